"""DuckDB SQL in pieces: common table expressions that the oracle of a query is put together from."""

from __future__ import annotations

from tsbags.functions.positions import segment_starts
from tsbags.operators.discretize import GAUSSIAN

EVENTS = """points AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
 CAST(round(value * 100) AS BIGINT) AS value FROM events)"""
LABELS = """labels AS (SELECT DISTINCT user_id AS series_id, CAST(user_id % 3 AS INTEGER) AS label FROM events),
sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY label),
totals AS (SELECT sum(n) AS n_all, count(*) AS classes FROM sizes)"""
ORDERS = """points AS (SELECT o_custkey AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
 CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders)"""
EMBEDDINGS = """points AS (SELECT vec_id AS series_id, unnest(range(len(embedding))) AS pos,
 round(unnest(embedding)::DOUBLE * 1000000) AS value FROM embeddings),
labels AS (SELECT vec_id AS series_id, label FROM embeddings)"""
RUNNING = """sums AS (SELECT series_id, pos, value, sum(value) OVER w AS s, sum(value * value) OVER w AS s2, sum(pos * value) OVER w AS st,
 sum(value) OVER p AS s_all, sum(value * value) OVER p AS s2_all, sum(pos * value) OVER p AS st_all FROM points
 WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY series_id))"""
OWN = {"s": "value", "s2": "value * value", "st": "pos * value"}


def upto(name: str, k: int, pad: bool = False) -> str:
    if k == 0:
        return f"({name} - {OWN[name]})"
    ahead = f"lead({name}, {k - 1}) OVER o"
    return f"coalesce({ahead}, {name}_all)" if pad else ahead


def between(name: str, a: int, b: int, pad: bool = False) -> str:
    return f"CAST({upto(name, b, pad)} - {upto(name, a, pad)} AS DOUBLE)"


def windows(win: int, columns: str, pad: bool = False) -> str:
    """mean and std of every window, and more columns computed over the same window clause `o`."""
    start = f"lead(pos, {win - 1}) OVER o IS NOT NULL" + (" OR pos = 0" if pad else "")
    return f"""raw AS (SELECT series_id, pos, {between('s', 0, win, pad)} / {win}.0::DOUBLE AS mean,
 {between('s2', 0, win, pad)} / {win}.0::DOUBLE AS sq, {columns}, ({start}) AS go FROM sums WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
windowed AS (SELECT *, CASE WHEN sq - mean * mean > 0 THEN sqrt(sq - mean * mean) ELSE 1.0::DOUBLE END AS std FROM raw WHERE go)"""


def sax(win: int, m: int, pad: bool = False) -> str:
    """coeffs (series_id, pos, c0, c1, ...)."""
    parts = segment_starts(win, m)
    columns = ", ".join(f"{between('s', a, b, pad)} / {b - a}.0::DOUBLE AS m{i}" for i, (a, b) in enumerate(parts))
    coeffs = ", ".join(f"(m{i} - mean) / std AS c{i}" for i in range(m))
    return f"{RUNNING}, {windows(win, columns, pad)}, coeffs AS (SELECT series_id, pos, {coeffs} FROM windowed)"


def sla(win: int, m: int, mean: str = "mean", std: str = "std", from_series: bool = False) -> str:
    """mean, std: what is taken off and divided by. from_series: the time of a segment counts from the series' start."""
    parts = segment_starts(win, (m + 1) // 2)
    columns = ", ".join(
        f"{between('s', a, b)} AS t{i}, {between('st', a, b)} - (pos + {a}) * {between('s', a, b)} AS u{i}" for i, (a, b) in enumerate(parts)
    )
    lines = ", ".join(
        f"(u{i} - {(b - a - 1) / 2}::DOUBLE * t{i}) / ({(b - a) * ((b - a) ** 2 - 1) / 12}::DOUBLE * {std}) AS l{i}" for i, (a, b) in enumerate(parts)
    )
    middle = lambda a, b: f"(pos + {a + (b - a - 1) / 2}::DOUBLE)" if from_series else f"{(b - a - 1) / 2}::DOUBLE"
    coeffs = ", ".join(
        f"l{i} AS c{2 * i}, (t{i} / {b - a}.0::DOUBLE - {mean}) / {std} - l{i} * {middle(a, b)} AS c{2 * i + 1}" for i, (a, b) in enumerate(parts)
    )
    return f"{RUNNING}, {windows(win, columns)}, lines AS (SELECT *, {lines} FROM windowed), coeffs AS (SELECT series_id, pos, {coeffs} FROM lines)"


def pack(letters: list[str], bits: int) -> str:
    out = "0::BIGINT"
    for x in letters:
        out = f"(({out} << {bits}) | ({x})::BIGINT)"
    return out


def words(m: int, card: int, bits: int) -> str:
    """words (series_id, pos, word) by Gaussian cuts."""
    letters = [" + ".join(f"(c{i} >= {b}::DOUBLE)::INT" for b in GAUSSIAN[card]) for i in range(m)]
    return f"words AS (SELECT series_id, pos, {pack(letters, bits)} AS word FROM coeffs)"


def long(m: int, where: str = "TRUE") -> str:
    """vals (series_id, pos, letter, val)."""
    each = " UNION ALL ".join(f"SELECT series_id, pos, {i} AS letter, c{i} AS val FROM coeffs WHERE {where}" for i in range(m))
    return f"vals AS ({each})"


def equal_depth(keys: str, card: int, least: int = 3, source: str = "vals") -> str:
    """bounds (keys, bounds DOUBLE[])."""
    return f"""ranked AS (SELECT {keys}, val, row_number() OVER (PARTITION BY {keys} ORDER BY val) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
binned AS (SELECT *, greatest(n // {card}, {least}) AS size FROM ranked),
bounds AS (SELECT {keys}, coalesce(list_sort(list_distinct(list(val) FILTER (place % size = 0 AND place >= size AND place <= n - size)))[1:{card - 1}], []) AS bounds
 FROM binned GROUP BY {keys})"""


def info_gain(card: int, least: int = 3) -> str:
    """bounds (letter, bounds DOUBLE[]) of labelled (letter, val, label): every level of the recursion is a set of CTEs."""
    levels = max(card.bit_length() - 1, 1)
    parts = ["""placed AS (SELECT letter, val, label, row_number() OVER w - 1 AS place, lag(val) OVER w AS prev FROM labelled
 WINDOW w AS (PARTITION BY letter ORDER BY val, label))""", "lengths AS (SELECT letter, count(*) AS n FROM placed GROUP BY letter)",
             "iv0 AS (SELECT letter, 0::BIGINT AS a, n AS b FROM lengths)"]
    for k in range(levels):
        parts.append(f"""cand{k} AS (SELECT letter, a, b, place AS i, val AS split FROM iv{k} JOIN placed USING (letter) WHERE place > a AND place < b AND val <> prev AND b - a > {least}),
sides{k} AS (SELECT c.letter, a, b, i, split, label, sum((place < i)::INT)::DOUBLE AS lo, sum((place >= i)::INT)::DOUBLE AS hi
 FROM cand{k} c JOIN placed p ON c.letter = p.letter AND place >= a AND place < b GROUP BY ALL),
shares{k} AS (SELECT *, lo + hi AS t, (i - a)::DOUBLE AS nlo, (b - i)::DOUBLE AS nhi, (b - a)::DOUBLE AS n FROM sides{k}),
gains{k} AS (SELECT letter, a, b, i, split, sum(-t / n * log2(t / n)) - sum(CASE WHEN lo > 0 THEN -lo / nlo * log2(lo / nlo) ELSE 0 END) * any_value(nlo / n)
 - sum(CASE WHEN hi > 0 THEN -hi / nhi * log2(hi / nhi) ELSE 0 END) * any_value(nhi / n) AS gain FROM shares{k} GROUP BY letter, a, b, i, split HAVING count(*) > 1),
best{k} AS (SELECT * FROM gains{k} QUALIFY row_number() OVER (PARTITION BY letter, a, b ORDER BY round(gain, 9) DESC, i DESC) = 1),
big{k} AS (SELECT *, CASE WHEN i - a >= b - i THEN a ELSE i END AS low, CASE WHEN i - a >= b - i THEN i ELSE b END AS high FROM best{k}),
iv{k + 1} AS (SELECT letter, a, i AS b FROM big{k} WHERE least(i - a, b - i) >= {least} UNION ALL SELECT letter, i, b FROM big{k} WHERE least(i - a, b - i) >= {least}
 UNION ALL SELECT letter, low, low + (high - low) // 2 FROM big{k} WHERE least(i - a, b - i) < {least} AND high - low > {2 * least}
 UNION ALL SELECT letter, low + (high - low) // 2, high FROM big{k} WHERE least(i - a, b - i) < {least} AND high - low > {2 * least})""")
    every = " UNION ALL ".join(f"SELECT letter, i, split FROM best{k}" for k in range(levels))
    parts.append(f"""every AS ({every}),
bounds AS (SELECT letter, list_sort(list_distinct(list(split)))[1:{card - 1}] AS bounds FROM every JOIN lengths USING (letter) WHERE i <= n - {least} GROUP BY letter)""")
    return ", ".join(parts)


BAG = """kept AS (SELECT *, lag(word) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM words),
bag AS (SELECT series_id, word, count(*) AS cnt FROM kept WHERE before IS NULL OR before <> word GROUP BY series_id, word)"""
CLASSES = "classes AS (SELECT word, label, CAST(sum(cnt) AS BIGINT) AS cnt FROM bag JOIN labels USING (series_id) GROUP BY word, label)"


def f_stat(keys: str, value: str, source: str) -> str:
    """scored (keys, f)."""
    return f"""per AS (SELECT {keys}, label, CAST(sum({value}) AS DOUBLE) AS s, CAST(sum({value} * {value}) AS DOUBLE) AS s2 FROM {source} GROUP BY {keys}, label),
added AS (SELECT {keys}, n_all, classes, sum(s) AS t, sum(s2) AS x2, sum(s * s / n) AS g FROM per JOIN sizes USING (label), totals GROUP BY {keys}, n_all, classes),
scored AS (SELECT {keys}, CASE WHEN x2 - g > greatest(1.0, x2) * 1e-9 AND n_all > classes AND classes > 1
 THEN (g - t * t / n_all) * (n_all - classes) / ((x2 - g) * (classes - 1)) ELSE 0.0 END AS f FROM added)"""


RANKS = "ranks AS (SELECT word, f, row_number() OVER (ORDER BY round(f, 9) DESC, word) AS rk FROM scored WHERE f > 0)"
PROFILE = """profile AS (SELECT word, label, cnt, cnt / n AS mean_cnt,
 (1 + log10(cnt)) * log10(1 + (SELECT count(*) FROM sizes) / count(*) OVER (PARTITION BY word)) AS tfidf FROM classes JOIN sizes USING (label))"""
TERMS = """grid AS (SELECT series_id, l.label AS own, rk, ranks.word, z.label, n, coalesce(c.cnt, 0) AS cnt
 FROM labels l CROSS JOIN ranks CROSS JOIN sizes z LEFT JOIN classes c ON c.word = ranks.word AND c.label = z.label),
out1 AS (SELECT g.*, coalesce(b.cnt, 0) AS x FROM grid g LEFT JOIN bag b USING (series_id, word)),
out2 AS (SELECT *, cnt - CASE WHEN label = own THEN x ELSE 0 END AS s, CASE WHEN label = own AND n > 1 THEN n - 1 ELSE n END AS m FROM out1),
out3 AS (SELECT *, sum((s > 0)::INT) OVER (PARTITION BY series_id, rk) AS holders, count(*) OVER (PARTITION BY series_id, rk) AS number FROM out2),
terms AS (SELECT series_id, own, rk, label, (s / m - x) * (s / m - x) AS ed, CASE WHEN s > 0 THEN (1 + log10(s)) * log10(1 + number / holders) ELSE 0.0 END AS tfidf,
 CASE WHEN x > 0 THEN 1 + log10(x) ELSE 0.0 END AS tf FROM out3),
swept AS (SELECT series_id, own, rk, label, sum(ed) OVER w AS ed, sum(tf * tfidf) OVER w AS p, sum(tfidf * tfidf) OVER w AS c, sum(tf * tf) OVER w AS j FROM terms
 WINDOW w AS (PARTITION BY series_id, label ORDER BY rk ROWS UNBOUNDED PRECEDING)),
measured AS (SELECT series_id, own, rk, label, round(ed, 9) AS ed, round(CASE WHEN c * j > 0 THEN p * p / (c * j) ELSE 0.0 END, 9) AS cos FROM swept)"""
PREDICTED = """ed AS (SELECT series_id, own, rk, label FROM measured QUALIFY row_number() OVER (PARTITION BY series_id, rk ORDER BY ed, label) = 1),
cosine AS (SELECT series_id, own, rk, label FROM measured QUALIFY row_number() OVER (PARTITION BY series_id, rk ORDER BY cos DESC, label) = 1),
accuracies AS (SELECT 'ed' AS sim, rk, sum((label = own)::INT)::BIGINT AS n_correct, sum((label = own)::INT) / count(*) AS accuracy FROM ed GROUP BY rk
 UNION ALL SELECT 'cos', rk, sum((label = own)::INT)::BIGINT, sum((label = own)::INT) / count(*) FROM cosine GROUP BY rk),
best AS (SELECT sim, rk AS n_selected, accuracy AS cv_score FROM accuracies QUALIFY row_number() OVER (PARTITION BY sim ORDER BY accuracy DESC, rk DESC) = 1)"""


def query(*parts: str) -> str:
    """WITH all but the last part, then the last one."""
    return f"WITH RECURSIVE {', '.join(parts[:-1])} {parts[-1]}"
