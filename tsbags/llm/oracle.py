"""DuckDB SQL for the rows of those operators that SQL can express."""

from __future__ import annotations

OP5 = """WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
sized AS (SELECT rid, doc_id, strlen(text) + 8 AS size,
 list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM d),
summed AS (SELECT rid, doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS text_crc32 FROM sized, crc),
costs AS (SELECT rid, s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS cost FROM summed, range(25) r(s)),
won AS (SELECT rid, arg_min(s, (cost, s)) FILTER (s < 24) AS shard, arg_min(s, (cost, s)) AS grown FROM costs GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM summed JOIN won USING (rid)"""

OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

OP8 = """WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT s, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM n),
cdf AS (SELECT s, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS p FROM r, LATERAL (SELECT unnest(range(ceil(rate + 12 * sqrt(rate) + 20)::INT + 1)) AS k)),
d AS (SELECT row_number() OVER () AS rid, *, (('0x' || substr(md5('mix-1/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT rid, any_value(rate) AS rate, count(*) AS times FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.s AND cdf.p <= d.u GROUP BY rid),
e AS (SELECT d.*, rate, unnest(range(1, times + 1)) AS copy FROM d JOIN c USING (rid))
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, copy::INT AS copy, md5('mix-1/' || coalesce(doc_id::VARCHAR, '') || '/' || copy) AS mix_key FROM e"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = rf"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS s FROM b, LATERAL (SELECT unnest(range(len(w) - least(10, len(w)) + 1)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM d, ks, LATERAL (SELECT unnest(range(len(w) - k + 1)) AS i)),
h AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)"""

_SAID = "</s>[INST] ok [/INST]"
OP10 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS body,
 CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 14 + 2 * strlen(role) END AS marks,
 CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS sign FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(body + marks)::BIGINT AS formatted_chars, regexp_full_match(string_agg(sign, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS lawful
FROM e GROUP BY conv_id"""

_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a string expression, with the table t of crc in scope."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, sha256({_HEAD} || {_field("text")}) AS leaf,
 sha256({_HEAD} || CASE WHEN doc_id IS NOT NULL AND {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_field(_LOW)} ELSE {_field("text")} END) AS altered FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS pos FROM d),
nodes AS (SELECT lang, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
 UNION ALL SELECT lang, level + 1, idx >> 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) >> 3) FROM nodes WHERE n > 1 GROUP BY lang, level, idx >> 3),
g AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos AS idx, h, count(*) OVER () AS n FROM g
 UNION ALL SELECT level + 1, idx >> 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) >> 3) FROM tops WHERE n > 1 GROUP BY level, idx >> 3),
steps AS (SELECT rid, s.level, s.idx, s.h, l.pos >> (3 * s.level) AS p FROM l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.n > 1 AND s.idx >> 3 = l.pos >> (3 * s.level + 3)
 UNION ALL SELECT rid, 100 + s.level, s.idx, s.h, g.pos >> (3 * s.level) FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN tops s ON s.n > 1 AND s.idx >> 3 = g.pos >> (3 * s.level + 3)),
way AS (SELECT *, dense_rank() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps),
folded AS (SELECT rid, 0::BIGINT AS k, altered AS h FROM l
 UNION ALL SELECT f.rid, f.k + 1, sha256(string_agg(CASE WHEN w.idx = w.p THEN f.h ELSE w.h END, '' ORDER BY w.idx)) FROM folded f JOIN way w ON w.rid = f.rid AND w.k = f.k + 1 GROUP BY f.rid, f.k),
ended AS (SELECT rid, arg_max(h, k) AS folded_root FROM folded GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(h, '' ORDER BY k, idx)) AS proof FROM way WHERE idx <> p GROUP BY rid)
SELECT doc_id, leaf, g.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN ended USING (rid) LEFT JOIN proofs USING (rid), (SELECT h FROM tops WHERE n = 1) r"""


def _with(way: str, cost: str, letters: str, line: str = "''") -> str:
    """A survivor (cost, letters, lines so far) with one more edit."""
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letters}', 'x': {way}.x || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


_U, _A = "'user:' || chr(10)", "'assistant:' || chr(10)"
_PUT_IN = f"""s0 AS t0, s1 AS t1, {_least("s2", *[_with(s, "2", "I", _U) for s in ("s0", "s1", "s3")])} AS t2,
 {_least("s3", _with("s2", "2", "I", _A), *[_with(s, "4", "II", f"{_U} || {_A}") for s in ("s0", "s1")])} AS t3"""
_LINE = {r: f"{r} || ':' || text || chr(10)" for r in ("role", "'user'", "'assistant'")}
_if = lambda test, way: f"CASE WHEN {test} THEN {way} END"
_STAYS = "fault NOT IN ('blank', 'duplicate')"
_TO_USER = [_if(f"{_STAYS} AND r = 'u'", _with(t, "u", "K", _LINE["role"])) for t in ("t0", "t1", "t3")] + [
    _if(_STAYS, _with(t, "2 + u", "R", _LINE["'user'"])) for t in ("t0", "t1", "t3")
]
_TO_ASSISTANT = [_if(f"{_STAYS} AND r = 'a'", _with("t2", "u", "K", _LINE["role"])), _if(_STAYS, _with("t2", "2 + u", "R", _LINE["'assistant'"]))]
_DROP = {t: _with(t, "3", "D") for t in ("t0", "t1", "t2", "t3")}
_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
OP13 = rf"""WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_KEY)} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM k, range(2) c(i) WHERE k <> 0 AND (i = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, nth > 1 AS again, left(role, 1) AS r
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
 WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
 lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS illegal FROM o),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'x': ''}} AS s0, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR) AS s1, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR) AS s2, NULL::STRUCT(c INT, a VARCHAR, x VARCHAR) AS s3 FROM conversations
 UNION ALL SELECT conv_id, i, {_DROP["t0"]}, {_least(_DROP["t1"], _if(f"{_STAYS} AND r = 's'", _with("t0", "u", "K", _LINE["role"])))}, {_least(_DROP["t2"], *_TO_USER)}, {_least(_DROP["t3"], *_TO_ASSISTANT)}
 FROM (SELECT v.conv_id, f.i, r, role, text, fault, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS u, {_PUT_IN} FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i + 1)),
ended AS (SELECT conv_id, {_least("t0", "t3")} AS best FROM (SELECT conv_id, {_PUT_IN} FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
 coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(left(best.x, greatest(length(best.x) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM e.conv_id"""
