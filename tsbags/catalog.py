"""All queries of the library by operator, each beside the DuckDB SQL that gives the same rows.

Most run on events (a series per user, window 20, words of 4 letters out of 4); labels are user_id % 3. Doubles are
rounded on both sides.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.functions import bits, positions
from tsbags.operators import bags, classify, discretize, ensemble, grid, kernel, profiles, scores, subclasses
from tsbags.plans import bopf, hybrid, measured
from tsbags.plans import oracle as Q
from tsbags.plans.common import ranked_counts, sizes_of, swept
from tsbags.sources import series as S
from tsbags.session import cut, table
from tsbags.streaming.scoring import score_stream

FLAGSHIP = "e3_chi2"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WIN, SIZE, CARD = 20, 4, 4
BITS = bits.num_bits(CARD)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tsbags-")
    return os.path.join(top, f"{name}-{uuid.uuid4().hex}")


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def listed(values: str | Column) -> Column:
    return F.concat_ws(",", F.transform(values, lambda v: v.cast("long").cast("string")))


def _points(spark, d):
    return S.events_user(spark, d)


def _long_points(spark, d):
    """The same places by ranges of events, so no task holds a series."""
    value = F.round(F.col("value") * 100).cast("long")
    return S.points_of_long_events(table(spark, d, "events"), "user_id", ["ts", "event_id"], value)


def _series(spark, d):
    """The same as series of doubles."""
    rows = S.wide(_points(spark, d))
    return rows.withColumn("values", F.transform("values", lambda v: v.cast("double")))


def _words(spark, d):
    return discretize.words(positions.sax(_points(spark, d), WIN, SIZE), SIZE, CARD)


def _bag(spark, d):
    return bags.count_bag(_words(spark, d))


def _labels(spark, d):
    return S.events_labels(spark, d)


def _labelled(spark, d):
    return _bag(spark, d).join(_labels(spark, d), "series_id")


def _sizes(spark, d):
    return S.class_sizes(_labels(spark, d))


def _ranks(spark, d):
    return scores.rank_words(scores.f_statistic(_labelled(spark, d), ["word"], "cnt", _sizes(spark, d)), "f", [], drop_zero=True)


WORDS = (Q.EVENTS, Q.sax(WIN, SIZE), Q.words(SIZE, CARD, BITS))
BAG = (*WORDS, Q.BAG)
CLASSES = (*BAG, Q.LABELS, Q.CLASSES)
LABELLED = "labelled AS (SELECT * FROM bag JOIN labels USING (series_id))"
RANKED = (*CLASSES, LABELLED, Q.f_stat("word", "cnt", "labelled"), Q.RANKS)

# Sources and sinks.


@query("""SELECT label::DOUBLE AS raw_label, len(embedding)::INT AS len,
 array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS vals FROM embeddings""")
def s1_text_series(spark, d):
    path = shared_folder(spark, "text")
    rows = S.embedding_series(spark, d)
    rows.select(F.concat_ws("\t", F.col("label").cast("string"), F.concat_ws(" , ", F.transform("values", lambda v: v.cast("string"))), F.lit("NaN")).alias("value")).write.text(path)
    return S.read_text_series(spark, path).select("raw_label", "len", listed("values").alias("vals"))


@query(Q.query(Q.EVENTS, "SELECT series_id, count(*)::INT AS len, string_agg(value::VARCHAR, ',' ORDER BY pos) AS vals FROM points GROUP BY series_id"))
def s2_series(spark, d):
    return S.wide(_points(spark, d)).select("series_id", "len", listed("values").alias("vals"))


@query(Q.query(Q.EVENTS, "w AS (SELECT series_id, count(*) AS len, string_agg(value::VARCHAR, ',' ORDER BY pos) AS vals FROM points GROUP BY series_id)",
               "SELECT series_id, len::INT AS len, vals || repeat(',0', (max(len) OVER () - len)::INT) AS vals FROM w"))
def s3_zero_pad(spark, d):
    return S.zero_pad(S.wide(_points(spark, d))).select("series_id", "len", listed("values").alias("vals"))


@query(Q.query(Q.LABELS, "firsts AS (SELECT label, min(series_id) AS f FROM labels WHERE series_id % 4 <> 0 GROUP BY label)",
               "mapped AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS new FROM firsts)",
               "SELECT series_id, (label - 1)::DOUBLE AS raw_label, new::INT AS label FROM labels JOIN mapped USING (label)"))
def s4_relabel(spark, d):
    raw = _labels(spark, d).select("series_id", (F.col("label") - 1).cast("double").alias("raw_label"))
    mapping = S.label_map(raw.filter("series_id % 4 <> 0"))
    return S.relabel(raw, mapping).select("series_id", "raw_label", F.col("label").cast("int").alias("label"))


@query(Q.query(Q.EVENTS, Q.LABELS, "w AS (SELECT series_id, label, count(*) AS len FROM points JOIN labels USING (series_id) GROUP BY series_id, label)",
               "SELECT count(*) AS n_series, min(len)::INT AS min_len, max(len)::INT AS max_len, count(DISTINCT label) AS n_classes FROM w"))
def s5_stats(spark, d):
    return S.stats(S.wide(_points(spark, d)).join(_labels(spark, d), "series_id"))


@query(Q.query(Q.LABELS, "SELECT 'events' AS dataset, 'run-1' AS run_id, 'class ' || label AS variant, round(n / n_all, 6) AS accuracy FROM sizes, totals"))
def s6_results(spark, d):
    sizes = _sizes(spark, d)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    rows = sizes.select(
        F.lit("events").alias("dataset"), F.lit("run-1").alias("run_id"), F.concat(F.lit("class "), "label").alias("variant"),
        F.round(share, 6).alias("accuracy"), F.lit(0.0).alias("train_s"), F.lit(0.0).alias("test_s_per_series"),
    )
    path = shared_folder(spark, "results")
    S.write_results(rows, path)
    return spark.read.parquet(path).select(F.col("dataset").cast("string"), "run_id", "variant", "accuracy")


# Positions.


@query(Q.query(Q.EVENTS, Q.RUNNING, """SELECT series_id, pos + 1 AS pos, s::BIGINT AS s, s2::BIGINT AS s2, st::BIGINT AS st FROM sums
 UNION ALL SELECT DISTINCT series_id, 0, 0, 0, 0 FROM points"""))
def p1_prefix_sums(spark, d):
    return positions.prefix_sums(_points(spark, d)).select("series_id", F.col("pos").cast("long"), "s", "s2", "st")


@query(Q.query(Q.EVENTS, Q.sax(WIN, SIZE), "SELECT series_id, pos, round(mean, 6) AS mean, round(std, 6) AS std FROM windowed"))
def p2_window_stats(spark, d):
    return positions.window_stats(_points(spark, d), WIN).select("series_id", F.col("pos").cast("long"), *six("mean", "std"))


#: Positions of a range: series of some 70 points are cut into several here, over as many tasks.
RANGE = 32


@query(ORACLE_SQL["p1_prefix_sums"])
def p1_prefix_sums_in_pieces(spark, d):
    return positions.prefix_sums(_long_points(spark, d), RANGE).select("series_id", F.col("pos").cast("long"), "s", "s2", "st")


@query(ORACLE_SQL["p2_window_stats"])
def p2_window_stats_in_pieces(spark, d):
    return positions.window_stats(_long_points(spark, d), WIN, piece=RANGE).select("series_id", F.col("pos").cast("long"), *six("mean", "std"))


@query(Q.query(Q.EVENTS, "t AS (SELECT series_id, pos, sum(value) OVER w AS total, count(*) OVER w AS k FROM points WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))",
               "SELECT series_id, pos, total::BIGINT AS total FROM t WHERE k = 5"))
def p3_segment_sums(spark, d):
    return positions.segment_sums(_points(spark, d), 5).select("series_id", F.col("pos").cast("long"), "total")


@query(Q.query(Q.EVENTS, """SELECT series_id, pos, list_sum(range(pos, pos + 5))::BIGINT AS sum_t, round(list_sum(list_transform(range(pos, pos + 5), lambda t: t * t)) / 5, 6) AS mean_t2
 FROM points"""))
def p4_position_forms(spark, d):
    a, b = F.col("pos"), F.col("pos") + 4
    return _points(spark, d).select(
        "series_id", F.col("pos").cast("long"), positions.sum_between(a, b).alias("sum_t"), F.round(positions.squares_between(a, b) / 5, 6).alias("mean_t2")
    )


@query(Q.query(Q.EVENTS, "w AS (SELECT series_id, count(*) AS len FROM points GROUP BY series_id)",
               "SELECT series_id, seg::INT AS seg, (seg * (len // 4))::INT AS seg_start, (CASE WHEN seg = 3 THEN len ELSE (seg + 1) * (len // 4) END)::INT AS seg_end FROM w, range(4) r(seg)"))
def p5_segments(spark, d):
    lengths = S.wide(_points(spark, d))
    return lengths.select("series_id", F.inline(positions.segments_of(F.col("len"), SIZE)).alias("seg", "seg_start", "seg_end"))


@query(Q.query(Q.EVENTS, "w AS (SELECT count(*) AS len FROM points GROUP BY series_id)", "m AS (SELECT min(len) AS l FROM w)",
               "g AS (SELECT least(greatest(round_even(l * 0.025, 0)::INT, 10), l) AS a, l AS b, greatest(round_even(l * 0.025, 0)::INT, 1) AS st FROM m)",
               "SELECT unnest(range(a, b + 1, st))::INT AS win_len FROM g"))
def p6_window_grid(spark, d):
    shortest = S.wide(_points(spark, d)).agg(F.min("len").alias("l"))
    return shortest.select(F.explode(positions.length_grid(F.col("l"))).alias("win_len"))


@query(Q.query(Q.EVENTS, "w AS (SELECT series_id, count(*) - 20 AS last FROM points GROUP BY series_id HAVING count(*) >= 20)",
               "SELECT series_id, unnest(list_distinct(list_append(range(0, last + 1, 7), last)))::INT AS pos FROM w"))
def p7_window_positions(spark, d):
    lengths = S.wide(_points(spark, d)).filter(F.col("len") >= WIN)
    return lengths.select("series_id", F.explode(positions.positions(F.col("len") - WIN, 7, with_last=True)).alias("pos"))


def _rounded(coeffs: DataFrame, n: int) -> DataFrame:
    return coeffs.select("series_id", F.col("pos").cast("long"), *[F.round(F.get("coeffs", F.lit(i)), 6).alias(f"c{i}") for i in range(n)])


C4 = ", ".join(f"round(c{i}, 6) AS c{i}" for i in range(4))


@query(Q.query(Q.EVENTS, Q.sax(WIN, SIZE), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p8_sax(spark, d):
    return _rounded(positions.sax(_points(spark, d), WIN, SIZE), SIZE)


@query(ORACLE_SQL["p8_sax"])
def p8_sax_in_pieces(spark, d):
    return _rounded(positions.sax(_long_points(spark, d), WIN, SIZE, piece=RANGE), SIZE)


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p9_sla(spark, d):
    return _rounded(positions.sla(_points(spark, d), WIN, 4), 4)


@query(ORACLE_SQL["p9_sla"])
def p9_sla_in_pieces(spark, d):
    return _rounded(positions.sla(_long_points(spark, d), WIN, 4, piece=RANGE), 4)


C6 = ", ".join(f"round(c{i}, 6) AS c{i}" for i in range(6))


@query(Q.query(Q.EVENTS, Q.sla(WIN, 5), f"SELECT series_id, pos, {C6} FROM coeffs"))
def p9_sla_odd_size(spark, d):
    return _rounded(positions.sla(_points(spark, d), WIN, 5), 6)


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4, mean="0.0::DOUBLE"), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p9_sla_without_mean(spark, d):
    return _rounded(positions.sla(_points(spark, d), WIN, 4, mean_norm=False), 4)


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4, std="1.0::DOUBLE"), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p9_sla_without_std(spark, d):
    return _rounded(positions.sla(_points(spark, d), WIN, 4, std_norm=False), 4)


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4, from_series=True), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p9_sla_without_pos(spark, d):
    return _rounded(positions.sla(_points(spark, d), WIN, 4, pos_norm=False), 4)


@query(Q.query(Q.ORDERS, Q.sax(12, 4, pad=True), f"SELECT series_id, pos, {C4} FROM coeffs"))
def p10_short_series(spark, d):
    return _rounded(positions.sax(S.orders_customer(spark, d), 12, 4, pad=True), 4)


# Discretisation.


@query(Q.query(Q.EVENTS, Q.LABELS, "m AS (SELECT label, sum(value)::DOUBLE / count(*) AS a, sum(value * value)::DOUBLE / count(*) AS q FROM points JOIN labels USING (series_id) GROUP BY label)",
               "c AS (SELECT label, a, sqrt(q - a * a) AS sd, unnest([-0.67::DOUBLE, 0, 0.67]) AS b, unnest([0, 1, 2]) AS i FROM m)",
               "SELECT label, i::INT AS cut, round(b * sd + a, 2) AS bound FROM c"))
def d1_gaussian_cuts(spark, d):
    rows = _points(spark, d).join(_labels(spark, d), "series_id")
    mean = F.sum("value").cast("double") / F.count("*")
    square = F.sum(F.col("value") * F.col("value")).cast("double") / F.count("*")
    fitted = rows.groupBy("label").agg(mean.alias("a"), square.alias("q")).withColumn("sd", F.sqrt(F.col("q") - F.col("a") * F.col("a")))
    return fitted.select("label", F.posexplode(discretize.gaussian_cuts(CARD, F.col("a"), F.col("sd"))).alias("cut", "bound"))


def _sampled(coeffs: DataFrame) -> DataFrame:
    return discretize.long_coeffs(coeffs.filter(F.col("pos") % WIN == 0), ("series_id", "pos"))


def _bounds_out(bounds: DataFrame, *keys: str) -> DataFrame:
    return bounds.select(*keys, F.posexplode("bounds").alias("cut", "bound")).select(*keys, "cut", F.round("bound", 6).alias("bound"))


def _bounds_sql(keys: str) -> str:
    return f"SELECT {keys}, (unnest(range(len(bounds))))::INT AS cut, round(unnest(bounds), 6) AS bound FROM bounds"


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4), Q.long(4, "pos % 20 = 0"), Q.equal_depth("letter", 4), _bounds_sql("letter")))
def d2_equal_depth(spark, d):
    return _bounds_out(discretize.equal_depth(_sampled(positions.sla(_points(spark, d), WIN, 4)), 4), "letter")


@query(Q.query(Q.EVENTS, Q.sax(WIN, SIZE), Q.long(SIZE), Q.equal_depth("series_id, letter", 3), _bounds_sql("series_id, letter")))
def d3_equal_depth_by_series(spark, d):
    coeffs = positions.sax(_points(spark, d), WIN, SIZE)
    values = discretize.long_coeffs(coeffs, ("series_id", "pos"))
    return _bounds_out(discretize.equal_depth(values, 3, ("series_id", "letter")), "series_id", "letter")


@query(Q.query(Q.EVENTS, Q.sax(WIN, SIZE), Q.long(SIZE, "pos % 20 = 0"), Q.LABELS, "labelled AS (SELECT letter, val, label FROM vals JOIN labels USING (series_id))",
               Q.info_gain(CARD), _bounds_sql("letter")))
def d4_info_gain_bounds(spark, d):
    values = _sampled(positions.sax(_points(spark, d), WIN, SIZE)).join(_labels(spark, d), "series_id").select("letter", "val", "label")
    return _bounds_out(discretize.info_gain_bounds(values, CARD), "letter")


@query("""WITH v AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, round(unnest(embedding)::DOUBLE * 1000000) AS val FROM embeddings),
pv AS (SELECT dim, val, label, count(*) AS c FROM v GROUP BY ALL), ls AS (SELECT DISTINCT dim, label FROM pv), vs AS (SELECT DISTINCT dim, val FROM pv),
g AS (SELECT vs.dim, vs.val, ls.label, coalesce(c, 0) AS c FROM vs JOIN ls USING (dim) LEFT JOIN pv ON pv.dim = vs.dim AND pv.val = vs.val AND pv.label = ls.label),
s AS (SELECT dim, val, label, coalesce(sum(c) OVER (PARTITION BY dim, label ORDER BY val ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(c) OVER (PARTITION BY dim, label) AS t FROM g),
n AS (SELECT *, t - b AS a, sum(b) OVER w AS nb, sum(t) OVER w AS nt, max(t - b) OVER w AS most FROM s WINDOW w AS (PARTITION BY dim, val)),
e AS (SELECT dim, val, nb, nt, sum(CASE WHEN b > 0 THEN -b / nb * log2(b / nb) ELSE 0 END) AS eb, sum(CASE WHEN a > 0 THEN -a / (nt - nb) * log2(a / (nt - nb)) ELSE 0 END) AS ea,
 sum(CASE WHEN t > 0 THEN -t / nt * log2(t / nt) ELSE 0 END) AS et, string_agg(CASE WHEN a = most THEN label::VARCHAR END, ',' ORDER BY label) AS majority FROM n GROUP BY ALL),
r AS (SELECT dim, val, majority, round(et - (nb * eb + (nt - nb) * ea) / nt, 9) AS gain FROM e WHERE nb > 0)
SELECT dim, round(gain, 6) AS gain, val AS split, majority FROM r QUALIFY row_number() OVER (PARTITION BY dim ORDER BY gain DESC, val DESC) = 1""")
def d5_single_split(spark, d):
    rows = S.embedding_series(spark, d).select("label", F.posexplode("values").alias("dim", "val"))
    return discretize.single_split(rows, ["dim"]).select("dim", F.round("gain", 6).alias("gain"), "split", F.concat_ws(",", F.transform("majority", lambda x: x.cast("string"))).alias("majority"))


@query("""WITH c AS (SELECT event_type, user_id % 3 AS label, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY event_type) AS n FROM c)
SELECT event_type, n::BIGINT AS total, round(sum(-c / n * log2(c / n)), 6) AS entropy FROM t GROUP BY event_type, n""")
def d6_entropy(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("label"))
    return discretize.class_entropy(rows, ["event_type"]).select("event_type", "total", *six("entropy"))


LETTERS = (Q.EVENTS, Q.sax(WIN, SIZE), Q.long(SIZE), Q.LABELS, "labelled AS (SELECT * FROM vals JOIN labels USING (series_id))",
           Q.f_stat("letter", "val", "labelled"))


@query(Q.query(*LETTERS, "SELECT letter, round(f, 6) AS f, (row_number() OVER (ORDER BY round(f, 9) DESC, letter) - 1)::INT AS place FROM scored"))
def d7_letter_order(spark, d):
    values = discretize.long_coeffs(positions.sax(_points(spark, d), WIN, SIZE)).join(_labels(spark, d), "series_id")
    return discretize.letter_order(values, _sizes(spark, d)).select("letter", *six("f"), "place")


@query(Q.query(Q.EVENTS, Q.sax(WIN, SIZE), Q.long(SIZE, "pos % 20 = 0"), "shared AS (SELECT CASE WHEN letter < 2 THEN 0 ELSE 1 END AS letter, val FROM vals)",
               Q.equal_depth("letter", 4, source="shared"), _bounds_sql("letter")))
def d8_letter_groups(spark, d):
    values = discretize.pooled(_sampled(positions.sax(_points(spark, d), WIN, SIZE)), {0: 0, 1: 0, 2: 1, 3: 1})
    return _bounds_out(discretize.equal_depth(values, 4), "letter")


def _places(words: DataFrame, *more: Column) -> DataFrame:
    return words.select("series_id", F.col("pos").cast("long"), *more)


@query(Q.query(*WORDS, "SELECT series_id, pos, word FROM words"))
def d9_encode(spark, d):
    return _places(_words(spark, d), F.col("word"))


SLA_LETTERS = [f"len(list_filter(b{i}, lambda v: v <= c{i}))" for i in range(4)]


@query(Q.query(Q.EVENTS, Q.sla(WIN, 4), Q.long(4, "pos % 20 = 0"), Q.equal_depth("letter", 3),
               "one AS (SELECT " + ", ".join(f"any_value(bounds) FILTER (letter = {i}) AS b{i}" for i in range(4)) + " FROM bounds)",
               f"SELECT series_id, pos, {Q.pack(SLA_LETTERS, 2)} AS word FROM coeffs, one"))
def d10_fitted_words(spark, d):
    coeffs = positions.sla(_points(spark, d), WIN, 4)
    return _places(discretize.words(coeffs, 4, 3, discretize.equal_depth(_sampled(coeffs), 3)), F.col("word"))


@query(Q.query(
    *WORDS, "lasts AS (SELECT series_id, max(pos) AS last FROM words GROUP BY series_id)",
    "anchors AS (SELECT DISTINCT series_id, pos FROM (SELECT series_id, pos FROM words WHERE pos % 20 = 0 UNION ALL SELECT series_id, last FROM lasts))",
    "firsts AS (SELECT series_id, pos AS lo, lead(pos) OVER (PARTITION BY series_id ORDER BY pos) AS hi FROM anchors)",
    """parts(series_id, lo, hi, same, word) AS (
 SELECT f.series_id, lo, hi, a.word = b.word, a.word FROM firsts f JOIN words a ON a.series_id = f.series_id AND a.pos = lo JOIN words b ON b.series_id = f.series_id AND b.pos = hi
 UNION ALL SELECT p.series_id, n.lo, n.hi, a.word = b.word, a.word FROM parts p, LATERAL (SELECT p.lo + (p.hi - p.lo + 1) // 2 AS mid) m,
 LATERAL (SELECT p.lo AS lo, mid AS hi UNION ALL SELECT mid, p.hi) n JOIN words a ON a.series_id = p.series_id AND a.pos = n.lo JOIN words b ON b.series_id = p.series_id AND b.pos = n.hi
 WHERE NOT p.same AND p.hi - p.lo >= 2)""",
    "filled AS (SELECT series_id, lo, hi, word FROM parts WHERE same AND hi - lo >= 2)",
    "SELECT w.series_id, w.pos, coalesce(f.word, w.word) AS word FROM words w LEFT JOIN filled f ON f.series_id = w.series_id AND w.pos > f.lo AND w.pos < f.hi",
))
def d11_local_fill(spark, d):
    return _places(discretize.filled_words(_words(spark, d), WIN), F.col("word"))


@query(ORACLE_SQL["d11_local_fill"])
def d11_lazy_fill(spark, d):
    """The same words, looking only at the windows that filling needs."""
    words = grid.grid_words(_series(spark, d), [grid.Config(0, "sax", SIZE, WIN, CARD, fill=True)])
    return _places(words, F.col("word"))


@query(Q.query(*WORDS, "SELECT series_id, pos, word >> 2 AS word FROM words"))
def d12_shorten(spark, d):
    return _places(_words(spark, d), discretize.shorten(F.col("word"), 1, CARD).alias("word"))


@query(Q.query(*WORDS, "p AS (SELECT *, lag(word) OVER (PARTITION BY series_id ORDER BY pos) AS q FROM words)",
               "SELECT series_id, pos, (" + " + ".join(f"abs(((word >> {2 * i}) & 3) - ((q >> {2 * i}) & 3))" for i in range(4)) + ")::BIGINT AS dist FROM p WHERE q IS NOT NULL"))
def d13_word_distance(spark, d):
    pairs = _words(spark, d).withColumn("q", F.lag("word").over(positions.by_pos())).filter("q is not null")
    return _places(pairs, discretize.distance(F.col("word"), F.col("q"), SIZE, CARD).cast("long").alias("dist"))


@query(Q.query(*CLASSES, "asked AS (SELECT DISTINCT word FROM words)",
               "pairs AS (SELECT a.word, c.label, c.word AS nearest, " + " + ".join(f"abs(((a.word >> {2 * i}) & 3) - ((c.word >> {2 * i}) & 3))" for i in range(4)) + " AS dist FROM asked a CROSS JOIN classes c WHERE c.cnt > 1)",
               "SELECT word, label, nearest, dist::INT AS dist FROM pairs QUALIFY row_number() OVER (PARTITION BY word, label ORDER BY dist, nearest) = 1"))
def d13_nearest_word(spark, d):
    """The nearest word of every class that it has more than once, for every word there is."""
    often = bags.class_bag(_bag(spark, d), _labels(spark, d)).filter("cnt > 1")
    return discretize.nearest_words(_words(spark, d), often, SIZE, CARD, ("label",)).select("word", "label", "nearest", "dist")


@query(Q.query(*WORDS, """SELECT series_id, pos, (word << 2) | 3 AS appended, word >> 4 AS trimmed, (word >> 2) & 15 AS got, (word & ~(15 << 2)) | (5 << 2) AS put,
 word & ~(15 << 2) AS zeros, word | (15 << 2) AS ones FROM words"""))
def d14_bits(spark, d):
    w = F.col("word")
    return _places(
        _words(spark, d), bits.append_bits(w, F.lit(3), 2).alias("appended"), bits.trim_bits(w, 4).alias("trimmed"), bits.get_bits(w, 2, 4).alias("got"),
        bits.set_bits(w, F.lit(5), 2, 4).alias("put"), bits.set_bits_to_0(w, 2, 4).alias("zeros"), bits.set_bits_to_1(w, 2, 4).alias("ones"),
    )


# Bags.


@query(Q.query(*BAG, "SELECT series_id, word, cnt FROM bag"))
def b1_count_bag(spark, d):
    return _bag(spark, d)


@query(Q.query(*WORDS, "SELECT DISTINCT series_id, word FROM words"))
def b2_binary_bag(spark, d):
    return bags.binary_bag(_words(spark, d))


BIGRAMS = ("pairs AS (SELECT series_id, pos, (word << 8) | lead(word, 20) OVER (PARTITION BY series_id ORDER BY pos) AS word FROM words QUALIFY lead(word, 20) OVER (PARTITION BY series_id ORDER BY pos) IS NOT NULL)",
           "kept2 AS (SELECT *, lag(word) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM pairs)",
           "marked AS (SELECT series_id, word << 1 AS word, cnt FROM bag UNION ALL SELECT series_id, (word << 1) | 1, count(*) FROM kept2 WHERE before IS NULL OR before <> word GROUP BY series_id, word)")


@query(Q.query(*BAG, *BIGRAMS, "SELECT series_id, word, cnt FROM marked"))
def b3_bigrams(spark, d):
    return bags.marked_bag(_words(spark, d), WIN, SIZE, CARD)


@query(Q.query(*BAG, "SELECT word, series_id, cnt FROM bag"))
def b4_inverted(spark, d):
    return bags.inverted(_bag(spark, d)).select("word", "series_id", "cnt")


@query(Q.query(*CLASSES, "SELECT word, label, cnt FROM classes"))
def b5_class_bag(spark, d):
    return bags.class_bag(_bag(spark, d), _labels(spark, d))


@query(Q.query(*CLASSES, "one AS (SELECT word, label, cnt AS x FROM bag JOIN labels USING (series_id) WHERE series_id = 1)",
               "SELECT word, label, cnt - coalesce(x, 0) AS cnt FROM classes LEFT JOIN one USING (word, label) WHERE cnt > coalesce(x, 0)"))
def b6_class_bag_without_one(spark, d):
    bag, labels = _bag(spark, d), _labels(spark, d)
    return bags.class_bag_without(bags.class_bag(bag, labels), bag, labels, 1)


@query(Q.query(*BAG, *BIGRAMS, """short AS (SELECT series_id, cnt, CASE WHEN word & 1 = 1 THEN (((word >> 13) << 4 | ((word >> 5) & 15)) << 1) | 1 ELSE (word >> 5) << 1 END AS word FROM marked)""",
               "SELECT series_id, word, sum(cnt)::BIGINT AS cnt FROM short GROUP BY series_id, word"))
def b7_coarsen(spark, d):
    return bags.coarsen(bags.marked_bag(_words(spark, d), WIN, SIZE, CARD), 2, SIZE, CARD, marked=True)


@query(Q.query(*BAG, "top AS (SELECT word FROM bag GROUP BY word ORDER BY sum(cnt) DESC, word LIMIT 1)",
               "SELECT series_id, coalesce(max(cnt) FILTER (word = (SELECT word FROM top)), 0)::BIGINT AS cnt FROM (SELECT DISTINCT series_id FROM points) LEFT JOIN bag USING (series_id) GROUP BY series_id"))
def b8_dense_count(spark, d):
    bag = _bag(spark, d)
    word = bag.groupBy("word").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "word").first()["word"]
    return bags.dense_count(bag, _labels(spark, d), word)


# Scores.


@query(Q.query(*CLASSES, LABELLED, Q.f_stat("word", "cnt", "labelled"), "SELECT word, round(f, 6) AS f FROM scored"))
def e1_f_statistic(spark, d):
    return scores.f_statistic(_labelled(spark, d), ["word"], "cnt", _sizes(spark, d)).select("word", *six("f"))


@query(Q.query("labelled AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, round(unnest(embedding)::DOUBLE * 1000000) AS val FROM embeddings)",
               "sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)", "totals AS (SELECT sum(n) AS n_all, count(*) AS classes FROM sizes)",
               Q.f_stat("dim", "val", "labelled"), "SELECT dim, round(f, 6) AS f FROM scored"))
def e2_f_statistic_columns(spark, d):
    rows = S.embedding_series(spark, d)
    return scores.f_statistic(rows.select("label", F.posexplode("values").alias("dim", "val")), ["dim"], "val", S.class_sizes(rows)).select("dim", *six("f"))


@query(Q.query("labelled AS (SELECT label, unnest(range(len(embedding)))::INT AS word, round(unnest(embedding)::DOUBLE * 1000000) AS val FROM embeddings UNION ALL SELECT label, -1, label FROM embeddings)",
               "sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)", "totals AS (SELECT sum(n) AS n_all, count(*) AS classes FROM sizes)", Q.f_stat("word", "val", "labelled"),
               "said AS (SELECT word, f, x2 - g <= greatest(1.0, x2) * 1e-9 AND g - t * t / n_all > greatest(1.0, x2) * 1e-9 AND n_all > classes AND classes > 1 AS perfect FROM scored JOIN added USING (word))",
               "SELECT word, perfect, round(f, 6) AS f, (row_number() OVER (ORDER BY perfect DESC, round(f, 9) DESC, word))::INT AS rk FROM said WHERE perfect OR f > 0"))
def e1_f_statistic_perfect_first(spark, d):
    """Beside the columns, the label itself is a value, which separates the classes perfectly."""
    rows = S.embedding_series(spark, d)
    values = rows.select("label", F.posexplode("values").alias("word", "val")).union(rows.select("label", F.lit(-1), F.col("label").cast("double")))
    ranked = scores.rank_words(scores.f_statistic(values, ["word"], "val", S.class_sizes(rows), perfect=float("inf")), "f", [], drop_zero=True)
    perfect = F.col("f") == float("inf")
    return ranked.select("word", perfect.alias("perfect"), F.when(perfect, 0.0).otherwise(F.round("f", 6)).alias("f"), "rk")


@query(Q.query(*CLASSES, "per AS (SELECT word, cnt AS s, n, n_all FROM classes JOIN sizes USING (label), totals)",
               "SELECT word, round(sum(s * s * n_all / n) / sum(s) - sum(s), 6) AS chi2 FROM per GROUP BY word"))
def e3_chi2(spark, d):
    return scores.chi_square(_labelled(spark, d), ["word"], "cnt", _sizes(spark, d)).select("word", *six("chi2"))


@query(Q.query(*RANKED, "SELECT word, round(f, 6) AS f, rk::INT AS rk FROM ranks"))
def e4_rank_words(spark, d):
    return _ranks(spark, d).select("word", *six("f"), "rk")


@query(ORACLE_SQL["e4_rank_words"])
def e4_rank_many_words(spark, d):
    f = scores.f_statistic(_labelled(spark, d), ["word"], "cnt", _sizes(spark, d))
    return scores.rank_many_words(f, "f", [], drop_zero=True).select("word", *six("f"), "rk")


@query(Q.query(*CLASSES, "SELECT label, word, cnt FROM classes QUALIFY rank() OVER (PARTITION BY label ORDER BY cnt DESC) = 1"))
def e5_extremes(spark, d):
    return scores.extremes(bags.class_bag(_bag(spark, d), _labels(spark, d)), ["label"], "cnt").select("label", "word", "cnt")


# Profiles and the sweep.


def _profile(spark, d):
    return profiles.profile(bags.class_bag(_bag(spark, d), _labels(spark, d)), _sizes(spark, d))


@query(Q.query(*CLASSES, Q.PROFILE, "SELECT word, label, round(mean_cnt, 6) AS mean_cnt FROM profile"))
def c1_mean_counts(spark, d):
    return _profile(spark, d).select("word", "label", *six("mean_cnt"))


@query(Q.query(*CLASSES, Q.PROFILE, "SELECT word, label, round(tfidf, 6) AS tfidf FROM profile"))
def c2_tfidf(spark, d):
    return _profile(spark, d).select("word", "label", *six("tfidf"))


@query(Q.query(*RANKED, Q.PROFILE, "SELECT label, rk::INT AS rk, round(sum(tfidf * tfidf) OVER (PARTITION BY label ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) AS sigma2 FROM profile JOIN ranks USING (word)"))
def c3_centroid_norms(spark, d):
    return profiles.centroid_norms(_profile(spark, d), _ranks(spark, d)).select("label", "rk", *six("sigma2"))


def _terms(spark, d):
    bag = cut(_bag(spark, d))
    labels = _labels(spark, d)
    sizes = S.class_sizes(labels)
    f = scores.f_statistic(bag.join(labels, "series_id"), ["word"], "cnt", sizes)
    return profiles.loo_terms(bag, scores.rank_words(f, "f", [], drop_zero=True), labels, sizes)


@query(Q.query(*RANKED, Q.TERMS, "SELECT series_id, rk::INT AS rk, label, round(ed, 6) AS ed FROM terms"))
def c4_loo_euclidean(spark, d):
    return _terms(spark, d).select("series_id", "rk", "label", *six("ed"))


@query(Q.query(*RANKED, Q.TERMS, "SELECT series_id, rk::INT AS rk, label, round(tfidf, 6) AS tfidf, round(tf, 6) AS tf FROM terms"))
def c5_loo_cosine(spark, d):
    return _terms(spark, d).select("series_id", "rk", "label", *six("tfidf", "tf"))


@query(Q.query(*RANKED, Q.TERMS, Q.PREDICTED, "SELECT sim, rk::INT AS rk, n_correct, round(accuracy, 6) AS accuracy FROM accuracies"))
def c6_prefix_sweep(spark, d):
    return profiles.accuracies(profiles.dense_sweep(_terms(spark, d))).select("sim", "rk", "n_correct", *six("accuracy"))


def _block_sweep(spark, d):
    bag = cut(_bag(spark, d).withColumn("cfg_id", F.lit(0)))
    labels = cut(_labels(spark, d))
    sizes = S.class_sizes(labels)
    f = scores.f_statistic(bag.join(labels, "series_id"), ["cfg_id", "word"], "cnt", sizes)
    ranks = cut(scores.rank_words(f, "f", ["cfg_id"], drop_zero=True).withColumn("method_id", F.lit(0)))
    ranked = ranked_counts(bag, ranks, labels).select("method_id", "rk", "label", "cnt")
    cases = labels.select(F.lit(0).alias("case_id"), F.lit(0).alias("method_id"), "series_id", "label")
    return profiles.sweep(profiles.sweep_rows(profiles.placed(bag, ranks), cases), cut(ranked), sizes_of(labels))


@query(ORACLE_SQL["c6_prefix_sweep"])
def c6_prefix_sweep_blocks(spark, d):
    total = _labels(spark, d).count()
    summed = _block_sweep(spark, d).groupBy("sim", "rk").agg(F.sum("n_correct").alias("n_correct"))
    return summed.select("sim", "rk", "n_correct", F.round(F.col("n_correct") / total, 6).alias("accuracy"))


@query(Q.query(*RANKED, Q.PROFILE, Q.TERMS, Q.PREDICTED, "SELECT sim, word, label, rk::INT AS rk, round(mean_cnt, 6) AS mean_cnt, round(tfidf, 6) AS tfidf FROM best JOIN ranks ON rk <= n_selected JOIN profile USING (word)"))
def c7_selected_words(spark, d):
    total = _labels(spark, d).count()
    scored = _block_sweep(spark, d).groupBy("sim", "rk").agg((F.sum("n_correct") / total).alias("accuracy"))
    methods = profiles.best_prefix(scored)
    chosen = profiles.select_words(_ranks(spark, d), methods, _profile(spark, d))
    return chosen.select("sim", "word", "label", "rk", *six("mean_cnt", "tfidf"))


# Subclasses: embeddings, words of 4 letters over windows of 16 and 32 as one method.

EMBEDDED = [grid.Config(0, "sax", 4, 16, 4), grid.Config(1, "sax", 4, 32, 4)]


def _embedded(spark, d):
    """bag, ranks and labels of the embedding series."""
    rows = S.embedding_series(spark, d)
    labels = cut(rows.select("series_id", "label"))
    bag = cut(grid.grid_bag(rows, EMBEDDED))
    chi = scores.chi_square(bag.join(labels, "series_id"), ["cfg_id", "word"], "cnt", S.class_sizes(labels))
    return bag, cut(scores.rank_words(chi.withColumn("method_id", F.lit(4)), "chi2", ["method_id"])), labels


def _numbered(spark, d):
    bag, ranks, labels = _embedded(spark, d)
    return bag, ranks, labels, cut(subclasses.subclass_ids(subclasses.clusters(subclasses.features(bag, ranks, labels))))


def _grid_words(win: int, cfg: int) -> str:
    return f"SELECT {cfg} AS cfg_id, * FROM (WITH {Q.EMBEDDINGS}, {Q.sax(win, 4)}, {Q.words(4, 4, 2)}, {Q.BAG} SELECT series_id, word, cnt FROM bag)"


EMBEDDED_BAG = f"""labels AS (SELECT vec_id AS series_id, label FROM embeddings), sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY label), totals AS (SELECT sum(n) AS n_all FROM sizes),
bag AS ({_grid_words(16, 0)} UNION ALL {_grid_words(32, 1)}), per AS (SELECT cfg_id, word, label, sum(cnt) AS s FROM bag JOIN labels USING (series_id) GROUP BY ALL),
chi AS (SELECT cfg_id, word, sum(s * s * n_all / n) / sum(s) - sum(s) AS chi2 FROM per JOIN sizes USING (label), totals GROUP BY cfg_id, word),
ranks AS (SELECT cfg_id, word, row_number() OVER (ORDER BY round(chi2, 9) DESC, cfg_id, word) AS rk FROM chi QUALIFY rk <= {subclasses.FEATURES})"""


@query(Q.query(EMBEDDED_BAG, "SELECT series_id, label, string_agg(rk - 1, ',' ORDER BY rk) AS places, string_agg(cnt, ',' ORDER BY rk) AS counts FROM bag JOIN ranks USING (cfg_id, word) JOIN labels USING (series_id) GROUP BY series_id, label"))
def x1_features(spark, d):
    return subclasses.features(*_embedded(spark, d)).select("series_id", "label", listed("places").alias("places"), listed("counts").alias("counts"))


@query()
def x2_x_means(spark, d):
    return subclasses.clusters(subclasses.features(*_embedded(spark, d))).select("series_id", "label", "cluster")


@query()
def x3_subclass_ids(spark, d):
    *_, numbered = _numbered(spark, d)
    return numbered.join(F.broadcast(subclasses.unsplit(numbered)), "method_id").select("series_id", "label", "subclass", "unsplit")


@query()
def x4_subclass_sweep(spark, d):
    bag, ranks, labels, numbered = _numbered(spark, d)
    of = {r["subclass"]: r["label"] for r in numbered.select("subclass", "label").distinct().collect()}
    _, said = swept(bag, ranks, cut(numbered.select("series_id", F.col("subclass").alias("label"))), of)
    return subclasses.to_classes(said.drop("own"), numbered).join(labels, "series_id").select("series_id", "sim", "label", "predicted")


#: Clusters given by rule, so that SQL can follow: even classes have two, by the parity of the series. 10 x class +
#: cluster has the order of the subclasses' numbers; words of both configurations are told apart by their upper bits.
GIVEN_BAG = f"""plain AS (SELECT vec_id AS series_id, label FROM embeddings), plain_sizes AS (SELECT label, count(*) AS n FROM plain GROUP BY label),
bag AS (SELECT series_id, cfg_id * 65536 + word AS word, cnt FROM ({_grid_words(16, 0)} UNION ALL {_grid_words(32, 1)})),
per AS (SELECT word, label, sum(cnt) AS s FROM bag JOIN plain USING (series_id) GROUP BY ALL),
chi AS (SELECT word, sum(s * s * (SELECT sum(n) FROM plain_sizes) / n) / sum(s) - sum(s) AS chi2 FROM per JOIN plain_sizes USING (label) GROUP BY word),
ranks AS (SELECT word, row_number() OVER (ORDER BY round(chi2, 9) DESC, word) AS rk FROM chi),
labels AS (SELECT series_id, label * 10 + CASE WHEN label % 2 = 0 THEN series_id % 2 ELSE 0 END AS label FROM plain),
sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY label)"""


def _given(spark, d):
    """bag, ranks, labels and numbered subclasses."""
    bag, ranks, labels = _embedded(spark, d)
    cluster = F.when(F.col("label") % 2 == 0, F.col("series_id") % 2).otherwise(0).cast("int")
    return bag, ranks, labels, cut(subclasses.subclass_ids(labels.select(F.lit(4).alias("method_id"), "series_id", "label", cluster.alias("cluster"))))


@query(Q.query(GIVEN_BAG, "given AS (SELECT series_id, label // 10 AS label, label AS cluster FROM labels)",
               f"cells AS (SELECT g.label, cluster, rk, cnt FROM bag JOIN (SELECT * FROM ranks WHERE rk <= {subclasses.FEATURES}) USING (word) JOIN given g USING (series_id))",
               "used AS (SELECT label, count(DISTINCT rk) AS m FROM cells GROUP BY label)", "one AS (SELECT label, cluster, count(*) AS n FROM given GROUP BY label, cluster)",
               "added AS (SELECT label, cluster, sum(s2) AS squares, sum(s * s) AS square FROM (SELECT label, cluster, rk, sum(cnt) AS s, sum(cnt * cnt) AS s2 FROM cells GROUP BY ALL) GROUP BY label, cluster)",
               "whole AS (SELECT label, count(*) AS k, sum(n)::DOUBLE AS r, sum(squares - square / n) AS spread, sum(n * ln(n)) AS logs FROM one JOIN added USING (label, cluster) GROUP BY label)",
               """SELECT label::INT AS label, k, round(spread, 6) AS spread, round(-(r / 2 * (ln(2 * pi()) + m * ln(spread / (r - k))) + (r - k * k) / 2 - logs + r * ln(r)) - k * (m + 1) / 2 * ln(r), 6) AS bic
 FROM whole JOIN used USING (label)"""))
def x2_criterion_given(spark, d):
    bag, ranks, labels, numbered = _given(spark, d)
    return subclasses.criteria(subclasses.features(bag, ranks, labels), numbered.drop("subclass")).select("label", "k", *six("spread", "bic"))


@query("""WITH c AS (SELECT vec_id AS series_id, label, CASE WHEN label % 2 = 0 THEN vec_id % 2 ELSE 0 END AS cluster FROM embeddings)
SELECT series_id, label, (dense_rank() OVER (ORDER BY label, cluster) - 1)::INT AS subclass, (SELECT count(DISTINCT (label, cluster)) = count(DISTINCT label) FROM c) AS unsplit FROM c""")
def x3_subclass_ids_given(spark, d):
    *_, numbered = _given(spark, d)
    return numbered.join(F.broadcast(subclasses.unsplit(numbered)), "method_id").select("series_id", "label", "subclass", "unsplit")


@query(Q.query(GIVEN_BAG, Q.CLASSES, Q.TERMS, Q.PREDICTED.replace("(label = own)", "(label // 10 = own // 10)"),
               "said AS (SELECT 'ed' AS sim, * FROM ed UNION ALL SELECT 'cos', * FROM cosine)",
               "SELECT series_id, sim, (own // 10)::INT AS label, (said.label // 10)::INT AS predicted FROM said JOIN best USING (sim) WHERE rk = n_selected"))
def x4_subclass_sweep_given(spark, d):
    bag, ranks, labels, numbered = _given(spark, d)
    of = {r["subclass"]: r["label"] for r in numbered.select("subclass", "label").distinct().collect()}  # a row per subclass
    _, said = swept(bag, ranks, cut(numbered.select("series_id", F.col("subclass").alias("label"))), of)
    return subclasses.to_classes(said.drop("own"), numbered).join(labels, "series_id").select("series_id", "sim", "label", "predicted")


# Ensembles, on predictions made by rule from the embeddings: method m takes component m.

MADE = """each AS (SELECT vec_id AS series_id, label AS own, unnest(range(len(embedding)))::INT AS method_id, abs(round(unnest(embedding)::DOUBLE * 1000000))::BIGINT AS v FROM embeddings),
predictions AS (SELECT series_id, own, method_id, CASE WHEN v % 5 < 3 THEN own ELSE (v % 10)::INT END AS predicted, CASE WHEN method_id % 2 = 0 THEN 'ed' ELSE 'cos' END AS sim FROM each),
methods AS (SELECT sim, method_id, avg((predicted = own)::INT) AS cv_score, CASE WHEN method_id % 3 = 0 THEN 'sla' ELSE 'sax' END AS kind, 3 + method_id % 6 AS word_size,
 method_id % 7 AS n_selected, CASE WHEN method_id % 4 < 2 THEN 'classes' ELSE 'subclasses' END AS partition, method_id % 9 = 0 AS unsplit FROM predictions GROUP BY sim, method_id)"""


def _predictions(spark, d):
    v = F.abs(F.round(F.col("x").cast("double") * 1_000_000)).cast("long")
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("method_id", "x")).withColumn("v", v)
    return rows.select(
        F.col("vec_id").alias("series_id"), F.col("label").alias("own"), "method_id",
        F.when(F.col("v") % 5 < 3, F.col("label")).otherwise((F.col("v") % 10).cast("int")).alias("predicted"),
        F.when(F.col("method_id") % 2 == 0, "ed").otherwise("cos").alias("sim"),
    )


def _methods(predictions):
    m = F.col("method_id")
    return predictions.groupBy("sim", "method_id").agg(F.avg((F.col("predicted") == F.col("own")).cast("double")).alias("cv_score")).select(
        "*", F.when(m % 3 == 0, "sla").otherwise("sax").alias("kind"), (3 + m % 6).alias("word_size"), (m % 7).alias("n_selected"),
        F.when(m % 4 < 2, "classes").otherwise("subclasses").alias("partition"), (m % 9 == 0).alias("unsplit"),
    )


TOP = "top AS (SELECT sim, method_id, cv_score, row_number() OVER (PARTITION BY sim ORDER BY cv_score DESC, method_id) AS vote_order FROM methods QUALIFY vote_order <= 10)"


@query(Q.query(MADE, TOP, "SELECT sim, method_id, round(cv_score, 6) AS cv_score, vote_order::INT AS vote_order FROM top"))
def m1_top_methods(spark, d):
    return ensemble.top_methods(_methods(_predictions(spark, d)), 10).select("sim", "method_id", *six("cv_score"), "vote_order")


@query(Q.query(MADE, TOP, "a AS (SELECT *, avg(cv_score) OVER (PARTITION BY sim) AS m FROM top)", "SELECT sim, method_id, round(cv_score, 6) AS cv_score FROM a QUALIFY m > 0.999 * max(m) OVER () OR m = max(m) OVER ()"))
def m2_drop_weak_similarity(spark, d):
    kept = ensemble.drop_weak_similarity(ensemble.top_methods(_methods(_predictions(spark, d)), 10), 0.999)
    return kept.select("sim", "method_id", *six("cv_score"))


ORDERED = "row_number() OVER (PARTITION BY {} ORDER BY cv_score DESC, (kind = 'sla')::INT DESC, word_size DESC, n_selected, sim, method_id) AS vote_order"
PREFIX = """steps AS (SELECT DISTINCT {g}, series_id, own, vote_order FROM votes), cls AS (SELECT DISTINCT {g}, series_id, predicted FROM votes),
gains AS (SELECT s.*, c.predicted, coalesce(v.weight, 0) AS w FROM steps s JOIN cls c USING ({g}, series_id) LEFT JOIN votes v USING ({g}, series_id, vote_order, predicted)),
added AS (SELECT {g}, series_id, own, vote_order, predicted, round(sum(w) OVER (PARTITION BY {g}, series_id, predicted ORDER BY vote_order ROWS UNBOUNDED PRECEDING), 9) AS w FROM gains),
won AS (SELECT {g}, series_id, own, vote_order, predicted FROM added QUALIFY row_number() OVER (PARTITION BY {g}, series_id, vote_order ORDER BY w DESC, predicted) = 1),
acc AS (SELECT {g}, vote_order, avg((predicted = own)::INT) AS accuracy FROM won GROUP BY {g}, vote_order)"""


@query(Q.query(MADE, f"ranked AS (SELECT *, {ORDERED.format('sim')} FROM methods)", "votes AS (SELECT p.*, vote_order, cv_score AS weight FROM predictions p JOIN ranked USING (sim, method_id))",
               PREFIX.format(g="sim"), "SELECT sim, vote_order::INT AS vote_order, round(accuracy, 6) AS accuracy FROM acc"))
def m3_weighted_prefix(spark, d):
    said = _predictions(spark, d)
    ordered = ensemble.ordered_methods(_methods(said), ["sim"]).withColumn("weight", F.col("cv_score"))
    return ensemble.prefix_votes_of(said, ordered, ["sim", "method_id"], ["sim"]).select("sim", "vote_order", *six("accuracy"))


@query(Q.query(
    MADE, "kinds AS (SELECT unnest(['sla+sax', 'sax']) AS k)", "parts AS (SELECT unnest(['all', 'classes', 'subclasses']) AS p)", "ways AS (SELECT unnest(['plain', 'weighted']) AS v)",
    f"""chosen AS (SELECT k || '/' || p || '/' || v AS variant, v, m.*, {ORDERED.format('k, p, v')} FROM methods m, kinds, parts, ways
 WHERE CASE WHEN k = 'sax' THEN kind = 'sax' ELSE kind = 'sla' OR word_size >= 6 END AND (p = 'all' OR p = m.partition OR unsplit))""",
    "votes AS (SELECT p.*, variant, vote_order, CASE WHEN v = 'weighted' THEN cv_score ELSE 1.0 END AS weight FROM predictions p JOIN chosen USING (sim, method_id))",
    PREFIX.format(g="variant"), "SELECT variant, vote_order::INT AS n_methods, round(accuracy, 6) AS accuracy FROM acc QUALIFY row_number() OVER (PARTITION BY variant ORDER BY accuracy DESC, vote_order DESC) = 1",
))
def m4_variants(spark, d):
    said = cut(_predictions(spark, d))
    chosen = ensemble.ordered_methods(ensemble.variant_methods(_methods(said)), ["variant"])
    chosen = chosen.withColumn("weight", F.when(F.col("votes") == "weighted", F.col("cv_score")).otherwise(1.0))
    return ensemble.best_ensemble(ensemble.prefix_votes_of(said, chosen, ["sim", "method_id"], ["variant"]), ["variant"]).select("variant", "n_methods", *six("accuracy"))


# Scoring.


@query(f"{_grid_words(16, 0)} UNION ALL {_grid_words(32, 1)}")
def r1_grid_bag(spark, d):
    return grid.grid_bag(S.embedding_series(spark, d), EMBEDDED).select("cfg_id", "series_id", "word", "cnt")


#: A transform of one's own: the steps from each segment's mean to the next, over the window's deviation.
grid.KINDS["steps"] = grid.Kind(
    lambda size: size,
    lambda c, sums, starts, mean, std: [
        ((sums(0, e) - sums(0, b)) / (e - b) - (sums(0, b) - sums(0, a)) / (b - a)) / std
        for (a, b), (_, e) in pairwise(positions.segment_starts(c.win, c.word_size + 1))
    ],
)


def _steps_words(win: int, m: int) -> str:
    parts = positions.segment_starts(win, m + 1)
    means = ", ".join(f"{Q.between('s', a, b)} / {b - a}.0::DOUBLE AS m{i}" for i, (a, b) in enumerate(parts))
    steps = ", ".join(f"(m{i + 1} - m{i}) / std AS c{i}" for i in range(m))
    return f"{Q.RUNNING}, {Q.windows(win, means)}, coeffs AS (SELECT series_id, pos, {steps} FROM windowed)"


@query(Q.query(Q.EMBEDDINGS, _steps_words(20, 4), Q.words(4, 4, 2), Q.BAG, "SELECT 7 AS cfg_id, series_id, word, cnt FROM bag"))
def r1_own_transform(spark, d):
    return grid.grid_bag(S.embedding_series(spark, d), [grid.Config(7, "steps", 4, 20, 4)]).select("cfg_id", "series_id", "word", "cnt")


@query(ORACLE_SQL["r1_grid_bag"])
def r1_grid_bag_of_points(spark, d):
    """From points instead of arrays: no row holds a series, only a piece (here of 128 points, four of the widest windows)."""
    rows = S.embedding_series(spark, d)
    return grid.grid_bag_of_points(S.points_of_arrays(rows, "series_id", "values"), EMBEDDED, size=64).select("cfg_id", "series_id", "word", "cnt")


HOLD = 4
TRAINED = (*BAG, Q.LABELS.replace("FROM labels GROUP BY", f"FROM labels WHERE series_id % {HOLD} <> 0 GROUP BY"),
           f"classes AS (SELECT word, label, CAST(sum(cnt) AS BIGINT) AS cnt FROM bag JOIN labels USING (series_id) WHERE series_id % {HOLD} <> 0 GROUP BY word, label)", Q.PROFILE,
           f"""tests AS (SELECT * FROM labels WHERE series_id % {HOLD} = 0), vocabulary AS (SELECT DISTINCT word FROM profile),
norms AS (SELECT label, sum(mean_cnt * mean_cnt) AS m2, sum(tfidf * tfidf) AS c2 FROM profile GROUP BY label),
own AS (SELECT series_id, sum(cnt * cnt) AS x2, sum((1 + log10(cnt)) ** 2) AS j2 FROM bag JOIN vocabulary USING (word) GROUP BY series_id),
shared AS (SELECT series_id, p.label, sum(b.cnt * mean_cnt) AS xm, sum((1 + log10(b.cnt)) * tfidf) AS p FROM bag b JOIN profile p USING (word) GROUP BY series_id, p.label),
measured AS (SELECT t.series_id, n.label, m2 + coalesce(x2, 0) - 2 * coalesce(xm, 0) AS ed, CASE WHEN c2 * coalesce(j2, 0) > 0 THEN 1 - coalesce(p, 0) ** 2 / (c2 * j2) ELSE 1.0 END AS cos
 FROM tests t CROSS JOIN norms n LEFT JOIN own o USING (series_id) LEFT JOIN shared s ON s.series_id = t.series_id AND s.label = n.label)""")


def _measured(spark, d):
    bag, labels = _bag(spark, d), _labels(spark, d)
    train, test = labels.filter(F.col("series_id") % HOLD != 0), labels.filter(F.col("series_id") % HOLD == 0)
    profiled = profiles.profile(bags.class_bag(bag, train), S.class_sizes(train))
    return classify.distances(bag.join(test.select("series_id"), "series_id", "left_semi"), profiled.drop("cnt"), test)


@query(Q.query(*TRAINED, "SELECT series_id, label, round(ed, 6) AS ed FROM measured"))
def r2_euclidean(spark, d):
    return _measured(spark, d).select("series_id", "label", *six("ed"))


@query(Q.query(*TRAINED, "SELECT series_id, label, round(cos, 6) AS cos FROM measured"))
def r3_cosine(spark, d):
    return _measured(spark, d).select("series_id", "label", *six("cos"))


def _measured_locally(spark, d, sim):
    """The same distances by the model in memory, from the points of each series."""
    rows = _series(spark, d)
    train, test = (rows.filter(F.col("series_id") % HOLD != 0), rows.filter(F.col("series_id") % HOLD == 0))
    config = grid.Config(0, "sax", SIZE, WIN, CARD)
    labels = _labels(spark, d).filter(F.col("series_id") % HOLD != 0)
    bag = grid.grid_bag(train, [config]).join(labels, "series_id").groupBy("word", "label").agg(F.sum("cnt").alias("cnt"))
    profiled = profiles.profile(bag, S.class_sizes(labels)).select(
        F.lit(0).alias("method_id"), F.lit(sim).alias("sim"), F.lit("classes").alias("partition"), F.lit(0).alias("cfg_id"), "word", "label", "mean_cnt", "tfidf"
    )
    return kernel.distances(kernel.build([config], {}, cut(profiled)), test).select("series_id", "label", F.round("distance", 6).alias(sim))


@query(ORACLE_SQL["r2_euclidean"])
def r2_euclidean_in_memory(spark, d):
    return _measured_locally(spark, d, "ed")


@query(ORACLE_SQL["r3_cosine"])
def r3_cosine_in_memory(spark, d):
    return _measured_locally(spark, d, "cos")


@query(Q.query(MADE, "w AS (SELECT series_id, predicted, round(sum(cv_score), 9) AS w FROM predictions JOIN methods USING (sim, method_id) GROUP BY series_id, predicted)",
               "SELECT series_id, predicted FROM w QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY w DESC, predicted) = 1"))
def r4_vote(spark, d):
    said = _predictions(spark, d)
    return ensemble.vote(said.join(F.broadcast(_methods(said).select("sim", "method_id", "cv_score")), ["sim", "method_id"]), ["series_id"], "cv_score")


@query(Q.query(MADE, "SELECT method_id, count(*) AS n, round(avg((predicted = own)::INT), 6) AS accuracy FROM predictions GROUP BY method_id"))
def r5_accuracy(spark, d):
    said = _predictions(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("series_id"), "label")
    return classify.accuracy(said.drop("own"), labels, ("method_id",)).select("method_id", "n", *six("accuracy"))


LENGTHS = {"low": 0.25, "step": 0.25}  # windows of a quarter, half, three quarters and all of a series


def _split(spark, d):
    rows = S.spread(S.embedding_series(spark, d))
    return rows.filter("series_id % 4 <> 0"), rows.filter("series_id % 4 = 0")


@query()
def r6_bopf(spark, d):
    train, test = _split(spark, d)
    return bopf.score(bopf.fit(train, (3, 4), **LENGTHS), test)


@query()
def r6_measured(spark, d):
    """A run of the first classifier with its times, through the sink and back."""
    train, test = _split(spark, d)
    _, rows = measured.run("embeddings", "run-1", train, test, lambda t: bopf.fit(t, (4,), **LENGTHS))
    path = shared_folder(spark, "measured")
    S.write_results(rows, path)
    return spark.read.parquet(path).select(F.col("dataset").cast("string"), "run_id", "variant", *six("accuracy", "train_s", "test_s_per_series"))


@query()
def r6_bopf_default_grid(spark, d):
    """Sizes 3-7 and windows in steps of 2.5 %: 140 configurations of series of 64 points."""
    train, test = _split(spark, d)
    return bopf.score(bopf.fit(train), test)


@query()
def r6_hybrid(spark, d):
    train, test = _split(spark, d)
    return hybrid.score(hybrid.fit(train, (4, 6), (6,), **LENGTHS), test)


@query()
def r6_hybrid_default_grid(spark, d):
    """Nine methods (SAX words of 3-8 letters, SLA words of 6, 8, 10) over windows in steps of 2.5 %."""
    train, test = _split(spark, d)
    return hybrid.score(hybrid.fit(train), test)


@query()
def r6_stream(spark, d):
    train, test = _split(spark, d)
    path, model = shared_folder(spark, "stream"), bopf.fit(train, (4,), **LENGTHS)
    test.select("series_id", "values").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("series_id long, values array<double>").parquet(f"{path}/in")
    score_stream(model, stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("variant", "series_id", "predicted")
