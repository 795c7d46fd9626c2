"""The pipeline against a plain version of every stage, on the smallest tables."""

import hashlib
import math
from collections import Counter

import brute
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from tsbags.llm import catalog, language

SF = "/root/testdata/sf0.001"


def uniform(*parts):
    return (int(hashlib.md5("/".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def poisson(u, rate):
    n, p, total = 0, math.exp(-rate), 0.0
    while True:
        total += p
        if total > u:
            return n
        n += 1
        p *= rate / n


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read again between them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        if i < 4:
            assert new.columns == docs.columns
        docs = new
        out.append(docs.collect())
    return out


def rows(found):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found)


def test_language_stage(spark, stages):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    coders = language.compressors(model)
    want = [r for r in stages[0] if language.predict(r.text, list(model), coders)[1] > catalog.MARGIN]
    assert rows(stages[1]) == rows(want)
    assert len(want) >= 0.97 * len(stages[0])


def test_near_duplicate_stage(stages):
    ids, prints = [r.doc_id for r in stages[1]], [brute.simhash(r.text, 5) for r in stages[1]]
    keep = set(brute.component_ids(ids, prints, 6))
    assert rows(stages[2]) == rows([r for r in stages[1] if r.doc_id in keep])


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(stages[3]) == rows([r for r in stages[2] if not brute.hits(r.text, items)[4]])
    assert len(stages[3]) < len(stages[2])


def test_mixing_stage(stages):
    sizes = Counter(r.source for r in stages[3])
    total = sum(n**0.5 for n in sizes.values())
    want = Counter()
    for r in stages[3]:
        rate = sizes[r.source] ** 0.5 / total * len(stages[3]) / sizes[r.source]
        n = poisson(uniform(catalog.MIX["seed"], str(r.doc_id)), rate)
        if n:
            want[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] = n
    assert rows(stages[4]) == want


def test_sharding_stage(stages):
    assert rows(stages[5]) == rows(stages[4])
    for r in stages[5]:
        costs = [-math.log(uniform(str(r.doc_id), str(s))) for s in range(24)]
        assert r.shard == costs.index(min(costs))


def test_run_gives_the_same_rows(spark, stages):
    got = pipeline.run(spark, SF)
    assert rows(got.collect()) == rows(stages[5])


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, shard string, fingerprint long, n_words string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(6).collect()
    a, b, c, d, e, f = (r.text for r in rows)
    long = " ".join([a, b, c, d] * 400)
    data = [
        (3, a, "en", "s", 1, "x", 1, "w"), (5, a, "en", "s", 1, None, None, None), (5, b, "en", "s", 1, "x", 1, "w"),
        (None, c, "en", None, None, "x", 1, "w"), (None, c, "en", None, None, "x", 1, "w"), (7, None, "en", "s", 1, "x", 1, "w"),
        (8, "", None, "s", 1, "x", 1, "w"), (9, d, "fr", "t", 1, "x", 1, "w"), (9, d, "fr", "t", 1, "x", 1, "w"), (10, e, "de", None, 1, "y", 2, "w"),
        (11, long, "en", "t", 1, "x", 1, "w"), (12, f, None, "t", None, None, None, None),
    ]
    return spark.createDataFrame(data, AWKWARD)


def test_near_duplicate_stage_keeps_every_text_once(spark, awkward):
    _, stage = pipeline.STAGES[1]
    got = stage(spark, awkward, SF)
    assert got.columns == awkward.columns
    kept, texts = Counter((r.doc_id, r.text) for r in got.collect()), {(r.doc_id, r.text) for r in awkward.collect()}
    a, b = (next(t for i, t in texts if i == n and (n == 3 or t != next(t for i, t in texts if i == 3))) for n in (3, 5))
    assert kept[3, a] == 1 and kept[5, a] == 0 and kept[5, b] == 1  # the repeated id loses only its copy
    assert sum(n for (i, _), n in kept.items() if i is None) == 2  # no id says which to drop
    assert kept[7, None] == 1 and kept[8, ""] == 0  # both without words: one component, the least id stays
    assert {i: n for (i, _), n in kept.items() if i and i >= 9} == {9: 1, 10: 1, 11: 1, 12: 1}


def test_stages_take_awkward_rows(spark, awkward):
    docs = awkward
    for i, (_, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns  # a column named shard is replaced
        rows = got.collect()
        if i == 0:
            assert all(r.text for r in rows)
        if i == 2:
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        docs = docs if i in (0, 3) else got
    assert {0 <= r.shard < 24 for r in rows} == {True}


OWN = "score lang_pred accepted n_words n_hit n_items items_sha256 contaminated rate copy mix_key _hash _row _text _items _hit_key fingerprint Score_2 own_column".split()


def test_stages_leave_own_columns_alone(spark, awkward):
    """Columns of every name that a stage makes or uses, and a map, keep their values and types."""
    value = lambda i: F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    docs = awkward.drop("shard", "n_words", "fingerprint").filter("text is not null").dropDuplicates(["doc_id", "text"])
    docs = docs.select("*", *[value(i).alias(c) for i, c in enumerate(OWN)], F.create_map(F.lit("id"), value("map")).alias("labels"), F.lit(77.5).alias("Accepted_by"))
    want = {(r.doc_id, r.text): tuple(r) for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, docs, SF)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert [f.dataType for f in got.schema][: len(docs.columns)] == [f.dataType for f in docs.schema], name
        rows = got.collect()
        assert rows, name
        assert all(tuple(r)[: len(docs.columns)] == want[r.doc_id, r.text] for r in rows), name
