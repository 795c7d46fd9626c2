"""SimHash near-duplicates: pigeonhole blocks over distinct fingerprints, Hamming check, connected components.

The 64 bits are cut into `blocks` blocks; fingerprints that differ in at most `distance` bits agree on at least
`blocks - distance` whole blocks, so every choice of that many blocks is a join key, and no close pair is missed. A key
shared by many fingerprints is cut into hashed parts, and the parts are compared two by two in tasks of bounded size;
what leaves a task is a spanning forest of its links, not all pairs.

Defined cases: a null or empty text, or one of blanks only, has the fingerprint zero, which links like any other; a
text of fewer than `size` words is one shingle; repeated rows and equal texts share a component; rows with a null id
are kept, and the component's id is its least id that isn't null; an empty table stays empty; clashing input columns
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.llm.components import components
from tsbags.llm.words import slices
from tsbags.session import cut

SHINGLE, DISTANCE = 4, 4
#: Fingerprints of one key that a task compares at once.
PART = 2_048
#: Groups up to this size are compared by shifting, many groups at once.
SMALL = 24
#: Tasks that the rows of one component are dealt to.
SALTS = 8
_UNPACK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _UNPACK):
        part = h[i : i + _UNPACK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Adds `fingerprint` (long) to the columns `keep` (all by default)."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    source = docs.select(*[F.col(c) for c in names], F.col(text).alias("_text"))
    schema = docs.select(*names).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 8_000_000):
                marks = [fingerprint(t.as_py(), size) for t in part.column(len(names))]
                kept = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.int64())], names=[*names, "fingerprint"])

    return source.mapInArrow(run, schema)


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of each choice of blocks that a close pair may agree on, as signed numbers."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    wholes = [sum(c) for c in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in wholes]


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """So many blocks that a key has about as many bits as the count of fingerprints, so random keys hold few of them."""
    blocks = distance + 2
    while blocks < distance + 8 and 64 * (blocks - distance) // blocks + 3 < max(1, count).bit_length():
        blocks += 1
    return blocks


def _forest(marks: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the close pairs among the marks connect; at most one fewer than marks."""
    out, left = [], np.arange(len(marks))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            here = front.pop()
            near = np.bitwise_count(marks[left] ^ marks[here]) <= distance
            new = left[near]
            if len(new):
                out.append((np.full(len(new), here), new))
                front.extend(new.tolist())
                left = left[~near]
    return out


def links(groups: np.ndarray, marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `groups`."""
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    small = sizes <= SMALL
    for d in range(1, int(sizes[small].max(initial=1))):
        same = (group[d:] == group[:-d]) & small[group[d:]]
        near = np.flatnonzero(same & (np.bitwise_count(marks[d:] ^ marks[:-d]) <= distance))
        a.append(near)
        b.append(near + d)
    for g in np.flatnonzero(~small):
        for x, y in _forest(marks[cuts[g] : cuts[g + 1]], distance):
            a.append(x + cuts[g])
            b.append(y + cuts[g])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def close_links(marks: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect what the pairs of distinct `fingerprint`s within the distance connect."""
    blocks = blocks or blocks_for(marks.count(), distance)
    keys = F.array(*[
        F.struct(F.lit(i).alias("no"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits"))
        for i, m in enumerate(masks(blocks, distance))
    ])
    keyed = marks.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.no", "k.bits")
    shared = keyed.groupBy("no", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    paired = (
        keyed.join(shared, ["no", "bits"]).withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .select("no", "bits", "low", "high", "fingerprint")
    )
    dealt = paired.repartition("no", "bits", "low", "high").sortWithinPartitions("no", "bits", "low", "high")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            names = held[["no", "bits", "low", "high"]].to_numpy()
            open_from = np.flatnonzero((names != names[-1]).any(axis=1))
            done = int(open_from[-1]) + 1 if len(open_from) else 0
            if done:
                yield found(held.iloc[:done])
                held = held.iloc[done:]
        if held is not None and len(held):
            yield found(held)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows[["no", "bits", "low", "high"]].to_numpy()
        group = np.cumsum(np.r_[0, (names[1:] != names[:-1]).any(axis=1)])
        values = rows["fingerprint"].to_numpy()
        a, b = links(group, values.view(np.uint64), distance)
        return pd.DataFrame({"a": values[a], "b": values[b]})

    return dealt.mapInPandas(run, "a long, b long")


def _component_ids(rows: DataFrame, key: str, links: DataFrame, marks: DataFrame) -> DataFrame:
    """(fingerprint, component_id) for each distinct fingerprint. Only fingerprints with links are looked up by their
    component, whose id is given to SALTS tasks, so that a very large component isn't one task's."""
    linked = marks.join(components(links).withColumnRenamed("node", "fingerprint"), "fingerprint")
    linked = cut(linked.select("fingerprint", "least", "label", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).alias("salt")))
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = linked.join(ids, ["label", "salt"]).select("fingerprint", "component_id")
    return cut(marks.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id")))


def _marks(rows: DataFrame, key: str) -> DataFrame:
    return cut(rows.groupBy("fingerprint").agg(F.min(key).alias("least")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """One row per document: key, fingerprint (long), component_id."""
    rows = cut(with_fingerprints(docs, text, keep=[key]))
    marks = _marks(rows, key)
    ids = _component_ids(rows, key, close_links(marks, distance, blocks), marks)
    return rows.join(ids, "fingerprint").select(key, "fingerprint", "component_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None
) -> DataFrame:
    """One row of each component, whole: of its rows with the least id, the one whose text has the least hash, and of
    equal texts the first by the other columns.

    Rows with a null id all stay: no id says which of them to drop. Texts aren't grouped: only fingerprints are, and the
    rows to keep are found by a join of id and text hash, so an id that occurs in several components loses none.
    """
    named = docs.withColumn("_hash", F.xxhash64(F.col(text)))
    rows = cut(with_fingerprints(named, text, size, keep=[key, "_hash"]).filter(F.col(key).isNotNull()))
    marks = _marks(rows, key)
    ids = _component_ids(rows, key, close_links(marks, distance, blocks), marks)
    least = rows.join(ids, "fingerprint").groupBy("component_id").agg(F.min(F.struct(F.col(key), "_hash", "fingerprint")).alias("_k"))
    kept = least.select(F.col(f"_k.{key}").alias("_kept"), F.col("_k._hash").alias("_kept_hash")).distinct()
    # maps have no order of their own
    order = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema if f.name not in (key, text)]
    first = Window.partitionBy(key, "_hash").orderBy(*order)
    one = (
        named.join(kept, (F.col(key) == F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
        .withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row", "_hash")
    )
    return one.unionByName(docs.filter(F.col(key).isNull()))
