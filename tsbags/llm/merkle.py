"""A Merkle manifest of a table: every row a leaf, one tree per group, a root over all, and each row's inclusion proof.

Leaves are numbered within their group by exact ranks and dealt out in blocks, each an aligned subtree of `levels`
levels. A block hashes its own subtree. The levels above come by a butterfly exchange: in round r the blocks whose
numbers differ only in their r-th digit (base: the fanout) meet, swap the roots of their subtrees, and each of them
hashes the parent for itself. So after a round every block knows all siblings of that level, and after the last one the
root: no pass down the tree. Where the last subtree of a level has fewer blocks than its siblings, each of them answers
in several meetings. The roots of the groups are the leaves of one more tree of the same kind, built the same way.

A node's digest is the SHA-256 of its children's digests (lowercase hex text) from left to right; a run of fewer than
`fanout` children, even of one, is hashed too while its level has more nodes; a lone leaf is its tree's root.

A block is one row of fanout^levels leaves, whatever the size of a group; only a row per block takes part in the rounds,
whose number is the logarithm of the blocks. What meets in a round are `fanout` rows at most (and as many answers).

Defined cases: every null column is `-` in a leaf, the null group is a group of its own and comes first; null keys come
first; rows equal in the key are ordered by their leaf; repeated rows are leaves of their own; an empty table has no rows
and no root; texts of any length are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsbags.functions.ranks import exact_ranks
from tsbags.session import cut

FANOUT = 8
#: Levels of the subtree that a block holds: 512 leaves, some 70 KB.
LEVELS = 3
PATH = "array<struct<place:int,run:array<string>>>"


def digest(parts: Column) -> Column:
    """The digest of an array of strings, one after the other."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as UTF-8 byte count, colon, value; `-` where it is null."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _parents(nodes: Column, fanout: int) -> Column:
    last = F.ceil(F.size(nodes) / fanout).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.slice(nodes, i * fanout + 1, fanout)))


def _blocks(leaves: DataFrame, keys: list[str], order: list[str], kept: list[str], fanout: int, levels: int) -> DataFrame:
    """(keys, block, blocks, rows array<struct<at, leaf, kept>>): aligned runs of leaves, written as a table."""
    size = fanout**levels
    at = F.col("rn") - 1
    ranked = exact_ranks(leaves.select(*keys, *dict.fromkeys([*order, "leaf", *kept])), keys, order)
    dealt = ranked.groupBy(*keys, F.floor(at / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks")).agg(
        F.sort_array(F.collect_list(F.struct((at % size).cast("int").alias("at"), "leaf", *[c for c in kept if c != "leaf"]))).alias("rows")
    )
    return cut(dealt)


def _hashed(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Adds level0 .. (arrays of digests, null above a lone tree's root) and `held`, the root of the block."""
    out = blocks.withColumn("level0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(levels):
        below = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when((F.size(below) > 1) | (F.col("blocks") > 1), _parents(below, fanout)))
    tops = [F.element_at(f"level{k}", 1) for k in range(levels, -1, -1)]
    return out.withColumn("held", F.coalesce(*tops))


def _meet(state: DataFrame, keys: list[str], span: int, fanout: int) -> DataFrame:
    """One round: blocks that differ in the digit of `span` swap what they hold, and each hashes the parent."""
    node, nodes = F.floor(F.col("block") / span), F.ceil(F.col("blocks") / span)
    low = F.col("block") % span
    mine = F.least(F.lit(span), F.col("blocks") - node * span)  # blocks of the own subtree: fewer in a level's last one
    alone = (nodes % fanout == 1) & (node == nodes - 1)
    answers = F.when((mine == span) | alone, F.array(low)).otherwise(F.sequence(low, F.lit(span - 1).cast("long"), mine))
    asked = state.withColumn("_at", F.explode(answers)).select(
        *keys, F.floor(node / fanout).alias("_meeting"), "_at", F.struct((node % fanout).cast("int").alias("place"), F.col("held").alias("digest")).alias("_said"),
        F.when(F.col("_at") == low, F.struct("block", "blocks", "held", "path")).alias("_me"),
    )
    met = asked.groupBy(*keys, "_meeting", "_at").agg(F.sort_array(F.collect_list("_said")).alias("_run"), F.collect_list("_me").alias("_members"))
    each = met.withColumn("_me", F.explode("_members")).select(*keys, "_me.*", F.transform("_run", lambda s: s["digest"]).alias("_run"))
    step = F.array(F.struct((node % fanout).cast("int").alias("place"), F.col("_run").alias("run")))
    return each.select(
        *keys, "block", "blocks", F.when(nodes > 1, digest(F.col("_run"))).otherwise(F.col("held")).alias("held"),
        F.when(nodes > 1, F.concat("path", step)).otherwise(F.col("path")).cast(PATH).alias("path"),
    )


def butterfly(roots: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, block, blocks, held, path) of the same without path: `held`, a block's own root before, is its tree's root
    after, and `path` has the block's place and its run of siblings at every level above it."""
    state = roots.select(*keys, "block", "blocks", "held", F.array().cast(PATH).alias("path"))
    most = roots.agg(F.max("blocks")).first()[0] or 0  # a number
    span = 1
    while span < most:
        state = _meet(state, keys, span, fanout)
        span *= fanout
    return state


def tree(leaves: DataFrame, keys: list[str], order: list[str], kept: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees of (keys, order, leaf, kept) by keys, none null. Returns the blocks with their levels, and (keys, block,
    top, above): the tree's root and the path from the block's root to it, by block."""
    blocks = _blocks(leaves, keys, order, kept, fanout, levels)
    hashed = _hashed(blocks, fanout, levels)
    above = butterfly(hashed.select(*keys, "block", "blocks", "held"), keys, fanout)
    return hashed, cut(above.select(*keys, "block", F.col("held").alias("top"), F.col("path").alias("above")))


def _paths(hashed: DataFrame, above: DataFrame, keys: list[str], kept: list[str], fanout: int, levels: int) -> DataFrame:
    """(keys, kept, top, path) of every leaf: the levels of its block, then those above."""
    met = hashed.drop("held").join(above, [*keys, "block"]).withColumn("row", F.explode("rows"))
    steps = []
    for k in range(levels):
        place = F.floor(F.col("row.at") / fanout**k)
        run = F.slice(f"level{k}", (F.floor(place / fanout) * fanout + 1).cast("int"), fanout)
        steps.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct((place % fanout).cast("int").alias("place"), run.alias("run"))))
    local = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return met.select(*keys, "top", *[F.col(f"row.{c}") for c in kept], F.concat(local, "above").cast(PATH).alias("path"))


def manifest(leaves: DataFrame, group: str, order: list[str], kept: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(group, kept, subroot, root, path) of every row of (group, order, leaf, kept): one tree per value of `group`
    (ascending, null first), and one over their roots. path: array<struct<place, run>> from the leaf to the root."""
    kept = list(dict.fromkeys(["leaf", *kept]))
    # joins don't match nulls, and order and equality of a string are those of its bytes
    named = leaves.withColumn("_named", F.col(group).isNotNull()).withColumn("_tree", F.coalesce(F.col(group).cast("string"), F.lit("")))
    keys = ["_named", "_tree"]
    hashed, above = tree(named, keys, order, kept, fanout, levels)
    subroots = above.filter("block = 0").select(*keys, F.col("top").alias("leaf"), F.lit(0).alias("_whole"))
    tops = _paths(*tree(subroots, ["_whole"], keys, keys, fanout, levels), ["_whole"], ["leaf", *keys], fanout, levels)
    tops = tops.select(*keys, F.col("top").alias("root"), F.col("path").alias("_upper"))  # a row per group
    # onto the rows of blocks, not of leaves: a group of any size is a row per block here
    whole = above.join(tops, keys).select(*keys, "block", F.struct("top", "root").alias("top"), F.concat("above", "_upper").cast(PATH).alias("above"))
    paths = _paths(hashed, whole, keys, kept, fanout, levels)
    return paths.select(
        F.when(F.col("_named"), F.col("_tree")).alias(group), *[c for c in kept if c != group],
        F.col("top.top").alias("subroot"), F.col("top.root").alias("root"), "path",
    )


def proof(path: Column) -> Column:
    """The digests of all siblings, level by level from the leaf up, left to right: array of strings."""
    return F.flatten(F.transform(path, lambda s: F.filter(s["run"], lambda _, i: i != s["place"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda held, s: digest(F.transform(s["run"], lambda d, i: F.when(i == s["place"], held).otherwise(d))))
