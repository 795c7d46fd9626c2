"""The Merkle manifest, the piece encoder and the repair of conversations against plain versions."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from tsbags.llm import catalog, merkle, pieces, repair, secret_scan

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    """The levels of digests, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_path(levels, at, fanout):
    for level in levels[:-1]:
        begin = at // fanout * fanout
        yield at - begin, level[begin : begin + fanout]
        at //= fanout


def plain_manifest(rows, fanout):
    """By row: (leaf, subroot, root, path) of (group, key, leaf) rows."""
    groups = sorted({g for g, *_ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x for _, _, x in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))], fanout) for g in groups}
    top = plain_tree([trees[g][-1][0] for g in groups], fanout)
    out = []
    for at, g in enumerate(groups):
        for i, leaf in enumerate(trees[g][0]):
            path = [*plain_path(trees[g], i, fanout), *plain_path(top, at, fanout)]
            out.append((g, leaf, trees[g][-1][0], top[-1][0], path))
    return out


@pytest.mark.parametrize(("fanout", "levels", "sizes"), [
    (2, 1, {"a": 1, "b": 2, "c": 3, None: 23, "é": 17, "Z": 40}), (3, 2, {"a": 9, "b": 10, "c": 82, "d": 1, "e": 28}), (8, 3, {"x": 600, None: 513}),
    (2, 2, {f"g{i:02}": 1 + i % 5 for i in range(19)}), (8, 1, {"x": 8 * 8 * 8 + 1}),
])
def test_manifest_equals_plain_tree(spark, fanout, levels, sizes):
    rows = [(g, k, h(str(g), str(k))) for g, n in sizes.items() for k in range(n)]
    rows += [rows[0]] * 2 + [(rows[-1][0], None, h("null key"))]
    df = spark.createDataFrame(rows, "g string, k long, leaf string")
    got = merkle.manifest(df, "g", ["k", "leaf"], ["k"], fanout, levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    said = sorted((r.g or "", r.leaf, r.subroot, r.root, tuple((s.place, tuple(s.run)) for s in r.path)) for r in got)
    want = sorted((g or "", leaf, sub, root, tuple((p, tuple(run)) for p, run in path)) for g, leaf, sub, root, path in plain_manifest(rows, fanout))
    assert said == want
    assert all(r.folded == r.root for r in got)


def test_butterfly_rounds_leave_every_block_with_all_siblings(spark):
    for n in (1, 2, 3, 4, 5, 9, 11, 27, 28):
        roots = spark.range(n).select(F.lit("t").alias("g"), F.col("id").alias("block"), F.lit(n).cast("long").alias("blocks"), F.sha2(F.col("id").cast("string"), 256).alias("held"))
        levels = plain_tree([h(str(i)) for i in range(n)], 3)
        for r in merkle.butterfly(roots, ["g"], 3).collect():
            assert r.held == levels[-1][0]
            assert [(s.place, s.run) for s in r.path] == [(p, run) for p, run in plain_path(levels, r.block, 3)]


def test_op11_query_on_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "ABC é\U0001f600", "en", "a", 3), (3, "ABC é\U0001f600", "en", "a", 3), (None, "Null Id", "en", "b", 5),
            (6, "W" * 300_000, "fr", "b", 9), (7, "lower", None, "b", 9), (9, "Up", "fr", None, -1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as leaf", "2 as path").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_merkle_manifest(spark, str(tmp_path)).collect()
    leaf = lambda r, t: h(*[field(v) for v in (r[0], r[3], r[2], r[4], t)])
    want = plain_manifest([(r[2], r[0], leaf(r, r[1])) for r in rows], 8)
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == sorted(
        (x, s, t, h(*[d for p, run in path for i, d in enumerate(run) if i != p])) for _, x, s, t, path in want
    )
    for r in got:
        (row,) = {x for x in rows if x[0] == r.doc_id}
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None and row[1] != row[1].translate(str.maketrans(catalog.UPPER, catalog.LOWER))
        assert r.verified == (not tampered), row[0]
    assert {r.doc_id for r in got if not r.verified} != set()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert catalog.op11_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


# ---- SentencePiece

TEXTS = [
    "", None, " ", "  ", "a", " a  b ", "\n", "\n\n a\n", "\u2581\u2581x \u2581", "don't stop... 3.14², naïve—“q” ’s", "日本語 テスト", "\u0000a\u0007",
    "क्षि हिन्दी x क", "<s> </s> <0x0A> <unk>", "é" * 3000, "x" * 50_000, ".,;" * 50 + "a", "\t\tif x:\n\t\t\treturn", "🙂🙂 a🙂b", "ŉ²³.", "A².", "the same", "the same",
    " ".join(f"word{i % 977}" for i in range(60_000)),
]
SOME = " \u2581\n.,ab²\u0301éΩя日-'’\t0"


@pytest.mark.parametrize(("rest", "head"), [("task", pieces.HEAD), ("task", 50), ("join", 50), ("join", 0)])
def test_pieces_equal_the_library(spark, rest, head):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(SOME) for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    df = spark.createDataFrame([(i, t, "own", b"x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, ids binary")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    once = pieces.encode(df, MODEL, head=head, rest=rest, decoded=head == 50)
    got = (once if head == 50 else pieces.decode(once, MODEL)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want, texts[r.doc_id]
        assert r.decoded == library.decode(want) and r.text == texts[r.doc_id] and r.chunk == "own"


def test_each_distinct_chunk_is_segmented_once(spark):
    df = spark.createDataFrame([("the cat, the dog.\nthe end",), ("the cat",)], "text string")
    got = {r.chunk: r.n for r in pieces.chunk_counts(df, MODEL).collect()}
    assert got == {"\u2581the": 3, "\u2581cat": 2, ",": 1, "\u2581dog": 1, ".": 1, "\nthe": 1, "\u2581end": 1}
    few = pieces.often(pieces.chunk_counts(df, MODEL), 1)
    assert [r.chunk for r in pieces.chunk_counts(df, MODEL).filter(few).collect()] == ["\u2581the"]


def test_boundaries_follow_from_the_model():
    def model(*extra, **trainer):
        m = proto.ModelProto()
        m.normalizer_spec.escape_whitespaces = True
        m.trainer_spec.byte_fallback = trainer.get("bytes", True)
        for p in ("\u2581", "a", "b", ".", "ab", "\u2581a", *extra):
            m.pieces.add(piece=p, type=1)
        return m

    assert pieces.boundaries(model("a\u2581b")) == pieces.WHOLE
    assert pieces.boundaries(model(bytes=False)) == "\u2581+[^\u2581]*"
    split = lambda m: __import__("re").findall(pieces.boundaries(m), "\u2581ab.b\nab")
    assert split(model()) == ["\u2581ab", ".b", "\nab"]
    assert split(model("b.")) == ["\u2581ab.b", "\n", "ab"]  # a piece has a stop after b, so neither b nor a ends a chunk
    assert split(model("a\n")) == ["\u2581ab.b\nab"]  # a line break may merge with what it stands before


# ---- columns of the input


def test_op1_leaves_own_columns_alone(spark):
    """Names that the scan uses keep their values; those of its output are replaced, and come once."""
    inner = ["_text", "_assign", "_access", "_hex", "_markov", "_gaps", "_hits", "_values", "Text2"]
    replaced = ["n_assign", "N_hex", "n_access", "spans", "base_spans"]
    docs = spark.createDataFrame([(1, "token = abcdef123456"), (2, None)], "doc_id long, body string")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in inner + replaced])
    got = secret_scan.scan(docs, secret_scan.train(docs.withColumnRenamed("body", "text")), "body")
    assert got.columns == ["doc_id", "body", *inner, "n_assign", "n_access", "n_hex", "base_spans", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i][c] == f"{c}-{i}" for i in (1, 2) for c in inner)
    assert (rows[1].body, rows[1].n_assign, rows[2].body, rows[2].n_assign) == ("token = abcdef123456", 1, None, 0)


# ---- conversation repair


def plain_repair(rows):
    """(cost, audit, repaired rows): all rows' edits tried, by dynamic programming over whole strings."""
    best = {0: (0, "", ())}

    def put_in(states):
        for _ in range(3):
            for q, (cost, said, out) in list(states.items()):
                there = repair.SPOKEN[q]
                way = (cost + 2, said + "I", (*out, (repair.ROLE[there], "")))
                states[there] = min(states.get(there, way), way)
        return states

    for role, text, fault in rows:
        new = {}
        for q, (cost, said, out) in put_in(best).items():
            ways = [(q, (cost + 3, said + "D", out))]
            more = 1 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                there = repair.SPOKEN[q]
                ways.append((there, (cost + 2 + more, said + "R", (*out, (repair.ROLE[there], text)))))
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if kept is not None:
                    ways.append((kept, (cost + more, said + "K", (*out, (role, text)))))
            for there, way in ways:
                new[there] = min(new.get(there, way), way)
        best = new
    ended = put_in(best)
    return min(ended[q] for q in (0, 3) if q in ended)


def every_repair(rows):
    """The least (cost, audit) of every sequence of edits with up to two rows put in at each place."""
    found = []
    choices = ["", "I", "II"]
    for edits in itertools.product(itertools.product(choices, "DKR"), repeat=len(rows)):
        for end in choices:
            state, cost, said = 0, 0, ""
            for (ins, letter), (role, _, fault) in zip(edits, rows, strict=True):
                for x in ins:
                    state, cost = repair.SPOKEN[state], cost + 2
                if letter != "D" and fault in ("blank", "duplicate"):
                    break
                state = repair.after(state, letter, role[:1])
                if state is None:
                    break
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and fault == "truncated")
                said += ins + letter
            else:
                for x in end:
                    state, cost = repair.SPOKEN[state], cost + 2
                if state in repair.FINAL:
                    found.append((cost, said + end))
    return min(found)


def decoded(rows):
    d, out, most = repair.Decoder(), [], 0
    for role, _, fault in rows:
        out += d.feed(role[:1], fault)
        seen, stack = 0, [d.root]
        while stack:
            seen += 1
            stack += stack.pop().children
        most = max(most, seen)
    out += d.finish()
    return d.cost, "".join(out), most


def draw(rng, n, roles=("system", "user", "assistant", "tool")):
    return [(rng.choice(roles), f"t{i}.", rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(n)]


def test_decoder_equals_every_sequence_of_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            rows = draw(rng, n)
            assert decoded(rows)[:2] == every_repair(rows) == plain_repair(rows)[:2]


def test_decoder_equals_plain_dynamic_programming_and_forgets():
    rng = random.Random(6)
    for n in (5, 20, 80):
        for roles in (("user", "assistant"), ("user",), ("assistant",), ("system", "user", "assistant", "tool")):
            for _ in range(30):
                rows = draw(rng, n, roles)
                assert decoded(rows)[:2] == plain_repair(rows)[:2]
    rows = [(("user", "assistant")[i % 2], "x.", rng.choice(["", "", "truncated", "duplicate"])) for i in range(5_000)]
    assert decoded(rows)[2] < 400  # nodes alive at once


def plain_conversation(rows):
    """What the query returns, from (turn, role, text) rows before the damage."""
    after = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = {1: "", 2: "".join(c for c in said(text) if c not in ".!?")}.get(k, said(text))
        after += [(turn, "user" if k == 4 else said(role), text)] * {0: 0, 3: 2}.get(k, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    rows, seen = [], set()
    for _, role, text in after:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    turns = [t for t, *_ in after if t is not None]
    cost, audit, out = plain_repair(rows)
    count = lambda k: sum(f == k for *_, f in rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, h("\n".join(f"{r}:{t}" for r, t in out))


def check_query(spark, rows, folder):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as edit", "7 as cost").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = catalog.op13_conversation_repair(spark, folder).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[n] for n in names) == plain_conversation([x for x in rows if x[0] == r.conv_id]), r.conv_id


def test_op13_query_on_awkward_rows(spark, tmp_path):
    rng = random.Random(8)
    words = ["hi.", "why?", "", " \t\x0b", None, "no stop", "Ends! \n", "é…", "x" * 100_000 + "."]
    rows = [(c, rng.choice([t, t, None, 2 * t]), rng.choice(["user", "assistant", "system", "tool", None, "User"]), rng.choice(words)) for c in [*range(60), None] for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "user", "again.") for t in range(300)] + [(98, 5, "assistant", "same.")] * 7
    check_query(spark, rows, f"{tmp_path}/a")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert catalog.op13_conversation_repair(spark, f"{tmp_path}/b").count() == 0


def test_op13_conversation_without_rows_left(spark, tmp_path):
    gone = [c for c in range(2_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(1))][:3]
    check_query(spark, [(c, 0, "user", "hi.") for c in gone], str(tmp_path))
    (r, *_) = catalog.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert (r.cost, r.audit, r.gaps, r.repaired_sha256) == (0, "", 0, h(""))


def test_repaired_rows_come_in_order(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")], "conv_id long, turn long, role string, text string")
    got = [(r.edit, r.old_role, r.role, r.text, r.cost) for r in repair.repair(rows).orderBy("step").collect()]
    assert got == [
        ("K", "user", "user", "a.", None), ("I", None, "assistant", "", None), ("K", "user", "user", "b.", None),
        ("K", "assistant", "assistant", "c.", None), ("", None, None, None, 2),
    ]
