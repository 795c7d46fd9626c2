"""Repair of damaged conversations: the cheapest edits that make the order of roles lawful, by a Viterbi decoder that
emits edits as soon as they are settled.

The lawful orders of role initials are `(s?(ua)+)?`, four states: nothing said, system, user, assistant. Rows come in order of
turn; each is kept (free, 1 if its text is truncated), given the role user or assistant (2, and 1 if truncated) or deleted
(3; blank rows and repetitions must be); an empty user or assistant row may be put in anywhere (2). Among the cheapest
ways the one whose letters (D, I, K, R) come first in ASCII order is taken.

Decoder: per row one survivor for every state, each the leaf of a tree of backpointers. A node counts what refers to it,
children and survivors; one that nothing refers to is taken out, with what only it held. Once the root has one child and is
no survivor itself, all survivors share that child: its edits are settled, are emitted, and it becomes the root. A survivor
so much worse than another that it can't win (`EXTRA`) is dropped. So memory is what is unsettled, not the conversation. Where two ways reach a state at equal cost, their whole unsettled letters are
compared (the comparison of every two survivors is carried on from row to row, so it costs the same however long they
are). That decides for good: letters fix state and cost, so of two such ways neither's letters begin the other's.

Rows of a conversation are dealt to one task, sorted there by Spark, which spills, and read as a stream; repetitions are
marked by a window of the same partitioning. The decoder is sequential: one conversation isn't split over tasks.

Defined cases: null roles and texts count as one space; null turns come first, equal turns are ordered by role, then text;
a role's initial is its first character, and a role without one can't be kept; rows with a null conversation id form one
conversation; a conversation of which no rows are left has one row with the edit '' (as any without edits); an empty table
has no rows; repeated rows are repetitions; columns beside the named ones are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
PAIRS = ("su", "ua", "au")
#: Where a state leads by a row of user or assistant: the user's turn comes after all but the user's.
SPOKEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (NOTHING, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}


def after(state: int, letter: str, initial: str) -> int | None:
    """The state that an edit leads to, None where it isn't allowed. The letters alone fix roles and states."""
    if letter == "D":
        return state
    there = SPOKEN[state]
    if letter in "IR":
        return there
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return there if initial == ROLE[there][0] else None


def _moves() -> dict[tuple[str, str], list[tuple[int, int, str, int]]]:
    """By initial and fault: (from, to, letters, cost) of a row's edit, with up to two rows put in before it. Of equal
    ends the cheapest, then the first letters."""
    out = {}
    for initial, fault in product(("s", "u", "a", ""), ("", "blank", "duplicate", "truncated")):
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for state, inserted, letter in product(SPOKEN, range(3), "DKR"):
            if letter != "D" and fault in ("blank", "duplicate"):
                continue
            at = state
            for _ in range(inserted):
                at = SPOKEN[at]
            there = after(at, letter, initial)
            if there is not None:
                cost = INSERT * inserted + {"D": DELETE, "K": KEEP, "R": REROLE}[letter] + (TRUNCATED if fault == "truncated" and letter != "D" else 0)
                way = (cost, "I" * inserted + letter)
                best[state, there] = min(best.get((state, there), way), way)
        out[initial, fault] = [(a, b, letters, cost) for (a, b), (cost, letters) in best.items()]
    return out


MOVES = _moves()
#: From each state to an end: cost and letters.
ENDS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


#: What a continuation of the second state costs more, at most, if it goes on from the first: a user or assistant put in,
#: a later system row deleted, an end not reached. A survivor that is worse than another by more can't win or tie any more.
#: Without this the way that deletes every row stays a survivor, and nothing before the end is settled.
EXTRA = {
    NOTHING: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {NOTHING: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {NOTHING: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {NOTHING: DELETE, SYSTEM: 0, USER: INSERT},
}


class Node:
    """A step of the backpointer tree."""

    __slots__ = ("parent", "letters", "children", "held")

    def __init__(self, parent: Node | None, letters: str):
        self.parent, self.letters, self.children, self.held = parent, letters, set(), 0
        if parent is not None:
            parent.children.add(self)


def _prune(node: Node) -> None:
    """Takes out a node that nothing refers to, and its ancestors as far as only it held them."""
    while not node.held and not node.children and node.parent is not None:
        parent, node.parent = node.parent, None
        parent.children.discard(node)
        node = parent


class Decoder:
    """Feed rows; what comes out are the letters of settled rows, one string a row, then those after the last row."""

    def __init__(self):
        self.root = Node(None, "")
        self.root.held = 1
        self.alive: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        #: By two survivors: what remains of their whole letters after those that both begin with, up to what decides.
        self.apart: dict[tuple[int, int], tuple[str, str]] = {(NOTHING, NOTHING): ("", "")}
        self.cost = 0

    def feed(self, initial: str, fault: str) -> Iterator[str]:
        best: dict[int, tuple[int, int, str]] = {}
        for state, there, letters, cost in MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            if state in self.alive:
                way = (self.alive[state][0] + cost, state, letters)
                if there not in best or self._less(way, best[there]):
                    best[there] = way
        costs = [(q, way[0]) for q, way in best.items()]
        self._take({q: way for q, way in best.items() if all(p == q or way[0] <= cost + EXTRA[p][q] for p, cost in costs)})
        return self._settled()

    def finish(self) -> Iterator[str]:
        best = None
        for state, (cost, _) in self.alive.items():
            way = (cost + ENDS[state][0], state, ENDS[state][1])
            if best is None or self._less(way, best):
                best = way
        self.cost = best[0]
        self._take({NOTHING: best})
        return self._settled()

    def _remains(self, a: tuple[int, int, str], b: tuple[int, int, str]) -> tuple[str, str]:
        """Of two ways: their letters after those that both begin with. Equal to a comparison of all unsettled letters,
        without walking back to where the ways part."""
        x, y = self.apart[a[1], b[1]]
        x, y = x + a[2], y + b[2]
        same = 0
        while same < min(len(x), len(y)) and x[same] == y[same]:
            same += 1
        x, y = x[same:], y[same:]
        return (x[0], y[0]) if x and y else (x, y)

    def _less(self, a: tuple[int, int, str], b: tuple[int, int, str]) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        x, y = self._remains(a, b)
        return x < y

    def _take(self, ways: dict[int, tuple[int, int, str]]) -> None:
        self.apart = {(p, q): self._remains(a, b) for p, a in ways.items() for q, b in ways.items()}
        before, self.alive = self.alive, {q: (cost, Node(self.alive[state][1], letters)) for q, (cost, state, letters) in ways.items()}
        for _, node in self.alive.values():
            node.held += 1
        for _, node in before.values():
            node.held -= 1
            _prune(node)

    def _settled(self) -> Iterator[str]:
        while not self.root.held and len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.root.parent = None
            yield self.root.letters


def damage(rows: DataFrame) -> DataFrame:
    """The rows after a fixed damage by crc32(conv_id:turn) % 20, nulls as one space: 0 drops the row, 1 empties its text,
    2 takes out its [.!?], 3 repeats it, 4 makes it the user's. A dropped row stays, with `left` false."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind != 0).alias("left"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _fault(text: Column, earlier: Column) -> Column:
    seen = F.rtrim(F.translate(text, BLANK_CHARS, " " * len(BLANK_CHARS)))
    return F.when(seen == "", "blank").when(earlier, "duplicate").when(~F.substring(seen, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


SCHEMA = "conv_id long, step long, edit string, turn long, old_role string, role string, text string, fault string, illegal boolean, cost long"


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, old_role, role, text, fault, illegal, cost) of (conv_id, turn, role, text): every edit
    in order. edit: K, R, D or I; '' for a row that only closes its conversation and has the cost of all edits. role: as
    repaired, null where deleted. illegal: whether the row's and its predecessor's initials aren't lawful neighbours before
    the repair. A row whose column `left` is false is no row, but its conversation is known."""
    left = F.col("left") if "left" in rows.columns else F.lit(True)
    space = F.lit(" ")
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), F.coalesce(left, F.lit(True)).alias("left"),
    ).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "text", "left").orderBy(F.asc_nulls_first("turn"))
    marked = clean.withColumn("_nth", F.row_number().over(alike)).withColumn("fault", _fault(F.col("text"), F.col("_nth") > 1))
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "_nth").drop("_nth")
    return ordered.mapInPandas(_decode, SCHEMA)


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversation by conversation; a row waits until its edit is settled."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    conv, decoder, waiting, step, state, last = None, None, deque(), 0, NOTHING, None
    out: list[tuple] = []

    def emit(letters: str) -> None:
        nonlocal step, state
        for letter in letters:
            if letter == "I":
                state = SPOKEN[state]
                out.append((conv, step, "I", None, None, ROLE[state], "", None, False, None))
            else:
                turn, role, text, fault, illegal = waiting.popleft()
                state = after(state, letter, role[:1])
                out.append((conv, step, letter, turn, role, {"D": None, "K": role}.get(letter, ROLE.get(state)), text, fault or None, illegal, None))
            step += 1

    def close() -> None:
        for letters in decoder.finish():
            emit(letters)
        out.append((conv, step, "", None, None, None, None, None, False, decoder.cost))

    for frame in frames:
        frame = frame.astype({"conv_id": "Int64", "turn": "Int64"})
        for key, turn, role, text, left, fault in frame[["conv_id", "turn", "role", "text", "left", "fault"]].itertuples(index=False, name=None):
            key, turn = (None if pd.isna(v) else int(v) for v in (key, turn))
            if decoder is None or key != conv:
                if decoder is not None:
                    close()
                conv, decoder, step, state, last = key, Decoder(), 0, NOTHING, None
            if not left:
                continue
            illegal = last is not None and last + role[:1] not in PAIRS
            last = role[:1]
            waiting.append((turn, role, text, fault, illegal))
            for letters in decoder.feed(role[:1], fault):
                emit(letters)
        if out:
            yield _frame(out, names)
            out.clear()
    if decoder is not None:
        close()
        yield _frame(out, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    whole = {c: "Int64" for c in ("conv_id", "step", "turn", "cost")}
    return pd.DataFrame(rows, columns=names).astype(whole)


def digest(edits: DataFrame) -> DataFrame:
    """A row per conversation: gaps in its turns, faults, unlawful neighbours, the edits' cost and letters, and the hash of
    the repaired rows, `role:text` joined by newlines."""
    row = F.col("old_role").isNotNull()
    spread = F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    lines = F.sort_array(F.collect_list(F.when(F.col("edit") != "", F.struct("step", "edit", F.concat("role", F.lit(":"), "text").alias("line")))))
    kept = F.filter("_lines", lambda e: e["line"].isNotNull())  # a deleted row has no role
    return (
        edits.groupBy("conv_id").agg(
            F.coalesce(spread, F.lit(0)).alias("gaps"), *[count(row & (F.col("fault") == k))(k) for k in ("blank", "duplicate", "truncated")],
            count(F.col("illegal"))("illegal"), F.max("cost").alias("cost"), lines.alias("_lines"),
        )
        .select(
            "conv_id", F.col("gaps").cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
            F.array_join(F.transform("_lines", lambda e: e["edit"]), "").alias("audit"),
            F.sha2(F.array_join(F.transform(kept, lambda e: e["line"]), "\n").cast("binary"), 256).alias("repaired_sha256"),
        )
    )
