"""Chat formatting from a declarative template, in built-in functions only.

A finite-state machine over the roles tells whether the turns of a conversation come in a lawful order; every turn is
emitted as segments (opening marker, text, closing marker), each with a loss flag; the formatted string is their
concatenation, and can be parsed back into roles and texts.

Escaping: every control string starts with '<' or '['. In a text, each '<', '[' and backslash gets a backslash *after*
it, so no control string can occur in a text, and dropping those backslashes gives the text back.

Defined cases: a null text is empty; a null role is the empty role; roles that the template doesn't name are marked by
their UTF-8 bytes in hex; null turns come first; equal turns are ordered by role, then text; rows with a null
conversation id form one conversation; columns beside the four named ones are ignored. A conversation is one training
example and becomes one row, so it has to fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers and loss flags by role, and the lawful orders of roles."""

    roles: dict[str, tuple[str, str, bool]]  # role: opening marker, closing marker, whether its text is learned
    other: tuple[str, str, str] = ("<role=", ">", "</role>")  # for roles without an entry; never learned
    moves: dict[str, dict[str, str]] = field(default_factory=dict)  # state: role: next state
    start: str = "start"
    final: tuple[str, ...] = ()

    def __post_init__(self):
        marks = [m for a, b, _ in self.roles.values() for m in (a, b)] + [self.other[0], self.other[2]]
        if any(m.lstrip(" \n")[:1] not in ("<", "[") for m in marks):
            raise ValueError("every marker must start with '<' or '[' (after blanks), so that escaping covers it")


#: The production template.
INSTRUCT = Template(
    roles={
        "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>\n", True),
    },
    moves={
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=("answered",),
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _quoted(marks) -> str:
    return "|".join(rf"\Q{m}\E" for m in marks)


def _choose(value: Column, options: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in options.items():
        out = F.when(value == F.lit(k), v).otherwise(out)
    return out


def _segments(turn: Column, t: Template) -> Column:
    role, text = turn["role"], turn["text"]
    named = lambda i: {r: F.lit(m[i]) for r, m in t.roles.items()}
    opening = _choose(role, named(0), F.concat(F.lit(t.other[0]), F.hex(role.cast("binary")), F.lit(t.other[1])))
    closing = _choose(role, named(1), F.lit(t.other[2]))
    piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    return F.array(
        piece(opening, F.lit(False)), piece(escape(text), _choose(role, named(2), F.lit(False))), piece(closing, F.lit(False))
    )


def _end_state(turns: Column, t: Template) -> Column:
    """The state after all turns, '' once a move isn't lawful."""

    def move(state: Column, turn: Column) -> Column:
        out = F.lit("")
        for here, ways in t.moves.items():
            for role, there in ways.items():
                out = F.when((state == F.lit(here)) & (turn["role"] == F.lit(role)), F.lit(there)).otherwise(out)
        return out

    return F.aggregate(turns, F.lit(t.start), move)


def render(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, formatted, lawful."""
    clean = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (
        clean.groupBy("conv_id").agg(turns.alias("turns"))
        .select(
            "conv_id",
            F.flatten(F.transform("turns", lambda x: _segments(x, template))).alias("segments"),
            _end_state(F.col("turns"), template).isin(*template.final).alias("lawful"),
        )
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
    )


def parse(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> from a formatted string."""
    t = template
    generic = rf"\Q{t.other[0]}\E[0-9A-F]*\Q{t.other[1]}\E"
    opening = f"({_quoted(m[0] for m in t.roles.values())}|{generic})"
    closing = f"(?:{_quoted([*(m[1] for m in t.roles.values()), t.other[2]])})"
    pattern = F.lit(f"(?s){opening}(.*?){closing}")
    marks = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))
    inner = lambda m: F.substring(m, len(t.other[0]) + 1, F.length(m) - len(t.other[0]) - len(t.other[1]))
    return F.zip_with(
        marks, texts,
        lambda m, x: F.struct(
            _choose(m, {v[0]: F.lit(r) for r, v in t.roles.items()}, F.unhex(inner(m)).cast("string")).alias("role"),
            unescape(x).alias("text"),
        ),
    )


def digest(rendered: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the output says when it is read back: turns from `formatted`, learned text from `segments`."""
    learned = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    said = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return (
        rendered.withColumn("read", parse(F.col("formatted"), template)).withColumn("learned", learned)
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "lawful",
        )
    )
