"""Operator 13: chat formatting with relational means only.

The turns of a conversation are collected as structs and sorted; an array
aggregation walks over them, merges adjacent turns of one role into one block and
writes the text with the marks of a template. Everything is Spark expressions.

    <s>[INST]user[/INST]How are you?</s>[INST]assistant[/INST]Fine.[AND]And you?</s>

Marks inside texts and roles are escaped: one backslash more after their first
sign, so a text that holds a mark, or an escaped one, comes back as it was. The
mask of trained text is a list of byte ranges of the formatted text, one for each
turn of a trained role.

The aggregation goes over slices of ``SLICE`` turns, which bounds what an
aggregation step copies, and the slices are joined at the end: time grows with
the length of a conversation, not with its square. The formatted text of one
conversation is one value, so its turns must come together in one task.

Rows: turns without a number come first, equal numbers in the order of role and
text; repeated rows are turns of their own. A null text or role is empty. Rows
without a conversation id are one conversation. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns that one aggregation goes over.
SLICE = 256


@dataclass(frozen=True)
class Template:
    """The marks of a chat format. No mark may hold a backslash or begin with the end of another one."""

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    more: str = "[AND]"
    end: str = "</s>"

    def __post_init__(self):
        marks = self.marks()
        if len({*marks}) < len(marks) or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("marks differ, have two signs at least and no backslash")
        if any(a[k:].startswith(b[:len(a) - k]) for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("no mark may begin inside another one")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no mark may begin with another one")

    def marks(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self)]

    def pattern(self, escaped: bool) -> str:
        """The first sign of a mark, before any number of backslashes and the rest; ``escaped``: with one backslash."""
        firsts = sorted({m[0] for m in self.marks()})
        rests = {f: "|".join(re.escape(m[1:]) for m in self.marks() if m[0] == f) for f in firsts}
        one = r"\\" if escaped else ""
        return "|".join(rf"({re.escape(f)}){one}(?=\\*(?:{rests[f]}))" for f in firsts)

    def groups(self) -> str:
        """The first sign in a replacement: only the group of the alternative that matched is not empty."""
        return "".join(f"${i + 1}" for i in range(len({m[0] for m in self.marks()})))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(False), self.groups() + r"\\")

    def unescape(self, text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, self.pattern(True), self.groups())).otherwise(text)


MARKS = Template()


def collected(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id and its sorted turns: array of (turn, role, text), nulls in role and text as empty."""
    row = F.struct(F.col(turn_col).alias("turn"), *(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))))
    return turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def escaped(template: Template, trained: list[str]):
    """A turn as it is written: escaped role and text, and whether it is trained on."""
    def turn_of(turn: Column) -> Column:
        return F.struct(template.escape(turn["role"]).alias("role"), template.escape(turn["text"]).alias("text"),
                        turn["role"].isin(trained).alias("trained"))
    return turn_of


def written(template: Template):
    """Aggregation step: what is written so far, and the byte ranges of trained text in it."""
    def step(done: Column, turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        header = F.concat(F.lit(template.role), role, F.lit(template.text))
        mark = (F.when(done["role"].isNull(), header).when(done["role"] == role, F.lit(template.more))
                .otherwise(F.concat(F.lit(template.end), header)))
        start = done["bytes"] + F.octet_length(mark)
        size = F.octet_length(text).cast("long")
        span = F.struct(start.alias("start"), size.alias("length"))
        spans = F.when(turn["trained"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(role.alias("role"), F.concat(done["out"], mark, text).alias("out"),
                        (start + size).alias("bytes"), spans.alias("spans"))
    return step


def format_chats(turns: DataFrame, template: Template = MARKS, trained: tuple[str, ...] = ("assistant",),
                 conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in bytes of the formatted text)."""
    rows = collected(turns, conv_col, turn_col, role_col, text_col)
    rows = rows.select("conv_id", F.transform("turns", escaped(template, list(trained))).alias("turns"))
    no_spans = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def one_slice(number: Column) -> Column:
        first = number * SLICE
        before = F.when(first > 0, F.get("turns", first - 1)["role"])
        begin = F.struct(before.alias("role"), F.lit("").alias("out"), F.lit(0).cast("long").alias("bytes"), no_spans.alias("spans"))
        return F.aggregate(F.slice("turns", first + 1, F.lit(SLICE)), begin, written(template))

    count = F.ceil(F.size("turns") / SLICE).cast("int")
    slices = rows.select("conv_id", F.transform(F.sequence(F.lit(0), count - 1), one_slice).alias("slices"))
    size = len(template.begin.encode())
    ends = F.aggregate("slices", F.array(F.lit(size).cast("long")),
                       lambda at, s: F.concat(at, F.array(F.element_at(at, -1) + s["bytes"])))
    moved = F.zip_with("slices", F.slice(ends, F.lit(1), F.size("slices")), lambda s, at: F.transform(
        s["spans"], lambda span: F.struct((span["start"] + at).alias("start"), span["length"].alias("length"))))
    text = F.concat(F.lit(template.begin), F.array_join(F.transform("slices", lambda s: s["out"]), ""), F.lit(template.end))
    return slices.select("conv_id", text.alias("formatted"), F.flatten(moved).alias("loss_spans"))


def read_turns(formatted: Column, template: Template = MARKS) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    def texts_of(block: Column) -> Column:
        parts = F.split(block, re.escape(template.text), -1)
        body = F.substr(parts[1], F.lit(1), F.length(parts[1]) - len(template.end))
        return F.transform(F.split(body, re.escape(template.more), -1), lambda text: F.struct(
            template.unescape(parts[0]).alias("role"), template.unescape(text).alias("text")))

    blocks = F.split(formatted, re.escape(template.role), -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), texts_of))


def masked_text(formatted: Column, spans: Column, template: Template = MARKS) -> Column:
    """All text under the mask, with escapes undone, joined without anything between."""
    # The one-element array binds the bytes to a name: each range is then a copy of its own length only.
    parts = F.transform(F.array(F.encode(formatted, "UTF-8")), lambda data: F.transform(spans, lambda s: template.unescape(
        F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))))
    return F.array_join(F.flatten(parts), "")


def read_back(chats: DataFrame, template: Template = MARKS) -> DataFrame:
    """What a reader finds in formatted chats: numbers and digests of turns and of text under the mask."""
    found = chats.select("conv_id", "formatted", read_turns(F.col("formatted"), template).alias("turns"),
                         masked_text(F.col("formatted"), F.col("loss_spans"), template).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
