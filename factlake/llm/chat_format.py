"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows are put in turn order, a machine walks their roles, and the template writes
each turn as three segments (header, text, end) with a flag that says whether the loss counts it.
Control strings inside texts are escaped, so the formatted string can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a formatted turn looks like, which order of roles is valid, and what is learned.

    ``begin`` + role + ``middle`` + text + ``end``; ``loss_roles`` are the roles whose text counts.
    ``moves`` maps a state to the roles it allows (the role is the next state); a conversation is
    valid if every move is allowed and the last state is in ``final``.
    """

    begin: str = "### "
    middle: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def escapes(self) -> list[tuple[str, str]]:
        """Pairs (plain, escaped) in the order of escaping. Each escape is a backslash and a letter.

        The backslash goes first, so each backslash of an escaped text begins an escape, and no
        control string is left or newly formed in it.
        """
        return [("\\", "\\b"), (self.end.rstrip("\n"), "\\e"), (self.begin, "\\h"), (self.middle.rstrip(), "\\m")]


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT, role: bool = False) -> Column:
    """The text without control strings; in a role also without the string that ends it."""
    for plain, code in template.escapes()[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    """The inverse of ``escape``. The backslash comes back last, when no escape is left to find."""
    for plain, code in reversed(template.escapes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conv_id: state, valid, segments (array of text and loss) and formatted.

    Rows are ordered by turn, then role, then text; null turns come first, null roles and texts
    are empty, a null conv_id is a conversation of its own, repeated rows are repeated turns.
    Conversations in an invalid order are formatted too, with valid false. Other columns of
    ``turns`` are not used. An empty table gives no rows.
    """
    row = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    allowed = [f"{a}\n{b}" for a, after in template.moves.items() for b in after]

    def step(state: Column, turn: Column) -> Column:
        move = F.concat(state, F.lit("\n"), turn["role"])
        return F.when(move.isin(allowed), turn["role"]).otherwise(F.lit("invalid\n"))

    def written(turn: Column) -> Column:
        head = F.concat(F.lit(template.begin), escape(turn["role"], template, role=True), F.lit(template.middle))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        chats.withColumn("state", F.aggregate("turns", F.lit(""), step))
        .withColumn("valid", F.col("state").isin(*template.final))
        .withColumn("segments", F.flatten(F.transform("turns", written)))
        .withColumn("formatted", F.array_join(F.col("segments.text"), ""))
        .drop("turns")
    )


def parse_chats(formatted: Column, template: Template = DEFAULT) -> Column:
    """Array of (role, text), read from a formatted string alone."""
    pieces = F.slice(F.split(formatted, f"\\Q{template.end}\\E", -1), 1, F.size(F.split(formatted, f"\\Q{template.end}\\E", -1)) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.middle)
        role = F.substring(piece, F.lit(len(template.begin) + 1), at - (len(template.begin) + 1))
        text = F.substring(piece, at + len(template.middle), F.length(piece))
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text that the loss counts, unescaped, in order."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescape(s["text"], template)), "")
