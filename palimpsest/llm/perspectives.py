"""Multi-party perspective rotation of dialogues, in column expressions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others as
named users; only what the speaker says is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import let

NARRATORS = ("system",)
PART_TURNS = 64
UNORDERED_PARTS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """Text that opens and ends no turn: every ``<|`` gets a backslash inside, one that already holds some gets one more, so
    taking one away gives the text again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _head(speaker: Column, me: Column, narrators: tuple[str, ...]) -> Column:
    name = F.when(speaker.isin(*narrators), speaker).when(speaker == me, "assistant").otherwise(F.concat(F.lit("user name="), _plain(F.translate(speaker, "\r\n", "  "))))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def rotate(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, n_turns, n_chars, n_masked, text, spans.

    ``turns`` needs conv_id, turn, role (the speaker) and text; other columns are ignored. A part holds the turns whose number
    falls into one run of ``part_turns``, so no row grows with its conversation; the parts of a dialogue follow each other.
    ``spans`` are the (start, end) characters of a part that count in the loss: the speaker's words and the mark that ends
    them. Narrators are rendered as themselves and are no participants; a conversation of narrators alone has no rows.
    Turns of one number are ordered by speaker and text; equal rows count once. A null role is the speaker ``unknown``, a
    null text is empty, a turn without a number follows the numbered ones in parts of its own, and a row without
    conv_id is a conversation of its own, named ``row-`` and a hash. No rows give no rows. Turn marks inside texts and names are escaped, line ends in names become blanks,
    so nobody's words open a turn; ``n_chars`` and ``spans`` count the escaped text.
    """
    content = F.xxhash64("turn", "role", "text")
    turns = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row-"), F.hex(content))).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(1 << 40) + F.pmod(content, F.lit(UNORDERED_PARTS))).cast("long").alias("part"),
    )
    people = turns.where(~F.col("speaker").isin(*narrators)).select("conv_id", F.col("speaker").alias("me")).distinct()
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "speaker", "text"))).alias("turns"))
    both = parts.join(people, "conv_id")
    me = F.col("me")
    pieces = F.transform(
        "turns", lambda t: F.struct(_head(t["speaker"], me, narrators).alias("head"), F.concat(_plain(t["text"]), F.lit(CLOSE)).alias("body"), ((t["speaker"] == me) & ~t["speaker"].isin(*narrators)).alias("own"))
    )
    span = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        added = F.when(p["own"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"])
        return F.struct(end.alias("at"), added.alias("spans"))

    made = let(
        pieces,
        lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.aggregate(ps, zero, step, lambda a: a["spans"]).alias("spans")),
    )
    out = both.select("conv_id", me.alias("speaker"), "part", F.size("turns").cast("long").alias("n_turns"), made.alias("m"))
    masked = F.aggregate("m.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("conv_id", "speaker", "part", "n_turns", F.length("m.text").cast("long").alias("n_chars"), masked.alias("n_masked"), "m.text", "m.spans")
