"""Chat formatting from each participant's view: the dialogue with that speaker as assistant, the others as named users.

A view is rendered in parts of `part_turns` turn numbers, so that no dialogue, however long, meets in one task. Parts join up: their
texts one after the other are the whole view, and turns and characters are counted from its beginning. Most dialogues have one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, stored

#: The end of a rendered turn, and how the marks of tags are written where they stand in a name or a text.
CLOSE = "<|end|>\n"
ESCAPED = (("<|", "<\\|"), ("|>", "|\\>"))


def escaped(text: Column) -> Column:
    """The text without anything that reads as a tag."""
    for mark, written in ESCAPED:
        text = F.replace(text, F.lit(mark), F.lit(written))
    return text


def perspectives(turns: DataFrame, part_turns: int = 256, system: str = "system", path: str | None = None) -> DataFrame:
    """Render conversations (conv_id, turn, role, text) for every participant; role names the speaker.

    A row for each conversation, participant and part: conv_id, perspective, part, first_turn (turns of the view before it), n_turns,
    first_char (characters before it), text, spans (array of begin, counted from the view's beginning, and length in characters of
    that speaker's words and end tag, the trained part), mask_chars (their sum). Turns come by number; repeated turns stay,
    ordered by role and text. System turns keep their tag for every view and are no participant. A null role is a participant
    of its own (perspective null, named "unknown"), a null text is empty, a null turn counts as -1, a null conv_id is a
    conversation of its own. A conversation with system turns alone has no views. Marks of tags in names and texts are escaped.
    """
    path = path or new_dir(turns.sparkSession, "perspectives")
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), F.coalesce(turns["turn"].cast("long"), F.lit(-1)).alias("turn"), turns["role"].cast("string").alias("speaker"),
        F.concat(escaped(F.coalesce(turns["text"].cast("string"), F.lit(""))), F.lit(CLOSE)).alias("body"),
    )
    views = rows.filter(~F.col("speaker").eqNullSafe(F.lit(system))).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    at = rows.join(stored(views, path), rows["conv_id"].eqNullSafe(F.col("of"))).drop("of").withColumn("part", F.floor(F.col("turn") / part_turns))
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    named = F.concat(F.lit("<|user:"), escaped(F.coalesce("speaker", F.lit("unknown"))), F.lit("|>"))
    tag = F.when(own, "<|assistant|>").when(F.col("speaker").eqNullSafe(F.lit(system)), "<|system|>").otherwise(named)
    by = ["conv_id", "perspective", "part"]
    at = at.select(*by, F.struct("turn", F.coalesce("speaker", F.lit("")).alias("speaker"), "body", tag.alias("head"), own.alias("own")).alias("t"))
    at = at.groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))

    def step(s, t):
        begin, length = s["end"] + F.length(t["head"]), F.length(t["body"]).cast("bigint")
        span = F.array(F.struct(begin.alias("begin"), length.alias("length")))
        return F.struct((begin + length).alias("end"), F.when(t["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "")
    at = at.select(*by, F.size("turns").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("turns", start, step, lambda s: s["spans"]).alias("spans"))
    # a part begins where the parts before it end
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    at = at.withColumns({"first_turn": earlier(F.col("n_turns")), "first_char": earlier(F.length("text"))})
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("first_char")).alias("begin"), s["length"].alias("length")))
    return at.select(*by, "first_turn", "n_turns", "first_char", "text", moved.alias("spans"), F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["length"]).alias("mask_chars"))
