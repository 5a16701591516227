"""Cutting oversized texts at natural boundaries, by one regular expression of bounded quantifiers.

The expression's alternatives are ordered by the strength of the boundary that a piece ends at: the end of the text, a
blank line, a line, a sentence, a clause, a word, and at last any character. Each consumes as much as the limit lets
it, so ``regexp_extract_all`` yields the pieces of a text one after another; all is done by SQL array functions within
the scan's stage, without a shuffle or Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short forms whose full stop ends no sentence.
ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof Rev St Mt Sr Jr Hon Gen Col Capt Sgt Fr Sra Dra Hr Nr Bd Jh "
    "no cf ca vs vol pp p fig ed eds al approx dept est etc e.g i.e z.B d.h bzw usw Nos Inc Ltd Co Corp Bros"
).split()


def piece_pattern(fresh: int) -> str:
    """The expression for pieces of at most ``fresh`` characters (code points)."""
    low = max(1, fresh // 2)
    short = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
    no_short_form = rf"(?<!(?:^|[\s(])(?:{short}|\p{{Lu}}|\d{{1,3}})\.\s)"
    ends = [
        r"(?<=\n[ \t\r]{0,4}\n)",
        r"(?<=\n)",
        rf"(?:(?<=[.!?…][”\"’')\]»]{{0,2}}\s){no_short_form}(?=[\p{{Lu}}\p{{Lo}}\p{{N}}“\"‘«(¿¡•*\-<\[])|(?<=[。！？]))",
        r"(?<=[;:,–—]\s|[，；：、])",
        r"(?<=\s)",
    ]
    options = [rf".{{1,{fresh}}}\z", *(rf".{{{low},{fresh}}}{end}" for end in ends)]
    options += [rf".{{1,{low}}}(?<=\s)(?=\S{{{low}}})", rf".{{{low},{fresh}}}(?![\p{{M}}‍️])", rf".{{1,{fresh}}}"]
    return "(?s)" + "|".join(options)


def lookback(previous: Column, overlap: int) -> Column:
    """The part of the end of ``previous``, of at most ``overlap`` characters, that the next piece repeats: from the
    first sentence that starts in it, else the first word, else all of it."""
    tail = F.right(previous, F.lit(overlap))
    sentence = F.regexp_extract(tail, r"(?s)(?<=[.!?…][”\"’')\]]{0,2}\s)(?=[\p{Lu}“\"(¿¡]).*", 0)
    word = F.regexp_extract(tail, r"(?s)(?<=\s)\S.*", 0)
    found = F.coalesce(F.nullif(sentence, F.lit("")), F.nullif(word, F.lit("")), tail)
    return F.when(F.length(previous) <= overlap, previous).otherwise(found)


def split_text(df: DataFrame, text: str, limit: int = 1600, overlap: int = 160) -> DataFrame:
    """One row per piece of each text longer than ``limit`` characters (code points).

    Adds ``piece_no`` (from 0), ``start_pos`` and ``end_pos`` (the half-open span of the text that is new in the piece),
    ``overlap`` (characters repeated from the piece before) and ``piece`` (at most ``limit`` characters). The new spans
    of a text are adjoining and cover it, so they give it back when put together. A text of up to ``limit`` characters,
    an empty one and NULL give no row; a text without any boundary is cut by characters. Equal rows are each cut.
    Columns of ``df`` named like an added one are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    added = {"piece_no", "start_pos", "end_pos", "overlap", "piece"}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in added]
    fresh = limit - overlap
    whole = df.filter(F.length(F.col(text)) > limit)
    parts = whole.select(*keep, F.regexp_extract_all(F.col(text), F.lit(piece_pattern(fresh)), F.lit(0)).alias("_parts"))
    starts = F.aggregate(
        F.col("_parts"),
        F.array(F.lit(0)),
        lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))),
    )
    before = lookback(F.get("_parts", F.col("i") - 1), overlap) if overlap else F.lit("")
    return (
        parts.withColumn("_starts", starts)
        .select(*keep, "_parts", "_starts", F.posexplode("_parts").alias("i", "part"))
        .withColumn("_back", F.coalesce(before, F.lit("")))
        .select(
            *keep,
            F.col("i").alias("piece_no"),
            F.get("_starts", "i").alias("start_pos"),
            F.get("_starts", F.col("i") + 1).alias("end_pos"),
            F.length("_back").alias("overlap"),
            F.concat("_back", "part").alias("piece"),
        )
    )


def split_passages(results: DataFrame, limit: int = 1600, overlap: int = 160) -> DataFrame:
    """Pieces of the oversized passages of ``context``: ``result_id``, ``passage_pos`` (from 0) and the columns that
    ``split_text`` adds. NULL lists and NULL passages give no row."""
    passages = results.select("result_id", F.posexplode("context").alias("passage_pos", "passage"))
    return split_text(passages, "passage", limit, overlap).drop("passage")
