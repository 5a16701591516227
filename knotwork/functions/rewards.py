"""Rewards of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text

# The forms of a well-formed step and of a well-formed last turn, and one user turn.
STEP = r"(?s)^<think>(.*?)</think>\n<query>(.*?)</query>\n?\z"
LAST = r"(?s)^<think>(.*?)</think>\n<answer>(.*?)</answer>\n?\z"
USER = r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>"
POINT = 0.5


def _count(x: Column, tag: str) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(tag), F.lit("")))) / len(tag)


def _is_step(turn: Column) -> Column:
    """Whether a turn before the last is a thought and a query, each tag once."""
    once = [_count(turn, tag) == 1 for tag in ("<think>", "</think>", "<query>", "</query>")]
    return once[0] & once[1] & once[2] & once[3] & F.regexp_like(turn, F.lit(STEP))


def _before_last(turns: Column) -> Column:
    return F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))


def _end(turns: Column) -> Column:
    """Points of the last turn: a thought and an answer, whatever tags their bodies hold."""
    return F.when(F.coalesce(F.regexp_like(F.try_element_at(turns, F.lit(-1)), F.lit(LAST)), F.lit(False)), POINT).otherwise(0.0)


def format_score(transcript: Column) -> Column:
    """Half a point for each well-formed turn: before the last a thought and a query with each tag once, at the last a
    thought and an answer. 0 without an assistant turn, and of NULL."""
    turns = text.assistant_blocks(transcript)
    steps = POINT * F.size(F.filter(_before_last(turns), _is_step))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) > 0, steps + _end(turns)).otherwise(0.0)


def tool_format_score(transcript: Column) -> Column:
    """As ``format_score``, but a step counts only if the user turn that answers it (the one with the next number) brings
    knowledge without the word 'error'. A well-formed step that no user turn answers makes the whole score 0."""
    turns, users = text.assistant_blocks(transcript), F.regexp_extract_all(transcript, F.lit(USER), F.lit(1))
    known = F.transform(users, lambda u: F.try_element_at(text.bodies(u, "knowledge"), F.lit(1)))
    good = F.transform(known, lambda k: F.coalesce(~F.contains(k, F.lit("error")), F.lit(False)))
    place = F.transform(_before_last(turns), lambda b, i: F.when(_is_step(b), i + 2))  # where its answer stands, from 1
    place = F.filter(place, lambda i: i.isNotNull())
    answered = F.size(F.filter(place, lambda i: F.coalesce(F.try_element_at(good, i), F.lit(False))))
    lost = F.exists(place, lambda i: i > F.size(users))
    return F.when((F.coalesce(F.size(turns), F.lit(0)) > 0) & ~lost, POINT * answered + _end(turns)).otherwise(0.0)


def composite(format_: Column, answer_score: Column, known: Column | None = None) -> Column:
    """Format score capped at 1, less 1; the answer's score is added only at full format. A missing format counts 0. Where
    ``known`` is given and false (no transcript, or no truth to hold it against) the reward is 0."""
    capped = F.least(F.coalesce(format_, F.lit(0.0)), F.lit(1.0))
    out = F.when(capped == 1.0, capped - 1 + F.coalesce(answer_score, F.lit(0.0))).otherwise(capped - 1)
    return out if known is None else F.when(known, out).otherwise(0.0)


def tool_reward(transcript: Column, truth: Column) -> Column:
    """``composite`` of ``tool_format_score`` and whether the last turn's answer ends in the true number."""
    right = F.when(text.ends_in(text.last_turn_answer(transcript), truth), 1.0).otherwise(0.0)
    return composite(tool_format_score(transcript), right, transcript.isNotNull() & truth.isNotNull())


def local_format(transcript: Column) -> Column:
    """1 if a thought and an answer are there, else 0."""
    return F.when((F.size(text.bodies(transcript, "think")) > 0) & (F.size(text.bodies(transcript, "answer")) > 0), 1.0).otherwise(0.0)


def local_reward(transcript: Column, truth: Column) -> Column:
    """``local_format`` plus F1 of the words."""
    return local_format(transcript) + F.coalesce(text.f1_raw(truth, transcript), F.lit(0.0))


def managed(df: DataFrame, score: Column, length: Column, size: Column, given: str = "rm_scores", out: str = "rewards") -> DataFrame:
    """``out``: rewards by token, the row's score at its last valid token and 0 elsewhere. Where the frame has rewards of a
    reward model in column ``given``, those are taken as they are and nothing is scored. A score that can't be had (NULL,
    as ``try_`` functions give it, or NaN) is 0; a row without a valid token gets zeros."""
    if given in df.columns:
        return df.withColumn(out, F.col(given))
    sure = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.transform(places, lambda i: F.when(i == length, sure).otherwise(0.0)))
