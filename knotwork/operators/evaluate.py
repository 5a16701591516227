"""Evaluation of answers: corpus averages, best step, recall and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text
from knotwork.operators.vector import cosine


def without_nan(x: Column) -> Column:
    """NULL in place of NaN, so that averages skip it."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def mean_or_nan(x: Column) -> Column:
    """Mean without NULL and NaN; NaN if nothing is left."""
    return F.coalesce(F.avg(without_nan(x)), F.lit(float("nan")))


def answer_scores(df: DataFrame, golds: str = "golden_answers", said: str = "answer", missing: float | None = None) -> DataFrame:
    """``em`` and ``f1`` of each row: the best over its gold answers, after normalisation; 0 without a gold answer. An
    answer that is NULL scores ``missing``; if that is None, it is held against the gold answers as an empty one."""
    one = F.coalesce(F.col(said), F.lit(""))
    plain = text.normalize_answer(one)
    scores = {"em": text.best_of(F.col(golds), lambda g: text.exact(text.normalize_answer(g), plain)), "f1": text.best_of(F.col(golds), lambda g: text.f1_multiset(g, one))}
    if missing is not None:
        scores = {k: F.when(F.col(said).isNull(), missing).otherwise(x) for k, x in scores.items()}
    return df.withColumns(scores)


def recall_hit(golds: Column, retrieved: Column) -> Column:
    """Whether any gold answer is a part of the retrieved text, both in round form, or shares a word with it."""
    there = text.round_tokens(retrieved)
    return F.exists(golds, lambda g: F.contains(F.array_join(there, " "), text.normalize_round(g)) | F.arrays_overlap(text.round_tokens(g), there))


def recall_summary(df: DataFrame, question: str, golds: str, retrieved: str) -> DataFrame:
    """``recall, em, f1, num_samples``: whether the retrieved text holds a gold answer, by all rows; EM and F1 of the whole
    text in round form, the best over the gold answers, by the rows that have a question and a gold answer. The others are
    no hits and have no score; without any row recall is 0, without a scored one EM and F1 are NULL."""
    known = F.filter(F.coalesce(F.col(golds), F.array().cast("array<string>")), lambda g: F.length(g) > 0)
    rows = df.select(F.coalesce(F.length(question) > 0, F.lit(False)).alias("asked"), known.alias("golds"), F.coalesce(F.col(retrieved), F.lit("")).alias("text"))
    judged = rows.withColumn("asked", F.col("asked") & (F.size("golds") > 0))
    em = text.best_of(F.col("golds"), lambda g: text.exact(text.normalize_round(g), text.normalize_round(F.col("text"))))
    f1 = text.best_of(F.col("golds"), lambda g: text.f1_set(g, F.col("text")))
    scored = judged.select(F.when(F.col("asked"), recall_hit(F.col("golds"), F.col("text"))).alias("hit"), F.when(F.col("asked"), em).alias("em"), F.when(F.col("asked"), f1).alias("f1"))
    return scored.agg((F.count_if("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"), F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.count("*").alias("num_samples"))


def pass_at_n(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """``pass_at_n``: share of groups whose best score is 1."""
    best = df.groupBy(*by).agg(F.max(without_nan(F.col(score))).alias("best"))
    return best.agg((F.count_if(F.col("best") == 1.0) / F.greatest(F.count("*"), F.lit(1))).alias("pass_at_n"))


def best_step(df: DataFrame, score: str = "answer_f1_score", step: str = "step") -> DataFrame:
    """The step of the highest mean score, of equals the later one: one row ``step, mean_score``."""
    means = df.filter(F.col(step).isNotNull()).groupBy(step).agg(F.round(F.avg(without_nan(F.col(score))), 9).alias("mean_score"))
    return means.orderBy(F.desc_nulls_last("mean_score"), F.desc(step)).limit(1).select(F.col(step).alias("step"), "mean_score")


def at_best_step(df: DataFrame, score: str = "answer_f1_score", step: str = "step") -> DataFrame:
    """The rows of the best step."""
    return df.join(F.broadcast(best_step(df, score, step).select(F.col("step").alias(step))), step, "left_semi")


def means_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of columns by group, NaN and NULL skipped, NaN if nothing is left."""
    return df.groupBy(*by).agg(*(mean_or_nan(F.col(c)).alias(c) for c in columns))


# What a generation is judged by, and the score of one that can't be read.
RUBRICS = ("comprehensiveness", "knowledgeability", "correctness", "relevance", "diversity", "logical_coherence", "factuality")
UNREAD = 5.0


def judge_score(*scores: Column) -> Column:
    """Mean of a row's rubric scores (0 to 10) by ten, four places; a missing one counts 5."""
    total = sum((F.coalesce(without_nan(x.cast("double")), F.lit(UNREAD)) for x in scores), F.lit(0.0))
    return F.round(total / len(scores) / 10, 4)


def similarity_mean(df: DataFrame, gold: str, said: str, knowledge: str) -> DataFrame:
    """``rsim``: mean cosine of two columns of vectors; 0 for a row whose ``knowledge`` is empty or NULL, and where a vector
    is NULL."""
    each = F.when(F.length(knowledge) > 0, F.coalesce(cosine(F.col(gold), F.col(said)), F.lit(0.0))).otherwise(0.0)
    return df.agg(F.avg(each).alias("rsim"))


def distinct_context(passages: Column) -> Column:
    """Passages without repeats, in their first order."""
    return F.array_distinct(F.filter(passages, lambda p: p.isNotNull()))
