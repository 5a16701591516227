"""The queries of this package: each takes a session and a folder of tables and gives a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import answers, bpe, mixing, mojibake, names, near_duplicates, splitting, survivors
from knotwork.session import cut, few
from knotwork.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _best_values(spark: SparkSession, folder: str) -> survivors.Fused:
    return survivors.best_values(*(table(spark, folder, t) for t in ("entities", "documents", "clients")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The survivors by trust, time and ``ord``, an order that leaves the model nothing to decide; its own survivors are
    those of ``p1_records``."""
    return survivors.ranked_survivors(*(table(spark, folder, t) for t in ("entities", "documents", "clients")))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """A record for each name, of the values that the model holds for most probably true."""
    return survivors.merged_records(table(spark, folder, "entities"), _best_values(spark, folder).survivors)


def p1_retained(spark: SparkSession, folder: str) -> DataFrame:
    return _best_values(spark, folder).facts.filter("posterior >= 0.5")


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = _best_values(spark, folder).quality
    return spark.createDataFrame(rows, "field string, client_id string, sensitivity double, specificity double, claims long")


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_names(table(spark, folder, "entities"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.spelling_pairs(p2_clusters(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return answers.defective_answers(table(spark, folder, "results_step"), ["result_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, folder, "results_step"), "result_id", "context", 3, 0.7)
    return pairs.select(F.col("id_a").alias("result_id_a"), F.col("id_b").alias("result_id_b"))


def p4_pruning(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.pruning(table(spark, folder, "results_step"), "result_id", "context", 3, 0.7)


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_passages(table(spark, folder, "results_step"), 1600, 160)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).filter("piece_no = 0").select("result_id", "passage_pos")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), "text", "ids")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    sources = targets.select("source").distinct()
    named = table(spark, folder, "documents").select("doc_id", "source", "text").join(F.broadcast(sources) if few(sources, 128) else sources, "source", "left_semi")
    sized = cut(bpe.count_tokens(named.select("doc_id", F.array("source").alias("sources"), "text"), "text", "tokens"))
    return mixing.mix(sized, targets)


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_texts(table(spark, folder, "documents").select("doc_id", "text"), "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_restored(spark, folder).select("doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
