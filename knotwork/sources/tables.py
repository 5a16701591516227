"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: one parquet file or a folder of them."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scan_concat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one frame; rows that occur in two files stay twice. A column that one file lacks is NULL there."""
    if not paths:
        raise ValueError("no path given")
    frames = [spark.read.parquet(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
