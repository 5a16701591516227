"""Schemas of the record and graph frames."""

from __future__ import annotations

from pyspark.sql import types as T

_RECORD = [T.StructField("client_id", T.StringType()), T.StructField("round_number", T.IntegerType()), T.StructField("ord", T.LongType())]

ENTITIES = T.StructType([
    *_RECORD, T.StructField("entity_name", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("source_chunk_hash", T.StringType()),
])
HYPEREDGES = T.StructType([*_RECORD, T.StructField("hyperedge_name", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("source_chunk_hash", T.StringType())])
EDGES = T.StructType([
    *_RECORD, T.StructField("src_id", T.StringType()), T.StructField("tgt_id", T.StringType()), T.StructField("weight", T.DoubleType()),
    T.StructField("source_chunk_hash", T.StringType()),
])
NODES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("source_id", T.ArrayType(T.StringType())),
])
PARAMS = T.StructType([
    T.StructField("client_id", T.StringType()), T.StructField("param", T.StringType()), T.StructField("idx", T.IntegerType()),
    T.StructField("val", T.DoubleType()), T.StructField("num_samples", T.LongType()),
])
