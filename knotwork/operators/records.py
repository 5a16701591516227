"""Record frames: packing, deltas, slices by round and client, and text to records."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions import text
from knotwork.session import cut, ship


def pack_entities(entities: DataFrame, threshold: float = 30.0, tokens: int = 200) -> DataFrame:
    """Entities of at least the threshold's weight, descriptions cut to ``tokens`` tokens of four characters. NULL and NaN
    weights don't reach it."""
    return entities.filter((F.col("weight") >= threshold) & ~F.isnan("weight")).withColumn("description", text.truncate_description(F.col("description"), tokens))


def delta_records(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Records of the current round whose key wasn't sent in the previous one. NULL keys are never found there."""
    return current.join(previous.select(*keys).distinct(), keys, "left_anti")


def nonempty_chunks(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Chunks stripped of outer white space, without those that are empty then."""
    return chunks.withColumn(content, text.strip(F.col(content))).filter(F.length(content) > 0)


def split_roles(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity nodes and hyperedge nodes; a node without a role is an entity. Entities lack 'UNKNOWN', '' and 50.0,
    hyperedges a weight of 1.0."""
    role = F.coalesce("role", F.lit("entity"))
    entities = nodes.filter(role == "entity").select("id", F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("weight", F.lit(50.0)).alias("weight"))
    return entities, nodes.filter(role == "hyperedge").select("id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 by ``order``, whatever their number: range-partitioned, numbered within each partition, and
    offset by the sizes of the partitions before, so that no task sees all rows. Rows of equal ``order`` are numbered in
    any sequence, so it should be unique. The partitions are cut off first: every plan that has them would sample its own
    bounds."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    # A row for each partition of the exchange.
    return placed.withColumn("_within", within).join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn(name, (F.col("_offset") + F.col("_within")).cast("long")).drop("_part", "_within", "_offset")


def first_rows(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The rows before position ``n``; a negative number gives none."""
    return df.filter(F.col(pos) < n)


def preference_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """``prompt, chosen, rejected`` of a table of preferences, row by row, NULL where they are NULL."""
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def batch_size(n: int, parts: int) -> int:
    return max(1, -(-n // parts))


def round_slice(df: DataFrame, n: int, rounds: int, r: int, pos: str = "pos") -> DataFrame:
    """The rows of round ``r`` of ``rounds``: consecutive batches of ceil(n / rounds), at least one; none once used up."""
    b = batch_size(n, rounds)
    return df.filter((F.col(pos) >= r * b) & (F.col(pos) < (r + 1) * b))


def client_round_of(pos: Column, n: int, clients: int, rounds: int) -> tuple[Column, Column]:
    """Client and round that a position falls to, when each client has ``rounds`` consecutive chunks."""
    chunk = F.floor(pos / batch_size(n, clients * rounds))
    return F.floor(chunk / rounds), F.pmod(chunk, F.lit(rounds))


def prebuilt_records(nodes: DataFrame) -> DataFrame:
    """Entity records of a ready graph: weight 1, empty type, the MD5 of the name as hash, the content as description."""
    return nodes.select(F.col("id").alias("entity_name"), F.lit("").alias("entity_type"), F.col("content").alias("description"), F.lit(1.0).alias("weight"), F.md5("id").alias("source_chunk_hash"))


def golden_answers(answers: Column, single: Column) -> Column:
    """Golden answers as an array of non-empty strings: the list if there is one, else the single answer, else none."""
    found = F.coalesce(answers, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    return F.filter(found, lambda x: F.coalesce(x != "", F.lit(False)))


def with_chunk_hash(records: DataFrame, chunks: DataFrame, default: Column) -> DataFrame:
    """Records with the hash of the chunk they name, else ``default``. ``chunks``: ``chunk_id, chunk_hash``."""
    return records.join(chunks.groupBy("chunk_id").agg(F.min("chunk_hash").alias("chunk_hash")), "chunk_id", "left").withColumn("chunk_hash", F.coalesce("chunk_hash", default))


def chunk_documents(documents: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Chunks of ``size`` words between white space, each with the last ``overlap`` of the one before: ``doc_id, chunk_no,
    content, chunk_id``. Blank documents have none. The chunk id is ``chunk-`` and the MD5 of the content."""
    step = size - overlap
    w = text.words(F.col("text"))
    parts = documents.select("doc_id", w.alias("w")).filter("size(w) > 0")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / F.lit(step)).cast("int") - 1)), lambda k: F.array_join(F.slice("w", k * step + 1, size), " "))
    return parts.select("doc_id", F.posexplode(starts).alias("chunk_no", "content")).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content")))


def extract_records(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, hyperedges and edges of chunks by a plain rule: a sentence is a hyperedge, a run of capitalised words in it
    an entity. ``chunks``: ``chunk_id, content``. Weights are 1."""
    sentences = chunks.select("chunk_id", F.explode(F.split("content", r"(?<=[.!?])\s+")).alias("s")).filter(F.length(F.trim("s")) > 0)
    found = sentences.select("chunk_id", "s", F.array_distinct(F.regexp_extract_all("s", F.lit(r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*"), F.lit(0))).alias("names"))
    hyper = F.concat(F.lit("<hyperedge>"), F.col("s"))
    edges = found.select("chunk_id", hyper.alias("src_id"), F.explode("names").alias("name"))
    entities = edges.select(text.canonical_name(F.col("name")).alias("entity_name"), F.lit("UNKNOWN").alias("entity_type"), F.substring("src_id", 12, 1 << 20).alias("description"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("source_chunk_hash"))
    links = edges.select("src_id", text.canonical_name(F.col("name")).alias("tgt_id"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("source_chunk_hash"))
    return entities, found.select(hyper.alias("hyperedge_name"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("source_chunk_hash")), links


def packed_size(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows and bytes of the records as JSON, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("records"), F.sum(F.octet_length(F.to_json(F.struct(*columns)))).alias("bytes"))


def byte_slices(df: DataFrame, content: str, whole: int = 10 << 20, piece: int = 4 << 20) -> DataFrame:
    """Binary content in slices: whole below ``whole`` bytes, else pieces of ``piece``: adds ``slice_no, slice``."""
    n = F.octet_length(content)
    size = F.when(n < whole, F.greatest(n, F.lit(1))).otherwise(piece)
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int"))
    return df.withColumn("slice_no", F.explode(cuts)).withColumn("slice", F.substring(F.col(content), F.col("slice_no") * size + 1, size))


def _zipped(texts: pd.Series, level: int) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=level).compress
    return texts.map(lambda t: None if t is None else pack(t.encode()))


def _unzipped(blobs: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor().decompressobj
    return blobs.map(lambda b: None if b is None else unpack().decompress(bytes(b)).decode())


def pack_payloads(df: DataFrame, columns: list[str], level: int = 3) -> DataFrame:
    """``payload`` (the columns as JSON, zstd-compressed), ``original_bytes``, ``packed_bytes`` and ``ratio`` (infinite for
    an empty payload) of each row."""
    ship(df.sparkSession)

    def zipped(texts: pd.Series) -> pd.Series:
        return _zipped(texts, level)

    packed = df.withColumn("_t", F.to_json(F.struct(*columns))).withColumn("payload", F.pandas_udf(zipped, T.BinaryType())(F.col("_t")))
    return packed.withColumn("original_bytes", F.octet_length("_t")).withColumn("packed_bytes", F.octet_length("payload")).withColumn("ratio", F.when(F.col("packed_bytes") == 0, float("inf")).otherwise(F.col("original_bytes") / F.col("packed_bytes"))).drop("_t")


def unpack_payloads(df: DataFrame, schema: str) -> DataFrame:
    """The columns that a payload holds, by a DDL schema."""
    ship(df.sparkSession)
    return df.withColumn("_r", F.from_json(F.pandas_udf(_unzipped, T.StringType())(F.col("payload")), schema)).select(*(c for c in df.columns if c not in ("payload", "original_bytes", "packed_bytes", "ratio")), "_r.*")


def of_clients(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """Messages of the sampled clients; a client without one is skipped."""
    return messages.join(clients.select("client_id").distinct(), "client_id", "left_semi")


def overridden(df: DataFrame, own: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with columns taken from ``own`` where it has the key and a value, else as they are. ``own`` has a key once."""
    there = own.select(*keys, *(F.col(c).alias(f"_own_{c}") for c in columns))
    return df.join(there, keys, "left").withColumns({c: F.coalesce(f"_own_{c}", c) for c in columns}).drop(*(f"_own_{c}" for c in columns))


def nested(df: DataFrame, prompt: str, response: str) -> DataFrame:
    """``prompt, response`` by dotted paths into nested columns."""
    return df.select(F.col(prompt).alias("prompt"), F.col(response).alias("response"))
