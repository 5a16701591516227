"""Exact vector search over arrays of floats, near-equal groups, and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import graph
from knotwork.operators.components import connected_components
from knotwork.session import cut, few, merged, ship

# What the search says when it has no index, no model or no hit.
NOT_LOADED = "<knowledge>Knowledge graph not yet loaded.</knowledge>"
NO_MODEL = "<knowledge>Embedding model not available.</knowledge>"
NOTHING = "<knowledge>No relevant knowledge found.</knowledge>"
#: Places that a similarity is rounded to before it is ranked, so that near ties don't depend on the order of a sum.
PLACES = 9
#: Vectors that a block of an exact search over all vectors should hold at least and at most, the rows of it that are
#: multiplied at once, and how far a product of floats may be from that of doubles.
BLOCK, ROWS, FLOATS = (500, 32_000), 256, 1e-5


def normalize(v: Column) -> Column:
    """A vector of length 1 in double; the zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.round(dot(normalize(a), normalize(b)), PLACES)


def similarities(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of every query with every vector. Queries, a stated set, go to the index in blocks: each
    is broadcast if they are few, else they are dealt over salted copies of the index."""
    q = queries.select("query_id", normalize(F.col("query")).alias("q"))
    v = index.select("vec_id", normalize(F.col("embedding")).alias("v"))
    if few(q, 1024):
        pairs = v.crossJoin(F.broadcast(q))
    else:
        blocks = 64
        pairs = v.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "b")
    return pairs.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")), PLACES).alias("score"))


def top_k(scored: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best of each query, of equals the smaller id, as ``rank`` from 1; only those of at least the threshold."""
    kept = scored if threshold is None else scored.filter(F.col("score") >= threshold)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k)


def limited(ranked: DataFrame, limits: DataFrame) -> DataFrame:
    """Results up to each query's own ``max_results``; a query without a limit keeps all."""
    return ranked.join(limits, "query_id", "left").filter(F.col("max_results").isNull() | (F.col("rank") <= F.col("max_results"))).drop("max_results")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Arrays of numbers as rows; a missing place counts as 0."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
    rows = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = flat
    return rows


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each ``a``, of equals the smaller ``b``; NaN is the best of all."""
    order = np.lexsort((b, -np.where(np.isnan(score), np.inf, score), a))
    a, b, score = a[order], b[order], score[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[place < most], b[place < most], score[place < most]


def _block_pairs(block: pa.Table, threshold: float, most: int) -> pa.Table:
    """Of the vectors of two blocks (or of one) each one's ``most`` best of the other, both ways. Products of floats tell
    which pairs may lie above the threshold; these are worked out in double."""
    ids, blocks = block.column("vec_id").combine_chunks(), block.column("block").to_numpy()
    rank = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    every = _matrix(block.column("v").combine_chunks())
    left = np.flatnonzero(blocks == blocks.min())
    one = len(left) == len(blocks)
    right = left if one else np.flatnonzero(blocks != blocks.min())
    small = every[right].astype(np.float32).T
    kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(left), ROWS):
        rough = every[left[at : at + ROWS]].astype(np.float32) @ small
        i, j = np.nonzero(~(rough <= threshold - FLOATS))
        i, j = left[at + i], right[j]
        there = (rank[i] < rank[j]) if one else (rank[i] != rank[j])
        i, j = i[there], j[there]
        score = np.concatenate([np.empty(0), *(np.round(np.einsum("ij,ij->i", every[i[k : k + 65_536]], every[j[k : k + 65_536]]), PLACES) for k in range(0, len(i), 65_536))])
        above = ~(score <= threshold)
        i, j, score = rank[i[above]], rank[j[above]], score[above]
        kept += [_best(i, j, score, most), _best(j, i, score, most)]
    a, b, score = _best(*(np.concatenate(x) for x in zip(*kept)), most)
    of = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
    of[rank] = np.arange(len(rank))
    return pa.table([ids.take(pa.array(of[a])), ids.take(pa.array(of[b])), pa.array(score)], names=["vec_a", "vec_b", "score"])


def _all_pairs(vectors: DataFrame, threshold: float, most: int) -> DataFrame:
    """Each vector's best of every block, all against all: blocks, of a number that follows the table's, meet two by two,
    each two in a task of its own, and are multiplied as matrices. Only what is above the threshold leaves a task."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter("vec_id is not null").select("vec_id", normalize(F.col("embedding")).alias("v")).filter("v is not null")
    n, wanted = rows.count(), 1
    while wanted * (wanted + 1) < 6 * spark.sparkContext.defaultParallelism:
        wanted += 1
    blocks = max(min(wanted, n // BLOCK[0]), -(-n // BLOCK[1]), 1)
    own, other = F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("other", other)
    met = dealt.select("vec_id", "v", "block", (F.least(own, "other") * blocks + F.greatest(own, "other")).alias("two"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return met.repartition(blocks * (blocks + 1) // 2, "two").groupBy("two").applyInArrow(lambda t: _block_pairs(t, threshold, most), f"vec_a {kind}, vec_b {kind}, score double")


def neighbour_pairs(vectors: DataFrame, threshold: float = 0.85, k: int = 5, centres: np.ndarray | None = None, probes: int = 2) -> DataFrame:
    """``vec_a, vec_b, score`` of vectors that are among the ``k - 1`` nearest of one another's side and above the
    threshold: exact, all against all in blocks, as its definition asks; or with ``centres`` each against those of the
    ``probes`` cells nearest to it. Each block keeps its best of a vector before they are put together."""
    if centres is None:
        kept, steps = _all_pairs(vectors, threshold, k - 1), (["vec_a"],)
    else:
        a = in_cells(vectors, centres, 1).select("cell", F.col("vec_id").alias("vec_b"), F.col("v").alias("b"))
        b = in_cells(vectors, centres, probes).select("cell", F.col("vec_id").alias("vec_a"), F.col("v").alias("a"))
        scored = a.join(b, (a.cell == b.cell) & (F.col("vec_a") != F.col("vec_b"))).select(b.cell, "vec_a", "vec_b", F.round(dot(F.col("a"), F.col("b")), PLACES).alias("score"))
        kept, steps = scored.filter(F.col("score") > threshold), (["vec_a", "cell"], ["vec_a"])  # what is below can't push out what is above
    for by in steps:
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_b"))).filter(F.col("r") <= k - 1)
    return kept.select("vec_a", "vec_b", "score")


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of cells of about alike vectors, by k-means of directions. It is fitted on at most ``sample`` vectors, by an
    order of hashes; the index then takes every vector."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).toArrow().column("e").to_pylist()
    points = np.array([r for r in rows if r is not None and None not in r], dtype=np.float64)
    if not len(points):
        return np.zeros((1, 1))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres = points[: min(cells, len(points))].copy()
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``vec_id, v, cell``: each vector, of length 1, in the ``probes`` cells whose centres are nearest to it."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # cells x places

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                best = np.argsort(-(flat @ held.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                ends = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()))], names=["vec_id", "v", "cells"])

    rows = vectors.filter(F.size("embedding") == centres.shape[1]).select("vec_id", normalize(F.col("embedding")).alias("v"))
    return rows.mapInArrow(placed, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>, cells array<int>").select("vec_id", "v", F.explode("cells").alias("cell"))


def cell_search(queries: DataFrame, index: DataFrame, centres: np.ndarray, probes: int, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` best of each query among the vectors of the ``probes`` cells nearest to
    it. More probes find more; with all cells the search is exact."""
    q = in_cells(queries.select(F.col("query_id").alias("vec_id"), F.col("query").alias("embedding")), centres, probes)
    v = in_cells(index.select("vec_id", "embedding"), centres, 1)
    pairs = v.join(q.select("cell", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "cell")
    return top_k(pairs.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")), PLACES).alias("score")), k)


def near_groups(vectors: DataFrame, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """``vec_id, group_id``: vectors joined by neighbour links; the group is its smallest id."""
    found = connected_components(neighbour_pairs(vectors, threshold, k), "vec_a", "vec_b")
    return vectors.select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("group_id"))


def fuzzy_entities(entities: DataFrame, encode, threshold: float = 0.85, k: int = 5, centres: np.ndarray | None = None, probes: int = 2) -> DataFrame:  # noqa: ANN001
    """``id, group_id``: canonical names whose first descriptions (by ``ord``, a NULL one as empty) lie near one another,
    joined; the group is its smallest name. ``encode`` makes a vector of a column of texts. With ``centres`` only names of
    neighbouring cells are held against each other."""
    first = graph.named(entities).groupBy("id").agg(F.min_by(F.coalesce("description", F.lit("")), "ord").alias("d"))
    vectors = cut(first.select(F.col("id").alias("vec_id"), encode(F.col("d")).alias("embedding")))
    found = connected_components(neighbour_pairs(vectors, threshold, k, centres, probes), "vec_a", "vec_b")
    return vectors.select(F.col("vec_id").alias("id")).join(merged(found.withColumnRenamed("node", "id")), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def adjacent_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, fact``: each node with the hyperedge nodes that an edge ties it to, from either end, once."""
    facts = nodes.filter(F.col("role") == "hyperedge").select(F.col("id").alias("fact"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("name"), F.col("src").alias("fact")), F.struct(F.col("src").alias("name"), F.col("dst").alias("fact")))).alias("x"))
    return ends.select("x.*").distinct().join(facts, "fact", "left_semi").select("name", "fact")


def with_metadata(hits: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Hits (with ``name``) and the columns of the node of that name; NULL where the graph has none. ``nodes`` has an id
    once."""
    return hits.join(nodes.select(F.col("id").alias("name"), *columns), "name", "left")


def without_index(queries: DataFrame, loaded: bool, model: bool) -> DataFrame:
    """``query_id, context`` of queries that nothing can be searched for: the graph isn't loaded, or there is no model."""
    if loaded and model:
        raise ValueError("with a graph and a model, contexts come from a search")
    return queries.select("query_id").distinct().withColumn("context", F.lit(NO_MODEL if loaded else NOT_LOADED))


def contexts(facts: DataFrame, entities: DataFrame, related: DataFrame, queries: DataFrame, most: int = 50) -> DataFrame:
    """``query_id, context``: the facts found, then each entity found with its related facts, at most ``most`` lines.

    ``facts``: ``query_id, rank, content``; ``entities``: ``query_id, rank, name, description``; ``related``: ``name, fact``,
    of which an entity's go by name; ``queries``: ``query_id``. An empty fact and an empty description give no line. A
    query without a line gets the fixed message. Only one query's lines are put together, and those are bounded by its
    hits, of which each entity gives at most ``most`` related facts.
    """
    def line(section: int, sub, text):  # noqa: ANN001, ANN202
        return F.struct(F.lit(section).alias("section"), "rank", sub.alias("sub"), text.alias("line")).alias("x")

    first = facts.filter(F.length("content") > 0).select("query_id", line(0, F.lit(0), F.concat(F.lit("Fact: "), "content")))
    named = entities.filter(F.length("name") > 0)
    own = named.filter(F.length("description") > 0).select("query_id", line(1, F.lit(0), F.concat(F.lit("Entity ["), "name", F.lit("]: "), "description")))
    numbered = related.join(named.select("name").distinct(), "name", "left_semi").withColumn("sub", F.row_number().over(Window.partitionBy("name").orderBy("fact"))).filter(F.col("sub") <= most)
    more = named.join(numbered, "name").select("query_id", line(1, F.col("sub"), F.concat(F.lit("Related fact: "), "fact")))
    lines = first.union(own).union(more).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("xs"))
    text = F.concat(F.lit("<knowledge>\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n</knowledge>"))
    return queries.select("query_id").distinct().join(lines, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NOTHING)).alias("context"))
