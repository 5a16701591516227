"""Building, describing and querying the knowledge hypergraph: nodes ``id, role, entity_type, description, weight,
source_id`` and edges ``src, dst, weight, source_id``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import canonical_name
from knotwork.session import cut, ship


def named(entities: DataFrame) -> DataFrame:
    """Entity records with ``id``, their canonical name; records without a name are dropped."""
    return entities.withColumn("id", canonical_name(F.col("entity_name"))).filter("id is not null")


def exact_groups(entities: DataFrame) -> DataFrame:
    """``id, records, first_ord`` of each canonical name."""
    return named(entities).groupBy("id").agg(F.count("*").alias("records"), F.min("ord").alias("first_ord"))


def _majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, of equals the first seen."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One node per canonical name: the longest description (in characters, of equals the first seen), the majority type
    (of equals the first seen), the sum of the weights, and the sorted distinct chunk hashes.

    NULL descriptions and types count as empty and 'UNKNOWN'; NULL weights are skipped, NaN is kept as it is. Map-side
    aggregation collapses hubs before the shuffle.
    """
    rows = named(entities).select("id", "ord", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), "weight", "source_chunk_hash")
    merged = rows.groupBy("id").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"),
        F.sum("weight").alias("weight"),
        F.array_sort(F.collect_set("source_chunk_hash")).alias("source_id"),
    )
    kinds = _majority(rows, "id", "entity_type")
    return merged.join(kinds, "id").select("id", F.lit("entity").alias("role"), "entity_type", "description", "weight", "source_id")


def merge_hyperedges(hyperedges: DataFrame) -> DataFrame:
    """One node per hyperedge name: summed weight, sorted distinct sources (``client_`` and the client's id)."""
    rows = hyperedges.filter("hyperedge_name is not null")
    merged = rows.groupBy(F.col("hyperedge_name").alias("id")).agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set(F.concat(F.lit("client_"), "client_id"))).alias("source_id"))
    return merged.select("id", F.lit("hyperedge").alias("role"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("description"), "weight", "source_id")


def merge_edges(edges: DataFrame, canonicalize: bool = False, count: bool = False) -> DataFrame:
    """One edge per (source, target): summed weight, sorted distinct chunk hashes. Edges with a NULL end are dropped. The
    entity end is put in canonical form only if asked for, as is ``records``, the number of an edge's records."""
    target = canonical_name(F.col("tgt_id")) if canonicalize else F.col("tgt_id")
    rows = edges.select(F.col("src_id").alias("src"), target.alias("dst"), "weight", "source_chunk_hash").filter("src is not null and dst is not null")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source_chunk_hash")).alias("source_id"), *([F.count("*").alias("records")] if count else []))


def joined_source(source_id: Column, separator: str = "<SEP>") -> Column:
    return F.array_join(source_id, separator)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``num_nodes, num_edges, num_entity_nodes, num_hyperedge_nodes, density``; density is E / (V (V - 1)), 0 below two
    nodes. A node without a role is neither."""
    n = nodes.agg(F.count("*").alias("num_nodes"), F.count_if(F.col("role") == "entity").alias("num_entity_nodes"), F.count_if(F.col("role") == "hyperedge").alias("num_hyperedge_nodes"))
    e = edges.agg(F.count("*").alias("num_edges"))
    v = F.col("num_nodes").cast("double")
    return n.crossJoin(e).select("num_nodes", "num_edges", "num_entity_nodes", "num_hyperedge_nodes", F.when(F.col("num_nodes") < 2, 0.0).otherwise(F.col("num_edges") / (v * (v - 1))).alias("density"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 of sorted names joined by '|', batch by batch; one of no names is that of the empty text."""
    digest, begun = hashlib.md5(usedforsecurity=False), False
    for batch in batches:
        if batch.num_rows:
            digest.update((("|" if begun else "") + "|".join(batch.column(0).to_pylist())).encode())
            begun = True
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:12]])], names=["names_hash"])


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``num_entities, num_hyperedges, num_edges, names_hash``. The hash is the first twelve hex digits of the MD5 of the
    sorted entity names joined by '|'; a node without a role counts as an entity, a NULL name isn't hashed.

    MD5 goes from name to name, so one task takes the sorted ranges in turn; it holds a batch of names at a time, never
    all of them. ``bucketed_fingerprint`` hashes parts side by side.
    """
    ship(nodes.sparkSession)
    entity = F.coalesce(F.col("role"), F.lit("entity")) != "hyperedge"
    counts = nodes.agg(F.count_if(entity).alias("num_entities"), F.count_if(~entity).alias("num_hyperedges"))
    names = nodes.filter(entity & F.col("id").isNotNull()).select("id").orderBy("id").coalesce(1).mapInArrow(_digest, "names_hash string")
    # Three frames of one row; without a partition nothing is hashed.
    names = names.agg(F.coalesce(F.max("names_hash"), F.substring(F.md5(F.lit("")), 1, 12)).alias("names_hash"))
    return counts.crossJoin(names).crossJoin(edges.agg(F.count("*").alias("num_edges"))).select("num_entities", "num_hyperedges", "num_edges", "names_hash")


def bucketed_fingerprint(nodes: DataFrame, edges: DataFrame, buckets: int = 4096) -> DataFrame:
    """As ``fingerprint`` for graphs of any size: the hash is over the hashes of ``buckets`` parts of the names."""
    entity = F.coalesce(F.col("role"), F.lit("entity")) != "hyperedge"
    parts = nodes.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("part")).agg(
        F.count_if(entity).alias("e"), F.count_if(~entity).alias("h"), F.md5(F.array_join(F.array_sort(F.collect_list(F.when(entity, F.col("id")))), "|")).alias("digest")
    )
    n = parts.agg(F.sum("e").alias("num_entities"), F.sum("h").alias("num_hyperedges"), F.substring(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "|")), 1, 12).alias("names_hash"))
    return n.crossJoin(edges.agg(F.count("*").alias("num_edges"))).select("num_entities", "num_hyperedges", "num_edges", "names_hash")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two fingerprints: counts old and new, how many more of each (never below 0), ``changed``."""
    a = old.select(*(F.col(c).alias(f"old_{c}") for c in old.columns))
    b = new.select(*(F.col(c).alias(f"new_{c}") for c in new.columns))
    more = [F.greatest(F.lit(0), F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"more_{c}") for c in ("num_entities", "num_hyperedges", "num_edges")]
    same = F.lit(True)
    for c in old.columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return a.crossJoin(b).select("*", *more, (~same).alias("changed"))


def delta_metrics(change: DataFrame, skipped: bool | Column = False) -> DataFrame:
    """A delta under the names of a log of metrics; flags are 0 or 1."""
    names = {f"kg/{new}_{kind}": f"{old}_num_{kind}" for kind in ("entities", "hyperedges") for new, old in (("prev", "old"), ("curr", "new"))}
    names |= {f"kg/new_{kind}": f"more_num_{kind}" for kind in ("entities", "hyperedges", "edges")}
    flag = skipped if isinstance(skipped, Column) else F.lit(skipped)
    return change.select(*(F.col(old).alias(new) for new, old in names.items()), F.col("changed").cast("int").alias("kg/changed"), flag.cast("int").alias("kg/broadcast_skipped"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``node, other`` of each edge from both ends, once."""
    a = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return a.union(a.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree, centrality`` of every node: degree / (n - 1). A self link counts twice; with one node it is 1 by
    convention, as in the usual definition. Ends of edges count as nodes."""
    ends = edges.select("src", "dst").distinct()
    degrees = ends.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    every = nodes.select("id").union(degrees.select("id")).distinct()
    n = every.agg(F.count("*").alias("n"))
    return every.join(degrees, "id", "left").crossJoin(F.broadcast(n)).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def top_central(nodes: DataFrame, edges: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` most central nodes; of equals the smaller id."""
    return degree_centrality(nodes, edges).orderBy(F.desc("degree"), "id").limit(k)


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` steps of the seeds of each group. ``seeds`` has ``id`` and any group columns before it; seeds
    stay, be they isolated. The links are made once; each hop joins only the last frontier, made distinct first, and is cut
    off. A hub's links are one skewed join partition, which is split at run time."""
    groups = [c for c in seeds.columns if c != "id"]
    reached = cut(seeds.select(*groups, "id").distinct())
    frontier, links = reached, cut(both_ways(edges)) if hops > 0 else None
    for _ in range(hops):
        stepped = frontier.join(links, F.col("id") == F.col("node")).select(*groups, F.col("other").alias("id")).distinct()
        there = reached.select(*(F.col(c).alias(f"_{c}") for c in [*groups, "id"]))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups]  # a NULL group is a group
        frontier = cut(stepped.join(there, [F.col("id") == F.col("_id"), *same], "left_anti"))
        reached = reached.union(frontier)
    return reached


def induced(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges among the chosen ids, for each group of ``chosen``."""
    groups = [c for c in chosen.columns if c != "id"]
    kept = chosen.join(nodes, "id").select(*groups, *nodes.columns)
    first = chosen.join(edges, F.col("id") == F.col("src")).select(*groups, *edges.columns)
    second = chosen.select(*groups, F.col("id").alias("dst"))
    return kept, first.join(second, [*groups, "dst"], "left_semi").select(*groups, *edges.columns)


def relevance_fragment(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, top_k: int = 100) -> tuple[DataFrame, DataFrame]:
    """For each group of seeds that are in the graph: everything within ``hops``, and the ``top_k`` most central nodes. The
    graph is read by every step, so it is cut off once."""
    nodes, edges = cut(nodes), cut(edges)
    groups = [c for c in seeds.columns if c != "id"]
    known = seeds.join(nodes.select("id"), "id", "left_semi").select(*groups, "id")
    central = top_central(nodes, edges, top_k).select("id")
    every = known.select(*groups).distinct().crossJoin(central) if groups else central
    chosen = cut(expand(known, edges, hops).union(every).distinct())
    return induced(nodes, edges, chosen)


def fragment(nodes: DataFrame, edges: DataFrame, strategy: str = "full", seeds: DataFrame | None = None, hops: int = 2, top_k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that a client gets: 'full' all of it, 'relevance' what ``relevance_fragment`` gives (all of it
    without seeds). Another strategy raises ``ValueError``."""
    if strategy not in ("full", "relevance"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "full" or seeds is None:
        return nodes, edges
    return relevance_fragment(nodes, edges, seeds, hops, top_k)


def coverage(part: DataFrame, whole: DataFrame) -> DataFrame:
    """``coverage_ratio``: nodes of the part by nodes of the whole, 1 if the whole is empty."""
    a, b = part.agg(F.count("*").alias("a")), whole.agg(F.count("*").alias("b"))
    return a.crossJoin(b).select(F.when(F.col("b") == 0, 1.0).otherwise(F.col("a") / F.col("b")).alias("coverage_ratio"))


def entity_metadata(nodes: DataFrame) -> DataFrame:
    """``id, entity_type, description, weight`` of the entity nodes, with 'UNKNOWN', '' and 1 where they lack it."""
    entity = F.coalesce(F.col("role"), F.lit("entity")) == "entity"
    return nodes.filter(entity).select("id", F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def key_values(nodes: DataFrame) -> DataFrame:
    """``key, content`` as the index stores hold them: ``ent-`` or ``rel-`` and the MD5 of the name; an entity's content
    is its name and description."""
    entity = F.coalesce(F.col("role"), F.lit("entity")) != "hyperedge"
    return nodes.select(
        F.concat(F.when(entity, F.lit("ent-")).otherwise(F.lit("rel-")), F.md5("id")).alias("key"),
        F.when(entity, F.concat_ws(" ", "id", F.coalesce("description", F.lit("")))).otherwise(F.col("id")).alias("content"),
    )


def build_round(state: tuple[DataFrame, DataFrame] | None, entities: DataFrame, hyperedges: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a round: the round's records merged and put over the nodes and edges there were."""
    nodes = merge_entities(entities).unionByName(merge_hyperedges(hyperedges))
    links = merge_edges(edges)
    if state is None:
        return nodes, links
    return upsert(state[0], nodes, ["id"]), upsert(state[1], links, ["src", "dst"])
