"""Queries of graph building, traversal and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text
from knotwork.operators import graph, records, vector
from knotwork.operators.components import connected_components
from knotwork.plans.answer_queries import SPACES, tok
from knotwork.plans.base import CANON, query
from knotwork.session import cut
from knotwork.sources import documents
from knotwork.sources.tables import scan_concat as scan
from knotwork.sources.tables import table
from knotwork.streaming import rounds

NAMED = f"""e AS (SELECT {CANON % 'entity_name'} AS id, * FROM entities WHERE entity_name IS NOT NULL)"""
NODES = NAMED + """, m AS (SELECT id, arg_max(coalesce(description, ''), {'n': length(coalesce(description, '')), 'o': -ord}) AS description, sum(weight) AS weight,
  coalesce(list_sort(list_distinct(list(source_chunk_hash) FILTER (WHERE source_chunk_hash IS NOT NULL))), []) AS source_id FROM e GROUP BY id),
 ty AS (SELECT id, entity_type, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS r FROM (SELECT id, coalesce(entity_type, 'UNKNOWN') AS entity_type, count(*) AS n, min(ord) AS f FROM e GROUP BY 1, 2)),
 en AS (SELECT m.id, 'entity' AS role, ty.entity_type, m.description, m.weight, m.source_id FROM m JOIN ty ON m.id = ty.id AND ty.r = 1),
 hn AS (SELECT hyperedge_name AS id, 'hyperedge' AS role, NULL AS entity_type, NULL AS description, sum(weight) AS weight, list_sort(list_distinct(list('client_' || client_id))) AS source_id FROM hyperedges WHERE hyperedge_name IS NOT NULL GROUP BY 1),
 nodes AS (SELECT * FROM en UNION ALL SELECT * FROM hn),
 ge AS (SELECT src_id AS src, tgt_id AS dst, sum(weight) AS weight, coalesce(list_sort(list_distinct(list(source_chunk_hash) FILTER (WHERE source_chunk_hash IS NOT NULL))), []) AS source_id FROM edges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL GROUP BY 1, 2)"""
#: Nodes and edges of the records before a round; %d is the round.
UNTIL = """nodes_%(t)s AS (SELECT DISTINCT id, role FROM (SELECT """ + CANON % "entity_name" + """ AS id, 'entity' AS role FROM entities WHERE entity_name IS NOT NULL AND round_number < %(r)d
  UNION ALL SELECT hyperedge_name, 'hyperedge' FROM hyperedges WHERE hyperedge_name IS NOT NULL AND round_number < %(r)d)),
 fp_%(t)s AS (SELECT count(*) FILTER (WHERE role <> 'hyperedge') AS num_entities, count(*) FILTER (WHERE role = 'hyperedge') AS num_hyperedges,
  (SELECT count(*) FROM (SELECT DISTINCT src_id, tgt_id FROM edges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL AND round_number < %(r)d)) AS num_edges,
  substr(md5(string_agg(id, '|' ORDER BY id) FILTER (WHERE role <> 'hyperedge')), 1, 12) AS names_hash FROM nodes_%(t)s)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_round(None, *(table(spark, d, t) for t in ("entities", "hyperedges", "edges")))


def _until(spark: SparkSession, d: str, r: int) -> tuple[DataFrame, DataFrame]:
    return graph.build_round(None, *(table(spark, d, t).filter(F.col("round_number") < r) for t in ("entities", "hyperedges", "edges")))


@query(f"WITH {NAMED} SELECT id, count(*) AS records, min(ord) AS first_ord FROM e GROUP BY id")
def entity_exact_dedup(spark, d):  # noqa: ANN001, ANN201
    return graph.exact_groups(table(spark, d, "entities"))


@query(f"WITH {NODES} SELECT id, role, entity_type, description, round(weight, 4) AS weight, array_to_string(source_id, '<SEP>') AS source_id FROM en")
def entity_merge(spark, d):  # noqa: ANN001, ANN201
    return graph.merge_entities(table(spark, d, "entities")).withColumn("weight", F.round("weight", 4)).withColumn("source_id", graph.joined_source(F.col("source_id")))


@query(f"WITH {NODES} SELECT id, round(weight, 4) AS weight, array_to_string(source_id, '<SEP>') AS source_id FROM hn")
def hyperedge_merge(spark, d):  # noqa: ANN001, ANN201
    return graph.merge_hyperedges(table(spark, d, "hyperedges")).select("id", F.round("weight", 4).alias("weight"), graph.joined_source(F.col("source_id")).alias("source_id"))


@query(f"WITH {NODES} SELECT src, dst, round(weight, 4) AS weight, array_to_string(source_id, '<SEP>') AS source_id FROM ge")
def edge_merge(spark, d):  # noqa: ANN001, ANN201
    return graph.merge_edges(table(spark, d, "edges")).withColumn("weight", F.round("weight", 4)).withColumn("source_id", graph.joined_source(F.col("source_id")))


@query(f"""SELECT src_id AS src, {CANON % 'tgt_id'} AS dst, round(sum(weight), 4) AS weight, count(*) AS records FROM edges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL GROUP BY 1, 2""")
def edge_merge_canonical(spark, d):  # noqa: ANN001, ANN201
    merged = graph.merge_edges(table(spark, d, "edges"), canonicalize=True, count=True)
    return merged.select("src", "dst", F.round("weight", 4).alias("weight"), "records")


@query(f"""WITH {NODES}, c AS (SELECT count(*) AS v, count(*) FILTER (WHERE role = 'entity') AS en, count(*) FILTER (WHERE role = 'hyperedge') AS hn FROM nodes), k AS (SELECT count(*) AS n FROM ge)
SELECT v AS num_nodes, k.n AS num_edges, en AS num_entity_nodes, hn AS num_hyperedge_nodes, round(CASE WHEN v < 2 THEN 0 ELSE k.n / (CAST(v AS DOUBLE) * (v - 1)) END, 9) AS density FROM c, k""")
def kg_stats(spark, d):  # noqa: ANN001, ANN201
    return graph.stats(*_graph(spark, d)).withColumn("density", F.round("density", 9))


@query(f"WITH {UNTIL % dict(t='a', r=1000)} SELECT num_entities, num_hyperedges, num_edges, names_hash FROM fp_a")
def kg_fingerprint(spark, d):  # noqa: ANN001, ANN201
    return graph.fingerprint(*_graph(spark, d))


DELTA = """SELECT a.num_entities AS old_num_entities, a.num_hyperedges AS old_num_hyperedges, a.num_edges AS old_num_edges, a.names_hash AS old_names_hash,
 b.num_entities AS new_num_entities, b.num_hyperedges AS new_num_hyperedges, b.num_edges AS new_num_edges, b.names_hash AS new_names_hash,
 greatest(0, b.num_entities - a.num_entities) AS more_num_entities, greatest(0, b.num_hyperedges - a.num_hyperedges) AS more_num_hyperedges, greatest(0, b.num_edges - a.num_edges) AS more_num_edges,
 a IS DISTINCT FROM b AS changed FROM fp_a a, fp_b b"""


@query(f"WITH {UNTIL % dict(t='a', r=20)}, {UNTIL % dict(t='b', r=1000)} {DELTA}")
def kg_delta(spark, d):  # noqa: ANN001, ANN201
    return graph.delta(graph.fingerprint(*_until(spark, d, 20)), graph.fingerprint(*_graph(spark, d)))


@query(f"""WITH {UNTIL % dict(t='a', r=20)}, {UNTIL % dict(t='b', r=1000)}, k AS ({DELTA}) SELECT old_num_entities AS "kg/prev_entities", new_num_entities AS "kg/curr_entities", old_num_hyperedges AS "kg/prev_hyperedges", new_num_hyperedges AS "kg/curr_hyperedges",
 more_num_entities AS "kg/new_entities", more_num_hyperedges AS "kg/new_hyperedges", more_num_edges AS "kg/new_edges", CAST(changed AS INTEGER) AS "kg/changed", CAST(NOT changed AS INTEGER) AS "kg/broadcast_skipped" FROM k""")
def kg_metrics(spark, d):  # noqa: ANN001, ANN201
    change = graph.delta(graph.fingerprint(*_until(spark, d, 20)), graph.fingerprint(*_graph(spark, d)))
    return graph.delta_metrics(change, ~F.col("changed"))


CENTRAL = """ends AS (SELECT DISTINCT src, dst FROM ge), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ends UNION ALL SELECT dst FROM ends) GROUP BY 1),
 every AS (SELECT id FROM nodes UNION SELECT id FROM deg), cen AS (SELECT every.id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / CAST((SELECT count(*) FROM every) - 1 AS DOUBLE), 9) AS centrality FROM every LEFT JOIN deg USING (id))"""


@query(f"WITH {NODES}, {CENTRAL} SELECT * FROM cen")
def degree_centrality(spark, d):  # noqa: ANN001, ANN201
    return graph.degree_centrality(*_graph(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(f"WITH {NODES}, {CENTRAL} SELECT * FROM cen ORDER BY degree DESC, id LIMIT 100")
def degree_centrality_topk(spark, d):  # noqa: ANN001, ANN201
    return graph.top_central(*_graph(spark, d), 100).withColumn("centrality", F.round("centrality", 9))


SEEDS = f"""seeds AS (SELECT DISTINCT client_id, {CANON % 'entity_name'} AS id FROM entities WHERE entity_name IS NOT NULL AND ord % 100 = 0)"""
HOPS = """links AS (SELECT src AS a, dst AS b FROM ge UNION SELECT dst, src FROM ge),
 h0 AS (SELECT client_id, id FROM seeds WHERE id IN (SELECT id FROM nodes)), h1 AS (SELECT * FROM h0 UNION SELECT client_id, b FROM h0 JOIN links ON a = id),
 h2 AS (SELECT * FROM h1 UNION SELECT client_id, b FROM h1 JOIN links ON a = id)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter("entity_name is not null and ord % 100 = 0")
    return e.select("client_id", graph.canonical_name(F.col("entity_name")).alias("id")).distinct()


@query(f"WITH {NODES}, {SEEDS}, {HOPS} SELECT client_id, id FROM h2")
def khop_expand(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = _graph(spark, d)
    seeds = _seeds(spark, d).join(nodes.select("id"), "id", "left_semi").select("client_id", "id")
    return graph.expand(seeds, edges.select("src", "dst"), 2)


RELEVANT = f"""{NODES}, {SEEDS}, {HOPS}, {CENTRAL}, top AS (SELECT id FROM cen ORDER BY degree DESC, id LIMIT 100),
 chosen AS (SELECT client_id, id FROM h2 UNION SELECT client_id, id FROM (SELECT DISTINCT client_id FROM h0), top)"""


@query(f"""WITH {RELEVANT}, n AS (SELECT client_id, count(*) AS num_nodes FROM chosen JOIN nodes USING (id) GROUP BY 1),
 k AS (SELECT a.client_id, count(*) AS num_edges FROM ge JOIN chosen a ON a.id = src JOIN chosen b ON b.id = dst AND b.client_id IS NOT DISTINCT FROM a.client_id GROUP BY 1)
 SELECT n.client_id, num_nodes, coalesce(num_edges, 0) AS num_edges, round(num_nodes / CAST((SELECT count(*) FROM nodes) AS DOUBLE), 9) AS coverage_ratio FROM n LEFT JOIN k ON n.client_id IS NOT DISTINCT FROM k.client_id""")
def relevance_fragment(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = _graph(spark, d)
    kept, links = graph.fragment(nodes.select("id"), edges.select("src", "dst"), "relevance", _seeds(spark, d), 2, 100)
    n = kept.groupBy("client_id").agg(F.count("*").alias("num_nodes"))
    k = links.groupBy(F.col("client_id").alias("c")).agg(F.count("*").alias("num_edges"))
    whole = nodes.agg(F.count("*").alias("whole"))
    return n.join(k, F.col("client_id").eqNullSafe(F.col("c")), "left").crossJoin(F.broadcast(whole)).select("client_id", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"), F.round(F.col("num_nodes") / F.col("whole"), 9).alias("coverage_ratio"))


@query(f"WITH {NAMED} SELECT round(count(DISTINCT id) FILTER (WHERE round_number < 20) / CAST(count(DISTINCT id) AS DOUBLE), 9) AS coverage_ratio FROM e")
def coverage_of_rounds(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "entities")
    return graph.coverage(graph.exact_groups(e.filter("round_number < 20")), graph.exact_groups(e)).withColumn("coverage_ratio", F.round("coverage_ratio", 9))


@query(f"WITH {NODES} SELECT id, coalesce(entity_type, 'UNKNOWN') AS entity_type, coalesce(description, '') AS description, round(coalesce(weight, 1.0), 4) AS weight FROM en")
def entity_metadata(spark, d):  # noqa: ANN001, ANN201
    return graph.entity_metadata(_graph(spark, d)[0]).withColumn("weight", F.round("weight", 4))


@query(f"""WITH {NODES} SELECT CASE WHEN role = 'entity' THEN 'ent-' ELSE 'rel-' END || md5(id) AS key, CASE WHEN role = 'entity' THEN id || ' ' || coalesce(description, '') ELSE id END AS content FROM nodes""")
def kv_rebuild(spark, d):  # noqa: ANN001, ANN201
    return graph.key_values(_graph(spark, d)[0])


@query("""WITH RECURSIVE l AS (SELECT DISTINCT src_id AS a, tgt_id AS b FROM edges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach(node, seen) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ways GROUP BY a UNION SELECT w.a, min(r.seen) FROM reach r JOIN both_ways w ON w.b = r.node JOIN recurring.reach o ON o.node = w.a WHERE r.seen < o.seen GROUP BY w.a)
 SELECT node, seen AS component FROM reach""")
def connected_components_of_edges(spark, d):  # noqa: ANN001, ANN201
    return connected_components(table(spark, d, "edges"), "src_id", "tgt_id")


@query(f"""WITH o AS (SELECT {CANON % 'entity_name'} AS id, max(round_number) AS r FROM entities WHERE entity_name IS NOT NULL GROUP BY 1),
 new AS (SELECT {CANON % 'entity_name'} AS id, sum(weight) AS w FROM entities WHERE entity_name IS NOT NULL AND round_number >= 20 GROUP BY 1),
 old AS (SELECT {CANON % 'entity_name'} AS id, sum(weight) AS w FROM entities WHERE entity_name IS NOT NULL AND round_number < 20 GROUP BY 1)
 SELECT id, round(w, 4) AS weight FROM new UNION ALL SELECT id, round(w, 4) FROM old WHERE id NOT IN (SELECT id FROM new)""")
def graph_upsert(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "entities")
    old, new = (graph.merge_entities(e.filter(c)).select("id", F.round("weight", 4).alias("weight")) for c in ("round_number < 20", "round_number >= 20"))
    return graph.upsert(old, new, ["id"])


@query("SELECT client_id, ord, entity_name, substr(description, 1, 800) AS description, weight FROM entities WHERE weight >= 30 AND NOT isnan(weight)")
def weight_filter_truncate(spark, d):  # noqa: ANN001, ANN201
    return records.pack_entities(table(spark, d, "entities")).select("client_id", "ord", "entity_name", "description", "weight")


@query("""SELECT a.client_id, a.round_number, a.ord, a.entity_name FROM entities a WHERE NOT EXISTS (SELECT 1 FROM entities b WHERE b.round_number = a.round_number - 1 AND b.client_id = a.client_id AND b.entity_name = a.entity_name)""")
def delta_anti_join(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "entities")
    return records.delta_records(e, e.withColumn("round_number", F.col("round_number") + 1), ["round_number", "client_id", "entity_name"]).select("client_id", "round_number", "ord", "entity_name")


@query("""SELECT a.client_id, a.round_number, a.ord, a.src_id, a.tgt_id FROM edges a WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.round_number = a.round_number - 1 AND b.client_id = a.client_id AND b.src_id = a.src_id AND b.tgt_id = a.tgt_id AND b.weight = a.weight)""")
def edge_delta(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "edges")
    return records.delta_records(e, e.withColumn("round_number", F.col("round_number") + 1), ["round_number", "client_id", "src_id", "tgt_id", "weight"]).select("client_id", "round_number", "ord", "src_id", "tgt_id")


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, pos FROM n WHERE pos >= 3 * greatest(1, ceil(n / 40.0)) AND pos < 4 * greatest(1, ceil(n / 40.0))""")
def round_slice(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id")
    return records.round_slice(records.numbered(docs, "doc_id"), docs.count(), 40, 3)


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), c AS (SELECT doc_id, CAST(floor(pos / greatest(1, ceil(n / (24 * 40.0)))) AS BIGINT) AS k FROM n)
 SELECT doc_id, k // 40 AS client, k % 40 AS round FROM c""")
def client_round_slice(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id")
    client, r = records.client_round_of(F.col("pos"), docs.count(), 24, 40)
    return records.numbered(docs, "doc_id").select("doc_id", client.alias("client"), r.alias("round"))


@query("""SELECT entity_name, '' AS entity_type, description, 1.0 AS weight, md5(entity_name) AS source_chunk_hash FROM entities WHERE entity_name IS NOT NULL""")
def prebuilt_projection(spark, d):  # noqa: ANN001, ANN201
    return records.prebuilt_records(table(spark, d, "entities").filter("entity_name is not null").select(F.col("entity_name").alias("id"), F.col("description").alias("content")))


@query("""SELECT e.ord, coalesce(d.h, e.source_chunk_hash, '') AS chunk_hash FROM entities e LEFT JOIN (SELECT DISTINCT chunk_hash AS h FROM documents WHERE chunk_hash IS NOT NULL) d ON d.h = e.source_chunk_hash""")
def chunk_hash_lookup(spark, d):  # noqa: ANN001, ANN201
    chunks = table(spark, d, "documents").filter("chunk_hash is not null").select(F.col("chunk_hash").alias("chunk_id"), "chunk_hash")
    e = table(spark, d, "entities").select("ord", F.col("source_chunk_hash").alias("chunk_id"))
    return records.with_chunk_hash(e, chunks, F.coalesce("chunk_id", F.lit(""))).select("ord", "chunk_hash")


@query("""WITH g AS (SELECT result_id, list_filter(CASE WHEN result_id % 3 = 0 THEN CASE WHEN data_source IS NULL THEN [] ELSE [data_source] END ELSE coalesce(golden_answers, CASE WHEN data_source IS NULL THEN [] ELSE [data_source] END) END, lambda x: x IS NOT NULL AND x <> '') AS g FROM results_step)
 SELECT result_id, array_to_string(g, '|') AS golds, len(g) AS n FROM g""")
def golden_answer_coercion(spark, d):  # noqa: ANN001, ANN201
    g = records.golden_answers(F.when(F.col("result_id") % 3 != 0, F.col("golden_answers")), F.col("data_source"))
    return table(spark, d, "results_step").select("result_id", F.array_join(g, "|").alias("golds"), F.size(g).alias("n"))


#: Words between white space, and the chunks of so many (size, overlap) of each document.
DOC_WORDS = """dw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '') AS w FROM documents)"""
CHUNKS = DOC_WORDS + """, dc AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - %(o)d) / %(s)d.0) AS BIGINT)))) AS k FROM dw WHERE len(w) > 0),
 ch AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, array_to_string(w[k * %(s)d + 1:k * %(s)d + %(n)d], ' ') AS content FROM dc)"""


@query(f"WITH {CHUNKS % dict(o=10, s=90, n=100)} SELECT doc_id, chunk_no, content, 'chunk-' || md5(content) AS chunk_id FROM ch")
def chunked_documents(spark, d):  # noqa: ANN001, ANN201
    return records.chunk_documents(table(spark, d, "documents"), 100, 10)


EXTRACTED = CHUNKS % dict(o=100, s=1100, n=1200) + r""", st AS (SELECT 'chunk-' || md5(content) AS chunk_id, unnest(regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM ch),
 nm AS (SELECT chunk_id, s, list_distinct(regexp_extract_all(s, '\p{Lu}[\p{L}''-]+(?: \p{Lu}[\p{L}''-]+)*')) AS names FROM st WHERE trim(s) <> '')"""


@query(f"WITH {EXTRACTED}, ln AS (SELECT chunk_id, '<hyperedge>' || s AS src_id, unnest(names) AS name FROM nm) SELECT src_id, {CANON % 'name'} AS tgt_id, 1.0 AS weight, chunk_id AS source_chunk_hash FROM ln")
def extracted_edges(spark, d):  # noqa: ANN001, ANN201
    return records.extract_records(records.chunk_documents(table(spark, d, "documents"), 1200, 100))[2]


@query(f"WITH {EXTRACTED} SELECT '<hyperedge>' || s AS hyperedge_name, 1.0 AS weight, chunk_id AS source_chunk_hash FROM nm")
def extracted_hyperedges(spark, d):  # noqa: ANN001, ANN201
    return records.extract_records(records.chunk_documents(table(spark, d, "documents"), 1200, 100))[1]


@query("""SELECT client_id, round_number, count(*) AS records, sum(strlen(to_json({'ord': ord, 'source_chunk_hash': source_chunk_hash})) - CASE WHEN source_chunk_hash IS NULL THEN strlen(',"source_chunk_hash":null') ELSE 0 END) AS bytes FROM entities GROUP BY 1, 2""")
def uplink_sizes(spark, d):  # noqa: ANN001, ANN201
    return records.packed_size(table(spark, d, "entities"), ["ord", "source_chunk_hash"], ["client_id", "round_number"])


VEC = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sims AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 100 = 0)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {VEC} SELECT query_id, vec_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims) WHERE r <= 10")
def vector_topk(spark, d):  # noqa: ANN001, ANN201
    found = vector.top_k(vector.similarities(_queries(spark, d), table(spark, d, "embeddings")), 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {VEC} SELECT query_id, vec_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims WHERE score >= 0.3) WHERE r <= 5")
def threshold_search(spark, d):  # noqa: ANN001, ANN201
    return vector.top_k(vector.similarities(_queries(spark, d), table(spark, d, "embeddings")), 5, 0.3).select("query_id", "vec_id", "rank")


@query(f"WITH {VEC} SELECT query_id, vec_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims) WHERE r <= 1 + (query_id // 100) % 7")
def per_query_limit(spark, d):  # noqa: ANN001, ANN201
    q = _queries(spark, d)
    limits = q.select("query_id", (1 + F.pmod(F.floor(F.col("query_id") / 100), F.lit(7))).alias("max_results"))
    return vector.limited(vector.top_k(vector.similarities(q, table(spark, d, "embeddings")), 10), limits).select("query_id", "vec_id", "rank")


@query()
def cell_search(spark, d):  # noqa: ANN001, ANN201
    index = table(spark, d, "embeddings")
    found = vector.cell_search(_queries(spark, d), index, vector.fit_cells(index, 16), 11, 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


NEAR = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id),
 n AS (SELECT vec_a, vec_b, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_a ORDER BY score DESC, vec_b) AS r FROM s) WHERE r <= 4 AND score > 0.35)"""


@query(f"WITH {NEAR} SELECT vec_a, vec_b, round(score, 6) AS score FROM n")
def fuzzy_dedup_pairs(spark, d):  # noqa: ANN001, ANN201
    return vector.neighbour_pairs(table(spark, d, "embeddings"), 0.35).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {NEAR}, w AS (SELECT vec_a AS a, vec_b AS b FROM n UNION SELECT vec_b, vec_a FROM n),
 reach(node, seen) USING KEY (node) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.a, min(r.seen) FROM reach r JOIN w ON w.b = r.node JOIN recurring.reach o ON o.node = w.a WHERE r.seen < o.seen GROUP BY w.a)
 SELECT node AS vec_id, seen AS group_id FROM reach""")
def fuzzy_groups(spark, d):  # noqa: ANN001, ANN201
    return vector.near_groups(table(spark, d, "embeddings"), 0.35)


HASHED = f"""{NAMED}, fd AS (SELECT id, arg_min(coalesce(description, ''), ord) AS d FROM e GROUP BY id), ft AS (SELECT id, list_transform({tok('d')}, lambda w: ((instr('0123456789abcdef', substr(md5(w), 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(w), 2, 1)) - 1) // 4) AS places FROM fd),
 v AS (SELECT id AS vec_id, list_transform(range(0, 64), lambda i: CAST(len(list_filter(places, lambda a: a = i)) AS DOUBLE)) AS e FROM ft)"""


@query(f"""WITH RECURSIVE {HASHED}, s AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(coalesce(list_cosine_similarity(a.e, b.e), 0.0), 9) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_sum(a.e) > 0 AND list_sum(b.e) > 0),
 n AS (SELECT vec_a, vec_b FROM (SELECT *, row_number() OVER (PARTITION BY vec_a ORDER BY score DESC, vec_b) AS r FROM s) WHERE r <= 4 AND score > 0.85), w AS (SELECT vec_a AS a, vec_b AS b FROM n UNION SELECT vec_b, vec_a FROM n),
 reach(node, seen) USING KEY (node) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.a, min(r.seen) FROM reach r JOIN w ON w.b = r.node JOIN recurring.reach o ON o.node = w.a WHERE r.seen < o.seen GROUP BY w.a)
 SELECT node AS id, seen AS group_id FROM reach""")
def fuzzy_entities(spark, d):  # noqa: ANN001, ANN201
    return vector.fuzzy_entities(table(spark, d, "entities"), text.hashed_vector)


@query("SELECT row_number() OVER (ORDER BY client_id) - 1 AS pos, client_id AS key, num_samples, trust FROM clients")
def json_document_round_trip(spark, d):  # noqa: ANN001, ANN201
    path = rounds.new_folder(spark)
    documents.write_json_document(table(spark, d, "clients"), path, "client_id", ["num_samples", "trust"])
    return documents.read_json_document(spark, path, "num_samples long, trust int").select(F.col("pos").cast("long").alias("pos"), "key", "num_samples", "trust")


@query("SELECT result_id, step, question, format_score FROM results_step WHERE NOT isnan(format_score) OR format_score IS NULL")
def json_lines_append(spark, d):  # noqa: ANN001, ANN201
    path = rounds.new_folder(spark)
    r = table(spark, d, "results_step").filter("not isnan(format_score) or format_score is null").select("result_id", "step", "question", "format_score")
    for k in range(3):
        documents.write_json_lines(r.filter(F.pmod("result_id", F.lit(3)) == k), path, first=k == 0)
    return spark.read.schema(r.schema).json(path)


@query(f"WITH {NODES} SELECT 'node' AS kind, md5(id) AS a, role AS b, round(weight, 4) AS weight FROM nodes UNION ALL SELECT 'edge', md5(src), md5(dst), round(weight, 4) FROM ge")
def graphml_round_trip(spark, d):  # noqa: ANN001, ANN201
    path = rounds.new_folder(spark)
    nodes, edges = (x.withColumn("weight", F.round("weight", 4)) for x in _graph(spark, d))
    documents.write_graphml(nodes, edges, path)
    n, e = documents.read_graphml(spark, path)
    both = n.select(F.lit("node").alias("kind"), F.md5("id").alias("a"), F.col("role").alias("b"), "weight").unionByName(e.select(F.lit("edge").alias("kind"), F.md5("src").alias("a"), F.md5("dst").alias("b"), "weight"))
    return both


@query("SELECT regexp_replace(question, '" + SPACES + "$', '') AS sentence, count(*) AS n FROM results_step WHERE question IS NOT NULL AND NOT contains(question, chr(10)) AND NOT contains(question, chr(13)) GROUP BY 1")
def sentence_lines(spark, d):  # noqa: ANN001, ANN201
    path = rounds.new_folder(spark)
    table(spark, d, "results_step").filter(~F.col("question").rlike(r"[\n\r]")).select(F.concat("question", F.lit(" \u00a0 "))).write.text(path)
    return documents.read_sentences(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


def _hits(spark: SparkSession, d: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions of every hundredth result, and for each the nodes that stand in for its search hits: the nodes by name are
    dealt to the questions in turn, the first five of each role."""
    q = records.numbered(table(spark, d, "results_step").filter("result_id % 100 = 0").select(F.col("result_id").alias("query_id")), "query_id", name="k")
    n = q.agg(F.count("*").alias("n"))
    dealt = records.numbered(nodes.select("role", "id"), "role", "id")
    first = dealt.groupBy("role").agg(F.min("pos").alias("first"))
    ranked = dealt.join(F.broadcast(first), "role").crossJoin(F.broadcast(n)).select("role", "id", F.pmod(F.col("pos") - F.col("first"), "n").alias("k"), (F.floor((F.col("pos") - F.col("first")) / F.col("n")) + 1).cast("int").alias("rank"))
    return q.select("query_id"), ranked.filter("rank <= 5").join(q, "k").select("query_id", "role", "rank", F.col("id").alias("name"))


@query(f"""WITH {NODES}, q AS (SELECT result_id AS query_id, row_number() OVER (ORDER BY result_id) - 1 AS k, count(*) OVER () AS n FROM results_step WHERE result_id % 100 = 0),
 h AS (SELECT query_id, role, id, pos // n + 1 AS rank FROM (SELECT role, id, row_number() OVER (PARTITION BY role ORDER BY id) - 1 AS pos FROM nodes) x JOIN q ON pos % n = k WHERE pos // n < 5),
 rel AS (SELECT DISTINCT dst AS name, src AS fact FROM ge WHERE src IN (SELECT id FROM hn) UNION SELECT DISTINCT src, dst FROM ge WHERE dst IN (SELECT id FROM hn)), num AS (SELECT name, fact, row_number() OVER (PARTITION BY name ORDER BY fact) AS sub FROM rel),
 lines AS (SELECT query_id, 0 AS section, rank, 0 AS sub, 'Fact: ' || id AS line FROM h WHERE role = 'hyperedge' AND id <> '' UNION ALL SELECT query_id, 1, rank, 0, 'Entity [' || h.id || ']: ' || description FROM h JOIN en ON en.id = h.id WHERE h.role = 'entity' AND description <> ''
  UNION ALL SELECT query_id, 1, rank, sub, 'Related fact: ' || fact FROM h JOIN num ON num.name = h.id WHERE h.role = 'entity'),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, rank, sub, line) AS r FROM lines),
 txt AS (SELECT query_id, '<knowledge>' || chr(10) || string_agg(line, chr(10) ORDER BY section, rank, sub, line) || chr(10) || '</knowledge>' AS context FROM top WHERE r <= 50 GROUP BY 1)
 SELECT q.query_id, coalesce(context, '<knowledge>No relevant knowledge found.</knowledge>') AS context FROM q LEFT JOIN txt USING (query_id)""")
def search_context(spark, d):  # noqa: ANN001, ANN201
    nodes, edges = (cut(x) for x in _graph(spark, d))
    q, hits = _hits(spark, d, nodes)
    facts = hits.filter("role = 'hyperedge'").select("query_id", "rank", F.col("name").alias("content"))
    entities = vector.with_metadata(hits.filter("role = 'entity'").select("query_id", "rank", "name"), nodes, ["description"])
    return vector.contexts(facts, entities, vector.adjacent_facts(nodes, edges), q)


@query("""SELECT result_id AS query_id, CASE WHEN result_id % 200 = 0 THEN '<knowledge>Knowledge graph not yet loaded.</knowledge>' ELSE '<knowledge>Embedding model not available.</knowledge>' END AS context FROM results_step WHERE result_id % 100 = 0""")
def search_without_index(spark, d):  # noqa: ANN001, ANN201
    q = table(spark, d, "results_step").filter("result_id % 100 = 0").select(F.col("result_id").alias("query_id"))
    return vector.without_index(q.filter("query_id % 200 = 0"), False, True).unionByName(vector.without_index(q.filter("query_id % 200 <> 0"), True, False))


@query(f"""WITH {NODES}, h AS (SELECT ord, {CANON % 'tgt_id'} AS name FROM edges WHERE tgt_id IS NOT NULL) SELECT ord, entity_type, md5(description) AS description FROM h LEFT JOIN en ON en.id = h.name""")
def metadata_lookup(spark, d):  # noqa: ANN001, ANN201
    hits = table(spark, d, "edges").filter("tgt_id is not null").select("ord", graph.canonical_name(F.col("tgt_id")).alias("name"))
    found = vector.with_metadata(hits, graph.merge_entities(table(spark, d, "entities")), ["entity_type", "description"])
    return found.select("ord", "entity_type", F.md5("description").alias("description"))


def _xml(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _data(key: str, x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN '' ELSE '<data key="{key}">' || {x} || '</data>' END"""


@query(f"""WITH {NODES}, n AS (SELECT *, round(weight, 4) AS w FROM nodes), g AS (SELECT *, round(weight, 4) AS w FROM ge) SELECT 1 AS section, '<node id="' || {_xml('id')} || '">' || {_data('role', 'role')} || {_data('entity_type', _xml('entity_type'))} || {_data('description', _xml('description'))} || {_data('weight', 'CAST(CASE WHEN abs(w) < 1e7 THEN w END AS VARCHAR)')} || '</node>' AS line FROM n
 UNION ALL SELECT 2, '<edge source="' || {_xml('src')} || '" target="' || {_xml('dst')} || '">' || {_data('weight', 'CAST(CASE WHEN abs(w) < 1e7 THEN w END AS VARCHAR)')} || '</edge>' FROM g""")
def graphml_lines(spark, d):  # noqa: ANN001, ANN201
    rounded = F.round("weight", 4)
    nodes, edges = (x.withColumn("weight", F.when(F.abs(rounded) < 1e7, rounded)) for x in _graph(spark, d))
    return documents.graphml_lines(nodes, edges).filter("section in (1, 2)")


@query("SELECT ord, client_id, round_number FROM entities WHERE client_id IN (SELECT client_id FROM clients WHERE trust >= 4)")
def sampled_client_messages(spark, d):  # noqa: ANN001, ANN201
    return records.of_clients(table(spark, d, "entities"), table(spark, d, "clients").filter("trust >= 4")).select("ord", "client_id", "round_number")


@query("SELECT c.client_id, coalesce(o.n, c.num_samples) AS num_samples FROM clients c LEFT JOIN (SELECT client_id, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) % 2 = 0) o USING (client_id)")
def client_override(spark, d):  # noqa: ANN001, ANN201
    own = table(spark, d, "entities").groupBy("client_id").agg(F.count("*").alias("num_samples")).filter("num_samples % 2 = 0")
    return records.overridden(table(spark, d, "clients").select("client_id", "num_samples"), own, ["client_id"], ["num_samples"])


@query("""SELECT result_id AS "r.result_id", len(golden_answers) AS "r.golden_answers.list_len", to_json(golden_answers) AS "r.golden_answers" FROM results_step""")
def flattened_params(spark, d):  # noqa: ANN001, ANN201
    flat = documents.flatten(table(spark, d, "results_step").select(F.struct("result_id", "golden_answers").alias("r")))
    return flat.select("`r.result_id`", F.col("`r.golden_answers.list_len`").cast("long").alias("r.golden_answers.list_len"), "`r.golden_answers`")


@query("SELECT count(*) AS rows, count(DISTINCT ord) AS different FROM (SELECT ord FROM entities UNION ALL SELECT ord FROM hyperedges UNION ALL SELECT ord FROM entities)")
def scan_concat(spark, d):  # noqa: ANN001, ANN201
    paths = [f"{d}/{t}.parquet" for t in ("entities", "hyperedges", "entities")]
    return scan(spark, paths).agg(F.count("*").alias("rows"), F.count_distinct("ord").alias("different"))


@query(f"WITH {NODES} SELECT id, coalesce(entity_type, 'UNKNOWN') AS entity_type, coalesce(description, '') AS description, round(coalesce(weight, 50.0), 4) AS weight, 'entity' AS role FROM en UNION ALL SELECT id, NULL, NULL, round(coalesce(weight, 1.0), 4), 'hyperedge' FROM hn")
def split_roles(spark, d):  # noqa: ANN001, ANN201
    entities, hyperedges = records.split_roles(_graph(spark, d)[0])
    both = entities.withColumn("role", F.lit("entity")).unionByName(hyperedges.withColumn("role", F.lit("hyperedge")), allowMissingColumns=True)
    return both.withColumn("weight", F.round("weight", 4))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '^" + SPACES + "', ''), '" + SPACES + "$', '') AS content FROM documents WHERE regexp_replace(text, '" + SPACES + "', '', 'g') <> ''")
def nonempty_chunks(spark, d):  # noqa: ANN001, ANN201
    return records.nonempty_chunks(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))


@query("SELECT doc_id, CAST(k AS INTEGER) AS slice_no, substr(hex(encode(text)), k * 800 + 1, 800) AS slice FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN strlen(text) < 1000 THEN 1 ELSE (strlen(text) + 399) // 400 END)) AS k FROM documents WHERE strlen(text) >= 1000)\n UNION ALL SELECT doc_id, 0, hex(encode(text)) FROM documents WHERE strlen(text) < 1000")
def byte_slices(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return records.byte_slices(docs, "content", 1000, 400).select("doc_id", "slice_no", F.hex("slice").alias("slice"))


@query("SELECT question AS prompt, list_extract(golden_answers, 1) AS chosen, md5(prediction) AS rejected FROM results_step")
def preference_pairs(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step").select("question", F.try_element_at("golden_answers", F.lit(1)).alias("gold"), F.md5("prediction").alias("said"))
    return records.preference_pairs(r, "question", "gold", "said")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT doc_id FROM n WHERE pos < 200")
def first_rows(spark, d):  # noqa: ANN001, ANN201
    return records.first_rows(records.numbered(table(spark, d, "documents").select("doc_id"), "doc_id"), 200).select("doc_id")


@query("""WITH n AS (SELECT client_id, num_samples, trust, row_number() OVER (ORDER BY client_id) AS k, count(*) OVER () AS n FROM clients) SELECT k AS pos, '  "' || client_id || '": {' || chr(10) || '    "num_samples": ' || num_samples || ',' || chr(10) || '    "trust": ' || trust || chr(10) || '  }' || CASE WHEN k < n THEN ',' ELSE '' END AS line FROM n""")
def json_document_lines(spark, d):  # noqa: ANN001, ANN201
    return documents.json_document_lines(table(spark, d, "clients"), "client_id", ["num_samples", "trust"]).filter("line not in ('{', '}')")


@query("SELECT result_id, question AS prompt, len(golden_answers) AS answers FROM results_step")
def nested_key_path(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step").select(F.struct("result_id", F.struct("question").alias("x")).alias("p"), F.struct("golden_answers").alias("q"), "result_id")
    both = records.nested(r, "p", "q.golden_answers")
    return both.select(F.col("prompt.result_id").alias("result_id"), F.col("prompt.x.question").alias("prompt"), F.when(F.col("response").isNotNull(), F.size("response")).cast("long").alias("answers"))
