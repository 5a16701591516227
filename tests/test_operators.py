"""Operators on small literal frames: the reference's own checks, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from knotwork.functions import grading, rewards, text
from knotwork.operators import balance, batch, evaluate, federated, graph, records, rl, tools, vector
from knotwork.operators.components import connected_components
from knotwork.schemas import EDGES, ENTITIES, HYPEREDGES
from knotwork.sources import documents as docs
from knotwork.streaming import rounds


def entities(spark, rows):
    return spark.createDataFrame([(c, r, o, n, t, d, w, h) for o, (c, r, n, t, d, w, h) in enumerate(rows)], ENTITIES)


def one(df):
    return df.first().asDict()


def test_two_clients_one_name(spark):
    e = entities(spark, [("a", 0, "Tree", "X", "short", 1.0, "h1"), ("b", 0, ' "TREE" ', "Y", "longer", 2.0, "h2"), ("b", 0, None, "Y", "z", 2.0, "h2")])
    assert graph.exact_groups(e).count() == 2  # white space outside the quotes keeps the quotes, as in the reference's rule
    e = entities(spark, [("a", 0, "Tree", "X", "aaaa", 1.0, "h1"), ("b", 0, '"TREE"', "Y", "bbbb", 2.0, None)])
    row = one(graph.merge_entities(e))
    assert (row["id"], row["description"], row["entity_type"], row["weight"], row["source_id"]) == ('"TREE"', "aaaa", "X", 3.0, ["h1"])


def test_packing_threshold(spark):
    e = entities(spark, [("a", 0, f"n{i}", "X", "d" * 900, 50.0 + i, "h") for i in range(5)] + [("a", 0, "low", "X", None, 29.9, "h"), ("a", 0, "nan", "X", None, float("nan"), "h"), ("a", 0, "none", "X", None, None, "h")])
    packed = records.pack_entities(e)
    assert packed.count() == 5 and packed.agg(F.max(F.length("description"))).first()[0] == 800


def test_delta_of_three_then_five(spark):
    first = entities(spark, [("a", 0, f"n{i}", "X", "", 1.0, "h") for i in range(3)])
    second = entities(spark, [("a", 1, f"n{i}", "X", "", 1.0, "h") for i in range(5)])
    assert records.delta_records(second, first, ["client_id", "entity_name"]).count() == 2


@pytest.mark.parametrize("samples, expected", [((10, 10), 0.5), ((30, 10), 0.75), ((0, 0), 0.5)])
def test_weighted_average(spark, samples, expected):
    p = spark.createDataFrame([("a", "w", 0, 1.0, samples[0]), ("b", "w", 0, 0.0, samples[1])], "client_id string, param string, idx int, val double, num_samples long")
    assert federated.weighted_average(p).first()["val"] == pytest.approx(expected)
    assert federated.masked_average(p).first()["val"] == pytest.approx(1.0 if samples[0] else 1.0)


def small_graph(spark):
    nodes = spark.createDataFrame([("a", "entity"), ("b", "entity"), ("c", "entity"), ("h", "hyperedge")], "id string, role string")
    edges = spark.createDataFrame([("h", "a", 1.0), ("h", "b", 1.0)], "src string, dst string, weight double")
    return nodes, edges


def test_fragments(spark):
    nodes, edges = small_graph(spark)
    assert graph.fragment(nodes, edges)[0].count() == 4
    seeds = spark.createDataFrame([("a",)], "id string")
    kept, links = graph.fragment(nodes, edges, "relevance", seeds, 1, 1)
    assert {r.id for r in kept.collect()} == {"a", "h"} and links.count() == 1
    with pytest.raises(ValueError):
        graph.fragment(nodes, edges, "other")
    assert {r.id for r in graph.expand(spark.createDataFrame([("c",)], "id string"), edges, 2).collect()} == {"c"}
    assert one(graph.coverage(nodes.limit(0), nodes.limit(0)))["coverage_ratio"] == 1.0


def test_stats_and_delta(spark):
    nodes, edges = small_graph(spark)
    s = one(graph.stats(nodes, edges))
    assert (s["num_nodes"], s["num_edges"], s["num_entity_nodes"], s["num_hyperedge_nodes"]) == (4, 2, 3, 1)
    assert s["density"] == pytest.approx(2 / 12)
    assert one(graph.stats(nodes.limit(0), edges.limit(0)))["density"] == 0.0
    same = one(graph.delta(graph.fingerprint(nodes, edges), graph.fingerprint(nodes, edges)))
    assert same["changed"] is False and same["more_num_entities"] == 0
    less = one(graph.delta(graph.bucketed_fingerprint(nodes, edges), graph.bucketed_fingerprint(nodes.filter("id <> 'c'"), edges)))
    assert less["changed"] is True and less["more_num_entities"] == 0


def test_partitions_change_nothing(spark):
    e = entities(spark, [("a", 0, f"n{i % 7}", f"t{i % 3}", "d" * (i % 4), float(i), f"h{i % 5}") for i in range(60)])
    a = sorted(map(str, graph.merge_entities(e.repartition(1)).collect()))
    assert a == sorted(map(str, graph.merge_entities(e.repartition(7).orderBy(F.desc("ord"))).collect()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    links = spark.createDataFrame([*chain, (None, 3)], "src long, dst long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(links.limit(0)).count() == 0


def test_splits(spark):
    df = spark.range(30).withColumn("topic", F.pmod("id", F.lit(5)))
    assert sorted(r["count"] for r in federated.iid_split(df, "id", 30, 4).groupBy("client").count().collect()) == [7, 7, 8, 8]
    for split in (federated.topic_split(df, "topic", 3), federated.dirichlet_split(df, "id", "topic", 3)):
        assert split.count() == 30 and split.select("id").distinct().count() == 30


def test_sparsify_keeps_ties(spark):
    p = spark.createDataFrame([("a", "w", i, v, 1) for i, v in enumerate([3.0, -3.0, 1.0, 2.0, 0.5, 0.1, 0.2, 0.3, 0.4, 0.6])], "client_id string, param string, idx int, val double, num_samples long")
    kept = {r.val for r in federated.sparsify(p, 0.1).collect()}
    assert kept == {3.0, -3.0, 0.0}
    assert federated.sparsify(p, 1.0).filter("val <> 0").count() == 10


def test_eos_and_padding(spark):
    df = spark.createDataFrame([([0, 0, 2, 42, 3, 5, 1, 0, 0],), ([],)], "t array<int>")
    rows = df.select(batch.eos_mask(F.col("t"), 1), batch.fit_length(F.col("t"), 4, 9), batch.without_left_pads(F.col("t"), 0)).collect()
    assert list(rows[0]) == [[1, 1, 1, 1, 1, 1, 1, 0, 0], [5, 1, 0, 0], [2, 42, 3, 5, 1, 0, 0]]
    assert list(rows[1]) == [[], [9, 9, 9, 9], []]
    with pytest.raises(Exception, match="longer"):
        df.select(batch.fit_length(F.col("t"), 4, 9, truncation="error")).collect()


def test_batch_algebra(spark):
    df = spark.range(5).withColumnRenamed("id", "row_id").withColumn("v", F.col("row_id") * 10)
    padded, more = batch.pad_to_divisor(df, 5, 4)
    assert more == 3 and [r.v for r in padded.orderBy("row_id").collect()] == [0, 10, 20, 30, 40, 0, 10, 20]
    assert batch.unpad(padded, 5).count() == 5
    assert [r.v for r in batch.pad_with_first(df, 5, 7).orderBy("row_id").collect()][5:] == [0, 0]
    with pytest.raises(ValueError):
        batch.chunk(df, 5, 2)
    with pytest.raises(KeyError):
        batch.pop(df, ["x"])
    folded = batch.fold(df.filter("row_id < 4"), 4, 2, "v")
    assert sorted(r["v"] for r in batch.unfold(folded, 2, "v").collect()) == [0, 10, 20, 30]
    order = spark.createDataFrame([(0, 4), (1, 3), (2, 2), (3, 1), (4, 0)], "row_id long, new_id long")
    assert [r.v for r in batch.reorder(batch.reorder(df, order), batch.inverse_order(order)).orderBy("row_id").collect()] == [0, 10, 20, 30, 40]
    assert batch.conflicts(df, df.withColumn("v", F.lit(0))).first()["rows_that_differ"] == 4


def test_group_advantage(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "uid string, score double")
    got = {(r.uid, r.score): r.advantage for r in rl.group_advantage(df).collect()}
    assert got[("b", 5.0)] == pytest.approx(5 / (1 + 1e-6)) and got[("a", 1.0)] == pytest.approx(-got[("a", 3.0)])
    assert {r.uid: r.advantage for r in rl.group_advantage(df, single="zero").collect()}["b"] == 0.0
    assert {r.score: r.advantage for r in rl.leave_one_out_advantage(df).collect()} == {1.0: -2.0, 3.0: 2.0, 5.0: 5.0}


def test_answers(spark):
    df = spark.createDataFrame([(["The Eiffel Tower!"], "eiffel tower"), (["x"], None), ([], "y"), (None, "y"), (["a b b"], "b b c")], "golden_answers array<string>, answer string")
    rows = evaluate.answer_scores(df).collect()
    assert [(r.em, round(r.f1, 4)) for r in rows] == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.8)]


def test_transcripts(spark):
    good = "<|im_start|>assistant\n<think>t</think>\n<query>{\"query\": \"q\"}</query><|im_end|>\n<|im_start|>assistant\n<think>t</think>\n<answer>a\nb</answer><|im_end|>"
    df = spark.createDataFrame([(good,), ("nothing",), (None,), ("<query>[1]</query></answer>",)], "x string")
    x = F.col("x")
    rows = df.select(rewards.format_score(x), text.first_answer(x), text.last_answer(x), text.tool_query(x), rewards.local_format(x)).collect()
    assert list(rows[0]) == [1.0, "a\nb", "a b", "q", 1.0]
    assert list(rows[1]) == [0.0, None, None, None, 0.0]
    assert rows[2][0] == 0.0 and rows[3][3] is None


def test_nan_means(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", None), ("n", float("nan"))], "metric string, value double")
    got = {r.metric: r["mean"] for r in federated.mean_of_metrics(df).collect()}
    assert got["m"] == 1.0 and math.isnan(got["n"])


def differencing(lengths, k, equal):
    """Largest differencing by its definition: all partial solutions are looked through for the two widest."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    groups = [order[at : at + k] for at in range(0, len(order), k)] if equal else [[i] for i in order]
    found = [sorted(([lengths[i] if i is not None else 0, 0 if i is None else 1, [] if i is None else [(i, lengths[i])]] for i in g + [None] * (k - len(g))), reverse=True) for g in groups]
    while len(found) > 1:
        found.sort(key=lambda s: (s[0][0] - s[-1][0], s[0]), reverse=True)
        a, b = found[0], found[1]
        found = [*found[2:], sorted(([x[0] + y[0], x[1] + y[1], x[2] + y[2]] for x, y in zip(a, b[::-1])), reverse=True)]
    return [sorted(i for i, _ in part[2]) for part in found[0]]


def test_balance_by_definition():
    import random

    draw = random.Random(3)
    for n in (1, 2, 7, 24, 60):
        for k in (1, 2, 3, 4):
            lengths = [draw.choice([1, 2, 3, 5, 50, 100]) for _ in range(n)]
            assert balance.largest_differencing(lengths, k) == differencing(lengths, k, False)
            if n % k == 0:
                assert balance.largest_differencing(lengths, k, True) == differencing(lengths, k, True)
                loads, sizes, want = [0] * k, [0] * k, [[] for _ in range(k)]
                for i, x in enumerate(lengths):
                    j = min(range(k), key=lambda j: (sizes[j], loads[j], j))
                    want[j].append(i)
                    loads[j] += x
                    sizes[j] += 1
                assert balance.least_loaded(lengths, k, True) == want


def test_balance(spark):
    lengths = [9, 8, 7, 6, 5, 4, 3, 2]
    parts = balance.largest_differencing(lengths, 2)
    assert sorted(i for p in parts for i in p) == list(range(8)) and abs(sum(lengths[i] for i in parts[0]) - 22) <= 1
    assert [len(p) for p in balance.largest_differencing(lengths, 4, True)] == [2, 2, 2, 2]
    assert [sum(lengths[i] for i in p) for p in balance.least_loaded(lengths, 2)] == [22, 22]
    assert balance.largest_differencing([], 2) == [[], []]


def test_balance_of_every_row(spark):
    from collections import defaultdict

    from knotwork.plans import registry

    rows = spark.range(1237).select(F.col("id").alias("row_id"), (F.pmod(F.col("id") * 7919, F.lit(997)) + 1).alias("length")).repartition(5)
    length = {r.row_id: r.length for r in rows.collect()}
    for k, most in ((8, None), (None, 20_000)):
        found = balance.balance_each(rows, 512, k, most).collect()
        assert sorted(r.row_id for r in found) == list(range(1237)) and all(r.batch == r.row_id // 512 and r.length == length[r.row_id] for r in found)
        for b in range(3):
            parts = defaultdict(list)
            for r in found:
                if r.batch == b:
                    parts[r.part].append(r.length)
            sums = [sum(p) for p in parts.values()]
            assert len(parts) == (k or -(-sum(sums) // most)) and max(sums) - min(sums) < 1000
            assert k is None or max(map(len, parts.values())) - min(map(len, parts.values())) <= 1
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    for name in ("seqlen_balance", "micro_batches"):
        assert sorted(r.row_id for r in registry.queries()[name](spark, sf).select("row_id").collect()) == list(range(n)) and n > 512
    assert registry.queries()["seqlen_balance_report"](spark, sf).count() == -(-n // 512)


def test_tools(spark):
    assert tools.evaluate("2 + 3 * 4") == 14 and tools.evaluate("1/0") is None and tools.evaluate("__import__('os')") is None and tools.evaluate("9**99999") is None
    upper = tools.tool()(lambda word: F.upper(word))
    upper.name = "upper"
    calls = spark.createDataFrame([(1, "upper", '{"word": "a"}'), (2, None, None), (3, "x", "{}"), (4, "upper", "{}"), (5, "upper", None)], "call_id int, tool string, arguments string")
    got = {r.call_id: (r.outcome, r.result) for r in tools.run_calls(calls, [upper]).collect()}
    assert got == {1: ("ok", "A"), 2: ("no_call", None), 3: ("unknown_tool", None), 4: ("invalid", None), 5: ("invalid", None)}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_a, r.vec_b) for r in vector.neighbour_pairs(v, 0.9).collect()} == {(1, 2), (2, 1)}
    assert {r.vec_id: r.group_id for r in vector.near_groups(v, 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    q = v.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert [r.vec_id for r in vector.top_k(vector.similarities(q, v), 2).orderBy("rank").collect()] == [1, 2]


def test_sources(spark, tmp_path):
    nodes = spark.createDataFrame([('a&"<', "entity", "T", "d > e", 1.5), ("h", "hyperedge", None, None, None)], "id string, role string, entity_type string, description string, weight double")
    edges = spark.createDataFrame([("h", 'a&"<', 2.0)], "src string, dst string, weight double")
    docs.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = docs.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str) and list(map(tuple, e.collect())) == list(map(tuple, edges.collect()))
    (tmp_path / "kv.json").write_text('{"k1": {"content": "a"}, "k2": {"content": "b"}}')
    assert [(r.pos, r.key, r.content) for r in docs.read_json_document(spark, str(tmp_path / "kv.json"), "content string").collect()] == [(0, "k1", "a"), (1, "k2", "b")]
    for step in (1, 2):
        docs.write_json_lines(spark.createDataFrame([(step,)], "step int"), str(tmp_path / "m"), first=step == 1)
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert docs.flatten(spark.createDataFrame([((1, (2,)), [1, 2])], "a struct<b:int,c:struct<d:int>>, l array<int>")).columns == ["a.b", "a.c.d", "l.list_len", "l"]


def record_frames(spark, r, n):
    e = entities(spark, [("a", r, f"n{i}", "X", "d", 1.0, "h") for i in range(n)])
    h = spark.createDataFrame([("a", r, 0, "<hyperedge>s", 1.0, "h")][: min(n, 1)], HYPEREDGES)
    k = spark.createDataFrame([("a", r, i, "<hyperedge>s", f'"N{i}"', 1.0, "h") for i in range(n)], EDGES)
    return e, h, k


def test_rounds_batch_and_stream_agree(spark, tmp_path):
    store = rounds.GraphStore(spark, str(tmp_path / "batch"))
    history = rounds.run_rounds(store, 3, lambda r: record_frames(spark, r, [2, 3, 0][r]))
    assert [h["new_num_entities"] for h in history] == [2, 3, 3] and [h["changed"] for h in history] == [True, True, False]
    again = store.advance(1, *record_frames(spark, 1, 3)).first()
    assert again["new_num_entities"] == 3
    e0, e1 = (record_frames(spark, r, n)[0] for r, n in ((0, 3), (1, 5)))
    assert store.unsent(0, e0).count() == 3 and store.unsent(1, e1).count() == 2
    for r, n in ((0, 2), (1, 3)):
        record_frames(spark, r, n)[0].coalesce(1).write.parquet(str(tmp_path / "in" / f"r{r}"))
    stream = spark.readStream.schema(ENTITIES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    other = rounds.GraphStore(spark, str(tmp_path / "stream"))
    empty = (spark.createDataFrame([], HYPEREDGES), spark.createDataFrame([], EDGES))
    rounds.stream_rounds(stream, other, str(tmp_path / "cp"), lambda df: (df, *empty)).awaitTermination()
    assert other.graph(other.latest())[0].count() == 3


def test_empty_frames(spark):
    e = entities(spark, [])
    h, k = spark.createDataFrame([], HYPEREDGES), spark.createDataFrame([], EDGES)
    nodes, edges = graph.build_round(None, e, h, k)
    assert nodes.count() == 0 and edges.count() == 0 and graph.degree_centrality(nodes, edges).count() == 0
    assert graph.fingerprint(nodes, edges).first()["num_entities"] == 0
    assert records.numbered(spark.range(0), "id").count() == 0


def test_grading():
    assert grading.last_boxed(r"so \boxed{\frac{1}{2}} and \boxed{x^{2}}") == r"\boxed{x^{2}}" and grading.last_boxed("none") is None
    assert grading.same_answer(r"\frac12", r"\frac{1}{2}") and grading.same_answer("0.5", r"\frac{1}{2}") and grading.same_answer(None, None) and not grading.same_answer("1", None)
    assert grading.grade("1,234", "1234") and not grading.grade("3", "3.5") and grading.grade("(1, 2)", "(1,2)") and not grading.grade("(1,2)", "[1,2]")
    assert grading.close_numbers("0.5", "50") and grading.close_numbers("33.333", "33.3333") and not grading.close_numbers("1", "2")


def test_format_of_odd_turns(spark):
    def turn(x):
        return f"<|im_start|>assistant\n{x}<|im_end|>\n"

    def user(x):
        return f"<|im_start|>user\n{x}<|im_end|>\n"

    ask, say = "<think>t</think>\n<query>q</query>", "<think>t</think>\n<answer>so 7</answer>"
    cases = [
        (turn(say), 0.5, 0.5), (turn("<think>a<think>b</think>\n<answer>x<think>y</answer>"), 0.5, 0.5), (turn("<query>q" + ask) + turn(say), 0.5, 0.5), (turn(ask) + turn(say), 1.0, 0.0),
        (user("Q") + turn(ask) + user("<knowledge>k</knowledge>") + turn(say), 1.0, 1.0), (user("Q") + turn(ask) + user("<knowledge>an error</knowledge>") + turn(say), 1.0, 0.5), (user("Q") + turn(ask) + user("none") + turn(say), 1.0, 0.5),
        (turn(say + "\n"), 0.5, 0.5), (turn(say + "\n\n"), 0.0, 0.0), ("", 0.0, 0.0), (None, 0.0, 0.0),
    ]
    df = spark.createDataFrame([(k, t, "7") for k, (t, *_) in enumerate(cases)], "k int, t string, truth string")
    rows = df.orderBy("k").select(rewards.format_score(F.col("t")), rewards.tool_format_score(F.col("t")), rewards.tool_reward(F.col("t"), F.col("truth")), rewards.composite(rewards.format_score(F.col("t")), F.lit(1.0), F.col("t").isNotNull())).collect()
    assert [(r[0], r[1]) for r in rows] == [c[1:] for c in cases]
    assert [r[2] for r in rows] == [0.0 if t is None else 1.0 if b == 1.0 else b - 1 for t, _, b in cases]
    assert [r[3] for r in rows] == [0.0 if t is None else 1.0 if a == 1.0 else a - 1 for t, a, _ in cases]


def test_managed_rewards(spark):
    df = spark.createDataFrame([(1, 0.5, 2, 3), (2, None, 1, 2), (3, float("nan"), 1, 1), (4, 1.0, 0, 0)], "id int, s double, n int, size int")
    assert [list(r.rewards) for r in rewards.managed(df, F.col("s"), F.col("n"), F.col("size")).orderBy("id").collect()] == [[0.0, 0.5, 0.0], [0.0, 0.0], [0.0], []]
    given = df.withColumn("rm_scores", F.array(F.lit(9.0)))
    assert {tuple(r.rewards) for r in rewards.managed(given, F.col("s"), F.col("n"), F.col("size")).collect()} == {(9.0,)}


def test_advantages_by_name(spark):
    tokens = spark.createDataFrame([(r, t, float(t + r), 0.5, int(t < 3), 0.1) for r in range(3) for t in range(200 if r else 1)], "row_id long, t int, reward double, value double, mask int, baseline double")
    for kind, options in (("gae", {"gamma": 0.9, "lam": 0.8}), ("reinforce_plus_plus", {"gamma": 0.9}), ("remax", {})):
        out = rl.advantage(tokens, kind, **options)
        assert {"row_id", "t", "advantage", "ret"} <= set(out.columns) and out.count() == tokens.count()
    adv, following = {}, {}
    for r in sorted(tokens.collect(), key=lambda r: (r.row_id, -r.t)):
        after = following.get(r.row_id, (0.0, 0.0))
        est = r.reward + 0.9 * after[1] - r.value + 0.72 * after[0]
        following[r.row_id] = (est, r.value)
        adv[(r.row_id, r.t)] = est
    got = {(r.row_id, r.t): r for r in rl.estimated(tokens, 0.9, 0.8).collect()}
    assert all(math.isclose(got[k].estimate, v, rel_tol=1e-9) and math.isclose(got[k].ret, v + 0.5, rel_tol=1e-9) for k, v in adv.items()) and len(got) == len(adv)
    with pytest.raises(ValueError):
        rl.advantage(tokens, "other")
    assert rl.gae(tokens.limit(0), 0.9, 0.9).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([([1, 0, 1] * 50,), ([],), (None,), ([5],)], "m array<int>")
    rows = [r[0] for r in df.select(batch.running(F.col("m"))).collect()]
    assert rows[0] == [sum(([1, 0, 1] * 50)[: k + 1]) for k in range(150)] and rows[1:] == [[], None, [5]]


def test_parts_of_a_batch(spark):
    a = spark.range(4).withColumnRenamed("id", "row_id")
    assert batch.from_parts({"a": a, "b": a.withColumn("x", F.lit(1))}).columns == ["row_id", "x"]
    with pytest.raises(ValueError, match="b"):
        batch.from_parts({"a": a, "b": a.limit(2)})
    with pytest.raises(ValueError):
        batch.from_parts({})
    assert batch.union_of({"a": 1, "b": [2]}, {"b": [2], "c": 3}) == {"a": 1, "b": [2], "c": 3}
    with pytest.raises(ValueError, match="a"):
        batch.union_of({"a": 1}, {"a": 2})


def test_algorithms_and_settings(spark):
    from knotwork.settings import Settings

    p = spark.createDataFrame([("a", "w", i, float(i), 1) for i in range(10)], "client_id string, param string, idx int, val double, num_samples long")
    assert {r.idx: r.val for r in federated.train_round(p, "sparse", ratio=0.2).collect()} == {i: float(i) if i > 7 else 0.0 for i in range(10)}
    with pytest.raises(ValueError, match="dense"):
        federated.algorithm("other")
    assert Settings.of({"lora_modules": ["q"], "num_rounds": 2}).lora_modules == ("q",) and Settings().lr == 5e-7
    for wrong in ({"adv_estimator": "x"}, {"client_frac": 0.0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            Settings.of(wrong)


def test_documents_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("b", 'é "x"', 1.5), ("a", None, 2.0)], "k string, s string, v double")
    docs.write_json_document(rows, str(tmp_path / "doc"), "k", ["s", "v"])
    import glob
    import json

    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "doc" / "part-*")))
    assert text.rstrip("\n") == json.dumps({"a": {"s": None, "v": 2.0}, "b": {"s": 'é "x"', "v": 1.5}}, indent=2, ensure_ascii=False)
    assert [(r.key, r.s, r.v) for r in docs.read_json_document(spark, str(tmp_path / "doc"), "s string, v double").orderBy("key").collect()] == [("a", None, 2.0), ("b", 'é "x"', 1.5)]
    for step, value in ((1, 0.5), (2, 0.25), (2, 0.125)):
        docs.write_metrics({"loss": value, "name": "x"}, str(tmp_path / "metrics"), step, spark)
    assert sorted((r.step, r.metric, r.value) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()) == [(1, "loss", 0.5), (2, "loss", 0.125)]
    assert docs.log_line({"loss": 0.25, "name": "x", "n": 3}, 4) == "step:4 - loss:0.250 - n:3.000"
    (tmp_path / "s.txt").write_text("one \n\ntwo\u00a0\n")
    assert [r.sentence for r in docs.read_sentences(spark, str(tmp_path / "s.txt")).collect()] == ["one", "", "two"]


def test_downlink_only_of_a_changed_graph(spark, tmp_path):
    sent, clients = [], spark.createDataFrame([(f"c{i}",) for i in range(4)], "client_id string")
    store = rounds.GraphStore(spark, str(tmp_path), whole=2)
    sizes = [2, 3, 0, 0, 4]
    history = rounds.run_rounds(store, 5, lambda r, names: record_frames(spark, r, sizes[r]), clients, 0.5, lambda r, g: sent.append((r, g[0].count())), lambda r, g: {"val/n": g[0].count()}, 2)
    assert [h["downlink"] for h in history] == ["none", "sent", "sent", "skipped", "skipped"] and [r for r, _ in sent] == [1, 2]
    assert [h.get("val/n") for h in history] == [3, None, 4, None, 5] and [h["init"] for h in history] == [True, False, False, False, False]
    assert all(len(h["clients"]) == 2 for h in history) and [h["new_num_entities"] for h in history] == [2, 3, 3, 3, 4]


def test_search_without_a_graph(spark):
    q = spark.createDataFrame([(1,), (1,)], "query_id long")
    assert [tuple(r) for r in vector.without_index(q, False, False).collect()] == [(1, "<knowledge>Knowledge graph not yet loaded.</knowledge>")]
    assert vector.without_index(q, True, False).first()[1] == "<knowledge>Embedding model not available.</knowledge>"
    with pytest.raises(ValueError):
        vector.without_index(q, True, True)


def test_cells_find_nine_of_ten(spark):
    from knotwork.plans import registry

    sf = "/root/testdata/sf0.1"
    exact, found = ({(r.query_id, r.vec_id) for r in registry.queries()[name](spark, sf).collect()} for name in ("vector_topk", "cell_search"))
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) == len(found)
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    centres = vector.fit_cells(v, 8)
    assert vector.in_cells(v, centres, 1).count() == v.count()
    every = {(r.vec_a, r.vec_b) for r in vector.neighbour_pairs(v.filter("vec_id < 200"), 0.35).collect()}
    assert every == {(r.vec_a, r.vec_b) for r in vector.neighbour_pairs(v.filter("vec_id < 200"), 0.35, centres=centres, probes=8).collect()}


def test_numbers_of_wide_rows(spark):
    df = spark.range(50_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("x"), F.lit("y" * 50).alias("z"))
    rows = records.numbered(df, "k").orderBy("k").select("pos").collect()
    assert [r.pos for r in rows] == list(range(50_000))


def test_sparsify_of_one_large_tensor(spark):
    p = spark.range(20_000).select(F.lit("a").alias("client_id"), F.lit("w").alias("param"), F.col("id").cast("int").alias("idx"), (F.pmod(F.xxhash64("id"), F.lit(1000)) - 500).cast("double").alias("val"), F.lit(1).alias("num_samples"))
    values = sorted((abs(r.val) for r in p.collect()), reverse=True)
    kept = [abs(r.val) for r in federated.sparsify(p, 0.05).filter("val <> 0").collect()]
    assert sorted(kept, reverse=True) == [v for v in values if v >= values[999]]


@pytest.mark.parametrize("a, b, right", [
    (r"\frac12", "0.5", True), (r"\text{ 5 }", "5", True), (r"x=\sqrt3", r"\sqrt{3}", True), ("2/4", "1/2", False), ("007/2", r"\frac{007}{2}", True), ("5 million", "5*10^6", True), ("", "0", False), (None, "1", False),
    ("1,000,000", "1000000", True), ("(1,2)", "[1,2]", False), ("3+4", "7", False), ("1.5", "3/2", True), ("2^{3}", "8", False), (r"\sqrt", r"\sqrt", True),
])
def test_grade(a, b, right):
    assert grading.grade(a, b) is right


@pytest.mark.parametrize("a, b, right", [
    ("50%", "0.5", True), ("101_2", "101", True), (r"2\pi", "6.2832", True), ("Interval.open(1, 2)", "(1,2)", True), ("Point(1)", "(1)", True), ("Point(1, 2)", "(1, 2)", False), ("1, 2", "2, 1", False), ("{1}", "1", True), ("3*4", "12.0", True), ("a", "b", False), ("", "1", False),
])
def test_same_math(a, b, right):
    assert grading.same_math(a, b) is right


def test_found_answer():
    assert grading.found_answer("So. The answer is: 42") == (True, "42") and grading.found_answer("I think 7 is the answer") == (True, "I think 7")
    assert grading.found_answer(r"hence \fbox{3} and \boxed{x^{2}}") == (True, "x^{2}") and grading.found_answer("none") == (False, "none") and grading.found_answer("") == (False, "")
    assert grading.judged(r"\boxed{3\pi}", "9.42") == (True, False, r"3\pi") and grading.judged(None, "1") == (False, False, "None")
    assert grading.last_boxed(r"\fbox{1} \boxed{2}") == r"\boxed{2}" and grading.last_boxed(r"\boxed{2} \fbox{1}") == r"\boxed{2}"
    assert not grading.may_be_worked_out("abc") and not grading.may_be_worked_out("2^100") and grading.may_be_worked_out("x+y")
