"""Queries of batch algebra, reinforcement learning, federation and balance over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import grading
from knotwork.operators import balance, batch, evaluate, federated, records, rl, tools
from knotwork.plans import base
from knotwork.plans.base import BATCH, PARAMS, SEQUENCES, TOKENS, query
from knotwork.sources.tables import table
from knotwork.streaming import rounds


def _rounded(df, *columns, places=6):  # noqa: ANN001, ANN002, ANN202
    return df.select(*(F.round(c, places).alias(c) if c in columns else c for c in df.columns))


ORDERS = "o AS (SELECT o_orderkey, o_custkey AS uid, o_totalprice / 1000 AS score FROM orders)"


def _orders(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 1000).alias("score"))


@query(f"WITH {ORDERS}, w AS (SELECT *, avg(score) OVER p AS m, stddev_samp(score) OVER p AS s, count(*) OVER p AS n FROM o WINDOW p AS (PARTITION BY uid)) SELECT o_orderkey, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 5) AS advantage FROM w")
def grpo_advantage(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.group_advantage(_orders(spark, d)).select("o_orderkey", "advantage"), "advantage", places=5)


@query(f"WITH {ORDERS}, w AS (SELECT *, avg(score) OVER p AS m, stddev_samp(score) OVER p AS s, count(*) OVER p AS n FROM o WINDOW p AS (PARTITION BY uid)) SELECT o_orderkey, round(CASE WHEN n = 1 THEN 0.0 ELSE (score - m) / (s + 1e-6) END, 5) AS advantage FROM w")
def grpo_advantage_local(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.group_advantage(_orders(spark, d), single="zero").select("o_orderkey", "advantage"), "advantage", places=5)


@query(f"WITH {ORDERS}, w AS (SELECT *, avg(score) OVER p AS m, count(*) OVER p AS n FROM o WINDOW p AS (PARTITION BY uid)) SELECT o_orderkey, round(CASE WHEN n = 1 THEN score ELSE n / CAST(n - 1 AS DOUBLE) * (score - m) END, 3) AS advantage FROM w")
def rloo_advantage(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.leave_one_out_advantage(_orders(spark, d)).select("o_orderkey", "advantage"), "advantage", places=3)


@query(f"WITH {TOKENS} SELECT row_id, t, round(sum(reward * mask) OVER w, 6) AS ret, round(sum(reward * mask) OVER w - baseline * mask, 6) AS advantage FROM tok WINDOW w AS (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def remax_returns(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.baseline_returns(base.tokens(spark, d)).select("row_id", "t", "ret", "advantage"), "ret", "advantage")


DISCOUNTED = f"""{TOKENS}, last AS (SELECT row_id, max(t) AS t FROM tok GROUP BY 1),
 back AS (SELECT tok.row_id, tok.t, mask, reward AS ret, reward * mask AS run FROM tok JOIN last USING (row_id, t) UNION ALL SELECT tok.row_id, tok.t, tok.mask, reward + 0.9 * run, (reward + 0.9 * run) * tok.mask FROM back JOIN tok ON tok.row_id = back.row_id AND tok.t = back.t - 1)"""


@query(f"WITH RECURSIVE {DISCOUNTED} SELECT row_id, t, round(ret, 6) AS ret FROM back")
def reinforce_pp_returns(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.discounted(base.tokens(spark, d), 0.9).select("row_id", "t", "ret"), "ret")


def _whitened(column: str, frame: str) -> str:
    """Mean and variance by their definition, over the kept tokens: the variance with n / (n - 1)."""
    return f"""m AS (SELECT sum({column} * mask) / sum(mask) AS m FROM {frame}), v AS (SELECT sum(({column} - m) * ({column} - m) * mask) / sum(mask) * (sum(mask) / (sum(mask) - 1.0)) AS v FROM {frame}, m)"""


@query(f"WITH RECURSIVE {DISCOUNTED}, {_whitened('ret', 'back')} SELECT row_id, t, round((ret - m) / sqrt(v + 1e-8) * mask, 5) AS advantage, round(ret, 6) AS ret FROM back, m, v")
def reinforce_pp_advantage(spark, d):  # noqa: ANN001, ANN201
    return _rounded(_rounded(rl.advantage(base.tokens(spark, d), "reinforce_plus_plus", gamma=0.9), "advantage", places=5), "ret")


ESTIMATED = f"""{TOKENS}, last AS (SELECT row_id, max(t) AS t FROM tok GROUP BY 1),
 back AS (SELECT tok.row_id, tok.t, mask, value, reward - value AS adv FROM tok JOIN last USING (row_id, t) UNION ALL SELECT tok.row_id, tok.t, tok.mask, tok.value, reward + 0.99 * back.value - tok.value + 0.99 * 0.95 * adv FROM back JOIN tok ON tok.row_id = back.row_id AND tok.t = back.t - 1)"""


@query(f"WITH RECURSIVE {ESTIMATED}, {_whitened('adv', 'back')} SELECT row_id, t, round((adv - m) / sqrt(v + 1e-8), 5) AS advantage, round(adv + value, 6) AS ret FROM back, m, v")
def gae(spark, d):  # noqa: ANN001, ANN201
    return _rounded(_rounded(rl.advantage(base.tokens(spark, d), "gae", gamma=0.99, lam=0.95), "advantage", places=5), "ret")


@query(f"WITH {TOKENS}, s AS (SELECT avg(advantage) FILTER (WHERE mask <> 0) AS m, var_samp(advantage) FILTER (WHERE mask <> 0) AS v FROM tok) SELECT row_id, t, round((advantage - m) / sqrt(v + 1e-8), 6) AS whitened FROM tok, s")
def masked_whiten(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.whiten(base.tokens(spark, d), "advantage").select("row_id", "t", "whitened"), "whitened")


@query(f"""WITH {TOKENS}, x AS (SELECT row_id, t, logp - ref_logp AS d FROM tok) SELECT row_id, t, round(d, 6) AS kl, round(abs(d), 6) AS absolute, round(0.5 * d * d, 6) AS mse, round(greatest(least(exp(-d) + d - 1, 10.0), -10.0), 6) AS low_var FROM x""")
def kl_penalty_variants(spark, d):  # noqa: ANN001, ANN201
    a, b = F.col("logp"), F.col("ref_logp")
    kinds = (("kl", "kl"), ("absolute", "abs"), ("mse", "mse"), ("low_var", "low_var_kl"))
    return base.tokens(spark, d).select("row_id", "t", *(F.round(rl.kl_penalty(a, b, k), 6).alias(n) for n, k in kinds))


@query(f"WITH {TOKENS}, e AS (SELECT row_id, sum((logp - ref_logp) * mask) / nullif(sum(mask), 0) AS k FROM tok GROUP BY 1) SELECT round(avg(k), 6) AS mean_kl FROM e")
def mean_kl(spark, d):  # noqa: ANN001, ANN201
    kept = base.tokens(spark, d)
    some = kept.groupBy("row_id").agg(F.sum("mask").alias("n")).filter("n > 0")
    return _rounded(rl.mean_kl(kept.join(some, "row_id", "left_semi")), "mean_kl")


@query(f"WITH {TOKENS} SELECT row_id, t, round(score - 0.1 * (logp - ref_logp) * mask, 6) AS reward FROM tok")
def penalised_rewards(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.penalised_rewards(base.tokens(spark, d), 0.1).select("row_id", "t", "reward"), "reward")


@query(f"""WITH {TOKENS}, x AS (SELECT *, exp(logp - old_logp) AS r FROM tok), y AS (SELECT *, -advantage * r AS a, -advantage * greatest(least(r, 1.02), 0.98) AS b FROM x)
 SELECT round(sum(greatest(a, b) * mask) / sum(mask), 6) AS pg_loss, round(sum(CASE WHEN b > a THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 4) AS clip_fraction, round(sum((old_logp - logp) * mask) / sum(mask), 6) AS approx_kl FROM y""")
def ppo_clip_loss(spark, d):  # noqa: ANN001, ANN201
    out = rl.policy_loss(base.tokens(spark, d), 0.02)
    return out.select(F.round("pg_loss", 6).alias("pg_loss"), F.round("clip_fraction", 4).alias("clip_fraction"), F.round("approx_kl", 6).alias("approx_kl"))


@query(f"""WITH {TOKENS}, x AS (SELECT *, greatest(least(value_new, value + 0.1), value - 0.1) AS h FROM tok), y AS (SELECT *, (value_new - ret) * (value_new - ret) AS a, (h - ret) * (h - ret) AS b FROM x)
 SELECT round(0.5 * sum(greatest(a, b) * mask) / sum(mask), 6) AS vf_loss, round(sum(CASE WHEN b > a THEN 1.0 ELSE 0.0 END * mask) / sum(mask), 4) AS clip_fraction FROM y""")
def value_loss(spark, d):  # noqa: ANN001, ANN201
    out = rl.value_loss(base.tokens(spark, d), 0.1)
    return out.select(F.round("vf_loss", 6).alias("vf_loss"), F.round("clip_fraction", 4).alias("clip_fraction"))


@query(f"WITH {TOKENS} SELECT round(1 - var_samp(ret - value) / (var_samp(ret) + 1e-5), 6) AS explained_variance FROM tok WHERE mask <> 0")
def explained_variance(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.explained_variance(base.tokens(spark, d)), "explained_variance")


def _three(name: str, x: str, frame: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{name}/{n}' AS metric, CAST({f}({x}) AS DOUBLE) AS value FROM {frame} WHERE {where}" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min")))


@query(f"""WITH {TOKENS}, s AS (SELECT row_id, sum(score) AS score, sum(reward) AS reward, sum(mask) AS n FROM tok GROUP BY 1),
 r AS (SELECT o_orderkey, o_orderkey % 4 / 4.0 AS fs, o_custkey % 10 / 10.0 AS f1, o_custkey % 2 AS em, o_orderkey % 5 + 1 AS turns, o_custkey % 9 AS pl FROM orders),
 x AS ({_three('critic/score', 'score', 's')} UNION ALL {_three('critic/rewards', 'reward', 's')} UNION ALL {_three('critic/advantages', 'advantage', 'tok', 'mask <> 0')} UNION ALL {_three('critic/returns', 'ret', 'tok', 'mask <> 0')} UNION ALL {_three('critic/values', 'value', 'tok', 'mask <> 0')}
 UNION ALL {_three('critic/format_score', 'fs', 'r')} UNION ALL {_three('critic/answer_f1_score', 'f1', 'r')} UNION ALL {_three('critic/answer_em_score', 'em', 'r')} UNION ALL {_three('turns', 'turns', 'r')} UNION ALL {_three('response_length', 'n', 's')} UNION ALL {_three('prompt_length', 'pl', 'r')}
 UNION ALL SELECT 'response_length/clip_ratio', count(*) FILTER (WHERE n = 4) / CAST(count(*) AS DOUBLE) FROM s UNION ALL SELECT 'prompt_length/clip_ratio', count(*) FILTER (WHERE pl = 8) / CAST(count(*) AS DOUBLE) FROM r
 UNION ALL SELECT 'critic/vf_explained_var', 1 - var_samp(ret - value) / (var_samp(ret) + 1e-5) FROM tok WHERE mask <> 0) SELECT metric, round(value, 5) AS value FROM x""")
def data_metrics(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.pmod("o_orderkey", F.lit(4)) / 4).alias("format_score"), (F.pmod("o_custkey", F.lit(10)) / 10).alias("answer_f1_score"), F.pmod("o_custkey", F.lit(2)).alias("answer_em_score"),
        (F.pmod("o_orderkey", F.lit(5)) + 1).alias("turns"), F.pmod("o_custkey", F.lit(9)).alias("prompt_length"),
    )
    return _rounded(rl.data_metrics(base.tokens(spark, d), rows, 4, 8), "value", places=5)


@query("WITH t AS (SELECT event_type, sum(value) AS s, sum(length(props)) AS n FROM events GROUP BY 1) SELECT event_type AS section, round(s, 4) AS seconds, round(s * 1000 / n, 4) AS ms_per_token FROM t")
def timing_metrics(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("event_type").alias("section"), F.col("value").alias("seconds"), F.length("props").alias("n"))
    out = rl.timing_metrics(e.select("section", "seconds"), e.groupBy("section").agg(F.sum("n").alias("tokens")))
    return _rounded(out, "seconds", "ms_per_token", places=4)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT vec_id, x, list_max(x) AS top FROM e), z AS (SELECT *, list_sum(list_transform(x, lambda y: exp(y - top))) AS z, list_sum(list_transform(x, lambda y: exp(y - top) * y)) AS s FROM m) SELECT vec_id, round(top + ln(z) - s / z, 6) AS entropy FROM z""")
def logits_entropy(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "embeddings").select("vec_id", F.round(rl.entropy(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("entropy"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS step, o_totalprice / 1e6 AS kl FROM orders) SELECT step, round(ln(0.2) + sum(ln(1 + greatest(least(kl / 0.1 - 1, 0.2), -0.2) * 64 / 10000.0)) OVER (ORDER BY step), 6) AS log_coef FROM s""")
def adaptive_kl(spark, d):  # noqa: ANN001, ANN201
    steps = base.batch(spark, d).select(F.col("row_id").alias("step"), (F.col("o_totalprice") / 1e6).alias("kl"), F.lit(64).alias("n"))
    return _rounded(rl.adaptive_kl(steps, 0.2, 0.1, 10000.0).select("step", "log_coef"), "log_coef")


@query("""WITH s AS (SELECT unnest(range(0, 1000)) AS step) SELECT step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE greatest(0.1, 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0))) END, 6) AS factor FROM s""")
def learning_rates(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rl.learning_rates(spark.range(1000).withColumnRenamed("id", "step"), 100, 1000, floor=0.1), "factor")


@query(f"WITH {SEQUENCES} SELECT row_id, array_to_string(list_transform(tokens, lambda x, i: CASE WHEN list_position(tokens, 3) IS NULL OR list_position(tokens, 3) = 0 OR i <= list_position(tokens, 3) THEN 1 ELSE 0 END), ',') AS mask FROM seq")
def eos_mask(spark, d):  # noqa: ANN001, ANN201
    return base.sequences(spark, d).select("row_id", F.array_join(batch.eos_mask(F.col("tokens"), 3).cast("array<string>"), ",").alias("mask"))


@query(f"""WITH {SEQUENCES} SELECT row_id, array_to_string(list_transform(mask, lambda x, i: greatest(list_sum(mask[1:i]) - 1, 0)), ',') AS clipped, array_to_string(list_transform(mask, lambda x, i: (list_sum(mask[1:i]) - 1) * x), ',') AS masked FROM seq""")
def position_ids(spark, d):  # noqa: ANN001, ANN201
    s = base.sequences(spark, d)
    return s.select("row_id", F.array_join(batch.positions_clipped(F.col("mask")).cast("array<string>"), ",").alias("clipped"), F.array_join(batch.positions_masked(F.col("mask")).cast("array<string>"), ",").alias("masked"))


@query(f"""WITH {SEQUENCES} SELECT row_id, array_to_string(CASE WHEN len(tokens) > 5 THEN tokens[len(tokens) - 4:len(tokens)] ELSE list_concat(list_transform(range(0, 5 - len(tokens)), lambda i: 0), tokens) END, ',') AS left_padded,
 array_to_string(CASE WHEN len(tokens) > 5 THEN tokens[1:5] ELSE list_concat(tokens, list_transform(range(0, 5 - len(tokens)), lambda i: 0)) END, ',') AS right_padded FROM seq""")
def pad_truncate(spark, d):  # noqa: ANN001, ANN201
    t = F.col("tokens")
    return base.sequences(spark, d).select("row_id", F.array_join(batch.fit_length(t, 5, 0).cast("array<string>"), ",").alias("left_padded"), F.array_join(batch.fit_length(t, 5, 0, False, "right").cast("array<string>"), ",").alias("right_padded"))


@query(f"""WITH {SEQUENCES} SELECT row_id, array_to_string(list_concat(list_filter(tokens, lambda x: x = 1), list_filter(tokens, lambda x: x <> 1)), ',') AS moved, array_to_string(list_transform(tokens, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END), ',') AS attention FROM seq""")
def pads_aside(spark, d):  # noqa: ANN001, ANN201
    t = F.col("tokens")
    return base.sequences(spark, d).select("row_id", F.array_join(batch.pads_aside(t, 1).cast("array<string>"), ",").alias("moved"), F.array_join(batch.attention_mask(t, 1).cast("array<string>"), ",").alias("attention"))


@query(f"""WITH {SEQUENCES} SELECT row_id, array_to_string(list_transform(mask, lambda x, i: CASE WHEN i - 1 < 1 OR i = len(mask) THEN 0 ELSE x END), ',') AS loss_mask FROM seq""")
def loss_mask_sft(spark, d):  # noqa: ANN001, ANN201
    return base.sequences(spark, d).select("row_id", F.array_join(batch.sft_loss_mask(F.col("mask"), F.lit(2)).cast("array<string>"), ",").alias("loss_mask"))


@query(f"""WITH {SEQUENCES} SELECT row_id, array_to_string(list_transform(range(0, len(tokens)), lambda i: CASE WHEN i = len(tokens) - 1 THEN 7 ELSE 0 END), ',') AS rewards FROM seq""")
def reward_place(spark, d):  # noqa: ANN001, ANN201
    placed = batch.place_reward(F.lit(7.0), F.size("tokens"), F.size("tokens"))
    return base.sequences(spark, d).select("row_id", F.array_join(F.transform(placed, lambda x: x.cast("int").cast("string")), ",").alias("rewards"))


@query(f"""WITH {SEQUENCES} SELECT sum(list_sum(mask)) AS kept, round(sum(list_sum(mask)) / CAST(sum(len(mask)) AS DOUBLE), 6) AS coverage FROM seq""")
def loss_mask_coverage(spark, d):  # noqa: ANN001, ANN201
    s = base.sequences(spark, d).select(F.col("mask").alias("loss_mask"), F.transform("mask", lambda x: F.lit(1)).alias("response_mask"))
    return _rounded(rl.loss_mask_coverage(s), "coverage")


@query(f"WITH {BATCH} SELECT row_id * 3 + k AS row_id, o_orderkey FROM b, (SELECT unnest(range(0, 3)) AS k)")
def batch_repeat(spark, d):  # noqa: ANN001, ANN201
    return batch.repeat(base.batch(spark, d), 3).select("row_id", "o_orderkey")


@query(f"WITH {BATCH} SELECT k * (SELECT count(*) FROM b) + row_id AS row_id, o_orderkey FROM b, (SELECT unnest(range(0, 3)) AS k)")
def batch_repeat_whole(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.repeat(b, 3, b.count(), interleave=False).select("row_id", "o_orderkey")


@query(f"WITH {BATCH} SELECT row_id, row_id // ((SELECT count(*) FROM b) // 5) AS chunk_id FROM b")
def batch_chunk(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.chunk(b, b.count(), 5).select("row_id", "chunk_id")


@query(f"WITH {BATCH}, n AS (SELECT count(*) AS n FROM b), i AS (SELECT unnest(range(0, CAST(n + (7 - n % 7) % 7 AS BIGINT))) AS row_id, n FROM n) SELECT i.row_id, o_orderkey FROM i JOIN b ON b.row_id = i.row_id % i.n")
def batch_pad(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.pad_to_divisor(b, b.count(), 7)[0].select("row_id", "o_orderkey")


@query(f"WITH {BATCH}, n AS (SELECT count(*) // 5 AS w FROM b) SELECT row_id % w AS fold_id, array_to_string(list(o_orderkey ORDER BY row_id), ',') AS keys FROM b, n GROUP BY 1")
def batch_fold(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.fold(b, b.count(), 5, "o_orderkey").select("fold_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("keys"))


@query(f"WITH {BATCH} SELECT row_id, row_id // 64 AS batch FROM b WHERE row_id // 64 < (SELECT count(*) FROM b) // 64")
def batch_sampler(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.full_batches(b, b.count(), 64).select("row_id", "batch")


@query(f"WITH {BATCH} SELECT k AS epoch, row_id // 128 AS batch, row_id FROM b, (SELECT unnest(range(0, 2)) AS k)")
def batch_iterator(spark, d):  # noqa: ANN001, ANN201
    return batch.mini_batches(base.batch(spark, d), 128, 2).select("epoch", "batch", "row_id")


@query(f"""WITH {BATCH}, e AS (SELECT k AS epoch, row_id, row_number() OVER (PARTITION BY k ORDER BY md5('7|' || k || '|' || row_id), row_id) - 1 AS pos FROM b, (SELECT unnest(range(0, 2)) AS k)) SELECT epoch, pos // 128 AS batch, row_id FROM e""")
def batch_iterator_seeded(spark, d):  # noqa: ANN001, ANN201
    return batch.mini_batches(base.batch(spark, d), 128, 2, 7).select("epoch", "batch", "row_id")


@query(f"""WITH {BATCH}, e AS (SELECT row_id, row_number() OVER (ORDER BY md5('3|' || row_id), row_id) - 1 AS pos, count(*) OVER () AS n FROM b) SELECT row_id, pos // 64 AS batch FROM e WHERE pos // 64 < n // 64""")
def batch_sampler_random(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.random_batches(b, b.count(), 64, 3).select("row_id", "batch")


@query(f"""WITH {BATCH} SELECT o_orderkey FROM b ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 20""")
def seeded_sample(spark, d):  # noqa: ANN001, ANN201
    return batch.seeded_sample(base.batch(spark, d), "o_orderkey", 20).select("o_orderkey")


@query(f"WITH {BATCH} SELECT row_id, o_orderkey AS k, o_totalprice AS p FROM b WHERE row_id >= 10 AND row_id < 1000")
def batch_columns(spark, d):  # noqa: ANN001, ANN201
    taken, rest = batch.pop(base.batch(spark, d), ["o_orderkey"])
    both = batch.zip_rows(batch.rename(taken, ["o_orderkey"], ["k"]), batch.rename(rest, ["o_totalprice"], ["p"]))
    return batch.rows(both, 10, 1000)


@query(f"WITH {BATCH}, n AS (SELECT count(*) AS n FROM b) SELECT n - 1 - row_id AS row_id, o_orderkey FROM b, n")
def batch_reorder(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    order = b.select("row_id", (F.lit(b.count() - 1) - F.col("row_id")).alias("new_id"))
    back = batch.reorder(batch.reorder(b, order), batch.inverse_order(order))  # as it was
    return batch.reorder(back, order).select("row_id", "o_orderkey")


@query(f"WITH {BATCH} SELECT row_id, o_orderkey FROM b UNION ALL SELECT (SELECT count(*) FROM b) + k, (SELECT o_orderkey FROM b WHERE row_id = 0) FROM (SELECT unnest(range(0, 5)) AS k)")
def batch_pad_first(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    n = b.count()
    return batch.pad_with_first(b, n, n + 5).select("row_id", "o_orderkey")


@query("SELECT 'orders' AS frame, (SELECT count(*) FROM orders) AS rows, true AS same UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer) = (SELECT count(*) FROM orders)")
def batch_consistency(spark, d):  # noqa: ANN001, ANN201
    return batch.same_rows({t: table(spark, d, t) for t in ("orders", "customer")})


@query(f"WITH {SEQUENCES} SELECT row_id, array_to_string(CASE WHEN row_id % 3 = 0 THEN [9, 9, 9, 9] ELSE tokens[1:4] END, ',') AS tokens, CASE WHEN row_id % 3 = 0 THEN '' ELSE 'r' || row_id END AS text FROM seq")
def pad_inactive(spark, d):  # noqa: ANN001, ANN201
    s = base.sequences(spark, d)
    active = s.filter(F.col("row_id") % 3 != 0).select("row_id", batch.first_tokens(F.col("tokens"), 4).alias("tokens"), F.concat(F.lit("r"), "row_id").alias("text"))
    padded = batch.pad_inactive(s, active, "tokens", "text", 4, 9)
    return padded.select("row_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), "text")


@query(f"WITH {SEQUENCES} SELECT row_id, array_to_string(tokens[coalesce(nullif(list_position(list_transform(tokens, lambda x: x <> 1), true), 0), len(tokens) + 1):len(tokens)], ',') AS unpadded, array_to_string(tokens[1:list_sum(mask)], ',') AS kept FROM seq")
def effective_tokens(spark, d):  # noqa: ANN001, ANN201
    t = F.col("tokens")
    return base.sequences(spark, d).select("row_id", F.array_join(batch.without_left_pads(t, 1).cast("array<string>"), ",").alias("unpadded"), F.array_join(batch.effective(t, F.col("mask")).cast("array<string>"), ",").alias("kept"))


@query(f"WITH {SEQUENCES} SELECT row_id, array_to_string(list_transform(mask, lambda x, i: CASE WHEN i - 1 IN (1, 2) OR i - 1 = 4 THEN 0 ELSE x END), ',') AS loss_mask FROM seq")
def loss_mask_spans(spark, d):  # noqa: ANN001, ANN201
    spans = batch.span_loss_mask(F.col("mask"), F.array(F.lit(1), F.lit(4)), F.array(F.lit(3), F.lit(5)))
    return base.sequences(spark, d).select("row_id", F.array_join(spans.cast("array<string>"), ",").alias("loss_mask"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round(x[vec_id % 64 + 1] - ln(list_sum(list_transform(x, lambda y: exp(y)))), 6) AS logp, round(greatest(least(x[1], 0.05), -0.05), 6) AS clipped FROM e""")
def label_logp(spark, d):  # noqa: ANN001, ANN201
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(batch.log_probability(x, F.pmod("vec_id", F.lit(64)).cast("int")), 6).alias("logp"), F.round(batch.clipped(F.get(x, F.lit(0)), F.lit(-0.05), F.lit(0.05)), 6).alias("clipped"))


@query(f"WITH {BATCH} SELECT row_id, o_orderkey, o_totalprice FROM b")
def batch_zip(spark, d):  # noqa: ANN001, ANN201
    b = base.batch(spark, d)
    return batch.zip_rows(b.select("row_id", "o_orderkey"), b.select("row_id", "o_orderkey", "o_totalprice"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def first_per_source(spark, d):  # noqa: ANN001, ANN201
    return batch.first_per_group(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 3).select("o_orderpriority", "o_orderkey")


WEIGHTS = "cl AS (SELECT client_id, max(num_samples) AS n FROM par GROUP BY 1), w AS (SELECT client_id, n / CAST((SELECT sum(n) FROM cl) AS DOUBLE) AS w FROM cl)"


@query(f"WITH {PARAMS}, {WEIGHTS} SELECT param, idx, round(sum(w * val), 5) AS val FROM par JOIN w USING (client_id) GROUP BY 1, 2")
def fedavg(spark, d):  # noqa: ANN001, ANN201
    return _rounded(federated.weighted_average(base.params(spark, d)), "val", places=5)


SPARSE = """sp AS (SELECT client_id, param, idx, num_samples, CASE WHEN rank() OVER (PARTITION BY client_id, param ORDER BY abs(val) DESC) <= greatest(1, CAST(round_even(count(*) OVER (PARTITION BY client_id, param) * 0.1, 0) AS INTEGER)) THEN val ELSE 0.0 END AS val FROM par)"""


@query(f"WITH {PARAMS}, {SPARSE} SELECT client_id, param, idx, val FROM sp")
def topk_sparsify(spark, d):  # noqa: ANN001, ANN201
    return federated.sparsify(base.params(spark, d), 0.1).select("client_id", "param", "idx", "val")


@query(f"WITH {PARAMS}, {SPARSE}, {WEIGHTS} SELECT param, idx, round(CASE WHEN sum(CASE WHEN val <> 0 THEN w ELSE 0 END) = 0 THEN 0.0 ELSE sum(CASE WHEN val <> 0 THEN w * val ELSE 0 END) / greatest(sum(CASE WHEN val <> 0 THEN w ELSE 0 END), 1e-8) END, 5) AS val FROM sp JOIN w USING (client_id) GROUP BY 1, 2")
def masked_fedavg(spark, d):  # noqa: ANN001, ANN201
    return _rounded(federated.masked_average(federated.sparsify(base.params(spark, d), 0.1)), "val", places=5)


@query(f"WITH {PARAMS}, {SPARSE} SELECT client_id, count(*) FILTER (WHERE val <> 0) AS nonzero, count(*) AS total, round(count(*) FILTER (WHERE val <> 0) / CAST(count(*) AS DOUBLE), 6) AS density, count(*) * 4 AS dense_bytes, count(*) FILTER (WHERE val <> 0) * 8 AS sparse_bytes FROM sp GROUP BY 1")
def density_bytes(spark, d):  # noqa: ANN001, ANN201
    return _rounded(federated.density(federated.sparsify(base.params(spark, d), 0.1)), "density")


@query(f"WITH {PARAMS}, {WEIGHTS}, g AS (SELECT param, idx, sum(w * val) AS g FROM par JOIN w USING (client_id) GROUP BY 1, 2) SELECT client_id, round(0.005 * sum((val - g) * (val - g)), 5) AS proximal FROM par JOIN g USING (param, idx) GROUP BY 1")
def fedprox_term(spark, d):  # noqa: ANN001, ANN201
    p = base.params(spark, d)
    return _rounded(rl.proximal_term(p, federated.weighted_average(p), 0.01), "proximal", places=5)


@query("SELECT date_trunc('hour', ts) AS round_number, event_type AS direction, sum(length(props)) AS bytes, round(sum(length(props)) / 1048576.0, 9) AS megabytes FROM events GROUP BY 1, 2")
def bandwidth_by_round(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("round_number"), F.col("event_type").alias("direction"), F.length("props").alias("bytes"))
    return _rounded(federated.bandwidth(t), "megabytes", places=9)


@query("SELECT event_type AS metric, round(coalesce(avg(CASE WHEN NOT isnan(v) THEN v END), 'nan'::DOUBLE), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1")
def nan_skipping_mean(spark, d):  # noqa: ANN001, ANN201
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    return _rounded(federated.mean_of_metrics(table(spark, d, "events").select(F.col("event_type").alias("metric"), v.alias("value"))), "mean")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS client FROM o""")
def iid_split(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id")
    return federated.iid_split(docs, "doc_id", docs.count(), 7)


@query("""WITH l AS (SELECT DISTINCT o_orderpriority AS p FROM orders), c AS (SELECT p, CAST((row_number() OVER (ORDER BY md5('0|' || p), p) - 1) % 3 AS INTEGER) AS client FROM l) SELECT o_orderkey, client FROM orders JOIN c ON p = o_orderpriority""")
def topic_skew_split(spark, d):  # noqa: ANN001, ANN201
    return federated.topic_split(table(spark, d, "orders"), "o_orderpriority", 3).select("o_orderkey", "client")


@query()
def dirichlet_split(spark, d):  # noqa: ANN001, ANN201
    return federated.dirichlet_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 5)


@query("""SELECT r AS round_number, client_id FROM (SELECT r, client_id, row_number() OVER (PARTITION BY r ORDER BY md5('0|' || r || '|' || client_id), client_id) AS k FROM clients, (SELECT unnest(range(0, 4)) AS r)) WHERE k <= greatest(1, (SELECT count(*) FROM clients) // 4)""")
def client_sampling(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "clients")
    n, out = c.count(), None
    for r in range(4):
        one = federated.sample_clients(c, n, 0.25, r).select(F.lit(r).alias("round_number"), "client_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderpriority, row_number() OVER (ORDER BY md5('0|' || o_orderpriority), o_orderpriority) - 1 AS label FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def topic_labels(spark, d):  # noqa: ANN001, ANN201
    return federated.topic_labels(table(spark, d, "orders"), "o_orderpriority")


MIXED = "CASE WHEN event_type = (SELECT min(event_type) FROM events) AND event_id % 5 = 0 THEN 'e' || event_id WHEN event_id % 7 = 0 THEN 'NaN' WHEN event_id % 11 <> 0 THEN CAST(event_id % 1000 AS VARCHAR) END"


@query(f"""WITH v AS (SELECT event_type, event_id, {MIXED} AS v FROM events), k AS (SELECT *, try_cast(v AS DOUBLE) AS n FROM v WHERE v IS NOT NULL AND v <> 'NaN') SELECT event_type AS metric, CASE WHEN count(*) = count(n) THEN round(avg(n), 6) END AS mean, CASE WHEN count(*) > count(n) THEN arg_min(v, event_id) END AS first FROM k GROUP BY 1""")
def mean_or_first(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("least"))
    v = F.when((F.col("event_type") == F.col("least")) & (F.col("event_id") % 5 == 0), F.concat(F.lit("e"), "event_id")).when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 != 0, F.pmod("event_id", F.lit(1000)).cast("string"))
    rows = e.crossJoin(F.broadcast(least)).select(F.col("event_type").alias("metric"), v.alias("value"), F.col("event_id").alias("ord"))
    return _rounded(federated.mean_or_first(rows), "mean")


@query(f"WITH {PARAMS}, {WEIGHTS} SELECT param, idx, round(sum(w * val), 5) AS val FROM par JOIN w USING (client_id) GROUP BY 1, 2")
def train_round(spark, d):  # noqa: ANN001, ANN201
    return _rounded(federated.train_round(base.params(spark, d), "dense"), "val", places=5)


@query("""SELECT result_id, CAST((6 * list_sum(list_transform(string_split(substr(md5(substr(question, 1, 50)), 1, 31), ''), lambda c: instr('0123456789abcdef', c) - 1)) + instr('0123456789abcdef', substr(md5(substr(question, 1, 50)), 32, 1)) - 1) % 10 AS INTEGER) AS label FROM results_step""")
def pseudo_label(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", federated.pseudo_label(F.col("question")).alias("label"))


#: Sequences of one batch to balance.
BALANCED = 512


def _lengths(spark, d):  # noqa: ANN001, ANN202
    return records.numbered(table(spark, d, "customer").select("c_custkey", (F.floor(F.abs("c_acctbal")) + 1).cast("long").alias("length")), "c_custkey", name="row_id")


@query()
def seqlen_balance(spark, d):  # noqa: ANN001, ANN201
    return balance.balance_each(_lengths(spark, d), BALANCED, 8)


@query()
def seqlen_balance_report(spark, d):  # noqa: ANN001, ANN201
    rows = _lengths(spark, d).withColumn("batch", F.floor(F.col("row_id") / BALANCED).cast("long"))
    before = rows.withColumn("part", F.pmod("row_id", F.lit(8)))
    return balance.report(before, balance.balance_each(rows, BALANCED, 8), "batch")


@query()
def micro_batches(spark, d):  # noqa: ANN001, ANN201
    return balance.balance_each(_lengths(spark, d), BALANCED, most_tokens=200_000)


@query("SELECT sum(x) AS tokens, round((6.0 * (28.0 * (1024 * 3072 * 3 + 1024 * 8 * 128 * 4) + 151936.0 * 1024 * 2) * sum(x) + 12.0 * 28 * 8 * 128 * sum(x * x)) / 1e9, 3) AS gigaflops FROM (SELECT length(question) AS x FROM results_step)")
def flops_estimate(spark, d):  # noqa: ANN001, ANN201
    out = balance.flops(table(spark, d, "results_step").select(F.length("question").alias("length")), 28, 1024, 3072, 8, 151936)
    return out.select("tokens", F.round(F.col("flops") / 1e9, 3).alias("gigaflops"))


#: Expressions by row, with x and y the row's number by 17 and by 5, and their values in SQL.
EXPRESSIONS = (("x + (y * 2 / 2)", "x + y"), ("(x - y) ** 2", "(x - y) * (x - y)"), ("-x // 3", "floor(-x / 3.0)"), ("x % (y + 1)", "x % (y + 1)"), ("x / (y - 2)", "CASE WHEN y <> 2 THEN x / CAST(y - 2 AS DOUBLE) END"), ("open('x')", "NULL"), ("2 +", "NULL"), ("1.5e1 * x", "15 * x"), ("x ** 99999", "NULL"))


@query("SELECT result_id, round(CAST(CASE result_id % " + str(len(EXPRESSIONS)) + " " + " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in enumerate(EXPRESSIONS)) + " END AS DOUBLE), 6) AS value FROM (SELECT result_id, result_id % 17 + 2 AS x, result_id % 5 AS y FROM results_step)")
def calculator(spark, d):  # noqa: ANN001, ANN201
    kinds = F.array(*(F.lit(e) for e, _ in EXPRESSIONS))
    written = F.get(kinds, F.pmod("result_id", F.lit(len(EXPRESSIONS))).cast("int"))
    for name, n, more in (("x", 17, 2), ("y", 5, 0)):
        written = F.regexp_replace(written, F.lit(rf"\b{name}\b(?!')"), (F.pmod("result_id", F.lit(n)) + more).cast("string"))
    return _rounded(tools.calculate(table(spark, d, "results_step").select("result_id", written.alias("e")), "e").select("result_id", "value"), "value")


@query("""SELECT result_id AS call_id, CASE WHEN result_id % 4 = 0 THEN 'no_call' WHEN result_id % 4 = 1 THEN 'unknown_tool' WHEN result_id % 4 = 2 THEN 'invalid' ELSE 'ok' END AS outcome, CASE WHEN result_id % 4 = 3 THEN CAST(length(question) AS VARCHAR) END AS result FROM results_step WHERE question IS NOT NULL""")
def tool_outcomes(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step").filter("question is not null")
    kind = F.pmod("result_id", F.lit(4))
    calls = r.select(F.col("result_id").alias("call_id"), F.when(kind == 0, F.lit(None)).when(kind == 1, "nothing").otherwise("size").alias("tool"), F.when(kind == 3, F.to_json(F.struct(F.col("question").alias("query")))).otherwise("{}").alias("arguments"))
    size = tools.Tool("size", lambda a: F.length(F.get_json_object(a, "$.query")), required=("query",))
    return tools.run_calls(calls, [size]).select("call_id", "outcome", "result")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark, d):  # noqa: ANN001, ANN201
    return _rounded(rounds.windowed_counts(table(spark, d, "events")), "value", places=4)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events_stream(spark, d):  # noqa: ANN001, ANN201
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return _rounded(rounds.finished(rounds.windowed_counts(stream)), "value", places=4)


ROUND = "(SELECT count(DISTINCT {c}) FROM {t} WHERE {c} IS NOT NULL AND round_number // 10 <= r)"


@query("WITH r AS (SELECT unnest(range(0, 4)) AS r), c AS (SELECT r, " + ROUND.format(c=base.CANON % "entity_name", t="entities") + " AS new_num_entities, " + ROUND.format(c="hyperedge_name", t="hyperedges") + """ AS new_num_hyperedges,
 (SELECT count(*) FROM (SELECT DISTINCT src_id, tgt_id FROM edges WHERE src_id IS NOT NULL AND tgt_id IS NOT NULL AND round_number // 10 <= r)) AS new_num_edges FROM r)
 SELECT r AS round, new_num_entities, new_num_hyperedges, new_num_edges, CASE WHEN r = 0 THEN 'none' ELSE 'sent' END AS downlink FROM c""")
def graph_rounds(spark, d):  # noqa: ANN001, ANN201
    tables = [table(spark, d, t) for t in ("entities", "hyperedges", "edges")]
    store = rounds.GraphStore(spark, rounds.new_folder(spark))
    history = rounds.run_rounds(store, 4, lambda r: tuple(t.filter(F.floor(F.col("round_number") / 10) == r) for t in tables))
    return spark.createDataFrame([(h["round"], h["new_num_entities"], h["new_num_hyperedges"], h["new_num_edges"], h["downlink"]) for h in history], "round int, new_num_entities long, new_num_hyperedges long, new_num_edges long, downlink string")


@query("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY 1")
def metric_means(spark, d):  # noqa: ANN001, ANN201
    return _rounded(evaluate.means_by(table(spark, d, "events"), ["event_type"], ["value"]), "value")


@query(f"WITH {BATCH}, l AS (SELECT row_id, o_orderkey % 13 AS n FROM b) SELECT row_id, CAST(coalesce(sum(n) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cu_seqlen FROM l")
def sequence_offsets(spark, d):  # noqa: ANN001, ANN201
    lengths = base.batch(spark, d).select("row_id", F.pmod("o_orderkey", F.lit(13)).alias("n"))
    return batch.offsets(lengths, "n").select("row_id", "cu_seqlen")


@query("SELECT result_id FROM results_step WHERE len(string_split(question, ' ')) + turns <= 12")
def prompt_length_with_tools(spark, d):  # noqa: ANN001, ANN201
    return batch.within_length(table(spark, d, "results_step"), F.split("question", " "), 12, F.col("turns")).select("result_id")


@query("SELECT result_id FROM results_step WHERE len(string_split(question, ' ')) <= 9")
def prompt_length_filter(spark, d):  # noqa: ANN001, ANN201
    return batch.within_length(table(spark, d, "results_step"), F.split("question", " "), 9).select("result_id")


@query("SELECT l_orderkey AS row_id, array_to_string(list(l_quantity::INTEGER ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER::VARCHAR), ',') AS quantities FROM lineitem GROUP BY 1")
def samples_by_row(spark, d):  # noqa: ANN001, ANN201
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    return batch.transpose(lines, "k", "q").select("row_id", F.array_join("values", ",").alias("quantities"))


@query("SELECT ord, entity_name, description FROM entities WHERE weight >= 30 AND NOT isnan(weight)")
def payload_round_trip(spark, d):  # noqa: ANN001, ANN201
    packed = records.pack_payloads(records.pack_entities(table(spark, d, "entities")).select("ord", "entity_name", "description"), ["entity_name", "description"])
    return records.unpack_payloads(packed.select("ord", "payload"), "entity_name string, description string")


#: Responses, truths and what they are worth: by ``graded``, and right and formed by ``graded_responses``. The number of the
#: row stands where ``#`` is.
SHAPES = (
    (r"so \boxed{#/7}", r"\frac{#}{7}", 1, 1, 1), ("#.0", "#", 1, 1, 1), ("#1", "#", 0, 0, 0), (r"the answer is \boxed{\dfrac{#}{3}}", "#/3", 1, 1, 1), ("#,000", "#000", 1, 1, 1),
    ("#%", "#", 1, 1, 1), ("# cm", "#", 1, 1, 1), ("(#, 2)", "(#,2)", 1, 1, 1), ("[#, 2)", "(#, 2)", 0, 0, 0), (r"x=#\pi", r"#\pi", 1, 1, 1), ("Interval(#, 2)", "[#, 2]", 0, 1, 0), ("# 1/2", "#.5", 1, 1, 1),
    (r"Step 2: so \boxed{#1}", "#", 0, 0, 1), ("# is the answer", "#", 0, 1, 1), ("no number", "#", 0, 0, 0), (r"\sqrt3", r"\sqrt{3}", 1, 1, 1), ("#_7", "#", 0, 1, 0), (r"#\pi", "#*3.14", 0, 1, 0), ("2*#", "(# + #)", 1, 1, 1), (r"\text{#}", "#", 1, 1, 1),
)


def _shaped(spark, d):  # noqa: ANN001, ANN202
    shapes = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in enumerate(SHAPES)], "k int, said string, truth string")
    n = F.col("n").cast("string")
    rows = table(spark, d, "results_step").select("result_id", F.pmod("result_id", F.lit(len(SHAPES))).cast("int").alias("k"), (F.floor(F.col("result_id") / len(SHAPES)) * 2 + 1001).alias("n"))
    return rows.join(F.broadcast(shapes), "k").select("result_id", F.replace("said", F.lit("#"), n).alias("said"), F.replace("truth", F.lit("#"), n).alias("truth"))  # as many rows as shapes


@query(f"SELECT result_id, CAST(list_extract({[s[2] for s in SHAPES]}, result_id % {len(SHAPES)} + 1) AS DOUBLE) AS score FROM results_step")
def math_grading(spark, d):  # noqa: ANN001, ANN201
    return grading.graded(_shaped(spark, d), "said", "truth").select("result_id", "score")


@query(f"SELECT result_id, list_extract({[s[3] for s in SHAPES]}, result_id % {len(SHAPES)} + 1) = 1 AS right, list_extract({[s[4] for s in SHAPES]}, result_id % {len(SHAPES)} + 1) = 1 AS formed FROM results_step".replace(" right,", ' "right",'))
def math_responses(spark, d):  # noqa: ANN001, ANN201
    return grading.graded_responses(_shaped(spark, d), "said", "truth").select("result_id", "verdict.right", "verdict.formed")


@query(f"""WITH {TOKENS} SELECT row_id AS trajectory_id, count(*) AS steps, count(*) FILTER (WHERE mask = 1) AS effective, round(sum(reward), 4) AS reward, string_agg('Tool call ' || t || ': search -> r' || t, chr(10) ORDER BY t) AS history FROM tok GROUP BY 1""")
def trajectory_summary(spark, d):  # noqa: ANN001, ANN201
    t = base.tokens(spark, d).select(F.col("row_id").alias("trajectory_id"), F.col("t").alias("step"), F.lit("search").alias("tool"), F.when(F.col("mask") == 1, "ok").otherwise("failed").alias("outcome"), F.concat(F.lit("r"), F.col("t").cast("string")).alias("result"), "reward")
    return _rounded(tools.trajectories(t).select("trajectory_id", "steps", "effective", "reward", "history"), "reward", places=4)


@query(f"WITH {TOKENS}, f AS (SELECT row_id, t, min(mask) OVER (PARTITION BY row_id ORDER BY t) AS alive FROM tok) SELECT row_id AS trajectory_id, least(sum(alive), 3) AS turns FROM f GROUP BY 1")
def turn_counts(spark, d):  # noqa: ANN001, ANN201
    t = base.tokens(spark, d).select(F.col("row_id").alias("trajectory_id"), F.col("t").alias("turn"), (F.col("mask") == 1).alias("has_call"))
    return tools.turns_with_calls(t, 3)
