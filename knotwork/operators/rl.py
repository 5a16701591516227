"""Advantages, returns, losses and batch statistics of reinforcement learning. Token frames have ``row_id, t`` and a row for
each token; array functions work within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut

EPS = 1e-6


def _group_stats(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows with their group's ``_mean``, ``_std`` and ``_n``. The statistics are aggregated map-side and joined back, so a
    group that holds a third of all rows isn't gathered; a skewed join partition is split at run time."""
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_std"), F.count("*").alias("_n"))
    return df.join(stats, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def group_advantage(df: DataFrame, group: str = "uid", score: str = "score", single: str = "score") -> DataFrame:
    """``advantage``: (score - mean) / (std + 1e-6) within the group, std unbiased. In a group of one the mean is 0 and
    the std 1 (``single='score'``), or the advantage is 0 (``single='zero'``). A NULL group is a group."""
    alone = F.col(score) / (1 + EPS) if single == "score" else F.lit(0.0)
    out = F.when(F.col("_n") == 1, alone).otherwise((F.col(score) - F.col("_mean")) / (F.col("_std") + EPS))
    return _group_stats(df, group, score).withColumn("advantage", out).drop("_mean", "_std", "_n")


def leave_one_out_advantage(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """``advantage``: n / (n - 1) (score - mean); a group of one keeps its score. A NULL group is a group."""
    n = F.col("_n")
    out = F.when(n == 1, F.col(score)).otherwise(n / (n - 1) * (F.col(score) - F.col("_mean")))
    return _group_stats(df, group, score).withColumn("advantage", out).drop("_mean", "_std", "_n")


def _after(order: str = "t") -> Window:
    return Window.partitionBy("row_id").orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def baseline_returns(tokens: DataFrame) -> DataFrame:
    """``ret`` and ``advantage`` with a baseline: the sum of rewards from here on, less the baseline, on kept tokens."""
    ret = F.sum(F.col("reward") * F.col("mask")).over(_after())
    return tokens.withColumn("ret", ret).withColumn("advantage", F.col("ret") - F.col("baseline") * F.col("mask"))


def states(values: Column, zero: Column, step, piece: int = 64) -> Column:  # noqa: ANN001
    """Array of the states ``step(state, x)`` over an array, from the state ``zero`` on. The states are made in pieces, so
    that appending to arrays costs the power 1.5 of the length, not its square."""
    def grow(xs: Column, first: Column) -> Column:
        grown = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(xs))

    n = F.ceil(F.size(values) / F.lit(piece)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(values, k * piece + 1, piece))
    grown = F.aggregate(pieces, F.array(F.array(zero)), lambda acc, p: F.concat(acc, F.array(grow(p, F.element_at(F.element_at(acc, -1), -1)))))
    return F.when(F.size(values) > 0, F.flatten(F.slice(grown, 2, F.size(pieces))))


def _rows_back(tokens: DataFrame, *columns: str) -> DataFrame:
    """``row_id, xs``: each row's tokens in one array, which its length bounds, from the last on."""
    return tokens.groupBy("row_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), *columns)))).alias("xs"))


def discounted(tokens: DataFrame, gamma: float) -> DataFrame:
    """``row_id, t, mask, ret``: returns discounted from the end on; the running value is set to 0 after a token that the
    mask leaves out."""
    zero = F.struct(F.lit(None).cast("int").alias("t"), F.lit(0.0).alias("ret"), F.lit(0).cast("int").alias("mask"))
    made = states(F.col("xs"), zero, lambda s, x: F.struct(x["t"].alias("t"), (x["reward"].cast("double") + gamma * s["ret"] * s["mask"]).alias("ret"), x["mask"].cast("int").alias("mask")))
    return _rows_back(tokens, "reward", "mask").select("row_id", F.explode(made).alias("o")).select("row_id", "o.t", "o.mask", "o.ret")


def reinforce_plus_plus(tokens: DataFrame, gamma: float) -> DataFrame:
    """``row_id, t, advantage, ret``: ``discounted`` returns; the advantages are the returns whitened over the kept tokens
    of the batch, 0 on the others."""
    out = whiten(discounted(tokens, gamma), "ret")
    return out.select("row_id", "t", (F.col("whitened") * F.col("mask")).alias("advantage"), "ret")


def estimated(tokens: DataFrame, gamma: float, lam: float) -> DataFrame:
    """``row_id, t, mask, estimate, ret`` by generalised advantage estimation, before whitening. The return is estimate
    plus value; the mask has no part in the recurrence."""
    zero = F.struct(F.lit(None).cast("int").alias("t"), F.lit(0).cast("int").alias("mask"), F.lit(0.0).alias("estimate"), F.lit(0.0).alias("value"))
    made = states(
        F.col("xs"), zero,
        lambda s, x: F.struct(x["t"].alias("t"), x["mask"].cast("int").alias("mask"), (x["reward"] + gamma * s["value"] - x["value"] + gamma * lam * s["estimate"]).alias("estimate"), x["value"].cast("double").alias("value")),
    )
    return _rows_back(tokens, "reward", "value", "mask").select("row_id", F.explode(made).alias("o")).select("row_id", "o.t", "o.mask", "o.estimate", (F.col("o.estimate") + F.col("o.value")).alias("ret"))


def gae(tokens: DataFrame, gamma: float, lam: float) -> DataFrame:
    """``row_id, t, advantage, ret`` by generalised advantage estimation: the advantages are whitened over the kept tokens
    of the batch (and on all tokens), the returns come of the estimates before that. A batch with one kept token or none
    has NULL advantages."""
    return whiten(estimated(tokens, gamma, lam), "estimate").select("row_id", "t", F.col("whitened").alias("advantage"), "ret")


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / F.sum(mask)


def masked_stats(df: DataFrame, x: str, mask: str = "mask") -> DataFrame:
    """``mean, var, n`` over the whole batch's kept tokens; the variance is unbiased, NULL for one token or none."""
    kept = F.when(F.col(mask) != 0, F.col(x))
    return df.agg(F.avg(kept).alias("mean"), F.var_samp(kept).alias("var"), F.count(kept).alias("n"))


def whiten(df: DataFrame, x: str, mask: str = "mask", shift: bool = True) -> DataFrame:
    """``whitened``: (x - mean) / sqrt(var + 1e-8) over the whole batch, the mean put back if it isn't shifted. One
    aggregation, of one row, is broadcast."""
    stats = masked_stats(df, x, mask)
    out = (F.col(x) - F.col("mean")) / F.sqrt(F.col("var") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn("whitened", out if shift else out + F.col("mean")).drop("mean", "var", "n")


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.greatest(F.least(F.exp(-d) + d - 1, F.lit(10.0)), F.lit(-10.0))
    raise NotImplementedError(kind)


def penalised_rewards(tokens: DataFrame, beta: float, kind: str = "kl") -> DataFrame:
    """``reward``: the score less beta times the penalty on kept tokens."""
    return tokens.withColumn("reward", F.col("score") - beta * kl_penalty(F.col("logp"), F.col("ref_logp"), kind) * F.col("mask"))


def mean_kl(tokens: DataFrame, kind: str = "kl") -> DataFrame:
    """``mean_kl``: the mean over sequences of each one's masked mean."""
    each = tokens.groupBy("row_id").agg(masked_mean(kl_penalty(F.col("logp"), F.col("ref_logp"), kind), F.col("mask")).alias("k"))
    return each.agg(F.avg("k").alias("mean_kl"))


def policy_loss(tokens: DataFrame, clip: float = 0.2) -> DataFrame:
    """``pg_loss, clip_fraction, approx_kl`` of the clipped policy objective over kept tokens."""
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    plain = -F.col("advantage") * ratio
    clipped = -F.col("advantage") * F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip))
    m = F.col("mask")
    return tokens.agg(
        masked_mean(F.greatest(plain, clipped), m).alias("pg_loss"),
        masked_mean(F.when(clipped > plain, 1.0).otherwise(0.0), m).alias("clip_fraction"),
        masked_mean(F.col("old_logp") - F.col("logp"), m).alias("approx_kl"),
    )


def value_loss(tokens: DataFrame, clip: float = 0.5) -> DataFrame:
    """``vf_loss, clip_fraction`` of the clipped value objective: half the masked mean of the larger squared error."""
    held = F.greatest(F.least(F.col("value_new"), F.col("value") + clip), F.col("value") - clip)
    plain, other = (F.col("value_new") - F.col("ret")) ** 2, (held - F.col("ret")) ** 2
    return tokens.agg((0.5 * masked_mean(F.greatest(plain, other), F.col("mask"))).alias("vf_loss"), masked_mean(F.when(other > plain, 1.0).otherwise(0.0), F.col("mask")).alias("clip_fraction"))


def entropy(logits: Column) -> Column:
    """Entropy of the distribution of an array of logits: logsumexp less the mean logit."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return top + F.log(z) - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * x) / z


def proximal_term(params: DataFrame, global_params: DataFrame, mu: float) -> DataFrame:
    """``client_id, proximal``: mu / 2 times the squared distance of a client's values from the global ones."""
    both = params.join(global_params.select("param", "idx", F.col("val").alias("g")), ["param", "idx"])
    return both.groupBy("client_id").agg((mu / 2 * F.sum((F.col("val") - F.col("g")) ** 2)).alias("proximal"))


def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """``step, coef, log_coef``: the coefficient after each step and its natural logarithm, multiplied by 1 + clip(kl / target - 1, -0.2, 0.2) n / horizon.
    ``steps``: ``step, kl, n``. As all factors are above 0 for n below five horizons, a running sum of logarithms gives
    the product: within range partitions, each with the sums of those before, so that no task sees all steps."""
    error = F.greatest(F.least(F.col("kl") / target - 1, F.lit(0.2)), F.lit(-0.2))
    factor = F.log(1 + error * F.col("n") / horizon)
    # Cut, as range partitions are sampled anew by every plan that has them.
    placed = cut(steps.select("step", factor.alias("_f")).repartitionByRange("step").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum("_f").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    within = F.sum("_f").over(Window.partitionBy("_part").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_part").select("step", (start * F.exp(F.col("_before") + F.col("_within"))).alias("coef"), (F.log(F.lit(start)) + F.col("_before") + F.col("_within")).alias("log_coef"))


def explained_variance(tokens: DataFrame) -> DataFrame:
    """``explained_variance``: 1 - var(ret - value) / (var(ret) + 1e-5) over kept tokens, unbiased."""
    kept = tokens.filter(F.col("mask") != 0)
    return kept.agg((1 - F.var_samp(F.col("ret") - F.col("value")) / (F.var_samp("ret") + 1e-5)).alias("explained_variance"))


def data_metrics(tokens: DataFrame, rows: DataFrame, most_response: int, most_prompt: int, use_critic: bool = True) -> DataFrame:
    """``metric, value`` of a batch: mean, maximum and minimum of each series, one row each.

    ``tokens``: ``row_id, t, mask, score, reward, advantage, ret`` and with a critic ``value``; ``rows``: ``row_id,
    format_score, answer_f1_score, answer_em_score, turns, prompt_length``. Scores and rewards are sums of a row's tokens;
    advantages, returns and values are of kept tokens; lengths also have the share of rows of full length, and a critic the
    explained variance. Without a row a metric is NULL.
    """
    by_row = tokens.groupBy("row_id").agg(F.sum("score").alias("score"), F.sum("reward").alias("rewards"), F.sum("mask").alias("response_length"))

    def three(prefix: str, x: Column) -> list[Column]:
        return [f(x).cast("double").alias(f"{prefix}/{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]

    kept = {"advantages": "advantage", "returns": "ret"} | ({"values": "value"} if use_critic else {})
    of_tokens = [c for name, column in kept.items() for c in three(f"critic/{name}", F.when(F.col("mask") != 0, F.col(column)))]
    if use_critic:
        left = F.when(F.col("mask") != 0, F.col("ret") - F.col("value"))
        of_tokens.append((1 - F.var_samp(left) / (F.var_samp(F.when(F.col("mask") != 0, F.col("ret"))) + 1e-5)).alias("critic/vf_explained_var"))
    full = lambda c, most: F.avg((F.col(c) == most).cast("double")).alias(f"{c}/clip_ratio")
    sums = by_row.agg(*three("critic/score", F.col("score")), *three("critic/rewards", F.col("rewards")), *three("response_length", F.col("response_length")), full("response_length", most_response))
    scores = [c for name in ("format_score", "answer_f1_score", "answer_em_score") for c in three(f"critic/{name}", F.col(name))]
    given = rows.agg(*scores, *three("turns", F.col("turns")), *three("prompt_length", F.col("prompt_length")), full("prompt_length", most_prompt))
    whole = sums.crossJoin(tokens.agg(*of_tokens)).crossJoin(given)  # one row each
    return whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in whole.columns))).alias("x")).select("x.*")


def timing_metrics(timings: DataFrame, token_counts: DataFrame) -> DataFrame:
    """``section, seconds, ms_per_token``. ``timings``: ``section, seconds``; ``token_counts``: ``section, tokens``."""
    total = timings.groupBy("section").agg(F.sum("seconds").alias("seconds"))
    return total.join(token_counts, "section", "left").select("section", "seconds", (F.col("seconds") * 1000 / F.col("tokens")).alias("ms_per_token"))


def loss_mask_coverage(df: DataFrame) -> DataFrame:
    """``kept, coverage``: tokens that the loss keeps, and their share of the response."""
    add = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda s, x: s + x))
    return df.agg(add("loss_mask").alias("kept"), (add("loss_mask") / add("response_mask")).alias("coverage"))


def learning_rates(steps: DataFrame, warmup: int, total: int, kind: str = "cosine", floor: float = 0.0, cycles: float = 0.5) -> DataFrame:
    """``step, factor`` of a schedule with linear warm-up: 'cosine' falling to ``floor``, or 'constant'."""
    s = F.col("step").cast("double")
    up = s / max(1, warmup)
    if kind == "constant":
        return steps.select("step", F.when(s < warmup, up).otherwise(1.0).alias("factor"))
    progress = (s - warmup) / max(1, total - warmup)
    wave = 0.5 * (1 + F.cos(F.lit(2 * 3.141592653589793 * cycles) * progress))
    return steps.select("step", F.when(s < warmup, up).otherwise(F.greatest(F.lit(floor), floor + (1 - floor) * wave)).alias("factor"))


#: Ways to an advantage by name: functions of a frame and their options.
ADVANTAGES = {
    "grpo": group_advantage,
    "rloo": leave_one_out_advantage,
    "remax": baseline_returns,
    "reinforce_plus_plus": reinforce_plus_plus,
    "gae": gae,
}


def advantage(df: DataFrame, kind: str, **options) -> DataFrame:  # noqa: ANN003
    """Rows with an ``advantage`` of the named kind; those by token also have ``ret``. An unknown name raises
    ``ValueError``."""
    if kind not in ADVANTAGES:
        raise ValueError(f"unknown advantage {kind!r}")
    return ADVANTAGES[kind](df, **options)
