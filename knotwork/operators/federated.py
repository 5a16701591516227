"""Federated averaging, sparsification, and splitting data over clients. Parameters are a long table ``client_id, param,
idx, val, num_samples``."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.records import numbered
from knotwork.session import cut, few


def _weights(params: DataFrame) -> DataFrame:
    """``client_id, w``: a client's samples by those of all; alike for all if there are none."""
    clients = params.groupBy("client_id").agg(F.max("num_samples").alias("n"))
    total = clients.agg(F.sum("n").alias("total"), F.count("*").alias("clients"))
    return clients.crossJoin(F.broadcast(total)).select("client_id", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(1 / F.col("clients")).alias("w"))


def weighted_average(params: DataFrame) -> DataFrame:
    """``param, idx, val``: each value times its client's share of all samples, summed. A client that lacks a parameter
    adds nothing to it; the shares stay."""
    w = _weights(params)
    rows = params.join(F.broadcast(w) if few(w, 64) else w, "client_id")
    return rows.groupBy("param", "idx").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def masked_average(params: DataFrame) -> DataFrame:
    """As ``weighted_average`` over values that aren't 0, by the weights of these; 0 where all are."""
    w = _weights(params)
    rows = params.join(F.broadcast(w) if few(w, 64) else w, "client_id")
    weight = F.sum(F.when(F.col("val") != 0, F.col("w")).otherwise(0.0))
    return rows.groupBy("param", "idx").agg(F.when(weight == 0, 0.0).otherwise(F.sum(F.when(F.col("val") != 0, F.col("w") * F.col("val")).otherwise(0.0)) / F.greatest(weight, F.lit(1e-8))).alias("val"))


def average(params: DataFrame, strategy: str = "weighted") -> DataFrame:
    if strategy not in ("weighted", "masked"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return weighted_average(params) if strategy == "weighted" else masked_average(params)


def sparsify(params: DataFrame, ratio: float) -> DataFrame:
    """Values of the largest magnitude of each client's parameter: k = max(1, round(n ratio)), halves to even, and all
    that equal the k-th; the others become 0. A ratio of 1 or more changes nothing.

    All values are put in order range by range, so that a tensor of any size is spread over many tasks; the k-th place of
    each gives its threshold, and the frame is filtered by that."""
    if ratio >= 1:
        return params
    by = ["client_id", "param"]
    placed = cut(numbered(params.select(*by, (-F.abs("val")).alias("_m"), "idx"), *by, "_m", "idx", name="_pos"))
    groups = placed.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio, 0).cast("int"))
    wanted = groups.select(*by, (F.col("_first") + k - 1).alias("_pos"))
    least = cut(placed.join(wanted, [*by, "_pos"]).select(*by, (-F.col("_m")).alias("_least")))
    rows = params.join(F.broadcast(least) if few(least, 128) else least, by, "left")
    return rows.withColumn("val", F.when(F.abs("val") >= F.col("_least"), F.col("val")).otherwise(0.0)).select(*params.columns)


def density(params: DataFrame) -> DataFrame:
    """``client_id, nonzero, total, density, dense_bytes, sparse_bytes``: 4 bytes a value, 8 a value and its place."""
    rows = params.groupBy("client_id").agg(F.count_if(F.col("val") != 0).alias("nonzero"), F.count("*").alias("total"))
    return rows.select("client_id", "nonzero", "total", (F.col("nonzero") / F.col("total")).alias("density"), (F.col("total") * 4).alias("dense_bytes"), (F.col("nonzero") * 8).alias("sparse_bytes"))


def bandwidth(transfers: DataFrame) -> DataFrame:
    """``round_number, direction, bytes, megabytes``."""
    total = transfers.groupBy("round_number", "direction").agg(F.sum("bytes").alias("bytes"))
    return total.withColumn("megabytes", F.col("bytes") / (1024 * 1024))


def sample_clients(clients: DataFrame, n: int, fraction: float, round_number: int, seed: int = 0) -> DataFrame:
    """max(1, int(n fraction)) clients by a seeded order of MD5 digests, another for each round; sorted."""
    k = max(1, int(n * fraction))
    order = F.md5(F.concat(F.lit(f"{seed}|{round_number}|"), F.col("client_id")))
    return clients.orderBy(order, "client_id").limit(k).orderBy("client_id")


def iid_split(df: DataFrame, key: str, n: int, clients: int, seed: str = "0") -> DataFrame:
    """``client`` of each row by an order of MD5 digests: sizes differ by one at most, the first clients have more."""
    base, more = divmod(n, clients)
    ordered = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")))), "_h", key)
    edge = more * (base + 1)
    inner = F.floor(F.col("pos") / (base + 1)) if not base else F.when(F.col("pos") < edge, F.floor(F.col("pos") / (base + 1))).otherwise(more + F.floor((F.col("pos") - edge) / base))
    return ordered.withColumn("client", inner.cast("int")).drop("_h", "pos")


def topic_labels(df: DataFrame, topic: str, seed: str = "0") -> DataFrame:
    """The distinct topics and ``label``, whole numbers from 0 in an order of MD5 digests."""
    topics = df.select(topic).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(topic).cast("string"), F.lit("")))))
    return numbered(topics, "_h", topic, name="label").drop("_h")


def topic_split(df: DataFrame, label: str, clients: int, seed: str = "0") -> DataFrame:
    """``client`` of each row: labels in an order of MD5 digests are dealt to the clients in turn. NULL is a label."""
    dealt = topic_labels(df, label, seed).select(F.col(label).alias("_topic"), F.pmod("label", F.lit(clients)).cast("int").alias("client"))
    return df.join(dealt, df[label].eqNullSafe(F.col("_topic"))).drop("_topic")


def dirichlet_split(df: DataFrame, key: str, label: str, clients: int, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """``client`` of each row: for each label the clients' shares are drawn from a Dirichlet distribution, floored, and what
    remains goes to one drawn client. Labels are few; their counts alone reach the driver."""
    found = df.groupBy(label).count().limit(100_001).collect()
    if len(found) > 100_000:
        raise ValueError("more than 100000 labels")
    draw, bounds, start = random.Random(seed), [], 0
    for value, n in sorted(((r[label], r["count"]) for r in found), key=lambda x: (x[0] is not None, x[0])):
        parts = [draw.gammavariate(alpha, 1.0) for _ in range(clients)]
        total = sum(parts) or 1.0
        sizes = [int(n * p / total) for p in parts]
        sizes[draw.randrange(clients)] += n - sum(sizes)
        for c, size in enumerate(sizes):
            bounds.append((value, c, start, start + size))
            start += size
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame(bounds, f"_label {kind}, client int, _low long, _high long")
    # Rows are numbered over all labels, so that no task has to hold a label of many rows.
    placed = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))), label, "_h", key, name="_pos")
    here = placed[label].eqNullSafe(table["_label"]) & (F.col("_pos") >= F.col("_low")) & (F.col("_pos") < F.col("_high"))
    return placed.join(F.broadcast(table), here).select(*(placed[c] for c in df.columns), "client")


def pseudo_label(text: Column) -> Column:
    """MD5 of the first 50 characters as a number, modulo 10: as every power of 16 leaves 6, that is six times the sum of
    all digits but the last, plus the last."""
    digits = F.transform(F.split(F.md5(F.substring(text, 1, 50)), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    digits = F.filter(digits, lambda x: x >= 0)
    return F.pmod(6 * F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda s, x: s + x) + F.element_at(digits, 32), F.lit(10))


def mean_of_metrics(rows: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """``metric, mean``: mean of each metric over those who report it, NaN skipped; NaN if nobody has a number."""
    number = F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value))
    return rows.groupBy(key).agg(F.coalesce(F.avg(number), F.lit(float("nan"))).alias("mean"))


def mean_or_first(rows: DataFrame, key: str = "metric", value: str = "value", order: str = "ord") -> DataFrame:
    """``metric, mean, first``: of values as texts, the mean of a metric whose values are all numbers, NaN left out; of a
    metric that has another value the first by ``order``, NaN left out too. What doesn't hold is NULL."""
    number = F.expr(f"try_cast(`{value}` as double)")
    kept = rows.filter(F.col(value).isNotNull() & ~F.coalesce(F.isnan(number), F.lit(False))).withColumn("_n", number)
    found = kept.groupBy(key).agg(F.avg("_n").alias("mean"), F.count_if(F.col("_n").isNull()).alias("_other"), F.min_by(value, order).alias("first"))
    return found.select(key, F.when(F.col("_other") == 0, F.col("mean")).alias("mean"), F.when(F.col("_other") > 0, F.col("first")).alias("first"))


#: Ways of training together by name: what a client makes of its parameters before it sends them, and how the server
#: puts them together.
ALGORITHMS: dict[str, tuple] = {}


def register_algorithm(name: str, client, server) -> None:  # noqa: ANN001
    """``client``: parameters and options to parameters; ``server``: parameters to ``param, idx, val``. A name that is
    there is replaced."""
    ALGORITHMS[name] = (client, server)


def algorithm(name: str) -> tuple:
    """The pair under a name; an unknown one raises ``ValueError`` with those there are."""
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; there are {sorted(ALGORITHMS)}")
    return ALGORITHMS[name]


def train_round(params: DataFrame, name: str, **options) -> DataFrame:  # noqa: ANN003
    """The parameters after a round of the named algorithm."""
    client, server = algorithm(name)
    return server(client(params, **options))


register_algorithm("dense", lambda params: params, weighted_average)
register_algorithm("sparse", lambda params, ratio=0.1: sparsify(params, ratio), masked_average)
