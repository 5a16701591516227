"""Balancing sequences by length. The algorithms are sequential; they get ids and lengths of one batch, whose size is
bounded, on the driver or, of many batches, each in one task."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import ship

#: Sequences of one batch.
MOST_SEQUENCES = 1_000_000


class _Solution:
    """Parts of some sequences, ``[sum, number, members]`` each, the largest first. Solutions go by the difference between
    their largest and smallest sum, the widest first, and those alike by their largest part, the largest first."""

    def __init__(self, parts: list[list]) -> None:
        self.parts = sorted(parts, reverse=True)
        self.spread = self.parts[0][0] - self.parts[-1][0]

    def __lt__(self, other: _Solution) -> bool:
        return (self.spread, self.parts[0]) > (other.spread, other.parts[0])

    def joined(self, other: _Solution) -> _Solution:
        """Both in one: the largest part of one with the smallest of the other. Sums are added, never made anew."""
        for mine, more in zip(self.parts, reversed(other.parts)):
            mine[0] += more[0]
            mine[1] += more[1]
            mine[2] += more[2]
        return _Solution(self.parts)


def largest_differencing(lengths: Sequence[int], k: int, equal_size: bool = False, ragged: bool = False) -> list[list[int]]:
    """Places of ``k`` parts of about the same sum, by k-way largest differencing: the two partial solutions that differ
    most within themselves are put together. With ``equal_size`` all parts have as many members; the number must divide,
    or with ``ragged`` parts may have one member less. The parts come with the largest sum first; of equal sums the one
    with more members, then with the greater members as they came together."""
    n = len(lengths)
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    if equal_size:
        first = n % k
        if first and not ragged:
            raise ValueError(f"{n} sequences don't make {k} parts of equal size")
        starts = [order[at : at + k] for at in range(first, n, k)] + ([order[:first]] if first else [])
    else:
        starts = [[i] for i in order]
    heap = [_Solution([[lengths[i], 1, [(i, lengths[i])]] for i in start] + [[0, 0, []] for _ in range(k - len(start))]) for start in starts]
    heapq.heapify(heap)
    while len(heap) > 1:
        widest = heapq.heappop(heap)
        heapq.heappush(heap, widest.joined(heapq.heappop(heap)))
    return [sorted(i for i, _ in members) for _, _, members in heap[0].parts] if heap else [[] for _ in range(k)]


def least_loaded(lengths: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Places of ``k`` parts: each sequence in turn goes to the part of the least sum, of equals the first; with
    ``equal_size`` to that of the fewest members, and of those of the least sum."""
    heap = [(0, 0, j) for j in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, length in enumerate(lengths):
        members, load, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (members + equal_size, load + length, j))
    return parts


def balance(df: DataFrame, k: int, row_id: str = "row_id", length: str = "length", equal_size: bool = True) -> DataFrame:
    """``row_id, length, part`` of a batch's sequences by ``largest_differencing``."""
    rows = df.select(row_id, F.col(length).cast("long").alias("length")).orderBy(row_id).limit(MOST_SEQUENCES + 1).collect()
    if len(rows) > MOST_SEQUENCES:
        raise ValueError(f"more than {MOST_SEQUENCES} sequences in a batch")
    parts = largest_differencing([r.length for r in rows], k, equal_size)
    out = [(rows[i][0], rows[i].length, j) for j, p in enumerate(parts) for i in p]
    return df.sparkSession.createDataFrame(out, f"{row_id} long, length long, part int")


def micro_batches(df: DataFrame, most_tokens: int, row_id: str = "row_id", length: str = "length") -> DataFrame:
    """``balance`` into as few parts as the tokens need."""
    total = df.agg(F.coalesce(F.sum(length), F.lit(0)).alias("n")).first()["n"]
    return balance(df, max(1, -(-int(total) // most_tokens)), row_id, length, equal_size=False)


def balance_each(df: DataFrame, size: int, k: int | None = None, most_tokens: int | None = None, row_id: str = "row_id", length: str = "length") -> DataFrame:
    """``batch, row_id, length, part`` of all rows, of which every ``size`` by ``row_id`` are a batch, balanced in one task:
    into ``k`` parts of equal size (in the last batch one less, if it doesn't divide), or without ``k`` into as few parts as
    ``most_tokens`` needs."""
    ship(df.sparkSession)

    def parts_of(batch: pa.Table) -> pa.Table:
        rows = batch.sort_by("row_id")
        lengths = rows.column("length").to_pylist()
        found = largest_differencing(lengths, k or max(1, -(-sum(lengths) // most_tokens)), k is not None, ragged=True)
        of = {i: j for j, p in enumerate(found) for i in p}
        return rows.append_column("part", pa.array([of[i] for i in range(len(lengths))], pa.int32()))

    rows = df.select(F.floor(F.col(row_id) / size).cast("long").alias("batch"), F.col(row_id).cast("long").alias("row_id"), F.col(length).cast("long").alias("length"))
    return rows.groupBy("batch").applyInArrow(parts_of, "batch long, row_id long, length long, part int").withColumnRenamed("row_id", row_id)


def report(before: DataFrame, after: DataFrame, by: str | None = None) -> DataFrame:
    """``min_before, max_before, diff_before, min_after, max_after, diff_after, mean``: sums of parts. Both frames:
    ``part, length``, and ``by`` if it is given, which gives a row each."""
    keys = [by] if by else []

    def sums(df: DataFrame, name: str) -> DataFrame:
        s = df.groupBy(*keys, "part").agg(F.sum("length").alias("s"))
        return s.groupBy(*keys).agg(F.min("s").alias(f"min_{name}"), F.max("s").alias(f"max_{name}"), (F.max("s") - F.min("s")).alias(f"diff_{name}"), *([F.avg("s").alias("mean")] if name == "after" else []))

    return sums(before, "before").join(sums(after, "after"), by) if by else sums(before, "before").crossJoin(sums(after, "after"))


def flops(df: DataFrame, layers: int, hidden: int, inner: int, heads: int, vocabulary: int, length: str = "length") -> DataFrame:
    """``tokens, flops`` of training on sequences: six for each parameter and token, twelve for attention. The constants
    are a model's sizes."""
    head = hidden // heads
    dense = layers * (hidden * inner * 3 + hidden * heads * head * 4) + vocabulary * hidden * 2
    x = F.col(length).cast("double")
    return df.agg(F.sum(length).alias("tokens"), (6.0 * dense * F.sum(x) + 12.0 * layers * heads * head * F.sum(x * x)).alias("flops"))
