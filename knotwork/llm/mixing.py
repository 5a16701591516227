"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to, and these sets by the sources that a mix names. A flow
routes each pattern's tokens to the sources' quotas: the first use of a pattern's documents costs nothing, each further one
more than the last, so that small sources are repeated as little as will do, and documents of several sources go where they
are needed. Each mix is solved by itself, in one task, which sees its targets and patterns and no document. Documents are
then chosen by a seeded order, in which the interval of a pattern's tokens that flows to a source marks the documents it
uses.

The total of a mix is the one at which the shares are expected to be nearest to the targets. A smaller total lets scarce
sources keep their shares, but is made of few documents, whose sizes don't come out even; with a larger one scarce sources
run out, at their capped repeats, and the others keep their proportions.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut, few

#: Totals that are tried for a mix besides those at which a source runs out; of these, if they are more, as many by rank.
TOTALS, ENDS = 96, 512
#: Documents of a part of the seeded order whose sums are put in sequence by themselves, and the least number of parts.
PART, LEAST_PARTS = 50_000, 256


class Flow:
    """Min-cost flow of whole numbers by successive cheapest paths."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.arcs: dict[int, list[int]] = defaultdict(list)

    def add(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            least, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                x = queue.popleft()
                waiting.discard(x)
                for e in self.arcs[x]:
                    y, c = self.to[e], least[x] + self.cost[e]
                    if self.room[e] > 0 and c < least.get(y, 1 << 60):
                        least[y], via[y] = c, e
                        if y not in waiting:
                            waiting.add(y)
                            queue.append(y)
            if sink not in via:
                return total
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            pushed = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= pushed
                self.room[e ^ 1] += pushed
            total += pushed


def _components(patterns: dict[tuple[str, ...], tuple[int, int]]) -> list[list[tuple[str, ...]]]:
    """Patterns in groups that share no source."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in patterns:
        for s in p:
            root[find(s)] = find(p[0])
    groups: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for p in patterns:
        groups[find(p[0])].append(p)
    return list(groups.values())


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[tuple[tuple[str, ...], str], int]:
    """How many tokens go from each pattern to each source in a mix of ``total`` tokens."""
    flow, node = Flow(), {}
    for key in [*patterns, *shares]:
        node[key] = len(node) + 2
    arcs = {}
    for pattern, tokens in patterns.items():
        for use in range(max(repeats[s] for s in pattern)):
            flow.add(0, node[pattern], tokens, use)
        for s in pattern:
            arcs[(pattern, s)] = flow.add(node[pattern], node[s], tokens * repeats[s])
    for s, share in shares.items():
        flow.add(node[s], 1, round(share * total))
    flow.run(0, 1)
    return {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1]}


def solve(patterns: dict[tuple[str, ...], tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens by pattern and source of the mix that is expected to be nearest to its targets, or of ``total`` tokens where
    they can be had. ``patterns``: tokens and documents of each; ``targets``: share and repeats of each source. The shares
    of sources that have no documents are spread over the others in proportion; sources without a share or a repeat are
    left out of the patterns."""
    wanted = {s for s, (share, uses) in targets.items() if uses > 0 and share > 0}
    usable: dict[tuple[str, ...], tuple[int, int]] = {}
    for p, (tokens, documents) in patterns.items():
        kept = tuple(s for s in p if s in wanted)
        if kept and tokens > 0:
            t, n = usable.get(kept, (0, 0))
            usable[kept] = (t + tokens, n + documents)
    present = sorted({s for p in usable for s in p})
    weight = sum(targets[s][0] for s in present)
    if not weight:
        return {}
    shares = {s: targets[s][0] / weight for s in present}
    repeats = {s: targets[s][1] for s in present}
    capacity = {s: 0 for s in present}
    size: dict[str, list[int]] = {s: [0, 0] for s in present}
    for p, (tokens, documents) in usable.items():
        for s in p:
            capacity[s] += tokens * repeats[s]
            size[s][0] += tokens
            size[s][1] += documents
    alone, tied = [], []
    for group in _components(usable):
        (alone if len(group) == 1 and len(group[0]) == 1 else tied).append(group)

    def tied_routes(group: list[tuple[str, ...]], t: float) -> dict[tuple[tuple[str, ...], str], int]:
        inside = {s for p in group for s in p}
        return route({p: usable[p][0] for p in group}, {s: shares[s] for s in inside}, repeats, t)

    if total is None:
        total = _nearest(present, shares, capacity, {s: t / max(1, n) for s, (t, n) in size.items()}, [g[0][0] for g in alone], lambda t: [tied_routes(g, t) for g in tied])
    out = {(g[0], g[0][0]): min(round(shares[g[0][0]] * total), capacity[g[0][0]]) for g in alone}
    for group in tied:
        out |= tied_routes(group, total)
    return {k: v for k, v in out.items() if v > 0}


def _nearest(present: list[str], shares: dict[str, float], capacity: dict[str, int], document: dict[str, float], alone: list[str], tied) -> float:  # noqa: ANN001
    """The total with the least expected deviation: the sum of the shares' differences from the targets, and half a
    document of each source that isn't used up; of equals the largest."""
    share, room, mean = (np.array([x[s] for s in present], dtype=np.float64) for x in (shares, capacity, document))
    ends = np.unique(room / share)
    if len(ends) > ENDS:
        ends = np.quantile(ends, np.linspace(0, 1, ENDS), method="nearest")
    least = max(1.0, float(mean.min()))
    totals = np.unique(np.concatenate([ends, np.geomspace(least, max(float(ends[-1]), least), TOTALS)]))
    place = {s: k for k, s in enumerate(present)}
    single = np.array([place[s] for s in alone], dtype=np.int64)
    best, found = math.inf, float(totals[-1])
    for t in totals:
        reached = np.zeros(len(present))
        reached[single] = np.minimum(share[single] * t, room[single])
        for routes in tied(t):
            for (_, s), tokens in routes.items():
                reached[place[s]] += tokens
        whole = reached.sum()
        if whole <= 0:
            continue
        even = np.where(reached < room - 0.5, np.minimum(mean / 2, np.maximum(reached, 1)), 0)
        off = (np.abs(reached / whole - share) + even / whole).sum()
        if off <= best + 1e-12:
            best, found = off, float(t)
    return found


def _solved(patterns: pa.Table, goals: pa.Table, total: int | None) -> pa.Table:
    """Routes of one mix as intervals of the patterns' tokens, in parts of the whole; with repeats they go beyond 1."""
    schema = pa.schema([("mix_name", pa.string()), ("pattern", pa.list_(pa.string())), ("source", pa.string()), ("low", pa.float64()), ("high", pa.float64())])
    targets = {s: (share, uses) for s, share, uses in zip(*(goals.column(c).to_pylist() for c in ("source", "target_share", "max_repeats")))}
    own = {tuple(p): (t, n) for p, t, n in zip(*(patterns.column(c).to_pylist() for c in ("pattern", "tokens", "documents")))}
    alike: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
    for p in own:
        alike[tuple(s for s in p if targets[s][0] > 0 and targets[s][1] > 0)].append(p)
    rows, start = [], dict.fromkeys(alike, 0.0)
    for (kept, source), tokens in sorted(solve(own, targets, total).items()):
        part = tokens / sum(own[p][0] for p in alike[kept])
        rows += [{"mix_name": goals.column("mix_name")[0].as_py(), "pattern": list(p), "source": source, "low": start[kept], "high": start[kept] + part} for p in alike[kept]]
        start[kept] += part
    return pa.Table.from_pylist(rows, schema=schema)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection, and the shares it reaches.

    ``documents``: ``doc_id, sources`` (the set it belongs to) and ``tokens``; ``targets``: ``mix_name, source,
    target_share, max_repeats``. Selection: ``mix_name, source, doc_id, uses``, where no document is used more than
    ``max_repeats`` times for a source and all a document's uses in a mix are within the largest of its sources'. Shares:
    ``mix_name, source, target_share, actual_share, deviation, total_deviation, tokens, documents, most_uses`` for every
    row of the targets; the total deviation is the sum of a mix's deviations without their signs.

    A mix has ``total`` tokens where they can be had, or without it the total whose shares are expected to be nearest to
    the targets; a source that runs out before is used up to its repeats and doesn't shrink the others. What the order
    leaves of a source's quota is made up for by one use more or less of the document whose size fits it best.

    Documents without an id, without tokens, or of NULL or unnamed sources are left out; a target without documents gets a
    share of 0; NULL, NaN and negative shares and NULL repeats count as 0; of two rows for one source of a mix the larger
    share and repeats hold; a NULL mix or source is left out. Empty tables give an empty selection. Other columns are not
    read. The same seed gives the same selection, however the rows are partitioned; rows of one id are put out as one, with
    their uses added.
    """
    share = F.col("target_share").cast("double")
    clean = F.when(F.isnan(share) | (share < 0), 0.0).otherwise(F.coalesce(share, F.lit(0.0)))
    named = targets.filter("mix_name is not null and source is not null")
    goals = cut(named.groupBy("mix_name", "source").agg(F.max(clean).alias("target_share"), F.max(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0))).alias("max_repeats")))

    def small(df: DataFrame, row_bytes: int) -> DataFrame:
        return F.broadcast(df) if few(df, row_bytes) else df

    member = F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isNotNull())))
    rows = documents.filter("tokens > 0 and doc_id is not null").select("doc_id", F.col("tokens").cast("long").alias("tokens"), member.alias("member"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    parts = 1 << max(LEAST_PARTS.bit_length() - 1, math.ceil(rows.count() / PART).bit_length())
    rows = rows.withColumn("part", F.shiftrightunsigned("h", 64 - parts.bit_length() + 1))
    sums = cut(rows.groupBy("member", "part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    members = cut(sums.groupBy("member").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents")))
    # A row for each set of sources, and for each mix that names some of them.
    in_mix = members.withColumn("source", F.explode("member")).join(small(goals.select("mix_name", "source"), 128), "source")
    in_mix = cut(in_mix.groupBy("mix_name", "member", "tokens", "documents").agg(F.array_sort(F.collect_list("source")).alias("pattern")))
    patterns = in_mix.groupBy("mix_name", "pattern").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
    solved = patterns.groupBy("mix_name").cogroup(goals.groupBy("mix_name")).applyInArrow(lambda p, g: _solved(p, g, total), "mix_name string, pattern array<string>, source string, low double, high double")
    # Each mix begins at a place of its own in the order.
    shift = F.pmod(F.xxhash64(F.lit(seed), "mix_name"), F.lit(1 << 20)) / (1 << 20)
    flows = cut(solved.join(in_mix, ["mix_name", "pattern"]).select("mix_name", "member", "source", (F.col("low") + shift).alias("low"), (F.col("high") + shift).alias("high"), F.col("tokens").alias("whole")))

    chosen = cut(_select(rows, sums, small(flows, 256)))
    selection = cut(_fitted(rows, chosen, flows, goals, small))
    used = selection.groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    all_of = used.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    reached = goals.join(used, ["mix_name", "source"], "left").join(all_of, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_uses")),
    )
    reached = reached.withColumn("deviation", F.col("actual_share") - F.col("target_share"))
    off = reached.groupBy("mix_name").agg(F.sum(F.abs("deviation")).alias("total_deviation"))
    shares = reached.join(off, "mix_name").select("mix_name", "source", "target_share", "actual_share", "deviation", "total_deviation", "tokens", "documents", "most_uses")
    return selection.select("mix_name", "source", "doc_id", "uses"), shares


def _select(rows: DataFrame, sums: DataFrame, flows: DataFrame) -> DataFrame:
    """Documents and uses of each route. In the seeded order a document takes an interval of its set's tokens; with every
    further use all intervals recur one whole further on. A use belongs to the route that its middle falls in."""
    by_member = Window.partitionBy("member").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("begin", F.coalesce(F.sum("tokens").over(by_member), F.lit(0))).select("member", "part", "begin")
    in_part = Window.partitionBy("member", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("tokens").over(in_part), F.lit(0))).join(begins, ["member", "part"])
    met = placed.join(flows, "member").withColumn("middle", (F.col("begin") + F.col("within") + F.col("tokens") / 2) / F.col("whole"))
    uses = (F.ceil(F.col("high") - F.col("middle")) - F.ceil(F.col("low") - F.col("middle"))).cast("int")
    return met.withColumn("uses", uses).filter("uses > 0").select("mix_name", "source", "doc_id", "uses", "tokens")


def _fitted(rows: DataFrame, chosen: DataFrame, flows: DataFrame, goals: DataFrame, small) -> DataFrame:  # noqa: ANN001
    """The selection with one use more or less in each source, where that brings its tokens nearer to its quota."""
    by = ["mix_name", "source"]
    quota = flows.groupBy(*by).agg(F.sum((F.col("high") - F.col("low")) * F.col("whole")).alias("quota"))
    used = chosen.groupBy(*by).agg(F.sum(F.col("uses") * F.col("tokens")).alias("used"))
    gaps = cut(quota.join(used, by, "left").join(goals.select(*by, "max_repeats"), by).select(*by, "max_repeats", (F.col("quota") - F.coalesce("used", F.lit(0))).alias("gap")))
    # Only a document that is smaller than twice the gap brings its source nearer.
    short = flows.select("mix_name", "member", "source").join(gaps.filter("gap > 0"), by)
    free = rows.join(small(short, 256), "member").filter(F.col("tokens") < 2 * F.col("gap"))
    uses = chosen.groupBy("mix_name", "doc_id").agg(F.sum("uses").alias("so_far"))
    free = free.join(uses, ["mix_name", "doc_id"], "left").filter(F.coalesce("so_far", F.lit(0)) < F.col("max_repeats"))
    more = free.select(*by, "doc_id", "tokens", "gap", F.lit(1).alias("change"))
    less = chosen.join(small(gaps.filter("gap < 0"), 128), by).filter(F.col("tokens") < -2 * F.col("gap")).select(*by, "doc_id", "tokens", "gap", F.lit(-1).alias("change"))
    off = F.abs(F.col("gap") - F.col("change") * F.col("tokens"))
    best = more.unionByName(less).groupBy(*by).agg(F.min_by(F.struct("doc_id", "tokens", "change"), F.struct(off, F.xxhash64("doc_id"), "doc_id")).alias("x"))
    changes = best.select(*by, "x.doc_id", F.col("x.change").alias("uses"), "x.tokens")
    return chosen.unionByName(changes.select(*chosen.columns)).groupBy(*by, "doc_id").agg(F.sum("uses").cast("int").alias("uses"), F.first("tokens").alias("tokens")).filter("uses > 0")
