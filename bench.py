"""Times the headline queries and prints one JSON line: one warm-up run each, then the median of three (the queries for
training data run once)."""

from __future__ import annotations

import json
import os
import statistics
import time

from knotwork.plans import registry
from knotwork.session import local_session

HEADLINE = ("entity_merge", "edge_merge", "degree_centrality_topk", "khop_expand", "vector_topk", "em_f1_multigold", "grpo_advantage", "fedavg", "relevance_fragment", "gae")
TRAINING = ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_selection", "p8_found")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    queries = dict(registry.queries())
    names = list(HEADLINE)
    try:
        from knotwork.llm import queries as extra

        queries |= extra.queries()
        names += TRAINING
    except ImportError:
        pass
    seconds = {}
    for name in names:
        took = []
        for _ in range(4 if name in HEADLINE else 1):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
