"""Exact search over all vectors in blocks that are multiplied as matrices."""

from __future__ import annotations

import numpy as np

from knotwork.operators import vector


def test_blocks_against_brute_force(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(vector, "BLOCK", (40, 60), raising=False)
    draw = np.random.default_rng(3)
    rows = [(f"n{i:03d}é", [float(x) for x in draw.poisson(0.4, 12)]) for i in range(300)]  # many ties and equal vectors
    rows += [("zero", [0.0] * 12), ("none", None), ("short", [3.0, 1.0]), ("gap", [1.0, None]), (None, [1.0] * 12)]
    found = vector.neighbour_pairs(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 0.7, 4)

    known = {k: np.array(v + [0.0] * (12 - len(v))) for k, v in rows if k and v and None not in v}
    unit = {k: v / (np.sqrt(v @ v) or 1) for k, v in known.items()}
    wanted = set()
    for a in unit:
        near = sorted((-s, b) for b in unit if b != a and (s := round(float(unit[a] @ unit[b]), 9)) > 0.7)
        wanted |= {(a, b, -s) for s, b in near[:3]}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 300
    # No row for each pair: what leaves a task is only each vector's best.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_no_vectors(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector.neighbour_pairs(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    assert vector.neighbour_pairs(one).count() == 0
