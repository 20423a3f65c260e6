"""How many shuffles near-duplicate detection takes, and components of odd edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import components as steps
from skyloom.llm import near_dedup


def test_few_shuffles(spark, monkeypatch):
    """A wide group of near copies is found by a bounded number of shuffles, which are what the query costs with many partitions."""
    shuffles = []

    def counted(real):
        return lambda df, *a, **b: (shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")), real(df, *a, **b))[1]

    for module in (near_dedup, steps):
        monkeypatch.setattr(module, "durable", counted(module.durable))
    rng, rows = np.random.default_rng(7), []
    for i in range(60):
        words = [f"w{j}" for j in range(150)]
        for p in rng.integers(0, 150, rng.integers(1, 9)):
            words[p] = f"x{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=3, percent=85).collect()
    assert all(r["component_id"] == 0 for r in got if r["doc_id"] >= 100) and len(got) == 80
    assert sum(shuffles) <= 45


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 5), (5, 3), (9, 5), (7, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(i, 100 + i) for i in range(40)]])
def test_components_of_odd_edges(spark, edges):
    """Equal, reversed and own edges, chains and stars of stars; each id comes once."""
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = steps.components(spark.createDataFrame(edges, "u long, v long").select(F.col("u"), F.col("v"))).collect()
    assert sorted(map(tuple, got)) == sorted(up.items())
