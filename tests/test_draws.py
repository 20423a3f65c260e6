"""Hashed permutations against plain loops over the same draws, and against random permutations."""

import hashlib

import numpy as np
import pytest

from skyloom.operators import draws


def lattice(side):
    return [[a * side + b for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= a < side and 0 <= b < side] for r in range(side) for c in range(side)]


def table(spark, v, near, g="t"):
    return spark.createDataFrame([(g, i, float(x), n) for i, (x, n) in enumerate(zip(v, near))], "g string, k long, v double, near array<long>")


def order(n, d, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{d}:{i}".encode()).hexdigest(), i))


def p_of(larger, m):
    return (min(larger, m - larger) + 1) / (m + 1)


def plain_local(v, near, m, star):
    v = np.asarray(v, float)
    z = (v - v.mean()) / v.std()
    out = []
    for i, own in enumerate(near):
        k, larger = len(own), 0
        if not k:
            out.append(1.0)
            continue
        sign = 1 if star else z[i]
        for d in range(1, m + 1):
            others = [j for j in order(len(v), d) if j != i][:k]
            larger += round(sign * z[others].sum(), 9) >= round(sign * z[own].sum(), 9)
        out.append(p_of(larger, m))
    return out


@pytest.mark.parametrize("star", [True, False])
def test_local_p_of_the_same_draws(spark, star):
    rng = np.random.default_rng(1)
    near = lattice(5)
    near[7] = []
    near = [[j for j in n if j != 7] for n in near]
    v = rng.gamma(2, 3, 25).round(2)
    got = {r["k"]: r["p_sim"] for r in draws.local(table(spark, v, near), ["g"], "k", "v", "near", 60, 42, star).collect()}
    assert got == pytest.approx(dict(enumerate(plain_local(v, near, 60, star))))


def test_local_statistics(spark):
    v, near = np.array([1.0, 2.0, 3.0, 10.0]), [[1], [0, 2], [1, 3], [2]]
    z = v - v.mean()
    local = {r["k"]: r for r in draws.local(table(spark, v, near), ["g"], "k", "v", "near", 9, 0, False).collect()}
    assert [local[i]["statistic"] for i in range(4)] == pytest.approx([z[i] * z[n].mean() / v.var() for i, n in enumerate(near)])
    assert [local[i]["lag"] for i in range(4)] == pytest.approx([z[n].mean() for n in near])
    star = {r["k"]: r["statistic"] for r in draws.local(table(spark, v, near), ["g"], "k", "v", "near", 9, 0, True).collect()}
    w = np.array([len(n) + 1 for n in near])
    total = np.array([v[i] + v[n].sum() for i, n in enumerate(near)])
    assert [star[i] for i in range(4)] == pytest.approx((total - v.mean() * w) / (v.std() * np.sqrt((4 * w - w * w) / 3)))
    flat = draws.local(table(spark, np.ones(5), [[1], [0], [], [4], [3]]), ["g"], "k", "v", "near", 9, 0, True).collect()
    assert all(r["statistic"] is None and r["p_sim"] is None for r in flat)
    alone = {r["k"]: r for r in draws.local(table(spark, v, [[1], [0], [], []]), ["g"], "k", "v", "near", 9, 0, False).collect()}
    assert alone[2]["statistic"] == 0 and alone[2]["p_sim"] == 1 and alone[3]["lag"] == 0
    with pytest.raises(Exception, match="all zones"):
        draws.local(table(spark, [1.0, float("nan"), 2.0], [[1], [0], [0]]), ["g"], "k", "v", "near", 9, 0, False).collect()


def test_moran(spark):
    """The index, p of the same draws, p near that of random permutations, groups apart, no spread."""
    rng = np.random.default_rng(2)
    near, side = lattice(6), 6
    v = np.array([r + c for r in range(side) for c in range(side)], float) + rng.normal(0, 2.5, 36)
    df = table(spark, v, near, "trend").union(table(spark, rng.normal(0, 1, 36), near, "noise")).union(table(spark, np.ones(36), near, "flat"))
    got = {r["g"]: r for r in draws.moran(df, ["g"], "k", "v", "near", 199).collect()}
    z = (v - v.mean()) / v.std()
    index = lambda x: sum(x[i] * x[n].mean() for i, n in enumerate(near)) / 36
    assert got["trend"]["moran_i"] == pytest.approx(index(z))
    assert got["trend"]["p_sim"] == p_of(sum(round(index(z[order(36, d)]) * 36, 9) >= round(index(z) * 36, 9) for d in range(1, 200)), 199)
    assert got["flat"]["moran_i"] is None and got["flat"]["p_sim"] is None
    x = np.array([r["v"] for r in df.where("g = 'noise'").orderBy("k").collect()])
    x = (x - x.mean()) / x.std()
    share = np.mean([index(rng.permutation(x)) >= index(x) for _ in range(2000)])
    assert got["noise"]["p_sim"] == pytest.approx(min(share, 1 - share), abs=0.12)


def test_draws_do_not_depend_on_partitions(spark):
    df = table(spark, np.arange(16.0) ** 2 % 11, lattice(4))
    of = lambda d: sorted((r["k"], round(r["statistic"], 9), r["p_sim"]) for r in draws.local(d, ["g"], "k", "v", "near", 30, 7, True).collect())
    assert of(df.coalesce(1)) == of(df.repartition(5))
