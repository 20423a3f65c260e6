"""Trend tests and spatial models against published results and closed forms."""

import math

import numpy as np
import pytest

from skyloom.operators import inference, significance

# Two yearly series with autocorrelated ranks, and (z, p) of the original test and of the one with the variance correction of Hamed and Rao.
SERIES = [
    [32.99947079789838, 32.61800274198761, 34.636415383724405, 32.22299830816764, 34.93330623606258, 34.3838527558682, 35.46868061282849, 33.72924871739301, 31.181000521650176, 34.27644517161818, 30.589937845865887, 31.349665350276933, 33.15540944525536, 33.21184892824823, 34.34039012722924, 36.136169145324565, 35.0733246655984, 34.69082359954779, 34.98842341832309, 33.657444096658494, 34.3335070070759, 34.510471350811315, 33.93983606090648, 31.105584559709648, 33.67052234165639, 33.5155390957834],
    [29.57241558893156, 29.49111132667544, 29.4091932639656, 29.19645736787869, 29.600930816157515, 29.218522557471, 29.691379509695015, 29.997925676706767, 29.608116665244697, 29.96499979911417, 30.65248544747287, 29.73508723644932, 29.99886032654589, 29.777133037385514, 30.2376230416952, 30.0612659807766, 30.295435113223768, 30.41710371024449, 30.442280548407048, 30.45991406221982, 30.88805903086324, 30.18159977959376, 29.72468997981909, 29.12424744347012, 29.30015384686778, 28.01921009956667],
]
RESULTS = [
    {"s": 11.0, "original": (0.2204155075111935, 0.8255475691294885), "hamed_rao": (0.2843950082972973, 0.7761076839465644), "slope": 0.0116682024613184},
    {"s": 89.0, "original": (1.939656466098503, 0.0524214535865017), "hamed_rao": (1.4480867624920823, 0.1475927872115054), "slope": 0.0334490703109011},
]


@pytest.mark.parametrize(("series", "want"), list(zip(SERIES, RESULTS, strict=True)))
def test_trend_tests_of_published_series(series, want):
    v = np.array(series)
    for method in ("original", "hamed_rao"):
        status, s, z, p = inference.trend_test(v, method)
        assert (status, s) == ("ok", want["s"]) and (z, p) == pytest.approx(want[method], abs=1e-12)
    assert inference._sen(v) == pytest.approx(want["slope"], abs=1e-12)


def test_trend_test_statuses():
    assert inference.trend_test(np.array([1.0, 2.0, np.nan]))[0] == "insufficient"
    assert inference.trend_test(np.full(8, 3.0))[0] == "no_variance"
    status, s, z, _ = inference.trend_test(np.arange(10.0))
    assert (status, s) == ("ok", 45.0) and z == pytest.approx(44 / math.sqrt(125))
    # Ties lower the variance: four equal values among ten.
    tied = np.array([1.0, 1, 1, 1, 2, 3, 4, 5, 6, 7])
    assert inference._kendall(tied)[1] == pytest.approx((10 * 9 * 25 - 4 * 3 * 13) / 18)
    # White noise is hardly changed by any of the modified tests' corrections of a perfect alternation.
    v = np.array([0.0, 1.0] * 10) + np.arange(20) * 1e-3
    assert abs(inference.trend_test(v, "yue_wang")[2]) > abs(inference.trend_test(v, "original")[2])


def _rook(side):
    w = np.zeros((side * side, side * side))
    for r in range(side):
        for c in range(side):
            for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= a < side and 0 <= b < side:
                    w[r * side + c, a * side + b] = 1
    return w / w.sum(axis=1, keepdims=True)


def test_ols_closed_form():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    y = x @ [1.0, 2.0, -3.0] + rng.normal(0, 0.5, 200)
    fit = inference.ols(y, x)
    assert fit["b"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    one = inference.ols(y, x[:, :2])
    r = np.corrcoef(x[:, 1], y)[0, 1]
    assert one["r2"] == pytest.approx(r * r) and one["t"][1] == pytest.approx(r * math.sqrt(198 / (1 - r * r)))
    with pytest.raises(ValueError, match="rank"):
        inference.ols(y, np.column_stack([x, x[:, 1]]))


def test_spatial_models_find_planted_dependence():
    rng = np.random.default_rng(1)
    w, n = _rook(18), 324
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    e = rng.normal(0, 0.5, n)
    lagged = np.linalg.solve(np.eye(n) - 0.6 * w, x @ [1.0, 2.0] + e)
    rho, b, like = inference.spatial_lag(lagged, x, w)
    assert rho == pytest.approx(0.6, abs=0.06) and b == pytest.approx([1.0, 2.0], abs=0.25) and like > inference.ols(lagged, x)["like"]
    error = x @ [1.0, 2.0] + np.linalg.solve(np.eye(n) - 0.6 * w, e)
    lam, b, like = inference.spatial_error(error, x, w)
    assert lam == pytest.approx(0.6, abs=0.12) and b == pytest.approx([1.0, 2.0], abs=0.15) and like > inference.ols(error, x)["like"]
    tests = inference.lagrange(lagged, x, w)
    assert tests["p_lag"] < 1e-6
    assert tests["p_robust_lag"] < 1e-6 and tests["lm_both"] == pytest.approx(tests["lm_lag"] + tests["lm_robust_error"])
    choice = {k: (tests[n], tests[f"p_{n.removeprefix('lm_')}"]) for k, n in (("lm_lag", "lm_lag"), ("lm_error", "lm_error"), ("rlm_lag", "lm_robust_lag"), ("rlm_error", "lm_robust_error"))}
    assert significance.model_choice(choice) == "lag"
    clean = inference.lagrange(x @ [1.0, 2.0] + e, x, w)
    assert clean["p_lag"] > 0.01 and clean["p_error"] > 0.01
    # The error test is the residuals' Moran, squared and scaled.
    r = inference.ols(error, x)["e"]
    moran = r @ w @ r / (r @ r)
    assert inference.lagrange(error, x, w)["lm_error"] == pytest.approx((n * moran) ** 2 / np.trace(w @ w + w.T @ w))


def test_local_regression_follows_the_place():
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 10, (150, 2))
    x = np.column_stack([np.ones(150), rng.normal(size=150)])
    y = x[:, 0] + (1 + at[:, 0] / 5) * x[:, 1]
    b, _ = inference.local_regression(y, x, at, 40)
    assert np.corrcoef(b[:, 1], 1 + at[:, 0] / 5)[0, 1] > 0.97
    flat, _ = inference.local_regression(x @ [1.0, 2.0], x, at, 40)
    assert flat == pytest.approx(np.tile([1.0, 2.0], (150, 1)))


def test_detectable_slope_falls_with_years_and_rises_with_noise():
    few, many, loud = (inference.detectable_slope(n, s, draws=120) for n, s in ((10, 1.0), (25, 1.0), (10, 2.0)))
    assert many < few < loud and loud == pytest.approx(2 * few, rel=0.15)


def test_model_choice():
    p = lambda **x: {k: (v, 0.01 if v > 5 else 0.5) for k, v in x.items()}
    assert significance.model_choice(p(lm_lag=1, lm_error=1)) == "ols"
    assert significance.model_choice(p(lm_lag=9, lm_error=1)) == "lag" and significance.model_choice(p(lm_lag=1, lm_error=9)) == "error"
    assert significance.model_choice(p(lm_lag=9, lm_error=9, rlm_lag=1, rlm_error=9)) == "error"
    assert significance.model_choice(p(lm_lag=9, lm_error=9, rlm_lag=8, rlm_error=7)) == "lag"
    assert significance.model_choice(p(lm_lag=8, lm_error=9, rlm_lag=1, rlm_error=1)) == "error"
