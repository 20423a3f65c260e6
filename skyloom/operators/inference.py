"""Statistical models on grouped tables: modified trend tests, OLS tables, spatial models, local regression.

A group is a series or a set of zones, so it fits in one task; the work is numpy
on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _kendall(v: np.ndarray) -> tuple[float, float]:
    """S and its variance with the correction for ties."""
    n = len(v)
    s = float(sum(np.sign(v[i + 1 :] - v[i]).sum() for i in range(n)))
    _, ties = np.unique(v, return_counts=True)
    return s, (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18


def _autocorrelation(x: np.ndarray, lag: int) -> float:
    c = x - x.mean()
    return float((c[lag:] * c[: len(c) - lag]).sum() / max((c * c).sum(), 1e-300))


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    _, which, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[which]


def _sen(v: np.ndarray) -> float:
    i, j = np.triu_indices(len(v), 1)
    return float(np.median((v[j] - v[i]) / (j - i)))


def trend_test(values: np.ndarray, method: str = "original") -> tuple[str, float, float, float]:
    """(status, s, z, p) of a Mann-Kendall test; method is original, hamed_rao, yue_wang, prewhitening or trend_free.

    Short series and constant ones give a status and no figures; nothing raises.
    """
    v = values[np.isfinite(values)].astype(float)
    none = (math.nan,) * 3
    if len(v) < 4:
        return ("insufficient", *none)
    if np.ptp(v) == 0:
        return ("no_variance", *none)
    n = len(v)
    if method in ("prewhitening", "trend_free"):
        slope = _sen(v) if method == "trend_free" else 0.0
        flat = v - slope * np.arange(n)
        r = _autocorrelation(flat, 1)
        v = flat[1:] - r * flat[:-1] + slope * np.arange(1, n)
        n -= 1
        if np.ptp(v) == 0:
            return ("degenerate", *none)
    s, var = _kendall(v)
    if method in ("hamed_rao", "yue_wang"):
        # Two values on the median slope's line tie but for rounding, so places count from 1 as in the published procedure.
        flat = v - _sen(v) * np.arange(1, n + 1)
        base = _ranks(flat) if method == "hamed_rao" else flat
        rho = np.array([_autocorrelation(base, k) for k in range(1, n - 1)])
        k = np.arange(1, n - 1)
        if method == "hamed_rao":
            rho = np.where(np.abs(rho) > 1.959963984540054 / math.sqrt(n), rho, 0)
            var *= max(1 + 2 / (n * (n - 1) * (n - 2)) * float(((n - k) * (n - k - 1) * (n - k - 2) * rho).sum()), 1e-12)
        else:
            var *= max(1 + 2 * float(((1 - k / n) * rho).sum()), 1e-12)
    z = 0.0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    return "ok", s, z, math.erfc(abs(z) / math.sqrt(2))


def trend_tests(df: DataFrame, keys: Sequence[str], year: str, value: str, methods: Sequence[str]) -> DataFrame:
    """(keys, method, status, s, z, p), one row per series and method."""
    types = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(year)[value].to_numpy(float)
        rows = [(*pdf[list(keys)].iloc[0], m, *trend_test(v, m)) for m in methods]
        return pd.DataFrame(rows, columns=[*keys, "method", "status", "s", "z", "p"])

    return df.groupBy(*keys).applyInPandas(run, f"{types}, method string, status string, s double, z double, p double")


def ols(y: np.ndarray, x: np.ndarray) -> dict:
    """Coefficients with standard errors and t, R2, AIC, residuals; x has its constant.  Refuses a rank-deficient design."""
    n, k = x.shape
    if np.linalg.matrix_rank(x) < k or n <= k:
        raise ValueError("the design is rank-deficient")
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    s2 = e @ e / (n - k)
    se = np.sqrt(np.diag(inverse) * s2)
    like = -n / 2 * (math.log(2 * math.pi) + math.log(e @ e / n) + 1)
    return {"b": b, "se": se, "t": b / se, "r2": 1 - e @ e / ((y - y.mean()) ** 2).sum(), "aic": 2 * (k + 1) - 2 * like, "e": e, "s2": e @ e / n, "like": like}


def lagrange(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Lagrange-multiplier tests of the OLS residuals under weights w: for a lag, for an error, each robust to the other, both together, with p; and the residuals' Moran."""
    fit = ols(y, x)
    e, s2 = fit["e"], fit["s2"]
    t = np.trace(w @ w + w.T @ w)
    m = np.eye(len(y)) - x @ np.linalg.inv(x.T @ x) @ x.T
    wxb = w @ x @ fit["b"]
    j = wxb @ m @ wxb / s2 + t
    lagged, errors = e @ w @ y / s2, e @ w @ e / s2
    one = {"lag": lagged**2 / j, "error": errors**2 / t, "robust_lag": (lagged - errors) ** 2 / max(j - t, 1e-300), "robust_error": (errors - t / j * lagged) ** 2 / max(t * (1 - t / j), 1e-300)}
    p = lambda q: math.erfc(math.sqrt(max(q, 0) / 2))
    both = one["error"] + one["robust_lag"]
    out = {f"lm_{k}": v for k, v in one.items()} | {f"p_{k}": p(v) for k, v in one.items()}
    return out | {"lm_both": both, "p_both": math.exp(-both / 2), "residual_moran": float(e @ w @ e / (e @ e)) * len(y) / w.sum() if w.sum() else math.nan}


def _golden(f, low: float, high: float) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(60):
        if fa > fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def spatial_lag(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(rho, coefficients, log likelihood) of y = rho W y + x b + e by concentrated maximum likelihood."""
    n = len(y)
    e0, e1 = ols(y, x)["e"], ols(w @ y, x)["e"]
    like = lambda r: np.linalg.slogdet(np.eye(n) - r * w)[1] - n / 2 * math.log(((e0 - r * e1) ** 2).sum() / n)
    rho = _golden(like, -0.99, 0.99)
    return rho, ols(y - rho * (w @ y), x)["b"], float(like(rho) - n / 2 * (math.log(2 * math.pi) + 1))


def spatial_error(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(lambda, coefficients, log likelihood) of y = x b + u, u = lambda W u + e by maximum likelihood."""
    n = len(y)

    def like(k: float) -> float:
        a = np.eye(n) - k * w
        return np.linalg.slogdet(a)[1] - n / 2 * math.log((ols(a @ y, a @ x)["e"] ** 2).sum() / n)

    k = _golden(like, -0.99, 0.99)
    a = np.eye(n) - k * w
    return k, ols(a @ y, a @ x)["b"], float(like(k) - n / 2 * (math.log(2 * math.pi) + 1))


def local_regression(y: np.ndarray, x: np.ndarray, at: np.ndarray, neighbours: int) -> tuple[np.ndarray, float]:
    """Coefficients at each place and the corrected AIC, under an adaptive bisquare kernel."""
    n, k = x.shape
    d = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2))
    b, trace, e = np.zeros((n, k)), 0.0, np.zeros(n)
    for i in range(n):
        far = np.partition(d[i], min(neighbours, n - 1))[min(neighbours, n - 1)] + 1e-12
        u = np.where(d[i] < far, (1 - (d[i] / far) ** 2) ** 2, 0)
        hat = np.linalg.pinv((x * u[:, None]).T @ x) @ (x * u[:, None]).T
        b[i] = hat @ y
        e[i] = y[i] - x[i] @ b[i]
        trace += float(x[i] @ hat[:, i])
    s2 = max(float((e * e).mean()), 1e-300)
    return b, 2 * n * math.log(math.sqrt(s2)) + n * math.log(2 * math.pi) + n * (n + trace) / max(n - 2 - trace, 1e-9)


def model_ladder(zones: DataFrame, group: str, key: str, response: str, predictors: Sequence[str], xy: Sequence[str], neighbours: str) -> DataFrame:
    """(group, model, parameter, value) of OLS, LM tests, spatial lag and error models and GWR per set of zones.

    ``neighbours`` is array<long> of keys; weights are row-standardised.
    """
    group_type = dict(zones.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[response, *predictors]).sort_values(key).reset_index(drop=True)
        place = {int(k): i for i, k in enumerate(pdf[key])}
        w = np.zeros((len(pdf), len(pdf)))
        for i, row in enumerate(pdf[neighbours]):
            near = [place[int(j)] for j in row if int(j) in place]
            w[i, near] = 1 / max(len(near), 1)
        y = pdf[response].to_numpy(float)
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in predictors]])
        names, out = ["const", *predictors], []
        fit = ols(y, x)
        out += [("ols", n, v) for n, v in zip([*names, "r2", "aic"], [*fit["b"], fit["r2"], fit["aic"]], strict=True)]
        out += [("lm", n, v) for n, v in lagrange(y, x, w).items()]
        for model, f in (("lag", spatial_lag), ("error", spatial_error)):
            r, b, like = f(y, x, w)
            out += [(model, n, v) for n, v in zip(["rho", *names, "log_likelihood"], [r, *b, like], strict=True)]
        best = min(range(max(len(names) + 2, len(pdf) // 4), len(pdf)), key=lambda k: local_regression(y, x, pdf[list(xy)].to_numpy(float), k)[1])
        b, aicc = local_regression(y, x, pdf[list(xy)].to_numpy(float), best)
        out += [("gwr", f"median_{n}", float(np.median(b[:, i]))) for i, n in enumerate(names)] + [("gwr", "aicc", aicc), ("gwr", "neighbours", float(best))]
        return pd.DataFrame([(pdf[group].iloc[0], *r) for r in out], columns=[group, "model", "parameter", "value"])

    return zones.groupBy(group).applyInPandas(run, f"{group} {group_type}, model string, parameter string, value double")


def detectable_slope(years: int, noise: float, alpha: float = 0.05, power: float = 0.8, draws: int = 400, seed: int = 42) -> float:
    """The slope that the original test finds with the wanted power, by seeded draws and bisection."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, noise, (draws, years))
    found = lambda slope: np.mean([trend_test(row + slope * np.arange(years))[3] <= alpha for row in base])
    low, high = 0.0, 4 * noise / max(years - 1, 1)
    while found(high) < power:
        high *= 2
    for _ in range(12):
        mid = (low + high) / 2
        low, high = (low, mid) if found(mid) >= power else (mid, high)
    return high
