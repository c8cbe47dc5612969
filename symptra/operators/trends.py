"""Search-volume trends: features, per-series smooth fits, draws, bands."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quantile_bands
from ..functions.glm import (
    GPBasis,
    choose_penalties,
    digamma,
    log_gamma,
    normal_draws,
    penalty_diagonal,
    seeded,
    solve_penalised,
    trigamma,
)
from ..schema import BANK_HOLIDAYS, SEARCH_TERMS
from .compare import bands_with_value
from .mrp import N_DRAWS, _unpack_draws
from .prevalence import with_time_index
from .survey import add_row_id, filter_symptoms_in

TREND_LENGTH = 7.0
BASIS_SIZE = 10
N_WEEKDAY = 3
EDGE = 1e-4
START_PRECISION = 10.0
PRECISION = (1e-2, 1e6)  # a constant series ends at the upper bound
FIT_SCHEMA = (
    "symptom string, beta array<double>, cov array<double>, log10_penalty array<double>, "
    "phi double, edf double, t_max int, converged boolean"
)


def trend_features(
    df: DataFrame,
    holidays: Sequence[dt.date] = tuple(BANK_HOLIDAYS),
    terms: Sequence[str] = tuple(SEARCH_TERMS),
) -> DataFrame:
    """Weekday (Sunday = 1), holiday flag, day index and row id per series."""
    return (
        filter_symptoms_in(df, terms)
        .withColumn("dotw", F.dayofweek("date"))
        .withColumn("is_bank_holiday", F.col("date").isin(list(holidays)).cast("int"))
        .transform(with_time_index, "date", ["symptom"])
        .transform(add_row_id, "date", ["symptom"])
    )


def _layout(t_max: int):
    evaluate, size = GPBasis(t_max, TREND_LENGTH, BASIS_SIZE).evaluator()
    gp = slice(2, 2 + size)
    week = slice(gp.stop, gp.stop + N_WEEKDAY)
    return evaluate, gp, week, week.stop + 1


def _design(t: np.ndarray, dotw: np.ndarray | None, holiday: np.ndarray | None, t_max: int) -> np.ndarray:
    """Intercept, linear day, smooth, weekday cycle, holiday; the last two stay
    zero when left out."""
    evaluate, gp, week, width = _layout(t_max)
    x = np.zeros((len(t), width))
    x[:, 0] = 1.0
    x[:, 1] = (t - (t_max + 1) / 2) / t_max
    x[:, gp] = evaluate(t)
    if dotw is not None:
        angle = 2 * np.pi * (dotw - 1) / 7
        x[:, week] = np.column_stack([np.sin(angle), np.cos(angle), np.sin(2 * angle)])
        x[:, -1] = holiday
    return x


def _fit_series(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("t")
    t_max = int(pdf["t"].max())
    x = _design(pdf["t"].to_numpy(float), pdf["dotw"].to_numpy(float), pdf["is_bank_holiday"].to_numpy(float), t_max)
    count, y = pdf["n"].to_numpy(float), pdf["y"].to_numpy(float)
    up, down = pdf["log_y"].to_numpy(float), pdf["log_rest"].to_numpy(float)
    _, gp, week, width = _layout(t_max)
    blocks, penalties = [gp, week], [0.0, 0.0]
    eta, beta, phi, done = np.log(y / (1 - y)), None, START_PRECISION, False
    for _ in range(100):
        w, z = _beta_step(eta, phi, count, up - down)
        xw = x * w[:, None]
        gram, rhs, total = xw.T @ x, xw.T @ z, w @ (z * z)
        penalties = choose_penalties(gram, rhs, total, count.sum(), blocks, penalties, "reml")
        penalty = penalty_diagonal(width, blocks, penalties)
        new, cov, edf = solve_penalised(gram, rhs, penalty)
        eta = np.clip(x @ new, -15, 15)
        before, phi = phi, _precision(eta, phi, count, up, down, x, penalty)
        done = beta is not None and np.abs(new - beta).max() < 1e-6 and abs(np.log(phi / before)) < 1e-4
        beta = new
        if done:
            break
    return pd.DataFrame(
        {
            "symptom": [pdf["symptom"].iloc[0]],
            "beta": [beta.tolist()],
            "cov": [cov.ravel().tolist()],
            "log10_penalty": [[float(v) for v in penalties]],
            "phi": [phi],
            "edf": [edf],
            "t_max": [t_max],
            "converged": [bool(done)],
        }
    )


def _beta_step(eta: np.ndarray, phi: float, count: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fisher weights and working response of a beta likelihood; ``logit`` is a
    day's mean of log(y / (1 - y))."""
    p = 1 / (1 + np.exp(-eta))
    slope = p * (1 - p)
    curve = trigamma(p * phi) + trigamma((1 - p) * phi)
    gap = logit - (digamma(p * phi) - digamma((1 - p) * phi))
    return count * phi**2 * curve * slope**2, eta + gap / (phi * curve * slope)


def _precision(eta, phi: float, count, up, down, x: np.ndarray, penalty: np.ndarray) -> float:
    """The precision that maximises the restricted likelihood at ``eta``, by a
    golden section over two units of its log to either side."""
    p = 1 / (1 + np.exp(-eta))

    def value(u: float) -> float:
        f = np.exp(u)
        w, _ = _beta_step(eta, f, count, np.zeros_like(eta))
        fit = log_gamma(np.array(f)) - log_gamma(p * f) - log_gamma((1 - p) * f) + p * f * up + (1 - p) * f * down
        return float(count @ fit - 0.5 * np.linalg.slogdet((x * w[:, None]).T @ x + np.diag(penalty))[1])

    at = np.log(phi)
    lo, hi = max(at - 2, np.log(PRECISION[0])), min(at + 2, np.log(PRECISION[1]))
    ratio = (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    va, vb = value(a), value(b)
    while hi - lo > 1e-5:
        if va < vb:
            lo, a, va = a, b, vb
            b = lo + ratio * (hi - lo)
            vb = value(b)
        else:
            hi, b, vb = b, a, va
            a = hi - ratio * (hi - lo)
            va = value(a)
    return float(np.exp((lo + hi) / 2))


def fit_trend(features: DataFrame) -> DataFrame:
    """Smooth beta regression of value / 100 with a logit link, one per series:
    Fisher scoring for the coefficients and a restricted likelihood for the
    precision ``phi``, in turn; ``converged`` says whether both came to rest.

    Series are independent tasks. Each is first reduced to one row per date
    (count and the means that the likelihood needs), so a task never holds more than the study days.
    """
    y = F.greatest(F.least(F.col("value") / 100, F.lit(1 - EDGE)), F.lit(EDGE))
    days = (
        features.filter(F.col("value").isNotNull())
        .groupBy("symptom", "t", "dotw", "is_bank_holiday")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("y"),
            F.avg(F.log(y)).alias("log_y"),
            F.avg(F.log(1 - y)).alias("log_rest"),
        )
    )
    return days.groupBy("symptom").applyInPandas(_fit_series, FIT_SCHEMA)


def _draw(fit: DataFrame, features: DataFrame, rows, n_draws: int, seed: int, out: str) -> DataFrame:
    """Draws for every feature row: series by series, next to its coefficients.
    Distinct days are computed once and joined back by Spark."""

    def per_series(days: pd.DataFrame, coef: pd.DataFrame) -> pd.DataFrame:
        if coef.empty or days.empty:
            return pd.DataFrame({"symptom": [], "t": [], "_v": []}, dtype=object)
        r = coef.iloc[0]
        beta = np.asarray(r["beta"])
        cov = np.asarray(r["cov"]).reshape(len(beta), len(beta))
        b = normal_draws(beta, cov, n_draws, seeded(seed, r["symptom"]))
        t = days["t"].to_numpy(float)
        values = rows(t, int(r["t_max"]), b)
        return pd.DataFrame({"symptom": r["symptom"], "t": days["t"].to_numpy(), "_v": list(values)})

    days = features.select("symptom", "t").distinct()
    arrays = (
        days.groupBy("symptom")
        .cogroup(fit.groupBy("symptom"))
        .applyInPandas(per_series, "symptom string, t int, _v array<double>")
    )
    return _unpack_draws(features.join(arrays, ["symptom", "t"], "left").withColumnRenamed("_v", "_a"), "_a", out)


def _natural(t: np.ndarray, t_max: int, b: np.ndarray) -> np.ndarray:
    return 100 / (1 + np.exp(-(_design(t, None, None, t_max) @ b.T)))


def trend_samples(fit: DataFrame, features: DataFrame, n_draws: int = N_DRAWS, seed: int = 1) -> DataFrame:
    """Posterior trend (weekday and holiday left out) on the 0-100 scale."""
    return _draw(fit, features, _natural, n_draws, seed, "fitted")


def trend_bands(samples: DataFrame) -> DataFrame:
    """Bands per date and series with the observed value."""
    return bands_with_value(samples, "fitted", ["date", "symptom"])


def trend_derivative_samples(
    fit: DataFrame, features: DataFrame, eps: float = 0.001, n_draws: int = N_DRAWS, seed: int = 1
) -> DataFrame:
    """Central difference of the linear predictor in the day, in percent."""

    def slope(t: np.ndarray, t_max: int, b: np.ndarray) -> np.ndarray:
        up, down = _design(t + eps / 2, None, None, t_max), _design(t - eps / 2, None, None, t_max)
        return 100 * ((up - down) / eps) @ b.T

    return _draw(fit, features, slope, n_draws, seed, "derivative")


def derivative_bands(samples: DataFrame) -> DataFrame:
    return quantile_bands(samples, "derivative", ["date", "symptom"])
