"""Incidence by deconvolving prevalence with the duration distribution."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lognormal_density, normal_cdf, ratio, strict_sum
from ..functions.frames import one_row_each, quantile_bands
from ..schema import ALL_AGES, DISTRIBUTION_DAYS
from .duration import with_expected_duration

SERIES = ["symptom", "age_group", "draw"]


def delay_pmf(draws: DataFrame, size: int = DISTRIBUTION_DAYS, pmf: str = "density") -> DataFrame:
    """Delay weights for days 0..size of each draw as an array: the density at
    whole days (unnormalised), or interval masses with ``pmf="interval"``."""
    days = F.sequence(F.lit(0), F.lit(size))

    def mass(d: Column) -> Column:
        if pmf == "density":
            return lognormal_density(d, "mu", "sigma")
        upper = normal_cdf((F.ln(d + 1) - F.col("mu")) / F.col("sigma"))
        lower = F.when(d > 0, normal_cdf((F.ln(d) - F.col("mu")) / F.col("sigma"))).otherwise(0.0)
        return upper - lower

    return with_expected_duration(draws).withColumn("delay_pmf", F.transform(days, mass))


def richardson_lucy(
    observed: np.ndarray, pmf: np.ndarray, tol: float, max_iter: int, scale: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deconvolve many series (rows) of equal length at once.

    State covers the ``d`` days before the first observation as well, where
    d + 1 is the number of delay days. It starts from the observations moved
    back by the most likely delay, edges repeated. A series stops when its mean
    (expected - observed)^2 / expected falls below ``tol``. Days whose cases
    cannot have been observed yet come out as NaN. A series with an unknown day
    or delay weight cannot be deconvolved: all its days are NaN.

    Also returns the number of updates and the last mean per series; a series
    has converged if that is below ``tol``.
    """
    rows, n = observed.shape
    known = np.isfinite(observed).all(axis=1) & np.isfinite(pmf).all(axis=1)
    updates, fit = np.zeros(rows, int), np.full(rows, np.nan)
    if not known.all():
        out = np.full((rows, n), np.nan)
        if known.any():
            out[known], updates[known], fit[known] = richardson_lucy(observed[known], pmf[known], tol, max_iter, scale)
        return out, updates, fit
    d = pmf.shape[1] - 1
    data = observed * scale
    mode = pmf.argmax(axis=1)
    source = np.clip(np.arange(d + n)[None, :] - d + mode[:, None], 0, n - 1)
    state = np.maximum(np.take_along_axis(data, source, axis=1), 1e-12 * scale)
    seen = np.zeros((rows, d + n))
    for k in range(d + 1):
        seen[:, d - k : d - k + n] += pmf[:, [k]]
    live = np.ones(rows, bool)
    for _ in range(max_iter):
        s, p, y = state[live], pmf[live], data[live]
        expected = np.zeros_like(y)
        for k in range(d + 1):
            expected += p[:, [k]] * s[:, d - k : d - k + n]
        safe = np.where(expected > 0, expected, 1.0)
        chisq = np.where(expected > 0, (expected - y) ** 2 / safe, 0.0).mean(axis=1)
        ratio = np.where(expected > 0, y / safe, 0.0)
        back = np.zeros_like(s)
        for k in range(d + 1):
            back[:, d - k : d - k + n] += p[:, [k]] * ratio
        q = seen[live]
        update = np.divide(s * back, q, out=np.full_like(s, np.nan), where=q > 0)
        update = np.where(np.isnan(update), s, update)
        going = chisq >= tol
        index = np.flatnonzero(live)
        fit[index] = chisq
        updates[index[going]] += 1
        state[index[going]] = update[going]
        live[index[~going]] = False
        if not live.any():
            break
    state = np.where(seen > 0, state, np.nan)
    return state[:, d:] / scale, updates, fit


def deconvolve(
    prevalence: DataFrame,
    delays: DataFrame,
    tol: float = 1e-4,
    max_iter: int = 32,
    scale: float = 1.0,
    status: bool = False,
) -> DataFrame:
    """Richardson-Lucy incidence for every symptom, age group and draw.

    Each series (one row per study day) is packed into one row; tasks then
    work on batches of series as matrices. ``t`` counts the rows of a series
    from 1. ``scale`` multiplies the data for the stopping rule only. A series
    without delay weights, or with an unknown day, has unknown incidence
    throughout. ``status`` adds the updates made, the last fit (unknown where
    the series was not deconvolved) and whether it fell below ``tol``. Two rows
    for one date in a series end the query.
    """
    parts = int(prevalence.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prevalence.repartition(parts, *SERIES)  # small rows, long work: keep all tasks
    series = spread.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("date", "prevalence", "population"))).alias("_s")
    ).filter(one_row_each("_s", "date"))
    packed = series.select(
        *SERIES,
        F.transform("_s", lambda s: s["prevalence"]).alias("_y"),
        F.col("_s")[0]["population"].alias("population"),
    ).join(delays.select(*SERIES, "exp_dur", "delay_pmf"), SERIES, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["_y"].map(len)
            for _, part in pdf.groupby(lengths):
                y = np.stack([np.asarray(v, float) for v in part["_y"]])
                weights = [None if v is None else np.asarray(v, float) for v in part["delay_pmf"]]
                days = max((len(v) for v in weights if v is not None), default=1)
                pmf = np.stack([np.full(days, np.nan) if v is None else v for v in weights])
                state, updates, fit = richardson_lucy(y, pmf, tol, max_iter, scale)
                out = state / part["exp_dur"].to_numpy(float)[:, None]
                keys = part[[*SERIES, "population"]].reset_index(drop=True)
                yield keys.assign(_i=list(out), updates=updates, fit=fit)

    types = dict(packed.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in [*SERIES, "population"])
    solved = packed.mapInPandas(run, f"{keys}, _i array<double>, updates int, fit double")
    extra = ["updates", "fit"] if status else []
    rows = solved.select(*SERIES, "population", *extra, F.posexplode("_i").alias("_p", "_v"))
    more = [
        "updates",
        F.when(~F.isnan("fit"), F.col("fit")).alias("fit"),
        F.coalesce(~F.isnan("fit") & (F.col("fit") < tol), F.lit(False)).alias("converged"),
    ]
    return rows.select(
        *SERIES,
        "population",
        (F.col("_p") + 1).alias("t"),
        F.when(~F.isnan("_v"), F.col("_v")).alias("incidence"),
        *(more if status else []),
    )


def deconvolution_status(solved: DataFrame) -> DataFrame:
    """Per symptom and age group: series, those that converged, those without
    a solution, and the most updates and the worst fit among them."""
    series = solved.groupBy(*SERIES).agg(
        F.max("updates").alias("updates"), F.max("fit").alias("fit"), F.bool_or("converged").alias("converged")
    )
    return series.groupBy("symptom", "age_group").agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if("converged").alias("n_converged"),
        F.count_if(F.col("fit").isNull()).alias("n_unknown"),
        F.max("updates").alias("most_updates"),
        F.max("fit").alias("worst_fit"),
    )


def assign_dates(df: DataFrame, start: dt.date | Column, date_offset: int = 1) -> DataFrame:
    """date = start + t, one day after the first observation for t = 1;
    ``date_offset=0`` puts t = 1 on the start date itself."""
    start = start if isinstance(start, Column) else F.lit(start)
    return df.withColumn("date", F.date_add(start, F.col("t") - 1 + date_offset)).drop("t")


def national_weighted(df: DataFrame) -> DataFrame:
    """Population-weighted incidence over ages, as age group "All"."""
    return (
        df.groupBy("date", "symptom", "draw")
        .agg(ratio(strict_sum(F.col("incidence") * F.col("population")), strict_sum("population")).alias("incidence"))
        .withColumn("age_group", F.lit(ALL_AGES))
    )


def stack_national(df: DataFrame, national: DataFrame) -> DataFrame:
    return df.unionByName(national, allowMissingColumns=True)


def deconvolution_bands(df: DataFrame, tag: str = "Deconvolution") -> DataFrame:
    """Bands of daily incidence per 1,000 people, unknown values left out."""
    known = df.withColumn("incidence", F.when(~F.isnan("incidence"), F.col("incidence") * 1000))
    return quantile_bands(known, "incidence", ["symptom", "age_group", "date"]).withColumn("data", F.lit(tag))


def align_end_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both methods' bands, cut at the earlier of their last dates per symptom
    and age group."""
    keys = ["symptom", "age_group"]
    both = a.unionByName(b, allowMissingColumns=True)
    last = both.groupBy(*keys, "data").agg(F.max("date").alias("_m")).groupBy(*keys).agg(F.min("_m").alias("_end"))
    return both.join(last, keys).filter(F.col("date") <= F.col("_end")).drop("_end")


def relative_difference(
    combined: DataFrame, probs: Sequence[str] = ("50", "5", "95"), deconvolution: str = "Deconvolution"
) -> DataFrame:
    """(fixed - deconvolved) / deconvolved for each reported quantile."""
    method = F.when(F.col("data") == deconvolution, "d").otherwise("f")
    values = [c for c in combined.columns if c.startswith("pi_")]
    wide = (
        combined.withColumn("_m", method)
        .groupBy("symptom", "age_group", "date")
        .pivot("_m", ["f", "d"])
        .agg(*[F.first(c).alias(c) for c in values])
    )
    wide = wide.withColumnsRenamed({f"{m}_{c}": f"{c}_{m}" for c in values for m in "fd"})
    diffs = {f"diff_{p}": ratio(F.col(f"pi_{p}_f") - F.col(f"pi_{p}_d"), F.col(f"pi_{p}_d")) for p in probs}
    return wide.withColumns(diffs)
