"""Symptom duration: censored delay cells, densities, summaries, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bands, format_interval, lognormal_density, unpack_bands
from ..functions.frames import attach_group_stats, quantile_bands
from ..schema import (
    AGE_GROUPS,
    BANDS,
    ILI_SYMPTOMS,
    MAX_DURATION_DAYS,
    MODELLED_SYMPTOMS,
    WINDOW_EXTENSION,
    WINDOW_EXTENSIONS,
)
from .survey import filter_symptoms_regex, label_symptoms

STRATA = ["symptom", "age_group"]
INTERVAL = ["pdate_lwr", "pdate_upr", "sdate_lwr", "sdate_upr"]


def unpivot_symptoms(df: DataFrame, symptoms: Sequence[str] = tuple(ILI_SYMPTOMS), only_new: bool = False) -> DataFrame:
    """One row per submission and symptom with its new / ongoing flags.

    ``only_new`` drops the other symptoms inside the array, before any row is
    multiplied.
    """
    flags = F.array(
        *[
            F.struct(
                F.lit(s).alias("symptom"),
                F.col(f"symptoms_new_{s}").alias("new"),
                F.col(f"symptoms_{s}").alias("ongoing"),
            )
            for s in symptoms
        ]
    )
    if only_new:
        flags = F.filter(flags, lambda f: f["new"])
    keep = ["submitted_at", "participant_id", F.col("symptoms_onset").alias("onset"), "age_group"]
    return df.select(*keep, F.inline(flags))


def filter_new_short(df: DataFrame, max_days: int = MAX_DURATION_DAYS, min_duration: int | None = None) -> DataFrame:
    """New modelled symptoms with less than ``max_days`` from onset to the day
    after submission. Onsets after submission pass unless ``min_duration``."""
    days = F.datediff("submitted_at", "onset") + 1
    out = filter_symptoms_regex(df, MODELLED_SYMPTOMS).filter(F.col("new") & (days < max_days))
    return out if min_duration is None else out.filter(days >= min_duration)


def new_symptom_delays(df: DataFrame) -> DataFrame:
    """Cleaned submissions -> rows of new, short, modelled symptoms."""
    return filter_new_short(unpivot_symptoms(df, MODELLED_SYMPTOMS, only_new=True))


def empirical_duration(df: DataFrame) -> DataFrame:
    """n and share (within symptom and age) of each observed duration."""
    counted = (
        df.withColumn("duration", F.datediff("submitted_at", "onset") + 1)
        .groupBy("symptom", "age_group", "duration")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*STRATA)))


def _with_intervals(df: DataFrame, extension: Column) -> DataFrame:
    return df.withColumns(
        {
            "pdate_lwr": F.col("onset"),
            "pdate_upr": F.date_add("onset", 1),
            "sdate_lwr": F.date_add("submitted_at", 1),
            "sdate_upr": F.date_add("submitted_at", F.lit(2) + extension),
        }
    )


def duration_cells(df: DataFrame, window_extension: int = WINDOW_EXTENSION) -> DataFrame:
    """Counts per censoring interval: onset within a day, end within the day
    after submission plus the extension."""
    counted = df.groupBy(*STRATA, "onset", "submitted_at").agg(F.count(F.lit(1)).alias("n"))
    return _with_intervals(counted, F.lit(window_extension)).select(*STRATA, *INTERVAL, "n")


def duration_cells_by_extension(df: DataFrame, extensions: Sequence[int] = tuple(WINDOW_EXTENSIONS)) -> DataFrame:
    """The same cells once per window extension, counted only once."""
    counted = df.groupBy(*STRATA, "onset", "submitted_at").agg(F.count(F.lit(1)).alias("n"))
    fanned = counted.withColumn("window_extension", F.explode(F.array(*[F.lit(e) for e in extensions])))
    return _with_intervals(fanned, F.col("window_extension")).select("window_extension", *STRATA, *INTERVAL, "n")


def delay_cells(
    cells: DataFrame, by: Sequence[str] = ("symptom",), obs_time_threshold: float | None = None
) -> DataFrame:
    """Delays relative to the start of the onset interval, re-aggregated.

    The observation time is the last end-interval bound of the model (one per
    ``by`` group). With ``obs_time_threshold``, observation times beyond that
    multiple of the longest delay become NULL, i.e. not truncated.
    """
    by = list(by)
    keys = [*[k for k in by if k not in STRATA], *STRATA]
    pre = cells.groupBy(
        *keys,
        F.datediff("sdate_lwr", "pdate_lwr").alias("delay_lwr"),
        F.datediff("sdate_upr", "pdate_lwr").alias("delay_upr"),
        F.datediff("pdate_upr", "pdate_lwr").alias("pwindow"),
        F.datediff("sdate_upr", "sdate_lwr").alias("swindow"),
        "pdate_lwr",
        "sdate_upr",
    ).agg(F.sum("n").alias("n"))
    timed = attach_group_stats(
        pre, by, F.max("sdate_upr").alias("_obs"), F.max("delay_upr").alias("_longest")
    ).withColumn("relative_obs_time", F.datediff("_obs", "pdate_lwr"))
    if obs_time_threshold is not None:
        near = F.col("relative_obs_time") <= F.col("_longest") * obs_time_threshold
        timed = timed.withColumn("relative_obs_time", F.when(near, F.col("relative_obs_time")))
    return timed.groupBy(*keys, "delay_lwr", "delay_upr", "pwindow", "swindow", "relative_obs_time").agg(
        F.sum("n").alias("n")
    )


def with_expected_duration(draws: DataFrame) -> DataFrame:
    """Mean of the lognormal."""
    return draws.withColumn("exp_dur", F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2))


def mean_duration_by_age(draws: DataFrame, keys: Sequence[str] = tuple(STRATA)) -> DataFrame:
    return with_expected_duration(draws).groupBy(*keys).agg(F.avg("exp_dur").alias("mean_dur"))


def density_grid(draws: DataFrame, low: float = 0.0, high: float = 100.0, step: float = 0.5) -> DataFrame:
    """Every draw at evenly spaced durations with its lognormal density."""
    n = int(round((high - low) / step))
    points = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(low) + i * F.lit(step))
    return draws.withColumn("duration", F.explode(points)).withColumn(
        "density", lognormal_density("duration", "mu", "sigma")
    )


def density_bands(grid: DataFrame, keys: Sequence[str] = tuple(STRATA)) -> DataFrame:
    return quantile_bands(grid, "density", [*keys, "duration"])


def duration_summary(draws: DataFrame, keys: Sequence[str] = tuple(STRATA)) -> DataFrame:
    """Mean and quantiles of the expected duration."""
    return (
        with_expected_duration(draws)
        .groupBy(*keys)
        .agg(F.avg("exp_dur").alias("mean"), bands("exp_dur", "q"))
        .select(*keys, "mean", *unpack_bands("q", BANDS))
    )


def mean_duration_table(draws: DataFrame, digits: int = 3, pad: bool = True) -> DataFrame:
    """Symptoms by age groups, cells "mean [q5, q95]"."""
    text = (
        duration_summary(draws)
        .withColumn("duration", format_interval("mean", "q5", "q95", digits, pad))
        .transform(label_symptoms, out="symptom")
    )
    return text.groupBy("symptom").pivot("age_group", AGE_GROUPS).agg(F.first("duration"))

