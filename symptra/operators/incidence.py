"""Incidence by shifting prevalence back half the expected duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, strict, strict_sum
from ..functions.frames import attach_group_stats, quantile_bands
from .survey import first_underscore_to_space


def prevalence_age_draws(samples: DataFrame) -> DataFrame:
    """Prevalence and population per symptom, date, draw and age group."""
    return samples.groupBy("symptom", F.col("submitted_at").alias("date"), "draw", "age_group").agg(
        ratio(strict_sum("p_n"), strict_sum("population")).alias("prevalence"),
        strict_sum("population").alias("population"),
    )


def _half(c: Column) -> Column:
    return F.bround(c / 2, 0).cast("int")


def backshift_incidence(prevalence: DataFrame, durations: DataFrame) -> DataFrame:
    """New cases per day, dated half an expected duration earlier.

    Draws of the two posteriors are paired by index. ``report_date`` keeps the
    date before the shift.
    """
    return (
        prevalence.join(
            durations.select("symptom", "age_group", "draw", "mu", "sigma", "exp_dur"),
            ["symptom", "age_group", "draw"],
            "left",
        )
        .withColumn("incidence", ratio(F.col("prevalence") * F.col("population"), "exp_dur"))
        .withColumn("report_date", F.col("date"))
        .withColumn("date", F.date_sub("report_date", _half(F.col("exp_dur"))))
    )


def trim_common_support(shifted: DataFrame) -> DataFrame:
    """Keep the dates every age group and draw of a symptom can cover; bounds
    use the dates before the shift. A symptom with an unmatched draw has no
    bounds and is dropped."""
    return (
        attach_group_stats(
            shifted,
            ["symptom"],
            F.min("report_date").alias("_d0"),
            F.max("report_date").alias("_d1"),
            strict(F.min, "exp_dur").alias("_e0"),
            strict(F.max, "exp_dur").alias("_e1"),
        )
        .withColumn("min_date", F.date_sub("_d0", _half(F.col("_e0"))))
        .withColumn("max_date", F.date_sub("_d1", _half(F.col("_e1"))))
        .filter(F.col("date").between(F.col("min_date"), F.col("max_date")))
        .drop("_d0", "_d1", "_e0", "_e1", "report_date")
    )


def incidence_national(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("symptom", "date", "draw").agg(
        strict_sum("incidence").alias("incidence"), strict_sum("population").alias("population")
    )


def _labelled_bands(df: DataFrame, keys: list[str]) -> DataFrame:
    return quantile_bands(df, "incidence", keys, "incidence_q").withColumn(
        "symptom", first_underscore_to_space("symptom")
    )


def incidence_age_bands(incidence: DataFrame) -> DataFrame:
    return _labelled_bands(incidence, ["symptom", "date", "age_group"])


def incidence_national_bands(national: DataFrame) -> DataFrame:
    return _labelled_bands(national, ["symptom", "date"])
