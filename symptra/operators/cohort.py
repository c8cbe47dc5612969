"""Cohort description tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import MAX_WAVES, MODELLED_SYMPTOMS
from .survey import clean_labels, strip_years


def with_imd_quintile(df: DataFrame) -> DataFrame:
    """Deprivation quintile from the decile, which is dropped."""
    return df.withColumn("imd_quint", F.ceil(F.col("imd_dec") / 2).cast("int")).drop("imd_dec")


def _level_shares(df: DataFrame, variables: Mapping[str, str]) -> DataFrame:
    """n and percentage per level of each variable.

    Rows are first counted per combination of all variables, so only that
    small table is unpivoted and shuffled again.
    """
    counted = df.groupBy(*[F.col(c).cast("string").alias(name) for name, c in variables.items()]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    levels = (
        counted.unpivot(["_n"], list(variables), "variable", "level")
        .groupBy("variable", "level")
        .agg(F.sum("_n").alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("variable"))
    return levels.withColumn("percent", F.col("n") * 100.0 / total)


def demographics_table(df: DataFrame, include_dates: bool = False) -> DataFrame:
    """n and % per level of sex, age group, region and deprivation quintile
    (and of the submission date, when it counts as categorical)."""
    df = df.withColumn("age_group", strip_years("age_group"))
    variables = {"Sex": "sex", "Age group": "age_group", "Region": "rgn21nm", "IMD quintile": "imd_quint"}
    if include_dates:
        variables = {"submitted_at": "submitted_at", **variables}
    return _level_shares(df, variables)


def symptom_table(df: DataFrame, symptoms: Sequence[str] = tuple(MODELLED_SYMPTOMS)) -> DataFrame:
    """n and % of TRUE / FALSE / unknown per new-symptom flag."""
    shares = _level_shares(df, {f"symptoms_new_{s}": f"symptoms_new_{s}" for s in symptoms})
    return shares.transform(clean_labels, "variable", out="symptom").drop("variable")


def waves_table(df: DataFrame, max_waves: int = MAX_WAVES) -> DataFrame:
    """Participants by number of submissions; counts above the number of waves
    form the NULL level."""
    waves = df.groupBy("participant_id").agg(F.count(F.lit(1)).alias("_n"))
    levels = waves.groupBy(F.when(F.col("_n").between(1, max_waves), F.col("_n")).cast("int").alias("waves")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return levels.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def count_participants(df: DataFrame) -> DataFrame:
    """Distinct participants; an unknown id counts as one more."""
    return df.agg(
        (
            F.countDistinct("participant_id")
            + F.coalesce(F.max(F.col("participant_id").isNull().cast("int")), F.lit(0))
        ).alias("n_participants")
    )


def count_submissions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_submissions"))
