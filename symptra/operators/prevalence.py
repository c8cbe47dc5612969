"""Prevalence: cells, weights, grid, poststratification and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bands, inverse_logit as _inverse_logit, ratio, strict_sum, unpack_bands
from ..functions.frames import attach_group_stats, null_safe_join, stored
from ..schema import AGE_GROUPS, ALL_AGES, MODELLED_SYMPTOMS, REGIONS
from .survey import strip_prefix, with_age_group, with_category_rank

CELL_KEYS = ["age_group", "region_name", "window_submission", "submitted_at"]


def with_time_index(df: DataFrame, date: str = "submitted_at", by: Sequence[str] = ()) -> DataFrame:
    """t = 1 + days since the first date, overall or per group."""
    return (
        attach_group_stats(df, by, F.min(date).alias("_first"))
        .withColumn("t", F.datediff(date, "_first") + 1)
        .drop("_first")
    )


def prevalence_cells(df: DataFrame, symptoms: Sequence[str] = tuple(MODELLED_SYMPTOMS)) -> DataFrame:
    """Trials and outcomes per symptom, age, region, window day and date.

    All outcomes are counted in one wide aggregation, the only scan of the
    survey; the symptom key and the day number appear afterwards, on its stored
    cells.
    """
    wide = df.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n_trials"),
        *[strict_sum(F.col(f"symptoms_new_{s}").cast("int")).alias(s) for s in symptoms],
    )
    cells = stored(wide).unpivot([*CELL_KEYS, "n_trials"], list(symptoms), "symptom", "n_outcome")
    return with_time_index(cells)


def window_weights(cells: DataFrame, weight_by: str = "cells", by: Sequence[str] = ("symptom",)) -> DataFrame:
    """Share of each window day, counting cells (default) or submissions."""
    size = F.count(F.lit(1)) if weight_by == "cells" else F.sum("n_trials")
    counted = cells.groupBy(*by, "window_submission").agg(size.alias("window_n"))
    total = F.sum("window_n").over(W.partitionBy(*by))
    return counted.select(*by, "window_submission", ratio("window_n", total).alias("window_weight"))


def _levels(column: str, order: Sequence[str] | None) -> Column:
    """Distinct values of a column, NULL included, in category order."""
    rank = F.lit(0)
    if order is not None:
        rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.array_sort(F.collect_set(F.struct(rank.alias("rank"), F.col(column).alias("v"))))


def prediction_grid(cells: DataFrame, windows: bool = True) -> DataFrame:
    """Every combination of the observed dates, ages, window days and regions.

    One aggregation gathers the four small value sets, which are then unfolded:
    no cartesian join. Row ids follow the order date, age, window, region.
    """
    dims = [("submitted_at", None), ("age_group", AGE_GROUPS)]
    if windows:
        dims.append(("window_submission", None))
    dims.append(("region_name", REGIONS))
    grid = cells.agg(
        F.min("submitted_at").alias("_first"), *[_levels(c, order).alias(f"_{c}") for c, order in dims]
    )
    row_id = F.lit(0).cast("long")
    for c, _ in dims:
        grid = grid.select(
            *grid.columns, F.posexplode(f"_{c}").alias(f"_i_{c}", f"_e_{c}")
        ).withColumn(c, F.col(f"_e_{c}.v"))
        row_id = row_id * F.size(f"_{c}") + F.col(f"_i_{c}")
    return grid.select(
        (row_id + 1).alias("row_id"),
        *[c for c, _ in dims],
        (F.datediff("submitted_at", "_first") + 1).alias("t"),
        F.lit(0).alias("n_trials"),
    )


def poststrat_population(population: DataFrame) -> DataFrame:
    """Population per age group and region."""
    return with_age_group(population).groupBy("age_group", "region_name").agg(F.sum("population").alias("population"))


def inverse_logit(df: DataFrame, column: str = "fitted", out: str = "p") -> DataFrame:
    """Linear predictor -> probability; the predictor is dropped."""
    return df.withColumn(out, _inverse_logit(column)).drop(column)


def attach_covariates(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Samples with the covariates of their grid row; every grid row is kept."""
    return samples.join(grid, "row_id", "right").transform(with_category_rank, "age_group", AGE_GROUPS, "age_rank")


def reweight_window(samples: DataFrame, weights: DataFrame, by: Sequence[str] = ("symptom",)) -> DataFrame:
    """Average the probabilities over window days with the given weights."""
    keys = [*by, "submitted_at", "draw", "region_name", "age_group"]
    joined = null_safe_join(samples, weights, [*by, "window_submission"], "left")
    return joined.groupBy(*keys).agg(strict_sum(F.col("p") * F.col("window_weight")).alias("p"))


def poststratify(samples: DataFrame, population: DataFrame) -> DataFrame:
    """Attach the stratum population and the expected number of cases. Spark
    broadcasts the strata by their estimated size."""
    pop = population.select("age_group", "region_name", "population")
    return null_safe_join(samples, pop, ["age_group", "region_name"], "left").withColumn(
        "p_n", F.col("p") * F.col("population")
    )


def _rate() -> Column:
    return ratio(strict_sum("p_n"), strict_sum("population")).alias("p")


def _breakdown(samples: DataFrame, extra: Sequence[str], tag: str) -> DataFrame:
    keys = ["symptom", "submitted_at", *extra]
    per_draw = samples.groupBy(*keys, "draw").agg(_rate())
    return per_draw.groupBy(*keys).agg(bands("p")).select(*keys, *unpack_bands(), *_tags(F.lit(tag)))


def _tags(breakdown: Column) -> list[Column]:
    return [F.concat(F.lit("symptoms_new_"), F.col("symptom")).alias("outcome"), breakdown.alias("breakdown")]


def prevalence_by_age(samples: DataFrame) -> DataFrame:
    return _breakdown(samples, ["age_group"], "age")


def prevalence_by_region(samples: DataFrame) -> DataFrame:
    return _breakdown(samples, ["region_name"], "region")


def prevalence_national(samples: DataFrame) -> DataFrame:
    return _breakdown(samples, [], "nation")


def prevalence_summary(samples: DataFrame) -> DataFrame:
    """Age, region and national bands.

    Samples are summed once by age and once by region; the nation adds up the
    age sums, so the long table is never multiplied by the breakdowns.
    """
    base = ["symptom", "submitted_at", "draw"]
    sums = [strict_sum(c).alias(c) for c in ("p_n", "population")]
    none = F.lit(None).cast("string")
    by_age = samples.groupBy(*base, "age_group").agg(*sums)
    by_region = samples.groupBy(*base, "region_name").agg(*sums)
    nation = by_age.groupBy(*base).agg(*sums)
    per_draw = (
        by_age.withColumns({"region_name": none, "breakdown": F.lit("age")})
        .unionByName(by_region.withColumns({"age_group": none, "breakdown": F.lit("region")}))
        .unionByName(nation.withColumns({"age_group": none, "region_name": none, "breakdown": F.lit("nation")}))
        .withColumn("p", ratio("p_n", "population"))
    )
    keys = ["symptom", "submitted_at", "age_group", "region_name", "breakdown"]
    return (
        per_draw.groupBy(*keys)
        .agg(bands("p"))
        .select("submitted_at", "age_group", "region_name", *unpack_bands(), *_tags(F.col("breakdown")))
    )


def _figure(summary: DataFrame, breakdowns: Sequence[str]) -> DataFrame:
    pct = {c: F.col(c) * 100.0 for c in summary.columns if c.startswith("pi_")}
    return (
        summary.filter(F.col("breakdown").isin(list(breakdowns)))
        .withColumns(pct)
        .withColumn("symptom", strip_prefix("outcome", "symptoms_new_"))
    )


def prevalence_age_figure_data(summary: DataFrame) -> DataFrame:
    """Percent bands by age, the nation shown as the age group "All"."""
    age = F.when(F.col("breakdown") == "nation", F.lit(ALL_AGES)).otherwise(F.col("age_group"))
    return (
        _figure(summary, ["age", "nation"])
        .withColumn("age_group", age)
        .transform(with_category_rank, "age_group", [ALL_AGES, *AGE_GROUPS], "age_rank")
    )


def prevalence_region_figure_data(summary: DataFrame) -> DataFrame:
    return _figure(summary, ["region"])


def prevalence_nation_figure_data(summary: DataFrame) -> DataFrame:
    return _figure(summary, ["nation"])
