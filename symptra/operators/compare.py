"""Survey incidence against search volume: growth rates, cross-correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bands, format_interval, ratio, strict_sum, unpack_bands
from ..functions.frames import one_row_each, quantile_bands
from ..schema import AGE_GROUPS_WITH_ALL, ALL_AGES, BANDS_90, FIGURE_ORDER, MODELLED_SYMPTOMS, SEARCH_TAG
from .survey import filter_symptoms_regex, harmonise_symptoms, label_symptoms, with_category_rank

SERIES = ["symptom", "age_group", "draw"]
FLAT = 1e-9  # relative spread below which a series counts as constant


def aggregate_draws(incidence: DataFrame) -> DataFrame:
    """Incidence and population per symptom, date, age group and draw."""
    return incidence.groupBy("symptom", "date", "age_group", "draw").agg(
        strict_sum("incidence").alias("incidence"), strict_sum("population").alias("population")
    )


def with_all_ages(incidence: DataFrame) -> DataFrame:
    """Age rows plus their total as age group "All", in one aggregation."""
    base = ["symptom", "date", "draw"]
    return incidence.groupingSets([[*base, "age_group"], base], *base, "age_group").agg(
        strict_sum("incidence").alias("incidence"),
        strict_sum("population").alias("population"),
        F.grouping("age_group").alias("_total"),
    ).select(
        *base,
        F.when(F.col("_total") == 1, F.lit(ALL_AGES)).otherwise(F.col("age_group")).alias("age_group"),
        "incidence",
        "population",
    )


def per_capita_bands(samples: DataFrame, tag: str | None = None) -> DataFrame:
    """Bands of daily incidence per 1,000 people; tagged by age group or ``tag``."""
    rate = samples.withColumn("incidence", ratio(F.col("incidence") * 1000, "population"))
    return quantile_bands(rate, "incidence", ["symptom", "age_group", "date"]).withColumn(
        "data", F.col("age_group") if tag is None else F.lit(tag)
    )


def _growth_rates(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """Daily change relative to the current value, in percent, without the
    first date of each series. A series is bounded by the study days. A date
    that occurs twice in a series has no rate: the query fails when run."""
    w = W.partitionBy(*keys).orderBy("date")
    prev = df.withColumns({"_d": F.lag("date").over(w), "_v": F.lag(value).over(w)})
    days = F.datediff("date", "_d")
    error = F.raise_error(F.lit("a series has two rows for one date")).cast("int")
    return (
        prev.filter(F.col("_d").isNotNull())
        .withColumn("diff_time", F.when(days == 0, error).otherwise(days).cast("double"))
        .withColumn("diff_incidence", F.col(value) - F.col("_v"))
        .withColumn(out, ratio(F.col("diff_incidence") / F.col("diff_time"), value) * 100)
        .drop("_d", "_v")
    )


def survey_growth_rates(samples: DataFrame) -> DataFrame:
    return _growth_rates(samples, "incidence", SERIES, "survey_gr")


def survey_growth_bands(growth: DataFrame) -> DataFrame:
    return quantile_bands(growth, "survey_gr", ["symptom", "age_group", "date"]).withColumn("data", F.col("age_group"))


def trend_draws(trends: DataFrame) -> DataFrame:
    """Search samples under survey symptom codes, modelled symptoms only."""
    return (
        trends.withColumn("data", F.lit(SEARCH_TAG))
        .transform(harmonise_symptoms)
        .transform(filter_symptoms_regex, MODELLED_SYMPTOMS)
    )


def bands_with_value(df: DataFrame, measure: str, keys: Sequence[str]) -> DataFrame:
    """Bands over the whole group plus the observed value, the row repeated
    for each distinct value if a group has several."""
    return (
        df.groupBy(*keys)
        .agg(bands(measure), F.array_sort(F.collect_set(F.struct("value"))).alias("_values"))
        .select(*keys, *unpack_bands(), F.explode("_values.value").alias("value"))
    )


def trend_compare_bands(draws: DataFrame) -> DataFrame:
    return bands_with_value(draws, "fitted", ["date", "symptom"]).withColumn("data", F.lit(SEARCH_TAG))


def trend_growth_rates(draws: DataFrame) -> DataFrame:
    return _growth_rates(draws, "fitted", ["symptom", "draw"], "search_gr")


def trend_growth_bands(growth: DataFrame) -> DataFrame:
    return quantile_bands(growth, "search_gr", ["date", "symptom"]).withColumn("data", F.lit(SEARCH_TAG))


def _figure(survey: DataFrame, search: DataFrame) -> DataFrame:
    return survey.unionByName(search, allowMissingColumns=True).transform(
        with_category_rank, "data", FIGURE_ORDER, "data_rank"
    )


def incidence_figure_data(survey_bands: DataFrame, trend_bands: DataFrame) -> DataFrame:
    return _figure(survey_bands, trend_bands)


def growth_figure_data(survey_bands: DataFrame, trend_bands: DataFrame) -> DataFrame:
    return _figure(survey_bands, trend_bands)


def join_draws(survey: DataFrame, trend: DataFrame) -> DataFrame:
    """Survey and search draws on symptom, date and draw index. Columns of the
    search side that the survey side also has are dropped."""
    keys = ["symptom", "date", "draw"]
    clash = [c for c in trend.columns if c in survey.columns and c not in keys]
    return survey.join(trend.drop(*clash), keys, "inner")


def cross_correlation(
    df: DataFrame,
    x: str,
    y: str,
    keys: Sequence[str] = tuple(SERIES),
    order: str = "date",
    max_lag: int | None = None,
) -> DataFrame:
    """Lagged cross-correlation per series: lag k pairs x at position i + k
    with y at position i; means and variances are those of the full series.

    Lags count rows. By default the largest is floor(10 (log10 n - log10 2)),
    at most n - 1. Constant series give NaN. Each series (at most one row per study day) becomes one row
    of two arrays, so one shuffle serves all lags and no row pairs are built.
    """
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")))).alias(
            "_s"
        )
    )
    return _correlate(packed.filter(one_row_each("_s", "o")), keys, max_lag)


def correlate_draws(
    survey: DataFrame, trend: DataFrame, x: str, y: str, on: Sequence[str] = ("symptom", "draw"), max_lag: int | None = None
) -> DataFrame:
    """The cross-correlation of survey and search draws on their common dates.

    Each side is first packed to one array row per series, so the join meets
    series, not days; the dates are matched inside the row. Search series
    without gaps are read by their day number, others by a look through the
    array. Two rows for one date in a series end the query."""
    on = list(on)

    def packed(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
        rows = F.collect_list(F.struct(F.col("date").alias("o"), F.col(value).cast("double").alias("v")))
        return df.groupBy(*keys).agg(F.array_sort(rows).alias(out)).filter(one_row_each(out, "o"))

    both = packed(survey, x, SERIES, "_x").join(packed(trend, y, on, "_y"), on)
    other = F.col("_y")

    def match(s: Column) -> Column:
        place = F.get(other, F.datediff(s["o"], other[0]["o"]))
        found = F.when(place["o"] == s["o"], place).otherwise(F.get(F.filter(other, lambda t: t["o"] == s["o"]), F.lit(0)))
        return F.struct(s["o"].alias("o"), s["v"].alias("x"), found.alias("t"))

    series = F.filter(F.transform("_x", match), lambda s: s["t"].isNotNull())
    pairs = F.transform(series, lambda s: F.struct(s["o"].alias("o"), s["x"].alias("x"), s["t"]["v"].alias("y")))
    merged = both.select(*SERIES, pairs.alias("_s")).filter(F.size("_s") > 0)
    return _correlate(merged, SERIES, max_lag)


def _correlate(packed: DataFrame, keys: Sequence[str], max_lag: int | None) -> DataFrame:
    """Lagged correlations of the arrays ``_s`` of (o, x, y)."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    def root(name: str) -> Column:
        return F.sqrt(total(F.transform(name, lambda v: v * v)))

    def values(name: str) -> Column:
        return F.transform("_s", lambda s: s[name].cast("double"))

    lag = F.lit(max_lag)
    if max_lag is None:
        lag = F.floor((F.log10("_n") - math.log10(2)) * 10).cast("int")
    series = (
        packed.select(*keys, F.size("_s").alias("_n"), values("x").alias("_x"), values("y").alias("_y"))
        .withColumns({"_mx": total(F.col("_x")) / F.col("_n"), "_my": total(F.col("_y")) / F.col("_n")})
        .select(
            *keys,
            "_n",
            "_mx",
            "_my",
            F.transform("_x", lambda v: v - F.col("_mx")).alias("_x"),
            F.transform("_y", lambda v: v - F.col("_my")).alias("_y"),
            F.greatest(F.least(lag, F.col("_n") - 1), F.lit(0)).alias("_l"),
        )
        .withColumns({"_sx": root("_x"), "_sy": root("_y")})
    )
    flat = (F.col("_sx") <= F.abs("_mx") * FLAT * F.sqrt("_n")) | (F.col("_sy") <= F.abs("_my") * FLAT * F.sqrt("_n"))
    shift = F.col("lag")
    n_pairs = F.col("_n") - F.abs(shift)
    left = F.slice("_x", F.greatest(shift, F.lit(0)) + 1, n_pairs)
    right = F.slice("_y", F.greatest(-shift, F.lit(0)) + 1, n_pairs)
    cross = total(F.zip_with(left, right, lambda a, b: a * b))
    return series.withColumn("lag", F.explode(F.sequence(-F.col("_l"), F.col("_l")))).select(
        *keys,
        "lag",
        F.when(flat, F.lit(float("nan"))).otherwise(cross / (F.col("_sx") * F.col("_sy"))).alias("ccf"),
    )


def ccf_bands(ccf: DataFrame) -> DataFrame:
    """Bands per lag over the draws whose correlation is defined."""
    return quantile_bands(ccf.filter(~F.isnan("ccf")), "ccf", ["symptom", "age_group", "lag"])


def max_per_draw(ccf: DataFrame, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Largest correlation of each draw and its lag, the smallest lag on ties
    (to nine decimals). Undefined correlations are left out."""
    rank = F.struct(F.round("ccf", 9).alias("c"), (-F.col("lag")).alias("l"))
    return (
        ccf.filter(~F.isnan("ccf"))
        .groupBy(*keys)
        .agg(F.max_by("lag", rank).alias("lag"), F.max("ccf").alias("ccf"))
    )


def max_bands(tops: DataFrame) -> DataFrame:
    """Quantiles of the draws' largest correlations and of their lags, in one
    aggregation of :func:`max_per_draw`; the tables below derive from it."""
    keys = ["symptom", "age_group"]
    return (
        tops.groupBy(*keys)
        .agg(bands("ccf", "ccf_pi_", BANDS_90), bands("lag", "lag_pi_", BANDS_90))
        .select(*keys, *unpack_bands("ccf_pi_", BANDS_90), *unpack_bands("lag_pi_", BANDS_90))
    )


def max_lag(ccf: DataFrame) -> DataFrame:
    return quantile_bands(max_per_draw(ccf), "lag", ["symptom", "age_group"], "lag_pi_", BANDS_90)


def max_corr(ccf: DataFrame) -> DataFrame:
    return quantile_bands(max_per_draw(ccf), "ccf", ["symptom", "age_group"], "ccf_pi_", BANDS_90)


def interval_table(bands_df: DataFrame, prefix: str, digits: int = 2) -> DataFrame:
    """Symptoms by age groups, cells "median [5%, 95%]"."""
    text = bands_df.withColumn("value", format_interval(f"{prefix}50", f"{prefix}5", f"{prefix}95", digits))
    return text.groupBy("symptom").pivot("age_group", AGE_GROUPS_WITH_ALL).agg(F.first("value"))


def max_lag_table(ccf: DataFrame, digits: int = 2) -> DataFrame:
    """Symptoms by age groups, cells "median lag [5%, 95%]"."""
    return interval_table(max_lag(ccf), "lag_pi_", digits)


def max_corr_table(ccf: DataFrame, digits: int = 2) -> DataFrame:
    return interval_table(max_corr(ccf), "ccf_pi_", digits)


def maxima_figure_data(both: DataFrame) -> DataFrame:
    """Labels and ranks for the two-dimensional figure, from :func:`max_bands`."""
    return (
        both.transform(label_symptoms, out="symptom")
        .transform(with_category_rank, "age_group", AGE_GROUPS_WITH_ALL, "age_rank")
        .withColumn("is_national", F.when(F.col("age_group") == ALL_AGES, "A").otherwise("B"))
    )


def max_ccf_2d(ccf: DataFrame) -> DataFrame:
    """Quantiles of the maximal correlation and of its lag side by side."""
    return maxima_figure_data(max_bands(max_per_draw(ccf)))
