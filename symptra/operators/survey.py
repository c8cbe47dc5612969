"""Survey cleaning: projections, derived columns, filters, categories, labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, with_range_bucket
from ..schema import (
    AGE_GROUPS,
    EXCLUDED_REGION,
    ILI_SYMPTOMS,
    MODELLED_SYMPTOMS,
    REGIONS,
    SEARCH_TO_SURVEY,
    STUDY_END,
    STUDY_START,
    SURVEY_COLUMNS,
    SURVEY_PREFIXES,
    SYMPTOM_LABELS,
)


def select_survey_columns(df: DataFrame, keep: Sequence[str] = ("submission_id",)) -> DataFrame:
    """Named survey columns plus every ``window*`` and ``symptoms*`` column."""
    named = [c for c in (*keep, *SURVEY_COLUMNS) if c in df.columns]
    grouped = [c for p in SURVEY_PREFIXES for c in df.columns if c.startswith(p) and c not in named]
    return df.select(*named, *grouped)


def add_relative_days(df: DataFrame) -> DataFrame:
    """Whole days from window start and from symptom onset to submission."""
    return df.withColumns(
        {
            "window_submission": F.datediff("submitted_at", "window_start_date"),
            "symptoms_submission": F.datediff("submitted_at", "symptoms_onset"),
        }
    )


def add_weekday(df: DataFrame, date: str = "submitted_at") -> DataFrame:
    """Weekday label with its rank (Sunday = 1)."""
    return df.withColumns({"wday": F.date_format(date, "EEE"), "wday_rank": F.dayofweek(date)})


def add_any_flag(
    df: DataFrame, prefix: str = "symptoms_new", symptoms: Sequence[str] = tuple(ILI_SYMPTOMS)
) -> DataFrame:
    """Three-valued OR over the symptom flags, as ``<prefix>_any``."""
    return df.withColumn(f"{prefix}_any", F.expr(" OR ".join(f"`{prefix}_{s}`" for s in symptoms)))


def add_ili_count(df: DataFrame, symptoms: Sequence[str] = tuple(ILI_SYMPTOMS)) -> DataFrame:
    """Number of new symptoms; NULL as soon as one flag is NULL."""
    total = " + ".join(f"CAST(`symptoms_new_{s}` AS INT)" for s in symptoms)
    return df.withColumn("symptoms_count_new_ili", F.expr(total))


def add_row_id(
    df: DataFrame,
    order: str,
    partition: Sequence[str] = (),
    column: str = "row_id",
    buckets: int | None = None,
) -> DataFrame:
    """Row number by ``order`` (a unique number or date), global or per group.

    One window over everything would sort the table in a single task. Instead
    value ranges of about equal size are numbered on their own, and the counts
    of the earlier ranges are added.
    """
    keys = list(partition)
    ranged = with_range_bucket(df, order, buckets)
    counts = ranged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_pos", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(F.asc_nulls_last(order))))
    return (
        null_safe_join(numbered, offsets, [*keys, "_bucket"], "left")
        .withColumn(column, F.col("_before") + F.col("_pos"))
        .drop("_bucket", "_pos", "_before")
    )


def with_age_group(df: DataFrame, age: str = "age", null_age: str | None = AGE_GROUPS[-1]) -> DataFrame:
    """Seven age bands. An unknown age falls in the last band unless
    ``null_age`` says otherwise (None keeps it NULL)."""
    uppers = [17, 34, 44, 54, 64, 74]
    a = F.col(age)
    band = F.when(a.isNull(), F.lit(null_age))
    for upper, label in zip(uppers, AGE_GROUPS):
        band = band.when(a < upper + 1 if upper == 17 else a <= upper, F.lit(label))
    return df.withColumn("age_group", band.otherwise(F.lit(AGE_GROUPS[-1])))


def filter_study(
    df: DataFrame,
    start: dt.date = STUDY_START,
    end: dt.date = STUDY_END,
    exclude_region: str = EXCLUDED_REGION,
) -> DataFrame:
    """Submissions inside the half-open study window, outside one region.
    Rows with a NULL region or date are dropped."""
    return df.filter(
        (F.col("rgn21nm") != exclude_region)
        & (F.col("submitted_at") >= F.lit(start))
        & (F.col("submitted_at") < F.lit(end))
    )


def with_category_rank(df: DataFrame, column: str, levels: Sequence[str], rank: str | None = None) -> DataFrame:
    """Ordered category: adds its 1-based rank; a value outside the levels
    becomes NULL, as does its rank."""
    listed = F.array(*[F.lit(v) for v in levels])
    pos = F.nullif(F.array_position(listed, F.col(column)), F.lit(0)).cast("int")
    return df.withColumns(
        {rank or f"{column}_rank": pos, column: F.when(pos.isNotNull(), F.col(column))}
    )


def first_underscore_to_space(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^([^_]*)_", "$1 ")


def underscores_to_spaces(c: Column | str) -> Column:
    return F.regexp_replace(c, "_", " ")


def sentence_case(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def strip_prefix(c: Column | str, prefix: str) -> Column:
    return F.regexp_replace(c, f"^{prefix}", "")


def strip_years(c: Column | str) -> Column:
    """Drop the first " years" of an age label."""
    return F.regexp_replace(c, r"^(.*?) years", "$1")


def clean_labels(df: DataFrame, column: str, prefix: str = "symptoms_new_", out: str = "label") -> DataFrame:
    """Column-name style code -> sentence-case label."""
    return df.withColumn(out, sentence_case(first_underscore_to_space(strip_prefix(column, prefix))))


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def label_symptoms(df: DataFrame, column: str = "symptom", out: str = "symptom_label") -> DataFrame:
    """Display label of a symptom code; NULL for an unknown code."""
    return df.withColumn(out, F.try_element_at(_lookup(SYMPTOM_LABELS), F.col(column)))


def harmonise_symptoms(df: DataFrame, column: str = "symptom") -> DataFrame:
    """Search-term names -> survey codes; other names are kept."""
    return df.withColumn(
        column, F.coalesce(F.try_element_at(_lookup(SEARCH_TO_SURVEY), F.col(column)), F.col(column))
    )


def filter_symptoms_regex(
    df: DataFrame, symptoms: Sequence[str] = tuple(MODELLED_SYMPTOMS), column: str = "symptom"
) -> DataFrame:
    """Rows whose symptom contains one of the names."""
    return df.filter(F.col(column).rlike("|".join(symptoms)))


def filter_symptoms_in(df: DataFrame, symptoms: Sequence[str], column: str = "symptom") -> DataFrame:
    return df.filter(F.col(column).isin(list(symptoms)))


def rename_by_rule(df: DataFrame, rule: Mapping[str, str] | None = None) -> DataFrame:
    """Rename columns by dictionary, or by default: ongoing flags get an
    ``ongoing_`` prefix and every other ``symptoms_`` prefix goes."""
    if rule is None:
        rule = {}
        for c in df.columns:
            if c.startswith("symptoms_new_"):
                rule[c] = c.replace("symptoms_", "", 1)
            elif c.startswith("symptoms_") and any(s in c for s in ILI_SYMPTOMS):
                rule[c] = c.replace("symptoms_", "ongoing_", 1)
            elif c.startswith("symptoms_"):
                rule[c] = c.replace("symptoms_", "", 1)
    return df.withColumnsRenamed(dict(rule))


def clean_survey(df: DataFrame) -> DataFrame:
    """Raw extract -> analysis table (all steps but the row id)."""
    return (
        df.transform(select_survey_columns)
        .transform(add_relative_days)
        .transform(add_weekday)
        .transform(add_any_flag, "symptoms_new")
        .transform(add_any_flag, "symptoms")
        .transform(add_ili_count)
        .transform(with_age_group)
        .transform(filter_study)
        .withColumn("region_name", F.col("rgn21nm"))
        .transform(with_category_rank, "region_name", REGIONS, "region_rank")
        .transform(with_category_rank, "age_group", AGE_GROUPS, "age_rank")
    )
