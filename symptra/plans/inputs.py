"""Analysis inputs derived from the driver's tables.

Survey submissions come from orders and customers, search volume from events.
Posterior-like draws are a bootstrap over participant groups: submissions are
first counted per group, then each draw weighs the groups. Work grows with the
tables; the number of draws does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import with_draws
from ..operators.duration import new_symptom_delays
from ..operators.prevalence import (
    poststrat_population,
    poststratify,
    prediction_grid,
    prevalence_cells,
    window_weights,
)
from ..operators.survey import clean_survey
from ..schema import AGE_GROUPS, EXCLUDED_REGION, MODELLED_SYMPTOMS, REGIONS, SUBMISSIONS

N_DRAWS = 20
GROUPS = 32
EVENT_TERMS = {
    "error": "cough",
    "click": "fever",
    "view": "sore_throat",
    "purchase": "shortness_of_breath",
    "signup": "anosmia",
}
_FLAG_RULES = {
    "cough": (31, 11),
    "fever": (37, 23),
    "sore_throat": (41, 13),
    "short_breath": (43, 29),
    "loss_smell": (47, 37),
    "tiredness": (53, 17),
    "headache": (59, 19),
    "muscle_ache": (61, 31),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey submission per order."""
    day = "(o_orderkey * 7 + o_custkey) % 140"
    late = "CASE WHEN o_orderkey % 20 = 0 THEN 50 ELSE 0 END"
    regions = ", ".join(f"'{r}'" for r in [*REGIONS, EXCLUDED_REGION])
    columns = {
        "submission_id": "o_orderkey",
        "participant_id": "o_custkey",
        "submitted_at": f"date_add(DATE '2023-11-01', CAST({day} AS INT))",
        "window_start_date": f"date_add(DATE '2023-11-01', CAST({day} - o_orderkey % 7 AS INT))",
        "symptoms_onset": f"date_add(DATE '2023-11-01', CAST({day} - (o_orderkey * 13) % 15 - {late} AS INT))",
        "sex": "CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END",
        "age": "CAST(3 + o_custkey % 90 AS INT)",
        "rgn21nm": f"element_at(array({regions}), CAST(c_nationkey % 10 + 1 AS INT))",
        "imd_dec": "CAST(1 + o_custkey % 10 AS INT)",
    }
    for s, (a, m) in _FLAG_RULES.items():
        columns[f"symptoms_new_{s}"] = f"(o_orderkey * {a} + o_custkey) % {m} = 0"
        columns[f"symptoms_{s}"] = f"(o_orderkey * {a} + o_custkey) % {m} < 2"
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(*[f"{columns[name]} AS {name}" for name in SUBMISSIONS.names])


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_survey(submissions_raw(spark, sf_dir))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = table(spark, sf_dir, "customer").select((3 + F.col("c_custkey") % 90).cast("int").alias("age")).distinct()
    regions = F.array(*[F.lit(r) for r in REGIONS])
    return ages.select("age", F.posexplode(regions).alias("_i", "region_name")).select(
        "age", "region_name", (5000 + (F.col("age") * 131 + F.col("_i") * 977) % 4000).cast("long").alias("population")
    )


def search_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event counts per type, indexed to the largest day of the type."""
    names = F.create_map(*[F.lit(x) for kv in EVENT_TERMS.items() for x in kv])
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("ts").cast("date").alias("date"), F.try_element_at(names, F.col("event_type")).alias("symptom")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = daily.groupBy("symptom").agg(F.max("n").alias("_top"))
    return daily.join(top, "symptom").select("date", "symptom", (100.0 * F.col("n") / F.col("_top")).alias("value"))


def _weight(group: Column, draw: Column) -> Column:
    """Poisson(1)-like bootstrap weight of a participant group in a draw."""
    h = (group * 7919 + draw * 104729 + group * draw * 31) % 1000
    return F.when(h < 368, 0).when(h < 736, 1).when(h < 920, 2).when(h < 981, 3).otherwise(4)


def prevalence_samples(spark: SparkSession, sf_dir: str, n_draws: int = N_DRAWS) -> DataFrame:
    """Bootstrap prevalence per symptom, date, draw, region and age group."""
    keys = ["submitted_at", "region_name", "age_group"]
    subs = submissions(spark, sf_dir)
    grouped = subs.groupBy(*keys, (F.col("participant_id") % GROUPS).alias("g")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"symptoms_new_{s}").cast("int")).alias(s) for s in MODELLED_SYMPTOMS],
    )
    w = _weight(F.col("g"), F.col("draw"))
    counted = (
        with_draws(grouped, n_draws)
        .groupBy(*keys, "draw")
        .agg(F.sum(F.col("n") * w).alias("n"), *[F.sum(F.col(s) * w).alias(s) for s in MODELLED_SYMPTOMS])
    )
    grid = with_draws(prediction_grid(subs, windows=False).select(*keys), n_draws)
    wide = grid.join(counted, [*keys, "draw"], "left").na.fill(0, ["n", *MODELLED_SYMPTOMS])
    prior = 0.5 + F.dayofmonth("submitted_at") / 100  # empty cells still vary by day
    rates = [((prior + F.col(s)) / (10 + F.col("n"))).alias(s) for s in MODELLED_SYMPTOMS]
    long = wide.select(*keys, "draw", *rates).unpivot([*keys, "draw"], list(MODELLED_SYMPTOMS), "symptom", "p")
    return poststratify(long, poststrat_population(population(spark, sf_dir)))


def duration_samples(spark: SparkSession, sf_dir: str, n_draws: int = N_DRAWS) -> DataFrame:
    """Bootstrap lognormal moments of the observed delays, shrunk towards five
    delays with mu = ln 4 and sigma = 0.7."""
    d = F.ln((F.datediff("submitted_at", "onset") + 1).cast("double"))
    grouped = (
        new_symptom_delays(submissions(spark, sf_dir))
        .groupBy("symptom", "age_group", (F.col("participant_id") % GROUPS).alias("g"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"))
    )
    w = _weight(F.col("g"), F.col("draw"))
    counted = (
        with_draws(grouped, n_draws)
        .groupBy("symptom", "age_group", "draw")
        .agg(*[F.sum(F.col(c) * w).alias(c) for c in ("n", "s1", "s2")])
    )
    strata = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in MODELLED_SYMPTOMS])).alias("symptom"))
    strata = strata.withColumn("age_group", F.explode(F.array(*[F.lit(a) for a in AGE_GROUPS])))
    full = with_draws(strata, n_draws).join(counted, ["symptom", "age_group", "draw"], "left").na.fill(0)
    mu0 = math.log(4.0)
    mu = (5 * mu0 + F.col("s1")) / (5 + F.col("n"))
    second = (5 * (mu0 * mu0 + 0.49) + F.col("s2")) / (5 + F.col("n"))
    return full.select("symptom", "age_group", "draw", mu.alias("mu"), F.sqrt(second - mu * mu).alias("sigma"))


def trend_samples(spark: SparkSession, sf_dir: str, n_draws: int = N_DRAWS) -> DataFrame:
    """Search volume with a draw-specific daily wobble of up to 5 percent."""
    wobble = (F.col("draw") * 7 + F.dayofmonth("date")) % 11 - 5
    return with_draws(search_trends(spark, sf_dir), n_draws).select(
        "date", "symptom", "draw", "value", (F.col("value") * (1 + 0.01 * wobble)).alias("fitted")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence_cells(submissions(spark, sf_dir))


def cell_samples(spark: SparkSession, sf_dir: str, n_draws: int = 4) -> DataFrame:
    """Linear predictors at the observed cells, keyed by grid row."""
    observed = cells(spark, sf_dir)
    keys = ["submitted_at", "age_group", "window_submission", "region_name"]
    grid = prediction_grid(observed).select("row_id", *keys)
    fitted = F.ln((F.col("n_outcome") + 0.5) / (F.col("n_trials") + 10)) + 0.01 * F.col("draw")
    return with_draws(observed.join(grid, keys), n_draws).select("symptom", "row_id", "draw", fitted.alias("fitted"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_weights(cells(spark, sf_dir))


def strata_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poststrat_population(population(spark, sf_dir))
