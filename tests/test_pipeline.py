"""All stages on the small tables: every table is written and not empty."""

from pathlib import Path

from symptra.plans import inputs
from symptra.plans.pipeline import Pipeline

TABLES = [
    "demographics", "symptoms", "waves", "participants", "submissions",
    "prevalence_status", "prevalence_summary", "prevalence_age_figure", "prevalence_region_figure", "prevalence_nation_figure",
    "impossible_delays", "duration_density", "duration_summary", "mean_duration",
    "duration_variants_summary", "duration_variants_density",
    "incidence_age", "incidence_national", "search_summary", "search_growth",
    "incidence_comparison", "growth_comparison", "max_lags_incidence", "max_corrs_gr", "max_2d_incidence", "max_2d_gr",
    "deconvolution_status", "methods", "method_difference",
]


def test_every_stage_writes_its_tables(spark, sf_dir, tmp_path):
    Pipeline(
        spark,
        inputs.submissions_raw(spark, sf_dir),
        inputs.population(spark, sf_dir),
        inputs.search_trends(spark, sf_dir),
        str(tmp_path),
        n_draws=8,
    ).run()
    for name in TABLES:
        assert (Path(tmp_path) / name / "_SUCCESS").exists(), name
        assert spark.read.csv(str(tmp_path / name), header=True).limit(1).count() == 1, name
    status = spark.read.csv(str(tmp_path / "deconvolution_status"), header=True, inferSchema=True)
    assert {r["n_series"] for r in status.collect()} == {8}
    draws = spark.read.parquet(str(tmp_path / "duration_samples"))
    assert draws.groupBy("symptom", "age_group").count().filter("count <> 8").count() == 0
