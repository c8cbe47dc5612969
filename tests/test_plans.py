"""Physical plans: pushdown, pruning, no cartesian products."""

from symptra.operators import survey
from symptra.plans import inputs, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_needs_no_cartesian_join(spark, sf_dir):
    text = plan(registry.prev.prediction_grid(inputs.submissions(spark, sf_dir), windows=False))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_study_filter_is_pushed_to_the_scan(spark, sf_dir, tmp_path):
    inputs.submissions_raw(spark, sf_dir).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(survey.filter_study(registry.sources.read_submissions(spark, str(tmp_path / "s"))).select("age"))
    assert "GreaterThanOrEqual(submitted_at,2023-11-14)" in text and "Not(EqualTo(rgn21nm,Scotland))" in text
    assert "symptoms_new_cough" not in text


def test_quantile_bands_sort_once(spark, sf_dir):
    text = plan(registry.frames.quantile_bands(inputs.table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"]))
    assert text.count("partial_percentile(") == 1


def test_cross_correlation_has_no_self_join(spark, sf_dir):
    samples = inputs.trend_samples(spark, sf_dir)
    text = plan(registry.compare.cross_correlation(samples, "fitted", "value", ["symptom", "draw"]))
    assert text.count("Scan parquet") == 2  # the table itself and its largest day per term


def test_population_join_is_broadcast(spark, sf_dir):
    text = plan(inputs.prevalence_samples(spark, sf_dir, 2))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
