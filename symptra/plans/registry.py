"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import columns as C
from ..functions import frames
from ..operators import cohort, compare, deconvolution, duration, durationfit, incidence, mrp, survey, trends
from ..operators import prevalence as prev
from ..schema import (
    AGE_GROUPS,
    BACKSHIFT_TAG,
    ILI_SYMPTOMS,
    MODELLED_SYMPTOMS,
    REGIONS,
)
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FIT_DRAWS = 50
DURATION_DRAWS = 1000


def places(query_name: str, column: str, digits: int = 6) -> int:
    """Decimals compared; fewer for counts of people, which are large."""
    counts = column in ("incidence", "diff_incidence", "p_n") or column.startswith("incidence_q")
    return 3 if counts and not query_name.startswith("deconvolve") else digits


def stable(df: DataFrame, query_name: str = "", digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: sums run in no fixed order."""
    return df.select(
        *[
            (F.round(c, places(query_name, c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(fn: Query) -> Query:
    name = fn.__name__.removeprefix("q_")
    QUERIES[name] = lambda spark, sf_dir: stable(fn(spark, sf_dir), name)
    return fn


def _scratch(spark: SparkSession) -> str:
    return f"{frames.shared_dir(spark)}/symptra-{uuid.uuid4().hex}"


# --- shared chains -----------------------------------------------------------


def prevalence_age(s: SparkSession, d: str) -> DataFrame:
    return incidence.prevalence_age_draws(I.prevalence_samples(s, d))


def durations(s: SparkSession, d: str) -> DataFrame:
    return duration.with_expected_duration(I.duration_samples(s, d))


def shifted(s: SparkSession, d: str) -> DataFrame:
    return incidence.backshift_incidence(prevalence_age(s, d), durations(s, d))


def incidence_draws(s: SparkSession, d: str) -> DataFrame:
    return incidence.trim_common_support(frames.stored(shifted(s, d)))


def survey_draws(s: SparkSession, d: str) -> DataFrame:
    return compare.with_all_ages(compare.aggregate_draws(incidence_draws(s, d)))


def search_draws(s: SparkSession, d: str) -> DataFrame:
    return compare.trend_draws(I.trend_samples(s, d))


def ccf_incidence(s: SparkSession, d: str) -> DataFrame:
    return compare.correlate_draws(survey_draws(s, d), search_draws(s, d), "incidence", "fitted")


def ccf_growth(s: SparkSession, d: str) -> DataFrame:
    survey_growth = compare.survey_growth_rates(survey_draws(s, d))
    return compare.correlate_draws(survey_growth, compare.trend_growth_rates(search_draws(s, d)), "survey_gr", "search_gr")


def delays(s: SparkSession, d: str) -> DataFrame:
    return duration.new_symptom_delays(I.submissions(s, d))


def delay_counts(s: SparkSession, d: str) -> DataFrame:
    return duration.delay_cells(frames.stored(duration.duration_cells(delays(s, d))))


def deconvolved(s: SparkSession, d: str, max_iter: int = 32, tol: float = 1e-4) -> DataFrame:
    prevalence = frames.stored(prevalence_age(s, d))
    solved = deconvolution.deconvolve(
        prevalence, deconvolution.delay_pmf(I.duration_samples(s, d)), tol=tol, max_iter=max_iter
    )
    start = prevalence.agg(F.min("date").alias("_start"))
    return deconvolution.assign_dates(solved.crossJoin(F.broadcast(start)), F.col("_start")).drop("_start")


def method_bands(s: SparkSession, d: str) -> DataFrame:
    """Bands of the back-shift and of a second method with a later start and
    an earlier end, cut to common ends."""
    draws = frames.stored(survey_draws(s, d))
    fixed = compare.per_capita_bands(draws, BACKSHIFT_TAG)
    other = compare.per_capita_bands(
        draws.withColumn("incidence", F.col("incidence") * (1.1 + F.dayofmonth("date") / 100)),
        "Deconvolution",
    )
    other = other.filter((F.col("date") >= "2023-11-20") & (F.col("date") < "2024-02-20"))
    return deconvolution.align_end_dates(fixed, other)


def trend_inputs(s: SparkSession, d: str) -> DataFrame:
    return trends.trend_features(I.search_trends(s, d))


# --- A: sources and sinks ----------------------------------------------------


@query
def q_read_latest_snapshot(s, d):
    return sources.read_latest_snapshot(s, f"{d}/customer*.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )


@query
def q_read_submissions(s, d):
    path = _scratch(s)
    I.submissions_raw(s, d).write.parquet(path)
    return sources.read_submissions(s, path)


@query
def q_read_population(s, d):
    path = _scratch(s)
    I.population(s, d).write.parquet(path)
    return sources.read_population(s, path)


@query
def q_read_search_trends(s, d):
    path = _scratch(s)
    I.search_trends(s, d).write.parquet(path)
    return sources.read_search_trends(s, path)


@query
def q_read_samples(s, d):
    first, second = _scratch(s), _scratch(s)
    samples = I.duration_samples(s, d)
    sources.write_samples(samples, first)
    sources.write_samples(samples.withColumn("sigma", F.col("sigma") * 2), second)
    stacked = sources.read_samples(s, {"stated": first, "wide": second})
    return stacked.select("method", "symptom", "age_group", "draw", "mu", "sigma")


@query
def q_write_samples(s, d):
    path = _scratch(s)
    sources.write_samples(I.trend_samples(s, d), path)
    return sources.read_samples(s, path).select("symptom", "date", "draw", "value", "fitted")


@query
def q_write_table(s, d):
    path = _scratch(s)
    sources.write_table(duration.duration_summary(I.duration_samples(s, d)), path)
    schema = "symptom string, age_group string, mean double, q50 double, q95 double, q5 double, q75 double, q25 double"
    return s.read.csv(path, header=True, schema=schema)


# --- B: survey cleaning ------------------------------------------------------


@query
def q_select_survey_columns(s, d):
    return survey.select_survey_columns(I.submissions_raw(s, d))


@query
def q_add_relative_days(s, d):
    return survey.add_relative_days(I.submissions_raw(s, d)).select(
        "submission_id", "window_submission", "symptoms_submission"
    )


@query
def q_add_weekday(s, d):
    return survey.add_weekday(I.submissions_raw(s, d)).select("submission_id", "wday", "wday_rank")


@query
def q_add_any_flag_new(s, d):
    return survey.add_any_flag(I.submissions_raw(s, d)).select("submission_id", "symptoms_new_any")


@query
def q_add_any_flag_ongoing(s, d):
    return survey.add_any_flag(I.submissions_raw(s, d), "symptoms").select("submission_id", "symptoms_any")


@query
def q_add_ili_count(s, d):
    return survey.add_ili_count(I.submissions_raw(s, d)).select("submission_id", "symptoms_count_new_ili")


@query
def q_add_row_id(s, d):
    return survey.add_row_id(I.submissions_raw(s, d).select("submission_id"), "submission_id")


@query
def q_add_row_id_by_symptom(s, d):
    return survey.add_row_id(I.search_trends(s, d), "date", ["symptom"])


@query
def q_with_age_group(s, d):
    return survey.with_age_group(I.submissions_raw(s, d)).select("submission_id", "age", "age_group")


@query
def q_filter_study(s, d):
    return survey.filter_study(I.submissions_raw(s, d)).select("submission_id", "submitted_at", "rgn21nm")


@query
def q_with_category_rank(s, d):
    raw = I.submissions_raw(s, d).select("submission_id", F.col("rgn21nm").alias("region_name"))
    return survey.with_category_rank(raw, "region_name", REGIONS)


@query
def q_clean_labels(s, d):
    counts = I.submissions(s, d).agg(
        *[F.sum(F.col(f"symptoms_new_{x}").cast("int")).alias(f"symptoms_new_{x}") for x in ILI_SYMPTOMS]
    )
    long = counts.unpivot([], list(counts.columns), "variable", "n")
    return survey.clean_labels(long, "variable").withColumn("spaced", survey.underscores_to_spaces("variable"))


@query
def q_label_symptoms(s, d):
    return survey.label_symptoms(I.duration_samples(s, d)).select("symptom", "age_group", "draw", "symptom_label")


@query
def q_harmonise_symptoms(s, d):
    return survey.harmonise_symptoms(I.search_trends(s, d))


@query
def q_filter_symptoms_regex(s, d):
    return survey.filter_symptoms_regex(I.search_trends(s, d))


@query
def q_filter_symptoms_in(s, d):
    return survey.filter_symptoms_in(I.search_trends(s, d), ["cough", "anosmia"])


@query
def q_rename_by_rule(s, d):
    return survey.rename_by_rule(I.submissions_raw(s, d)).select(
        "submission_id", "onset", *[f"{p}_{x}" for p in ("new", "ongoing") for x in MODELLED_SYMPTOMS]
    )


@query
def q_clean_survey(s, d):
    return I.submissions(s, d).select(
        "submission_id",
        "window_submission",
        "symptoms_submission",
        "symptoms_count_new_ili",
        "age_group",
        "region_name",
        "region_rank",
        "age_rank",
    )


# --- C: cohort ---------------------------------------------------------------


def cohort_input(s, d):
    return cohort.with_imd_quintile(I.submissions(s, d))


@query
def q_with_imd_quintile(s, d):
    return cohort_input(s, d).select("submission_id", "imd_quint")


@query
def q_demographics_table(s, d):
    return cohort.demographics_table(cohort_input(s, d), include_dates=True)


@query
def q_symptom_table(s, d):
    return cohort.symptom_table(cohort_input(s, d))


@query
def q_waves_table(s, d):
    return cohort.waves_table(I.submissions(s, d))


@query
def q_count_participants(s, d):
    return cohort.count_participants(I.submissions(s, d))


@query
def q_count_submissions(s, d):
    return cohort.count_submissions(I.submissions(s, d))


# --- D: prevalence -----------------------------------------------------------


@query
def q_prevalence_cells(s, d):
    return I.cells(s, d)


@query
def q_with_time_index(s, d):
    return prev.with_time_index(I.search_trends(s, d), "date", ["symptom"])


@query
def q_window_weights(s, d):
    return I.weights(s, d)


@query
def q_window_weights_by_submissions(s, d):
    return prev.window_weights(I.cells(s, d), weight_by="submissions")


@query
def q_prediction_grid(s, d):
    return prev.prediction_grid(I.cells(s, d))


@query
def q_poststrat_population(s, d):
    return I.strata_population(s, d)


@query
def q_fit_mrp(s, d):
    return mrp.fit_mrp(I.cells(s, d)).drop("cov")


@query
def q_fit_mrp_window(s, d):
    spec = mrp.MRPSpec(trend_length=None, age_trend_length=None, region=False)
    beta = F.col("beta")
    return mrp.fit_mrp(I.cells(s, d), spec).select("symptom", beta[0].alias("intercept"), beta[1].alias("slope"), "converged")


@query
def q_draw_status(s, d):
    cells, fit = _fit_parts(s, d)
    return mrp.draw_status(fit, cells, 1000)


@query
def q_fit_mrp_saturated(s, d):
    fit = mrp.fit_mrp(I.cells(s, d), mrp.SATURATED_BY_AGE)
    coefs = fit.select("symptom", F.posexplode("beta").alias("_i", "_b"))
    ages = F.array(*[F.lit(a) for a in AGE_GROUPS])
    return coefs.select("symptom", F.element_at(ages, F.col("_i") + 1).alias("age_group"), C.inverse_logit("_b").alias("p"))


def _fit_parts(s, d):
    cells = frames.stored(I.cells(s, d))
    return cells, mrp.fit_mrp(cells)


@query
def q_draw_linear_predictor(s, d):
    cells, fit = _fit_parts(s, d)
    samples = mrp.draw_linear_predictor(fit, prev.prediction_grid(cells), n_draws=10, cells=cells)
    return samples.groupBy("symptom", "draw").agg(F.avg("fitted").alias("fitted"), F.count(F.lit(1)).alias("n"))


@query
def q_prevalence_draws(s, d):
    cells, fit = _fit_parts(s, d)
    samples = mrp.prevalence_draws(
        fit,
        prev.prediction_grid(cells, windows=False),
        prev.window_weights(cells),
        I.strata_population(s, d),
        FIT_DRAWS,
        cells=cells,
    )
    return prev.prevalence_summary(samples)


@query
def q_inverse_logit(s, d):
    return prev.inverse_logit(I.cell_samples(s, d))


@query
def q_attach_covariates(s, d):
    grid = prev.prediction_grid(I.cells(s, d))
    samples = prev.inverse_logit(I.cell_samples(s, d, 1))
    return prev.attach_covariates(samples, grid).drop("n_trials")


@query
def q_reweight_window(s, d):
    return reweighted(s, d)


def reweighted(s, d):
    samples = prev.attach_covariates(prev.inverse_logit(I.cell_samples(s, d)), prev.prediction_grid(I.cells(s, d)))
    return prev.reweight_window(samples.filter(F.col("symptom").isNotNull()), I.weights(s, d))


@query
def q_poststratify(s, d):
    return prev.poststratify(reweighted(s, d), I.strata_population(s, d))


@query
def q_prevalence_by_age(s, d):
    return prev.prevalence_by_age(I.prevalence_samples(s, d))


@query
def q_prevalence_by_region(s, d):
    return prev.prevalence_by_region(I.prevalence_samples(s, d))


@query
def q_prevalence_national(s, d):
    return prev.prevalence_national(I.prevalence_samples(s, d))


@query
def q_prevalence_summary(s, d):
    return prev.prevalence_summary(I.prevalence_samples(s, d))


@query
def q_prevalence_age_figure_data(s, d):
    return prev.prevalence_age_figure_data(prev.prevalence_summary(I.prevalence_samples(s, d)))


@query
def q_prevalence_region_figure_data(s, d):
    return prev.prevalence_region_figure_data(prev.prevalence_summary(I.prevalence_samples(s, d)))


@query
def q_prevalence_nation_figure_data(s, d):
    return prev.prevalence_nation_figure_data(prev.prevalence_summary(I.prevalence_samples(s, d)))


# --- E: duration -------------------------------------------------------------


@query
def q_unpivot_symptoms(s, d):
    long = duration.unpivot_symptoms(I.submissions(s, d))
    return long.groupBy("symptom", "age_group", "new", "ongoing").agg(
        F.count(F.lit(1)).alias("n"), F.min("onset").alias("first_onset")
    )


@query
def q_filter_new_short(s, d):
    return duration.filter_new_short(duration.unpivot_symptoms(I.submissions(s, d)))


@query
def q_empirical_duration(s, d):
    return duration.empirical_duration(delays(s, d))


@query
def q_duration_cells(s, d):
    return duration.duration_cells(delays(s, d))


@query
def q_delay_cells(s, d):
    return delay_counts(s, d)


@query
def q_impossible_delays(s, d):
    return durationfit.impossible_delays(delay_counts(s, d))


@query
def q_fit_lognormal(s, d):
    return durationfit.posterior_summary(durationfit.fit_lognormal(delay_counts(s, d)))


@query
def q_draw_duration(s, d):
    return durationfit.draw_duration(durationfit.fit_lognormal(delay_counts(s, d)), n_draws=FIT_DRAWS)


@query
def q_draw_duration_ordered(s, d):
    draws = durationfit.draw_duration(durationfit.fit_lognormal(delay_counts(s, d)), n_draws=FIT_DRAWS, shuffle=False)
    return stable(draws, digits=4)  # node spacing comes from numerical curvature


@query
def q_with_expected_duration(s, d):
    return durations(s, d)


@query
def q_mean_duration_by_age(s, d):
    return duration.mean_duration_by_age(I.duration_samples(s, d))


@query
def q_density_grid(s, d):
    return duration.density_grid(I.duration_samples(s, d))


@query
def q_density_bands(s, d):
    return duration.density_bands(duration.density_grid(I.duration_samples(s, d)))


@query
def q_duration_summary(s, d):
    return duration.duration_summary(I.duration_samples(s, d))


@query
def q_mean_duration_table(s, d):
    return duration.mean_duration_table(I.duration_samples(s, d))


@query
def q_mean_duration_table_unpadded(s, d):
    return duration.mean_duration_table(I.duration_samples(s, d), digits=4, pad=False)


@query
def q_duration_window_cells(s, d):
    by_window = duration.duration_cells_by_extension(delays(s, d))
    return duration.delay_cells(by_window, by=["window_extension", "symptom"])


@query
def q_duration_window_sensitivity(s, d):
    return stable(durationfit.duration_window_sensitivity(delays(s, d), n_draws=DURATION_DRAWS), digits=4)


@query
def q_duration_sigma_sensitivity(s, d):
    return stable(durationfit.duration_sigma_sensitivity(delays(s, d), n_draws=DURATION_DRAWS), digits=4)


@query
def q_duration_shared_sigma(s, d):
    return durationfit.posterior_summary(durationfit.fit_lognormal(delay_counts(s, d), shared_sigma=True))


@query
def q_duration_prior_sensitivity(s, d):
    return stable(durationfit.duration_prior_sensitivity(delays(s, d), n_draws=DURATION_DRAWS), digits=4)


def variant_draws(s: SparkSession, d: str, n: int = FIT_DRAWS) -> DataFrame:
    return durationfit.sensitivity_draws(delays(s, d), n_draws=n, shuffle=False)


@query
def q_duration_sensitivity_draws(s, d):
    return stable(variant_draws(s, d), digits=3)


@query
def q_duration_sensitivity_summary(s, d):
    return stable(durationfit.sensitivity_summary(variant_draws(s, d, DURATION_DRAWS)), digits=4)


@query
def q_duration_sensitivity_density(s, d):
    return stable(durationfit.sensitivity_density(variant_draws(s, d)), digits=3)


@query
def q_fit_lognormal_contrasts(s, d):
    return durationfit.posterior_summary(durationfit.fit_lognormal(delay_counts(s, d), durationfit.CONTRAST_PRIORS))


@query
def q_draw_duration_contrasts(s, d):
    return durationfit.draw_contrasts(durationfit.fit_contrasts(delay_counts(s, d)), DURATION_DRAWS)



# --- F: incidence by fixed back-shift ----------------------------------------


@query
def q_prevalence_age_draws(s, d):
    return prevalence_age(s, d)


@query
def q_backshift_incidence(s, d):
    return shifted(s, d)


@query
def q_trim_common_support(s, d):
    return incidence_draws(s, d)


@query
def q_incidence_national(s, d):
    return incidence.incidence_national(incidence_draws(s, d))


@query
def q_incidence_age_bands(s, d):
    return incidence.incidence_age_bands(incidence_draws(s, d))


@query
def q_incidence_national_bands(s, d):
    return incidence.incidence_national_bands(incidence.incidence_national(incidence_draws(s, d)))


# --- G: incidence by deconvolution -------------------------------------------


@query
def q_delay_pmf(s, d):
    pmf = deconvolution.delay_pmf(I.duration_samples(s, d))
    return pmf.select("symptom", "age_group", "draw", "exp_dur", F.posexplode("delay_pmf").alias("day", "mass"))


@query
def q_delay_pmf_interval(s, d):
    pmf = deconvolution.delay_pmf(I.duration_samples(s, d), pmf="interval")
    return pmf.select("symptom", "age_group", "draw", F.posexplode("delay_pmf").alias("day", "mass"))


@query
def q_deconvolve(s, d):
    return deconvolved(s, d)


@query
def q_deconvolution_status(s, d):
    solved = deconvolution.deconvolve(
        prevalence_age(s, d), deconvolution.delay_pmf(I.duration_samples(s, d)), status=True
    )
    return deconvolution.deconvolution_status(solved)


@query
def q_deconvolve_two_steps(s, d):
    return deconvolved(s, d, max_iter=2, tol=0.0)


@query
def q_assign_dates(s, d):
    long = I.trend_samples(s, d).withColumn("t", F.dayofmonth("date")).select("symptom", "draw", "t", "fitted")
    start = I.search_trends(s, d).agg(F.min("date").alias("start"))
    return deconvolution.assign_dates(long.crossJoin(F.broadcast(start)), F.col("start"))


@query
def q_national_weighted(s, d):
    return deconvolution.national_weighted(incidence_draws(s, d))


@query
def q_stack_national(s, d):
    inc = incidence_draws(s, d).select("date", "symptom", "draw", "age_group", "incidence", "population")
    return deconvolution.stack_national(inc, deconvolution.national_weighted(inc))


@query
def q_deconvolution_bands(s, d):
    inc = incidence_draws(s, d).withColumn(
        "incidence", F.when(F.dayofmonth("date") + F.col("draw") % 3 != 31, F.col("incidence") / F.col("population"))
    )
    return deconvolution.deconvolution_bands(inc)


@query
def q_deconvolved_incidence_bands(s, d):
    solved = frames.stored(deconvolved(s, d))
    return deconvolution.deconvolution_bands(
        deconvolution.stack_national(solved, deconvolution.national_weighted(solved))
    )


@query
def q_align_end_dates(s, d):
    return method_bands(s, d)


@query
def q_relative_difference(s, d):
    return deconvolution.relative_difference(method_bands(s, d))


# --- H: search trends --------------------------------------------------------


@query
def q_trend_features(s, d):
    return trend_inputs(s, d)


@query
def q_fit_trend(s, d):
    return trends.fit_trend(trend_inputs(s, d))


@query
def q_trend_samples(s, d):
    features = trend_inputs(s, d)
    return trends.trend_samples(trends.fit_trend(features), features, n_draws=FIT_DRAWS)


@query
def q_trend_bands(s, d):
    return trends.trend_bands(I.trend_samples(s, d))


@query
def q_trend_derivative_samples(s, d):
    features = trend_inputs(s, d)
    return trends.trend_derivative_samples(trends.fit_trend(features), features, n_draws=FIT_DRAWS)


@query
def q_derivative_bands(s, d):
    samples = I.trend_samples(s, d).withColumn("derivative", F.col("fitted") - F.col("value"))
    return trends.derivative_bands(samples)


# --- I: comparison -----------------------------------------------------------


@query
def q_aggregate_draws(s, d):
    return compare.aggregate_draws(incidence_draws(s, d))


@query
def q_with_all_ages(s, d):
    return survey_draws(s, d)


@query
def q_per_capita_bands(s, d):
    return compare.per_capita_bands(survey_draws(s, d))


@query
def q_survey_growth_rates(s, d):
    return compare.survey_growth_rates(survey_draws(s, d))


@query
def q_survey_growth_bands(s, d):
    return compare.survey_growth_bands(compare.survey_growth_rates(survey_draws(s, d)))


@query
def q_trend_draws(s, d):
    return search_draws(s, d)


@query
def q_trend_compare_bands(s, d):
    return compare.trend_compare_bands(search_draws(s, d))


@query
def q_trend_growth_rates(s, d):
    return compare.trend_growth_rates(search_draws(s, d))


@query
def q_trend_growth_bands(s, d):
    return compare.trend_growth_bands(compare.trend_growth_rates(search_draws(s, d)))


@query
def q_incidence_figure_data(s, d):
    return compare.incidence_figure_data(
        compare.per_capita_bands(survey_draws(s, d)), compare.trend_compare_bands(search_draws(s, d))
    )


@query
def q_growth_figure_data(s, d):
    return compare.growth_figure_data(
        compare.survey_growth_bands(compare.survey_growth_rates(survey_draws(s, d))),
        compare.trend_growth_bands(compare.trend_growth_rates(search_draws(s, d))),
    )


@query
def q_join_draws(s, d):
    return compare.join_draws(survey_draws(s, d), search_draws(s, d))


@query
def q_cross_correlation(s, d):
    return ccf_incidence(s, d)


@query
def q_cross_correlation_growth(s, d):
    return ccf_growth(s, d)


@query
def q_ccf_bands(s, d):
    return compare.ccf_bands(ccf_incidence(s, d))


@query
def q_max_lag(s, d):
    return compare.max_lag(ccf_incidence(s, d))


@query
def q_max_corr(s, d):
    return compare.max_corr(ccf_incidence(s, d))


@query
def q_max_lag_table(s, d):
    return compare.max_lag_table(ccf_incidence(s, d))


@query
def q_max_corr_table(s, d):
    return compare.max_corr_table(ccf_incidence(s, d))


@query
def q_max_lag_table_growth(s, d):
    return compare.max_lag_table(ccf_growth(s, d))


@query
def q_max_corr_table_growth(s, d):
    return compare.max_corr_table(ccf_growth(s, d))


@query
def q_max_ccf_2d(s, d):
    return compare.max_ccf_2d(ccf_growth(s, d))


# --- U: helpers --------------------------------------------------------------


@query
def q_quantile_bands(s, d):
    return frames.quantile_bands(I.duration_samples(s, d), "mu", ["symptom", "age_group"])


@query
def q_ranked_quantiles(s, d):
    orders = I.table(s, d, "orders")
    return frames.ranked_quantiles(orders, "o_totalprice", ["o_orderpriority", "o_orderstatus"])


@query
def q_ranked_quantiles_ties(s, d):
    items = I.table(s, d, "lineitem")
    return frames.ranked_quantiles(items, "l_quantity", ["l_returnflag"])


@query
def q_lognormal_density(s, d):
    items = I.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 1).alias("x"))
    return items.withColumn("density", C.lognormal_density("x", F.lit(1.5), F.lit(0.7)))


@query
def q_format_interval(s, d):
    bands = frames.ranked_quantiles(I.table(s, d, "customer"), "c_acctbal", ["c_nationkey"])
    small = [F.col(c) / 1000 for c in ("pi_50", "pi_5", "pi_95")]
    return bands.select(
        "c_nationkey",
        C.format_interval("pi_50", "pi_5", "pi_95", 3).alias("large"),
        C.format_interval(*small, 2).alias("small"),
    )


@query
def q_strict_sum(s, d):
    marked = I.table(s, d, "orders").withColumn(
        "price", F.when(F.col("o_orderkey") % 1000 != 7, F.col("o_totalprice"))
    )
    return marked.groupBy("o_custkey").agg(C.strict_sum("price").alias("total"), F.sum("price").alias("known"))


@query
def q_assert_complete(s, d):
    return frames.assert_complete(
        I.submissions(s, d).select("submission_id", "age_group", "region_name"), ["age_group", "region_name"]
    )


@query
def q_with_draws(s, d):
    return frames.with_draws(I.table(s, d, "customer").select("c_custkey", "c_nationkey"), 20)


@query
def q_scalar_functions(s, d):
    x = F.col("c_acctbal")
    return I.table(s, d, "customer").select(
        "c_custkey",
        F.exp(x / 10000).alias("exp_x"),
        F.ln(F.abs(x) + 1).alias("ln_x"),
        F.ceil(x / 100).alias("ceil_x"),
        F.bround(F.col("c_custkey") / 2, 0).alias("half_even"),
        F.greatest(x, F.lit(0.0)).alias("floor_zero"),
        F.least(x, F.lit(5000.0)).alias("cap"),
        F.when(x < 0, "debt").otherwise("credit").alias("side"),
        F.col("c_name").rlike("[05]$").alias("round_name"),
        F.regexp_replace("c_name", "Customer#0*", "").alias("short_name"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag"),
    )
