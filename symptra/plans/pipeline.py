"""The whole analysis as stages that write their tables.

Samples are written partitioned by symptom and read back by later stages, so a
stage never recomputes the survey and a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, compare, deconvolution, duration, durationfit, incidence, mrp, survey, trends
from ..operators import prevalence as prev
from ..schema import BACKSHIFT_TAG
from ..sources import read_samples, write_samples, write_table


@dataclass
class Pipeline:
    """Stages in order: cohort, prevalence, duration, sensitivity, incidence,
    search, comparison, deconvolution. Incidence needs prevalence and duration;
    the comparison and the deconvolution need it. ``out`` is a folder all
    executors see."""

    spark: SparkSession
    submissions_raw: DataFrame
    population: DataFrame
    search_trends: DataFrame
    out: str
    n_draws: int = 1000

    def _samples(self, name: str) -> DataFrame:
        return read_samples(self.spark, f"{self.out}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        write_samples(df, f"{self.out}/{name}", mode="overwrite")

    def _table(self, df: DataFrame, name: str) -> None:
        write_table(df, f"{self.out}/{name}", mode="overwrite")

    def _submissions(self) -> DataFrame:
        return survey.clean_survey(self.submissions_raw)

    def cohort(self) -> None:
        """Descriptive tables of the cleaned survey."""
        people = cohort.with_imd_quintile(self._submissions())
        self._table(cohort.demographics_table(people, include_dates=True), "demographics")
        self._table(cohort.symptom_table(people), "symptoms")
        self._table(cohort.waves_table(people), "waves")
        self._table(cohort.count_participants(people), "participants")
        self._table(cohort.count_submissions(people), "submissions")

    def prevalence(self) -> None:
        path = f"{self.out}/prevalence_cells"
        self._write(prev.prevalence_cells(self._submissions()), "prevalence_cells")
        cells = read_samples(self.spark, path)
        self._write(mrp.fit_mrp(cells), "prevalence_fit")
        fit = self._samples("prevalence_fit")
        self._table(mrp.draw_status(fit, cells, self.n_draws), "prevalence_status")
        samples = mrp.prevalence_draws(
            fit,
            prev.prediction_grid(cells, windows=False),
            prev.window_weights(cells),
            prev.poststrat_population(self.population),
            self.n_draws,
            cells=cells,
        )
        self._write(samples, "prevalence_samples")
        bands = prev.prevalence_summary(self._samples("prevalence_samples"))
        write_samples(bands, f"{self.out}/prevalence_bands", ["outcome"], mode="overwrite")
        summary = self._samples("prevalence_bands")
        self._table(summary, "prevalence_summary")
        self._table(prev.prevalence_age_figure_data(summary), "prevalence_age_figure")
        self._table(prev.prevalence_region_figure_data(summary), "prevalence_region_figure")
        self._table(prev.prevalence_nation_figure_data(summary), "prevalence_nation_figure")

    def duration(self) -> None:
        counted = duration.duration_cells(duration.new_symptom_delays(self._submissions()))
        self._write(counted, "duration_cells")  # the survey is read once
        self._write(duration.delay_cells(self._samples("duration_cells")), "delay_cells")
        cells = self._samples("delay_cells")
        self._table(durationfit.impossible_delays(cells), "impossible_delays")
        fit = durationfit.fit_contrasts(cells)
        self._write(durationfit.draw_contrasts(fit, self.n_draws), "duration_samples")
        draws = self._samples("duration_samples")
        self._table(duration.density_bands(duration.density_grid(draws)), "duration_density")
        self._table(duration.duration_summary(draws), "duration_summary")
        self._table(duration.mean_duration_table(draws), "mean_duration")

    def sensitivity(self) -> None:
        """Durations under other window extensions, a shared sigma and other
        priors: draws, densities and summaries."""
        delays = duration.new_symptom_delays(self._submissions())
        self._write(durationfit.sensitivity_draws(delays, n_draws=self.n_draws), "duration_variants")
        draws = self._samples("duration_variants")
        self._table(durationfit.sensitivity_summary(draws), "duration_variants_summary")
        self._table(durationfit.sensitivity_density(draws), "duration_variants_density")

    def incidence(self) -> None:
        prevalence = incidence.prevalence_age_draws(self._samples("prevalence_samples"))
        self._write(prevalence, "prevalence_age")
        shifted = incidence.backshift_incidence(
            self._samples("prevalence_age"), duration.with_expected_duration(self._samples("duration_samples"))
        )
        self._write(incidence.trim_common_support(shifted), "incidence")
        draws = self._samples("incidence")
        self._table(incidence.incidence_age_bands(draws), "incidence_age")
        self._table(incidence.incidence_national_bands(incidence.incidence_national(draws)), "incidence_national")

    def search(self) -> None:
        self._write(trends.trend_features(self.search_trends), "search_features")
        features = self._samples("search_features")
        self._write(trends.fit_trend(features), "search_fits")
        fit = self._samples("search_fits")
        self._write(trends.trend_samples(fit, features, self.n_draws), "search_samples")
        self._write(trends.trend_derivative_samples(fit, features, n_draws=self.n_draws), "search_slopes")
        self._table(trends.trend_bands(self._samples("search_samples")), "search_summary")
        self._table(trends.derivative_bands(self._samples("search_slopes")), "search_growth")

    def comparison(self) -> None:
        survey_draws = compare.with_all_ages(compare.aggregate_draws(self._samples("incidence")))
        self._write(survey_draws, "incidence_all_ages")
        survey_draws = self._samples("incidence_all_ages")
        search = compare.trend_draws(self._samples("search_samples"))
        self._write(compare.survey_growth_rates(survey_draws).drop("diff_time", "diff_incidence"), "survey_growth")
        self._write(compare.trend_growth_rates(search), "trend_growth")
        survey_growth, search_growth = self._samples("survey_growth"), self._samples("trend_growth")
        self._table(
            compare.incidence_figure_data(compare.per_capita_bands(survey_draws), compare.trend_compare_bands(search)),
            "incidence_comparison",
        )
        self._table(
            compare.growth_figure_data(
                compare.survey_growth_bands(survey_growth), compare.trend_growth_bands(search_growth)
            ),
            "growth_comparison",
        )
        pairs = {
            "incidence": (survey_draws, search, "incidence", "fitted"),
            "gr": (survey_growth, search_growth, "survey_gr", "search_gr"),
        }
        for name, (left, right, x, y) in pairs.items():
            self._write(compare.correlate_draws(left, right, x, y), f"ccf_{name}")
            ccf = self._samples(f"ccf_{name}")
            self._table(compare.ccf_bands(ccf), f"ccf_bands_{name}")
            self._write(compare.max_bands(compare.max_per_draw(ccf)), f"ccf_maxima_{name}")
            maxima = self._samples(f"ccf_maxima_{name}")
            self._table(compare.interval_table(maxima, "lag_pi_"), f"max_lags_{name}")
            self._table(compare.interval_table(maxima, "ccf_pi_"), f"max_corrs_{name}")
            self._table(compare.maxima_figure_data(maxima), f"max_2d_{name}")

    def deconvolution(self) -> None:
        prevalence = self._samples("prevalence_age")
        start = prevalence.agg(F.min("date")).first()[0]
        pmf = deconvolution.delay_pmf(self._samples("duration_samples"))
        solved = deconvolution.assign_dates(deconvolution.deconvolve(prevalence, pmf, status=True), start)
        self._write(solved, "deconvolved_ages")
        solved = self._samples("deconvolved_ages")
        self._table(deconvolution.deconvolution_status(solved), "deconvolution_status")
        solved = solved.drop("updates", "fit", "converged")
        self._write(
            deconvolution.stack_national(solved, deconvolution.national_weighted(solved)), "deconvolved_incidence"
        )
        self._write(deconvolution.deconvolution_bands(self._samples("deconvolved_incidence")), "deconvolution_bands")
        self._write(compare.per_capita_bands(self._samples("incidence_all_ages"), BACKSHIFT_TAG), "backshift_bands")
        fixed, bands = self._samples("backshift_bands"), self._samples("deconvolution_bands")
        self._write(deconvolution.align_end_dates(fixed, bands), "method_bands")
        aligned = self._samples("method_bands")
        self._table(aligned, "methods")
        self._table(deconvolution.relative_difference(aligned), "method_difference")

    STAGES: ClassVar[tuple[str, ...]] = ("cohort", "prevalence", "duration", "sensitivity", "incidence", "search", "comparison", "deconvolution")

    def run(self) -> None:
        for stage in self.STAGES:
            getattr(self, stage)()
