"""Back-shift, growth, cross-correlation, number formats."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from symptra.functions import columns as C
from symptra.operators import compare, deconvolution, incidence

DAY0 = dt.date(2024, 1, 1)


def days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def test_shift_rounds_half_to_even(spark):
    prev = spark.createDataFrame(
        [("cough", DAY0, i, "a", 0.1, 1000) for i in range(4)],
        "symptom string, date date, draw int, age_group string, prevalence double, population long",
    )
    dur = spark.createDataFrame(
        [("cough", "a", i, 0.0, 1.0, e) for i, e in enumerate((1.0, 3.0, 5.0, 7.0))],
        "symptom string, age_group string, draw int, mu double, sigma double, exp_dur double",
    )
    out = incidence.backshift_incidence(prev, dur).orderBy("draw").collect()
    assert [(DAY0 - r["date"]).days for r in out] == [0, 2, 2, 4]
    trimmed = incidence.trim_common_support(incidence.backshift_incidence(prev, dur.filter("draw < 3")))
    assert trimmed.count() == 0  # an unmatched draw leaves the symptom without bounds


def test_growth_divides_by_current_value_and_gap(spark):
    d = days(4)
    df = spark.createDataFrame(
        [("cough", "All", 1, d[0], 10.0), ("cough", "All", 1, d[1], 20.0), ("cough", "All", 1, d[3], 10.0)],
        "symptom string, age_group string, draw int, date date, incidence double",
    )
    got = [r["survey_gr"] for r in compare.survey_growth_rates(df).orderBy("date").collect()]
    assert got == [50.0, -50.0]


def series(spark, pairs, draw=1):
    rows = [("cough", "All", draw, d, float(x), float(y)) for d, (x, y) in zip(days(len(pairs)), pairs)]
    return spark.createDataFrame(rows, "symptom string, age_group string, draw int, date date, x double, y double")


def test_cross_correlation_sign_range_and_flat_series(spark):
    wave = [math.sin(i / 3.0) + 0.1 * ((i * 7) % 5) for i in range(43)]
    same = compare.cross_correlation(series(spark, [(v, v) for v in wave[:40]]), "x", "y")
    by_lag = {r["lag"]: r["ccf"] for r in same.collect()}
    assert set(by_lag) == set(range(-13, 14))
    assert abs(by_lag[0] - 1) < 1e-12 and max(map(abs, by_lag.values())) <= 1 + 1e-12
    # x repeats y three rows later, so x[t + 3] = y[t]
    delayed = compare.cross_correlation(series(spark, list(zip(wave[:40], wave[3:43]))), "x", "y")
    assert compare.max_per_draw(delayed).first()["lag"] == 3
    flat = compare.cross_correlation(series(spark, [(1.0, v) for v in wave[:12]]), "x", "y")
    assert flat.filter(~F.isnan("ccf")).count() == 0
    assert compare.max_per_draw(flat).count() == 0


def test_ties_take_the_smallest_lag(spark):
    df = spark.createDataFrame(
        [("cough", "All", 1, lag, c) for lag, c in ((-1, 0.5), (0, 0.9), (2, 0.9), (3, float("nan")))],
        "symptom string, age_group string, draw int, lag int, ccf double",
    )
    row = compare.max_per_draw(df).first()
    assert (row["lag"], row["ccf"]) == (0, 0.9)


def test_bands_repeat_for_each_observed_value(spark):
    df = spark.createDataFrame([("cough", DAY0, 1.0, 5.0), ("cough", DAY0, 3.0, 7.0)], "symptom string, date date, fitted double, value double")
    out = compare.bands_with_value(df, "fitted", ["date", "symptom"]).collect()
    assert sorted((r["value"], r["pi_50"]) for r in out) == [(5.0, 2.0), (7.0, 2.0)]


def test_significant_digits(spark):
    cases = {0.0: "0.0", 12.34: "12", 9.96: "10", 0.01234: "0.012", 123.4: "120", -3.0: "-3.0", 0.5: "0.50"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    got = {r["x"]: r["t"] for r in df.withColumn("t", C.format_significant("x", 2)).collect()}
    assert got == cases
    plain = spark.createDataFrame([(11.5,), (120.0,)], "x double").select(C.format_significant("x", 4, pad=False).alias("t"))
    assert [r["t"] for r in plain.collect()] == ["11.5", "120"]


def test_density_is_zero_at_zero(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    got = [r["d"] for r in df.select(C.lognormal_density("x", F.lit(0.0), F.lit(1.0)).alias("d")).collect()]
    assert got[0] == 0 and abs(got[1] - 1 / math.sqrt(2 * math.pi)) < 1e-15


def test_deconvolution_dates_and_national_mean(spark):
    df = spark.createDataFrame(
        [("a", "cough", 1, 0.1, 100, 1), ("b", "cough", 1, 0.4, 300, 1)],
        "age_group string, symptom string, draw int, incidence double, population long, t int",
    )
    assert deconvolution.assign_dates(df, DAY0).first()["date"] == DAY0 + dt.timedelta(days=1)
    dated = deconvolution.assign_dates(df, DAY0, date_offset=0)
    assert dated.first()["date"] == DAY0
    nation = deconvolution.national_weighted(dated).first()
    assert abs(nation["incidence"] - 0.325) < 1e-12 and nation["age_group"] == "All"


def series_rows(n, shift=0, gaps=(), twice=()):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i + shift) for i in range(n) if i not in gaps]
    return [*days, *[days[i] for i in twice]]


def test_packed_correlation_equals_the_joined_one(spark):
    survey = [("cough", a, k, d, float((i * 7 + k * 3) % 11 + i)) for a in ("x", "y") for k in (1, 2) for i, d in enumerate(series_rows(40, 3, (5, 17)))]
    survey += [("fever", "x", 1, d, float(i)) for i, d in enumerate(series_rows(4, 400))]  # no common date
    trend = [("cough", k, d, float((i * 5 + k) % 13)) for k in (1, 2) for i, d in enumerate(series_rows(45, 0, (2, 9, 10, 30)))]
    trend += [("fever", 1, d, float(i)) for i, d in enumerate(series_rows(9))]
    left = spark.createDataFrame(survey, "symptom string, age_group string, draw int, date date, incidence double")
    right = spark.createDataFrame(trend, "symptom string, draw int, date date, fitted double")
    order = ["symptom", "age_group", "draw", "lag"]
    got = compare.correlate_draws(left, right, "incidence", "fitted").orderBy(*order).collect()
    want = compare.cross_correlation(compare.join_draws(left, right), "incidence", "fitted").orderBy(*order).collect()
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a["ccf"] - b["ccf"]) < 1e-12


@pytest.mark.parametrize("side", ["survey", "trend"])
def test_repeated_dates_end_the_query(spark, side):
    twice = (3,)
    survey = [("cough", "x", 1, d, float(i)) for i, d in enumerate(series_rows(9, twice=twice if side == "survey" else ()))]
    trend = [("cough", 1, d, float(i % 4)) for i, d in enumerate(series_rows(9, twice=twice if side == "trend" else ()))]
    left = spark.createDataFrame(survey, "symptom string, age_group string, draw int, date date, incidence double")
    right = spark.createDataFrame(trend, "symptom string, draw int, date date, fitted double")
    with pytest.raises(Exception, match="two rows for one"):
        compare.correlate_draws(left, right, "incidence", "fitted").collect()
    growth = compare.survey_growth_rates(left) if side == "survey" else compare.trend_growth_rates(right)
    with pytest.raises(Exception, match="two rows for one"):
        growth.collect()
