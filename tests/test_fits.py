"""Properties of the fitted models on simulated data with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from symptra.operators import deconvolution, duration, durationfit, mrp, prevalence, trends
from symptra.schema import AGE_GROUPS, REGIONS

DAY0 = dt.date(2023, 11, 14)


def simulated_cells(spark, n_days=40, trials=400, symptom="cough"):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(1, n_days + 1):
        for a, age in enumerate(AGE_GROUPS):
            for r, region in enumerate(REGIONS):
                w = (t + a + r) % 7
                eta = -3 + 0.6 * math.sin(t / 8) + 0.05 * w + 0.2 * (r - 4) / 4
                y = int(rng.binomial(trials, 1 / (1 + math.exp(-eta))))
                rows.append((symptom, age, region, w, DAY0 + dt.timedelta(days=t - 1), t, trials, y))
    return spark.createDataFrame(
        rows,
        "symptom string, age_group string, region_name string, window_submission int, submitted_at date, t int, n_trials long, n_outcome long",
    )


def test_regression_recovers_truth_and_draws_do_not_depend_on_partitions(spark):
    cells = simulated_cells(spark).persist()
    fit = mrp.fit_mrp(cells)
    row = fit.first()
    beta = np.asarray(row["beta"])
    assert abs(beta[1] - 0.05) < 0.02  # window effect
    grid = prevalence.prediction_grid(cells)
    samples = mrp.draw_linear_predictor(fit, grid, n_draws=40)
    truth = -3 + 0.6 * F.sin(F.col("t") / 8) + 0.05 * F.col("window_submission")
    joined = samples.groupBy("row_id").agg(F.avg("fitted").alias("m")).join(grid, "row_id")
    error = joined.filter("region_name = 'West Midlands'").agg(F.avg(F.abs(F.col("m") - truth))).first()[0]
    assert error < 0.06
    few = samples.filter("row_id in (1, 50, 999) and draw < 4")
    again = mrp.draw_linear_predictor(fit, grid.repartition(3), n_draws=40).filter("row_id in (1, 50, 999) and draw < 4")
    key = lambda df: sorted(map(tuple, df.select("row_id", "draw", F.round("fitted", 9)).collect()))
    assert key(few) == key(again)


def test_fused_draws_equal_the_separate_steps(spark):
    cells = simulated_cells(spark, n_days=6).persist()
    fit = mrp.fit_mrp(cells)
    weights = prevalence.window_weights(cells)
    pop = spark.createDataFrame(
        [(a, r, 1000 + i) for i, (a, r) in enumerate((a, r) for a in AGE_GROUPS for r in REGIONS)],
        "age_group string, region_name string, population long",
    )
    fused = mrp.prevalence_draws(fit, prevalence.prediction_grid(cells, windows=False), weights, pop, n_draws=3)
    grid = prevalence.prediction_grid(cells)
    samples = prevalence.inverse_logit(mrp.draw_linear_predictor(fit, grid, n_draws=3))
    steps = prevalence.poststratify(prevalence.reweight_window(prevalence.attach_covariates(samples, grid), weights), pop)
    keys = ["symptom", "submitted_at", "draw", "region_name", "age_group"]
    both = fused.select(*keys, "p_n").join(steps.select(*keys, F.col("p_n").alias("q")), keys)
    assert both.count() == fused.count() == steps.count() == 6 * 63 * 3
    assert both.agg(F.max(F.abs(F.col("p_n") - F.col("q")))).first()[0] < 1e-9


def test_strong_penalty_equalises_regions_and_reference_response(spark):
    cells = simulated_cells(spark, n_days=5).persist()
    spec = mrp.MRPSpec(window=False, trend_length=None, age_trend_length=None, region_penalty=1e9)
    beta = np.asarray(mrp.fit_mrp(cells, spec).first()["beta"])
    assert np.ptp(beta[-len(REGIONS):]) < 1e-4
    spec = mrp.MRPSpec(
        intercept=False, window=False, trend_length=None, age_trend_length=None, region=False, groups="age_group", reference_response=True
    )
    beta = np.asarray(mrp.fit_mrp(cells, spec).first()["beta"])
    r = cells.groupBy("age_group").agg((F.sum("n_outcome") / F.sum("n_trials")).alias("r")).collect()
    r = {x["age_group"]: x["r"] for x in r}
    for b, age in zip(beta, AGE_GROUPS):
        assert abs(1 / (1 + math.exp(-b)) - r[age] / (1 + r[age])) < 1e-7


def simulated_delays(spark, n=20_000, mu=math.log(4.0), sigma=0.7, last_day=60, age="a", ext=3):
    rng = np.random.default_rng(11)
    onset = rng.integers(0, last_day, n) + rng.random(n)
    end = onset + rng.lognormal(mu, sigma, n)
    first = np.floor(end)
    keep = first + 1 + ext <= last_day  # whole end interval seen by the last day
    onset, first = np.floor(onset[keep]), first[keep]
    base = pd.Timestamp(DAY0)
    pdf = pd.DataFrame({"pdate_lwr": base + pd.to_timedelta(onset, "D"), "sdate_lwr": base + pd.to_timedelta(first, "D")})
    df = spark.createDataFrame(pdf).select(F.col("pdate_lwr").cast("date"), F.col("sdate_lwr").cast("date"))
    return df.select(
        F.lit("cough").alias("symptom"),
        F.lit(age).alias("age_group"),
        "pdate_lwr",
        F.date_add("pdate_lwr", 1).alias("pdate_upr"),
        "sdate_lwr",
        F.date_add("sdate_lwr", 1 + ext).alias("sdate_upr"),
        F.lit(1).cast("long").alias("n"),
    )


def test_duration_posterior_recovers_truth(spark):
    # exact day intervals (no extension) and truncation at the last day
    cells = simulated_delays(spark, ext=0).unionByName(simulated_delays(spark, 8_000, math.log(6.0), 0.5, age="b", ext=0))
    posterior = durationfit.fit_lognormal(duration.delay_cells(cells)).persist()
    out = {r["age_group"]: r for r in durationfit.posterior_summary(posterior).collect()}
    for age, mu, sigma in (("a", math.log(4.0), 0.7), ("b", math.log(6.0), 0.5)):
        r = out[age]
        assert abs(r["mass"] - 1) < 1e-9
        assert abs(r["mu_mean"] - mu) < 4 * r["mu_sd"] and abs(r["sigma_mean"] - sigma) < 4 * r["sigma_sd"]
        assert 0.001 < r["mu_sd"] < 0.03
    draws = durationfit.draw_duration(posterior, 200)
    stats = {r["age_group"]: r for r in draws.groupBy("age_group").agg(F.avg("mu").alias("m"), F.countDistinct("draw").alias("n")).collect()}
    assert stats["a"]["n"] == 200 and abs(stats["a"]["m"] - out["a"]["mu_mean"]) < out["a"]["mu_sd"] / 3


def test_shared_sigma_is_one_value_per_symptom(spark):
    cells = simulated_delays(spark, 4000, ext=0).unionByName(simulated_delays(spark, 4000, math.log(7.0), 0.7, age="b", ext=0))
    out = durationfit.posterior_summary(durationfit.fit_lognormal(duration.delay_cells(cells), shared_sigma=True)).collect()
    assert len(out) == 2
    assert abs(out[0]["sigma_mean"] - out[1]["sigma_mean"]) < 1e-9
    assert abs(out[0]["sigma_mean"] - 0.7) < 0.05


def test_impossible_delays_are_dropped(spark):
    cells = simulated_delays(spark, 500, ext=0)
    negative = cells.limit(5).withColumn("sdate_upr", F.date_sub("pdate_lwr", 3)).withColumn("sdate_lwr", F.date_sub("pdate_lwr", 4))
    want = durationfit.posterior_summary(durationfit.fit_lognormal(duration.delay_cells(cells))).first()
    got = durationfit.posterior_summary(durationfit.fit_lognormal(duration.delay_cells(cells.unionByName(negative)))).first()
    assert abs(want["mu_mean"] - got["mu_mean"]) < 1e-6


def test_deconvolution_is_positive_and_convolves_back():
    days = np.arange(61)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmf = np.where(days > 0, np.exp(-((np.log(days) - math.log(4)) ** 2) / (2 * 0.49)) / (days * 0.7 * math.sqrt(2 * math.pi)), 0)
    t = np.arange(174)
    truth = 0.01 * (1.5 + np.sin(t / 15))
    observed = np.array([sum(pmf[k] * truth[i + 60 - k] for k in range(61)) for i in range(114)])
    stack, weights = np.stack([observed, observed * 2]), np.stack([pmf, pmf])
    out, updates, fit = deconvolution.richardson_lucy(stack, weights, tol=1e-12, max_iter=200)
    assert (updates == 200).all() and (fit < 1e-6).all()
    assert out.shape == (2, 114) and np.isnan(out[:, -1]).all() and (out[:, :-1] >= 0).all()
    assert np.abs(out[0, 20:80] / truth[80:140] - 1).max() < 0.03
    assert np.allclose(out[1, :-1], 2 * out[0, :-1])


def trend_rows(spark, value, n=84, symptom="cough"):
    rows = [(DAY0 + dt.timedelta(days=i), symptom, float(value(i))) for i in range(n)]
    return trends.trend_features(spark.createDataFrame(rows, "date date, symptom string, value double"))


def test_trend_of_constant_weekly_and_linear_series(spark):
    weekly = lambda i: 40 + 8 * math.sin(2 * math.pi * i / 7)
    rising = lambda i: 100 / (1 + math.exp(-(-2 + 0.03 * i)))
    features = (
        trend_rows(spark, lambda i: 50)
        .unionByName(trend_rows(spark, weekly, symptom="fever"))
        .unionByName(trend_rows(spark, rising, symptom="headache"))
        .persist()
    )
    fit = trends.fit_trend(features).persist()
    slopes = trends.trend_derivative_samples(fit, features, n_draws=50)
    by = {r["symptom"]: r for r in slopes.groupBy("symptom").agg(F.max(F.abs("derivative")).alias("top"), F.avg("derivative").alias("m")).collect()}
    assert by["cough"]["top"] < 0.5
    assert abs(by["headache"]["m"] - 3.0) < 0.1  # percent per day on the logit scale
    levels = trends.trend_samples(fit, features, n_draws=50)
    fever = levels.filter("symptom = 'fever'").groupBy("date").agg(F.avg("fitted").alias("m"))
    low, high = fever.agg(F.min("m"), F.max("m")).first()
    assert high - low < 3  # the weekly cycle is left out
    assert levels.count() == 3 * 84 * 50


def test_trend_edges_and_repeated_rows(spark):
    base = trend_rows(spark, lambda i: (i * 13) % 101)  # reaches 0 and 100
    doubled = base.unionByName(base)
    one = trends.fit_trend(base).first()
    two = trends.fit_trend(doubled).first()
    assert np.isfinite(one["beta"]).all() and np.isfinite(two["beta"]).all()
    assert trends.trend_samples(trends.fit_trend(base), base, n_draws=2).filter("fitted is null").count() == 0


def test_deconvolution_marks_unknown_series(spark):
    days = [DAY0 + dt.timedelta(days=i) for i in range(6)]
    rows = [("cough", "a", 1, d, None if i == 3 else 0.1, 10.0) for i, d in enumerate(days)]
    rows += [("cough", "b", 1, d, 0.1, 10.0) for d in days] + [("fever", "b", 1, d, 0.1, 10.0) for d in days]
    prevalence = spark.createDataFrame(rows, "symptom string, age_group string, draw int, date date, prevalence double, population double")
    draws = spark.createDataFrame([("cough", "a", 1, 1.0, 0.5), ("cough", "b", 1, 1.0, 0.5)], "symptom string, age_group string, draw int, mu double, sigma double")
    out = deconvolution.deconvolve(prevalence, deconvolution.delay_pmf(draws, 3), status=True).collect()
    of = lambda s, a: [r for r in out if (r["symptom"], r["age_group"]) == (s, a)]
    for key in (("cough", "a"), ("fever", "b")):
        assert len(of(*key)) == 6 and all(r["incidence"] is None and r["fit"] is None and r["converged"] is False for r in of(*key))
    assert any(r["incidence"] is not None for r in of("cough", "b")) and of("cough", "b")[0]["fit"] is not None


def test_basis_of_a_long_series_keeps_its_resolution():
    from symptra.functions.glm import GPBasis

    t = np.arange(1, 601)
    evaluate, k = GPBasis(600, 60.0, 6).evaluator()
    full = np.exp(-(((t[:, None] - t[None, :]) / 60.0) ** 2))
    values, vectors = np.linalg.eigh(full)
    top = vectors[:, np.argsort(values)[::-1][:k]] * np.sqrt(np.sort(values)[::-1][:k])
    got = evaluate(t)
    top = top - top.mean(axis=0)
    assert np.allclose(np.abs((got * top).sum(axis=0)), (top * top).sum(axis=0), rtol=0.02)


def test_age_contrasts_match_a_dense_grid(spark):
    """Two age groups, one with few submissions: the joint posterior over
    (mu, log sigma) of both, summed on one dense four-dimensional grid."""
    many = simulated_delays(spark, 300, ext=0)
    few = simulated_delays(spark, 25, math.log(6.0), 0.5, age="b", ext=0)
    delays = duration.delay_cells(many.unionByName(few)).persist()
    priors = durationfit.CONTRAST_PRIORS
    nodes = durationfit.fit_lognormal(delays, priors).toPandas()

    terms = {r["age_group"]: r for r in durationfit._terms(delays, ["symptom", "age_group"], True).collect()}
    spans = {"a": ((0.9, 1.9), (-0.8, 0.0)), "b": ((0.5, 4.0), (-2.0, 1.0))}
    axes, like = {}, {}
    for age, (m, s) in spans.items():
        mu, ls = np.linspace(*m, 81), np.linspace(*s, 81)
        t = {c: np.asarray(terms[age][c]) for c in ("hi", "lo", "pw", "n")}
        rows = []
        for v in ls:
            area = lambda d: durationfit.cdf_integral(d[None, :], mu[:, None], np.exp(v))  # noqa: B023, E731
            mass = (area(t["hi"]) - area(t["hi"] - t["pw"]) - area(t["lo"]) + area(t["lo"] - t["pw"])) / t["pw"]
            rows.append((t["n"] * np.log(np.maximum(mass, durationfit.TINY))).sum(axis=1))
        axes[age], like[age] = (mu, ls), np.array(rows)  # log sigma x mu
    a, b = (np.exp(like[k] - like[k].max()) for k in "ab")
    prior = np.exp(-0.5 * ((axes["a"][0] - priors.mu_mean) / priors.mu_sd) ** 2)[None, :]
    prior = prior * np.exp(-0.5 * ((axes["a"][1] - priors.log_sigma_mean) / priors.log_sigma_sd) ** 2)[:, None]
    across = np.exp(-0.5 * ((axes["b"][0][None, :] - axes["a"][0][:, None]) / 3) ** 2)  # mu a x mu b
    over = np.exp(-0.5 * ((axes["b"][1][None, :] - axes["a"][1][:, None]) / 3) ** 2)
    joint_a = a * prior * np.einsum("Jj,ji,Ii->JI", over, b, across)
    joint_b = b * np.einsum("Jj,JI,Ii->ji", over, a * prior, across)
    for age, p in (("a", joint_a), ("b", joint_b)):
        p = p / p.sum()
        for axis, grid, own in ((0, axes[age][0], lambda n: n.mu), (1, axes[age][1], lambda n: np.log(n.sigma))):
            part = nodes[nodes.age_group == age]
            assert abs(part.prob.sum() - 1) < 1e-9
            mean, got = (p.sum(axis=axis) * grid).sum(), (part.prob * own(part)).sum()
            sd = math.sqrt((p.sum(axis=axis) * (grid - mean) ** 2).sum())
            spread = math.sqrt((part.prob * (own(part) - got) ** 2).sum())
            assert abs(got - mean) < 0.03 * sd and abs(spread / sd - 1) < 0.05, (age, axis)
    # a weak contrast instead of the narrow prior on its own
    alone = durationfit.posterior_summary(durationfit.fit_lognormal(delays)).filter("age_group = 'b'").first()
    part = nodes[nodes.age_group == "b"]
    assert (part.prob * part.mu).sum() > alone["mu_mean"]


def test_contrast_draws_follow_the_marginals(spark):
    cells = simulated_delays(spark, 400, ext=0).unionByName(simulated_delays(spark, 60, math.log(7.0), 0.7, age="b", ext=0))
    delays = duration.delay_cells(cells).persist()
    for shared in (False, True):
        fit = durationfit.fit_contrasts(delays, shared_sigma=shared).persist()
        want = {r["age_group"]: r for r in durationfit.posterior_summary(durationfit.contrast_nodes(fit)).collect()}
        draws = durationfit.draw_contrasts(fit, 4000)
        assert draws.count() == 8000 and draws.select("draw").distinct().count() == 4000
        for r in draws.groupBy("age_group").agg(F.avg("mu").alias("m"), F.stddev("mu").alias("s"), F.avg("sigma").alias("g")).collect():
            w = want[r["age_group"]]
            assert abs(r["m"] - w["mu_mean"]) < 4 * w["mu_sd"] / math.sqrt(4000)
            assert abs(r["s"] / w["mu_sd"] - 1) < 0.06
            assert abs(r["g"] - w["sigma_mean"]) < 4 * w["sigma_sd"] / math.sqrt(4000)
        if shared:
            assert draws.groupBy("draw").agg(F.count_distinct(F.round("sigma", 9)).alias("n")).filter("n > 1").count() == 0


def test_wide_sigma_does_not_overflow():
    t = np.array([1.0, 5.0, 60.0])
    area = durationfit.cdf_integral(t[None, :], np.array([[0.0], [3.0]]), 60.0)
    assert np.isfinite(area).all() and (np.diff(area, axis=1) > 0).all()
    days = np.linspace(1e-6, 5.0, 200001)
    numeric = np.trapezoid(durationfit.normal_cdf((np.log(days) - 0.5) / 0.8), days)
    assert abs(durationfit.cdf_integral(np.array([5.0]), np.array([0.5]), 0.8)[0] - numeric) < 1e-6


def test_variants_share_one_pass(spark):
    """Each variant's posterior equals its own fit; equal fits are made once."""
    delays = spark.createDataFrame(
        [(DAY0 + dt.timedelta(days=20 + i % 9), i, DAY0 + dt.timedelta(days=10 + (i * 7) % 13), "a" if i % 3 else "b", "cough", True, True) for i in range(500)],
        "submitted_at date, participant_id long, onset date, age_group string, symptom string, new boolean, ongoing boolean",
    )
    draws = durationfit.sensitivity_draws(delays, n_draws=40, shuffle=False).persist()
    assert draws.select("analysis", "variant").distinct().count() == len(durationfit.ALL_VARIANTS)
    same = [draws.filter(c).drop("analysis", "variant").orderBy("age_group", "draw").collect() for c in ("analysis = 'window' AND variant = '3'", "variant = 'mu_sigma'", "variant = 'default'")]
    assert same[0] == same[1] == same[2] and len(same[0]) == 80
    cells = duration.delay_cells(duration.duration_cells(delays))
    for variant, args in (("mu", {"priors": durationfit.DEFAULT_PRIORS, "shared_sigma": True}), ("stated", {})):
        own = durationfit.draw_duration(durationfit.fit_lognormal(cells, **args), 40, shuffle=False).orderBy("age_group", "draw").collect()
        got = draws.filter(F.col("variant") == variant).orderBy("age_group", "draw").collect()
        assert np.allclose([(r["mu"], r["sigma"]) for r in own], [(r["mu"], r["sigma"]) for r in got], atol=1e-6)
    text = durationfit.fit_variants(delays)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in text and text.count("window_extension") > 0  # reads the stored cells only


def sparse_cells(spark, symptoms=("cough",)):
    rows = [(s, x, 4, 1 if (x + k) % 5 == 0 else 0) for k, s in enumerate(symptoms) for x in range(7) for _ in range(2)]
    return spark.createDataFrame(rows, "symptom string, window_submission int, n_trials long, n_outcome long")


WINDOW_ONLY = mrp.MRPSpec(trend_length=None, age_trend_length=None, region=False)


def test_corrected_draws_match_a_dense_grid(spark):
    """Few, rare outcomes: the posterior is skewed, and the Gaussian around the
    fit is not it."""
    cells = sparse_cells(spark)
    fit = mrp.fit_mrp(cells, WINDOW_ONLY).persist()
    draws, accepted = next(mrp.coefficient_draws(fit, 4000, 3, cells, WINDOW_ONLY))
    plain, _ = next(mrp.coefficient_draws(fit, 4000, 3, None, WINDOW_ONLY))
    assert draws["cough"].shape == (4000, 2) and accepted["cough"] > 0.5
    b0, b1 = np.linspace(-8, 2, 401), np.linspace(-2, 2, 401)
    x = np.repeat(np.arange(7), 2).astype(float)
    y = np.array([1.0 if v % 5 == 0 else 0.0 for v in x])
    eta = b0[:, None, None] + b1[None, :, None] * x
    log_p = (y * eta - 4 * np.logaddexp(0, eta)).sum(axis=2)
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    for axis, grid, k in ((1, b0, 0), (0, b1, 1)):
        share = p.sum(axis=axis)
        mean = (share * grid).sum()
        sd = math.sqrt((share * (grid - mean) ** 2).sum())
        got = draws["cough"][:, k]
        assert abs(got.mean() - mean) < 0.08 * sd and abs(got.std() / sd - 1) < 0.06
        for q in (0.05, 0.5, 0.95):
            assert abs(np.quantile(got, q) - np.interp(q, share.cumsum(), grid)) < 0.12 * sd
    centre = (p.sum(axis=1) * b0).sum()
    assert abs(plain["cough"][:, 0].mean() - centre) > 2 * abs(draws["cough"][:, 0].mean() - centre)


def test_many_symptoms_in_batches(spark, monkeypatch):
    names = [f"s{i:02d}" for i in range(30)]
    cells = sparse_cells(spark, names).persist()
    fit = mrp.fit_mrp(cells, WINDOW_ONLY).persist()
    assert fit.count() == 30 and fit.filter("converged").count() == 30
    whole, _ = next(mrp.coefficient_draws(fit, 20, 5, cells, WINDOW_ONLY))
    monkeypatch.setattr(mrp, "SENT_BYTES", 8 * 220 * 2 * 7)
    parts = list(mrp.coefficient_draws(fit, 20, 5, cells, WINDOW_ONLY))
    assert [len(d) for d, _ in parts] == [7, 7, 7, 7, 2]
    assert all(np.array_equal(whole[s], d[s]) for d, _ in parts for s in d)
    status = mrp.draw_status(fit, cells, 20, 5, WINDOW_ONLY)
    assert status.count() == 30 and status.filter("accepted > 0.3 AND distinct_draws > 5").count() == 30


def test_fit_that_runs_out_of_iterations_says_so(spark):
    fit = mrp.fit_mrp(sparse_cells(spark), WINDOW_ONLY, max_iterations=2).first()
    assert fit["converged"] is False and fit["iterations"] == 2
    assert mrp.fit_mrp(sparse_cells(spark).limit(0), WINDOW_ONLY).collect() == []


def test_gamma_functions():
    import math

    from symptra.functions.glm import digamma, log_gamma, trigamma

    x = np.array([1e-3, 0.3, 1.0, 2.5, 40.0, 1e5])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    h = 1e-4 * x
    assert np.allclose(digamma(x), (log_gamma(x + h) - log_gamma(x - h)) / (2 * h), rtol=1e-5)
    assert np.allclose(trigamma(x), (digamma(x + h) - digamma(x - h)) / (2 * h), rtol=1e-5)
    assert abs(trigamma(np.array(1.0)) - np.pi**2 / 6) < 1e-12


def test_trend_recovers_the_precision(spark):
    rng = np.random.default_rng(4)
    parts = None
    for name, phi in (("cough", 15.0), ("fever", 150.0)):
        mean = 1 / (1 + np.exp(-(0.5 * np.sin(np.arange(300) / 25) - 0.8)))
        y = 100 * rng.beta(mean * phi, (1 - mean) * phi)
        rows = trend_rows(spark, lambda i: float(y[i]), n=300, symptom=name)
        parts = rows if parts is None else parts.unionByName(rows)
    for r in trends.fit_trend(parts).collect():
        assert r["converged"]
        assert 0.75 < r["phi"] / {"cough": 15.0, "fever": 150.0}[r["symptom"]] < 1.33, (r["symptom"], r["phi"])
