"""Posterior of lognormal durations from doubly censored, truncated delays.

The two-parameter posterior is evaluated on a grid of (mu, log sigma) with
joins and sums: a coarse grid, zooms around its mode, and a final grid scaled
to the curvature there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_DEN, NORMAL_NUM, NORMAL_SPLIT
from ..functions.frames import null_safe_join, stored
from ..functions.glm import seeded
from ..schema import WINDOW_EXTENSION, WINDOW_EXTENSIONS
from .duration import STRATA, delay_cells, density_bands, density_grid, duration_cells_by_extension, duration_summary

TINY = 1e-300


@dataclass(frozen=True)
class DurationPriors:
    """Normal priors on mu and log sigma of each stratum.

    With ``contrast_sd`` they are those of a reference age group, and the other
    age groups differ from it by normal contrasts around zero, in mu and, unless
    it is shared, in log sigma."""

    mu_mean: float
    mu_sd: float
    log_sigma_mean: float
    log_sigma_sd: float
    contrast_sd: float | None = None


STATED_PRIORS = DurationPriors(math.log(4.0), 0.5, math.log(0.7), 0.5)
CONTRAST_PRIORS = replace(STATED_PRIORS, contrast_sd=3.0)
DEFAULT_PRIORS = DurationPriors(1.0, 1.0, -0.7, 0.4)


@dataclass(frozen=True)
class DurationVariant:
    """One setting of a sensitivity analysis."""

    analysis: str
    variant: str
    window_extension: int = WINDOW_EXTENSION
    shared_sigma: bool = False
    priors: DurationPriors = DEFAULT_PRIORS

    @property
    def fit(self) -> str:
        """Equal for variants that ask for the same posterior."""
        return repr((self.window_extension, self.shared_sigma, self.priors))


WINDOW_VARIANTS = [DurationVariant("window", str(e), e) for e in WINDOW_EXTENSIONS]
SIGMA_VARIANTS = [DurationVariant("sigma", "mu", shared_sigma=True), DurationVariant("sigma", "mu_sigma")]
PRIOR_VARIANTS = [DurationVariant("priors", "stated", priors=STATED_PRIORS), DurationVariant("priors", "default")]
ALL_VARIANTS = [*WINDOW_VARIANTS, *SIGMA_VARIANTS, *PRIOR_VARIANTS]


@dataclass(frozen=True)
class Grid:
    """Coarse ranges and the refinement that follows."""

    mu: tuple[float, float, int] = (0.0, 4.0, 21)
    log_sigma: tuple[float, float, int] = (-1.6, 0.6, 16)
    zooms: int = 3
    zoom_factor: int = 4
    zoom_half: int = 5
    final_half: int = 16
    steps_per_sd: int = 3


def _terms(delays: DataFrame, keys: Sequence[str], truncate: bool) -> DataFrame:
    """Terms n * ln(F(hi) - F(lo)) of the log likelihood, packed per stratum.

    Truncation enters as terms with negative n, so the two terms are summed
    on their own and never multiplied. Intervals that end before the onset are
    impossible and dropped; :func:`impossible_delays` counts them. A stratum holds at most one term per pair of study
    days, whatever the number of submissions.
    """
    valid = delays.filter(F.col("delay_upr") > 0)
    terms = valid.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("delay_upr").alias("hi"), F.col("delay_lwr").alias("lo"), "pwindow", F.col("n").alias("n")),
                F.struct(F.col("relative_obs_time").alias("hi"), F.lit(0).alias("lo"), "pwindow", (-F.col("n")).alias("n")),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    terms = terms.filter(F.col("hi").isNotNull() & (F.lit(truncate) | (F.col("n") > 0)))
    terms = terms.withColumn("sign", F.col("n") > 0).groupBy(*keys, "sign", "hi", "lo", "pwindow").agg(F.sum("n").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("hi", "lo", F.col("pwindow").alias("pw"), "n")))
    return terms.groupBy(*keys).agg(packed.alias("_t")).select(
        *keys, *[F.col(f"_t.{c}").cast("array<double>").alias(c) for c in ("hi", "lo", "pw", "n")]
    )


def impossible_delays(delays: DataFrame, keys: Sequence[str] = ("symptom", "age_group")) -> DataFrame:
    """Per stratum: submissions whose interval ends before the onset, which the
    likelihood leaves out, and all submissions."""
    out = F.coalesce(F.col("delay_upr") <= 0, F.lit(True))
    return delays.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("n_dropped"), F.sum("n").alias("n_all")
    )


def mills(a: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal over exp(-a^2 / 2), for a >= 0."""
    frac = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + k / frac
    near = np.minimum(a, NORMAL_SPLIT)
    ratio = np.polyval(NORMAL_NUM, near) / np.polyval(NORMAL_DEN, near)
    return np.where(a < NORMAL_SPLIT, ratio, 1.0 / (frac * 2.506628274631))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal CDF of an array, to about 1e-15."""
    a = np.abs(x)
    tail = np.exp(-0.5 * a * a) * mills(a)
    return np.where(x > 0, 1.0 - tail, tail)


def cdf_integral(t: np.ndarray, mu: np.ndarray, sigma: float) -> np.ndarray:
    """Integral of the lognormal CDF from 0 to t; zero for t <= 0.

    The mean's part, exp(mu + sigma^2 / 2) Phi(z - sigma), is written as
    t exp(-z^2 / 2) times a Mills ratio below the mean, where the exponential
    alone would overflow for a wide sigma."""
    known = np.where(t > 0, t, 1.0)
    z = (np.log(known) - mu) / sigma
    below = sigma - z
    low = known * np.exp(-0.5 * z * z) * mills(np.maximum(below, 0.0))
    high = np.exp(np.minimum(mu + 0.5 * sigma * sigma, np.log(known))) * normal_cdf(-below)
    area = t * normal_cdf(z) - np.where(below > 0, low, high)
    return np.where(t > 0, area, 0.0)


PRIOR = ["mu_mean", "mu_sd", "ls_mean", "ls_sd"]  # of a stratum's nodes


def _prior_columns(priors: DurationPriors, reference: Column, shared: bool = False) -> dict[str, Column]:
    """Priors of a stratum on its own: with contrasts, the wider ones that the
    age groups other than the reference have when it is unknown."""
    wide = priors.contrast_sd or 0.0

    def sd(own: float, add: float) -> Column:
        return F.when(reference, F.lit(own)).otherwise(F.lit(math.hypot(own, add)))

    return {
        "mu_mean": F.lit(priors.mu_mean),
        "mu_sd": sd(priors.mu_sd, wide),
        "ls_mean": F.lit(priors.log_sigma_mean),
        "ls_sd": sd(priors.log_sigma_sd, 0.0 if shared else wide),
    }


def _evaluate(strata: DataFrame, keys: list[str], half: tuple) -> DataFrame:
    """Log posterior of mu on a line of nodes for each log sigma node.

    One row per stratum and sigma node, spread over all tasks, carries the
    stratum's terms; a task evaluates all mu nodes of a row at once (``lp``),
    with its largest value (``top`` at position ``pos``) and log sum (``lse``).
    """
    (i0, i1), (j0, j1) = half
    parts = int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        strata.withColumn("j", F.explode(F.sequence(F.lit(j0), F.lit(j1))))
        .withColumn("ls", F.col("ls0") + F.col("j") * F.col("dls"))
        .drop("ls0")
        .repartition(parts, *keys, "j")
    )
    steps = np.arange(i0, i1 + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for r in pdf.itertuples(index=False):
                hi, lo, pw, n = (np.asarray(v, float) for v in (r.hi, r.lo, r.pw, r.n))
                mu = (r.mu0 + steps * r.dmu)[:, None]
                days, index = np.unique(np.concatenate([hi, hi - pw, lo, lo - pw]), return_inverse=True)
                area = cdf_integral(days[None, :], mu, np.exp(r.ls))[:, index]
                h1, h0, l1, l0 = np.split(area, 4, axis=1)
                mass = ((h1 - h0) - (l1 - l0)) / pw  # start uniform within pw
                prior = -0.5 * ((mu[:, 0] - r.mu_mean) / r.mu_sd) ** 2
                values.append((n * np.log(np.maximum(mass, TINY))).sum(axis=1) + prior)
            tops = np.array([v.max() for v in values])
            yield pdf.assign(
                lp=values,
                top=tops,
                pos=np.array([v.argmax() for v in values], dtype="int32"),
                lse=np.array([t + np.log(np.exp(v - t).sum()) for v, t in zip(values, tops)]),
            )

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, lp array<double>, top double, pos int, lse double")


def _over_sigma(keys: list[str], *more: str) -> W:
    """The strata that share one sigma."""
    return W.partitionBy(*[k for k in keys if k != "age_group"], "sigma_of", *more)


def _total(value: str, keys: list[str], shared: bool) -> Column:
    """Log posterior of a sigma node, added up over the strata sharing it."""
    total = F.sum(value).over(_over_sigma(keys, "j")) if shared else F.col(value)
    z = (F.col("ls") - F.col("ls_mean")) / F.col("ls_sd")
    return total + z * z * -0.5


def _mode(lines: DataFrame, keys: list[str], shared: bool, i0: int) -> DataFrame:
    """One row per stratum: the best sigma node, the best mu on it, and the
    two neighbouring lines."""
    w = W.partitionBy(*keys).orderBy("j")
    seen = lines.withColumn("total", _total("top", keys, shared)).withColumns(
        {"before": F.lag("lp").over(w), "after": F.lead("lp").over(w)}
    )
    others = [c for c in seen.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct("total", -F.col("j")))
    return (
        seen.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, "b.*")
        .withColumn("mu0", F.col("mu0") + (F.col("pos") + i0) * F.col("dmu"))
        .withColumnRenamed("ls", "ls0")
    )


STATE = ["hi", "lo", "pw", "n", "mu0", "ls0", "dmu", "dls", *PRIOR, "sigma_of"]


def _zoomed(mode: DataFrame, keys: list[str], factor: int) -> DataFrame:
    return mode.select(*keys, *STATE).withColumns({"dmu": F.col("dmu") / factor, "dls": F.col("dls") / factor})


def _scaled(mode: DataFrame, keys: list[str], shared: bool, grid: Grid) -> DataFrame:
    """Steps from the Laplace standard deviations at the mode."""

    def at(line: str, shift: int) -> Column:
        return F.get(line, F.col("pos") + shift)

    dmu, dls = F.col("dmu"), F.col("dls")
    h11 = 2 * at("lp", 0) - at("lp", 1) - at("lp", -1)
    h22 = 2 * at("lp", 0) - at("after", 0) - at("before", 0)
    h12 = (at("after", -1) + at("before", 1) - at("after", 1) - at("before", -1)) / 4
    fallback = 1.0 / 9.0  # curvature of a standard deviation of three steps
    curved = mode.withColumns(
        {
            "a": F.when(h11 > 0, h11).otherwise(fallback) / (dmu * dmu),
            "b": F.when(h22 > 0, h22).otherwise(fallback) / (dls * dls),
            "c": F.coalesce(h12, F.lit(0.0)) / (dmu * dls),
        }
    ).withColumn("schur", F.greatest(F.col("b") - F.col("c") * F.col("c") / F.col("a"), F.col("b") * 0.01))
    common = F.sum("schur").over(_over_sigma(keys)) if shared else F.col("schur")
    var_ls = 1.0 / (common + 1.0 / (F.col("ls_sd") * F.col("ls_sd")))
    slope = F.col("c") / F.col("a")
    return (
        curved.withColumn("vs", var_ls)
        .withColumn("dmu", F.sqrt(1.0 / F.col("a") + slope * slope * F.col("vs")) / grid.steps_per_sd)
        .withColumn("dls", F.sqrt("vs") / grid.steps_per_sd)
        .select(*keys, *STATE)
    )


def _posterior(lines: DataFrame, keys: list[str], shared: bool, i0: int) -> DataFrame:
    """Normalised node probabilities: P(sigma) times P(mu | sigma, stratum)."""
    over = W.partitionBy(*keys)
    weighed = (
        lines.withColumn("t", _total("lse", keys, shared))
        .withColumn("t", F.exp(F.col("t") - F.max("t").over(over)))
        .withColumn("pj", F.col("t") / F.sum("t").over(over))
    )
    nodes = weighed.select(*keys, "j", "ls", "mu0", "dmu", "pj", "lse", F.posexplode("lp").alias("pos", "lp"))
    i = F.col("pos") + i0
    return nodes.select(
        *keys,
        i.alias("i"),
        "j",
        (F.col("mu0") + i * F.col("dmu")).alias("mu"),
        F.exp("ls").alias("sigma"),
        (F.col("pj") * F.exp(F.col("lp") - F.col("lse"))).alias("prob"),
    )


def _final_lines(strata: DataFrame, keys: list[str], shared: bool, grid: Grid) -> DataFrame:
    """The last grid's lines of strata with their terms, priors and ``sigma_of``."""
    (m0, m1, nm), (s0, s1, ns) = grid.mu, grid.log_sigma
    start = {
        "mu0": F.lit(m0),
        "ls0": F.lit(s0),
        "dmu": F.lit((m1 - m0) / (nm - 1)),
        "dls": F.lit((s1 - s0) / (ns - 1)),
    }
    mode = _mode(_evaluate(strata.withColumns(start), keys, ((0, nm - 1), (0, ns - 1))), keys, shared, 0)
    z = grid.zoom_half
    for _ in range(grid.zooms):
        lines = _evaluate(_zoomed(mode, keys, grid.zoom_factor), keys, ((-z, z), (-z, z)))
        mode = _mode(lines, keys, shared, -z)
    f = grid.final_half
    return _evaluate(_scaled(mode, keys, shared, grid), keys, ((-f, f), (-f, f)))


def _sigma_of(keys: list[str], shared: Column) -> Column:
    own = F.col("age_group") if "age_group" in keys else F.lit(None).cast("string")
    return F.when(~shared, own)


def fit_lognormal(
    delays: DataFrame,
    priors: DurationPriors = STATED_PRIORS,
    keys: Sequence[str] = tuple(STRATA),
    shared_sigma: bool = False,
    truncate: bool = True,
    grid: Grid = Grid(),
) -> DataFrame:
    """Grid posterior of (mu, sigma) per stratum of ``keys``.

    ``shared_sigma`` gives all age groups one sigma: its posterior multiplies
    the age groups' marginal likelihoods. Rows: keys, i, j, mu, sigma, prob.
    Every pass keeps one row per stratum and sigma node. Priors with contrasts
    are those of :func:`fit_contrasts`, whose marginals are returned.
    """
    keys = list(keys)
    if priors.contrast_sd:
        return contrast_nodes(fit_contrasts(delays, priors, keys, shared_sigma, truncate, grid), keys)
    strata = _terms(delays, keys, truncate).withColumns(
        {**_prior_columns(priors, F.lit(True)), "sigma_of": _sigma_of(keys, F.lit(shared_sigma))}
    )
    return _posterior(_final_lines(strata, keys, shared_sigma, grid), keys, shared_sigma, -grid.final_half)


def fit_variants(
    delays: DataFrame, variants: Sequence[DurationVariant] = ALL_VARIANTS, grid: Grid = Grid()
) -> DataFrame:
    """Posteriors of all distinct fits among the variants (without contrasts),
    by ``fit``, in one pass: cells are counted once per window extension, and
    each stratum carries its own priors and its own sharing of sigma."""
    fits = {v.fit: v for v in variants}
    extensions = sorted({v.window_extension for v in fits.values()})
    by = ["window_extension", "symptom"]
    cells = delay_cells(stored(duration_cells_by_extension(delays, extensions)), by=by)
    asked = F.array(
        *[
            F.struct(
                F.lit(name).alias("fit"),
                F.lit(v.window_extension).alias("_e"),
                F.lit(v.shared_sigma).alias("_shared"),
                *[c.alias(k) for k, c in _prior_columns(v.priors, F.lit(True)).items()],
            )
            for name, v in fits.items()
        ]
    )
    keys = ["fit", *STRATA]
    terms = _terms(cells, ["window_extension", *STRATA], True)
    strata = (
        terms.withColumn("_v", F.explode(F.filter(asked, lambda v: v["_e"] == F.col("window_extension"))))
        .select(*STRATA, "hi", "lo", "pw", "n", "_v.*")
        .withColumn("sigma_of", _sigma_of(keys, F.col("_shared")))
        .drop("_e", "_shared")
    )
    shared = any(v.shared_sigma for v in fits.values())
    return _posterior(_final_lines(strata, keys, shared, grid), keys, shared, -grid.final_half)


# --- age contrasts -----------------------------------------------------------


def _axis(start: float, step: float, count: int) -> np.ndarray:
    return start + (np.arange(count) - count // 2) * step


def _kernel(to: np.ndarray, at: np.ndarray, sd: float) -> np.ndarray:
    """Log density, up to a constant, of ``at`` (columns) around ``to`` (rows)."""
    return -0.5 * ((at[None, :] - to[:, None]) / sd) ** 2


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def log_evidence(
    like: np.ndarray, mu: np.ndarray, ls: np.ndarray, ref_mu: np.ndarray, ref_ls: np.ndarray, sd: float, shared: bool
) -> np.ndarray:
    """Log evidence of an age group's delays at each node (sigma, mu) of the
    reference: its likelihood on its own grid, under contrasts around the node.
    The two directions are summed one after the other."""
    along = _log_sum(like[:, None, :] + _kernel(ref_mu, mu, sd)[None], 2)  # own sigma x reference mu
    if shared:
        return along
    return _log_sum(_kernel(ref_ls, ls, sd)[:, :, None] + along[None], 1)


def fit_contrasts(
    delays: DataFrame,
    priors: DurationPriors = CONTRAST_PRIORS,
    keys: Sequence[str] = tuple(STRATA),
    shared_sigma: bool = False,
    truncate: bool = True,
    grid: Grid = Grid(),
) -> DataFrame:
    """Joint posterior of all age groups, coupled through the reference group.

    The reference, the first age group by name, has the stated priors; given
    its (mu, log sigma), the other groups are independent, with normal
    contrasts. So each group's evidence is found at every node of the
    reference's grid, and the reference's posterior is its own times the
    product of the evidences. One row per stratum: its grid and likelihood, the
    reference's grid and posterior, and its own evidence there. Joins and sums
    run over strata; a task holds one stratum's grid at a time.
    """
    keys = list(keys)
    rest = [k for k in keys if k != "age_group"]
    first = F.min("age_group").over(W.partitionBy(*rest))
    strata = _terms(delays, keys, truncate).withColumn("_ref", F.col("age_group") == first)
    strata = strata.withColumns(
        {**_prior_columns(priors, F.coalesce("_ref", F.lit(False)), shared_sigma), "sigma_of": _sigma_of(keys, F.lit(shared_sigma))}
    ).drop("_ref")
    lines = _final_lines(strata, keys, shared_sigma, grid)
    packed = (
        lines.groupBy(*keys, "mu0", "dmu", "mu_mean", "mu_sd")
        .agg(F.array_sort(F.collect_list(F.struct("j", "ls", "lp"))).alias("_l"))
        .select(
            *keys, "mu0", "dmu", "mu_mean", "mu_sd", F.col("_l.ls").alias("ls"), F.flatten("_l.lp").alias("lp")
        )
    )
    is_ref = F.col("age_group") == F.min("age_group").over(W.partitionBy(*rest))
    packed = packed.withColumn("is_ref", F.coalesce(is_ref, F.lit(False)))
    types = dict(packed.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    width = 2 * grid.final_half + 1

    def bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The likelihood without the prior used to place the grid."""
        for pdf in batches:
            out = pdf[[*keys, "is_ref", "ls"]].copy()
            axes = [_axis(r.mu0, r.dmu, width) for r in pdf.itertuples()]
            like = [
                np.asarray(r.lp).reshape(len(r.ls), width) + 0.5 * ((mu - r.mu_mean) / r.mu_sd) ** 2
                for r, mu in zip(pdf.itertuples(), axes)
            ]
            yield out.assign(mu=axes, like=[v.ravel() for v in like])

    grids = packed.mapInPandas(bare, f"{schema}, is_ref boolean, ls array<double>, mu array<double>, like array<double>")
    grids = stored(grids)
    reference = grids.filter("is_ref").select(
        *rest, F.col("mu").alias("ref_mu"), F.col("ls").alias("ref_ls"), F.col("like").alias("ref_like")
    )
    with_ref = null_safe_join(grids, reference.drop("ref_like"), rest, "inner")
    sd = priors.contrast_sd

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                shape = (len(r.ref_ls), len(r.ref_mu))
                if r.is_ref:
                    found.append(np.zeros(shape).ravel())
                    continue
                like = np.asarray(r.like).reshape(len(r.ls), len(r.mu))
                found.append(log_evidence(like, r.mu, r.ls, r.ref_mu, r.ref_ls, sd, shared_sigma).ravel())
            yield pdf[keys].assign(log_z=found)

    evidences = stored(with_ref.mapInPandas(evidence, f"{schema}, log_z array<double>"))
    # a symptom has one array per age band
    added = evidences.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct("age_group", "log_z"))).alias("_z"))
    added = added.select(
        *rest,
        F.aggregate(
            F.slice("_z", 2, F.greatest(F.size("_z") - 1, F.lit(0))),
            F.col("_z")[0]["log_z"],
            lambda a, z: F.zip_with(a, z["log_z"], lambda x, y: x + y),
        ).alias("sum_z"),
    )

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                mu, ls = np.asarray(r.ref_mu), np.asarray(r.ref_ls)
                log_p = np.asarray(r.ref_like).reshape(len(ls), len(mu)) + np.asarray(r.sum_z).reshape(len(ls), len(mu))
                log_p = log_p - 0.5 * ((mu - priors.mu_mean) / priors.mu_sd)[None, :] ** 2
                log_p = log_p - 0.5 * ((ls - priors.log_sigma_mean) / priors.log_sigma_sd)[:, None] ** 2
                p = np.exp(log_p - log_p.max())
                found.append((p / p.sum()).ravel())
            yield pdf[[*rest, "ref_mu", "ref_ls"]].assign(ref_prob=found)

    rest_schema = ", ".join(f"{c} {types[c]}" for c in rest)
    weighed = null_safe_join(reference, added, rest, "inner").mapInPandas(
        weigh, f"{rest_schema}, ref_mu array<double>, ref_ls array<double>, ref_prob array<double>"
    )
    joined = null_safe_join(null_safe_join(grids, evidences, keys, "inner"), weighed, rest, "inner")
    return joined.withColumns({"contrast_sd": F.lit(sd), "shared": F.lit(shared_sigma)})


def contrast_nodes(fit: DataFrame, keys: Sequence[str] = tuple(STRATA)) -> DataFrame:
    """Marginal posterior of each stratum on its own grid, as node rows."""
    keys = list(keys)
    types = dict(fit.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                mu, ls, ref_mu, ref_ls = (np.asarray(v) for v in (r.mu, r.ls, r.ref_mu, r.ref_ls))
                p = np.asarray(r.ref_prob).reshape(len(ref_ls), len(ref_mu))
                if not r.is_ref:
                    like = np.asarray(r.like).reshape(len(ls), len(mu))
                    z = np.asarray(r.log_z).reshape(p.shape)
                    across = np.exp(_kernel(ref_mu, mu, r.contrast_sd))
                    over = np.eye(len(ls)) if r.shared else np.exp(_kernel(ref_ls, ls, r.contrast_sd))
                    shift = like.max()  # evidences are of about this size
                    p = np.exp(like - shift) * (over.T @ (p * np.exp(shift - z)) @ across)
                    p = p / p.sum()
                j, i = np.indices(p.shape)
                half_j, half_i = len(ls) // 2, len(mu) // 2
                out = {k: getattr(r, k) for k in keys}
                yield pd.DataFrame(
                    {
                        **out,
                        "i": (i - half_i).ravel().astype("int32"),
                        "j": (j - half_j).ravel().astype("int32"),
                        "mu": np.broadcast_to(mu, p.shape).ravel(),
                        "sigma": np.broadcast_to(np.exp(ls)[:, None], p.shape).ravel(),
                        "prob": p.ravel(),
                    }
                )

    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    return fit.mapInPandas(run, f"{schema}, i int, j int, mu double, sigma double, prob double")


def _pick(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Per row of weights the first place whose cumulated share reaches u."""
    total = np.cumsum(weights, axis=-1)
    return (total < (u * total[..., -1])[..., None]).sum(axis=-1).clip(max=weights.shape[-1] - 1)


def draw_contrasts(
    fit: DataFrame, n_draws: int = 1000, seed: int = 1234, keys: Sequence[str] = tuple(STRATA)
) -> DataFrame:
    """Joint draws: draw k of every age group of a symptom belongs to one node
    of the reference's grid. The reference's draws are systematic, in an order
    shuffled by seed and symptom; the others are drawn given the node."""
    keys = list(keys)
    rest = [k for k in keys if k != "age_group"]
    types = dict(fit.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                mu, ls, ref_mu, ref_ls = (np.asarray(v) for v in (r.mu, r.ls, r.ref_mu, r.ref_ls))
                name = "|".join(str(getattr(r, k)) for k in rest)
                order = seeded(seed, name).permutation(n_draws)
                total = np.cumsum(r.ref_prob)
                node = np.searchsorted(total, (order + 0.5) / n_draws * total[-1]).clip(max=len(total) - 1)
                big_j, big_i = np.divmod(node, len(ref_mu))
                if r.is_ref:
                    at_mu, at_ls = ref_mu[big_i], ref_ls[big_j]
                else:
                    u = seeded(seed, f"{name}|{r.age_group}").random((2, n_draws))
                    like = np.asarray(r.like).reshape(len(ls), len(mu))
                    near = _kernel(ref_mu, mu, r.contrast_sd)
                    if r.shared:
                        j = big_j
                    else:
                        along = _log_sum(like[:, None, :] + near[None], 2)  # own sigma x reference mu
                        log_j = _kernel(ref_ls, ls, r.contrast_sd)[big_j] + along[:, big_i].T
                        j = _pick(np.exp(log_j - log_j.max(axis=1, keepdims=True)), u[0])
                    log_i = like[j] + near[big_i]
                    i = _pick(np.exp(log_i - log_i.max(axis=1, keepdims=True)), u[1])
                    at_mu, at_ls = mu[i], ls[j]
                out = {k: getattr(r, k) for k in keys}
                yield pd.DataFrame({**out, "draw": np.arange(1, n_draws + 1, dtype="int32"), "mu": at_mu, "sigma": np.exp(at_ls)})

    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    return fit.mapInPandas(run, f"{schema}, draw int, mu double, sigma double")


def posterior_summary(posterior: DataFrame, keys: Sequence[str] = tuple(STRATA)) -> DataFrame:
    """Posterior mean and standard deviation of mu and sigma."""
    p = F.col("prob")

    def mean(c: str) -> Column:
        return F.sum(F.col(c) * p)

    def sd(c: str) -> Column:
        return F.sqrt(F.greatest(F.sum(F.col(c) * F.col(c) * p) - mean(c) * mean(c), F.lit(0.0)))

    return posterior.groupBy(*keys).agg(
        mean("mu").alias("mu_mean"),
        sd("mu").alias("mu_sd"),
        mean("sigma").alias("sigma_mean"),
        sd("sigma").alias("sigma_sd"),
        F.sum(p).alias("mass"),
    )


def draw_duration(
    posterior: DataFrame,
    n_draws: int = 1000,
    seed: int = 1234,
    keys: Sequence[str] = tuple(STRATA),
    shuffle: bool = True,
) -> DataFrame:
    """n_draws systematic draws of (mu, sigma) per stratum.

    Draw k sits at probability (k - 1/2) / n of the cumulated posterior, so
    each node unfolds its own draws and nothing is searched. ``shuffle``
    numbers them in an order hashed from seed, stratum and k. Windows span one
    stratum's nodes or draws, both fixed by the arguments.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("j", "i")
    cumulated = posterior.withColumn("hi", F.sum("prob").over(w)).withColumn("total", F.sum("prob").over(W.partitionBy(*keys)))
    edge = lambda c: F.floor(c / F.col("total") * n_draws + 0.5)
    first = F.coalesce(F.lag("last").over(w), F.lit(0)) + 1
    drawn = (
        cumulated.withColumn("last", edge(F.col("hi")).cast("int"))
        .withColumn("first", first)
        .filter(F.col("last") >= F.col("first"))
        .select(*keys, "mu", "sigma", F.explode(F.sequence("first", "last")).alias("draw"))
    )
    if shuffle:
        order = W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, "draw"), "draw")
        drawn = drawn.withColumn("draw", F.row_number().over(order))
    return drawn.select(*keys, "draw", "mu", "sigma")


def sensitivity_draws(
    delays: DataFrame,
    variants: Sequence[DurationVariant] = ALL_VARIANTS,
    n_draws: int = 1000,
    seed: int = 1234,
    shuffle: bool = True,
) -> DataFrame:
    """Draws of (mu, sigma) per analysis, variant, stratum and draw index. All
    variants are fitted together; equal fits are made once and listed under
    each variant that asks for them."""
    draws = draw_duration(fit_variants(delays, variants), n_draws, seed, ["fit", *STRATA], shuffle)
    listed = F.array(
        *[F.struct(F.lit(v.fit).alias("f"), F.lit(v.analysis).alias("analysis"), F.lit(v.variant).alias("variant")) for v in variants]
    )
    fanned = draws.withColumn("_v", F.explode(F.filter(listed, lambda v: v["f"] == F.col("fit"))))
    return fanned.select("_v.analysis", "_v.variant", *STRATA, "draw", "mu", "sigma")


VARIANT = ["analysis", "variant", *STRATA]


def sensitivity_summary(draws: DataFrame) -> DataFrame:
    """Mean and quantiles of the expected duration per variant and stratum."""
    return duration_summary(draws, VARIANT)


def sensitivity_density(draws: DataFrame) -> DataFrame:
    """Bands of the densities per variant, stratum and duration."""
    return density_bands(density_grid(draws), VARIANT)


def _one_analysis(delays: DataFrame, variants: Sequence[DurationVariant], n_draws: int, seed: int, name: str) -> DataFrame:
    draws = sensitivity_draws(delays, variants, n_draws, seed).withColumnRenamed("variant", name).drop("analysis")
    return duration_summary(draws, [name, *STRATA])


def duration_window_sensitivity(
    delays: DataFrame,
    extensions: Sequence[int] = tuple(WINDOW_EXTENSIONS),
    compared: Sequence[int] = (0, 3, 7),
    n_draws: int = 1000,
    seed: int = 1234,
) -> DataFrame:
    """Expected-duration summaries per window extension, under default priors.
    All extensions are fitted together; only ``compared`` ones are reported."""
    variants = [v for v in WINDOW_VARIANTS if v.window_extension in extensions]
    variants += [DurationVariant("window", str(e), e) for e in extensions if e not in WINDOW_EXTENSIONS]
    out = _one_analysis(delays, variants, n_draws, seed, "window_extension")
    out = out.withColumn("window_extension", F.col("window_extension").cast("int"))
    return out.filter(F.col("window_extension").isin(list(compared)))


def duration_sigma_sensitivity(delays: DataFrame, n_draws: int = 1000, seed: int = 1234) -> DataFrame:
    """Expected-duration summaries with sigma shared by the age groups ("mu")
    and by age group ("mu_sigma"), under default priors."""
    return _one_analysis(delays, SIGMA_VARIANTS, n_draws, seed, "formula_name")


def duration_prior_sensitivity(delays: DataFrame, n_draws: int = 1000, seed: int = 1234) -> DataFrame:
    """Expected-duration summaries under the stated and the default priors."""
    return _one_analysis(delays, PRIOR_VARIANTS, n_draws, seed, "priors")
