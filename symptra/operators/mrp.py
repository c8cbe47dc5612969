"""Multilevel regression for prevalence: penalised logistic fit by iterated
Spark aggregations, and posterior draws on the prediction grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import stored
from ..functions.glm import (
    GPBasis,
    choose_penalties,
    normal_draws,
    one_hot,
    penalty_diagonal,
    seeded,
    solve_penalised,
)
from ..schema import AGE_GROUPS, REGIONS
from .prevalence import poststratify

N_DRAWS = 1000


@dataclass(frozen=True)
class MRPSpec:
    """Terms of the linear predictor.

    ``groups`` is a column with an unpenalised indicator per level (with every
    other term off this is the saturated model). ``reference_response`` counts
    trials, not trials minus outcomes, as failures.
    """

    intercept: bool = True
    window: bool = True
    trend_length: float | None = 50.0
    age_trend_length: float | None = 20.0
    basis_size: int = 10
    region: bool = True
    age_main_effect: bool = False
    groups: str | None = None
    group_levels: Sequence[str] = tuple(AGE_GROUPS)
    region_penalty: float | None = None
    reference_response: bool = False


SATURATED_BY_AGE = MRPSpec(
    intercept=False, window=False, trend_length=None, age_trend_length=None, region=False, groups="age_group"
)


class Design:
    """Maps covariates to model columns; built from the spec and the last day."""

    def __init__(self, spec: MRPSpec, t_max: int):
        self.spec = spec
        self.blocks: dict[str, slice] = {}
        self.penalised: list[str] = []
        self.width = 0
        if spec.intercept:
            self._block("intercept", 1)
        if spec.window:
            self._block("window", 1)
        if spec.age_main_effect:
            self._block("age", len(AGE_GROUPS) - 1)
        if spec.groups:
            self._block("groups", len(spec.group_levels))
        if spec.trend_length:
            self.trend, k = GPBasis(t_max, spec.trend_length, spec.basis_size).evaluator()
            self._block("trend", k, penalised=True)
        if spec.age_trend_length:
            self.age_trend, k = GPBasis(t_max, spec.age_trend_length, spec.basis_size).evaluator()
            for a in range(len(AGE_GROUPS)):
                self._block(f"trend_{a}", k, penalised=True)
        if spec.region:
            self._block("region", len(REGIONS), penalised=True)

    def _block(self, name: str, size: int, penalised: bool = False) -> None:
        self.blocks[name] = slice(self.width, self.width + size)
        self.width += size
        if penalised:
            self.penalised.append(name)

    def penalty_slices(self) -> list[slice]:
        return [self.blocks[n] for n in self.penalised]

    def columns(self) -> list[str]:
        spec = self.spec
        wanted = {
            "t": spec.trend_length or spec.age_trend_length,
            "age_group": spec.age_trend_length or spec.age_main_effect,
            "region_name": spec.region,
            "window_submission": spec.window,
        }
        out = [c for c, used in wanted.items() if used]
        return out + ([spec.groups] if spec.groups and spec.groups not in out else [])

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(pdf), self.width))
        if "intercept" in self.blocks:
            x[:, self.blocks["intercept"]] = 1.0
        if "window" in self.blocks and "window_submission" in pdf:
            x[:, self.blocks["window"]] = pdf["window_submission"].to_numpy(float)[:, None]
        if "groups" in self.blocks:
            x[:, self.blocks["groups"]] = one_hot(pdf[self.spec.groups], self.spec.group_levels)
        if "age" in self.blocks or self.spec.age_trend_length:
            ages = one_hot(pdf["age_group"], AGE_GROUPS)
        if "age" in self.blocks:
            x[:, self.blocks["age"]] = ages[:, 1:]
        if "trend" in self.blocks:
            x[:, self.blocks["trend"]] = self._by_day(self.trend, pdf["t"])
        if self.spec.age_trend_length:
            basis = self._by_day(self.age_trend, pdf["t"])
            for a in range(len(AGE_GROUPS)):
                x[:, self.blocks[f"trend_{a}"]] = basis * ages[:, [a]]
        if "region" in self.blocks:
            x[:, self.blocks["region"]] = one_hot(pdf["region_name"], REGIONS)
        return x

    @staticmethod
    def _by_day(evaluate, t: pd.Series) -> np.ndarray:
        days, index = np.unique(t.to_numpy(float), return_inverse=True)
        return evaluate(days)[index]


COEFFICIENTS = (
    "symptom string, beta array<double>, cov array<double>, log10_penalty array<double>, "
    "edf double, deviance double, iterations int, t_max int, converged boolean"
)
FAN_IN = 16  # partial sums added in one task
SENT_BYTES = 64 << 20  # of draws sent to the tasks at once
CHUNK_VALUES = 1 << 21  # linear predictors held at once


def _model_cells(cells: DataFrame, design_columns: Sequence[str]) -> DataFrame:
    """Cells summed to what the model sees; unknown covariates are left out."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cells.select("symptom", *design_columns, "n_trials", "n_outcome")
        .dropna()
        .groupBy("symptom", *design_columns)
        .agg(F.sum("n_trials").alias("n_trials"), F.sum("n_outcome").alias("n_outcome"))
        .repartition(parts, "symptom", *design_columns)
    )


def _counts(part: pd.DataFrame, reference: bool) -> tuple[np.ndarray, np.ndarray]:
    """Successes and trials of the response."""
    y = part["n_outcome"].to_numpy(float)
    return y, part["n_trials"].to_numpy(float) + (y if reference else 0.0)


def _added_up(rows: DataFrame, finish, schema: str) -> DataFrame:
    """Arrays ``s`` summed per symptom in two levels, so no task adds more than
    the partitions of one branch; ``finish`` turns each symptom's sum into rows."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symptom": pdf["symptom"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

    branched = rows.withColumn("_b", F.floor(F.spark_partition_id() / FAN_IN))
    level = branched.groupBy("symptom", "_b").applyInPandas(total, "symptom string, s array<double>")
    return level.groupBy("symptom").applyInPandas(lambda pdf: finish(total(pdf)), schema)


def _normal_equations(cells: DataFrame, design: Design, betas) -> DataFrame:
    """Partial cross products of the working model, per task and symptom."""
    reference = design.spec.reference_response

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for symptom, part in pdf.groupby("symptom"):
                if symptom not in betas.value:
                    continue  # has converged
                x = design.matrix(part)
                y, m = _counts(part, reference)
                beta = betas.value[symptom]
                if beta is None:
                    start = (y + 0.5) / (m + 1.0)
                    eta = np.log(start / (1 - start))
                else:
                    eta = np.clip(x @ beta, -30, 30)
                p = 1 / (1 + np.exp(-eta))
                w = m * p * (1 - p)
                z = eta + (y - m * p) / w
                xw = x * w[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    lack = np.where(y > 0, y * np.log(y / (m * p)), 0.0)
                    lack = lack + np.where(m > y, (m - y) * np.log((m - y) / (m - m * p)), 0.0)
                row = np.concatenate([(xw.T @ x).ravel(), xw.T @ z, [w @ (z * z), 2 * lack.sum(), len(part)]])
                sums[symptom] = sums.get(symptom, 0.0) + row
        for symptom, row in sums.items():
            yield pd.DataFrame({"symptom": [symptom], "s": [row]})

    return cells.mapInPandas(partial, "symptom string, s array<double>")


SOLVED = "symptom string, beta array<double>, cov array<double>, pen array<double>, edf double, deviance double, done boolean"


def fit_mrp(
    cells: DataFrame,
    spec: MRPSpec = MRPSpec(),
    max_iterations: int = 25,
    tolerance: float = 1e-8,
    penalty_iterations: int = 6,
) -> DataFrame:
    """Penalised logistic regression per symptom -> coefficient table.

    Each iteration is one Spark job: tasks build partial normal equations,
    their sums go up a tree, and one task per symptom chooses the smoothing
    parameters (UBRE, during the first iterations) and solves. Its row is
    stored; the driver reads coefficients, deviance and whether the symptom is
    done, never a matrix. Cells with an unknown covariate are left out.
    ``converged`` is false where the iterations ran out.
    """
    spark = cells.sparkSession
    needed = Design(spec, 2).columns()
    data = stored(_model_cells(cells, needed))
    last_day = F.max("t") if "t" in needed else F.lit(1)
    last = {r["symptom"]: r["t"] for r in data.groupBy("symptom").agg(last_day.alias("t")).collect()}
    if not last:
        return spark.createDataFrame([], COEFFICIENTS)
    t_max = int(max(last.values()))
    design = Design(spec, t_max)
    slices, width = design.penalty_slices(), design.width
    region = design.penalised.index("region") if "region" in design.penalised else None

    def solver(iteration: int, deviances: dict, penalties: dict):
        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            symptom, s = pdf["symptom"].iloc[0], np.asarray(pdf["s"].iloc[0])
            gram, rhs = s[: width * width].reshape(width, width), s[width * width : width * (width + 1)]
            total, deviance, n = s[width * (width + 1) :]
            before, pen = deviances[symptom], penalties[symptom]
            done = iteration > 2 and abs(deviance - before) <= tolerance * (abs(deviance) + 0.1)
            done = bool(done and iteration > min(penalty_iterations, 3))
            if slices and iteration <= penalty_iterations and not done:
                pen = choose_penalties(gram, rhs, total, n, slices, pen, "ubre")
                if spec.region_penalty is not None and region is not None:
                    pen[region] = np.log10(spec.region_penalty)
            beta, cov, edf = solve_penalised(gram, rhs, penalty_diagonal(width, slices, pen))
            row = (symptom, beta, cov.ravel(), [float(v) for v in pen], edf, float(deviance), done)
            return pd.DataFrame([row], columns=["symptom", "beta", "cov", "pen", "edf", "deviance", "done"])

        return finish

    betas: dict[str, np.ndarray | None] = dict.fromkeys(last)
    deviances, penalties = dict.fromkeys(last, np.inf), {s: [1.0] * len(slices) for s in last}
    tables: list[DataFrame] = []
    chosen: dict[str, tuple[int, float, bool]] = {}  # symptom -> table, deviance, converged
    for iteration in range(1, max_iterations + 1):
        sent = spark.sparkContext.broadcast(betas)
        solved = _added_up(_normal_equations(data, design, sent), solver(iteration, deviances, penalties), SOLVED)
        tables.append(stored(solved))
        sent.unpersist()
        for r in tables[-1].drop("cov").collect():  # one short row per symptom
            symptom = r["symptom"]
            if r["done"]:  # the coefficients before this step are kept, its deviance is theirs
                chosen[symptom] = (iteration - 2, r["deviance"], True)
                del betas[symptom]
                continue
            chosen[symptom] = (iteration - 1, r["deviance"] if iteration > 1 else np.inf, False)
            betas[symptom], penalties[symptom] = np.asarray(r["beta"]), list(r["pen"])
            if iteration > 1:
                deviances[symptom] = r["deviance"]
        if not betas:
            break
    final = None
    for k in sorted({c[0] for c in chosen.values()}):
        names = [s for s, c in chosen.items() if c[0] == k]
        facts = F.create_map(
            *[v for s in names for v in (F.lit(s), F.struct(F.lit(float(chosen[s][1])).alias("d"), F.lit(chosen[s][2]).alias("c")))]
        )[F.col("symptom")]
        part = tables[k].filter(F.col("symptom").isin(names)).select(
            "symptom",
            "beta",
            "cov",
            F.col("pen").alias("log10_penalty"),
            "edf",
            facts["d"].alias("deviance"),
            F.lit(iteration).alias("iterations"),
            F.lit(t_max).alias("t_max"),
            facts["c"].alias("converged"),
        )
        final = part if final is None else final.unionByName(part)
    return final


TAILS = 8.0  # degrees of freedom of the proposals
BURN_IN = 200


def _proposals(beta: np.ndarray, cov: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n draws of a multivariate t around the fit, with their log densities."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    z = rng.standard_normal((n, len(beta))) * np.sqrt(TAILS / rng.chisquare(TAILS, n))[:, None]
    root = vectors * np.sqrt(np.clip(values, 0, None))
    return beta + z @ root.T, -0.5 * (TAILS + len(beta)) * np.log1p((z * z).sum(axis=1) / TAILS)


def _log_likelihoods(cells: DataFrame, design: Design, draws: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Binomial log likelihood of every draw of every symptom, in one
    aggregation over the cells."""
    sent = cells.sparkSession.sparkContext.broadcast(draws)
    reference = design.spec.reference_response

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for symptom, part in pdf.groupby("symptom"):
                if symptom not in sent.value:
                    continue
                b = sent.value[symptom].T
                step = max(1, CHUNK_VALUES // b.shape[1])
                for start in range(0, len(part), step):
                    rows = part.iloc[start : start + step]
                    y, m = _counts(rows, reference)
                    eta = design.matrix(rows) @ b
                    sums[symptom] = sums.get(symptom, 0.0) + (y @ eta - m @ np.logaddexp(0.0, eta))
        for symptom, row in sums.items():
            yield pd.DataFrame({"symptom": [symptom], "s": [row]})

    rows = cells.mapInPandas(partial, "symptom string, s array<double>")
    out = _added_up(rows, lambda pdf: pdf, "symptom string, s array<double>").collect()
    sent.unpersist()
    return {r["symptom"]: np.asarray(r["s"]) for r in out}


def _walk(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Metropolis chain over independent proposals with the given log weights
    (target over proposal density): the proposal held at each step."""
    held = np.empty(len(weights), int)
    at = int(np.argmax(weights[:BURN_IN]))
    limits = np.log(rng.random(len(weights)))
    for k, limit in enumerate(limits):
        if limit < weights[k] - weights[at]:
            at = k
        held[k] = at
    return held


def coefficient_draws(
    fit: DataFrame,
    n_draws: int,
    seed: int,
    cells: DataFrame | None = None,
    spec: MRPSpec = MRPSpec(),
) -> Iterator[tuple[dict[str, np.ndarray], dict[str, float]]]:
    """Draws of the coefficients (n_draws x columns) and the share of accepted
    proposals, for as many symptoms at a time as SENT_BYTES allow.

    Without ``cells`` the draws are Gaussian around the penalised fit. With
    them, proposals with wider tails are corrected by a Metropolis chain for the
    exact penalised likelihood, which one aggregation evaluates for all
    proposals. The result depends on seed and symptom only."""
    facts = fit.select("symptom", "t_max", F.size("beta").alias("p")).collect()  # one short row per symptom
    if not facts:
        return
    design = Design(spec, max(r["t_max"] for r in facts))
    data = None if cells is None else stored(_model_cells(cells, design.columns()))
    n = n_draws + BURN_IN
    at_once = max(1, SENT_BYTES // (8 * n * max(r["p"] for r in facts)))
    names = sorted(r["symptom"] for r in facts)
    for start in range(0, len(names), at_once):
        some = names[start : start + at_once]
        draws: dict[str, np.ndarray] = {}
        offers, density, penalties = {}, {}, {}
        for r in fit.filter(F.col("symptom").isin(some)).collect():
            symptom, beta = r["symptom"], np.asarray(r["beta"])
            cov = np.asarray(r["cov"]).reshape(len(beta), len(beta))
            rng = seeded(seed, symptom)
            if data is None:
                draws[symptom] = normal_draws(beta, cov, n_draws, rng)
            else:
                offers[symptom], density[symptom] = _proposals(beta, cov, n, rng)
                penalties[symptom] = penalty_diagonal(design.width, design.penalty_slices(), r["log10_penalty"])
        accepted: dict[str, float] = {}
        if data is not None:
            likelihood = _log_likelihoods(data, design, offers)
            for symptom, offer in offers.items():
                target = likelihood[symptom] - 0.5 * (offer * offer) @ penalties[symptom]
                held = _walk(target - density[symptom], seeded(seed, f"walk {symptom}"))
                accepted[symptom] = float(np.mean(np.diff(held) != 0))
                draws[symptom] = offer[held[BURN_IN:]]
        yield draws, accepted


def draw_status(
    fit: DataFrame, cells: DataFrame, n_draws: int = N_DRAWS, seed: int = 1, spec: MRPSpec = MRPSpec()
) -> DataFrame:
    """Per symptom: whether the fit converged, and the share of proposals that
    the correction accepted, with the number of distinct draws."""
    rows = [
        (symptom, accepted[symptom], len(np.unique(draws[symptom], axis=0)))
        for draws, accepted in coefficient_draws(fit, n_draws, seed, cells, spec)
        for symptom in draws
    ]
    found = fit.sparkSession.createDataFrame(rows, "symptom string, accepted double, distinct_draws long")
    return fit.select("symptom", "iterations", "converged", "edf", "deviance").join(F.broadcast(found), "symptom")


def _each_batch(fit: DataFrame, make, *args) -> DataFrame:
    """The rows of ``make(draws)`` for every batch of symptoms."""
    out = None
    for draws, _ in coefficient_draws(fit, *args):
        rows = make(draws)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("the fit has no symptom")
    return out


def _spread(grid: DataFrame, symptoms: Sequence[str], keys: Sequence[str]) -> DataFrame:
    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.withColumn("symptom", F.explode(F.array(*[F.lit(s) for s in symptoms]))).repartition(
        parts, "symptom", *keys
    )


def _unpack_draws(df: DataFrame, array: str, out: str) -> DataFrame:
    others = [c for c in df.columns if c != array]
    value = F.when(~F.isnan(F.col("_v")), F.col("_v"))
    return df.select(*others, F.posexplode(array).alias("_i", "_v")).select(
        *others, (F.col("_i") + 1).alias("draw"), value.alias(out)
    )


def draw_linear_predictor(
    fit: DataFrame,
    grid: DataFrame,
    n_draws: int = N_DRAWS,
    seed: int = 1,
    spec: MRPSpec = MRPSpec(),
    cells: DataFrame | None = None,
) -> DataFrame:
    """Posterior draws of the linear predictor for every grid row and symptom,
    corrected where the ``cells`` are given (:func:`coefficient_draws`).

    Tasks return one array of draws per grid row; Spark unfolds it to rows. The
    result depends on seed and symptom only.
    """
    design = Design(spec, fit.agg(F.max("t_max")).first()[0])
    needed = design.columns()

    def make(draws: dict[str, np.ndarray]) -> DataFrame:
        shared = grid.sparkSession.sparkContext.broadcast(draws)

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for symptom, part in _chunks(batches, n_draws):
                eta = design.matrix(part) @ shared.value[symptom].T
                yield pd.DataFrame({"symptom": symptom, "row_id": part["row_id"].to_numpy(), "eta": list(eta)})

        spread = _spread(grid.select("row_id", *needed), sorted(draws), ["row_id"])
        arrays = spread.mapInPandas(predict, "symptom string, row_id long, eta array<double>")
        return _unpack_draws(arrays, "eta", "fitted")

    return _each_batch(fit, make, n_draws, seed, cells, spec)


def _chunks(batches: Iterator[pd.DataFrame], n_draws: int) -> Iterator[tuple[str, pd.DataFrame]]:
    """One symptom's rows at a time, as many as CHUNK_VALUES draws allow."""
    step = max(1, CHUNK_VALUES // n_draws)
    for pdf in batches:
        for symptom, part in pdf.groupby("symptom"):
            for start in range(0, len(part), step):
                yield symptom, part.iloc[start : start + step]


def prevalence_draws(
    fit: DataFrame,
    grid: DataFrame,
    weights: DataFrame,
    population: DataFrame,
    n_draws: int = N_DRAWS,
    seed: int = 1,
    spec: MRPSpec = MRPSpec(),
    cells: DataFrame | None = None,
) -> DataFrame:
    """Draws, window reweighting and poststratification in one pass.

    ``grid`` has no window column: the window effect is a shift of the linear
    predictor, so all window days of a cell are averaged inside the task and
    the window-fold larger intermediate table never exists. With ``cells`` the
    draws are corrected (:func:`coefficient_draws`).
    """
    design = Design(spec, fit.agg(F.max("t_max")).first()[0])
    # one row per symptom and window day of the study
    rows = weights.select("symptom", "window_submission", "window_weight").collect()
    table: dict[str, list[tuple[float, float]]] = {}
    for r in rows:
        day = np.nan if r["window_submission"] is None else float(r["window_submission"])
        table.setdefault(r["symptom"], []).append((day, r["window_weight"]))
    slot = design.blocks.get("window")
    keys = ["submitted_at", "region_name", "age_group"]

    def make(draws: dict[str, np.ndarray]) -> DataFrame:
        shared = grid.sparkSession.sparkContext.broadcast((draws, {s: table.get(s, []) for s in draws}))

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            coefs, window = shared.value
            for symptom, part in _chunks(batches, n_draws):
                b = coefs[symptom]
                base = design.matrix(part) @ b.T
                shift = b[:, slot].ravel() if slot else np.zeros(len(b))
                p = np.zeros_like(base)
                for day, weight in window[symptom]:
                    p += weight / (1 + np.exp(-(base + day * shift)))
                yield part[["symptom", *keys]].reset_index(drop=True).assign(p=list(p))

        # all cells of a date in one task: later sums over age or region combine map-side
        spread = _spread(grid.select(*keys, "t"), sorted(draws), ["submitted_at"])
        schema = "symptom string, submitted_at date, region_name string, age_group string, p array<double>"
        return spread.mapInPandas(predict, schema).withColumnRenamed("p", "_p")

    arrays = _each_batch(fit, make, n_draws, seed, cells, spec)
    stratified = poststratify(arrays.withColumn("p", F.lit(1.0)), population).drop("p", "p_n")
    return _unpack_draws(stratified, "_p", "p").withColumn("p_n", F.col("p") * F.col("population"))
