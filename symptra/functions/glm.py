"""Small numpy helpers used inside tasks by the regression operators."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LOG10_PENALTIES = np.arange(-3.0, 7.0, 1.0)


@dataclass(frozen=True)
class GPBasis:
    """Leading eigenvectors of a squared-exponential kernel on t = 1..t_max,
    scaled so that their prior is standard normal, and centred."""

    t_max: int
    length: float
    size: int = 10

    def _projection(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # every day, or, for long series, days at most an eighth of the length
        # scale apart, which the kernel does not tell from every day
        count = max(500, int(np.ceil(8 * self.t_max / self.length)))
        knots = np.unique(np.linspace(1, self.t_max, min(self.t_max, count)).round())
        kernel = np.exp(-(((knots[:, None] - knots[None, :]) / self.length) ** 2))
        values, vectors = np.linalg.eigh(kernel)
        keep = np.argsort(values)[::-1][: self.size]
        keep = keep[values[keep] > 1e-6 * values.max()]  # smaller ones only add rounding noise
        projection = vectors[:, keep] / np.sqrt(values[keep])
        signs = np.sign(projection[np.abs(projection).argmax(axis=0), np.arange(projection.shape[1])])
        projection = projection * signs
        return knots, projection, (kernel @ projection).mean(axis=0)

    def evaluator(self):
        knots, projection, centre = self._projection()

        def evaluate(t: np.ndarray) -> np.ndarray:
            k = np.exp(-(((np.asarray(t, float)[:, None] - knots[None, :]) / self.length) ** 2))
            return k @ projection - centre

        return evaluate, projection.shape[1]


def one_hot(values: Sequence[str], levels: Sequence[str]) -> np.ndarray:
    """Indicator columns; an unknown value gives a row of NaN."""
    lookup = {v: i for i, v in enumerate(levels)}
    codes = np.array([lookup.get(v, -1) for v in values])
    out = (codes[:, None] == np.arange(len(levels))[None, :]).astype(float)
    out[codes < 0] = np.nan
    return out


def solve_penalised(
    gram: np.ndarray, rhs: np.ndarray, penalty: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their covariance and the effective degrees of freedom."""
    inverse = np.linalg.pinv(gram + np.diag(penalty), hermitian=True)
    return inverse @ rhs, inverse, float(np.trace(inverse @ gram))


def penalty_diagonal(width: int, blocks: Sequence[slice], log10: Sequence[float]) -> np.ndarray:
    diag = np.full(width, 1e-9)
    for block, value in zip(blocks, log10):
        diag[block] = 10.0**value
    return diag


def choose_penalties(
    gram: np.ndarray,
    rhs: np.ndarray,
    total: float,
    n: float,
    blocks: Sequence[slice],
    start: Sequence[float],
    criterion: str,
    sweeps: int = 1,
) -> list[float]:
    """Coordinate search over log10 penalties on the weighted least-squares
    problem with cross products ``gram``, ``rhs`` and ``total``.

    ``ubre`` is the unbiased risk estimate at known scale; ``reml`` the
    restricted likelihood with the scale profiled out.
    """
    width = len(rhs)
    free = width - sum(b.stop - b.start for b in blocks)
    ridge = np.diag_indices(width)

    def score(log10: Sequence[float]) -> float:
        penalty = penalty_diagonal(width, blocks, log10)
        system = gram.copy()
        system[ridge] += penalty
        try:
            inverse = np.linalg.inv(system)
        except np.linalg.LinAlgError:
            return np.inf
        beta = inverse @ rhs
        if criterion == "ubre":
            rss = total - 2 * rhs @ beta + beta @ gram @ beta
            return (rss + 2 * (width - penalty @ inverse.diagonal())) / n
        dof = max(n - free, 1.0)
        scale = max((total - rhs @ beta) / dof, 1e-12)
        rank_term = sum((b.stop - b.start) * v * np.log(10) for b, v in zip(blocks, log10))
        return dof * np.log(scale) + np.linalg.slogdet(system)[1] - rank_term

    best = list(start)
    for _ in range(sweeps):
        for k in range(len(blocks)):
            trials = [[*best[:k], v, *best[k + 1 :]] for v in LOG10_PENALTIES]
            best = trials[int(np.argmin([score(t) for t in trials]))]
    return best


def seeded(seed: int, name: str) -> np.random.Generator:
    """Generator that depends on the seed and a key only, never on partitions."""
    return np.random.default_rng([seed, zlib.crc32(name.encode())])


def normal_draws(mean: np.ndarray, cov: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n draws (rows) of a multivariate normal with a possibly singular covariance."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    root = vectors * np.sqrt(np.clip(values, 0, None))
    return mean + rng.standard_normal((n, len(mean))) @ root.T


SHIFT = 12  # the series below are taken at arguments beyond it


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers."""
    product = sum(np.log(x + i) for i in range(SHIFT))
    z = x + SHIFT
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - product


def digamma(x: np.ndarray) -> np.ndarray:
    z = x + SHIFT
    series = 1 / (2 * z) + 1 / (12 * z**2) - 1 / (120 * z**4) + 1 / (252 * z**6) - 1 / (240 * z**8)
    return np.log(z) - series - sum(1 / (x + i) for i in range(SHIFT))


def trigamma(x: np.ndarray) -> np.ndarray:
    z = x + SHIFT
    series = 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9)
    return series + sum(1 / (x + i) ** 2 for i in range(SHIFT))
