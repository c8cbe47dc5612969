"""Quality classifier: linear support vectors on Naive-Bayes-scaled n-grams.

Features are the words and punctuation runs of a text and their neighbouring
pairs, as indicators, hashed into ``buckets``. Each indicator is scaled by the
log-ratio of its smoothed shares in the two classes; a linear hinge-loss model
on them is fitted by dual coordinate descent (Hsieh et al.), one document at a
time over a bounded sample of labelled rows, in one task. A fifth of the sample
is kept out of that fit and turns margins into probabilities by a logistic fit.

Cases: null and empty texts have no feature, so their score is that of the
intercept; repeated rows get equal scores; a null doc_id is scored and not held
out; without both classes in the sample every score is the base rate. A text of
any length is read whole: its distinct features are gathered piece by piece.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_where, labelled, map_arrow, map_batches, pieces, sole_cache
from .toxicity import logistic

THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 18
PAIR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:  # a cache, so it may be emptied
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_HASH = _Hashes()


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct buckets of a text's single tokens and neighbouring pairs."""
    found = []
    last: list[int] = []
    for part in pieces(text):
        tokens = TOKEN.findall(part.lower())
        h = np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))
        if not len(h):
            continue
        row = np.concatenate([np.array(last, np.uint64), h])
        both = np.concatenate([h, (row[:-1] * PAIR) ^ (row[1:] + MIX)]) * MIX
        found.append(np.unique((both >> np.uint64(40)) % np.uint64(buckets)))
        last = [int(h[-1])]
    if not found:
        return np.zeros(0, np.int32)
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))).astype(np.int32)




def log_ratio(rows: list[np.ndarray], y: np.ndarray, buckets: int, alpha: float) -> np.ndarray:
    """Of the smoothed shares of each feature in the classes +1 and -1."""
    p, q = np.full(buckets, alpha), np.full(buckets, alpha)
    for row, sign in zip(rows, y):
        (p if sign > 0 else q)[row] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(
    rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, epochs: int, seed: int
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over indicator features times ``scale``, with a bias
    as one more feature. Rows are brought to unit length; each step solves one
    document's dual variable exactly within [0, c]."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    norm = [1 / math.sqrt(s) if (s := float((scale[r] ** 2).sum())) > 0 else 0.0 for r in rows]
    dual = np.zeros(len(rows))
    diagonal = np.array([(1.0 if k else 0.0) + 1.0 for k in norm])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] * norm[i]
            slope = y[i] * (float(w[r] @ x) + bias) - 1
            new = min(max(dual[i] - slope / diagonal[i], 0.0), c)
            if step := (new - dual[i]) * y[i]:
                w[r] += step * x
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w, bias


def margin(row: np.ndarray, weights: np.ndarray, scale2: np.ndarray, bias: float) -> float:
    """Of one document; ``scale2`` holds the squared feature scales."""
    length = math.sqrt(float(scale2[row].sum())) if len(row) else 0.0
    return bias + (float(weights[row].sum()) / length if length else 0.0)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_rows: int = 12_000,
    buckets: int = BUCKETS,
    c: float = 1.0,
    alpha: float = 1.0,
    epochs: int = 12,
    seed: int = 11,
) -> dict:
    """Learn from about ``max_rows`` labelled documents outside the held-out
    fold. Returns the weights, squared scales, bias and calibration."""
    train = labelled(docs, labels, label, F.coalesce(fold("doc_id", 4) == 2, F.lit(False)), max_rows, seed=29)
    train = train.withColumn("spare", fold("doc_id", 5) == 0)

    def extract(rows: pa.RecordBatch) -> pa.RecordBatch:
        sole_cache("nbsvm", _HASH.clear)
        packed = [features(t.as_py(), buckets).tobytes() for t in rows.column("text")]
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").cast(pa.string()), rows.column("label").cast(pa.int64()), rows.column("spare"), pa.array(packed, pa.binary())],
            ["doc_id", "label", "spare", "row"],
        )

    def solve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(
            ((r["doc_id"], r["row"], r["label"], r["spare"]) for b in source for r in b.to_pylist()), key=lambda r: r[:3]
        )
        rows = [np.frombuffer(r[1], np.int32) for r in got]
        good = np.array([r[2] > 0 for r in got], bool)
        spare = np.array([r[3] for r in got], bool)
        use = ~spare if 0 < good[~spare].sum() < (~spare).sum() and 0 < good[spare].sum() < spare.sum() else np.ones(len(got), bool)
        w, scale, bias = np.zeros(buckets), np.zeros(buckets), 0.0
        base = (good.mean() if len(got) else 0.5) * 0.998 + 0.001
        coef = np.array([math.log(base / (1 - base)), 0.0])
        if 0 < good.sum() < len(good):
            y = np.where(good, 1.0, -1.0)
            chosen = [rows[i] for i in np.flatnonzero(use)]
            scale = log_ratio(chosen, y[use], buckets, alpha)
            w, bias = dual_descent(chosen, y[use], scale, c, epochs, seed)
            held = np.flatnonzero(spare) if not use.all() else np.arange(len(got))
            w = w * scale
            z = np.array([margin(rows[i], w, scale**2, bias) for i in held])
            coef = logistic(z[:, None], good[held].astype(float))
        yield pa.RecordBatch.from_pydict(
            {"w": [w.astype(np.float32).tobytes()], "s": [(scale**2).astype(np.float32).tobytes()], "bias": [float(bias)], "coef": [coef.tolist()]}
        )

    packed = map_arrow(train, extract, "doc_id string, label long, spare boolean, row binary")
    # one task: about max_rows rows, whatever the input
    got = map_batches(packed.repartition(1), solve, "w binary, s binary, bias double, coef array<double>").first()
    if got is None:
        return {"w": np.zeros(buckets, np.float32), "s": np.zeros(buckets, np.float32), "bias": 0.0, "coef": np.zeros(2), "buckets": buckets}
    return {
        "w": np.frombuffer(got["w"], np.float32),
        "s": np.frombuffer(got["s"], np.float32),
        "bias": got["bias"],
        "coef": np.array(got["coef"]),
        "buckets": buckets,
    }


def quality_of(text: str, m: dict) -> float:
    z = m["coef"][0] + m["coef"][1] * margin(features(text, m["buckets"]), m["w"], m["s"], m["bias"])
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        sole_cache("nbsvm", _HASH.clear)
        s = [quality_of(x.as_py() or "", m) for x in rows.column("text")]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at least ``threshold``, with all their columns."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, "text", lambda t: quality_of(t, spread.value) >= threshold, lambda: sole_cache("nbsvm", _HASH.clear))
