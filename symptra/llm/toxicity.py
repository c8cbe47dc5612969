"""Toxic passages: maximum-scoring segments over token log-odds.

Fit. Words of labelled documents, and their beginnings of four to seven
letters, are counted in Spark by class, once per document. The score of such a
key is its log-odds between the classes under a Dirichlet prior: each key starts
with ``prior`` observations divided between the classes as all keys are, so rare
keys stay near zero and a key seen often, but never in clean text, scores high.
A token scores as the strongest of its keys, so inflected and unseen words are
covered. Every token also costs a drift. It makes the expected score negative on
any clean text, also in a language with a few more toxic documents than others,
as the theory of maximal segments needs; keys scored below it count nothing.

Search. One linear scan finds all maximal segments of a text (Ruzzo and Tompa).
For text of n tokens the best of them follows an extreme-value law on clean
text: P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda is the root of
E exp(lambda score) = 1 over clean tokens, K is fitted to clean documents.
Segments whose expected number by chance is below ``max_chance`` are the toxic
passages.

Score. The evidence of the best passage, of all passages together and their
number give a probability by a logistic fit on the labelled documents.

Cases: null and empty texts and texts without letters have no passage and get
the score of a text without evidence; repeated rows get equal scores; a null
doc_id is scored and not held out; without labelled documents of both classes
every score is the base rate. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fold, keep_where, labelled, map_arrow, map_batches, pieces, sole_cache

THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    drift: float
    decay: float  # lambda
    log_k: float
    max_chance: float
    coef: np.ndarray  # intercept and one per feature
    base: float

    def scores(self) -> TokenScores:
        cache = self.__dict__.get("_scores")
        if cache is None:
            cache = self.__dict__["_scores"] = TokenScores(self.weights)
        return cache

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their sums, in one pass.

    Neighbouring tokens of one sign are merged before, which changes no
    maximal segment's bounds; the pass keeps, for each candidate, the running
    total before it and after it."""
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(scores)]))
    totals = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    kept: list[list[float]] = []  # start, end, total before, total after
    for a, b in zip(starts.tolist(), ends.tolist()):
        if not positive[a]:
            continue
        new = [a, b, totals[a], totals[b]]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), float(r - l)) for a, b, l, r in kept]


BEGINNINGS = (4, 5, 6, 7)


def keys_of(word: str) -> list[str]:
    """The word and its proper beginnings, which end in a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


class TokenScores(dict):
    """Word to score, worked out when first asked for; emptied when large."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        get = self.weights.get
        value = self[word] = max((get(k, 0.0) for k in keys_of(word)), key=abs)
        return value


def _claim(model: ToxicityModel) -> None:
    sole_cache("toxicity", lambda: model.scores().clear())


def token_scores(text: str, model: ToxicityModel) -> np.ndarray:
    score = model.scores().__getitem__
    runs = [
        np.fromiter(map(score, words), np.float32, len(words))
        for part in pieces(text)
        if (words := WORD.findall(part.lower()))
    ]
    return (np.concatenate(runs) if runs else np.zeros(0, np.float32)) - np.float32(model.drift)


def best_segment(scores: np.ndarray) -> float:
    if not len(scores) or scores.max() <= 0:
        return 0.0
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    return float((total - np.minimum.accumulate(total)).max())


def passages(scores: np.ndarray, model: ToxicityModel) -> list[tuple[int, int, float]]:
    """The significant segments, with -log of their expected number by chance."""
    n = len(scores)
    floor = -math.log(model.max_chance)
    if not n or model.decay * best_segment(scores) - math.log(n) - model.log_k < floor:
        return []
    found = ((a, b, model.decay * s - math.log(n) - model.log_k) for a, b, s in maximal_segments(scores))
    return [x for x in found if x[2] >= floor]


def evidence(scores: np.ndarray, model: ToxicityModel) -> tuple[float, float, float]:
    """-log p of the best segment, the same per passage summed, and passages."""
    n = len(scores)
    if not n:
        return 0.0, 0.0, 0.0
    best = model.decay * best_segment(scores) - math.log(n) - model.log_k
    chance = -math.expm1(-math.exp(min(-best, 700.0)))  # extreme-value law
    first = min(-math.log(max(chance, 1e-300)), 60.0)
    if first < -math.log(-math.expm1(-model.max_chance)):
        return first, 0.0, 0.0
    found = passages(scores, model)
    return first, math.log1p(sum(x[2] for x in found)), math.log1p(len(found))


def _decay(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(x values) = 1."""
    low, high = 0.0, 1e-3
    excess = lambda x: float((share * np.exp(np.minimum(x * values, 700.0))).sum()) - 1.0
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a penalised logistic fit; the intercept comes first."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(a.shape[1])
        step = np.linalg.solve(hessian, a.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole_cache("toxicity", lambda: None)
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> Iterator[pa.RecordBatch]:
        words = [*counts[0], *(w for w in counts[1] if w not in counts[0])]
        if words:
            n = [[c[w] for w in words] for c in counts]
            yield pa.RecordBatch.from_pydict({"word": words, "clean": n[0], "toxic": n[1]})
        for c in counts:
            c.clear()

    for batch in source:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {w for part in pieces(text) for w in WORD.findall(part.lower())}
            counts[int(label > 0)].update({k for w in words for k in keys_of(w)})
        if len(counts[0]) + len(counts[1]) > 300_000:  # a bound on memory; sums come in the shuffle
            yield from rows()
    yield from rows()


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_rows: int = 20_000,
    max_keys: int = 200_000,
    prior: float = 4.0,
    drift: float = 1.0,
    max_chance: float = 0.05,
) -> ToxicityModel:
    """Learn from about ``max_rows`` labelled documents outside the held-out
    fold; the model holds the ``max_keys`` most frequent keys found in at least
    two documents."""
    train = labelled(docs, labels, label, F.coalesce(fold("doc_id", 4) == 2, F.lit(False)), max_rows)
    counts = (
        map_batches(train, _count, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    known = (
        counts.filter(F.col("clean") + F.col("toxic") > 1)
        .orderBy(F.desc(F.col("clean") + F.col("toxic")), "word")
        .limit(max_keys)
        .toPandas()
    )
    clean, toxic = known["clean"].to_numpy(float), known["toxic"].to_numpy(float)
    n0, n1 = clean.sum(), toxic.sum()
    blank = ToxicityModel({}, drift, 1.0, 0.0, max_chance, np.zeros(4), 0.0)
    if n0 and n1:
        # each key starts with ``prior`` observations divided as all keys are, so rare keys stay near zero
        score = np.log((toxic + prior * n1 / (n0 + n1)) / (clean + prior * n0 / (n0 + n1))) - math.log(n1 / n0)
        score = np.where(np.abs(score) < drift, 0.0, score)  # such keys raise no segment
        blank.weights = {w: float(s) for w, s in zip(known["word"], score) if s}
        # the law needs the scores of whole clean texts: the drift alone where no key is known
        share = np.concatenate((clean / n0, [max(1.0, float(clean[score == 0].sum()) / n0)]))
        blank.decay = _decay(np.concatenate((score, [0.0])) - drift, share / share.sum())
    model = blank
    spread = train.sparkSession.sparkContext.broadcast(model)

    def features(rows: pa.RecordBatch) -> pa.RecordBatch:
        m, out = spread.value, []
        _claim(m)
        for text in rows.column("text").to_pylist():
            s = token_scores(text, m)
            out.append((float(len(s)), best_segment(s) * m.decay))
        n, best = zip(*out)
        return pa.RecordBatch.from_pydict({"label": pa.array(rows.column("label").to_pylist(), pa.int64()), "n": n, "best": best})

    seen = map_arrow(train, features, "label long, n double, best double").toPandas()
    y = (seen["label"].to_numpy() > 0).astype(float)
    if len(seen):
        model.base = float(y.mean())
    calm = seen[(seen["label"] <= 0) & (seen["n"] > 0)]
    if len(calm):
        model.log_k = float((calm["best"] - np.log(calm["n"])).mean()) - 0.5772156649
    if 0 < y.sum() < len(y):
        again = train.sparkSession.sparkContext.broadcast(model)

        def full(rows: pa.RecordBatch) -> pa.RecordBatch:
            m = again.value
            _claim(m)
            x = [evidence(token_scores(t, m), m) for t in rows.column("text").to_pylist()]
            a, b, c = zip(*x)
            return pa.RecordBatch.from_pydict({"label": pa.array(rows.column("label").to_pylist(), pa.int64()), "a": a, "b": b, "c": c})

        f = map_arrow(train, full, "label long, a double, b double, c double").toPandas()
        model.coef = logistic(f[["a", "b", "c"]].to_numpy(), (f["label"].to_numpy() > 0).astype(float))
    else:
        model.coef = np.array([math.log((model.base + 1e-3) / (1 - model.base + 1e-3)), 0.0, 0.0, 0.0])
    return model


def toxicity_of(text: str, m: ToxicityModel) -> float:
    x = evidence(token_scores(text, m), m)
    z = float(m.coef[0] + np.dot(m.coef[1:], x))
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        _claim(m)
        s = [toxicity_of(x.as_py() or "", m) for x in rows.column("text")]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, first_word, end_word, evidence, passage): every significant
    passage, by word positions, with its words in lower case."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def find(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        out: list[tuple] = []
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            found = passages(token_scores(text or "", m), m)
            if found:
                words = [w for part in pieces(text) for w in WORD.findall(part.lower())]
                out += [(doc_id, a, b, e, " ".join(words[a:b])) for a, b, e in found]
        names = ["doc_id", "first_word", "end_word", "evidence", "passage"]
        columns = list(zip(*out)) if out else [[]] * 5
        types = [rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(
        docs.select("doc_id", "text"), find, f"doc_id {kind}, first_word long, end_word long, evidence double, passage string"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, "text", lambda t: toxicity_of(t, spread.value) < threshold, lambda: _claim(spread.value))
