"""Language identification by bit-sliced Bloom filters over letter n-grams.

All languages share one array of cells; bit l of a cell belongs to the filter
of language l, so one lookup (the AND of a few cells) returns the mask of all
languages that contain an n-gram. A text's mask bits are counted per language;
each count is corrected for the filter's false positives, and the language
with the largest share of the text's n-grams wins.

An n-gram belongs to a language if it is frequent there: at least ``rarest`` of
the language's n-grams, and at least ``relative`` times its share in the
language that has most of it. Texts are lowered; runs of other characters than
letters count as one space.

Cases: a null text or one without a letter is ``und`` with score 0; a text whose
n-grams no filter knows, and a tie, goes to the language that sorts first among
the best; repeated rows get equal results; a null lang teaches nothing; without
any learned language all rows are ``und``. Very long texts are counted in parts
and their counts added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fold, map_arrow, pieces

SIZES = (3, 4)
CELLS = 1 << 20
HASHES = 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not LETTER:
        LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return LETTER[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the text each belongs to. An
    n-gram lies in one text and has at most one space, at one of its ends."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(points), dtype=np.int32), [len(p) for p in points])
    flat = np.concatenate(points)
    flat = np.where(_letters()[flat], flat, 32).astype(np.uint64)
    space = flat == 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    flat, owner, space = flat[keep], owner[keep], space[keep]
    hashes, owners = [], []
    for n in SIZES:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ flat[i : i + m]) * MULTIPLIERS[0]
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        ok = (owner[:m] == owner[n - 1 :]) & ~inner
        h = h[ok]
        hashes.append(h ^ (h >> np.uint64(29)))
        owners.append(owner[:m][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owners)


def cells_of(h: np.ndarray, i: int, cells: int) -> np.ndarray:
    return ((h * MULTIPLIERS[i + 1]) >> np.uint64(32)) & np.uint64(cells - 1)


def fit_languages(
    docs: DataFrame,
    lang: str = "lang",
    max_rows: int = 20_000,
    max_ngrams: int = 40_000,
    cells: int = CELLS,
    rarest: float = 2e-6,
    relative: float = 0.2,
) -> dict:
    """Learn from about ``max_rows`` documents outside the held-out fold; a
    filter holds the ``max_ngrams`` most frequent of its language's n-grams."""
    known = docs.filter(
        F.col(lang).isNotNull() & F.col("text").isNotNull() & ~F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    ).select("doc_id", F.col(lang).alias("lang"), "text")
    share = max_rows / max(known.select("doc_id").count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        langs = rows.column("lang").to_pylist()
        out: dict[str, dict] = {}
        for first, texts in batches(rows):
            for name in sorted(set(langs[first : first + len(texts)])):
                h, _ = ngrams([p for i, t in enumerate(texts) if langs[first + i] == name for p in pieces(t)])
                keys, n = np.unique(h, return_counts=True)
                out.setdefault(name, []).append((keys, n))
        names, keys, n = [], [], []
        for name, found in out.items():
            names += [name] * sum(len(k) for k, _ in found)
            keys += [k for k, _ in found]
            n += [c for _, c in found]
        keys = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        n = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys), pa.array(n)], ["lang", "h", "n"])

    counts = map_arrow(known, count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}  # one row a language
    langs = sorted(totals)[:64]
    if not langs:
        return {"langs": [], "table": np.zeros(cells, np.uint64), "false": np.zeros(0)}
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, float(totals[k]))]), F.col("lang"))
    shares = counts.filter(F.col("lang").isin(langs)).withColumn("rate", rate)
    by_ngram = shares.groupBy("h").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    member = (
        by_ngram.select("h", "top", F.inline("all"))  # at most 64 languages each
        .filter((F.col("rate") >= rarest) & (F.col("rate") >= relative * F.col("top")))
    )
    kinds = np.uint64 if len(langs) > 32 else np.uint32 if len(langs) > 8 else np.uint8
    cell = np.zeros(cells, kinds)
    for i, name in enumerate(langs):
        own = member.filter(F.col("lang") == name).orderBy(F.desc("rate"), "h").limit(max_ngrams).select("h").toPandas()
        h = own["h"].to_numpy(np.int64).view(np.uint64)
        for k in range(HASHES):
            cell[cells_of(h, k, cells).astype(np.int64)] |= kinds(1 << i)
    fill = [float(((cell >> kinds(i)) & kinds(1)).mean()) for i in range(len(langs))]
    return {"langs": langs, "table": cell, "false": np.array(fill) ** HASHES}


def hits(texts: list[str], m: dict) -> tuple[np.ndarray, np.ndarray]:
    """N-grams per text, and per text and language those that its filter has."""
    h, owner = ngrams(texts)
    mask = None
    for k in range(HASHES):
        got = m["table"][cells_of(h, k, len(m["table"])).astype(np.int64)]
        mask = got if mask is None else mask & got
    n = np.bincount(owner, minlength=len(texts))
    kind = m["table"].dtype.type
    found = [np.bincount(owner, ((mask >> kind(i)) & kind(1)), minlength=len(texts)) for i in range(len(m["langs"]))]
    return n, np.array(found).T.reshape(len(texts), len(m["langs"]))


def predict_languages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        names, scores = [], []
        for _, texts in batches(rows):
            parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
            at = np.array([i for i, _ in parts])
            n = np.zeros(len(texts), np.int64)
            found = np.zeros((len(texts), len(m["langs"])))
            for lo, hi in _runs([len(p) for _, p in parts]):
                a, b = hits([p for _, p in parts[lo:hi]], m)
                np.add.at(n, at[lo:hi], a)
                np.add.at(found, at[lo:hi], b)
            for i, text in enumerate(texts):
                if not m["langs"] or not any(c.isalpha() for c in text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                share = np.maximum(found[i] / max(n[i], 1) - m["false"], 0) / (1 - m["false"])
                best = int(share.argmax())
                names.append(m["langs"][best])
                total = float(share.sum())
                scores.append(float(share[best]) / total if total > 0 else 1 / len(m["langs"]))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    kind = dict(docs.dtypes)["doc_id"]
    out = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _runs(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` characters."""
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        held += s
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)
