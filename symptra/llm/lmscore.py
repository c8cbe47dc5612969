"""Cross-entropy difference of a target and a background language model.

Both models are bigram models over one vocabulary, the words that occur at
least ``min_count`` times in the target; every other word is one unknown word.
They have the same order and the same smoothing: a bigram's probability is
mixed with the unigram's by a Dirichlet prior of ``mass`` counts, the unigram's
with a uniform one. A document's score is its mean loss per token under the
target model less that under the background model, in nats: the lower, the more
it is like the target.

The target is counted over all its rows, the background over all documents.
Bigrams are counted in ``buckets`` cells, exactly while the vocabulary squared
fits and by a hash beyond. Every task adds up its own cells and sends them as
blocks; blocks are added in two levels, so no task gets all of them at once.
The finished tables have a fixed size and are broadcast.

Cases: a null, empty or wordless text has no tokens and null losses and score;
equal rows score equally; an empty target makes every word unknown, and the
score then compares nothing else; an empty documents table gives no rows. Texts
of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, pieces

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 21
BLOCK = 1 << 14
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(target: DataFrame, min_count: int = 2, max_words: int = 1 << 16) -> dict[str, int]:
    """Word to number, from 2 on: 0 is the start of a text, 1 the unknown word.
    The ``max_words`` most frequent words, if there are more."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for rows in source:
            for text in rows.column("text").to_pylist():
                for part in pieces(text):
                    found.update(TOKEN.findall(part.lower()))
            if len(found) > 300_000:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    words = (
        target.filter(F.col("text").isNotNull())
        .select("text")
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_count)
        .orderBy(F.desc("n"), "word")
        .limit(max_words)
        .select("word")
        .toPandas()["word"]
    )
    return {w: i + 2 for i, w in enumerate(words)}


def token_numbers(text: str, words: dict[str, int]) -> np.ndarray:
    """Word numbers of a text, after the start mark."""
    get = words.get
    found = [[0]]
    for part in pieces(text):
        tokens = TOKEN.findall(part.lower())
        found.append([get(t, 1) for t in tokens])
    return np.concatenate([np.array(f, np.int64) for f in found])


def cells(before: np.ndarray, word: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Cell of each bigram, unigrams' own cells come first."""
    pair = before * size + word
    if size * size <= buckets:
        return pair
    mixed = pair.astype(np.uint64) * MULTIPLIER
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, words: dict[str, int], buckets: int) -> np.ndarray:
    """Counts of unigrams, then of bigram cells, over all documents."""
    size = len(words) + 2
    total = size + buckets
    spread = docs.sparkSession.sparkContext.broadcast(words)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(total, np.int64)
        known = spread.value
        for rows in source:
            for text in rows.column("text").to_pylist():
                ids = token_numbers(text, known)
                if len(ids) > 1:
                    np.add.at(table, ids[1:], 1)
                    np.add.at(table, size + cells(ids[:-1], ids[1:], size, buckets), 1)
                    table[0] += 1
        yield from _blocks(table, TaskContext.get().partitionId())

    schema = "block int, task int, at binary, n binary"
    own = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(count, schema)
    n = parts(docs.sparkSession)
    part = own.withColumn("task", F.col("task") % 32)
    for keys in (["block", "task"], ["block"]):
        part = part.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_added, schema)
    table = np.zeros(total, np.int64)
    for row in part.toLocalIterator():  # a fixed number of cells in all
        at = row["block"] * BLOCK + np.frombuffer(row["at"], np.uint16).astype(np.int64)
        table[at] += np.frombuffer(row["n"], np.int64)
    return table


def _blocks(table: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(table), BLOCK):
        own = table[lo : lo + BLOCK]
        at = np.flatnonzero(own)
        if len(at):
            yield _row(lo // BLOCK, task, at, own[at])


def _row(block: int, task: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([n.tobytes()])],
        ["block", "task", "at", "n"],
    )


def _added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of one block; holds one block at a time."""
    key, held = None, np.zeros(BLOCK, np.int64)
    for rows in source:
        for block, task, at, n in zip(*(rows.column(c).to_pylist() for c in ("block", "task", "at", "n"))):
            if key is not None and block != key[0]:
                used = np.flatnonzero(held)
                yield _row(*key, used, held[used])
                held[:] = 0
            key = (block, task)
            held[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    if key is not None:
        used = np.flatnonzero(held)
        yield _row(*key, used, held[used])


def fit_models(
    documents: DataFrame, target: DataFrame, min_count: int = 2, max_words: int = 1 << 16, buckets: int = BUCKETS
) -> dict:
    """Tables of both models; both frames have ``text``."""
    words = vocabulary(target, min_count, max_words)
    return {
        "words": words,
        "buckets": buckets,
        "target": ngram_counts(target, words, buckets).astype(np.float32),
        "background": ngram_counts(documents, words, buckets).astype(np.float32),
    }


def loss(ids: np.ndarray, table: np.ndarray, size: int, buckets: int, mass: float) -> float:
    """Sum over the tokens of -log probability."""
    before, word = ids[:-1], ids[1:]
    total = float(table[1:size].sum(dtype=np.float64))
    single = (table[word] + 1.0) / (total + size - 1)
    pair = table[size + cells(before, word, size, buckets)]
    # a word's count as a context: all its occurrences; the start's: all texts
    return float(-np.log((pair + mass * single) / (table[before] + mass)).sum())


def score_documents(docs: DataFrame, model: dict, mass: float = 10.0) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score per document."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = spread.value
        size = len(m["words"]) + 2
        n, first, second = [], [], []
        for text in rows.column("text").to_pylist():
            ids = token_numbers(text or "", m["words"])
            k = len(ids) - 1
            n.append(k)
            first.append(loss(ids, m["target"], size, m["buckets"], mass) / k if k else None)
            second.append(loss(ids, m["background"], size, m["buckets"], mass) / k if k else None)
        gap = [None if a is None else a - b for a, b in zip(first, second)]
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (first, second, gap))],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
