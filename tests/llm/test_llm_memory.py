"""What Python workers hold, which an executor's memory has to hold with its own."""

import ctypes
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from symptra.llm import chosen_path, common, mixing, nbsvm, tokens, toxicity


def held_mb() -> float:
    pages = int(Path("/proc/self/statm").read_text().split()[1])
    return pages * 4096 / 1e6


def fill() -> list[bytes]:
    """About 100 MB, of which a small part, spread over all of it, is kept."""
    every = [b"x" * 1000 + str(i).encode() for i in range(100_000)]
    return every[::1000]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library has no malloc_trim")
def test_the_next_operator_finds_freed_memory_given_back():
    common.sole_cache("one", list)
    before = held_mb()
    kept = fill()
    assert held_mb() > before + 50
    common.sole_cache("two", list)
    assert held_mb() < before + 30 and len(kept) == 100


class Frame:
    """Keeps the function that a task would run."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library has no malloc_trim")
def test_a_task_gives_its_memory_back():
    kept = []

    def work(rows):
        kept.append(fill())
        return rows

    task = common.map_arrow(Frame(), work, "x long")
    rows = pa.RecordBatch.from_pydict({"x": [1]})
    before = held_mb()
    outputs = task(iter([rows]))
    assert next(outputs).num_rows == 1
    assert held_mb() > before + 50
    assert next(outputs, None) is None
    assert held_mb() < before + 30


def test_cached_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 500)
    coder = tokens.TokenIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j % 26)}q" for j in range(26)) for i in range(200)]
    for i in range(0, 200, 10):
        for text, ids in zip(texts[i : i + 10], coder.encode(texts[i : i + 10])):
            assert ids.tolist() == coder.whole(text)
        assert len(coder.slots) <= 500 + 10 * 26


def test_the_mix_starts_no_python_workers(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b", None), (3, "d", "x")], "doc_id long, text string, source string")
    sizes = mixing.word_sizes(docs)
    cuts = mixing.sample_cuts(sizes, (3, 1, 2), 1.5, 2.0, 20, F.lit(1.0))
    assert "ExistingRDD" not in cuts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["_mix_source"] or "", r["source_size"]) for r in cuts.collect()) == [("", 2), ("x", 4)]
    none = mixing.sample_cuts(sizes.limit(0), (3, 1, 2), 1.5, 2.0, 20, F.lit(1.0))
    assert none.count() == 0 and none.dtypes == cuts.dtypes


def test_hashes_of_words_are_bounded():
    words = [f"w{i}" for i in range(250_000)]
    for cache in (nbsvm._HASH, chosen_path._WORDS):
        cache.clear()
        most = 0
        for w in words:
            cache[w]
            most = max(most, len(cache))
        assert most <= 100_001
        cache.clear()


def test_counting_for_the_classifier_empties_the_caches_of_others():
    nbsvm.features("some words of another operator")
    common.sole_cache("nbsvm", nbsvm._HASH.clear)
    assert nbsvm._HASH
    rows = pa.RecordBatch.from_pydict({"text": ["good words", "bad words", ""], "label": [0, 1, 0]})
    out = pa.Table.from_batches(toxicity._count(iter([rows]))).to_pylist()
    assert not nbsvm._HASH
    found = {r["word"]: (r["clean"], r["toxic"]) for r in out}
    assert found["words"] == (1, 1) and found["good"] == (1, 0) and found["bad"] == (0, 1) and len(out) == len(found)
