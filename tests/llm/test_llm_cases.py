"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from symptra.llm import chosen_path, huffman, langid, lmscore, mixing, nbsvm, nndescent, packing, spotsigs, toxicity
from symptra.llm.common import run_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "the long river runs to the quiet sea and turns " * 30_000
EXTRA = ["bucket", "rep", "key", "size", "rank", "n", "copies", "rows", "first", "score", "label", "start", "length", "_n", "target"]


@pytest.fixture(scope="module")
def hard(spark):
    same = "a quick brown fox jumps over the lazy dog near the old mill"
    rows = [
        (1, same, "en", "web"),
        (2, same, "en", "web"),
        (2, same, "en", "web"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, LONG, "en", "books"),
        (6, "  \t\n", None, "web"),
        (7, "123 456 !!", "de", "web"),
        (None, same, "en", "web"),
        (None, None, None, None),
        (8, "der alte Fuchs und die Mühle am Fluß", "de", "news"),
        (9, "\U0001f600 İstanbul   odd", None, "news"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in EXTRA:
        docs = docs.withColumn(name, F.lit(7))
    return docs.cache()


@pytest.fixture(scope="module")
def no_docs(hard):
    return hard.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(1, 1, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_jaccard_join(hard, no_docs):
    out = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(hard).collect()]
    assert sorted(out, key=str) == sorted(
        [(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (None, None, 0), (8, 8, 0), (9, 9, 0)],
        key=str,
    )
    kept = chosen_path.one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None, None], key=str)
    assert chosen_path.jaccard_join(no_docs).count() == 0
    assert chosen_path.one_of_each(no_docs).count() == 0


def test_mixing(hard, no_docs):
    out = mixing.mix(mixing.word_sizes(hard)).collect()
    assert len(out) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert {r["taken"] for r in out if r["doc_id"] in (3, 4, 6)} == {0}
    assert len({r["taken"] for r in out if r["doc_id"] == 2}) == 1
    assert mixing.mixed_documents(hard).columns == hard.columns
    assert mixing.mix(mixing.word_sizes(no_docs)).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_packing(hard, no_docs):
    out = packing.pack_documents(hard, VOCABULARY).collect()
    assert {r["doc_tokens"] for r in out if r["doc_id"] in (3, 4)} == {1}
    assert sum(r["length"] for r in out if r["doc_id"] == 5) == next(r["doc_tokens"] for r in out if r["doc_id"] == 5)
    assert sum(r["start"] == 0 for r in out) == 12
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


@pytest.mark.parametrize(
    "fit, score, keep",
    [
        (toxicity.fit_toxicity, toxicity.score_toxicity, toxicity.drop_toxic),
        (nbsvm.fit_quality, nbsvm.score_quality, nbsvm.keep_good),
    ],
)
def test_classifiers(hard, no_docs, labels, fit, score, keep):
    model = fit(hard, labels)
    out = score(hard, model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4)}) == 1
    assert all(r["held_out"] is False for r in out if r["doc_id"] is None)
    assert keep(hard, model).columns == hard.columns
    assert score(no_docs, model).count() == 0
    for nothing in (fit(hard, labels.limit(0)), fit(no_docs, labels)):
        assert len({r["score"] for r in score(hard, nothing).collect()}) == 1


def test_fingerprints(hard, no_docs):
    out = spotsigs.fingerprints(hard).collect()
    assert len(out) == 12
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert {r["n_chars"] for r in out if r["doc_id"] in (3, 4)} == {0}
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next"))
    alone = spotsigs.fingerprints(hard.filter("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    assert spotsigs.fingerprints(no_docs).count() == 0
    assert spotsigs.similar_pairs(no_docs).count() == 0


def test_language_model_scores(hard, no_docs):
    target = hard.filter("doc_id = 1").select("text")
    out = lmscore.score_documents(hard, lmscore.fit_models(hard, target, min_count=1)).collect()
    assert len(out) == 12
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in out)
    assert lmscore.score_documents(hard, lmscore.fit_models(hard, target.limit(0))).count() == 12
    assert lmscore.score_documents(no_docs, lmscore.fit_models(no_docs, target)).count() == 0


def test_languages(hard, no_docs):
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(hard, langid.fit_languages(hard)).collect()}
    assert {(3, "und"), (4, "und"), (6, "und"), (7, "und"), (None, "und")} <= out
    assert len({p for d, p in out if d in (1, 2)}) == 1
    none = langid.predict_languages(hard, langid.fit_languages(no_docs)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.predict_languages(no_docs, langid.fit_languages(hard)).count() == 0


def test_token_files(spark, hard, no_docs):
    path = run_folder(spark)
    huffman.write_encoded(hard, path, VOCABULARY)
    out = sorted((r["start"], r["n_tokens"]) for r in huffman.read_encoded(spark, path).collect())
    assert len(out) == 12
    assert [s for s, _ in out] == [sum(n for _, n in out[:i]) for i in range(12)]
    path = run_folder(spark)
    huffman.write_encoded(no_docs, path, VOCABULARY)
    assert huffman.read_encoded(spark, path).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(1, 30)] + [
        (100, [1.0, 1.0, 1.0]),
        (100, [1.0, 1.0, 1.0]),
        (200, None),
        (300, [0.0, 0.0, 0.0]),
        (400, [1.0, None, 2.0]),
        (500, [1.0, nan, 2.0]),
        (600, [1.0, 2.0]),
        (None, [1.0, 1.0, 1.0]),
        (31, [1.0, 1.0, 1.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("node", "v", "ids", "far", "query", "own", "vec"):
        vectors = vectors.withColumn(name, F.lit(1))
    out = nndescent.nearest(vectors).collect()
    assert {r["query_id"] for r in out} == {100}
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in out)
    assert first[0] == (1, 1, 0.0) and first[1] == (2, 31, 0.0)
    few = nndescent.nearest(vectors.filter("vec_id IN (1, 2, 100)"))
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert nndescent.nearest(vectors.limit(0)).count() == 0
    assert nndescent.nearest(vectors.filter("vec_id = 200")).count() == 0
