"""The pipeline's stages against brute-force versions on what each was given."""

import importlib

import corpus_pipeline
from symptra.llm import mixing, nbsvm, toxicity
from test_llm_results import brute_join


def test_each_stage_works_on_what_the_one_before_kept(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == names
    ids = {n: [r[0] for r in df.select("doc_id").collect()] for n, df in given.items()}

    scored = toxicity.score_toxicity(given["toxicity"], toxicity.fit_toxicity(given["toxicity"], labels))
    assert sorted(ids["quality"]) == sorted(r["doc_id"] for r in scored.filter("score < 0.3").collect())
    scored = nbsvm.score_quality(given["quality"], nbsvm.fit_quality(given["quality"], labels))
    assert sorted(ids["near_duplicates"]) == sorted(r["doc_id"] for r in scored.filter("score >= 0.7").collect())
    rows = [(r["doc_id"], r["text"] or "") for r in given["near_duplicates"].collect()]
    assert sorted(ids["mixing"]) == sorted({c for c, _ in brute_join(rows).values()})
    copies = mixing.mix(mixing.word_sizes(given["mixing"])).collect()
    assert sorted(ids["packing"]) == sorted(r["doc_id"] for r in copies for _ in range(r["copies"]))
    assert docs.filter("start = 0").count() == len(ids["packing"])

    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == docs.count() and whole.exceptAll(docs).count() == 0


def test_registered_queries():
    entry = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in entry
    assert sorted(int(q[2:].split("_")[0]) for q in entry if q.startswith("op")) == list(range(1, 14))
