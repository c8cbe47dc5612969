"""The text operators as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (
    chosen_path,
    huffman,
    langid,
    ledger,
    lmscore,
    mixing,
    nbsvm,
    nndescent,
    packing,
    rnsgemm,
    spotsigs,
    toxicity,
    whitening,
)
from .oracles import ORACLES as ORACLES
from .common import run_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


WORD_BPE = "word_bpe_49k.json"


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.word_sizes(table(spark, sf_dir, "documents")))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lmscore.score_documents(docs, lmscore.fit_models(docs, table(spark, sf_dir, "benchmark")))


@query
def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit_languages(docs))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark)
    huffman.write_encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return huffman.read_encoded(spark, path)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score_quality(docs, nbsvm.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnsgemm.hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark)
    ledger.write_ledger(table(spark, sf_dir, "documents"), path)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return ledger.verdicts(ledger.read_ledger(spark, path)).select(*base, "fail_bits")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
