"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share of the budget by weight, at most
``most`` times its own size; the excess is shared again by weight until no
target is above. A source's copies per document, target over size, split into
whole copies that every document gets for certain and a rest that is sampled:
documents are ranked by (U / (1 - U)) / (p / (1 - p)), random odds over the
odds of their inclusion, and the first ones are taken until the sample has
the rest's words, to the nearest document.

Ranks are found without bringing a source together: ranks fall into fixed
ranges, the ranges' words are summed, and only the documents of the one range
in which a source's rest ends are put in order.

So the sample is described by one row per source, and every document's copies
follow from its own row and that one, without moving texts.

U is a hash of doc_id (of the text, where that is null) and a seed, so reruns
agree. An optional weight column makes documents of one source more or less
likely: inclusion odds p / (1 - p) are multiplied by it.

Cases: a null text has size 0; documents of size 0 take nothing; a null source
is a source of its own, last in order; rows with equal ids in one source are
taken together or not at all; an empty table gives an empty result. Inner
columns start with ``_mix``, so extra columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import local_table, settled

RANGES = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def doc_key(doc_id: Column, text: Column) -> Column:
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, the number of words of the whole text, and a key."""
    return docs.select(
        "doc_id",
        "source",
        text_size(F.col("text")).alias("size"),
        doc_key(F.col("doc_id"), F.col("text")).alias("key"),
    )


def source_targets(
    spark: SparkSession, sources: DataFrame, weights: Sequence[float], budget: float, most: float
) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size).

    Sources are few; they come to the driver as one row each. All sources whose
    share is above their limit get the limit, and what is left is shared among
    the others, which ends after at most as many turns as there are sources.
    The total is a multiple of all sizes."""
    rows = [(r["source"], r["source_size"]) for r in sources.collect()]
    rows.sort(key=lambda r: (r[0] is None, [ord(c) for c in r[0] or ""]))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    left = budget * sum(n for _, n in rows)
    target = [0.0] * len(rows)
    open_ = [i for i, (_, n) in enumerate(rows) if n > 0]
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > most * rows[i][1]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = most * rows[i][1]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    data = [(s, n, t) for (s, n), t in zip(rows, target)]
    return local_table(spark, data, "source string, source_size long, target double")


def _placed(df: DataFrame, cuts: DataFrame, size: str, key: str, seed: int, weight: Column) -> DataFrame:
    """Adds a source's row, and the rank and range of each document."""
    # cuts: one row per source
    df = df.join(F.broadcast(cuts), df["source"].eqNullSafe(cuts["_mix_source"]), "left")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    df = df.withColumn("_mix_u", uniform)
    odds = F.col("_mix_part") / (1 - F.col("_mix_part")) * F.greatest(weight, F.lit(1e-9))
    sampled = (F.col("_mix_part") > 0) & (F.col(size) > 0)
    df = df.withColumn("_mix_rank", F.when(sampled, F.col("_mix_u") / (1 - F.col("_mix_u")) / odds))
    return df.withColumn("_mix_range", F.floor(F.col("_mix_rank") / (1 + F.col("_mix_rank")) * RANGES))


CUTS = (
    "_mix_source string, source_size long, target double, _mix_whole int, _mix_part double, _mix_end long, "
    "_mix_cut_rank double, _mix_cut_key long"
)


def sample_cuts(
    sizes: DataFrame, weights: Sequence[float], budget: float, most: float, seed: int, weight: Column
) -> DataFrame:
    """A row per source: its target, whole copies, sampled part, the range of
    ranks in which its sample ends, and the last document taken there."""
    spark = sizes.sparkSession
    targets = source_targets(
        spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most
    ).collect()
    rows = {}
    for r in targets:
        expected = r["target"] / r["source_size"] if r["source_size"] else 0.0
        whole = int(expected + 1e-9)  # a share within 1e-9 of a whole number is that number of copies
        rows[r["source"]] = [r["source"], r["source_size"], r["target"], whole, max(expected - whole, 0.0) if expected - whole > 1e-9 else 0.0, None, None, None]
    first = local_table(spark, list(map(tuple, rows.values())), CUTS)
    docs = _placed(sizes, first, "size", "key", seed, weight).filter(F.col("_mix_rank").isNotNull())
    by_range = docs.groupBy("source", "_mix_range").agg(
        F.sum("size").alias("_words"), F.first(F.col("_mix_part") * F.col("source_size")).alias("_rest")
    )
    order = W.partitionBy("source").orderBy("_mix_range")  # at most RANGES rows a source
    ends = (
        by_range.withColumn("_before", F.sum("_words").over(order) - F.col("_words"))
        .filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
        .select(F.col("source").alias("_s"), F.col("_mix_range").alias("_e"), "_before", "_rest")
    )
    ends = settled(ends)  # at most one row per source
    last = docs.join(F.broadcast(ends), docs["source"].eqNullSafe(ends["_s"]) & (F.col("_mix_range") == F.col("_e")))
    # take a document if that brings the sum nearer to the rest; equal ones together
    run = W.partitionBy("source").orderBy("_mix_rank", "key")
    near = F.col("_before") + F.sum("size").over(run) - F.col("size") / 2 <= F.col("_rest")
    taken = last.withColumn("_near", near).filter("_near").groupBy("source").agg(
        F.max(F.struct("_mix_rank", "key")).alias("_last")
    )
    for r in ends.collect():
        rows[r["_s"]][5] = r["_e"]
    for r in taken.collect():
        rows[r["source"]][6:] = [r["_last"]["_mix_rank"], r["_last"]["key"]]
    return local_table(spark, list(map(tuple, rows.values())), CUTS)


def with_copies(
    df: DataFrame, cuts: DataFrame, size: str, key: str, seed: int, weight: Column
) -> DataFrame:
    """Adds ``copies``, source_size and target."""
    df = _placed(df, cuts, size, key, seed, weight)
    inside = F.struct("_mix_rank", F.col(key).alias("k")) <= F.struct(
        F.col("_mix_cut_rank").alias("_mix_rank"), F.col("_mix_cut_key").alias("k")
    )
    sampled = (
        F.when(F.col("_mix_rank").isNull(), False)
        .when(F.col("_mix_end").isNull(), True)  # the part is the whole source, up to rounding
        .when(F.col("_mix_range") == F.col("_mix_end"), F.col("_mix_cut_rank").isNotNull() & inside)
        .otherwise(F.col("_mix_range") < F.col("_mix_end"))
    )
    copies = F.when(F.col(size) > 0, F.col("_mix_whole") + sampled.cast("int")).otherwise(0)
    return df.withColumn("copies", copies.cast("int")).drop(
        "_mix_source", "_mix_whole", "_mix_part", "_mix_end", "_mix_cut_rank", "_mix_cut_key", "_mix_u", "_mix_rank", "_mix_range"
    )


def mix(
    sizes: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
    doc_weight: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, source) per document.

    ``sizes`` has doc_id, source, size and key, and ``doc_weight`` if one is
    named."""
    weight = F.coalesce(F.col(doc_weight).cast("double"), F.lit(1.0)) if doc_weight else F.lit(1.0)
    kept = settled(sizes.select("doc_id", "source", "size", "key", *([doc_weight] if doc_weight else [])))
    cuts = sample_cuts(kept, weights, budget, most, seed, weight)
    return with_copies(kept, cuts, "size", "key", seed, weight).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "source",
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 20
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns."""
    sizes = settled(word_sizes(docs).select("source", "size", "key"))
    cuts = sample_cuts(sizes, weights, budget, most, seed, F.lit(1.0))
    names = docs.columns
    df = docs.withColumn("_mix_size", text_size(F.col("text"))).withColumn("_mix_key", doc_key(F.col("doc_id"), F.col("text")))
    cuts = cuts.drop("target").withColumnRenamed("source_size", "_mix_source_size")
    df = with_copies(df.withColumnsRenamed({"copies": "_mix_copies0"}) if "copies" in names else df, cuts, "_mix_size", "_mix_key", seed, F.lit(1.0))
    df = df.filter("copies > 0").withColumn("_mix_again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return df.select(*[F.col("_mix_copies0").alias(c) if c == "copies" else F.col(c) for c in names])
