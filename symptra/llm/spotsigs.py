"""SpotSigs document fingerprints in DataFrame functions.

A signature is an anchor, a common function word, with the chain of the next
``CHAIN`` content words (words that are no anchors) after it. The set of a
text's signatures, as 32-bit hashes, is its fingerprint: the set's size and its
members in ascending order. Fingerprints are compared by Jaccard similarity.

Words are runs of letters in lower case. A chain looks over at most ``REACH``
anchors that follow its own; where these have fewer content words between them,
or the text ends, the chain is shorter; an anchor with no content word after it
makes no signature. A text without any signature gets the hash of its words as
its only one, so equal texts have equal fingerprints and wordless texts are
alike.

Cases: a null text is an empty one; equal rows have equal fingerprints; null
doc_ids come last in the order of documents; a single document is its own next
one; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, settled, settled

# Common function words of the corpus languages.
ANCHORS = [
    *["the", "a", "an", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "as", "be", "by", "on", "are"],
    *["der", "die", "das", "und", "ein", "eine", "ist", "den", "nicht", "von", "mit", "sich", "auf", "für"],
    *["le", "la", "les", "et", "un", "une", "est", "des", "du", "que", "pas", "pour", "dans", "sur"],
    *["el", "los", "las", "y", "en", "por", "con", "no", "una", "es", "del", "se", "de", "para"],
]
CHAIN = 2
REACH = 6
ANCHOR = f" ({'|'.join(ANCHORS)})(?= )"


def plain_words(text: Column) -> Column:
    """' word word ... ' in lower case, a space on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, reach: int = REACH) -> DataFrame:
    """Adds the ascending distinct signature hashes of a text column.

    The steps are columns of their own, so each is worked out once per row."""
    words, between, anchors, found = (f"_{k}_{out}" for k in ("words", "between", "anchors", "found"))

    def sign(anchor: Column, i: Column) -> Column:
        after = F.concat(*[F.coalesce(F.get(F.col(between), i + k), F.lit("")) for k in range(1, reach + 1)])
        content = F.rtrim(F.substring_index(after, " ", chain + 1))
        return F.when(content != "", F.pmod(F.xxhash64(anchor, content), F.lit(1 << 32)))

    df = df.withColumn(words, plain_words(F.col(text)))
    df = df.withColumn(between, F.split(words, ANCHOR)).withColumn(
        anchors, F.regexp_extract_all(words, F.lit(ANCHOR), F.lit(1))
    )
    df = df.withColumn(found, F.sort_array(F.array_distinct(F.array_compact(F.transform(anchors, sign)))))
    alone = F.array(F.pmod(F.xxhash64(F.col(words)), F.lit(1 << 32)))
    return df.withColumn(out, F.when(F.size(found) > 0, F.col(found)).otherwise(alone)).drop(words, between, anchors, found)


def fingerprint(sigs: Column) -> Column:
    members = F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), members)


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): of the document before it by id, in order of
    descending ids; the last one's is the first's.

    Documents are dealt once into ranges of ids; a copy of the first document
    of the following range stands at the end of each, so every range finds its
    neighbours alone. Ids may repeat; such documents are ordered by text."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    width = max(2, round((4 * parts(spark)) ** 0.5))
    n = width * width
    # n cut points, evaluated once and used as constants
    cuts = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def above(values: list[int]) -> Column:
        if not values:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v < F.col("doc_id")))

    # first among the groups' last cuts, then among the cuts of one group
    top = above([g[-1] for g in groups[:-1]])
    inner = F.lit(0)
    for i, g in enumerate(groups):
        inner = F.when(F.col("_group") == i, above(g)).otherwise(inner)
    ranged = own.withColumn("_group", top).withColumn(
        "_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_group") * width + inner)
    )
    ranged = ranged.drop("_group")
    heads = ranged.groupBy("_range").agg(F.max("doc_id").alias("_head")).orderBy(F.desc("_range")).collect()  # n rows
    pairs = [(a["_range"], b["_range"], b["_head"]) for a, b in zip(heads, heads[1:] + heads[:1])]
    follow = spark.createDataFrame(pairs, "_to int, _from int, _head long")
    first = (
        ranged.join(F.broadcast(follow), (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_head")))
        .groupBy("_to")
        .agg(F.min("text").alias("text"))  # the first by text, if ids repeat
        .select(F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "text", F.col("_to").alias("_range"), F.lit(1).alias("_copy"))
    )
    order = W.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "text")
    all_rows = ranged.withColumn("_copy", F.lit(0)).unionByName(first)
    return all_rows.withColumn("next_text", F.lead("text").over(order))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every document (see the module)."""
    df = with_signatures(with_next(docs), "text", "_own")
    order = W.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "text")
    df = df.withColumn("_next", F.lead("_own").over(order)).filter(F.col("_copy") == 0)
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars").cast("int") - third)), F.substring("next_text", F.lit(1), third)
    )
    df = df.withColumn("_edited", edited)
    df = with_signatures(df, "_edited", "_edit")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprint(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(left_id, right_id, likeness) between the first documents of equal
    fingerprints whose likeness is at least ``threshold``.

    Sets are partitioned by length: partners' lengths differ at most by the
    factor ``threshold``, so a set meets those of its own length range and of
    the next one. Of each set only its rarest signatures are compared, as many
    as any partner must share one of."""
    sets = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    sets = settled(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("size", F.size("sigs")))
    each = sets.select("doc_id", "size", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    rare = W.partitionBy("doc_id").orderBy("n", "sig")
    start = each.join(often, "sig").withColumn("rank", F.row_number().over(rare))
    start = start.filter((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1) & (F.col("n") > 1))
    start = start.withColumn("band", F.floor(F.log("size") / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9))
    left = start.select(F.col("doc_id").alias("left_id"), F.col("size").alias("left_size"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = start.select(F.col("doc_id").alias("right_id"), F.col("size").alias("right_size"), "sig", "band")
    fits = (F.col("left_size") >= F.col("right_size") * threshold) & (
        (F.col("left_size") < F.col("right_size")) | ((F.col("left_size") == F.col("right_size")) & (F.col("left_id") < F.col("right_id")))
    )
    pairs = left.join(right, ["sig", "band"]).filter(fits).select("left_id", "right_id").distinct()
    a = sets.select(F.col("doc_id").alias("left_id"), F.col("sigs").alias("a"))
    b = sets.select(F.col("doc_id").alias("right_id"), F.col("sigs").alias("b"))
    return (
        pairs.join(a, "left_id")
        .join(b, "right_id")
        .select("left_id", "right_id", likeness(F.col("a"), F.col("b")).alias("likeness"))
        .filter(F.col("likeness") >= threshold)
    )
