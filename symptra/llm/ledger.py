"""Quality rules kept as a ledger of bit masks, in DataFrame functions.

Every rule is evaluated once per document; the ledger keeps the measurements and
one long whose bit i tells that rule i failed. Policies are versioned masks: a
document is kept if none of a policy's rules failed. What each rule adds to a
policy follows from the counts per mask alone, without the texts.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A word is repeated if it lies in a
window of eight words that occurs twice or more in the text. Windows are compared
by 64-bit hashes of the eight words in order, built by doubling from two to four
to eight; within a text of 20,000 words two different ones meet with a chance of
about 1e-11.

Cases: a null text is an empty one, with no words; it fails rule 0 and, like
every text without words, no other rule; repeated rows have a row each; a null
doc_id stays null; an empty table gives an empty ledger. Texts of any length
are read whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# letters but capitals, with their marks, and blanks
PLAIN = r"[\p{Ll}\p{Lm}\p{Lo}\p{Lt}\p{M}\x20\x09-\x0D]+"
WINDOW = 8

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_letters", "n_digits", "n_upper", "n_ellipsis_lines", "n_bullet_lines",
]


@dataclass(frozen=True)
class Rule:
    """Fails where ``condition``, an expression over the measurements, holds."""

    name: str
    condition: str


# The position is the rule's bit. Rules are only ever appended.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "10 * word_chars < 22 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
    Rule("digits", "100 * n_digits > 30 * word_chars"),
    Rule("capitals", "100 * n_upper > 50 * word_chars"),
    Rule("ellipses", "n_lines > 1 AND 100 * n_ellipsis_lines > 30 * n_lines"),
    Rule("bullets", "n_lines > 1 AND 100 * n_bullet_lines > 90 * n_lines"),
]
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Named rules that each reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask(self.rules)


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


POLICIES = [
    Policy("base", 1, BASE),
    Policy("shape", 1, (*BASE, "many_words", "short_words", "long_words", "symbols")),
    Policy("shape", 2, tuple(r.name for r in RULES)),
]
CURRENT = POLICIES[-1]


def length_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements. Steps are columns of their own, so each is
    worked out once; the sort of windows runs only where one occurs twice."""
    text, words = F.col("text"), F.col("words")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("body", F.btrim(text, F.lit(BLANK)))
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "words": F.when(F.col("body") == "", none).otherwise(F.split("body", SPACE)),
            "lines": F.filter(F.split(text, "\n"), lambda v: F.btrim(v, F.lit(BLANK)) != ""),
            # what a text of plain words has little of
            "rest": F.regexp_replace(text, PLAIN, ""),
        }
    ).withColumn("n_words", F.size("words").cast("long"))

    # hashes of 2, 4 and 8 neighbouring words
    df = df.withColumn("hashes", words)
    for reach in (1, 2, 4):
        h = F.col("hashes")
        many = F.greatest(F.size(h) - reach, F.lit(0))
        pairs = F.zip_with(F.slice(h, F.lit(1), many), F.slice(h, F.lit(reach + 1), many), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("hashes", pairs)
    df = df.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    placed = F.sort_array(F.transform("hashes", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.col("again"), placed))

    def same(v: Column, k: Column) -> Column:
        return F.coalesce(F.get("placed", k)["h"] == v["h"], F.lit(False))

    twice = F.filter("placed", lambda v, k: same(v, k - 1) | same(v, k + 1))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda v: v["i"])))
    # a window adds its words up to the start of the next one
    added = F.transform("at", lambda v, k: F.least(F.coalesce(F.get("at", k + 1) - v, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(added, F.lit(0), lambda s, v: s + v)

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter("lines", lambda v: v.rlike(pattern)))

    rest = F.char_length("rest")
    others = F.char_length(F.regexp_replace("rest", r"\p{Lu}+", ""))
    df = df.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
    counts = {
        "n_symbols": rest - length_without(F.col("rest"), SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_letters": F.col("word_chars") - others,
        "n_digits": rest - length_without(F.col("rest"), "0123456789"),
        "n_upper": rest - others,
        "n_ellipsis_lines": lines_like(r"(\.\.\.|…)\s*$"),
        "n_bullet_lines": lines_like(r"^\s*[-*•]"),
    }
    df = df.withColumns({k: v.cast("long") for k, v in counts.items()})
    return df.select("doc_id", *MEASURES)


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    # a text without words fails the first rule only: the others' shares have nothing to count
    alone = F.when(F.col("n_words") == 0, F.lit(mask(("few_words",))).cast("long")).otherwise(bits)
    return measured(docs).withColumn("fail_bits", alone)


def write_ledger(docs: DataFrame, path: str) -> None:
    """The texts are read once, here; policies and ablations read this table."""
    ledger(docs).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def failed(names: tuple[str, ...]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long")) != 0


def verdicts(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy; documents that fail
    a base rule are never kept."""
    return entries.withColumn("base_failed", failed(BASE)).withColumn(
        "kept", ~F.col("base_failed") & ~failed(policy.rules)
    )


def ablations(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule of it: documents and words the policy rejects, those
    the rule fails, those it alone rejects, and what the policy without the
    rule rejects.

    The ledger is first counted per mask, so at most 2^rules rows meet the
    policies."""
    listed = [(p.name, p.version, p.mask, r, mask((r,))) for p in policies for r in p.rules]
    names = ["policy", "version", "mask", "rule", "bit"]
    counted = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    each = counted.withColumn(
        "asked",
        F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, names)]) for row in listed]),
    ).select("fail_bits", "docs", "words", F.inline("asked"))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    rest = F.col("fail_bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))

    def total(what: str, where: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(what))), F.lit(0)).alias(name)

    return each.groupBy("policy", "version", "rule").agg(
        total("docs", hit != 0, "rejected"),
        total("words", hit != 0, "rejected_words"),
        total("docs", F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, "failed"),
        total("docs", hit == F.col("bit"), "rejected_alone"),
        total("words", hit == F.col("bit"), "rejected_alone_words"),
        total("docs", rest != 0, "rejected_without"),
        F.bit_or(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits")).otherwise(0)).alias("seen_with"),
    )
