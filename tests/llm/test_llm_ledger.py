"""The quality ledger against brute force; policies and ablations from it."""

import re
from collections import Counter

from pyspark.sql import functions as F

from symptra.llm import ledger
from symptra.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    lines = [v for v in text.split("\n") if WORD.search(v)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def measures(df):
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return sorted(((r["doc_id"], *(r[c] for c in wanted)) for r in df.collect()), key=str)


def test_measurements_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
    assert measures(ledger.ledger(docs)) == wanted


def test_hard_cases(spark):
    eight = "one two three four five six seven eight"
    texts = [
        None, "", " \t\r\n\x0b\x0c ", "a", "a " * 9, "a\n" * 40, f"{eight} {eight}", f"{eight} x {eight} y {eight}",
        f"{eight} nine ten two three four five six seven eight nine ten", "  non breaking  em",
        "\U0001f600 \U0001f600\U0001f600", "x \n x\nx \n\n  \nx", "# * $ % & | < > a", "1 2 3 4 5 6 7 8 9 10 " * 3, "LOUD " * 30,
        "the long river runs to the quiet sea and turns " * 5000, "\x00 nul \x1f unit", "word\x85word two", "- a\n* b\n• c",
    ]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(2, texts[6]), (2, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("words", "lines", "hashes", "at", "fail_bits", "kept", "rest", "n_words"):
        df = df.withColumn(name, F.lit(9))
    out = ledger.ledger(df)
    assert measures(out) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    bits = {r["doc_id"]: r["fail_bits"] for r in out.collect()}
    assert bits[0] == bits[1] == bits[2 - 1] == ledger.mask(("few_words",))
    assert bits[14] & ledger.mask(("capitals",)) and bits[18] & ledger.mask(("bullets",))
    assert ledger.verdicts(ledger.ledger(df.limit(0))).collect() == []
    assert ledger.ablations(ledger.ledger(df.limit(0))).count() == 0


def test_stored_ledger_serves_policies_and_ablations(spark, sf_dir, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write_ledger(table(spark, sf_dir, "documents"), path)
    entries = ledger.read_ledger(spark, path)
    rows = entries.collect()
    for policy in ledger.POLICIES:
        kept = {r["doc_id"] for r in ledger.verdicts(entries, policy).filter("kept").collect()}
        base = ledger.mask(ledger.BASE)
        assert kept == {r["doc_id"] for r in rows if not r["fail_bits"] & (policy.mask | base)}
    found = {(r["policy"], r["version"], r["rule"]): r for r in ledger.ablations(entries).collect()}
    for policy in ledger.POLICIES:
        for name in policy.rules:
            bit, hit = ledger.mask((name,)), [r["fail_bits"] & policy.mask for r in rows]
            got = found[policy.name, policy.version, name]
            assert got["rejected"] == sum(h != 0 for h in hit)
            assert got["failed"] == sum(h & bit != 0 for h in hit)
            assert got["rejected_alone"] == sum(h == bit for h in hit)
            assert got["rejected_without"] == sum(h & ~bit != 0 for h in hit)
            assert got["rejected_words"] == sum(r["n_words"] for r, h in zip(rows, hit) if h)


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    ledger.verdicts(ledger.ledger(table(spark, sf_dir, "documents"))).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
