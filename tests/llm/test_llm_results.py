"""Every text operator against a brute-force version, a round trip or held-out labels."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from symptra.llm import common, chosen_path, huffman, langid, lmscore, mixing, nbsvm, nndescent, packing, spotsigs, tokens, toxicity
from symptra.llm.common import run_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# near copies


def near_copies(seed=3):
    """Texts with every fifth word or fewer changed, and unrelated ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=200)
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
        if rng.random() < 0.5:
            rows.append(rows[-1])
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_join(rows, threshold=0.8, n=5):
    def runs(text):
        w = text.split()
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}
    links = Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("options", [{}, {"limit": 3}, {"limit": 2, "dense": 0.1}, {"limit": 3, "dense": 2.0}, {"limit": 2, "levels": 1}])
def test_jaccard_join_equals_brute_force(spark, options):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(docs, **options).collect()}
    assert found == brute_join(rows)


def test_jaccard_join_of_texts_without_ids_or_with_the_same(spark):
    rows = near_copies(5)
    named = [(None if i % 3 == 0 else i // 2, t) for i, t in rows]
    docs = spark.createDataFrame(named, "doc_id long, text string")
    found = sorted((r["n_links"] for r in chosen_path.jaccard_join(docs).collect()))
    assert found == sorted(links for _, links in brute_join(rows).values())


def shuffled_rows(df):
    """Rows that the exchanges of an executed query wrote."""

    def walk(node):
        name, metrics = node.nodeName(), node.metrics()
        own = metrics.apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def as_at_size(spark):
    """Joins as of large tables: Spark neither broadcasts a side nor filters one by itself."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_texts_and_signatures_that_no_pair_needs_are_not_shuffled(spark, as_at_size, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} of these") for i in range(3000)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = common.settled(chosen_path.class_table(docs, 5, 128))
    classes = common.settled(rows.selectExpr("xxhash64(set_key) rep", "set_key", "doc_id first", "text_key", "sig", "k"))
    few = spark.createDataFrame([(i,) for i in range(7, 3000, 150)], "first long")  # a filter by values would pass to the texts
    needed = common.settled(classes.join(few, "first").select("rep", "set_key", "first", "text_key"))
    found = chosen_path._members(docs, needed, 5)
    assert {r["rep"] for r in found.collect()} == {r["rep"] for r in needed.collect()} and needed.count() == 20
    assert 20 < shuffled_rows(found) < 500
    held = needed.selectExpr("rep", "first % 2 bucket")
    judged = chosen_path._judged(held, classes, 9, 128, 0.5, True)
    assert len(judged.collect()) == 20
    assert shuffled_rows(judged) < 1500  # 9 places of each set, and the sets


def test_rows_that_are_perhaps_in_a_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, str(i % 7), i) for i in range(20_000)] + [(None, "0", -1)], "a long, b string, c long")
    keys = df.filter("c % 40 = 3").select("a", "b")
    needed = df.join(keys, ["a", "b"])
    passed = common.perhaps_in(df, keys, "a", "b")
    assert passed.columns == df.columns
    assert needed.count() == 500 and passed.join(keys, ["a", "b"]).count() == 500
    assert passed.count() < 500 + 20_000 // 32
    assert common.perhaps_in(df, keys.limit(0), "a", "b").count() == 0
    assert common.perhaps_in(df, df.unionByName(df), "a", "b").exceptAll(df).count() == 0
    assert common.perhaps_in(df, df, "a", "b").count() == 20_001
    monkeypatch.setattr(common, "MOST", 9)  # too few bits: more pass, none is lost
    crowded = common.perhaps_in(df, keys, "a", "b")
    assert crowded.count() > passed.count() and crowded.join(keys, ["a", "b"]).count() == 500


def test_filters_send_only_the_text_and_keep_all_columns(spark):
    docs = spark.createDataFrame(
        [(1, "good", 5), (2, None, 6), (3, "bad words", 7)], "doc_id long, text string, `boolean` int"
    )
    kept = common.keep_where(docs, "text", lambda t: "bad" not in t, lambda: None)
    assert kept.dtypes == docs.dtypes and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(1, "good", 5), (2, None, 6)]


def test_caches_of_other_operators_are_emptied():
    emptied = []
    common.sole_cache("a", lambda: emptied.append("a"))
    common.sole_cache("a", lambda: emptied.append("a"))
    assert emptied == []
    common.sole_cache("b", lambda: emptied.append("b"))
    assert emptied == ["a"]


def test_one_of_each_keeps_the_first_of_each_class(spark):
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in chosen_path.one_of_each(docs).collect()}
    assert kept == {c for c, _ in brute_join(rows).values()}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    found = {r["node"]: r["root"] for r in chosen_path.components(chain).collect()}
    assert found == {i: 0 for i in range(1, 201)}


# mixing


def test_mix_meets_its_targets(spark, documents):
    rows = mixing.mix(mixing.word_sizes(documents)).collect()
    again = mixing.mix(mixing.word_sizes(documents.repartition(5))).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    size = Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    weight = dict(zip(sources, [3, 1, 2] * len(sources)))
    left, goal, open_ = 1.5 * sum(size.values()), {}, set(sources)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        goal |= {s: 2 * size[s] for s in over} if over else {s: left * weight[s] / total for s in open_}
        left -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    for s in sources:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine) / 2 + 1


def test_mixed_documents_repeat_as_the_mix_says(spark, documents):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(mixing.word_sizes(documents)).collect()}
    found = Counter(r["doc_id"] for r in mixing.mixed_documents(documents).select("doc_id").collect())
    assert found == Counter({d: n for d, n in copies.items() if n})


# packing


def test_packing_holds_every_id_once(spark, documents, ids_of):
    pieces = packing.pack_documents(documents, VOCABULARY).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = ids_of(text) + [1]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    held = sum(p["length"] for p in pieces)
    assert held / (2048 * len(by_sequence)) > 0.95


def test_cut_lengths_and_best_fit():
    for n in [1, 2, 5, 2047, 2048, 2049, 4096, 5000, 123457]:
        lengths = packing.cut_lengths(n)
        assert sum(lengths) == n and all(0 < x <= 2048 for x in lengths)
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]


# toxicity


def test_maximal_segments_equal_their_definition():
    rng = np.random.default_rng(4)

    def recursive(scores, lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = scores[i:j].sum()
                if s > 0 and (best is None or s > best[2]):
                    best = (i, j, s)
        if best is None:
            return []
        return recursive(scores, lo, best[0]) + [best] + recursive(scores, best[1], hi)

    for _ in range(60):
        scores = rng.normal(-0.2, 1, rng.integers(0, 18))
        want = recursive(scores, 0, len(scores))
        found = toxicity.maximal_segments(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want])


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def held_out_rates(scored, labels, label):
    rows = scored.join(labels.select("doc_id", label), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows, np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity_scores_equal_the_formulas(spark):
    """Counts, scores and evidence of a small table, worked out plainly."""
    toxic = ["you are scum", "scum and trash", "trash you", "the scum"] * 6
    clean = ["the sea is calm", "you and the river", "a calm river", "the mill is old"] * 15
    rows = [(i, f"{t} {i % 7 * 'z'}".strip(), int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    seen = {}
    for i, text, label in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            seen[text] = max(label, seen.get(text, 0))
    counts = {}
    for text, label in seen.items():
        for key in {k for w in text.split() for k in toxicity.keys_of(w)}:
            counts.setdefault(key, [0, 0])[label] += 1
    counts = {k: c for k, c in counts.items() if sum(c) > 1}
    n0, n1 = (sum(c[y] for c in counts.values()) for y in (0, 1))
    share = n1 / (n0 + n1)
    for key, (c, t) in counts.items():
        score = math.log((t + 4 * share) / (c + 4 * (1 - share))) - math.log(n1 / n0)
        assert abs(model.weights.get(key, 0.0) - (score if abs(score) >= 1 else 0.0)) < 1e-9
    assert model.weights["scum"] > 1
    scores = toxicity.token_scores("the scum are scum and calm", model)
    best = max(sum(scores[a:b]) for a in range(6) for b in range(a + 1, 7))
    assert abs(toxicity.best_segment(scores) - best) < 1e-6
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(got[i] for i in range(len(toxic))) > max(got[i] for i in range(len(toxic), len(rows)))


def test_toxicity_on_held_out_labels(spark, sf_dir):
    # sf0.01 has 51 toxic labels in all, too few to learn from (accuracy 0.883, see the README)
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).cache()
    rows, right = held_out_rates(scored, labels, "toxic")
    judged = scored.filter("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    cut = judged.score[judged.toxic == 0].quantile(0.9)
    assert (judged.score[judged.toxic == 1] > cut).mean() >= 0.9  # at one false alarm in ten
    assert right >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in scored.filter("score < 0.3").collect()}


def test_quality_on_held_out_labels(larger):
    docs, labels = larger
    model = nbsvm.fit_quality(docs, labels)
    scored = nbsvm.score_quality(docs, model).cache()
    rows, right = held_out_rates(scored, labels, "quality")
    assert right >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = {r["doc_id"] for r in nbsvm.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in scored.filter("score >= 0.7").collect()}


def test_dual_descent_separates_the_separable():
    rows = [np.array(r) for r in ([0, 1], [0, 2], [3, 4], [3, 5])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    weights, bias = nbsvm.dual_descent(rows, y, np.ones(6), 10.0, 200, 1)
    margins = [weights[r].sum() / np.sqrt(len(r)) + bias for r in rows]
    assert all(m * s > 0.9 for m, s in zip(margins, y))


# nearest neighbours


@pytest.mark.parametrize("scale, forest", [(1.0, True), (1e-9, True), (1e6, True), (1e22, True), (1.0, False)])
def test_neighbours_are_found_and_measured_exactly(spark, sf_dir, scale, forest):
    """2000 vectors: more than a block, so the descent and the search find them."""
    vectors = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * scale))
    known = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect()}
    found = {}
    for r in nndescent.nearest(vectors, forest=forest).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert found.keys() == {i for i in known if i % 100 == 0}
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert s == pytest.approx(np.linalg.norm(known[q] - known[v]), rel=1e-12)
        best = heapq.nsmallest(10, ((np.linalg.norm(known[q] - x), v) for v, x in known.items() if v != q))
        hits += len({v for _, v in best} & {v for _, v, _ in rows})
        total += 10
    assert hits / total >= 0.9


# fingerprints


def brute_signatures(text):
    """Anchors and chains, word by word."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    anchors = set(spotsigs.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain, passed = [], 0
            for v in words[i + 1 :]:
                if v in anchors:
                    passed += 1
                    if passed == spotsigs.REACH:
                        break
                elif len(chain) < spotsigs.CHAIN:
                    chain.append(v)
            if chain:
                found.add((w, *chain))
    return found or {tuple(words)}


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(9)
    plain = ["river", "stone", "Löwe", "glass", "tree", "cloud", "horse", "mill"]
    texts = [" ".join(rng.choice(plain + spotsigs.ANCHORS[:8]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += ["", "123 !", texts[0], "\U0001f600 the cat sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: r for r in spotsigs.fingerprints(docs).collect()}
    assert len(found) == len(texts)

    def near(a, b):
        return len(a & b) / len(a | b)

    for i, text in enumerate(texts):
        following = texts[i - 1] if i else texts[-1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = found[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own = brute_signatures(text)
        assert r["near_edited"] == pytest.approx(near(own, brute_signatures(edited)))
        assert r["near_next"] == pytest.approx(near(own, brute_signatures(following)))
    assert found[0]["fingerprint"] == found[texts.index(texts[0], 1)]["fingerprint"]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for _ in range(10):
        base = [rng.choice(plain + spotsigs.ANCHORS[:6] * 5) for _ in range(90)]
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(90)] = rng.choice(plain)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(sorted(r[:2])): r[2] for r in spotsigs.similar_pairs(docs, 0.8).collect()}
    sets, first = {}, {}
    for i, t in rows:
        sets[i] = frozenset(brute_signatures(t))
        first.setdefault(sets[i], i)
    want = {}
    kept = sorted(first.values())
    for n, i in enumerate(kept):
        for j in kept[n + 1 :]:
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.8:
                want[i, j] = s
    assert want and found == pytest.approx(want)


# language models


def test_scores_equal_counts_by_hand(spark, sf_dir, documents):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    model = lmscore.fit_models(documents, target)
    found = {r["doc_id"]: r for r in lmscore.score_documents(documents, model).collect()}
    tokens = lambda text: lmscore.TOKEN.findall((text or "").lower())
    goal = [tokens(r["text"]) for r in target.collect()]
    words = {w for w, n in Counter(w for t in goal for w in t).items() if n >= 2}
    known = lambda t: ["<s>", *[w if w in words else "<unk>" for w in t]]
    rows = {r["doc_id"]: known(tokens(r["text"])) for r in documents.collect()}

    def counted(texts):
        one, two = Counter(), Counter()
        for t in texts:
            one.update(t)
            two.update(zip(t, t[1:]))
        return one, two, sum(one.values()) - one["<s>"]

    models = counted(map(known, goal)), counted(rows.values())
    assert len(words) + 1 < 1 << 10  # bigrams are counted exactly, without a hash

    def loss(t, one, two, total):
        out = 0.0
        for a, b in zip(t, t[1:]):
            single = (one[b] + 1) / (total + len(words) + 1)
            out -= np.log((two[a, b] + 10 * single) / (one[a] + 10))
        return out / (len(t) - 1)

    for doc_id, t in rows.items():
        r = found[doc_id]
        assert r["n_tokens"] == len(t) - 1
        if len(t) > 1:
            a, b = (loss(t, *m) for m in models)
            assert r["target_loss"] == pytest.approx(a, rel=1e-4)
            assert r["score"] == pytest.approx(a - b, rel=1e-3, abs=1e-4)


# languages


def test_languages_on_held_out_documents(larger):
    docs, _ = larger
    rows = langid.predict_languages(docs, langid.fit_languages(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    known = [r for r in rows if r["held_out"] and r["lang"] is not None and sum(c.isalpha() for c in r["text"] or "") >= 40]
    assert len(known) > 50
    assert np.mean([r["lang"] == r["lang_pred"] for r in known]) >= 0.97
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


# token files


def test_token_files_round_trip(spark, documents, ids_of):
    path = run_folder(spark)
    huffman.write_encoded(documents, path, VOCABULARY)
    found = {r["doc_id"]: r for r in huffman.read_encoded(spark, path).collect()}
    start = 0
    for r in documents.orderBy("doc_id").collect():
        ids = ids_of(r["text"]) + [2]
        f = found.pop(r["doc_id"])
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not found


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 200):
        counts = rng.integers(1, 10_000, n)
        lengths = huffman.code_lengths(counts, 20)
        assert np.sum(0.5 ** lengths) == 1 and lengths.max() <= 20
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((lengths * counts).sum()) == cost
    skewed = huffman.code_lengths(np.array([1 << i for i in range(30)]), 6)
    assert skewed.max() <= 6 and np.sum(0.5**skewed) <= 1


# token ids


def test_distinct_words_of_a_batch_are_looked_up_once():
    class Counted(tokens.Slots):
        calls = 0

        def __getitem__(self, key):
            self.calls += 1
            return super().__getitem__(key)

    coder = tokens.TokenIds(VOCABULARY)
    coder.slots = Counted()
    texts = ["The cat, the don't and the caf\u00e9 of the CAT " * 50] * 20
    first = coder.encode(texts)
    assert coder.slots.calls == len(coder.slots) < 10
    assert all(np.array_equal(first[0], x) for x in first)
    assert first[0].tolist() == coder.whole(texts[0])


def test_ids_are_those_of_the_library(ids_of):
    odd = "<| <|endoftext|> |> 's 'RE ''ve don't \x00 \x1c \x1f \x7f \x85 \xa0 \u00e9 \u00df \u0130 \u212a \u03a3 \u0301 \u2003 \u4e2d \u3000 \U0001f600 \xb2".split(" ")
    plain = list("abtsmdrevlTSMDRELV01_,.<|>'-\"  \t\n\v\f\r")
    rng = random.Random(7)
    coder = tokens.TokenIds(VOCABULARY)
    for turn in range(60):
        letters = plain + odd if turn % 2 else plain
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 20, 200]))) for _ in range(30)]
        for text, ids in zip(texts, coder.encode(texts)):
            assert ids.tolist() == ids_of(text), repr(text)
    near = [f"{x}{chr(p)}{y}" for p in range(0x80, 0x400) for x, y in (("", ""), ("a", "b"), ("\u00c9", "\u00d1"), ("1 ", "'s"))]
    assert [x.tolist() for x in coder.encode(near)] == [ids_of(t) for t in near]
    assert coder.encode([]) == []
    coder.known = False
    texts = ["", "a b", "\u00e9'S"]
    assert [x.tolist() for x in coder.encode(texts)] == [ids_of(t) for t in texts]
