"""Jaccard join of word n-gram sets by chosen paths.

Sets. A text's set is its distinct runs of five words (words are what stands
between ASCII white space; a shorter text is one run). Texts with equal sets
form a class at once, by a hash of the set; only classes are joined.

Join. A set gets a signature of ``SIZE`` minimum hashes; equal values at a place
are a shared token, with the sets' Jaccard similarity as probability. A run
samples one place for the root and puts sets with the same value there into one
bucket. Buckets that fit into one block (at most ``LIMIT`` sets with ``ELEMENTS``
members) are compared by brute force. Larger ones are split again:
every bucket samples ``fanout`` more places by a hash of its path, and its sets
go to one bucket for each of them. A bucket that splitting would not thin out,
because its sets agree at most places (the members resemble each other), or
that is still large at the last level, is left whole. A group of near copies
makes such buckets in every run, of nearly the same sets; so each is merged with
the largest one that most of its sets are in, and their union, a crowd, is
compared once by brute force in blocks of bounded size. Nothing is dropped. Runs and fanout follow from the
target recall for pairs at the threshold: a run of roots misses such a pair
with probability (1 - threshold) ** runs, a split one with
(1 - threshold) ** fanout; closer pairs are missed far more rarely.

Every pair is looked at once only: in the first crowd that holds both sets, or
else in the bucket of the first sampled place at which it agrees, at each level.
So links are counted where they are found, and
pairs are never listed: a bucket gives the links of each of its sets and the
edges of a spanning forest.

Check. Pairs whose signatures agree at fewer than ``FLOOR`` of the places are
passed over (a pair at the threshold does so with a probability below 1e-6);
all others are decided exactly on their sets, which are made again from the
texts for those classes alone.

Cases: null texts, and texts without words, have no set; each such row is a
class of its own without links. Equal texts, and equal rows, are one class. A
null doc_id takes part like any other; the class id is the smallest doc_id that
is not null. Very long texts have large sets, which are hashed piece by piece.
An empty table gives no rows. Only doc_id and text are read, so other columns
may have any names; ties do not occur, as nothing is ranked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, parts, perhaps_in, settled, sole_cache

N = 5
THRESHOLD = 0.8
SIZE = 128
FLOOR = 0.62  # five standard errors below the threshold
LIMIT = 4096  # sets of a bucket, or of a block of a crowd
SMALL = 256  # buckets that are compared however long their sets are
ELEMENTS = 1 << 22  # members of the sets of a block, on average at most
EDGES = 100_000  # in a partition, about
LEVELS = 3
DENSE = 0.5
SPARE = 3  # places more in splits, as some may have been sampled above
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:  # a cache, so it may be emptied
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``n`` words, ascending."""
    words = SPACE.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = max(len(h) - n + 1, 1)
    runs = np.full(m, min(len(h), n), np.uint64)
    for i in range(min(n, len(h))):
        runs = _mixed(runs + h[i : i + m] * ODD[0])
    return np.unique(runs)


def signature(s: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Minimum of ``size`` hashes over a set that is not empty, 32 bits each."""
    rng = np.random.default_rng(7)
    a = rng.integers(1 << 62, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 62, size=size, dtype=np.uint64)
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        h = s[lo : lo + 4096, None] * a + b
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=0))
    return (_mixed(low) >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def places(path: np.ndarray, count: int, size: int) -> np.ndarray:
    """The places that each bucket (a hash of its path) samples, in order."""
    steps = np.arange(count, dtype=np.uint64)
    first = _mixed(path[:, None] + ODD[1])
    stride = (_mixed(first + ODD[2]) | np.uint64(1)) % np.uint64(size)  # odd: no place twice
    return ((first + steps * stride) % np.uint64(size)).astype(np.int64)


def class_table(docs: DataFrame, n: int, size: int) -> DataFrame:
    """(doc_id, text_key, set_key, k, sig) of every row; no set: null key."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        sole_cache("chosen_path", _WORDS.clear)
        keys, counts, sigs = [], [], []
        for text in rows.column("text"):
            s = shingles(text.as_py(), n)
            counts.append(len(s))
            if len(s):
                h = s.tobytes()
                keys.append(_digest(h))
                sigs.append(signature(s, size).tobytes())
            else:
                keys.append(None)
                sigs.append(None)
        return pa.RecordBatch.from_arrays(
            [*rows.columns[:2], pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())],
            ["doc_id", "text_key", "set_key", "k", "sig"],
        )

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(texts, run, f"doc_id {kind}, text_key long, set_key string, k long, sig binary")


def _digest(data: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(data)


def _sampled(sets: DataFrame, count: int, size: int) -> DataFrame:
    """A row for each set and sampled place of its bucket: (rep, parent, place
    number, bucket, k). ``sets`` has rep, bucket, sig and k; a root's bucket is 0."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        path = rows.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(path), size)
        at = places(path, count, size)
        value = np.take_along_axis(sig, at, 1).astype(np.uint64)
        step = np.arange(count, dtype=np.uint64)
        bucket = _mixed(_mixed(path[:, None] + (step + np.uint64(1)) * ODD[4]) + value * ODD[0])
        take = pa.array(np.repeat(np.arange(len(path)), count))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("rep").take(take),
                rows.column("bucket").take(take),
                pa.array(np.tile(np.arange(count, dtype=np.int32), len(path))),
                pa.array(bucket.view(np.int64).ravel()),
                rows.column("k").take(take),
            ],
            ["rep", "parent", "step", "bucket", "k"],
        )

    return map_arrow(sets.select("rep", "bucket", "sig", "k"), run, "rep long, parent long, step int, bucket long, k long")


def _agreement(sets: DataFrame, count: int, size: int) -> DataFrame:
    """(parent, c): how many pairs of a bucket's sets agree at a place that it
    would sample next, on average. Counted in each batch before the shuffle."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        path = rows.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(path), size)
        value = np.take_along_axis(sig, places(path, count, size), 1).astype(np.uint64)
        step = np.tile(np.arange(count, dtype=np.uint64), len(path))
        seen, n = np.unique(np.stack([np.repeat(path, count), step, value.ravel()], 1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in seen.T.copy()), pa.array(n)], ["parent", "step", "value", "n"])

    seen = map_arrow(sets.select("bucket", "sig"), run, "parent long, step long, value long, n long")
    per = seen.groupBy("parent", "step", "value").agg(F.sum("n").alias("n"))
    return per.groupBy("parent").agg((F.sum(F.col("n").cast("double") * F.col("n")) / count).alias("same"))


def _groups(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key after the other, of input sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for rows in source:
        if not rows.num_rows:
            continue
        columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(rows.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(rows.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(group: pa.Table, size: int, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b), ascending and in parts of bounded size, of a task's members that are its own to decide and whose
    signatures agree often enough. Members are of one block, or of two, and
    then pairs go across. ``before`` holds the places sampled before the one of
    this bucket, at each level; ``crowds`` those that a set is in."""
    n = group.num_rows
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(n, size)
    side = group.column("side").to_numpy()
    paths = group.column("before").to_pylist()[0]
    before = np.array(paths, np.int64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    pair = int(group.column("pair")[0].as_py())
    across = pair > 0 and pair >> 31 != (pair & ((1 << 31) - 1)) - 1
    if not len(left) or across and not len(right):
        return
    rows, columns = (left, right) if across else (left, left)
    home = int(group.column("bucket")[0].as_py()) if pair else None
    others: dict[int, list[int]] = {}
    for i, crowds in enumerate(group.column("crowds").to_pylist()):
        for c in crowds or ():
            if home is None or c < home:
                others.setdefault(c, []).append(i)
    inside = []
    for held in others.values():
        if len(held) > 1:
            inside.append(np.zeros(n, bool))
            inside[-1][held] = True
    need = math.ceil(floor * size)
    step = max(1, (1 << 20) // max(1, len(columns)))
    across_places = np.ascontiguousarray(sig.T)
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        own = columns[None, :] > part[:, None] if not across else np.ones((len(part), len(columns)), bool)
        for p in before:
            own &= sig[part, p][:, None] != sig[columns, p][None, :]
        for held in inside:
            own &= ~(held[part][:, None] & held[columns][None, :])
        if np.count_nonzero(own) * 8 > own.size:
            alike = np.zeros(own.shape, np.uint16)
            for values in across_places:
                alike += values[part][:, None] == values[columns][None, :]
            a, b = np.nonzero(own & (alike >= need))
            yield part[a], columns[b]
            continue
        a, b = np.nonzero(own)
        a, b = part[a], columns[b]
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            near = (sig[x] == sig[y]).sum(axis=1) >= need
            yield x[near], y[near]


def _live(tasks: DataFrame, size: int, floor: float) -> DataFrame:
    """Of each task, the members that have a candidate partner in it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(source, ["bucket", "pair"]):
            if group.num_rows < 2:
                continue
            live = np.zeros(group.num_rows, bool)
            for a, b in _candidates(group, size, floor):
                live[a] = live[b] = True
            if live.any():
                use = group.take(pa.array(np.flatnonzero(live)))
                yield from use.drop_columns(["sig"]).combine_chunks().to_batches()

    return map_batches(tasks, run, tasks.drop("sig").schema)


def _links(live: DataFrame, size: int, floor: float, threshold: float) -> DataFrame:
    """(rep, links, other): links that a task adds to a set, in rows of the
    partners' classes, and an edge of the task's spanning forest."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(source, ["bucket", "pair"]):
            if group.num_rows < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
            k = np.array([len(s) for s in sets])
            rep = group.column("rep").to_numpy()
            rows_of = group.column("rows").to_numpy()
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            del sets
            cut = np.concatenate(([0], np.cumsum(k)))
            mark = np.zeros(int(number.max()) + 1, bool)
            links = np.zeros(len(k), np.int64)
            tree = np.arange(len(k))
            edges = []
            for a, b in _candidates(group, size, floor):
                starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
                for lo, hi in zip(starts, [*starts[1:], len(a)]):
                    i, others = int(a[lo]), b[lo:hi]
                    mark[number[cut[i] : cut[i + 1]]] = True
                    from_, to = int(others[0]), int(others[-1]) + 1
                    if len(others) * 4 > to - from_:
                        hits = mark[number[cut[from_] : cut[to]]].astype(np.int32)
                        both = np.add.reduceat(hits, cut[from_:to] - cut[from_])[others - from_]
                    else:
                        both = np.array([int(mark[number[cut[j] : cut[j + 1]]].sum()) for j in others])
                    mark[number[cut[i] : cut[i + 1]]] = False
                    linked = others[both >= threshold * (k[i] + k[others] - both) - 1e-9]
                    links[i] += int(rows_of[linked].sum())
                    links[linked] += rows_of[i]
                    fresh = linked[tree[linked] != tree[i]]
                    while len(fresh):
                        j = int(fresh[0])
                        edges.append((i, j))
                        tree[tree == tree[j]] = tree[i]
                        fresh = fresh[tree[fresh] != tree[i]]
            used = np.flatnonzero(links)
            if len(used):
                nothing = pa.nulls(len(used), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rep[used]), pa.array(links[used]), nothing], ["rep", "links", "other"])
                x, y = np.array(edges).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[x]), pa.array(np.zeros(len(x), np.int64)), pa.array(rep[y])], ["rep", "links", "other"]
                )

    return map_batches(live, run, "rep long, links long, other long")


def tasks_of(
    classes: DataFrame, runs: int, fanout: int, size: int, limit: int, levels: int, dense: float
) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, pair, side, before, rep): which sets each brute-force task
    compares; and the crowds, if there are any. ``classes`` has rep, sig and k."""
    level = classes.select("rep", F.lit(0).cast("long").alias("bucket"), F.array().cast("array<int>").alias("before"), "sig", "k")
    out = whole = paths = None
    more: list[DataFrame] = []
    for depth in range(levels):
        count = runs if depth == 0 else fanout
        rows = settled(_sampled(level, count, size))
        sizes = rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("step").alias("step"), F.sum("k").alias("total")
        )
        fits = (F.col("n") <= min(SMALL, limit)) | (F.col("n") <= limit) & (F.col("total") <= ELEMENTS)
        sizes = sizes.filter("n > 1").withColumn("fits", fits)
        before = _places_before(sizes, paths, count, size)
        small = before.filter("fits")
        large = settled(before.filter("NOT fits").drop("fits"))
        chosen = rows.select("rep", "bucket").join(small.select("bucket", "before"), "bucket")
        small_tasks = chosen.select("bucket", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "before", "rep")
        out = small_tasks if out is None else out.unionByName(small_tasks)
        if not large.take(1):
            break
        # rows of small buckets are done with
        sampled = settled(rows.select("rep", "bucket", "k", "step").join(large, "bucket"))
        if depth == 0:
            held = settled(_judged(sampled.filter("step = 0"), classes, fanout, size, dense, levels > 1))
            whole = settled(held.filter("alike").select("rep", "bucket", "n", "k"))
            sampled = sampled.filter("step > 0")
        first = whole.select("rep", F.col("bucket").alias("crowd"), F.col("n").alias("crowd_n"))
        sampled = sampled.join(first, "rep", "left")
        # a bucket whose sets are mostly in one crowd only adds the others to it
        votes = sampled.filter(F.col("crowd").isNotNull()).groupBy("bucket", "n", "crowd", "crowd_n").agg(F.count(F.lit(1)).alias("c"))
        joins = settled(votes.filter("2 * c > n").select("bucket", "crowd", "crowd_n"))
        rest = sampled.drop("crowd_n").join(joins.select("bucket", "crowd"), ["bucket", "crowd"], "left_anti").drop("crowd", "step")
        added = rest.drop("n").join(joins, "bucket").select("rep", F.col("crowd").alias("bucket"), F.col("crowd_n").alias("n"), "k")
        later = _judged(rest.join(joins, "bucket", "left_anti"), classes, fanout, size, dense, depth < levels - 1)
        later = settled(later)
        held = later if depth else held.drop("step").unionByName(later)
        more.append(settled(added.distinct()))
        more.append(later.filter("alike").select("rep", "bucket", "n", "k"))
        split = held.filter("NOT alike").select("rep", "bucket", "before")
        if not split.take(1):
            break
        paths = split.select("bucket", "before").distinct()
        level = split.join(perhaps_in(classes.select("rep", "sig", "k"), split, "rep"), "rep")
    if whole is None:
        return out, None
    members = settled(crowds(settled(reduce(DataFrame.unionByName, more, whole))))
    return out.unionByName(_blocked(members, limit)), members


def _judged(held: DataFrame, classes: DataFrame, count: int, size: int, dense: float, splits: bool) -> DataFrame:
    """Adds ``alike``: whether the sets of the bucket agree at most of the places
    that it would sample next, or it cannot be split any more."""
    if not splits:
        return held.withColumn("alike", F.lit(True))
    held = settled(held)
    sigs = perhaps_in(classes.select("rep", "sig"), held, "rep")
    agree = _agreement(held.select("rep", "bucket").join(sigs, "rep"), count, size)
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    judged = sizes.join(agree, F.col("bucket") == F.col("parent"))
    alike = (F.col("same") >= dense * F.col("_n") * F.col("_n")).alias("alike")
    return held.join(judged.select("bucket", alike), "bucket")


def crowds(whole: DataFrame) -> DataFrame:
    """(rep, crowd, k): the sets of buckets (rep, bucket, n, k) that are left
    whole, where a bucket joins the one that is the largest for most of its sets."""
    first = whole.groupBy("rep").agg(F.max(F.struct("n", "bucket")).alias("_first"))
    votes = whole.join(first, "rep").groupBy("bucket", "n", F.col("_first.bucket").alias("hub")).agg(F.count(F.lit(1)).alias("c"))
    merged = votes.filter((F.col("hub") != F.col("bucket")) & (F.col("c") * 2 > F.col("n")))
    crowd = F.coalesce("hub", "bucket").alias("crowd")
    return whole.join(merged.select("bucket", "hub"), "bucket", "left").select("rep", crowd, "k").distinct()


def _places_before(sizes: DataFrame, paths: DataFrame | None, count: int, size: int) -> DataFrame:
    """Adds the places at which a bucket's own pairs must differ: the parent's,
    and those that the parent sampled before this bucket's."""
    if paths is None:
        sizes = sizes.withColumn("_own", F.array().cast("array<int>"))
    else:
        sizes = sizes.join(paths.select(F.col("bucket").alias("parent"), F.col("before").alias("_own")), "parent")

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        path = rows.column("parent").to_numpy().view(np.uint64)
        at = places(path, count, size)
        own = rows.column("_own").to_pylist()
        before = [sorted({*o, *p[:s].tolist()}) for o, p, s in zip(own, at, rows.column("step").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [rows.column("bucket"), rows.column("n"), rows.column("fits"), pa.array(before, pa.list_(pa.int32()))],
            ["bucket", "n", "fits", "before"],
        )

    shape = "bucket long, n long, fits boolean, before array<int>"
    return map_arrow(sizes.select("bucket", "n", "fits", "parent", "step", "_own"), run, shape)


def _blocked(members: DataFrame, limit: int) -> DataFrame:
    """Tasks for all pairs of blocks of a crowd: a set goes to the tasks of its
    own block with every block. Blocks are bounded in sets and in the sets'
    members."""
    sizes = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / limit, F.col("total") / ELEMENTS)).cast("int")
    df = members.join(sizes.select("crowd", blocks.alias("_m")), "crowd")
    df = df.withColumn("_b", F.pmod(F.xxhash64("rep", "crowd"), F.col("_m")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    low, high = F.least("_b", "_other"), F.greatest("_b", "_other")
    return df.select(
        F.col("crowd").alias("bucket"),
        (low.cast("long") * (1 << 31) + high + 1).alias("pair"),
        F.when(F.col("_b") <= F.col("_other"), 0).otherwise(1).alias("side"),
        F.array().cast("array<int>").alias("before"),
        "rep",
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b), by
    alternating large and small stars until nothing changes."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    old = None
    few = 1 + edges.count() // EDGES  # partitions that the edges need; they only get fewer rows each round
    while True:  # rounds grow with the logarithm of the longest chain
        around = both(edges.coalesce(few))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.coalesce(few)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = settled(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .coalesce(few)
            .distinct()
            .coalesce(few)
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == old:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        old = now


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = N,
    recall: float = 1 - 1e-6,
    limit: int = LIMIT,
    levels: int = LEVELS,
    size: int = SIZE,
    floor: float = FLOOR,
    dense: float = DENSE,
) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the smallest doc_id of all
    that are linked to it, over any number of links, and the number of other
    rows whose sets have a Jaccard similarity of at least ``threshold``."""
    runs = runs_for(recall, threshold)
    rows = settled(class_table(docs, n, size))
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62))
    sets = rows.filter("k > 0").groupBy("set_key").agg(
        F.min(F.struct(named.alias("first"), "text_key")).alias("source"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig"), F.first("k").alias("k")
    )
    # a class is known by a hash of its set
    rep = F.xxhash64("set_key")
    classes = settled(sets.select(rep.alias("rep"), "set_key", "source.first", "source.text_key", "rows", "sig", "k"))
    tasks, crowded = tasks_of(classes.select("rep", "sig", "k"), runs, runs + SPARE, size, limit, levels, dense)
    spread = max(parts(docs.sparkSession), 1)
    tasks = settled(tasks)
    compared = perhaps_in(classes.select("rep", "rows", "sig"), tasks, "rep")
    if crowded is None:
        compared = compared.withColumn("crowds", F.lit(None).cast("array<long>"))
    else:
        compared = compared.join(crowded.groupBy("rep").agg(F.collect_set("crowd").alias("crowds")), "rep", "left")
    placed = tasks.join(compared, "rep").repartition(spread, "bucket", "pair")
    live = settled(_live(placed.sortWithinPartitions("bucket", "pair", "side", "rep"), size, floor))
    used = perhaps_in(classes.select("rep", "set_key", "first", "text_key", "sig"), live, "rep")
    needed = settled(live.select("rep").distinct().join(used, "rep"))
    texts = _members(docs, needed.drop("sig"), n).join(needed.select("rep", "sig"), "rep")
    full = live.join(texts, "rep").repartition(spread, "bucket", "pair").sortWithinPartitions("bucket", "pair", "side", "rep")
    found = settled(_links(full, size, floor, threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.filter(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b"))
    joined = components(edges)
    linked = links.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = linked.join(classes.select("rep", "set_key", "first", "rows"), "rep")
    smallest = firsts.groupBy("root").agg(F.min("first").alias("class_id"))
    groups = firsts.join(smallest, "root").select("set_key", "class_id", "links")
    of_class = classes.select("set_key", "first", "rows").join(groups, "set_key", "left")
    keyed = of_class.select("set_key", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    unnamed = F.when(F.col("class_id") < (1 << 62), F.col("class_id"))
    out = rows.filter("k > 0").select("doc_id", "set_key").join(keyed, "set_key").select("doc_id", unnamed.alias("class_id"), "n_links")
    alone = rows.filter("k = 0").select("doc_id", F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _members(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(rep, members): the sets of the needed classes, one text each."""
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62))
    text = docs.select(named.alias("first"), F.xxhash64("text").alias("text_key"), "text")
    found = perhaps_in(text, needed, "first", "text_key").join(needed, ["first", "text_key"])

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        sole_cache("chosen_path", _WORDS.clear)
        reps, members = [], []
        for rep, key, t in zip(*(rows.column(c) for c in ("rep", "set_key", "text"))):
            s = shingles(t.as_py(), n).tobytes()
            if s and _digest(s) == key.as_py():  # ids may repeat
                reps.append(rep.as_py())
                members.append(s)
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(members, pa.binary())], ["rep", "members"])

    made = map_arrow(found, run, "rep long, members binary")
    return made.groupBy("rep").agg(F.first("members").alias("members"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each class, the one with the smallest
    doc_id, with all columns. Rows that share a doc_id are one document, of
    which one row stays; rows without an id stay, as nothing names them."""
    joined = settled(jaccard_join(docs, **options))
    stay = joined.filter("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    stay = stay.select(F.col("doc_id").alias("_stay"), "_n")
    kept = docs.join(stay, docs["doc_id"] == stay["_stay"])
    once = kept.filter(stay["_n"] == 1).select(*[docs[c] for c in docs.columns])
    twice = kept.filter(stay["_n"] > 1).select(*[docs[c] for c in docs.columns])
    nameless = docs.filter(docs["doc_id"].isNull())
    if stay.filter("_n > 1").take(1):
        once = once.unionByName(twice.dropDuplicates(["doc_id"]))
    return once.unionByName(nameless)
