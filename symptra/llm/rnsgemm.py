"""Hard negatives by an exact matrix product in a residue number system.

Integer vectors are taken modulo several small primes; the residue matrices are
multiplied in float32, whose sums stay below 2^24 and so are exact; mixed-radix
digits (Garner's form of the Chinese remainder theorem) give the signed scores
back. As many primes are used as the largest possible score needs, which
follows from the longest vector.

Rows are dealt into groups of bounded size by a hash of their label, large
buckets in several chunks. Anchors, packed into blocks, visit the groups of
their label's bucket for the positives and all groups for the negatives: a
group stays in memory while the anchor blocks stream past, and gives the best
rows of each anchor. These are merged by a window over an anchor's few rows.

Cases: rows with a null label, a null vector, or null or non-finite components
take no part; a shorter vector counts as padded with zeros; a row with a null
vec_id is no anchor and comes last among equal scores (the largest long stands
for it inside); rows that share the anchor's vec_id are not its partners, and
each of several rows with one id counts on its own, as anchor too; an anchor
without positives, or a positive without rows in its window, gives no row; an
empty table gives none. Columns other than the three are not read. Components
of 2^53 / 256 and more in size raise an error; scores beyond a long wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, run_folder

SEGMENT = 64  # dimensions added up in float32 before they are reduced
LARGEST_PRIME = 1021  # (1021 // 2)^2 * 64 < 2^24
GROUP_VALUES = 1 << 23  # components of a group of rows
ANCHORS = 1024  # of a block
CELL = 1 << 22  # scores held at once
NOBODY = (1 << 63) - 1
LOWEST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes whose product exceeds twice ``bound`` plus one."""
    found: list[int] = []
    product, p = 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """The residue of least size."""
    half = p // 2
    return (values + half) % p - half


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(x, p).astype(np.float32) for p in primes]


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a times b modulo p, both residues in float32."""
    total = None
    for start in range(0, a.shape[1], SEGMENT):
        part = (a[:, start : start + SEGMENT] @ b[start : start + SEGMENT]).astype(np.int32)
        total = centred(part if total is None else total + part, p)
    return np.zeros((a.shape[0], b.shape[1]), np.int32) if total is None else total


def exact_product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integer product from residue matrices, one pair per prime."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        v = residue_product(a[k], b[k], p)
        for q, digit in zip(primes, digits):
            inverse = pow(q, -1, p)
            v = centred((v - centred(digit, p)) * np.int32(centred(np.int64(inverse), p)), p)
        digits.append(v)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        out = out * p + digit
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k highest allowed scores; of equal
    ones the leftmost."""
    s = np.where(allowed, scores, LOWEST)
    pick = s > LOWEST
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]
        pick &= s >= least
        if np.count_nonzero(pick) > 4 * k * len(s):  # many ties: the first k of them
            tie = pick & (s == least)
            pick &= ~tie | (np.cumsum(tie, axis=1, dtype=np.int32) <= k)
    r, c = np.nonzero(pick)
    v = s[r, c]
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], v[keep]


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


class _Group:
    """Rows of one group in order of their ids, as residues."""

    def __init__(self, rows: pa.Table, primes: list[int], d: int) -> None:
        tie, label, x = _flat(rows, "tie"), _flat(rows, "label"), _flat(rows, "x").reshape(-1, d)
        order = np.argsort(tie, kind="stable")
        self.tie, self.label = tie[order], label[order]
        self.x = [np.ascontiguousarray(r.T) for r in residues(x[order].astype(np.int64), primes)]


def _visit(
    source: Iterator[pa.RecordBatch], primes: list[int], d: int, visit, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Sorted by group and kind, a group's rows come before the blocks of
    anchors; ``visit(group, block, slice, scores)`` gives the rows of a slice."""
    held: list[pa.RecordBatch] = []
    group: _Group | None = None
    at = None
    for batch in source:
        g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(g)]):
            if lo == hi:
                continue
            if g[lo] != at:
                at, held, group = g[lo], [], None
            if kind[lo] == 0:
                held.append(batch.slice(lo, hi - lo))
                continue
            if not held and group is None:
                continue
            if group is None:
                group, held = _Group(pa.Table.from_batches(held), primes, d), []
            for i in range(lo, hi):
                block = pa.Table.from_batches([batch.slice(i, 1)])
                x = residues(_flat(block, "x").reshape(-1, d).astype(np.int64), primes)
                step = max(1, CELL // len(group.tie))
                for start in range(0, len(x[0]), step):
                    part = slice(start, start + step)
                    scores = exact_product([r[part] for r in x], group.x, primes)
                    columns = visit(group, block, part, scores)
                    if len(columns[0]):
                        yield pa.record_batch([pa.array(c) for c in columns], schema=schema)


def _positives(k: int):
    def visit(group: _Group, block: pa.Table, part: slice, scores: np.ndarray) -> list[np.ndarray]:
        own, tie, label = (_flat(block, c)[part] for c in ("row", "tie", "label"))
        allowed = (label[:, None] == group.label) & (tie[:, None] != group.tie)
        r, c, v = best(scores, allowed, k)
        return [own[r], group.tie[c], v]

    return visit


def _negatives(k: int, slots: int):
    def visit(group: _Group, block: pa.Table, part: slice, scores: np.ndarray) -> list[np.ndarray]:
        own, label = (_flat(block, c)[part] for c in ("row", "label"))
        high, low = (_flat(block, c).reshape(-1, slots)[part] for c in ("high", "low"))
        other = label[:, None] != group.label
        found = []
        for slot in range(slots):
            allowed = other & (scores <= high[:, slot, None]) & (scores >= low[:, slot, None])
            r, c, v = best(scores, allowed, k)
            found.append((own[r], np.full(len(r), slot, np.int32), group.tie[c], v))
        return [np.concatenate(c) for c in zip(*found)]

    return visit


def integer_rows(embeddings: DataFrame, scale: float = 256.0, relabel_every: int = 7, classes: int = 10) -> DataFrame:
    """(tie, label, x) of the rows that take part: tie is the id, or NOBODY."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    moved = (F.col("label") + 1) % classes
    limit = float(1 << 53)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    safe = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < limit)
    return (
        embeddings.select("vec_id", "label", "embedding")
        .filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
        .select(
            F.coalesce(F.col("vec_id").cast("long"), F.lit(NOBODY)).alias("tie"),
            F.when(F.col("vec_id") % relabel_every == 0, moved).otherwise(F.col("label")).cast("long").alias("label"),
            F.when(safe, whole).otherwise(F.raise_error(F.lit("component too large"))).alias("x"),
        )
    )


def hard_negatives(
    embeddings: DataFrame,
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    (see the module). The window bounds negative scores in hundredths of the
    positive's."""
    spark = embeddings.sparkSession
    folder = run_folder(spark)
    buckets = 2 * parts(spark)
    base = integer_rows(embeddings, scale).select(
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int").alias("bucket"),
        "tie",
        "label",
        "x",
    )
    base.write.parquet(f"{folder}/rows")
    base = spark.read.parquet(f"{folder}/rows")
    is_anchor = (F.col("tie") % anchor_every == 0) & (F.col("tie") != NOBODY)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    sizes = (
        base.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_anchor).alias("anchors"),
            F.max(F.size("x")).alias("d"),
            F.min(F.size("x")).alias("least_d"),
            F.max(square).alias("square"),
            F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("entry"),
        )
        .collect()  # one row per bucket
    )
    rows, d = sum(s["n"] for s in sizes), max([s["d"] for s in sizes], default=0)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not d or not any(s["anchors"] for s in sizes):
        return spark.createDataFrame([], out)
    primes = primes_for(int(max(s["square"] for s in sizes) * (1 + 1e-9)) + 1)
    entry = max(s["entry"] or 0 for s in sizes)
    kind = "smallint" if entry < 1 << 15 else "int" if entry < 1 << 31 else "bigint"
    if min(s["least_d"] for s in sizes) < d:
        base = base.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))))
    base = base.withColumn("x", F.col("x").cast(f"array<{kind}>"))

    # groups of rows and blocks of anchors, numbered from 0, bucket by bucket
    target = max(64, min(GROUP_VALUES // d, -(-rows // buckets)))
    chunks, starts, blocks, first = ([0] * buckets for _ in range(4))
    total = n_blocks = 0
    for s in sizes:
        b = s["bucket"]
        chunks[b], starts[b] = -(-s["n"] // target), total
        blocks[b], first[b] = -(-s["anchors"] // ANCHORS), n_blocks
        total, n_blocks = total + chunks[b], n_blocks + blocks[b]

    def of_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("bucket"))

    def place(start: list[int], number: list[int]) -> Column:
        return (of_bucket(start) + F.pmod(F.xxhash64("row", F.lit(1)), of_bucket(number))).cast("int")

    empty = F.array().cast("array<bigint>")
    lists = [F.array(c).alias(c) for c in ("row", "tie", "label")]
    group_rows = base.select(place(starts, chunks).alias("g"), F.lit(0).alias("kind"), *lists, "x", empty.alias("high"), empty.alias("low"))
    anchors = base.filter(is_anchor)
    packed = pa.schema(
        [("bucket", pa.int32())]
        + [(c, pa.list_(pa.int64())) for c in ("row", "tie", "label")]
        + [("x", pa.list_({"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind]))]
        + [(c, pa.list_(pa.int64())) for c in ("high", "low")]
    )

    def pack(rows: pa.Table) -> pa.Table:
        one = [rows.column("bucket").combine_chunks()[:1]]
        for field in list(packed)[1:]:
            values = rows.column(field.name).combine_chunks()
            values = values.flatten() if pa.types.is_list(values.type) else values
            one.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(field.type))
        return pa.Table.from_arrays(one, schema=packed)

    def best_rows(anchors: DataFrame, groups: Column, visit, schema: str, fields: list) -> DataFrame:
        packs = (
            anchors.withColumn("block", place(first, blocks))
            .groupBy("block")
            .applyInArrow(pack, f"bucket int, row array<long>, tie array<long>, label array<long>, x array<{kind}>, high array<long>, low array<long>")
        )
        visits = packs.select(F.explode(groups).alias("g"), F.lit(1).alias("kind"), "row", "tie", "label", "x", "high", "low")
        arrow = pa.schema(fields)

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _visit(source, primes, d, visit, arrow)

        both = group_rows.unionByName(visits).repartition("g").sortWithinPartitions("g", "kind")
        return both.mapInArrow(run, schema)

    of_own = F.sequence(of_bucket(starts), of_bucket(starts) + of_bucket(chunks) - 1)
    near = best_rows(
        anchors.withColumns({"high": empty, "low": empty}),
        of_own,
        _positives(positives),
        "row long, positive long, score long",
        [("row", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())],
    )
    order = W.partitionBy("row").orderBy(F.desc("score"), "positive")
    near = near.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < positives)
    near.write.parquet(f"{folder}/positives")
    near = spark.read.parquet(f"{folder}/positives")

    # bounds of the windows, by whole numbers that stay within a long; an unused slot's window is empty
    low_share, high_share = window
    score = F.col("score")

    def part_of(share: int, up: bool) -> Column:
        whole, rest = F.expr("(score - pmod(score, 100)) div 100"), F.pmod(score, F.lit(100))
        return whole * share + (F.ceil if up else F.floor)(rest * share / 100)

    by_slot = [F.max(F.when(F.col("slot") == i, v)) for v in (part_of(high_share, False), part_of(low_share, True)) for i in range(positives)]
    high = F.array(*[F.coalesce(c, F.lit(int(LOWEST))) for c in by_slot[:positives]])
    low = F.array(*[F.coalesce(c, F.lit(NOBODY)) for c in by_slot[positives:]])
    bounds = near.groupBy("row").agg(high.alias("high"), low.alias("low"))
    far = best_rows(
        anchors.join(bounds, "row"),
        F.sequence(F.lit(0), F.lit(total - 1)),
        _negatives(negatives, positives),
        "row long, slot int, negative long, negative_score long",
        [("row", pa.int64()), ("slot", pa.int32()), ("negative", pa.int64()), ("negative_score", pa.int64())],
    )
    order = W.partitionBy("row", "slot").orderBy(F.desc("negative_score"), "negative")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)

    def vec_id(c: str) -> Column:
        return F.when(F.col(c) != NOBODY, F.col(c))

    return (
        far.join(near, ["row", "slot"])
        .join(anchors.select("row", "tie"), "row")
        .select(
            F.col("tie").alias("anchor_id"),
            vec_id("positive").alias("positive_id"),
            "rank",
            vec_id("negative").alias("negative_id"),
            F.col("score").alias("positive_score"),
            "negative_score",
        )
    )
