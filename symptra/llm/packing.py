"""Harmonic packing of token ids into sequences of a fixed capacity.

Each document's ids are cut into pieces. Whole sequences come first; what is
left is cut into a few pieces whose lengths are just under the capacity divided
by a whole number. A piece of length s belongs to class k = capacity // s, and
k pieces of class k make a sequence, so every class fills its sequences by
counting alone: pieces are numbered within (shard, class), shards add the
counts of the shards before them, and number // k is the sequence. No worker
waits for another's sequences.

Fewer than k pieces per class are left over; for all classes together their
number is bounded by the capacity alone (about 10,000 for 2,048), whatever the
input. They are packed by best fit, longest first, in one task.

Cases: a null or empty text has only the end id; equal rows are documents of
their own; a null doc_id stays null; an empty table gives an empty result.
Very long texts are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, map_arrow, map_batches, parts, settled
from .tokens import token_ids

CAPACITY = 2048
SLACK = 0.01  # of a piece's room that may stay empty


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest * k >= (1 - slack) * capacity:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


def encode_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, slack: float = SLACK
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), a row per piece."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        coder = token_ids(vocabulary)
        owner, start, length, crc, total = [], [], [], [], []
        for first, texts in batches(rows, chars=1 << 20):
            for i, ids in enumerate(coder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for n in cut_lengths(len(ids), capacity, slack):
                    owner.append(first + i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n]))
                    total.append(len(ids))
                    at += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        columns = [rows.column("doc_id").take(pa.array(owner, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in (start, length, crc, total)], names)

    return map_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; given longest first, each goes to the
    fullest sequence that has room."""
    room_of: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = []
    open_rooms = np.zeros(capacity + 1, bool)
    for n in lengths:
        fits = np.flatnonzero(open_rooms[n:])
        if len(fits):
            room = int(fits[0]) + n
            seq = by_room[room].pop()
            open_rooms[room] = bool(by_room[room])
        else:
            room, seq = capacity, len(room_of)
            room_of.append(capacity)
        out.append((seq, capacity - room))
        room -= n
        by_room[room].append(seq)
        open_rooms[room] = room > 0
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (with ``length``): sequences are
    numbered from 0 without gaps."""
    spark = pieces.sparkSession
    shards = 4 * parts(spark)
    names = pieces.columns
    held = settled(
        pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("int")).withColumn(
            "_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int")
        )
    )
    sizes = held.groupBy("_class", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    by_class = W.partitionBy("_class")  # a row per shard
    offsets = sizes.select(
        F.col("_class").alias("_c"),
        F.col("_shard").alias("_s"),
        (F.sum("_n").over(by_class.orderBy("_shard")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_class).alias("_all"),
    )
    # at most 2 sqrt(capacity) classes: sequences of the classes before
    totals = {r["_class"]: r["n"] for r in sizes.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    base, begin = {}, 0
    for k in sorted(totals):
        base[k] = begin
        begin += totals[k] // k
    own = W.partitionBy("_class", "_shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = (
        held.withColumn("_own", F.row_number().over(own) - 1)
        .join(offsets, (F.col("_class") == F.col("_c")) & (F.col("_shard") == F.col("_s")))
        .withColumn("_number", F.col("_before") + F.col("_own"))
        .withColumn("_seq", F.floor(F.col("_number") / F.col("_class")))
    )
    full = F.col("_seq") < F.floor(F.col("_all") / F.col("_class"))
    known = [F.lit(x) for k, v in base.items() for x in (k, int(v))] or [F.lit(1), F.lit(0)]
    first = F.element_at(F.create_map(*known), F.col("_class"))
    # Pieces of a class differ in length, so offsets add up the sequence's earlier ones.
    within = W.partitionBy("_class", "_seq").orderBy("_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = numbered.filter(full).select(
        *names,
        (first + F.col("_seq")).cast("long").alias("sequence_id"),
        (F.sum("length").over(within) - F.col("length")).cast("long").alias("offset"),
    )
    left = numbered.filter(~full).select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in left.dtypes) + ", sequence_id long, offset long"

    def finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in source if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        order = [(c, "ascending") for c in names if c != "length"]
        rows = rows.sort_by([("length", "descending"), *order])
        placed = best_fit(rows.column("length").to_pylist(), capacity)
        rows = rows.append_column("sequence_id", pa.array([begin + s for s, _ in placed], pa.int64()))
        yield from rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).combine_chunks().to_batches()

    # one task for fewer than k pieces of each class k, a bounded number
    return whole.unionByName(map_batches(left.repartition(1), finish, schema))


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, slack: float = SLACK
) -> DataFrame:
    return pack(encode_pieces(docs, vocabulary, end_id, capacity, slack), capacity)
