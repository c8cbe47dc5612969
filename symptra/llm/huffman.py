"""Token ids in files of canonical, length-limited Huffman codes.

Format. A folder with two tables. ``codebook`` has the code length of each id
that occurs; codes are canonical: counted up by (length, id). ``blocks`` has a
row per block, in ascending doc_id order within and across segments; its
payload is the block's file image, little-endian:

    magic "HUF1", documents u32, checkpoints u32, stream bytes u32
    doc_id i64 per document, null flag u8 per document, ids u32 per document
    bit offset u32 per checkpoint
    bit stream, first bit highest, padded with zero bytes

Every document starts at a checkpoint, and another follows after each
``EVERY`` ids, so any part can be decoded alone. Blocks do not depend on one
another. Code lengths come from the counts of all ids by package-merge, at most
``LONGEST`` bits, so one table lookup of that many bits gives an id and the
length of its code; all checkpoints of a block are decoded side by side.

Cases: a null or empty text has only the end id; null doc_ids come first;
equal rows and equal doc_ids are documents of their own, in no fixed order
among themselves unless their lengths differ; an empty table gives empty
tables. A document is never split, so a very long one makes a long block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, map_arrow, parts, remove, run_folder
from .tokens import token_ids

LONGEST = 20
EVERY = 256
BLOCK_IDS = 1 << 18
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for counts, by
    package-merge. Both lists are sorted, so the items chosen at a level are
    the lightest symbols and the lightest packages, and only numbers of them
    need to be kept."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    marks = []
    level = leaves
    is_leaf = np.ones(n, bool)
    marks.append(is_leaf)
    for _ in range(longest - 1):
        even = len(level) // 2 * 2
        packages = level[:even:2] + level[1:even:2]
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        marks.append(by < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for mark in reversed(marks):
        chosen = int(mark[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids, lengths))
    size = np.left_shift(np.int64(1), LONGEST - lengths[order])
    start = np.cumsum(size) - size  # codes aligned to LONGEST bits
    codes = np.empty(len(ids), np.int64)
    codes[order] = start >> (LONGEST - lengths[order])
    return codes


def pack_bits(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The codes one after the other, highest bit first."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    begin = ends - lengths
    word = begin >> 5
    value = codes.astype(np.uint64) << (64 - (begin & 31) - lengths).astype(np.uint64)
    out = np.zeros((total + 31) // 32 + 2, np.uint64)
    # codes of one word have no bit in common, so sums are unions
    for shift, at in ((np.uint64(32), word), (np.uint64(0), word + 1)):
        part = (value >> shift) & np.uint64(0xFFFFFFFF)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        if len(cut):
            out[at[cut]] += np.add.reduceat(part, cut)
    return out.astype(">u4").tobytes()[: (total + 7) // 8]


def encode_block(docs: list[tuple[int | None, np.ndarray]], code: np.ndarray, length: np.ndarray) -> bytes:
    ids = np.concatenate([d for _, d in docs]).astype(np.int64)
    sizes = np.array([len(d) for _, d in docs], np.int64)
    bits = length[ids]
    first = np.cumsum(bits) - bits
    base = np.repeat(np.cumsum(sizes) - sizes, (sizes + EVERY - 1) // EVERY)
    runs = [np.arange(0, n, EVERY) for n in sizes]
    marks = first[base + np.concatenate(runs)]
    stream = pack_bits(code[ids], bits)
    return b"".join(
        [
            MAGIC,
            struct.pack("<III", len(docs), len(marks), len(stream)),
            np.array([0 if i is None else i for i, _ in docs], "<i8").tobytes(),
            np.array([i is None for i, _ in docs], "u1").tobytes(),
            sizes.astype("<u4").tobytes(),
            marks.astype("<u4").tobytes(),
            stream,
        ]
    )


def decode_table(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next LONGEST bits: the id, and its code's length."""
    order = np.lexsort((ids, lengths))
    size = np.left_shift(np.int64(1), LONGEST - lengths[order])
    symbol = np.repeat(ids[order].astype(np.uint32), size)
    bits = np.repeat(lengths[order].astype(np.uint8), size)
    room = (1 << LONGEST) - len(symbol)
    return np.pad(symbol, (0, room)), np.pad(bits, (0, room), constant_values=1)


def decode_block(payload: bytes, symbol: np.ndarray, bits: np.ndarray) -> list[tuple[int | None, np.ndarray]]:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, m, size = struct.unpack_from("<III", payload, 4)
    at = 16
    doc_ids = np.frombuffer(payload, "<i8", n, at)
    nulls = np.frombuffer(payload, "u1", n, at + 8 * n)
    sizes = np.frombuffer(payload, "<u4", n, at + 9 * n).astype(np.int64)
    marks = np.frombuffer(payload, "<u4", m, at + 13 * n).astype(np.int64)
    at += 13 * n + 4 * m
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8, size + 8, at) if len(payload) - at == size else None
    if raw is None:
        raise ValueError("the block's stream has another length than stated")
    raw = raw.astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    left = np.concatenate([np.minimum(EVERY, s - np.arange(0, s, EVERY)) for s in sizes])
    out = np.zeros((EVERY, m), np.uint32)
    place = marks.copy()
    order = np.argsort(-left, kind="stable")  # streams that are over stand last
    place, counts = place[order], left[order]
    active = m
    for step in range(int(counts[0])):
        while counts[active - 1] <= step:
            active -= 1
        p = place[:active]
        key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - LONGEST)
        out[step, :active] = symbol[key]
        p += bits[key]
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    by_stream = out.T[back]
    ids = by_stream[np.arange(EVERY)[None, :] < left[:, None]]
    cut = np.concatenate(([0], np.cumsum(sizes)))
    return [(None if nulls[i] else int(doc_ids[i]), ids[cut[i] : cut[i + 1]]) for i in range(n)]


def write_encoded(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids, each followed by ``end_id``, to ``path``."""
    spark = docs.sparkSession

    def tokenise(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(vocabulary)
        counts = np.zeros(1 << 16, np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for rows in source:
            ids_of: list[bytes] = []
            n = []
            for _, texts in batches(rows):
                found = coder.encode(texts)
                seen = np.bincount(np.concatenate([*found, np.full(len(found), end_id, np.uint32)]))
                if len(seen) > len(counts):
                    counts = np.pad(counts, (0, len(seen) - len(counts)))
                counts[: len(seen)] += seen
                last = np.array([end_id], np.uint32)
                for ids in found:
                    ids_of.append(_narrow(np.concatenate((ids, last))))
                    n.append(len(ids) + 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_of, pa.binary()), pa.nulls(len(n), pa.binary())],
                names,
            )
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                names,
            )

    def spread_counts(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist()]
        total = np.zeros(max(map(len, found)), np.int64)
        for c in found:
            total[: len(c)] += c
        used = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    rough = run_folder(spark)
    docs.select("doc_id", "text").mapInArrow(tokenise, "doc_id long, n long, ids binary, counts binary").write.option(
        "compression", "zstd"
    ).parquet(rough)
    held = spark.read.parquet(rough)
    counts = map_arrow(held.filter("n < 0").select("counts"), spread_counts, "id long, n long")
    # a row per id of the vocabulary
    got = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, n = got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame(
        [(int(i), int(k)) for i, k in zip(ids, lengths)], "id long, bits int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    size = int(ids.max()) + 1 if len(ids) else 1
    code, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if len(ids):
        code[ids], length[ids] = canonical_codes(ids, lengths), lengths
    tables = spark.sparkContext.broadcast((code, length))

    def assemble(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = tables.value
        segment = TaskContext.get().partitionId()
        block: list[tuple[int | None, np.ndarray]] = []
        number, begin, held_ids = 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([segment], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "start": [begin],
                    "n": [held_ids],
                    "payload": [encode_block(block, code, length)],
                }
            )

        for rows in source:
            for doc_id, raw in zip(rows.column("doc_id"), rows.column("ids")):
                ids = _wide(raw.as_py())
                block.append((doc_id.as_py(), ids))
                held_ids += len(ids)
                if held_ids >= block_ids:
                    yield flush()
                    block, number, begin, held_ids = [], number + 1, begin + held_ids, 0
        if block:
            yield flush()

    ordered = held.filter("n > 0").select("doc_id", "n", "ids").repartitionByRange(parts(spark), "doc_id")
    ordered.sortWithinPartitions("doc_id", "n").select("doc_id", "ids").mapInArrow(
        assemble, "segment int, block int, start long, n long, payload binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, rough)


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where they all fit, else four; the first byte says."""
    if int(ids.max()) < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.astype("<u4").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # a row per id of the vocabulary
    tables = spark.sparkContext.broadcast(
        decode_table(book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64))
    )

    def decode(rows: pa.RecordBatch) -> pa.RecordBatch:
        symbol, bits = tables.value
        out = []
        for segment, start, payload in zip(*(rows.column(c) for c in ("segment", "start", "payload"))):
            at = start.as_py()
            for doc_id, ids in decode_block(payload.as_py(), symbol, bits):
                out.append((segment.as_py(), doc_id, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                at += len(ids)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["segment", "doc_id", "begin", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("segment").agg(F.sum("n").alias("n")).orderBy("segment").collect()  # one row per file
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["segment"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "segment int, before long"))
    found = map_arrow(
        blocks.select("segment", "start", "payload"),
        decode,
        "segment int, doc_id long, begin long, n_tokens long, ids_crc32 long",
    )
    return found.join(starts, "segment").select(
        "doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
