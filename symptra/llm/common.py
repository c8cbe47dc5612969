"""Helpers shared by the text operators: tables, stored steps, samples, text."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 20
BITS = 64  # of a key's bitmap, so that one other key in 64 passes
MOST = 26  # a bitmap has at most two to this power of bits: 8 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled_dir(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder. A local one is set only
    where none is configured and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="symptra-"))


def settled(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: rows go to the shared checkpoint
    folder, so no executor loss repeats the work before."""
    settled_dir(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int, seed: int = 17
) -> DataFrame:
    """(doc_id, text, label) of about ``max_rows`` labelled documents outside
    the held-out fold, chosen by a hash of the id; all of them, if there are
    fewer. A document with several labels counts once, with the largest, and so
    do copies of a text."""
    known = (
        labels.select(F.col("doc_id"), F.col(label).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    share = max_rows / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about max_rows rows of two numbers
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))


def perhaps_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` whose ``columns`` may be among those of ``keys``: all that
    are, and few others. It goes ahead of a join by these columns, so that the
    join shuffles little of a wide table where it needs little. The bits of the
    keys' hashes are broadcast; where the keys are too many for a bitmap of
    bounded size, more rows pass. ``keys`` is read twice, so it should be
    stored; the columns have the same types in both."""
    key = F.xxhash64(*columns)
    count = keys.agg(F.approx_count_distinct(key)).first()[0]
    power = math.ceil(math.log2(BITS * max(count, 1)))
    at = F.pmod(key, F.lit(1 << min(max(power, 15), MOST))) + 1
    bucket, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    marks = keys.select(bucket.alias("_bucket"), bit.alias("_bit")).repartition("_bucket")
    bits = marks.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    marked = F.getbit(byte, (bit % 8).cast("int")) == 1
    return df.join(F.broadcast(bits), (bucket == F.col("_bucket")) & marked, "left_semi")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text, or, where it is very long, parts of it cut at white space."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table, by way of Arrow. Made of tuples
    alone, it would start Python workers of another kind, to copy the rows, on
    the executors, where they stay for a minute."""
    shape = _parse_datatype_string(schema)
    kinds = to_arrow_schema(shape)
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), shape)


def batches(rows: pa.RecordBatch, column: str = "text", chars: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``chars`` characters; null is ''."""
    run: list[str] = []
    first, held = 0, 0
    values = rows.column(column)
    for i in range(rows.num_rows):
        text = values[i].as_py() or ""
        run.append(text)
        held += len(text)
        if held >= chars:
            yield first, run
            first, run, held = i + 1, [], 0
    if run:
        yield first, run


def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # other C libraries have none
        return None


_TRIM = _trimmer()


def release() -> None:
    """Give freed memory back to the machine. Spark keeps a Python worker for
    later tasks, and its allocators would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow, after which a task's worker gives its memory back."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(source)
        release()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            if rows.num_rows and (out := fn(rows)) is not None:
                yield out

    return map_batches(df, run, schema)


_CACHES: dict[str, Callable[[], None]] = {}


def sole_cache(owner: str, clear: Callable[[], None]) -> None:
    """Empty the caches that other operators left in this Python worker, which
    Spark uses for one stage after the other, and give their memory back;
    ``clear`` empties the caller's."""
    others = [n for n in _CACHES if n != owner]
    for name in others:
        _CACHES.pop(name)()
    if others:
        release()
    _CACHES[owner] = clear


def keep_where(df: DataFrame, column: str, test: Callable[[str], bool], before: Callable[[], None]) -> DataFrame:
    """Rows whose text passes ``test`` (null is ''), with all columns; only the
    text is sent to Python. ``before`` runs ahead of each batch."""

    def passed(texts: pa.Array) -> pa.Array:
        before()
        return pa.array([bool(test(t.as_py() or "")) for t in texts], pa.bool_())

    # names may clash with nothing: the filter adds no column
    return df.filter(F.arrow_udf(passed, "boolean")(df[column]))


def run_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, for tables written between steps."""
    settled_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this run wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
