"""Whitening of embeddings with distributed block matrices of MLlib.

The distinct integer vectors are numbered, centred and cut into blocks of rows;
the blocks' transposes times the blocks, added over many splits of the long
dimension, give the scatter matrix; its eigenvectors are found on the driver,
which holds one matrix of dimensions squared and nothing that grows with the
rows. A second product, of all centred rows with the whitening matrix, projects
the rows.

Rows are numbered without gaps: tables are stored with the task and the place
within it, and the tasks' sizes give each its first number.

Cases: a null vector, or one with null or non-finite entries, is left out;
vectors shorter than the longest count as padded with zeros; repeated rows have
their own results and count once in the fit; a null vec_id stays null; a
component without variance (fewer distinct rows than components, or equal ones)
has null for ``whitened`` and, where no component has any, for ``explained`` and
``identity_error``; an empty table gives no rows. Other columns are not read.
The deviation is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, run_folder

BLOCK_VALUES = 1 << 18  # of a block of rows


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        embeddings.select("vec_id", "embedding")
        .filter(F.col("embedding").isNotNull() & sound)
        .select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    )


def numbered(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The rows, stored, with ``index`` from 0 without gaps, and their number."""
    spark = df.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    df.withColumns({"_task": F.spark_partition_id(), "_place": within}).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_task").count().orderBy("_task").collect()  # one row per task that wrote
    first, total = [], 0
    for s in sizes:
        first.append((s["_task"], total))
        total += s["count"]
    starts = spark.createDataFrame(first, "_task int, _start long")
    index = (F.col("_start") + F.col("_place")).alias("index")
    return stored.join(F.broadcast(starts), "_task").select(index, *df.columns), total


def blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Of (index, values), with whole rows in each block, several blocks per
    task of a shuffle and at most BLOCK_VALUES entries in one."""
    slots = 2 * parts(rows.sparkSession)
    height = max(1, min(BLOCK_VALUES // d, -(-n // slots)))
    vectors = rows.select("index", array_to_vector("values").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, d).toBlockMatrix(height, d)


def scatter(matrix: BlockMatrix, slots: int) -> np.ndarray:
    """The transpose times the matrix. The sum over rows is split among at most
    ``slots`` tasks, whose partial products are then added."""
    splits = min(matrix.numRowBlocks, slots)
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, directions: np.ndarray) -> BlockMatrix:
    d, k = directions.shape
    sc = matrix.blocks.context
    weights = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(d, k, directions.T.ravel().tolist()))], 1), d, k)
    return matrix.multiply(weights)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(index, values) of a block matrix."""
    indexed = matrix.toIndexedRowMatrix()  # held: the Java matrix goes with its wrapper
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def whiten(embeddings: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error
    (see the module)."""
    spark = embeddings.sparkSession
    folder, slots = run_folder(spark), 4 * parts(spark)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, total = numbered(integer_vectors(embeddings, scale), f"{folder}/rows")
    size = rows.agg(F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least"), F.max(F.array_max(F.transform("x", F.abs))).alias("entry")).first()
    d = size["d"] or 0
    if not d:
        return spark.createDataFrame([], out)
    if size["least"] < d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))))
    fit, n = numbered(rows.select("x").distinct(), f"{folder}/fit")
    sums = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s")).orderBy("j")
    sums = [r["s"] for r in sums.collect()]  # one per dimension

    def entries(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    means = entries([s / n for s in sums], "double")
    centred = F.zip_with("x", means, lambda v, m: v.cast("double") - m)
    matrix = blocks(fit.select("index", centred.alias("values")), n, d).cache()
    covariance = scatter(matrix, slots) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    varied = values > max(values[0], 0.0) * d * np.finfo(float).eps
    directions = vectors / np.sqrt(np.where(varied, values, 1.0))

    error = None
    if varied.any():
        kept = int(varied.sum())  # the leading ones
        spread = scatter(projected(matrix, directions[:, :kept]), slots) / n
        error = float(np.abs(spread - np.eye(kept)).max())
    matrix.blocks.unpersist()

    kind = "bigint" if d * (2 * n * (size["entry"] + 1)) ** 2 < 1 << 63 else "decimal(38,0)"
    off = F.zip_with("x", entries(sums, kind), lambda v, s: v.cast(kind) * F.lit(n).cast(kind) - s)
    deviation = F.aggregate(off, F.lit(0).cast(kind), lambda a, v: (a + v * v).cast(kind)).try_cast("long")
    white = rows_of(projected(blocks(rows.select("index", centred.alias("values")), total, d), directions))
    per_component = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                (F.get("values", F.lit(k)) if varied[k] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(values[k]) / trace if trace > 0 else None).cast("double").alias("explained"),
            )
            for k in range(len(values))
        ]
    )
    return (
        rows.select("index", "vec_id", deviation.alias("deviation"))
        .join(white, "index")
        .select("vec_id", "deviation", F.inline(per_component))
        .select(
            "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
