"""Readers: fixed schemas, filters and column lists reach the files."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import POPULATION, SEARCH_TRENDS, STUDY_END, STUDY_START, SUBMISSIONS
from .writers import MANIFEST, data_files


def read_latest_snapshot(spark: SparkSession, glob: str, schema: StructType | None = None) -> DataFrame:
    """The newest finished snapshot of a family, with all its files.

    Each match of ``glob`` is a snapshot: a file, or a folder of part files. If
    any of them has a manifest (``write_snapshot``), those without one are not
    finished; the time of a snapshot is the one in its manifest, and exactly the
    listed files are read. One whose files are missing or have other sizes is
    damaged and passed over. In a family without manifests a folder that Spark
    still writes to is passed over, and the time is that of the latest data
    file. No contents of data files are read to choose.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(glob)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = [m for m in fs.globStatus(root) or [] if not m.getPath().getName().startswith(("_", "."))]
    manifests = {m.getPath().toString(): found for m in matches if m.isDirectory() and (found := _manifest(spark, fs, m.getPath()))}
    reader = spark.read if schema is None else spark.read.schema(schema)
    for path, manifest in sorted(manifests.items(), key=lambda x: (x[1]["time"], x[0]), reverse=True):
        there = {name: size for name, size, _ in data_files(spark, path)}
        if all(there.get(f["name"]) == f["size"] for f in manifest["files"]):
            return reader.option("basePath", path).parquet(*(f"{path}/{f['name']}" for f in manifest["files"]))
    found = []
    for match in [] if manifests else matches:
        path = match.getPath()
        if match.isFile():
            found.append((match.getModificationTime(), path.toString()))
        elif not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_temporary")):
            found += [(max(t for _, _, t in files), path.toString()) for files in [data_files(spark, path.toString())] if files]
    if not found:
        raise FileNotFoundError(glob)
    return reader.parquet(max(found)[1])


def _manifest(spark: SparkSession, fs, folder) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    if not fs.exists(path):
        return None
    source = fs.open(path)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS).parquet(path)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POPULATION).parquet(path)


def read_search_trends(
    spark: SparkSession, path: str, start: dt.date = STUDY_START, end: dt.date = STUDY_END
) -> DataFrame:
    """Daily search index inside the half-open date range."""
    return (
        spark.read.schema(SEARCH_TRENDS)
        .parquet(path)
        .filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    )


def read_samples(spark: SparkSession, path: str | Mapping[str, str], tag: str = "method") -> DataFrame:
    """Posterior samples written by ``write_samples``: partition folders give
    back their key columns. A mapping of name to path stacks several sets and
    tags each with its name."""
    if isinstance(path, str):
        return spark.read.parquet(path)
    sets: Sequence[DataFrame] = [
        spark.read.parquet(p).withColumn(tag, F.lit(name)) for name, p in path.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
