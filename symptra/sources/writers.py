"""Writers: partitioned Parquet for samples, CSV for final tables."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below the folder, size, modification time) of its data files;
    hidden files and folders are left out."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    start = len(fs.makeQualified(folder).toUri().getPath().rstrip("/")) + 1
    out = []
    files = fs.listFiles(folder, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toUri().getPath()[start:]
        if not any(p.startswith(("_", ".")) for p in name.split("/")):
            out.append((name, f.getLen(), f.getModificationTime()))
    return out


def write_snapshot(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """A snapshot that readers see whole or not at all: the data files first,
    then a manifest with their names and sizes, put in place by a rename. A
    folder that is there already is never written to."""
    df.write.mode("error").partitionBy(*keys).parquet(path)
    spark = df.sparkSession
    listed = [{"name": name, "size": size} for name, size, _ in data_files(spark, path)]
    hadoop = spark._jvm.org.apache.hadoop.fs
    done, draft = hadoop.Path(path, MANIFEST), hadoop.Path(path, f"{MANIFEST}.draft")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"time": time.time_ns(), "files": listed}).encode()))
    out.close()
    if not fs.rename(draft, done):
        raise OSError(f"cannot commit {path}")


def write_samples(df: DataFrame, path: str, keys: Sequence[str] = ("symptom",), mode: str = "error") -> None:
    """Samples as Parquet, one folder per key value, so readers prune by key.

    Rows are written from the tasks that hold them: no shuffle that would put a
    whole symptom into one task.
    """
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """A summary table as CSV with a header."""
    df.write.mode(mode).csv(path, header=True)
