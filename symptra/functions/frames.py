"""DataFrame helpers: grouped quantiles, draw expansion, null-safe joins."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BANDS
from .columns import bands, unpack_bands


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is configured, a local one is
    made for a session on this machine alone, and removed at its end."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="symptra-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps use
    them several times without repeating the work before, and executor loss
    costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row_each(series: str, field: str) -> Column:
    """True for a packed series, an array of structs sorted by ``field``; the
    query fails, when run, if one value of ``field`` has two rows."""
    s = F.col(series)
    steps = F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))
    twice = F.exists(steps, lambda i: F.coalesce(F.get(s, i)[field] == F.get(s, i - 1)[field], F.lit(False)))
    return F.when(~twice, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a series has two rows for one {field}")).cast("boolean")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    A window over few, huge groups would put each group in one task; here the
    aggregate combines map-side and comes back through a join, for which Spark
    picks the strategy by the sizes it finds when it runs.
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))  # always one row
    return null_safe_join(df, df.groupBy(*keys).agg(*aggs), keys, "left")


def with_range_bucket(df: DataFrame, order: str, buckets: int | None = None, column: str = "_bucket") -> DataFrame:
    """Number the value ranges of ``order`` (a number or date) so that each
    holds about as many rows. Defaults to four ranges per shuffle partition.

    Cut points are approximate quantiles. They depend on the order in which
    Spark merges partial results, so they are evaluated once, here, and used as
    constants by all that follows. A value is placed in two steps, first among
    every width-th cut, then among the cuts in between. NULL comes last.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = math.isqrt(max(buckets or 4 * parts, 1) - 1) + 1
    n = width * width
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n + 1)], 20 * n)).first()[0]
    if not cuts:
        return df.withColumn(column, F.lit(0))  # no value, or no row
    constant = F.array(*[F.lit(c) for c in cuts])
    tops = F.array(*[F.lit(c) for c in cuts[width - 1 :: width]])
    below = lambda c: c < F.col(order)
    first = F.least(F.size(F.filter(tops, below)), F.lit(width - 1))
    second = F.size(F.filter(F.slice(constant, F.col("_first") * width + 1, width), below))
    place = F.when(F.col(order).isNull(), n + 1).otherwise(F.col("_first") * width + second)
    return df.withColumn("_first", first).withColumn(column, place).drop("_first")


def ranked_quantiles(
    df: DataFrame, value: str, keys: Sequence[str], prefix: str = "pi_", probs: dict[str, float] = BANDS
) -> DataFrame:
    """The same exact quantiles for groups of any size.

    Rows are first counted per distinct value; value ranges of about equal size
    are cumulated on their own and shifted by the earlier ranges, and only the
    values at the wanted ranks are kept. Neither a large group nor a frequent
    value ends up in one task.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = with_range_bucket(counted, value)
    sizes = ranged.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*keys)  # one row per range
    offsets = sizes.select(
        *keys,
        "_bucket",
        (F.sum("_size").over(group.orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(group).alias("_total"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(value)
    ranks = null_safe_join(
        ranged.withColumn("_end", F.sum("_n").over(inside)), offsets, [*keys, "_bucket"], "left"
    ).withColumn("_end", F.col("_end") + F.col("_before"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_n") < rank) & (rank <= F.col("_end")), F.col(value)))

    picks, out = [], []
    for k, p in probs.items():
        place = F.col("_total") - 1
        place = place * p
        picks += [at(F.floor(place) + 1).alias(f"_lo{k}"), at(F.ceil(place) + 1).alias(f"_hi{k}")]
        share = place - F.floor(place)
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * share).alias(f"{prefix}{k}"))
    return ranks.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks).select(*keys, *out)


def quantile_bands(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    prefix: str = "pi_",
    probs: dict[str, float] = BANDS,
    accuracy: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group of ``keys``.

    The values of a group are its posterior draws, so one group holds at most
    as many values as there are draws; use :func:`ranked_quantiles` for groups
    of raw rows. ``accuracy`` switches to the bounded sketch, for exploration.
    """
    keys = list(keys)
    if dict(df.dtypes)[value] == "double":
        df = df.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    agg = bands(value, prefix, probs)
    if accuracy is not None:
        agg = F.percentile_approx(value, list(probs.values()), accuracy).alias(f"_{prefix}")
    return df.groupBy(*keys).agg(agg).select(*keys, *unpack_bands(prefix, probs))


def with_draws(df: DataFrame, n_draws: int, column: str = "draw") -> DataFrame:
    """Every row once per draw 1..n_draws, generated inside the tasks."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(1), F.lit(n_draws))))


def assert_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the query, when run, if a listed column holds a NULL."""
    check = F.lit(True)
    for c in columns:
        check = check & F.col(c).isNotNull()
    guard = F.when(check, F.lit(True)).otherwise(
        F.raise_error(F.lit("NULL in one of: " + ", ".join(columns))).cast("boolean")
    )
    return df.filter(guard)
