"""Shared plan helpers."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.session import shared_folder, shuffles_released

# Row bound under which a side table (taxonomy, lexicon, cut points,
# vocabulary) is broadcast.  Above it the join is pinned to a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000


# A broadcast table is built on the driver: keep it within this share of
# the driver's memory (``spark.driver.memory``, default 1g).
DRIVER_BROADCAST_SHARE = 0.1
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def driver_memory_bytes(spark) -> int:
    v = str(spark.sparkContext.getConf().get("spark.driver.memory", "1g")).strip().lower()
    v = v[:-1] if v.endswith("b") else v
    return int(float(v[:-1]) * _UNITS[v[-1]]) if v and v[-1] in _UNITS else int(float(v) * (1 << 20))


def within_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, bytes_per_row: int = 128) -> bool:
    """Whether ``count(df)`` is within ``max_rows`` and the driver-memory budget."""
    budget = int(DRIVER_BROADCAST_SHARE * driver_memory_bytes(df.sparkSession) / bytes_per_row)
    with shuffles_released(df.sparkSession):
        return df.count() <= min(max_rows, budget)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      bytes_per_row: int = 128, over: str = "merge") -> DataFrame:
    """``broadcast(df)`` after proving its size (``within_broadcast``).

    Above the bound the side carries the ``over`` hint (``merge``: sort-merge;
    ``shuffle_hash``: per-partition hash table of this side, no sort), so the
    join stays a shuffle join: without a hint AQE may still demote it to a
    broadcast from runtime statistics and build a table the driver cannot
    hold."""
    return F.broadcast(df) if within_broadcast(df, max_rows, bytes_per_row) else df.hint(over)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it several times.

    In the cluster's checkpoint folder where there is one (survives a lost
    executor; cleaned when nothing refers to it any more), else cached."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        with shuffles_released(df.sparkSession):
            return df.select("*").checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """``stored`` for a long table that joins read by ``key``: Parquet files in
    the cluster's checkpoint folder, bucketed by the key, so that no such join
    shuffles it again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        return stored(df)
    name = f"textcards_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_released(spark):
        (df.write.format("parquet").bucketBy(n, key).option("compression", "zstd")
         .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, for many narrow rows that a
    later step reads: its shuffles are gone when it is read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textcards-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def safe_ratio(num, den):
    """``num / den`` as double, 0.0 when ``den`` is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))
