"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from textcards.session import shuffles_released


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where a local session names none (tests, a laptop) a temporary folder
    is made and remembered as the context's checkpoint directory; on a cluster
    no other machine could read it, so that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textcards-shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; every call gives another one."""
    return f"{shared_dir(spark)}/textcards-{name}-{uuid.uuid4().hex}"


_made: list[list[str]] = []


@contextmanager
def released():
    """Deletes at the end what ``cut`` has written inside, but for the tables
    whose paths are taken off the yielded list."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        drop(*_made.pop())


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor loses nothing of it, and two readers do
    not compute it twice.  ``drop`` releases it."""
    path = scratch(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    for made in _made:
        made.append(path)
    return out


def drop(*tables) -> None:
    """Delete tables made by ``cut`` (or paths) that no later result reads."""
    for t in tables:
        path = t if isinstance(t, str) else t._shared_path
        spark = SparkSession.getActiveSession()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, max_rows: int, more=None):
    """``df`` with a broadcast hint after a count proved it has at most
    ``max_rows`` rows (plus ``more``, a column that counts what a row's arrays
    hold), else pinned to a sort-merge join (AQE splits its hot keys)."""
    from pyspark.sql import functions as F
    with shuffles_released(df.sparkSession):
        n = df.count() if more is None else df.agg(F.coalesce(F.sum(more + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= max_rows else df.hint("merge")
