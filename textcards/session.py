"""Session helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job here assumes.  AQE re-plans joins and coalesces
# partitions at runtime; skew-join splitting handles hot terms / hot ids.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "textcards",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given, so on a cluster the launcher's
    master wins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the checkpoint directory the cluster names, setting it only if unset.

    The cluster's shared folder comes from ``spark.checkpoint.dir``.  A
    ``fallback`` (e.g. a test's temporary folder) is used only when the
    session names none.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    target = named or fallback or os.environ.get("TEXTCARDS_CHECKPOINT_DIR")
    if target:
        sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``.  A local
    session that names none gets a temporary folder; on a cluster that is an error,
    because no other machine could read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="textcards-shared-"))
    return named.rstrip("/")


# Shuffle files of a finished query go at once (else when the driver happens to
# collect its garbage, so the steps of a long job add up on disk).
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that are made and end inside delete their shuffle files when they
    end.  For steps that leave a table or a number behind and are not read again."""
    before = spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE_SHUFFLES)
        else:
            spark.conf.set(RELEASE_SHUFFLES, before)
