"""Tables in versions (S6, S8): a folder of version folders and one pointer.

A write makes a new version folder beside the others and then replaces the small
pointer file by one atomic rename (Hadoop ``FileContext``, any file system that
Spark writes).  Until then every reader sees the version before, so a job may
write the table it reads, and a job that dies halfway changes nothing.  The
pointer names the current version and the one before, which stays for readers
that have begun; the one before that is deleted.  A folder that Spark wrote
plainly counts as its first version.  What a dead job left is removed by
``vacuum``.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
PLAIN = "."         # the files that lie in the table's folder itself


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(x.rstrip("/") for x in parts))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and the one before."""
    fs, p = _fs(spark, path)
    at = _path(spark, path, POINTER)
    if fs.exists(at):
        stream = fs.open(at)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
    return [PLAIN] if fs.exists(p) and any(f.isFile() and not f.getPath().getName().startswith((".", "_"))
                                           for f in fs.listStatus(p)) else []


def resolve(spark: SparkSession, path: str) -> str:
    """Where the rows of ``path`` lie: its current version, or the path itself
    where it is a plain file or folder."""
    found = versions(spark, path) if _is_folder(spark, path) else []
    return path if not found or found[0] == PLAIN else f"{path.rstrip('/')}/{found[0]}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Replace the pointer in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, _ = _fs(spark, path)
    fresh, at = _path(spark, path, f".{POINTER}-{uuid.uuid4().hex}"), _path(spark, path, POINTER)
    out = fs.create(fresh)
    out.write(("\n".join(names) + "\n").encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(fresh), fs.makeQualified(at), how)


def publish(df: DataFrame, path: str, write) -> str:
    """``write(df, folder)`` into a new version of ``path`` and make it current."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p) and not _is_folder(spark, path):
        raise ValueError(f"{path} is a file: a table needs a folder")
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{name}"
    write(df, folder)
    before = versions(spark, path)
    point(spark, path, [name, *before[:1]])
    for old in before[1:]:
        _delete(spark, path, old)
    return folder


def _delete(spark: SparkSession, path: str, name: str) -> None:
    fs, p = _fs(spark, path)
    if name != PLAIN:
        fs.delete(_path(spark, path, name), True)
        return
    for f in fs.listStatus(p):
        if f.isFile() and f.getPath().getName().startswith(("part-", "_SUCCESS")):
            fs.delete(f.getPath(), False)


def vacuum(spark: SparkSession, path: str, older_than_hours: float = 24.0) -> list[str]:
    """Delete version folders that the pointer does not name and that are older:
    what jobs left that died before they published.  Returns their names."""
    fs, p = _fs(spark, path)
    kept, gone = set(versions(spark, path)), []
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if (f.isDirectory() and name.startswith("v-") and name not in kept
                and f.getModificationTime() <= 1000 * (time.time() - 3600 * older_than_hours)):
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone
