"""Sources: S1 record JSONL, S2 CSV roster, S3 text directory, S4 taxonomy,
S5 split.  Every reader takes an explicit schema (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards.functions.text import py_strip
from textcards.sources.versioned import resolve

RECORD_SCHEMA = (
    "incident_id string, incident_name string, text string, "
    "sources array<struct<url:string,retrieved_date:string>>, "
    "labels map<string,array<string>>, "
    "evidence_gold map<string,map<string,array<int>>>, "
    "date string, missing_text boolean"
)
PREDICTION_SCHEMA = (
    "incident_id string, pred map<string,array<string>>, "
    "confidence map<string,map<string,double>>, "
    "evidence map<string,map<string,array<int>>>"
)
SCRAPED_SCHEMA = "incident_id string, source_url string, source_type string, text string"
ROSTER_SCHEMA = "incident_id string, incident_name string, url string, retrieved_date string, notes string"
FLAT_GOLD_SCHEMA = "incident_id string, text string, subsystem_label string, incident_type_label string"
SPLIT_SCHEMA = ("strategy string, seed int, test_size double, n_labeled int, "
                "train array<string>, test array<string>")


def fs_path(spark: SparkSession, path: str):
    """``(Hadoop file system, qualified path)``: any URI Spark reads, not only the driver's disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_path(spark, path)
    return fs.exists(p)


def file_order() -> F.Column:
    """Order of the lines of a text-like source: by file, block, then line
    (``monotonically_increasing_id`` follows the lines within one block)."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                    F.monotonically_increasing_id().alias("l"))


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """One JSON object per line; blank lines skipped; a malformed line
    fails the job (FAILFAST), as the reference raises.  ``path`` may be a file,
    a folder or a table in versions."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(resolve(spark, path))


def read_csv(spark: SparkSession, path: str, schema: str = ROSTER_SCHEMA) -> DataFrame:
    """Header CSV, quoted fields (commas / newlines inside quotes), all
    strings; a row with another number of fields than the header fails the job."""
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def read_text_dir(spark: SparkSession, path: str, id_col: str = "incident_id") -> DataFrame:
    """S3: one document per ``{id}.txt`` file; id = file stem, text stripped."""
    df = spark.read.option("wholetext", "true").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return df.select(F.regexp_replace(name, "\\.txt$", "").alias(id_col),
                     py_strip("value").alias("text"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The JSON taxonomy ``{"labels": {field: [label, ...]}}`` ->
    ``(field, label, label_pos)`` rows (list order kept)."""
    doc = (spark.read.schema("labels map<string,array<string>>").option("multiLine", "true")
           .option("mode", "FAILFAST").json(path))
    ex = doc.select(F.explode("labels").alias("field", "_ls"))
    return ex.select("field", F.posexplode("_ls").alias("label_pos", "label")).select(
        "field", "label", F.col("label_pos").cast("int").alias("label_pos"))


def read_split(spark: SparkSession, path: str | None, id_col: str = "incident_id"):
    """Split -> ``(id, part)`` rows; ``None`` when no path (no filter).

    Broken JSON fails the job.  Reads both the one-document JSON form (``{"train": [...], "test": [...]}``)
    and the long form written by ``jobs.split_job`` (``path/ids``)."""
    if not path:
        return None
    ids_dir = f"{path.rstrip('/')}/ids"
    if exists(spark, ids_dir):
        df = spark.read.schema(f"{id_col} string, part string").option("mode", "FAILFAST").json(resolve(spark, ids_dir))
        return df.select(id_col, "part")
    doc = spark.read.schema(SPLIT_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    train = doc.select(F.explode("train").alias(id_col), F.lit("train").alias("part"))
    test = doc.select(F.explode("test").alias(id_col), F.lit("test").alias("part"))
    return train.unionByName(test)


#: Tables of fewer bytes than this may be spread over the cores.
SMALL_TABLE_BYTES = 256 << 20


def read_parquet(spark: SparkSession, path: str, key: str | None = None,
                 spread_to: int | None = None) -> DataFrame:
    """Parquet scan (pushdown and pruning apply).

    ``spread_to`` asks for so many tasks where a small table (under
    ``SMALL_TABLE_BYTES`` on disk, whatever the cluster's size) has fewer
    splits: text operators are CPU-bound per row, and one small row group
    would keep all but one core idle.  Rows are then dealt by ``key`` (so
    later grouping on it reuses the partitioning) or round-robin.  A larger
    table is never shuffled here.
    """
    df = spark.read.parquet(path)
    if not spread_to:
        return df
    fs, p = fs_path(spark, path)
    if fs.getContentSummary(p).getLength() >= SMALL_TABLE_BYTES or df.rdd.getNumPartitions() >= spread_to:
        return df
    return df.repartition(spread_to, key) if key else df.repartition(spread_to)
