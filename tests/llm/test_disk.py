"""What stays on disk while the operators run."""

import glob
import os
import time

from pyspark.sql import functions as F

from textcards.llm import paragraph_dedup, shingle_join, storage

TEXTS = [" ".join(f"w{(i // 2 * 31 + k) % 997}" for k in range(60)) + f" end{i % 3}" for i in range(40)]


def tables(spark):
    return {x.split("-")[1] for x in os.listdir(storage.shared_dir(spark).removeprefix("file:")) if x.startswith("textcards-")}


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def seen_at_links(spark, module, monkeypatch, run):
    """The tables that are new when the sets of the clusters have been compared."""
    before, found = tables(spark), []
    links = module.verified_links

    def watched(*a, **kw):
        out = links(*a, **kw)
        found.append(tables(spark) - before)
        return out

    monkeypatch.setattr(storage, "shared_dir", lambda s, d=f"{storage.shared_dir(spark)}/{module.__name__}": (
        os.makedirs(d.removeprefix("file:"), exist_ok=True), d)[1])
    before = tables(spark)
    monkeypatch.setattr(module, "verified_links", watched)
    assert run().count() == len(TEXTS)
    return found[0]


def test_near_duplicates_keep_no_spent_tables(spark, monkeypatch):
    left = seen_at_links(spark, shingle_join, monkeypatch, lambda: shingle_join.jaccard_components(docs(spark)))
    assert "items" in left and not left & {"sets", "kept", "near", "shared", "hubs", "classes"}


def test_paragraphs_keep_no_spent_tables(spark, monkeypatch):
    left = seen_at_links(spark, paragraph_dedup, monkeypatch, lambda: paragraph_dedup.dedup_paragraphs(docs(spark)))
    assert "items" in left and "lines" in left and not left & {"paragraphs", "bands", "shared", "wanted"}


def test_cut_releases_its_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}      # noqa: E731
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept.collect()
    before = files()
    made = storage.cut(spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s")), "released")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 997 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert sum(r["count"] for r in kept.collect()) == 1000
