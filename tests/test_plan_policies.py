"""Plan-shape policies: spreading small scans, bounded broadcasts."""

import os

from pyspark.sql import functions as F

from textcards.operators import common as C
from textcards.sources import readers as R
from textcards.sources.readers import read_parquet


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_only_when_too_few_splits(spark, tmp_dir, monkeypatch):
    few = os.path.join(tmp_dir, "few")
    spark.range(100).select(F.col("id").alias("k"), F.lit("t").alias("text")) \
        .coalesce(1).write.parquet(few)
    df = read_parquet(spark, few, "k", spread_to=4)
    assert df.rdd.getNumPartitions() == 4 and "hashpartitioning(k" in plan(df)
    assert read_parquet(spark, few, "k").rdd.getNumPartitions() == 1      # only where the caller asks
    monkeypatch.setattr(R, "SMALL_TABLE_BYTES", 1)
    assert "Exchange" not in plan(read_parquet(spark, few, "k", spread_to=4))     # a large table is never shuffled
    monkeypatch.undo()
    many = os.path.join(tmp_dir, "many")
    spark.range(100).select(F.col("id").alias("k")).repartition(6).write.parquet(many)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                          "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")   # one split per small file
    spark.conf.set("spark.sql.files.openCostInBytes", "256")
    try:
        df = read_parquet(spark, many, "k", spread_to=4)
        assert df.rdd.getNumPartitions() >= 4
        assert "Exchange" not in plan(df)                  # already enough splits: untouched
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bounded_broadcast_policy(spark, monkeypatch):
    big = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    side = spark.range(300).select(F.col("id").alias("k"))
    small = plan(big.join(C.bounded_broadcast(side, max_rows=1000), "k"))
    assert "BroadcastHashJoin" in small
    over = plan(big.join(C.bounded_broadcast(side, max_rows=100), "k"))
    assert "SortMergeJoin" in over and "BroadcastHashJoin" not in over
    # the driver-memory budget bounds it too (here: a tiny share of memory)
    monkeypatch.setattr(C, "DRIVER_BROADCAST_SHARE", 1e-9)
    budget = plan(big.join(C.bounded_broadcast(side, max_rows=1000), "k"))
    assert "SortMergeJoin" in budget


def test_frequent_terms_do_not_gather(spark, monkeypatch):
    """Beyond the broadcast bound, a term in 80 % of the rows stays out of the
    shuffle join, and the result is the broadcast join's."""
    from textcards.operators import tfidf as T
    texts = [(i, ("common " if i % 5 else "") + " ".join(f"w{(i * 7 + k) % 500}" for k in range(3))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    vocab = T.fit_vocabulary(docs).cache()
    got = {}
    for bound in (10_000, 0):
        monkeypatch.setattr(T, "MAX_BROADCAST_VOCAB", bound)
        v = T.tfidf_vectors(docs, vocab)
        got[bound] = sorted((r.doc_id, r.term, r.tf, round(r.weight, 12)) for r in v.collect())
    assert got[0] == got[10_000]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        terms = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
        j = T.lookup(terms, vocab, ["idf"])
        assert "SortMergeJoin" in plan(j)
        per = [r["n"] for r in j.where("term = 'common'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per) == 320 and max(per) < 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_label_metrics_shuffles(spark):
    """One shuffle by record, one by label; nothing runs while the plan is built."""
    from textcards.operators.metrics import label_metrics
    long = spark.createDataFrame([(1, "f", "a"), (2, "f", "b")], "id long, field string, label string")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    tax = spark.createDataFrame([("f", "a", 0), ("f", "b", 1)], "field string, label string, label_pos int")
    per_label, _ = label_metrics(long, long, ids, ids, tax)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_label, _ = label_metrics(long, long, ids, ids, tax)
        text = plan(per_label)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning(") <= 3 and "CartesianProduct" not in text
