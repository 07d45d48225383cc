"""Property tests."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textcards.functions.text import split_sentences
from textcards.operators import splits as S
from textcards.operators.lexicon import lexicon_predict, lexicon_table, taxonomy_table
from textcards.operators.metrics import label_metrics

TEXT = st.lists(st.sampled_from(["Alpha", "beta", ".", "!", "?", " ", "  ", "\n", " ",
                                 "fire", "leak"]), max_size=40).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_sentences_lose_only_whitespace(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", split_sentences("t").alias("s")).collect():
        squash = lambda x: re.sub(r"\s", "", x)
        assert "".join(squash(s) for s in r["s"]) == squash(r["t"])
        assert all(s and s == s.strip() for s in r["s"])


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_evidence_indices_in_range(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lex = lexicon_table(spark, {"f": {"a": ["fire", "alpha"], "b": ["leak", "beta", "e"]}})
    p = lexicon_predict(docs, lex, "doc_id", "text")
    n = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(split_sentences("text"))
                                                  .alias("n")).collect()}
    for r in p.collect():
        assert all(0 <= i < n[r["doc_id"]] for i in r["evidence"]) and len(r["evidence"]) <= 3
        assert len(set(r["evidence"])) == len(r["evidence"])


def test_metrics_partition_invariant_and_bounded(spark):
    gold = spark.range(300).select(F.col("id").cast("string").alias("id"),
                                   F.lit("f").alias("field"),
                                   F.concat(F.lit("l"), (F.col("id") % 5).cast("string")).alias("label"))
    pred = spark.range(300).select(F.col("id").cast("string").alias("id"),
                                   F.lit("f").alias("field"),
                                   F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("label"))
    ids = gold.select("id")
    tax = taxonomy_table(spark, {"f": [f"l{i}" for i in range(6)]})
    a = label_metrics(gold, pred, ids, ids, tax, "id")[1].first().asDict()
    b = label_metrics(gold.repartition(7), pred.repartition(3).orderBy(F.rand(1)),
                      ids.repartition(5), ids, tax, "id")[1].first().asDict()
    assert {k: round(v, 12) if isinstance(v, float) else v for k, v in a.items()} == \
        {k: round(v, 12) if isinstance(v, float) else v for k, v in b.items()}
    assert all(0.0 <= a[k] <= 1.0 for k in ("micro_precision", "micro_recall", "micro_f1", "macro_f1"))


def test_labelled_only(spark):
    gold = spark.createDataFrame([("a", "f", "x")], "id string, field string, label string")
    pred = spark.createDataFrame([("a", "f", "x"), ("b", "f", "x")], "id string, field string, label string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    tax = taxonomy_table(spark, {"f": ["x"]})
    allg = label_metrics(gold, pred, ids, ids, tax, "id")[1].first()
    lab = label_metrics(gold, pred, ids, ids, tax, "id", labelled_only=True)[1].first()
    assert (allg["n"], allg["micro_precision"]) == (2, 0.5)      # unlabelled b counts as negative
    assert (lab["n"], lab["micro_precision"]) == (1, 1.0)


def test_splits_disjoint_and_complete(spark):
    recs = spark.range(500).select(F.col("id"), F.date_format(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 37).cast("int")),
        "yyyy-MM-dd").alias("date"))
    for split in (S.time_split(recs, "id", "date", 0.3)[0], S.hash_split(recs, "id", 0.3)):
        rows = split.collect()
        parts = {}
        for r in rows:
            parts.setdefault(r["id"], set()).add(r["part"])
        assert len(parts) == 500 and all(len(v) == 1 for v in parts.values())
        assert sum("test" in v for v in parts.values()) == 150
