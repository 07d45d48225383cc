import pytest

from textcards.operators.evidence import (evidence_indices_from_text, evidence_metrics,
                                          evidence_text)


def test_precision_divides_by_k_and_coverage(spark):
    gold = spark.createDataFrame(
        [("r1", "a", "x", 0), ("r1", "a", "x", 2), ("r1", "b", "y", 1), ("r2", "a", "x", 5),
         ("r4", "zz", "q", 0)],
        "id string, field string, label string, sent_idx int")
    recs = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "id string")
    pred = spark.createDataFrame(
        [("r1", "a", "x", [2]), ("r1", "b", "y", [0, 3, 1]), ("r2", "a", "x", [])],
        "id string, field string, label string, evidence array<int>")
    out = {r["scope"]: r for r in evidence_metrics(gold, recs, pred, ["a", "b"], "id").collect()}
    ov = out["overall"]
    # items: (r1,a,x) p1=1 p3=1/3 r1=1/2 r3=1/2; (r1,b,y) p1=0 p3=1/3 r1=0 r3=1; (r2,a,x) all 0
    assert ov["n_items"] == 3
    assert ov["precision_at_1"] == pytest.approx(1 / 3)
    assert ov["precision_at_3"] == pytest.approx((1 / 3 + 1 / 3) / 3)
    assert ov["recall_at_1"] == pytest.approx(0.5 / 3)
    assert ov["recall_at_3"] == pytest.approx(1.5 / 3)
    assert ov["coverage"] == pytest.approx(1 / 4)     # r1 only; r3 (no items), r4 (unknown field)
    assert ov["n_incidents"] == 4
    assert out["b"]["n_items"] == 1 and out["b"]["recall_at_3"] == 1.0


def test_text_evidence_maps_to_last_index(spark):
    sents = spark.createDataFrame(
        [("r1", 0, "Same  line."), ("r1", 1, "Other."), ("r1", 2, "Same line.")],
        "id string, sent_idx int, sentence string")
    pred = spark.createDataFrame(
        [("r1", "a", "x", [" Other. ", "Same\tline.", "missing"]), ("r1", "a", "y", ["nope"])],
        "id string, field string, label string, evidence_text array<string>")
    got = {r["label"]: r["evidence"] for r in evidence_indices_from_text(pred, sents, "id").collect()}
    assert got == {"x": [1, 2], "y": []}


def test_evidence_text_quotes(spark):
    sents = spark.createDataFrame([("r1", 0, "A."), ("r1", 1, "B."), ("r1", 2, "C.")],
                                  "id string, sent_idx int, sentence string")
    pred = spark.createDataFrame([("r1", "f", "l", [2, 0])],
                                 "id string, field string, label string, evidence array<int>")
    assert evidence_text(pred, sents, "id").first()["quotes"] == ["C.", "A."]


def test_in_row_ranking_and_last_index(spark):
    from pyspark.sql import functions as F
    from textcards.functions.text import last_sentence_index
    from textcards.operators.lexicon import lexicon_predict, lexicon_table
    docs = spark.createDataFrame([(1, "Fire here. Calm. Fire  here. Fire and leak.")],
                                 "doc_id int, text string")
    lex = lexicon_table(spark, {"f": {"fire": ["fire", "leak"]}})
    r = lexicon_predict(docs, lex, "doc_id", "text", ranked_k=3, keep_sentences=True).select(
        "ranked", F.transform("ranked", lambda x: last_sentence_index(
            F.col("sentences_norm"), x["sentence"])).alias("idx")).first()
    # scores: s0=1, s2=1, s3=2 -> order s3, s0, s2; s0 and s2 are equal after
    # whitespace normalisation, so both map to the last one (2)
    assert [(x["sent_idx"], x["score"]) for x in r["ranked"]] == [(3, 2), (0, 1), (2, 1)]
    assert r["idx"] == [3, 2, 2]
