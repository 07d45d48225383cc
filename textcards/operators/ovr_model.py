"""Stored models of C5: fitting and predicting in separate runs (M1 M2 M5).

A model is three tables in one version folder (``sources.versioned``, so it is
replaced in one step and may be read meanwhile): ``vocabulary`` (term, df, idf,
heavy), ``coefficients`` (term, heavy, one value per fitted label) and ``labels``
(number, field, label, state ``active`` or ``always``, intercept).  Scoring joins
the records' weighted terms to the coefficients; nothing of the vocabulary's
length passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards.operators.common import stored_by, written
from textcards.operators.tfidf import fit_vocabulary, top_sentence_lists
from textcards.sources.versioned import publish, resolve

LABELS = "number int, field string, label string, state string, intercept double"


@dataclass
class ModelTables:
    """``vocab``; ``coef``: (term, heavy, c0, c1, ...), a column per label of
    ``labels``, with its intercept; ``always``: labels of every training record."""

    vocab: DataFrame
    coef: DataFrame | None
    labels: list
    intercepts: list
    always: list


def fit_tables(train_docs: DataFrame, gold_long: DataFrame, states: list, id_col: str, text_col: str,
               max_df: float = 0.95, **fit) -> ModelTables:
    """Fit on ``train_docs``; ``states``: rows of ``label_states``, collected."""
    from textcards.operators.ovr import fit_ovr
    active = sorted((r["field"], r["label"]) for r in states if r["state"] == "active")
    always = sorted((r["field"], r["label"]) for r in states if r["state"] == "always")
    vocab = stored_by(fit_vocabulary(train_docs, text_col, max_df=max_df), "term")
    if not active:
        return ModelTables(vocab, None, [], [], always)
    model = fit_ovr(train_docs, gold_long, active, vocab, id_col, text_col, **fit)
    return ModelTables(vocab, model.coef, list(model.labels), [float(b) for b in model.intercepts], always)


def save_model(model: ModelTables, path: str) -> None:
    spark = model.vocab.sparkSession
    rows = [(k, f, lab, "active", b) for k, ((f, lab), b) in enumerate(zip(model.labels, model.intercepts))]
    rows += [(len(rows) + k, f, lab, "always", None) for k, (f, lab) in enumerate(model.always)]

    def write(labels, folder):
        labels.coalesce(1).write.parquet(f"{folder}/labels")
        model.vocab.write.parquet(f"{folder}/vocabulary")
        if model.coef is not None:
            model.coef.select("term", "heavy", F.array(*[f"c{k}" for k in range(len(model.labels))]).alias("coef")) \
                .write.parquet(f"{folder}/coefficients")

    publish(spark.createDataFrame(rows, LABELS), path, write)


def load_model(spark: SparkSession, path: str) -> ModelTables:
    folder = resolve(spark, path)
    rows = sorted(spark.read.parquet(f"{folder}/labels").collect(), key=lambda r: r["number"])      # the label space
    active = [r for r in rows if r["state"] == "active"]
    coef = None
    if active:
        coef = spark.read.parquet(f"{folder}/coefficients")
        coef = coef.select("term", "heavy", *[F.col("coef")[k].alias(f"c{k}") for k in range(len(active))])
    return ModelTables(spark.read.parquet(f"{folder}/vocabulary"), coef, [(r["field"], r["label"]) for r in active],
                       [r["intercept"] for r in active], [(r["field"], r["label"]) for r in rows if r["state"] == "always"])


def predict(model: ModelTables, docs: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.5,
            evidence_k: int = 3) -> DataFrame:
    """``(id, field, label, confidence, evidence)``: probabilities at or above
    the threshold, always-on labels at 1.0; the evidence is the record's top
    TF-IDF sentences."""
    from textcards.operators.ovr import predict_ovr
    sure = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(lab).alias("label"), F.lit(1.0).alias("confidence"))
                     for f, lab in model.always]).cast("array<struct<field:string,label:string,confidence:double>>")
    out = docs.select(id_col, F.explode(sure).alias("x")).select(id_col, "x.*")
    if model.labels:
        out = out.unionByName(written(predict_ovr(model, docs, model.vocab, id_col, text_col, threshold)))
    ev = written(top_sentence_lists(docs, model.vocab, id_col, text_col, evidence_k))
    return out.join(ev, id_col, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>")))
