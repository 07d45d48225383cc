"""C11 dataset profile: F2 F3 P12 A21-A24."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.functions.text import token_count


def _has_text(text_col):
    return F.coalesce(F.col(text_col), F.lit("")) != F.lit("")


def _labelled(labels_col):
    return F.coalesce(F.size(F.col(labels_col)), F.lit(0)) > 0


def record_features(records: DataFrame, text_col: str = "text",
                    labels_col: str = "labels", keep=()) -> DataFrame:
    """Per-record inputs of the profile: ``has_text, n_tokens, labels``.

    Project these *before* joining labels from another table, so the text
    itself never crosses that join's shuffle."""
    return records.select(*keep, _has_text(text_col).alias("has_text"),
                          token_count(text_col).alias("n_tokens"), F.col(labels_col).alias("labels")
                          if labels_col in records.columns else
                          F.lit(None).cast("map<string,array<string>>").alias("labels"))


def dataset_profile(feats: DataFrame) -> DataFrame:
    """``dataset_stats`` over ``record_features`` output (one aggregate)."""
    has_text = F.col("has_text")
    labelled = _labelled("labels") & has_text
    card = F.aggregate(F.map_values(F.col("labels")), F.lit(0),
                       lambda a, v: a + F.coalesce(F.size(v), F.lit(0)))
    return feats.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(has_text).alias("n_with_text"),
        F.count_if(labelled).alias("n_labeled"),
        F.coalesce(F.avg(F.when(has_text, F.col("n_tokens"))), F.lit(0.0))
        .alias("avg_length_tokens"),
        F.coalesce(F.avg(F.when(labelled, card)), F.lit(0.0)).alias("avg_label_cardinality"))


def profile_label_distribution(feats: DataFrame) -> DataFrame:
    """``label_distribution`` over ``record_features`` output."""
    lab = feats.where(_labelled("labels") & F.col("has_text"))
    ex = lab.select(F.explode("labels").alias("field", "_ls"))
    return (ex.select("field", F.explode("_ls").alias("label"))
            .groupBy("field", "label").agg(F.count(F.lit(1)).alias("n")))


def dataset_stats(records: DataFrame, text_col: str = "text",
                  labels_col: str = "labels") -> DataFrame:
    """One row: ``n_total, n_with_text, n_labeled, avg_length_tokens,
    avg_label_cardinality``.

    ``labels_col`` is ``map<string, array<string>>``.  Labelled = non-empty
    map *and* non-empty text (F2).  Token length = whitespace tokens (P12),
    averaged over records with text (F3).  Cardinality = labels over all
    fields, duplicates counted, averaged over labelled records.  One pass,
    one partial+final aggregate.
    """
    return dataset_profile(record_features(records, text_col, labels_col))


def label_distribution(records: DataFrame, text_col: str = "text",
                       labels_col: str = "labels") -> DataFrame:
    """``(field, label, n)`` over labelled records; raw (not limited to
    the taxonomy), duplicates counted."""
    return profile_label_distribution(record_features(records, text_col, labels_col))
