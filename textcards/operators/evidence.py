"""Evidence grounding metrics: C9 (J4 J7 F9 U1 A18-A20) and J8.

An *item* is a (record, field, label) with a non-empty gold index list.
``precision@k = |gold ∩ top-k| / k`` (divides by k, not by what was
returned), ``recall@k = |gold ∩ top-k| / |gold|``; no prediction scores 0.
Coverage = records with a predicted sentence for at least one gold item /
records that have a non-empty gold map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcards.functions.text import normalize_sentence
from textcards.operators.common import safe_ratio


def evidence_indices_from_text(pred_text: DataFrame, sentences_df: DataFrame,
                               id_col: str = "id") -> DataFrame:
    """Evidence given as sentence *text* -> sentence indices.

    ``pred_text``: (id, field, label, evidence_text array<string>) in rank order.
    ``sentences_df``: (id, sent_idx, sentence) of the gold text.  Texts are
    compared after whitespace normalisation, by 128-bit digests: sentences are
    digested where they are read and do not travel.  A sentence that occurs
    twice maps to its *last* index; unmatched texts are dropped, and a label
    whose texts all failed to match keeps an empty list.
    """
    digest = lambda c: F.unhex(F.md5(normalize_sentence(c).cast("binary"))).alias("_n")
    index = (sentences_df.select(id_col, "sent_idx", digest("sentence"))
             .groupBy(id_col, "_n").agg(F.max("sent_idx").alias("sent_idx")))
    exploded = (pred_text.select(id_col, "field", "label", F.posexplode_outer("evidence_text").alias("_pos", "_t"))
                .select(id_col, "field", "label", "_pos", digest("_t")))
    found = F.when(F.col("sent_idx").isNotNull(), F.struct("_pos", "sent_idx"))      # nulls are not collected
    return (exploded.join(index, [id_col, "_n"], "left")
            .groupBy(id_col, "field", "label").agg(F.sort_array(F.collect_list(found)).alias("_e"))
            .select(id_col, "field", "label", F.transform("_e", lambda x: x["sent_idx"]).alias("evidence")))


def evidence_metrics(gold_evidence: DataFrame, gold_records: DataFrame, pred_evidence: DataFrame,
                     fields, id_col: str = "id") -> DataFrame:
    """Rows ``scope`` = ``overall`` then one per field, with
    ``n_items, precision_at_1, precision_at_3, recall_at_1, recall_at_3`` and
    the report-level ``coverage`` and ``n_incidents`` (same on every row).

    ``gold_evidence``: (id, field, label, sent_idx) long form (empty lists
    simply have no rows).  ``gold_records``: ids whose gold map is non-empty.
    ``pred_evidence``: (id, field, label, evidence array<int>) in rank order.
    Gold items on fields outside ``fields`` are ignored.
    """
    fields = list(fields)
    items = (gold_evidence.where(F.col("field").isin(fields))
             .groupBy(id_col, "field", "label")
             .agg(F.array_distinct(F.collect_list("sent_idx")).alias("_gold")))
    recs = gold_records.select(id_col).distinct()
    items = items.join(recs, id_col, "left_semi")
    j = items.join(pred_evidence.select(id_col, "field", "label", "evidence"),
                   [id_col, "field", "label"], "left")
    ev = F.coalesce(F.col("evidence"), F.array().cast("array<int>"))
    g = F.col("_gold")

    def at(k):
        top = F.slice(ev, 1, k)
        hit = F.size(F.array_intersect(top, g)).cast("double")
        empty = F.size(top) == 0
        return (F.when(empty, 0.0).otherwise(hit / k),
                F.when(empty, 0.0).otherwise(hit / F.size(g)))

    p1, r1 = at(1)
    p3, r3 = at(3)
    scored = j.select(id_col, F.struct("field", p1.alias("p1"), p3.alias("p3"), r1.alias("r1"), r3.alias("r3"),
                                       (F.size(ev) > 0).alias("any")).alias("_i"))
    # per record: its items and whether any has predicted evidence; then every
    # item counts for its field and overall, every record overall: one aggregate
    per_rec = recs.join(scored.groupBy(id_col).agg(F.collect_list("_i").alias("_is")), id_col, "left")  # items of one record
    none = F.lit(None).cast("double")
    names = ("p1", "p3", "r1", "r3")
    items_of = F.coalesce(F.col("_is"), F.array().cast(per_rec.schema["_is"].dataType))
    record = F.struct(F.lit("overall").alias("scope"), F.exists(items_of, lambda x: x["any"]).alias("hit"),
                      *[none.alias(c) for c in names])

    def cell(scope):
        return lambda x: F.struct((F.lit(scope) if scope else x["field"]).alias("scope"),
                                  F.lit(None).cast("boolean").alias("hit"), *[x[c].alias(c) for c in names])

    cells = per_rec.select(F.explode(F.concat(F.array(record), F.transform(items_of, cell("overall")),
                                              F.transform(items_of, cell(None)))).alias("c")).select("c.*")
    agg = cells.groupBy("scope").agg(
        F.count_if(F.col("hit").isNull()).alias("n_items"), F.count("hit").alias("_recs"), F.count_if("hit").alias("_hits"),
        *[F.avg(c).alias(c) for c in names])
    spine = recs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in ["overall", *fields]])).alias("scope"))
    whole = Window.partitionBy(F.lit(0))          # over the report's rows, one per field and one overall
    of_all = lambda c: F.coalesce(F.max(c).over(whole), F.lit(0))
    t = spine.join(F.broadcast(agg), "scope", "left").select(
        "scope", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        *[F.coalesce(c, F.lit(0.0)).alias(name) for c, name in zip(
            names, ("precision_at_1", "precision_at_3", "recall_at_1", "recall_at_3"))],
        of_all("_recs").cast("bigint").alias("n_incidents"), of_all("_hits").alias("_hits"))
    return t.select("scope", "n_items", "precision_at_1", "precision_at_3", "recall_at_1", "recall_at_3",
                    safe_ratio(F.col("_hits"), F.col("n_incidents")).alias("coverage"), "n_incidents")


def evidence_text(pred_evidence: DataFrame, sentences_df: DataFrame,
                  id_col: str = "id") -> DataFrame:
    """Evidence indices -> verbatim sentences, in evidence order."""
    ex = pred_evidence.select(id_col, "field", "label",
                              F.posexplode("evidence").alias("_pos", "sent_idx"))
    j = ex.join(sentences_df.select(id_col, "sent_idx", "sentence"), [id_col, "sent_idx"], "inner")
    return (j.groupBy(id_col, "field", "label")
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "sentence"))).alias("_q"))
            .select(id_col, "field", "label",
                    F.transform("_q", lambda x: x["sentence"]).alias("quotes")))
