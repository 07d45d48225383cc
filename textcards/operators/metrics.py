"""Label evaluation: C8 (J3 J10 F4 A10-A14) and flat gold C10.

Everything stays in long form (id, field, label).  The per-label table is
built on the taxonomy spine, so zero-support labels are present and enter
macro-F1 as 0, exactly like a fixed label list passed to a metric library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcards.lexicons import NO_LABEL, SKIP_LABELS
from textcards.functions.text import normalize_label, py_strip
from textcards.operators.common import bounded_broadcast, safe_ratio
from textcards.operators.lexicon import lexicon_labels


def restrict_ids(df: DataFrame, ids: DataFrame | None, id_col: str,
                 empty_split: str = "all") -> DataFrame:
    """keep rows whose id is in ``ids``.

    ``ids=None`` means no filter.  An *empty* id list means no filter when
    ``empty_split="all"`` (evaluation / TF-IDF behaviour) and zero rows when
    ``"none"`` (lexicon behaviour).
    """
    if ids is None:
        return df
    ids = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    if empty_split == "none":
        return df.join(ids, id_col, "left_semi")
    # whether the list is empty is part of the plan: one count row, no eager check
    n = ids.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
            .join(ids.withColumn("_in", F.lit(True)), id_col, "left")
            .where(F.col("_in") | (F.col("_n") == 0)).select(*df.columns))


def label_metrics(gold_long: DataFrame, pred_long: DataFrame, gold_ids: DataFrame,
                  pred_ids: DataFrame, taxonomy: DataFrame, id_col: str = "id",
                  labelled_only: bool = False):
    """Multi-label metrics per (field, label) and per field.

    ``gold_long``/``pred_long``: (id, field, label) rows; duplicates collapse.
    ``gold_ids``: every gold record after filtering (its count is ``n``);
    ``pred_ids``: every scored record, including ones with no prediction.
    A record is scored when it is in both; an unlabelled gold record counts
    as all-negative.  Labels outside the taxonomy are ignored.

    One shuffle brings the four inputs together by record; gold and predicted
    label sets are compared inside its row, and one map-side combined
    aggregate over (field, label) gives all counts.  A row without a field
    carries the number of records (A14).  Nothing runs while the plan is built.

    Returns ``(per_label, per_field)``.  ``per_field`` has no rows when no
    record is scored (the field is left out, as in the reference).
    ``labelled_only=True`` drops gold records without any gold label first
    (the reference scores them as all-negative).
    """
    none = F.lit(None).cast("struct<field:string,label:string>")
    pair = F.struct(F.col("field"), F.col("label"))

    def part(df, kind, value):
        return df.select(F.col(id_col).alias("_id"), F.lit(kind).alias("_k"), value.alias("_l"))

    rows = (part(gold_ids, "gi", none).unionByName(part(pred_ids, "pi", none))
            .unionByName(part(gold_long, "g", pair)).unionByName(part(pred_long, "p", pair)))
    is_ = lambda kind: F.col("_k") == kind
    per_id = rows.groupBy("_id").agg(
        F.bool_or(is_("gi")).alias("gi"), F.bool_or(is_("pi")).alias("pi"),
        F.collect_set(F.when(is_("g"), F.col("_l"))).alias("g"),      # labels of one record
        F.collect_set(F.when(is_("p"), F.col("_l"))).alias("p"))
    gold = F.col("gi") & (F.size("g") > 0) if labelled_only else F.col("gi")
    scored = gold & F.col("pi")
    seen = F.when(scored, F.array_union("g", "p")).otherwise(F.array().cast("array<struct<field:string,label:string>>"))
    cells = per_id.where(gold).select(scored.alias("scored"), "g", "p", F.explode(
        F.concat(F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("label"))),
                 seen)).alias("c"))
    cells = cells.select("scored", "c.field", "c.label", F.array_contains("g", F.col("c")).alias("ing"),
                         F.array_contains("p", F.col("c")).alias("inp"))
    # the spine: every taxonomy label, and the row without a field
    tax = taxonomy.select("field", "label", "label_pos")
    spine = tax.unionByName(
        tax.sparkSession.range(1).select(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("label"),
                                         F.lit(None).cast("int").alias("label_pos")))
    spine = bounded_broadcast(spine)
    same = lambda a, b: a["field"].eqNullSafe(b["field"]) & a["label"].eqNullSafe(b["label"])
    known = cells.alias("c").join(spine.select("field", "label").alias("s"),
                                  same({k: F.col(f"c.{k}") for k in ("field", "label")},
                                       {k: F.col(f"s.{k}") for k in ("field", "label")}), "left_semi")
    counts = known.groupBy("field", "label").agg(
        F.count_if(F.col("ing") & F.col("inp")).alias("tp"), F.count_if(F.col("inp") & ~F.col("ing")).alias("fp"),
        F.count_if(F.col("ing") & ~F.col("inp")).alias("fn"), F.count(F.lit(1)).alias("_n"),
        F.count_if("scored").alias("_s"))
    # at most one row per row of the spine, whose size is proven
    joined = spine.alias("s").join(F.broadcast(counts).alias("c"), same({k: F.col(f"s.{k}") for k in ("field", "label")},
                                                          {k: F.col(f"c.{k}") for k in ("field", "label")}), "left")
    whole = Window.partitionBy(F.lit(0))       # over the taxonomy's rows
    of_all = lambda c: F.coalesce(F.max(F.when(F.col("s.field").isNull(), F.col(c))).over(whole), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    table = joined.select("s.field", "s.label", F.col("s.label_pos").cast("int").alias("label_pos"),
                          *[zero(c).alias(c) for c in ("tp", "fp", "fn")],
                          of_all("_n").cast("bigint").alias("n"), of_all("_s").cast("bigint").alias("n_scored"))
    table = table.where("field is not null")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_label = table.select(
        "field", "label", "label_pos", "tp", "fp", "fn", (tp + fn).alias("support"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "n", "n_scored")
    sums = per_label.groupBy("field").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("f1").alias("macro_f1"), F.max("n").alias("n"), F.max("n_scored").alias("n_scored"))
    per_field = (sums.where("n_scored > 0")
                 .select("field", "n", "n_scored",
                         safe_ratio(tp, tp + fp).alias("micro_precision"),
                         safe_ratio(tp, tp + fn).alias("micro_recall"),
                         safe_ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
                         "macro_f1"))
    return per_label.drop("n", "n_scored"), per_field


def flat_gold_eval(rows: DataFrame, lexicon: DataFrame, field_map: dict,
                   id_col: str = "id", text_col: str = "text"):
    """Single-label gold columns scored against lexicon predictions.

    ``field_map``: ``{report_name: (gold_column, lexicon_field)}``.  Labels
    are stripped; a row whose gold label is ``""`` or ``TBD`` in *any*
    column is skipped (and counted).  ``correct`` = gold label among the
    predicted labels; the confusion uses the top-1 prediction = first in
    lexicon order (not the most confident), ``"none"`` when blank.

    Returns ``(accuracy, confusion)``.
    """
    golds = {name: normalize_label(F.coalesce(F.col(gc), F.lit("")))
             for name, (gc, _) in field_map.items()}
    skip = None
    for c in golds.values():
        cond = c.isin(*SKIP_LABELS)
        skip = cond if skip is None else (skip | cond)
    tagged = rows.select(F.col(id_col).alias("_id"), py_strip(F.coalesce(F.col(text_col), F.lit("")))
                         .alias("_text"), *[c.alias(f"_g_{n}") for n, c in golds.items()],
                         skip.alias("_skip"))
    scored = tagged.where(~F.col("_skip"))
    pred_fields = sorted({pf for _, pf in field_map.values()})
    preds = (lexicon_labels(scored.select("_id", "_text"), lexicon, "_id", "_text",
                            fields=pred_fields)
             .groupBy("_id")
             .agg(F.collect_list(F.struct("field", "label_pos", "label")).alias("_p")))   # labels of one record
    found = F.coalesce(F.col("_p"), F.array().cast(preds.schema["_p"].dataType))

    def judged(name, pf):
        mine = F.array_sort(F.filter(found, lambda x: x["field"] == F.lit(pf)))
        gold = F.col(f"_g_{name}")
        return F.struct(F.lit(name).alias("field"), gold.alias("gold"),
                        F.coalesce(F.try_element_at(mine, F.lit(1))["label"], F.lit(NO_LABEL)).alias("pred"),
                        F.exists(mine, lambda x: x["label"] == gold).alias("correct"))

    scored_rows = (scored.drop("_text").join(preds, "_id", "left")
                   .select(F.explode(F.array(*[judged(n, pf) for n, (_, pf) in field_map.items()])).alias("_j"))
                   .select("_j.*"))
    skipped = tagged.agg(F.count_if("_skip").alias("skipped"))
    names = F.array(*[F.lit(n) for n in field_map])
    totals = (scored_rows.groupBy("field")
              .agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total")))
    # every field appears even when nothing was scored
    spine = skipped.select(F.explode(names).alias("field"), "skipped")
    accuracy = (spine.join(totals, "field", "left")
                .select("field", F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
                        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
                        safe_ratio(F.coalesce("correct", F.lit(0)), F.coalesce("total", F.lit(0)))
                        .alias("accuracy"),
                        F.col("skipped").cast("bigint").alias("skipped")))
    confusion = scored_rows.groupBy("field", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    return accuracy, confusion
