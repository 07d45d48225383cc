"""C12 cards (P16 P17 J8) and C13 annotation merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.functions.text import badge, py_strip, split_sentences
from textcards.operators.common import bounded_broadcast
from textcards.operators.lexicon import lexicon_predict

NONE_CARD = "_None_"


def cards(docs: DataFrame, lexicon: DataFrame, fields, id_col: str = "doc_id",
          text_col: str = "text", taxonomy: DataFrame | None = None) -> DataFrame:
    """One row per (record, field): ``(id, field, n_labels, card)``.

    ``card`` lists each predicted label as a badge ``label (p=0.50)`` followed
    by its verbatim evidence sentences (``> sentence``), one item per line;
    ``_None_`` when the field has no label.  Quotes come from the lexicon
    pass itself, so the text is never shuffled.
    """
    fields = list(fields)
    p = lexicon_predict(docs, lexicon, id_col, text_col, taxonomy, fields, quotes=True)
    per = (p.groupBy(id_col, "field")
           .agg(F.sort_array(F.collect_list(F.struct("label_pos", "label", "confidence",
                                                     "quotes"))).alias("_items")))
    spine = docs.select(id_col, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    j = spine.join(per, [id_col, "field"], "left")
    item = lambda x: F.concat(
        badge(x["label"], x["confidence"]),
        F.array_join(F.transform(x["quotes"], lambda q: F.concat(F.lit("\n> "), q)), ""))
    body = F.array_join(F.transform("_items", item), "\n")
    return j.select(id_col, "field",
                    F.coalesce(F.size("_items"), F.lit(0)).cast("int").alias("n_labels"),
                    F.coalesce(body, F.lit(NONE_CARD)).alias("card"))


def _parse_labels(raw, options):
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), py_strip)
    kept = F.filter(parts, lambda s: (s != F.lit("")) & F.array_contains(options, s))
    return kept


def _parse_indices(raw, n_sents):
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), py_strip)
    digits = F.filter(parts, lambda s: s.rlike("^[0-9]+$"))
    # leading zeros do not count; more than 18 digits are beyond any sentence
    idx = F.transform(digits, lambda s: F.regexp_replace(s, "^0+(?=[0-9])", ""))
    idx = F.transform(idx, lambda s: F.when(F.length(s) <= 18, s.cast("long")))
    valid = F.filter(idx, lambda i: i.isNotNull() & (i < n_sents))
    return F.array_sort(F.array_distinct(F.transform(valid, lambda i: i.cast("int"))))


def merge_annotations(records: DataFrame, annotations: DataFrame, taxonomy: DataFrame,
                      fields, id_col: str = "incident_id", ord_col: str | None = None) -> DataFrame:
    """Apply label annotations to records (the batch form of the
    interactive labelling tool).

    ``records``: (id, text, labels map<string,array<string>>,
    evidence_gold map<string,map<string,array<int>>>, ...).
    ``annotations``: (id, field, labels_raw string, evidence_raw
    map<string,string>) — comma-separated answers; a missing row or a blank
    answer keeps the old value.  Of several answers for one (record, field) the
    last by ``ord_col`` counts (A1); without an order, or on equal order, the
    larger ``labels_raw``.  Non-blank labels are split, stripped and
    kept only when in the field's taxonomy (input order, repeats kept);
    evidence indices are parsed, kept in ``[0, n_sentences)``, sorted and
    de-duplicated, and asked only for the kept labels.  Records without text
    are returned untouched; every field of a record with text gets a labels
    entry.
    """
    fields = list(fields)
    opts = (bounded_broadcast(taxonomy.groupBy("field")
                              .agg(F.sort_array(F.collect_list(F.struct("label_pos", "label")))
                                   .alias("_o")))
            .select("field", F.transform("_o", lambda x: x["label"]).alias("options")))
    ann = (annotations.join(opts, "field", "inner")
           .groupBy(id_col, "field")
           .agg(F.max_by(F.struct("labels_raw", "evidence_raw", "options"), F.struct(
               (F.col(ord_col) if ord_col else F.lit(0)).alias("o"), "labels_raw")).alias("_a"))
           .select(id_col, "field", "_a.*")
           .groupBy(id_col)
           .agg(F.map_from_entries(F.collect_list(F.struct(
               "field", F.struct("labels_raw", "evidence_raw", "options")))).alias("_ann")))
    j = records.join(ann, id_col, "left")
    has_text = F.coalesce(F.col("text"), F.lit("")) != F.lit("")
    n_sents = F.size(split_sentences(F.coalesce(F.col("text"), F.lit(""))))
    old_l = F.coalesce(F.col("labels"), F.create_map().cast("map<string,array<string>>"))
    old_e = F.coalesce(F.col("evidence_gold"),
                       F.create_map().cast("map<string,map<string,array<int>>>"))
    new_l_entries, new_e_entries = [], []
    for f in fields:
        a = F.element_at(F.col("_ann"), F.lit(f))
        raw = a["labels_raw"]
        blank = F.coalesce(py_strip(raw), F.lit("")) == F.lit("")
        prev = F.coalesce(F.element_at(old_l, F.lit(f)), F.array().cast("array<string>"))
        labels_f = F.when(blank, prev).otherwise(_parse_labels(raw, a["options"]))
        prev_e = F.coalesce(F.element_at(old_e, F.lit(f)),
                            F.create_map().cast("map<string,array<int>>"))
        ev_raw = a["evidence_raw"]

        def ev_for(lab, prev_e=prev_e, ev_raw=ev_raw):
            r = F.element_at(ev_raw, lab)
            keep = F.coalesce(F.element_at(prev_e, lab), F.array().cast("array<int>"))
            return F.when(F.coalesce(py_strip(r), F.lit("")) == F.lit(""), keep).otherwise(
                _parse_indices(r, n_sents))

        asked = F.array_distinct(labels_f)
        fresh = F.map_from_arrays(asked, F.transform(asked, lambda lab: ev_for(lab)))
        kept_old = F.map_filter(prev_e, lambda k, v: ~F.array_contains(asked, k))
        new_l_entries.append(F.struct(F.lit(f).alias("k"), labels_f.alias("v")))
        new_e_entries.append(F.struct(F.lit(f).alias("k"), F.map_concat(kept_old, fresh)
                                      .alias("v")))
    other_l = F.map_filter(old_l, lambda k, v: ~k.isin(fields))
    other_e = F.map_filter(old_e, lambda k, v: ~k.isin(fields))
    new_labels = F.map_concat(other_l, F.map_from_entries(F.array(*new_l_entries)))
    new_ev = F.map_concat(other_e, F.map_from_entries(F.array(*new_e_entries)))
    out = j.withColumn("labels", F.when(has_text, new_labels).otherwise(F.col("labels")))
    out = out.withColumn("evidence_gold",
                         F.when(has_text, new_ev).otherwise(F.col("evidence_gold")))
    return out.drop("_ann")
