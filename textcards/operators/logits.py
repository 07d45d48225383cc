"""C6 scoring from a logits table: P18 P19 A15 (+ K3 evidence via lexicon.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.functions.labels import picked_by_threshold, sigmoid32
from textcards.operators.common import bounded_broadcast
from textcards.operators.lexicon import evidence_label_table, keyword_sentence_ranking
from textcards.sources.sinks import assemble_records


def logit_probabilities(logits: DataFrame, taxonomy: DataFrame, id_col: str = "id",
                        logits_col: str = "logits") -> DataFrame:
    """One row per (record, label): ``(id, field, label, label_pos, logit, prob)``.

    Logit ``i`` (0-based) belongs to the taxonomy label at ``label_pos = i``;
    extra logits are ignored (inner join with the label list).
    """
    tax = bounded_broadcast(taxonomy.select("field", "label", "label_pos"))
    ex = logits.select(F.col(id_col), F.posexplode(logits_col).alias("label_pos", "logit"))
    return (ex.join(tax, "label_pos", "inner")
            .select(id_col, "field", "label", "label_pos",
                    F.col("logit").cast("float").alias("logit"),
                    sigmoid32("logit").alias("prob")))


def logit_labels(logits: DataFrame, taxonomy: DataFrame, id_col: str = "id",
                 logits_col: str = "logits", threshold: float = 0.5) -> DataFrame:
    """Picked labels ``prob >= threshold``, label-list order, confidence
    = probability (as double)."""
    p = logit_probabilities(logits, taxonomy, id_col, logits_col)
    return (p.where(picked_by_threshold("prob", threshold))
            .select(id_col, "field", "label", "label_pos",
                    F.col("prob").cast("double").alias("confidence")))


def score_logits(docs: DataFrame, logits: DataFrame, taxonomy: DataFrame, evidence_lexicon: DataFrame | None,
                 fields, id_col: str = "incident_id", text_col: str = "text", threshold: float = 0.5,
                 k: int = 3) -> DataFrame:
    """Logits -> nested records (S9) whose evidence is sentence *texts*.

    ``logits (id, field, logits)``: one vector per record and field, value i for
    the field's label at ``label_pos = i``.  Picked are labels with probability
    ``>= threshold`` (P19); each gets the ``k`` sentences with most of its
    evidence keywords (K3), a label without keywords its own name (P15).
    Records of ``docs`` that have logits are returned, with every field.
    """
    fields = list(fields)
    tax = taxonomy.select("field", "label", "label_pos")
    cells = logits.where(F.col("field").isin(fields)).select(
        id_col, "field", F.posexplode("logits").alias("label_pos", "logit"))
    picked = (cells.join(bounded_broadcast(tax), ["field", "label_pos"])
              .withColumn("prob", sigmoid32("logit")).where(picked_by_threshold("prob", threshold))
              .select(id_col, "field", "label", "label_pos", F.col("prob").cast("double").alias("confidence")))
    ranked = keyword_sentence_ranking(docs.select(id_col, text_col), picked.select(id_col, "field", "label"),
                                      evidence_label_table(taxonomy, evidence_lexicon), id_col, text_col, k)
    quotes = ranked.groupBy(id_col, "field", "label").agg(
        F.sort_array(F.collect_list(F.struct("rank", "sentence"))).alias("_e"))      # at most k sentences
    found = picked.join(quotes, [id_col, "field", "label"], "left").withColumn(
        "evidence", F.coalesce(F.transform("_e", lambda x: x["sentence"]), F.array().cast("array<string>"))).drop("_e")
    scored = docs.select(id_col).join(logits.select(id_col).distinct(), id_col, "left_semi")
    return assemble_records(found, scored, fields, id_col)


def epsilon_micro_f1(logits: DataFrame, gold_hot: DataFrame, id_col: str = "id",
                     logits_col: str = "logits", gold_col: str = "gold",
                     threshold: float = 0.5) -> DataFrame:
    """Micro P/R/F1 over all (record, label) cells with ``1e-9`` added to
    each denominator, predictions = ``sigmoid(logit) >= threshold``.

    ``gold_hot``: (id, gold array<int> 0/1) aligned with the logits.
    Cells are compared position by position inside each row (no explode),
    then one global sum.  One-row result.
    """
    j = logits.select(id_col, logits_col).join(gold_hot.select(id_col, gold_col), id_col, "inner")
    cells = F.arrays_zip(F.col(logits_col).alias("x"), F.col(gold_col).alias("y"))
    pred = lambda c: picked_by_threshold(sigmoid32(c["x"]), threshold).cast("int")
    per_row = j.select(
        F.aggregate(cells, F.lit(0), lambda a, c: a + pred(c) * c["y"]).alias("tp"),
        F.aggregate(cells, F.lit(0), lambda a, c: a + pred(c) * (1 - c["y"])).alias("fp"),
        F.aggregate(cells, F.lit(0), lambda a, c: a + (1 - pred(c)) * c["y"]).alias("fn"))
    s = per_row.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    eps = F.lit(1e-9)
    prec = tp / (tp + fp + eps)
    rec = tp / (tp + fn + eps)
    return s.select("tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"),
                    (2 * prec * rec / (prec + rec + eps)).alias("micro_f1"))
