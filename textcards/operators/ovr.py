"""C5 TF-IDF + one-vs-rest logistic regression: A9 M1-M5 U2 K7 (+ K2 evidence).

* Label states per field (A9): over the *distinct* training records,
  ``0 < count < n`` -> active (gets a classifier), ``count == n > 0`` ->
  always-on (predicted at confidence 1.0), ``0`` -> never predicted.
* Features: the TF-IDF vocabulary is fitted once on the training texts and
  shared by all fields (the reference refits the identical vectoriser per
  field), with no bound on its size.
* One binary L2 logistic regression per active label (``logreg``), all fitted
  together on every training record.  Coefficients are a table ``(term, one value
  per label)``; test records meet it in a join by term.
* Prediction: probability ``>= threshold``; always-on labels added at 1.0;
  labels listed alphabetically; evidence = the record's top TF-IDF
  sentences, shared by every label of the record.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.operators.common import bounded_broadcast, stored, stored_by
from textcards.operators.logreg import MAX_TASKS, coefficients, fit_vectors, matrix_entries
from textcards.operators.ovr_model import fit_tables, predict
from textcards.operators.row_vectors import RowVectors
from textcards.operators.tfidf import HEAVY_SHARE, lookup, tfidf_matrix, tfidf_products

KEY = "\u0000"      # between field and label


def label_states(gold_long: DataFrame, train_ids: DataFrame, taxonomy: DataFrame,
                 id_col: str = "id") -> DataFrame:
    """``(field, label, label_pos, count, n, state)``, state in
    ``active | always | never``.  Out-of-taxonomy labels are ignored; a
    label repeated inside one record counts once."""
    ids = train_ids.select(id_col).distinct()
    n = ids.count()
    tax = bounded_broadcast(taxonomy.select("field", "label", "label_pos"))
    counts = (gold_long.select(id_col, "field", "label").distinct()
              .join(ids, id_col, "left_semi")
              .groupBy("field", "label").agg(F.count(F.lit(1)).alias("count")))
    c = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    state = (F.when((c > 0) & (c < n), "active")
             .when((c == n) & (F.lit(n) > 0), "always").otherwise("never"))
    return (tax.join(counts, ["field", "label"], "left")
            .select("field", "label", "label_pos", c.alias("count"),
                    F.lit(n).cast("bigint").alias("n"), state.alias("state")))


@dataclass
class OvrModel:
    """``labels``: fitted (field, label) pairs; ``gold``: (row, g), the numbers of
    each training record's labels, stored; ``coef``: (term, heavy, c0, c1, ...) stored;
    ``matrix``: the training matrix in blocks, stored."""

    labels: list
    n: int
    gold: DataFrame
    intercepts: np.ndarray
    coef: DataFrame
    matrix: DataFrame
    C: float

    def entries(self) -> DataFrame:
        """The training matrix as ``(row, term, weight)``."""
        return self.matrix.mapInArrow(matrix_entries, "row int, term string, weight double")


def numbered(ids: DataFrame, id_col: str) -> DataFrame:
    """``(id, row)``: the distinct ids, numbered from 0 by the number of those in
    the partitions before; stored."""
    few = ids.select(id_col).distinct().sortWithinPartitions(F.xxhash64(F.col(id_col).cast("string")), id_col)
    at = stored(few.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    first, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        first.append((p, total - (p << 33)))      # a number per partition
        total += n
    spark = ids.sparkSession
    return at.join(F.broadcast(spark.createDataFrame(first, "_p long, _first long")), part == F.col("_p")).select(
        id_col, (F.col("_at") + F.col("_first")).cast("int").alias("row"))


def _write_gold(vectors: RowVectors):
    def run(group):
        """The rows of a range (row, g) -> its part of the vector ``y``."""
        import pyarrow as pa
        row = group.column("row").to_numpy()
        c = int(row[0]) // vectors.size
        a, b = vectors.bounds(c)
        y = np.zeros((vectors.labels, b - a))
        g = group.column("g").combine_chunks()
        y[g.flatten().to_numpy(), (row - a)[g.value_parent_indices().to_numpy()]] = 1.0
        vectors.write("y", c, y)
        return pa.table({"range": [c]})
    return run


def fit_ovr(train_docs: DataFrame, gold_long: DataFrame, active: list, vocab: DataFrame,
            id_col: str = "id", text_col: str = "text", max_iter: int = 2000, C: float = 1.0,
            tol: float = 1e-4) -> OvrModel:
    """All ``active`` labels fitted on every training record."""
    spark = train_docs.sparkSession
    rows = numbered(train_docs, id_col)
    keys = F.array(*[F.lit(KEY.join(x)) for x in active])
    gold_sets = (gold_long.select(id_col, (F.array_position(keys, F.concat_ws(KEY, "field", "label")) - 1).cast("int").alias("k"))
                 .where("k >= 0").groupBy(id_col).agg(F.collect_set("k").alias("g")))
    gold = stored(rows.join(gold_sets, id_col, "left").select("row", F.coalesce("g", F.array().cast("array<int>")).alias("g")))
    n, tasks = gold.count(), min(MAX_TASKS, spark.sparkContext.defaultParallelism)
    texts = train_docs.join(bounded_broadcast(rows), id_col).select("row", text_col)
    matrix = stored(tfidf_matrix(texts, vocab, tasks, "row", text_col))
    with RowVectors(spark, n, len(active)) as vectors:
        gold.groupBy(F.floor(F.col("row") / vectors.size).alias("range")).applyInArrow(_write_gold(vectors), "range long").count()
        name, intercepts = fit_vectors(matrix, vectors, C, tol, max_iter)
        coef = stored_by(coefficients(matrix, vectors, name, HEAVY_SHARE * n), "term")
    return OvrModel(list(active), n, gold, intercepts, coef, matrix, C)


def margins(vectors: DataFrame, model: OvrModel, key: str) -> DataFrame:
    """``(key, m0, m1, ...)``: the labels' margins without intercepts, of rows
    with a known term."""
    names = [f"c{k}" for k in range(len(model.labels))]
    return lookup(vectors.select(key, "term", "weight"), model.coef, names).groupBy(key).agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(f"m{k}") for k, c in enumerate(names)])


def optimality(model: OvrModel) -> DataFrame:
    """``(field, label, n, positives, max_grad)``: the gradient of each label's
    objective at the fitted coefficients, recomputed with joins and aggregates
    from the training matrix; nothing of the solver is used."""
    names, entries = range(len(model.labels)), model.entries()
    gold = model.gold.select("row", *[F.array_contains("g", k).cast("double").alias(f"y{k}") for k in names])
    m = gold.join(margins(entries, model, "row"), "row", "left")
    z = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) + F.lit(float(model.intercepts[k])) for k in names]
    residual = stored(m.select("row", *[(1 / (1 + F.exp(-z[k])) - F.col(f"y{k}")).alias(f"r{k}") for k in names],
                               *[f"y{k}" for k in names]))
    wide = residual.select("row", *[f"r{k}" for k in names])
    g = entries.join(bounded_broadcast(wide, bytes_per_row=16 + 16 * len(names)), "row").groupBy("term").agg(
        *[(F.sum(F.col("weight") * F.col(f"r{k}")) / model.n).alias(f"g{k}") for k in names])
    g = g.join(model.coef, "term").agg(
        *[F.max(F.abs(F.col(f"g{k}") + F.col(f"c{k}") / (model.C * model.n))).alias(f"g{k}") for k in names])
    b = residual.agg(*[F.abs(F.avg(f"r{k}")).alias(f"b{k}") for k in names],
                     *[F.sum(f"y{k}").cast("long").alias(f"p{k}") for k in names])
    both = g.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k")     # one row each
    return both.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), F.lit(lab).alias("label"), F.lit(model.n).cast("long").alias("n"),
        F.col(f"p{k}").alias("positives"), F.greatest(F.coalesce(f"g{k}", F.lit(0.0)), f"b{k}").alias("max_grad"))
        for k, (f, lab) in enumerate(model.labels)])).alias("x")).select("x.*")


def predict_ovr(model: OvrModel, test_docs: DataFrame, vocab: DataFrame, id_col: str = "id",
                text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, field, label, confidence)`` of the labels at or above the threshold."""
    names = [f"c{k}" for k in range(len(model.labels))]
    m = tfidf_products(test_docs, vocab, model.coef, names, id_col, text_col)
    j = test_docs.select(id_col).join(m, id_col, "left")
    p = [1 / (1 + F.exp(-(F.coalesce(F.col(f"m{k}"), F.lit(0.0)) + F.lit(float(b)))))
         for k, b in enumerate(model.intercepts)]
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(lab).alias("label"), p[k].alias("confidence"))
                      for k, (f, lab) in enumerate(model.labels)])
    return j.select(id_col, F.explode(F.filter(named, lambda x: x["confidence"] >= threshold)).alias("x")).select(id_col, "x.*")


def ovr_predict(train_docs: DataFrame, test_docs: DataFrame, gold_long: DataFrame,
                taxonomy: DataFrame, fields, id_col: str = "id", text_col: str = "text",
                threshold: float = 0.5, max_iter: int = 2000, max_df: float = 0.95,
                evidence_k: int = 3, C: float = 1.0, tol: float = 1e-4):
    """Fit on ``train_docs`` (id, text) with gold ``(id, field, label)``;
    predict ``test_docs``.  Returns ``(predictions, states)``:
    predictions ``(id, field, label, confidence, evidence array<int>)``."""
    fields = list(fields)
    states = label_states(gold_long, train_docs.select(id_col), taxonomy, id_col)
    rows = states.where(F.col("field").isin(fields)).collect()   # <= taxonomy size
    model = fit_tables(train_docs, gold_long, rows, id_col, text_col, max_df, max_iter=max_iter, C=C, tol=tol)
    return predict(model, test_docs, id_col, text_col, threshold, evidence_k), states
