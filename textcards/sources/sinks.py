"""Sinks: S6 record JSONL, S7 append, S8 metric reports, S9 nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.sources.versioned import publish, resolve


def assemble_records(pred_long: DataFrame, scored_ids: DataFrame, fields,
                     id_col: str = "incident_id", label_order: str = "label_pos") -> DataFrame:
    """Long predictions -> one nested record per scored id.

    ``(id, pred map<field, array<label>>, confidence map<field, map<label,
    double>>, evidence map<field, map<label, array<int>>>)`` with **every
    field present** (``[]`` / ``{}`` when nothing was predicted), labels in
    ``label_order`` (``label_pos`` = taxonomy order, ``label`` = alphabetical).
    One shuffle by id; records without predictions come from ``scored_ids``.
    ``pred_long`` must hold one row per (id, field, label).
    """
    fields = list(fields)
    per_id = (pred_long.groupBy(id_col).agg(F.collect_list(F.struct(
        "field", F.col(label_order).alias("_o"), "label", "confidence", "evidence")).alias("_p")))
    j = scored_ids.select(id_col).distinct().join(per_id, id_col, "left")
    items = F.coalesce(F.col("_p"), F.array().cast(per_id.schema["_p"].dataType))

    def of(f):
        return F.array_sort(F.filter(items, lambda x: x["field"] == F.lit(f)))

    names = F.array(*[F.lit(f) for f in fields])
    pred = F.map_from_arrays(names, F.array(*[F.transform(of(f), lambda x: x["label"])
                                              for f in fields]))
    conf = F.map_from_arrays(names, F.array(*[F.map_from_entries(F.transform(
        of(f), lambda x: F.struct(x["label"], x["confidence"]))) for f in fields]))
    evid = F.map_from_arrays(names, F.array(*[F.map_from_entries(F.transform(
        of(f), lambda x: F.struct(x["label"], x["evidence"]))) for f in fields]))
    return j.select(id_col, pred.alias("pred"), conf.alias("confidence"), evid.alias("evidence"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, nulls omitted (optional keys).

    Overwriting publishes a new version (``versioned``): ``df`` may read the very
    table it replaces, and a crash keeps the old rows.  Appending adds files to
    the current version."""
    def write(rows, folder, how="errorifexists"):
        rows.write.mode(how).option("ignoreNullFields", "true").json(folder)

    if mode == "append":
        write(df, resolve(df.sparkSession, path), "append")
    else:
        publish(df, path, write)


def write_report(df: DataFrame, path: str) -> None:
    """A metric table with one row per taxonomy label, field or scope at
    most, as one file of JSON lines, published like ``write_jsonl``.  The rows go
    to one task *after* their aggregation (a plain ``coalesce`` would pull that
    into the task as well)."""
    publish(df.repartition(1), path, lambda rows, folder: rows.write.json(folder))
