"""Ingest jobs: C1 build records (J1 J2 A1 P7 P9-P11), C2 clean (P3 P2 F1),
C3 page text (P1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.functions.html import paragraph_text
from textcards.functions.text import (clean_text, display_name, infer_date, missing_text_flag,
                                      py_strip, source_entries)


def last_per_id(df: DataFrame, id_col: str, ord_col: str) -> DataFrame:
    """A1 "last record wins": per id keep the row with the largest ``ord_col``.

    A plain ``max_by`` aggregate (partial aggregation map-side, so a hot id
    is pre-reduced before the shuffle); no window, no sort.
    """
    others = [c for c in df.columns if c != id_col]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(id_col).agg(F.max_by(packed, F.col(ord_col)).alias("_r"))
            .select(id_col, *[F.col("_r")[c].alias(c) for c in others]))


def build_records(roster: DataFrame, texts: DataFrame | None, previous: DataFrame | None,
                  id_col: str = "incident_id") -> DataFrame:
    """One record per roster row.

    ``roster``: (id, name, url, retrieved_date) strings.  ``texts``: (id, text)
    (J1, left join; missing -> ``""``, text stripped).  ``previous``: earlier
    records (id, labels map, evidence_gold map, date) already reduced to one
    per id (``last_per_id``); non-empty values are carried over (J2).
    Output follows the canonical record schema: ``incident_id,
    incident_name, text, sources, labels, evidence_gold, date,
    missing_text`` (absent keys are nulls).
    """
    r = roster.select(py_strip(F.coalesce(F.col(id_col), F.lit(""))).alias("incident_id"),
                      F.col("name").alias("_name"), F.col("url").alias("_url"),
                      F.col("retrieved_date").alias("_rd"))
    if texts is not None:
        t = texts.select(F.col(id_col).alias("incident_id"), F.col("text").alias("_text"))
        r = r.join(t, "incident_id", "left")
    else:
        r = r.withColumn("_text", F.lit(None).cast("string"))
    if previous is not None:
        p = previous.select(F.col(id_col).alias("incident_id"), F.col("labels").alias("_pl"),
                            F.col("evidence_gold").alias("_pe"), F.col("date").alias("_pd"))
        r = r.join(p, "incident_id", "left")
    else:
        r = (r.withColumn("_pl", F.lit(None).cast("map<string,array<string>>"))
             .withColumn("_pe", F.lit(None).cast("map<string,map<string,array<int>>>"))
             .withColumn("_pd", F.lit(None).cast("string")))
    text = py_strip(F.coalesce(F.col("_text"), F.lit("")))
    nonempty = lambda m: F.when(F.size(m) > 0, m)
    return r.select(
        "incident_id",
        display_name("_name", "incident_id").alias("incident_name"),
        text.alias("text"),
        source_entries("_url", "_rd").alias("sources"),
        nonempty(F.col("_pl")).alias("labels"),
        nonempty(F.col("_pe")).alias("evidence_gold"),
        infer_date("incident_id", "_pd").alias("date"),
        missing_text_flag(text).alias("missing_text"))


def clean_records(records: DataFrame, text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """Missing text -> ``""``, normalise whitespace, keep ``length >= min_chars``."""
    out = records.withColumn(text_col, clean_text(text_col))
    return out.where(F.length(text_col) >= min_chars)


def page_records(pages: DataFrame, id_col: str, url_col: str, html_col: str = "html",
                 source_type: str = "news") -> DataFrame:
    """C3 (minus the fetch): ``(incident_id, source_url, source_type, text)``."""
    return pages.select(F.col(id_col).cast("string").alias("incident_id"),
                        F.col(url_col).alias("source_url"),
                        F.lit(source_type).alias("source_type"),
                        paragraph_text(html_col).alias("text"))
