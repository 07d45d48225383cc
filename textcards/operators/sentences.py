"""P4 as a table: one row per (record, sentence index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.functions.text import split_sentences


def sentences(df: DataFrame, id_cols, text_col: str = "text") -> DataFrame:
    """``(*id_cols, sent_idx int, sentence string)``; narrow, no shuffle.

    Records whose text is empty produce no rows (as in the reference).
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return (df.select(*ids, F.posexplode(split_sentences(F.coalesce(F.col(text_col), F.lit(""))))
                      .alias("sent_idx", "sentence")))
