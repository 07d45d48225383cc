"""Lexicon labelling (C4) over a Structured Streaming source.

The lexicon path needs no cross-record state: each record is labelled
inside its own row after a stream-static broadcast join with the label
table, so the same ``lexicon_predict`` plan runs on a streaming DataFrame
in append mode.  Exactly-once output comes from the file sink + checkpoint;
a restarted stream must find the same checkpoint, so without an explicit
location it is ``spark.checkpoint.dir`` plus the stream's name (not the
session's own subfolder of it, which changes with every session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textcards.operators.lexicon import lexicon_predict


def stream_lexicon_predictions(records: DataFrame, lexicon: DataFrame,
                               taxonomy: DataFrame | None = None, id_col: str = "doc_id",
                               text_col: str = "text", fields=None) -> DataFrame:
    """Streaming DataFrame of long-form predictions (see ``lexicon_predict``)."""
    if not records.isStreaming:
        raise ValueError("records must be a streaming DataFrame (spark.readStream...)")
    return lexicon_predict(records, lexicon, id_col, text_col, taxonomy, fields)


def start_lexicon_stream(spark: SparkSession, source_dir: str, schema: str, lexicon: DataFrame,
                         sink_dir: str, taxonomy: DataFrame | None = None,
                         id_col: str = "doc_id", text_col: str = "text",
                         checkpoint: str | None = None, name: str | None = None,
                         available_now: bool = True,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Read parquet files arriving in ``source_dir``, write predictions as
    parquet to ``sink_dir``.  ``available_now`` processes what is there (in
    bounded micro-batches) and stops; otherwise runs continuously.  Needs a
    ``checkpoint`` location, or a ``name`` and ``spark.checkpoint.dir``."""
    if checkpoint is None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base or not name:
            raise ValueError("pass a checkpoint location, or a stream name with spark.checkpoint.dir set")
        checkpoint = f"{base.rstrip('/')}/streams/{name}"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    records = reader.parquet(source_dir)
    preds = stream_lexicon_predictions(records, lexicon, taxonomy, id_col, text_col)
    writer = (preds.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start(sink_dir)
