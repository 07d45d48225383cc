"""The llm queries: ``opN_<name>(spark, sf_dir)``, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards.llm.oracles import ORACLES  # noqa: F401  (read by the entry point)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark, sf_dir):
    from textcards.llm import quality_gam as gam
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = gam.train(docs, labels.where(~gam.held_out()))
    scored = gam.score(docs, model, ["doc_id"])
    return scored.select("doc_id", gam.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark, sf_dir):
    from textcards.llm import storage, warc_store
    base = storage.scratch(spark, "warc")
    files = warc_store.write_pages(_table(spark, sf_dir, "pages"), base)
    records = warc_store.verified(storage.cut(warc_store.read_archives(files, base), "records"), files)
    return warc_store.page_records(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark, sf_dir):
    from textcards.llm.mixing import mix
    return mix(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), "share", "weight", "copies")


def op4_decontamination(spark, sf_dir):
    from textcards.llm.decontam import contamination_digest
    return contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_paragraph_dedup(spark, sf_dir):
    from textcards.llm.paragraph_dedup import dedup_paragraphs
    kept = dedup_paragraphs(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"),
                       F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_license_scan(spark, sf_dir):
    from textcards.llm.license_scan import digest
    return digest(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    from textcards.llm.suffix_dedup import dedup_substrings
    kept = dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_shards(spark, sf_dir):
    from public_tokenizers import PATTERN, path
    from textcards.llm import storage, token_output
    out_dir = storage.scratch(spark, "shards")
    records = token_output.materialise(_table(spark, sf_dir, "documents"), out_dir,
                                       path("byte_bpe_50k.tiktoken"), PATTERN)
    return records.withColumn("docs", F.to_json("docs"))


def op9_fingerprints(spark, sf_dir):
    from textcards.llm.fingerprints import edited_fingerprints
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_shingle_join(spark, sf_dir):
    from textcards.llm.shingle_join import jaccard_components
    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op11_centroid_clustering(spark, sf_dir):
    from textcards.llm.centroids import clustered
    return clustered(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir):
    from textcards.llm.hard_negatives import mine
    every = lambda n: F.col("vec_id") % n == 0
    label = F.when(every(7), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), every(50), label=label)


def op13_byte_bpe(spark, sf_dir):
    from public_tokenizers import PATTERN, path
    from textcards.llm.byte_bpe import ByteBpe
    bpe = ByteBpe(spark, path("byte_bpe_50k.tiktoken"), PATTERN)
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), keep=["doc_id"], offsets=False)
    return bpe.decode(encoded, pieces_too=False).select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_gam, op2_warc, op3_source_mixing, op4_decontamination, op5_paragraph_dedup,
                                    op6_license_scan, op7_suffix_dedup, op8_token_shards, op9_fingerprints,
                                    op10_shingle_join, op11_centroid_clustering, op12_hard_negatives, op13_byte_bpe)}
