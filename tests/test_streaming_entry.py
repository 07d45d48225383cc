import os

from textcards import lexicons as LX
from textcards.operators.lexicon import lexicon_predict, lexicon_table, taxonomy_table
from textcards.streaming.lexicon_stream import start_lexicon_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(src)
    lex = lexicon_table(spark, LX.DOCUMENT_LEXICON)
    tax = taxonomy_table(spark, LX.DOCUMENT_TAXONOMY)
    sink = os.path.join(tmp_dir, "sink")
    q = start_lexicon_stream(spark, src, "doc_id long, text string", lex, sink, tax,
                             checkpoint=os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(300)
    got = sorted((r["doc_id"], r["field"], r["label"], r["hits"], tuple(r["evidence"]))
                 for r in spark.read.parquet(sink).collect())
    want = sorted((r["doc_id"], r["field"], r["label"], r["hits"], tuple(r["evidence"]))
                  for r in lexicon_predict(docs, lex, "doc_id", "text", tax).collect())
    assert got == want and len(got) > 0


def test_restarted_stream_adds_nothing_twice(spark, tmp_dir):
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lex, tax = lexicon_table(spark, LX.DOCUMENT_LEXICON), taxonomy_table(spark, LX.DOCUMENT_TAXONOMY)
    for part in (0, 1):          # the second start finds the first one's files done
        docs.where(f"doc_id % 2 = {part}").write.mode("append").parquet(src)
        start_lexicon_stream(spark, src, "doc_id long, text string", lex, sink, tax, name=f"labels-{os.path.basename(tmp_dir)}",
                             checkpoint=None if spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
                             else os.path.join(tmp_dir, "ckpt")).awaitTermination(300)
    got = spark.read.parquet(sink).groupBy("doc_id", "field", "label").count()
    assert got.where("count > 1").isEmpty()
    assert got.count() == lexicon_predict(docs, lex, "doc_id", "text", tax).count()


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "field", "labels", "confidences", "evidence"]
    assert df.count() == 3 * spark.read.parquet(f"{SF}/documents.parquet").count()
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    qs = {q for q in qs if q.startswith("q_")}
    assert set(qs) - set(sql) == {"q_ovr_predict"}      # iterative model fit: rows-only
