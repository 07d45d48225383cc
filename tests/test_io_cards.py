import json
import os

from pyspark.sql import functions as F

from textcards import lexicons as LX
from textcards.operators.cards import cards, merge_annotations
from textcards.operators.ingest import build_records, last_per_id, page_records
from textcards.operators.lexicon import lexicon_predict, lexicon_table, taxonomy_table
from textcards.sources import readers as R
from textcards.sources.versioned import resolve
from textcards.sources.sinks import assemble_records, write_jsonl


def test_jsonl_round_trip_and_failfast(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in.jsonl")
    with open(src, "w", encoding="utf-8") as f:
        f.write(json.dumps({"incident_id": "a-2023-01-02", "text": "Hé. Ok.", "sources": [],
                            "labels": {"f": ["x"]}, "evidence_gold": {"f": {"x": [0]}}}) + "\n\n")
        f.write(json.dumps({"incident_id": "b", "text": "", "sources": [{"url": "u"}],
                            "missing_text": True}, ensure_ascii=False) + "\n")
    df = R.read_jsonl(spark, src)
    got = {r["incident_id"]: r for r in df.collect()}
    assert set(got) == {"a-2023-01-02", "b"} and got["a-2023-01-02"]["evidence_gold"]["f"]["x"] == [0]
    out = os.path.join(tmp_dir, "out")
    write_jsonl(df, out)
    again = R.read_jsonl(spark, out)
    assert sorted(r["incident_id"] for r in again.collect()) == ["a-2023-01-02", "b"]
    bad = os.path.join(tmp_dir, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"incident_id": "x"}\n{not json\n')
    try:
        R.read_jsonl(spark, bad).collect()
        raise AssertionError("malformed JSON must fail")
    except Exception as e:  # noqa: BLE001
        assert "FAILFAST" in str(e) or "Malformed" in str(e)


def test_csv_text_dir_taxonomy_split(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "roster.csv")
    with open(csv, "w", encoding="utf-8") as f:
        f.write('incident_id,incident_name,url,retrieved_date,notes\n'
                'a-2023-01-02,"Name, with comma",http://x,2024-01-01,"multi\nline"\n'
                'b,,,,\n')
    roster = R.read_csv(spark, csv)
    assert roster.count() == 2
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "a-2023-01-02.txt"), "w") as f:
        f.write("  Text one.\n")
    texts = R.read_text_dir(spark, raw)
    assert [(r["incident_id"], r["text"]) for r in texts.collect()] == [("a-2023-01-02", "Text one.")]
    tax = os.path.join(tmp_dir, "schema.json")
    with open(tax, "w") as f:
        json.dump({"labels": {"f": ["x", "y"], "g": ["z"]}, "version": 1}, f)
    t = sorted(tuple(r) for r in R.read_taxonomy(spark, tax).collect())
    assert t == [("f", "x", 0), ("f", "y", 1), ("g", "z", 0)]
    sp = os.path.join(tmp_dir, "split.json")
    with open(sp, "w") as f:
        json.dump({"strategy": "time", "seed": 13, "test_size": 0.2, "n_labeled": 2,
                   "train": ["a"], "test": ["b"]}, f)
    assert sorted(tuple(r) for r in R.read_split(spark, sp).collect()) == [("a", "train"), ("b", "test")]
    assert R.read_split(spark, None) is None

    prev = spark.createDataFrame(
        [("a-2023-01-02", {"f": ["x"]}, None, "", 1), ("a-2023-01-02", {"f": ["y"]}, None, "", 2),
         ("b", {}, None, "2020-05-05", 1)],
        "incident_id string, labels map<string,array<string>>, "
        "evidence_gold map<string,map<string,array<int>>>, date string, ord int")
    prev = last_per_id(prev, "incident_id", "ord").drop("ord")
    rec = {r["incident_id"]: r for r in build_records(
        roster.select("incident_id", F.col("incident_name").alias("name"), "url",
                      "retrieved_date"), texts, prev).collect()}
    a, b = rec["a-2023-01-02"], rec["b"]
    assert a["incident_name"] == "Name, with comma" and a["text"] == "Text one."
    assert a["labels"] == {"f": ["y"]} and a["date"] == "2023-01-02" and a["missing_text"] is None
    assert a["sources"][0]["retrieved_date"] == "2024-01-01"
    assert b["incident_name"] == "b" and b["text"] == "" and b["missing_text"] is True
    assert b["labels"] is None and b["sources"] == [] and b["date"] == "2020-05-05"


def test_assemble_records_all_fields(spark):
    docs = spark.createDataFrame([("i1", "Fire and a leak."), ("i2", "Calm day.")],
                                 "incident_id string, text string")
    p = lexicon_predict(docs, lexicon_table(spark, LX.INCIDENT_LEXICON), "incident_id", "text",
                        taxonomy_table(spark, LX.INCIDENT_TAXONOMY))
    rec = {r["incident_id"]: r for r in assemble_records(
        p, docs, LX.INCIDENT_FIELDS, "incident_id").collect()}
    assert set(rec["i2"]["pred"]) == set(LX.INCIDENT_FIELDS)
    assert all(v == [] for v in rec["i2"]["pred"].values())
    assert rec["i1"]["pred"]["failure_mode"] == ["leak", "fire"]          # taxonomy order
    assert rec["i1"]["evidence"]["cause"]["propellant_leak"] == [0]


def test_cards_and_merge(spark):
    docs = spark.createDataFrame([(1, "Fire. More fire! Calm."), (2, "")], "doc_id int, text string")
    lex = lexicon_table(spark, {"f": {"fire": ["fire"]}, "g": {"calm": ["calm"]}})
    c = {(r["doc_id"], r["field"]): r["card"] for r in cards(docs, lex, ["f", "g"]).collect()}
    assert c[(1, "f")] == "fire (p=0.50)\n> Fire.\n> More fire!"
    assert c[(2, "f")] == "_None_" and c[(1, "g")] == "calm (p=0.50)\n> Calm."

    recs = spark.createDataFrame(
        [("a", "One. Two. Three.", {"f": ["x"], "other": ["o"]}, {"f": {"x": [0], "old": [1]}}),
         ("b", "", {"f": ["x"]}, None)],
        "incident_id string, text string, labels map<string,array<string>>, "
        "evidence_gold map<string,map<string,array<int>>>")
    ann = spark.createDataFrame(
        [("a", "f", " y , bad, x,y", {"y": "2, 0, 0, 7, z", "x": ""}),
         ("b", "f", "y", {"y": "0"})],
        "incident_id string, field string, labels_raw string, evidence_raw map<string,string>")
    tax = taxonomy_table(spark, {"f": ["x", "y"], "g": ["z"]})
    out = {r["incident_id"]: r for r in merge_annotations(recs, ann, tax, ["f", "g"]).collect()}
    a = out["a"]
    assert a["labels"] == {"other": ["o"], "f": ["y", "x", "y"], "g": []}
    assert a["evidence_gold"]["f"] == {"old": [1], "y": [0, 2], "x": [0]}
    assert out["b"]["labels"] == {"f": ["x"]}                       # no text: untouched


def test_page_records(spark):
    pages = spark.createDataFrame([(7, "http://p", "<p>Hi <b>there</b></p>")],
                                  "page_id long, url string, html string")
    r = page_records(pages, "page_id", "url").first()
    assert (r["incident_id"], r["source_type"], r["text"]) == ("7", "news", "Hi there")


def test_append_and_report_sinks(spark, tmp_dir):
    from textcards.sources.sinks import write_report
    out = os.path.join(tmp_dir, "scraped")
    rec = spark.createDataFrame([("p1", "http://a", "news", "Text.")], R.SCRAPED_SCHEMA)
    write_jsonl(rec, out, mode="append")
    write_jsonl(rec, out, mode="append")                      # S7: appended, not replaced
    assert R.read_jsonl(spark, out, R.SCRAPED_SCHEMA).count() == 2
    rep = os.path.join(tmp_dir, "report")
    write_report(spark.createDataFrame([("overall", 0.5)], "scope string, f1 double"), rep)
    back = spark.read.json(resolve(spark, rep)).collect()
    assert [(r["scope"], r["f1"]) for r in back] == [("overall", 0.5)]
