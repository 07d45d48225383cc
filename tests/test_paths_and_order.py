"""URIs instead of local paths, broken files, record order, exact cuts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textcards.functions.text import parse_date
from textcards.operators import splits as S
from textcards.operators.cards import merge_annotations
from textcards.operators.lexicon import taxonomy_table
from textcards.plans import jobs as J
from textcards.sources import readers as R


def lines(path, rows):
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def records(tmp_dir):
    return lines(os.path.join(tmp_dir, "recs.jsonl"), [
        {"incident_id": f"r{i}", "text": "A fire.", "labels": {"failure_mode": ["fire"]}, "date": "2024-01-01",
         "evidence_gold": {"failure_mode": {"fire": [0]}}} for i in range(10)])


def test_previous_labels_from_a_uri(spark, tmp_dir):
    roster = os.path.join(tmp_dir, "roster.csv")
    with open(roster, "w") as f:
        f.write("incident_id,incident_name,url,retrieved_date,notes\nr1,n,,,\n")
    for prev in (records(tmp_dir), f"file://{records(tmp_dir)}"):
        out = os.path.join(tmp_dir, f"out{len(prev)}")
        r = J.build_incidents_job(spark, roster, None, out, prev).first()
        assert r["labels"] == {"failure_mode": ["fire"]} and r["date"] == "2024-01-01"
    r = J.build_incidents_job(spark, roster, None, os.path.join(tmp_dir, "none"), f"file://{tmp_dir}/absent").first()
    assert r["labels"] is None


def test_split_written_and_read_by_uri(spark, tmp_dir):
    data, split = records(tmp_dir), os.path.join(tmp_dir, "split")
    J.split_job(spark, f"file://{data}", f"file://{split}")
    for path in (split, f"file://{split}"):
        got = {r["incident_id"] for r in R.read_split(spark, path).where("part = 'test'").collect()}
        assert got == {"r8", "r9"}           # of one date, the last ids
        out = os.path.join(tmp_dir, f"m{len(path)}")
        preds = lines(os.path.join(tmp_dir, "p.jsonl"), [{"incident_id": f"r{i}", "pred": {"failure_mode": ["fire"]}} for i in range(10)])
        _, per = J.evaluate_job(spark, f"file://{data}", preds, out, split=path)
        assert {(r["n"], r["n_scored"]) for r in per.collect()} == {(2, 2)}
    with pytest.raises(ValueError):          # a plain file is not replaced by a table
        J.clean_job(spark, data, f"file://{data}")


@pytest.mark.parametrize("read", ["predictions", "split", "taxonomy", "records"])
def test_broken_files_fail(spark, tmp_dir, read):
    path = os.path.join(tmp_dir, "broken.json")
    with open(path, "w") as f:
        f.write('{"incident_id": "a", "train": ["a"], "labels": {"f": ["x"]}, "te')
    with pytest.raises(Exception, match="(?i)malformed"):
        {"predictions": lambda: J.read_predictions(spark, path), "split": lambda: R.read_split(spark, path),
         "taxonomy": lambda: R.read_taxonomy(spark, path), "records": lambda: R.read_jsonl(spark, path)}[read]().collect()


def test_last_line_wins_across_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    for i, pad in enumerate((40_000, 10, 20_000)):       # files are packed into tasks by size
        lines(os.path.join(d, f"part-{i}.json"), [{"incident_id": "a", "text": str(i)}, {"incident_id": f"x{i}", "text": "p" * pad}])
    assert {r["text"] for r in J.read_records(spark, d).where("incident_id = 'a'").collect()} == {"2"}


def test_fields_of_the_given_taxonomy(spark, tmp_dir):
    schema = os.path.join(tmp_dir, "schema.json")
    with open(schema, "w") as f:
        json.dump({"labels": {"colour": ["red", "blue"]}}, f)
    out = J.lexicon_predict_job(spark, lines(os.path.join(tmp_dir, "c.jsonl"), [{"incident_id": "a", "text": "A red car."}]),
                                os.path.join(tmp_dir, "out"), schema_path=schema, lexicon={"colour": {"red": ["red"]}}).first()
    assert out["pred"] == {"colour": ["red"]}


def test_dates_have_four_digit_years(spark):
    given = ["2023-4-2", "2023-04-02", "23-4-2", "12023-01-01", "-5-01-01", "2023-13-01", "2023-02-30", "", None, "2023-04-02 "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, d string").select("i", parse_date("d").alias("p"))
    got = {r["i"]: str(r["p"]) for r in df.collect() if r["p"] is not None}
    assert got == {0: "2023-04-02", 1: "2023-04-02"}


def test_cut_is_exact_next_to_bucket_edges(spark):
    lo, hi = 3, (1 << 60) + 12345
    width = -(-(hi - lo + 1) // S.BUCKETS)
    keys = sorted({lo, hi} | {lo + b * width + d for b in range(1, S.BUCKETS) for d in (-1, 0)})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 7, 100, 1024, 2047, 3001, len(keys) - 1):
        got = df.where(S.extreme_n(df, ["k"], n)).collect()
        assert sorted(r["k"] for r in got) == keys[-n:]
    wide = spark.createDataFrame([(-(1 << 63) + i,) for i in range(1500)] + [((1 << 63) - 1 - i,) for i in range(1500)], "k long")
    assert wide.where(S.extreme_n(wide, ["k"], 1501)).count() == 1501


def test_string_ids_break_ties_in_their_order(spark):
    ids = ["b", "a", "ab", "abcdefgh", "abcdefg", "abcdefghi", "é", "z", "ba", "10", "9", "a\u0001"]
    df = spark.createDataFrame([(i, "2024-01-01") for i in ids], "id string, date string")
    for size in (0.1, 0.3, 0.5, 0.9):
        split, _ = S.time_split(df, "id", "date", size)
        test = {r["id"] for r in split.where("part = 'test'").collect()}
        assert test == set(sorted(ids)[-S.test_count(len(ids), size):])


def test_annotation_answers(spark):
    recs = spark.createDataFrame([("a", "One. Two. Three.", None, None)], "incident_id string, text string, "
                                 "labels map<string,array<string>>, evidence_gold map<string,map<string,array<int>>>")
    ann = spark.createDataFrame(
        [("a", "f", "x", {"x": "0"}, 2), ("a", "f", "y", {"y": "0000000001, 2, 99999999999999999999999"}, 9), ("a", "f", "x", {"x": "0"}, 1)],
        "incident_id string, field string, labels_raw string, evidence_raw map<string,string>, ord int")
    tax = taxonomy_table(spark, {"f": ["x", "y"]})
    r = merge_annotations(recs, ann, tax, ["f"], ord_col="ord").first()
    assert r["labels"] == {"f": ["y"]} and r["evidence_gold"]["f"] == {"y": [1, 2]}
    merge_annotations(recs, ann, tax, ["f"]).collect()          # no order: still one answer


def test_score_logits_job(spark, tmp_dir):
    data = lines(os.path.join(tmp_dir, "d.jsonl"), [
        {"incident_id": "a", "text": "The tiles cracked. A raptor engine leaked. Tiles and heat shield burned!"}, {"incident_id": "b", "text": "x"}])
    taxonomy = ["raptor_engine", "propulsion", "avionics", "gnc", "stage_separation", "structures", "heat_shield"]
    logits = lines(os.path.join(tmp_dir, "l.jsonl"), [
        {"incident_id": "a", "field": "subsystem", "logits": [0.0, -1.0, 2.0] + [-5.0] * (len(taxonomy) - 4) + [3.0]}])
    r = J.score_logits_job(spark, data, logits, os.path.join(tmp_dir, "out")).collect()
    assert len(r) == 1 and set(r[0]["pred"]) == {"subsystem", "failure_mode", "impact", "cause"}
    assert r[0]["pred"]["subsystem"] == ["raptor_engine", "avionics", "heat_shield"]
    assert r[0]["confidence"]["subsystem"]["raptor_engine"] == 0.5
    ev = r[0]["evidence"]["subsystem"]
    assert ev["heat_shield"] == ["Tiles and heat shield burned!", "The tiles cracked."]
    assert ev["raptor_engine"] == ["A raptor engine leaked."] and ev["avionics"] == []
