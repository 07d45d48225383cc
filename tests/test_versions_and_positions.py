"""Tables in versions, jobs in place, row numbers, splits of repeated ids."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textcards.operators import splits as S
from textcards.plans import jobs as J
from textcards.sources import readers as R
from textcards.sources import versioned as V
from textcards.sources.sinks import write_jsonl, write_report


def jsonl(path, rows):
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def ids(spark, path):
    return sorted(r["incident_id"] for r in R.read_jsonl(spark, path).collect())


def test_build_in_place_twice(spark, tmp_dir):
    roster, out, raw = f"{tmp_dir}/roster.csv", f"{tmp_dir}/records", f"{tmp_dir}/raw"
    os.makedirs(raw)
    with open(f"{raw}/r1.txt", "w") as f:
        f.write("A fire.")
    for rows in (["r1"], ["r1", "r2"], ["r1", "r2", "r3"]):
        with open(roster, "w") as f:
            f.write("incident_id,incident_name,url,retrieved_date,notes\n" + "".join(f"{r},n,,,\n" for r in rows))
        J.build_incidents_job(spark, roster, raw, out, labels_from=out)
        if len(rows) == 1:          # labels by hand, written over the records
            rec = J.read_records(spark, out)
            labelled = F.create_map(F.lit("cause"), F.array(F.lit("unknown")))
            write_jsonl(rec.withColumn("labels", labelled.cast("map<string,array<string>>")), out)
        got = {r["incident_id"]: r for r in J.read_records(spark, out).collect()}
        assert sorted(got) == rows and got["r1"]["labels"] == {"cause": ["unknown"]} and got["r1"]["text"] == "A fire."
    assert len([f for f in os.listdir(out) if f.startswith("v-")]) == 2        # the current version and the one before


def test_merge_and_clean_in_place(spark, tmp_dir):
    data = f"{tmp_dir}/records"
    write_jsonl(R.read_jsonl(spark, jsonl(f"{tmp_dir}/r.jsonl", [
        {"incident_id": "r1", "text": "A fire. " * 40, "labels": {"cause": ["unknown"]}}, {"incident_id": "r2", "text": "x"}])), data)
    ann = jsonl(f"{tmp_dir}/ann.jsonl", [{"incident_id": "r1", "field": "cause", "labels_raw": "propellant_leak", "evidence_raw": {}}])
    J.merge_annotations_job(spark, data, ann, data)
    got = {r["incident_id"]: r["labels"] for r in J.read_records(spark, data).collect()}
    assert got["r1"]["cause"] == ["propellant_leak"] and "r2" in got
    J.clean_job(spark, data, data)
    assert ids(spark, data) == ["r1"]


def test_death_between_write_and_publish_keeps_the_old_rows(spark, tmp_dir, monkeypatch):
    out = f"{tmp_dir}/records"
    row = lambda i: R.read_jsonl(spark, jsonl(f"{tmp_dir}/{i}.jsonl", [{"incident_id": i}]))
    write_jsonl(row("old"), out)

    def dies(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "point", dies)
        with pytest.raises(OSError):
            write_jsonl(row("new"), out)
    assert ids(spark, out) == ["old"]
    with pytest.raises(Exception):      # and one that dies while it writes
        write_jsonl(row("new").withColumn("x", F.raise_error(F.lit("bad"))), out)
    assert ids(spark, out) == ["old"]
    assert len(V.vacuum(spark, out, older_than_hours=24)) == 0 and len(V.vacuum(spark, out, older_than_hours=-1)) >= 1
    assert ids(spark, out) == ["old"] and len([f for f in os.listdir(out) if f.startswith("v-")]) == 1
    write_jsonl(row("new"), out)
    assert ids(spark, out) == ["new"]


def test_plain_folders_files_and_appending(spark, tmp_dir):
    out, uri = f"{tmp_dir}/records", f"file://{tmp_dir}/records"
    row = lambda i: spark.createDataFrame([(i,)], "incident_id string")
    row("plain").write.json(out)
    assert ids(spark, uri) == ["plain"]
    write_jsonl(R.read_jsonl(spark, out).select("incident_id").union(row("a")), uri)     # a plain folder, written over itself
    assert ids(spark, out) == ["a", "plain"]
    write_jsonl(row("b"), out, mode="append")
    assert ids(spark, out) == ["a", "b", "plain"]
    write_report(row("c"), out)
    assert ids(spark, out) == ["c"] and not [f for f in os.listdir(out) if f.startswith("part-")]
    with pytest.raises(ValueError, match="is a file"):
        write_jsonl(row("d"), jsonl(f"{tmp_dir}/f.jsonl", [{"incident_id": "x"}]))
    assert ids(spark, f"{tmp_dir}/f.jsonl") == ["x"]


def test_csv_rows_of_another_width_fail(spark, tmp_dir):
    path = f"{tmp_dir}/r.csv"
    with open(path, "w") as f:
        f.write("incident_id,incident_name,url,retrieved_date,notes\na,b\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_csv(spark, path).collect()


def test_row_positions_follow_the_lines(spark, tmp_dir):
    d = f"{tmp_dir}/d"
    os.makedirs(d)
    rng, want = random.Random(1), []
    for k in range(4):
        rows = [{"incident_id": f"{k}-{rng.randrange(50)}", "text": "x" * rng.randrange(200)} for _ in range(200)]
        jsonl(f"{d}/part-{k}.jsonl", rows)
        want += [r["incident_id"] for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")       # several blocks a file
    try:
        rec = R.read_jsonl(spark, d)
        assert rec.rdd.getNumPartitions() > 8
        got = S.row_positions(rec).select("incident_id", "position").collect()
        assert [r["incident_id"] for r in sorted(got, key=lambda r: r["position"])] == want
        assert sorted(r["position"] for r in got) == list(range(len(want)))
        split = S.head_split_by_position(rec, ["incident_id"], 0.8).collect()
        train = sorted((r["position"] for r in split if r["part"] == "train"))
        assert train == list(range(640)) and len(split) == 800
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n,frac,train", [(1, 0.8, 1), (5, 0.8, 4), (1, 0.0, 1)])
def test_head_split_of_few_rows(spark, tmp_dir, n, frac, train):
    rec = R.read_jsonl(spark, jsonl(f"{tmp_dir}/r.jsonl", [{"incident_id": "same"}] * n))
    got = S.head_split_by_position(rec, ["incident_id"], frac).collect()
    assert sum(r["part"] == "train" for r in got) == train
    assert [r["position"] for r in got if r["part"] == "eval"] == ([0] if n == 1 else [4])


def test_head_split_job(spark, tmp_dir):
    data = jsonl(f"{tmp_dir}/r.jsonl", [{"incident_id": f"r{i % 3}", "text": "" if i == 1 else "t", "labels": {"cause": ["unknown"]}} for i in range(6)])
    J.head_split_job(spark, data, f"{tmp_dir}/s", 0.6)
    got = sorted((r["position"], r["part"]) for r in R.read_jsonl(spark, f"{tmp_dir}/s/ids", "position long, part string").collect())
    assert got == [(0, "train"), (2, "train"), (3, "train"), (4, "eval"), (5, "eval")]


def test_repeated_ids_on_the_cut(spark):
    rows = [("a", "2024-01-01")] * 4 + [("b", "2024-01-02")] * 3 + [("c", None)] * 2
    df = spark.createDataFrame(rows, "id string, date string").repartition(3)
    for size, test in ((0.2, 1), (0.5, 4), (0.9, 6)):
        split, how = S.time_split(df, "id", "date", size)
        got = sorted((r["id"], r["part"]) for r in split.collect())
        b = min(3, test)
        assert how == "time" and got == sorted([("b", "test")] * b + [("b", "train")] * (3 - b) + [("a", "test")] * (test - b)
                                               + [("a", "train")] * (4 - test + b) + [("c", "train")] * 2)
    assert sum(r["part"] == "test" for r in S.hash_split(df, "id", 0.5).collect()) == 4
    head = S.head_split(df.withColumn("o", F.lit(1)), "id", "o", 0.5).collect()
    assert sum(r["part"] == "train" for r in head) == 4 and len(head) == 9


def test_evidence_of_another_taxonomy(spark, tmp_dir):
    with open(f"{tmp_dir}/tax.json", "w") as f:
        json.dump({"labels": {"topic": ["a", "b"]}}, f)
    gold = jsonl(f"{tmp_dir}/g.jsonl", [{"incident_id": "r", "text": "One. Two.", "evidence_gold": {"topic": {"a": [0], "b": [1]}}}])
    pred = jsonl(f"{tmp_dir}/p.jsonl", [{"incident_id": "r", "evidence": {"topic": {"a": ["One."], "b": ["0"]}}}])
    m = {r["scope"]: r for r in J.evidence_eval_job(spark, gold, pred, f"{tmp_dir}/e", schema_path=f"{tmp_dir}/tax.json").collect()}
    assert m["topic"]["n_items"] == 2 and m["overall"]["n_items"] == 2
    assert J.evidence_eval_job(spark, gold, pred, f"{tmp_dir}/e").where("scope = 'overall'").first()["n_items"] == 0
