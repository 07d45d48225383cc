"""End-to-end: the composite jobs chained over files (like the reference's smoke run)."""

import json
import os

from tests.test_text import py_normalize
from textcards.plans import jobs as J
from textcards.sources.versioned import resolve

TEXTS = {
    "rec-2023-02-01": "Engines failed to ignite during ascent. The vehicle began to tumble and "
                      "the flight termination system was activated. Debris fell near the pad.",
    "rec-2023-06-15": "A propellant leak caused a fire in the engine bay. The booster was lost "
                      "after separation.",
    "rec-2024-01-10": "Thermal protection tiles were lost during reentry. Telemetry dropped and "
                      "the ship broke up. The cause remains unclear.",
}
LABELS = {
    "rec-2023-02-01": {"subsystem": ["raptor_engine", "gnc", "range_safety"],
                       "failure_mode": ["engine_shutdown", "loss_of_control", "fts_triggered"],
                       "impact": ["vehicle_loss"], "cause": ["unknown"]},
    "rec-2023-06-15": {"subsystem": ["propulsion", "raptor_engine"], "failure_mode": ["leak", "fire"],
                       "impact": ["vehicle_loss", "delay"], "cause": ["propellant_leak"]},
    "rec-2024-01-10": {"subsystem": ["heat_shield", "communications"],
                       "failure_mode": ["comms_loss", "reentry_breakup"],
                       "impact": ["vehicle_loss"], "cause": ["thermal_protection_failure", "unknown"]},
}


def files(spark, d):
    return [f for f in os.listdir(resolve(spark, d)) if f.startswith("part-")]


def test_pipeline(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    for k, t in TEXTS.items():
        with open(os.path.join(raw, f"{k}.txt"), "w") as f:
            f.write(t + "\n")
    roster = os.path.join(tmp_dir, "roster.csv")
    with open(roster, "w") as f:
        f.write("incident_id,incident_name,url,retrieved_date,notes\n")
        for k in TEXTS:
            f.write(f'{k},"Record {k}",https://example.org/{k},2024-05-01,\n')
        f.write("tbd-001,,,,template\ntbd-002,,,,template\n")
    prev = os.path.join(tmp_dir, "prev.jsonl")
    with open(prev, "w") as f:
        for k, labs in LABELS.items():
            ev = {"failure_mode": {labs["failure_mode"][0]: [0]}}
            f.write(json.dumps({"incident_id": k, "labels": labs, "evidence_gold": ev}) + "\n")

    inc = os.path.join(tmp_dir, "incidents")
    rec = {r["incident_id"]: r for r in J.build_incidents_job(spark, roster, raw, inc, prev).collect()}
    assert len(rec) == 5 and rec["tbd-001"]["missing_text"] is True
    assert rec["rec-2024-01-10"]["date"] == "2024-01-10" and rec["rec-2023-02-01"]["labels"]

    split = os.path.join(tmp_dir, "split")
    parts = {r["incident_id"]: r["part"] for r in J.split_job(spark, inc, split).collect()}
    assert parts == {"rec-2023-02-01": "train", "rec-2023-06-15": "train", "rec-2024-01-10": "test"}

    kw = os.path.join(tmp_dir, "kw_preds")
    kp = J.lexicon_predict_job(spark, inc, kw, split=split).collect()
    assert [r["incident_id"] for r in kp] == ["rec-2024-01-10"]
    assert set(kp[0]["pred"]) == {"subsystem", "failure_mode", "impact", "cause"}
    assert "heat_shield" in kp[0]["pred"]["subsystem"]

    tf = os.path.join(tmp_dir, "tfidf_preds")
    tp = J.tfidf_predict_job(spark, tf, data=inc, split=split).collect()
    assert [r["incident_id"] for r in tp] == ["rec-2024-01-10"]
    # labels on both training records are always-on (confidence 1.0)
    assert tp[0]["confidence"]["impact"]["vehicle_loss"] == 1.0
    assert tp[0]["pred"]["subsystem"] == sorted(tp[0]["pred"]["subsystem"])

    for name, preds in (("kw", kw), ("tfidf", tf)):
        out = os.path.join(tmp_dir, f"metrics_{name}")
        _, per_field = J.evaluate_job(spark, inc, preds, out, split=split)
        got = {r["field"]: r for r in per_field.collect()}
        assert set(got) == {"subsystem", "failure_mode", "impact", "cause"}
        assert all(r["n"] == 1 and 0 <= r["micro_f1"] <= 1 for r in got.values())
        assert files(spark, os.path.join(out, "fields"))

    ev = {r["scope"]: r for r in J.evidence_eval_job(
        spark, inc, kw, os.path.join(tmp_dir, "evidence"), split=split).collect()}
    assert ev["overall"]["n_incidents"] == 1 and ev["overall"]["n_items"] == 1

    s, d = J.dataset_stats_job(spark, inc, os.path.join(tmp_dir, "stats"),
                               os.path.join(tmp_dir, "dist"))
    st = s.first()
    assert (st["n_total"], st["n_with_text"], st["n_labeled"]) == (5, 3, 3)
    assert st["avg_label_cardinality"] == (8 + 7 + 7) / 3

    flat = os.path.join(tmp_dir, "flat.csv")
    with open(flat, "w") as f:
        f.write("incident_id,text,subsystem_label,incident_type_label\n")
        f.write(f'a,"{TEXTS["rec-2023-06-15"]}",propulsion,leak\n')
        f.write("b,Nothing.,TBD,fire\n")
    acc, _ = J.flat_gold_eval_job(spark, flat, os.path.join(tmp_dir, "flat_out"))
    a = {r["field"]: (r["correct"], r["total"], r["skipped"]) for r in acc.collect()}
    assert a == {"subsystem": (1, 1, 1), "incident_type": (1, 1, 1)}


def test_cards_and_merge_jobs(spark, tmp_dir):
    data = os.path.join(tmp_dir, "recs.jsonl")
    with open(data, "w") as f:
        f.write(json.dumps({"incident_id": "r1", "text": TEXTS["rec-2023-06-15"],
                            "labels": {"cause": ["unknown"]}}) + "\n")
    c = {r["field"]: r["card"] for r in J.cards_job(spark, data, os.path.join(tmp_dir, "cards")).collect()}
    assert c["failure_mode"].startswith("leak (p=0.50)\n> A propellant leak") and c["impact"].startswith("vehicle_loss")
    ann = os.path.join(tmp_dir, "ann.jsonl")
    with open(ann, "w") as f:
        f.write(json.dumps({"incident_id": "r1", "field": "cause", "labels_raw": "propellant_leak, x",
                            "evidence_raw": {"propellant_leak": "0, 5"}}) + "\n")
    m = J.merge_annotations_job(spark, data, ann, os.path.join(tmp_dir, "merged")).first()
    assert m["labels"]["cause"] == ["propellant_leak"]
    assert m["evidence_gold"]["cause"] == {"propellant_leak": [0]}


def test_clean_and_pages_jobs(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "scraped.jsonl")
    with open(raw, "w") as f:
        f.write(json.dumps({"incident_id": "a", "source_url": "u", "source_type": "news",
                            "text": "  x\r\n\r\n\r\ny \t z " + "w" * 200}) + "\n")
        f.write(json.dumps({"incident_id": "b", "source_url": "u", "source_type": "news",
                            "text": "too short"}) + "\n")
        f.write(json.dumps({"incident_id": "c", "source_url": "u", "source_type": "news"}) + "\n")
    kept = J.clean_job(spark, raw, os.path.join(tmp_dir, "clean")).collect()
    assert [r["incident_id"] for r in kept] == ["a"]
    assert kept[0]["text"] == py_normalize("  x\r\n\r\n\r\ny \t z " + "w" * 200)
    assert kept[0]["text"].startswith("x\n\ny z w")         # each \r a newline, 3+ -> 2
    pages = spark.createDataFrame([(1, "http://p", "<p>One</p><script>x</script><p>Two &amp; 3</p>")],
                                  "page_id long, url string, html string")
    out = os.path.join(tmp_dir, "pages")
    J.extract_pages_job(spark, pages, out)
    J.extract_pages_job(spark, pages, out)                    # appended
    got = spark.read.json(out).collect()
    assert len(got) == 2 and got[0]["text"] == "One\nTwo & 3"
