"""

Gold and predicted label sets of the single test record are fixed values
(taxonomy labels); the expected numbers are the published ones.
"""

import pytest

from textcards import lexicons as LX
from textcards.operators.lexicon import taxonomy_table
from textcards.operators.metrics import label_metrics

GOLD = {
    "subsystem": ["heat_shield", "gnc", "communications", "software"],
    "failure_mode": ["loss_of_control", "comms_loss", "reentry_breakup"],
    "impact": ["vehicle_loss", "delay"],
    "cause": ["thermal_protection_failure", "control_authority_loss"],
}
LEXICON_PRED = {
    "subsystem": ["raptor_engine", "gnc", "heat_shield", "communications"],
    "failure_mode": ["loss_of_control", "comms_loss"],
    "impact": [],
    "cause": ["control_authority_loss", "thermal_protection_failure"],
}
TFIDF_PRED = {
    "subsystem": ["gnc", "ground_systems", "launch_pad", "range_safety", "raptor_engine"],
    "failure_mode": ["debris", "engine_shutdown", "fts_triggered", "loss_of_control", "pad_damage"],
    "impact": ["delay", "pad_damage", "vehicle_loss"],
    "cause": ["unknown"],
}
# (micro P, micro R, micro F1, macro F1) per field, as published
LEXICON_WANT = {"subsystem": (0.75, 0.75, 0.75, 0.2143), "failure_mode": (1.0, 0.6667, 0.8, 0.1818),
                "impact": (0.0, 0.0, 0.0, 0.0), "cause": (1.0, 1.0, 1.0, 0.2857)}
TFIDF_WANT = {"subsystem": (0.2, 0.25, 0.2222, 0.0714), "failure_mode": (0.2, 0.3333, 0.25, 0.0909),
              "impact": (0.6667, 1.0, 0.8, 0.4), "cause": (0.0, 0.0, 0.0, 0.0)}


def long(spark, rid, labels):
    return spark.createDataFrame([(rid, f, l) for f, ls in labels.items() for l in ls],
                                 "id string, field string, label string")


@pytest.mark.parametrize("pred,want", [(LEXICON_PRED, LEXICON_WANT), (TFIDF_PRED, TFIDF_WANT)])
def test_published_test_split_metrics(spark, pred, want):
    ids = spark.createDataFrame([("r3",)], "id string")
    _, per_field = label_metrics(long(spark, "r3", GOLD), long(spark, "r3", pred), ids, ids,
                                 taxonomy_table(spark, LX.INCIDENT_TAXONOMY), "id")
    got = {r["field"]: (r["micro_precision"], r["micro_recall"], r["micro_f1"], r["macro_f1"], r["n"])
           for r in per_field.collect()}
    assert set(got) == set(LX.INCIDENT_FIELDS)
    for field, vals in want.items():
        assert got[field][:4] == pytest.approx(vals, abs=5e-5), field
        assert got[field][4] == 1


LABELLED = [
    {"subsystem": ["raptor_engine", "gnc", "range_safety", "launch_pad", "ground_systems"],
     "failure_mode": ["engine_shutdown", "loss_of_control", "fts_triggered", "pad_damage", "debris"],
     "impact": ["vehicle_loss", "pad_damage", "delay"], "cause": ["unknown"]},
    {"subsystem": ["stage_separation", "raptor_engine", "propulsion", "communications"],
     "failure_mode": ["fire", "explosion", "comms_loss", "structural_failure"],
     "impact": ["vehicle_loss", "delay"], "cause": ["unknown"]},
    GOLD,
]


def test_published_dataset_profile(spark):
    from textcards.operators.stats import dataset_stats, label_distribution
    rows = [(f"r{i}", " ".join(["w"] * 43), labels) for i, labels in enumerate(LABELLED)]
    rows += [(f"t{i}", "", None) for i in range(37)]          # roster rows without text
    df = spark.createDataFrame(rows, "id string, text string, labels map<string,array<string>>")
    s = dataset_stats(df).first()
    assert (s["n_total"], s["n_with_text"], s["n_labeled"]) == (40, 3, 3)
    assert s["avg_length_tokens"] == 43.0 and s["avg_label_cardinality"] == 12.0
    dist = label_distribution(df).collect()
    per_field = {}
    for r in dist:
        per_field[r["field"]] = per_field.get(r["field"], 0) + 1
    assert per_field == {"subsystem": 10, "failure_mode": 10, "impact": 3, "cause": 3}


# The three demo narratives, the labels of the two training
# records, and the published predictions for the third.
NARRATIVES = {
    "r1": "During the first integrated flight test, multiple engines failed to ignite and the vehicle climbed with reduced "
          "thrust. Telemetry later indicated loss of attitude control. The flight termination system was activated, and "
          "debris impacted the launch pad area causing damage to nearby ground equipment.",
    "r2": "The booster completed the ascent phase and initiated a hot-staging separation. Shortly after separation, the "
          "booster experienced an anomaly with a rapid fire event in the engine section and was lost. The ship continued "
          "briefly, then lost telemetry and broke apart before reaching its planned trajectory.",
    "r3": "The ship reached space and completed a partial mission profile. During reentry, the vehicle began to tumble and "
          "lost control authority. Communications dropped and the vehicle broke up. Engineers suspected thermal protection "
          "issues and off-nominal attitude during peak heating.",
}
TRAIN_LABELS = {
    "r1": {"subsystem": ["raptor_engine", "gnc", "range_safety", "launch_pad", "ground_systems"],
           "failure_mode": ["engine_shutdown", "loss_of_control", "fts_triggered", "pad_damage", "debris"],
           "impact": ["vehicle_loss", "pad_damage", "delay"], "cause": ["unknown"]},
    "r2": {"subsystem": ["stage_separation", "raptor_engine", "propulsion", "communications"],
           "failure_mode": ["fire", "explosion", "comms_loss", "structural_failure"],
           "impact": ["vehicle_loss", "delay"], "cause": ["unknown"]},
}
LEXICON_CONFIDENCE = {"raptor_engine": 0.5, "gnc": 0.9000000000000001, "heat_shield": 0.5, "communications": 0.5,
                      "loss_of_control": 0.5, "comms_loss": 0.5, "control_authority_loss": 0.5, "thermal_protection_failure": 0.5}
LEXICON_EVIDENCE = {"raptor_engine": [3], "gnc": [1, 3], "heat_shield": [3], "communications": [2], "loss_of_control": [1],
                    "comms_loss": [2], "control_authority_loss": [1], "thermal_protection_failure": [3]}
TFIDF_CONFIDENCE = 0.5124190678285979
TFIDF_ALWAYS = {"raptor_engine", "vehicle_loss", "delay", "unknown"}
TFIDF_EVIDENCE = [1, 2, 0]


def test_published_lexicon_predictions(spark):
    from textcards.operators.lexicon import lexicon_predict, lexicon_table
    from textcards.sources.sinks import assemble_records
    docs = spark.createDataFrame([("r3", NARRATIVES["r3"])], "id string, text string")
    p = lexicon_predict(docs, lexicon_table(spark, LX.INCIDENT_LEXICON), "id", "text",
                        taxonomy_table(spark, LX.INCIDENT_TAXONOMY), LX.INCIDENT_FIELDS)
    r = assemble_records(p, docs, LX.INCIDENT_FIELDS, "id").first()
    assert r["pred"] == LEXICON_PRED
    assert {k: v for f in r["confidence"].values() for k, v in f.items()} == LEXICON_CONFIDENCE
    assert {k: v for f in r["evidence"].values() for k, v in f.items()} == LEXICON_EVIDENCE


def test_published_tfidf_predictions(spark):
    from textcards.operators.ovr import ovr_predict
    from textcards.sources.sinks import assemble_records
    docs = lambda *ids: spark.createDataFrame([(i, NARRATIVES[i]) for i in ids], "id string, text string")
    gold = spark.createDataFrame([(i, f, l) for i, x in TRAIN_LABELS.items() for f, ls in x.items() for l in ls],
                                 "id string, field string, label string")
    preds, _ = ovr_predict(docs("r1", "r2"), docs("r3"), gold, taxonomy_table(spark, LX.INCIDENT_TAXONOMY), LX.INCIDENT_FIELDS, "id")
    r = assemble_records(preds.withColumn("_o", preds["label"]), docs("r3"), LX.INCIDENT_FIELDS, "id", label_order="_o").first()
    assert {f: sorted(v) for f, v in r["pred"].items()} == {f: sorted(v) for f, v in TFIDF_PRED.items()}
    assert all(v == sorted(v) for v in r["pred"].values())
    for f, found in r["confidence"].items():
        for label, c in found.items():
            assert c == (1.0 if label in TFIDF_ALWAYS else pytest.approx(TFIDF_CONFIDENCE, abs=1e-5))
            assert r["evidence"][f][label] == TFIDF_EVIDENCE
