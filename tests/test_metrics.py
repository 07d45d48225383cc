import random

from textcards.operators.lexicon import lexicon_table, taxonomy_table
from textcards.operators.metrics import flat_gold_eval, label_metrics, restrict_ids

TAX = {"a": ["x", "y", "z"], "b": ["p"]}


def brute(gold, pred, gold_ids, pred_ids, tax):
    """Fixed-label-list multi-label metrics with zero_division=0 (oracle)."""
    pairs = [i for i in gold_ids if i in pred_ids]
    out_label, out_field = {}, {}
    for field, labels in tax.items():
        tps = fps = fns = 0
        f1s = []
        for lab in labels:
            tp = sum(1 for i in pairs if lab in gold.get(i, {}).get(field, []) and lab in pred.get(i, {}).get(field, []))
            fp = sum(1 for i in pairs if lab not in gold.get(i, {}).get(field, []) and lab in pred.get(i, {}).get(field, []))
            fn = sum(1 for i in pairs if lab in gold.get(i, {}).get(field, []) and lab not in pred.get(i, {}).get(field, []))
            f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
            out_label[(field, lab)] = (tp, fp, fn, f1)
            tps, fps, fns = tps + tp, fps + fp, fns + fn
            f1s.append(f1)
        if pairs:
            out_field[field] = (tps / (tps + fps) if tps + fps else 0.0,
                                tps / (tps + fns) if tps + fns else 0.0,
                                2 * tps / (2 * tps + fps + fns) if (2 * tps + fps + fns) else 0.0,
                                sum(f1s) / len(f1s))
    return out_label, out_field


def rounded(d):
    return {k: tuple(round(x, 12) for x in v) for k, v in d.items()}


def to_long(spark, d):
    rows = [(i, f, l) for i, fm in d.items() for f, ls in fm.items() for l in ls]
    return spark.createDataFrame(rows, "id string, field string, label string")


def ids_df(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def run(spark, gold, pred, gold_ids, pred_ids):
    pl, pf = label_metrics(to_long(spark, gold), to_long(spark, pred), ids_df(spark, gold_ids),
                           ids_df(spark, pred_ids), taxonomy_table(spark, TAX), "id")
    lab = {(r["field"], r["label"]): (r["tp"], r["fp"], r["fn"], r["f1"]) for r in pl.collect()}
    fld = {r["field"]: (r["micro_precision"], r["micro_recall"], r["micro_f1"], r["macro_f1"])
           for r in pf.collect()}
    return lab, fld, pf


def test_hand_case(spark):
    gold = {"r1": {"a": ["x", "y", "y", "off"]}, "r2": {}, "r3": {"a": ["z"]}}
    pred = {"r1": {"a": ["x", "z"]}, "r2": {"a": ["x"]}, "r9": {"a": ["y"]}}
    gold_ids, pred_ids = ["r1", "r2", "r3"], ["r1", "r2", "r9"]
    lab, fld, pf = run(spark, gold, pred, gold_ids, pred_ids)
    want_lab, want_fld = brute(gold, pred, gold_ids, pred_ids, TAX)
    assert rounded(lab) == rounded(want_lab) and rounded(fld) == rounded(want_fld)
    assert lab[("a", "x")][:3] == (1, 1, 0)          # unlabelled r2 counts as all-negative
    assert lab[("b", "p")] == (0, 0, 0, 0.0)          # zero support, in macro as 0
    r = pf.where("field = 'a'").first()
    assert (r["n"], r["n_scored"]) == (3, 2)          # r3 is gold but unscored


def test_no_pairs_leaves_fields_out(spark):
    _, fld, _ = run(spark, {"r1": {"a": ["x"]}}, {"r2": {"a": ["x"]}}, ["r1"], ["r2"])
    assert fld == {}


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    labels = {"a": ["x", "y", "z", "w"], "b": ["p", "q"]}
    gold, pred = {}, {}
    for i in range(60):
        gold[f"r{i}"] = {f: rnd.sample(ls + ["zz"], rnd.randint(0, 2)) for f, ls in labels.items()}
        pred[f"r{i}"] = {f: rnd.sample(ls, rnd.randint(0, 2)) for f, ls in labels.items()}
    gold_ids = [f"r{i}" for i in range(50)]
    pred_ids = [f"r{i}" for i in range(10, 60)]
    lab, fld, _ = run(spark, gold, pred, gold_ids, pred_ids)
    want_lab, want_fld = brute(gold, pred, gold_ids, pred_ids, TAX)
    assert rounded(lab) == rounded(want_lab) and rounded(fld) == rounded(want_fld)


def test_restrict_ids_empty_split_modes(spark):
    df = ids_df(spark, ["a", "b"])
    empty = spark.createDataFrame([], "id string")
    assert restrict_ids(df, None, "id").count() == 2
    assert restrict_ids(df, empty, "id", "all").count() == 2
    assert restrict_ids(df, empty, "id", "none").count() == 0
    assert restrict_ids(df, ids_df(spark, ["b"]), "id").count() == 1


def test_flat_gold_smoke_rows(spark):
    """One scored row and one skipped row: total 1, correct 1, skipped 1."""
    lex = lexicon_table(spark, {"subsystem": {"engine": ["engine"], "pad": ["pad"]},
                                "failure_mode": {"fire": ["fire"], "leak": ["leak"]}})
    rows = spark.createDataFrame(
        [("i1", "The engine caught fire near the pad.", " engine ", "fire"),
         ("i2", "Nothing here.", "TBD", "fire"),
         ("i3", "A leak.", "pad", "leak")],
        "id string, text string, subsystem_label string, incident_type_label string")
    fm = {"subsystem": ("subsystem_label", "subsystem"),
          "incident_type": ("incident_type_label", "failure_mode")}
    acc, conf = flat_gold_eval(rows, lex, fm, "id", "text")
    a = {r["field"]: (r["correct"], r["total"], r["skipped"]) for r in acc.collect()}
    assert a == {"subsystem": (1, 2, 1), "incident_type": (2, 2, 1)}
    c = sorted((r["field"], r["gold"], r["pred"], r["n"]) for r in conf.collect())
    # top-1 is the first label in lexicon order, "none" when nothing hit
    assert c == [("incident_type", "fire", "fire", 1), ("incident_type", "leak", "leak", 1),
                 ("subsystem", "engine", "engine", 1), ("subsystem", "pad", "none", 1)]
