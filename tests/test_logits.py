import numpy as np

from textcards.functions.labels import multi_hot, sigmoid32
from textcards.operators.lexicon import taxonomy_table
from textcards.operators.logits import epsilon_micro_f1, logit_labels


def test_sigmoid32_matches_numpy_float32(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 3, 500), [0.0, -1e-9, 1e-9, -1e-7, 30.0, -30.0]]).astype(np.float32)
    df = spark.createDataFrame([(float(x),) for x in xs], "x float")
    got = np.array([r["p"] for r in df.select(sigmoid32("x").alias("p")).collect()], dtype=np.float32)
    want = (np.float32(1) / (np.float32(1) + np.exp(-xs))).astype(np.float32)
    # numpy's float32 exp is a SIMD approximation; Spark rounds a double exp
    # once, so the two differ by a few ulp at most ...
    ulp = np.abs(got.view(np.int32).astype(np.int64) - want.view(np.int32).astype(np.int64))
    assert ulp.max() <= 4
    # ... and never in the decision that matters
    assert (got >= 0.5).tolist() == (want >= 0.5).tolist()
    # a logit of -1e-9 is exactly 0.5 in float32, so it is picked
    assert got[-5] == np.float32(0.5)


def test_logit_labels_and_epsilon_f1(spark):
    tax = taxonomy_table(spark, {"t": ["a", "b", "c"]})
    rows = [(1, [0.2, -0.1, 0.0, 9.0]), (2, [-1.0, 2.0, -3.0, 9.0])]
    lg = spark.createDataFrame(rows, "id int, logits array<float>")
    got = sorted((r["id"], r["label"]) for r in logit_labels(lg, tax, "id", "logits").collect())
    assert got == [(1, "a"), (1, "c"), (2, "b")]                  # extra logits ignored
    gold = spark.createDataFrame([(1, [1, 0, 0]), (2, [0, 0, 1])], "id int, gold array<int>")
    m = epsilon_micro_f1(lg.selectExpr("id", "slice(logits, 1, 3) AS logits"), gold, "id").first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 1)
    p, r = 1 / (3 + 1e-9), 1 / (2 + 1e-9)
    assert abs(m["micro_f1"] - 2 * p * r / (p + r + 1e-9)) < 1e-12
    mh = spark.createDataFrame([(["a", "b", "c"], ["c", "x", "c"])], "ll array<string>, l array<string>")
    assert mh.select(multi_hot("ll", "l").alias("m")).first()["m"] == [0, 0, 1]
