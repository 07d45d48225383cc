import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textcards.operators import splits as S


def test_test_count_half_even():
    assert S.test_count(3, 0.2) == 1          # round(0.6) = 1
    assert S.test_count(1, 0.2) == 1          # max(1, 0)
    assert S.test_count(25, 0.1) == 2         # round(2.5) = 2 (half-even)
    assert S.test_count(35, 0.1) == 4         # round(3.5) = 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.integers(0, 70),
       st.booleans())
def test_extreme_n_matches_sort(spark, dates, n, largest):
    rows = [(d, i) for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, "d long, i long")
    got = sorted(tuple(r) for r in df.where(S.extreme_n(df, ["d", "i"], n, largest)).collect())
    want = sorted(sorted(rows, reverse=largest)[:max(0, n)])
    assert got == want


def test_extreme_n_wide_range_and_hot_value(spark):
    rnd = random.Random(3)
    # one value holds a third of the rows; the rest spread over a 2^60 range
    rows = [(7, i) for i in range(300)] + [(rnd.randint(-2**60, 2**60), 1000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "d long, i long")
    for n in (1, 250, 299, 450, 899):
        got = sorted(tuple(r) for r in df.where(S.extreme_n(df, ["d", "i"], n)).collect())
        assert got == sorted(sorted(rows, reverse=True)[:n])


def test_time_split_ties_undated_and_fallback(spark):
    recs = spark.createDataFrame(
        [("a", "2023-01-01"), ("b", "2023-05-01"), ("c", "2023-05-01"), ("d", None),
         ("e", "2023-13-40"), ("f", "2022-4-2")], "id string, date string")
    split, strategy = S.time_split(recs, "id", "date", 0.4)
    parts = {r["id"]: r["part"] for r in split.collect()}
    assert strategy == "time"
    # 4 dated -> round(1.6) = 2 test: both 2023-05-01 rows
    assert parts == {"a": "train", "b": "test", "c": "test", "d": "train", "e": "train",
                     "f": "train"}
    undated = spark.createDataFrame([("x", None), ("y", ""), ("z", "bad")], "id string, date string")
    split, strategy = S.time_split(undated, "id", "date", 0.2, seed=13)
    assert strategy == "random"
    assert sorted(r["part"] for r in split.collect()) == ["test", "train", "train"]


def test_hash_split_deterministic(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("id"))
    a = {r["id"]: r["part"] for r in S.hash_split(ids, "id", 0.2, 13).collect()}
    b = {r["id"]: r["part"] for r in S.hash_split(ids.repartition(7), "id", 0.2, 13).collect()}
    assert a == b and sum(v == "test" for v in a.values()) == 40


def test_head_split(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "id long, ord long")
    parts = {r["id"]: r["part"] for r in S.head_split(df, "id", "ord", 0.8).collect()}
    assert [parts[i] for i in range(10)] == ["train"] * 8 + ["eval"] * 2
    one = spark.createDataFrame([(5, 1)], "id long, ord long")
    assert sorted(r["part"] for r in S.head_split(one, "id", "ord").collect()) == ["eval", "train"]


def test_source_split(spark):
    df = spark.createDataFrame([(1, "news"), (2, "official"), (3, "community")],
                               "id long, source string")
    got = {r["id"]: r["part"] for r in S.source_split(df, "id", "source", ["news"],
                                                       ["official"]).collect()}
    assert got == {1: "train", 2: "test"}
