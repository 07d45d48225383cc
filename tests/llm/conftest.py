import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, cluster string, k0 int, "
          "part string, rep string, key string, src string, tokens string, row string, copies int, spans int, wanted int")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, very short and very long texts, copies, near copies,
    repeated rows, one id with two texts, and shared passages."""
    rng = random.Random(7)
    base = prose(rng, 300)
    w = base.split()
    near = " ".join(w[:150] + ["changed"] + w[151:])
    passage = prose(rng, 70, 10_000)
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (None, None), (None, base), (5, ""), (6, " \n\t "),
            (7, "one"), (8, "One"), (9, "two words"), (10, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40)),
            (11, passage + "\n" + prose(rng, 30)), (12, "é" * 150 + passage + "ü" * 20), (13, "a" * 1000), (14, "ab " * 500),
            (15, prose(rng, 60_000, 5_000)), (16, prose(rng, 20)), (16, prose(rng, 25)), (-5, near + " tail"),
            (17, "Released under the MIT License.\n" + prose(rng, 30)), (18, "%%% $$$ &&& " * 40)]
    rows += [(100 + i, prose(rng, rng.randrange(1, 200))) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with the columns of documents and columns named like the operators' own."""
    full = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 4}", len(t or ""), 9.0, "c", 1, "p", "r", "k",
             "s", "t", "o", 3, 4, 5) for k, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def stored(spark, edge_docs, tmp_path_factory):
    """The edge rows as a table of files, in several partitions."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    edge_docs.repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)
