import math
from collections import Counter

import pytest

from tests.test_text import py_sentences
from textcards.operators import tfidf as T
from textcards.operators.lexicon import taxonomy_table
from textcards.operators.ovr import label_states, ovr_predict

CORPUS = [
    "The ship reached orbit. The engine shut down early! Telemetry was lost.",
    "Engine fire on the pad. The tower was damaged.",
    "Orbit reached. Reentry heating damaged the tiles and the flaps.",
    "The the the. Nothing else.",
]


def py_terms(text):
    import re
    toks = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def py_vocab(texts, max_df=0.95):
    n = len(texts)
    df = Counter(t for x in texts for t in set(py_terms(x)))
    return {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d <= max_df * n}


def docs(spark, texts=CORPUS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_vocabulary_matches_brute_force(spark):
    v = {r["term"]: r["idf"] for r in T.fit_vocabulary(docs(spark), max_df=0.7).collect()}
    want = py_vocab(CORPUS, 0.7)
    assert v.keys() == want.keys() and "the" not in v          # the: in 4/4 > 0.7*4
    assert all(v[k] == pytest.approx(want[k], abs=1e-12) for k in v)


def test_sentence_ranking_matches_brute_force(spark):
    vocab = T.fit_vocabulary(docs(spark))
    idf = py_vocab(CORPUS)
    got = {(r["doc_id"], r["rank"]): (r["sent_idx"], r["score"])
           for r in T.top_sentences(docs(spark), vocab, "doc_id", "text", 3).collect()}
    for d, text in enumerate(CORPUS):
        scores = []
        for i, s in enumerate(py_sentences(text)):
            tf = Counter(t for t in py_terms(s) if t in idf)
            w = [c * idf[t] for t, c in tf.items()]
            if w:
                sc = sum(w) / math.sqrt(sum(x * x for x in w))
                if sc > 0:
                    scores.append((round(sc, 9), i, sc))
        scores.sort(key=lambda x: (-x[0], -x[1]))
        for rank, (_, i, sc) in enumerate(scores[:3], 1):
            assert got[(d, rank)][0] == i and got[(d, rank)][1] == pytest.approx(sc, abs=1e-12)


def test_tfidf_vectors_unit_norm(spark):
    vocab = T.fit_vocabulary(docs(spark))
    v = T.tfidf_vectors(docs(spark), vocab, "doc_id", "text")
    norms = {}
    for r in v.collect():
        norms[r["doc_id"]] = norms.get(r["doc_id"], 0.0) + r["weight"] ** 2
    assert all(x == pytest.approx(1.0) for x in norms.values())


GOLD_TAX = {"sub": ["engine", "pad", "orbit", "never"]}


def gold_df(spark):
    rows = [(0, "sub", "engine"), (0, "sub", "orbit"), (0, "sub", "orbit"), (1, "sub", "engine"),
            (1, "sub", "pad"), (2, "sub", "orbit"), (2, "sub", "engine"), (3, "sub", "engine"),
            (3, "sub", "off_taxonomy")]
    return spark.createDataFrame(rows, "id int, field string, label string")


def test_label_states(spark):
    ids = spark.createDataFrame([(i,) for i in range(4)], "id int")
    st = {r["label"]: (r["count"], r["state"]) for r in
          label_states(gold_df(spark), ids, taxonomy_table(spark, GOLD_TAX), "id").collect()}
    assert st == {"engine": (4, "always"), "pad": (1, "active"), "orbit": (2, "active"),
                  "never": (0, "never")}


def test_ovr_predict_shapes(spark):
    d = docs(spark).withColumnRenamed("doc_id", "id")
    preds, states = ovr_predict(d, d, gold_df(spark), taxonomy_table(spark, GOLD_TAX), ["sub"],
                                "id", max_iter=200)
    rows = preds.collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], {})[r["label"]] = r["confidence"]
    # always-on label on every test record at 1.0; never-seen label never predicted
    assert all(v.get("engine") == 1.0 for v in by.values()) and len(by) == 4
    assert not any("never" in v for v in by.values())
    assert all(0.5 <= c <= 1.0 for v in by.values() for c in v.values())
    ev = {r["id"]: list(r["evidence"]) for r in rows}
    assert all(len(e) <= 3 for e in ev.values())


def newton_lr(X, y, iters=50):
    """argmin sum(logloss) + 0.5*|w|^2 (intercept unpenalised), by Newton."""
    import numpy as np
    Xb = np.hstack([X, np.ones((X.shape[0], 1))])
    w = np.zeros(Xb.shape[1])
    reg = np.eye(Xb.shape[1])
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + reg @ w
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_ovr_probability_matches_newton(spark):
    import numpy as np
    train = CORPUS[:3]
    idf = py_vocab(train)
    terms = sorted(idf)

    def vec(text):
        tf = Counter(t for t in py_terms(text) if t in idf)
        v = np.array([tf.get(t, 0) * idf[t] for t in terms])
        n = np.linalg.norm(v)
        return v / n if n else v

    X = np.array([vec(t) for t in train])
    y = np.array([1.0, 0.0, 1.0])                       # "orbit" on docs 0 and 2
    w = newton_lr(X, y)
    test_text = CORPUS[3] + " Orbit reached again."
    want = 1 / (1 + np.exp(-(np.append(vec(test_text), 1.0) @ w)))
    tr = spark.createDataFrame(list(enumerate(train)), "id int, text string")
    te = spark.createDataFrame([(9, test_text)], "id int, text string")
    gold = spark.createDataFrame([(0, "sub", "orbit"), (2, "sub", "orbit"), (1, "sub", "pad")],
                                 "id int, field string, label string")
    tax = taxonomy_table(spark, {"sub": ["orbit", "pad"]})
    # tight tolerance: the distributed L-BFGS reaches the optimum
    preds, _ = ovr_predict(tr, te, gold, tax, ["sub"], "id", threshold=0.0, tol=1e-9)
    got = {r["label"]: r["confidence"] for r in preds.collect()}
    assert got["orbit"] == pytest.approx(want, abs=1e-6)
    # default: the reference learner's gradient tolerance (1e-4)
    preds, _ = ovr_predict(tr, te, gold, tax, ["sub"], "id", threshold=0.0)
    got = {r["label"]: r["confidence"] for r in preds.collect()}
    assert got["orbit"] == pytest.approx(want, abs=1e-3)


def test_fit_does_not_depend_on_tasks_and_blocks(spark, monkeypatch):
    import numpy as np
    from textcards.operators import logreg as LR
    rng = np.random.default_rng(0)
    rows, x = [], np.zeros((200, 50))
    for i in range(200):
        for j in rng.choice(50, size=5, replace=False):
            x[i, j] = rng.random()
            rows.append((i, f"t{j:02d}", float(x[i, j])))
    y = np.column_stack([np.arange(200) % 3 == 0, x[:, 0] > 0]).astype(float)
    df = spark.createDataFrame(rows, "row int, term string, weight double")
    fits = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    for tasks, entries in ((1, 2_000_000), (7, 40)):
        monkeypatch.setattr(LR, "BLOCK_ENTRIES", entries)
        blocks = df.repartition(tasks, "term").sortWithinPartitions("term", "row").mapInArrow(
            LR.pack_columns, "rows binary, vals binary, starts binary").cache()
        assert tasks == 1 or blocks.count() > 7
        fits.append(LR.fit_labels(blocks, y, tol=1e-9))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (a, b), (c, d) = fits
    assert np.allclose(x.T @ a, x.T @ c, atol=1e-6) and np.allclose(b, d, atol=1e-6)
    for k in range(2):          # the optimum, by Newton
        w = newton_lr(x, y[:, k])
        assert np.allclose(x.T @ a[:, k], w[:-1], atol=1e-4) and abs(b[k] - w[-1]) < 1e-4


def test_bounded_training_sample(spark):
    from textcards.operators.logreg import sample_rows
    ids = spark.range(100).withColumnRenamed("id", "k")
    few = sample_rows(ids, "k", 10).collect()
    assert sorted(r["row"] for r in few) == list(range(10)) and len({r["k"] for r in few}) == 10
    assert sample_rows(ids, "k", 1000).count() == 100


def test_stored_model_predicts_the_same(spark, tmp_dir):
    """Fit, store and predict in separate steps; then another model over the first."""
    from textcards.operators import ovr_model as M
    from textcards.operators.lexicon import taxonomy_table
    from textcards.operators.ovr import label_states, ovr_predict
    words = ["engine fire", "tank leak", "pad wind", "engine leak", "wind fire"]
    train = spark.createDataFrame([(i, f"{words[i % 5]} number{i}. {words[i % 3]} again.") for i in range(30)], "id int, text string")
    test = spark.createDataFrame([(100, "engine fire."), (101, "wind on the pad. leak."), (102, ""), (103, None)], "id int, text string")
    gold = spark.createDataFrame([(i, "f", "burn") for i in range(30) if "fire" in words[i % 5]] + [(i, "f", "all") for i in range(30)]
                                 + [(i, "f", "leak") for i in range(30) if "leak" in words[i % 5]], "id int, field string, label string")
    tax = taxonomy_table(spark, {"f": ["burn", "leak", "all", "none"]})
    want, _ = ovr_predict(train, test, gold, tax, ["f"], "id")
    rows = label_states(gold, train.select("id"), tax, "id").collect()
    fitted = M.fit_tables(train, gold, rows, "id", "text")
    path = f"{tmp_dir}/model"
    M.save_model(fitted, path)
    loaded = M.load_model(spark, path)
    assert loaded.labels == [("f", "burn"), ("f", "leak")] and loaded.always == [("f", "all")]
    got = M.predict(loaded, test, "id", "text")
    key = lambda df: sorted((r["id"], r["label"], round(r["confidence"], 9), tuple(r["evidence"])) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) > 4
    M.save_model(M.ModelTables(fitted.vocab, None, [], [], [("f", "all")]), path)      # no active label
    assert {(r["label"], r["confidence"]) for r in M.predict(M.load_model(spark, path), test, "id", "text").collect()} == {("all", 1.0)}
    assert key(M.predict(loaded, test, "id", "text")) == key(want)                     # the version before is still there


def test_fit_and_score_jobs(spark, tmp_dir):
    import json
    from textcards.plans import jobs as J
    data = f"{tmp_dir}/r.jsonl"
    with open(data, "w") as f:
        for i in range(12):
            f.write(json.dumps({"incident_id": f"r{i:02}", "date": f"2024-01-{i + 1:02}", "text": ("A fire. " if i % 2 else "A leak. ") + "Pad wind.",
                                "labels": {"failure_mode": ["fire"] if i % 2 else ["leak"], "cause": ["unknown"]}}) + "\n")
    J.split_job(spark, data, f"{tmp_dir}/split")
    whole = J.tfidf_predict_job(spark, f"{tmp_dir}/a", data=data, split=f"{tmp_dir}/split").collect()
    J.tfidf_fit_job(spark, data, f"{tmp_dir}/model", split=f"{tmp_dir}/split")
    parts = J.tfidf_score_job(spark, data, f"{tmp_dir}/model", f"{tmp_dir}/b", split=f"{tmp_dir}/split").collect()
    flat = lambda rows: sorted((r["incident_id"], str(r["pred"]), str(r["evidence"])) for r in rows)
    assert flat(parts) == flat(whole) and len(parts) == 2


def test_terms_leave_a_chunk_once():
    """A term in every record of a chunk is one row of it; chunks are cut within a batch."""
    import pyarrow as pa
    from textcards.operators import term_blocks as B
    words = ["hot pad x fire", "hot pad", "", "hot hot hot", "größe hot"]
    batch = pa.RecordBatch.from_arrays([pa.array(words)], names=["words"])
    got = [(t, n) for b in B.chunk_terms([batch, batch]) for t, n in zip(b["term"].to_pylist(), b["n"].to_pylist())]
    assert sorted(got) == sorted([("hot", 8), ("pad", 4), ("fire", 2), ("größe", 2), ("hot pad", 4), ("hot hot", 2),
                                  ("pad fire", 2), ("größe hot", 2)])


def test_blocks_and_repeated_ids_match_brute_force(spark, monkeypatch):
    """Many small blocks and chunks; rows that share an id (or have none) are one record."""
    from textcards.operators import term_blocks as B
    monkeypatch.setattr(B, "BLOCK_CHARS", 60)
    monkeypatch.setattr(T, "MAX_BROADCAST_VOCAB", 3)
    texts = [f"{CORPUS[i % 4]} number{i % 5} again." for i in range(12)] + [None, "", "a b c."]
    ids = [None if i in (3, 7) else i // 2 if i < 4 else i for i in range(len(texts))]
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    idf = py_vocab([t or "" for t in texts])
    vocab = T.fit_vocabulary(d)
    assert {r["term"]: pytest.approx(r["idf"]) for r in vocab.collect()} == idf
    want, lines = {}, {}
    for i, t in zip(ids, texts):
        want.setdefault(i, Counter()).update(x for x in py_terms(t or "") if x in idf)
        for k, s in enumerate(py_sentences(t or "")):
            lines.setdefault((i, k), Counter()).update(x for x in py_terms(s) if x in idf)
    got = {(r["doc_id"], r["term"]): (r["tf"], r["weight"]) for r in T.tfidf_vectors(d, vocab).collect()}
    assert len(got) == sum(map(len, want.values()))
    for i, tf in want.items():
        norm = math.sqrt(sum((n * idf[x]) ** 2 for x, n in tf.items()))
        assert all(got[i, x] == (n, pytest.approx(n * idf[x] / norm)) for x, n in tf.items())
    scores = {(r["doc_id"], r["sent_idx"]): r["score"] for r in T.sentence_scores(d, vocab).collect()}
    assert scores == {k: pytest.approx(sum(n * idf[x] for x, n in tf.items()) / math.sqrt(sum((n * idf[x]) ** 2 for x, n in tf.items())))
                      for k, tf in lines.items() if tf}


def test_fit_takes_every_record(spark):
    """More records than the old sample's 20,000: counts, and the optimum of all of them."""
    import numpy as np
    from textcards.operators.common import stored_by
    from textcards.operators.ovr import fit_ovr, optimality
    n, words = 20_050, ["alpha", "beta", "gamma", "delta", "omega"]
    kinds = [f"{words[i % 5]} {words[i // 5 % 5]}." for i in range(25)]
    of, hot = [i * 7 % 25 for i in range(n)], [i % 3 == 0 or i % 25 in (7, 14) for i in range(n)]
    train = spark.createDataFrame([(i, kinds[k]) for i, k in enumerate(of)], "id int, text string")
    gold = spark.createDataFrame([(i, "f", "hot") for i in range(n) if hot[i]], "id int, field string, label string")
    vocab = stored_by(T.fit_vocabulary(train), "term")
    model = fit_ovr(train, gold, [("f", "hot")], vocab, tol=1e-7)
    (row,) = optimality(model).collect()
    assert (row["n"], row["positives"]) == (n, sum(hot)) and row["max_grad"] <= 1e-6
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    terms = sorted(idf)
    x = np.zeros((25, len(terms) + 1))
    for k, t in enumerate(kinds):
        for a, c in Counter(py_terms(t)).items():
            x[k, terms.index(a)] = c * idf[a]
        x[k] /= np.linalg.norm(x[k])
    x[:, -1] = 1.0
    total, ones = np.bincount(of, minlength=25), np.bincount(of, weights=hot, minlength=25)
    w, reg = np.zeros(len(terms) + 1), np.append(np.ones(len(terms)), 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (total * p * (1 - p))[:, None]) + np.diag(reg), x.T @ (total * p - ones) + reg * w)
    got = {r["term"]: r["c0"] for r in model.coef.collect()}
    assert got.keys() == set(terms) and max(abs(got[t] - w[i]) for i, t in enumerate(terms)) < 1e-2
    assert model.intercepts[0] == pytest.approx(w[-1], abs=1e-2)


def test_fit_in_ranges_of_rows(spark, monkeypatch):
    """Vectors of many ranges, mapped from files: the same fit as with one range."""
    from textcards.operators import row_vectors as V
    from textcards.operators.ovr import ovr_predict
    words = ["engine fire", "tank leak", "pad wind", "engine leak", "wind fire"]
    train = spark.createDataFrame([(None if i == 9 else i // 2 if i < 4 else i, f"{words[i % 5]} number{i}. {words[i % 3]} again.")
                                   for i in range(40)], "id int, text string")
    test = spark.createDataFrame([(100, "engine fire."), (101, "wind on the pad. leak."), (102, None)], "id int, text string")
    gold = spark.createDataFrame([(i, "f", lab) for i in range(40) for lab in ("burn", "leak", "wind") if (i * 7 + len(lab)) % 3],
                                 "id int, field string, label string")
    tax = taxonomy_table(spark, {"f": ["burn", "leak", "wind"]})
    key = lambda: sorted((r["id"], r["label"], pytest.approx(r["confidence"], abs=1e-9)) for r in ovr_predict(      # noqa: E731
        train, test, gold, tax, ["f"], "id", threshold=0.0)[0].collect())
    want = key()
    monkeypatch.setattr(V, "RANGE_VALUES", 20)
    monkeypatch.setattr(V, "IN_MEMORY", 10)
    assert key() == want and len(want) == 9


def test_known_terms_are_read_from_files(spark, tmp_dir):
    """Vectors and predictions read what the vocabulary knows of their blocks, and the
    margins, from written tables: the joins' shuffles are not held beside theirs."""
    from textcards.operators import ovr_model as M
    d = docs(spark)
    vocab = T.fit_vocabulary(d).cache()
    plan = T.tfidf_vectors(d, vocab)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    coef = vocab.select("term", "heavy", (vocab.df * 0.5).alias("c0"))
    model = M.ModelTables(vocab, coef, [("f", "a")], [0.1], [])
    plan = M.predict(model, d, "doc_id", "text", 0.0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" not in plan
