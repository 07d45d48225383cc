"""Operators 1, 2, 3, 6, 8, 9 and the pipeline."""

import base64
import hashlib
import math
import os
import random
import zlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from textcards.llm import fingerprints, license_scan, mixing, quality_gam, storage, token_output, warc_store
from textcards.llm.license_templates import TEMPLATES

SF = "/root/testdata/sf0.001"


# -- 1 -----------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.train(docs, labels.where(~quality_gam.held_out()))
    rows = quality_gam.score(docs, model, ["doc_id"]).join(labels.where(quality_gam.held_out()), "doc_id").collect()
    assert len(rows) > 80
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_quality_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (18, 0), (14, 0), (3, 1), (3, 0), (None, 1), (4, None), (4, 0)], "doc_id long, quality int")
    model = quality_gam.train(edge_docs, labels)
    out = quality_gam.score(edge_docs, model, edge_docs.columns, "__quality")
    assert out.columns == [*edge_docs.columns, "__quality"]
    rows = out.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["__quality"] <= 1 for r in rows)
    assert len({r["__quality"] for r in rows if not r.text}) == 1          # null and empty alike
    assert len({r["__quality"] for r in rows if r.doc_id in (1, 2)}) == 1
    none = quality_gam.train(edge_docs, labels.where("false"))
    assert {r.score for r in quality_gam.score(edge_docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality_gam.score(no_docs, model, ["doc_id"]).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality_gam.Gam().fit(x, y)
    assert ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.9
    assert (3, 0) in [(f, g) for f, g, _ in model.pairs]


# -- 2 -----------------------------------------------------------------------

PAGES = [(3, "u3", "<p>a</p>"), (1, None, "<p>a</p>"), (2, "u2", None), (4, "u 4\r\n", ""), (5, "u5", "x" * 300_000), (6, "u6", "é\x1f\x8b\x08"),
         (None, "n", "<p>a</p>"), (None, "n", "only"), (7, "u7", "twice"), (7, "u7", "twice")]


def expected_pages(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and (h or "") not in first or i is not None and i < first[h or ""]:
            first[h or ""] = i
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "") if len(raw) >= least else None
        other = f is not None and i != f
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", f if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_warc_round_trip(spark, split, least):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, sha int").repartition(3)
    base = storage.scratch(spark, "warc")
    files = warc_store.write_pages(pages, base, min_revisit=least, file_bytes=600)
    rows = warc_store.page_records(warc_store.read_archives(files, base, split)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == expected_pages(PAGES, least)


def damaged(path, how, records):
    """Damage one file of several records."""
    import zlib
    raw = bytearray(open(path, "rb").read())
    starts, at = [], 0
    while at < len(raw):
        starts.append(at)
        unpack = zlib.decompressobj(31)
        unpack.decompress(bytes(raw[at:]))
        at = len(raw) - len(unpack.unused_data)
    assert len(starts) == records
    if how == "cut tail":
        raw = raw[:-15]
    elif how == "cut record":
        raw = raw[:starts[-1]]
    elif how == "cut head":
        raw = raw[starts[1]:]
    else:
        where, byte = how
        raw[starts[where] + byte] ^= 0xFF
    open(path, "wb").write(bytes(raw))


@pytest.mark.parametrize("how", ["cut tail", "cut record", "cut head", (0, 0), (2, 0), (4, 0), (2, 2), (2, 14), (4, 14), (2, 40), (4, 60)])
@pytest.mark.parametrize("split", [64, 1 << 20])
def test_damage_is_an_error(spark, tmp_path, how, split):
    raw = [warc_store.record(i, "u", f"<p>page {i}</p>".encode() * 9, None) for i in range(5)]
    path = str(tmp_path / "a.warc.gz")
    open(path, "wb").write(b"".join(raw))
    whole = len(b"".join(raw))
    damaged(path, how, 5)

    def read():
        from pyarrow import fs
        size = len(open(path, "rb").read())
        with fs.LocalFileSystem().open_input_file(path) as f:
            window = warc_store.Window(f, size)
            return [warc_store.parse(r)[0] for a in range(0, size, split) for _, r in warc_store.members(window, a, min(size, a + split))]

    if how in ("cut record", "cut head"):           # whole records are missing: the size and the counts tell
        assert len(read()) == 4
        files = spark.createDataFrame([("a.warc.gz", whole, 5)], "path string, size long, records long")
        with pytest.raises(Exception, match="were written"):
            warc_store.read_archives(files, f"file://{tmp_path}").collect()
        short = files.withColumn("size", F.lit(len(open(path, "rb").read())).cast("long"))
        records = warc_store.read_archives(short, f"file://{tmp_path}")
        with pytest.raises(ValueError, match="lost"):
            warc_store.verified(records, short)
        return
    with pytest.raises((ValueError, zlib.error)):
        read()


def test_warc_of_no_pages(spark):
    base = storage.scratch(spark, "warc")
    files = warc_store.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), base)
    assert warc_store.read_archives(files, base).count() == 0


def test_magic_inside_a_member_is_no_record(tmp_path):
    import pyarrow as pa
    noise = random.Random(1).randbytes(4000).replace(b"\x1f\x8b", b"zz")
    payload = (noise[:1000] + warc_store.MAGIC + noise[1000:] + warc_store.MAGIC * 5)
    raw = [warc_store.record(i, "u", payload + bytes([i]), None) for i in range(4)]
    path = tmp_path / "a.gz"
    path.write_bytes(b"".join(raw))
    whole = len(path.read_bytes())
    for step in (1, 7, 500, 100_000) if whole < 20_000 else (500, 100_000):
        found = []
        with pa.OSFile(str(path)) as f:
            for a in range(0, whole, step):
                found += [at for at, _ in warc_store.members(warc_store.Window(f, whole), a, min(whole, a + step))]
        assert found == list(np.cumsum([0, *map(len, raw[:-1])]))


# -- 3 -----------------------------------------------------------------------

def source_totals(rows):
    total = Counter()
    for s, t in rows:
        total[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    return total


def test_mixing_weights_and_passes(edge_docs):
    rows = mixing.mix(edge_docs, max_repeats=3.0).select("row.source", "row.text", "tokens", "weight", "share", "copies").collect()
    total = source_totals((r.source, r.text) for r in rows)
    share = {s: n / sum(total.values()) for s, n in total.items()}
    weight = {r.source: r.weight for r in rows}
    for r in rows:
        assert r.share == pytest.approx(share[r.source])
    assert sum(weight.values()) == pytest.approx(1)
    # the weights are a power of the shares, and the limit or the entropy binds
    big, small = max(share, key=share.get), min(share, key=share.get)
    a = math.log(weight[big] / weight[small]) / math.log(share[big] / share[small])
    entropy = lambda q: -sum(x * math.log(x) for x in q if x)
    target = (entropy(share.values()) + math.log(len(share))) / 2
    spread = (share[big] / share[small]) ** (1 - a)
    assert entropy(weight.values()) == pytest.approx(target, abs=1e-6) or spread == pytest.approx(3.0, rel=1e-6)
    assert spread <= 3.0 + 1e-6
    # budgets: whole passes, then documents while they fit
    spend = max(total[s] / weight[s] for s in total)
    for s in total:
        used = sum(r.tokens * r.copies for r in rows if r.source == s)
        quota = weight[s] * spend
        most = max(r.tokens for r in rows if r.source == s)
        assert quota - most <= used <= quota + 1
        assert len({r.copies for r in rows if r.source == s}) <= 2
    assert min(r.copies for r in rows) >= 1


def test_mixing_budget_and_edges(spark, edge_docs, no_docs):
    mixed = mixing.mixed_documents(edge_docs, max_repeats=2.0)
    assert mixed.columns == edge_docs.columns
    assert mixed.select("doc_id", "text").distinct().count() == edge_docs.select("doc_id", "text").distinct().count()
    half = mixing.mix(edge_docs, budget=40_000).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert half <= 40_010
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mix(blank).collect()] == [1, 1]


# -- 6 -----------------------------------------------------------------------

def test_licences(spark, edge_docs, edge_rows, no_docs):
    mit, bsd = TEMPLATES["MIT"], TEMPLATES["BSD-3-Clause"]
    texts = [t for _, t in edge_rows] + [mit, mit.replace("Software", "Program"), bsd.upper(), "x\n" + TEMPLATES["Apache-2.0-header"].replace("\n", " "),
                                         "prose before\nLicensed under  CC-BY 4.0\nafter"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = {k: set(license_scan.bigrams(v)) for k, v in TEMPLATES.items()}
    hits = 0
    for r in license_scan.scan(docs).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        want = []
        for i, unit in [(-1, texts[r.doc_id] or ""), *enumerate(lines)]:
            g = set(license_scan.bigrams(unit))
            want += [(-2 * len(g & t) / (len(g) + len(t)), i, k) for k, t in known.items() if 2 * len(g & t) >= 0.8 * (len(g) + len(t))]
        assert [(-m.dice, m.line, m.license) for m in r.matches] == sorted(want)
        assert r.n_units == len(lines)
        hits += len(want)
    assert hits >= 6
    assert license_scan.digest(edge_docs).count() == len(edge_rows) and license_scan.digest(no_docs).count() == 0


# -- 8 -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_token_shards_round_trip(spark, stored, edge_rows, vocabulary):
    out = storage.scratch(spark, "shards")
    records = token_output.materialise(stored, out, *vocabulary, length=64, shard_bytes=4096)
    rows = records.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and len({r.shard for r in rows}) > 3
    ids = list(token_output.read_slots(out, records, 0, len(rows), length=64))
    assert all(hashlib.sha256(x.tobytes()).hexdigest() == r.sha256 for x, r in zip(ids, rows, strict=True))
    some = list(token_output.read_slots(out, records, 5, 7, length=64))
    assert all((a == b).all() for a, b in zip(some, ids[5:12], strict=True))
    with open(vocabulary[0], "rb") as f:
        encode = token_output.encoder(f.read(), vocabulary[1])
    want = sorted((i if i is not None else -1, tuple(encode.encode_ordinary(t)) + (50256,)) for i, t in edge_rows if t)
    # put the pieces of each document together again: within a partition they follow in order
    got, by_row = defaultdict(list), {r.slot: x for r, x in zip(rows, ids, strict=True)}
    for r in rows:
        for d in r.docs:
            got[d.doc_id if d.doc_id is not None else -1].append(tuple(by_row[r.slot][d.first:d.first + d.n].tolist()))
    counts = Counter(i for i, _ in want)
    for i, t in want:
        assert sum(map(len, got[i])) == sum(len(x) for j, x in want if j == i)
        if counts[i] == 1 and len(got[i]) <= 3:
            assert any(sum(p, ()) == t for p in __import__("itertools").permutations(got[i]))
    assert [f for f in os.listdir(out.removeprefix("file:")) if f.startswith(".") and not f.endswith(".crc")] == []


def test_token_shards_of_nothing(spark, no_docs, vocabulary, tmp_path):
    no_docs.write.parquet(str(tmp_path / "none"))
    records = token_output.materialise(spark.read.parquet(str(tmp_path / "none")), storage.scratch(spark, "shards"), *vocabulary)
    assert records.count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 65_537])
def test_feistel_is_a_permutation(size):
    out = token_output.Feistel(size, 5)(np.arange(size))
    assert sorted(out.tolist()) == list(range(size))
    assert size < 10 or (token_output.Feistel(size, 6)(np.arange(size)) != out).any()


def test_pieces_do_not_change_tokens(vocabulary, monkeypatch):
    monkeypatch.setattr(token_output, "PIECE", 50)
    with open(vocabulary[0], "rb") as f:
        encode = token_output.encoder(f.read(), vocabulary[1]).encode_ordinary
    text = "It's  a test,\n\n with   spaces 123 4567 l'été don't " * 20
    parts = list(token_output.pieces(text))
    assert len(parts) > 5 and "".join(parts) == text
    assert sum((encode(p) for p in parts), []) == encode(text)


# -- 9 -----------------------------------------------------------------------

def five(text):
    w = brute.SPACED.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 7)      # several ranges
    got = fingerprints.edited_fingerprints(edge_docs).collect()
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    rows = sorted(((i, t or "") for i, t in edge_rows), key=key)
    after = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        after[i, len(t)].append((t, t[:len(t) - len(t) // 2] + n[:len(t) // 2], n))
    want = Counter((i, n, hashlib.sha256(e.encode()).hexdigest()) for (i, n), v in after.items() for _, e, _ in v)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    similar = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in got:
        options = [(similar(five(t), five(e)), similar(five(t), five(n))) for t, e, n in after[r.doc_id, r.n_chars]]
        assert any(abs(r.near_edited - a) < 0.2 and abs(r.near_next - b) < 0.2 for a, b in options)
        assert len(r.fingerprint) in (0, 2 * fingerprints.BINS)
    assert len({r.fingerprint for r in got if r.n_chars == len(edge_rows[0][1]) and r.doc_id in (1, 2)}) == 1
    assert fingerprints.edited_fingerprints(no_docs).count() == 0
    alone = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(alone).first().near_next == 1.0


def test_fingerprint_estimates_are_unbiased(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = prose(rng, 400, 50_000).split()
        k = rng.randrange(400)
        rows.append((i, " ".join(w), " ".join(w[:k] + prose(rng, 400 - k, 50_000).split())))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    df = fingerprints.fingerprint(fingerprints.fingerprint(df, "a", "fa"), "b", "fb")
    near = {r.doc_id: r.n for r in df.select("doc_id", fingerprints.likeness("fa", "fb").alias("n")).collect()}
    err = [near[i] - len(five(a) & five(b)) / len(five(a) | five(b)) for i, a, b in rows]
    assert abs(np.mean(err)) < 0.015 and np.std(err) < 0.06


# -- the pipeline ------------------------------------------------------------

def test_pipeline_stages(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus.STAGES[:-1]:
        before = docs
        docs = storage.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        old = {r.doc_id: r.text for r in before.collect()}
        if name == "quality":
            assert 0.5 * len(old) < len(ids) < len(old)
        if name == "near_duplicates":
            want = brute.jaccard_components(list(old.items()), 5, 80)
            assert sorted(ids) == sorted({c for _, _, c in want})
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            bad = brute.contamination(list(old.items()), items)
            assert sorted(ids) == sorted(i for i, x in zip(old, bad, strict=True) if not x[-1])
        if name == "mixing":
            assert set(ids) == set(old) and len(ids) >= len(old)
    records = corpus.STAGES[-1][1](spark, docs, SF)
    assert records.agg(F.sum("n_tokens")).first()[0] > 1000


def test_pipeline_stages_on_odd_tables(spark, edge_docs, no_docs, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    for name, docs in (("edge", edge_docs), ("none", no_docs)):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1), (18, 0)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert corpus.run(spark, d).count() >= (0 if name == "none" else 1)
