"""Operators 11 to 13 against plain Python statements of their rules."""

import base64
import hashlib
import math
import random

import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from textcards.llm import byte_bpe, centroids, hard_negatives

VECTORS = "vec_id long, embedding array<double>, label int, v int, id string, row string, cluster string, near int"
EXTRA = (1, "x", "y", "z", 2)


def vectors(rng, n, dim, labels=4, spread=0.3):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [x + rng.gauss(0, spread) for x in middles[i % labels]], i % labels) for i in range(n)]


def odd_vectors(dim):
    return [(None, [0.5] * dim, 1), (9001, None, 1), (9002, [0.1] * (dim - 1) + [None], 1), (9003, [math.nan] + [0.0] * (dim - 1), 0),
            (9004, [math.inf] * dim, 0), (9005, [], 1), (9006, [0.0] * dim, None), (9050, [0.0] * dim, 2), (9007, [0.25] * (dim + 1), 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTORS)


# --- operator 11 -------------------------------------------------------------------------
def plain_clusters(rows, k=16, rounds=3):
    """Rows of (id, whole vector) -> (id, cluster, distance), centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in start[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        near = nearest()
        for n in range(len(middle)):
            own = [v for (_, v), (_, at) in zip(kept, near) if at == n]
            if own:
                middle[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, at, d) for (i, _), (d, at) in zip(kept, nearest())], middle


@pytest.mark.parametrize("n", [3, 200])
def test_clusters_equal_plain_rounds(spark, n):
    rng = random.Random(n)
    rows = vectors(rng, n, 64) + odd_vectors(64)
    rows += [rows[0], rows[1], rows[1]] + [(5000 + i, rows[2][1], 1) for i in range(30)]
    rng.shuffle(rows)
    want, middle = plain_clusters(rows)
    got = centroids.clustered(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(want)
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    for r in got:
        assert r["centroid_sha256"] == hashes[r["cluster"]]
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in want)


def test_an_empty_cluster_keeps_its_centroid(spark):
    rows = [(i, [0.5] * 64, 0) for i in range(20)] + [(20, [3.0] * 64, 0)]
    want, middle = plain_clusters(rows)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.clustered(frame(spark, rows)).collect()}
    assert got == {i: (c, d) for i, c, d in want}


def test_clusters_of_nothing_and_out_of_range(spark):
    empty = centroids.clustered(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="out of the range"):
        centroids.clustered(frame(spark, [(1, [1e9] * 64, 0)])).collect()


# --- operator 12 -------------------------------------------------------------------------
def plain_negatives(rows, every, scale=256):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, u in {(i, lab, tuple(v)): (i, lab, v) for i, lab, v in kept if i % every == 0}.values():
        scored = sorted(((-sum(x * y for x, y in zip(u, v)), i, b) for i, b, v in kept if i != a))
        for neg, p, _ in [x for x in scored if x[2] == lab][:5]:
            ps = -neg
            fits = [(-s, i) for s, i, b in scored if b != lab and 50 * ps <= -100 * s <= 95 * ps]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(fits[:3])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, every, **more):
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0, **more)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("spread,block", [(0.2, 8192), (1.0, 8192), (0.5, 7)])
def test_negatives_equal_brute_force(spark, spread, block):
    rng = random.Random(int(spread * 10))
    rows = vectors(rng, 400, 16, spread=spread) + odd_vectors(16)
    rows += [(600 + i, rows[7][1], rng.randrange(4)) for i in range(120)]          # one common vector: ties
    rows += [rows[50], rows[50], (50, rows[3][1], 1)]                              # a repeated anchor, an id with two rows
    rows += [(1000 + i, [-x for x in rows[i][1]], 2) for i in range(20)] + [(1050, [1e-9] * 16, 1), (1100, [0.0] * 16, 1)]
    rng.shuffle(rows)
    assert mined(frame(spark, rows).repartition(3), 10, block=block) == plain_negatives(rows, 10)


def test_walk_stops_early_and_is_exact(spark, monkeypatch):
    """Tight clusters: the lists are cut, the rows stay those of brute force."""
    rng = random.Random(3)
    rows = vectors(rng, 1500, 24, labels=6, spread=0.05)
    seen = []
    plain = hard_negatives.Walk.score_part
    monkeypatch.setattr(hard_negatives, "STEP", 50)

    def counted(self, active, ids, labels, v):
        seen.append(len(active) * len(ids))
        plain(self, active, ids, labels, v)

    block = [r for r in rows if r[0] % 50 == 0]
    import numpy as np
    v = np.array([[math.floor(256 * x) for x in r[1]] for r in block], float)
    b = hard_negatives.Anchors(v, np.array([r[0] for r in block]), np.array([r[2] for r in block]),
                               np.linalg.norm(v, axis=1), *hard_negatives.clusters_of(v))
    monkeypatch.setattr(hard_negatives, "MEMBERS", 5)
    b.centroids, b.radius, b.members = hard_negatives.clusters_of(v)
    monkeypatch.setattr(hard_negatives.Walk, "score_part", counted)
    walk = hard_negatives.Walk(b, np.full((len(v), 1), -np.inf), np.full((len(v), 1), np.inf), True, 5)
    x = np.array([[math.floor(256 * y) for y in r[1]] for r in rows], float)
    walk.slice(np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), x)
    assert sum(seen) < 0.5 * len(v) * len(rows)
    for a, r in enumerate(block):
        want = sorted((-float(v[a] @ x[i]), c[0]) for i, c in enumerate(rows) if c[2] == r[2] and c[0] != r[0])[:5]
        assert list(zip(-walk.score[a], walk.id[a])) == want
    monkeypatch.undo()
    assert mined(frame(spark, rows), 50) == plain_negatives(rows, 50)


def test_negatives_in_long_arithmetic_and_of_nothing(spark):
    rng = random.Random(5)
    rows = [(i, [x * 3e4 for x in v], lab) for i, v, lab in vectors(rng, 60, 8)]
    big = [(i, [x * 5 for x in v], lab) for i, v, lab in rows]
    assert mined(frame(spark, big), 10) == plain_negatives(big, 10)
    assert mined(frame(spark, []), 10) == [] and mined(frame(spark, odd_vectors(4)), 10_000) == []


# --- operator 13 -------------------------------------------------------------------------
VOCABULARY = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    return byte_bpe.loaded(byte_bpe.model(open(VOCABULARY, "rb").read(), PATTERN))


_encoders = {}


def ids_of(tok, text):
    if id(tok) not in _encoders:
        _encoders[id(tok)] = tok, byte_bpe.Encoder(tok, False)
    return _encoders[id(tok)][1]([text])[0][0].tolist()


def strange_texts():
    rng = random.Random(1)
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(rng.randrange(0x10000, 0x110000)) for _ in range(4000)]
    yield "".join(every)
    for c in every[::7]:
        yield f"a{c}b 1{c}2 !{c}? {c} {c}{c}\n{c}"
    yield from ["", " ", "  ", "\x00\x1c\x1d\x1e\x1f\x85\xa0 x", "I'll we've don't 'S 'LL", "<|endoftext|>", "a" * 5000, " " * 3000 + "x",
                "\n\n\t x  y", "日本語テキスト🙂🙂🏽‍♀️", "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    for _ in range(200):
        yield "".join(rng.choice(" \n\tab1é🙂'!日\xa0ſ") for _ in range(rng.randrange(1, 80)))


def test_ids_equal_tiktoken(tok, reference):
    for text in strange_texts():
        assert ids_of(tok, text) == reference.encode_ordinary(text), text[:60]


def test_remembered_units_give_the_same_ids(tok, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_UNITS", 50)
    texts = list(strange_texts())
    encode = byte_bpe.Encoder(tok, False)
    placed = byte_bpe.Encoder(tok, True)
    for i in range(0, len(texts), 5):
        want = [reference.encode_ordinary(t) for t in texts[i:i + 5]]
        assert [x.tolist() for x in encode(texts[i:i + 5])[0]] == want
        assert [x.tolist() for x in placed(texts[i:i + 5])[0]] == want


def test_every_character_is_cut_as_tiktoken_cuts_it(reference):
    """With a vocabulary whose ids show every cut."""
    import tiktoken
    ranks = {bytes([i]): i for i in range(256)}
    for a in b"a1! ":
        for x in range(128, 256):
            ranks[bytes([a, x])] = len(ranks)
    file = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    own = tiktoken.Encoding("cuts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = byte_bpe.loaded(byte_bpe.model(file, PATTERN))
    for start in range(0x80, 0x110000, 4096):
        text = "".join(f"a{c}1{c}!{c} {c} \n" for c in map(chr, range(start, min(start + 4096, 0x110000))) if not 0xD800 <= ord(c) < 0xE000)
        assert ids_of(made, text) == own.encode_ordinary(text), hex(start)


def test_offsets_and_split_characters(tok):
    text = "héllo 🙂🏽 日本 x"
    ids, starts, ends = [x[0].tolist() for x in byte_bpe.Encoder(tok, True)([text])]
    table = byte_bpe.byte_table(tok)
    data, pieces = byte_bpe.decoded(ids, table)
    assert data.decode() == text and "".join(pieces) == text and len(pieces) == len(ids)
    for i, a, b in zip(ids, starts, ends):
        assert table[i] in text[a:b].encode()           # the whole characters that the token's bytes belong to
    assert any(a == c and b == d for a, b, c, d in zip(starts, ends, starts[1:], ends[1:]))     # a split character
    assert byte_bpe.decoded(ids[:-5], table)[0] == b"".join(table[i] for i in ids[:-5])
    emoji = ids_of(tok, "🙂")
    assert len(emoji) > 1 and byte_bpe.decoded(emoji[:1], table)[1] == ["�"]


def test_encode_and_decode_tables(spark, edge_docs, edge_rows, no_docs, reference):
    bpe = byte_bpe.ByteBpe(spark, VOCABULARY, PATTERN)
    odd = edge_docs.withColumnsRenamed({"k0": "ids", "part": "starts", "rep": "bytes", "key": "pieces"})
    encoded = bpe.encode(odd)
    got = bpe.decode(encoded).select("row.doc_id", "row.ids", F.col("ids").alias("found"), "bytes", "text").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in edge_rows), key=key)
    assert sorted(((r["doc_id"], r["found"], bytes(r["bytes"])) for r in got), key=key) == want
    assert all(r["ids"] == 1 and r["text"] == bytes(r["bytes"]).decode() for r in got)
    assert bpe.decode(bpe.encode(no_docs)).count() == 0
    nothing = spark.createDataFrame([((1,), None)], "row struct<a:int>, ids array<int>")
    assert [bytes(r["bytes"]) for r in bpe.decode(nothing).collect()] == [b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([((1,), [50_256])], "row struct<a:int>, ids array<int>")).collect()


def test_long_text_is_whole(spark, reference):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(600_000))
    bpe = byte_bpe.ByteBpe(spark, VOCABULARY, PATTERN)
    got = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")), False).first()
    assert got["ids"] == reference.encode_ordinary(text) and bytes(got["bytes"]) == text.encode()


def test_vocabulary_that_is_no_bpe_is_refused():
    lines = [base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)]
    with pytest.raises(ValueError, match="not a merge"):
        byte_bpe.model(b"\n".join([*lines, base64.b64encode(b"abc") + b" 256"]), PATTERN)
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.model(b"\n".join(lines[1:]), PATTERN)
