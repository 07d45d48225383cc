"""Operators 4, 5, 7 and 10 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import prose
from textcards.llm import decontam, paragraph_dedup, shingle_join, suffix_dedup, tokens


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components(edge_docs, edge_rows, n, percent):
    got = [tuple(r) for r in shingle_join.jaccard_components(edge_docs, n=n, percent=percent).collect()]
    assert order(got) == order(brute.jaccard_components(edge_rows, n, percent))


def near_copies(count, seed=3, size=80, edits=4):
    rng = random.Random(seed)
    base = prose(rng, size).split()
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"n{rng.randrange(9)}"
        out.append((i, " ".join(w)))
    return out


def test_weak_parts_lose_no_link(spark, monkeypatch):
    rows = near_copies(120, 9, 60, 5)
    monkeypatch.setattr(shingle_join, "HOT_PART", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in shingle_join.jaccard_components(docs, n=3, percent=80).collect()]
    assert order(got) == order(brute.jaccard_components(rows, 3, 80))


def test_large_cluster_is_dealt_in_blocks(spark):
    rows = near_copies(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in shingle_join.jaccard_components(docs, n=3, percent=85, max_cluster=10, block=7).collect()]
    assert order(got) == order(brute.jaccard_components(rows, 3, 85))


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_of_linked_sets_meet(percent):
    rng = np.random.default_rng(1)
    for size in [1, 2, 3, 5, 8, 9, 10, 13, 20, 37, 90, 250]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = rng.permutation(len(a))[:rng.integers(0, max(1, len(a) // 10) + 1)]
            b = np.unique(np.concatenate([np.delete(a, drop), rng.integers(0, 1 << 63, rng.integers(0, 2)).astype(np.uint64)]))
            k = len(np.intersect1d(a, b))
            if k and 100 * k >= percent * (len(a) + len(b) - k) and not np.array_equal(a, b):
                both = np.intersect1d(shingle_join.prefix(a, percent), shingle_join.prefix(b, percent)).size
                assert both >= shingle_join.common(len(a), percent) and both >= shingle_join.common(len(b), percent)
                (x, s), (y, t) = shingle_join.signatures(a, percent), shingle_join.signatures(b, percent)
                same = np.isin(x, y)         # in one partition, more than either set's budget
                assert any((same & (s == g)).sum() > g // shingle_join.TAGS for g in np.unique(s))
                same = np.isin(y, x)
                assert any((same & (t == g)).sum() > g // shingle_join.TAGS for g in np.unique(t))


def test_count_tree_finds_all_that_can_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(200)]
    sizes = np.array([len(s) for s in sets])
    counts = shingle_join.group_counts(sets)
    tree = shingle_join.CountTree(counts, sizes, 60)
    for i, s in enumerate(sets):
        near = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 60 * len(np.union1d(s, t))}
        assert near <= set(tree.probe(counts[i], sizes[i]).tolist())


def test_one_of_each_keeps_columns_and_one_row(edge_docs, edge_rows):
    out = shingle_join.one_of_each(edge_docs, n=3, percent=90)
    assert out.columns == edge_docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    # rows of one id and text are one; each links by its own text only
    known = sorted({(i, t or "") for i, t in edge_rows if i is not None})
    comps = brute.jaccard_components([(k, t) for k, (_, t) in enumerate(known)], 3, 90)
    stay = [known[k] for k, (_, _, c) in enumerate(comps) if c == k]
    assert got == sorted([(False, i, t) for i, t in stay] + [(True, 0, t or "") for i, t in edge_rows if i is None])
    assert [t for _, i, t in got if i == 16] and sum(i == 16 for _, i, _ in got) == 2       # two unrelated texts of one id


def test_one_of_each_with_one_id_under_many_texts(spark):
    rng = random.Random(9)
    base = [prose(rng, 80, 5000) for _ in range(30)]
    rows = [(7, t, f"s{k}") for k, t in enumerate(base)] + [(7, base[3], "s0"), (7, base[3], "a"), (5, base[4], "x"), (9, base[5], "y"), (11, base[0] + " tail", "z")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted((r.doc_id, r.text, r.source) for r in shingle_join.one_of_each(docs, n=5, percent=80).collect())
    want = [(7, t, "a" if k == 3 else f"s{k}") for k, t in enumerate(base) if k != 4] + [(5, base[4], "x")]
    assert got == sorted(want)


def test_contamination(spark, edge_docs, edge_rows):
    items = [(1, " ".join(edge_rows[0][1].split()[20:45])), (2, "one"), (3, None), (4, ""), (None, "two words"), (5, "Two, WORDS!"),
             (6, " ".join(edge_rows[10][1].split()[38:60])), (6, "two words"), (7, "not in any text at all of these documents here ok")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, brute.contamination(edge_rows, items)))
    for block_words in (1_000_000, 12):        # one block, several blocks
        got = decontam.contamination_digest(edge_docs, bench, block_words=block_words).drop("doc_id").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    kept = decontam.decontaminate(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(not x[-1] for x in brute.contamination(edge_rows, items))


def test_longest_match_and_its_place(spark):
    text = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(1, "x y " + text + " z " + text[:23])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "q " + text)], "item_id long, text string")
    row = decontam.find_contamination(docs, bench, ["doc_id"])[0].first()
    assert [tuple(m) for m in row["matches"]] == [("9", 1, 2, 16), ("9", 1, 19, 12)]
    assert [tuple(h) for h in row["hits"]] == [(2, 18), (19, 31)]


def test_items_beyond_a_block(spark):
    """Pieces, blocks and passes change nothing: equal rows, longest matches and places included."""
    rng = random.Random(31)
    texts = [prose(rng, 400, 300) for _ in range(12)]
    docs = spark.createDataFrame([(i, rng.choice(texts)[50:900] + " zz " + t + " " + t[:700]) for i, t in enumerate(texts)] + [(77, None)],
                                 "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([("long", " ".join(texts[:6])), ("part", texts[7][100:1500]), (None, "zz"), ("gone", "qq ww ee"), ("none", None)],
                                  "item_id string, text string").repartition(2)
    seen = []
    for block_words in (1_000_000, 250, 41):
        found, (k,) = decontam.find_contamination(docs, bench, ["doc_id"], block_words=block_words)
        seen.append(sorted((r[k], r.n_words, str(r.hits), str(r["items"]), sorted(map(tuple, r.matches))) for r in found.collect()))
    assert seen[0] == seen[1] == seen[2] and max(m[3] for r in seen[0] for m in r[4]) >= 400


def test_more_words_than_a_block_may_number(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontam.find_contamination(bench.withColumnRenamed("item_id", "doc_id"), bench, ["doc_id"], block_words=1 << 22)


def test_paragraphs(spark, edge_docs, edge_rows):
    rng = random.Random(2)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(1, 60)) for _ in range(3)]
        w = rng.choice(shared).split()
        w[rng.randrange(60)] = "edit"
        parts.insert(rng.randrange(3), " ".join(w))
        rows.append((i, "\n".join(parts) + rng.choice(["", "\n", "\n\n"])))
    want = brute.paragraphs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    assert sum(len(x) for x, _ in want.values()) >= 15
    for r in paragraph_dedup.dedup_paragraphs(docs).collect():
        assert (r.removed, r.n_paragraphs) == want[r.doc_id]
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in r.removed)


def test_paragraph_edges(edge_docs, edge_rows, no_docs):
    got = paragraph_dedup.dedup_paragraphs(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].text == "" and by_id[4].n_paragraphs == 0
    assert by_id[10].removed == [] and by_id[11].removed == [0]
    assert [r.removed for r in got if r.doc_id == 2] == [[0], [0]]     # a null id comes first and keeps the paragraph
    assert paragraph_dedup.dedup_paragraphs(no_docs).count() == 0


def test_tuned_bands_reach_the_recall():
    for percent in (60, 80, 90):
        bands, rows = paragraph_dedup.tune_bands(percent, 0.999, 2)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= 0.999


def test_paragraph_sets_cost_little():
    """The sets of a text's paragraphs are those of its lines, read in one go: 12,000
    paragraphs took seconds when each was cut out and hashed alone."""
    import time

    import pyarrow as pa
    rng = random.Random(8)
    texts = ["\n".join(prose(rng, rng.randrange(20, 60), 300) for _ in range(n)) for n in (5, 12_000, 1)] + ["\u00c4b c d e f\n\n" + prose(rng, 30) + "\n"]
    wanted = [[{"line": k, "last": k, "pid": 100_000 * i + k, "cluster": k % 7} for k in range(t.count("\n") + 1)] for i, t in enumerate(texts)]
    wanted[3] = [{"line": 0, "last": 2, "pid": 300_000, "cluster": 1}, {"line": 2, "last": 2, "pid": 300_001, "cluster": 2}]
    kind = pa.list_(pa.struct([("line", pa.int32()), ("last", pa.int32()), ("pid", pa.int64()), ("cluster", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["other", *texts]), pa.array([[], *wanted], kind)], names=["text", "wanted"]).slice(1)
    t0 = time.process_time()
    out = pa.Table.from_batches(paragraph_dedup.read_line_sets([batch, batch.slice(0, 0)])).to_pylist()
    assert time.process_time() - t0 < 1
    got = {r["doc_id"]: (r["cluster"], r["items"]) for r in out}
    assert len(out) == len(got) == sum(map(len, wanted))
    for t, mine in zip(texts, wanted):
        lines = t.split("\n")
        for w in mine[:300]:
            x = "\n".join(lines[w["line"]:w["last"] + 1]).encode()
            s = next(tokens.shingle_sets(np.frombuffer(x, np.uint8), np.array([0, len(x)]), tokens.NON_SPACE, 5))
            assert got[w["pid"]] == (w["cluster"], s.tobytes())


@pytest.mark.parametrize("sides", [False, True])
def test_small_clusters_compared_at_once(monkeypatch, sides):
    """As many classes, from links that hold, as by the tree."""
    rng = random.Random(6)
    for _ in range(60):
        n, base = rng.randrange(2, 20), rng.sample(range(1 << 60), 40)
        sets = [np.unique(np.array([x if rng.random() < 0.93 else rng.randrange(1 << 60) for x in base[:rng.randrange(20, 41)]], np.uint64))
                for _ in range(n)]
        side = np.array([rng.randrange(2) for _ in range(n)]) if sides else None
        classes = []
        for few in (64, 0):
            monkeypatch.setattr(shingle_join, "FEW", few)
            found, u = shingle_join.links(list(range(n)), sets, 80, side), brute.Union(range(n))
            for a, b in found:
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (not sides or side[a] != side[b])
                u.join(a, b)
            classes.append([u.find(k) for k in range(n)])
            assert len(found) == n - len(set(classes[-1]))
        assert classes[0] == classes[1]


@pytest.mark.parametrize("more", [{}, {"max_segments": 1}, {"block_bytes": 1}])
def test_substrings(edge_docs, edge_rows, more):
    rows = suffix_dedup.dedup_substrings(edge_docs, **more).collect()
    got = sorted((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)
    assert got == sorted(brute.substrings(edge_rows, 200))
    assert all(s.a < s.b for r in rows for s in r.spans)


def test_substrings_of_empty_tables(no_docs):
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0
    assert shingle_join.jaccard_components(no_docs).count() == 0


def test_interval_expansion_equals_sorting():
    rng = np.random.default_rng(3)
    unit = rng.integers(1, 4, 90)
    x = np.concatenate([unit, [0], rng.integers(1, 4, 200), [0], unit[10:80], [0], np.tile([1, 2], 60), [0]])
    length = 40
    sa, border = suffix_dedup.expand(x, length)
    groups = {}
    for g, p in zip(np.cumsum(border), sa, strict=True):
        groups.setdefault(int(g), set()).add(tuple(x[p:p + length]))
    assert all(len(v) == 1 for v in groups.values())
    assert len(groups) == len({tuple(x[p:p + length]) for p in range(len(x))})


def test_very_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(30_000)).encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = tokens.words(buf, offs, tokens.NON_SPACE)[0]
    runs = [np.concatenate(c) for c in zip(*suffix_dedup.text_runs(buf, offs, 200, 64), strict=True)]
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 5_000)
    assert np.array_equal(whole, tokens.words(buf, offs, tokens.NON_SPACE)[0])
    parts = [np.concatenate(c) for c in zip(*suffix_dedup.text_runs(buf, offs, 200, 64), strict=True)]
    assert parts[2].sum() == runs[2].sum() == len(text) - 199
    assert set(parts[3].tolist()) == set(runs[3].tolist())
