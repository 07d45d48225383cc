"""Operator 5: near-duplicate paragraphs by MinHash banding.

A paragraph begins at a line that has a word (white-space separated, A-Z
lower-cased) and is the shortest run of whole lines from there that reaches
``min_words`` words: the line itself where it is long enough, else with the lines
after it.  So hard-wrapped text and passages over several lines have paragraphs
that begin at the same line in every copy, no blank line is needed, and a short
line goes only as part of a run.

1. One pass hashes every paragraph of every whole text: an identity hash of its
   words and a MinHash signature of its ``SHINGLE``-word shingles, folded into
   bands.  ``tune_bands`` takes the fewest hashes whose recall at the wanted
   similarity reaches ``RECALL``.
2. Equal paragraphs are one class, represented by its first one.  Only
   representatives are banded.  Paragraphs that collide in a band are tied to
   the smallest of the band; connected components of these ties are clusters.
3. Within a cluster the exact shingle sets are compared (Jaccard similarity,
   in integers); a cluster beyond a bound is dealt as pairs of blocks.
4. Components of the verified links are groups.  The first paragraph of a group
   (smallest doc_id, then line) stays as far as this group is concerned; the
   lines of the others go, but for lines that the first one has itself (runs of
   one text overlap).  So each line that goes lies in a paragraph that has a
   near duplicate before it.

Cases: null and empty texts, and texts of fewer words than ``min_words``, have no
paragraphs.  Very long texts take time and memory in proportion.  Rows that
share a doc_id are told apart by their text; rows that share both count as the
same document and lose or keep the same paragraphs.  A null doc_id sorts before
all others.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, storage, tokens
from textcards.llm.components import components
from textcards.llm.shingle_join import MAX_BROADCAST, verified_links

SHINGLE = 5
PERCENT = 80
MIN_WORDS = 20
RECALL = 0.9998
MAX_ROWS = 2                 # minhashes of a band; more select better but need more bands
ID_BITS = 33                 # paragraphs of one input partition: 2**33
MAX_ELEMENTS = 2_000_000     # rows and array elements of a broadcast, 24 bytes each at most
RETURNED = 50_000            # paragraphs hashed at a time

NO_ID = -(1 << 63)           # stands for a null doc_id


def tune_bands(percent: int, recall: float = RECALL, max_rows: int = MAX_ROWS) -> tuple[int, int]:
    """(bands, rows of a band): the most selective bands of at most
    ``max_rows`` rows, as many as the recall at the wanted similarity needs."""
    rows = max_rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows))), rows


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, index of each line's document)."""
    at = np.unique(np.concatenate([offs, np.flatnonzero(buf == 0x0A) + 1]))
    return at, np.searchsorted(offs, at[:-1], side="right") - 1


def _spans(op, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return op.reduceat(np.append(values, np.uint64(0)), np.column_stack([a, b]).ravel())[::2]


def line_words(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each line's begin (one more at the end)."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for p, q in tokens.chunks(at):
        h, line = tokens.words(part[at[p]:at[q]], at[p:q + 1] - at[p], tokens.NON_SPACE)
        hashes.append(h)
        counts.append(np.bincount(line, minlength=q - p))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def word_edges(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each line's words begin (one more at the end), without their hashes."""
    inside = tokens.NON_SPACE[buf] != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[at[:-1]] = inside[at[:-1]]          # two texts may meet within a word
    return np.searchsorted(np.flatnonzero(starts), at)


def runs_of(edge: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the paragraphs."""
    first = np.flatnonzero(np.diff(edge) > 0)
    last = np.searchsorted(edge, edge[first] + min_words) - 1
    inside = last < len(doc)
    first, last = first[inside], last[inside]
    same = doc[last] == doc[first]
    return first[same], last[same]


def identity(h: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words of each span [a, b), wherever it lies."""
    n = len(h) + 1
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tokens.powers(n, base)[:-1], dtype=np.uint64)])
    back = tokens.powers(n, pow(base, -1, 1 << 64))
    return tokens.mix((acc[b] - acc[a]) * back[a] + (b - a).astype(np.uint64))


def read_paragraphs(min_words: int, bands: int, rows: int):
    """Task code: (doc_id, th, text) -> a row per paragraph."""
    u = np.uint64

    def signed(h, a, b):
        """Identity hashes and band hashes of the spans [a, b)."""
        sh = tokens.combine(h, SHINGLE)
        low = [_spans(np.minimum, tokens.mix(sh ^ u(tokens._K[k])), a, b - SHINGLE + 1) for k in range(bands * rows)]
        sig = []
        for band in range(bands):
            x = np.full(len(a), band, u)
            for m in low[band * rows:(band + 1) * rows]:
                x = tokens.mix(x * u(0x9E3779B97F4A7C15) + m)
            sig.append(x)
        return (identity(tokens.mix(h), a, b, tokens._K[0]), identity(tokens.mix(~h), a, b, tokens._K[1]),
                np.column_stack(sig).view(np.int64).ravel())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId() << ID_BITS
        for batch in batches:
            buf, offs = tokens.text_bytes(batch.column("text"))
            for i, j in tokens.chunks(offs):
                part, local = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                at, doc = lines_of(part, local)
                number = np.arange(len(at) - 1) - np.searchsorted(doc, np.arange(len(local)))[doc]
                h, edge = line_words(part, at)
                firsts, lasts = runs_of(edge, doc, min_words)
                for k in range(0, len(firsts), RETURNED):
                    first, last = firsts[k:k + RETURNED], lasts[k:k + RETURNED]
                    lo, hi = edge[first[0]], edge[last[-1] + 1]
                    h1, h2, sig = signed(h[lo:hi], edge[first] - lo, edge[last + 1] - lo)
                    rows_at = pa.array(np.arange(len(first) + 1, dtype=np.int32) * bands)
                    take = pa.array(doc[first] + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(pid, pid + len(first))), batch.column("doc").take(take), batch.column("th").take(take),
                         pa.array(number[first].astype(np.int32)), pa.array(number[last].astype(np.int32)),
                         pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(rows_at, pa.array(sig))],
                        names=["pid", "doc", "th", "line", "last", "h1", "h2", "bands"])
                    pid += len(first)
    return run


def distinct_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Of the spans [a, b), those of equal length together: (their numbers, sizes
    of their sets, the sorted distinct values of one after the other)."""
    n = b - a
    order = np.argsort(n, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        if len(some):       # none where there are no spans
            x = np.sort(values[a[some][:, None] + np.arange(n[some[0]])], axis=1)
            new = np.ones(x.shape, bool)
            np.not_equal(x[:, 1:], x[:, :-1], out=new[:, 1:])
            yield some, new.sum(1), x[new]


def read_line_sets(batches):
    """Task code: (text, wanted paragraphs) -> the shingle set of each wanted paragraph."""
    import pyarrow as pa
    for batch in batches:
        buf, offs = tokens.text_bytes(batch.column("text"))
        for i, j in tokens.chunks(offs):
            part, local = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            at, doc = lines_of(part, local)
            h, edge = line_words(part, at)
            sh = tokens.combine(h, SHINGLE)
            wanted = batch.column("wanted").slice(i, j - i)
            top = np.repeat(np.searchsorted(doc, np.arange(len(local) - 1)), np.asarray(wanted.value_lengths()))
            flat = wanted.flatten()
            line, last, pid, cluster = (np.asarray(flat.field(c)) for c in ("line", "last", "pid", "cluster"))
            for k in range(0, len(flat), RETURNED):
                here = slice(k, k + RETURNED)
                a, b = edge[top[here] + line[here]], edge[top[here] + last[here] + 1] - SHINGLE + 1
                which, sizes, values = (np.concatenate(x) for x in zip(*distinct_spans(sh, a, b)))
                ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([pa.array(pid[here][which]), pa.array(cluster[here][which]), sets],
                                                 names=["doc_id", "cluster", "items"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs (doc_id, text)`` -> ``doc, th, line, last, group``: every paragraph
    that has a near duplicate, its first and last line, and its group."""
    if min_words < SHINGLE:
        raise ValueError(f"a paragraph needs at least {SHINGLE} words")
    ship("textcards.llm.tokens", "textcards.llm.shingle_join", __name__)
    texts = _keyed(docs)
    bands, rows = tune_bands(percent)
    every = storage.cut(texts.mapInArrow(
        read_paragraphs(min_words, bands, rows),
        "pid long, doc long, th long, line int, last int, h1 long, h2 long, bands array<long>"), "paragraphs")
    place = F.struct("doc", "th", "line", "last", "pid")
    classes = storage.cut(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                          .select("h1", "h2", "first.*", "n"), "classes")

    # of each class one paragraph's bands; the others' are not read again
    bands_of = storage.cut(every.select("pid", "bands").join(classes.select("pid"), "pid", "left_semi"), "bands")
    slim = storage.cut(every.select("doc", "th", "line", "last", "h1", "h2"), "lines")
    storage.drop(every)
    banded = bands_of.select("pid", F.explode("bands").alias("band"))
    shared = storage.cut(banded.groupBy("band").agg(F.min("pid").alias("hub"), F.max("pid").alias("top"))
                         .where("hub < top").select("band", "hub"), "shared")
    ties = banded.join(shared, "band").where("pid != hub").select(
        F.col("pid").alias("a"), F.col("hub").alias("b")).distinct()
    joined = components(ties, "clusters")
    cluster = storage.cut(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "members")
    storage.drop(bands_of, shared, joined)

    wanted = storage.cut(classes.join(cluster.withColumnRenamed("doc_id", "pid"), "pid").groupBy("doc", "th")
              .agg(F.collect_list(F.struct("line", "last", "pid", "cluster")).alias("wanted")), "wanted")      # lines of one document
    items = texts.join(storage.bounded(wanted, MAX_ELEMENTS, F.size("wanted")), ["doc", "th"]) \
        .select("text", "wanted").mapInArrow(read_line_sets, "doc_id long, cluster long, items binary")
    found = components(verified_links(items, cluster, percent, spent=[wanted]), "links").select(
        F.col("node").alias("pid"), F.col("component").alias("group"))

    grouped = storage.cut(classes.join(found, "pid", "left").where("group is not null or n > 1").select(
        "h1", "h2", F.coalesce("group", "pid").alias("group")), "grouped")
    storage.drop(classes)
    return slim.join(grouped, ["h1", "h2"]).select(
        "doc", "th", "line", "last", "group")


def repeated_lines(members: DataFrame) -> DataFrame:
    """``repeated_paragraphs`` -> ``doc, th, line``: the lines that go."""
    members = storage.cut(members, "repeats")
    place = F.struct("doc", "th", "line", "last")
    kept = storage.cut(members.groupBy("group").agg(F.min(place).alias("kept")), "kept")
    own = F.sequence("line", "last")
    same = F.expr("doc = kept.doc and th = kept.th")
    gone = F.when(same, F.array_except(own, F.sequence("kept.line", "kept.last"))).otherwise(own)
    return (members.join(storage.bounded(kept, MAX_BROADCAST), "group").where(place != F.col("kept"))
            .select("doc", "th", F.explode(gone).alias("line")).distinct())


def without_lines(min_words: int):
    """Task code: (doc_id, text, removed) -> (doc_id, n_paragraphs, removed, text)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            _, offs = tokens.text_bytes(batch.column("text"))
            for i, j in tokens.chunks(offs):
                part = batch.slice(i, j - i)
                buf, local = tokens.text_bytes(part.column("text"))
                at, doc = lines_of(buf, local)
                first, _ = runs_of(word_edges(buf, at), doc, min_words)
                texts, removed = part.column("text"), part.column("removed")
                changed = np.asarray(removed.value_lengths()) > 0
                if changed.any():
                    kept = []
                    for k in np.flatnonzero(changed):
                        gone = set(removed[k].as_py())
                        kept.append("\n".join(x for n, x in enumerate(texts[k].as_py().split("\n")) if n not in gone))
                    texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(kept, texts.type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.bincount(doc[first], minlength=j - i)), removed, texts],
                    names=["doc_id", "n_paragraphs", "removed", "text"])
    return run


def dedup_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text`` without its repeated paragraphs,
    ``n_paragraphs`` and the numbers of the removed lines (from 0)."""
    with storage.released() as made:
        gone = storage.cut(repeated_lines(repeated_paragraphs(docs, percent, min_words)).groupBy("doc", "th")
                           .agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")   # lines of one document
        made.remove(gone._shared_path)
    rows = _keyed(docs).join(storage.bounded(gone, MAX_ELEMENTS, F.size("removed")), ["doc", "th"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text",
        F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))
    return rows.mapInArrow(without_lines(min_words), "doc_id long, n_paragraphs long, removed array<int>, text string")
