"""Operator 7: repeated substrings by interval expansion on a Burrows-Wheeler transform.

Every byte that some ``length``-byte string covers which also starts anywhere
else (in any document, overlaps included) is removed.  Strings never cross
documents, and all are judged on the input.

1. *Runs.*  The key of a window of ``length`` bytes is the smallest hash of its
   ``GRAM``-byte pieces, so equal windows have equal keys, and consecutive
   windows with the same smallest piece are one run.  One pass over the texts
   gives each run its key and a hash of its bytes (about one run per 56 bytes).
2. Only keys that occur twice can hold a repeated window.  Of these, equal runs
   are one segment with a multiplicity: copies are counted, not compared.
3. *Blocks.*  The bytes of each distinct segment go to the task of its key.
   Whole keys are joined into blocks of bounded size; a block's suffix array
   (prefix doubling) gives its Burrows-Wheeler transform.  Common prefixes are
   derived by increasing value: from the intervals of level v, backward
   extension by one byte gives the borders of level v + 1, breadth first, each
   border once; at ``length`` the expansion stops.  Suffixes without a border
   between them share ``length`` bytes; a window whose group has a total
   multiplicity of two or more is repeated.
   A key with more than ``max_segments`` distinct segments is not put into one
   task: its windows are hashed one by one and counted by a distributed
   aggregate instead (same result, more rows).
4. Repeated windows go back to all runs of their segment, are merged into spans
   per document, and cut out of the bytes.

Cases: a null or empty text has no bytes.  Texts shorter than ``length`` are
kept whole.  Rows that share a doc_id are told apart by their text; rows that
share both are copies of each other, so all their windows are repeated.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, storage, tokens
from textcards.llm.paragraph_dedup import _keyed

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 1 << 19
MAX_SEGMENTS = 12_000
POSITION_BITS = 24
PIECE = 1 << 22              # bytes of a very long text taken at once
MAX_KEYS = 2_000_000         # repeated keys sent to every executor (16 bytes each)
MAX_DOCUMENTS = 500_000
RUN_BITS = 40                # runs of one input partition: 2**40

_R = 0x9E3779B97F4A7C15
_LETTER = tokens.mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on (gram: a power of two)."""
    h, m = _LETTER[x], 1
    while m < gram:
        h = h[:-m] * np.uint64(pow(_R, m, 1 << 64)) + h[m:]
        m *= 2
    return tokens.mix(h)


def runs_of(x: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(start, windows, key, hash of the bytes) of the runs in a buffer of
    texts; ``ends[p]`` is the end of the text that holds byte p."""
    n = len(x) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    h = gram_hashes(x, gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    wide, k = length - gram + 1, 1
    while 2 * k <= wide:
        best = np.minimum(best[:-k], best[k:])
        k *= 2
    if wide > k:
        best = np.minimum(best[:k - wide], best[wide - k:])
    at = (best & low).astype(np.int64)
    at[ends[:n] - np.arange(n) < length] = -1          # the window would cross the end
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(start, n))
    real = at[start] >= 0
    start, count = start[real], count[real]
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tokens._powers(_R, len(h)), dtype=np.uint64)])
    back = tokens._powers(pow(_R, -1, 1 << 64), len(h))
    body = tokens.mix((acc[start + count + wide - 1] - acc[start]) * back[start] + count.astype(np.uint64))
    return start, count, h[at[start]], body


def text_runs(buf, offs, length: int, gram: int):
    """(document, start in it, windows, key, body hash) of a batch's texts."""
    for i, j in tokens.chunks(offs):
        part, local = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        if j - i > 1 or len(part) <= 2 * PIECE:
            ends = np.repeat(local[1:], np.diff(local))
            start, count, key, body = runs_of(part, ends, length, gram)
            doc = np.searchsorted(local, start, side="right") - 1
            yield doc + i, start - local[doc], count, key, body
            continue
        for a in range(0, len(part), PIECE):            # windows that start in [a, a + PIECE)
            x = part[a:a + PIECE + length - 1]
            start, count, key, body = runs_of(x, np.full(len(x), len(x)), length, gram)
            yield np.full(len(start), i), start + a, count, key, body


def read_runs(length: int, gram: int):
    """Task code: (doc, th, text) -> its runs."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << RUN_BITS
        for batch in batches:
            buf, offs = tokens.text_bytes(batch.column("text"))
            for doc, start, count, key, body in text_runs(buf, offs, length, gram):
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + len(doc))), batch.column("doc").take(take), batch.column("th").take(take),
                     pa.array(start), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)),
                     pa.array(body.view(np.int64))], names=["run", "doc", "th", "start", "n", "key", "body"])
                number += len(doc)
    return run


def cut_segments(length: int):
    """Task code: (text, wanted runs) -> the bytes of each wanted run."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            buf, offs = tokens.text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), np.array(wanted.value_lengths()))
            w = wanted.flatten()
            a = offs[row] + np.array(w.field("start"))
            b = a + np.array(w.field("n")) + length - 1
            at = np.concatenate([[0], np.cumsum(b - a)])
            for i, j in tokens.chunks(at):
                size = np.diff(at[i:j + 1])
                index = np.repeat(a[i:j] - (at[i:j] - at[i]), size) + np.arange(at[j] - at[i])
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at[i:j + 1] - at[i]).astype(np.int32).tobytes()),
                                                                  pa.py_buffer(buf[index].tobytes())])
                yield pa.RecordBatch.from_arrays([w.field(c).slice(i, j - i) for c in ("key", "body", "copies")] + [data],
                                                 names=["key", "body", "copies", "bytes"])
    return run


def suffix_array(x: np.ndarray, depth: int):
    """(suffix array by at least ``depth`` symbols, borders of level v,
    borders of level v - 1, v): a border lies before a suffix that differs from
    its predecessor within that many symbols."""
    letters = np.unique(x)
    code = np.zeros(int(letters[-1]) + 1, np.uint64)
    code[letters] = np.arange(1, len(letters) + 1)
    bits = int(len(letters)).bit_length()
    v = 63 // bits
    x = code[x]
    n = len(x)
    key = np.zeros(n, np.uint64)
    for i in range(v):
        key <<= np.uint64(bits)
        key[:n - i] |= x[i:]
    sa = np.argsort(key)
    key = key[sa]

    def borders(k):
        return np.concatenate(([True], k[1:] != k[:-1]))

    first, before = borders(key), borders(key >> np.uint64(bits))
    cut = first.copy()
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
    k = v
    while k < depth:
        open_ = ~(cut & np.append(cut[1:], True))        # suffixes not alone in their group
        u = np.flatnonzero(open_)
        if not len(u):
            break
        p = sa[u]
        nxt = np.where(p + k < n, rank[np.minimum(p + k, n - 1)] + 1, 0)
        key = (rank[p].astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        o = np.argsort(key)
        p, key = p[o], key[o]
        sa[u] = p
        cut[u] = borders(key)
        rank[p] = np.maximum.accumulate(np.where(cut[u], u, 0))
        k *= 2
    return sa, first, before, v


def expand(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, borders): suffixes without a border between them share
    at least ``length`` symbols."""
    sa, border, before, level = suffix_array(x, length + 1)
    if level >= length:
        raise ValueError("length is too small for the packed start")
    n = len(x)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    back = place[sa - 1]                                 # where backward extension leads (the BWT's LF mapping)
    ahead = place[np.minimum(sa + 1, n - 1)]
    same = ahead[np.maximum(back - 1, 0)]                # the previous suffix with the same byte before it
    same[sa == 0] = -1                                   # nothing stands before the text
    every = np.append(np.flatnonzero(border), n)
    new = np.flatnonzero(border & ~before)
    size = every[np.searchsorted(every, new, side="right")] - new     # up to the next border
    while level < length and len(new):
        end = np.cumsum(size)
        j = np.repeat(new - end + size, size) + np.arange(end[-1])
        first = same[j] < np.repeat(new, size)           # the first suffix with its byte behind the border
        # suffixes with the same byte before them lead to neighbours: sorted, each run begins at a first
        run = np.sort((back[j].astype(np.int64) << 1) | first)
        head = np.flatnonzero(run & 1)
        new, size = run[head] >> 1, np.diff(np.append(head, len(run)))
        fresh = ~border[new]
        new, size = new[fresh], size[fresh]
        border[new] = True
        level += 1
    return sa, border


def repeated_windows(segments: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Per segment a mask over its windows: which occur at least twice."""
    size = np.array([len(s) for s in segments])
    x = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    base = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(base[-1], np.int64)                  # a zero ends each segment
    text[np.arange(len(x)) + np.repeat(np.arange(len(size)), size)] = x
    sa, border = expand(text, length)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(border) - 1
    n = size - length + 1
    at = np.repeat(base[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    weight = np.bincount(group[at], weights=np.repeat(copies, n), minlength=int(border.sum()))
    return np.split(weight[group[at]] >= 2, np.cumsum(n)[:-1])


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = "array<struct<a:long,b:long>>"


def solve_blocks(length: int, block_bytes: int):
    """Task code: segments sorted by key -> spans of repeated windows."""
    def run(batches):
        import pyarrow as pa

        def solve(rows):
            masks = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows], float), length)
            spans = [spans_of(m) for m in masks]
            at = np.cumsum([0, *map(len, spans)]).astype(np.int32)
            flat = np.array([s for x in spans for s in x], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(
                     [pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"]))], names=["key", "body", "spans"])

        rows, held, key = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "copies", "bytes")), strict=True):
                if r[0] != key and held >= block_bytes:
                    yield solve(rows)
                    rows, held = [], 0
                key = r[0]
                rows.append(r)
                held += len(r[3])
        if rows:
            yield solve(rows)
    return run


def hash_windows(length: int):
    """Task code: segments -> a hash of every window (for keys of many segments)."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for key, body, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "copies", "bytes")), strict=True):
                x = np.frombuffer(raw, np.uint8)
                n, out = len(x) - length + 1, []
                for base in (_R, 0xD6E8FEB86659FD93):
                    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[x] * tokens.powers(len(x), base), dtype=np.uint64)])
                    back = tokens.powers(n, pow(base, -1, 1 << 64))
                    out.append(tokens.mix((acc[length:] - acc[:n]) * back).view(np.int64))
                same = [pa.array(np.full(n, v, np.int64)) for v in (key, body, copies)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), *map(pa.array, out)],
                                                 names=["key", "body", "copies", "at", "w1", "w2"])
    return run


def merge_spans(length: int):
    """Task code: (doc, th, window spans of its runs) -> byte spans, merged."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column("found")
            row = np.repeat(np.arange(batch.num_rows), np.array(lists.value_lengths()))
            f = lists.flatten()
            a, b = np.array(f.field("a")), np.array(f.field("b")) + length - 1
            o = np.lexsort((a, row))
            row, a, b = row[o], a[o], b[o]
            far = int(b.max(initial=0)) + 1               # rows apart on one axis
            reach = np.maximum.accumulate(b + row * far)
            new = np.ones(len(a), bool)
            new[1:] = (a + row * far)[1:] > reach[:-1]
            new[1:] |= row[1:] != row[:-1]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(a)) - 1 if len(head) else head
            spans = pa.StructArray.from_arrays([pa.array(a[head]), pa.array(reach[tail] - row[tail] * far)], names=["a", "b"])
            at = pa.array(np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.ListArray.from_arrays(at, spans)],
                                             names=["doc", "th", "spans"])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
                   max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """``docs (doc_id, text)`` -> ``doc, th, spans``: the bytes to remove of every
    document (``doc``: its id, ``th``: a hash of its text) that has any."""
    ship("textcards.llm.tokens", __name__)
    texts = _keyed(docs)
    runs = storage.cut(texts.mapInArrow(
        read_runs(length, gram), "run long, doc long, th long, start long, n int, key long, body long"), "runs")
    keys = storage.cut(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    some = storage.cut(runs.join(storage.bounded(keys, MAX_KEYS), "key", "left_semi"), "candidates")
    storage.drop(runs, keys)

    segments = storage.cut(some.groupBy("key", "body").agg(F.count("*").alias("copies"), F.min("run").alias("run")), "segments")
    many = storage.cut(segments.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > max_segments).select("key"), "many")
    wanted = (segments.select("run", "copies").join(some, "run").groupBy("doc", "th")
              .agg(F.collect_list(F.struct("start", "n", "key", "body", "copies")).alias("wanted")))   # runs of one document
    wanted = storage.cut(wanted, "wanted")
    named = wanted.select("doc", "th")
    if wanted.count() <= MAX_DOCUMENTS:
        texts_in = texts.join(F.broadcast(named), ["doc", "th"], "left_semi")
    else:
        texts_in = texts
    texts_in = texts_in.join(wanted.hint("merge"), ["doc", "th"]).select("text", "wanted")
    bytes_ = texts_in.mapInArrow(cut_segments(length), "key long, body long, copies long, bytes binary")
    dense = not many.isEmpty()
    if dense:
        bytes_ = storage.cut(bytes_, "bytes")
    plain = bytes_.join(storage.bounded(many, MAX_KEYS), "key", "left_anti") if dense else bytes_
    spans = plain.repartition("key").sortWithinPartitions("key").mapInArrow(
        solve_blocks(length, block_bytes), f"key long, body long, spans {SPANS}")
    spans = spans.select("key", "body", F.explode("spans").alias("s")).select("key", "body", "s.a", "s.b")
    if dense:
        windows = bytes_.join(storage.bounded(many, MAX_KEYS), "key", "left_semi").mapInArrow(
            hash_windows(length), "key long, body long, copies long, at long, w1 long, w2 long")
        twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("c")).where("c > 1").select("w1", "w2")
        spans = spans.unionByName(windows.join(twice, ["w1", "w2"]).select(
            "key", "body", F.col("at").alias("a"), (F.col("at") + 1).alias("b")))
    spans = storage.cut(spans.distinct() if dense else spans, "spans")
    found = some.join(spans, ["key", "body"]).groupBy("doc", "th").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("found"))  # of one document
    out = storage.cut(found.mapInArrow(merge_spans(length), f"doc long, th long, spans {SPANS}"), "merged")
    storage.drop(some, segments, many, wanted, spans, *([bytes_] if dense else []))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, spans`` (maximal removed
    runs of bytes) and ``kept`` (the remaining bytes, joined)."""
    from textcards.llm.paragraph_dedup import NO_ID
    spans = repeated_spans(docs, length, **kw)
    df = _keyed(docs).join(storage.bounded(spans, MAX_DOCUMENTS), ["doc", "th"], "left")
    raw = F.col("text").cast("binary")
    df = df.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), raw.alias("raw"),
                   F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))
    size = F.octet_length("raw").cast("long")
    # what lies between the spans: from the end of one to the start of the next
    edge = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    zero = F.lit(0).cast("long")
    gaps = F.zip_with(F.concat(F.array(zero), F.col("spans")["b"]), F.concat(F.col("spans")["a"], F.array(size)), edge)
    df = df.withColumn("gaps", gaps)
    kept = F.aggregate("gaps", F.lit(b"").cast("binary"), lambda acc, g: F.concat(
        acc, F.substring(F.col("raw"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    removed = F.aggregate("spans", zero, lambda acc, s: acc + s["b"] - s["a"])
    return df.select("doc_id", size.alias("n_bytes"), removed.alias("n_removed"), "spans",
                     F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept).alias("kept"))
