"""Operator 4: benchmark decontamination with suffix arrays of the training text.

A *window* is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Each task takes its training documents in shards
of a few megabytes: it replaces words by their numbers in the vocabulary of the
test items, sorts the suffixes that can start a window (their first words
start some window) into a suffix array, and binary-searches every test suffix
in it, word by word.  The interval that is left after a whole window holds all
its verbatim occurrences; matches that go on along the same diagonal are
joined into the longest ones.  Documents never leave their rows and nothing is
shuffled: the test items go to the documents.

The items are tokenised by Spark and written to the shared folder in blocks of at
most ``block_words`` words (an id counts like the words that take its room).  An
item beyond that is cut into pieces that overlap by a window less one word, so each
window lies in exactly one, and matches that go on in the next piece are joined
again.  A block goes to the tasks as hashes, which build its tables; the driver
holds one at a time.  A benchmark of several blocks makes as many passes, each over
what the earlier one wrote, adding to what it found; no item is left out.

Cases: an item of any length is searched whole.  Null or empty texts have no words and match nothing, as documents and
as items.  A null item_id is written as the empty string.  Items of one id
count once.  Rows are judged one by one, so repeated rows and ids get equal
results.  Empty tables give empty results or no matches.  Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, storage, tokens

WINDOW = 10
LEAD = 3                     # words that choose the suffixes of the array
BLOCK_WORDS = 1_000_000      # words of test items sent at once (8 MB of hashes)
MAX_BLOCK_WORDS = (1 << 21) - 2          # word numbers of a block are packed in 21 bits
PIECE = "item_id string, place int, cut boolean, words binary"

MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"
FOUND = f"n_words bigint, hits array<struct<start:int,end:int>>, items array<string>, matches {MATCH}"


class Block:
    """Test items on their way to the tasks: ids, places of pieces, hashes of all words."""

    def __init__(self, rows, window: int):
        h = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.ids = [r["item_id"] or "" for r in rows]
        self.at = np.array([r["place"] for r in rows], np.int64)
        self.cut = {r["item_id"] or "" for r in rows if r["cut"]}
        self.first = np.cumsum([0, *map(len, h)])
        self.words = np.concatenate([*h, np.zeros(0, np.uint64)])
        self.window = window


class TestItems:
    """The tables of a block: vocabulary, windows, and which items hold them."""

    def __init__(self, block: Block):
        self.window = window = block.window
        self.vocab = np.unique(block.words)
        number = np.append(np.searchsorted(self.vocab, block.words) + 1, 0).astype(np.int32)
        size = np.diff(block.first)
        need = np.minimum(size, window)
        n = np.where(need > 0, size - need + 1, 0)
        item = np.repeat(np.arange(len(size)), n)
        s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        reach = np.arange(window)
        word = np.minimum((block.first[item] + s)[:, None] + reach, len(number) - 1)
        table = np.where(reach < need[item][:, None], number[word], 0).astype(np.int32)
        at = s + block.at[item]
        # equal windows are one test suffix; holders[first[w]:first[w+1]] are their items
        self.suffixes, which = np.unique(table, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        self.need = (self.suffixes > 0).sum(1)
        self.first = np.searchsorted(which[order], np.arange(len(self.suffixes) + 1))
        self.holder, self.place = item[order], at[order]
        self.leads = {n: np.unique(self.lead(self.suffixes[np.minimum(self.need, LEAD) == n], n))
                      for n in range(1, LEAD + 1)}

    @staticmethod
    def lead(rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for i in range(n):
            out = (out << 21) | rows[:, i]
        return out

    def candidates(self, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions of the shard where some window may begin."""
        found = []
        for n, known in self.leads.items():
            if not len(known) or len(number) < n:
                continue
            m = len(number) - n + 1
            ok = number[:m] > 0
            for i in range(1, n):
                ok &= (number[i:m + i] > 0) & (doc[i:m + i] == doc[:m])
            p = np.flatnonzero(ok)
            key = self.lead(number[p[:, None] + np.arange(n)].reshape(-1, n), n)
            k = np.searchsorted(known, key)
            found.append(p[known[np.minimum(k, len(known) - 1)] == key])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, number: np.ndarray, doc: np.ndarray):
        """(test suffix, position) of every occurrence of every window."""
        p = self.candidates(number, doc)
        if not len(p):
            return np.zeros(0, np.int64), p
        at = p[:, None] + np.arange(self.window)
        inside = np.minimum(at, len(number) - 1)
        word = np.where((at < len(number)) & (doc[inside] == doc[p][:, None]), number[inside], 0)
        order = np.lexsort(word.T[::-1])           # the suffix array, to the depth of a window
        p, word = p[order], word[order]
        rank = np.zeros(len(p), np.int64)
        at = np.zeros(len(self.suffixes), np.int64)          # each test suffix's interval, as a rank
        alive = np.ones(len(self.suffixes), bool)
        out_w, out_p = [], []
        for d in range(self.window):
            key = (rank << 21) | word[:, d]
            want = (at << 21) | self.suffixes[:, d]
            lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            alive &= (self.suffixes[:, d] > 0) & (hi > lo)
            rank = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
            at = rank[np.minimum(lo, len(rank) - 1)]
            whole = np.flatnonzero(alive & (self.need == d + 1))
            n = (hi - lo)[whole]
            out_w.append(np.repeat(whole, n))
            out_p.append(p[np.repeat(lo[whole] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo[whole], n)
                           + np.arange(n.sum())])
        return np.concatenate(out_w), np.concatenate(out_p)


def _lists(doc: np.ndarray, n: int, values):
    import pyarrow as pa
    at = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, values)


def _per_row(lists, n):
    """(row, values) of an Arrow list column."""
    size = np.array(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(n), size), lists.flatten()


def _joined(matches: list[dict], cut: set[str], window: int) -> list[dict]:
    """Matches of items that were cut, joined where one goes on in the next piece."""
    out, last = [m for m in matches if m["item_id"] not in cut], None
    for m in sorted((m for m in matches if m["item_id"] in cut), key=lambda m: (m["item_id"], m["doc_word"] - m["item_word"], m["doc_word"])):
        if last and m["item_id"] == last["item_id"] and m["doc_word"] - m["item_word"] == last["doc_word"] - last["item_word"] \
                and m["doc_word"] == last["doc_word"] + last["n_words"] - window + 1:
            last["n_words"] += m["n_words"] - window + 1
        else:
            last = dict(m)
            out.append(last)
    return out


def scan(sent: Block, keep: list[str], text: str):
    """Task code: adds what this block's items match to what is known so far."""
    def run(batches):
        import pyarrow as pa
        block, ids = TestItems(sent), np.array([*sent.ids, ""], dtype=object)[:-1]
        for batch in (x for b in batches for x in tokens.slices(b, text)):
            n = batch.num_rows
            buf, offs = tokens.text_bytes(batch.column(text))
            numbers, docs = [], []
            for i, j in tokens.chunks(offs):
                h, d = tokens.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], tokens.ALNUM)
                k = np.searchsorted(block.vocab, h)
                known = np.append(block.vocab, np.uint64(0))[k] == h
                numbers.append(np.where(known & (k < len(block.vocab)), k + 1, 0))
                docs.append(d + i)
            number, doc = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (numbers, docs))
            start = np.searchsorted(doc, np.arange(n + 1))
            w, p = block.search(number, doc)

            mark = np.zeros(len(number) + 1, np.int64)
            np.add.at(mark, p, 1)
            np.add.at(mark, p + block.need[w], -1)
            row, old = _per_row(batch.column("hits"), n)
            if len(row):
                np.add.at(mark, start[row] + np.array(old.field("start")), 1)
                np.add.at(mark, start[row] + np.array(old.field("end")), -1)
            hit = np.concatenate(([False], np.cumsum(mark[:-1]) > 0, [False]))
            edge = np.zeros(len(number) + 1, bool)
            edge[start] = True
            up = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))[:]
            up = up[up < len(number)]
            down = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
            runs = pa.StructArray.from_arrays(
                [pa.array((up - start[doc[up]]).astype(np.int32)),
                 pa.array((down - start[doc[up]]).astype(np.int32))], names=["start", "end"])

            # occurrences by item, joined along diagonals into the longest matches
            size = block.first[w + 1] - block.first[w]
            k = np.repeat(block.first[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pos, item, place = np.repeat(p, size), block.holder[k], block.place[k]
            width = np.repeat(block.need[w], size)
            o = np.lexsort((pos, pos - place, item, doc[pos])) if len(pos) else np.zeros(0, np.int64)
            pos, item, place, width = pos[o], item[o], place[o], width[o]
            new = np.ones(len(pos), bool)
            if len(pos) > 1:
                new[1:] = (pos[1:] != pos[:-1] + 1) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(pos)) - 1 if len(head) else head
            length = pos[tail] + width[tail] - pos[head]
            row_old, old = _per_row(batch.column("matches"), n)
            old = old.to_pylist()
            row_new = doc[pos[head]]
            new_matches = [{"item_id": i, "item_word": int(a), "doc_word": int(b), "n_words": int(c)} for i, a, b, c in
                           zip(ids[item[head]], place[head], pos[head] - start[row_new], length, strict=True)]
            rows = np.concatenate([row_old, row_new]).astype(np.int64)
            o = np.argsort(rows, kind="stable")
            both = old + new_matches
            both = [both[x] for x in o]
            rows = rows[o]
            if sent.cut:
                whole = [(k, m) for k in np.unique(rows) for m in _joined(
                    both[np.searchsorted(rows, k):np.searchsorted(rows, k, "right")], sent.cut, block.window)]
                rows, both = np.array([k for k, _ in whole], np.int64), [m for _, m in whole]
            matches = _lists(rows, n, pa.array(both, pa.struct(
                [("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])))
            named = sorted({*zip(row_old.tolist(), (m["item_id"] for m in old), strict=True),
                            *zip(row_new.tolist(), (m["item_id"] for m in new_matches), strict=True)})
            items = _lists(np.array([x[0] for x in named], np.int64), n, pa.array([x[1] for x in named], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(start)), _lists(doc[up], n, runs), items, matches],
                names=[*keep, "n_words", "hits", "items", "matches"])
    return run


def _pieces(window: int, most: int):
    """Task code: the words of every item that has some, in pieces of at most ``most``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                h = tokens.words(raw, np.array([0, len(raw)]), tokens.ALNUM)[0]
                for a in range(0, max(len(h) - window + 1, min(len(h), 1)), most - window + 1):
                    yield pa.RecordBatch.from_pydict({
                        "item_id": pa.array([item_id], pa.string()), "place": pa.array([a], pa.int32()),
                        "cut": [len(h) > most], "words": pa.array([h[a:a + most].astype(np.uint64).tobytes()], pa.binary())})
    return run


def _numbered(most: int):
    """Task code: the task's items dealt to blocks, whose names hold the partition's number."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, k, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            name = []
            for item_id, words in zip(batch.column("item_id").to_pylist(), batch.column("words"), strict=True):
                size = words.as_buffer().size // 8
                room = size + len(item_id or "") // 8 + 4
                if held and held + room > most:
                    k, held = k + 1, 0
                held += room
                name.append(f"{part}-{k}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string())], names=[*batch.schema.names, "block"])
    return run


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """(number of blocks, the blocks one by one, read from the shared folder)."""
    if not window <= block_words <= MAX_BLOCK_WORDS:
        raise ValueError(f"block_words must lie between the window and {MAX_BLOCK_WORDS}")
    items = storage.cut(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        _pieces(window, block_words), PIECE), "benchmark-words")
    room = F.sum(F.floor(F.length("words") / 8) + F.floor(F.length(F.coalesce("item_id", F.lit(""))) / 8) + 4)
    total = items.agg(F.coalesce(room, F.lit(0))).first()[0]
    path = storage.scratch(benchmark.sparkSession, "benchmark-blocks")
    items.coalesce(max(1, -(-total // block_words))).mapInArrow(_numbered(block_words), PIECE + ", block string") \
        .write.partitionBy("block").parquet(path)
    storage.drop(items)
    stored = benchmark.sparkSession.read.schema(PIECE + ", block string").parquet(path)
    names = [r[0] for r in stored.select("block").distinct().collect()]

    def each():
        for name in names:
            yield Block(stored.where(F.col("block") == name).collect(), window)
        if not names:
            yield Block([], window)
        storage.drop(path)

    return max(1, len(names)), each()


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """(DataFrame, names of the kept columns in it).

    The kept columns of ``docs`` come back as ``k0, k1, ...`` beside ``n_words``,
    ``hits`` (runs of hit words), ``items`` (ids of matching items, sorted as
    strings) and ``matches`` (longest verbatim matches with their places)."""
    ship("textcards.llm.tokens", __name__)
    names = ["k%d" % i for i in range(len(keep))]
    kinds = [f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, names, strict=True)]
    text = names[keep.index("text")] if "text" in keep else "text"
    out = docs.select(*(docs[c].alias(k) for c, k in zip(keep, names, strict=True)),
                      *([] if "text" in keep else [docs["text"].alias("text")]),
                      F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"),
                      F.expr("cast(array() as array<string>)").alias("items"),
                      F.expr(f"cast(array() as {MATCH})").alias("matches"))
    count, blocks = _blocks(benchmark, window, block_words)
    before = None
    for i, block in enumerate(blocks):
        more = [] if text in names or i == count - 1 else ["text"]
        out = out.mapInArrow(tokens.trimmed(scan(block, [*names, *more], text)), ", ".join([*kinds, *("text string" for _ in more), FOUND]))
        if i < count - 1:
            out = storage.cut(out.drop("n_words"), "decontamination")
            if before is not None:
                storage.drop(before)
            before = out
    return out, names


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (``find_contamination``
    also has the longest matches and their places)."""
    found, (k,) = find_contamination(docs, benchmark, ["doc_id"], **kw)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(F.col(k).alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that hold a window of some item."""
    found, names = find_contamination(docs, benchmark, docs.columns, **kw)
    return found.where(F.size("hits") == 0).select(*(F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)))
