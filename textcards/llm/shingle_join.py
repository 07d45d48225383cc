"""Operator 10: n-gram Jaccard self join through an R-tree over count vectors.

A document is the set of its distinct word shingles.  Two documents link when
their Jaccard similarity reaches a threshold (exactly, in integers).

1. *Sets.*  One pass over the texts gives each document the size and a 128-bit
   hash of its set.  Documents of equal sets are one class, which its smallest
   doc_id represents: copies are never expanded into pairs.
2. *Lossless partition.*  Only representatives go on, in two steps.
   a. Sets are ordered by hash.  Two sets that link overlap so much that their
      prefixes, as long as a set may lack of a partner and ``SHARED`` percent of
      it more, have about that many elements in common.  A set that shares
      fewer elements of its prefix with others has no link and goes.
   b. The sets left are cut by hash range into P parts, where linked sets differ
      in at most d elements and P exceeds d by 1 + spare; so they agree in more
      than ``spare`` parts.  Empty parts may be left out up to that number (a
      set with more is cut anew by another hash), a set that shares fewer parts
      goes, and parts that very many sets share, as those of a common line, may
      be left out as well.  What is left ties the sets that share a part into
      clusters (a star to the smallest, then connected components).
   A link never leaves its cluster.
3. *R-tree.*  Within a cluster the shingles are hashed into groups; a
   document is the point of its group counts.  The points are packed into a
   tree of bounding boxes.  A probe descends only where the summed coordinate
   minima of the point and the box's upper corner can still reach the needed
   overlap, and surviving pairs are verified on the exact sets.  Pairs that
   are already connected are not verified again; a spanning forest of
   verified links leaves the task.
   A cluster beyond ``max_cluster`` sets is cut by set size, and where that
   does not do, dealt as pairs of blocks, one task each; so no task holds an
   unbounded group, and every pair of sets that can link meets in one of them.
4. Components of the verified links.

Cases: null or empty texts and texts without words have an empty set, link
with nothing and are a component of their own.  Rows that share a doc_id are
one node.  A null doc_id links with nothing and has a null component.
Repeated rows are all returned.  An empty table gives an empty result.  Other
columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcards.llm import ship, storage, tokens
from textcards.llm.components import components

GROUPS = 64          # coordinates of a point
FANOUT = 16          # points of a leaf, children of a node
MAX_CLUSTER = 1500   # sets compared in one task
BLOCK = 750          # sets of a block of a larger cluster
FEW = 64             # sets of so many items together are all compared at once
FEW_ITEMS = 1 << 13
BATCH_ROWS = 256     # rows of an Arrow batch that a task returns
SHARED = 10          # percent of a set that linked prefixes have in common at least
STEP = 1.5           # ratio of the size classes of the parts
HOT_PART = 64        # a part of more sets than this is weak: it selects little
WEAK_SHARE = 0.1     # parts (of all of a set) added so that weak ones may be left out
ROUNDS = 6           # partitions tried before empty parts count as common ones
TAGS = 256           # at least ROUNDS for each class a set is in
MAX_BROADCAST = 500_000   # rows of (doc_id, cluster) sent to every executor


def common(n: int, percent: int) -> int:
    """Elements that the prefix of a set of n has in common with that of every
    set it links with, whose size is at least ``percent`` of n."""
    return max(1, SHARED * -(-percent * n // 100) // 100)


def prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a sorted set: as many as it may lack of a partner
    (it shares at least ``percent`` of its elements with one) and those that
    are to be in common."""
    n = len(s)
    return s[:n - -(-percent * n // 100) + max(1, SHARED * n // 100)]


def class_upper(c: int) -> int:
    return int(STEP ** (c + 1)) + c


def size_class(n: int, percent: int) -> list[int]:
    """The class of a set of n elements, and those up to its largest partner's."""
    c = 0
    while n > class_upper(c):
        c += 1
    out = [c]
    while n * 100 // percent > class_upper(out[-1]):
        out.append(out[-1] + 1)
    return out


def class_parts(c: int, percent: int) -> tuple[int, int]:
    """(parts P of a class, spare ones); P = 0: no two different sets of the
    class link."""
    u = class_upper(c)
    d = (100 - percent) * 2 * u // (100 + percent)
    if d == 0:
        return 0, 0
    spare = 1
    for _ in range(20):      # parts grow with the spare ones, so settle both
        p = d + 1 + spare
        low = u / STEP       # the smallest sets of the class have most empty parts
        empty = p * np.exp(-low / p)
        want = int(np.ceil(empty + 3 * np.sqrt(empty) + p * WEAK_SHARE)) + 1
        if want <= spare:
            break
        if want > p // 2:    # tiny sets: all parts count, empty ones too
            return d + 1, 0
        spare = want
    return d + 1 + spare, spare


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the parts of one set, their tags), for each class it may meet.

    Two sets that link agree in more parts than ``spare``; if either has at
    most ``spare`` empty parts, they share a non-empty one.  If both have
    more, both go on to another partition of the same kind.  A tag is
    ``TAGS * budget + partition``: the budget is how many more parts of that
    partition the set may leave out with that still true."""
    sigs, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k, c in enumerate(size_class(len(s), percent) if len(s) else []):
        p, spare = class_parts(c, percent)
        for again in range(ROUNDS if p else 0):
            t = np.sort(tokens.mix(s ^ np.uint64(again))) if again else s
            part = ((t >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
            at = np.searchsorted(part, np.arange(p, dtype=np.uint64))
            acc = np.zeros(len(t) + 1, np.uint64)
            np.cumsum(tokens.mix(t), out=acc[1:])
            end = np.append(at[1:], len(t))
            tag = tokens.mix(np.arange(p, dtype=np.uint64) + np.uint64((c + 1) * ROUNDS + again << 32))
            sig = tokens.mix((acc[end] - acc[at]) ^ tag)
            full = end > at
            empty = int(p - full.sum())
            if again == ROUNDS - 1 and empty > spare:
                full[:], empty = True, 0
            sigs.append(sig[full])
            tags.append(np.full(full.sum(), TAGS * max(0, spare - empty) + k * ROUNDS + again, np.int32))
            if empty <= spare:
                break
    return np.concatenate(sigs), np.concatenate(tags)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = tokens.mix(s), tokens.mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def read_sets(n: int, percent: int, want_set: bool):
    """Task code: (doc_id, text) -> sizes, hashes and prefixes, or whole sets and their parts."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            buf, offs = tokens.text_bytes(batch.column("text"))
            for i, j in tokens.chunks(offs):
                rows = list(tokens.shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], tokens.NON_SPACE, n))
                if want_set:
                    sig = [signatures(s, percent) for s in rows]
                    at = pa.array(np.cumsum([0, *(len(x) for x, _ in sig)]).astype(np.int32))
                    parts, tags = (np.concatenate([x[k] for x in sig]) for k in (0, 1))
                    out = pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, j - i), pa.array([s.tobytes() for s in rows], pa.binary()),
                         pa.ListArray.from_arrays(at, pa.array(parts.view(np.int64))),
                         pa.ListArray.from_arrays(at, pa.array(tags))], names=["doc_id", "items", "parts", "tags"])
                else:
                    h = [set_hash(s) for s in rows]
                    first = [prefix(s, percent) for s in rows]
                    at = pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32))
                    out = pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in rows], pa.int64()),
                         pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()),
                         pa.ListArray.from_arrays(at, pa.array(np.concatenate(first).view(np.int64)))],
                        names=["doc_id", "n_shingles", "h1", "h2", "prefix"])
                yield out
    return run


class CountTree:
    """R-tree over group-count points, packed bottom up, probed from the top."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, order = percent, self._pack(counts, sizes)
        self.order = order
        self.points, self.sizes = counts[order], sizes[order]
        self.levels = []         # from the leaves up: (upper corners, smallest size, largest size)
        hi, small, large = self.points, self.sizes, self.sizes
        while len(hi) > 1:
            at = np.arange(0, len(hi), FANOUT)
            hi, small, large = (np.maximum.reduceat(hi, at), np.minimum.reduceat(small, at),
                                np.maximum.reduceat(large, at))
            self.levels.append((hi, small, large))

    @staticmethod
    def _pack(counts, sizes) -> np.ndarray:
        """Order of the points: halved again and again along the widest coordinate."""
        full = np.column_stack([sizes, counts])
        todo, done = [np.arange(len(full))], []
        while todo:
            x = todo.pop()
            if len(x) <= FANOUT:
                done.append(x)
                continue
            spread = full[x].max(0) - full[x].min(0)
            x = x[np.argsort(full[x, spread.argmax()], kind="stable")]
            half = -(-len(x) // 2 // FANOUT) * FANOUT or FANOUT
            todo += [x[half:], x[:half]]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def probe(self, point, size: int) -> np.ndarray:
        """Points whose summed coordinate minima allow the needed overlap."""
        p = self.percent

        def able(hi, small, large):
            bound = np.minimum(hi, point).sum(1)
            return ((100 + p) * bound >= p * (size + small)) & (100 * large >= p * size) & (p * small <= 100 * size)

        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            at = at[able(*(x[at] for x in self.levels[k]))]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < (len(self.levels[k - 1][0]) if k else len(self.points))]
        return self.order[at[able(self.points[at], self.sizes[at], self.sizes[at])]]


def group_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, as one product of their members' table."""
    members, at = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.zeros((len(sets), len(members)), np.float32)     # sums below 2**24 are exact
    table[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
    return (table @ table.T).astype(np.int64)


def links(ids, sets, percent: int, side=None):
    """A spanning forest of the verified links; with ``side`` (0/1 per set) of
    those between the two sides only."""
    sizes = np.array([len(s) for s in sets])
    index = np.arange(len(sets)) if side is None else np.flatnonzero(side == 1)
    probes = np.arange(len(sets)) if side is None else np.flatnonzero(side == 0)
    if not len(index) or not len(probes):
        return []
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    if len(sets) <= FEW and sizes.sum() <= FEW_ITEMS:
        inter = overlaps(sets)
        able = 100 * inter >= percent * (sizes[:, None] + sizes - inter)
        for i, j in np.argwhere(np.triu(able, 1)).tolist():
            if side is not None and side[i] == side[j]:
                continue
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((ids[i], ids[j]))
        return out

    counts = group_counts(sets)
    tree = CountTree(counts[index], sizes[index], percent)
    for i in probes:
        for j in index[tree.probe(counts[i], sizes[i])]:
            if i == j or side is None and j < i:
                continue
            a, b = find(i), find(j)
            if a == b:
                continue
            inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                root[b] = a
                out.append((ids[i], ids[j]))
    return out


def join_clusters(percent: int):
    """Task code: rows (task, side, doc_id, items) sorted by task -> links (a, b)."""
    def run(batches):
        import pyarrow as pa

        def solve(rows):
            ids = [r[1] for r in rows]
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            cross = rows[0][0] >= 0
            return links(ids, sets, percent, np.array([r[0] for r in rows]) if cross else None)

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                               pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        key, rows, found = None, [], []
        for batch in batches:
            for task, side, doc_id, items in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "doc_id", "items")), strict=True):
                if task != key:
                    found += solve(rows) if len(rows) > 1 else []
                    key, rows = task, []
                    if len(found) >= 10_000:
                        yield pack(found)
                        found = []
                rows.append((side, doc_id, items))
        found += solve(rows) if len(rows) > 1 else []
        yield pack(found)
    return run


def verified_links(items: DataFrame, cluster: DataFrame, percent: int, max_cluster: int = MAX_CLUSTER,
                   block: int = BLOCK, spent=()) -> DataFrame:
    """Links ``(a, b)`` that connect what links within each cluster.

    ``items (doc_id, cluster, items)`` holds the sets, ``cluster (doc_id,
    cluster)`` the membership.  A cluster of up to ``max_cluster`` sets is one
    task's.  A larger one is cut into bands of set size, no wider than linked
    sets may differ, and a task gets two neighbouring bands; if these are still
    too many sets, it is dealt as all pairs of its blocks.  ``spent``: tables made
    by ``cut`` that nothing reads once ``items`` is written."""
    items = storage.cut(items, "items")
    storage.drop(*spent)
    large = cluster.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k") > max_cluster).select(
        "cluster", F.lit(True).alias("large"))
    size = F.octet_length("items") / 8
    band = F.floor(F.log(size) / F.lit(np.log(100.2 / percent))).cast("long")
    alone = F.array(F.lit(-2).cast("long"))
    placed = (items.join(storage.bounded(large, MAX_BROADCAST), "cluster", "left")
              .withColumn("band", F.explode(F.when(F.col("large"), F.array(band - 1, band)).otherwise(alone))))
    many = (placed.groupBy("cluster", "band").agg(F.count("*").alias("k")).where(F.col("k") > max_cluster)
            .withColumn("nb", F.ceil(F.col("k") / block)).drop("k"))
    many = storage.cut(many, "blocks")
    zero = F.lit(0).cast("long")
    dealt = (placed.join(storage.bounded(many, MAX_BROADCAST), ["cluster", "band"], "left")
             .withColumn("nb", F.coalesce("nb", F.lit(1).cast("long")))
             .withColumn("mine", F.pmod(F.xxhash64("doc_id"), "nb"))
             .withColumn("other", F.explode(F.sequence(zero, F.col("nb") - 1)))
             .select(F.struct("cluster", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("pair"),
                     F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0)
                     .otherwise(1).cast("int").alias("side"), "doc_id", "items"))
    tasks = (dealt.repartition("pair").sortWithinPartitions("pair", "doc_id")
             .select(F.concat_ws("/", "pair.cluster", "pair.band", "pair.i", "pair.j").alias("task"), "side", "doc_id", "items"))
    return tasks.mapInArrow(tokens.trimmed(join_clusters(percent)), "a long, b long")


def shared_parts(near: DataFrame) -> DataFrame:
    """``(part, weak)`` of the parts that more than one row has; ``weak`` tells
    a part of very many sets.  A table that grows with the corpus: it is
    counted with map-side partial sums and merge-joined, never broadcast."""
    return storage.cut(near.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
                       .select("part", (F.col("n") > HOT_PART).alias("weak")), "shared")


def shared_by_enough(near: DataFrame, of: list[str], least: str) -> DataFrame:
    """``near (rep, part, ...)`` without parts that only one row has, and without
    the groups ``of`` one set that have fewer than ``least`` left."""
    shared = shared_parts(near)
    found = near.drop("weak").join(shared.hint("merge"), "part")
    out = storage.cut(found.withColumn("n", F.count("*").over(Window.partitionBy(*of)))       # parts of one set
                      .where(f"n >= {least}").drop("n"), "near")
    storage.drop(shared)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, max_cluster: int = MAX_CLUSTER,
                       block: int = BLOCK) -> DataFrame:
    """``docs (doc_id, text)`` -> ``doc_id, n_shingles, component_id``, a row per
    input row; ``component_id`` is the smallest doc_id reachable by links of
    ``100 * |A & B| >= percent * |A | B|`` over sets of ``n``-word shingles."""
    ship("textcards.llm.tokens", __name__)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = storage.cut(texts.mapInArrow(
        tokens.trimmed(read_sets(n, percent, False)), "doc_id long, n_shingles long, h1 long, h2 long, prefix array<long>"), "sets")
    with storage.released() as made:
        known = sets.where("doc_id is not null and n_shingles > 0")
        classes = storage.cut(known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
        key = ["n_shingles", "h1", "h2"]
        copies = storage.cut(known.select("doc_id", *key).join(classes, key)      # AQE splits a class of a third of all rows
                             .where("doc_id != rep").select("doc_id", "h1", "rep"), "copies")
        # the prefixes stay where they are: other tables are joined to them
        reps = known.join(storage.bounded(copies.select("doc_id", "h1"), MAX_BROADCAST), ["doc_id", "h1"], "left_anti")
        near = reps.select(F.col("doc_id").alias("rep"), F.explode("prefix").alias("part"))
        shared = shared_parts(near)
        shares = shared.join(near.hint("merge"), "part").groupBy("rep").agg(F.count("*").alias("n"))
        least = F.expr(f"greatest(1L, {SHARED} * (({percent} * n_shingles + 99) div 100) div 100)")
        left = shares.join(reps.select(F.col("doc_id").alias("rep"), least.alias("least")), "rep").where("n >= least")
        left = storage.cut(left.select(F.col("rep").alias("doc_id")).distinct(), "left")
        sizes = storage.cut(sets.select("doc_id", "n_shingles"), "sizes")
        storage.drop(sets, shared, classes)       # the prefixes are most of it
        made.remove(sizes._shared_path)

        kept = storage.cut(texts.join(storage.bounded(left, MAX_BROADCAST), "doc_id").mapInArrow(
            tokens.trimmed(read_sets(n, percent, True)), "doc_id long, items binary, parts array<long>, tags array<int>"), "kept")
        near = (kept.select(F.col("doc_id").alias("rep"), F.explode(F.arrays_zip("parts", "tags")).alias("x"))
                .select("rep", F.col("x.parts").alias("part"), F.col("x.tags").alias("tag"))
                .withColumn("least", F.expr(f"tag div {TAGS} + 1")))
        first = shared_by_enough(near, ["rep", "tag"], "least")
        second = shared_by_enough(first, ["rep", "tag"], "least")
        storage.drop(first)
        # a set leaves out its weak parts where one that is not weak must be left
        n_weak = F.sum(F.col("weak").cast("int")).over(Window.partitionBy("rep", "tag"))
        near = storage.cut(second.withColumn("n", n_weak).where("not weak or n >= least").select("rep", "part"), "near")
        storage.drop(second)
        hubs = storage.cut(near.groupBy("part").agg(F.min("rep").alias("hub"), F.max("rep").alias("high"))
                           .where("hub < high").select("part", "hub"), "hubs")
        stars = near.join(hubs.hint("merge"), "part").where("rep != hub").select(
            F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        joined = components(stars, "clusters")
        cluster = storage.cut(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "members")
        storage.drop(near, hubs, joined)

        items = kept.select("doc_id", "items").join(storage.bounded(cluster, MAX_BROADCAST), "doc_id")
        found = verified_links(items, cluster, percent, max_cluster, block, spent=[kept])
        merged = components(found.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
        made.remove(merged._shared_path)
    return (sizes.join(merged, sizes.doc_id == merged.node, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


KEY_LIMIT = 1 << 62


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that another of their component stands for:
    of each component the row with the smallest doc_id (then text hash) stays, once.

    A row goes only where its own text links with one that stays.  Rows of one
    doc_id with several texts are documents of their own here (they get numbers
    above all ids for the join); of rows equal in doc_id and text the smallest row
    stays.  Rows without a doc_id all stay, and so do null and empty texts."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("__th", th)
    with storage.released() as made:
        again = storage.cut(rows.where("doc_id is not null").groupBy("doc_id").agg(
            F.count("*").alias("n"), F.min("__th").alias("lo"), F.max("__th").alias("hi")).where("n > 1"), "again")
        many = again.where("lo != hi").select("doc_id")
        if many.isEmpty():
            numbers = None
            keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        else:
            numbers = (rows.join(storage.bounded(many, MAX_BROADCAST), "doc_id", "left_semi")
                       .select("doc_id", "__th").distinct())
            numbers = storage.cut(numbers.select("doc_id", "__th", F.monotonically_increasing_id().alias("n")), "numbers")
            top, most = docs.agg(F.max("doc_id")).first()[0], numbers.agg(F.max("n")).first()[0]
            if max(top, 0) + most >= KEY_LIMIT:
                raise ValueError("no room for numbers above the doc_ids")
            numbers = numbers.select("doc_id", "__th", (F.col("n") + F.lit(max(top, 0) + 1)).alias("__key"))
            keyed = _with_key(rows, numbers).select(F.col("__key").alias("doc_id"), "text")
        found = (jaccard_components(keyed, **kw).where("doc_id is not null").select(
            F.col("doc_id").alias("__key"), "component_id").distinct())
        if numbers is None:
            gone = found.where("__key != component_id").select("__key")
        else:
            named = storage.cut(found.join(numbers, "__key", "left").select(
                "__key", "component_id", F.struct(F.coalesce("doc_id", "__key").alias("i"), F.coalesce("__th", F.lit(0)).alias("t"),
                                                  F.col("__key").alias("k")).alias("place")), "named")
            heads = named.groupBy("component_id").agg(F.min("place").alias("head"))
            gone = named.join(heads, "component_id").where("place != head").select("__key")
            numbers = storage.cut(numbers, "keys")
            made.remove(numbers._shared_path)
        gone = storage.cut(gone, "gone")
        made.remove(gone._shared_path)
        made.remove(again._shared_path)
    left = _with_key(rows, numbers).join(storage.bounded(gone, MAX_BROADCAST), "__key", "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    ids = storage.bounded(again.select("doc_id"), MAX_BROADCAST)
    one = left.join(ids, "doc_id", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))


def _with_key(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """``rows`` with ``__key``: the doc_id, or the number of (doc_id, text) where
    an id has several texts.  Only rows of such ids are joined by text."""
    if numbers is None:
        return rows.withColumn("__key", F.col("doc_id").cast("long"))
    many = storage.bounded(numbers.select("doc_id").distinct(), MAX_BROADCAST)
    single = rows.join(many, "doc_id", "left_anti").withColumn("__key", F.col("doc_id").cast("long"))
    return single.unionByName(rows.join(many, "doc_id", "left_semi").join(
        storage.bounded(numbers, MAX_BROADCAST), ["doc_id", "__th"]).select(*rows.columns, "__key"))
