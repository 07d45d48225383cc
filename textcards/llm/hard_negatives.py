"""Operator 12: hard negatives by shared candidate lists of anchor clusters.

Components become the integers floor(scale * x); a score is the integer inner
product of an anchor and a row, so scores and their order are exact.

1. The anchors are taken in blocks of at most about ``BLOCK`` (the stated query
   set, against all rows, in blocks).  A block is clustered by direction; a
   cluster has its centroid and the largest angle of a member to it.
2. A task holds the candidates of its part in slices.  For each cluster it
   computes the angle of every candidate of the slice to the centroid once.
   With the cluster's angle b, no member u scores a candidate x above
   |u| |x| cos(max(0, angle(x) - b)).  The slice is sorted by that bound once;
   all members walk the same list, and a member stops where the bound of the
   next candidate is below what it still needs.  What it needs is carried from
   slice to slice.
3. Walk one gives each anchor's positives (the first rows of its label); the
   tasks return at most ``positives`` rows an anchor, which are merged by a
   grouped sort.  Walk two gives, for each positive, the first rows of another
   label inside its window of scores.

Bounds carry a margin for rounding of angles; scores never do.

Cases: rows with a null id or label, a null vector, or a null, NaN or infinite
component take no part.  Vectors of unequal lengths are compared as if the
shorter ended in zeros; a vector of zeros scores 0 with all.  Anchor rows equal
in id, label and vector are one anchor; another row of the anchor's id is not
one of its "other rows"; repeated candidate rows all count.  An anchor without
positives, or a positive without a row in its window, gives no rows.  An empty
table gives an empty result.  Only the named columns are read.  Scores beyond a
long stop the job; from 2**53 on they are computed in 64-bit integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, storage
from textcards.llm.centroids import finite, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95              # percent of the positive's score
BLOCK = 8192                    # anchors of a block
MEMBERS = 64                    # anchors of a cluster, on average
SLICE = 16_384                  # candidates of one list
STEP = 1024                     # candidates of a list scored at a time
MARGIN = 1e-6                   # radians

FOUND = "anchor int, slot int, score long, vec_id long"


@dataclass
class Anchors:
    """A block: vectors (n x dim), ids, labels, and its clusters."""

    v: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    members: list


def clusters_of(v: np.ndarray, rounds: int = 5):
    """``(centroids, radius, members)``: spherical k-means of the rows of ``v``."""
    n, v = len(v), v.astype(float)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm > 0, norm, 1)[:, None]
    k = -(-n // MEMBERS)
    centroids = unit[np.linspace(0, n - 1, k).astype(int)]
    for _ in range(rounds):
        at = (unit @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, unit)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 1e-9, sums / np.where(size > 1e-9, size, 1)[:, None], centroids)
    at = (unit @ centroids.T).argmax(1)
    members = [np.flatnonzero(at == c) for c in range(k)]
    kept = [c for c in range(k) if len(members[c])]
    angle = np.arccos(np.clip((unit * centroids[at]).sum(1), -1, 1))
    angle[norm == 0] = 0                    # scores 0 whatever the angle
    return centroids[kept], np.array([angle[members[c]].max() for c in kept]), [members[c] for c in kept]


def matrix(column, dim: int, kind) -> np.ndarray:
    """An Arrow list column as rows of ``dim`` numbers, short ones ending in zeros."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if (size == dim).all():
        return flat.reshape(len(size), dim).astype(kind)
    out = np.zeros((len(size), dim), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Walk:
    """The members' walks: ``k`` best (score, then smaller id) of each slot.

    ``low``, ``high``: windows of scores, anchors x slots; ``same``: candidates
    of the anchor's own label, else of other labels."""

    def __init__(self, block: Anchors, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.b, self.low, self.high, self.same, self.k = block, low, high, same, k
        slots = low.size
        self.score = np.zeros((slots, k), block.v.dtype)
        self.id = np.zeros((slots, k), np.int64)
        self.filled = np.zeros(slots, np.int64)
        self.need = low.copy()          # by anchor and slot: lower scores no longer matter

    def merge(self, slot, score, ids):
        touched = np.unique(slot)
        there = np.arange(self.k) < self.filled[touched][:, None]
        slot = np.concatenate((slot, np.repeat(touched, self.filled[touched])))
        score = np.concatenate((score, self.score[touched][there]))
        ids = np.concatenate((ids, self.id[touched][there]))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        slot, place, score, ids = slot[keep], place[keep], score[keep], ids[keep]
        self.score[slot, place], self.id[slot, place] = score, ids
        self.filled[touched] = np.bincount(np.searchsorted(touched, slot), minlength=len(touched))
        full = touched[self.filled[touched] == self.k]
        self.need.reshape(-1)[full] = np.maximum(self.low.reshape(-1)[full], self.score[full, -1])

    def slice(self, ids, labels, v):
        """Walk the lists of one slice of candidates."""
        b, f = self.b, v.astype(float)
        norm = np.sqrt((f * f).sum(1))
        cos = b.centroids @ (f / np.where(norm > 0, norm, 1)[:, None]).T
        angle = np.arccos(np.clip(cos, -1, 1)) - b.radius[:, None] - MARGIN
        bound = norm * np.cos(np.clip(angle, 0, None)) * (1 + 1e-9)
        per_norm = np.where(b.norms > 0, b.norms, 1)
        for c, members in enumerate(b.members):
            least = self.need[members].min(1) / per_norm[members]
            # a zero anchor needs its candidates whatever their bound
            least[b.norms[members] == 0] = np.where(self.need[members].min(1)[b.norms[members] == 0] <= 0, -np.inf, np.inf)
            walked = np.flatnonzero(bound[c] >= least.min())
            walked = walked[np.argsort(-bound[c][walked], kind="stable")]
            for i in range(0, len(walked), STEP):
                part = walked[i:i + STEP]
                need = self.need[members]
                top = b.norms[members] * bound[c][part[0]]
                top[b.norms[members] == 0] = 0
                active = members[top >= need.min(1)]
                if not len(active):
                    break               # certified for every member
                self.score_part(active, ids[part], labels[part], v[part])

    def score_part(self, active, ids, labels, v):
        b, slots = self.b, self.low.shape[1]
        s = b.v[active] @ v.T
        fits = b.labels[active][:, None] == labels
        fits = fits & (b.ids[active][:, None] != ids) if self.same else ~fits
        for j in range(slots):
            m, i = np.nonzero(fits & (s >= self.need[active, j][:, None]) & (s <= self.high[active, j][:, None]))
            if not len(m):
                continue
            slot, score, found = active[m] * slots + j, s[m, i], ids[i]
            last, full = self.score[slot, -1], self.filled[slot] == self.k
            better = ~full | (score > last) | (found < self.id[slot, -1])
            if better.any():
                self.merge(slot[better], score[better], found[better])

    def found(self):
        """Arrow batches of ``FOUND``, at most k rows a slot."""
        import pyarrow as pa
        slots = self.low.shape[1]
        for i in range(0, len(self.filled), 10_000):
            there = np.arange(self.k) < self.filled[i:i + 10_000, None]
            slot = i + np.repeat(np.arange(len(there)), there.sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot // slots).astype(np.int32)), pa.array((slot % slots).astype(np.int32)),
                 pa.array(self.score[i:i + 10_000][there].astype(np.int64)), pa.array(self.id[i:i + 10_000][there])],
                names=["anchor", "slot", "score", "vec_id"])


def walked(block: Anchors, low, high, same: bool, k: int):
    """Task code: candidates -> the best of each slot among them."""
    def run(batches):
        walk = Walk(block, low, high, same, k)
        dim = block.v.shape[1]
        most = max(1, min(SLICE, (16 << 20) // (8 * max(dim, 1))))
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                walk.slice(np.asarray(part.column("id")), np.asarray(part.column("label")),
                           matrix(part.column("v"), dim, block.v.dtype))
        yield from walk.found()
    return run


def best(rows: DataFrame, block: Anchors, low, high, same: bool, k: int) -> DataFrame:
    """``anchor, slot, top``: the first k (score, vec_id) over all tasks."""
    found = rows.mapInArrow(walked(block, low, high, same, k), FOUND)
    top = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id")))      # k rows a task at most
    return found.groupBy("anchor", "slot").agg(F.slice(top, 1, k).alias("top"))


def take_block(anchors: DataFrame, dim: int, kind) -> Anchors:
    t = anchors.toArrow()           # about BLOCK rows
    v = matrix(t["v"], dim, kind)
    ids, labels = np.asarray(t["id"]), np.asarray(t["label"])
    return Anchors(v, ids, labels, np.sqrt((v.astype(float) ** 2).sum(1)), *clusters_of(v))


def mine(table: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str | Column = "label",
         vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the rows of ``table`` where ``is_anchor`` (a column of
    it) holds."""
    ship(__name__)
    spark = table.sparkSession
    lab = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), lab.cast("long").alias("label"),
                        F.col(vector_col).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x")))
    rows = storage.cut(rows.select("id", "label", whole(F.col("x"), scale).alias("v"), "is_anchor"), "candidates")
    dim, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if dim and dim * most * most >= 1 << 63:
        raise ValueError("scores of these vectors do not fit a long")
    kind = np.float64 if not dim or dim * most * most < 1 << 53 else np.int64
    anchors = storage.cut(rows.where("is_anchor").select("id", "label", "v").distinct(), "anchors")
    n = anchors.count()
    blocks = -(-n // block)
    tasks = 4 * spark.sparkContext.defaultParallelism
    dealt = rows.select("id", "label", "v").coalesce(tasks)
    out = storage.scratch(spark, "negatives")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    spark.createDataFrame([], schema).write.parquet(out)
    for i in range(blocks):
        b = take_block(anchors.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == i), dim or 0, kind)
        if not len(b.ids):
            continue
        least, greatest = (-np.inf, np.inf) if kind is np.float64 else (np.iinfo(kind).min, np.iinfo(kind).max)
        one = (len(b.ids), 1)
        first = best(dealt, b, np.full(one, least, kind), np.full(one, greatest, kind), True, positives).collect()
        # a positive's window; slots without a positive need more than any score
        lo, hi = np.full((len(b.ids), positives), greatest, kind), np.full((len(b.ids), positives), least, kind)
        pairs = []
        for r in first:
            for j, (neg, pid) in enumerate(r["top"]):
                a, score = r["anchor"], -neg
                lo[a, j], hi[a, j] = -(-low * score // 100), high * score // 100
                if lo[a, j] > hi[a, j]:
                    lo[a, j] = greatest
                pairs.append((a, j, int(b.ids[a]), pid, score))
        if not pairs:
            continue
        named = spark.createDataFrame(pairs, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        got = best(dealt, b, lo, hi, False, negatives).join(F.broadcast(named), ["anchor", "slot"])
        got.select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("p", "t")).select(
            "anchor_id", "positive_id", (F.col("p") + 1).alias("rank"), F.col("t.vec_id").alias("negative_id"),
            "positive_score", (-F.col("t.neg")).alias("negative_score")).write.mode("append").parquet(out)
    storage.drop(rows, anchors)
    return spark.read.schema(schema).parquet(out)
