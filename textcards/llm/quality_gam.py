"""Operator 1: quality classifier, a generalised additive model with pairs.

``score = sigmoid(b + sum_f table_f[bin_f] + sum_(f,g) table_fg[bin_f, bin_g])``.
Features describe a whole text (length, word and line repetition, character
classes), are cut into quantile bins, and every table is learned by cyclic
boosting: round after round each feature gets one shallow tree (three leaves)
on its bins, then the pairs with the largest residual gain get trees of two
cuts (four leaves).  A tree over the bins of a feature is just an addition to
its lookup table, so scoring is one vectorised table lookup per feature.

Fitting reads at most ``max_train_rows`` labelled rows (a documented bound,
rows taken by the hash of their id); scoring covers every row and text.

Cases: a null text counts as empty and gets the score of an empty text.
Without usable labels (none, or null) the model says 0.5 for all; with a
single class it says that class's smoothed rate.  Repeated and conflicting
labels all count.  Rows are scored one by one, so ties and repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, tokens

MAX_TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 60, 6
RATE, RIDGE = 0.1, 1.0
MIN_LEAF = 5

FEATURES = ["log_words", "word_length", "distinct_words", "top_word", "repeated_word", "digits", "upper", "symbols",
            "bars", "stops", "lines", "repeated_lines", "line_length", "ended_lines", "non_ascii", "longest_word",
            "short_words", "entropy"]

_DIGITS, _UPPER = slice(0x30, 0x3A), slice(0x41, 0x5B)
_SYMBOLS = [ord(c) for c in "#$%&*@^~_=+<>{}[]\\"]
_STOPS = [ord(c) for c in ".,!?;:"]
_ENDED = re.compile(r"[.!?][\"')\]]*$")


def features(text: str, raw: np.ndarray) -> list[float]:
    """The feature values of one text; ``raw`` are its UTF-8 bytes."""
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    share = count[count > 0] / n
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    size = [len(w) for w in words]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(len(words)), sum(size) / m, len(seen) / m, max(seen.values(), default=0) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        count[_DIGITS].sum() / n, count[_UPPER].sum() / n, count[_SYMBOLS].sum() / n, count[0x7C] / n,
        count[_STOPS].sum() / m, count[0x0A] / m, 1 - len(set(lines)) / k if lines else 0.0,
        np.log1p(len(text) / k), sum(1 for x in lines if _ENDED.search(x[-8:])) / k,
        count[0x80:].sum() / n, np.log1p(max(size, default=0)), size.count(1) / m,
        float(-(share * np.log2(share)).sum()),
    ]


def feature_matrix(column) -> np.ndarray:
    raw, offs = tokens.text_bytes(column)
    texts = column.to_pylist()
    return np.array([features(t or "", raw[a:b]) for t, a, b in zip(texts, offs[:-1], offs[1:], strict=True)],
                    dtype=float).reshape(-1, len(FEATURES))


def read_features(batches):
    """Task code: (quality, text) -> (quality, features)."""
    import pyarrow as pa
    for batch in (x for b in batches for x in tokens.slices(b, "text")):
        x = feature_matrix(batch.column("text"))
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))],
                                         names=["quality", "x"])


class Gam:
    """Lookup tables; fitted by ``fit``, applied by ``predict``."""

    def __init__(self):
        self.base, self.cuts, self.tables, self.pairs = 0.0, [], [], []

    # -- scoring ---------------------------------------------------------
    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)])

    def _raw(self, bins: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.base)
        for f, t in enumerate(self.tables):
            z += t[bins[:, f]]
        for f, g, t in self.pairs:
            z += t[coarse[:, f], coarse[:, g]]
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        bins = self._bins(x)
        return 1 / (1 + np.exp(-self._raw(bins, self._coarse(bins))))

    def _coarse(self, bins: np.ndarray) -> np.ndarray:
        """Bins of the pair tables: neighbouring bins of a feature together."""
        wide = np.array([len(c) + 1 for c in self.cuts])
        return bins * PAIR_BINS // np.maximum(wide, PAIR_BINS)

    # -- fitting ---------------------------------------------------------
    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        if len(np.unique(y)) < 2:
            return self
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        bins = self._bins(x)
        coarse = self._coarse(bins)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, t in enumerate(self.tables):
                step = self._tree(bins[:, f], len(t), *self._slopes(y, z))
                t += step
                z += step[bins[:, f]]
        g, h = self._slopes(y, z)
        every = [(f, k) for f in range(x.shape[1]) for k in range(f)]
        gain = {p: self._quarter(coarse[:, p[0]], coarse[:, p[1]], g, h)[0] for p in every}
        chosen = sorted(every, key=lambda p: (-gain[p], p))[:PAIRS]
        self.pairs = [(f, k, np.zeros((PAIR_BINS, PAIR_BINS))) for f, k in chosen]
        for _ in range(PAIR_ROUNDS):
            for f, k, t in self.pairs:
                step = self._quarter(coarse[:, f], coarse[:, k], *self._slopes(y, z))[1]
                t += step
                z += step[coarse[:, f], coarse[:, k]]
        return self

    @staticmethod
    def _slopes(y, z):
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    @staticmethod
    def _tree(b, n, g, h) -> np.ndarray:
        """Additions of a three-leaf tree over n ordered bins."""
        gs, hs, ns = (np.bincount(b, weights=w, minlength=n) for w in (g, h, None))
        leaves = [(0, n)]
        for _ in range(2):
            best = (1e-9, None)
            for lo, hi in leaves:
                if hi - lo < 2:
                    continue
                a, c, m = (np.cumsum(v[lo:hi])[:-1] for v in (gs, hs, ns))
                ga, ha, ma = gs[lo:hi].sum(), hs[lo:hi].sum(), ns[lo:hi].sum()
                gain = a * a / (c + RIDGE) + (ga - a) ** 2 / (ha - c + RIDGE) - ga * ga / (ha + RIDGE)
                gain = np.where((m >= MIN_LEAF) & (ma - m >= MIN_LEAF), gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (lo, lo + k + 1, hi))
            if best[1] is None:
                break
            lo, cut, hi = best[1]
            leaves = [x for x in leaves if x != (lo, hi)] + [(lo, cut), (cut, hi)]
        out = np.zeros(n)
        for lo, hi in leaves:
            out[lo:hi] = RATE * gs[lo:hi].sum() / (hs[lo:hi].sum() + RIDGE)
        return out

    @staticmethod
    def _quarter(b, c, g, h):
        """(gain, additions) of the best pair of cuts, one on each feature."""
        cell = b * PAIR_BINS + c
        grids = [np.bincount(cell, weights=w, minlength=PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS) for w in (g, h)]
        best, out = 0.0, np.zeros((PAIR_BINS, PAIR_BINS))
        for i in range(1, PAIR_BINS):
            for j in range(1, PAIR_BINS):
                q = [[(s[r, t].sum()) for r in (slice(0, i), slice(i, None)) for t in (slice(0, j), slice(j, None))]
                     for s in grids]
                gain = sum(a * a / (d + RIDGE) for a, d in zip(*q, strict=True))
                if gain > best:
                    best, out = gain, np.empty((PAIR_BINS, PAIR_BINS))
                    value = iter(RATE * a / (d + RIDGE) for a, d in zip(*q, strict=True))
                    for r in (slice(0, i), slice(i, None)):
                        for t in (slice(0, j), slice(j, None)):
                            out[r, t] = next(value)
        return best, out


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Gam:
    """Fit on at most ``max_train_rows`` rows of ``labels (doc_id, quality)``, and on at most
    as many rows of features where documents share an id."""
    ship("textcards.llm.tokens", __name__)
    sample = (labels.where("doc_id is not null and quality is not null")
              .select("doc_id", F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("quality", "text").mapInArrow(tokens.trimmed(read_features), "quality int, x array<double>")
            .orderBy(F.xxhash64("x"), "x", "quality").limit(max_train_rows).toArrow())
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.array(rows.column("quality"), dtype=float)
    order = np.lexsort((*x.T, y))         # the same model whatever the order of the tasks
    return Gam().fit(x[order], y[order])


def scorer(model: Gam, keep: list[str], text: str):
    """Task code: the kept columns and the score of column ``text``."""
    def run(batches):
        import pyarrow as pa
        for batch in (x for b in batches for x in tokens.slices(b, text)):
            score = model.predict(feature_matrix(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)],
                                             names=[*keep, "_score"])
    return run


def score(docs: DataFrame, model: Gam, keep: list[str], name: str = "score") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the model's score (0 to 1) as ``name``."""
    ship("textcards.llm.tokens", __name__)
    kept = ["k%d" % i for i in range(len(keep))]          # whatever the columns are called
    sent = [docs[c].alias(k) for c, k in zip(keep, kept, strict=True)]
    text = kept[keep.index("text")] if "text" in keep else "text"
    sent += [] if "text" in keep else [docs["text"].alias("text")]
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True))
    out = docs.select(*sent).mapInArrow(tokens.trimmed(scorer(model, kept, text)), f"{kinds}, _score double")
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("_score").alias(name))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
