"""Binary L2 logistic regressions for several labels at once (M1, M2).

Objective per label (the reference learner's, C = 1 by default)::

    f(w, b) = mean_i log(1 + exp(-s_i (x_i . w + b))) + ||w||^2 / (2 C n)

on every labelled row; neither the rows nor the vocabulary have a bound.  Every
iterate of a gradient method lies in the span of the training rows, ``w = X' a``,
so the state of a label is a few numbers per row, whatever the vocabulary.  These
vectors are files by ranges of rows (``row_vectors``) and are combined range by
range in tasks; the driver sees inner products only.  The large operation is
``K A = X X' A`` for the columns of all labels together.  The training matrix is
cut by term: a task multiplies with the terms it holds and writes one partial sum
by rows, so nothing of the vocabulary's length ever exists in one place.  One such
pass per iteration serves all labels; the line search needs none, because margins
are linear along a direction.  The iteration is L-BFGS with inner products taken
through K, which is L-BFGS on w itself.

Why not ``pyspark.ml.classification.LogisticRegression``: it optimises in
standardised feature space, and with ``standardization=False`` it compensates
with a per-feature penalty ``1/sigma_j^2``.  For sparse TF-IDF terms
``sigma_j`` is tiny, the problem becomes badly conditioned, and it was measured
to run its full 2000 iterations per label (696 s at sf0.1).

Stopping rules follow the reference learner's: ``max|grad w| <= tol`` (1e-4),
relative decrease ``<= 64 * eps``, or ``max_iter`` iterations.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcards.operators.row_vectors import RowVectors

FTOL = 64 * np.finfo(float).eps
MAX_TRAIN_ROWS = 20_000        # of ``sample_rows``; fits take all rows
BLOCK_ENTRIES = 2_000_000      # matrix entries of one stored block (24 MB)
MAX_TASKS = 16                 # partial sums by rows that a pass writes
HISTORY = 10
HALVINGS = 50                  # of a line search, LINE at a time
LINE = 5
RETURNED = 200_000             # rows of a returned batch

# Task code is pickled by value: executors need only numpy and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sample_rows(ids: DataFrame, id_col: str, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``(id, row)``: at most ``max_rows`` ids, by hash, numbered from 0 (for a
    caller that wants a sample; no fit takes one by itself)."""
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    few = ids.select(id_col).distinct().orderBy(*order).limit(max_rows)
    return few.select(id_col, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int").alias("row"))


def pack_columns(batches):
    """Task code: (row, term, weight) sorted by term -> compact column blocks."""
    import pyarrow as pa
    rows, vals, starts, last, n = [], [], [], None, 0

    def block():
        r, v = np.concatenate(rows).astype(np.int32), np.concatenate(vals)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (
            r, v, np.concatenate(starts).astype(np.int32))], names=["rows", "vals", "starts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        terms = np.array(batch.column("term").to_pylist(), dtype=object)
        new = np.concatenate(([terms[0] != last], terms[1:] != terms[:-1]))
        if n >= BLOCK_ENTRIES and new.any():      # cut at the first new term
            k = int(new.argmax())
            rows.append(np.array(batch.column("row"))[:k])
            vals.append(np.array(batch.column("weight"))[:k])
            yield block()
            rows, vals, starts, n = [], [], [], 0
            terms, new, batch = terms[k:], new[k:], batch.slice(k)
        rows.append(np.array(batch.column("row")))
        vals.append(np.array(batch.column("weight")))
        starts.append(np.flatnonzero(new) + n)
        n += len(terms)
        last = terms[-1]
    if n:
        yield block()


def _blocks(batches):
    """(rows, values, starts, sizes, terms) of the blocks of a task."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            r, v, s = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (
                ("rows", np.int32), ("vals", np.float64), ("starts", np.int32)))
            yield r, v, s, np.diff(np.append(s, len(r))), batch.column("terms")[i].as_py() if "terms" in names else None


def gram(blocks: DataFrame, vectors: RowVectors, of: str, to: str, labels: list[int]) -> tuple[list[str], np.ndarray]:
    """``X X' v`` of the vector ``of`` as partial sums ``to``, whose names come
    back, and ``max |X' v|`` per label; only ``labels`` are computed."""
    def part(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        v = total = None
        top = np.zeros(vectors.labels)
        for r, x, s, size, _ in _blocks(batches):
            if v is None:
                v, total = vectors.whole(of), vectors.empty()
            for k in labels:
                w = np.add.reduceat(x * v[k][r], s)
                top[k] = max(top[k], np.abs(w).max())
                total[k] += np.bincount(r, weights=x * np.repeat(w, size), minlength=vectors.n)
        if v is not None:
            name = f"{to}-{TaskContext.get().partitionId():05d}"
            vectors.write_whole(name, total)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([top.tobytes()], pa.binary())], names=["name", "top"])

    found = blocks.mapInArrow(part, "name string, top binary").collect()      # one row a task
    return sorted(x["name"] for x in found), np.max([np.zeros(vectors.labels), *(np.frombuffer(x["top"]) for x in found)], axis=0)


def coefficients(blocks: DataFrame, vectors: RowVectors, of: str, heavy: float) -> DataFrame:
    """``(term, heavy, c0, c1, ...)``: ``X' v``; terms of more than ``heavy`` rows are heavy."""
    def part(batches):
        import pyarrow as pa
        v = None
        for r, x, s, size, terms in _blocks(batches):
            v = vectors.whole(of) if v is None else v
            w = [np.add.reduceat(x * v[k][r], s) for k in range(vectors.labels)]
            terms = pa.array(terms.decode().split("\n"))
            for a in range(0, len(s), RETURNED):
                b = a + RETURNED
                yield pa.RecordBatch.from_arrays([terms[a:b], pa.array(size[a:b] > heavy), *(pa.array(c[a:b]) for c in w)],
                                                 names=["term", "heavy", *(f"c{k}" for k in range(vectors.labels))])
    return blocks.mapInArrow(part, "term string, heavy boolean, " + ", ".join(f"c{k} double" for k in range(vectors.labels)))


def matrix_entries(batches):
    """Task code: blocks -> (row, term, weight)."""
    import pyarrow as pa
    for r, x, s, size, terms in _blocks(batches):
        terms, at = pa.array(terms.decode().split("\n")), np.repeat(np.arange(len(s)), size)
        for a in range(0, len(r), RETURNED):
            b = a + RETURNED
            yield pa.RecordBatch.from_arrays([pa.array(r[a:b]), terms.take(pa.array(at[a:b])), pa.array(x[a:b])],
                                             names=["row", "term", "weight"])


def _dot(u, v):
    return np.einsum("km,km->k", u, v)


def _losses(sign, z):
    return np.logaddexp(0.0, -sign * z).sum(axis=1)


class _Label:
    """One label's iteration, of which the driver holds numbers only: intercept,
    loss, and inner products of the vectors that its next direction combines."""

    def __init__(self):
        self.b, self.f, self.done, self.iterations = 0.0, float(np.log(2.0)), False, 0
        self.pairs, self.dots = [], {}      # numbers of the steps kept; inner products of vectors

    def dot(self, u, v):
        return self.dots[min(u, v), max(u, v)]

    def combined(self, q, v):
        return sum(c * self.dot(u, v) for u, c in q.items())

    def direction(self, it: int) -> dict:
        """The L-BFGS direction as a combination of ``("g", it)`` and of the steps
        ("s") and gradient changes ("y") kept."""
        g = ("g", it)
        first = 1.0 / max(np.sqrt(max(self.dot(g, g), 0.0)), 1e-12)
        q, back = {g: 1.0}, []
        for i in reversed(self.pairs):
            s, y = ("s", i), ("y", i)
            c = self.combined(q, s) / self.dot(s, y)
            back.append(c)
            q[y] = q.get(y, 0.0) - c
        c = first
        if self.pairs:
            s, y = ("s", self.pairs[-1]), ("y", self.pairs[-1])
            c = self.dot(s, y) / self.dot(y, y)
        q = {u: c * x for u, x in q.items()}
        for i, c in zip(self.pairs, reversed(back)):
            s, y = ("s", i), ("y", i)
            c -= self.combined(q, y) / self.dot(s, y)
            q[s] = q.get(s, 0.0) + c
        d = {u: -x for u, x in q.items()}
        if self.combined(d, g) >= 0:         # not a descent direction: start again
            self.pairs = []
            d = {g: -first}
        return d


def fit_vectors(blocks: DataFrame, vectors: RowVectors, C: float = 1.0, tol: float = 1e-4, max_iter: int = 2000):
    """Fit all labels to the 0/1 vector ``y``; returns ``(name, intercepts)``: the
    coefficients are ``X' a`` for the vector ``a`` of that name."""
    n, reg, labels = vectors.n, 1.0 / (C * vectors.n), [_Label() for _ in range(vectors.labels)]
    spark, halves = blocks.sparkSession, 0.5 ** np.arange(HALVINGS)
    every = lambda step: vectors.each(spark, step)      # noqa: E731
    intercepts = lambda: np.array([x.b for x in labels])[:, None]      # noqa: E731
    part = {}                   # intercept's component of each vector kept

    def begun(c):
        r = 0.5 - vectors.read("y", c)
        zero = np.zeros(r.shape)
        vectors.write("a0", c, zero)
        vectors.write("ka0", c, zero)
        vectors.write("g0", c, r / n)
        return r.sum(axis=1)

    residual, it = sum(every(begun)) / n, 0
    while True:
        active = [k for k, x in enumerate(labels) if not x.done]
        sums, top = gram(blocks, vectors, f"g{it}", f"t{it}", active)
        last = it - 1
        kept = sorted({i for x in labels if not x.done for i in x.pairs})

        def met(c):
            """K g out of its partial sums, the last step's gradient change, and the
            inner products of both and of the step with the vectors kept."""
            g, kg = vectors.read(f"g{it}", c), sum(vectors.read_part(s, c) for s in sums)
            vectors.write(f"kg{it}", c, kg)
            out = [_dot(g, kg)]
            if not kept:
                return np.array(out)
            y, ky = g - vectors.read(f"g{last}", c), kg - vectors.read(f"kg{last}", c)
            vectors.write(f"y{last}", c, y)
            vectors.write(f"ky{last}", c, ky)
            ks = vectors.read(f"ks{last}", c)
            for i in kept:
                s, yi = vectors.read(f"s{i}", c), y if i == last else vectors.read(f"y{i}", c)
                out += [_dot(s, kg), _dot(yi, kg), _dot(s, ky), _dot(yi, ky), _dot(yi, ks)]
            return np.array(out)

        found = iter(sum(every(met)))
        vectors.drop(*sums)
        g = ("g", it)
        part[g] = residual.copy()
        if last >= 0:
            part["y", last] = part[g] - part["g", last]
        known = {(g, g): next(found)}
        for i in kept:
            for u, v in ((("s", i), g), (("y", i), g), (("s", i), ("y", last)), (("y", i), ("y", last)), (("y", i), ("s", last))):
                known[min(u, v), max(u, v)] = next(found)
        for k, x in enumerate(labels):
            x.dots.update({(u, v): p[k] + part[u][k] * part[v][k] for (u, v), p in known.items()})
            if not x.done and x.pairs and x.pairs[-1] == last and x.dot(("s", last), ("y", last)) <= 1e-12:
                x.pairs.pop()
            x.pairs = x.pairs[-HISTORY:]
            x.done = x.done or max(top[k], abs(residual[k])) <= tol or x.iterations >= max_iter
        directions = [{} if x.done else x.direction(it) for x in labels]
        if all(x.done for x in labels):
            return f"a{it}", np.array([x.b for x in labels])
        used = sorted({u for d in directions for u in d})
        weight = {u: np.array([d.get(u, 0.0) for d in directions])[:, None] for u in used}
        db = sum(weight[u][:, 0] * part[u] for u in used)
        slope = [x.combined(d, g) for x, d in zip(labels, directions)]
        b = intercepts()

        def turned(c):
            """The direction, and the losses of the first step lengths along it."""
            d = sum(weight[u] * vectors.read(f"{u[0]}{u[1]}", c) for u in used)
            kd = sum(weight[u] * vectors.read(f"k{u[0]}{u[1]}", c) for u in used)
            vectors.write(f"d{it}", c, d)
            vectors.write(f"kd{it}", c, kd)
            a, ka = vectors.read(f"a{it}", c), vectors.read(f"ka{it}", c)
            return np.array([_dot(a, ka), _dot(d, ka), _dot(d, kd), *along(c, halves[:LINE], ka, kd)])

        def along(c, lengths, ka=None, kd=None):
            ka = vectors.read(f"ka{it}", c) if ka is None else ka
            kd = vectors.read(f"kd{it}", c) if kd is None else kd
            sign, z, dz = 2.0 * vectors.read("y", c) - 1.0, ka + b, kd + db[:, None]
            return np.array([_losses(sign, z + t * dz) for t in lengths])

        aa, ad, dd, *losses = sum(every(turned))
        steps, tried = np.zeros(len(labels)), 0
        open_ = {k for k, x in enumerate(labels) if not x.done}
        while open_ and tried < HALVINGS:      # backtracking (Armijo): no pass over the matrix
            if tried:
                losses = sum(every(lambda c: along(c, halves[tried:tried + LINE])))
            for t, loss in zip(halves[tried:tried + LINE], losses):
                for k in sorted(open_):
                    f = loss[k] / n + 0.5 * reg * (aa[k] + 2 * t * ad[k] + t * t * dd[k])
                    if f <= labels[k].f + 1e-4 * t * slope[k]:
                        open_.discard(k)
                        x, steps[k] = labels[k], t
                        x.b += t * db[k]
                        x.pairs.append(it)
                        x.iterations += 1
                        x.done = (x.f - f) / max(abs(x.f), abs(f), 1.0) <= FTOL
                        x.f = f
            tried += LINE
        for k in open_:
            labels[k].done = True
        part["s", it] = steps * db
        t, b, on = steps[:, None], intercepts(), np.array([not x.done for x in labels])[:, None]

        def moved(c):
            """The next iterate and its gradient, of labels still open."""
            s, ks = t * vectors.read(f"d{it}", c), t * vectors.read(f"kd{it}", c)
            a, ka = vectors.read(f"a{it}", c) + s, vectors.read(f"ka{it}", c) + ks
            r = 0.5 * (1.0 + np.tanh(0.5 * (ka + b))) - vectors.read("y", c)
            for name, x in ((f"s{it}", s), (f"ks{it}", ks), (f"a{it + 1}", a), (f"ka{it + 1}", ka), (f"g{it + 1}", on * (r / n + reg * a))):
                vectors.write(name, c, x)
            return r.sum(axis=1)

        residual = sum(every(moved)) / n
        if all(x.done for x in labels):
            return f"a{it + 1}", np.array([x.b for x in labels])
        wanted = {i for x in labels if not x.done for i in x.pairs}
        vectors.drop(f"a{it}", f"ka{it}", f"d{it}", f"kd{it}", *(f"{v}{last}" for v in ("g", "kg") if last >= 0),
                     *(f"{v}{i}" for i in kept if i not in wanted for v in ("s", "ks", "y", "ky")))
        for x in labels:
            x.dots = {uv: p for uv, p in x.dots.items() if all(u[0] != "g" and u[1] in wanted for u in uv)}
        it += 1


def fit_labels(blocks: DataFrame, y: np.ndarray, C: float = 1.0, tol: float = 1e-4, max_iter: int = 2000):
    """``(a, intercepts)`` for the label columns of ``y`` (rows x labels, 0/1), for
    a matrix of few rows; the coefficients are ``X' a``."""
    with RowVectors(blocks.sparkSession, *y.shape) as vectors:
        for c in range(vectors.ranges):
            a, b = vectors.bounds(c)
            vectors.write("y", c, np.ascontiguousarray(y[a:b].T, dtype=float))
        name, intercepts = fit_vectors(blocks, vectors, C, tol, max_iter)
        return np.array(vectors.whole(name)).T, intercepts
