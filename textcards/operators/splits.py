"""Train/test splits: K4 (time) K5 (hash) K6 (head) K8 (source) U4 F2 P8.

No global sort and no window without a partition key.  The exact "last n
rows in (date, id) order" cut is found by *histogram refinement*: a
bounded aggregate (at most ``BUCKETS`` rows come back to the driver) narrows
the value range of one key at a time until the cut value is exact; then
every row is tagged by comparison with the cut in one narrow projection.
A date that holds a third of all rows costs a few more small aggregates,
never a single-task window.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from textcards.functions.text import parse_date
from textcards.operators.common import bounded_broadcast, stored
from textcards.sources.readers import file_order

BUCKETS = 2048


def _bucket(c: str, lo: int, hi: int, width: int) -> Column:
    """Bucket number by integer division (a double would round keys beyond
    2^53 into a neighbouring bucket); decimal where the range needs it."""
    if hi - lo < 1 << 63 and width < 1 << 63:
        return F.expr(f"({c} - {lo}L) div {width}L") if lo > -(1 << 63) else F.expr(f"({c} - ({lo + 1}L - 1L)) div {width}L")
    return F.expr(f"(cast({c} as decimal(20,0)) - {lo}BD) div {width}BD")


def _kth(keys: DataFrame, c: str, k: int, largest: bool):
    """The k-th value of long column ``c`` counted from the top (``largest``)
    or the bottom.  Returns ``(v, n_beyond, n_equal)`` where ``n_beyond``
    counts rows strictly before ``v`` in that direction.

    Each round is one bounded aggregate: while more than ``BUCKETS`` rows
    remain in the value range, count them per equal-width bucket and keep the
    bucket holding the k-th row; once at most ``BUCKETS`` rows (or values)
    remain, count them per exact value."""
    lo, hi, in_range = keys.agg(F.min(c), F.max(c), F.count(c)).first()
    beyond = 0
    while True:
        rng = keys.where(F.col(c).between(lo, hi))
        if hi - lo < BUCKETS or in_range <= BUCKETS:
            hist = rng.groupBy(c).count().collect()
            for row in sorted(hist, key=lambda r: r[0], reverse=largest):
                if beyond + row["count"] >= k:
                    return row[0], beyond, row["count"]
                beyond += row["count"]
            raise ValueError("cut not found: fewer rows than requested")
        width = -(-(hi - lo + 1) // BUCKETS)
        b = _bucket(c, lo, hi, width)
        hist = rng.groupBy(b.alias("b")).count().collect()
        for row in sorted(hist, key=lambda r: r["b"], reverse=largest):
            if beyond + row["count"] >= k:
                lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                in_range = row["count"]
                break
            beyond += row["count"]
        else:
            raise ValueError("cut not found: fewer rows than requested")


def extreme_n(df: DataFrame, key_cols: list[str], n: int, largest: bool = True) -> Column:
    """Predicate selecting exactly the ``n`` rows of ``df`` with the largest
    (or smallest) key tuple in lexicographic order.

    ``key_cols`` are long columns of ``df`` whose tuple is unique per row (the
    splits end it with the row's number, so records may repeat ids and dates);
    apply the returned predicate to ``df`` (or anything carrying the same
    key columns).  ``n <= 0`` selects nothing, ``n >= count`` everything.
    """
    if n <= 0:
        return F.lit(False)
    keys = df.select(*key_cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = keys.count()
        if n >= total:
            return F.lit(True)
        preds, prefix, sub, k = [], F.lit(True), keys, n
        for c in key_cols:
            v, n_beyond, n_equal = _kth(sub, c, k, largest)
            past = (F.col(c) > F.lit(v)) if largest else (F.col(c) < F.lit(v))
            preds.append(prefix & past)
            prefix = prefix & (F.col(c) == F.lit(v))
            k -= n_beyond
            if k == n_equal:          # every row on this value is in
                preds.append(prefix)
                break
            sub = sub.where(F.col(c) == F.lit(v))
        else:
            raise ValueError("key tuple is not unique")
        out = preds[0]
        for p in preds[1:]:
            out = out | p
        return out
    finally:
        keys.unpersist()


def test_count(n: int, test_size: float) -> int:
    """``max(1, round(n * p))`` with Python's half-even ``round`` on the float."""
    return max(1, int(round(n * test_size)))


def id_keys(df: DataFrame, id_col: str) -> dict[str, Column]:
    """Long key columns that order rows by id, names ``_i0, _i1, ...``.

    An integral id is its own key.  A string id is cut into its bytes, seven
    to a key, with the length last: comparing the keys one after another is
    comparing the strings by code point."""
    if isinstance(df.schema[id_col].dataType, IntegralType):
        return {"_i0": F.col(id_col).cast("long")}
    text = F.col(id_col).cast("string")
    longest = df.agg(F.max(F.octet_length(text))).first()[0] or 0
    parts = [F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), i + 1, 7)), 14, "0"), 16, 10).cast("long")
             for i in range(0, longest, 7)]
    return {f"_i{i}": k for i, k in enumerate([*parts, F.octet_length(text).cast("long")])}


ROW = "_row"        # last key: the number of a stored row, which breaks all ties


def _keyed(records: DataFrame, *columns) -> DataFrame:
    """The columns and ``ROW``, stored, so that every pass sees the same numbers."""
    return stored(records.select(*columns, F.monotonically_increasing_id().alias(ROW)))


def row_positions(records: DataFrame, name: str = "position") -> DataFrame:
    """``records``, just read from files, with each row's number (from 0) in the
    order file, block, line.

    Rows are counted per block in one narrow aggregate; a running sum over the
    blocks (not the rows) gives where each begins, and the row's place inside its
    block is added.  No row is sorted or moved."""
    rows = records.withColumn("_o", file_order())
    blocks = rows.groupBy(F.col("_o.f").alias("_f"), F.col("_o.b").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_o.l").alias("_l"))
    begins = blocks.select("_f", "_b", "_l", (F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")).alias("_at"))
    j = rows.join(bounded_broadcast(begins), (F.col("_o.f") == F.col("_f")) & (F.col("_o.b") == F.col("_b")))
    return j.select(*records.columns, (F.col("_at") + F.col("_o.l") - F.col("_l")).alias(name))


def hash_key(id_col: str, seed: int) -> Column:
    """K5 order key: first 60 bits of ``md5(id || '|' || seed)``."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def date_key(df: DataFrame, date_col: str) -> Column:
    """Day number of a date column; strings go through the tolerant P8 parse."""
    dt = df.schema[date_col].dataType
    d = parse_date(date_col) if isinstance(dt, StringType) else F.to_date(F.col(date_col))
    return F.unix_date(d).cast("long")


def hash_split(records: DataFrame, id_col: str, test_size: float = 0.2,
               seed: int = 13) -> DataFrame:
    """K5 (re-aimed random split): order records by ``md5(id|seed)`` (then
    id), the first ``max(1, round(n*p))`` are test.  Returns ``(id, part)``."""
    keys = id_keys(records, id_col)
    k = _keyed(records, id_col, hash_key(id_col, seed).alias("_h"), *(c.alias(n) for n, c in keys.items()))
    n = k.count()
    if n == 0:
        return k.select(id_col, F.lit("test").alias("part")).limit(0)
    pred = extreme_n(k, ["_h", *keys, ROW], test_count(n, test_size), largest=False)
    return k.select(id_col, F.when(pred, "test").otherwise("train").alias("part"))


def time_split(records: DataFrame, id_col: str, date_col: str, test_size: float = 0.2,
               seed: int = 13):
    """K4: labelled records sorted by date; the last ``max(1, round(n*p))``
    dated records are test, the other dated and every undated record train
    (U4).  Ties on the cut date are broken by id (ascending order, so the
    larger ids are the later ones).  With no dated record at all falls back
    to ``hash_split``.  Returns ``(split (id, part), strategy)``.
    """
    keys = id_keys(records, id_col)
    k = _keyed(records, id_col, date_key(records, date_col).alias("_d"), *(c.alias(n) for n, c in keys.items()))
    dated = k.where(F.col("_d").isNotNull())
    n = dated.count()
    if n == 0:
        return hash_split(records.select(id_col), id_col, test_size, seed), "random"
    pred = extreme_n(dated, ["_d", *keys, ROW], test_count(n, test_size), largest=True)
    part = F.when(F.col("_d").isNotNull() & pred, "test").otherwise("train")
    return k.select(id_col, part.alias("part")), "time"


def head_of(rows: DataFrame, columns: list[str], order: list[str], train_frac: float) -> DataFrame:
    """K6 by the long columns ``order``, unique per row: the first ``max(1, int(train_frac * n))`` in
    ``order`` train, the rest eval; if nothing is left, eval = the first record
    (which is then in both parts)."""
    k = stored(rows)
    n = k.count()
    split_n = max(1, int(train_frac * n))
    train = extreme_n(k, order, split_n, largest=False)
    tagged = k.select(*columns, F.when(train, "train").otherwise("eval").alias("part"))
    if split_n < n or n == 0:
        return tagged
    first = extreme_n(k, order, 1, largest=False)
    return tagged.unionByName(k.where(first).select(*columns, F.lit("eval").alias("part")))


def head_split(records: DataFrame, id_col: str, ord_col: str, train_frac: float = 0.8) -> DataFrame:
    """K6 by an explicit order column, then id.  Returns ``(id, part)``."""
    keys = id_keys(records, id_col)
    k = records.select(id_col, F.col(ord_col).cast("long").alias("_o"), *(c.alias(n) for n, c in keys.items()),
                       F.monotonically_increasing_id().alias(ROW))
    return head_of(k, [id_col], ["_o", *keys, ROW], train_frac)


def head_split_by_position(records: DataFrame, columns, train_frac: float = 0.8) -> DataFrame:
    """K6 in file order: ``records``, just read from files, repeated ids and all.
    Returns ``(columns, position, part)``."""
    return head_of(row_positions(records.select(*columns)), [*columns, "position"], ["position"], train_frac)


def source_split(records: DataFrame, id_col: str, source_col: str, train_sources,
                 test_sources) -> DataFrame:
    """K8: train on some source types, test on others (others dropped)."""
    s = F.col(source_col)
    part = (F.when(s.isin(list(train_sources)), "train")
            .when(s.isin(list(test_sources)), "test"))
    return records.select(id_col, part.alias("part")).where(F.col("part").isNotNull())
