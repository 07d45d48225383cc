"""Operator 9: one-permutation MinHash fingerprints [DataFrame functions only].

A text's shingles (``SHINGLE`` words, split at white space; a text of fewer
words, but not none, is one shingle) are hashed once.  The leading bits of a
hash choose one of ``BINS`` bins, and each bin keeps its smallest hash.  An
empty bin is filled by optimal densification: it takes the value of the filled
bin that comes first in its own pseudo-random order of the bins.  Of each
value the low ``LOW_BITS`` bits are stored, packed as two hex digits.  The
share m of equal bins estimates the resemblance; equal low bits by chance are
corrected: ``(m - c) / (1 - c)`` with ``c = 2**-LOW_BITS``, cut to [0, 1].

Everything is array functions inside the row: sorted hashes group by bin, so
the minimum of a bin is the first hash of its run.  No Python, no explode.

``with_next`` gives each document the next one in descending doc_id, after the
last the first.  Ids are cut into ranges at (approximate) quantiles and each
range is a window of its own; the row that opens a range is sent to the range
before as well, so neighbours across a border meet and texts move once.

Cases: a null text counts as empty; without words the fingerprint is empty
and resembles another empty one fully, any other not at all.  Null ids come
last.  Rows of equal id are ordered by text.  A lone document follows itself.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE = 5
BINS = 128
BIN_SHIFT = 57               # 64 - log2(BINS)
LOW_BITS = 8
ROWS_A_RANGE = 1000
MAX_RANGES = 10_000


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, BIN_SHIFT).cast("int")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the low bits of each bin (array<smallint>, empty
    without words).  Steps are columns of their own, so each is computed once."""
    w, h, s, f, e = (f"{out}_{x}" for x in "whsfe")
    n = F.size(h)
    # words -> hashes -> shingle hashes, sorted
    df = df.withColumn(w, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    runs = F.arrays_zip(*(F.slice(h, i + 1, n - (SHINGLE - 1)).alias(f"w{i}") for i in range(SHINGLE)))
    long = F.transform(runs, lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(SHINGLE))))
    short = F.array(F.xxhash64(F.col(h), F.lit(0)))
    df = df.withColumn(s, F.sort_array(F.when(n >= SHINGLE, long).when(n > 0, short)
                                       .otherwise(F.expr("cast(array() as array<bigint>)")))).drop(h)
    # the first hash of each run of equal bins is the bin's minimum
    before = F.concat(F.slice(F.transform(F.slice(s, 1, 1), lambda x: F.bitwise_not(x)), 1, 1),
                      F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    df = df.withColumn(f, F.filter(F.zip_with(s, before, lambda x, p: F.when(_bin(x) != _bin(p), x)),
                                   lambda x: x.isNotNull())).drop(s)
    # optimal densification
    low = (1 << LOW_BITS) - 1
    full = F.transform(f, lambda x: F.struct(_bin(x).alias("b"), x.alias("v")))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(f, _bin))
    donor = F.transform(empty, lambda j: F.struct(j.alias("b"), F.array_min(F.transform(
        f, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("r"), x.alias("v"))))["v"].alias("v")))
    df = df.withColumn(e, F.when(F.size(f) > 0, F.array_sort(F.concat(full, donor)))).drop(f)
    return df.withColumn(out, F.coalesce(F.transform(e, lambda x: x["v"].bitwiseAND(low).cast("short")),
                                         F.expr("cast(array() as array<smallint>)"))).drop(e)


def packed(bits: str) -> Column:
    """The stored form: two hex digits a bin."""
    return F.concat_ws("", F.transform(bits, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")))


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance of two fingerprints, corrected for chance."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    c = 2.0 ** -LOW_BITS
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - c) / (1 - c)))) \
        .otherwise((F.size(a) == F.size(b)).cast("double"))


def with_next(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``df (doc_id, ...)`` with ``next_<c>`` of the row next in descending doc_id."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n, least, most = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    if not n:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    ranges = min(MAX_RANGES, -(-n // ROWS_A_RANGE))
    cuts = df.select(key.alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges) \
        if ranges > 1 else []
    bounds = _exact(df.select(key.alias("k")), cuts, most)     # each the largest id of its range
    at = F.lit(0)
    if len(bounds) > 1:
        edge = F.array(*(F.lit(b) for b in bounds))
        steps = F.lit([1 << i for i in range((len(bounds) - 1).bit_length() - 1, -1, -1)])
        at = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
            (pos + step < len(bounds)) & (F.element_at(edge, F.least(pos + step, F.lit(len(bounds) - 1))) < F.col("_key")),
            pos + step).otherwise(pos))
        opens = F.element_at(edge, F.col("_at") + 1) == F.col("_key")
    else:
        opens = F.col("_key") == F.lit(most)
    above = (F.col("_at") + 1) % len(bounds)
    copies = F.when(opens, F.array(F.struct(F.col("_at").alias("r"), F.lit(False).alias("guest")),
                                   F.struct(above.alias("r"), F.lit(True).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("_at").alias("r"), F.lit(False).alias("guest"))))
    rows = df.withColumn("_key", key).withColumn("_at", at).withColumn("_in", F.explode(copies))
    order = Window.partitionBy("_in.r").orderBy("_in.guest", F.desc("_key"), text)
    return (rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
            .where("not _in.guest").drop("_key", "_at", "_in"))


def _exact(keys: DataFrame, cuts: list, most: int) -> list[int]:
    """Quantiles come back as doubles; take the largest id up to each of them."""
    cuts = sorted(set(cuts))
    if not cuts:
        return [most]
    found = []
    for i in range(0, len(cuts), 500):       # one aggregate for every 500 borders
        part = cuts[i:i + 500]
        row = keys.agg(*(F.max(F.when(F.col("k") <= F.lit(int(c)), F.col("k"))).alias(f"m{j}")
                         for j, c in enumerate(part))).first()
        found += [x for x in row if x is not None]
    return sorted({*found, most})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` -> fingerprints of each text and of its edited form
    (its last half replaced by as much of the next document), and likenesses."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(fingerprint(df, "text", "bits"), "text", ["text", "bits"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                          F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = fingerprint(df, "edited", "edited_bits").drop("edited")
    return df.select("doc_id", "n_chars", "edited_sha256", packed("bits").alias("fingerprint"),
                     packed("edited_bits").alias("edited_fingerprint"), likeness("bits", "edited_bits").alias("near_edited"),
                     likeness("bits", "next_bits").alias("near_next"))
