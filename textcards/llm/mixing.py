"""Operator 3: mixing sources to target weights by temperature [DataFrame only].

A source with token share p gets the weight ``p**a / sum(p**a)``.  ``a = 1``
keeps the natural shares, ``a = 0`` makes them equal.  The exponent is found
by repeated section: every round evaluates ``SECTIONS`` exponents of the
current interval in one small aggregate over the table of sources and keeps
the section that holds the solution, until it is narrower than ``PRECISION``.

* target entropy: the largest exponent whose weights have at least the target
  entropy (entropy falls as the exponent rises); default: half way between the
  natural entropy and that of equal weights;
* repetition limit: if some source would then be repeated more than
  ``max_repeats`` times, the smallest exponent that respects the limit.

Realisation: a source's documents have a fixed pseudo-random order (a keyed
hash), cut into blocks by the leading bits of the key.  A source's budget is
so many whole passes over that permutation and then the documents from its
start while the running total of tokens stays within the rest.  Where the last
pass ends is found block by block (``BITS`` bits of the key per round, a
histogram per source), never by a sort or a window over a source's documents.
So a source with a third of all rows is a few thousand pre-aggregated numbers,
and texts never move.

Without a budget the smallest one is taken that uses every document at least
once: nothing is dropped, small sources are repeated.

Cases: a null source is a source of its own.  Null or empty texts have no
tokens; they are used in each whole pass, and a source without any tokens gets
weight 0 and one pass.  Rows with equal doc_id and text are used equally
often.  An empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textcards.llm import storage

MAX_REPEATS = 4.0
SECTIONS = 32
PRECISION = 1e-9
BITS = 12
KEY_BITS = 60
MAX_BROADCAST = 100_000      # sources sent to every executor


def n_tokens(text: str = "text"):
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def order_key(seed: int):
    """Place of a row in its source's permutation, ``KEY_BITS`` bits."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    return F.shiftrightunsigned(h, 64 - KEY_BITS)


def _evaluate(shares: DataFrame, points: list[float]) -> list:
    """Per exponent: entropy of the weights, largest repetition relative to the
    least (``spread``) and to the natural one (``top``)."""
    at = F.explode(F.array(*(F.lit(float(p)) for p in points)))
    q = F.exp(F.col("a") * F.col("logp"))
    rate = F.exp((F.col("a") - 1) * F.col("logp"))
    z = F.sum(q)
    return (shares.select(at.alias("a"), "logp").groupBy("a")
            .agg((F.log(z) - F.col("a") * F.sum(q * F.col("logp")) / z).alias("entropy"),
                 (F.max(rate) / F.min(rate)).alias("spread"), (F.max(rate) / z).alias("top"))
            .orderBy("a").collect())        # a row per exponent


def _section(shares, good, lo: float, hi: float, largest: bool) -> float:
    """The largest (smallest) exponent in [lo, hi] for which ``good`` holds."""
    while hi - lo > PRECISION:
        rows = _evaluate(shares, [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS)] + [hi])
        ok = [r["a"] for r in rows if good(r)]
        if not ok:
            return lo if largest else hi
        edge = (hi - lo) / SECTIONS
        if largest:
            lo, hi = max(ok), min(hi, max(ok) + edge)
        else:
            lo, hi = max(lo, min(ok) - edge), min(ok)
    return lo if largest else hi


def source_plan(rows: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS,
                budget: int | None = None) -> DataFrame:
    """``rows (src, tokens)`` -> per source ``src, total, share, weight, passes, rest``."""
    src = storage.cut(rows.groupBy("src").agg(F.sum("tokens").alias("total")), "sources")
    n, total = src.where("total > 0").agg(F.count("*"), F.sum("total")).first()
    if not n:
        return src.select("src", "total", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"),
                          F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("rest"))
    shares = src.where("total > 0").select("src", F.log(F.col("total") / F.lit(total)).alias("logp"))
    natural = _evaluate(shares, [1.0])[0]["entropy"]
    target = target_entropy if target_entropy is not None else (natural + math.log(n)) / 2

    def repeats(r):
        return r["spread"] if budget is None else r["top"] * budget / total

    a = _section(shares, lambda r: r["entropy"] >= target - 1e-12, 0.0, 1.0, True)
    a = _section(shares, lambda r: repeats(r) <= max_repeats * (1 + 1e-12), a, 1.0, False) if max_repeats else a
    z, least = (shares.agg(F.sum(F.exp(a * F.col("logp"))), F.min(F.exp((a - 1) * F.col("logp")))).first())
    weight = F.coalesce(F.exp(a * F.col("logp")) / F.lit(z), F.lit(0.0))
    spend = float(budget) if budget is not None else total * z / least
    planned = src.join(storage.bounded(shares, MAX_BROADCAST), "src", "left").select(
        "src", "total", F.coalesce(F.exp("logp"), F.lit(0.0)).alias("share"), weight.alias("weight"))
    quota = F.round(F.col("weight") * F.lit(spend)).cast("long")
    quota = F.greatest(quota, F.col("total")) if budget is None else quota
    return planned.withColumn("passes", F.when(F.col("total") > 0, F.floor(quota / F.col("total"))).otherwise(1)) \
        .withColumn("rest", F.when(F.col("total") > 0, quota - F.col("passes") * F.col("total")).otherwise(0))


def last_pass_ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the key before which its last, partial pass ends.

    ``rows (src, key, tokens)``; one round per ``BITS`` bits: a histogram of the
    block that holds the end, and in it the first bucket that does not fit."""
    state = plan.select("src", "rest", F.lit(0).cast("long").alias("block"))
    for bits in range(KEY_BITS - BITS, -1, -BITS):
        inside = rows.join(storage.bounded(state, MAX_BROADCAST), "src").where(
            F.shiftrightunsigned("key", bits + BITS) == F.col("block"))
        hist = inside.groupBy("src", F.shiftrightunsigned("key", bits).alias("bucket")).agg(
            F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
        run = F.sum("t").over(Window.partitionBy("src").orderBy("bucket"))
        state = storage.cut(
            hist.withColumn("run", run).where("run > rest").groupBy("src")
            .agg(F.min(F.struct("bucket", "run", "t", "rest")).alias("m"))
            .select("src", (F.col("m.rest") - F.col("m.run") + F.col("m.t")).alias("rest"),
                    F.col("m.bucket").alias("block")), "mixing")
    return state.select("src", F.col("block").alias("stop"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS,
        budget: int | None = None, seed: int = 13) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``tokens``, its source's
    ``share`` and ``weight``, and ``copies``: how often the mixture uses the row."""
    tagged = docs.select(F.struct(*docs.columns).alias("row"), source_key().alias("src"), n_tokens().alias("tokens"),
                         order_key(seed).alias("key"))
    rows = storage.cut(tagged.select("src", "key", "tokens"), "rows")
    plan = storage.cut(source_plan(rows, target_entropy, max_repeats, budget), "plan")
    plan = storage.cut(plan.join(last_pass_ends(rows, plan), "src", "left")
                       .select("src", "share", "weight", "passes", F.coalesce("stop", F.lit(0)).alias("stop")), "plan")
    storage.drop(rows)
    extra = F.when(F.col("key") < F.col("stop"), 1).otherwise(0)
    return tagged.join(storage.bounded(plan, MAX_BROADCAST), "src").select(
        "row", "tokens", "share", "weight", (F.col("passes") + extra).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs``, each row as often as the mixture uses it."""
    used = mix(docs, **kw).where("copies > 0")
    return used.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("pass")).select("row.*")
