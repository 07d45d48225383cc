"""Operator 6: licence scan [DataFrame functions only].

Texts and templates are normalised alike: lower case, every run of other
characters than a-z and 0-9 is one space.  A unit is the whole text, one of its
lines, or a run of consecutive lines.  A unit is compared with a template by the
Dice coefficient of their sets of word bigrams, ``2 |A & B| / (|A| + |B|)``.  A
coefficient of t needs sizes within ``t / (2 - t)`` of each other, and a unit
that has that share of a template's bigrams, so a template is a candidate only
where the whole text has them; no other text gets the bigrams of its lines and
runs built.  (A bit table of the templates' bigrams comes first.)

Of the runs that reach t with a template those count that are better than the
whole text and than each of their lines; the best one first, then the best of
those that do not overlap it, and so on.  A run does not count where the line
before or after it would add bigrams, all of them the template's.  One whose
first or last line adds no bigram of the template to the others is never better
than the run without that line; so a line begins only runs that end before the
last of its bigrams comes again, which bounds the ends to try.  Places, sums
and bounds are arrays of numbers built once; time grows with the length of the
text, not with the number of runs in it.

All of it happens inside the row, no shuffle: the templates are a small
literal.

Cases: null and empty texts, and units of fewer than two words, have no
bigrams and match nothing.  Of equal coefficients the earliest line wins (the
whole text counts as line -1), then the template's name.  Repeated rows get
equal results; an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcards.llm.license_templates import TEMPLATES

THRESHOLD = 0.8
BITS = 1 << 17           # of the bit table: about ten a bigram
CHUNK = 64               # numbers that are summed one by one
FAR = (1 << 31) - 1


def normalise(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[str]:
    w = normalise(text).split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def templates(texts: dict[str, str] | None = None) -> Column:
    """The templates as an array of (name, grams), a literal."""
    return F.array(*(F.struct(F.lit(k).alias("name"), F.split(F.lit("|".join(bigrams(t))), "[|]").alias("grams"))
                     for k, t in sorted((texts or TEMPLATES).items())))


def perhaps(gram: Column, texts: dict[str, str] | None = None) -> Column:
    """False only for a bigram that no template has."""
    bits = [0] * (BITS // 64)
    for g in {g for t in (texts or TEMPLATES).values() for g in bigrams(t)}:
        h = zlib.crc32(g.encode()) % BITS
        bits[h // 64] |= 1 << h % 64
    signed = ",".join(str(x - (1 << 64) if x >> 63 else x) for x in bits)
    table = F.split(F.lit(signed), ",").cast("array<bigint>")
    h = F.crc32(gram.cast("binary")) % BITS
    return F.getbit(F.get(table, F.floor(h / 64).cast("int")), (h % 64).cast("int")) == 1


def pairs(words: Column) -> Column:
    """The bigrams of an array of words, in order, repeated ones too."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, levels: int = 2) -> Column:
    """Running sums of an array; chunks of chunks, so no array is copied element by element."""
    def sums(v):
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))

    if not levels:
        return let(values, sums)
    last = lambda w: F.coalesce(F.get(w, F.size(w) - 1), F.lit(0).cast("long"))

    def shifted(parts):
        totals = F.transform(parts, last)
        return let(running(totals, levels - 1), lambda ends: F.flatten(F.transform(
            parts, lambda w, c: F.transform(w, lambda x: x + F.get(ends, c) - last(w)))))

    chunks = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")),
                                               lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
    return let(F.transform(chunks, sums), shifted)


def neighbours(grams: Column) -> Column:
    """Per bigram: its place ``p``, the places of the same one before (-1: none) and after (FAR: none)."""
    by_gram = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
    near = lambda s, x, i, none: F.when(F.get(s, i)["g"] == x["g"], F.get(s, i)["p"]).otherwise(F.lit(none))
    return F.array_sort(let(by_gram, lambda s: F.transform(s, lambda x, i: F.struct(
        x["p"].alias("p"), near(s, x, i - 1, -1).alias("prev"), near(s, x, i + 1, FAR).alias("next")))))


def own(at: Column, r: Column) -> Column:
    """The bigrams that a line adds to a run which it ends."""
    first = F.greatest(r["a"], F.lit(1))
    return F.slice(at, first, r["b"] - first)


def best_runs(t: Column, at: Column, grams: Column, maybe: Column, rows: Column, hits: Column, threshold: float) -> Column:
    """The runs of lines that match template ``t``; ``at``: ``neighbours``; ``rows``: the
    lines that have words (number ``k``, ``line``, place of the first word ``a``, of the
    end ``b``, different bigrams up to there ``d``)."""
    n = F.size(t["grams"])
    least, most = n * threshold / (2 - threshold), n * (2 - threshold) / threshold      # bounds of a run's size

    def described(flags):
        """Per line also: hits up to its end ``h``; the end ``lim`` before which a run that it
        begins must end for it to bring a bigram of the template, the place ``low`` behind which
        one that it ends must begin; are all that it adds in front, behind, in the template."""
        hit = lambda part: F.filter(part, lambda x: F.get(flags, x["p"]))
        front = lambda r: F.slice(at, r["a"] + 1, r["b"] - r["a"])
        counts = F.transform(rows, lambda r: F.size(hit(own(at, r))).cast("long"))

        def line(r, h):
            return let(hit(front(r)), lambda f: let(hit(own(at, r)), lambda e: F.struct(
                *(r[c].alias(c) for c in ("k", "line", "a", "b", "d")), F.get(h, r["k"]).alias("h"),
                F.coalesce(F.array_max(F.transform(f, lambda x: x["next"])), F.lit(-1)).alias("lim"),
                F.coalesce(F.array_min(F.transform(e, lambda x: x["prev"])), F.lit(FAR)).alias("low"),
                (F.size(f) == F.size(front(r))).alias("front"), (F.size(e) == F.size(own(at, r))).alias("behind"))))

        return let(running(counts), lambda h: F.transform(rows, lambda r: line(r, h)))

    def last_end(lines, x):
        """Number of the last line that a run from ``x`` may end with; a binary search."""
        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            y = F.get(lines, mid)
            fits = (y["b"] - 2 < x["lim"]) & (y["d"] - x["d"] <= most)
            return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid - 1).alias("hi"))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lines) + 1)).cast("int"))
        return F.aggregate(steps, F.struct(x["k"].alias("lo"), (F.size(lines) - 1).alias("hi")),
                           lambda s, i: F.when(s["lo"] < s["hi"], halve(s, i)).otherwise(s), lambda s: s["lo"])

    def able(x, y):
        return (y["b"] - x["a"] - 1 >= least) & (y["h"] - x["h"] + x["b"] - x["a"] >= least)

    def ends(lines, flags, x, k):
        def counted(y, fresh):
            mine = F.filter(fresh, lambda q: q["p"] <= y["b"] - 2)
            return let(mine, lambda m: F.struct(
                (-2.0 * F.size(F.filter(m, lambda q: F.get(flags, q["p"]))) / (F.size(m) + n)).alias("less"),
                (y["line"] - x["line"]).alias("more"), x["line"].alias("line"), y["line"].alias("last")))

        def tried(y):
            before, after = F.get(lines, x["k"] - 1), F.get(lines, y["k"] + 1)
            better = F.coalesce(before["front"] & (before["lim"] > y["b"] - 2), F.lit(False)) | F.coalesce(
                after["behind"] & (after["low"] < x["a"]), F.lit(False))
            return (y["low"] < x["a"]) & able(x, y) & ~better

        fresh = F.filter(F.slice(at, x["a"] + 1, F.get(lines, k)["b"] - 1 - x["a"]), lambda q: q["prev"] < x["a"])
        return let(F.filter(F.slice(lines, x["k"] + 2, k - x["k"]), tried), lambda some: F.when(F.size(some) > 0, let(
            fresh, lambda new: F.transform(some, lambda y: counted(y, new)))))

    def from_line(lines, flags, x):
        return let(last_end(lines, x), lambda k: F.when((k > x["k"]) & able(x, F.get(lines, k)), ends(lines, flags, x, k)))

    def all_runs(lines, flags):
        first = F.filter(lines, lambda x: x["lim"] >= x["a"] + least)
        return F.flatten(F.filter(F.transform(first, lambda x: from_line(lines, flags, x)), lambda r: r.isNotNull()))

    runs = let(F.transform(grams, lambda g, i: F.get(maybe, i) & F.array_contains(t["grams"], g)),
               lambda flags: let(described(flags), lambda lines: all_runs(lines, flags)))
    found = let(F.filter(hits, lambda m: m["license"] == t["name"]), lambda mine: F.filter(
        runs, lambda r: (-r["less"] >= threshold) & ~F.exists(mine, lambda m: (m["dice"] >= -r["less"]) & (
            (m["line"] == -1) | m["line"].between(r["line"], r["last"])))))
    none = F.expr("cast(array() as array<struct<less: double, more: int, line: int, last: int>>)")
    apart = F.aggregate(F.array_sort(found), none, lambda kept, r: F.when(
        F.exists(kept, lambda k: (k["line"] <= r["last"]) & (r["line"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(r))))
    return F.transform(apart, lambda r: F.struct((-r["less"]).alias("dice"), r["line"].alias("line"), r["last"].alias("last"),
                                                 t["name"].alias("license")))


def scan(docs: DataFrame, threshold: float = THRESHOLD, texts: dict[str, str] | None = None) -> DataFrame:
    """``docs (doc_id, text)`` -> ``doc_id, n_units, matches``; a match is
    ``(line, license, dice, last)``, best first; ``n_units`` counts the lines."""
    enough = lambda n, grams: n * (2 - threshold) >= F.size(grams) * threshold
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9\\n]+", " ")
    df = docs.select("doc_id", plain.alias("plain"))
    df = df.select("doc_id", "plain", F.split(F.trim(F.regexp_replace("plain", "[ \n]+", " ")), " ").alias("words"))
    df = df.select("doc_id", "plain", pairs(F.col("words")).alias("grams"))
    df = df.select("doc_id", "plain", "grams", F.array_distinct(F.filter("grams", lambda g: perhaps(g, texts))).alias("seen"))
    near = F.filter(templates(texts), lambda t: enough(F.size("seen"), t["grams"]) & enough(
        F.size(F.array_intersect(t["grams"], F.col("seen"))), t["grams"]))
    df = df.select("doc_id", "plain", "grams", near.alias("near"))
    some = F.size("near") > 0
    lines = F.transform(F.split("plain", "\n"), lambda x: F.split(F.trim(x), " "))
    df = df.select("doc_id", "near", F.when(some, F.col("grams")).otherwise(F.expr("cast(array() as array<string>)")).alias("grams"),
                   F.size(F.split("plain", "\n")).cast("long").alias("n_units"),
                   F.when(some, lines).otherwise(F.expr("cast(array() as array<array<string>>)")).alias("lines"))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.array_distinct("grams").alias("grams"))), F.transform(
        "lines", lambda w, i: F.struct(i.alias("line"), F.array_distinct(pairs(w)).alias("grams"))))

    def compared(u: Column) -> Column:
        n = F.size(u["grams"])
        close = F.filter("near", lambda t: enough(n, t["grams"]) & (F.size(t["grams"]) * (2 - threshold) >= n * threshold))
        return F.transform(close, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + F.size(t["grams"]))).alias("dice"),
            u["line"].alias("line"), u["line"].alias("last"), t["name"].alias("license")))

    hits = F.filter(F.flatten(F.transform(units, compared)), lambda m: m["dice"] >= threshold)
    df = df.select("doc_id", "n_units", "near", "grams", hits.alias("hits"), F.filter(F.transform(
        "lines", lambda w, i: F.struct(i.alias("line"), F.when(w[0] != "", F.size(w)).cast("long").alias("n"))),
        lambda x: x["n"].isNotNull()).alias("rows"))
    rows = let(running(F.col("rows")["n"]), lambda end: F.transform("rows", lambda r, k: F.struct(
        k.alias("k"), r["line"].alias("line"), (F.get(end, k) - r["n"]).cast("int").alias("a"), F.get(end, k).cast("int").alias("b"))))
    df = df.select("doc_id", "n_units", "near", "grams", "hits", rows.alias("rows"), neighbours(F.col("grams")).alias("at"),
                   F.transform("grams", lambda g: perhaps(g, texts)).alias("maybe"))
    new = F.transform("rows", lambda r: F.size(F.filter(own(F.col("at"), r), lambda x: x["prev"] < 0)).cast("long"))
    rows = let(running(new), lambda d: F.transform("rows", lambda r: F.struct(
        *(r[c].alias(c) for c in ("k", "line", "a", "b")), F.get(d, r["k"]).alias("d"))))
    df = df.select("doc_id", "n_units", "near", "grams", "hits", "at", "maybe", rows.alias("rows"))
    runs = F.flatten(F.transform("near", lambda t: best_runs(
        t, F.col("at"), F.col("grams"), F.col("maybe"), F.col("rows"), F.col("hits"), threshold)))
    df = df.select("doc_id", "n_units", F.concat("hits", runs).alias("hits"))
    best = F.array_sort(F.transform("hits", lambda m: F.struct(
        (-m["dice"]).alias("less"), m["line"].alias("line"), m["license"].alias("license"), m["last"].alias("last"))))
    return df.select("doc_id", "n_units", F.transform(best, lambda m: F.struct(
        m["line"].alias("line"), m["license"].alias("license"), (-m["less"]).alias("dice"), m["last"].alias("last"))).alias("matches"))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: its best match and the names of all it matches
    (without a match: an empty name, coefficient 0 and line -2)."""
    df = scan(docs, **kw)
    best = F.try_element_at("matches", F.lit(1))
    return df.select("doc_id", "n_units", F.size("matches").cast("long").alias("n_matches"), F.coalesce(best["license"], F.lit("")).alias("license"),
                     F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), F.coalesce(best["line"], F.lit(-2)).alias("line"),
                     F.array_join(F.array_sort(F.array_distinct(F.col("matches")["license"])), ",").alias("licenses"))
