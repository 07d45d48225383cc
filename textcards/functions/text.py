"""Scalar text functions (``Column -> Column``), all JVM-side built-ins.

Whitespace follows Python's ``str.isspace`` (which also drives
``str.strip``, ``str.split()`` and ``re``'s ``\\s``), not Java's ASCII
``\\s``: the set is spelled out so Spark and DuckDB agree with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts.
PY_WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)


def _java_class(codepoints) -> str:
    return "[" + "".join("\\x{%X}" % c for c in codepoints) + "]"


# Java-regex character class equal to Python's \s on str patterns.
WS = _java_class(PY_WHITESPACE_CODEPOINTS)
NOT_WS = "[^" + WS[1:]

# Sentence boundary = whitespace run preceded by . ! or ?
SENTENCE_END_CHARS = ".!?"
SENTENCE_SPLIT_RE = "(?<=[.!?])" + WS + "+"

# Word token: maximal run of two or more word characters (letters, digits,
# underscore); Python's default vectoriser pattern on lower-cased text.
TOKEN_RE = "[\\p{L}\\p{N}_]{2,}"
NOT_TOKEN_RE = "[^\\p{L}\\p{N}_]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: trim every Python whitespace code point from both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def normalize_whitespace(c) -> Column:
    """P2 ``normalize``: ``\\r``->``\\n``, 3+ newlines->2, ``[ \\t]+``->space, strip."""
    t = F.translate(col_(c), "\r", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    return py_strip(t)


def clean_text(c) -> Column:
    """P3 + P2: missing text becomes ``""`` before normalising."""
    return normalize_whitespace(F.coalesce(col_(c), F.lit("")))


def split_sentences(c) -> Column:
    """Ordered sentence array; empty text gives ``[]``.

    Strip, split on whitespace preceded by ``.``/``!``/``?``, strip each
    piece, drop empties.  The array position is the evidence index.
    """
    parts = F.split(py_strip(c), SENTENCE_SPLIT_RE)
    return F.filter(F.transform(parts, py_strip), lambda s: s != F.lit(""))


def normalize_sentence(c) -> Column:
    """P5: strip and collapse every whitespace run to one space."""
    return F.regexp_replace(py_strip(c), WS + "+", " ")


def normalize_label(c) -> Column:
    """Label trim."""
    return py_strip(c)


def token_count(c) -> Column:
    """P12 ``len(text.split())``: number of non-whitespace runs (0 for empty)."""
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(NOT_WS + "+"))


def word_tokens(c) -> Column:
    """Lower-case, maximal runs of >= 2 word characters, in order."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TOKEN_RE), 0)


def spaced_words(c) -> Column:
    """P13 as one text: the lower-cased runs of word characters (those of one
    character too) with a space between them."""
    return F.regexp_replace(F.lower(col_(c)), NOT_TOKEN_RE, " ")


def uni_bi_grams(tokens) -> Column:
    """Unigrams followed by space-joined bigrams of an ordered token array."""
    # Lambdas touch only their own arguments: a lambda that indexes an outer
    # array expression re-evaluates that expression once per element.
    t = col_(tokens)
    nxt = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    bigrams = F.array_compact(F.zip_with(t, nxt, lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(t, bigrams)


def infer_date(record_id, prior_date=None) -> Column:
    """A prior date wins, else the first ``20dd-dd-dd`` in the id, else null."""
    from_id = F.nullif(F.regexp_extract(col_(record_id), "(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1),
                       F.lit(""))
    if prior_date is None:
        return from_id
    return F.coalesce(F.nullif(col_(prior_date), F.lit("")), from_id)


def parse_date(c) -> Column:
    """Tolerant ``%Y-%m-%d`` parse (a four-digit year, month and day of one
    or two digits); bad or empty values become null."""
    ok = F.rlike(col_(c), F.lit("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"))
    return F.when(ok, F.try_to_timestamp(col_(c), F.lit("y-M-d")).cast("date"))


def display_name(name, record_id) -> Column:
    """Stripped name, or the id when blank."""
    return F.coalesce(F.nullif(py_strip(F.coalesce(col_(name), F.lit(""))), F.lit("")),
                      col_(record_id))


def source_entries(url, retrieved_date) -> Column:
    """P10: ``[]`` for an empty url; the date key only when non-empty."""
    u = py_strip(F.coalesce(col_(url), F.lit("")))
    d = F.nullif(py_strip(F.coalesce(col_(retrieved_date), F.lit(""))), F.lit(""))
    entry = F.struct(u.alias("url"), d.alias("retrieved_date"))
    return F.when(u != F.lit(""), F.array(entry)).otherwise(
        F.array().cast("array<struct<url:string,retrieved_date:string>>"))


def missing_text_flag(text) -> Column:
    """``true`` only when the text is empty, else null (key absent)."""
    return F.when(F.coalesce(col_(text), F.lit("")) == F.lit(""), F.lit(True))


def preview(text, n: int = 900) -> Column:
    """First ``n`` characters, with ``...`` appended when longer."""
    t = col_(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def badge(label, confidence) -> Column:
    """``label (p=0.50)``; just the label when there is no confidence."""
    return F.when(col_(confidence).isNull(), col_(label)).otherwise(
        F.format_string("%s (p=%.2f)", col_(label), col_(confidence)))


def last_sentence_index(normalized_sentences, text) -> Column:
    """J7 inside a row: 0-based index of the *last* sentence equal to ``text``
    after whitespace normalisation (P5); null when none matches.
    ``normalized_sentences`` is the record's sentence array already passed
    through ``normalize_sentence`` (once per record)."""
    norm = col_(normalized_sentences)
    pos = F.array_position(F.reverse(norm), normalize_sentence(text))
    return F.when(pos > 0, (F.size(norm) - pos).cast("int"))
