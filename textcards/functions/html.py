"""Visible paragraph text of an HTML page, as one Column expression.

No parser: a fixed sequence of regex rewrites and array functions that
runs inside the scan stage.  Rules (decided once, tested in
tests/test_html.py):

1. drop comments, then ``script`` / ``style`` / ``noscript`` blocks (a
   script may contain a literal ``</p>``);
2. a ``<p ...>`` tag opens a paragraph (mark A); ``</p>`` and any
   block-level open/close tag ends it (mark B).  A new ``<p>`` therefore
   closes an open one, so unclosed paragraphs do not repeat text;
3. inside a paragraph every tag separates text nodes; nodes are decoded,
   stripped, empties dropped, joined by one space;
   a ``<`` that opens no tag (``a < b``) is text.  Decoded are numeric
   character references (decimal and hex) and the named ones of HTML 4, in
   one pass, so ``&amp;lt;`` stays ``&lt;``;
4. empty paragraphs are dropped, paragraphs joined by ``\\n``, runs of
   spaces/tabs collapsed, the result stripped.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from textcards.functions.text import col_, py_strip

# The markers and the tag/entity rules above.
MARK_BREAK = "\x01"
MARK_OPEN = "\x02"
MARK_NODE = "\x03"
COMMENT_RE = "(?s)<!--.*?-->"
DROPPED_BLOCK_TAGS = ["script", "style", "noscript"]
PARA_OPEN_RE = "(?i)<p(\\s[^>]*)?>"
BLOCK_TAGS = ["p", "article", "div", "section", "main", "nav", "footer", "header",
              "ul", "ol", "li", "table", "body", "html",
              "h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_RE = "(?i)</?(" + "|".join(BLOCK_TAGS) + ")(\\s[^>]*)?>"
TAG_RE = "</?[a-zA-Z][^>]*>|<[!?][^>]*>"
REFERENCE_RE = "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,30});"
# Named references: the standard library's HTML 4 table, and ``&apos;``.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
# What the numbers 128-159 stand for on pages (Windows-1252);
# the five unassigned ones stand for themselves.
C1_CHARACTERS = ("\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f"
                 "\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178")
REPLACEMENT = "\ufffd"        # for numbers that are no character


def dropped_block_re(tag: str) -> str:
    return "(?is)<" + tag + "\\b[^>]*>.*?</" + tag + "\\s*>"


def _character(ref) -> Column:
    """The character a reference names (without ``&`` and ``;``), or null."""
    is_hex = ref.rlike("^#[xX]")
    digits = F.regexp_replace(ref, "^#[xX]?0*", "")          # any number of zeros before the number
    code = (F.when(F.length(digits) > 8, F.lit(0x110000)).when(digits == "", F.lit(0))
            .when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long")))
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    number = (F.when(bad, F.lit(REPLACEMENT))
              .when(code.between(128, 159), F.substring(F.lit(C1_CHARACTERS), (code - 127).cast("int"), F.lit(1)))
              .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    return F.when(ref.startswith("#"), number).otherwise(F.try_element_at(named, ref))


def decode_entities(c) -> Column:
    """Character references decoded in one pass; unknown ones stay as written."""
    parts = F.split(col_(c), "&")

    def part(p, i):
        ref = F.regexp_extract(p, REFERENCE_RE, 1)
        known = F.when(ref != F.lit(""), _character(ref))
        return F.when(i == 0, p).when(known.isNull(), F.concat(F.lit("&"), p)).otherwise(
            F.concat(known, F.substring(p, F.length(ref) + 2, F.length(p))))

    return F.array_join(F.transform(parts, part), "")


def paragraph_text(html) -> Column:
    h = F.regexp_replace(F.coalesce(col_(html), F.lit("")), COMMENT_RE, "")
    for tag in DROPPED_BLOCK_TAGS:
        h = F.regexp_replace(h, dropped_block_re(tag), "")
    h = F.regexp_replace(h, PARA_OPEN_RE, MARK_BREAK + MARK_OPEN)
    h = F.regexp_replace(h, BLOCK_RE, MARK_BREAK)
    pieces = F.split(h, MARK_BREAK)
    paras = F.filter(pieces, lambda p: p.startswith(MARK_OPEN))

    def para(p):
        nodes = F.split(decode_entities(F.regexp_replace(F.substring(p, 2, 1 << 30), TAG_RE,
                                                         MARK_NODE)), MARK_NODE)
        kept = F.filter(F.transform(nodes, py_strip), lambda s: s != F.lit(""))
        return F.array_join(kept, " ")

    texts = F.filter(F.transform(paras, para), lambda s: s != F.lit(""))
    return py_strip(F.regexp_replace(F.array_join(texts, "\n"), "[ \t]+", " "))
