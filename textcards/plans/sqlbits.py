"""DuckDB spellings of the Column functions, used by the oracle SQL.

The oracles are an independent re-statement of each query in plain SQL;
these helpers keep the shared rules (whitespace set, sentence split,
tokens) written once.
"""

from __future__ import annotations

from textcards.functions.text import PY_WHITESPACE_CODEPOINTS

WS_CLASS = "[" + "".join("\\x{%X}" % c for c in PY_WHITESPACE_CODEPOINTS) + "]"
WS_CHARS = "(" + " || ".join("chr(%d)" % c for c in PY_WHITESPACE_CODEPOINTS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def sentences(x: str) -> str:
    """List of sentences of text expression ``x``."""
    split = (f"string_split(regexp_replace({strip(x)}, '([.!?])' || '{WS_CLASS}' || '+', "
             f"'\\1' || chr(1), 'g'), chr(1))")
    return (f"list_filter(list_transform({split}, lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def normalize_sentence(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS_CLASS}+', ' ', 'g')"


def sql_str(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, columns) -> str:
    """``(VALUES ...) AS t(cols)`` body for a small fixed table."""
    body = ", ".join("(" + ", ".join(
        sql_str(v) if isinstance(v, str) or v is None else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def lexicon_values(mapping: dict) -> str:
    rows = []
    for field, labels in mapping.items():
        for lp, (label, kws) in enumerate(labels.items()):
            for kp, kw in enumerate(kws):
                rows.append((field, label, lp, kp, kw))
    return values(rows, ["field", "label", "label_pos", "kw_pos", "keyword"])


def taxonomy_values(mapping: dict) -> str:
    rows = [(f, l, p) for f, labels in mapping.items() for p, l in enumerate(labels)]
    return values(rows, ["field", "label", "label_pos"])
