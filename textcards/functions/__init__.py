"""Column -> Column building blocks."""

from textcards.functions.text import (  # noqa: F401
    PY_WHITESPACE, WS, badge, clean_text, display_name, infer_date, missing_text_flag,
    normalize_label, normalize_sentence, normalize_whitespace, parse_date, preview,
    py_strip, source_entries, split_sentences, token_count, uni_bi_grams, word_tokens,
)
from textcards.functions.html import paragraph_text  # noqa: F401
from textcards.functions.labels import (  # noqa: F401
    multi_hot, sigmoid32, picked_by_threshold,
)
