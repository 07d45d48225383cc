"""Label-space expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textcards.functions.text import col_


def multi_hot(label_list, labels) -> Column:
    """0/1 vector over an ordered label list; unknown labels ignored,
    duplicates collapse."""
    ll, labs = col_(label_list), col_(labels)
    return F.transform(ll, lambda l: F.coalesce(F.array_contains(labs, l), F.lit(False)).cast("int"))


def sigmoid32(logit) -> Column:
    """Logistic function evaluated in float32, as the reference does on a
    float32 logit vector (so a logit of -1e-9 still gives exactly 0.5)."""
    x = col_(logit).cast("float")
    e = F.exp((-x).cast("double")).cast("float")
    return (F.lit(1.0).cast("float") / (F.lit(1.0).cast("float") + e)).cast("float")


def picked_by_threshold(prob, threshold: float = 0.5) -> Column:
    """Keep a label when its probability is ``>= threshold``."""
    return col_(prob) >= F.lit(threshold).cast("float")
