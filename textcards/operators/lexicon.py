"""C4 lexicon labelling: F7 J5 J6 A2 A3 K1 U3 F5 P15 A8 K3 as one narrow Spark stage.

Plan shape (see ``explain``)::

    scan(id, text)
      -> project(id, lower(text), sentences)
      -> BroadcastNestedLoopJoin  exists(keywords, k -> contains(text, k))
             with the *label table*: one row per label, its keywords as an array
      -> project(hits, confidence, evidence, quotes)   # higher-order functions

There is no shuffle: every (record, label) result is computed inside the
joined row, so the job scales with the scan.  The only broadcast is the
label table, whose keywords are counted first; past ``MAX_JOIN_KEYWORDS``,
where testing keyword after keyword costs more than one walk of an automaton,
``keyword_automaton`` finds them with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards.functions.text import normalize_sentence, split_sentences
from textcards.operators.common import bounded_broadcast
from textcards.operators.keyword_automaton import (automaton_matches, evidence_of,
                                                   lexicon_entries, ranking_of)

# Keywords of the broadcast label table; the join costs one substring test each
# per record, an automaton about as much as 100 of them.
MAX_JOIN_KEYWORDS = 1_000

LEXICON_SCHEMA = "field string, label string, label_pos int, kw_pos int, keyword string"
TAXONOMY_SCHEMA = "field string, label string, label_pos int"


# Small in-code tables become JVM literals (no Python worker is started to
# read them); larger ones go through createDataFrame.
MAX_LITERAL_ROWS = 5_000


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed table as a literal relation (``inline`` of structs)."""
    if not rows or len(rows) > MAX_LITERAL_ROWS:
        return spark.createDataFrame(rows, schema)
    cols = [c.strip().split(" ") for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, cols)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def lexicon_table(spark: SparkSession, mapping: dict) -> DataFrame:
    """``{field: {label: [keyword, ...]}}`` -> lexicon rows in declaration order."""
    rows = []
    for field, labels in mapping.items():
        for label_pos, (label, kws) in enumerate(labels.items()):
            for kw_pos, kw in enumerate(kws):
                rows.append((field, label, label_pos, kw_pos, kw))
    return local_table(spark, rows, LEXICON_SCHEMA)


def taxonomy_table(spark: SparkSession, mapping: dict) -> DataFrame:
    """``{field: [label, ...]}`` -> taxonomy rows with the label's list position."""
    rows = [(field, label, pos) for field, labels in mapping.items()
            for pos, label in enumerate(labels)]
    return local_table(spark, rows, TAXONOMY_SCHEMA)


def label_table(lexicon: DataFrame, taxonomy: DataFrame | None = None,
                fields=None) -> DataFrame:
    """One row per label: ``(field, label, label_pos, kws array<string>)``.

    Keywords are lower-cased once (constant folding) and kept in keyword
    order, duplicates included (a keyword listed twice counts twice).  With
    a taxonomy, labels outside it are dropped (F5) before any text is read.
    """
    lex = lexicon
    if fields is not None:
        lex = lex.where(F.col("field").isin(list(fields)))
    if taxonomy is not None:
        # both sides are label-space sized: Spark's own size estimate picks the join
        lex = lex.join(taxonomy.select("field", "label"), ["field", "label"], "left_semi")
    return (lex.groupBy("field", "label", "label_pos")
            .agg(F.sort_array(F.collect_list(F.struct("kw_pos", F.lower("keyword").alias("kw"))))
                 .alias("_k"))
            .select("field", "label", "label_pos",
                    F.transform("_k", lambda x: x["kw"]).alias("kws")))


def evidence_label_table(taxonomy: DataFrame, evidence_lexicon: DataFrame | None) -> DataFrame:
    """Every taxonomy label with its evidence keywords; a label without
    any falls back to its own name with ``_`` read as a space."""
    kw = (label_table(evidence_lexicon).select("field", "label", "kws")
          if evidence_lexicon is not None else None)
    t = taxonomy.select("field", "label", "label_pos")
    if kw is not None:
        t = t.join(kw, ["field", "label"], "left")
    else:
        t = t.withColumn("kws", F.lit(None).cast("array<string>"))
    return t.select("field", "label", "label_pos",
                    F.coalesce("kws", F.array(F.lower(F.replace("label", F.lit("_"), F.lit(" ")))))
                    .alias("kws"))


def _is_large(lexicon: DataFrame) -> bool:
    return lexicon.limit(MAX_JOIN_KEYWORDS + 1).count() > MAX_JOIN_KEYWORDS


def _prepared_docs(docs: DataFrame, id_cols, text_col: str, quotes: bool,
                   normalized: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    if quotes:
        d = docs.select(*id_cols, F.lower(text).alias("_tl"), split_sentences(text).alias("_so"))
        d = d.withColumn("_sl", F.transform("_so", F.lower))
        if normalized:      # once per record, before the join fans out to labels
            d = d.withColumn("_sn", F.transform("_so", normalize_sentence))
        return d
    # split(lower(t)) == map(lower, split(t)): lowering never adds or removes a
    # sentence boundary, so one split of the lowered text is enough.
    d = docs.select(*id_cols, F.lower(text).alias("_tl"))
    return d.withColumn("_sl", split_sentences(F.col("_tl")))


def _match(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(labels), F.expr("exists(kws, k -> contains(_tl, k))"), "inner")


def _confidence():
    return F.least(F.lit(0.95), F.lit(0.3) + F.lit(0.2) * F.col("hits"))


def _ids(id_col):
    return [id_col] if isinstance(id_col, str) else list(id_col)


# A "word character" for whole-word matching (letters,
# digits, underscore), as in the tokenizer.
WORD_CHAR = "[\\p{L}\\p{N}_]"


def _occurs(text, kw, whole_word: bool):
    """``kw`` in ``text`` (both lower-cased); with ``whole_word`` the match
    must not touch a word character on either side.  The substring test runs
    first, so the regex only runs on candidates."""
    hit = F.contains(text, kw)
    if not whole_word:
        return hit
    pattern = F.concat(F.lit("(?<!" + WORD_CHAR + ")\\Q"), kw, F.lit("\\E(?!" + WORD_CHAR + ")"))
    return hit & F.regexp(text, pattern)


def _ranked_sentences(kws, sl, so, k: int):
    """K3 inside the row: the top-``k`` sentences by how many of ``kws`` they
    contain (positive only; ties in sentence order), as
    ``array<struct<sent_idx, score, sentence>>``."""
    scores = F.transform(sl, lambda s, i: F.struct(
        (-F.size(F.filter(kws, lambda kw: F.contains(s, kw)))).alias("neg"), i.alias("idx")))
    top = F.slice(F.array_sort(F.filter(scores, lambda x: x["neg"] < 0)), 1, k)
    return F.transform(top, lambda x: F.struct(
        x["idx"].alias("sent_idx"), (-x["neg"]).cast("bigint").alias("score"),
        F.element_at(so, x["idx"] + 1).alias("sentence")))


def lexicon_predict(docs: DataFrame, lexicon: DataFrame, id_col="doc_id",
                    text_col: str = "text", taxonomy: DataFrame | None = None,
                    fields=None, max_evidence: int = 3, quotes: bool = False,
                    whole_word: bool = False, ranked_k: int = 0,
                    keep_sentences: bool = False) -> DataFrame:
    """Long-form lexicon predictions, one row per (record, predicted label).

    ``(id.., field, label, label_pos, hits, confidence, evidence array<int>
    [, quotes array<string>])``.  ``hits`` = lexicon keywords found as a
    case-insensitive substring of the text; ``confidence = min(0.95, 0.3 +
    0.2*hits)``; ``evidence`` = indices of sentences containing a found
    keyword, ordered by (keyword position, sentence index), first occurrence
    kept, first ``max_evidence`` (so a keyword spanning a sentence end still
    labels the record but gives no evidence).  ``quotes`` are the verbatim
    sentences of ``evidence`` (J8).  Records without any hit have no rows:
    pair with the input ids when a spine is needed.  ``whole_word=True``
    stops a keyword from matching inside a longer word (the reference
    matches substrings: "engine" hits "Engineers").  ``ranked_k > 0`` adds
    ``ranked``: the label's top sentences by keyword count (K3, computed in
    the row, no join back to the text).  ``keep_sentences`` adds the
    record's ``sentences`` and ``sentences_norm`` (P5-normalised, computed
    once per record) for a following in-row step; drop them before any
    shuffle.
    """
    ids = _ids(id_col)
    need_so = quotes or ranked_k > 0 or keep_sentences
    d = _prepared_docs(docs, ids, text_col, need_so, normalized=keep_sentences)
    cols = [*ids, "field", "label", "label_pos", "hits", "confidence", "evidence"]
    if _is_large(lexicon):
        sentence_columns = {"sentences": "_so", "sentences_norm": "_sn"} if keep_sentences else {}
        found = automaton_matches(d, [*ids, *sentence_columns.values()], lexicon_entries(lexicon, taxonomy, fields),
                                  max_evidence, ranked_k > 0, whole_word)
        evidence, texts = evidence_of(F.col("ev"), max_evidence)
        return found.select(
            *ids, "field", "label", "label_pos", "hits", _confidence().alias("confidence"), evidence.alias("evidence"),
            *([texts.alias("quotes")] if quotes else []),
            *([ranking_of(F.col("rk"), ranked_k).alias("ranked")] if ranked_k > 0 else []),
            *[F.col(c).alias(name) for name, c in sentence_columns.items()])
    j = _match(d, label_table(lexicon, taxonomy, fields))
    tl, sl = F.col("_tl"), F.col("_sl")
    found = F.filter("kws", lambda k: _occurs(tl, k, whole_word))
    # Only the first `max_evidence` sentences of any one keyword can reach
    # the first `max_evidence` distinct indices, so each list is cut there.
    per_kw = F.transform(found, lambda k: F.slice(
        F.array_compact(F.transform(sl, lambda s, i: F.when(_occurs(s, k, whole_word), i))),
        1, max_evidence))
    out = j.select(*ids, "field", "label", "label_pos",
                   F.size(found).cast("bigint").alias("hits"),
                   F.slice(F.array_distinct(F.flatten(per_kw)), 1, max_evidence).alias("evidence"),
                   *([_ranked_sentences(F.col("kws"), sl, F.col("_so"), ranked_k).alias("ranked")]
                     if ranked_k > 0 else []),
                   *(["_so"] if need_so else []), *(["_sn"] if keep_sentences else []))
    if whole_word:      # the join tests substrings only
        out = out.where("hits > 0")
    out = out.withColumn("confidence", _confidence())
    if quotes:
        out = out.withColumn("quotes", F.transform(
            "evidence", lambda i: F.element_at(F.col("_so"), i + 1)))
        cols.append("quotes")
    if ranked_k > 0:
        cols.append("ranked")
    if keep_sentences:
        out = out.withColumn("sentences", F.col("_so")).withColumn("sentences_norm", F.col("_sn"))
        cols += ["sentences", "sentences_norm"]
    return out.select(*cols)


def lexicon_labels(docs: DataFrame, lexicon: DataFrame, id_col="doc_id",
                   text_col: str = "text", taxonomy: DataFrame | None = None,
                   fields=None) -> DataFrame:
    """Labels and confidences only (A2 A3), no sentence work."""
    ids = _ids(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*ids, F.lower(text).alias("_tl"))
    if _is_large(lexicon):
        found = automaton_matches(d, ids, lexicon_entries(lexicon, taxonomy, fields))
        return found.select(*ids, "field", "label", "label_pos", "hits", _confidence().alias("confidence"))
    j = _match(d, label_table(lexicon, taxonomy, fields))
    hits = F.size(F.filter("kws", lambda k: F.contains(F.col("_tl"), k))).cast("bigint")
    return (j.select(*ids, "field", "label", "label_pos", hits.alias("hits"))
            .withColumn("confidence", _confidence()))


def keyword_sentence_ranking(docs: DataFrame, picked: DataFrame, evidence_labels: DataFrame,
                             id_col="doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """For each picked (record, label), the top-``k`` sentences
    by number of the label's evidence keywords they contain (case
    insensitive); only positive scores; ties keep sentence order.  Returns
    ``(id.., field, label, rank, sent_idx, score, sentence)`` with the
    verbatim sentence text.

    ``picked``: (id.., field, label) rows; ``evidence_labels``: output of
    ``evidence_label_table``.  ``picked`` is joined to the records once by id
    (both sides shuffle on id), then all ranking happens inside the row.
    """
    ids = _ids(id_col)
    lab = bounded_broadcast(evidence_labels.select("field", "label", "kws"))
    per_doc = (picked.select(*ids, "field", "label").distinct()
               .join(lab, ["field", "label"], "inner"))
    d = _prepared_docs(docs, ids, text_col, quotes=True)
    j = d.join(per_doc, ids, "inner")
    scores = F.transform("_sl", lambda s, i: F.struct(
        (-F.size(F.filter("kws", lambda kw: F.contains(s, kw)))).alias("neg"), i.alias("idx")))
    top = F.slice(F.array_sort(F.filter(scores, lambda x: x["neg"] < 0)), 1, k)
    ranked = j.select(*ids, "field", "label", "_so", F.posexplode(top).alias("_r", "_x"))
    return ranked.select(*ids, "field", "label", (F.col("_r") + 1).alias("rank"),
                         F.col("_x.idx").alias("sent_idx"),
                         (-F.col("_x.neg")).cast("bigint").alias("score"),
                         F.element_at("_so", F.col("_x.idx") + 1).alias("sentence"))
