"""Driver queries: each reads the given tables under ``sf_dir`` and returns a
DataFrame whose columns match the DuckDB twin in ``oracles.py``.

Doubles that come out of sums/averages are rounded to 9 places so the
order in which partitions add up cannot change the compared value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards import lexicons as LX
from textcards.functions.html import paragraph_text
from textcards.functions.text import clean_text, split_sentences
from textcards.operators.common import stored, stored_by
from textcards.operators.lexicon import lexicon_predict, lexicon_table, taxonomy_table
from textcards.operators.sentences import sentences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Primary key of each driver table (used to spread a scan that has too few splits).
TABLE_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id",
              "embeddings": "vec_id", "labels": "doc_id", "orders": "o_orderkey",
              "benchmark": "item_id", "events": "event_id"}


# Tables whose rows carry text: per-row work is CPU-heavy, so the scan of a
# small one is spread over the cores (see ``read_parquet``).
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from textcards.sources.readers import read_parquet
    path = f"{sf_dir}/{name}.parquet"
    if name not in TEXT_TABLES:
        return spark.read.parquet(path)
    return read_parquet(spark, path, TABLE_KEYS.get(name), spread_to=spark.sparkContext.defaultParallelism)


def doc_lexicon(spark):
    return lexicon_table(spark, LX.DOCUMENT_LEXICON)


def doc_taxonomy(spark):
    return taxonomy_table(spark, LX.DOCUMENT_TAXONOMY)


def ints_csv(c) -> F.Column:
    """``[1, 3]`` -> ``'1,3'`` (scalar form for comparison)."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- P4 -------------------------------------------------------------------
@query
def q_sentences(spark, sf_dir):
    return sentences(table(spark, sf_dir, "documents"), "doc_id")


@query
def q_conversation_sentences(spark, sf_dir):
    return sentences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


# --- C2: P3 P2 F1 -----------------------------------------------------------
@query
def q_clean_min_chars(spark, sf_dir, min_chars: int = 200):
    docs = table(spark, sf_dir, "documents")
    cleaned = docs.select("doc_id", clean_text("text").alias("text"))
    return (cleaned.where(F.length("text") >= min_chars)
            .select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars")))


# --- C3: P1 -----------------------------------------------------------------
@query
def q_page_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", paragraph_text("html").alias("text"))


@query
def q_page_text_references(spark, sf_dir):
    """P1 on pages that hold character references and a ``<`` that opens no
    tag: each page's own text follows a paragraph made from its page_id."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    made = F.concat(F.lit("<p>n&#"), (n % 900 + 160).cast("string"), F.lit("; x&#x"), F.hex(n % 3000 + 8192),
                    F.lit("; a < b &mdash; &rsquo;q&rsquo; &eacute;&Eacute; &amp;lt; &amp;#65; &unknown; &#0; &#150; c > d & e &#8364</p>"))
    return pages.select("page_id", paragraph_text(F.concat(made, F.coalesce("html", F.lit("")))).alias("text"))


# --- C4: F7 J5 J6 A2 A3 K1 U3 F5 ------------------------------------------------
def _doc_predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexicon_predict(docs, doc_lexicon(spark), "doc_id", "text", doc_taxonomy(spark))


@query
def q_lexicon_predict(spark, sf_dir):
    p = _doc_predictions(spark, sf_dir)
    return p.select("doc_id", "field", "label", "label_pos", "hits", "confidence")


@query
def q_lexicon_evidence(spark, sf_dir):
    p = _doc_predictions(spark, sf_dir)
    return p.select("doc_id", "field", "label", ints_csv("evidence").alias("evidence"))


# --- shared derivations from the driver tables ---------------------------------
ROUND = 9


def r9(c):
    return F.round(c, ROUND)


def gold_tables(spark, sf_dir):
    """Gold labels of the labelled documents, long form, and their ids.

    language = the document's ``lang``; quality = high/low from
    ``labels.quality``; toxicity = ``toxic`` when ``labels.toxic = 1``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")      # ids and languages only: no spreading
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    g = docs.select("doc_id", "lang").join(lab, "doc_id", "inner")
    long = (g.select("doc_id", F.explode(F.array(
        F.struct(F.lit("language").alias("field"), F.col("lang").alias("label")),
        F.struct(F.lit("quality").alias("field"),
                 F.when(F.col("quality") == 1, "high").otherwise("low").alias("label")),
        F.struct(F.lit("toxicity").alias("field"),
                 F.when(F.col("toxic") == 1, "toxic").alias("label")))).alias("x"))
        .select(F.col("doc_id").alias("id"), "x.field", "x.label")
        .where(F.col("label").isNotNull()))
    ids = docs.select(F.col("doc_id").alias("id")).join(
        lab.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return long, ids


def gold_label_maps(spark, sf_dir):
    """``(doc_id, labels map<string,array<string>>)`` for labelled documents."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (docs.select("doc_id", "lang").join(lab, "doc_id", "inner")
            .select("doc_id", F.create_map(
                F.lit("language"), F.array("lang"),
                F.lit("quality"), F.array(F.when(F.col("quality") == 1, "high").otherwise("low")),
                F.lit("toxicity"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic")))
                .otherwise(F.array().cast("array<string>"))).alias("labels")))


def gold_taxonomy(spark):
    return taxonomy_table(spark, LX.GOLD_TAXONOMY)


# --- C8: J3 J10 F4 A1 A10-A14 P18 -------------------------------------------------
def _label_metrics(spark, sf_dir):
    from textcards.operators.lexicon import lexicon_labels
    from textcards.operators.metrics import label_metrics
    docs = table(spark, sf_dir, "documents")
    pred = (lexicon_labels(docs, doc_lexicon(spark), "doc_id", "text", doc_taxonomy(spark))
            .select(F.col("doc_id").alias("id"), "field", "label"))
    gold, gold_ids = gold_tables(spark, sf_dir)
    pred_ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"))
    return label_metrics(gold, pred, gold_ids, pred_ids, gold_taxonomy(spark), "id")


@query
def q_label_metrics(spark, sf_dir):
    per_label, _ = _label_metrics(spark, sf_dir)
    return per_label.select("field", "label", "label_pos", "tp", "fp", "fn", "support",
                            r9("precision").alias("precision"), r9("recall").alias("recall"),
                            r9("f1").alias("f1"))


@query
def q_micro_macro(spark, sf_dir):
    _, per_field = _label_metrics(spark, sf_dir)
    return per_field.select("field", "n", "n_scored",
                            *[r9(c).alias(c) for c in ("micro_precision", "micro_recall",
                                                        "micro_f1", "macro_f1")])


# --- C10: P6 F6 P20 A16 A17 -------------------------------------------------------
def _flat_gold(spark, sf_dir):
    from textcards.operators.metrics import flat_gold_eval
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return flat_gold_eval(docs, doc_lexicon(spark), {"language": ("lang", "language")},
                          "doc_id", "text")


@query
def q_top1_confusion(spark, sf_dir):
    _, confusion = _flat_gold(spark, sf_dir)
    return confusion


@query
def q_anyhit_accuracy(spark, sf_dir):
    acc, _ = _flat_gold(spark, sf_dir)
    return acc.select("field", "correct", "total", r9("accuracy").alias("accuracy"), "skipped")


def marked_gold(lang, doc_id):
    """Gold labels with the cases a hand-made table has: blank, ``TBD``, padded."""
    k = F.col(doc_id) % 7
    return (F.when(k == 0, F.lit(" TBD ")).when(k == 1, F.lit("  ")).when(k == 2, F.lit(None).cast("string"))
            .when(k == 3, F.concat(F.lit(" "), F.col(lang), F.lit("\t"))).otherwise(F.col(lang)))


def _marked_eval(spark, sf_dir):
    from textcards.operators.metrics import flat_gold_eval
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", marked_gold("lang", "doc_id").alias("gold"))
    return flat_gold_eval(docs, doc_lexicon(spark), {"language": ("gold", "language")}, "doc_id", "text")


@query
def q_flat_gold_skips(spark, sf_dir):
    acc, _ = _marked_eval(spark, sf_dir)
    return acc.select("field", "correct", "total", r9("accuracy").alias("accuracy"), "skipped")


@query
def q_flat_gold_confusion(spark, sf_dir):
    return _marked_eval(spark, sf_dir)[1]


@query
def q_multi_hot(spark, sf_dir):
    """Language labels (one repeated, one unknown) over an ordered list."""
    from textcards.functions.labels import multi_hot
    docs = table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, LX.GOLD_TAXONOMY["language"]))
    labels = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("it"), "lang")).otherwise(F.array("lang", "lang", F.lit("zz")))
    return docs.select("doc_id", ints_csv(multi_hot(names, labels)).alias("hot"))


@query
def q_last_per_id(spark, sf_dir):
    """A1: of the turns of a conversation the last one counts."""
    from textcards.operators.ingest import last_per_id
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))
    return last_per_id(turns.withColumn("ord", F.col("turn")), "conv_id", "ord").select("conv_id", "turn", "role", "n_chars")


# --- A4 A5 / A6 A7 K2 J9 F8 ---------------------------------------------------------
@query
def q_vocab_idf(spark, sf_dir):
    from textcards.operators.tfidf import fit_vocabulary
    v = fit_vocabulary(table(spark, sf_dir, "documents"))
    return v.select("term", "df", r9("idf").alias("idf"))


@query
def q_tfidf_sentences(spark, sf_dir):
    from textcards.operators.tfidf import fit_vocabulary, top_sentences
    docs = table(spark, sf_dir, "documents")
    t = top_sentences(docs, stored_by(fit_vocabulary(docs), "term"), "doc_id", "text", 3)
    return t.select("doc_id", "rank", "sent_idx", r9("score").alias("score"))


@query
def q_doc_tfidf_norms(spark, sf_dir):
    """A6 check: per document, number of in-vocabulary terms and the sum of
    squared normalised weights (1.0 for every non-empty vector)."""
    from textcards.operators.tfidf import fit_vocabulary, tfidf_vectors
    docs = table(spark, sf_dir, "documents")
    v = tfidf_vectors(docs, stored_by(fit_vocabulary(docs), "term"), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"),
                                   F.sum("tf").alias("n_tokens"),
                                   r9(F.sum(F.col("weight") * F.col("weight"))).alias("sq_norm"))


# --- A9 / M1-M5 ---------------------------------------------------------------------
@query
def q_label_state(spark, sf_dir):
    from textcards.operators.ovr import label_states
    gold, ids = gold_tables(spark, sf_dir)
    return label_states(gold, ids, gold_taxonomy(spark), "id")


def _ovr_split(spark, sf_dir):
    """(training documents, test documents, gold) of the K5 split of the labelled documents."""
    from textcards.operators.splits import hash_split
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    gold, ids = gold_tables(spark, sf_dir)
    split = stored(hash_split(ids, "id", 0.2, 13))
    train = docs.join(split.where(F.col("part") == "train"), "id", "left_semi")
    test = docs.join(split.where(F.col("part") == "test"), "id", "left_semi")
    return train, test, gold


@query
def q_ovr_predict(spark, sf_dir):
    from textcards.operators.ovr import ovr_predict
    train, test, gold = _ovr_split(spark, sf_dir)
    preds, _ = ovr_predict(train, test, gold, gold_taxonomy(spark), LX.GOLD_FIELDS, "id")
    return preds.select(F.col("id").alias("doc_id"), "field", "label",
                        F.round("confidence", 6).alias("confidence"),
                        ints_csv("evidence").alias("evidence"))


@query
def q_ovr_optimality(spark, sf_dir):
    """M1: every active label's fit is a minimum of its objective: the largest
    gradient component, recomputed by joins, is within the learner's tolerance."""
    from textcards.operators.ovr import fit_ovr, label_states, optimality
    from textcards.operators.tfidf import fit_vocabulary
    train, _, gold = _ovr_split(spark, sf_dir)
    states = label_states(gold, train.select("id"), gold_taxonomy(spark), "id")
    active = sorted((r["field"], r["label"]) for r in states.where("state = 'active'").collect())
    model = fit_ovr(train, gold, active, stored_by(fit_vocabulary(train), "term"))
    return optimality(model).select("field", "label", "n", "positives", (F.col("max_grad") <= 1e-4).alias("optimal"))


@query
def q_ovr_always_on(spark, sf_dir):
    """Labels that every training record has are predicted at 1.0,
    in alphabetical order, with the record's TF-IDF sentences as evidence."""
    from textcards.operators.ovr import ovr_predict
    train, test, _ = _ovr_split(spark, sf_dir)
    gold = train.select("id", F.lit("scope").alias("field"), F.explode(F.array(F.lit("web"), F.lit("text"), F.lit("off"))).alias("label"))
    tax = taxonomy_table(spark, {"scope": ["web", "never", "text"]})
    preds, _ = ovr_predict(train, test, gold, tax, ["scope"], "id")
    per = preds.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", "confidence"))).alias("l"),
                                  F.first("evidence").alias("evidence"))
    return per.select(F.col("id").alias("doc_id"), F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("labels"),
                      F.array_min(F.transform("l", lambda x: x["confidence"])).alias("confidence"),
                      ints_csv("evidence").alias("evidence"))


# --- K4 K5 K6 K8 U4 P8 F2 -------------------------------------------------------------
@query
def q_time_split(spark, sf_dir):
    from textcards.operators.splits import time_split
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    split, _ = time_split(orders, "o_orderkey", "date", 0.2, 13)
    return split


@query
def q_time_split_string_ids(spark, sf_dir):
    """K4 with string ids of different lengths, many ties on the cut date,
    unpadded, missing and malformed dates."""
    from textcards.operators.splits import time_split
    k = F.col("o_orderkey")
    date = (F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 11 == 1, F.lit("23-4-2")).when(k % 11 == 2, F.lit("12023-01-01"))
            .when(k % 11 == 3, F.lit("-5-01-01")).when(k % 11 == 4, F.date_format("o_orderdate", "yyyy-M-1"))
            .otherwise(F.date_format("o_orderdate", "yyyy-01-01")))
    rid = F.concat(F.lit("record-"), F.reverse(k.cast("string")), F.when(k % 2 == 0, F.lit("-é")).otherwise(F.lit("")))
    orders = table(spark, sf_dir, "orders").select(rid.alias("rid"), date.alias("date")).dropDuplicates(["rid"])
    split, _ = time_split(orders, "rid", "date", 0.2, 13)
    return split


@query
def q_hash_split(spark, sf_dir):
    from textcards.operators.splits import hash_split
    _, ids = gold_tables(spark, sf_dir)
    return hash_split(ids.select(F.col("id").alias("doc_id")), "doc_id", 0.2, 13)


@query
def q_head_split(spark, sf_dir):
    from textcards.operators.splits import head_split
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return head_split(docs, "doc_id", "doc_id", 0.8)


SOURCE_TRAIN = [f"src{i}" for i in range(15)]
SOURCE_TEST = [f"src{i}" for i in range(15, 20)]


@query
def q_source_split(spark, sf_dir):
    from textcards.operators.splits import source_split
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_split(docs, "doc_id", "source", SOURCE_TRAIN, SOURCE_TEST)


# --- C9: J4 J7 F9 U1 A18-A20 P5 ----------------------------------------------------------
def gold_evidence(spark, sf_dir):
    """Gold evidence of the labelled documents: for the gold language label,
    every sentence containing one of that language's gold keywords.
    Computed inside each document row (no join on text)."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    kw = LX.DOCUMENT_GOLD_EVIDENCE["language"]
    kwmap = F.create_map(*[x for lang, kws in kw.items()
                           for x in (F.lit(lang), F.array(*[F.lit(k.lower()) for k in kws]))])
    d = (docs.join(lab, "doc_id", "left_semi")
         .select("doc_id", "lang", split_sentences(F.lower(F.coalesce("text", F.lit(""))))
                 .alias("_sl"), F.element_at(kwmap, F.col("lang")).alias("_kws")))
    idx = F.array_compact(F.transform("_sl", lambda s, i: F.when(
        F.exists(F.coalesce(F.col("_kws"), F.array().cast("array<string>")),
                 lambda k: F.contains(s, k)), i)))
    ev = d.select(F.col("doc_id").alias("id"), F.lit("language").alias("field"),
                  F.col("lang").alias("label"), F.explode(idx).alias("sent_idx"))
    recs = d.select(F.col("doc_id").alias("id"))
    return ev, recs


def _metrics_out(m):
    return m.select("scope", "n_items", *[r9(c).alias(c) for c in (
        "precision_at_1", "precision_at_3", "recall_at_1", "recall_at_3", "coverage")],
        "n_incidents")


@query
def q_evidence_metrics(spark, sf_dir):
    from textcards.operators.evidence import evidence_metrics
    ev, recs = gold_evidence(spark, sf_dir)
    pred = _doc_predictions(spark, sf_dir).select(F.col("doc_id").alias("id"), "field", "label",
                                                  "evidence")
    return _metrics_out(evidence_metrics(ev, recs, pred, LX.DOCUMENT_FIELDS, "id"))


@query
def q_evidence_text_match(spark, sf_dir):
    """Evidence given as sentence *text* (keyword-count ranking, K3), mapped
    back to indices by normalised text (J7, last match wins), then scored
    like C9.  The labels come from the lexicon pass, so ranking and mapping
    both run inside each record's row (no join back to the text)."""
    from textcards.functions.text import last_sentence_index
    from textcards.operators.evidence import evidence_metrics
    docs = table(spark, sf_dir, "documents")
    ev, recs = gold_evidence(spark, sf_dir)
    p = lexicon_predict(docs, doc_lexicon(spark), "doc_id", "text", doc_taxonomy(spark),
                        ranked_k=3, keep_sentences=True)
    pred = p.select(F.col("doc_id").alias("id"), "field", "label", F.array_compact(F.transform(
        "ranked", lambda r: last_sentence_index(F.col("sentences_norm"), r["sentence"])))
        .alias("evidence"))
    return _metrics_out(evidence_metrics(ev, recs, pred, LX.DOCUMENT_FIELDS, "id"))


@query
def q_evidence_external(spark, sf_dir):
    """J7 as a join: evidence texts from outside (other whitespace, repeated
    sentences, texts of no record) mapped to the last index of the sentence."""
    from textcards.functions.text import split_sentences
    from textcards.operators.evidence import evidence_indices_from_text
    from textcards.operators.sentences import sentences
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    known = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    known = known.withColumn("s", split_sentences(F.coalesce("text", F.lit(""))))
    n, off = F.size("s"), F.lit("in no record.")
    some = F.array(F.concat(F.lit("\t"), F.replace(F.get("s", F.lit(0)), F.lit(" "), F.lit("  ")), F.lit(" ")), off,
                   F.get("s", n - 1), F.get("s", F.floor(n / 2).cast("int")))
    given = (known.select("id", F.lit("language").alias("field"), F.col("lang").alias("label"),
                          F.when(n > 0, some).otherwise(F.array(off)).alias("evidence_text"))
             .unionByName(known.select("id", F.lit("all").alias("field"), F.lit("every").alias("label"), F.col("s").alias("evidence_text"))))
    out = evidence_indices_from_text(given, sentences(docs, "id"), "id")
    return out.select(F.col("id").alias("doc_id"), "field", "label", ints_csv("evidence").alias("evidence"))


# --- C11: A21-A24 P12 F2 F3 -----------------------------------------------------------
def _profile_feats(spark, sf_dir):
    from textcards.operators.stats import record_features
    docs = table(spark, sf_dir, "documents")
    feats = record_features(docs.select("doc_id", "text"), "text", "labels", keep=["doc_id"])
    return (feats.drop("labels").join(gold_label_maps(spark, sf_dir), "doc_id", "left"))


@query
def q_dataset_stats(spark, sf_dir):
    from textcards.operators.stats import dataset_profile
    s = dataset_profile(_profile_feats(spark, sf_dir))
    return s.select("n_total", "n_with_text", "n_labeled",
                    r9("avg_length_tokens").alias("avg_length_tokens"),
                    r9("avg_label_cardinality").alias("avg_label_cardinality"))


@query
def q_label_distribution(spark, sf_dir):
    from textcards.operators.stats import profile_label_distribution
    return profile_label_distribution(_profile_feats(spark, sf_dir))


# --- C1: J1 J2 A1 P7 P9-P11 ---------------------------------------------------------------
def roster_tables(spark, sf_dir):
    """Roster from ``orders`` (ids embed the order date), texts from
    ``documents`` (document ``doc_id`` = order key), previous labels from
    ``labels`` (last one per id wins, ordered by ``quality``/``toxic``)."""
    orders = table(spark, sf_dir, "orders")
    rid = F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string"), F.lit("-"),
                   F.date_format("o_orderdate", "yyyy-MM-dd"))
    roster = orders.select(
        rid.alias("incident_id"), F.col("o_orderkey").alias("_key"),
        F.when(F.col("o_orderstatus") == "P", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("name"),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(F.lit("https://example.org/orders/"), F.col("o_orderkey").cast("string")))
        .otherwise(F.lit("")).alias("url"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("")).alias("retrieved_date"))
    keys = roster.select("incident_id", F.col("_key").alias("doc_id"))
    texts = (table(spark, sf_dir, "documents").select("doc_id", "text")
             .join(keys, "doc_id", "inner").select("incident_id", "text"))
    prev = (gold_label_maps(spark, sf_dir)
            .join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
            .join(keys, "doc_id", "inner")
            .select("incident_id", "labels",
                    F.lit(None).cast("map<string,map<string,array<int>>>").alias("evidence_gold"),
                    F.when(F.col("toxic") == 1, F.lit("1999-12-31")).alias("date")))
    return roster, texts, prev


def map_csv(m) -> F.Column:
    """``{k: [a, b]}`` -> ``'k=a,b;...'`` with keys sorted (scalar for comparison)."""
    m = F.col(m) if isinstance(m, str) else m
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(
        k, F.lit("="), F.array_join(F.element_at(m, k), ","))), ";")


@query
def q_roster_build(spark, sf_dir):
    from textcards.operators.ingest import build_records
    roster, texts, prev = roster_tables(spark, sf_dir)
    rec = build_records(roster, texts, prev, "incident_id")
    return rec.select(
        "incident_id", "incident_name", F.length("text").cast("bigint").alias("n_chars"),
        F.size("sources").cast("int").alias("n_sources"),
        F.try_element_at("sources", F.lit(1))["url"].alias("source_url"),
        F.try_element_at("sources", F.lit(1))["retrieved_date"].alias("retrieved_date"),
        "date", "missing_text", map_csv("labels").alias("labels"))


# --- C6: P19 A15 P15 A8 K3 F8 -------------------------------------------------------------
def logit_taxonomy(spark):
    return taxonomy_table(spark, {LX.LOGIT_FIELD: LX.LOGIT_LABELS})


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"), "label")


@query
def q_logit_labels(spark, sf_dir):
    from textcards.operators.logits import logit_labels
    p = logit_labels(_logits(spark, sf_dir), logit_taxonomy(spark), "id", "logits", 0.5)
    return p.select(F.col("id").alias("vec_id"), "label", "label_pos",
                    r9("confidence").alias("confidence"))


@query
def q_epsilon_f1(spark, sf_dir):
    from textcards.functions.labels import multi_hot
    from textcards.operators.logits import epsilon_micro_f1
    lg = _logits(spark, sf_dir)
    # The gold vector over the whole label list
    names = F.array(*map(F.lit, LX.LOGIT_LABELS))
    gold = lg.select("id", multi_hot(names, F.array(F.element_at(names, F.col("label") + 1))).alias("gold"))
    m = epsilon_micro_f1(lg, gold, "id", "logits", "gold", 0.5)
    return m.select("tp", "fp", "fn", r9("precision").alias("precision"),
                    r9("recall").alias("recall"), r9("micro_f1").alias("micro_f1"))


@query
def q_pick_evidence_text(spark, sf_dir):
    from textcards.operators.lexicon import evidence_label_table, keyword_sentence_ranking
    from textcards.operators.logits import logit_labels
    picked = logit_labels(_logits(spark, sf_dir), logit_taxonomy(spark), "id", "logits", 0.5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    ev_lex = lexicon_table(spark, {LX.LOGIT_FIELD: LX.LOGIT_EVIDENCE_KEYWORDS})
    labels = evidence_label_table(logit_taxonomy(spark), ev_lex)
    r = keyword_sentence_ranking(docs, picked.select("id", "field", "label"), labels, "id",
                                 "text", 3)
    return r.select(F.col("id").alias("doc_id"), "label", "rank", "sent_idx", "score", "sentence")


@query
def q_score_logits(spark, sf_dir):
    """The logits path end to end, nested records flattened."""
    from textcards.operators.logits import score_logits
    lg = _logits(spark, sf_dir).select("id", F.lit(LX.LOGIT_FIELD).alias("field"), "logits")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rec = score_logits(docs, lg, logit_taxonomy(spark), lexicon_table(spark, {LX.LOGIT_FIELD: LX.LOGIT_EVIDENCE_KEYWORDS}),
                       [LX.LOGIT_FIELD], "id")
    f = LX.LOGIT_FIELD
    ev = F.col("evidence")[f]
    return rec.select(F.col("id").alias("doc_id"), F.array_join(F.col("pred")[f], ",").alias("labels"),
                      r9(F.aggregate(F.map_values(F.col("confidence")[f]), F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
                      F.array_join(F.transform(F.col("pred")[f], lambda l: F.array_join(ev[l], "|")), ";").alias("evidence"))


# --- C12: P16 P17 J8 / C13: J11 ------------------------------------------------------------
@query
def q_cards(spark, sf_dir):
    from textcards.operators.cards import cards
    docs = table(spark, sf_dir, "documents")
    return cards(docs, doc_lexicon(spark), LX.DOCUMENT_FIELDS, "doc_id", "text",
                 doc_taxonomy(spark))


@query
def q_preview(spark, sf_dir):
    from textcards.functions.text import preview
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", preview("text", 900).alias("preview"))


def annotation_tables(spark, sf_dir):
    """Records (documents + previous gold labels/evidence) and annotation
    answers derived from ``labels``: quality answers when quality = 1
    (with an unknown label and a repeat), language answers when toxic = 1,
    blank answers otherwise."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("incident_id"), "text",
                                                   "lang")
    maps = gold_label_maps(spark, sf_dir).withColumnRenamed("doc_id", "incident_id")
    records = (docs.join(maps, "incident_id", "left")
               .withColumn("evidence_gold", F.when(
                   F.col("labels").isNotNull(),
                   F.create_map(F.lit("language"), F.create_map(F.col("lang"), F.array(F.lit(0)))))))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("incident_id"),
                                               "quality", "toxic")
    q = lab.select("incident_id", F.lit("quality").alias("field"),
                   F.when(F.col("quality") == 1, F.lit(" high , bogus ,high")).otherwise(F.lit(""))
                   .alias("labels_raw"),
                   F.create_map(F.lit("high"), F.lit("2, 0,0, 999 ,x, -1, 0000000001, 99999999999999999999")).alias("evidence_raw"))
    la = lab.select("incident_id", F.lit("language").alias("field"),
                    F.when(F.col("toxic") == 1, F.lit("fr,en")).otherwise(F.lit("   "))
                    .alias("labels_raw"),
                    F.create_map(F.lit("fr"), F.lit("1"), F.lit("en"), F.lit("")).alias("evidence_raw"))
    early = lab.select("incident_id", F.lit("quality").alias("field"), F.lit("low").alias("labels_raw"),
                       F.create_map(F.lit("low"), F.lit("0")).alias("evidence_raw"), F.lit(0).alias("ord"))
    late = q.unionByName(la).withColumn("ord", F.lit(1))
    return records.drop("lang"), early.unionByName(late)


@query
def q_merge_annotations(spark, sf_dir):
    from textcards.operators.cards import merge_annotations
    records, ann = annotation_tables(spark, sf_dir)
    out = merge_annotations(records, ann, gold_taxonomy(spark), LX.GOLD_FIELDS, "incident_id", "ord")
    ex = out.select("incident_id", "evidence_gold", F.explode("labels").alias("field", "labs"))
    ev = F.element_at(F.col("evidence_gold"), F.col("field"))
    return ex.select(F.col("incident_id").alias("doc_id"), "field",
                     F.array_join("labs", ",").alias("labels"),
                     F.coalesce(F.array_join(F.transform(F.array_sort(F.map_keys(ev)), lambda k: F.concat(
                         k, F.lit(":"), F.array_join(F.element_at(ev, k), ","))), ";"), F.lit(""))
                     .alias("evidence"))


# --- S9 nested records (flagship) -------------------------------------------------------------
@query
def q_prediction_records(spark, sf_dir):
    """Lexicon predictions folded into one nested record per document (all
    fields present), then flattened per field for comparison."""
    from textcards.sources.sinks import assemble_records
    docs = table(spark, sf_dir, "documents")
    p = _doc_predictions(spark, sf_dir)
    rec = assemble_records(p, docs.select("doc_id"), LX.DOCUMENT_FIELDS, "doc_id")
    ex = rec.select("doc_id", "confidence", "evidence", F.explode("pred").alias("field", "labels"))
    conf = F.element_at(F.col("confidence"), F.col("field"))
    evid = F.element_at(F.col("evidence"), F.col("field"))
    return ex.select(
        "doc_id", "field", F.array_join("labels", ",").alias("labels"),
        F.array_join(F.transform("labels", lambda l: F.format_string(
            "%.4f", F.element_at(conf, l))), ",").alias("confidences"),
        F.array_join(F.transform("labels", lambda l: F.array_join(
            F.transform(F.element_at(evid, l), lambda i: i.cast("string")), " ")), "|")
        .alias("evidence"))


def q_lexicon_cards(spark, sf_dir):
    """Flagship (entry): nested lexicon prediction records, flattened."""
    return q_prediction_records(spark, sf_dir)


@query
def q_split_label_metrics(spark, sf_dir):
    """C8 on the test part of the K5 split (F4: gold and predictions both
    restricted to the split's test ids), as the reference evaluates."""
    from textcards.operators.lexicon import lexicon_labels
    from textcards.operators.metrics import label_metrics, restrict_ids
    from textcards.operators.splits import hash_split
    docs = table(spark, sf_dir, "documents")
    gold, gold_ids = gold_tables(spark, sf_dir)
    test = hash_split(gold_ids, "id", 0.2, 13).where(F.col("part") == "test").select("id")
    pred = (lexicon_labels(docs, doc_lexicon(spark), "doc_id", "text", doc_taxonomy(spark))
            .select(F.col("doc_id").alias("id"), "field", "label"))
    pred_ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"))
    # only gold records of the split are scored, whatever else was predicted
    _, per_field = label_metrics(gold, pred, restrict_ids(gold_ids, test, "id"), pred_ids,
                                 gold_taxonomy(spark), "id")
    return per_field.select("field", "n", "n_scored",
                            *[r9(c).alias(c) for c in ("micro_precision", "micro_recall",
                                                        "micro_f1", "macro_f1")])


@query
def q_incident_lexicon(spark, sf_dir):
    """The original incident lexicon (104 keywords, 37 labels) and taxonomy
    over ``documents``: the keyword job the reference runs, at table scale."""
    docs = table(spark, sf_dir, "documents")
    p = lexicon_predict(docs, lexicon_table(spark, LX.INCIDENT_LEXICON), "doc_id", "text",
                        taxonomy_table(spark, LX.INCIDENT_TAXONOMY))
    return p.select("doc_id", "field", "label", "hits", "confidence",
                    ints_csv("evidence").alias("evidence"))


INCIDENT_SENTENCES = [
    "The raptor engine failed to ignite and the tank began leaking.",
    "Telemetry dropped; guidance was lost. Attitude control failed, and FTS was activated.",
    "Fire near the launch mount. A heat shield tile hit by debris broke apart; the vehicle was lost.",
    "Launch delayed by a software bug, a small issue. Reentry heating. Cause unclear.",
    "Nothing of note happened. The signal\nlost its way. Engineers unlisted the update.",
]


def incident_texts(id_col: str = "doc_id"):
    """Documents with an incident sentence or two ahead of their own text."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, INCIDENT_SENTENCES)), (k % len(INCIDENT_SENTENCES) + 1).cast("int"))
    i = F.col(id_col)
    return F.concat(pick(i), F.lit(" "), F.when(i % 3 == 0, pick(F.floor(i / 7))).otherwise(F.lit("")), F.lit(" "),
                    F.coalesce("text", F.lit("")))


@query
def q_incident_lexicon_hits(spark, sf_dir):
    """The original lexicon where its keywords occur: all four fields, keywords
    in several labels and across a line end, and a label outside the taxonomy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", incident_texts().alias("text"))
    lexicon = {f: dict(labels) for f, labels in LX.INCIDENT_LEXICON.items()}
    lexicon["subsystem"]["unlisted"] = ["unlisted"]
    p = lexicon_predict(docs, lexicon_table(spark, lexicon), "doc_id", "text",
                        taxonomy_table(spark, LX.INCIDENT_TAXONOMY))
    return p.select("doc_id", "field", "label", "hits", "confidence",
                    ints_csv("evidence").alias("evidence"))


# --- large lexicon --------------------------------------------------------------------------
def document_keywords(docs: DataFrame) -> DataFrame:
    """A lexicon out of the documents themselves: their words of four letters or
    more and pairs of neighbouring words of six or more; a keyword's label is its
    first letter, its position its length."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), 1)
    w = docs.select(words.alias("w"))
    single = w.select(F.explode("w").alias("keyword")).where(F.length("keyword") >= 4)
    pair = F.zip_with("w", F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(
        (F.length(a) >= 6) & (F.length(b) >= 6), F.concat(a, F.lit(" "), b)))
    pairs = w.where(F.size("w") > 1).select(F.explode(pair).alias("keyword")).where("keyword is not null")
    return single.union(pairs).distinct().select(
        F.lit("first").alias("field"), F.substring("keyword", 1, 1).alias("label"), F.lit(0).alias("label_pos"),
        F.length("keyword").alias("kw_pos"), "keyword")


@query
def q_large_lexicon(spark, sf_dir):
    """Over 100,000 keywords at sf0.01: found in one walk per text."""
    docs = table(spark, sf_dir, "documents")
    p = lexicon_predict(docs, stored(document_keywords(docs)), "doc_id", "text")
    return p.select("doc_id", "label", "hits", "confidence", ints_csv("evidence").alias("evidence"))


# --- tables in versions, row numbers ---------------------------------------------------------
@query
def q_versioned_records(spark, sf_dir):
    """Records written, read back, changed and written over themselves
    twice (a job reads the table it replaces), then read again."""
    from textcards.plans.jobs import read_records
    from textcards.session import shared_folder
    from textcards.sources.sinks import write_jsonl
    path = f"{shared_folder(spark)}/textcards-records-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    write_jsonl(docs.select(
        F.concat(F.lit("rec-"), F.col("doc_id")).alias("incident_id"), "text",
        F.when(F.col("lang").isNotNull(), F.create_map(F.lit("language"), F.array("lang"))).alias("labels")), path)
    first = read_records(spark, path)
    write_jsonl(first.withColumn("incident_name", F.substring("text", 1, 20)), path)
    second = read_records(spark, path)
    write_jsonl(second.withColumn("missing_text", F.coalesce(F.trim("text"), F.lit("")) == ""), path)
    return read_records(spark, path).select("incident_id", "text", "incident_name", "missing_text",
                                            F.element_at("labels", "language")[0].alias("language"))


@query
def q_head_split_by_position(spark, sf_dir):
    """K6 in file order over rows whose id repeats (one per turn)."""
    from textcards.operators.splits import head_split_by_position
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return head_split_by_position(turns, ["conv_id", "turn"], 0.8)


@query
def q_ovr_score(spark, sf_dir):
    """M2, M5: ``documents`` scored with a stored model whose coefficients are
    given by a rule over the vocabulary (a fit's cannot be restated in SQL)."""
    from textcards.operators.ovr_model import ModelTables, load_model, predict, save_model
    from textcards.operators.tfidf import fit_vocabulary
    from textcards.session import shared_folder
    docs = table(spark, sf_dir, "documents")
    vocab = stored_by(fit_vocabulary(docs), "term")
    coef = vocab.select("term", "heavy", (((F.col("df") % 7) - 3) * 0.5).alias("c0"), (((F.length("term") % 5) - 2) * 0.75).alias("c1"))
    path = f"{shared_folder(spark)}/textcards-model-{uuid.uuid4().hex}"
    save_model(ModelTables(vocab, coef, [("topic", "common"), ("topic", "wordy")], [0.1, -0.2], [("topic", "any")]), path)
    p = predict(load_model(spark, path), docs, "doc_id", "text", 0.5)
    return p.select("doc_id", "field", "label", F.round("confidence", 6).alias("confidence"), ints_csv("evidence").alias("evidence"))
