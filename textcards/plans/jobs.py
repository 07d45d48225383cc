"""Composite jobs C1-C13 over files: the end-to-end entry points.

Each job reads its inputs with explicit schemas, runs the operators as
one Spark plan and writes its outputs; parameters are function arguments.
Wherever "last record wins", record order is (file path, block, line), taken
right after the read (``readers.file_order``).

Outputs are tables in versions (``sources.versioned``): a job may write the
table it reads, and one that dies keeps the old rows.  A split is written as
long-form rows ``(incident_id, part)`` plus a one-row parameter record,
never as one JSON document holding every id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcards import lexicons as LX
from textcards.operators.evidence import evidence_indices_from_text, evidence_metrics
from textcards.operators.ingest import build_records, clean_records, last_per_id, page_records
from textcards.operators.lexicon import lexicon_predict, lexicon_table, taxonomy_table
from textcards.operators.metrics import flat_gold_eval, label_metrics, restrict_ids
from textcards.operators.ovr import label_states, ovr_predict
from textcards.operators.ovr_model import fit_tables, load_model, predict, save_model
from textcards.operators.sentences import sentences
from textcards.operators.splits import head_of, row_positions, time_split
from textcards.operators.stats import dataset_stats, label_distribution
from textcards.sources import readers as R
from textcards.sources.sinks import assemble_records, write_jsonl, write_report

ID = "incident_id"


def _taxonomy(spark: SparkSession, schema_path: str | None) -> DataFrame:
    if schema_path:
        return R.read_taxonomy(spark, schema_path)
    return taxonomy_table(spark, LX.INCIDENT_TAXONOMY)


def _fields(taxonomy: DataFrame, fields, schema_path: str | None = None) -> list:
    """The given fields, else those of the given taxonomy, else the built-in ones."""
    if fields:
        return list(fields)
    if schema_path:
        return [r["field"] for r in taxonomy.select("field").distinct().orderBy("field").collect()]
    return LX.INCIDENT_FIELDS


def read_records(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """Records JSONL; with ``dedupe`` the last line per id wins (A1)."""
    df = R.read_jsonl(spark, path)
    return last_per_id(df.withColumn("_ord", R.file_order()), ID, "_ord").drop("_ord") if dedupe else df


def read_predictions(spark: SparkSession, path: str,
                     schema: str = R.PREDICTION_SCHEMA) -> DataFrame:
    """Prediction JSONL; the last line per id wins (A1)."""
    df = R.read_jsonl(spark, path, schema).withColumn("_ord", R.file_order())
    return last_per_id(df, ID, "_ord").drop("_ord")


def _split_ids(spark: SparkSession, split_path: str | None, part: str):
    s = R.read_split(spark, split_path, ID)
    return None if s is None else s.where(F.col("part") == part).select(ID)


def labels_long(records: DataFrame) -> DataFrame:
    """``labels`` map -> ``(incident_id, field, label)`` rows."""
    ex = records.select(ID, F.explode_outer("labels").alias("field", "_l"))
    return ex.select(ID, "field", F.explode("_l").alias("label"))


# --- C1 C2 C3 ---------------------------------------------------------------------------
def build_incidents_job(spark: SparkSession, roster_csv: str, raw_dir: str | None, out: str,
                        labels_from: str | None = None) -> DataFrame:
    roster = R.read_csv(spark, roster_csv).select(
        ID, F.col("incident_name").alias("name"), "url", "retrieved_date")
    texts = R.read_text_dir(spark, raw_dir, ID) if raw_dir else None
    prev = None
    if labels_from and R.exists(spark, labels_from):
        prev = read_records(spark, labels_from).select(ID, "labels", "evidence_gold", "date")
    rec = build_records(roster, texts, prev, ID)
    write_jsonl(rec, out)
    return rec


def clean_job(spark: SparkSession, inp: str, out: str, min_chars: int = 200) -> DataFrame:
    rec = clean_records(R.read_jsonl(spark, inp, R.SCRAPED_SCHEMA), "text", min_chars)
    write_jsonl(rec, out)
    return rec


def extract_pages_job(spark: SparkSession, pages: DataFrame, out: str, id_col: str = "page_id",
                      url_col: str = "url", source_type: str = "news") -> DataFrame:
    """C3 without the fetch: pages ``(id, url, html)`` -> appended records."""
    rec = page_records(pages, id_col, url_col, "html", source_type)
    write_jsonl(rec, out, mode="append")
    return rec


# --- C7 ---------------------------------------------------------------------------------
def split_job(spark: SparkSession, data: str, out: str, seed: int = 13,
              test_size: float = 0.2) -> DataFrame:
    rec = read_records(spark, data)
    labelled = rec.where((F.coalesce(F.size("labels"), F.lit(0)) > 0)
                         & (F.coalesce(F.col("text"), F.lit("")) != ""))
    split, strategy = time_split(labelled.select(ID, "date"), ID, "date", test_size, seed)
    write_jsonl(split, f"{out}/ids")
    write_report(spark.range(1).select(F.lit(strategy).alias("strategy"), F.lit(seed).alias("seed"),
                                       F.lit(test_size).alias("test_size"),
                                       F.lit(labelled.count()).alias("n_labeled")), f"{out}/params")
    return split


def head_split_job(spark: SparkSession, data: str, out: str, train_frac: float = 0.8) -> DataFrame:
    """K6 by file position over the records with labels and text: ``(incident_id,
    position, part)`` rows, a row per record, repeated ids included.  The position
    counts all records of the file; the share is taken of the labelled ones."""
    rec = R.read_jsonl(spark, data)
    labelled = row_positions(rec).where((F.coalesce(F.size("labels"), F.lit(0)) > 0)
                                        & (F.coalesce(F.col("text"), F.lit("")) != ""))
    split = head_of(labelled.select(ID, "position"), [ID, "position"], ["position"], train_frac)
    write_jsonl(split, f"{out}/ids")
    return split


# --- C4 C5 -------------------------------------------------------------------------------
def lexicon_predict_job(spark: SparkSession, data: str, out: str, schema_path: str | None = None,
                        split: str | None = None, lexicon: dict | None = None,
                        fields=None) -> DataFrame:
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    rec = read_records(spark, data)
    rec = restrict_ids(rec, _split_ids(spark, split, "test"), ID, empty_split="none")
    p = lexicon_predict(rec, lexicon_table(spark, lexicon or LX.INCIDENT_LEXICON), ID, "text", tax,
                        fields)
    nested = assemble_records(p, rec.select(ID), fields, ID)
    write_jsonl(nested, out)
    return nested


def tfidf_predict_job(spark: SparkSession, out: str, data: str | None = None,
                      train: str | None = None, test: str | None = None,
                      schema_path: str | None = None, split: str | None = None,
                      threshold: float = 0.5, fields=None) -> DataFrame:
    train, test = train or data, test or data
    if not train or not test:
        raise ValueError("provide data, or both train and test paths")
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    tr = restrict_ids(read_records(spark, train), _split_ids(spark, split, "train"), ID)
    te = restrict_ids(read_records(spark, test), _split_ids(spark, split, "test"), ID)
    preds, _ = ovr_predict(tr.select(ID, "text"), te.select(ID, "text"), labels_long(tr), tax,
                           fields, ID, "text", threshold)
    nested = assemble_records(preds.withColumn("_o", F.col("label")), te.select(ID), fields, ID,
                              label_order="_o")
    write_jsonl(nested, out)
    return nested


def tfidf_fit_job(spark: SparkSession, train: str, model: str, schema_path: str | None = None,
                  split: str | None = None, fields=None, **fit) -> DataFrame:
    """The first half of C5: fit on the train part and store the model tables."""
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    tr = restrict_ids(read_records(spark, train), _split_ids(spark, split, "train"), ID)
    gold = labels_long(tr)
    states = label_states(gold, tr.select(ID), tax, ID).where(F.col("field").isin(fields))
    save_model(fit_tables(tr.select(ID, "text"), gold, states.collect(), ID, "text", **fit), model)
    return states


def tfidf_score_job(spark: SparkSession, data: str, model: str, out: str, schema_path: str | None = None,
                    split: str | None = None, threshold: float = 0.5, fields=None) -> DataFrame:
    """The second half: predict the test part with a stored model, in another run."""
    fields = _fields(_taxonomy(spark, schema_path), fields, schema_path)
    te = restrict_ids(read_records(spark, data), _split_ids(spark, split, "test"), ID)
    preds = predict(load_model(spark, model), te.select(ID, "text"), ID, "text", threshold)
    nested = assemble_records(preds.where(F.col("field").isin(fields)).withColumn("_o", F.col("label")), te.select(ID),
                              fields, ID, label_order="_o")
    write_jsonl(nested, out)
    return nested


LOGITS_SCHEMA = "incident_id string, field string, logits array<float>"


def score_logits_job(spark: SparkSession, data: str, logits: str, out: str, schema_path: str | None = None,
                     threshold: float = 0.5, evidence_keywords: dict | None = None, fields=None) -> DataFrame:
    """C6 from a logits table (JSON lines, ``LOGITS_SCHEMA``): picked labels,
    probabilities and evidence sentences as nested records."""
    from textcards.operators.logits import score_logits
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    keywords = LX.INCIDENT_EVIDENCE_KEYWORDS if evidence_keywords is None else evidence_keywords
    labels = tax.where(F.col("field").isin(fields)).select("field", "label").collect()      # the label space
    ev = {f: {r["label"]: keywords[r["label"]] for r in labels if r["field"] == f and r["label"] in keywords} for f in fields}
    nested = score_logits(read_records(spark, data), R.read_jsonl(spark, logits, LOGITS_SCHEMA), tax,
                          lexicon_table(spark, ev), fields, ID, "text", threshold)
    write_jsonl(nested, out)
    return nested


# --- C8 C9 C10 C11 -------------------------------------------------------------------------
def evaluate_job(spark: SparkSession, gold: str, pred: str, out: str,
                 schema_path: str | None = None, split: str | None = None, fields=None):
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    test = _split_ids(spark, split, "test")
    g = restrict_ids(read_records(spark, gold), test, ID)
    p = restrict_ids(read_predictions(spark, pred), test, ID)
    p_long = p.select(ID, F.explode_outer("pred").alias("field", "_l")).select(
        ID, "field", F.explode("_l").alias("label"))
    per_label, per_field = label_metrics(labels_long(g), p_long, g.select(ID), p.select(ID),
                                         tax.where(F.col("field").isin(fields)), ID)
    write_report(per_field, f"{out}/fields")
    write_report(per_label, f"{out}/per_label")
    return per_label, per_field


def evidence_eval_job(spark: SparkSession, gold: str, pred: str, out: str, split: str | None = None,
                      fields=None, schema_path: str | None = None) -> DataFrame:
    fields = _fields(_taxonomy(spark, schema_path), fields, schema_path)
    test = _split_ids(spark, split, "test")
    g = restrict_ids(read_records(spark, gold), test, ID)
    ev = (g.select(ID, F.explode("evidence_gold").alias("field", "_m"))
          .select(ID, "field", F.explode("_m").alias("label", "_i"))
          .select(ID, "field", "label", F.explode("_i").alias("sent_idx")))
    recs = g.where(F.coalesce(F.size("evidence_gold"), F.lit(0)) > 0).select(ID)
    # predicted evidence may be indices or sentence texts
    schema = "incident_id string, evidence map<string,map<string,array<string>>>"
    p = restrict_ids(read_predictions(spark, pred, schema), test, ID)
    pe = (p.select(ID, F.explode("evidence").alias("field", "_m"))
          .select(ID, "field", F.explode("_m").alias("label", "_v")))
    is_idx = F.forall("_v", lambda v: v.rlike("^-?[0-9]+$"))
    idx = pe.where(is_idx).select(ID, "field", "label", F.transform(
        "_v", lambda v: v.cast("int")).alias("evidence"))
    txt = pe.where(~is_idx).select(ID, "field", "label", F.col("_v").alias("evidence_text"))
    sents = sentences(g.select(ID, "text"), ID)
    pred_ev = idx.unionByName(evidence_indices_from_text(txt, sents, ID))
    m = evidence_metrics(ev, recs, pred_ev, fields, ID)
    write_report(m, out)
    return m


def flat_gold_eval_job(spark: SparkSession, labels_csv: str, out: str,
                       lexicon: dict | None = None):
    rows = R.read_csv(spark, labels_csv, R.FLAT_GOLD_SCHEMA)
    acc, conf = flat_gold_eval(rows, lexicon_table(spark, lexicon or LX.INCIDENT_LEXICON),
                               {"subsystem": ("subsystem_label", "subsystem"),
                                "incident_type": ("incident_type_label", "failure_mode")},
                               ID, "text")
    write_report(acc, f"{out}/accuracy")
    write_jsonl(conf, f"{out}/confusion")      # raw labels: unbounded
    return acc, conf


def dataset_stats_job(spark: SparkSession, data: str, stats_out: str, labels_out: str):
    rec = read_records(spark, data, dedupe=False)
    s, d = dataset_stats(rec), label_distribution(rec)
    write_report(s, stats_out)
    write_jsonl(d, labels_out)      # raw labels: unbounded
    return s, d


# --- C12 C13 ---------------------------------------------------------------------------------
ANNOTATION_SCHEMA = ("incident_id string, field string, labels_raw string, "
                     "evidence_raw map<string,string>")


def cards_job(spark: SparkSession, data: str, out: str, schema_path: str | None = None,
              lexicon: dict | None = None, fields=None) -> DataFrame:
    """One card per (record, field): badges and verbatim evidence."""
    from textcards.operators.cards import cards
    tax = _taxonomy(spark, schema_path)
    fields = _fields(tax, fields, schema_path)
    c = cards(read_records(spark, data), lexicon_table(spark, lexicon or LX.INCIDENT_LEXICON),
              fields, ID, "text", tax)
    write_jsonl(c, out)
    return c


def merge_annotations_job(spark: SparkSession, data: str, annotations: str, out: str,
                          schema_path: str | None = None, fields=None) -> DataFrame:
    """Apply annotation answers (JSON lines, ``ANNOTATION_SCHEMA``) to
    records and write the updated records to a new path."""
    from textcards.operators.cards import merge_annotations
    tax = _taxonomy(spark, schema_path)
    ann = R.read_jsonl(spark, annotations, ANNOTATION_SCHEMA).withColumn("_ord", R.file_order())
    merged = merge_annotations(read_records(spark, data), ann, tax, _fields(tax, fields, schema_path), ID, "_ord")
    write_jsonl(merged, out)
    return merged
