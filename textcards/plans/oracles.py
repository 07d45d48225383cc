"""DuckDB twins of ``queries.py`` (tables are pre-registered views)."""

from __future__ import annotations

from textcards import lexicons as LX
from textcards.plans.sqlbits import (WS_CLASS, lexicon_values, sentences, sql_str, strip,
                                     taxonomy_values)

ORACLES: dict[str, str] = {}


def oracle(name):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


@oracle("q_sentences")
def _():
    return f"""
SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sent_idx, unnest(s) AS sentence
FROM (SELECT doc_id, {sentences("coalesce(text, '')")} AS s FROM documents)"""


@oracle("q_conversation_sentences")
def _():
    return f"""
SELECT conv_id, turn, CAST(unnest(range(len(s))) AS INTEGER) AS sent_idx, unnest(s) AS sentence
FROM (SELECT conv_id, turn, {sentences("coalesce(text, '')")} AS s FROM conversations)"""


def _normalize(x):
    t = f"replace({x}, chr(13), chr(10))"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    return strip(t)


@oracle("q_clean_min_chars")
def _():
    return f"""
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {_normalize("coalesce(text, '')")} AS text FROM documents)
WHERE length(text) >= 200"""


def _page_text(html):
    """P1 from its rules: comments and script, style, noscript go; <p> opens a
    paragraph, </p> and block tags end it; inside it tags part text nodes."""
    h = f"regexp_replace({html}, '<!--(.|\\n)*?-->', '', 'g')"
    for tag in ("script", "style", "noscript"):
        h = f"regexp_replace({h}, '<{tag}\\b[^>]*>(.|\\n)*?</{tag}\\s*>', '', 'gi')"
    h = f"regexp_replace({h}, '<p(\\s[^>]*)?>', chr(1) || chr(2), 'gi')"
    blocks = "p|article|div|section|main|nav|footer|header|ul|ol|li|table|body|html|h[1-6]"
    h = f"regexp_replace({h}, '</?({blocks})(\\s[^>]*)?>', chr(1), 'gi')"
    node = "regexp_replace(substr(p, 2), '</?[a-zA-Z][^>]*>|<[!?][^>]*>', chr(3), 'g')"
    named = {"lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "copy": 169, "middot": 183, "amp": 38,
             "mdash": 8212, "rsquo": 8217, "eacute": 233, "Eacute": 201}
    by_name = " ".join(f"WHEN '{k}' THEN chr({v})" for k, v in named.items())
    ref = "regexp_extract(x, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);', 1)"
    num = (f"CASE WHEN {ref}[2:2] IN ('x', 'X') THEN CAST('0x' || substr({ref}, 3) AS BIGINT) "
           f"ELSE CAST(substr({ref}, 2) AS BIGINT) END")
    char = (f"CASE WHEN {ref} = '' THEN NULL WHEN {ref}[1:1] = '#' THEN "
            f"(CASE {num} WHEN 0 THEN chr(65533) WHEN 150 THEN chr(8211) ELSE chr(CAST({num} AS INTEGER)) END) "
            f"ELSE (CASE {ref} {by_name} END) END")
    decoded = (f"list_aggregate(list_transform(string_split({node}, '&'), lambda x, i: CASE WHEN i = 1 THEN x "
               f"WHEN {char} IS NULL THEN '&' || x ELSE {char} || substr(x, len({ref}) + 2) END), 'string_agg', '')")
    para = (f"array_to_string(list_filter(list_transform(string_split({decoded}, chr(3)), "
            f"lambda s: {strip('s')}), lambda s: s <> ''), ' ')")
    paras = (f"list_filter(list_transform(list_filter(string_split({h}, chr(1)), "
             f"lambda p: starts_with(p, chr(2))), lambda p: {para}), lambda s: s <> '')")
    return strip(f"regexp_replace(array_to_string({paras}, chr(10)), '[ \\t]+', ' ', 'g')")


@oracle("q_page_text")
def _():
    return f"SELECT page_id, {_page_text("coalesce(html, '')")} AS text FROM pages"


@oracle("q_page_text_references")
def _():
    made = ("'<p>n&#' || (page_id % 900 + 160) || '; x&#x' || upper(to_hex(page_id % 3000 + 8192)) || "
            "'; a < b &mdash; &rsquo;q&rsquo; &eacute;&Eacute; &amp;lt; &amp;#65; &unknown; &#0; &#150; c > d & e &#8364</p>'")
    return f"SELECT page_id, {_page_text('h')} AS text FROM (SELECT page_id, {made} || coalesce(html, '') AS h FROM pages)"


def _lexicon_ctes(lexicon=LX.DOCUMENT_LEXICON, taxonomy=LX.DOCUMENT_TAXONOMY,
                  docs="documents", id_col="doc_id"):
    return f"""
lex AS (SELECT * FROM {lexicon_values(lexicon)}),
tax AS (SELECT * FROM {taxonomy_values(taxonomy)}),
l AS (SELECT lex.field, lex.label, lex.label_pos, lex.kw_pos, lower(lex.keyword) AS kw
      FROM lex JOIN tax ON lex.field = tax.field AND lex.label = tax.label),
d AS (SELECT {id_col} AS id, lower(coalesce(text, '')) AS tl FROM {docs}),
hk AS (SELECT d.id, l.field, l.label, l.label_pos, l.kw_pos, l.kw
       FROM d JOIN l ON contains(d.tl, l.kw)),
pred AS (SELECT id, field, label, label_pos, count(*) AS hits,
                least(0.95::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * count(*)) AS confidence
         FROM hk GROUP BY id, field, label, label_pos),
s AS (SELECT id, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS sent
      FROM (SELECT id, {sentences('tl')} AS sl FROM d WHERE id IN (SELECT id FROM hk))),
ev_all AS (SELECT hk.id, hk.field, hk.label, min(hk.kw_pos) AS mk, s.sent_idx
           FROM hk JOIN s ON s.id = hk.id AND contains(s.sent, hk.kw)
           GROUP BY hk.id, hk.field, hk.label, s.sent_idx),
ev_rank AS (SELECT *, row_number() OVER (PARTITION BY id, field, label
                                         ORDER BY mk, sent_idx) AS rn FROM ev_all),
ev AS (SELECT id, field, label, list(sent_idx ORDER BY rn) AS evidence
       FROM ev_rank WHERE rn <= 3 GROUP BY id, field, label),
preds AS (SELECT pred.*, coalesce(ev.evidence, []) AS evidence
          FROM pred LEFT JOIN ev USING (id, field, label))"""


@oracle("q_lexicon_predict")
def _():
    return f"""WITH {_lexicon_ctes()}
SELECT id AS doc_id, field, label, CAST(label_pos AS INTEGER) AS label_pos, hits, confidence
FROM pred"""


@oracle("q_lexicon_evidence")
def _():
    return f"""WITH {_lexicon_ctes()}
SELECT id AS doc_id, field, label, array_to_string(evidence, ',') AS evidence FROM preds"""


def _r(x):
    return f"round({x}, 9)"


def _ratio(num, den):
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / ({den}) END"


GOLD_CTES = f"""
gtax AS (SELECT * FROM {taxonomy_values(LX.GOLD_TAXONOMY)}),
lab AS (SELECT l.doc_id, d.lang, l.quality, l.toxic
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
gold AS (SELECT * FROM (
           SELECT doc_id AS id, 'language' AS field, lang AS label FROM lab
           UNION ALL
           SELECT doc_id, 'quality', CASE WHEN quality = 1 THEN 'high' ELSE 'low' END FROM lab
           UNION ALL
           SELECT doc_id, 'toxicity', 'toxic' FROM lab WHERE toxic = 1) x
         WHERE label IS NOT NULL),
gids AS (SELECT DISTINCT doc_id AS id FROM documents
         WHERE doc_id IN (SELECT doc_id FROM labels))"""


def _label_metric_ctes():
    return f"""WITH {_lexicon_ctes()}, {GOLD_CTES},
pairs AS (SELECT id FROM gids WHERE id IN (SELECT doc_id FROM documents)),
g AS (SELECT DISTINCT gold.id, gold.field, gold.label FROM gold
      JOIN gtax ON gtax.field = gold.field AND gtax.label = gold.label
      WHERE gold.id IN (SELECT id FROM pairs)),
p AS (SELECT DISTINCT pred.id, pred.field, pred.label FROM pred
      JOIN gtax ON gtax.field = pred.field AND gtax.label = pred.label
      WHERE pred.id IN (SELECT id FROM pairs)),
j AS (SELECT coalesce(g.field, p.field) AS field, coalesce(g.label, p.label) AS label,
             g.id IS NOT NULL AS gi, p.id IS NOT NULL AS pi
      FROM g FULL OUTER JOIN p ON g.id = p.id AND g.field = p.field AND g.label = p.label),
c AS (SELECT field, label, count(*) FILTER (WHERE gi AND pi) AS tp,
             count(*) FILTER (WHERE pi AND NOT gi) AS fp,
             count(*) FILTER (WHERE gi AND NOT pi) AS fn
      FROM j GROUP BY field, label),
pl AS (SELECT gtax.field, gtax.label, CAST(gtax.label_pos AS INTEGER) AS label_pos,
              CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp,
              CAST(coalesce(fn, 0) AS BIGINT) AS fn
       FROM gtax LEFT JOIN c ON c.field = gtax.field AND c.label = gtax.label),
plm AS (SELECT *, tp + fn AS support, {_ratio('tp', 'tp + fp')} AS precision,
               {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1
        FROM pl)"""


@oracle("q_label_metrics")
def _():
    return f"""{_label_metric_ctes()}
SELECT field, label, label_pos, tp, fp, fn, support, {_r('precision')} AS precision,
       {_r('recall')} AS recall, {_r('f1')} AS f1 FROM plm"""


@oracle("q_micro_macro")
def _():
    return f"""{_label_metric_ctes()},
fsum AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro_f1
         FROM plm GROUP BY field)
SELECT field, (SELECT count(*) FROM gids) AS n, (SELECT count(*) FROM pairs) AS n_scored,
       {_r(_ratio('tp', 'tp + fp'))} AS micro_precision, {_r(_ratio('tp', 'tp + fn'))} AS micro_recall,
       {_r(_ratio('2 * tp', '2 * tp + fp + fn'))} AS micro_f1, {_r('macro_f1')} AS macro_f1
FROM fsum WHERE (SELECT count(*) FROM pairs) > 0"""


def _flat_gold_ctes(gold="lang"):
    return f"""WITH lex AS (SELECT * FROM {lexicon_values(LX.DOCUMENT_LEXICON)}),
l AS (SELECT label, label_pos, lower(keyword) AS kw FROM lex WHERE field = 'language'),
rows_ AS (SELECT doc_id AS id, {strip("coalesce(text, '')")} AS t,
                 {strip(f"coalesce({gold}, '')")} AS gold FROM documents),
sc AS (SELECT * FROM rows_ WHERE gold NOT IN ('', 'TBD')),
hk AS (SELECT sc.id, l.label, l.label_pos FROM sc JOIN l ON contains(lower(sc.t), l.kw)),
pr AS (SELECT id, list(DISTINCT label) AS labels, arg_min(label, label_pos) AS top1
       FROM hk GROUP BY id),
r AS (SELECT 'language' AS field, sc.gold, coalesce(pr.top1, 'none') AS pred,
             coalesce(list_contains(pr.labels, sc.gold), false) AS correct
      FROM sc LEFT JOIN pr ON pr.id = sc.id)"""


def _confusion(gold="lang"):
    return f"""{_flat_gold_ctes(gold)}
SELECT field, gold, pred, count(*) AS n FROM r GROUP BY field, gold, pred"""


@oracle("q_top1_confusion")
def _():
    return _confusion()


MARKED_GOLD = ("(CASE doc_id % 7 WHEN 0 THEN ' TBD ' WHEN 1 THEN '  ' WHEN 2 THEN NULL "
               "WHEN 3 THEN ' ' || lang || chr(9) ELSE lang END)")


@oracle("q_flat_gold_confusion")
def _():
    return _confusion(MARKED_GOLD)


def _accuracy(gold="lang"):
    return f"""{_flat_gold_ctes(gold)}
SELECT 'language' AS field, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct,
       CAST(count(*) AS BIGINT) AS total,
       {_r(_ratio('count(*) FILTER (WHERE correct)', 'count(*)'))} AS accuracy,
       CAST((SELECT count(*) FROM rows_ WHERE gold IN ('', 'TBD')) AS BIGINT) AS skipped
FROM r"""


@oracle("q_anyhit_accuracy")
def _():
    return _accuracy()


@oracle("q_flat_gold_skips")
def _():
    return _accuracy(MARKED_GOLD)


@oracle("q_multi_hot")
def _():
    names = ", ".join(sql_str(x) for x in LX.GOLD_TAXONOMY["language"])
    return f"""SELECT doc_id, array_to_string(list_transform([{names}], lambda l: CASE WHEN l = lang OR (doc_id % 5 = 0 AND l = 'it')
  THEN '1' ELSE '0' END), ',') AS hot FROM documents"""


@oracle("q_last_per_id")
def _():
    return """SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n_chars FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""


TOKEN_RE_SQL = "[\\p{L}\\p{N}_]{2,}"


def _terms(x):
    """Unigrams + bigrams of text expression ``x`` (a lambda-free two-step)."""
    return (f"list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), "
            f"lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)")


def _vocab_ctes(docs="documents"):
    return f"""
vt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_RE_SQL}') AS t
       FROM {docs}),
vterms AS (SELECT doc_id, {_terms('t')} AS ts FROM vt),
vdt AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM vterms),
vn AS (SELECT count(*) AS n FROM {docs}),
vdf AS (SELECT term, count(*) AS df FROM vdt GROUP BY term),
vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM vdf, vn
          WHERE df <= 0.95::DOUBLE * n AND df >= 1)"""


@oracle("q_vocab_idf")
def _():
    return f"""WITH {_vocab_ctes()}
SELECT term, df, {_r('idf')} AS idf FROM vocab"""


def _sentence_score_ctes():
    return f"""{_vocab_ctes()},
ss AS (SELECT doc_id, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS s
       FROM (SELECT doc_id, {sentences("coalesce(text, '')")} AS sl FROM documents)),
st AS (SELECT doc_id, sent_idx, regexp_extract_all(lower(s), '{TOKEN_RE_SQL}') AS t FROM ss),
sterm AS (SELECT doc_id, sent_idx, unnest({_terms('t')}) AS term FROM st),
stf AS (SELECT doc_id, sent_idx, term, count(*) AS tf FROM sterm GROUP BY ALL),
sw AS (SELECT doc_id, sent_idx, tf * idf AS w FROM stf JOIN vocab USING (term)),
sscore AS (SELECT doc_id, sent_idx, sum(w) / sqrt(sum(w * w)) AS score
           FROM sw GROUP BY doc_id, sent_idx)"""


@oracle("q_tfidf_sentences")
def _():
    return f"""WITH {_sentence_score_ctes()},
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id
                                    ORDER BY round(score, 9) DESC, sent_idx DESC) AS rank
       FROM sscore WHERE score > 0)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, sent_idx, {_r('score')} AS score
FROM rk WHERE rank <= 3"""


@oracle("q_doc_tfidf_norms")
def _():
    return f"""WITH {_vocab_ctes()},
dterm AS (SELECT doc_id, unnest(ts) AS term FROM vterms),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM dterm GROUP BY ALL),
dw AS (SELECT doc_id, tf, tf * idf AS w FROM dtf JOIN vocab USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM dw GROUP BY doc_id)
SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens,
       {_r('sum((w / nrm) * (w / nrm))')} AS sq_norm
FROM dw JOIN dn USING (doc_id) GROUP BY doc_id"""


@oracle("q_label_state")
def _():
    return f"""WITH {GOLD_CTES},
n AS (SELECT count(*) AS n FROM gids),
cnt AS (SELECT field, label, count(*) AS count
        FROM (SELECT DISTINCT id, field, label FROM gold WHERE id IN (SELECT id FROM gids))
        GROUP BY field, label)
SELECT gtax.field, gtax.label, CAST(gtax.label_pos AS INTEGER) AS label_pos,
       CAST(coalesce(cnt.count, 0) AS BIGINT) AS count, CAST(n.n AS BIGINT) AS n,
       CASE WHEN coalesce(cnt.count, 0) > 0 AND coalesce(cnt.count, 0) < n.n THEN 'active'
            WHEN coalesce(cnt.count, 0) = n.n AND n.n > 0 THEN 'always' ELSE 'never' END AS state
FROM gtax LEFT JOIN cnt ON cnt.field = gtax.field AND cnt.label = gtax.label, n"""


OVR_SPLIT = f"""{GOLD_CTES},
otn AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT)) AS tn FROM gids),
ork AS (SELECT id, row_number() OVER (ORDER BY substr(md5(CAST(id AS VARCHAR) || '|13'), 1, 15), id) AS rn FROM gids),
otrain AS (SELECT d.* FROM documents d JOIN ork ON ork.id = d.doc_id WHERE rn > (SELECT tn FROM otn)),
otest AS (SELECT d.* FROM documents d JOIN ork ON ork.id = d.doc_id WHERE rn <= (SELECT tn FROM otn))"""


@oracle("q_ovr_optimality")
def _():
    return f"""WITH {OVR_SPLIT},
c AS (SELECT field, label, count(DISTINCT id) AS k FROM gold WHERE id IN (SELECT doc_id FROM otrain) GROUP BY field, label),
n AS (SELECT count(*) AS n FROM otrain)
SELECT gtax.field, gtax.label, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS positives, true AS optimal
FROM gtax JOIN c ON c.field = gtax.field AND c.label = gtax.label, n WHERE k > 0 AND k < n"""


@oracle("q_ovr_always_on")
def _():
    train, test = _sentence_score_ctes().split("ss AS (", 1)
    train, test = train.replace("FROM documents", "FROM otrain"), test.replace("FROM documents", "FROM otest")
    return f"""WITH {OVR_SPLIT}, {train}ss AS ({test},
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, sent_idx DESC) AS rank
       FROM sscore WHERE score > 0),
e AS (SELECT doc_id, string_agg(CAST(sent_idx AS VARCHAR), ',' ORDER BY rank) AS evidence FROM rk WHERE rank <= 3 GROUP BY doc_id)
SELECT t.doc_id, 'text,web' AS labels, 1.0::DOUBLE AS confidence, coalesce(e.evidence, '') AS evidence
FROM otest t LEFT JOIN e ON e.doc_id = t.doc_id"""


@oracle("q_time_split")
def _():
    return """WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT count(*) AS n FROM r WHERE d IS NOT NULL),
k AS (SELECT greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) AS tn FROM c),
rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY d DESC, o_orderkey DESC) AS rn
       FROM r WHERE d IS NOT NULL)
SELECT r.o_orderkey, CASE WHEN rk.rn <= (SELECT tn FROM k) THEN 'test' ELSE 'train' END AS part
FROM r LEFT JOIN rk ON rk.o_orderkey = r.o_orderkey"""


@oracle("q_time_split_string_ids")
def _():
    return """WITH o AS (SELECT DISTINCT 'record-' || reverse(CAST(o_orderkey AS VARCHAR)) ||
         CASE WHEN o_orderkey % 2 = 0 THEN '-é' ELSE '' END AS rid, o_orderkey % 11 AS k, o_orderdate AS od FROM orders),
r AS (SELECT rid, CASE WHEN k < 4 THEN NULL WHEN k = 4 THEN CAST(date_trunc('month', od) AS DATE)
                       ELSE CAST(date_trunc('year', od) AS DATE) END AS d FROM o),
tn AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT)) AS tn FROM r WHERE d IS NOT NULL),
rk AS (SELECT rid, row_number() OVER (ORDER BY d DESC, rid DESC) AS rn FROM r WHERE d IS NOT NULL)
SELECT r.rid, CASE WHEN rk.rn <= (SELECT tn FROM tn) THEN 'test' ELSE 'train' END AS part
FROM r LEFT JOIN rk ON rk.rid = r.rid"""


@oracle("q_hash_split")
def _():
    return """WITH ids AS (SELECT DISTINCT doc_id FROM documents
             WHERE doc_id IN (SELECT doc_id FROM labels)),
k AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT)) AS tn FROM ids),
rk AS (SELECT doc_id, row_number() OVER (
         ORDER BY substr(md5(CAST(doc_id AS VARCHAR) || '|13'), 1, 15), doc_id) AS rn FROM ids)
SELECT doc_id, CASE WHEN rn <= (SELECT tn FROM k) THEN 'test' ELSE 'train' END AS part FROM rk"""


@oracle("q_head_split")
def _():
    return """WITH n AS (SELECT count(*) AS n FROM documents),
k AS (SELECT greatest(1, CAST(floor(0.8::DOUBLE * n) AS BIGINT)) AS sn, n FROM n),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, CASE WHEN rn <= (SELECT sn FROM k) THEN 'train' ELSE 'eval' END AS part FROM rk
UNION ALL
SELECT doc_id, 'eval' FROM rk WHERE rn = 1 AND (SELECT sn >= n FROM k)"""


@oracle("q_source_split")
def _():
    from textcards.plans.queries import SOURCE_TEST, SOURCE_TRAIN
    tr = ", ".join(sql_str(s) for s in SOURCE_TRAIN)
    te = ", ".join(sql_str(s) for s in SOURCE_TEST)
    return f"""SELECT doc_id, part FROM (
  SELECT doc_id, CASE WHEN source IN ({tr}) THEN 'train' WHEN source IN ({te}) THEN 'test' END AS part
  FROM documents) x WHERE part IS NOT NULL"""


# --- C9 evidence metrics -------------------------------------------------------------------
def _gold_evidence_ctes():
    kw = LX.DOCUMENT_GOLD_EVIDENCE["language"]
    rows = [(lang, k.lower()) for lang, kws in kw.items() for k in kws]
    from textcards.plans.sqlbits import values
    return f"""
gkw AS (SELECT * FROM {values(rows, ['label', 'kw'])}),
grec AS (SELECT doc_id AS id, lang, lower(coalesce(text, '')) AS tl FROM documents
         WHERE doc_id IN (SELECT doc_id FROM labels)),
gs AS (SELECT id, lang, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS sent
       FROM (SELECT id, lang, {sentences('tl')} AS sl FROM grec)),
gev AS (SELECT DISTINCT gs.id, 'language' AS field, gs.lang AS label, gs.sent_idx
        FROM gs JOIN gkw ON gkw.label = gs.lang AND contains(gs.sent, gkw.kw))"""


def _evidence_metric_sql(pred_cte: str) -> str:
    fields = LX.DOCUMENT_FIELDS
    flist = ", ".join(sql_str(f) for f in fields)
    fvals = ", ".join(f"({sql_str(f)})" for f in fields)

    def pk(k, recall):
        den = "len(gold)" if recall else f"{k}.0"
        return (f"CASE WHEN len(ev[1:{k}]) = 0 THEN 0.0 "
                f"ELSE len(list_intersect(ev[1:{k}], gold)) / {den} END")
    return f""",
items AS (SELECT id, field, label, list(DISTINCT sent_idx) AS gold FROM gev
          WHERE field IN ({flist}) AND id IN (SELECT id FROM grec) GROUP BY id, field, label),
ej AS (SELECT items.id, items.field, items.gold, coalesce(pe.evidence, []) AS ev
       FROM items LEFT JOIN {pred_cte} pe
       ON pe.id = items.id AND pe.field = items.field AND pe.label = items.label),
scr AS (SELECT id, field, {pk(1, False)} AS p1, {pk(3, False)} AS p3, {pk(1, True)} AS r1,
               {pk(3, True)} AS r3, len(ev) > 0 AS anyp FROM ej),
rh AS (SELECT r.id, coalesce(bool_or(s.anyp), false) AS hit
       FROM (SELECT DISTINCT id FROM grec) r LEFT JOIN scr s ON s.id = r.id GROUP BY r.id),
ov AS (SELECT 'overall' AS scope, (SELECT count(*) FROM scr) AS n_items,
              {_r("coalesce((SELECT avg(p1) FROM scr), 0.0)")} AS precision_at_1,
              {_r("coalesce((SELECT avg(p3) FROM scr), 0.0)")} AS precision_at_3,
              {_r("coalesce((SELECT avg(r1) FROM scr), 0.0)")} AS recall_at_1,
              {_r("coalesce((SELECT avg(r3) FROM scr), 0.0)")} AS recall_at_3,
              {_r(_ratio("count(*) FILTER (WHERE hit)", "count(*)"))} AS coverage,
              count(*) AS n_incidents FROM rh),
fs AS (SELECT * FROM (VALUES {fvals}) t(field)),
pf AS (SELECT fs.field AS scope, count(scr.id) AS n_items,
              {_r("coalesce(avg(p1), 0.0)")} AS precision_at_1,
              {_r("coalesce(avg(p3), 0.0)")} AS precision_at_3,
              {_r("coalesce(avg(r1), 0.0)")} AS recall_at_1,
              {_r("coalesce(avg(r3), 0.0)")} AS recall_at_3,
              (SELECT coverage FROM ov) AS coverage, (SELECT n_incidents FROM ov) AS n_incidents
       FROM fs LEFT JOIN scr ON scr.field = fs.field GROUP BY fs.field)
SELECT * FROM ov UNION ALL SELECT * FROM pf"""


@oracle("q_evidence_metrics")
def _():
    return f"WITH {_lexicon_ctes()}, {_gold_evidence_ctes()}" + _evidence_metric_sql("preds")


def _norm_sentence(x):
    return f"regexp_replace({strip(x)}, '{WS_CLASS}+', ' ', 'g')"


@oracle("q_evidence_text_match")
def _():
    return f"""WITH {_lexicon_ctes()}, {_gold_evidence_ctes()},
evkw AS (SELECT tax.field, tax.label, coalesce(l.kw, lower(replace(tax.label, '_', ' '))) AS kw
         FROM tax LEFT JOIN l ON l.field = tax.field AND l.label = tax.label),
so AS (SELECT id, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS sent
       FROM (SELECT doc_id AS id, {sentences("coalesce(text, '')")} AS sl FROM documents)),
ksc AS (SELECT p.id, p.field, p.label, so.sent_idx, so.sent, count(*) AS score
        FROM pred p JOIN evkw ON evkw.field = p.field AND evkw.label = p.label
        JOIN so ON so.id = p.id AND contains(lower(so.sent), evkw.kw)
        GROUP BY p.id, p.field, p.label, so.sent_idx, so.sent),
krk AS (SELECT *, row_number() OVER (PARTITION BY id, field, label
                                     ORDER BY score DESC, sent_idx) AS r FROM ksc),
ptext AS (SELECT id, field, label, r, sent FROM krk WHERE r <= 3),
nidx AS (SELECT id, {_norm_sentence('sent')} AS n, max(sent_idx) AS sent_idx FROM so
         WHERE id IN (SELECT id FROM grec) GROUP BY id, {_norm_sentence('sent')}),
pev AS (SELECT p.id, p.field, p.label, list(n.sent_idx ORDER BY p.r) AS evidence
        FROM ptext p JOIN nidx n ON n.id = p.id AND n.n = {_norm_sentence('p.sent')}
        GROUP BY p.id, p.field, p.label)""" + _evidence_metric_sql("pev")


@oracle("q_evidence_external")
def _():
    return f"""WITH d AS (SELECT doc_id AS id, lang, {sentences("coalesce(text, '')")} AS sl FROM documents),
so AS (SELECT id, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS sent FROM d),
nidx AS (SELECT id, {_norm_sentence('sent')} AS n, max(sent_idx) AS sent_idx FROM so GROUP BY id, {_norm_sentence('sent')}),
k AS (SELECT * FROM d WHERE id IN (SELECT doc_id FROM labels)),
g AS (SELECT id, 'language' AS field, lang AS label, CASE WHEN len(sl) > 0 THEN
             [chr(9) || replace(sl[1], ' ', '  ') || ' ', 'in no record.', sl[len(sl)], sl[len(sl) // 2 + 1]] ELSE ['in no record.'] END AS t FROM k
      UNION ALL SELECT id, 'all', 'every', sl FROM k),
x AS (SELECT id, field, label, unnest(t) AS t, unnest(range(len(t))) AS pos FROM g),
m AS (SELECT x.id, field, label, string_agg(CAST(sent_idx AS VARCHAR), ',' ORDER BY pos) AS evidence
      FROM x JOIN nidx ON nidx.id = x.id AND nidx.n = {_norm_sentence('x.t')} GROUP BY x.id, field, label)
SELECT g.id AS doc_id, g.field, g.label, coalesce(evidence, '') AS evidence
FROM g LEFT JOIN m ON m.id = g.id AND m.field = g.field AND m.label IS NOT DISTINCT FROM g.label"""


# --- C11 stats --------------------------------------------------------------------------------
NOT_WS_CLASS = "[^" + WS_CLASS[1:]


def _profile_ctes():
    return f"""WITH f AS (SELECT doc_id, coalesce(text, '') <> '' AS ht,
                  len(regexp_extract_all(coalesce(text, ''), '{NOT_WS_CLASS}+')) AS ntok
           FROM documents),
lb AS (SELECT l.doc_id, d.lang, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
pr AS (SELECT f.*, lb.doc_id IS NOT NULL AS labelled, lb.lang, lb.quality, lb.toxic,
              2 + CASE WHEN lb.toxic = 1 THEN 1 ELSE 0 END AS card
       FROM f LEFT JOIN lb ON lb.doc_id = f.doc_id)"""


@oracle("q_dataset_stats")
def _():
    return f"""{_profile_ctes()}
SELECT count(*) AS n_total, count(*) FILTER (WHERE ht) AS n_with_text,
       count(*) FILTER (WHERE labelled AND ht) AS n_labeled,
       {_r("coalesce(avg(ntok) FILTER (WHERE ht), 0.0)")} AS avg_length_tokens,
       {_r("coalesce(avg(card) FILTER (WHERE labelled AND ht), 0.0)")} AS avg_label_cardinality
FROM pr"""


@oracle("q_label_distribution")
def _():
    return f"""{_profile_ctes()},
x AS (SELECT 'language' AS field, lang AS label FROM pr WHERE labelled AND ht
      UNION ALL SELECT 'quality', CASE WHEN quality = 1 THEN 'high' ELSE 'low' END
      FROM pr WHERE labelled AND ht
      UNION ALL SELECT 'toxicity', 'toxic' FROM pr WHERE labelled AND ht AND toxic = 1)
SELECT field, label, count(*) AS n FROM x GROUP BY field, label"""


# --- C1 roster ---------------------------------------------------------------------------------
@oracle("q_roster_build")
def _():
    return f"""WITH ro AS (
  SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y-%m-%d') AS incident_id,
         o_orderkey AS k,
         CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE ' ' || o_orderpriority END AS name,
         CASE WHEN o_orderstatus = 'F' THEN 'https://example.org/orders/' || CAST(o_orderkey AS VARCHAR)
              ELSE '' END AS url,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS rd
  FROM orders),
tx AS (SELECT doc_id, text FROM documents),
lb AS (SELECT l.doc_id, d.lang, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
j AS (SELECT ro.*, {strip("coalesce(tx.text, '')")} AS t, lb.doc_id IS NOT NULL AS labelled,
             lb.lang, lb.quality, lb.toxic
      FROM ro LEFT JOIN tx ON tx.doc_id = ro.k LEFT JOIN lb ON lb.doc_id = ro.k)
SELECT {strip('incident_id')} AS incident_id,
       coalesce(nullif({strip('name')}, ''), {strip('incident_id')}) AS incident_name,
       CAST(length(t) AS BIGINT) AS n_chars,
       CAST(CASE WHEN {strip('url')} <> '' THEN 1 ELSE 0 END AS INTEGER) AS n_sources,
       CASE WHEN {strip('url')} <> '' THEN {strip('url')} END AS source_url,
       CASE WHEN {strip('url')} <> '' THEN nullif({strip('rd')}, '') END AS retrieved_date,
       coalesce(CASE WHEN labelled AND toxic = 1 THEN '1999-12-31' END,
                nullif(regexp_extract(incident_id, '(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})', 1), '')) AS date,
       CASE WHEN t = '' THEN true END AS missing_text,
       CASE WHEN labelled THEN 'language=' || lang || ';quality=' ||
            CASE WHEN quality = 1 THEN 'high' ELSE 'low' END || ';toxicity=' ||
            CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END END AS labels
FROM j"""


# --- C6 logits ------------------------------------------------------------------------------------
LOGIT_CTES = f"""
ltax AS (SELECT * FROM {taxonomy_values({LX.LOGIT_FIELD: LX.LOGIT_LABELS})}),
lx AS (SELECT vec_id, label AS gold_label,
              CAST(unnest(range(len(embedding))) AS INTEGER) AS label_pos,
              unnest(embedding) AS logit FROM embeddings),
lp AS (SELECT vec_id, gold_label, label_pos,
              CAST(1 AS FLOAT) / (CAST(1 AS FLOAT) + CAST(exp(-CAST(logit AS DOUBLE)) AS FLOAT)) AS prob
       FROM lx)"""


@oracle("q_logit_labels")
def _():
    return f"""WITH {LOGIT_CTES}
SELECT lp.vec_id, ltax.label, CAST(ltax.label_pos AS INTEGER) AS label_pos,
       {_r('CAST(prob AS DOUBLE)')} AS confidence
FROM lp JOIN ltax ON ltax.label_pos = lp.label_pos WHERE prob >= CAST(0.5 AS FLOAT)"""


@oracle("q_epsilon_f1")
def _():
    return f"""WITH {LOGIT_CTES},
c AS (SELECT CASE WHEN prob >= CAST(0.5 AS FLOAT) THEN 1 ELSE 0 END AS p,
             CASE WHEN label_pos = gold_label THEN 1 ELSE 0 END AS y FROM lp),
s AS (SELECT CAST(sum(p * y) AS BIGINT) AS tp, CAST(sum(p * (1 - y)) AS BIGINT) AS fp,
             CAST(sum((1 - p) * y) AS BIGINT) AS fn FROM c),
m AS (SELECT *, tp / (tp + fp + 1e-9) AS pr, tp / (tp + fn + 1e-9) AS rc FROM s)
SELECT tp, fp, fn, {_r('pr')} AS precision, {_r('rc')} AS recall,
       {_r('2 * pr * rc / (pr + rc + 1e-9)')} AS micro_f1 FROM m"""


@oracle("q_pick_evidence_text")
def _():
    from textcards.plans.sqlbits import values
    rows = [(lab, k.lower()) for lab, kws in LX.LOGIT_EVIDENCE_KEYWORDS.items() for k in kws]
    return f"""WITH {LOGIT_CTES},
ekw AS (SELECT * FROM {values(rows, ['label', 'kw'])}),
evkw AS (SELECT ltax.label, coalesce(ekw.kw, lower(replace(ltax.label, '_', ' '))) AS kw
         FROM ltax LEFT JOIN ekw ON ekw.label = ltax.label),
picked AS (SELECT lp.vec_id AS id, ltax.label FROM lp JOIN ltax ON ltax.label_pos = lp.label_pos
           WHERE prob >= CAST(0.5 AS FLOAT)),
so AS (SELECT id, CAST(unnest(range(len(sl))) AS INTEGER) AS sent_idx, unnest(sl) AS sent
       FROM (SELECT doc_id AS id, {sentences("coalesce(text, '')")} AS sl FROM documents
             WHERE doc_id IN (SELECT id FROM picked))),
ksc AS (SELECT p.id, p.label, so.sent_idx, so.sent, count(*) AS score
        FROM picked p JOIN evkw ON evkw.label = p.label
        JOIN so ON so.id = p.id AND contains(lower(so.sent), evkw.kw)
        GROUP BY p.id, p.label, so.sent_idx, so.sent),
krk AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY score DESC, sent_idx) AS r
        FROM ksc)
SELECT id AS doc_id, label, CAST(r AS INTEGER) AS rank, sent_idx, score, sent AS sentence
FROM krk WHERE r <= 3"""


@oracle("q_score_logits")
def _():
    ranked = ORACLES["q_pick_evidence_text"]
    return f"""WITH ev AS ({ranked}),
{LOGIT_CTES.strip()},
picked AS (SELECT lp.vec_id AS id, ltax.label, ltax.label_pos, CAST(prob AS DOUBLE) AS p
           FROM lp JOIN ltax ON ltax.label_pos = lp.label_pos WHERE prob >= CAST(0.5 AS FLOAT)),
q AS (SELECT doc_id, label, string_agg(sentence, '|' ORDER BY rank) AS e FROM ev GROUP BY doc_id, label),
n AS (SELECT picked.id, string_agg(picked.label, ',' ORDER BY label_pos) AS labels, sum(p) AS conf,
             string_agg(coalesce(q.e, ''), ';' ORDER BY label_pos) AS e
      FROM picked LEFT JOIN q ON q.doc_id = picked.id AND q.label = picked.label GROUP BY picked.id)
SELECT d.doc_id, coalesce(n.labels, '') AS labels, {_r('coalesce(n.conf, 0.0)')} AS confidence, coalesce(n.e, '') AS evidence
FROM documents d LEFT JOIN n ON n.id = d.doc_id WHERE d.doc_id IN (SELECT vec_id FROM embeddings)"""


# --- C12 / C13 --------------------------------------------------------------------------------------
@oracle("q_cards")
def _():
    fvals = ", ".join(f"({sql_str(f)})" for f in LX.DOCUMENT_FIELDS)
    return f"""WITH {_lexicon_ctes()},
orig AS (SELECT doc_id AS id, {sentences("coalesce(text, '')")} AS so FROM documents),
q AS (SELECT preds.id, preds.field, preds.label, preds.label_pos, preds.confidence,
             list_transform(preds.evidence, lambda i: orig.so[i + 1]) AS quotes
      FROM preds JOIN orig ON orig.id = preds.id),
it AS (SELECT id, field, count(*) AS n,
              string_agg(printf('%s (p=%.2f)', label, confidence) ||
                         array_to_string(list_transform(quotes, lambda x: chr(10) || '> ' || x), ''),
                         chr(10) ORDER BY label_pos) AS card
       FROM q GROUP BY id, field),
fs AS (SELECT * FROM (VALUES {fvals}) t(field))
SELECT d.doc_id, fs.field, CAST(coalesce(it.n, 0) AS INTEGER) AS n_labels,
       coalesce(it.card, '_None_') AS card
FROM documents d CROSS JOIN fs LEFT JOIN it ON it.id = d.doc_id AND it.field = fs.field"""


@oracle("q_preview")
def _():
    return """SELECT doc_id, CASE WHEN length(text) > 900 THEN left(text, 900) || '...'
                       ELSE text END AS preview FROM documents"""


@oracle("q_merge_annotations")
def _():
    def parse(raw):
        parts = f"list_transform(string_split({raw}, ','), lambda s: {strip('s')})"
        digits = f"list_filter({parts}, lambda s: regexp_full_match(s, '[0-9]+'))"
        ints = f"list_transform({digits}, lambda s: TRY_CAST(s AS HUGEINT))"
        inside = f"list_filter({ints}, lambda i: i IS NOT NULL AND i >= 0 AND i < ns)"
        return f"list_sort(list_distinct(list_transform({inside}, lambda i: CAST(i AS INTEGER))))"
    opts = {f: labs for f, labs in LX.GOLD_TAXONOMY.items()}
    opt_case = "CASE field " + " ".join(
        f"WHEN {sql_str(f)} THEN [{', '.join(sql_str(x) for x in labs)}]" for f, labs in opts.items()
    ) + " END"
    return f"""WITH recs AS (
  SELECT d.doc_id, coalesce(d.text, '') <> '' AS ht,
         len({sentences("coalesce(d.text, '')")}) AS ns,
         l.doc_id IS NOT NULL AS labelled, d.lang, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
fl AS (SELECT * FROM (VALUES ('language'), ('quality'), ('toxicity')) t(field)),
x AS (SELECT r.*, fl.field, {opt_case} AS options,
        CASE WHEN NOT labelled THEN []
             WHEN field = 'language' THEN [lang]
             WHEN field = 'quality' THEN [CASE WHEN quality = 1 THEN 'high' ELSE 'low' END]
             ELSE CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END END AS old_l,
        CASE WHEN labelled AND field = 'language' THEN [{{'k': lang, 'v': [0]}}]
             ELSE CAST([] AS STRUCT(k VARCHAR, v INTEGER[])[]) END AS old_e,
        CASE WHEN labelled AND field = 'quality'
                  THEN CASE WHEN quality = 1 THEN ' high , bogus ,high' ELSE '' END
             WHEN labelled AND field = 'language'
                  THEN CASE WHEN toxic = 1 THEN 'fr,en' ELSE '   ' END END AS raw,
        CASE WHEN field = 'quality' THEN [{{'k': 'high', 'v': '2, 0,0, 999 ,x, -1, 0000000001, 99999999999999999999'}}]
             WHEN field = 'language' THEN [{{'k': 'fr', 'v': '1'}}, {{'k': 'en', 'v': ''}}]
             ELSE CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[]) END AS ev_raw
      FROM recs r CROSS JOIN fl),
y AS (SELECT *, CASE WHEN {strip("coalesce(raw, '')")} = '' THEN old_l
                     ELSE list_filter(list_transform(string_split(raw, ','), lambda s: {strip('s')}),
                                      lambda s: s <> '' AND list_contains(options, s)) END AS new_l
      FROM x),
z AS (SELECT *, list_distinct(new_l) AS asked FROM y),
w AS (SELECT doc_id, field, new_l,
        list_concat(
          list_filter(old_e, lambda e: NOT list_contains(asked, e.k)),
          list_transform(asked, lambda a: {{'k': a, 'v':
            CASE WHEN {strip("coalesce(list_filter(ev_raw, lambda e: e.k = a)[1].v, '')")} = ''
                 THEN coalesce(list_filter(old_e, lambda e: e.k = a)[1].v, CAST([] AS INTEGER[]))
                 ELSE {parse("list_filter(ev_raw, lambda e: e.k = a)[1].v")} END}})) AS new_e
      FROM z)
SELECT doc_id, field, array_to_string(new_l, ',') AS labels,
       array_to_string(list_transform(list_sort(new_e), lambda e: e.k || ':' || array_to_string(e.v, ',')),
                       ';') AS evidence
FROM w"""


# --- S9 nested records ------------------------------------------------------------------------------
@oracle("q_prediction_records")
def _():
    fvals = ", ".join(f"({sql_str(f)})" for f in LX.DOCUMENT_FIELDS)
    return f"""WITH {_lexicon_ctes()},
fs AS (SELECT * FROM (VALUES {fvals}) t(field)),
agg AS (SELECT id, field,
               string_agg(label, ',' ORDER BY label_pos) AS labels,
               string_agg(printf('%.4f', confidence), ',' ORDER BY label_pos) AS confidences,
               string_agg(array_to_string(evidence, ' '), '|' ORDER BY label_pos) AS evidence
        FROM preds GROUP BY id, field)
SELECT d.doc_id, fs.field, coalesce(agg.labels, '') AS labels,
       coalesce(agg.confidences, '') AS confidences, coalesce(agg.evidence, '') AS evidence
FROM documents d CROSS JOIN fs LEFT JOIN agg ON agg.id = d.doc_id AND agg.field = fs.field"""


@oracle("q_split_label_metrics")
def _():
    base = _label_metric_ctes().replace(
        "pairs AS (SELECT id FROM gids WHERE id IN (SELECT doc_id FROM documents)),",
        """tn AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT)) AS tn
       FROM gids),
trk AS (SELECT id, row_number() OVER (
          ORDER BY substr(md5(CAST(id AS VARCHAR) || '|13'), 1, 15), id) AS rn FROM gids),
tids AS (SELECT id FROM trk WHERE rn <= (SELECT tn FROM tn)),
pairs AS (SELECT id FROM gids WHERE id IN (SELECT doc_id FROM documents)
          AND id IN (SELECT id FROM tids)),""")
    assert "tids" in base
    return f"""{base},
fsum AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro_f1
         FROM plm GROUP BY field)
SELECT field, (SELECT count(*) FROM gids WHERE id IN (SELECT id FROM tids)) AS n,
       (SELECT count(*) FROM pairs) AS n_scored,
       {_r(_ratio('tp', 'tp + fp'))} AS micro_precision, {_r(_ratio('tp', 'tp + fn'))} AS micro_recall,
       {_r(_ratio('2 * tp', '2 * tp + fp + fn'))} AS micro_f1, {_r('macro_f1')} AS macro_f1
FROM fsum WHERE (SELECT count(*) FROM pairs) > 0"""


@oracle("q_incident_lexicon")
def _():
    return f"""WITH {_lexicon_ctes(LX.INCIDENT_LEXICON, LX.INCIDENT_TAXONOMY)}
SELECT id AS doc_id, field, label, hits, confidence, array_to_string(evidence, ',') AS evidence
FROM preds"""


@oracle("q_incident_lexicon_hits")
def _():
    from textcards.plans.queries import INCIDENT_SENTENCES
    said = "[" + ", ".join(sql_str(x) for x in INCIDENT_SENTENCES) + "]"
    pick = lambda k: f"{said}[({k}) % {len(INCIDENT_SENTENCES)} + 1]"
    docs = (f"(SELECT doc_id, {pick('doc_id')} || ' ' || CASE WHEN doc_id % 3 = 0 THEN {pick('doc_id // 7')} ELSE '' END "
            f"|| ' ' || coalesce(text, '') AS text FROM documents)")
    return f"""WITH {_lexicon_ctes(LX.INCIDENT_LEXICON, LX.INCIDENT_TAXONOMY, docs)}
SELECT id AS doc_id, field, label, hits, confidence, array_to_string(evidence, ',') AS evidence FROM preds"""


@oracle("q_large_lexicon")
def _():
    return f"""
WITH d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS tl FROM documents),
w AS (SELECT regexp_extract_all(tl, '[\\p{{L}}\\p{{N}}_]+') AS w FROM d),
l AS (SELECT DISTINCT kw FROM (
        SELECT unnest(w) AS kw FROM w UNION ALL
        SELECT CASE WHEN length(w[i]) >= 6 AND length(w[i + 1]) >= 6 THEN w[i] || ' ' || w[i + 1] END
        FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
      WHERE kw LIKE '% %' OR length(kw) >= 4),
u AS (SELECT id, -1 AS sent_idx, tl AS x FROM d UNION ALL
      SELECT id, CAST(unnest(range(len(sl))) AS INTEGER), unnest(sl) FROM (SELECT id, {sentences('tl')} AS sl FROM d)),
run AS (SELECT id, sent_idx, string_split(x, ' ') AS w
        FROM (SELECT id, sent_idx, unnest(regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}_ ]+|  +')) AS x FROM u)),
tok AS (SELECT DISTINCT id, sent_idx, unnest(w) AS t FROM run),
inside AS (SELECT DISTINCT t, t[i:j] AS kw FROM (SELECT t, i, unnest(range(i + 3, length(t) + 1)) AS j
           FROM (SELECT t, unnest(range(1, length(t) - 2)) AS i FROM (SELECT DISTINCT t FROM tok)))),
two AS (SELECT DISTINCT id, sent_idx, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM run)
        WHERE length(w[i]) >= 6 AND length(w[i + 1]) >= 6),
across AS (SELECT a, b, a[i:] || ' ' || b[:j] AS kw FROM (SELECT a, b, i, unnest(range(6, length(b) + 1)) AS j
           FROM (SELECT a, b, unnest(range(1, length(a) - 4)) AS i FROM (SELECT DISTINCT a, b FROM two)))),
m AS (SELECT DISTINCT id, sent_idx, kw[1:1] AS label, kw FROM (
        SELECT id, sent_idx, kw FROM tok JOIN inside USING (t) JOIN l USING (kw) UNION ALL
        SELECT id, sent_idx, kw FROM two JOIN across USING (a, b) JOIN l USING (kw))),
pred AS (SELECT id, label, count(*) AS hits FROM m WHERE sent_idx = -1 GROUP BY id, label),
ev_all AS (SELECT id, label, min({{'n': length(kw), 'k': kw}}) AS mk, sent_idx FROM m WHERE sent_idx >= 0 GROUP BY id, label, sent_idx),
ev_rank AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY mk, sent_idx) AS rn FROM ev_all),
ev AS (SELECT id, label, string_agg(CAST(sent_idx AS VARCHAR), ',' ORDER BY rn) AS evidence
       FROM ev_rank WHERE rn <= 3 GROUP BY id, label)
SELECT pred.id AS doc_id, label, hits, least(0.95::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * hits) AS confidence,
       coalesce(evidence, '') AS evidence
FROM pred LEFT JOIN ev USING (id, label)"""


@oracle("q_versioned_records")
def _():
    return """
SELECT 'rec-' || doc_id AS incident_id, text, substr(text, 1, 20) AS incident_name,
       trim(coalesce(text, ''), ' ') = '' AS missing_text, lang AS language FROM documents"""


@oracle("q_head_split_by_position")
def _():
    return """
SELECT conv_id, turn, position, CASE WHEN position < greatest(1, floor(0.8::DOUBLE * n)) THEN 'train' ELSE 'eval' END AS part
FROM (SELECT conv_id, turn, row_number() OVER () - 1 AS position, count(*) OVER () AS n FROM conversations)"""


@oracle("q_ovr_score")
def _():
    return f"""WITH {_sentence_score_ctes()},
dterm AS (SELECT doc_id, unnest(ts) AS term FROM vterms),
dw AS (SELECT doc_id, term, df, count(*) * idf AS w FROM dterm JOIN vocab USING (term) GROUP BY doc_id, term, df, idf),
m AS (SELECT doc_id, sqrt(sum(w * w)) AS n, sum(w * ((df % 7) - 3) * 0.5::DOUBLE) AS a, sum(w * ((length(term) % 5) - 2) * 0.75::DOUBLE) AS b
      FROM dw GROUP BY doc_id),
z AS (SELECT d.doc_id, 'common' AS label, coalesce(a / n, 0) + 0.1::DOUBLE AS z FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
      UNION ALL SELECT d.doc_id, 'wordy', coalesce(b / n, 0) - 0.2::DOUBLE FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id),
p AS (SELECT doc_id, label, 1 / (1 + exp(-z)) AS confidence FROM z UNION ALL SELECT doc_id, 'any', 1.0::DOUBLE FROM documents),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, sent_idx DESC) AS rank
       FROM sscore WHERE score > 0),
ev AS (SELECT doc_id, string_agg(CAST(sent_idx AS VARCHAR), ',' ORDER BY rank) AS evidence FROM rk WHERE rank <= 3 GROUP BY doc_id)
SELECT p.doc_id, 'topic' AS field, label, round(confidence, 6) AS confidence, coalesce(evidence, '') AS evidence
FROM p LEFT JOIN ev ON ev.doc_id = p.doc_id WHERE confidence >= 0.5"""
