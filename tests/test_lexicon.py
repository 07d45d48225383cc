from hypothesis import given, settings, strategies as st

from textcards import lexicons as LX
from textcards.operators import lexicon as L
from tests.test_text import py_sentences


def py_score(text, field_map):
    """Brute-force statement of the lexicon rule (test oracle)."""
    tl, sents = text.lower(), py_sentences(text)
    out = {}
    for label, kws in field_map.items():
        hits, evid = 0, []
        for kw in kws:
            if kw.lower() in tl:
                hits += 1
                evid += [i for i, s in enumerate(sents) if kw.lower() in s.lower()]
        if hits:
            out[label] = (hits, min(0.95, 0.3 + 0.2 * hits), list(dict.fromkeys(evid))[:3])
    return out


def spark_score(spark, texts, mapping, taxonomy=None, quotes=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lex = L.lexicon_table(spark, mapping)
    tax = L.taxonomy_table(spark, taxonomy) if taxonomy else None
    p = L.lexicon_predict(docs, lex, "doc_id", "text", tax, quotes=quotes)
    out = {}
    for r in p.collect():
        out.setdefault(r["doc_id"], {}).setdefault(r["field"], {})[r["label"]] = (
            r["hits"], r["confidence"], list(r["evidence"])) + ((list(r["quotes"]),) if quotes else ())
    return out


NARRATIVE = ("The vehicle lifted off on schedule. Guidance software lost attitude reference "
             "after staging. Telemetry dropped for a minute. Engineers reviewed the control "
             "logs and found a tumble.")


def test_incident_lexicon_semantics(spark):
    got = spark_score(spark, [NARRATIVE], LX.INCIDENT_LEXICON, LX.INCIDENT_TAXONOMY)[0]
    for field, fmap in LX.INCIDENT_LEXICON.items():
        want = py_score(NARRATIVE, fmap)
        assert got.get(field, {}) == want, field
    sub = got["subsystem"]
    assert sub["gnc"] == (4, 0.95, [1, 3])                 # capped at 0.95
    assert sub["raptor_engine"] == (1, 0.5, [3])           # "engine" inside "Engineers"
    assert sub["software"][1] == 0.5
    # "telemetry" (avionics) and "telemetry dropped" (communications): same sentence
    assert got["subsystem"]["communications"][2] == [2]


def test_three_hits_confidence_bits(spark):
    text = "Flames and fire. Burning debris."
    got = spark_score(spark, [text], {"failure_mode": LX.INCIDENT_LEXICON["failure_mode"]})
    assert got[0]["failure_mode"]["fire"] == (3, 0.9000000000000001, [0, 1])


def test_evidence_order_follows_keywords_then_sentences(spark):
    mapping = {"f": {"lab": ["zeta", "alpha"], "dup": ["kw", "kw"]}}
    text = "alpha one. alpha two. zeta three. alpha four. zeta five. kw."
    got = spark_score(spark, [text], mapping)[0]["f"]
    assert got["lab"] == (2, 0.7, [2, 4, 0])               # zeta's sentences first
    assert got["dup"][0] == 2                               # listed twice counts twice


def test_keyword_spanning_sentences_labels_without_evidence(spark):
    mapping = {"f": {"x": ["end. start"]}}
    got = spark_score(spark, ["The end. start again."], mapping)[0]["f"]
    assert got["x"] == (1, 0.5, [])


def test_taxonomy_filter_and_quotes(spark):
    mapping = {"f": {"keep": ["cat"], "drop": ["cat"]}}
    got = spark_score(spark, ["A Cat. Dog."], mapping, {"f": ["keep"]}, quotes=True)[0]["f"]
    assert got == {"keep": (1, 0.5, [0], ["A Cat."])}


TEXTS = [NARRATIVE, "Pad damage and a leak; the tower was destroyed. Delay expected!", "", None,
         "Fire. fire! The engine-fire; ENGINE lost.\nLost engine? Engineers_ tank the tank farm.", "\u0130stanbul fire \U0001f525. Fire"]
OPTIONS = [{}, {"quotes": True}, {"whole_word": True}, {"ranked_k": 2, "quotes": True}, {"keep_sentences": True},
           {"whole_word": True, "ranked_k": 3, "max_evidence": 1}]


def _all_columns(spark, lex, options):
    docs = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(TEXTS)], "doc_id int, name string, text string")
    p = L.lexicon_predict(docs, lex, ["doc_id", "name"], "text", L.taxonomy_table(spark, LX.INCIDENT_TAXONOMY), **options)
    return p.columns, sorted(map(repr, p.collect()))


def test_automaton_equals_join(spark, monkeypatch):
    from textcards.operators import keyword_automaton as K
    lexicon = {f: dict(v) for f, v in LX.INCIDENT_LEXICON.items()}
    lexicon["cause"] = dict(lexicon["cause"], unknown=["fire", "fire", "", "the engine", "zz"], weather=[None, "Fire"])
    lex = L.lexicon_table(spark, lexicon)
    join = [_all_columns(spark, lex, o) for o in OPTIONS]
    labels = sorted(map(repr, L.lexicon_labels(spark.createDataFrame([(0, TEXTS[0])], "doc_id int, text string"), lex).collect()))
    monkeypatch.setattr(L, "MAX_JOIN_KEYWORDS", 7)
    for chars in (10**6, 900):                       # one automaton, and several that are merged
        monkeypatch.setattr(K, "MAX_AUTOMATON_CHARS", chars)
        assert [_all_columns(spark, lex, o) for o in OPTIONS] == join
        assert sorted(map(repr, L.lexicon_labels(
            spark.createDataFrame([(0, TEXTS[0])], "doc_id int, text string"), lex).collect())) == labels


def test_automaton_has_one_scan_and_no_shuffle(spark, monkeypatch, tmp_dir):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").write.parquet(tmp_dir + "/d")
    monkeypatch.setattr(L, "MAX_JOIN_KEYWORDS", 7)
    p = L.lexicon_predict(spark.read.parquet(tmp_dir + "/d"), L.lexicon_table(spark, LX.INCIDENT_LEXICON), "doc_id", "text")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "MapInArrow" in plan


WORDS = st.sampled_from(["fire", "Fire", "leak", "tumble", "engine", "x", "FTS", "tank",
                         "header tank", ". ", "! ", "? ", " ", "\n", "pad", "  "])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=25).map("".join), min_size=1, max_size=5))
def test_matches_brute_force(spark, texts):
    got = spark_score(spark, texts, LX.INCIDENT_LEXICON)
    for i, t in enumerate(texts):
        for field, fmap in LX.INCIDENT_LEXICON.items():
            assert got.get(i, {}).get(field, {}) == py_score(t, fmap)


def test_keyword_sentence_ranking(spark):
    docs = spark.createDataFrame([(1, "a b. b c. c c. d.")], "id int, text string")
    picked = spark.createDataFrame([(1, "f", "lab"), (1, "f", "none_hit")],
                                   "id int, field string, label string")
    lex = L.lexicon_table(spark, {"f": {"lab": ["b", "c"]}})
    tax = L.taxonomy_table(spark, {"f": ["lab", "none_hit"]})
    labels = L.evidence_label_table(tax, lex)
    r = L.keyword_sentence_ranking(docs, picked, labels, "id", "text", 3).collect()
    got = sorted((x["label"], x["rank"], x["sent_idx"], x["score"], x["sentence"]) for x in r)
    # scores: s0=1 (b), s1=2 (b,c), s2=1 (c), s3=0; ties keep sentence order
    assert got == [("lab", 1, 1, 2, "b c."), ("lab", 2, 0, 1, "a b."), ("lab", 3, 2, 1, "c c.")]


def test_whole_word_option(spark):
    docs = spark.createDataFrame([(0, "Engineers checked. The engine (main) failed; re-engine?")],
                                 "doc_id int, text string")
    lex = L.lexicon_table(spark, {"f": {"eng": ["engine"], "dot": ["a.b"]}})
    sub = {r["label"]: list(r["evidence"]) for r in
           L.lexicon_predict(docs, lex, "doc_id", "text").collect()}
    whole = {r["label"]: list(r["evidence"]) for r in
             L.lexicon_predict(docs, lex, "doc_id", "text", whole_word=True).collect()}
    assert sub == {"eng": [0, 1]}
    assert whole == {"eng": [1]}          # "Engineers" no longer matches; "re-engine" does
    # regex metacharacters in keywords are literal
    d2 = spark.createDataFrame([(1, "x a.b y. axb.")], "doc_id int, text string")
    got = [r["label"] for r in L.lexicon_predict(d2, lex, "doc_id", "text", whole_word=True).collect()]
    assert got == ["dot"]
