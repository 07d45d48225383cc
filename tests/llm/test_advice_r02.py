
import random
import time

from tests.llm import brute
from tests.llm.conftest import prose
from textcards.llm import license_scan, paragraph_dedup, shingle_join
from textcards.llm.license_templates import TEMPLATES


# -- op5 -----------------------------------------------------------------------

def wrap(text, n):
    w = text.split()
    return "\n".join(" ".join(w[k:k + n]) for k in range(0, len(w), n))


def test_short_lines_and_passages_over_several_lines(spark):
    rng = random.Random(5)
    passage, line = prose(rng, 60, 10_000), "all rights reserved by the authors here"
    other = wrap(passage, 11).split("\n")
    other[2] = "an edited line"
    rows = [(0, line + "\n" + prose(rng, 30)), (1, prose(rng, 30) + "\n\n" + line), (2, "a b c d\n\na b c d"),
            (3, prose(rng, 12) + "\n\n" + wrap(passage, 12) + "\n \t\n" + prose(rng, 9)), (4, wrap(passage, 12) + "\n\n" + prose(rng, 8)),
            (5, "title of it\n" + passage), (6, passage), (7, "\n".join(other)), (8, prose(rng, 30) + "\n" + line),
            (9, prose(rng, 26) + "\n" + line + "\n" + prose(rng, 33) + "\n" + wrap(passage, 12)), (11, None), (12, "\n\n \n"),
            (13, passage + "\nshort tail"), (14, other[0] + "\n\n" + other[4]), (15, "one two three\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.paragraphs(rows)
    got = {r.doc_id: r for r in paragraph_dedup.dedup_paragraphs(docs).collect()}
    assert {i: (r.removed, r.n_paragraphs) for i, r in got.items()} == want
    assert got[1].removed == [] and got[8].removed == []                    # a stock line of seven words stays
    assert got[4].removed == [0, 1, 2, 3, 4] and got[9].removed == [3, 4, 5, 6, 7] and got[6].removed == [0]
    assert got[15].text == "\n".join(["one two three"] * 7 + [""])          # what repeats itself stays once
    for i, t in rows:
        assert got[i].text == "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want[i][0])


def test_random_wrapped_lines(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.randrange(4, 60), 900) for _ in range(12)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(pool) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 25), 900)
            out += [wrap(x, rng.choice([4, 9, 9, 99])), *rng.choice([[], [""], ["", " "]])]
        rows.append((i, "\n".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.paragraphs(rows)
    assert sum(len(x) for x, _ in want.values()) > 50
    assert {r.doc_id: (r.removed, r.n_paragraphs) for r in paragraph_dedup.dedup_paragraphs(docs).collect()} == want


def test_a_text_of_many_lines(spark):
    """3 MB in 50,000 short lines, and its copy with a line changed: time linear in the text."""
    rng = random.Random(4)
    lines = [prose(rng, 9, 9000) for _ in range(50_000)]
    edited = lines[:25_000] + [prose(rng, 9, 9000)] + lines[25_001:]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(edited)), (3, "\n".join(lines[:100]))], "doc_id long, text string")
    t0 = time.time()
    got = {r.doc_id: r for r in paragraph_dedup.dedup_paragraphs(docs.repartition(3)).collect()}
    assert got[1].removed == [] and got[2].removed[:3] == [0, 1, 2] and len(got[3].removed) == 100
    assert 49_990 <= len(got[2].removed) < 50_000 and got[2].text.split("\n")[-1] == edited[25_000]
    assert time.time() - t0 < 120


# -- op6 -----------------------------------------------------------------------

def best_run(text, template):
    """The highest coefficient of any run of lines, the whole text included."""
    t, lines, best = set(license_scan.bigrams(template)), text.split("\n"), 0.0
    for a in range(len(lines)):
        for b in range(a, len(lines)):
            g = set(license_scan.bigrams("\n".join(lines[a:b + 1])))
            best = max(best, 2 * len(g & t) / (len(g) + len(t)))
    return best


def test_licence_blocks_inside_longer_texts(spark):
    rng = random.Random(8)
    mit, header = wrap(TEMPLATES["MIT"], 14), wrap(TEMPLATES["Apache-2.0-header"], 9)
    filler = lambda n: wrap("of the software " + prose(rng, n) + " in the", 12)
    edited = mit.split("\n")
    edited[3], edited[7] = "another line altogether", edited[7].replace(" or ", " and ")
    texts = [filler(300) + "\n" + mit + "\n" + filler(300), "# " + header.replace("\n", "\n# ") + "\n" + filler(200),
             filler(90) + "\n\n" + "\n\n".join(edited) + "\n" + filler(50), filler(400), mit.replace("\n", "\n\n") + "\n" + filler(200),
             filler(60) + "\nLicensed under CC\nBY 4.0.\n" + filler(60), filler(40) + "\n" + mit + "\n" + filler(9) + "\n" + mit]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        for name in ("MIT", "ISC", "Apache-2.0-header", "CC-BY-4.0-notice", "BSD-3-Clause"):
            want, most = best_run(text, TEMPLATES[name]), max([m.dice for m in got[i].matches if m.license == name], default=0.0)
            assert most == (want if want >= 0.8 else 0.0), (i, name)
    first = texts[0].split("\n").index(mit.split("\n")[0])
    assert [(m.line, m.last, m.license, m.dice) for m in got[0].matches] == [(first, first + mit.count("\n"), "MIT", 1.0)]
    assert len([m for m in got[6].matches if m.license == "MIT" and m.last > m.line >= 0]) == 2 and got[3].matches == []


def test_complete_licences_have_templates(spark):
    bsd = TEMPLATES["BSD-3-Clause"]
    bsd = bsd[:bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE"):]
    free = (license_scan.__file__.rsplit("/", 1)[0] + "/licenses/")
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    texts = {"BSD-2-Clause": bsd} | {k: open(f"{free}{k}.txt").read() for k in names}
    assert "relinquishment in perpetuity" in texts["Unlicense"] and "END OF TERMS" in texts["Apache-2.0"]
    filler = wrap(prose(random.Random(1), 300), 11)
    rows = [x for k, t in texts.items() for x in ((k, t), (k + "+", filler + "\n" + t + "\n" + filler))]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    for r in license_scan.scan(docs).collect():
        found = {m.license: m.dice for m in reversed(r.matches) if m.license in texts or m.license == "BSD-3-Clause"}
        assert max(found, key=found.get) == r.doc_id.rstrip("+") and max(found.values()) == 1.0, r.doc_id


# -- op10 ----------------------------------------------------------------------

def test_partners_two_classes_away(spark):
    rng = random.Random(4)
    for percent in (10, 50, 66, 80):
        for n in range(1, 400):
            most = shingle_join.size_class(n * 100 // percent, percent)[0]
            assert most in shingle_join.size_class(n, percent)
            assert len(shingle_join.size_class(n, percent)) * shingle_join.ROUNDS <= shingle_join.TAGS
    rows = []
    for n in (7, 12, 22, 40, 64):
        w = prose(rng, 2 * n, 10_000).split()
        rows += [(len(rows), " ".join(w[:n])), (len(rows) + 1, " ".join(w[:2 * n - 2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in shingle_join.jaccard_components(docs, n=3, percent=50).collect())
    assert got == brute.jaccard_components(rows, 3, 50) and [c for _, _, c in got] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]
