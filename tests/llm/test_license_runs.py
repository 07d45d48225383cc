"""Operator 6: runs of lines against every run tried, and the time on long texts."""

import random
import time

from textcards.llm import license_scan
from textcards.llm.license_templates import TEMPLATES


def every_run(text, template, threshold=0.8):
    """(line, last, dice) of the runs that count, from the rules: all of them built."""
    t = set(license_scan.bigrams(template))
    lines = [(i, w) for i, w in enumerate(license_scan.normalise(x).split() for x in text.lower().split("\n")) if w]
    grams = lambda part: set(license_scan.bigrams(" ".join(x for _, w in part for x in w)))
    dice = lambda g: 2.0 * len(g & t) / (len(g) + len(t)) if g else 0.0
    whole, single, runs = dice(grams(lines)), {i: dice(grams([(i, w)])) for i, w in lines}, []
    for x in range(len(lines)):
        for y in range(x + 1, len(lines)):
            own = grams(lines[x:y + 1])
            wider = [grams(lines[x - 1:y + 1])] * (x > 0) + [grams(lines[x:y + 2])] * (y + 1 < len(lines))
            longer = any(g - own and g - own <= t for g in wider)
            # what the line adds, repeated ones included, must all be the template's
            before = x > 0 and set(license_scan.bigrams(" ".join([*lines[x - 1][1], lines[x][1][0]]))) <= t
            after = y + 1 < len(lines) and set(license_scan.bigrams(" ".join([lines[y][1][-1], *lines[y + 1][1]]))) <= t
            if longer and ((before and wider[0] - own) or (after and wider[-1] - own)):
                continue
            d = dice(own)
            if d >= threshold and not (whole >= threshold and whole >= d) and not any(
                    single[i] >= threshold and single[i] >= d for i, _ in lines[x:y + 1]):
                runs.append((-d, lines[y][0] - lines[x][0], lines[x][0], lines[y][0]))
    kept = []
    for r in sorted(runs):
        if not any(k[2] <= r[3] and r[2] <= k[3] for k in kept):
            kept.append(r)
    return sorted((a, b, -d) for d, _, a, b in kept)


def test_runs_equal_every_run_tried(spark):
    rng = random.Random(5)
    own = {"a": "one two three four five six seven eight", "b": "permission is granted to use copy modify merge and sell copies of it to use it",
           "c": "this software is provided as is without warranty of any kind or support of any kind"}
    words = sorted({w for t in own.values() for w in t.split()}) + ["foo", "bar", "baz"]
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(2, 6)):
            w = rng.choice(list(own.values())).split() if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 12))
            w = [rng.choice(words) if rng.random() < 0.05 else x for x in w]
            while w:
                n = rng.randint(1, 6)
                lines.append(rng.choice(["", "# ", "  "]) + " ".join(w[:n]) + rng.choice(["", ".", "\n"]))
                w = w[n:]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    some = 0
    for r in license_scan.scan(docs, texts=own).collect():
        for name, template in own.items():
            got = sorted((m.line, m.last, m.dice) for m in r.matches if m.license == name and m.last > m.line >= 0)
            assert got == every_run(texts[r.doc_id], template), (texts[r.doc_id], name)
            some += len(got)
    assert some > 100


def seconds(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.time()
    row = license_scan.scan(df).first()
    return time.time() - t0, row


def test_long_texts_take_linear_time(spark):
    rng = random.Random(2)
    mit = TEMPLATES["MIT"].strip()
    words = sorted({w for t in TEMPLATES.values() for w in license_scan.normalise(t).split()})
    prose = lambda n: "\n".join(" ".join(rng.choices(words, k=11)) for _ in range(n))
    seconds(spark, prose(10) + "\n" + mit)
    for make in (lambda n: prose(n * 1300) + "\n" + mit, lambda n: "\n".join([mit] * (90 * n)),
                 lambda n: "\n".join(["Released under the MIT License."] * (3000 * n))):
        (short, _), (long, row) = seconds(spark, make(1)), seconds(spark, make(30))
        assert long < 45 * max(short, 1.0), (short, long)
        assert any(m.license.startswith("MIT") and m.dice == 1.0 for m in row.matches)
