"""Lexicon matching for large lexicons (J5 J6 F7): one Aho-Corasick automaton
finds every keyword of a text in one walk over it, however many keywords there
are, where the join of ``lexicon`` tests keyword after keyword.

The lexicon's rows come to the driver (their characters are counted first) and
go to the workers, which build the automaton once each.  A task walks the lowered
text of a record, and its sentences where evidence is wanted, and returns one row
per (record, label) with the same meaning as the join's.  Texts do not move.
Beyond ``MAX_AUTOMATON_CHARS`` the lexicon is dealt by keyword over several
automata, each with its own scan; partial hits and evidence of a (record, label)
are then merged by one grouping on both, so no keyword is left out and a label
may hold any number of them.
"""

from __future__ import annotations

import math
import sys
import unicodedata

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the keywords of one automaton (about 40 bytes each in a worker).
MAX_AUTOMATON_CHARS = 8_000_000
ENTRY = ["field", "label", "label_pos", "kw_pos", "kw"]
FOUND = ("field string, label string, label_pos int, hits long, "
         "ev array<struct<ord:int,kw:string,idx:int,s:string>>, rk array<struct<idx:int,score:long,s:string>>")

# Task code is pickled by value: executors need only pyarrow and ahocorasick.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lexicon_entries(lexicon: DataFrame, taxonomy: DataFrame | None = None, fields=None) -> DataFrame:
    """``ENTRY`` rows: lowered keywords; labels outside the taxonomy go."""
    lex = lexicon if fields is None else lexicon.where(F.col("field").isin(list(fields)))
    if taxonomy is not None:
        lex = lex.join(taxonomy.select("field", "label"), ["field", "label"], "left_semi")
    return lex.select("field", "label", "label_pos", "kw_pos", F.lower("keyword").alias("kw")).where("kw is not null")


class Matcher:
    """The automaton of a worker: keyword -> its uses (label number, order)."""

    def __init__(self, entries: list[tuple]):
        import ahocorasick
        self.labels, numbers, uses = [], {}, {}
        for field, label, label_pos, kw_pos, kw in entries:
            key = (field, label, label_pos)
            if key not in numbers:
                numbers[key] = len(self.labels)
                self.labels.append(key)
            uses.setdefault(kw, []).append((numbers[key], kw_pos))
        self.words, self.uses = list(uses), list(uses.values())
        self.everywhere = self.words.index("") if "" in uses else None
        self.automaton = ahocorasick.Automaton()
        for k, word in enumerate(self.words):
            if word:
                self.automaton.add_word(word, k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str, whole_word: bool = False) -> set[int]:
        """Numbers of the keywords in ``text``."""
        out = set()
        if self.everywhere is not None and (not whole_word or any(
                not _wordy(text, i - 1) and not _wordy(text, i) for i in range(len(text) + 1))):
            out.add(self.everywhere)            # the empty keyword
        if not len(self.automaton):
            return out
        if not whole_word:
            out.update(k for _, k in self.automaton.iter(text))
            return out
        for end, k in self.automaton.iter(text):
            if k not in out and not _wordy(text, end - len(self.words[k])) and not _wordy(text, end + 1):
                out.add(k)
        return out

    def match(self, text: str, lowered, sentences, max_evidence: int, ranked: bool, whole_word: bool):
        """``[(label number, hits, evidence, ranking)]`` of a record.  Evidence:
        (kw_pos, keyword, sentence number, sentence) in order, the first
        ``max_evidence`` distinct numbers; ranking: every sentence that holds a
        keyword of the label, with the number of them."""
        by_label: dict[int, list] = {}
        hits = self.found(text, whole_word)
        for k in hits:
            for lab, pos in self.uses[k]:
                by_label.setdefault(lab, []).append((pos, self.words[k], k))
        if not by_label or lowered is None:
            return [(lab, len(used), [], []) for lab, used in by_label.items()]
        where: dict[int, list] = {}
        counts: dict[tuple, int] = {}
        for i, s in enumerate(lowered):
            inside = self.found(s, whole_word)
            for k in inside & hits:
                if len(at := where.setdefault(k, [])) < max_evidence:
                    at.append(i)
            if ranked:
                for k in self.found(s) if whole_word else inside:
                    for lab, _ in self.uses[k]:
                        if lab in by_label:
                            counts[lab, i] = counts.get((lab, i), 0) + 1
        text_of = (lambda i: sentences[i]) if sentences is not None else (lambda i: None)
        out = []
        for lab, used in by_label.items():
            evidence, seen = [], set()
            for pos, word, k in sorted(used):
                for i in where.get(k, ()):
                    if i not in seen and len(seen) < max_evidence:
                        seen.add(i)
                        evidence.append((pos, word, i, text_of(i)))
            out.append((lab, len(used), evidence,
                        [(i, counts[lab, i], text_of(i)) for i in range(len(lowered)) if (lab, i) in counts] if ranked else []))
        return out


def _wordy(text: str, i: int) -> bool:
    """Whether there is a word character (letter, number, underscore) at ``i``."""
    return 0 <= i < len(text) and (text[i] == "_" or unicodedata.category(text[i])[0] in "LN")


_built: dict[int, tuple] = {}


def matches(entries: list[tuple], keep: list[str], max_evidence: int, ranked: bool, whole_word: bool):
    """Task code: records -> rows of ``keep`` and ``FOUND``."""
    key = hash(tuple(entries))

    def run(batches):
        import pyarrow as pa
        if key not in _built:
            _built.clear()              # one automaton a worker
            _built[key] = Matcher(entries)
        m = _built[key]
        shape = pa.schema([("field", pa.string()), ("label", pa.string()), ("label_pos", pa.int32()), ("hits", pa.int64()),
                           ("ev", pa.list_(pa.struct([("ord", pa.int32()), ("kw", pa.string()), ("idx", pa.int32()), ("s", pa.string())]))),
                           ("rk", pa.list_(pa.struct([("idx", pa.int32()), ("score", pa.int64()), ("s", pa.string())])))])
        for batch in batches:
            names = batch.schema.names
            column = lambda c: batch.column(c) if c in names else None
            tl, sl, so = column("_tl"), column("_sl"), column("_so")
            at, rows = [], []

            def made():
                kept = batch.select(keep).take(pa.array(at, pa.int32()))
                flat = list(zip(*rows))
                return pa.RecordBatch.from_arrays(
                    [*kept.columns, *(pa.array(v, t) for v, t in zip(flat, shape.types))], names=[*keep, *shape.names])

            for i in range(batch.num_rows):
                for lab, hits, ev, rk in m.match(tl[i].as_py(), None if sl is None else sl[i].as_py(),
                                                 None if so is None else so[i].as_py(), max_evidence, ranked, whole_word):
                    at.append(i)
                    rows.append((*m.labels[lab], hits, [dict(zip(("ord", "kw", "idx", "s"), e)) for e in ev],
                                 [dict(zip(("idx", "score", "s"), e)) for e in rk]))
                if len(rows) >= 5_000:
                    yield made()
                    at, rows = [], []
            if rows:
                yield made()
    return run


def automaton_matches(prepared: DataFrame, keep: list[str], entries: DataFrame, max_evidence: int = 3,
                      ranked: bool = False, whole_word: bool = False) -> DataFrame:
    """``keep`` columns of ``prepared`` (``_tl`` lowered text, ``_sl`` lowered and
    ``_so`` verbatim sentences where wanted) with ``FOUND``, a row per label found.

    ``keep`` must identify a record together with its other kept columns."""
    chars = entries.agg(F.sum(F.length("kw") + 1)).first()[0] or 0
    n = max(1, math.ceil(chars / MAX_AUTOMATON_CHARS))
    used = [*keep, *[c for c in ("_tl", "_sl", "_so") if c in prepared.columns and c not in keep]]
    rows = prepared.select(*used)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", " + FOUND
    dealt = entries.withColumn("_part", F.pmod(F.xxhash64("kw"), F.lit(n))) if n > 1 else entries
    parts = []
    for i in range(n):
        part = dealt.where(F.col("_part") == i) if n > 1 else dealt
        rows_of = [tuple(r) for r in part.select(*ENTRY).collect()]       # within MAX_AUTOMATON_CHARS
        parts.append(rows.mapInArrow(matches(rows_of, keep, max_evidence, ranked, whole_word), schema))
    if n == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keep, "field", "label", "label_pos").agg(
        F.sum("hits").alias("hits"), F.flatten(F.collect_list("ev")).alias("ev"), F.flatten(F.collect_list("rk")).alias("rk"))


def evidence_of(ev, max_evidence: int):
    """The first distinct sentences in keyword order: ``(numbers, sentences)``."""
    order = F.array_sort(ev)
    numbers = F.slice(F.array_distinct(F.transform(order, lambda x: x["idx"])), 1, max_evidence)
    texts = F.transform(numbers, lambda i: F.filter(ev, lambda x: x["idx"] == i)[0]["s"])
    return numbers, texts


def ranking_of(rk, k: int):
    """The top sentences by number of keywords (partial numbers of the same
    sentence are added), ties in sentence order."""
    numbers = F.array_distinct(F.transform(rk, lambda x: x["idx"]))
    total = F.transform(numbers, lambda i: F.struct(
        (-F.aggregate(F.filter(rk, lambda x: x["idx"] == i), F.lit(0).cast("long"), lambda s, x: s + x["score"])).alias("neg"),
        i.alias("idx"), F.filter(rk, lambda x: x["idx"] == i)[0]["s"].alias("s")))
    return F.transform(F.slice(F.array_sort(total), 1, k), lambda x: F.struct(
        x["idx"].alias("sent_idx"), (-x["neg"]).alias("score"), x["s"].alias("sentence")))
