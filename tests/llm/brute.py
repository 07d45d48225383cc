"""Plain statements of the operators' rules, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOW))


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


class Union:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def jaccard_components(rows, n, percent):
    """[(doc_id, text)] -> sorted (doc_id, size, component)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    u = Union({i for i, _ in rows if i is not None})
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t:
                k = len(s & t)
                if 100 * k >= percent * (len(s) + len(t) - k):
                    u.join(i, j)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, len(s), None if i is None else u.find(i)) for i, s in sets), key=key)


def contamination(rows, items, window=10):
    """[(doc_id, text)] -> per row (n_words, n_hit, n_items, sha256, contaminated)."""
    known = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            known[tuple(w[a:a + k])].add("" if i is None else str(i))
    out = []
    for _, t in rows:
        w, hit, found = words(t, ALNUM), set(), set()
        for k in {len(x) for x in known}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in known:
                    hit.update(range(a, a + k))
                    found |= known[tuple(w[a:a + k])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def substrings(rows, length):
    """[(doc_id, text)] -> per row (n_bytes, n_removed, n_spans, kept sha256)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                mark[p:p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


def paragraphs(rows, percent=80, min_words=20):
    """[(doc_id, text)] with distinct ids -> {doc_id: (removed lines, n_paragraphs)}."""
    found, count = [], {}
    for i, t in rows:
        lines = [words(x) for x in (t or "").split("\n")]
        mine = []
        for k, line in enumerate(lines):
            ends = [m for m in range(k, len(lines)) if sum(map(len, lines[k:m + 1])) >= min_words]
            if line and ends:
                mine.append((i, k, ends[0], shingles(" ".join(sum(lines[k:ends[0] + 1], [])), 5)))
        count[i] = len(mine)
        found += mine
    found.sort(key=lambda p: p[:2])
    u = Union(range(len(found)))
    for a, p in enumerate(found):
        for b in range(a):
            k = len(p[3] & found[b][3])
            if 100 * k >= percent * (len(p[3]) + len(found[b][3]) - k):
                u.join(a, b)
    gone = {i: set() for i, _ in rows}
    for a, (i, k, m, _) in enumerate(found):
        first = found[u.find(a)]
        if u.find(a) != a:
            gone[i] |= {x for x in range(k, m + 1) if not (first[0] == i and first[1] <= x <= first[2])}
    return {i: (sorted(gone[i]), count[i]) for i, _ in rows}
