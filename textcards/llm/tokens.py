"""Vectorised words and shingles of Arrow text columns (numpy, no per-word Python).

All rules work on UTF-8 bytes: every separator is an ASCII byte, so a byte
rule and the same rule on code points cut at the same places.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 1 << 20          # temporary arrays are about 40 times this
_BASE = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2**64


def table(is_word) -> np.ndarray:
    """Byte -> 0 outside words, else lower-cased byte + 1."""
    t = np.zeros(256, np.uint16)
    for b in range(256):
        if is_word(b):
            t[b] = (b + 32 if 0x41 <= b <= 0x5A else b) + 1
    return t


#: words [^\x20\x09-\x0D]+ after lower-casing A-Z
NON_SPACE = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = powers(max(n, CHUNK_BYTES + 1), base)
    return _cache[base][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets); null counts as empty."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if big else np.int32)[column.offset:column.offset + n + 1]
    offsets = offsets.astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents of about ``limit`` bytes together (one at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


SLICE_BYTES = 4 << 20


def slices(batch, text: str):
    """An Arrow batch in parts of about ``SLICE_BYTES`` of text (one row at
    least): what a task makes of a batch, and returns at once, stays small."""
    _, offs = text_bytes(batch.column(text))
    for i, j in chunks(offs, SLICE_BYTES):
        yield batch.slice(i, j - i)


def _words(buf, offs, lut):
    low = lut[buf]
    inside = low != 0
    n = len(buf)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    acc = np.zeros(n + 1, U64)
    np.cumsum(low * _powers(_BASE, n), out=acc[1:])
    h = (acc[ends] - acc[starts]) * _powers(pow(_BASE, -1, 1 << 64), n)[starts]
    return mix(h), np.searchsorted(offs, starts, side="right") - 1


def words(buf: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its document), in text order.

    A single document beyond ``CHUNK_BYTES`` is read in pieces cut between
    words, so memory follows the number of words, not of bytes."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if n <= 2 * CHUNK_BYTES or len(offs) > 2:
        return _words(buf, offs, lut)
    parts, i = [], 0
    while i < n:
        j = min(n, i + CHUNK_BYTES)
        while j < n and lut[buf[j]]:     # go on to the end of the word
            j += 1
        parts.append(_words(buf[i:j], np.array([0, j - i]), lut)[0])
        i = j
    h = np.concatenate(parts)
    return h, np.zeros(len(h), np.int64)


_K = [int(x) | 1 for x in mix(np.arange(1, 65, dtype=U64))]


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    out = np.full(m, n, U64)
    for i in range(n):
        out += h[i:i + m] * U64(_K[i % 64]) + U64(i)
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash of a whole word sequence, other than any shingle's."""
    p = powers(len(h))
    total = int((h * p).sum(dtype=U64)) + len(h) * _K[63]
    return mix(np.array([total % (1 << 64)], U64))


def shingle_sets(buf, offs, lut, n: int):
    """For each document its sorted distinct shingle hashes (uint64).

    ``n`` words make a shingle; a document of fewer words, but not none, has
    its whole sequence as its only one."""
    h, doc = words(buf, offs, lut)
    edge = np.searchsorted(doc, np.arange(len(offs)))
    sh = combine(h, n) if len(h) >= n else np.zeros(0, U64)
    for i in range(len(offs) - 1):
        a, b = edge[i], edge[i + 1]
        if b - a >= n:
            s = np.sort(sh[a:b - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield sequence_hash(h[a:b])
        else:
            yield np.zeros(0, U64)


def trimmed(run):
    """Task code that gives its memory back when it ends: workers are reused, and
    what they keep is missing for the stages that follow."""
    def task(batches):
        yield from run(batches)
        import ctypes
        import pyarrow as pa
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
        if trim is not None:
            trim(0)
    return task
