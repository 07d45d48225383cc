"""Operator 13: byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary is a file of ranks (base64 of the token's bytes, rank); the rank
is the id.  The library's model works on characters, so every byte is written
as one printable character (``byte_characters``).  The merges, which the file
does not list, follow from the ranks: the two parts of a token are what the
merges of lower ranks leave of it.  A file in which a token has other than two
such parts is no BPE vocabulary and is refused.

Encoding: the pattern cuts the text, each match is encoded separately, no
special tokens.  Offsets are the first character and the one after the last
that a token's bytes belong to; tokens that hold parts of one character have
the same offsets.  Decoding reverses the byte table; a character whose bytes
are split over tokens comes out with the token that completes it.

One pass each, over Arrow batches in small slices, no shuffle.  The model
(bounded by ``MAX_VOCABULARY_BYTES``) is made once on the driver and loaded
once per worker.

Cases: a null or empty text has no ids and decodes to no bytes.  Very long
texts are encoded whole, in parts cut before a lone space, where the pattern
cuts anyway (so a pattern must not match across a space between two non-space
characters).  Repeated rows stay.  An empty table gives an empty result.  The
given columns come back in the struct ``row``, so their names do not clash with
``ids``, ``starts``, ``ends``, ``bytes``, ``text`` and ``pieces``.  Bytes that
are no UTF-8 decode to U+FFFD in ``text``; an unknown id stops the job, a null
id list decodes to no bytes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm import ship, tokens
from textcards.llm.token_output import pieces, read_vocabulary

#: Fixed value: the pattern that the library's byte-level step has built in (one step instead of two).
BUILT_IN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SLICE_BYTES = 4 << 20
LONG = 1 << 20               # characters of a text that is cut into units at once


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable Latin-1, else the
    next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else more))
        more += b not in printable
    return out


def parse_ranks(vocabulary: bytes) -> dict[bytes, int]:
    import base64
    ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, filter(None, vocabulary.splitlines()))}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    return ranks


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges of lower ranks than the token's leave of it."""
    parts, limit = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while True:
        pairs = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank >= limit:
            return parts
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def model(vocabulary: bytes, pattern: str) -> str:
    """The library's tokenizer for these ranks, as JSON."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, chars = parse_ranks(vocabulary), byte_characters()
    written = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = parts_of(token, ranks)
        if len(parts) != 2:
            raise ValueError(f"token {token!r} is not a merge of two tokens of lower rank")
        merges.append((written(parts[0]), written(parts[1])))
    made = Tokenizer(models.BPE(vocab={written(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True) if pattern == BUILT_IN else \
        pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


_loaded: dict[int, object] = {}


def loaded(made: str):
    """The tokenizer of a worker; one thread, as Spark runs a task per core."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    key = hash(made)
    if key not in _loaded:
        _loaded[key] = Tokenizer.from_str(made)
    return _loaded[key]


#: A stretch of text that the pattern treats alike wherever it stands: cut before
#: every lone space between two non-space characters.
UNIT = re.compile(r"(?: (?=\S))?\S*(?:(?! \S)\s+\S*)*")
CACHED_UNITS, CACHED_LENGTH = 200_000, 64


SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())


class Encoder:
    """A worker's encoder.  Units met before are looked up (two generations of
    about ``CACHED_UNITS``, short ones only), the others go through the library,
    joined to one text and told apart by their numbers of bytes."""

    def __init__(self, tok, offsets: bool):
        self.tok, self.offsets = tok, offsets
        self.size = np.array([len(x or b"") for x in byte_table(tok)])
        self.young, self.old = {}, {}

    def learn(self, units: set[str]):
        if self.offsets:
            units = list(units)
            for u, e in zip(units, self.tok.encode_batch(units, add_special_tokens=False)):
                span = np.array(e.offsets, np.int32).reshape(-1, 2)
                self.young[u] = (np.array(e.ids, np.int32), span[:, 0], span[:, 1])
            return
        # units that start with their lone space and end with no white space: a
        # row of them is a text that is cut into just these units
        plain = [u for u in units if len(u) > 1 and u[0] == " " and u[1] not in SPACES and u[-1] not in SPACES]
        rest = units.difference(plain)
        for u, e in zip(rest, self.tok.encode_batch_fast(list(rest), add_special_tokens=False)):
            self.young[u] = np.array(e.ids, np.int32).tobytes()
        if plain:
            ids = np.array(self.tok.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)))
            cut = 4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)
            raw = ids.tobytes()
            cut = cut.tolist()
            self.young.update(zip(plain, map(raw.__getitem__, map(slice, [0, *cut], cut))))

    def __call__(self, texts: list[str]) -> list[list[np.ndarray]]:
        """``[ids]`` or ``[ids, starts, ends]``, each a list of arrays, a text each."""
        units = [UNIT.findall(t) if len(t) <= LONG else [u for piece in pieces(t) for u in UNIT.findall(piece)] for t in texts]
        new = set(chain.from_iterable(units)).difference(self.young)
        met = new.intersection(self.old)
        self.young.update(zip(met, map(self.old.__getitem__, met)))
        new -= met
        self.learn(new)
        look = self.young.__getitem__
        if self.offsets:
            out = [self.placed(us) for us in units]
            out = [[x[c] for x in out] for c in range(3)]
        else:
            out = [[np.frombuffer(b"".join(map(look, us)), np.int32) for us in units]]
        for u in [u for u in new if len(u) > CACHED_LENGTH]:
            del self.young[u]
        if len(self.young) > CACHED_UNITS:
            self.young, self.old = {}, self.young
        return out

    def placed(self, units):
        found, at = [self.young[u] for u in units], 0
        ids, starts, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for u, (i, a, b) in zip(units, found):
            ids.append(i)
            starts.append(a + at)
            ends.append(b + at)
            at += len(u)
        return [np.concatenate(x).astype(np.int32) for x in (ids, starts, ends)]


def lists(values):
    import pyarrow as pa
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def encoder(made: str, offsets: bool):
    """Task code: (row, text) -> (row, ids[, starts, ends])."""
    names = ["row", "ids", "starts", "ends"] if offsets else ["row", "ids"]

    def run(batches):
        import pyarrow as pa
        encode = Encoder(loaded(made), offsets)
        for batch in batches:
            _, offs = tokens.text_bytes(batch.column("text"))
            for i, j in tokens.chunks(offs, SLICE_BYTES):
                part = batch.slice(i, j - i)
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(lists, encode(texts))], names=names)
    return run


def decoded(ids, table: list[bytes]) -> tuple[bytes, list[str]]:
    """``(bytes, text of each token)``: the incomplete bytes of a character wait
    for the token that completes it (or shows that none will)."""
    import codecs
    utf8 = codecs.getincrementaldecoder("utf-8")("replace")
    texts = [utf8.decode(table[i]) for i in ids]
    if rest := utf8.decode(b"", True):
        texts[-1] += rest
    return b"".join([table[i] for i in ids]), texts


def byte_table(tok) -> list:
    """Token id -> bytes, by the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tok.get_vocab()
    table: list = [None] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        table[i] = bytes(back[c] for c in token)
    return table


def decoder(made: str, pieces_too: bool):
    """Task code: (row, ids) -> (row, ids, bytes[, text, pieces])."""
    def run(batches):
        import pyarrow as pa
        table = byte_table(loaded(made))
        for batch in batches:
            n = batch.num_rows
            size = np.asarray(batch.column("ids").fill_null([]).value_lengths()) if n else np.zeros(0, int)
            for i, j in tokens.chunks(np.concatenate(([0], np.cumsum(4 * size))), SLICE_BYTES):
                part = batch.slice(i, j - i)
                flat = np.asarray(part.column("ids").flatten())
                if len(flat) and not (0 <= flat.min() and flat.max() < len(table)):
                    raise ValueError("an id is not in the vocabulary")
                rows = [x or [] for x in part.column("ids").to_pylist()]
                columns, names = [part.column("row"), part.column("ids")], ["row", "ids", "bytes"]
                if pieces_too:
                    found = [decoded(r, table) for r in rows]
                    columns += [pa.array([b for b, _ in found], pa.binary()), pa.array(["".join(t) for _, t in found], pa.string()),
                                pa.array([t for _, t in found], pa.list_(pa.string()))]
                    names += ["text", "pieces"]
                else:
                    columns.append(pa.array([b"".join(map(table.__getitem__, r)) for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


class ByteBpe:
    """Encoder and decoder of one vocabulary file and pattern."""

    def __init__(self, spark, vocabulary_path: str, pattern: str):
        ship(__name__, "textcards.llm.tokens", "textcards.llm.token_output")
        self.made = model(read_vocabulary(spark, vocabulary_path), pattern)

    def encode(self, table: DataFrame, text_col: str = "text", keep=None, offsets: bool = True) -> DataFrame:
        """``row, ids array<int>[, starts, ends array<int>]``; ``row`` is the
        struct of the columns ``keep`` (all but the text, where not given)."""
        keep = [c for c in table.columns if c != text_col] if keep is None else list(keep)
        row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))
        rows = table.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
        more = ", starts array<int>, ends array<int>" if offsets else ""
        return rows.mapInArrow(encoder(self.made, offsets), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>{more}")

    def decode(self, encoded: DataFrame, pieces_too: bool = True) -> DataFrame:
        """``row, ids, bytes[, text, pieces]`` of ``encoded (row, ids)``."""
        rows = encoded.select("row", F.col("ids").cast("array<int>").alias("ids"))
        more = ", text string, pieces array<string>" if pieces_too else ""
        return rows.mapInArrow(decoder(self.made, pieces_too),
                               f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, bytes binary{more}")
