"""Operator 8: token ids as binary shards in a keyed training order.

1. One pass tokenises the texts, ends each document with the end id, packs
   them without gaps into sequences of ``length`` ids and numbers these.  The
   numbers of an input partition begin where an upper bound for the earlier
   partitions ends (a text has no more ids than bytes), which one cheap
   aggregate over text lengths gives beforehand.
2. A keyed Feistel network over the next power of four, with cycle-walking
   back into the range of numbers, is a permutation of them.  The permuted
   number decides a sequence's shard (an equal range of them) and its place.
   Unused numbers leave no gaps: a sequence's global slot is its rank.
3. Each task gets whole shards, sorts them and writes one file each of records
   of a fixed stride (``length`` little-endian ids), to a temporary name that
   is renamed when complete.  Records, order and names do not depend on the
   attempt, so a task that runs again writes the same file.
   ``read_slots`` reads any range of slots by seeking, which is how training
   resumes.

The texts must come from files (a table read, as in the pipeline): both passes
rely on the same input partitions, and a partition that exceeds its numbers
stops the job rather than using another's.

Cases: a null or empty text gives no ids (no end id either).  The last sequence
of an input partition is filled with end ids; ``n_tokens`` tells how many of
its ids count.  Very long texts are tokenised in pieces cut where the tokeniser
cuts anyway.  Repeated rows are all written.  An empty table gives no shard.
A null doc_id is kept in the list of documents.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textcards.llm import ship, storage, tokens

LENGTH = 2048                 # ids of a sequence
SHARD_BYTES = 32 << 20        # about; a shard is what one task sorts and writes
MAX_VOCABULARY_BYTES = 64 << 20
PIECE = 1 << 20               # characters tokenised at once
RETURNED = 512                # rows of a returned batch
FEISTEL_ROUNDS = 8

SEQUENCE = "number long, n_tokens int, docs array<struct<doc_id:long,first:int,n:int>>, ids binary"
RECORD = "shard long, place int, n_tokens int, docs array<struct<doc_id:long,first:int,n:int>>, sha256 string, path string"


class Feistel:
    """A keyed permutation of 0..size-1."""

    def __init__(self, size: int, key: int):
        self.size = max(1, int(size))
        self.half = max(1, (int(self.size - 1).bit_length() + 1) // 2)
        rng = np.random.Generator(np.random.PCG64(key))
        self.keys = rng.integers(0, 1 << 63, FEISTEL_ROUNDS, dtype=np.uint64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in self.keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << half) | right

    def __call__(self, x) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64))
        while True:                     # cycle-walking
            off = out >= np.uint64(self.size)
            if not off.any():
                return out.astype(np.int64)
            out[off] = self._once(out[off])


_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str):
    """A text in parts of about ``PIECE`` characters, cut before a lone space."""
    i = 0
    while len(text) - i > 2 * PIECE:
        m = _CUT.search(text, i + PIECE)
        if m is None:
            break
        yield text[i:m.start()]
        i = m.start()
    yield text[i:]


_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes, pattern: str):
    import base64
    import tiktoken
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def sequences(vocabulary: bytes, pattern: str, end: int, length: int, first: np.ndarray, kind: str):
    """Task code: (doc_id, text) -> packed, numbered sequences of this partition."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary, pattern).encode_ordinary
        number = int(first[part]) if part < len(first) - 1 else -1
        held, held_n, docs, rows = [], 0, [], []

        def flush(fill=False):
            nonlocal held, held_n, docs, number
            if fill and held_n:
                held.append(np.full(length - held_n, end, kind))
            ids = np.concatenate(held)
            rows.append((number, min(held_n, length), docs, ids[:length].tobytes()))
            if number < 0 or number >= first[part + 1]:
                raise RuntimeError("input partitions changed between the passes; read the texts from files")
            number += 1
            held, docs = [], []
            return ids[length:]

        def pack():
            at = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            flat = [d for r in rows for d in r[2]]
            what = pa.StructArray.from_arrays([pa.array([d[0] for d in flat], pa.int64()),
                                               pa.array([d[1] for d in flat], pa.int32()),
                                               pa.array([d[2] for d in flat], pa.int32())], names=["doc_id", "first", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(at), what), pa.array([r[3] for r in rows], pa.binary())],
                names=["number", "n_tokens", "docs", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                done = 0
                parts = [np.array(encode(x), kind) for x in pieces(text)]
                ids = np.concatenate([*parts, np.array([end], kind)])
                while done < len(ids):
                    take = min(length - held_n, len(ids) - done)
                    held.append(ids[done:done + take])
                    docs.append((doc_id, held_n, take))
                    held_n += take
                    done += take
                    if held_n == length:
                        flush()
                        held_n = 0
                    if len(rows) >= RETURNED:
                        yield pack()
                        rows = []
        if held_n:
            flush(fill=True)
        if rows:
            yield pack()
    return run


def write_shards(base: str):
    """Task code: rows sorted by (shard, order) -> files and a row per record."""
    def run(batches):
        import hashlib
        import os
        import uuid
        import pyarrow as pa
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(base)
        files.create_dir(root, recursive=True)
        out = shard = None
        place, path, tmp = 0, "", ""

        def close():
            out.close()
            final = f"{root}/{path}"
            if files.get_file_info(final).type == fs.FileType.NotFound:
                files.move(tmp, final)
            else:                      # another attempt has written the same bytes
                files.delete_file(tmp)

        for batch in batches:
            rows = []
            for s, ids in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if s != shard:
                    if out is not None:
                        close()
                    shard, place, path = s, 0, f"shard-{s:08d}.bin"
                    tmp = f"{root}/.{path}.{os.getpid()}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(tmp)
                raw = ids.as_py()
                out.write(raw)
                rows.append((s, place, hashlib.sha256(raw).hexdigest(), path))
                place += 1
            col = lambda i, t: pa.array([r[i] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [col(0, pa.int64()), col(1, pa.int32()), batch.column("n_tokens"), batch.column("docs"),
                 col(2, pa.string()), col(3, pa.string())],
                names=["shard", "place", "n_tokens", "docs", "sha256", "path"])
        if out is not None:
            close()
    return run


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    content, n = spark.read.format("binaryFile").load(path).select("content", "length").first()
    if n > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {n} bytes; the bound is {MAX_VOCABULARY_BYTES}")
    return bytes(content)


def materialise(docs: DataFrame, out_dir: str, vocabulary_path: str, pattern: str, length: int = LENGTH,
                key: int = 20_240_607, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards below ``out_dir`` and return their records:
    ``slot, shard, path, byte_offset, n_tokens, docs, sha256``."""
    ship("textcards.llm.tokens", __name__)
    spark = docs.sparkSession
    vocabulary = read_vocabulary(spark, vocabulary_path)
    end = 1 + max(int(x.split()[1]) for x in vocabulary.splitlines() if x.strip())
    kind = "<u2" if end < 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    # a row per input partition: an upper bound of its ids
    bound = F.sum(F.when(F.length("text") > 0, F.octet_length("text") + 1).otherwise(0))
    parts = {p: int(b or 0) for p, b in texts.groupBy(F.spark_partition_id()).agg(bound).collect()}
    count = [-(-parts.get(p, 0) // length) for p in range(max(parts, default=-1) + 1)]
    first = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    size = int(first[-1])
    stride = length * np.dtype(kind).itemsize
    shards = max(1, -(-size * stride // (2 * shard_bytes)))      # about two bytes an id

    order = Feistel(size, key)
    numbered, place = sequences(vocabulary, pattern, end, length, first, kind), permuted(order)
    placed = texts.mapInArrow(tokens.trimmed(lambda batches: place(numbered(batches))),       # one worker a task
                              "permuted long, " + SEQUENCE[len("number long, "):])
    dealt = (placed.withColumn("shard", F.expr(f"permuted * {shards} div {max(1, size)}") if size * shards < 1 << 62
                               else F.floor(F.col("permuted") / F.lit(size / shards)))
             .repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "permuted"))
    records = storage.cut(dealt.select("shard", "n_tokens", "docs", "ids").mapInArrow(tokens.trimmed(write_shards(out_dir)), RECORD),
                          "records")
    before = (records.groupBy("shard").agg(F.count("*").alias("n"))
              .select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")))   # a row per shard
    return records.join(F.broadcast(before) if shards <= 100_000 else before, "shard").select(
        (F.col("before") + F.col("place")).alias("slot"), "shard", "path",
        (F.col("place").cast("long") * stride).alias("byte_offset"), "n_tokens", "docs", "sha256")


def permuted(order: Feistel):
    """Task code: replaces the number of a sequence by its permuted number."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(order(np.array(batch.column("number")))), *batch.columns[1:]],
                                             names=["permuted", *batch.schema.names[1:]])
    return run


def read_slots(out_dir: str, records: DataFrame, start: int, n: int, length: int = LENGTH, kind: str = "<u2"):
    """The ids of the slots ``start .. start + n - 1``, read by seeking."""
    from pyarrow import fs
    files, root = fs.FileSystem.from_uri(out_dir)
    stride = length * np.dtype(kind).itemsize
    rows = records.where(F.col("slot").between(start, start + n - 1)).groupBy("path").agg(
        F.min("slot").alias("slot"), F.min("byte_offset").alias("at"), F.count("*").alias("n")).orderBy("slot").collect()
    for r in rows:
        with files.open_input_file(f"{root}/{r['path']}") as f:
            f.seek(r["at"])
            raw = np.frombuffer(f.read(r["n"] * stride), kind)
        yield from raw.reshape(-1, length)
