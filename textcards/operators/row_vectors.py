"""Vectors with a number per (row, label), as files by ranges of rows.

A vector of ``n`` rows and ``labels`` columns is a folder in the folder that driver
and executors share, with a file per range of rows, so a task that combines vectors
holds a few ranges, whatever ``n`` is.  Files are written under another name and
renamed, so tasks may run again.  ``whole`` puts a vector into one array, mapped
from a local temporary file where it is long.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle

RANGE_VALUES = 500_000      # numbers of one range (4 MB)
IN_MEMORY = 8_000_000       # numbers of a whole vector that is not mapped from a file

# Task code is pickled by value: executors need only numpy and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RowVectors:
    def __init__(self, spark, n: int, labels: int):
        from textcards.session import shared_folder
        self.uri = f"{shared_folder(spark)}/textcards-vectors-{uuid.uuid4().hex}"
        self.n, self.labels = n, labels
        self.size = max(1, RANGE_VALUES // max(1, labels))
        self.ranges = max(1, -(-n // self.size))
        files, root = self._open()
        files.create_dir(root, recursive=True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        files, root = self._open()
        files.delete_dir(root)

    def _open(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.uri)

    def bounds(self, c: int) -> tuple[int, int]:
        return c * self.size, min(self.n, (c + 1) * self.size)

    def _put(self, name: str, pieces) -> None:
        from pyarrow import fs
        files, root = self._open()
        path, tmp = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(tmp) as f:
            for x in pieces:
                f.write(x.tobytes())
        if files.get_file_info(path).type == fs.FileType.NotFound:
            files.move(tmp, path)
        else:                      # another attempt has written the same
            files.delete_file(tmp)

    def write(self, name: str, c: int, x: np.ndarray) -> None:
        self._put(f"{name}/{c:06d}", [np.asarray(x, float)])

    def read(self, name: str, c: int) -> np.ndarray:
        files, root = self._open()
        with files.open_input_file(f"{root}/{name}/{c:06d}") as f:
            return np.frombuffer(f.read()).reshape(self.labels, -1)

    def empty(self) -> np.ndarray:
        """Zeros for a whole vector, labels x rows."""
        import tempfile
        if self.n * self.labels <= IN_MEMORY:
            return np.zeros((self.labels, self.n))
        return np.memmap(tempfile.TemporaryFile(), float, "w+", shape=(self.labels, self.n))

    def whole(self, name: str) -> np.ndarray:
        out = self.empty()
        for c in range(self.ranges):
            a, b = self.bounds(c)
            out[:, a:b] = self.read(name, c)
        return out

    def write_whole(self, name: str, x: np.ndarray) -> None:
        """One file, the ranges one after another (``read_part``)."""
        self._put(name, (x[:, a:b] for a, b in map(self.bounds, range(self.ranges))))

    def read_part(self, name: str, c: int) -> np.ndarray:
        files, root = self._open()
        a, b = self.bounds(c)
        with files.open_input_file(f"{root}/{name}") as f:
            f.seek(a * self.labels * 8)
            return np.frombuffer(f.read((b - a) * self.labels * 8)).reshape(self.labels, -1)

    def drop(self, *names: str) -> None:
        from pyarrow import fs
        files, root = self._open()
        for name in names:
            kind = files.get_file_info(f"{root}/{name}").type
            if kind == fs.FileType.Directory:
                files.delete_dir(f"{root}/{name}")
            elif kind == fs.FileType.File:
                files.delete_file(f"{root}/{name}")

    def each(self, spark, step) -> list:
        """``step(range)`` (an array) of every range, in their order: in tasks, or
        here where there is one range only."""
        if self.ranges == 1:
            return [step(0)]

        def task(batches):
            import pyarrow as pa
            for batch in batches:
                for c in batch.column("id").to_pylist():
                    x = np.asarray(step(c), float)
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([x.tobytes()], pa.binary()), pa.array([str(x.shape)])],
                                                     names=["id", "x", "shape"])

        rows = spark.range(0, self.ranges, 1, min(self.ranges, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(
            task, "id long, x binary, shape string").collect()      # a few numbers a range
        shape = lambda s: tuple(int(p) for p in s.strip("()").split(",") if p.strip())      # noqa: E731
        return [np.frombuffer(r["x"]).reshape(shape(r["shape"])) for r in sorted(rows, key=lambda r: r["id"])]
