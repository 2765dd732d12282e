"""Archives in place: an index is read without the bytes that it points to, and entries by their ranges alone.

A RangedFile stands in for a file's bytes: decoders slice it, and only the slices that they ask for are read, by blocks. So the index of
an image of many gigabytes costs some blocks, and an entry its own size.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import ship
from tessera.sources.binary import as_error
from tessera.sources.reading import ROWS, schema_of, store_uri
from tessera.sources.registry import FORMATS

BLOCK, HELD = 1 << 16, 64


class RangedFile:
    """Length, slices and find() of a file in any store, by blocks of which the last HELD are kept."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(store_uri(path))
        self.file = fs.open_input_file(at)
        self.size, self.read_bytes = self.file.size(), 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.file.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
            self.read_bytes += len(self.blocks[k])
            if len(self.blocks) > HELD:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            key = key + self.size if key < 0 else key
            return self._block(key // BLOCK)[key % BLOCK]
        a, b, step = key.indices(self.size)
        if step != 1:
            raise ValueError("only whole runs of bytes")
        if b - a > HELD * BLOCK:
            self.read_bytes += b - a
            return self.file.read_at(b - a, a)
        parts = [self._block(k) for k in range(a // BLOCK, -(-b // BLOCK))] if b > a else []
        return b"".join(parts)[a % BLOCK : a % BLOCK + b - a] if parts else b""

    def find(self, sub: bytes, start: int = 0, end: int | None = None) -> int:
        end, at = self.size if end is None else min(end, self.size), start
        while at < end:
            stop = min(end, (at // BLOCK + 1) * BLOCK + len(sub) - 1)
            if (k := self[at:stop].find(sub)) >= 0:
                return at + k
            at = (at // BLOCK + 1) * BLOCK
        return -1

    def close(self) -> None:
        self.file.close()


def index_only(paths: DataFrame, name: str) -> DataFrame:
    """Entries of the archives whose paths are in `paths` (path), without their bytes. A file that can't be read gives a row with `_error`."""
    ship(paths.sparkSession)
    schema = schema_of(name)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    file = RangedFile(path)
                    for row in FORMATS[name].decode(file):
                        rows.append({"path": path, **row})
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                    file.close()
                except Exception as e:  # noqa: BLE001  a damaged file is a row
                    rows.append({"path": path, "_error": as_error(e).row()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return paths.select(F.col("path").cast("string").alias("path")).mapInArrow(run, schema)


def read_entries(entries: DataFrame, most: int = 8 << 20) -> DataFrame:
    """entries (path, idx, name, offset, size) with their bytes as rows path, idx, name, part, payload: an entry longer than `most` comes in
    parts, so no row holds a whole long file. Entries of one archive can be read by many tasks."""
    ship(entries.sparkSession)
    schema = "path string, idx int, name string, part int, payload binary"
    arrow = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("part", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = r["path"], RangedFile(r["path"])
                for part, at in enumerate(range(0, max(1, r["size"]), most)):
                    own = file[r["offset"] + at : r["offset"] + min(at + most, r["size"])]
                    yield pa.RecordBatch.from_pylist([{"path": path, "idx": r["idx"], "name": r["name"], "part": part, "payload": own}], arrow)
        if file is not None:
            file.close()

    return entries.select("path", "idx", "name", "offset", "size").mapInArrow(run, schema)
