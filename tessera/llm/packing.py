"""Packing documents into sequences of a fixed length, online and in bounded space."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.tokens import MEMO, encoded, ids_crc32

LENGTH, OPEN, MERGED = 2048, 64, 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, fill long, closed boolean, sequence_id long, offset long"


class Windows:
    """At most `most` open windows of `length` ids. A piece goes into the window that it leaves least room in; if none has
    room, the fullest window is emitted and another opened. Open windows are kept in the order of their room."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count = length, most, 0
        self.open: list[tuple[int, int]] = []  # room, number
        self.held: dict[int, list] = {}

    def add(self, piece: object, n: int) -> list | None:
        """The pieces of a window that this one closed."""
        done = None
        i = bisect_left(self.open, (n, -1))
        if i < len(self.open):
            room, k = self.open.pop(i)
        else:
            if len(self.open) == self.most:
                done = self.held.pop(self.open.pop(0)[1])
            room, k, self.count = self.length, self.count, self.count + 1
            self.held[k] = []
        self.held[k].append((piece, self.length - room))
        if room > n:
            insort(self.open, (room - n, k))
        elif done is None:
            done = self.held.pop(k)
        else:  # a full piece closed both; the caller never adds one while windows must be emitted
            raise ValueError("a piece as long as a window is emitted by itself")
        return done

    def rest(self) -> Iterator[list]:
        for _, k in self.open:
            yield self.held.pop(k)
        self.open = []


def _packed(pieces: Iterable[tuple[tuple, int]], length: int, most: int) -> Iterator[tuple[list, bool]]:
    """Windows with their pieces, and if they were closed."""
    w = Windows(length, most)
    for piece, n in pieces:
        if n == length:
            yield [(piece, 0)], True
        elif (done := w.add(piece, n)) is not None:
            yield done, True
    for x in w.rest():
        yield x, False


KINDS = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def _batches(windows: Iterable[tuple[list, bool]], first: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for k, (pieces, closed) in enumerate(windows):
        fill = sum(p[2] for p, _ in pieces)
        rows += [(*p, fill, closed, first + k, at) for p, at in pieces]
        if len(rows) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def _sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The pieces of one group of tasks after another, the longest first."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["group"] != key:
                yield sorted(held, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
                held = []
            key = r["group"]
            held.append(tuple(r[n] for n in NAMES[:6]))
    if held:
        yield sorted(held, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, most_open: int = OPEN, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Sequences of at most `length` token ids from docs (doc_id, text; any order).

    Each task cuts documents of `length` ids and more into whole sequences and a tail, and packs tails and shorter documents
    best-fit into `most_open` windows, emitting the fullest when none has room: memory is bounded by the windows alone. The
    windows that are left open, `most_open` a task at most, are taken apart and packed again, MERGED tasks' at a time, until
    one task's are left; there the longest pieces go first. So a task holds at most MERGED x most_open x length pieces. A null text is empty and has the end id alone. Repeated rows are
    packed each by itself; other columns are ignored; an empty table gives no row.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids (little-endian, 2 bytes
    each where the vocabulary allows). memo: pieces of text whose ids a worker keeps, in each of two generations.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for keys, many in encoded(batches, tokenizer, end, memo):
            for key, ids in zip(keys, many, strict=True):
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    yield (key, at, len(part), ids_crc32(part), len(ids), part.tobytes() if with_ids else None), len(part)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _batches(_packed(cut(batches), length, most_open), TaskContext.get().partitionId() << 33)

    def again(level: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            windows = (w for held in _sorted_groups(batches) for w in _packed(((r, r[2]) for r in held), length, most_open))
            yield from _batches(windows, (level << 56) + (TaskContext.get().partitionId() << 33))

        return merge

    done = written(spark, rows.mapInArrow(pack, PIECE), "packed")
    parts, left, level = [done.where("closed")], done.where("not closed"), 1
    tasks = left.select(F.shiftright("sequence_id", 33)).distinct().count()
    while tasks > 1:
        groups = max(1, -(-tasks // MERGED))
        dealt = left.withColumn("group", F.pmod(F.shiftright("sequence_id", 33), F.lit(groups))).repartition(groups, "group").sortWithinPartitions("group")
        merged = written(spark, dealt.mapInArrow(again(level), PIECE), f"merged{level}")
        if groups == 1:
            parts.append(merged)
            break
        parts.append(merged.where("closed"))
        left, tasks, level = merged.where("not closed"), groups, level + 1
    else:
        parts.append(left)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def fill_of(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, and the padding's share of all sequences."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (1 - F.sum("n") / (F.count("*") * length)).alias("padding"))

