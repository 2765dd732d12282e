"""Duplicate word windows, found by level-wise doubling.

A window of 20 words can only repeat if each of its runs of 10 words repeats. The first level looks at runs of 10 words, and of
those at the ones that are the least, by hash, within some window of 20: equal windows have equal least runs at equal places, so
none is missed while about one run in six is looked at. Windows whose least run repeats go on to 20 words, where
every candidate is judged; longest_repeats() goes on to 40, 80, ... until no candidate survives.

A level is one pass over the texts and one exchange. Each task first compares the windows that it holds, a bounded number at a
time, and sends one row for each different window; so a window that stands in a third of all documents gives one row per
such chunk. Places that a task has settled travel with their row, spread by its key.

Places belong to rows: a row's key is its doc_id and 32 bits of a hash of its text (_row), so that different texts under one id don't get
each other's places. doc_id and place tell which window starts earlier; rows with a null id are all documents of their own, each
with a number in its _row that is written once, and these come last, in the order of _row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import drop_written, written
from tessera.llm.words import U64, Words, mix, sliding, slices, windows

WINDOW, SEED_WORDS = 20, 10
#: Windows that a task compares at once.
CHUNK = 1_500_000
LAST = (1 << 63) - 1
#: What is exchanged: tag holds 31 bits of a second hash, the place, and if the task has more of the window. Rows stand in the
#: order of documents and places, which makes them small when compressed.
ROW = "k long, tag long, id long, _row long, packed binary"
_SCHEMA = pa.schema([("k", pa.int64()), ("tag", pa.int64()), ("id", pa.int64()), ("_row", pa.int64()), ("packed", pa.binary())])
KEY = ["id", "_row"]


def least_runs(hashes: np.ndarray, last: np.ndarray, run: int, window: int) -> np.ndarray:
    """If each run of `run` words is the least of all in some window of `window` words of its document; ties count."""
    h = windows(hashes, run)
    n = len(hashes)
    if n < window:
        return np.zeros(len(h), bool)
    inside = np.arange(n - window + 1) + window <= last[: n - window + 1]
    least = np.where(inside, sliding(np.minimum, h, window - run + 1), U64(0))
    pad = np.zeros(window - run, U64)
    best = sliding(np.maximum, np.concatenate([pad, least, pad]), window - run + 1)
    starts_inside = np.arange(len(h)) + run <= last[: len(h)]
    return (best == h) & starts_inside & (best != 0)


class _Chunk:
    """Windows of some rows: hash, second hash, number of the row in the chunk, place; and the rows' keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.keys: list[np.ndarray] = []
        self.n = self.held = 0

    def add(self, h: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> None:
        self.parts.append((h, check, (doc + self.held).astype(np.int32), pos))
        self.keys.append(keys)
        self.n += len(h)
        self.held += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each different window, with its first place, and for each other text under that id that has it there; then
        each row's later places."""
        if not self.n:
            return
        h, check, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, number = np.unique(np.concatenate(self.keys), axis=0, return_inverse=True)
        self.parts, self.keys, self.n, self.held = [], [], 0, 0
        ids, own = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        apart = np.ones(len(ids), bool)  # from the row before, as a document
        apart[1:] = (ids[1:] != ids[:-1]) | (ids[1:] == LAST)
        doc = number.reshape(-1)[doc]
        place = np.cumsum(apart)[doc] << 32 | pos
        order = np.lexsort((doc, place, check, h))
        h, check, doc, pos, place = h[order], check[order], doc[order], pos[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        leads = np.flatnonzero(new)
        sizes = np.diff(np.append(leads, len(h)))
        # Rows of one document id that hold a window at equal places: those aren't later ones.
        later = place != place[np.repeat(leads, sizes)]
        new[1:] |= doc[1:] != doc[:-1]
        firsts = np.flatnonzero(new & ~later)
        many = np.repeat(sizes > 1, sizes)[firsts]
        ranked = np.argsort(order[firsts])
        firsts, many = firsts[ranked], many[ranked]
        for at in range(0, len(firsts), 50_000):
            i = firsts[at : at + 50_000]
            tag = check[i] << 33 | pos[i].astype(np.int64) << 1 | many[at : at + len(i)]
            yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(tag), pa.array(ids[doc[i]]), pa.array(own[doc[i]]), pa.nulls(len(i), pa.binary())], schema=_SCHEMA)
        if later.any():
            doc, pos = doc[later], pos[later]
            order = np.argsort(doc, kind="stable")
            doc, pos = doc[order], pos[order]
            edges = np.flatnonzero(np.diff(doc)) + 1
            docs = doc[np.append(0, edges)]
            packed = [x.astype("<i4").tobytes() for x in np.split(pos, edges)]
            m = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(mix(ids[docs].view(U64) ^ mix(own[docs].view(U64))).view(np.int64)), pa.nulls(m, pa.int64()), pa.array(ids[docs]), pa.array(own[docs]), pa.array(packed, pa.binary())], schema=_SCHEMA)


def _marks(columns: list[pa.Array], n: int, offsets: np.ndarray) -> np.ndarray:
    """If a place (a word of the slice) is among its document's lists: int arrays and packed binaries."""
    out = np.zeros(n + 1, bool)
    for lists in columns:
        for i, found in enumerate(lists.to_pylist()):
            for x in [found] if found and isinstance(found[0], int) else found or []:
                p = np.frombuffer(x, "<i4") if isinstance(x, bytes) else np.asarray(x, np.int64)
                p = p[p < offsets[i + 1] - offsets[i]]
                out[offsets[i] + p] = True
    return out[:n]


def _candidates(part: pa.RecordBatch, length: int, seed: int | None) -> tuple[Words, np.ndarray]:
    """The slice's words, and which of them start a window to look at on this level."""
    w = Words(part.column("text"))
    n, last = len(w), w.last
    inside = np.arange(n) + length <= last
    if "firsts" not in part.schema.names:  # first level: sampled runs
        looked = np.zeros(n, bool)
        found = least_runs(w.hashes, last, length, seed)
        looked[: len(found)] = found
        return w, looked
    alive = _marks([part.column("firsts"), part.column("laters"), part.column("packed")], n, w.offsets)
    if seed is not None:  # second level: windows whose least run repeats; runs that are least in other windows don't count
        h = windows(w.hashes, seed)
        width = length - seed + 1
        known = np.where(alive[: len(h)], h, U64(0xFFFFFFFFFFFFFFFF))
        found = np.zeros(n, bool)
        if n >= length:
            found[: n - length + 1] = sliding(np.minimum, known, width) == sliding(np.minimum, h, width)
        return w, inside & found
    half = length // 2  # later levels: both halves repeat
    return w, inside & alive & np.concatenate([alive[half:], np.zeros(min(half, n), bool)])[:n]


def _level(docs: DataFrame, length: int, seed: int | None) -> DataFrame:
    """One level: docs (id, _row, text, and from the second level on firsts, laters, packed) to the places of repeated windows,
    as rows (id, _row, pos or packed, later): later if an equal window starts earlier."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            for part in slices(batch, "text"):
                w, looked = _candidates(part, length, seed)
                at = np.flatnonzero(looked)
                if not len(at):
                    continue
                h = windows(w.hashes, length)[at]
                check = (windows(w.hashes, length, 0x8CB92BA72F3D8DD7)[at] >> U64(33)).astype(np.int64)
                doc = w.document[at]
                keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in KEY], 1)
                chunk.add(h, check, doc, (at - w.offsets[doc]).astype(np.int32), keys)
                if chunk.n >= CHUNK:
                    yield from chunk.rows()
        yield from chunk.rows()

    rows = docs.mapInArrow(look, ROW).repartition("k")
    rows = rows.withColumn("check", F.shiftrightunsigned("tag", 33)).withColumn("pos", F.shiftrightunsigned("tag", 1).bitwiseAND(0xFFFFFFFF).cast("int")).withColumn("many", F.col("tag").bitwiseAND(1) == 1)
    same = Window.partitionBy("k", "check")
    place = F.struct("id", F.when(F.col("id") == LAST, F.col("_row")).alias("null_id"), "pos")
    rows = rows.withColumn("n", F.count("*").over(same)).withColumn("first", F.min(place).over(same))
    later = F.col("packed").isNotNull() | (place > F.col("first"))
    return rows.where("packed is not null or n > 1 or many").select(*KEY, "pos", "packed", later.alias("later"))


def _by_document(rows: DataFrame, firsts: bool = True) -> DataFrame:
    made = [F.collect_list(F.when(~F.col("later"), F.col("pos"))).alias("firsts")] if firsts else []
    return rows.groupBy(*KEY).agg(*made, F.collect_list(F.when(F.col("later") & F.col("packed").isNull(), F.col("pos"))).alias("laters"), F.collect_list("packed").alias("packed"))


def _with_keys(docs: DataFrame, others: tuple = ()) -> DataFrame:
    """docs as id, _row, text and others; 32 bits tell a few texts under one id apart, and are exchanged as half of 64. Rows with a null id are written with their _row, as that must not change from one reading to
    the next."""
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    known = docs.where(own.isNotNull()).select(own.alias("id"), F.xxhash64(text).bitwiseAND(0xFFFFFFFF).alias("_row"), text.alias("text"), *others)
    none = docs.where(own.isNull()).select(F.lit(LAST).alias("id"), F.xxhash64(text).bitwiseXOR(F.monotonically_increasing_id()).alias("_row"), text.alias("text"), *others)
    none = written(docs.sparkSession, none, "null-ids")
    if not none.isEmpty():
        return known.unionByName(none)
    drop_written(docs.sparkSession, none)
    return known


def _repeated(texts: DataFrame, window: int, seed: int) -> DataFrame:
    return _level(texts.join(_by_document(_level(texts, seed, window)), KEY), window, seed)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Places of windows of `window` words that docs (doc_id, text) hold more than once: id, _row, pos or packed (4-byte places), and
    later: an equal window starts earlier (smaller doc_id, or same document and earlier start). Null ids count as the largest."""
    return _repeated(_with_keys(docs), window, seed)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, with_text: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text and any others): doc_id, n_words, n_removed, kept_sha256; with_text also kept, and the other
    columns but for those of these names. kept are the words but for those in a window that also starts earlier, joined by
    one space.

    Windows are judged on the input. A null text has no words; a text under `window` words keeps all. Rows of one doc_id are one
    document, each with its own words: of equal places in them neither is earlier than the other. Rows with a null id are each a
    document of their own, and count as the largest; of exact copies one keeps its words. An empty table gives no row.
    """
    made = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    others = [c for c in docs.columns if c not in (*made, *KEY, "laters", "packed")] if with_text else []
    full = _with_keys(docs, tuple(c for c in others if c != "text"))
    found = _by_document(_repeated(full.select(*KEY, "text"), window, seed).where("later"), firsts=False)
    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                reach = np.concatenate([[0], np.cumsum(_marks([part.column("laters"), part.column("packed")], len(w), w.offsets))])
                first = np.maximum(np.arange(len(w)) - window + 1, np.repeat(w.offsets[:-1], w.counts))
                covered = reach[1:] > reach[first]  # some marked window of the document starts at most window - 1 words before
                rows = []
                for i, (key, text) in enumerate(zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    gone = covered[w.offsets[i] : w.offsets[i + 1]]
                    own = (text or "").encode().split()
                    kept = b" ".join(compress(own, ~gone) if gone.any() else own)
                    rows.append((key, len(own), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in others)], names=[*names, *others])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * with_text, *(full.schema[c] for c in others)])
    out = full.join(found, KEY, "left").mapInArrow(cut, schema)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), *names[1:], *others)


def longest_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id and longest: the largest of window, 2 x window, 4 x window, ... words at which a window of the document occurs
    more than once in docs; a row for each document with a null id. Levels go on until no candidate survives; each is written, and read by the next."""
    spark, texts = docs.sparkSession, _with_keys(docs)
    length, out = window, None
    at = written(spark, _by_document(_repeated(texts, window, seed)), "repeats")
    while not at.isEmpty():
        here = at.select(*KEY, F.lit(length).cast("long").alias("longest"))
        out = here if out is None else out.unionByName(here)
        length *= 2
        at = written(spark, _by_document(_level(texts.join(at, KEY), length, None)), "repeats")
    if out is None:  # nothing repeats
        out = at.select(*KEY, F.lit(length).cast("long").alias("longest"))
    else:
        drop_written(spark, at)
    null_id = F.when(F.col("id") == LAST, F.col("_row")).alias("null_id")
    return out.groupBy(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), null_id).agg(F.max("longest").alias("longest")).drop("null_id")
