"""Token ids by a public tokenizer, and length-delimited record files of them.

Files. A shard holds records, one after another: the payload's length (8 bytes), a masked checksum of those 8 bytes, the
payload, a masked checksum of the payload (4 bytes each, little-endian). A payload is one document: 1 if it has an id,
the bytes of an id (2 or 4), the id (8 bytes), the token ids. The index beside each shard holds every record's offset and
at last the shard's size (8 bytes each), so records can be read in any order. The checksum is CRC-32 of zlib, rotated right
by 15 bits, plus a constant: the mask keeps a checksum of data that hold checksums sound.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import fresh_path, written
from tessera.llm.words import SLICE_BYTES, slices
from tessera.sources.reading import store_uri

MASK = 0xA282EAD8
#: Entries of a worker's memo, and bytes of a shard's records.
MEMO, SHARD_BYTES = 500_000, 64 << 20
DOCS = 512
#: Pieces of text among which equal ones are looked for at once.
BLOCK = 1 << 20


#: A piece of Latin-1's letters alone, which neither vocabulary cuts, and perhaps one mark after them, which both part from them.
_WORD = re.compile(r"( ?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]?)")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else the next from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in seen else next(rest) for b in range(256)}


_LETTER_OF = _byte_letters()
_SPACE = chr(_LETTER_OF[0x20])


class Pieces(dict):
    """Ids, as bytes, of pieces of text; a piece that isn't held is encoded by the library when it is asked for, a piece of letters by
    the library's model alone, as there is nothing to normalise or to cut.

    Of `most` pieces and more, the last full generation is kept to take from and a new one begun, so memory is bounded.
    """

    def __init__(self, tokenizer: object, code: str, most: int, lower: bool):
        super().__init__()
        self.tokenizer, self.code, self.most, self.lower, self.before = tokenizer, code, most, lower, {}
        self.tokens = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            if not self.lower and piece.isascii() and piece.removeprefix(" ").isalpha():
                ids = array(self.code, [x.id for x in self.tokens(piece.replace(" ", _SPACE))]).tobytes()
            elif (word := _WORD.fullmatch(piece)) is None:
                ids = array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            elif word[3]:
                ids = self[piece[:-1]] + self[word[3]]
            else:
                letters = word[2].lower() if self.lower else word[2]
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_LETTER_OF)
                ids = array(self.code, [x.id for x in self.tokens(_SPACE + letters if word[1] else letters)]).tobytes()
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Memo:
    """Ids of the pieces between which the tokenizer never merges, each encoded by the library once as long as it is held.

    Both vocabularies split a text before they merge, so a text's ids are those of its pieces in order. Of the vocabulary with word ends
    `words_of` cuts a text into such pieces; of the byte-level one `cuts` cuts many texts at once, but those that `_spaced` leaves to the
    library whole.
    """

    def __init__(self, path: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.drops = "</w>" in str(getattr(self.tokenizer.model, "end_of_word_suffix", "") or "")
        self.at_once = (SLICE_BYTES, DOCS) if self.drops else (4 * SLICE_BYTES, 4 * DOCS)
        self.pieces = Pieces(self.tokenizer, self.code, most, lower=self.drops)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if self.drops:
            get = self.pieces.__getitem__
            return [b"".join(map(get, words_of(t))) for t in texts]
        cut = [_spaced(t) for t in texts]
        ids = self._encode([t.encode() for t, x in zip(texts, cut, strict=True) if x])
        return [next(ids) if x else self.whole(t) for t, x in zip(texts, cut, strict=True)]

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of texts that `cuts` may cut: equal pieces of a block meet in Arrow, so Python sees each of them once."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        starts = cuts(data, at)
        offsets = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found, counts = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for i in range(0, len(pieces), BLOCK):
            block = pieces.slice(i, BLOCK).dictionary_encode()
            ids = list(map(self.pieces.__getitem__, block.dictionary.to_numpy(zero_copy_only=False).tolist()))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
            which = block.indices.to_numpy()
            n = sizes[which]
            shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
            found.append(np.frombuffer(b"".join(ids), self.kind)[np.repeat(shift, n) + np.arange(n.sum())])
            counts.append(n)
        ids, ends = np.concatenate(found), np.cumsum(np.concatenate(counts))[np.searchsorted(starts, at)].tolist()
        return (ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False))


#: One of a path, a size and a process, so that a worker's later tasks find what its earlier ones encoded.
_memos: dict[tuple[str, int], Memo] = {}


def memo(path: str, most: int = MEMO) -> Memo:
    if (path, most) not in _memos:
        _memos.clear()  # one vocabulary's pieces at a time
        _memos[path, most] = Memo(path, most)
    return _memos[path, most]


#: Of white space beside " " and "\n": what ASCII has, and how the rest begins in UTF-8.
_CONTROLS, _WIDE = ("\t", "\r", "\x0b", "\x0c", "\0"), (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_RUNS, _ODD = ("  ", "\n\n", " \n", "\n "), re.compile(r"\s{3}|\s\s\Z|[^\S \n]|\0")


def _plain(text: str) -> bool:
    """If a text's only white space is single spaces and line ends; if in doubt, not."""
    if any(x in text for x in _CONTROLS) or any(x in text for x in _RUNS):
        return False
    return text.isascii() or not any(x in (data := text.encode()) for x in _WIDE)


def _spaced(text: str) -> bool:
    """If all white space of a text is single spaces before a word and line ends; longer runs of white space, a run that ends the text, and
    rare white space are left to the library."""
    return _plain(text) or not _ODD.search(text)


#: What a byte is to the byte-level vocabulary's expression, which parts letters, digits and marks: _ANY is any of them.
_ANY, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _LINE = range(7)
_CLASS = np.full(256, _ANY, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x27, 0x20, 0x0A]] = _QUOTE, _BLANK, _LINE
#: If a piece ends between a byte of one class and one of the next. A quote may begin one of 's, 't and so on, so it isn't parted from letters.
_ENDS = np.zeros((7, 7), bool)
_ENDS[_LETTER, [_DIGIT, _MARK, _QUOTE]] = _ENDS[_DIGIT, [_LETTER, _MARK, _QUOTE]] = _ENDS[_MARK, [_LETTER, _DIGIT]] = True
_ENDS[:, [_BLANK, _LINE]] = _ENDS[_LINE] = True
_ENDS = _ENDS.reshape(-1)


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces of texts in UTF-8 begin, for the byte-level vocabulary; `at`: where the texts begin, and the end. Texts are as
    `_spaced` wants them: a space stays with what follows it, and a line end is by itself. Of letters beyond ASCII those of Latin-1
    are known."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(len(data), bool)
    begins[1:] = _ENDS[kind[:-1] * np.uint8(7) + kind[1:]]
    begins[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


#: White space to str.split(), but not to the tokenizer.
_SEPARATORS, _WORDS = ("\x1c", "\x1d", "\x1e", "\x1f"), re.compile(r"[^ \t\n\r\x0b\x0c]+")


def words_of(text: str) -> list[str]:
    """For the vocabulary with word ends, which drops white space."""
    return _WORDS.findall(text) if any(x in text for x in _SEPARATORS) else text.split()


def encoded(batches: Iterable[pa.RecordBatch], path: str, end: int, most: int = MEMO) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows' doc_id and ids with the end id, some hundred rows at a time; a null text is empty."""
    held = memo(path, most)
    size, docs = held.at_once
    for batch in batches:
        for part in slices(batch, "text", size):
            for at in range(0, part.num_rows, docs):
                rows = part.slice(at, docs)
                ids = held.encode([x or "" for x in rows.column("text").to_pylist()])
                yield rows.column("doc_id").to_pylist(), [np.append(np.frombuffer(x, held.kind), held.kind.type(end)) for x in ids]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def masked(data: bytes) -> int:
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: memoryview) -> bytes:
    """The payload of one record; an error if a checksum is wrong."""
    head = bytes(data[:8])
    (n,) = struct.unpack("<Q", head)
    if len(data) != n + 16 or struct.unpack("<I", data[8:12])[0] != masked(head):
        raise ValueError("a record's length is damaged")
    payload = bytes(data[12 : 12 + n])
    if struct.unpack("<I", data[12 + n :])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows, by the path's scheme, be it Hadoop's name for it."""
    return pafs.FileSystem.from_uri(store_uri(uri))


class ShardWriter:
    """Writes records to files of about SHARD_BYTES; each file has a name of its own, so a task that runs twice does no harm:
    the manifest names those of one run."""

    def __init__(self, folder: str, part: int):
        self.fs, self.at = filesystem(folder)
        self.folder, self.part, self.count = folder, part, 0
        self.fs.create_dir(self.at, recursive=True)
        self.out, self.row = None, None

    def add(self, doc_id: int | None, ids: np.ndarray) -> dict | None:
        """The finished shard's row of the manifest, if this record opened another."""
        done = self.close() if self.out is not None and self.size >= SHARD_BYTES else None
        if self.out is None:
            name = f"shard-{self.part:06d}-{self.count:04d}-{uuid.uuid4().hex}"
            self.out, self.size, self.offsets, self.count = self.fs.open_output_stream(f"{self.at}/{name}.rec"), 0, [], self.count + 1
            self.row = {"part": self.part, "shard": self.count, "path": f"{self.folder}/{name}", "n_docs": 0, "n_tokens": 0}
        record = framed(struct.pack("<BBq", doc_id is not None, ids.dtype.itemsize, doc_id or 0) + ids.tobytes())
        self.offsets.append(self.size)
        self.out.write(record)
        self.size += len(record)
        self.row["n_docs"] += 1
        self.row["n_tokens"] += len(ids)
        return done

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        with self.fs.open_output_stream(f"{self.at}/{self.row['path'].rsplit('/', 1)[1]}.idx") as f:
            f.write(np.array([*self.offsets, self.size], "<u8").tobytes())
        self.out = None
        return self.row | {"n_bytes": self.size}


MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long, n_bytes long"


def write_records(docs: DataFrame, tokenizer: str, end: int, folder: str) -> DataFrame:
    """Encode docs (doc_id, text) and write them in ascending doc_id order as record files into `folder`.

    Returns the manifest, written as a table: one row per shard, whose order is that of (part, shard). Null doc_id come
    first; rows with equal doc_id are put in the order of a hash of their texts. A null or empty text is the end id alone; other
    columns are ignored; texts of any length are one record. An empty table gives an empty manifest. Files of a task that was
    run again are named by no manifest.
    """
    spark = docs.sparkSession
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, found = ShardWriter(folder, TaskContext.get().partitionId()), []
        for keys, many in encoded(batches, tokenizer, end):
            found += [x for k, ids in zip(keys, many, strict=True) if (x := out.add(k, ids))]
        if x := out.close():
            found.append(x)
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(found, schema)

    return written(spark, rows.mapInArrow(write, MANIFEST), "manifest")


def read_shard(path: str, numbers: Iterable[int] | None = None, block: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard, in the file's order by blocks, or those of the given record numbers in the order given."""
    fs, at = filesystem(path)
    with fs.open_input_file(f"{at}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)

    def one(record: memoryview) -> tuple[int | None, np.ndarray]:
        payload = unframed(record)
        has, width, key = struct.unpack("<BBq", payload[:10])
        return (key if has else None), np.frombuffer(payload, f"<u{width}", offset=10)

    with fs.open_input_file(f"{at}.rec") as f:
        if numbers is not None:
            for i in numbers:
                f.seek(int(offsets[i]))
                yield one(memoryview(f.read(int(offsets[i + 1] - offsets[i]))))
            return
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
            f.seek(int(offsets[i]))
            data = memoryview(f.read(int(offsets[j] - offsets[i])))
            for k in range(i, j):
                yield one(data[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]])
            i = j


def read_records(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and path and record, its place."""
    order = Window.orderBy("part", "shard")  # one row per shard of SHARD_BYTES
    placed = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).select("path", "base")
    many = min(10_000, max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "path", "record"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["base"], []
                for i, (key, ids) in enumerate(read_shard(row["path"])):
                    rows.append((key, start, len(ids), ids_crc32(ids), row["path"], i))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return placed.repartition(many, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, record long")


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write record files of docs into the shared folder, then return what read_records() finds in them: a row per row of docs, as
    write_records() states for nulls, repeated rows, empty texts and empty tables."""
    return read_records(write_records(docs, tokenizer, end, fresh_path(spark, "records")))
