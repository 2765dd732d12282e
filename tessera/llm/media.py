"""Media columns: documents as sequences of texts and media references, and the media that the references name by digest.

interleaved() parses a page into ordered elements, a struct each: its position, its kind, a text or a reference with its
caption. Payloads are stored once per task and digest in a written table, as 8-bit samples in the WAVE format; resolve() joins
references to what was read back from it. Captions and positions come from the sequence alone, so they stay aligned whatever
the join does.
"""

from __future__ import annotations

import hashlib
import html as entities
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.words import slices

UNIT, RATE, SCHEME = 576, 8_000, "sha256:"
ELEMENTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_BLOCKS = frozenset("p div figure figcaption li h1 h2 h3 h4 h5 h6 article section blockquote br tr td body".split())
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "", "embed": "embed"}


class Sequence(HTMLParser):
    """A page's texts and media references in their order. A figure's caption goes to its references, else their alt or title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.kind, self.figure, self.caption, self.silent = "", None, None, 0

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        said = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        if tag in _BLOCKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            self.kind = _MEDIA[tag] or self.kind
            if said.get("src"):
                self.out.append({"position": len(self.out), "kind": self.kind or "media", "text": None, "ref": said["src"], "caption": said.get("alt") or said.get("title")})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag in ("audio", "video"):
            self.kind = ""
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for x in self.out[self.figure if self.figure is not None else len(self.out) :]:
                if x["ref"] is not None:
                    x["caption"] = said
            self.caption = None
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    s = Sequence()
    s.feed(html or "")
    s.close()
    s.flush()
    return s.out


def interleaved(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and its `elements`; a null or empty html has none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([sequence_of(x) for x in part.column("html").to_pylist()], kind)], names=["key", "elements"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(parse, f"key long, elements {ELEMENTS}").withColumnRenamed("key", key)


def payload(text: str | None, unit: int = UNIT) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of `unit`."""
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def wave(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of one channel of unsigned 8-bit samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = form + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def samples_of(stored: bytes) -> bytes:
    """The samples of such a file; an error for any other."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", stored, at + 8)
        if name == b"data":
            if form is None or form[0] != 1 or form[5] != 8:
                raise ValueError("not 8-bit samples")
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def feature_of(samples: bytes) -> str:
    """Mean, root mean square around 128, and zero crossings a thousand samples, of the waveform."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    up = x >= 128
    return f"mean={x.sum() / len(x):.3f};rms={np.sqrt(((x - 128) ** 2).sum() / len(x)):.3f};zcr={1000 * np.count_nonzero(up[1:] != up[:-1]) / len(x):.3f}"


FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_payloads(spark: SparkSession, docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """A written table of the payloads of docs (text): digest, n_bytes (unpadded) and stored; a task stores equal ones of a batch once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {}
                for text in part.column("text").to_pylist():
                    data = payload(text, unit)
                    n = len((text or "").encode())
                    rows.setdefault(hashlib.sha256(data).digest(), (n, data))
                yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in rows]), pa.array([n for n, _ in rows.values()], pa.int64()), pa.array([wave(x) for _, x in rows.values()], pa.binary())], names=["digest", "n_bytes", "stored"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(encode, "digest string, n_bytes long, stored binary")
    return written(spark, rows, "media")


def facts_of(media: DataFrame) -> DataFrame:
    """What the stored bytes say when they are read back: one row per digest. An error if they aren't what the digest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, stored in zip(*(batch.column(k) for k in ("digest", "n_bytes", "stored")), strict=True):
                data = stored.as_py()
                samples = samples_of(data)
                own = hashlib.sha256(samples).hexdigest()
                if own != digest.as_py():
                    raise ValueError(f"the payload {digest} is damaged")
                rows.append((own, n.as_py(), len(samples), own, zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FACTS.split(", ")])

    names = [x.split()[0] for x in FACTS.split(", ")]
    return media.mapInArrow(read, FACTS).groupBy("digest", "n_bytes").agg(*[F.min(c).alias(c) for c in names[2:]])


def resolve(sequences: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """Each media element of sequences (key, elements) with key, position, caption, digest and what `facts` (digest, ...) has on it;
    null where no payload has the digest. A digest may be hot: the join's sides are plain exchanges of small rows."""
    refs = sequences.select(key, F.explode("elements").alias("e")).where("e.ref is not null")
    refs = refs.select(key, F.col("e.position").alias("position"), F.col("e.caption").alias("caption"), F.when(F.startswith("e.ref", F.lit(SCHEME)), F.substring("e.ref", len(SCHEME) + 1, 64)).alias("digest"))
    return refs.join(facts, "digest", "left")


def as_pages(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """docs (doc_id, text) as pages: the text in a paragraph, then a figure with the reference to its payload and a caption."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, pages = part.column("doc_id").to_pylist(), []
                for k, text in zip(keys, part.column("text").to_pylist(), strict=True):
                    digest = hashlib.sha256(payload(text, unit)).hexdigest()
                    pages.append(f'<article><p>{entities.escape(text or "", quote=False)}</p><figure><audio src="{SCHEME}{digest}"></audio><figcaption>payload of document {k}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pages, pa.string())], names=["doc_id", "html"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lay, "doc_id long, html string")


def document_media(spark: SparkSession, docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Per row of docs (doc_id, text; null: empty): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, caption, position. The payloads are stored, the documents laid out as pages that refer to them, the pages
    parsed, the references joined to what is read back. UTF-8 has no
    byte 255, so different texts have different payloads."""
    facts = facts_of(store_payloads(spark, docs, unit))
    found = resolve(interleaved(as_pages(docs, unit), "doc_id"), "doc_id", facts)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position")
