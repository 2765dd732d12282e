"""Encoders and readers that converters need beyond the decoders: video, music wrapping, GIF, Matroska and font sheets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from tessera.functions.codecs import Ima, lcw_compress
from tessera.sources import images, media
from tessera.sources.binary import View, need

Chunk = tuple[bytes, bytes]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def _smaller(plain: Chunk) -> bytes:
    """A chunk as it is, or packed under the same name with a Z where that is smaller."""
    name, body = plain
    z = lcw_compress(body)
    return _chunk(name[:3] + b"Z", z) if len(z) < len(body) else _chunk(name, body)


def _blocks(pixels: bytes, width: int, height: int, w: int, h: int) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8).reshape(height, width)[: height // h * h, : width // w * w]
    return x.reshape(height // h, h, width // w, w).swapaxes(1, 2).reshape(-1, w * h)


def _book(blocks: np.ndarray, most: int) -> np.ndarray:
    """The blocks that aren't of one colour, most frequent first, those seen first before their equals."""
    mixed = blocks[(blocks != blocks[:, :1]).any(1)]
    if not len(mixed):
        return np.zeros((0, blocks.shape[1]), np.uint8)
    words, first, count = np.unique(mixed, axis=0, return_index=True, return_counts=True)
    return words[np.lexsort((first, -count))][:most]


def _pointers(blocks: np.ndarray, book: np.ndarray, fill: int) -> bytes:
    """Blocks of one colour point to it with the fill mark, others to the nearest word; without words, to their first colour."""
    plain = (blocks == blocks[:, :1]).all(1)
    if len(book):
        known = {w.tobytes(): i for i, w in enumerate(book)}
        wide = book.astype(np.int64)
        which = np.array([known[b.tobytes()] if b.tobytes() in known else int(np.square(wide - b).sum(1).argmin()) if not p else 0 for b, p in zip(blocks, plain.tolist(), strict=True)])
    else:
        plain, which = np.ones(len(blocks), bool), np.zeros(len(blocks), np.int64)
    low = np.where(plain, blocks[:, 0], which & 255)
    high = np.where(plain, fill, which >> 8)
    return low.astype(np.uint8).tobytes() + high.astype(np.uint8).tobytes()


def encode_vqa(frames: list[bytes], palette: bytes, width: int, height: int, audio: list[int] | None = None, rate: int = 22_050, channels: int = 1, fps: int = 15, block: tuple[int, int] = (4, 4), group: int = 8, words: int = 256) -> bytes:
    """Indexed frames with a six-bit palette: a code book per `group` of frames from its first one, pointers per frame, and sound
    (differences of four bits) in front of each frame."""
    w, h = block
    fill = 0xFF if h == 4 else 0x0F
    head = struct.pack("<5H4B6HBB", 2, 1 if audio else 0, len(frames), width, height, w, h, fps, 1, 0, words, 0, 0, 0, rate if audio else 0, channels if audio else 0, 16 if audio else 0) + bytes(14)
    sound = []
    if audio:
        left, right = Ima(), Ima()
        for at, n in media.samples_per_frame(len(audio) // channels, len(frames), rate, fps):
            part = audio[at * channels : (at + n) * channels]
            sides = [c.encode(part[k::channels]) for k, c in enumerate((left, right)[:channels])]
            sound.append(b"".join(bytes(a | b << 4 for a, b in zip(s[::2], [*s[1::2], 0][: len(s[::2])], strict=False)) for s in sides))
    parts, book, bodies = [], np.zeros((0, w * h), np.uint8), []
    for i, pixels in enumerate(frames):
        need(len(pixels) == width * height, "size", "VQA frame", len(pixels), width * height)
        blocks, body = _blocks(pixels, width, height, w, h), b""
        if i % max(1, group) == 0:
            book = _book(blocks, min(words, fill << 8))
            body = (_chunk(b"CPL0", palette) if i == 0 else b"") + (_smaller((b"CBF0", book.tobytes())) if len(book) else b"")
        bodies.append(body + _smaller((b"VPT0", _pointers(blocks, book, fill))))
    at = 12 + 8 + 42 + 8 + 4 * len(frames)
    index = []
    for i, body in enumerate(bodies):
        index.append(at // 2)
        part = (_chunk(b"SND2", sound[i]) if audio and sound[i] else b"") + _chunk(b"VQFR", body)
        parts.append(part)
        at += len(part)
    inside = b"WVQA" + _chunk(b"VQHD", head) + _chunk(b"FINF", struct.pack(f"<{len(index)}I", *index)) + b"".join(parts)
    return b"FORM" + struct.pack(">I", len(inside)) + inside


def mid_to_xmi(data: bytes) -> bytes:
    """The first track of a MIDI file in a catalogue of one sequence; its events stay as they are."""
    v = View(data, "MIDI")
    need(v.take(0, 4) == b"MThd", "magic", "MIDI header")
    at = 14
    while at + 8 <= len(data) and data[at : at + 4] != b"MTrk":
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "big")
    need(at + 8 <= len(data), "magic", "MIDI without a track")
    track = data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "big")]
    sequence = b"XMID" + _chunk(b"TIMB", b"") + _chunk(b"EVNT", track)
    return _chunk(b"FORM", b"XDIR" + _chunk(b"INFO", struct.pack("<H", 1))) + _chunk(b"CAT ", b"XMID" + _chunk(b"FORM", sequence))


def _unlzw(data: bytes, bits: int, most: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    width, held, have, before, out = bits + 1, 0, 0, b"", bytearray()
    for byte in data:
        held |= byte << have
        have += 8
        while have >= width:
            code, held, have = held & ((1 << width) - 1), held >> width, have - width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                continue
            if code == end or len(out) >= most:
                return bytes(out[:most])
            need(bool(table) and code <= len(table), "codec", "GIF code", code, len(table))
            word = table[code] if code < len(table) else before + before[:1]
            out += word
            if before and len(table) < 4096:
                table.append(before + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = word
    return bytes(out[:most])


def gif_frames(data: bytes) -> tuple[list[np.ndarray], int]:
    """Whole canvases (height x width x 4) after each frame, and the delay of the first in hundredths of a second."""
    v = View(data, "GIF")
    need(v.take(0, 6) in (b"GIF87a", b"GIF89a"), "magic", "GIF header")
    width, height, flags = v.fields("<HHB", 6)
    need(width * height <= 1 << 24, "size", "GIF canvas", width * height, 1 << 24)
    at = 13
    colours = None
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        colours, at = np.frombuffer(v.take(at, n), np.uint8).reshape(-1, 3), at + n
    canvas, out, delay = np.zeros((height, width, 4), np.uint8), [], None
    clear, disposal = None, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := v.u8(at):
            parts.append(v.take(at + 1, n))
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data):
        kind = v.u8(at)
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = v.u8(at + 1)
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                clear = body[3] if body[0] & 1 else None
                delay = int.from_bytes(body[1:3], "little") if delay is None else delay
            continue
        need(kind == 0x2C, "magic", "GIF block", kind, 0x2C)
        x, y, w, h, flags = v.fields("<HHHHB", at + 1)
        at += 10
        table = colours
        if flags & 128:
            n = 3 * (2 << (flags & 7))
            table, at = np.frombuffer(v.take(at, n), np.uint8).reshape(-1, 3), at + n
        need(table is not None, "magic", "GIF without colours")
        need(x + w <= width and y + h <= height, "offset", "GIF frame", x + w, width)
        bits = v.u8(at)
        body, at = blocks(at + 1)
        index = np.frombuffer(_unlzw(body, bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 64:
            rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            index = index[np.argsort(rows)]
        kept = canvas.copy()
        shown = np.ones((h, w), bool) if clear is None else index != clear
        part = canvas[y : y + h, x : x + w]
        part[shown] = np.concatenate([table[np.minimum(index, len(table) - 1)], np.full((h, w, 1), 255, np.uint8)], 2)[shown]
        out.append(canvas.copy())
        if disposal == 2:
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas = kept
        clear, disposal = None, 0
    return out, delay or 0


def font_sheet(data: bytes, columns: int = 16) -> np.ndarray:
    """Glyphs in cells of the largest size, 16 grey levels, by their code."""
    glyphs = list(images.fnt(data))
    w, h = max((g["width"] for g in glyphs), default=0), max((g["y_offset"] + g["data_rows"] for g in glyphs), default=0)
    out = np.zeros((-(-len(glyphs) // columns) * h, columns * w), np.uint8)
    for g in glyphs:
        x = images.glyph_pixels(g["data"], g["width"], g["data_rows"]) if g["data"] else np.zeros((0, 0), np.uint8)
        top, left = g["code"] // columns * h + g["y_offset"], g["code"] % columns * w
        out[top : top + x.shape[0], left : left + x.shape[1]] = x * 17
    return out[..., None].repeat(3, 2)


def _element(key: int, body: bytes) -> bytes:
    """An EBML element, its size in eight bytes."""
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def _number(key: int, value: int) -> bytes:
    return _element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


#: Fixed value: milliseconds that frames of a cluster are after its first at most.
CLUSTER_MS = 2000


def clusters_of(times: list[int], most: int = CLUSTER_MS) -> list[int]:
    """Of frames' times in order the cluster of each: a new one starts where a time is more than `most` after the start of the last."""
    out, start = [], None
    for t in times:
        if start is None or t - start > most:
            start = t
            out.append(out[-1] + 1 if out else 0)
        else:
            out.append(out[-1])
    return out


def gif(data: bytes, **_: object) -> Iterator[dict]:
    """Whole pictures after each frame."""
    frames, delay = gif_frames(data)
    for i, x in enumerate(frames):
        yield {"frame": i, "width": x.shape[1], "height": x.shape[0], "delay": delay, "rgba": x.tobytes()}


def mkv_of(frames: list[np.ndarray], fps: int, audio: list[int] | None = None, rate: int = 22_050, channels: int = 1) -> bytes:
    """Matroska with uncompressed 24-bit frames (BGR, from the top) and 16-bit sound; a cluster holds frames of at most CLUSTER_MS."""
    h, w = frames[0].shape[:2]
    head = _element(0x1A45DFA3, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = _element(0x1549A966, _number(0x2AD7B1, 1_000_000) + _element(0x4D80, b"tessera") + _element(0x5741, b"tessera"))
    picture = _element(0xE0, _number(0xB0, w) + _number(0xBA, h) + _element(0x2EB524, b"BGR\x18"))
    tracks = _element(0xAE, _number(0xD7, 1) + _number(0x73C5, 1) + _number(0x83, 1) + _element(0x86, b"V_UNCOMPRESSED") + _number(0x23E383, media.NANOS // max(1, fps)) + picture)
    if audio:
        sound = _element(0xE1, _element(0xB5, struct.pack(">d", rate)) + _number(0x9F, channels) + _number(0x6264, 16))
        tracks += _element(0xAE, _number(0xD7, 2) + _number(0x73C5, 2) + _number(0x83, 2) + _element(0x86, b"A_PCM/INT/LIT") + sound)
    cuts = media.samples_per_frame(len(audio) // channels, len(frames), rate, fps) if audio else []
    body = info + _element(0x1654AE6B, tracks)
    times = [i * 1000 // max(1, fps) for i in range(len(frames))]
    clusters = clusters_of(times)
    start, cluster = 0, b""
    for i, f in enumerate(frames):
        if not cluster:
            start, cluster = times[i], _number(0xE7, times[i])
        at = struct.pack(">h", times[i] - start)
        cluster += _element(0xA3, b"\x81" + at + b"\x80" + f[..., 2::-1].astype(np.uint8).tobytes())
        if audio:
            a, n = cuts[i]
            cluster += _element(0xA3, b"\x82" + at + b"\x80" + np.array(audio[a * channels : (a + n) * channels], "<i2").tobytes())
        if i + 1 == len(frames) or clusters[i + 1] != clusters[i]:
            body, cluster = body + _element(0x1F43B675, cluster), b""
    return head + _element(0x18538067, body)
