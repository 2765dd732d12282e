"""Sound, music and video, one row per block, chunk, event, note or frame."""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np

from tessera.functions.codecs import Ima, adpcm_encode, lcw_decompress, snd1_decode, snd2_decode, vlq_read, vlq_write
from tessera.sources.binary import DecodeError, View, capped, need

NANOS = 1_000_000_000


def aud_header(data: bytes) -> dict:
    h = View(data, "AUD header").record("<HIIBB", "sample_rate compressed_size uncompressed_size flags compression")
    need(12 + h["compressed_size"] <= len(data), "eof", "AUD data", 12 + h["compressed_size"], len(data))
    channels, width = 1 + (h["flags"] & 1), 1 + (h["flags"] >> 1 & 1)
    frames = h["uncompressed_size"] // (channels * width)
    return h | {"channels": channels, "sample_frames": frames, "duration_ns": frames * NANOS // h["sample_rate"] if h["sample_rate"] else None}


CHUNK_MAGIC = struct.pack("<I", 0x0000DEAF)


def aud_samples(data: bytes) -> list[int]:
    """All samples; chunks of the older codec and of the newer one have sizes (and a magic) before them."""
    h = aud_header(data)
    body, kind = data[12 : 12 + h["compressed_size"]], h["compression"]
    if kind == 0:
        return np.frombuffer(body[: len(body) // 2 * 2], "<i2").tolist() if h["flags"] & 2 else [(x - 128) * 256 for x in body]
    need(kind in (1, 99), "codec", "AUD compression", kind, 99)
    step = 8 if body[4:8] == CHUNK_MAGIC else 4
    at, out, left, right = 0, [], Ima(), Ima()
    while at + step <= len(body):
        (n,) = struct.unpack_from("<H", body, at)
        part = body[at + step : at + step + n]
        if not part:
            break
        if h["channels"] == 1:
            x = np.frombuffer(part, np.uint8)
            out += left.decode(np.stack([x & 15, x >> 4], 1).reshape(-1).tolist())
        else:
            halves = [np.frombuffer(part[k::2], np.uint8) for k in (0, 1)]
            a, b = (c.decode(np.stack([x & 15, x >> 4], 1).reshape(-1).tolist()) for c, x in zip((left, right), halves, strict=True))
            for i in range(0, max(len(a), len(b)), 2):
                out += a[i : i + 2] + b[i : i + 2]
        at += step + n
    return out


def aud(data: bytes, chunkFrames: int = 1024, **_: object) -> Iterator[dict]:  # noqa: N803
    """Chunks of a fixed number of sample frames, with where each starts."""
    h = aud_header(data)
    samples, step = aud_samples(data), int(chunkFrames) * h["channels"]
    for i in range(0, max(1, len(samples)), step):
        start = i // h["channels"]
        yield {"chunk": i // step, "sample_rate": h["sample_rate"], "channels": h["channels"], "compression": h["compression"], "start_frame": start, "start_ns": start * NANOS // h["sample_rate"] if h["sample_rate"] else None, "samples": samples[i : i + step]}


def build_aud(samples: list[int], rate: int, stereo: bool = False) -> bytes:
    body = adpcm_encode(samples, stereo)
    return struct.pack("<HIIBBHH", rate, len(body) + 4, 2 * len(samples), 2 | int(stereo), 1, len(body) & 0xFFFF, 2 * len(samples) & 0xFFFF) + body


def aud_to_wav(data: bytes) -> bytes:
    h = aud_header(data)
    return wav_of(aud_samples(data), h["sample_rate"], h["channels"])


def wav_of(samples: list[int], rate: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.array(samples, "<i2").tobytes())
    return out.getvalue()


def wav_mono(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, channels averaged, and the rate."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw, channels, width, rate = w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth(), w.getframerate()
    except (wave.Error, EOFError) as e:
        raise DecodeError("magic", f"WAV: {e}") from None
    need(width in (1, 2, 4), "size", "WAV sample width", width, 4)
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def wav(data: bytes, **_: object) -> Iterator[dict]:
    x, rate = wav_mono(data)
    yield {"sample_rate": rate, "frames": len(x), "samples": x.tolist()}


def wav_to_aud(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data)) as w:
        raw, channels, width, rate = w.readframes(w.getnframes()), w.getnchannels(), w.getsampwidth(), w.getframerate()
    need(width in (1, 2) and channels in (1, 2), "size", "WAV layout", width, 2)
    x = np.frombuffer(raw, "<i2").tolist() if width == 2 else [(v - 128) * 256 for v in raw]
    return build_aud(x, rate, channels == 2)


def voc(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "VOC")
    need(v.take(0, 20) == b"Creative Voice File\x1a", "magic", "VOC header")
    at, version, check = v.fields("<HHH", 20)
    need(check == (~version + 0x1234) & 0xFFFF, "magic", "VOC version check", check)
    need(26 <= at <= len(data), "offset", "VOC data", at, len(data))
    i = 0
    while at < len(data) and v.u8(at):
        kind, size = v.u8(at), int.from_bytes(v.take(at + 1, 3), "little")
        body = v.take(at + 4, size)
        divisor = body[0] if kind == 1 and body else None
        yield {"idx": i, "version": version, "block_type": kind, "offset": at + 4, "size": size, "sample_rate": 1_000_000 // (256 - divisor) if divisor is not None else None, "data": body}
        at += 4 + size
        i = capped(i + 1, 65_536, "VOC blocks")


VQA_HEADER = "version flags num_frames width height block_w block_h fps groupsize one_colours cb_entries x y max_frame freq channels bits"


def chunks(data: bytes, at: int, end: int, context: str) -> Iterator[tuple[bytes, int, bytes]]:
    """Named chunks with big-endian sizes, padded to even ones; fewer than 8 bytes at the end don't count."""
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        need(at + 8 + n <= end, "offset", context, at + 8 + n, end)
        yield name, at, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def vqa_parts(data: bytes) -> tuple[dict, list[tuple[bytes, int, bytes]], list[int] | None]:
    v = View(data, "VQA")
    need(v.take(0, 4) == b"FORM" and v.take(8, 4) == b"WVQA", "magic", "VQA header")
    parts = list(chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "big")), "VQA chunk"))
    head = index = None
    for name, _at, body in parts:
        if name == b"VQHD" and head is None:
            View(body, "VQHD").take(0, 42)
            head = View(body, "VQHD").record("<5H4B6HBB", VQA_HEADER)
        elif name == b"FINF" and head is not None and index is None:
            index = list(View(body, "FINF").array("I", head["num_frames"], 0))
    need(head is not None, "magic", "VQA without VQHD")
    return head, parts, index


def vqa_chunks(data: bytes, **_: object) -> Iterator[dict]:
    head, parts, _index = vqa_parts(data)
    for i, (name, at, body) in enumerate(parts):
        yield {"idx": i, "fourcc": name.decode("latin-1"), "offset": at, "size": len(body), "num_frames": head["num_frames"], "width": head["width"], "height": head["height"], "fps": head["fps"]}


class Picture:
    """What the frames of a video change: code words, those that gather for the next cycle, and colours."""

    def __init__(self, head: dict):
        self.head, self.words, self.next, self.count, self.packed = head, b"", b"", 0, None
        self.palette = bytearray(768)
        self.w, self.h = max(1, head["block_w"]), max(1, head["block_h"])
        self.fill = 0xFF if head["block_h"] == 4 else 0x0F

    def colours(self, body: bytes) -> None:
        v = np.frombuffer(body[:768], np.uint8) & 63
        self.palette[: len(v)] = (v << 2 | v >> 4).tobytes()

    def book(self, words: bytes) -> None:
        self.words, self.next, self.count, self.packed = words, b"", 0, None

    def gather(self, body: bytes, packed: bool) -> None:
        need(self.packed in (None, packed), "codec", "VQA mixes code book parts")
        self.next, self.count, self.packed = self.next + body, self.count + 1, packed
        if self.count >= max(1, self.head["groupsize"]):
            self.book(lcw_decompress(self.next, 16 << 20) if packed else self.next)

    def render(self, pointers: bytes) -> bytes:
        """Each block shows a code word, or one colour where the high byte is the fill mark; a word that isn't there leaves zeros."""
        width, height, w, h = self.head["width"], self.head["height"], self.w, self.h
        cols, rows = width // w, height // h
        n = cols * rows
        need(len(pointers) >= 2 * n, "eof", "VQA pointers", 2 * n, len(pointers))
        low, high = (np.frombuffer(pointers, np.uint8, n, k * n).astype(np.int64) for k in (0, 1))
        book = np.frombuffer(self.words[: len(self.words) // (w * h) * (w * h)], np.uint8).reshape(-1, w * h)
        book = np.concatenate([book, np.zeros((1, w * h), np.uint8)])
        which = np.minimum(high << 8 | low, len(book) - 1)
        blocks = np.where((high == self.fill)[:, None], low[:, None], book[which]).astype(np.uint8)
        out = np.zeros((height, width), np.uint8)
        out[: rows * h, : cols * w] = blocks.reshape(rows, cols, h, w).swapaxes(1, 2).reshape(rows * h, cols * w)
        return out.tobytes()

    def frame(self, body: bytes) -> bytes | None:
        pointers, later = None, []
        for name, _at, part in chunks(body, 0, len(body), "VQA frame"):
            if name in (b"VPT0", b"VPTK"):
                pointers = part
            elif name in (b"VPTZ", b"VPTD"):
                pointers = lcw_decompress(part, 1 << 20)
            elif name in (b"CBP0", b"CBPZ"):
                later.append((part, name == b"CBPZ"))
            else:
                self.apply(name, part)
        out = None if pointers is None else self.render(pointers)
        for part, packed in later:  # they show from the next frame on
            self.gather(part, packed)
        return out

    def apply(self, name: bytes, body: bytes) -> bytes | None:
        if name in (b"VQFR", b"VQFK", b"VQFL"):
            return self.frame(body)
        if name == b"CBF0":
            self.book(body)
        elif name == b"CBFZ":
            self.book(lcw_decompress(body, 16 << 20))
        elif name in (b"CBP0", b"CBPZ"):
            self.gather(body, name == b"CBPZ")
        elif name == b"CPL0":
            self.colours(body)
        elif name == b"CPLZ":
            self.colours(lcw_decompress(body, 768))
        return None


def vqa(data: bytes, startFrame: int = 0, **_: object) -> Iterator[dict]:  # noqa: N803
    """Frames with their colours, from a frame on: those before it are decoded too, as each rests on others."""
    head, parts, _index = vqa_parts(data)
    picture, i, fps = Picture(head), 0, max(1, head["fps"])
    for name, _at, body in parts:
        pixels = picture.apply(name, body)
        if pixels is not None:
            if i >= int(startFrame):
                yield {"frame": i, "timestamp_ns": i * NANOS // fps, "width": head["width"], "height": head["height"], "pixels": pixels, "palette": bytes(picture.palette)}
            i += 1


def vqa_audio(data: bytes) -> tuple[list[int], int, int]:
    """Samples, rate and channels."""
    head, parts, _index = vqa_parts(data)
    out, left, right = [], Ima(), Ima()
    for name, _at, body in parts:
        if name == b"SND0":
            out += np.frombuffer(body[: len(body) // 2 * 2], "<i2").tolist() if head["bits"] != 8 else [(x - 128) * 256 for x in body]
        elif name == b"SND1":
            out += snd1_decode(body)
        elif name == b"SND2":
            out += snd2_decode(body, head["channels"] >= 2, left, right)
    return out, head["freq"] or 22_050, head["channels"] or 1


def samples_per_frame(total: int, frames: int, rate: int, fps: int) -> list[tuple[int, int]]:
    """Of each video frame, where its sound starts and how much of it there is: rests carry over."""
    ends = [min(total, (i + 1) * rate // max(1, fps)) for i in range(frames)]
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def midi(data: bytes, **_: object) -> Iterator[dict]:
    """Events of a MIDI file, by track, at their ticks."""
    v = View(data, "MIDI")
    need(v.take(0, 4) == b"MThd", "magic", "MIDI header")
    size, form, tracks, division = v.fields(">IHHH", 4)
    at, track = 8 + size, 0
    while at + 8 <= len(data) and track < tracks:
        name, n = v.fields(">4sI", at)
        body = v.take(at + 8, n)
        at += 8 + n
        if name != b"MTrk":
            continue
        pos, tick, status, i = 0, 0, 0, 0
        while pos < n:
            step, k = vlq_read(body, pos)
            pos, tick = pos + k, tick + step
            need(pos < n, "eof", "MIDI event", pos, n)
            if body[pos] >= 128:
                status, pos = body[pos], pos + 1
            need(status >= 128, "magic", "MIDI status")
            kind, args = status >> 4, b""
            if status == 0xFF:
                need(pos < n, "eof", "MIDI meta event", pos, n)
                meta, pos = body[pos], pos + 1
                k, used = vlq_read(body, pos)
                args, pos = body[pos + used : pos + used + k], pos + used + k
            elif status in (0xF0, 0xF7):
                meta = None
                k, used = vlq_read(body, pos)
                args, pos = body[pos + used : pos + used + k], pos + used + k
            else:
                meta, k = None, 1 if kind in (12, 13) else 2
                args, pos = body[pos : pos + k], pos + k
            need(pos <= n, "eof", "MIDI event", pos, n)
            yield {"track": track, "idx": i, "tick": tick, "status": status, "channel": status & 15 if status < 0xF0 else None, "meta": meta, "data": bytes(args), "division": division, "format": form}
            i += 1
        track += 1


def smf(events: list[tuple[int, bytes]], ticks_per_beat: int) -> bytes:
    """A file of one track from events at ticks, in their order."""
    body, before = b"", 0
    for tick, event in events:
        body += vlq_write(tick - before) + event
        before = tick
    body += b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ticks_per_beat) + b"MTrk" + struct.pack(">I", len(body)) + body


def notes_to_smf(notes: list[dict], ticks_per_beat: int = 480, tempo: int = 120, channel: int = 0) -> bytes:
    """Of note, onset, duration (seconds) and velocity; at a tick ends come before starts."""
    beat = 60_000_000 // max(1, tempo)
    tick = beat / 1e6 / max(1, ticks_per_beat)
    whole = lambda x: int(x / tick + 0.5)
    out = []
    for x in notes:
        start = whole(x["onset"])
        out += [(start, 1, bytes([0x90 | channel & 15, x["note"], x["velocity"]])), (start + max(1, whole(x["duration"])), 0, bytes([0x80 | channel & 15, x["note"], 0]))]
    out.sort(key=lambda e: e[:2])
    return smf([(0, b"\xff\x51\3" + beat.to_bytes(3, "big")), *((t, e) for t, _, e in out)], max(1, ticks_per_beat))


def xmi_sequences(data: bytes) -> list[dict[bytes, bytes]]:
    """Chunks of each sequence: alone, or in a catalogue after a directory."""
    def forms(at: int, end: int) -> Iterator[dict[bytes, bytes]]:
        for name, _at, body in chunks(data, at, end, "XMI chunk"):
            if name == b"FORM" and body[:4] == b"XMID":
                yield {n: b for n, _p, b in reversed(list(chunks(body, 4, len(body), "XMI sequence")))}
            elif name == b"CAT " and body[:4] == b"XMID":
                yield from forms_of(body)

    def forms_of(body: bytes) -> Iterator[dict[bytes, bytes]]:
        for name, _at, part in chunks(body, 4, len(body), "XMI catalogue"):
            if name == b"FORM" and part[:4] == b"XMID":
                yield {n: b for n, _p, b in reversed(list(chunks(part, 4, len(part), "XMI sequence")))}

    need(data[:4] in (b"FORM", b"CAT "), "magic", "XMI header")
    found = list(forms(0, len(data)))
    need(bool(found), "magic", "XMI without a sequence")
    return found


def xmi(data: bytes, **_: object) -> Iterator[dict]:
    for i, s in enumerate(xmi_sequences(data)):
        need(b"EVNT" in s, "magic", "XMI sequence without events")
        timbres = s.get(b"TIMB", b"\0\0")
        count = int.from_bytes(timbres[:2], "little")
        pairs = [{"patch": timbres[2 + 2 * k], "bank": timbres[3 + 2 * k]} for k in range(min(count, (len(timbres) - 2) // 2))]
        yield {"idx": i, "timbres": pairs, "events": s[b"EVNT"]}


def xmi_to_mid(events: bytes, ticks_per_beat: int = 60) -> bytes:
    """Notes carry how long they last; delays are sums of bytes below 128."""
    v, at, tick, out, order = View(events, "XMI events"), 0, 0, [], 0

    def add(when: int, rank: int, event: bytes) -> None:
        nonlocal order
        out.append((when, rank, order, event))
        order += 1

    def quantity() -> int:
        nonlocal at
        value, n = vlq_read(events, at)
        need(n > 0, "eof", "XMI events", at, len(events))
        at += n
        return value

    while at < len(events):
        while at < len(events) and events[at] < 128:
            tick, at = tick + events[at], at + 1
        need(at < len(events), "eof", "XMI events", at, len(events))
        status, at = events[at], at + 1
        if status == 0xFF:
            kind, at = v.u8(at), at + 1
            n = quantity()
            body, at = v.take(at, n), at + n
            if kind == 0x2F:
                break
            add(tick, 1, bytes([0xFF, kind]) + vlq_write(n) + body)
        elif status in (0xF0, 0xF7):
            n = quantity()
            body, at = v.take(at, n), at + n
            add(tick, 1, bytes([status]) + vlq_write(n) + body)
        elif status >> 4 == 9:
            note, at = v.take(at, 2), at + 2
            add(tick, 1, bytes([status]) + note)
            add(tick + quantity(), 0, bytes([0x80 | status & 15, note[0], 0]))
        else:
            n = 1 if status >> 4 in (12, 13) else 2
            body, at = v.take(at, n), at + n
            add(tick, 1, bytes([status]) + body)
    return smf([(t, e) for t, _r, _o, e in sorted(out, key=lambda x: x[:3])], ticks_per_beat)


def adl(data: bytes, **_: object) -> Iterator[dict]:
    """Instruments (11 registers each) and songs of a sound-chip file: a container of pointers, or one flat stream."""
    v = View(data, "ADL")
    v.u16(0)
    if len(data) >= 1120 and v.u16(120) == 1000 and any(x != 255 and x < 250 for x in data[:120]):
        for i, at in enumerate(v.array("H", 250, 620)):
            if at == 0:
                break
            need(at >= 1000, "offset", "ADL instrument", at, 1000)
            yield {"kind": "instrument", "idx": i, "registers": v.take(120 + at, 11), "speed": None, "program": None, "offset": at, "writes": None}
        for i, k in enumerate(data[:120]):
            if k == 255:
                break
            capped(k, 249, "ADL song")
            at = v.u16(120 + 2 * k)
            need(1000 <= at <= len(data) - 120, "offset", "ADL program", at, len(data))
            yield {"kind": "song", "idx": i, "registers": None, "speed": None, "program": k, "offset": at, "writes": None}
        return
    at, found = 0, []
    while at + 2 <= len(data) and len(found) < 256:
        offset = v.u16(at)
        at += 2
        if offset < at:
            if offset and offset + 11 <= len(data):
                found.append(offset)
            break
        found.append(offset)
    for i, o in enumerate(found):
        yield {"kind": "instrument", "idx": i, "registers": v.take(o, 11), "speed": None, "program": None, "offset": o, "writes": None}
    at = max([at, *(o + 11 for o in found)])
    if at < len(data):
        speed = max(1, int.from_bytes(data[at : at + 2], "little")) if at + 2 <= len(data) else 1
        body = data[at + 2 :]
        yield {"kind": "song", "idx": 0, "registers": None, "speed": speed, "program": None, "offset": at, "writes": body[: len(body) // 2 * 2]}


def yin(window: np.ndarray, most: int, least: int, threshold: float, rate: float) -> float | None:
    """The pitch of a window: the first dip of the normalised difference below the threshold, refined by a parabola."""
    w = window.astype(np.float64)
    half = len(w) // 2
    most = min(most, half)
    d = np.array([np.square(w[:half] - w[t : t + half]).sum() for t in range(1, most + 1)])
    total = np.cumsum(d)
    norm = np.concatenate([[1.0], np.where(np.abs(total) < 2.2e-16, 1.0, d * np.arange(1, most + 1) / np.where(total == 0, 1, total))]).astype(np.float32).astype(np.float64)
    low = np.flatnonzero(norm[least:] < np.float32(threshold))
    if not len(low):
        return None
    t = least + int(low[0])
    while t + 1 < len(norm) and norm[t + 1] < norm[t]:
        t += 1
    shift = 0.0
    if 0 < t < len(norm) - 1 and abs(bend := 2 * (2 * norm[t] - norm[t + 1] - norm[t - 1])) >= 2.2e-16:
        shift = (norm[t + 1] - norm[t - 1]) / bend
    return rate / (t + shift) if t + shift >= 1 else None


def pitches(x: np.ndarray, rate: int, window: int = 2048, hop: int = 512, threshold: float = 0.15, low: float = 80.0, high: float = 2000.0) -> list[float | None]:
    least, most = max(1, int(rate / high)) if high > 0 else 1, -int(-rate // low) if low > 0 else window // 2
    most = min(most, window // 2)
    if least >= most or len(x) < window:
        return []
    return [yin(x[i : i + window], most, least, threshold, rate) for i in range(0, len(x) - window + 1, hop)]


def notes_of(found: list[float | None], x: np.ndarray, rate: int, hop: int = 512, least_ms: int = 50) -> list[dict]:
    """Runs of frames of one MIDI note that last long enough, with the velocity of their mean level."""
    def note(f: float | None) -> int | None:
        n = int(np.floor(69 + 12 * np.log2(f / 440) + 0.5)) if f and f > 0 else -1
        return n if 0 <= n <= 127 else None

    ids = [note(f) for f in found]
    edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b and ids[a] is not None and (b - a) * hop / rate >= least_ms / 1000:
            level = np.mean([np.sqrt(np.mean(np.square(x[i * hop : (i + 1) * hop].astype(np.float64)))) if i * hop < len(x) else 0.0 for i in range(a, b)])
            velocity = 1 if level <= 0 else int(min(127, max(1, np.floor(min(1.0, max(0.0, 1 + np.log10(level))) * 126 + 1.5))))
            out.append({"note": ids[a], "onset": a * hop / rate, "duration": (b - a) * hop / rate, "velocity": velocity})
    return out


def transcribed(data: bytes, **_: object) -> Iterator[dict]:
    """Notes of a WAV file."""
    x, rate = wav_mono(data)
    yield from ({"idx": i, **n} for i, n in enumerate(notes_of(pitches(x, rate), x, rate)))


def png_of(pixels: np.ndarray) -> bytes:
    """Of height x width x (3 or 4) bytes."""
    h, w, c = pixels.shape
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x 4 bytes of an 8-bit PNG that isn't interlaced."""
    v, at, body, colours, alpha, head = View(data, "PNG"), 8, b"", None, b"", None
    need(v.take(0, 8) == b"\x89PNG\r\n\x1a\n", "magic", "PNG header")
    while at < len(data):
        n, name = v.fields(">I4s", at)
        part = v.take(at + 8, n)
        at += 12 + n
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            colours = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = part
        elif name == b"IDAT":
            body += part
        elif name == b"IEND":
            break
    need(head is not None and head[2] == 8 and head[6] == 0 and head[3] in (0, 2, 3, 4, 6), "codec", "PNG kind")
    w, h, kind = head[0], head[1], head[3]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise DecodeError("codec", f"PNG: {e}") from None
    need(len(raw) == h * (w * c + 1), "size", "PNG pixels", len(raw), h * (w * c + 1))
    raw, out, above = raw.reshape(h, -1), np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.int64)
    for y in range(h):
        f, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if f == 2:
            line = line + above
        elif f == 1:
            line = np.cumsum(line.reshape(w, c), 0).reshape(-1)
        elif f in (3, 4):
            for i in range(w * c):
                a, b, d = (line[i - c] if i >= c else 0), above[i], (above[i - c] if i >= c else 0)
                near = sorted(((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d)))[0][2]
                line[i] = line[i] + ((a + b) // 2 if f == 3 else near) & 255
        above = line & 255
        out[y] = above
    out = out.reshape(h, w, c)
    full = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        need(colours is not None, "magic", "PNG without colours")
        a = np.frombuffer(alpha.ljust(len(colours), b"\xff"), np.uint8)
        return np.concatenate([colours[out[..., 0]], a[out[..., 0]][..., None]], 2)
    grey = out[..., :1].repeat(3, 2) if c < 3 else out[..., :3]
    return np.concatenate([grey, out[..., -1:] if c in (2, 4) else full], 2)


def png_palette(data: bytes) -> list[tuple[int, ...]] | None:
    """The colours of an indexed PNG in their own order; none of another kind."""
    v, at = View(data, "PNG"), 8
    while at + 8 <= len(data):
        n, name = v.fields(">I4s", at)
        if name == b"IHDR" and v.u8(at + 8 + 9) != 3:
            return None
        if name == b"PLTE":
            return [tuple(x) for x in np.frombuffer(v.take(at + 8, n), np.uint8).reshape(-1, 3).tolist()]
        at += 12 + n
    return None


def png(data: bytes, **_: object) -> Iterator[dict]:
    x = png_pixels(data)
    yield {"width": x.shape[1], "height": x.shape[0], "rgba": x.tobytes()}


def _avi_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Name, place and size of each chunk that isn't a list, in the file's order."""
    v = View(data, "AVI")
    need(v.take(0, 4) == b"RIFF" and v.take(8, 4) == b"AVI ", "magic", "AVI header")
    todo = [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], v.u32(at + 4)
            need(at + 8 + n <= len(data), "eof", "AVI chunk", at + 8 + n, len(data))
            body = at + 8
            if name == b"LIST":
                todo.append((body + n + n % 2, end))
                at, end = body + 4, body + n
                continue
            yield name, body, n
            at = body + n + n % 2


def avi(data: bytes, **_: object) -> Iterator[dict]:
    """Frames of uncompressed video of 24 or 32 bits, from the bottom row up, as RGBA."""
    v = View(data, "AVI")
    micros, size, frames, kind = None, None, 0, b""
    for name, body, n in _avi_chunks(data):
        if name == b"avih":
            micros = v.u32(body)
        elif name == b"strh":
            kind = data[body : body + 4]
        elif name == b"strf" and kind == b"vids":
            _s, w, h, _p, bits, packed = v.fields("<IiiHHI", body)
            need(packed == 0 and bits in (24, 32), "codec", "AVI pixels", bits, 32)
            size = (w, h, bits)
        elif name in (b"00db", b"00dc") and size:
            w, h, bits = size
            stride = (w * bits // 8 + 3) // 4 * 4
            need(n == stride * abs(h), "size", "AVI frame", n, stride * abs(h))
            x = np.frombuffer(data, np.uint8, n, body).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
            x = (x[::-1] if h > 0 else x)[..., 2::-1]
            yield {"frame": frames, "width": w, "height": abs(h), "micros_per_frame": micros, "rgba": np.concatenate([x, np.full((*x.shape[:2], 1), 255, np.uint8)], 2).tobytes()}
            frames += 1


def avi_audio(data: bytes) -> tuple[list[int], int, int]:
    """Samples of 16 bits, rate and channels of the sound; 8-bit samples are widened. No samples if there is none, or if it is compressed."""
    v, kind, form, parts = View(data, "AVI sound"), b"", None, []
    for name, body, n in _avi_chunks(data):
        if name == b"strh":
            kind = data[body : body + 4]
        elif name == b"strf" and kind == b"auds":
            code, channels, rate, _bytes, _align, bits = v.fields("<HHIIHH", body)
            form = (channels, rate, bits) if code == 1 and bits in (8, 16) else None
        elif name[2:] == b"wb" and form:
            parts.append(data[body : body + n])
    if form is None:
        return [], 22_050, 1
    whole = b"".join(parts)
    samples = (np.frombuffer(whole, np.uint8).astype(np.int64) - 128) * 256 if form[2] == 8 else np.frombuffer(whole[: len(whole) // 2 * 2], "<i2")
    return samples.tolist(), form[1], form[0]


def avi_of(frames: list[np.ndarray], fps: int, audio: list[int] | None = None, rate: int = 22_050, channels: int = 1) -> bytes:
    """Uncompressed: 24-bit frames (height x width x 3, RGB), then 16-bit sound interleaved by frame."""
    h, w = frames[0].shape[:2] if frames else (0, 0)
    stride = (w * 3 + 3) // 4 * 4
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    group = lambda name, *parts: part(b"LIST", name + b"".join(parts))
    streams = 2 if audio else 1
    head = part(b"avih", struct.pack("<14I", 1_000_000 // max(1, fps), 0, 0, 0x10, len(frames), 0, streams, stride * h, w, h, 0, 0, 0, 0))
    video = group(b"strl", part(b"strh", struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"DIB ", 0, 0, 0, 0, 1, fps, 0, len(frames), stride * h, 0, 0, 0, 0, w, h)), part(b"strf", struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 0, 0, 0, 0)))
    sound = group(b"strl", part(b"strh", struct.pack("<4s4sIHHIIIIIIII4H", b"auds", b"\0\0\0\0", 0, 0, 0, 0, 1, rate, 0, len(audio) // channels, 0, 0, 2 * channels, 0, 0, 0, 0)), part(b"strf", struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16))) if audio else b""
    movie = []
    cuts = samples_per_frame(len(audio) // channels, len(frames), rate, fps) if audio else []
    for i, f in enumerate(frames):
        rows = np.zeros((h, stride), np.uint8)
        rows[:, : 3 * w] = f[::-1, :, 2::-1].reshape(h, 3 * w)
        movie.append(part(b"00db", rows.tobytes()))
        if audio:
            a, n = cuts[i]
            movie.append(part(b"01wb", np.array(audio[a * channels : (a + n) * channels], "<i2").tobytes()))
    body = group(b"hdrl", head, video, sound) + group(b"movi", *movie)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"AVI " + body


def gif_of(frames: list[bytes], width: int, height: int, colours: np.ndarray, delay: int = 10) -> bytes:
    """An animation of indexed frames with one table of 256 colours, index 0 clear."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + colours.astype(np.uint8).tobytes() + b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0"
    for f in frames:
        packed = _lzw(f)
        blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
        out += b"\x21\xf9\4" + struct.pack("<BHBB", 0x09, delay, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + blocks + b"\0"
    return out + b";"


def _lzw(pixels: bytes) -> bytes:
    table, code, width, bits, held, out = {bytes([i]): i for i in range(256)}, 258, 9, 0, 0, bytearray()

    def put(value: int) -> None:
        nonlocal bits, held
        held |= value << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(256)
    word = b""
    for x in pixels:
        longer = word + bytes([x])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = code
        code += 1
        if code > 1 << width and width < 12:
            width += 1
        elif code == 4096:
            put(256)
            table, code, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([x])
    if word:
        put(table[word])
    put(257)
    if bits:
        out.append(held & 255)
    return bytes(out)


