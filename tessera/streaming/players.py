"""Sound and video taken bit by bit from a file that is open, in bounded memory: what a decoder has read so far is all that it holds.

Both take any binary file object; seek() of it is needed for rewind(), resync() and seeking alone.
"""

from __future__ import annotations

import io
import struct
from collections import deque
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

from tessera.functions.codecs import Ima, snd1_decode, snd2_decode
from tessera.sources.binary import DecodeError, View, need
from tessera.sources.media import CHUNK_MAGIC, NANOS, VQA_HEADER, Picture

# How far to look for the next chunk, and the largest chunk.
AUD_SCAN, VQA_SCAN, VQA_CHUNK = 64 << 10, 256 << 10, 16 << 20


def _exactly(file: BinaryIO, n: int, context: str) -> bytes:
    data = file.read(n)
    need(len(data) == n, "eof", context, len(data), n)
    return data


def _low_first(data: bytes) -> list[int]:
    x = np.frombuffer(data, np.uint8)
    return np.stack([x & 15, x >> 4], 1).reshape(-1).tolist()


class AudPlayer:
    """Samples of a sound file, as many as are asked for at a time; channels are interleaved."""

    def __init__(self, file: BinaryIO):
        self.file = file
        head = View(_exactly(file, 12, "AUD header"), "AUD header").record("<HIIBB", "sample_rate compressed_size uncompressed_size flags compression")
        need(head["compression"] in (0, 1, 99), "codec", "AUD compression", head["compression"], 99)
        self.head, self.channels = head, 1 + (head["flags"] & 1)
        self.start = file.tell() if file.seekable() else None
        self.marked: bool | None = None
        self._fresh()

    def _fresh(self) -> None:
        self.left, self.right, self.ready, self.taken, self.used = Ima(), Ima(), deque(), 0, 0

    def _raw(self, n: int) -> bytes:
        data = self.file.read(max(0, min(n, self.head["compressed_size"] - self.used)))
        self.used += len(data)
        return data

    def _pump(self) -> bool:
        """Decode the next chunk; False at the end."""
        if self.head["compression"] == 0:
            wide = bool(self.head["flags"] & 2)
            data = self._raw(4096)
            self.ready.extend(np.frombuffer(data[: len(data) // 2 * 2], "<i2").tolist() if wide else [(x - 128) * 256 for x in data])
            return bool(data)
        size = self._raw(4)
        if len(size) < 4:
            return False
        if self.marked is None:
            ahead = self._raw(4)
            self.marked = ahead == CHUNK_MAGIC
            extra = b"" if self.marked else ahead
        else:
            extra = b""
            if self.marked:
                mark = self._raw(4)
                if len(mark) < 4:
                    return False
                need(mark == CHUNK_MAGIC, "magic", "AUD chunk", int.from_bytes(mark, "little"), 0xDEAF)
        n = int.from_bytes(size[:2], "little")
        part = extra[:n] + self._raw(n - len(extra[:n]))
        if not part:
            return False
        if self.channels == 1:
            self.ready.extend(self.left.decode(_low_first(part)))
        else:
            a, b = (c.decode(_low_first(part[k::2])) for k, c in enumerate((self.left, self.right)))
            for i in range(0, max(len(a), len(b)), 2):
                self.ready.extend(a[i : i + 2] + b[i : i + 2])
        return True

    def read(self, n: int) -> list[int]:
        """The next samples, at most n; none at the end."""
        while len(self.ready) < n and self._pump():
            pass
        out = [self.ready.popleft() for _ in range(min(n, len(self.ready)))]
        self.taken += len(out)
        return out

    def chunks(self, frames: int = 1024) -> Iterator[tuple[int, list[int]]]:
        """Runs of so many sample frames, with the frame that each starts at."""
        while True:
            at = self.taken // self.channels
            if not (samples := self.read(frames * self.channels)):
                return
            yield at, samples

    def rewind(self) -> None:
        """To the first sample."""
        need(self.start is not None, "offset", "AUD stream can't go back")
        self.file.seek(self.start)
        self._fresh()

    def resync(self) -> bool:
        """After damage: to the next marked chunk within AUD_SCAN bytes, with a fresh decoder. False if there is none, or chunks have no marks."""
        if self.head["compression"] != 99:
            return False
        here = self.file.tell()
        found = self.file.read(AUD_SCAN).find(CHUNK_MAGIC)
        if found < 0 or here + found - 4 < self.start:
            return False
        self.file.seek(here + found - 4)
        taken = self.taken
        self._fresh()
        self.taken, self.used, self.marked = taken, here + found - 4 - self.start, True
        return True


class VqaPlayer:
    """Frames and sound of a video file. A step reads one chunk; frames and sound that it gives wait in queues until they are taken."""

    def __init__(self, file: BinaryIO):
        self.file, self.index = file, None
        start = _exactly(file, 12, "VQA header")
        need(start[:4] == b"FORM" and start[8:] == b"WVQA", "magic", "VQA header")
        self.end = 8 + int.from_bytes(start[4:8], "big")
        self.first = file.tell() if file.seekable() else None
        self.at, self.head = 12, None
        while self.head is None:
            chunk = self.next_chunk()
            need(chunk is not None, "magic", "VQA without VQHD")
            if chunk[0] == b"VQHD":
                self.head = View(chunk[1], "VQHD").record("<5H4B6HBB", VQA_HEADER)
        self.rate, self.channels, self.fps = self.head["freq"] or 22_050, self.head["channels"] or 1, max(1, self.head["fps"])
        self._fresh()

    def _fresh(self) -> None:
        self.picture, self.left, self.right = Picture(self.head), Ima(), Ima()
        self.frames, self.sound, self.made, self.given, self.cut = deque(), deque(), 0, 0, 0

    def next_chunk(self) -> tuple[bytes, bytes] | None:
        """The next chunk's name and bytes. At the end none; a rest of 1 to 7 bytes is no chunk, but damage if the file says that more follows."""
        head = self.file.read(8)
        if len(head) < 8:
            need(not head or self.at + len(head) >= self.end, "eof", "VQA chunk", len(head), 8)
            return None
        name, n = head[:4], int.from_bytes(head[4:], "big")
        need(n <= VQA_CHUNK, "size", "VQA chunk", n, VQA_CHUNK)
        body = _exactly(self.file, n, "VQA chunk")
        if n % 2:
            self.file.read(1)
        self.at += 8 + n + n % 2
        return name, body

    def step(self) -> bool:
        """One chunk, to the queue of frames or of sound; False at the end."""
        chunk = self.next_chunk()
        if chunk is None:
            return False
        name, body = chunk
        if name == b"FINF" and self.index is None:
            self.index = list(View(body, "FINF").array("I", self.head["num_frames"], 0))
        elif name == b"SND0":
            self.sound.extend(np.frombuffer(body[: len(body) // 2 * 2], "<i2").tolist() if self.head["bits"] != 8 else [(x - 128) * 256 for x in body])
        elif name == b"SND1":
            self.sound.extend(snd1_decode(body))
        elif name == b"SND2":
            self.sound.extend(snd2_decode(body, self.channels >= 2, self.left, self.right))
        elif (pixels := self.picture.apply(name, body)) is not None:
            self.frames.append((self.made, pixels, bytes(self.picture.palette)))
            self.made += 1
        return True

    def next_frame(self) -> tuple[int, bytes, bytes] | None:
        """Number, pixels and colours."""
        while not self.frames:
            if not self.step():
                return None
        return self.frames.popleft()

    def frame_into(self, out: bytearray | memoryview) -> int | None:
        """The next frame's pixels into a buffer of the caller's; gives its number."""
        frame = self.next_frame()
        if frame is None:
            return None
        need(len(out) >= len(frame[1]), "size", "VQA frame buffer", len(out), len(frame[1]))
        out[: len(frame[1])] = frame[1]
        return frame[0]

    def queued_audio(self, n: int) -> list[int]:
        """Samples that wait already, at most n; nothing is read."""
        out = [self.sound.popleft() for _ in range(min(n, len(self.sound)))]
        self.given += len(out)
        return out

    def audio(self, n: int) -> list[int]:
        """The next samples, at most n; chunks are read as long as there are too few, and their frames wait."""
        while len(self.sound) < n and self.step():
            pass
        return self.queued_audio(n)

    def audio_of_frame(self) -> list[int]:
        """The sound of just one frame's time: rests of a sample carry over to the next."""
        self.cut += 1
        due = self.cut * self.rate // self.fps * self.channels
        return self.audio(max(0, due - (self.cut - 1) * self.rate // self.fps * self.channels))

    def rewind(self) -> None:
        need(self.first is not None, "offset", "VQA stream can't go back")
        self.file.seek(self.first)
        self.at = 12
        self._fresh()

    def seek_frame(self, number: int) -> None:
        """The next frame is that one: all before it are decoded from the start, as each rests on others; their sound is dropped, and the
        parts of a sample that carry over are those of that time."""
        need(0 <= number < max(1, self.head["num_frames"]), "offset", "VQA frame", number, self.head["num_frames"])
        self.rewind()
        while self.made < number or (self.frames and self.frames[0][0] < number):
            if self.frames and self.frames[0][0] < number:
                self.frames.popleft()
            elif not self.step():
                raise DecodeError("eof", "VQA frame", number, self.made)
        self.sound.clear()
        self.cut = number

    def seek_time(self, nanos: int) -> int:
        """To the frame that is shown at a time, the last one from its end on; gives its number."""
        number = min(nanos * self.fps // NANOS, max(0, self.head["num_frames"] - 1))
        self.seek_frame(number)
        return number

    def seek_points(self) -> list[dict]:
        """Of each frame of the index: number, time, flags, and the byte where it starts."""
        if self.index is None and self.first is not None:
            here, at = self.file.tell(), self.at
            self.file.seek(self.first)
            while (chunk := self.next_chunk()) is not None and chunk[0] != b"FINF":
                pass
            if chunk is not None:
                self.index = list(View(chunk[1], "FINF").array("I", self.head["num_frames"], 0))
            self.file.seek(here)
            self.at = at
        return [{"frame": i, "time_ns": i * NANOS // self.fps, "flags": raw >> 28, "byte_offset": 2 * (raw & 0x0FFFFFFF)} for i, raw in enumerate(self.index or [])]

    def resync(self) -> bool:
        """After damage: to the next place within VQA_SCAN bytes that looks like a chunk's head, a name of visible letters and a size from 1 to VQA_CHUNK."""
        here = self.file.tell()
        data = np.frombuffer(self.file.read(VQA_SCAN), np.uint8)
        if len(data) >= 8:
            seen = (data >= 0x21) & (data <= 0x7E)
            n = len(data) - 7
            named = seen[:n] & seen[1 : n + 1] & seen[2 : n + 2] & seen[3 : n + 3]
            size = sum(data[4 + k : n + 4 + k].astype(np.int64) << (24 - 8 * k) for k in range(4))
            found = np.flatnonzero(named & (size > 0) & (size <= VQA_CHUNK))
            if len(found):
                self.file.seek(here + int(found[0]))
                self.at = here + int(found[0])
                return True
        return False


def aud_to_wav(source: BinaryIO, target: BinaryIO, frames: int = 4096) -> int:
    """A sound file as WAVE, some thousand samples at a time; the sizes are put in at the end. Gives the sample frames written."""
    player = AudPlayer(source)
    c, rate, n = player.channels, player.head["sample_rate"], 0
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, c, rate, rate * 2 * c, 2 * c, 16)
    target.write(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + form + struct.pack("<4sI", b"data", 0))
    for _at, samples in player.chunks(frames):
        target.write(np.array(samples, "<i2").tobytes())
        n += len(samples)
    target.seek(4)
    target.write(struct.pack("<I", 36 + 2 * n))
    target.seek(40)
    target.write(struct.pack("<I", 2 * n))
    return n // c


def aud_stream(data: bytes, chunkFrames: int = 1024, resync: bool = False, **_: object) -> Iterator[dict]:  # noqa: N803
    """A sound file's chunks, decoded step by step; with resync, damage is passed over to the next chunk that has a mark, and the chunk after
    it is said to be so."""
    player, k, after = AudPlayer(io.BytesIO(data)), 0, False
    runs = player.chunks(int(chunkFrames))
    while True:
        try:
            run = next(runs, None)
        except DecodeError:
            if not (str(resync).lower() == "true" and player.resync()):
                raise
            runs, after = player.chunks(int(chunkFrames)), True
            continue
        if run is None:
            return
        yield {"chunk": k, "sample_rate": player.head["sample_rate"], "channels": player.channels, "start_frame": run[0], "samples": run[1], "after_damage": after}
        k, after = k + 1, False


def vqa_stream(data: bytes, startFrame: int = 0, startNanos: int | None = None, resync: bool = False, **_: object) -> Iterator[dict]:  # noqa: N803
    """A video's frames, each with the sound of its time, from a frame or a time on; with resync, damage is passed over to the next place that
    looks like a chunk."""
    player = VqaPlayer(io.BytesIO(data))
    if startNanos is not None:
        player.seek_time(int(startNanos))
    elif int(startFrame):
        player.seek_frame(int(startFrame))
    while True:
        try:
            frame = player.next_frame()
        except DecodeError:
            if not (str(resync).lower() == "true" and player.resync()):
                raise
            continue
        if frame is None:
            return
        try:
            sound = player.audio_of_frame()
        except DecodeError:
            if str(resync).lower() != "true":
                raise
            sound = []
        yield {"frame": frame[0], "timestamp_ns": frame[0] * NANOS // player.fps, "width": player.head["width"], "height": player.head["height"], "pixels": frame[1], "palette": frame[2], "samples": sound}
