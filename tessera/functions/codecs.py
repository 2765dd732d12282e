"""Codecs of the formats, on bytes; each keeps all state in its call, so they run in any task."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from functools import cache

import numpy as np

from tessera.sources.binary import DecodeError

# ---- copies, fills and literals ("LCW", "Format80")


def lcw_decompress(src: bytes, most: int) -> bytes:
    """Commands until 80: near copies (0x00-0x7F), literals (0x81-0xBF), copies from a place (0xC0-0xFD, 0xFF), fills (0xFE).

    A copy from before the start gives zeros, one from beyond what is written gives zeros there; more than `most` bytes, or an
    end before 80, is an error.
    """
    out, at, n = bytearray(), 0, len(src)

    def args(k: int) -> bytes:
        nonlocal at
        if at + k > n:
            raise DecodeError("eof", "LCW stream", at + k, n)
        at += k
        return src[at - k : at]

    def copy(start: int, count: int) -> None:
        have = len(out) - start
        if have <= 0:
            out.extend(bytes(count))
        elif have >= count:
            out.extend(out[start : start + count])
        else:  # the copy runs into what it writes
            part = bytes(out[start:])
            out.extend((part * (count // have + 1))[:count])

    while True:
        command = args(1)[0]
        if command == 0x80:
            return bytes(out)
        if command < 0x80:
            back = (command & 15) << 8 | args(1)[0]
            count, start = (command >> 4) + 3, len(out) - back
            job = (lambda s=start, c=count: copy(s, c)) if 0 < back <= len(out) else (lambda c=count: out.extend(bytes(c)))
        elif command < 0xC0:
            count = command & 63
            if len(out) + count > most:
                raise DecodeError("codec", "LCW output", len(out) + count, most)
            out.extend(args(count))
            continue
        elif command == 0xFE:
            count, value = struct.unpack("<HB", args(3))
            job = lambda c=count, v=value: out.extend(bytes([v]) * c)
        else:
            count, start = struct.unpack("<HH", args(4)) if command == 0xFF else ((command & 63) + 3, struct.unpack("<H", args(2))[0])
            job = lambda s=start, c=count: copy(s, c)
        if len(out) + count > most:
            raise DecodeError("codec", "LCW output", len(out) + count, most)
        job()


def lcw_compress(data: bytes) -> bytes:
    """Runs of three and more become fills, repeats of 3 to 10 bytes within 4095 near copies (the nearest of the longest), the
    rest literals of at most 63 bytes."""
    out, at, n = bytearray(), 0, len(data)

    def run(i: int, most: int) -> int:
        j = i + 1
        while j < n and j - i < most and data[j] == data[i]:
            j += 1
        return j - i

    def repeat(i: int) -> tuple[int, int]:
        """Length and distance of the longest earlier match, which may run into the place itself."""
        length, where = 0, 0
        for k in range(3, min(10, n - i) + 1):
            found = data.rfind(data[i : i + k], max(0, i - 4095), i + k - 1)
            if found < 0:
                break
            length, where = k, i - found
        return length, where

    while at < n:
        count = run(at, 65535)
        if count >= 3:
            out += struct.pack("<BHB", 0xFE, count, data[at])
            at += count
            continue
        length, back = repeat(at)
        if length:
            out += bytes([(length - 3) << 4 | back >> 8, back & 255])
            at += length
            continue
        end = at + 1
        while end < n and end - at < 63 and run(end, 3) < 3 and not repeat(end)[0]:
            end += 1
        out += bytes([0x80 | end - at]) + data[at:end]
        at = end
    return bytes(out + b"\x80")


def xor_delta(canvas: bytes, delta: bytes) -> bytes:
    """A frame's changes ("Format40") on a canvas. A stream that ends early or runs over the canvas stops without an error."""
    out = np.frombuffer(canvas, np.uint8).copy()
    size, at, to, n = len(out), 0, 0, len(delta)

    def word(i: int) -> int | None:
        return delta[i] | delta[i + 1] << 8 if i + 2 <= n else None

    while at < n:
        command = delta[at]
        at += 1
        value, count, skip = None, 0, 0
        if command == 0:  # one value, some times
            if at + 2 > n:
                break
            count, value, at = delta[at], delta[at + 1], at + 2
        elif command < 0x80:
            count = command
        elif command > 0x80:
            skip = command & 127
        else:
            w = word(at)
            if not w:
                break
            at += 2
            if w < 0x8000:
                skip = w
            elif w < 0xC000:
                count = w & 0x3FFF
            else:
                if at >= n:
                    break
                count, value, at = w & 0x3FFF, delta[at], at + 1
        to += skip
        if to > size:
            break
        if count:
            if to + count > size or value is None and at + count > n:
                break
            if value is None:
                out[to : to + count] ^= np.frombuffer(delta, np.uint8, count, at)
                at += count
            else:
                out[to : to + count] ^= np.uint8(value)
            to += count
    return out.tobytes()


def scanlines(data: bytes, width: int, height: int) -> bytes:
    """Rows that each start with their length in bytes; zero is followed by how many zeros. What is missing is zero."""
    rows, at = [], 0
    for _ in range(height):
        if at + 2 > len(data):
            break
        end = min(at + max(2, data[at] | data[at + 1] << 8), len(data))
        row, i = bytearray(), at + 2
        while i < end and len(row) < width:
            zero = data.find(b"\0", i, end)
            literal = data[i : end if zero < 0 else zero]
            row += literal
            i += len(literal)
            if zero >= 0:
                if i + 1 >= len(data) or len(row) >= width:
                    break
                row += bytes(data[i + 1])
                i += 2
        rows.append(bytes(row[:width]).ljust(width, b"\0"))
        at = end
    return b"".join(rows).ljust(width * height, b"\0")


# ---- adaptive differences

# The standard's step sizes and index changes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX_CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


@cache
def _ima() -> tuple[list[list[int]], list[list[int]]]:
    """By step index and nibble: the difference, and the next index."""
    size = lambda s, k: (s >> 3) + (s if k & 4 else 0) + (s >> 1 if k & 2 else 0) + (s >> 2 if k & 1 else 0)
    moves = [[size(s, k) * (-1 if k & 8 else 1) for k in range(16)] for s in STEPS]
    after = [[min(88, max(0, i + INDEX_CHANGES[k & 7])) for k in range(16)] for i in range(len(STEPS))]
    return moves, after


class Ima:
    """One channel: its sample and step index go on from call to call."""

    def __init__(self) -> None:
        self.sample, self.index = 0, 0

    def decode(self, nibbles: Iterable[int]) -> list[int]:
        moves, after = _ima()
        s, i, out = self.sample, self.index, []
        for k in nibbles:
            s += moves[i][k]
            s = 32767 if s > 32767 else -32768 if s < -32768 else s
            i = after[i][k]
            out.append(s)
        self.sample, self.index = s, i
        return out

    def encode(self, samples: Iterable[int]) -> list[int]:
        """Of each sample the nibble: sign, then halves of the step that the rest of the difference still holds."""
        out = []
        for x in samples:
            step, rest = STEPS[self.index], abs(int(x) - self.sample)
            # Whole step; then the half, over what the first bit took; then the quarter, over both and the constant eighth.
            k = 4 if rest >= step else 0
            k |= 2 if rest >= (step >> 1) + (step if k & 4 else 0) else 0
            k |= 1 if rest >= (step >> 2) + (step >> 3) + (step if k & 4 else 0) + (step >> 1 if k & 2 else 0) else 0
            k |= 8 if x < self.sample else 0
            self.decode((k,))
            out.append(k)
        return out


def nibbles(data: bytes) -> np.ndarray:
    """Low one first."""
    x = np.frombuffer(data, np.uint8)
    return np.stack([x & 15, x >> 4], 1).reshape(-1)


def adpcm_decode(data: bytes, stereo: bool = False, most: int = 8 << 20) -> list[int]:
    """Stereo bytes alternate between the channels, so samples come as L, L, R, R."""
    if not stereo:
        return Ima().decode(nibbles(data[: (most + 1) // 2]).tolist())[:most]
    left, right = Ima().decode(nibbles(data[::2]).tolist()), Ima().decode(nibbles(data[1::2]).tolist())
    out: list[int] = []
    for i in range(0, max(len(left), len(right)), 2):
        out += left[i : i + 2] + right[i : i + 2]
        if len(out) >= most:
            break
    return out[:most]


def adpcm_encode(samples: Iterable[int], stereo: bool = False) -> bytes:
    """Stereo samples come as L, R, L, R; four make two bytes, and what is left over is dropped."""
    x = list(samples)

    def packed(one: list[int]) -> bytes:
        k = Ima().encode(one)
        k += [0] * (len(k) % 2)
        return bytes(a | b << 4 for a, b in zip(k[::2], k[1::2], strict=True))

    if not stereo:
        return packed(x)
    x = x[: len(x) // 4 * 4]
    return bytes(b for pair in zip(packed(x[::2]), packed(x[1::2]), strict=True) for b in pair)


def snd2_decode(data: bytes, stereo: bool, left: Ima, right: Ima) -> list[int]:
    """Video sound: stereo has the left half first, and samples come as L, R."""
    if not stereo:
        return left.decode(nibbles(data).tolist())
    half = len(data) // 2
    a, b = left.decode(nibbles(data[:half]).tolist()), right.decode(nibbles(data[half : 2 * half]).tolist())
    return [x for pair in zip(a, b, strict=True) for x in pair]


# Changes of two and four bits of the older sound codec.
TWO_BITS = (-2, -1, 0, 1)
FOUR_BITS = (-9, -8, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 8)


def snd1_decode(data: bytes, most: int = 1 << 20) -> list[int]:
    """Older sound: sizes, then commands over 8-bit samples around 128; given as 16 bits."""
    if len(data) < 4:
        raise DecodeError("eof", "sound chunk", 4, len(data))
    size, n = struct.unpack_from("<HH", data)
    if size > most or 4 + n > len(data):
        raise DecodeError("eof", "sound chunk", 4 + n, len(data))
    body = data[4 : 4 + n]
    if n == size:
        return [(x - 128) * 256 for x in body]
    out, at, s = [], 0, 0x80
    limit = lambda v: 0 if v < 0 else 255 if v > 255 else v
    while at < n and len(out) < size:
        code, count = body[at] >> 6, body[at] & 63
        at += 1
        if code == 2 and count & 32:
            s = limit(s + (((count & 31) ^ 16) - 16))
            out.append(s)
        elif code == 2:
            out += body[at : at + count + 1]
            at += count + 1
            s = out[-1] if out else s
        elif code == 3:
            out += [s] * (count + 1)
        else:
            for x in body[at : at + count + 1]:
                for k in (x >> 0 & 3, x >> 2 & 3, x >> 4 & 3, x >> 6) if code == 0 else (x & 15, x >> 4):
                    s = limit(s + (TWO_BITS[k] if code == 0 else FOUR_BITS[k]))
                    out.append(s)
            at += count + 1
    return [(x - 128) * 256 for x in out[:size]]


# ---- quantities of seven bits a byte


def vlq_write(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def vlq_read(data: bytes, at: int) -> tuple[int, int]:
    """The number and how many bytes it took (four at most)."""
    value, n = 0, 0
    while at + n < len(data) and n < 4:
        value, n = value << 7 | data[at + n] & 127, n + 1
        if data[at + n - 1] < 128:
            break
    return value, n


# ---- the encrypted index of archives


@cache
def _pi_words(n: int) -> list[int]:
    """The first 32-bit words of the fraction of pi, by Machin's formula in whole numbers."""
    one = 1 << (32 * n + 64)

    def arctan(x: int) -> int:
        term = total = one // x
        k = 1
        while term:
            term //= x * x
            k += 2
            total += -(term // k) if k % 4 == 3 else term // k
        return total

    fraction = 4 * (4 * arctan(5) - arctan(239)) - 3 * one
    return [fraction >> (32 * (n - 1 - i) + 64) & 0xFFFFFFFF for i in range(n)]


class Blowfish:
    """The public cipher; its tables are words of pi."""

    def __init__(self, key: bytes):
        w = _pi_words(18 + 1024)
        self.s = [list(w[18 + 256 * i : 18 + 256 * (i + 1)]) for i in range(4)]
        self.p = [x ^ int.from_bytes(bytes(key[(4 * i + j) % len(key)] for j in range(4)), "big") for i, x in enumerate(w[:18])]
        a = b = 0
        for table in (self.p, *self.s):
            for i in range(0, len(table), 2):
                a, b = self._rounds(a, b, self.p)
                table[i], table[i + 1] = a, b

    def _rounds(self, a: int, b: int, p: list[int]) -> tuple[int, int]:
        s0, s1, s2, s3 = self.s
        for i in range(16):
            a ^= p[i]
            b ^= (((s0[a >> 24] + s1[a >> 16 & 255] & 0xFFFFFFFF) ^ s2[a >> 8 & 255]) + s3[a & 255]) & 0xFFFFFFFF
            a, b = b, a
        return b ^ p[17], a ^ p[16]

    def _all(self, data: bytes, p: list[int]) -> bytes:
        words = struct.unpack(f">{len(data) // 4}I", data)
        return struct.pack(f">{len(words)}I", *(x for i in range(0, len(words), 2) for x in self._rounds(words[i], words[i + 1], p)))

    def encrypt(self, data: bytes) -> bytes:
        return self._all(data, self.p)

    def decrypt(self, data: bytes) -> bytes:
        return self._all(data, self.p[::-1])


def index_key(source: bytes, modulus: int, exponent: int = 65537) -> bytes:
    """56 key bytes from the 80 of the header: little-endian numbers of one byte more than they give, raised modulo the public key."""
    out_size = (modulus.bit_length() - 1) // 8
    out = b""
    for at in range(0, len(source) - out_size, out_size + 1):
        number = pow(int.from_bytes(source[at : at + out_size + 1], "little"), exponent, modulus)
        out += number.to_bytes(out_size + 1, "little")[:out_size]
    return out[:56]
