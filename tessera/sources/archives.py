"""Archive indexes: each decoder gives one row per entry, with where its bytes lie in the file."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

from tessera.functions.codecs import Blowfish, index_key
from tessera.sources.binary import View, capped, lossy, need

ENTRY = "idx int, name string, crc long, offset long, size long"
#: Fixed value: the public key whose holder encrypted the indexes.
PUBLIC_KEY = "AihRvNoIbTn85FZRYNZRcT+i6KpU+maCsEqr3Q5q+LDB5tH7Tz2qQ38V"


@cache
def _modulus() -> int:
    """Big-endian, after a type and a length byte."""
    raw = base64.b64decode(PUBLIC_KEY)
    return int.from_bytes(raw[2 : 2 + raw[1]], "big")


def mix(data: bytes, **_: object) -> Iterator[dict]:
    """Entries by hash, in unsigned order. An index of 0 entries is followed by flags: 2 says that it is encrypted."""
    v = View(data, "MIX index")
    start, count = 0, v.u16(0)
    if count == 0 and len(v) >= 4:
        flags, start = v.u16(2), 4
        if flags & 2:
            cipher = Blowfish(index_key(v.take(4, 80), _modulus()))
            (count,) = struct.unpack_from("<H", cipher.decrypt(v.take(84, 8)))
            capped(count, 131_072, "MIX entries")
            blocks = -(-(6 + 12 * count) // 8)
            head = cipher.decrypt(v.take(84, 8 * blocks))
            yield from _mix_entries(View(head, "MIX index"), 0, count, 84 + 8 * blocks, len(data))
            return
        count = v.u16(4)
    capped(count, 131_072, "MIX entries")
    yield from _mix_entries(v, start, count, start + 6 + 12 * count, len(data))


def _mix_entries(v: View, at: int, count: int, body: int, end: int) -> Iterator[dict]:
    found = sorted(struct.iter_unpack("<III", v.take(at + 6, 12 * count)), key=lambda e: e[0])
    need(body <= end, "eof", "MIX data", body, end)
    for crc, offset, size in found:
        need(body + offset + size <= end, "offset", "MIX entry", body + offset + size, end)
    for i, (crc, offset, size) in enumerate(found):
        yield {"idx": i, "name": None, "crc": crc, "offset": body + offset, "size": size}


def big(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "BIG index")
    need(v.take(0, 4) in (b"BIGF", b"BIG4"), "magic", "BIG header")
    (size,), (count, first) = v.fields("<I", 4), v.fields(">II", 8)
    need(16 <= size <= len(data), "size", "BIG archive", size, len(data))
    capped(count, 262_144, "BIG entries")
    need(16 <= first <= size, "offset", "BIG data", first, size)
    at, rows = 16, []
    for i in range(count):
        offset, n = v.fields(">II", at)
        name = v.text0(at + 8, first)
        need(0 < len(name) <= 4096, "size", "BIG name", len(name), 4096)
        need(offset + n <= len(data), "offset", "BIG entry", offset + n, len(data))
        rows.append({"idx": i, "name": lossy(name), "crc": None, "offset": offset, "size": n})
        at += 9 + len(name)
    yield from rows


def meg(data: bytes, **_: object) -> Iterator[dict]:
    """Three layouts: counts first; a marker, the data's start and counts; the same with the size of the names."""
    v = View(data, "MEG index")
    marker = v.u32(0)
    start, sized = None, False
    if marker in (0xFFFFFFFF, 0x8FFFFFFF):
        need(v.u32(4) == 0x3F7D70A4, "magic", "MEG id")
        need(marker == 0xFFFFFFFF, "magic", "MEG is encrypted")
        start, names, files = v.fields("<III", 8)
        at = 20
        sized = len(v) >= 24 and 24 + v.u32(20) + 20 * files == start
        at = 24 if sized else 20
    else:
        names, files = v.fields("<II", 0)
        at = 8
    capped(names, 65_536, "MEG names")
    capped(files, 65_536, "MEG files")
    table = []
    for _i in range(names):
        n = v.u16(at)
        table.append(lossy(v.take(at + 2, capped(n, 4096, "MEG name"))))
        at += 2 + n
    if start is not None and not sized:
        need(at == start - 20 * files, "offset", "MEG names' end", at, start - 20 * files)
    rows = []
    for i in range(files):
        if sized:
            flags, crc, _x, n, offset, which = v.fields("<HIIIIH", at + 20 * i)
            need(flags == 0, "magic", "MEG entry is encrypted")
        else:
            crc, _x, n, offset, which = v.fields("<5I", at + 20 * i)
        need(which < len(table), "offset", "MEG name", which, len(table))
        need(offset >= at + 20 * files and offset + n <= len(data), "offset", "MEG entry", offset + n, len(data))
        rows.append({"idx": i, "name": table[which], "crc": crc, "offset": offset, "size": n})
    yield from rows


def pak(data: bytes, **_: object) -> Iterator[dict]:
    """Names with offsets up to where the first file starts; a file ends where the next one starts."""
    v = View(data, "PAK directory")
    first, at, found = v.u32(0), 0, []
    need(4 <= first <= len(data), "offset", "PAK data", first, len(data))
    while at + 4 <= first:
        offset = v.u32(at)
        if offset == 0:
            break
        name = v.text0(at + 4, first)
        need(0 < len(name) <= 260, "size", "PAK name", len(name), 260)
        found.append((lossy(name), offset))
        capped(len(found), 16_384, "PAK entries")
        at += 5 + len(name)
    ends = [o for _, o in found[1:]] + [len(data)]
    for (_name, offset), end in zip(found, ends, strict=True):
        need(first <= offset <= end <= len(data), "offset", "PAK entry", offset, end)
    for i, ((name, offset), end) in enumerate(zip(found, ends, strict=True)):
        yield {"idx": i, "name": name, "crc": None, "offset": offset, "size": end - offset}


AUDIO_ENTRY = "idx int, name string, offset long, size long, sample_rate long, flags long, chunk_size long"


def idx(data: bytes, **_: object) -> Iterator[dict]:
    """Sounds of the .bag file beside it."""
    need(len(data) % 36 == 0, "size", "IDX bytes", len(data), 36)
    capped(len(data) // 36, 65_536, "IDX entries")
    for i, (name, offset, size, rate, flags, chunk) in enumerate(struct.iter_unpack("<16s5I", data)):
        yield {"idx": i, "name": lossy(name.split(b"\0", 1)[0]), "offset": offset, "size": size, "sample_rate": rate, "flags": flags, "chunk_size": chunk}


def iso(data: bytes, **_: object) -> Iterator[dict]:
    """Files of an ISO 9660 image, directory by directory, with whole paths; ;1 and a last dot are cut off."""
    v = View(data, "ISO image")
    at = 16 * 2048
    need(v.take(at, 7) == b"\1CD001\1", "magic", "ISO primary volume")
    need(v.u16(at + 128) == 2048, "size", "ISO block size", v.u16(at + 128), 2048)
    root = at + 156
    todo, n = [("", v.u32(root + 2), v.u32(root + 10), 0)], 0
    while todo:
        path, block, size, depth = todo.pop(0)
        capped(depth, 32, "ISO depth")
        here, pos = View(v.take(block * 2048, size), "ISO directory"), 0
        while pos < len(here):
            length = here.u8(pos)
            if length == 0:
                pos = (pos // 2048 + 1) * 2048
                continue
            need(length >= 34, "size", "ISO record", length, 34)
            name = here.take(pos + 33, here.u8(pos + 32))
            if name not in (b"\0", b"\1"):
                text = lossy(name).split(";")[0]
                text = path + (text[:-1] if text.endswith(".") else text)
                lba, bytes_ = here.u32(pos + 2), here.u32(pos + 10)
                if here.u8(pos + 25) & 2:
                    todo.append((text + "/", lba, bytes_, depth + 1))
                else:
                    need(lba * 2048 + bytes_ <= len(data), "offset", "ISO file", lba * 2048 + bytes_, len(data))
                    yield {"idx": n, "name": text, "crc": None, "offset": lba * 2048, "size": bytes_}
                    n += 1
                    capped(n, 524_288, "ISO entries")
            pos += length


#: The most entries of an index, and the hash under which an archive holds the names of its entries.
MOST_ENTRIES, NAMES_ENTRY = 131_072, 0x54C2D545


def names_blob(data: bytes, **_: object) -> Iterator[dict]:
    """Names and descriptions as texts that end in NUL, after their number. A list that is cut off ends with the last whole pair; empty
    names don't count."""
    if len(data) < 4:
        return
    parts = data[4:].split(b"\0")[:-1]  # what follows the last NUL has no end
    for i in range(min(int.from_bytes(data[:4], "little"), MOST_ENTRIES, len(parts) // 2)):
        if parts[2 * i]:
            yield {"idx": i, "name": lossy(parts[2 * i]), "description": lossy(parts[2 * i + 1])}


# Type hints of the trailing block, by their number.
HINTS = ("bin", "shp", "pal", "aud", "vqa", "wsa", "tmp", "fnt", "ini", "mix")


def cnfm(data: bytes, **_: object) -> Iterator[dict]:
    """Names and kinds of entries, in a block of its own at a file's end. Without the mark, or of another version, it has none; where it
    is cut off it ends, and the entries before stay."""
    if len(data) < 8 or data[:4] != b"CNFM" or int.from_bytes(data[4:6], "little") != 1:
        return
    at = 8
    for i in range(int.from_bytes(data[6:8], "little")):
        if at + 7 > len(data):
            return
        crc, hint, n = struct.unpack_from("<IBH", data, at)
        if at + 7 + n > len(data):
            return
        yield {"idx": i, "crc": crc, "type_hint": hint, "name": lossy(data[at + 7 : at + 7 + n])}
        at += 7 + n


def encode_cnfm(entries: list[dict]) -> bytes:
    out = b"CNFM" + struct.pack("<HH", 1, len(entries))
    for e in entries:
        name = e["name"].encode()
        out += struct.pack("<IBH", e["crc"], e["type_hint"], len(name)) + name
    return out


def encode_mix(entries: dict[int, bytes] | list[tuple[int, bytes]]) -> bytes:
    """A plain archive of hashes and contents; the index is in signed order. Entries of one hash, which pairs can have, all stay, in
    their order."""
    pairs = entries.items() if isinstance(entries, dict) else entries
    order = sorted(pairs, key=lambda x: x[0] - (1 << 32) if x[0] >> 31 else x[0])
    index, at = b"", 0
    for k, content in order:
        index += struct.pack("<III", k, at, len(content))
        at += len(content)
    return struct.pack("<HI", len(order), at) + index + b"".join(content for _, content in order)
