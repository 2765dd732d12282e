"""Sprites, tiles, fonts, palettes and screens, one row per frame, tile, glyph or colour."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from tessera.functions.codecs import lcw_compress, lcw_decompress, scanlines, xor_delta
from tessera.sources.binary import DecodeError, View, capped, need

AREA = 4 << 20
FRAME = "idx int, x int, y int, width int, height int, format int, offset long, pixels binary"


def pal(data: bytes, **_: object) -> Iterator[dict]:
    need(len(data) == 768, "size", "PAL bytes", len(data), 768)
    for i in range(256):
        yield dict(zip(("idx", "r", "g", "b"), (i, *data[3 * i : 3 * i + 3]), strict=True))


def encode_pal(colours: list[tuple[int, int, int]]) -> bytes:
    """Of 8-bit colours; what is missing is black."""
    return b"".join(bytes(v >> 2 for v in c) for c in colours).ljust(768, b"\0")


def rgb(palette: bytes, full: bool = False) -> np.ndarray:
    """256 x 3 bytes of a six-bit palette."""
    v = np.frombuffer(palette, np.uint8).reshape(-1, 3) & 63
    return v << 2 | v >> 4 if full else v << 2


def lut(data: bytes, **_: object) -> Iterator[dict]:
    need(len(data) == 4096 * 3, "size", "LUT bytes", len(data), 4096 * 3)
    cells = np.frombuffer(data, np.uint8).reshape(-1, 3)
    need(bool((cells < (64, 64, 16)).all()), "size", "LUT cell")
    for i, (x, y, value) in enumerate(cells.tolist()):
        yield {"idx": i, "x": x, "y": y, "value": value}


TRIANGLE = 256 * 257 // 2


def vqp(data: bytes, **_: object) -> Iterator[dict]:
    """Colours between two colours, as lower triangles."""
    n = View(data, "VQP tables").u32(0)
    need(len(data) == 4 + n * TRIANGLE, "size", "VQP bytes", len(data), 4 + n * TRIANGLE)
    for i in range(n):
        yield {"idx": i, "packed": data[4 + i * TRIANGLE : 4 + (i + 1) * TRIANGLE]}


def _area(width: int, height: int, limit: int, context: str) -> int:
    return capped(width * height, limit, context)


def shp_index(data: bytes) -> tuple[dict, list[tuple]]:
    """Header, and of each frame: kind, offset, reference, bytes."""
    v = View(data, "SHP frames")
    head = v.record("<7H", "frames x y width height largest flags")
    n = capped(head["frames"], 8192, "SHP frames")
    _area(head["width"], head["height"], AREA, "SHP frame area")
    table = [(raw >> 24, raw & 0xFFFFFF, ref) for raw, ref, _ in struct.iter_unpack("<IHH", v.take(14, 8 * (n + 2)))]
    start = 14 + 8 * (n + 2) + 768 * (head["flags"] & 1)
    need(start <= len(data), "eof", "SHP palette", start, len(data))
    need(not {k for k, _, _ in table[n:]} & {0x80, 0x40, 0x20}, "magic", "SHP end has a frame's code")
    frames = []
    for i, ((kind, at, ref), (_, end, _r)) in enumerate(zip(table[: n + 1], table[1:], strict=False)):
        if i == n:
            need(start <= at <= len(data), "offset", "SHP end", at, len(data))
            break
        need(kind in ((0x80,) if i == 0 else (0x80, 0x40, 0x20)), "magic", "SHP frame code", kind, 0x80)
        need(start <= at <= end <= len(data), "offset", "SHP frame", end, len(data))
        frames.append((kind, at, ref, data[at:end]))
    if not n:
        need(start <= table[0][1] <= len(data), "offset", "SHP end", table[0][1], len(data))
    return head, frames


def shp(data: bytes, **_: object) -> Iterator[dict]:
    """Whole frames: 80 stands alone, 40 changes the key frame at an offset (or the frame before), 20 the frame before."""
    head, frames = shp_index(data)
    size, done, keys = head["width"] * head["height"], [], {}
    for i, (kind, at, ref, body) in enumerate(frames):
        if not size:
            done.append(b"")
        elif kind == 0x80:
            keys[at] = i
            done.append(lcw_decompress(body, size))
        else:
            done.append(xor_delta(done[keys.get(ref, i - 1) if kind == 0x40 else i - 1], body))
        yield {"idx": i, "x": head["x"], "y": head["y"], "width": head["width"], "height": head["height"], "format": kind, "offset": at, "pixels": done[-1]}


def encode_shp(frames: list[bytes], width: int, height: int) -> bytes:
    """Key frames only."""
    for f in frames:
        need(len(f) == width * height, "size", "SHP frame", len(f), width * height)
    packed, at, table = [lcw_compress(f) for f in frames], 14 + 8 * (len(frames) + 2), b""
    for p in packed:
        table += struct.pack("<IHH", at | 0x80 << 24, 0, 0)
        at += len(p)
    head = struct.pack("<7H", len(frames), 0, 0, width, height, min(65535, max(map(len, packed), default=0)), 0)
    return head + table + struct.pack("<IHH", at, 0, 0) + bytes(8) + b"".join(packed)


def shp_ts_heads(data: bytes) -> list[dict]:
    v = View(data, "SHP frames")
    zero, width, height, n = v.fields("<4H")
    need(zero == 0, "magic", "SHP first word", zero, 0)
    capped(n, 4096, "SHP frames")
    capped(max(width, height), 4096, "SHP canvas")
    heads = [v.record("<4HB3s4s4sI", "x y width height format pad colour unused offset", 8 + 24 * i) for i in range(n)]
    for h in heads:
        if _area(h["width"], h["height"], 1 << 24, "SHP frame area"):
            need(h["offset"] <= len(data), "offset", "SHP frame", h["offset"], len(data))
    return heads


def shp_ts(data: bytes, **_: object) -> Iterator[dict]:
    """Frames with their place on the canvas: plain, rows of runs, or copies and fills."""
    v = View(data, "SHP frames")
    for i, h in enumerate(shp_ts_heads(data)):
        size, kind, body = h["width"] * h["height"], h["format"], data[h["offset"] :]
        if not size or not h["offset"]:
            pixels = b""
        else:
            need(kind in (0, 1, 2, 3), "magic", "SHP frame code", kind, 3)
            pixels = v.take(h["offset"], size) if kind == 0 else lcw_decompress(body, size) if kind == 3 else scanlines(body, h["width"], h["height"])
        yield {"idx": i, **{k: h[k] for k in ("x", "y", "width", "height", "format", "offset")}, "pixels": pixels}


def shp_d2(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "SHP frames")
    n = capped(v.u16(0), 4096, "SHP frames")
    offsets = v.array("I", n + 2, 2)
    shift = 2 if offsets[0] == 4 * (n + 2) else 0
    for i, at in enumerate(offsets[:n]):
        at += shift if at else 0
        flags, _slices, width, height, _size, packed = v.fields("<HBHBHH", at)
        need(width > 0 and height > 0, "size", "SHP frame", 0, 1)
        _area(capped(width, 1024, "SHP width"), height, AREA, "SHP frame area")
        start = at + 10 + 16 * (flags & 1)
        need(start <= len(data), "offset", "SHP frame", start, len(data))
        pixels = v.take(start, packed)[: width * height] if flags & 2 else lcw_decompress(data[start : start + packed], width * height)
        need(not flags & 2 or len(pixels) == width * height, "eof", "SHP pixels", len(pixels), width * height)
        yield {"idx": i, "x": 0, "y": 0, "width": width, "height": height, "format": flags, "offset": at, "pixels": pixels}


def wsa_index(data: bytes) -> tuple[dict, list[tuple[int, bytes]]]:
    """Header, and of each frame where its bytes lie and they; none where two zero offsets repeat the frame before."""
    v = View(data, "WSA frames")
    h = v.record("<7H", "frames x y width height largest flags")
    n = capped(h["frames"], 8192, "WSA frames")
    _area(h["width"], h["height"], AREA, "WSA frame area")
    offsets = v.array("I", n + 2, 14)
    base = 768 if h["flags"] & 1 else 0
    v.take(14 + 4 * (n + 2), base)
    frames = []
    for a, b in zip(offsets[:n], offsets[1 : n + 1], strict=True):
        need(a <= b, "offset", "WSA frame", b, a)
        frames.append((base + a, v.take(base + a, b - a) if b else b""))
    return h | {"loops": offsets[n + 1] != 0}, frames


def wsa(data: bytes, **_: object) -> Iterator[dict]:
    """Frames of an animation; each changes the one before."""
    h, frames = wsa_index(data)
    size = h["width"] * h["height"]
    canvas = bytes(size)
    for i, (at, body) in enumerate(frames):
        if body:
            delta = lcw_decompress(body, 2 * size)
            canvas = (np.frombuffer(canvas, np.uint8) ^ np.frombuffer(delta, np.uint8)).tobytes() if len(delta) == size else xor_delta(canvas, delta)
        yield {"idx": i, "x": h["x"], "y": h["y"], "width": h["width"], "height": h["height"], "format": int(h["loops"]), "offset": at, "pixels": canvas}


def encode_wsa(frames: list[bytes], width: int, height: int) -> bytes:
    packed, before = [], bytes(width * height)
    for f in frames:
        need(len(f) == width * height, "size", "WSA frame", len(f), width * height)
        packed.append(lcw_compress((np.frombuffer(f, np.uint8) ^ np.frombuffer(before, np.uint8)).tobytes()))
        before = f
    at = 14 + 4 * (len(frames) + 2)
    offsets = [at + sum(map(len, packed[:i])) for i in range(len(packed) + 1)]
    return struct.pack("<7H", len(frames), 0, 0, width, height, min(65535, max(map(len, packed), default=0)), 0) + struct.pack(f"<{len(offsets)}II", *offsets, 0) + b"".join(packed)


TILE = "idx int, col int, row int, width int, height int, pixels binary, extra binary, depth binary, terrain int, ramp int, level int"


def tmp_td(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "TMP tiles")
    h = v.record("<4H6I", "width height count allocated size icons palettes remaps flags map")
    need(h["count"] == 0 or h["width"] and h["height"], "size", "TMP tile", 0, 1)
    capped(h["count"], 4096, "TMP tiles")
    area = _area(h["width"], h["height"], 1 << 20, "TMP tile area")
    if h["map"]:
        v.take(h["map"], h["count"])
    start = h["icons"] or 32
    rows = [v.take(start + i * area, area) for i in range(h["count"])]
    for i, pixels in enumerate(rows):
        yield {"idx": i, "col": i, "row": 0, "width": h["width"], "height": h["height"], "pixels": pixels}


def encode_tmp_td(tiles: list[bytes], width: int, height: int) -> bytes:
    body = b"".join(tiles)
    n = len(tiles)
    at = 32 + len(body)
    return struct.pack("<4H6I", width, height, n, n, at + 2 * n, 32, 0, 0, at, at + n) + body + bytes(n) + bytes(i & 255 for i in range(n))


def _grid(v: View, cols: int, rows: int, area: int) -> Iterator[tuple[int, int]]:
    n = capped(cols * rows, 4096, "TMP tiles")
    capped(area, 1 << 20, "TMP tile area")
    return enumerate(v.array("I", n, 16))


def tmp_ra(data: bytes, **_: object) -> Iterator[dict]:
    """Offset 0 is an empty place of the grid."""
    v = View(data, "TMP tiles")
    image_w, image_h, w, h = v.fields("<4I")
    need(w > 0 and h > 0, "size", "TMP tile", 0, 1)
    cols = image_w // w
    for i, at in _grid(v, cols, image_h // h, w * h):
        yield {"idx": i, "col": i % cols, "row": i // cols, "width": w, "height": h, "pixels": v.take(at, w * h) if at else None}


def tmp_ts(data: bytes, **_: object) -> Iterator[dict]:
    """Isometric tiles, some with what stands over them and their depth."""
    v = View(data, "TMP tiles")
    w, h, cols, rows = v.fields("<4I")
    need(w > 0 and h > 0, "size", "TMP tile", 0, 1)
    size = w * h // 2
    for i, at in _grid(v, cols, rows, size):
        row = {"idx": i, "col": i % cols, "row": i // cols, "width": w, "height": h}
        if at:
            _x, _y, extra_w, extra_h, flags, level, terrain, ramp = v.fields("<iiIIIBBB", at)
            pos = at + 52
            row |= {"pixels": v.take(pos, size), "level": level, "terrain": terrain, "ramp": ramp}
            pos += size
            if flags & 1 and extra_w and extra_h:
                row["extra"] = v.take(pos, _area(extra_w, extra_h, 1 << 16, "TMP extra area"))
                pos += extra_w * extra_h
            if flags & 2:
                row["depth"] = v.take(pos, size)
        yield row


def fnt(data: bytes, **_: object) -> Iterator[dict]:
    """Glyphs of four-bit pixels."""
    v = View(data, "FNT glyphs")
    h = v.record("<HBB6HBBBB", "length compress blocks info offsets widths data heights unknown pad last height width")
    need(h["compress"] == 0, "magic", "FNT compression", h["compress"], 0)
    need(h["blocks"] == 5, "magic", "FNT blocks", h["blocks"], 5)
    n = h["last"] + 1
    widths, heights, offsets = v.take(h["widths"], n), v.array("H", n, h["heights"]), v.array("H", n, h["offsets"])
    for i, (width, tall, at) in enumerate(zip(widths, heights, offsets, strict=True)):
        rows = tall >> 8
        yield {"code": i, "width": width, "y_offset": tall & 255, "data_rows": rows, "data": v.take(at, -(-width // 2) * rows) if width and rows else b""}


def glyph_pixels(data: bytes, width: int, rows: int) -> np.ndarray:
    """Low half byte first."""
    x = np.frombuffer(data, np.uint8).reshape(rows, -(-width // 2)) if data else np.zeros((rows, 0), np.uint8)
    return np.stack([x & 15, x >> 4], 2).reshape(rows, -1)[:, :width]


def cps(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "CPS screen")
    file_size, kind, size, colours = v.fields("<HHIH")
    need(kind in (0, 4), "magic", "CPS compression", kind, 4)
    capped(size, 262_144, "CPS pixels")
    need(colours in (0, 768), "size", "CPS palette", colours, 768)
    palette = v.take(10, colours) or None
    body = 10 + colours
    yield {"file_size": file_size, "compression": kind, "palette": palette, "pixels": lcw_decompress(data[body:], size) if kind else v.take(body, size)}


def icn(data: bytes, tileWidth: int = 16, tileHeight: int = 16, **_: object) -> Iterator[dict]:  # noqa: N803
    area = int(tileWidth) * int(tileHeight)
    need(area > 0 and len(data) % area == 0, "size", "ICN bytes", len(data), area)
    for i in range(len(data) // area):
        yield {"idx": i, "pixels": data[i * area : (i + 1) * area]}


def icon_map(data: bytes, **_: object) -> Iterator[dict]:
    need(len(data) % 2 == 0, "size", "ICON.MAP bytes", len(data), 2)
    for i, (tile,) in enumerate(struct.iter_unpack("<H", data)):
        yield {"idx": i, "tile": tile}


def bin_grid(data: bytes, width: int = 64, height: int = 64, **_: object) -> Iterator[dict]:
    width, height = int(width), int(height)
    need(len(data) == 2 * width * height, "size", "BIN bytes", len(data), 2 * width * height)
    for i in range(width * height):
        yield {"x": i % width, "y": i // width, "template_type": data[2 * i], "template_icon": data[2 * i + 1]}


def dds(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "DDS header")
    need(v.take(0, 4) == b"DDS ", "magic", "DDS header")
    size, flags, height, width, pitch, depth, mips = v.fields("<7I", 4)
    need(size == 124, "size", "DDS header", size, 124)
    pf_size, pf_flags, four, bits = v.fields("<II4sI", 76)
    need(pf_size == 32, "size", "DDS pixel format", pf_size, 32)
    ten = v.fields("<5I", 128) if four == b"DX10" else None
    yield {"width": width, "height": height, "depth": depth, "mip_levels": mips, "flags": flags, "four_cc": four.decode("ascii", "replace") if pf_flags & 4 else None, "bits": bits, "compressed": bool(pf_flags & 4), "dxgi_format": ten[0] if ten else None, "data_offset": 148 if ten else 128, "data_size": len(data) - (148 if ten else 128)}


def tga(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "TGA header")
    h = v.record("<BBBHHBHHHHBB", "id map kind first length entry x y width height bits descriptor")
    need(h["kind"] in (0, 1, 2, 3, 9, 10, 11), "magic", "TGA image type", h["kind"], 11)
    map_bytes = h["length"] * -(-h["entry"] // 8) if h["map"] else 0
    start = 18 + h["id"] + map_bytes
    v.take(0, start)
    body = h["width"] * h["height"] * -(-h["bits"] // 8)
    if h["kind"] in (1, 2, 3):
        v.take(start, body)
    yield {"image_type": h["kind"], "width": h["width"], "height": h["height"], "bits": h["bits"], "rle": h["kind"] >= 9, "alpha_bits": h["descriptor"] & 15, "color_map_length": h["length"], "data_offset": start, "data_size": body if 1 <= h["kind"] <= 3 else len(data) - start, "footer": data[-18:] == b"TRUEVISION-XFILE.\0"}


def compact_codebook(indexes: np.ndarray, fill: int) -> list[int]:
    """Code words in the order of use, most used first; those of `fill` are plain colours."""
    used, counts = np.unique(indexes[indexes >> 8 != fill], return_counts=True)
    return used[np.argsort(-counts, kind="stable")].tolist()


def first_colours(pixels: np.ndarray, most: int = 256) -> list[tuple[int, ...]]:
    """Different colours in the order in which they are first seen."""
    out: dict[tuple[int, ...], None] = {}
    for c in map(tuple, pixels.reshape(-1, pixels.shape[-1]).tolist()):
        out.setdefault(c)
        if len(out) > most:
            raise DecodeError("size", "colours", len(out), most)
    return list(out)
