"""Models, maps and movies: transforms, limbs, chunk trees and headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tessera.sources.binary import View, capped, fixed_text, lossy, need


def hva(data: bytes, **_: object) -> Iterator[dict]:
    """A 3 x 4 matrix per frame and section."""
    v = View(data, "HVA")
    name, frames, sections = v.fields("<16sII")
    capped(sections, 512, "HVA sections")
    capped(frames, 65_536, "HVA frames")
    names = [fixed_text(v.take(24 + 16 * i, 16)) for i in range(sections)]
    body = v.take(24 + 16 * sections, 48 * frames * sections)
    for i, m in enumerate(struct.iter_unpack("<12f", body)):
        yield {"file_name": fixed_text(name), "frame": i // sections, "section": i % sections, "section_name": names[i % sections], "matrix": list(m)}


def vxl(data: bytes, **_: object) -> Iterator[dict]:
    """Limbs with their spans' places, bounds and sizes."""
    v = View(data, "VXL")
    _kind, palettes, limbs, tails, body, first, last = v.fields("<16s4IBB")
    capped(limbs, 512, "VXL limbs")
    capped(tails, 512, "VXL tails")
    v.take(0, 804)
    start = 804 + 28 * limbs
    v.take(start, body)
    for i in range(limbs):
        name, number, u1, u2 = v.fields("<16sIII", 804 + 28 * i)
        row = {"limb": i, "name": fixed_text(name) or "", "number": number, "palette_count": palettes, "remap_start": first, "remap_end": last}
        if i < tails:
            at = start + body + 92 * i
            (a, b, c, det), m, bounds, size = v.fields("<3If", at), v.array("f", 12, at + 16), v.array("f", 6, at + 64), v.take(at + 88, 4)
            row |= {"span_start": a, "span_end": b, "span_data": c, "det": det, "matrix": list(m), "bounds": list(bounds), "size_x": size[0], "size_y": size[1], "size_z": size[2], "normals": size[3]}
        yield row


def w3d(data: bytes, **_: object) -> Iterator[dict]:
    """Chunks of a tree, parents before children; bit 31 of a chunk's size says that it holds others."""
    v, count = View(data, "W3D chunk"), 0
    todo: list[list[int]] = [[0, len(data), -1, 0]]  # place, end, parent, ordinal
    while todo:
        at, end, parent, ordinal = todo[-1]
        if at + 8 > end:
            todo.pop()
            continue
        kind, raw = v.fields("<II", at)
        size = capped(raw & 0x7FFFFFFF, 64 << 20, "W3D chunk")
        need(at + 8 + size <= end, "eof", "W3D chunk", at + 8 + size, end)
        capped(count + 1, 100_000, "W3D chunks")
        todo[-1][0], todo[-1][3] = at + 8 + size, ordinal + 1
        holds = bool(raw >> 31)
        yield {"node_id": count, "parent_id": None if parent < 0 else parent, "depth": len(todo) - 1, "ordinal": ordinal, "chunk_type": kind, "data": None if holds else v.take(at + 8, size)}
        if holds:
            capped(len(todo), 32, "W3D depth")
            todo.append([at + 8, at + 8 + size, count, 0])
        count += 1


def mesh_header(data: bytes) -> dict:
    v = View(data, "W3D mesh header")
    version, attributes, name, container, tris, vertices, materials = v.fields("<II16s16sIII")
    return {"version": version, "attributes": attributes, "name": fixed_text(name) or "", "container": fixed_text(container) or "", "triangles": tris, "vertices": vertices, "materials": materials, "bounds": list(v.array("f", 10, 76))}


def vertices(data: bytes) -> list[tuple[float, float, float]]:
    return list(struct.iter_unpack("<3f", data[: len(data) // 12 * 12]))


def triangles(data: bytes) -> list[dict]:
    return [{"vertices": t[:3], "attributes": t[3], "normal": t[4:], "material": 0} for t in struct.iter_unpack("<4I4f", data[: len(data) // 32 * 32])]


def map_sage(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "SAGE map")
    if data[:4] == b"EAR\0":
        need(v.take(14, 4) == b"CkMp", "magic", "SAGE map inside")
        at = 18
    else:
        need(v.take(0, 4) == b"CkMp", "magic", "SAGE map header")
        at = 4
    i = 0
    while at < len(data):
        n = capped(v.u32(at), 256, "SAGE chunk name")
        name = lossy(v.take(at + 4, n))
        version, size = v.fields("<II", at + 4 + n)
        at += 12 + n
        yield {"idx": i, "name": name, "version": version, "data": v.take(at, capped(size, 64 << 20, "SAGE chunk"))}
        at += size
        i = capped(i + 1, 4096, "SAGE chunks")


def apt(data: bytes, **_: object) -> Iterator[dict]:
    v = View(data, "APT")
    need(v.take(0, 4) == b"Apt\0", "magic", "APT header")
    start = v.u32(4)
    n = capped(v.u32(start), 4096, "APT movies")
    for i, fields in enumerate(struct.iter_unpack("<5I", v.take(start + 4, 20 * n))):
        yield {"idx": i, "data_offset": start, "entry_offset": fields[0], "fields": list(fields[1:])}


# Houses by their number.
HOUSES = ("Harkonnen", "Atreides", "Ordos", "Fremen", "Sardaukar", "Mercenary")


def d2_map(data: bytes, **_: object) -> Iterator[dict]:
    h = View(data, "scenario").record("<8H", "lose_flags win_flags map_seed time_limit cursor_x cursor_y map_scale house")
    capped(h["map_scale"], 2, "scenario scale")
    yield h | {"house_name": HOUSES[h["house"]] if h["house"] < len(HOUSES) else None, "placements": data[16:]}
