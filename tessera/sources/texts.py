"""Text and string-table formats, one row per string, line or node."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

from tessera.sources.binary import DecodeError, View, capped, lossy, need


def _lines(data: bytes) -> list[str]:
    return [x.removesuffix("\r") for x in lossy(data).split("\n")]


def _fold(s: str) -> str:
    """A-Z alone, as the formats do."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def ini(data: bytes, **_: object) -> Iterator[dict]:
    """section, key, value, pos. Names are compared without regard to A-Z; a key stays at its first place, with its last casing
    and value; a ; ends a line anywhere; a line that starts with [ and has no ] is skipped."""
    capped(len(data), 16 << 20, "INI bytes")
    found: dict[str, tuple[str, dict[str, list]]] = {}
    here: dict[str, list] | None = None
    for line in _lines(data):
        line = line.split(";", 1)[0].strip()
        if line.startswith("["):
            if "]" in line:
                name = line[1 : line.index("]")].strip()
                here = found.setdefault(_fold(name), (name, {}))[1]
                capped(len(found), 16_384, "INI sections")
        elif here is not None and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key:
                here.setdefault(_fold(key), [None, None])[:] = key, value
                capped(len(here), 4_096, "INI keys")
    for name, keys in found.values():
        for pos, (key, value) in enumerate(keys.values()):
            yield {"section": name, "key": key, "value": value, "pos": pos}


NODE = "node_id int, parent_id int, depth int, ordinal int, key string, value string"


def miniyaml(data: bytes, **_: object) -> Iterator[dict]:
    """Nodes of a tree indented by tabs. A # ends a line unless a backslash precedes it; a line that is indented by two steps more
    than the one above goes, with what is under it; spaces as the first indent are an error."""
    path: list[tuple[int, int]] = []  # node, children so far
    roots, count, dropped = 0, 0, None
    for line in _lines(data):
        line = re.sub(r"(?<!\\)#.*$", "", line).replace("\\#", "#")
        if not line.strip():
            continue
        need(not line.startswith(" "), "magic", "MiniYAML indent of spaces")
        depth = len(line) - len(line.lstrip("\t"))
        capped(depth, 64, "MiniYAML depth")
        if depth > len(path) or dropped is not None and depth > dropped:
            dropped = dropped if dropped is not None and depth > dropped else depth - 1
            continue
        dropped = None
        del path[depth:]
        key, colon, value = line.strip().partition(":")
        parent, ordinal = (None, roots) if not path else (path[-1][0], path[-1][1])
        if path:
            path[-1] = (path[-1][0], ordinal + 1)
        else:
            roots += 1
        capped(count + 1, 100_000, "MiniYAML nodes")
        yield {"node_id": count, "parent_id": parent, "depth": depth, "ordinal": ordinal, "key": key.strip(), "value": value.strip() or None}
        path.append((count, 0))
        count += 1


def eng(data: bytes, **_: object) -> Iterator[dict]:
    """Strings by 16-bit offsets, whose first one also gives the table's length."""
    v = View(data, "ENG strings")
    table = v.u16(0)
    need(2 <= table <= len(data) and table % 2 == 0, "size", "ENG table", table, len(data))
    before, rows = table, []
    for i, offset in enumerate(v.array("H", table // 2, 0)):
        need(table <= offset < len(data), "offset", "ENG string", offset, len(data))
        need(offset >= before, "offset", "ENG order", offset, before)
        before = offset
        rows.append({"idx": i, "offset": offset, "text": lossy(v.text0(offset))})
    yield from rows


def dip_sections(data: bytes) -> list[dict]:
    v = View(data, "DIP sections")
    n = v.u32(0)
    capped(n, 4_096, "DIP sections")
    head = 4 + 4 * n
    need(n > 0 and head <= len(data), "size", "DIP header", head, len(data))
    ends = [(x >> 16) << 16 | x & 0xFFFF for x in v.array("I", n, 4)]
    start, rows = head, []
    for i, end in enumerate(ends):
        need(start < end <= len(data) if i else start <= end <= len(data), "offset", "DIP section", end, len(data))
        rows.append({"idx": i, "offset": start, "size": end - start, "text": None, "data": v.take(start, end - start)})
        start = end
    tail = data[start:]
    need(len(tail) <= 2 and (len(tail) != 2 or int.from_bytes(tail, "little") >= 0x8000), "size", "DIP trailer", len(tail), 2)
    need(any(x >= 0x80 for x in data[head:start]), "magic", "DIP has no commands")
    return rows


def dip(data: bytes, **_: object) -> Iterator[dict]:
    """Sections, or else a string table."""
    try:
        yield from dip_sections(data)
    except DecodeError:
        yield from ({**r, "size": len(r["text"].encode()), "data": None} for r in eng(data))


def csf(data: bytes, **_: object) -> Iterator[dict]:
    """Labelled strings, whose UTF-16 bytes are inverted; of equal labels the last one counts."""
    v = View(data, "CSF strings")
    need(v.take(0, 4) == b" FSC", "magic", "CSF header")
    version, labels, _strings, _unused, language = v.fields("<5I", 4)
    at, rows = 24, {}
    for i in range(capped(labels, 100_000, "CSF labels")):
        need(v.take(at, 4) == b" LBL", "magic", "CSF label")
        pairs, n = v.fields("<II", at + 4)
        label = lossy(v.take(at + 12, capped(n, 4_096, "CSF label")))
        at += 12 + n
        values, extra = [], None
        for _k in range(capped(pairs, 4_096, "CSF strings")):
            kind, n = v.take(at, 4), v.u32(at + 4)
            need(kind in (b" STR", b"STRW", b" RTS"), "magic", "CSF string")
            values.append(bytes(x ^ 255 for x in v.take(at + 8, 2 * capped(n, 1 << 20, "CSF text"))).decode("utf-16-le", "replace"))
            at += 8 + 2 * n
            if kind == b"STRW":
                n = v.u32(at)
                extra = lossy(v.take(at + 4, capped(n, 1 << 20, "CSF extra")))
                at += 4 + n
        rows[label] = {"label": label, "idx": i, "value": values[0] if values else None, "values": values, "extra": extra, "version": version, "language": language}
    yield from rows.values()


def _said(data: bytes, context: str) -> list[str]:
    """Lines that say something: trimmed, neither blank nor starting with a semicolon."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        raise DecodeError("magic", f"{context} encoding") from None
    return [x for line in text.split("\n") if (x := line.strip()) and not x.startswith(";")]


def string_file(data: bytes, **_: object) -> Iterator[dict]:
    """Triples of an id, a text in quotes and END."""
    rest = _said(data, "STR")
    need(len(rest) % 3 == 0, "eof", "STR entry", len(rest), 3)
    for pos, (name, value, end) in enumerate(zip(rest[::3], rest[1::3], rest[2::3], strict=True)):
        need(len(value) >= 2 and value[0] == value[-1] == '"', "magic", "STR text without quotes")
        need(_fold(end) == "end", "magic", "STR without END")
        yield {"id": name, "value": value[1:-1], "pos": pos}


def wnd(data: bytes, **_: object) -> Iterator[dict]:
    """Windows of a layout: one row per window, with neither key nor value, and one per property of it, by its ordinal."""
    version, stack, count, child = None, [], 0, False
    for i, line in enumerate(_said(data, "WND")):
        word = line.upper()
        key, eq, value = line.partition("=")
        key, value = key.strip(), value.strip().removesuffix(";").strip()
        if i == 0 and eq and key.upper() == "FILE_VERSION":
            version = int(value) if value.isdigit() else None
        elif word == "WINDOW":
            need(not stack or child, "magic", "WND window inside another without CHILD")
            capped(len(stack) + 1, 64, "WND depth")
            yield {"version": version, "node_id": count, "parent_id": stack[-1][0] if stack else None, "depth": len(stack)}
            stack.append([count, 0])
            count, child = count + 1, False
        elif not stack:
            continue
        elif word == "END":
            stack.pop()
            child = False
        elif word == "ENDALLCHILDREN":
            child = False
        elif word == "ENDCHILD" or word == "CHILD" and child:
            raise DecodeError("magic", f"WND {word}")
        elif word == "CHILD":
            child = True
        elif eq and key:
            node, ordinal = stack[-1]
            stack[-1][1] += 1
            yield {"version": version, "node_id": node, "parent_id": stack[-2][0] if len(stack) > 1 else None, "depth": len(stack) - 1, "key": key, "value": value, "ordinal": ordinal}
    need(not stack, "eof", "WND window without END", len(stack), 0)


def map_text(data: bytes, **_: object) -> Iterator[dict]:
    """What the INI of a map says of it, and its terrain: numbered base64 lines, joined."""
    rows = list(ini(data))
    get = {(_fold(r["section"]), _fold(r["key"])): r["value"] for r in rows}
    pick = lambda s, k: get.get((s, k))
    size = pick("map", "size") or pick("map", "localsize")
    bounds = [int(x) for x in size.split(",")] if size and re.fullmatch(r"\s*\d+\s*(,\s*\d+\s*){3}", size) else None
    if bounds is None:
        four = [pick("map", k) for k in ("x", "y", "width", "height")]
        bounds = [int(x) for x in four] if all(x and x.strip().isdigit() for x in four) else [None] * 4
    packs = {}
    for name in ("mappack", "isomappack5", "overlaypack", "overlaydatapack"):
        lines = sorted(((int(k), v) for (s, k), v in get.items() if s == name and k.isdigit()), key=lambda x: x[0])
        packs[name] = "".join(v for _, v in lines) or None
    pack = packs["isomappack5"] or packs["mappack"]
    try:
        content = base64.b64decode(pack, validate=True) if pack else None
    except ValueError:
        content = None
    yield {"name": pick("basic", "name"), "author": pick("basic", "author"), "theater": pick("map", "theater"), "x": bounds[0], "y": bounds[1], "width": bounds[2], "height": bounds[3], "pack": pack, "pack_bytes": content, "overlay": packs["overlaypack"]}


def apt_const(data: bytes, **_: object) -> Iterator[dict]:
    for i, part in enumerate(x for x in data.split(b"\0") if x):
        try:
            yield {"idx": capped(i, 100_000, "APT strings"), "text": part.decode()}
        except UnicodeDecodeError:
            raise DecodeError("magic", "APT text") from None


def to_yaml(nodes: list[dict]) -> str:
    """MiniYAML rows as YAML text, two spaces a step."""
    plain = re.compile(r"[A-Za-z_./][\w ./^@+()-]*")
    word = lambda s: s if plain.fullmatch(s) and s == s.strip() and s.lower() not in ("true", "false", "yes", "no", "on", "off", "null") else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "".join("  " * n["depth"] + word(n["key"]) + ":" + (f" {word(n['value'])}" if n["value"] is not None else "") + "\n" for n in nodes)


def encode_eng(strings: list[bytes]) -> bytes:
    at, table, body = 2 * len(strings), b"", b""
    for s in strings:
        table += struct.pack("<H", at + len(body))
        body += s + b"\0"
    return table + body
