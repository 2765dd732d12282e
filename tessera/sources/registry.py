"""Every format by name: its decoder, the schema of its rows, and what it is taken for by content."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tessera.functions.codecs import lcw_decompress
from tessera.sources import archives, encoding, images, media, models, texts
from tessera.sources.binary import DecodeError
from tessera.streaming import players


@dataclass(frozen=True)
class Format:
    name: str
    decode: Callable[..., Iterator[dict]]
    schema: str
    archive: bool = False


def _all() -> dict[str, Format]:
    a, i, m, o, t = archives, images, media, models, texts
    rows = [
        Format("mix", a.mix, a.ENTRY, True), Format("big", a.big, a.ENTRY, True), Format("meg", a.meg, a.ENTRY, True), Format("pak", a.pak, a.ENTRY, True), Format("iso", a.iso, a.ENTRY, True),
        Format("bag-idx", a.idx, a.AUDIO_ENTRY), Format("lmd", a.names_blob, "idx int, name string, description string"), Format("cnfm", a.cnfm, "idx int, crc long, type_hint int, name string"),
        Format("ini", t.ini, "section string, key string, value string, pos int"), Format("miniyaml", t.miniyaml, t.NODE), Format("eng", t.eng, "idx int, offset int, text string"),
        Format("dip", t.dip, "idx int, offset int, size int, text string, data binary"), Format("csf", t.csf, "label string, idx int, value string, values array<string>, extra string, version long, language long"),
        Format("str", t.string_file, "id string, value string, pos int"), Format("wnd", t.wnd, "version int, node_id int, parent_id int, depth int, key string, value string, ordinal int"),
        Format("mpr", t.map_text, _MAP), Format("map_ra2", t.map_text, _MAP), Format("apt_const", t.apt_const, "idx int, text string"),
        Format("pal", i.pal, "idx int, r int, g int, b int"), Format("lut", i.lut, "idx int, x int, y int, value int"), Format("vqp", i.vqp, "idx int, packed binary"),
        Format("shp", i.shp, i.FRAME), Format("shp_ts", i.shp_ts, i.FRAME), Format("shp_d2", i.shp_d2, i.FRAME), Format("wsa", i.wsa, i.FRAME),
        Format("tmp", i.tmp_td, i.TILE), Format("tmp_ra", i.tmp_ra, i.TILE), Format("tmp_ts", i.tmp_ts, i.TILE), Format("fnt", i.fnt, "code int, width int, y_offset int, data_rows int, data binary"),
        Format("cps", i.cps, "file_size int, compression int, palette binary, pixels binary"), Format("icn", i.icn, "idx int, pixels binary"), Format("icon_map", i.icon_map, "idx int, tile int"),
        Format("bin", i.bin_grid, "x int, y int, template_type int, template_icon int"),
        Format("dds", i.dds, "width long, height long, depth long, mip_levels long, flags long, four_cc string, bits long, compressed boolean, dxgi_format long, data_offset long, data_size long"),
        Format("tga", i.tga, "image_type int, width int, height int, bits int, rle boolean, alpha_bits int, color_map_length int, data_offset long, data_size long, footer boolean"),
        Format("hva", o.hva, "file_name string, frame int, section int, section_name string, matrix array<float>"),
        Format("vxl", o.vxl, "limb int, name string, number long, palette_count long, remap_start int, remap_end int, span_start long, span_end long, span_data long, det float, matrix array<float>, bounds array<float>, size_x int, size_y int, size_z int, normals int"),
        Format("w3d", o.w3d, "node_id int, parent_id int, depth int, ordinal int, chunk_type long, data binary"), Format("map_sage", o.map_sage, "idx int, name string, version long, data binary"),
        Format("apt", o.apt, "idx int, data_offset long, entry_offset long, fields array<long>"),
        Format("d2_map", o.d2_map, "lose_flags int, win_flags int, map_seed int, time_limit int, cursor_x int, cursor_y int, map_scale int, house int, house_name string, placements binary"),
        Format("aud", m.aud, "chunk int, sample_rate int, channels int, compression int, start_frame long, start_ns long, samples array<int>"),
        Format("wav", m.wav, "sample_rate int, frames long, samples array<float>"), Format("voc", m.voc, "idx int, version int, block_type int, offset long, size long, sample_rate long, data binary"),
        Format("vqa", m.vqa, "frame int, timestamp_ns long, width int, height int, pixels binary, palette binary"),
        Format("aud_stream", players.aud_stream, "chunk int, sample_rate int, channels int, start_frame long, samples array<int>, after_damage boolean"),
        Format("vqa_stream", players.vqa_stream, "frame int, timestamp_ns long, width int, height int, pixels binary, palette binary, samples array<int>"),
        Format("vqa_chunks", m.vqa_chunks, "idx int, fourcc string, offset long, size long, num_frames int, width int, height int, fps int"),
        Format("mid", m.midi, "track int, idx int, tick long, status int, channel int, meta int, data binary, division int, format int"),
        Format("xmi", m.xmi, "idx int, timbres array<struct<patch:int,bank:int>>, events binary"),
        Format("adl", m.adl, "kind string, idx int, registers binary, speed int, program int, offset long, writes binary"),
        Format("notes", m.transcribed, "idx int, note int, onset double, duration double, velocity int"),
        Format("png", m.png, "width int, height int, rgba binary"), Format("gif", encoding.gif, "frame int, width int, height int, delay int, rgba binary"), Format("avi", m.avi, "frame int, width int, height int, micros_per_frame long, rgba binary"),
    ]
    return {f.name: f for f in rows}


_MAP = "name string, author string, theater string, x long, y long, width long, height long, pack string, pack_bytes binary, overlay string"
FORMATS = _all()


def parses(name: str, data: bytes, **options: object) -> bool:
    try:
        for _ in FORMATS[name].decode(data, **options):
            pass
    except (DecodeError, struct.error, ValueError, IndexError):
        return False
    return True


def _printable(data: bytes) -> int:
    return sum(33 <= x <= 126 or x in (32, 9, 10, 12, 13) for x in data)


def _looks_mix(d: bytes) -> bool:
    if len(d) < 100:
        return False
    n, flags, size = int.from_bytes(d[:2], "little"), int.from_bytes(d[2:4], "little"), int.from_bytes(d[2:6], "little")
    return 1 <= flags <= 3 if n == 0 else 6 + 12 * n <= len(d) and abs(6 + 12 * n + size - len(d)) <= 20


def _looks_aud(d: bytes) -> bool:
    return len(d) >= 12 and d[:2] != b"\0\0" and d[11] in (1, 99) and abs(12 + int.from_bytes(d[2:6], "little") - len(d)) <= 64


def _looks_eng(d: bytes) -> bool:
    if len(d) < 8 or not parses("eng", d):
        return False
    start = [x.encode()[:64] for x in (r["text"] for r in texts.eng(d)) if x][:8]
    return bool(start) and 10 * sum(_printable(x) for x in start) >= 9 * sum(map(len, start))


def _looks_shp(d: bytes) -> bool:
    try:
        head, frames = images.shp_index(d)
        return all(lcw_decompress(body, head["width"] * head["height"]) is not None for _k, _a, _r, body in frames)
    except DecodeError:
        return False


def _first(name: str, d: bytes) -> dict | None:
    try:
        return next(iter(FORMATS[name].decode(d)), None)
    except (DecodeError, struct.error):
        return None


#: In this order; the first that holds names the format.
PROBES: tuple[tuple[str, Callable[[bytes], bool]], ...] = (
    ("vqa", lambda d: d[:4] == b"FORM" and d[8:12] == b"WVQA"),
    ("big", lambda d: len(d) >= 16 and d[:4] in (b"BIGF", b"BIG4")),
    ("meg", lambda d: d[:4] in (b"\xff\xff\xff\xff", b"\xff\xff\xff\x8f") and d[4:8] == struct.pack("<I", 0x3F7D70A4)),
    ("vxl", lambda d: d[:16] == b"Voxel Animation\0"),
    ("csf", lambda d: d[:4] == b" FSC"),
    ("voc", lambda d: len(d) >= 26 and d[:20] == b"Creative Voice File\x1a"),
    ("dds", lambda d: len(d) >= 128 and d[:8] == b"DDS \x7c\0\0\0"),
    ("apt", lambda d: len(d) >= 8 and d[:4] == b"Apt\0"),
    ("map_sage", lambda d: d[:4] == b"CkMp"),
    ("jpg", lambda d: d[:3] == b"\xff\xd8\xff"),
    ("tga", lambda d: len(d) >= 44 and d[-18:] == b"TRUEVISION-XFILE.\0"),
    ("mix", _looks_mix),
    ("ini", lambda d: bool(d) and _printable(d[:4096]) >= len(d[:4096]) * 9 // 10 and b"[" in d[:4096]),
    ("fnt", lambda d: parses("fnt", d)),
    ("dip", lambda d: _holds(texts.dip_sections, d)),
    ("lut", lambda d: parses("lut", d)),
    ("shp_ts", lambda d: _holds(images.shp_ts_heads, d)),
    ("pal", lambda d: len(d) == 768 and max(d) <= 63),
    ("vqp", lambda d: len(d) >= 4 and len(d) == 4 + int.from_bytes(d[:4], "little") * images.TRIANGLE),
    ("eng", _looks_eng),
    ("cps", lambda d: len(d) >= 10 and d[6:8] in (b"\0\0", b"\4\0") and parses("cps", d)),
    ("shp", _looks_shp),
    ("wsa", lambda d: _holds(images.wsa_index, d)),
    ("aud", _looks_aud),
    ("w3d", lambda d: len(d) >= 8 and _first("w3d", d) is not None and parses("w3d", d)),
    ("hva", lambda d: len(d) >= 24 and _first("hva", d) is not None and parses("hva", d)),
    ("tga", lambda d: len(d) >= 18 and d[2] in (1, 2, 3, 9, 10, 11) and all(0 < int.from_bytes(d[k : k + 2], "little") <= 16384 for k in (12, 14))),
)


def _holds(parse: Callable[[bytes], object], data: bytes) -> bool:
    try:
        parse(data)
    except DecodeError:
        return False
    return True


def sniff(data: bytes) -> str | None:
    return next((name for name, holds in PROBES if holds(data)), None)
