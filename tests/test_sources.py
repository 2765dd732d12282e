import struct

import numpy as np
import pytest

from tessera.functions.codecs import lcw_compress
from tessera.plans import verbs
from tessera.sources import archives, images, media, models, reading, texts
from tessera.sources.binary import DecodeError
from tessera.sources.registry import FORMATS, sniff

CHUNK = lambda name, body: name + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def vqa_file(frames: int = 2) -> bytes:
    head = struct.pack("<5H4B6HBB", 2, 1, frames, 8, 4, 4, 4, 15, 8, 0, 0, 0, 0, 0, 22050, 1, 16) + bytes(14)
    book = bytes(range(16)) + bytes([9]) * 16
    picture = CHUNK(b"CBF0", book) + CHUNK(b"CPL0", bytes(range(48)) * 16) + CHUNK(b"VPT0", bytes([1, 7, 0, 255]))
    body = CHUNK(b"VQHD", head) + b"".join(CHUNK(b"VQFR", picture) + CHUNK(b"SND0", struct.pack("<4h", 1, 2, 3, 4)) for _ in range(frames))
    return b"FORM" + struct.pack(">I", 4 + len(body)) + b"WVQA" + body


FILES = {
    "mix": archives.encode_mix({0x54C2D545: b"names", 5: b"abc", 0xF0000001: b"defg"}),
    "big": b"BIGF" + struct.pack("<I", 36) + struct.pack(">II", 1, 31) + struct.pack(">II", 31, 5) + b"a\\b.ini"[:6] + b"\0" + b"hello",
    "pak": struct.pack("<I", 23) + b"A.TXT\0" + struct.pack("<I", 26) + b"B.TXT\0" + b"\0\0\0" + b"abcdefg",
    "bag-idx": struct.pack("<16s5I", b"sound", 0, 4, 22050, 1, 0),
    "ini": b"[General]\r\nName = x ; no\r\nname=y\r\n[bad\r\nk=v\r\n[general]\r\nZ=1\r\n",
    "miniyaml": b"e1:\n\tHealth:\n\t\tHP: 100 # note\n\tColor: \\#fff\nempty:\n",
    "eng": texts.encode_eng([b"", b"Sell", b"Mission Failed"]),
    "str": b'GUI:Ok\n"OK"\nEND\n; note\nGUI:No\n"No"\nend\n',
    "wnd": b"FILE_VERSION = 2;\nWINDOW\n  NAME = a;\n  CHILD\n  WINDOW\n    NAME = b;\n  END\n  ENDALLCHILDREN\nEND\n",
    "csf": b" FSC" + struct.pack("<5I", 3, 1, 1, 0, 0) + b" LBL" + struct.pack("<II", 1, 2) + b"Ok" + b"STRW" + struct.pack("<I", 2) + bytes(x ^ 255 for x in "OK".encode("utf-16-le")) + struct.pack("<I", 3) + b"btn",
    "pal": bytes([63, 0, 1]) * 256,
    "lut": b"".join(bytes([i % 64, i // 64 % 64, i // 256 % 16]) for i in range(4096)),
    "vqp": struct.pack("<I", 1) + bytes(images.TRIANGLE),
    "shp": images.encode_shp([bytes(16), bytes(range(16))], 4, 4),
    "shp_ts": struct.pack("<4H", 0, 2, 2, 1) + struct.pack("<4HB3s4s4sI", 0, 0, 2, 2, 0, b"", b"", b"", 32) + b"abcd",
    "shp_d2": struct.pack("<H", 1) + struct.pack("<3I", 12, 26, 0) + struct.pack("<HBHBHH", 2, 2, 2, 2, 14, 4) + b"wxyz",
    "wsa": images.encode_wsa([bytes([1]) * 6, bytes(range(6))], 3, 2),
    "tmp": images.encode_tmp_td([bytes([1]) * 4, bytes([2]) * 4], 2, 2),
    "tmp_ra": struct.pack("<4I2I", 4, 2, 2, 2, 0, 24) + b"abcd",
    "tmp_ts": struct.pack("<4II", 4, 2, 1, 1, 20) + struct.pack("<iiIIIBBB", 0, 0, 1, 2, 3, 1, 2, 3).ljust(52, b"\0") + b"isop" + b"ex" + b"dept",
    "fnt": struct.pack("<HBB6HBBBB", 40, 0, 5, 14, 22, 20, 30, 26, 0, 0, 1, 2, 3) + bytes([3, 0]) + struct.pack("<HH", 30, 30) + struct.pack("<HH", 0x0201, 0) + b"\x21\x03\x54\x06",
    "cps": struct.pack("<HHIH", 0, 4, 10, 0) + lcw_compress(bytes([5]) * 10),
    "bin": bytes(8192),
    "icon_map": struct.pack("<3H", 1, 2, 3),
    "dds": (b"DDS " + struct.pack("<7I", 124, 0, 4, 8, 0, 0, 1) + bytes(44) + struct.pack("<II4sI", 32, 4, b"DXT1", 0)).ljust(128, b"\0"),
    "tga": struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 1, 24, 0) + b"bgr",
    "hva": struct.pack("<16sII", b"x.hva", 2, 1) + b"body".ljust(16, b"\0") + struct.pack("<24f", *range(24)),
    "vxl": (b"Voxel Animation\0" + struct.pack("<4IBB", 1, 1, 1, 2, 0, 0)).ljust(804, b"\0") + struct.pack("<16sIII", b"turret", 0, 1, 0) + b"zz" + struct.pack("<3If18f4B", 0, 1, 2, 1.0, *range(18), 3, 4, 5, 2),
    "w3d": struct.pack("<II", 0, 0x80000000 | 12) + struct.pack("<II", 0x1F, 4) + b"mesh" + struct.pack("<II", 0x200, 0),
    "map_sage": b"CkMp" + struct.pack("<I", 4) + b"Head" + struct.pack("<II", 1, 3) + b"abc",
    "apt": b"Apt\0" + struct.pack("<II5I", 8, 1, 1, 2, 3, 4, 5),
    "d2_map": struct.pack("<8H", 1, 2, 3, 4, 5, 6, 1, 2) + b"rest",
    "aud": media.build_aud([0, 100, 200, 300] * 50, 22050),
    "voc": b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x010A, (~0x010A + 0x1234) & 0xFFFF) + bytes([1, 4, 0, 0, 156, 0, 1, 2, 0]),
    "vqa": vqa_file(),
    "mid": media.notes_to_smf([{"note": 69, "onset": 0.0, "duration": 0.5, "velocity": 90}]),
    "xmi": b"FORM" + struct.pack(">I", 4 + 16) + b"XMID" + CHUNK(b"EVNT", b"\x90\x45\x5a\x0a\x0a\xff\x2f\x00"),
    "adl": bytes([0, 0, 5, 0]) + b"\x20\x01\x40\x02",
}


def rows(name, data=None, **options):
    return list(FORMATS[name].decode(FILES[name] if data is None else data, **options))


@pytest.mark.parametrize("name", sorted(FILES))
def test_decodes_and_damaged_files_only_raise_decode_errors(name):
    assert rows(name)
    data = FILES[name]
    for bad in (b"", data[: len(data) // 2], data[:5], b"\xff" * 64, bytes(64)):
        try:
            rows(name, bad)
        except DecodeError:
            pass


def test_archives():
    found = rows("mix")
    assert [r["crc"] for r in found] == [5, 0x54C2D545, 0xF0000001]
    assert [FILES["mix"][r["offset"] : r["offset"] + r["size"]] for r in found] == [b"abc", b"names", b"defg"]
    assert rows("pak")[0]["size"] == 3 and rows("pak")[1]["offset"] == 26
    assert rows("big")[0]["name"] == "a\\b.in" and rows("big")[0]["size"] == 5
    assert rows("bag-idx")[0]["sample_rate"] == 22050
    blob = archives.encode_cnfm([{"crc": 7, "type_hint": 1, "name": "a.shp"}])
    assert rows("cnfm", blob) == [{"idx": 0, "crc": 7, "type_hint": 1, "name": "a.shp"}]


def test_meg_legacy():
    names = struct.pack("<H", 5) + b"a.txt"
    table = struct.pack("<5I", 1, 0, 3, 8 + len(names) + 20, 0)
    data = struct.pack("<II", 1, 1) + names + table + b"xyz"
    assert rows("meg", data) == [{"idx": 0, "name": "a.txt", "crc": 1, "offset": 35, "size": 3}]


def test_iso():
    record = lambda name, lba, size, flags: (bytes([33 + len(name) + (1 - len(name) % 2), 0]) + struct.pack("<I", lba) + bytes(4) + struct.pack("<I", size) + bytes(11) + bytes([flags]) + bytes(6) + bytes([len(name)]) + name).ljust(33 + len(name) + (1 - len(name) % 2), b"\0")
    root = record(b"\0", 18, 2048, 2)
    pvd = (b"\1CD001\1".ljust(128, b"\0") + struct.pack("<H", 2048)).ljust(156, b"\0") + root
    directory = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"SUB", 19, 2048, 2) + record(b"A.TXT;1", 20, 3, 0)
    sub = record(b"B.;1", 20, 2, 0)
    data = bytes(16 * 2048) + pvd.ljust(4096, b"\0") + directory.ljust(2048, b"\0") + sub.ljust(2048, b"\0") + b"abc".ljust(2048, b"\0")
    assert [(r["name"], r["size"]) for r in rows("iso", data)] == [("A.TXT", 3), ("SUB/B", 2)]


def test_texts():
    assert rows("ini") == [{"section": "General", "key": "name", "value": "y", "pos": 0}, {"section": "General", "key": "k", "value": "v", "pos": 1}, {"section": "General", "key": "Z", "value": "1", "pos": 2}]
    tree = rows("miniyaml")
    assert [(r["depth"], r["key"], r["value"], r["parent_id"]) for r in tree] == [(0, "e1", None, None), (1, "Health", None, 0), (2, "HP", "100", 1), (1, "Color", "#fff", 0), (0, "empty", None, None)]
    with pytest.raises(DecodeError):
        rows("miniyaml", b"a:\n  b: 1\n")
    assert [r["text"] for r in rows("eng")] == ["", "Sell", "Mission Failed"]
    assert [(r["id"], r["value"]) for r in rows("str")] == [("GUI:Ok", "OK"), ("GUI:No", "No")]
    csf = rows("csf")[0]
    assert (csf["label"], csf["value"], csf["extra"], csf["version"]) == ("Ok", "OK", "btn", 3)
    assert [(r["node_id"], r["parent_id"], r.get("key"), r.get("value")) for r in rows("wnd")] == [(0, None, None, None), (0, None, "NAME", "a"), (1, 0, None, None), (1, 0, "NAME", "b")]
    m = rows("map_ra2", b"[Basic]\nName=m\nAuthor=a\n[Map]\nSize=0,0,50,60\nTheater=SNOW\n[IsoMapPack5]\n2=Yg==\n1=YWFh\n")[0]
    assert (m["name"], m["width"], m["theater"], m["pack"]) == ("m", 50, "SNOW", "YWFhYg==")


def test_images():
    assert [r["pixels"] for r in rows("shp")] == [bytes(16), bytes(range(16))]
    assert rows("shp_ts")[0]["pixels"] == b"abcd" and rows("shp_d2")[0]["pixels"] == b"wxyz"
    assert [r["pixels"] for r in rows("wsa")] == [bytes([1]) * 6, bytes(range(6))]
    assert rows("tmp_ra")[0]["pixels"] is None and rows("tmp_ra")[1]["pixels"] == b"abcd"
    ts = rows("tmp_ts")[0]
    assert (ts["pixels"], ts["extra"], ts["depth"], ts["terrain"]) == (b"isop", b"ex", b"dept", 2)
    g = rows("fnt")[0]
    assert images.glyph_pixels(g["data"], g["width"], g["data_rows"]).tolist() == [[1, 2, 3], [4, 5, 6]]
    assert rows("cps")[0]["pixels"] == bytes([5]) * 10
    assert images.rgb(bytes([63] * 3)).tolist() == [[252] * 3] and images.rgb(bytes([63] * 3), True).tolist() == [[255] * 3]


def test_models():
    assert rows("hva")[1]["matrix"][0] == 12.0
    assert rows("vxl")[0]["name"] == "turret" and rows("vxl")[0]["size_z"] == 5
    assert [(r["depth"], r["parent_id"], r["chunk_type"], r["data"]) for r in rows("w3d")] == [(0, None, 0, None), (1, 0, 0x1F, b"mesh"), (0, None, 0x200, b"")]
    assert models.triangles(struct.pack("<4I4f", 1, 2, 3, 4, 0, 0, 1, 2))[0]["vertices"] == (1, 2, 3)
    assert rows("d2_map")[0]["house_name"] == "Ordos"


def test_video_and_music():
    v = rows("vqa")
    first = np.frombuffer(v[0]["pixels"], np.uint8).reshape(4, 8)
    assert len(v) == 2 and (first[:, :4] == 9).all() and (first[:, 4:] == 7).all()
    assert media.vqa_audio(FILES["vqa"]) == ([1, 2, 3, 4] * 2, 22050, 1)
    assert rows("vqa", startFrame=1)[0]["frame"] == 1
    notes = [r for r in rows("mid") if r["status"] >> 4 in (8, 9)]
    assert [(r["tick"], r["status"] >> 4, r["data"][0]) for r in notes] == [(0, 9, 69), (480, 8, 69)]
    mid = media.xmi_to_mid(rows("xmi")[0]["events"])
    assert [(r["tick"], r["status"]) for r in FORMATS["mid"].decode(mid) if r["meta"] is None] == [(0, 0x90), (10, 0x80)]
    t = np.arange(22050) / 22050
    tone = media.wav_of((np.sin(2 * np.pi * 440 * t) * 20000).astype(int).tolist(), 22050, 1)
    assert [n["note"] for n in media.transcribed(tone)] == [69]
    assert list(media.transcribed(media.wav_of([0] * 22050, 22050, 1))) == []
    assert media.samples_per_frame(100, 3, 100, 30) == [(0, 3), (3, 3), (6, 4)]


def test_pictures_round_trip():
    x = np.random.default_rng(0).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (media.png_pixels(media.png_of(x)) == x).all()
    frames = list(media.avi(media.avi_of([x[..., :3]] * 2, 10, [1, 2, 3, 4], 20)))
    assert len(frames) == 2 and (np.frombuffer(frames[0]["rgba"], np.uint8).reshape(5, 7, 4)[..., :3] == x[..., :3]).all()


def test_sniff():
    for name in ("big", "vxl", "csf", "voc", "dds", "apt", "vqa", "pal", "lut", "aud", "fnt", "vqp", "hva"):
        assert sniff(FILES[name]) == name, name
    assert sniff(FILES["shp"]) == "shp" and sniff(FILES["wsa"]) in ("wsa", "shp") and sniff(b"") is None


def test_spark_reads_and_verbs(spark, tmp_path):
    for name in ("mix", "ini", "shp", "pal"):
        (tmp_path / f"x.{name}").write_bytes(FILES[name])
    (tmp_path / "bad.pal").write_bytes(b"short")
    at = str(tmp_path)
    assert reading.read_format(spark, "shp", at, "*.shp").count() == 2
    errors = reading.read_format(spark, "pal", at, "*.pal").where("_error is not null").select("path", "_error.kind").collect()
    assert len(errors) == 1 and errors[0]["kind"] == "size"
    names = verbs.name_map(spark.createDataFrame([("local mix database.dat",), ("# no",)], "name string"))
    listed = {r["crc"]: r["name"] for r in verbs.list_entries(reading.files(spark, at, "*.mix"), "mix", names).collect()}
    assert listed == {5: "(unknown)", 0x54C2D545: "local mix database.dat", 0xF0000001: "(unknown)"}
    got = {r["name"]: bytes(r["payload"]) for r in verbs.extract(reading.files(spark, at, "*.mix"), "mix", names).collect()}
    assert got["local mix database.dat"] == b"names" and got["00000005.bin"] == b"abc"
    assert {r["format"] for r in verbs.identify(reading.files(spark, at)).collect()} >= {"ini", "shp", "pal"}
    assert {r["ok"] for r in verbs.validate(reading.files(spark, at, "*.pal")).collect()} == {True, False}
    assert verbs.check(reading.files(spark, at, "*.mix"), "mix").first()["verdict"] == "OK"
    made = verbs.convert(reading.files(spark, at, "*.shp"), "shp", "png", FILES["pal"]).collect()
    assert len(made) == 2 and bytes(made[0]["data"]).startswith(b"\x89PNG")
    reading.register_sources(spark)
    assert spark.read.format("tessera_ini").load(f"{at}/x.ini").count() == 3
