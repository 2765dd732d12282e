"""Streams against whole-file decoders; archives in place; lookups; conversions of many files."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import CHUNK, FILES, vqa_file

from tessera.operators import lookups
from tessera.operators import relational as R
from tessera.plans import verbs
from tessera.sources import archives, encoding, images, media, reading
from tessera.sources.binary import DecodeError
from tessera.sources.ranged import RangedFile, index_only, read_entries
from tessera.streaming.players import AudPlayer, VqaPlayer, aud_to_wav


def marked_aud(parts: list[bytes]) -> bytes:
    body = b"".join(struct.pack("<HHI", len(p), 4 * len(p), 0xDEAF) + p for p in parts)
    return struct.pack("<HIIBB", 22050, len(body), sum(4 * len(p) for p in parts), 2, 99) + body


def test_aud_player():
    for data in (FILES["aud"], marked_aud([bytes([17 * k % 256] * 40) for k in range(5)]), media.build_aud([(k * 37) % 3000 - 1500 for k in range(800)], 8000, True)):
        whole = media.aud_samples(data)
        for step in (1, 7, 1000):
            p, got = AudPlayer(io.BytesIO(data)), []
            while part := p.read(step):
                got += part
            assert got == whole
            p.rewind()
            assert p.read(len(whole)) == whole
        starts = [a for a, _ in AudPlayer(io.BytesIO(data)).chunks(64)]
        assert starts == list(range(0, len(whole) // (1 + (data[10] & 1)), 64))
        out = io.BytesIO()
        assert aud_to_wav(io.BytesIO(data), out) == len(whole) // (1 + (data[10] & 1)) and out.getvalue() == media.aud_to_wav(data)


def test_aud_resync():
    data = bytearray(marked_aud([bytes([k] * 40) for k in range(1, 5)]))
    data[12 + 48 + 4] ^= 1  # the second chunk's mark
    p = AudPlayer(io.BytesIO(bytes(data)))
    assert len(p.read(80)) == 80
    with pytest.raises(DecodeError):
        p.read(1)
    assert p.resync() and p.read(80) == media.aud_samples(marked_aud([bytes([3] * 40)]))
    assert not AudPlayer(io.BytesIO(FILES["aud"])).resync()


def test_vqa_player():
    data = vqa_file(4)
    whole, (sound, _rate, _channels) = list(media.vqa(data)), media.vqa_audio(data)
    p, frames = VqaPlayer(io.BytesIO(data)), []
    while f := p.next_frame():
        frames.append(f)
    assert [(r["frame"], r["pixels"], r["palette"]) for r in whole] == frames and p.queued_audio(99) == sound and p.queued_audio(1) == []
    p.rewind()
    assert p.audio(6) == sound[:6] and len(p.frames) == 2 and p.next_frame() == frames[0]
    buffer = bytearray(32)
    assert p.frame_into(buffer) == 1 and bytes(buffer) == frames[1][1]
    p.seek_frame(2)
    assert p.next_frame() == frames[2] and p.seek_time(10**12) == 3 and p.next_frame() == frames[3] and p.next_frame() is None
    with pytest.raises(DecodeError):
        p.seek_frame(4)
    p.rewind()
    assert sum((p.audio_of_frame() for _ in range(4)), []) == sound
    damaged = data[:54] + b"\0\0\xff" + data[54:]
    q = VqaPlayer(io.BytesIO(damaged))
    with pytest.raises(DecodeError):
        q.next_frame()
    q.file.seek(54)
    assert q.resync() and q.next_frame()[1:] == frames[0][1:]


def test_vqa_seek_points():
    index = CHUNK(b"FINF", struct.pack("<2I", 0x40000010, 0x20))
    data = vqa_file(2)
    data = data[:62] + index + data[62:]
    data = data[:4] + struct.pack(">I", len(data) - 8) + data[8:]
    assert VqaPlayer(io.BytesIO(data)).seek_points() == [{"frame": 0, "time_ns": 0, "flags": 4, "byte_offset": 32}, {"frame": 1, "time_ns": 10**9 // 15, "flags": 0, "byte_offset": 64}]


def test_archives_in_place(spark, tmp_path):
    big = {7: bytes(300_000), 9: b"tail" * 50_000, archives.NAMES_ENTRY: b"\1\0\0\0x.shp\0\0"}
    (tmp_path / "a.mix").write_bytes(archives.encode_mix(big))
    (tmp_path / "a.big").write_bytes(FILES["big"])
    (tmp_path / "a.pak").write_bytes(FILES["pak"])
    (tmp_path / "bad.big").write_bytes(b"BIGF")
    file = RangedFile(str(tmp_path / "a.mix"))
    assert list(archives.mix(file)) == list(archives.mix((tmp_path / "a.mix").read_bytes())) and file.read_bytes <= 1 << 16
    whole = (tmp_path / "a.mix").read_bytes()
    assert file[70_000:200_000] == whole[70_000:200_000] and file[-1] == whole[-1] and file.find(b"tail") == whole.find(b"tail") and file.find(b"none") == -1
    paths = spark.createDataFrame([(str(tmp_path / "a.mix"),)], "path string")
    parts = read_entries(index_only(paths, "mix"), most=100_000).where("idx = 1").orderBy("part").collect()
    assert b"".join(bytes(r["payload"]) for r in parts) == big[9] and len(parts) == 2
    bad = index_only(spark.createDataFrame([(str(tmp_path / f),) for f in ("bad.big", "gone.big", "a.big")], "path string"), "big").collect()
    assert sorted(r["_error"] is None for r in bad) == [False, False, True]


def test_names_and_extraction(spark, tmp_path):
    """The archive's own names alone if it has any; sniffed endings; the second of a name takes its hash's; files are written."""
    from tessera.functions.columns import name_hash

    crc = lambda n: spark.range(1).select(name_hash(F.lit(n))).first()[0]
    names = b"\3\0\0\0" + b"UNIT.PAL\0\0" + b"..\\up.txt\0\0" + b"a\\b.txt\0note\0"
    own = archives.encode_mix({archives.NAMES_ENTRY: names, crc("unit.pal"): FILES["pal"], crc("a\\b.txt"): b"deep", crc("..\\up.txt"): b"no", 5: FILES["csf"], 6: b"?"})
    plain = archives.encode_mix({crc("unit.pal"): b"x", crc("other.ini"): b"[a]"})
    files = spark.createDataFrame([("own.mix", bytearray(own)), ("plain.mix", bytearray(plain))], "path string, content binary")
    given = verbs.name_map(spark.createDataFrame([("other.ini",), ("unit.pal",)], "name string"))
    listed = {(r["path"], r["crc"]): r["name"] for r in verbs.list_entries(files, "mix", given).collect()}
    assert listed["own.mix", crc("unit.pal")] == "UNIT.PAL" and listed["own.mix", 5] == "(unknown)" and listed["plain.mix", crc("other.ini")] == "other.ini"
    got = {(r["path"], r["name"]): bytes(r["payload"]) for r in verbs.extract(files, "mix", given).collect()}
    assert got["own.mix", "00000005.csf"] == FILES["csf"] and got["own.mix", "00000006.bin"] == b"?" and got["own.mix", "a/b.txt"] == b"deep" and not any("up.txt" in n for _, n in got)
    written = verbs.save(verbs.extract(files, "mix", given), f"file://{tmp_path}").collect()
    assert len(written) == len(got) and (tmp_path / "own.mix" / "a" / "b.txt").read_bytes() == b"deep"
    twice = spark.createDataFrame([("p", i, n, f"{i:08X}.shp") for i, n in enumerate(["A.SHP", "a.shp", "A.shp", "B.SHP"])], "path string, idx int, name string, other string")
    made = [r["unique_name"] for r in R.unique_names(twice, ["path"], "name", ["idx"], F.lit("0000ABCD.shp")).orderBy("idx").collect()]
    assert made == ["A.SHP", "0000ABCD.shp", "0000ABCD__2.shp", "B.SHP"]


def test_lookups(spark):
    def rows(name):
        return reading.decoded(spark.createDataFrame([("f", bytearray(FILES[name]))], "path string, content binary"), name)

    one = lambda df, c: [r[c] for r in df.collect()]
    assert one(lookups.by_hash(rows("mix"), F.lit(5)), "idx") == [0] and one(lookups.by_ordinal(rows("mix"), 2), "crc") == [0xF0000001]
    assert one(lookups.by_name(rows("mix"), F.lit("LOCAL mix database.dat")), "crc") == [0x54C2D545] and one(lookups.by_name(rows("pak"), F.lit("b.txt")), "idx") == [1]
    assert one(lookups.ini_value(rows("ini"), F.lit("GENERAL"), F.lit("Name")), "value") == ["y"] and one(lookups.has_section(rows("ini"), F.lit("none")), "has") == [False]
    assert one(lookups.section_sizes(rows("ini")), "keys") == [3] and one(lookups.string_value(rows("str"), F.lit("gui:no")), "value") == ["No"]
    assert sorted(one(lookups.window_property(rows("wnd"), F.lit("name")), "value")) == ["a", "b"] and one(lookups.window_count(rows("wnd")), "windows") == [2]
    assert one(lookups.child(rows("miniyaml"), F.lit("HP")), "value") == ["100"] and one(lookups.child(rows("miniyaml"), F.lit("hp")), "value") == []
    assert one(lookups.chunk(rows("map_sage"), F.lit("Head")), "version") == [1] and one(lookups.chunks_named(rows("map_sage"), F.lit("head")), "idx") == []
    assert one(lookups.top_chunks(rows("w3d"), lookups.MESH), "node_id") == [0] and one(lookups.first_top_chunk(rows("w3d"), lookups.ANIMATION), "node_id") == [2]
    assert one(lookups.first_child_chunk(rows("w3d"), 0x1F), "parent_id") == [0]
    assert one(lookups.cell(rows("bin"), 63, 63), "template_type") == [0] and one(lookups.cell(rows("bin"), 64, 0), "x") == []
    assert one(lookups.transform(rows("hva"), 1, 0), "matrix")[0][0] == 12.0 and one(lookups.waypoint_count(rows("ini")), "waypoints") == [0]
    assert lookups.midi_summary(rows("mid")).first()["channels"] == [0] and tuple(lookups.register_summary(rows("adl")).first())[1] >= 0
    stats = lookups.name_stats(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "k int, v string"), "k", "v").first()
    assert tuple(stats) == (1, 1)
    times = spark.range(1).select(lookups.frame_at(F.lit(70_000_000), F.lit(15), F.lit(9)), lookups.frame_at(F.lit(10**12), F.lit(15), F.lit(9)), lookups.frame_at(F.lit(0), F.lit(15), F.lit(0)), lookups.clip_nanos(F.lit(15), F.lit(4))).first()
    assert tuple(times) == (1, 8, None, 266_666_666)


def test_hints(spark):
    from tessera.functions import columns as C

    df = spark.createDataFrame([(1, "vqa", "shp_ts"), (99, "xyz", "bin")], "h int, e string, f string")
    got = df.select(C.extension_of_hint(F.col("h")), C.hint_of_extension(F.col("e")), C.display_name(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("shp", 4, "shp-ts"), ("bin", 0, "bin-td")]


def test_clusters():
    assert encoding.clusters_of([0, 1000, 2000, 2001, 4000, 4001, 4002]) == [0, 0, 0, 1, 1, 1, 2]


def test_many_pictures(spark):
    grey = images.encode_pal([(i % 64 * 4, i // 64 * 4, 0) for i in range(256)])
    rgb = images.rgb(grey)
    pictures = [rgb[np.arange(16).reshape(4, 4) + k] for k in range(3)]
    df = spark.createDataFrame([("a", k, bytearray(media.png_of(x))) for k, x in enumerate(pictures)] + [("b", 0, bytearray(b"no"))], "path string, ordinal int, content binary")
    got = {r["path"]: r for r in verbs.convert_sets(df, "shp", grey).collect()}
    frames = [r["pixels"] for r in images.shp(bytes(got["a"]["data"]))]
    assert got["b"]["error"] and len(frames) == 3 and all((rgb[np.frombuffer(f, np.uint8)] == x.reshape(-1, 3)).all() for f, x in zip(frames, pictures, strict=True))


def test_damaged_files_are_rows(spark):
    song = FILES["mid"]
    cut = bytearray(song[:-1])
    df = spark.createDataFrame([("bad", cut), ("good", bytearray(song))], "path string, content binary")
    assert {r["path"]: r["ok"] for r in verbs.validate(df, "mid").collect()} == {"bad": False, "good": True}
    assert reading.decoded(df, "mid").where("_error is not null").count() == 1
    assert len(list(images.pal(bytes([255]) * 768))) == 256
    assert list(archives.names_blob(b"\5\0\0\0a\0b\0cut")) == [{"idx": 0, "name": "a", "description": "b"}]
    block = archives.encode_cnfm([{"crc": 7, "type_hint": 1, "name": "a.shp"}] * 2)
    assert len(list(archives.cnfm(block[:-1]))) == 1 and list(archives.cnfm(block[:4] + b"\2\0" + block[6:])) == []


def test_sound_survives_avi_to_vqa():
    grey = images.encode_pal([(i % 64, i // 64, 0) for i in range(256)])
    frames = [images.rgb(grey)[np.full((4, 8), k)] for k in range(2)]
    made = verbs.avi_to_vqa(media.avi_of(frames, 15, [100, -100] * 1500, 22050), grey)[0]
    samples, rate, channels = media.vqa_audio(made)
    assert len(samples) >= 2900 and rate == 22050 and channels == 1
    assert media.avi_audio(media.avi_of(frames, 15))[0] == []


def test_nearest_and_numbered(spark):
    left = spark.createDataFrame([(i, (i * 37) % 500 if i % 4 else 3) for i in range(400)] + [(400, None)], "id int, at long")
    right = spark.createDataFrame([(k, (k * k * 7) % 900 - 200) for k in range(40)] + [(99, None)], "k int, x long")
    points = [((k * k * 7) % 900 - 200, k) for k in range(40)]
    for r in R.nearest(left, right, "at", "x", "k").collect():
        want = min((abs(x - r["at"]), k) for x, k in points) if r["at"] is not None else (None, None)
        assert (r["distance"], r["k"]) == want
    rows = [(("a" if i % 3 else None), (i * 7919) % 1000, i) for i in range(900)]
    got = R.numbered(spark.createDataFrame(rows, "g string, t long, i int"), ["g"], "t", ["t", "i"], "n").collect()
    want = {}
    for g in ("a", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((t, i) for x, t, i in rows if x == g), 1)}
    assert {r["i"]: r["n"] for r in got} == want
