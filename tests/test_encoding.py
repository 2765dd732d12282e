import struct

import numpy as np

from tessera.plans.verbs import CONVERSIONS
from tessera.sources import encoding, images, media

PALETTE = bytes(i % 64 for i in range(768))


def test_vqa_round_trips():
    r = np.random.default_rng(1)
    frames = [np.kron(r.integers(0, 9, (4, 6)), np.ones((2, 2))).astype(np.uint8).tobytes() for _ in range(5)]
    sound = [int(500 * np.sin(i / 9)) for i in range(22050 * 5 // 15)]
    data = encoding.encode_vqa(frames, PALETTE, 12, 8, sound, group=1)
    assert [x["pixels"] for x in media.vqa(data)] == frames
    back, rate, channels = media.vqa_audio(data)
    assert (rate, channels) == (22050, 1) and abs(len(back) - len(sound)) <= 5
    assert media.vqa_parts(data)[2][0] * 2 == data.index(b"SND2")


def test_gif_round_trips():
    r = np.random.default_rng(2)
    frames = [r.integers(1, 256, 40 * 30).astype(np.uint8).tobytes() for _ in range(3)]
    colours = images.rgb(PALETTE)
    found, delay = encoding.gif_frames(media.gif_of(frames, 40, 30, colours, 7))
    assert delay == 7 and len(found) == 3
    for f, x in zip(frames, found, strict=True):
        assert (x[..., :3] == colours[np.frombuffer(f, np.uint8).reshape(30, 40)]).all()


def test_music_and_containers():
    mid = media.notes_to_smf([{"note": 60, "onset": 0.0, "duration": 0.5, "velocity": 64}])
    xmi = encoding.mid_to_xmi(mid)
    assert len(list(media.xmi(xmi))) == 1 and xmi[:4] == b"FORM" and xmi[8:12] == b"XDIR"
    mkv = encoding.mkv_of([np.zeros((2, 3, 3), np.uint8)] * 2, 10, [1, 2, 3, 4], 20)
    assert mkv[:4] == bytes.fromhex("1A45DFA3") and b"V_UNCOMPRESSED" in mkv


def test_every_conversion_has_its_formats():
    shp = images.encode_shp([bytes([1, 2, 3, 4])], 2, 2)
    assert CONVERSIONS["shp", "gif"](shp, PALETTE)[0][:6] == b"GIF89a"
    png = CONVERSIONS["shp", "png"](shp, PALETTE)[0]
    assert struct.unpack(">II", png[16:24]) == (2, 2)
    assert CONVERSIONS["png", "shp"](png, PALETTE) and CONVERSIONS["png", "pal"](png, None)
    assert CONVERSIONS["gif", "wsa"](CONVERSIONS["shp", "gif"](shp, PALETTE)[0], PALETTE)
    avi = media.avi_of([np.zeros((4, 8, 3), np.uint8)] * 2, 15)
    assert len(list(media.vqa(CONVERSIONS["avi", "vqa"](avi, PALETTE)[0]))) == 2
