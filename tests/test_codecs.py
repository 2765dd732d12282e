import random

import pytest

from tessera.functions.codecs import Blowfish, Ima, adpcm_decode, adpcm_encode, index_key, lcw_compress, lcw_decompress, scanlines, snd1_decode, snd2_decode, vlq_read, vlq_write, xor_delta
from tessera.sources.binary import DecodeError


def test_lcw_fill_and_ends():
    assert lcw_decompress(bytes.fromhex("fe1000aa80"), 16) == b"\xaa" * 16
    with pytest.raises(DecodeError):
        lcw_decompress(bytes.fromhex("fe1000aa80"), 15)
    with pytest.raises(DecodeError):
        lcw_decompress(b"\x83ab", 10)
    assert lcw_decompress(b"\x80", 0) == b""


def test_lcw_round_trips():
    r = random.Random(1)
    for _ in range(200):
        data = bytes(r.choice(b"aab\0cz") for _ in range(r.randint(0, 600)))
        assert lcw_decompress(lcw_compress(data), len(data)) == data


def test_lcw_copies_into_itself():
    assert lcw_decompress(b"\x81a\x70\x01\x80", 20) == b"a" * 11  # a near copy of ten from one back
    assert lcw_decompress(b"\x82ab\xc3\x00\x00\x80", 20) == b"abababab"
    assert lcw_decompress(b"\x00\x05\x80", 20) == bytes(3)  # from before the start: zeros


@pytest.mark.parametrize(
    ("canvas", "delta", "out"),
    [
        (b"\xaa" * 4, "0411223344", "bb8899ee"),
        (b"\xaa" * 4, "82021122", "aaaabb88"),
        (b"\xaa" * 4, "800000", "aaaaaaaa"),
        (bytes(4), "0004ff", "ffffffff"),
        (bytes(4), "800480aabbccdd", "aabbccdd"),
        (bytes(4), "8004c0ff", "ffffffff"),
        (bytes(2), "0411223344", "0000"),
        (bytes(4), "80ff7f", "00000000"),
        (bytes(4), "ff", "00000000"),
        (bytes(4), "8001", "00000000"),
    ],
)
def test_xor_delta(canvas, delta, out):
    assert xor_delta(canvas, bytes.fromhex(delta)).hex() == out


def test_adpcm():
    assert len(adpcm_decode(b"\x77" * 10)) == 20
    assert adpcm_decode(b"\x77" * 10)[:5] == [11, 41, 104, 240, 533]
    assert len(adpcm_decode(b"\x77" * 10, most=7)) == 7
    slow = [int(3000 * ((i % 100) / 50 - 1)) for i in range(400)]
    back = adpcm_decode(adpcm_encode(slow))
    assert len(back) == 400
    assert sum(abs(a - b) for a, b in zip(slow[100:], back[100:], strict=True)) / 300 < 500
    assert len(adpcm_encode(slow[:10], stereo=True)) == 4  # eight of ten samples make four bytes


def test_video_sound():
    assert snd2_decode(b"\x77\x88", True, Ima(), Ima())[:2] == [11, -0]
    assert snd1_decode(bytes([3, 0, 3, 0, 128, 129, 0])) == [0, 256, -32768]
    assert snd1_decode(bytes([4, 0, 2, 0, 0xC3, 0])) == [0, 0, 0, 0]


def test_scanlines():
    assert scanlines(bytes([5, 0, 7, 0, 2, 2, 0]), 4, 2) == bytes([7, 0, 0, 0, 0, 0, 0, 0])


def test_vlq():
    for v in (0, 127, 128, 16383, 123456):
        assert vlq_read(vlq_write(v), 0) == (v, len(vlq_write(v)))


def test_blowfish_published_vector():
    c = Blowfish(b"abcdefghijklmnopqrstuvwxyz")
    assert c.encrypt(b"BLOWFISH").hex() == "324ed0fef413a203"
    assert c.decrypt(c.encrypt(b"12345678")) == b"12345678"


def test_index_key_length():
    assert len(index_key(bytes(range(80)), (1 << 319) + 12345)) == 56
