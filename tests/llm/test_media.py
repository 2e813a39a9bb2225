import hashlib
import random
import zlib

import numpy as np
import pytest

from siftwell.llm import media


@pytest.mark.parametrize("size", [1, 63, 64, 65, 640, 70_000])
def test_round_trip(size):
    raw = random.Random(size).randbytes(size)
    p = media.padded(raw)
    (luma,) = media.decode_images([media.encode_payload(p)], True)
    assert luma.payload() == p


def test_all_bytes_and_stuffing():
    p = bytes(range(256)) + b"\xff" * 640 + b"\x00" * 64
    (luma,) = media.decode_images([media.encode_payload(p)], True)
    assert luma.payload() == p


def _bits_jpeg():
    """A 16x8 grey image of two blocks with hand-made tables: DC +3 then 0, a run of 15+1 zeros and an AC of -1."""
    import struct

    dc = bytes([0x00, 0, 2, *[0] * 14, 0, 2])  # 00: category 0, 01: category 2
    ac = bytes([0x10, 0, 3, *[0] * 14, 0x00, 0xF0, 0x01])  # 00: end, 01: 16 zeros, 10: run 0 size 1
    bits = "01" + "11" + "01" + "10" + "0" + "00" + "00" + "00"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    s = media._segment
    return (
        b"\xff\xd8" + s(0xDB, bytes([0, *[16] * 64])) + s(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0]))
        + s(0xC4, dc + ac) + s(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    )


def test_hand_made_image():
    (x,) = media.decode_images([_bits_jpeg()], True)
    assert (x.width, x.height) == (16, 8)
    assert x.blocks[0, 0, 0] == 3 and x.blocks[0, 1, 0] == 3 and x.blocks[0, 0, 17] == -1
    assert x.thumbnail().tolist() == [[134, 134]]
    (y,) = media.decode_images([_bits_jpeg()], False)
    assert np.array_equal(y.thumbnail(), x.thumbnail())


def test_bad_images():
    good = media.encode_payload(bytes(128))
    for item in (b"", b"GIF89a", good[:40], good[:-20], good.replace(b"\xff\xc0", b"\xff\xc2")):
        assert isinstance(media.decode_images([item])[0], media.MediaError)
    assert not isinstance(media.decode_images([b"x", good])[1], media.MediaError)


def test_odd_but_readable_and_unreadable_images():
    good = media.encode_payload(bytes(range(64)))
    comment = good.replace(b"siftwell-blocks:1", b"siftwell-blocks:x")
    (x,) = media.decode_images([comment], True)
    assert x.payload_blocks is None and x.blocks.shape == (1, 1, 64)  # a comment of someone else
    no_sampling = good.replace(bytes([1, 1, 0x11, 0]), bytes([1, 1, 0x00, 0]), 1)
    at = good.index(b"\xff\xdb")
    short_table = good[:at] + media._segment(0xDB, bytes([0])) + good[at + 69 :]
    for item in (no_sampling, short_table):
        assert item != good and isinstance(media.decode_images([item])[0], media.MediaError)


def test_columns(spark):
    rows = [(1, "a", 0), (2, None, 0), (3, "", 0), (4, "é" * 5000, 0), (4, "é" * 5000, 0), (None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.media_features(media.store_payloads(df)).collect()
    assert len(got) == 6
    for r in got:
        text = {1: "a", 2: "", 3: "", 4: "é" * 5000, None: "z"}[r.doc_id]
        p = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-64:]) and r.error is None and len(r.thumbnail) == (r.width // 8) * (r.height // 8)
    assert media.media_features(media.store_payloads(df.limit(0))).count() == 0
    nulls = spark.createDataFrame([(1, 0, None), (2, 3, bytearray(b"no"))], "doc_id long, n_bytes long, media binary")
    assert {(r.doc_id, r.error) for r in media.media_features(nulls).collect()} == {(1, "null"), (2, "no start of image")}
