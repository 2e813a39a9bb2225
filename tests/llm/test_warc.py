import struct

import pytest
import zstandard

from siftwell.llm import warc


def _one(records, samples=()):
    return warc.make_archive(records, list(samples))


def test_archive_with_dictionary():
    bodies = [(f"<html><p>page {i}</p>" + "common words of all pages " * 20).encode() for i in range(200)]
    archive = _one([warc.make_record(i, f"http://x/{i}", b, None, False) for i, b in enumerate(bodies)], bodies)
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_MAGIC
    got = [warc.parse_record(r)["payload"] for _, r in warc.frames(archive)]
    assert got == bodies


def test_archive_without_dictionary_and_empty():
    archive = _one([warc.make_record(None, None, b"", None, False)])
    (r,) = [warc.parse_record(r) for _, r in warc.frames(archive)]
    assert r["payload"] == b"" and warc.page_of(r["headers"]["warc-record-id"]) is None
    assert list(warc.frames(b"")) == []


def test_raw_dictionary_frame():
    d = b"some shared words of the records " * 40
    body = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(warc.make_record(1, "u", b"some shared words", None, False))
    assert [warc.parse_record(r)["payload"] for _, r in warc.frames(struct.pack("<II", warc.DICTIONARY_MAGIC, len(d)) + d + body)] == [b"some shared words"]


@pytest.mark.parametrize("cut", [1, 5, 40])
def test_cut_archives(cut):
    archive = _one([warc.make_record(1, "u", b"x" * 100, None, False)] * 2)
    with pytest.raises(warc.WarcError):
        list(warc.frames(archive[:-cut]))


@pytest.mark.parametrize(
    "change",
    [(b"WARC/1.1", b"WORK/1.1"), (b"WARC-Date", b"WARC-Dote"), (b"x" * 50, b"y" * 50), (b"x" * 50, b"x" * 49), (b"\r\n\r\n", b"\r\n")],
)
def test_bad_records(change):
    good = warc.make_record(1, "u", b"x" * 50, None, False)
    assert warc.parse_record(good)["payload_bytes"] == 50
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(*change))


@pytest.mark.parametrize("length", ["²", "9" * 5000, "", "-1", "1e3"])
def test_odd_lengths_are_errors(spark, length):
    good = warc.make_record(1, "u", b"x" * 50, None, False)
    block = len(good.partition(b"\r\n\r\n")[2]) - 4
    bad = [good.replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % block, b"\r\nContent-Length: %s\r\n\r\nHTTP" % length.encode())]
    if length.isascii() and length.isdigit():
        told = good.replace(b"Content-Length: 50", b"Content-Length: " + length.encode()).replace(b"WARC-Block-Digest", b"X-Digest")
        bad.append(told.replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % block, b"\r\nContent-Length: %d\r\n\r\nHTTP" % (block + len(length) - 2)))
    for record in bad:
        with pytest.raises(warc.WarcError):
            warc.parse_record(record)
    archives = spark.createDataFrame([("a", bytearray(_one([*bad, good])))], "path string, content binary")
    assert sorted(r.error is None for r in warc.read_archives(archives).collect()) == [False] * len(bad) + [True]


def test_ids_beyond_64_bits_are_null():
    assert warc.page_of(f"<urn:x-page:{2**63 - 1}>") == 2**63 - 1 and warc.page_of(f"<urn:x-page:{2**63}>") is None and warc.page_of("<urn:x-page:²>") is None


def test_table(spark):
    big = "w" * 300_000
    rows = [(1, "u", "same"), (5, "u\r\nX: y", "same"), (3, None, "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (None, "u", "same"), (None, "v", "alone"), (9, "u", big), (10, "é", "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_archives(warc.write_archives(warc.deduplicated(df)), payloads=True).collect()
    assert len(got) == 10 and all(r.error is None for r in got)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (7, "revisit", 8), (8, "response", None), (None, "revisit", 5),
        (None, "response", None), (9, "response", None), (10, "response", None),
    }
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == warc.digest32(bytes(r.payload)) and r.payload_bytes == len(r.payload)
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {4, 0}
    none = warc.read_archives(warc.write_archives(warc.deduplicated(df)), True).where("record_type = 'revisit' and payload is not null")
    assert none.count() == 0
    assert warc.read_archives(warc.write_archives(warc.deduplicated(df.limit(0)))).count() == 0
    odd = spark.createDataFrame([("a", None), ("b", bytearray(b"junk-junk-junk"))], "path string, content binary")
    assert {(r.path, r.error) for r in warc.read_archives(odd).collect()} == {("a", "null"), ("b", "no frame where one should begin")}


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], "page_id long, html string")
    got = {(r.page_id, r.revisit) for r in warc.deduplicated(df, least_bytes=3).collect()}
    assert got == {(1, False), (2, False), (3, True), (4, False)}
