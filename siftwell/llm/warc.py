"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame for each record.

`deduplicated` names for each page the record that its payload is stored in: of pages with equal
payloads the one with the largest id. `write_archives` packs records into archives, each a row with
its whole bytes (the schema also of Spark's binaryFile source, so archives from elsewhere are read
alike). `read_archives` walks the frames, decodes one at a time and validates versions, mandatory
headers, lengths and digests.

A response holds an HTTP head and the payload; a revisit holds the HTTP head alone, whose
Content-Length still tells the payload's size, and names the response by WARC-Refers-To.

Cases: a null payload is empty; a null id is smaller than any other, and records of a group without
ids are all responses, as are repeated rows of the largest id; null urls get a name made of the id;
a damaged archive gives the records before the damage, then one row with `error`; a record that fails
a test has its reason in `error`. A null archive gives one row with the error "null". Empty tables
give empty results. Further columns are ignored. An archive is closed at ARCHIVE_BYTES before
compression, so memory holds one archive and one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import salted_totals

#: Bytes of records in an archive; an archive may exceed it by one record.
ARCHIVE_BYTES = 16 << 20
#: The dictionary of an archive is trained on its first payloads: so many bytes of them at most, each up to so long.
SAMPLE_BYTES, SAMPLE_EACH, DICTIONARY_BYTES = 1 << 20, 8192, 32768
#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame. Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]{1,19})>", name or "")
    return int(m[1]) if m and -(2**63) <= int(m[1]) < 2**63 else None


def length_of(digits: str) -> int:
    """A length in decimal digits, of 18 at most. Raises WarcError."""
    if not re.fullmatch(r"[0-9]{1,18}", digits):
        raise WarcError("content-length is no number")
    return int(digits)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record, response or revisit."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id)[1:-1]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record. Raises WarcError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the header doesn't end")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError("a header line has no name")
        headers.setdefault(name.lower(), value.strip())
    if missing := [x for x in MANDATORY if x not in headers]:
        raise WarcError(f"no {missing[0]}")
    length = length_of(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("content-length doesn't fit the record")
    block = rest[:length]
    for kind, part in (("warc-block-digest", block),):
        if (want := headers.get(kind, "")).startswith("sha1:") and want[5:] != digest32(part):
            raise WarcError(f"{kind} doesn't fit")
    out = {"headers": headers, "type": headers["warc-type"], "payload": None, "payload_bytes": None, "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        told = length_of(m[1].decode()) if m else None
        if out["type"] == "response":
            if not gap or told is not None and told != len(payload):
                raise WarcError("the HTTP content-length doesn't fit the payload")
            if out["digest"] and out["digest"] != digest32(payload):
                raise WarcError("warc-payload-digest doesn't fit")
            out |= {"payload": payload, "payload_bytes": len(payload), "digest": digest32(payload)}
        elif m:
            out["payload_bytes"] = told
    return out


# ---------------------------------------------------------------- frames


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its block headers."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size = (flags >> 6) and 1 << (flags >> 6) or single
        p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size
        while True:
            block = int.from_bytes(data[p : p + 3], "little")
            if p + 3 > len(data):
                raise WarcError("a frame is cut off")
            kind = block >> 1 & 3
            if kind == 3:
                raise WarcError("a frame has a reserved block")
            p += 3 + (1 if kind == 1 else block >> 3)
            if block & 1:
                break
        p += 4 * (flags >> 2 & 1)
    except IndexError:
        raise WarcError("a frame is cut off") from None
    if p > len(data):
        raise WarcError("a frame is cut off")
    return p


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes of the record) for each frame of an archive, one decoded at a time."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) - at < 8:
            raise WarcError("a frame is cut off")
        magic, size = struct.unpack_from("<II", archive, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            body = archive[at + 8 : at + 8 + size]
            if len(body) != size:
                raise WarcError("the dictionary is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                try:
                    raw = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME_MAGIC) else body
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError as e:
                    raise WarcError(f"the dictionary can't be read: {e}") from None
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError("no frame where one should begin")
        end = frame_end(archive, at)
        try:
            record = decoder.decompressobj().decompress(archive[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from None
        yield at, record
        at = end


def make_archive(records: list[bytes], samples: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary from the samples where they suffice to train one."""
    head, params = b"", {"level": 3, "write_checksum": True, "write_content_size": True}
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        trained = None
    if trained is not None:
        body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        head = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
        params["dict_data"] = trained
    write = zstandard.ZstdCompressor(**params).compress
    return head + b"".join(write(r) for r in records)


# ---------------------------------------------------------------- tables


def deduplicated(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): pages with what their record is. Payloads shorter than least_bytes are never revisits.

    A payload that a third of all pages share is dealt out over sub-groups before its pages meet the group's largest id.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        (F.col(url_col).cast("string") if url_col and url_col in pages.columns else F.lit(None).cast("string")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("_key"),
    )
    dealt, whole = salted_totals(rows, ["_key"], ["page_id"], {"_last": F.max("page_id")}, {"_last": F.max("_last")})
    out = dealt.join(whole, ["_key", "_salt"])
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return out.withColumn("revisit", revisit).select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("_last")).alias("refers_to"), "revisit")


def write_archives(records: DataFrame) -> DataFrame:
    """(path, content): archives of the records that `deduplicated` describes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        records, samples, size, sampled = [], [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:06d}.warc.zst"]), pa.array([make_archive(records, samples)], pa.binary())], ["path", "content"])

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(i) for i in range(5))):
                raw = payload.as_py()
                records.append(make_record(page_id.as_py(), url.as_py(), raw, refers_to.as_py(), revisit.as_py()))
                size += len(records[-1])
                if raw and not revisit.as_py() and sampled < SAMPLE_BYTES:
                    samples.append(raw[:SAMPLE_EACH])
                    sampled += len(samples[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number += 1
                    records, samples, size, sampled = [], [], 0, 0
        if records:
            yield archive()

    return records.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "path string, content binary")


_READ = pa.schema([
    ("path", pa.string()), ("frame_offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives in archives(path, content), validated; payloads only where asked for."""

    def rows_of(path: str | None, content: bytes | None) -> Iterator[dict]:
        blank = dict.fromkeys(_READ.names) | {"path": path}
        if content is None:
            yield blank | {"error": "null"}
            return
        last = 0
        try:
            for last, raw in frames(content):
                try:
                    r = parse_record(raw)
                    h = r["headers"]
                    yield blank | {
                        "frame_offset": last, "record_type": r["type"], "record_id": h["warc-record-id"], "page_id": page_of(h["warc-record-id"]), "target_uri": h.get("warc-target-uri"),
                        "payload_bytes": r["payload_bytes"], "payload_digest": r["digest"], "refers_to": page_of(h.get("warc-refers-to")), "payload": r["payload"] if payloads else None,
                    }
                except WarcError as e:
                    yield blank | {"frame_offset": last, "error": str(e)}
        except WarcError as e:
            yield blank | {"frame_offset": last, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in rows_of(path.as_py(), content.as_py()):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 4096 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    ddl = "path string, frame_offset long, record_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
    return archives.select("path", "content").mapInArrow(run, ddl)
