"""Media columns: baseline JPEG, read down to DC-only luminance thumbnails.

`media_features` parses the markers of each JPEG, Huffman-decodes its scans in numpy and returns
dimensions, a thumbnail of one pixel a block and hashes of it. Scans are decoded in lockstep: every
restart segment of every image of a batch advances by one symbol at a time, so the cost of a step is
spread over thousands of segments whatever Huffman tables the images use.

`store_payloads` keeps arbitrary bytes losslessly in such images. The unit is the quantised
coefficient: 64 payload bytes make one 8x8 block, each byte the eight magnitude bits of a coefficient
of category 8 (byte b >= 128 is b, otherwise b - 255), quantisation is 1 and the restart interval one
block. Blocks lie row by row in the squarest image that holds them; a comment segment has their count.

Cases: a null text counts as empty; an empty payload is one block of zeros; null media give null
features and the error "null"; bytes that aren't a baseline JPEG give null features and the reason in
`error`. Repeated rows give repeated rows; further columns of the input are ignored. Work memory is
bounded by CHUNK_BLOCKS blocks and one image.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that are coded or decoded at once (a work memory of about 30 MB).
CHUNK_BLOCKS = 16384
_COUNT_TAG = b"siftwell-blocks:"
_COUNT = re.compile(_COUNT_TAG + rb"([0-9]{1,9})")


class MediaError(ValueError):
    """The bytes are not a baseline JPEG that can be read."""


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(kind: int, symbol: int) -> bytes:
    return bytes([kind << 4, 1, *[0] * 15, symbol])


def _blocks_to_scan(blocks: np.ndarray, first: int) -> bytes:
    """Entropy-coded segments of (n, 64) bytes; block number `first` + i is followed by its restart marker."""
    n = len(blocks)
    b = blocks.reshape(n, 8, 8).astype(np.uint16)
    out = np.zeros((n, 8, 9), np.uint8)
    # eight fields of nine bits (a zero bit, then the byte) fill nine bytes
    for j in range(8):
        out[:, :, j] |= (b[:, :, j] >> (j + 1)).astype(np.uint8)
        out[:, :, j + 1] |= ((b[:, :, j] << (7 - j)) & 0xFF).astype(np.uint8)
    flat = out.reshape(n, 72)
    marked = np.empty((n, 74), np.uint8)
    marked[:, :72] = flat
    marked[:, 72] = 0xFF
    marked[:, 73] = 0xD0 + ((first + np.arange(n)) & 7)
    full = marked.ravel()
    at = np.flatnonzero(full == 0xFF)
    at = at[at % 74 != 72]  # a data byte FF is followed by a zero byte
    return (np.insert(full, at + 1, 0) if len(at) else full).tobytes()


def grid(n_blocks: int) -> tuple[int, int]:
    """(columns, rows) of the squarest image that holds the blocks."""
    cols = max(1, int(np.ceil(np.sqrt(n_blocks))))
    return cols, -(-n_blocks // cols)


def encode_payload(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % 64:
        raise MediaError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // 64
    cols, rows = grid(n)
    if cols * 8 > 65535:
        raise MediaError("the payload is larger than an image can hold")
    head = b"".join([
        b"\xff\xd8",
        _segment(0xFE, _COUNT_TAG + str(n).encode()),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, _one_code_table(0, 8) + _one_code_table(1, 8)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])
    whole = np.zeros((cols * rows, 64), np.uint8)
    whole.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    scan = b"".join(_blocks_to_scan(whole[i : i + CHUNK_BLOCKS], i) for i in range(0, cols * rows, CHUNK_BLOCKS))
    return head + scan[:-2] + b"\xff\xd9"  # no restart marker after the last block


# ---------------------------------------------------------------- parsing


@dataclass
class Scan:
    parts: list[tuple[int, int, int]]  # (component, DC table, AC table) as numbers of _Tables
    restart: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, list[int]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    payload_blocks: int | None = None


class _Tables:
    """Distinct Huffman tables of a batch, each a lookup of 16 bits: length << 8 | symbol (0: no such code)."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, counts_and_symbols: bytes) -> int:
        if counts_and_symbols not in self.number:
            counts, symbols = counts_and_symbols[:16], counts_and_symbols[16:]
            row, at, k = np.zeros(65536, np.uint16), 0, 0
            for length in range(1, 17):
                for _ in range(counts[length - 1]):
                    span = 1 << (16 - length)
                    if at + span > 65536:
                        raise MediaError("a Huffman table has too many codes")
                    row[at : at + span] = length << 8 | symbols[k]
                    at, k = at + span, k + 1
            self.number[counts_and_symbols] = len(self.rows)
            self.rows.append(row)
        return self.number[counts_and_symbols]


def parse(data: bytes, tables: _Tables) -> Image:
    """Markers of one JPEG. Raises MediaError for anything but a whole baseline image."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    image, huff, restart, at = Image(), {}, 0, 2
    try:
        while True:
            if data[at] != 0xFF:
                raise MediaError("a marker is missing")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise MediaError("a segment is cut off")
            at += 2 + size
            if marker == 0xFE and (own := _COUNT.fullmatch(body)):  # any other comment says nothing
                image.payload_blocks = int(own[1])
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = list(struct.unpack_from(">64H" if wide else ">64B", body, 1))
                    body = body[129 if wide else 65 :]
            elif marker == 0xC0:
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not image.width or not image.height:
                    raise MediaError("samples must have 8 bits and the image a size")
                image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if not all(1 <= c[1] <= 4 and 1 <= c[2] <= 4 for c in image.components):
                    raise MediaError("a sampling factor isn't from 1 to 4")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise MediaError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = tables.add(bytes(body[1 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                by_id = {c[0]: i for i, c in enumerate(image.components)}
                parts = [(by_id[body[1 + 2 * i]], huff[body[2 + 2 * i] >> 4], huff[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])]
                raw = np.frombuffer(data, np.uint8, offset=at)
                ff = np.flatnonzero(raw[:-1] == 0xFF)
                after = raw[ff + 1]
                ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
                if not len(ends):
                    raise MediaError("the scan doesn't end")
                image.scans.append(Scan(parts, restart, data[at : at + int(ends[0])]))
                at += int(ends[0])
    except (IndexError, KeyError, struct.error) as e:
        raise MediaError(f"cut off or unknown part: {type(e).__name__}") from None
    if not image.components or not any(0 in [p[0] for p in s.parts] for s in image.scans):
        raise MediaError("no luminance scan")
    return image


def _split_segments(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, start of each restart segment therein)."""
    raw = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[ff + 1] if len(ff) else np.zeros(0, np.uint8)
    rst = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[rst] = False
    keep[rst + 1] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], np.concatenate([[0], kept_before[rst]]).astype(np.int64)


# ---------------------------------------------------------------- lockstep decoding


def _decode(data: np.ndarray, start: np.ndarray, end: np.ndarray, mcus: np.ndarray, pattern: list[tuple[int, int, int]], lut: np.ndarray, coefficients: bool) -> tuple[np.ndarray, np.ndarray]:
    """Luminance blocks of restart segments that share one MCU pattern.

    pattern: (component, DC table, AC table) of each block of an MCU. Returns the blocks, (segments,
    blocks of a segment, 64 or 1), and an error flag for each segment. DC values are predicted within
    the segment.
    """
    n, per = len(start), len(pattern)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    last_word = len(word) - 1
    luma_at = np.cumsum([0] + [c == 0 for c, _, _ in pattern])
    n_luma = int(luma_at[-1])
    most = int(mcus.max()) if n else 0
    out = np.zeros((n, most * n_luma, 64 if coefficients else 1), np.int16)
    bad = np.zeros(n, bool)
    comp = np.array([c for c, _, _ in pattern])
    dc_t, ac_t = (np.array([p[i] for p in pattern], np.int64) << 16 for i in (1, 2))
    live = np.flatnonzero(mcus > 0)
    pos, block, k = start[live] * 8, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    limit, blocks = end[live] * 8, mcus[live] * per
    pred = np.zeros((len(live), int(comp.max()) + 1 if per else 1), np.int64)
    rows = np.arange(len(live))
    while len(live):
        in_mcu = block % per
        is_dc = k == 0
        at = np.minimum(pos >> 3, last_word)
        window = (word[at] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        code = lut[np.where(is_dc, dc_t[in_mcu], ac_t[in_mcu]) + window]
        length, symbol = (code >> 8).astype(np.int64), (code & 0xFF).astype(np.int64)
        run, size = np.where(is_dc, 0, symbol >> 4), np.where(is_dc, np.minimum(symbol, 16), symbol & 15)
        pos = pos + length
        at = np.minimum(pos >> 3, last_word)
        extra = ((word[at].astype(np.uint64) << (pos & 7).astype(np.uint64)) & 0xFFFFFFFF).astype(np.int64) >> (32 - size)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        pos = pos + size
        wrong = (length == 0) | (pos > limit)
        c = comp[in_mcu]
        total = pred[rows, c] + np.where(is_dc, value, 0)
        pred[rows, c] = total
        to = k + run
        ends = ~is_dc & (size == 0) & (run != 15)
        puts = (is_dc | (size > 0)) & (c == 0) & (to < 64)
        wrong |= ~is_dc & ~ends & (to > 63)
        put = puts & (coefficients | is_dc) & ~wrong
        slot = (block // per) * n_luma + luma_at[in_mcu]
        out[live[put], slot[put], to[put]] = np.where(is_dc, total, value)[put]
        k = np.where(ends, 64, to + 1)
        done = k >= 64
        k = np.where(done, 0, k)
        block = block + done
        stay = ~wrong & (block < blocks)
        if not stay.all():
            bad[live[wrong]] = True
            live, pos, block, k, limit, blocks, pred = (x[stay] for x in (live, pos, block, k, limit, blocks, pred))
            rows = np.arange(len(live))
    return out, bad


@dataclass
class Luma:
    """Luminance of one image: blocks in raster order, (rows, columns, 64 or 1)."""

    width: int
    height: int
    blocks: np.ndarray
    dc_step: int
    payload_blocks: int | None

    def thumbnail(self) -> np.ndarray:
        """One pixel a block: the block's mean, from its DC coefficient alone."""
        return np.clip(np.round(self.blocks[:, :, 0].astype(np.float64) * self.dc_step / 8 + 128), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that encode_payload stored in the coefficients."""
        if self.payload_blocks is None:
            raise MediaError("the image has no payload")
        v = self.blocks.reshape(-1, self.blocks.shape[-1])[: self.payload_blocks]
        return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def decode_images(items: list[bytes], coefficients: bool = False) -> list[Luma | MediaError]:
    """Luminance of each image, or why it can't be read. Scans of all images are decoded together."""
    tables, out, jobs = _Tables(), [None] * len(items), {}
    images: list[Image | None] = [None] * len(items)
    for i, item in enumerate(items):
        try:
            image = images[i] = parse(item, tables)
            scan = next(s for s in image.scans if 0 in [p[0] for p in s.parts])
            hs, vs = max(c[1] for c in image.components), max(c[2] for c in image.components)
            _, h, v, _ = image.components[0]
            if len(scan.parts) == 1:  # not interleaved: an MCU is a block of the component itself
                pattern = (scan.parts[0],)
                across, down, h, v = -(-image.width * h // (8 * hs)), -(-image.height * v // (8 * vs)), 1, 1
            else:
                pattern = tuple(p for p in scan.parts for _ in range(image.components[p[0]][1] * image.components[p[0]][2]))
                across, down = -(-image.width // (8 * hs)), -(-image.height // (8 * vs))
            data, starts = _split_segments(scan.data)
            total, each = across * down, scan.restart or across * down
            if len(starts) != -(-total // each):
                raise MediaError("restart markers don't fit the image")
            counts = np.full(len(starts), each, np.int64)
            counts[-1] = total - each * (len(starts) - 1)
            jobs.setdefault((pattern, each), []).append((i, data, starts, counts, across, down, h, v))
        except MediaError as e:
            out[i] = e
    lut = np.concatenate(tables.rows) if tables.rows else np.zeros(65536, np.uint16)
    for (pattern, each), group in jobs.items():
        n_luma = sum(c == 0 for c, _, _ in pattern)
        pieces, mark = [], 0
        owner = np.concatenate([np.full(len(g[2]), j) for j, g in enumerate(group)])
        data = np.concatenate([g[1] for g in group])
        starts, ends, counts = [], [], []
        for _, d, s, c, *_ in group:
            starts.append(s + mark)
            ends.append(np.append(s[1:], len(d)) + mark)
            counts.append(c)
            mark += len(d)
        starts, ends, counts = (np.concatenate(x) for x in (starts, ends, counts))
        bad = np.zeros(len(starts), bool)
        step = max(1, CHUNK_BLOCKS // max(1, each * len(pattern)))
        for a in range(0, len(starts), step):
            z = min(a + step, len(starts))
            low = int(starts[a])
            blocks, bad[a:z] = _decode(data[low : int(ends[z - 1])], starts[a:z] - low, ends[a:z] - low, counts[a:z], list(pattern), lut, coefficients)
            mask = np.arange(blocks.shape[1])[None, :] < (counts[a:z] * n_luma)[:, None]
            pieces.append(blocks[mask])
        blocks = np.concatenate(pieces)
        at = 0
        for j, (i, _, _, _, across, down, h, v) in enumerate(group):
            size = across * down * n_luma
            own = blocks[at : at + size]
            at += size
            if bad[np.searchsorted(owner, j) : np.searchsorted(owner, j, "right")].any():
                out[i] = MediaError("the scan has a wrong code")
                continue
            own = own.reshape(down, across, v, h, -1).swapaxes(1, 2).reshape(down * v, across * h, -1)
            image = images[i]
            hs, vs = max(c[1] for c in image.components), max(c[2] for c in image.components)
            _, ch, cv, q = image.components[0]
            own = own[: -(-image.height * cv // (8 * vs)), : -(-image.width * ch // (8 * hs))]
            out[i] = Luma(image.width, image.height, own, image.quant.get(q, [1])[0], image.payload_blocks)
    return out


def thumbnail_hashes(pixels: np.ndarray) -> tuple[str, str]:
    """(16 hex digits of a SHA-256 of size and pixels, 16 hex digits of an average hash of 8x8 samples)."""
    exact = hashlib.sha256(struct.pack(">II", *pixels.shape) + pixels.tobytes()).hexdigest()[:16]
    r, c = (np.arange(8) * pixels.shape[0] // 8, np.arange(8) * pixels.shape[1] // 8)
    small = pixels[np.ix_(r, c)].astype(np.float64)
    return exact, np.packbits(small > small.mean()).tobytes().hex()


# ---------------------------------------------------------------- columns


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, stored losslessly in a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(batch), 512):
                raws = [(x or "").encode() for x in texts.slice(a, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, 512), pa.array([len(x) for x in raws], pa.int64()), pa.array([encode_payload(padded(x)) for x in raws], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, width int, height int, thumbnail binary, thumbnail_hash string, "
    "average_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
)


def _groups(items: list, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items whose sizes sum to about `most`."""
    a = size = 0
    for i, x in enumerate(items):
        size += len(x or b"")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(items):
        yield a, len(items)


def media_features(df: DataFrame, payloads: bool = True) -> DataFrame:
    """Dimensions, DC-only thumbnail and hashes of the JPEGs in df(doc_id, n_bytes, media).

    With payloads, coefficients are read too and the payload's length and checksums are given for
    images that have one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, _FEATURES.split(", "))])
        for batch in batches:
            ids, sizes, media = (batch.column(i).to_pylist() for i in range(3))
            for a, z in _groups(media, 2 << 20):
                rows = []
                present = [i for i in range(a, z) if media[i] is not None]
                lumas = dict(zip(present, decode_images([media[i] for i in present], payloads)))
                for i in range(a, z):
                    row = dict.fromkeys(names) | {"doc_id": ids[i], "n_bytes": sizes[i]}
                    if media[i] is None:
                        row["error"] = "null"
                    else:
                        row |= {"media_bytes": len(media[i]), "media_sha256": hashlib.sha256(media[i]).hexdigest()}
                        x = lumas[i]
                        if isinstance(x, MediaError):
                            row["error"] = str(x)
                        else:
                            pixels = x.thumbnail()
                            exact, average = thumbnail_hashes(pixels)
                            row |= {"width": x.width, "height": x.height, "thumbnail": pixels.tobytes(), "thumbnail_hash": exact, "average_hash": average}
                            if payloads and x.payload_blocks is not None:
                                p = x.payload()
                                row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:])}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)
