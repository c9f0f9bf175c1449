"""Media columns: payloads as baseline JPEG whose DC coefficients are the payload's bytes.

One 8x8 block holds one byte, so an image's DC-only luminance thumbnail is the payload.  An image is 24 blocks wide
and at most 8,184 high; longer payloads take several images, one after the other.  Each row of blocks is a restart
interval, so all rows of a batch are Huffman-decoded side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import doc_text, map_arrow, worker_cache

#: Blocks in a row; a payload is a multiple of TILE bytes; rows in an image.
WIDE, TILE = 24, 576
MOST_ROWS = 341 * WIDE
#: Payload bytes that are coded or decoded at once.
CHUNK = 24 << 13
#: Fixed values of the format: the quantizer of DC, which makes a coefficient an eighth of a block's sum.
DC_STEP = 8
#: Our Huffman codes: 4 bits for each of the 12 DC sizes, in order; 1 bit for end of block, the only AC symbol.
DC_BITS, AC_BITS = 4, 1

_RESTART = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
_SIZE = np.array([0] + [int(x).bit_length() for x in range(1, 256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    """SOI to SOS of a grey image with ``rows`` rows of blocks."""
    quant = bytes([0, DC_STEP] + [1] * 63)
    dc = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])
    frame = struct.pack(">BHHB", 8, rows * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDD, struct.pack(">H", WIDE)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _encode_rows(data: np.ndarray) -> list[bytes]:
    """Entropy-coded rows of blocks, with stuffed bytes but no markers, of a payload part."""
    rows = data.reshape(-1, WIDE).astype(np.int64)
    diff = np.diff(rows, axis=1, prepend=128)
    size = _SIZE[np.abs(diff)]
    code = (size << size) | np.where(diff >= 0, diff, diff + (1 << size) - 1)
    code <<= AC_BITS  # its code is 0
    length = DC_BITS + size + AC_BITS
    wide = DC_BITS + 8 + AC_BITS
    code <<= wide - length
    bits = ((code[:, :, None] >> np.arange(wide - 1, -1, -1)) & 1).astype(np.uint8)
    used = np.arange(wide) < length[:, :, None]
    total = length.sum(1)
    padded = (total + 7) // 8 * 8
    start = np.concatenate(([0], np.cumsum(padded)))
    flat = np.ones(start[-1], np.uint8)
    at = start[:-1, None] + np.cumsum(length, axis=1) - length
    flat[(at[:, :, None] + np.arange(wide))[used]] = bits[used]
    packed = np.packbits(flat)
    full = packed == 0xFF
    if full.any():
        ends = (start // 8) + np.concatenate(([0], np.cumsum(full)))[start // 8]
        packed = np.insert(packed, np.flatnonzero(full) + 1, 0)
    else:
        ends = start // 8
    raw = packed.tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """For each payload, a positive multiple of TILE bytes, the JPEG images that hold it."""
    rows: list[bytes] = []
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    for start in range(0, len(joined), CHUNK):
        rows += _encode_rows(joined[start : start + CHUNK])
    out, at = [], 0
    for payload in payloads:
        parts, n = [], len(payload) // WIDE
        for start in range(0, n, MOST_ROWS):
            image = rows[at + start : at + min(n, start + MOST_ROWS)]
            parts.append(_header(len(image)))
            for i, row in enumerate(image):
                parts += (row, b"\xff\xd9" if i == len(image) - 1 else _RESTART[i % 8])
        out.append(b"".join(parts))
        at += n
    return out


def _huffman(body: bytes) -> dict[tuple[int, int], np.ndarray]:
    """Tables by (class, id): for 16 bits ahead, 256 * code length + symbol."""
    tables = {}
    while body:
        counts, total = body[1:17], sum(body[1:17])
        symbols, body, kind = body[17 : 17 + total], body[17 + total :], body[0]
        table, code, k = np.zeros(1 << 16, np.int64), 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                first = code << (16 - bits)
                table[first : first + (1 << (16 - bits))] = (bits << 8) | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        tables[kind >> 4, kind & 15] = table
    return tables


def _scan(scan: np.ndarray, blocks: int, dc: np.ndarray, ac: np.ndarray, step: int) -> np.ndarray:
    """DC-only luminance of restart intervals of ``blocks`` blocks: one row of samples each.  All go in step."""
    mark = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] != 0))
    starts, ends = np.concatenate(([0], mark[:-1] + 2)), mark
    real = np.ones(len(scan), bool)
    real[1:] = ~((scan[1:] == 0) & (scan[:-1] == 0xFF))
    place = np.concatenate(([0], np.cumsum(real)))
    data = np.concatenate((scan[real], np.full(8, 255, np.uint8))).astype(np.int64)
    at, limit = place[starts] * 8, place[ends] * 8
    ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    rows = len(starts)
    out, last = np.empty((rows, blocks), np.int64), np.zeros(rows, np.int64)

    def peek(n: int) -> np.ndarray:
        return (ahead[at >> 3] >> (32 - n - (at & 7))) & ((1 << n) - 1)

    for b in range(blocks):
        found = dc[peek(16)]
        at += found >> 8
        size = found & 255
        bits = peek(16) >> (16 - size)
        last = last + np.where(bits >= (1 << size) >> 1, bits, bits - (1 << size) + 1) * (size > 0)
        at += size
        out[:, b] = last
        k = np.zeros(rows, np.int64)  # AC coefficients are passed over: a thumbnail needs none
        while (open_ := k < 63).any():
            found = np.where(open_, ac[peek(16)], 0)
            size, run = found & 15, (found >> 4) & 15
            at += (found >> 8) + size
            k = np.where(open_, np.where((found & 255) == 0, 63, k + run + 1), k)
    if (at > limit).any():
        raise ValueError("a scan ends within a block")
    return np.clip(out * step // 8 + 128, 0, 255).astype(np.uint8)


def _images(media: bytes) -> list[tuple[bytes, int, int, bytes]]:
    """What the markers of each image say: its tables, the pixel width and height, and the scan with its end marker."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        at, tables, wide, high, every = at + 2, b"", 0, 0, 0
        while True:
            marker, length = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + length]
            if marker in (0xDB, 0xC4):
                tables += media[at : at + 2 + length]
            at += 2 + length
            if marker == 0xC0:
                high, wide = struct.unpack_from(">HH", body, 1)
            elif marker == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        end = media.index(b"\xff\xd9", at) + 2
        if every * 8 != wide:
            raise ValueError("rows of blocks must be restart intervals")
        out.append((tables, wide, high, media[at:end]))
        at = end
    return out


def _tables(spec: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The DC and the AC table and the DC quantizer of DQT and DHT segments."""
    kept = worker_cache("jpeg tables")
    if spec not in kept:
        found, step, at = {}, 1, 0
        while at < len(spec):
            length = struct.unpack_from(">H", spec, at + 2)[0]
            body = spec[at + 4 : at + 2 + length]
            if spec[at + 1] == 0xDB:
                step = body[1]
            else:
                found |= _huffman(body)
            at += 2 + length
        kept[spec] = (found[0, 0], found[1, 0], step)
    return kept[spec]


def decode_many(media: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """For each, the samples of its images' DC-only thumbnails, their pixel width and their summed height.

    Reads what markers say: baseline grey images with restart intervals of one row of blocks.  Images with the same
    tables and width are decoded side by side.
    """
    images = [(k, *image) for k, one in enumerate(media) for image in _images(one)]
    groups: dict[tuple[bytes, int], list[int]] = {}
    for i, (_, tables, wide, _, _) in enumerate(images):
        groups.setdefault((tables, wide), []).append(i)
    samples: dict[int, np.ndarray] = {}
    for (spec, wide), members in groups.items():
        dc, ac, step = _tables(spec)
        for block in _blocks(members, [len(images[i][4]) for i in members]):
            rows, at = _scan(np.frombuffer(b"".join(images[i][4] for i in block), np.uint8), wide // 8, dc, ac, step), 0
            if len(rows) != sum(images[i][3] // 8 for i in block):
                raise ValueError("rows are missing")
            for i in block:
                samples[i] = rows[at : at + images[i][3] // 8].ravel()
                at += images[i][3] // 8
    parts: list[list[int]] = [[] for _ in media]
    for i, image in enumerate(images):
        parts[image[0]].append(i)
    return [(np.concatenate([samples[i] for i in own]), images[own[0]][2], sum(images[i][3] for i in own)) for own in parts]


def _blocks(members: list, sizes: list[int], most: int = 1 << 20):
    """Runs of members of about ``most`` bytes in all."""
    held, total = [], 0
    for one, size in zip(members, sizes, strict=True):
        held.append(one)
        total += size
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def thumbnail_hash(samples: np.ndarray) -> str:
    """Average hash: 8x8 means of the samples against their mean, as 16 hex digits."""
    rows = samples.reshape(-1, WIDE)
    edges = np.arange(8) * len(rows) // 8
    small = np.add.reduceat(rows.reshape(len(rows), 8, 3).sum(2, dtype=np.int64), edges, axis=0) / (np.diff(np.append(edges, len(rows))) * 3)[:, None]
    return np.packbits(small > small.mean()).tobytes().hex()


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(TILE, -(-len(raw) // TILE) * TILE) - len(raw))


def _record(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


def with_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the ``media`` column of each whole text; a null text is as an empty one."""
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]

    def run(batch: pa.RecordBatch):
        rows = [(d, raw or b"") for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
        for block in _blocks(rows, [len(raw) for _, raw in rows]):
            media = encode_many([payload_of(raw) for _, raw in block])
            yield _record([(d, len(raw), m) for (d, raw), m in zip(block, media, strict=True)], schema)

    return map_arrow(doc_text(documents), run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of what the ``media`` column gives back; doc_id may be null, repeated rows stay."""
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored, rows = batch.column("media").to_pylist(), []
        for doc_id, n, kept, (samples, wide, high) in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), stored, decode_many(stored), strict=True):
            payload = samples.tobytes()
            feature = f"{wide}x{high}:{thumbnail_hash(samples)}"
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), feature, wide, high))
        return _record(rows, schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.int32(): "int"}
    return map_arrow(media, run, ", ".join(f"{n} {kinds[k]}" for n, k in schema))
