"""Baseline JPEG as a lossless column of bytes, and DC-only decoding of any baseline JPEG.

A payload byte is the DC coefficient of one 8x8 block: with a DC quantiser of 8 the block is flat
and its grey value is that byte, so the file is a valid baseline JPEG whose DC-only thumbnail
(one sample per block) is the payload itself. Rows of 64 blocks end in restart markers, which makes
each row independent and lets numpy decode all rows in step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

ROW = 64  # blocks in a row of stored bytes
MOST_ROWS = 8191  # of 8 pixels each: a JPEG has at most 65,535 lines
SLICE = 1 << 20  # bytes worked on at a time
# fixed values: DC categories 0-8 as the first codes of a 4-bit code; AC has only end-of-block
DC_COUNTS, DC_VALUES = bytes([0, 0, 0, 9, *[0] * 12]), bytes(range(9))
AC_COUNTS, AC_VALUES = bytes([1, *[0] * 15]), bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, *[8] * 64]))
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_VALUES)
        + _segment(0xC4, bytes([0x10]) + AC_COUNTS + AC_VALUES)
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: its bits with end of block, and how many."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diff])
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return (((size << size) | extra) << 1).astype(np.uint64), (4 + size + 1).astype(np.uint64)


BITS_OF, WIDTH_OF = _symbols()


def _scan(rows: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each row of ROW samples, stuffed, without markers."""
    n = len(rows)
    diff = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128)) + np.int16(255)
    value, width = BITS_OF[diff], WIDTH_OF[diff]
    for _ in range(2):  # join neighbours: four symbols are at most 52 bits
        value = (value[:, ::2] << width[:, 1::2]) | value[:, 1::2]
        width = width[:, ::2] + width[:, 1::2]
    ends = np.cumsum(width, axis=1).astype(np.int64)
    total = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(total)])
    begin = (base[:-1, None] * 8 + ends).ravel() - width.ravel().astype(np.int64)
    value = value.ravel() << (np.uint64(64) - width.ravel() - (begin & 7).astype(np.uint64))
    data, first = np.zeros(int(base[-1]) + 8, np.uint8), begin >> 3
    for k, part in enumerate(value.astype(">u8").view(np.uint8).reshape(-1, 8).T):
        data[first + k] |= part  # places differ: each value has over 8 bits
    data = data[:-8]
    data[base[1:] - 1] |= ((1 << (total * 8 - ends[:, -1])) - 1).astype(np.uint8)  # padding is ones
    full = np.flatnonzero(data == 255)
    stuffed = np.insert(data, full + 1, 0) if len(full) else data
    edge = base + np.searchsorted(full, base)
    buf = stuffed.tobytes()
    return [buf[edge[i] : edge[i + 1]] for i in range(n)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Store each payload (a positive multiple of 64 bytes) as one or more baseline JPEG files in a row."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    scans: list[bytes] = []
    for i in range(0, len(rows), SLICE // ROW):
        scans += _scan(rows[i : i + SLICE // ROW])
    out, at = [], 0
    restart = [bytes([255, 0xD0 + k]) for k in range(8)]
    for p in payloads:
        media = []
        upto = at + len(p) // ROW
        while at < upto:
            end = min(upto, at + MOST_ROWS)
            media.append(_header(end - at))
            for k, i in enumerate(range(at, end - 1)):
                media += (scans[i], restart[k & 7])
            media += (scans[end - 1], b"\xff\xd9")
            at = end
        out.append(b"".join(media))
    return out


class Unsupported(ValueError):
    """Not a baseline JPEG."""


@lru_cache(64)
def _table(counts: bytes, values: bytes, direct: bool = False) -> np.ndarray:
    """For every 16 bits ahead: code length << 8 | value; 0 where no code fits.

    direct: where code and its extra bits fit into 16, (difference + 2**15) << 8 | bits of both, else 0.
    """
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, many in enumerate(counts, 1):
        for _ in range(many):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | values[k]
            code, k = code + 1, k + 1
        code <<= 1
    if not direct:
        return out
    length, size = out >> 8, np.minimum(out & 255, 16)
    left = 16 - length - size
    extra = (np.arange(1 << 16) >> np.maximum(left, 0)) & ((1 << size) - 1)
    diff = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
    return np.where((out > 0) & (left >= 0), (diff + (1 << 15)) << 8 | (length + size), 0)


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Read the markers of one baseline file from `at`; returns its description and where it ends.

    The description has width, height, components (id, h, v, quantiser), quantisers, tables, interval and scan (first and past-the-end
    byte of the entropy-coded part).
    """
    if data[at : at + 2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    at += 2
    d: dict = {"quant": {}, "tables": {}, "interval": 0}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 255:
            raise Unsupported("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                d["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise Unsupported("precision")
            d["height"], d["width"] = struct.unpack(">HH", body[1:5])
            d["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC4 and marker != 0xCC:
            raise Unsupported("not baseline")
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                d["tables"][body[0]] = (body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xDD:
            d["interval"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            d["order"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise Unsupported("scan does not end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            if len(d["order"]) != len(d.get("parts", ())):
                raise Unsupported("more than one scan")
            d["scan"] = (at, end)
            return d, end + 2 if data[end + 1] == 0xD9 else len(data)


def _lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: list[tuple[int, tuple, tuple]]) -> np.ndarray:
    """Decode restart intervals in step. data: unstuffed bytes and 16 more; starts: bit offsets;
    blocks: MCUs of each lane. layout: per block of an MCU (component, DC code, AC code). Returns the DC
    of all MCUs, lane after lane, one column per block of an MCU."""
    words = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))  # 64 bits from each byte on
    limit = np.int64(8 * len(words) - 8)
    lanes, most = len(starts), int(blocks.max(initial=0))
    order = np.argsort(-blocks, kind="stable")
    at, left = starts[order].copy(), blocks[order]
    out = np.zeros((most, len(layout), lanes), np.int16)
    last = np.zeros((1 + max(c for c, _, _ in layout), lanes), np.int64)
    built = [(c, _table(*dc, direct=True), _table(*dc), _table(*ac)) for c, dc, ac in layout]
    u48 = np.uint64(48)
    for m in range(most):
        n = int(np.searchsorted(-left, -m, side="left"))  # lanes with more than m MCUs
        for b, (part, direct, dc, ac) in enumerate(built):
            pos = at[:n]
            word = words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
            code = direct[word >> u48]
            diff, taken = (code >> 8) - (1 << 15), code & 255
            slow = np.flatnonzero(code == 0)
            if len(slow):  # code and extra bits over 16
                w = word[slow]
                c = dc[w >> u48]
                if not c.all():
                    raise Unsupported("broken Huffman code")
                length, size = c >> 8, c & 255
                extra = ((w << length.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) >> (31 - size)
                diff[slow] = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
                taken[slow] = length + size
            last[part, :n] += diff
            out[m, b, :n] = last[part, :n]
            code = ac[(word << taken.astype(np.uint64)) >> u48]
            size, run = code & 15, (code >> 4) & 15
            pos = pos + taken + (code >> 8) + size
            k = run + 2
            busy = np.flatnonzero((code & 255) != 0)
            busy = busy[((size[busy] > 0) | (run[busy] == 15)) & (k[busy] < 64)]
            while len(busy):
                p = np.minimum(pos[busy], limit)
                code = ac[(words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)) >> u48]
                if not code.all():
                    raise Unsupported("broken Huffman code")
                size, run = code & 15, (code >> 4) & 15
                pos[busy] = p + (code >> 8) + size
                k[busy] += run + 1
                busy = busy[((size > 0) | (run == 15)) & (k[busy] < 64)]
            at[:n] = np.minimum(pos, limit)
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    out = out.transpose(2, 0, 1)[back]
    return out[np.arange(most)[None] < blocks[:, None]]


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """DC-only luminance of every file in each value: (width, height, grey levels, one per 8x8 block of the first component).

    Handles one or three components, subsampling, restart intervals and concatenated files.
    Files with equal tables are decoded together.
    """
    jobs: dict[tuple, list[tuple[int, int, dict, list[np.ndarray]]]] = {}
    out: list[list] = []
    for i, data in enumerate(media):
        at, files = 0, []
        while at < len(data):
            d, at = parse(data, at)
            a, b = d["scan"]
            raw = np.frombuffer(data, np.uint8, b - a, a)
            mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if b - a > 1 else np.empty(0, np.int64)
            key = (d["width"] if not d["interval"] else 0, tuple(d["parts"]), tuple(d["order"]), tuple(sorted(d["tables"].items())))
            jobs.setdefault(key, []).append((i, len(files), d, (raw, mark)))
            files.append(None)
        out.append(files)
    for (_, parts, order, tables), work in jobs.items():
        codes = dict(tables)
        hs, vs = max(p[1] for p in parts), max(p[2] for p in parts)
        one = len(parts) == 1
        layout = []
        for c, (_, dc, ac) in enumerate(order):
            for _ in range(1 if one else parts[c][1] * parts[c][2]):
                layout.append((c, codes[dc], codes[16 + ac]))
        chunks, starts, counts, base = [], [], [], 0
        for _, _, d, (raw, mark) in work:
            across = -(-d["width"] // (8 if one else 8 * hs))
            mcus = across * -(-d["height"] // (8 if one else 8 * vs))
            step = d["interval"] or mcus
            drop = np.ones(len(raw), bool)
            if len(raw) > 1:
                drop[1:] = ~((raw[:-1] == 255) & (raw[1:] == 0))
            drop[mark] = drop[mark + 1] = False
            left = np.concatenate([[0], np.cumsum(drop)])
            begin = np.concatenate([[0], left[mark + 2]]) if len(mark) else np.zeros(1, np.int64)
            lanes = -(-mcus // step)
            if len(begin) != lanes:
                raise Unsupported("restart markers do not match the size")
            chunks.append(raw[drop])
            starts.append((base + begin) * 8)
            counts.append(np.minimum(step, mcus - step * np.arange(lanes)))
            base += len(chunks[-1])
        data = np.concatenate([*chunks, np.zeros(16, np.uint8)])
        blocks = _lanes(data, np.concatenate(starts), np.concatenate(counts), layout)
        at = 0
        for (i, f, d, _), n in zip(work, counts, strict=True):
            mine = blocks[at : at + int(n.sum())]
            at += len(mine)
            across = -(-d["width"] // (8 if one else 8 * hs))
            h, v = (1, 1) if one else parts[0][1:3]
            grid = mine[:, : h * v].reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
            rows, columns = (d["height"], d["width"]) if one else (-(-d["height"] * v // vs), -(-d["width"] * h // hs))  # of the component
            grid = grid[: -(-rows // 8), : -(-columns // 8)]
            q = int(d["quant"][parts[0][3]][0])
            out[i][f] = (d["width"], d["height"], np.clip(grid.astype(np.int64) * q // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """64-bit difference hash: block means on 8 x 9 cells, each compared with its right neighbour."""
    y = np.arange(9) * grey.shape[0] // 8 if grey.shape[0] >= 8 else None
    rows = np.minimum(np.arange(8) * grey.shape[0] // 8, grey.shape[0] - 1) if y is None else y[:8]
    cols = np.minimum(np.arange(9) * grey.shape[1] // 9, grey.shape[1] - 1)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    sums[1:, 1:] = grey.cumsum(0, dtype=np.int64).cumsum(1)
    r2 = np.maximum(rows + 1, np.append(rows[1:], grey.shape[0]))
    c2 = np.maximum(cols + 1, np.append(cols[1:], grey.shape[1]))
    area = (r2 - rows)[:, None] * (c2 - cols)[None]
    mean = (sums[np.ix_(r2, c2)] - sums[np.ix_(rows, c2)] - sums[np.ix_(r2, cols)] + sums[np.ix_(rows, cols)]) / area
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def _batches(it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in it:
        values = b.column(column).to_pylist()
        at = 0
        while at < len(values):
            upto, held = at, 0
            while upto < len(values) and (upto == at or held < SLICE):
                held += len(values[upto] or b"")
                upto += 1
            yield b.slice(at, upto - at), values[at:upto]
            at = upto


def store(df: DataFrame) -> DataFrame:
    """Each whole text as a media column: doc_id, n_bytes, media (binary). Null text: no bytes, one row of zeros. A null doc_id is kept, equal
    rows are stored each for itself, other columns are dropped, an empty table gives an empty result."""
    prepare(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _batches(it, 1):
            texts = [t or b"" for t in texts]
            media = encode_many([t + bytes(-len(t) % ROW or (0 if t else ROW)) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Decode stored media: payload digests, dimensions and thumbnail hash of each value.

    media: doc_id, n_bytes, media. feature is `width x height` summed over the files of a value, their
    number and the difference hash of the thumbnail.
    """
    prepare(media.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values in _batches(it, 2):
            size, sha, tail, stored, ssha, feature = [], [], [], [], [], []
            for value, files in zip(values, thumbnails(values), strict=True):
                grey = np.concatenate([g for _, _, g in files])
                payload = grey.tobytes()
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-64:]))
                stored.append(len(value))
                ssha.append(hashlib.sha256(value).hexdigest())
                feature.append(f"{files[0][0]}x{sum(h for _, h, _ in files)}:{len(files)}:{thumbnail_hash(grey)}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(stored, pa.int64()), pa.array(ssha), pa.array(feature)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
