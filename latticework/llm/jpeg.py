"""Baseline JPEG: writing payloads losslessly, and reading dimensions and DC-only thumbnails.

Reader: markers are parsed, scans are Huffman-decoded with array operations and
each block's DC coefficient gives one luminance sample of the thumbnail.  All
restart intervals of a batch of images are decoded in step, one symbol of each
at a time, so images with many intervals decode fast and those without decode
right.  One- and three-component baseline images are read, with any sampling;
progressive, arithmetic, 12-bit and broken files give a status and no features.

Writer: every payload byte is one 8x8 block of one component.  With a DC
quantiser of 8 the block's DC coefficient is the byte minus 128 and the decoded
luminance is the byte itself, so the stored form is lossless.  Rows are 576
blocks wide; a restart marker follows each 48 blocks.  A payload beyond the
height limit of 65,535 lines continues in further images laid end to end.

Defined cases: a null or empty text is stored as one unit of filler bytes;
equal texts give equal bytes; rows are independent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import column_bytes, ragged, slices

UNIT = 576
#: Blocks between restart markers, and block rows of one image (65,535 lines at most).
INTERVAL, MOST_ROWS = 48, 8191
#: Bytes of text stored at once.
STEP = 1 << 20
# The usual luminance DC table (code counts by length, then categories).
DC_COUNTS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: One AC code is enough: the end of the block.
AC_COUNTS, AC_VALUES = bytes([0, 1] + [0] * 14), bytes([0])


def code_table(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Value and code length for each 16 bits that come next; length 0: no code."""
    value, length = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            lo = code << (16 - bits)
            hi = (code + 1) << (16 - bits)
            value[lo:hi], length[lo:hi] = values[k], bits
            code, k = code + 1, k + 1
        code <<= 1
    return value, length


def _codes(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out[values[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of the whole block, and how many."""
    dc, (end, end_bits) = _codes(DC_COUNTS, DC_VALUES), _codes(AC_COUNTS, AC_VALUES)[0]
    bits, sizes = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits.append((((code << size) | extra) << end_bits) | end)
        sizes.append(n + size + end_bits)
    return np.array(bits, dtype=np.uint64), np.array(sizes, dtype=np.int64)


_BITS, _SIZES = _writer_tables()


def _header(rows: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return (
        b"\xff\xd8"
        + segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
        + segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0))
        + segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_VALUES + bytes([0x10]) + AC_COUNTS + AC_VALUES)
        + segment(0xDD, struct.pack(">H", INTERVAL))
        + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def store(payloads: np.ndarray, units: np.ndarray) -> list[bytes]:
    """The stored form of each payload; payloads lie end to end and have `units` times UNIT bytes."""
    # entropy-coded bytes of all intervals at once
    dc = payloads.astype(np.int64) - 128
    diff = dc.copy()
    diff[1:] -= dc[:-1]
    diff[::INTERVAL] = dc[::INTERVAL]  # UNIT is a multiple of INTERVAL
    code, size = _BITS[diff + 255], _SIZES[diff + 255]
    lanes = len(payloads) // INTERVAL
    size = size.reshape(lanes, INTERVAL)
    upto = np.cumsum(size, axis=1)
    total = upto[:, -1]
    n_bytes = (total + 7) // 8
    base = np.append(0, np.cumsum(n_bytes))
    at = (upto - size + base[:-1, None] * 8).ravel()
    size = size.ravel()
    out = np.zeros(int(base[-1]) + 8, dtype=np.uint8)
    # a code has at most 26 bits, so it touches at most 5 bytes; at each place, all codes of one residue are disjoint
    shift = (40 - (at & 7) - size).astype(np.uint64)
    word, byte = code << shift, at >> 3
    sums = np.zeros(len(out), dtype=np.float64)
    for k in range(5):
        part = ((word >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64)
        sums += np.bincount(byte + k, weights=part, minlength=len(out))
    out = sums.astype(np.uint8)
    pad = (-total) % 8
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[: int(base[-1])]
    # a zero follows each 0xFF; a restart marker follows each interval
    extra = np.zeros(len(out) + 1, dtype=np.int64)
    extra[1:] = np.cumsum(out == 255)
    grown = base + extra[base]
    stuffed = np.zeros(int(grown[-1]), dtype=np.uint8)
    stuffed[np.arange(len(out)) + extra[:-1]] = out
    raw = stuffed.tobytes()
    per_unit = UNIT // INTERVAL
    made, lane = [], 0
    cuts = grown.tolist()
    for u in units.tolist():
        parts = []
        for first in range(0, u, MOST_ROWS):
            rows = min(MOST_ROWS, u - first)
            n = rows * per_unit
            parts.append(_header(rows))
            for k in range(n):
                parts.append(raw[cuts[lane + k] : cuts[lane + k + 1]])
                if k < n - 1:
                    parts.append(_RESTART[k & 7])
            parts.append(b"\xff\xd9")
            lane += n
        made.append(b"".join(parts))
    return made


_RESTART = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


@dataclass
class Image:
    """What the markers of one image say; thumbnail: one luminance sample per block, or None with a status."""

    status: str = "ok"
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser number
    scan: list = field(default_factory=list)  # component number, DC table, AC table, in scan order
    quant: dict = field(default_factory=dict)  # number: DC step
    tables: dict = field(default_factory=dict)  # class and number: key of the code table
    interval: int = 0
    data: tuple = (0, 0)  # entropy-coded bytes
    end: int = 0
    thumbnail: np.ndarray | None = None


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _marked(blob: bytes, at: int) -> Image:
    """Parse the markers of the image that starts at `at`."""
    im = Image()
    if blob[at : at + 2] != b"\xff\xd8":
        im.status, im.end = "no_image", len(blob)
        return im
    at += 2
    try:
        while True:
            if blob[at] != 0xFF:
                raise ValueError("marker")
            while blob[at + 1] == 0xFF:
                at += 1
            kind = blob[at + 1]
            if kind == 0xD9:
                raise ValueError("no_scan")
            n = struct.unpack_from(">H", blob, at + 2)[0]
            body = blob[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise ValueError("truncated")
            at += 2 + n
            if kind == 0xDB:
                k = 0
                while k < len(body):
                    wide, number = body[k] >> 4, body[k] & 15
                    im.quant[number] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (2 if wide else 1)
            elif kind == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    key = counts + body[k + 17 : k + 17 + sum(counts)]
                    if key not in _tables:
                        if len(_tables) > 64:
                            _tables.clear()
                        _tables[key] = code_table(key[:16], key[16:])
                    im.tables[body[k] >> 4, body[k] & 15] = _tables[key]
                    k += 17 + sum(counts)
            elif kind == 0xC0:
                depth, im.height, im.width, n_parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or not im.height or not im.width or n_parts not in (1, 3):
                    raise ValueError("unsupported")
                im.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n_parts)]
            elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("unsupported")
            elif kind == 0xDD:
                im.interval = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                numbers = [p[0] for p in im.parts]
                if body[0] != len(numbers):
                    raise ValueError("unsupported")  # scans of single components aren't joined
                im.scan = [(numbers.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        stop = at
        while True:  # the next marker that is no stuffing and no restart
            stop = blob.index(b"\xff", stop)
            if blob[stop + 1] == 0 or 0xD0 <= blob[stop + 1] <= 0xD7:
                stop += 2
            else:
                break
        im.data = (at, stop)
        im.end = stop + 2 if blob[stop + 1] == 0xD9 else len(blob)
    except (ValueError, IndexError, struct.error) as e:
        im.status = str(e) if str(e) in ("unsupported", "no_scan") else "broken"
        after = blob.find(b"\xff\xd9\xff\xd8", at)
        im.end = after + 2 if after >= 0 else len(blob)
    return im


def _decode(images: list[tuple[np.ndarray, Image]]) -> None:
    """Set the thumbnails of images that share tables and layout."""
    first = images[0][1]
    sampled = len(first.parts) > 1
    across, down = max(p[1] for p in first.parts), max(p[2] for p in first.parts)
    # the blocks of one unit of the scan, as component numbers
    units = [c for c, _, _ in first.scan for _ in range(first.parts[c][1] * first.parts[c][2] if sampled else 1)]
    tables = {c: (first.tables[0, dc], first.tables[1, ac]) for c, dc, ac in first.scan}
    joined, cuts, lane_units, owner, at = [], [], [], [], 0
    for k, (data, im) in enumerate(images):
        wide = -(-im.width // (8 * across)) if sampled else -(-im.width // 8)
        high = -(-im.height // (8 * down)) if sampled else -(-im.height // 8)
        n = wide * high
        ff = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, dtype=np.int64)
        follow = data[ff + 1]
        marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        drop = np.zeros(len(data), dtype=bool)
        drop[ff[follow == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        kept = np.cumsum(~drop)
        starts = np.append(0, kept[marks])
        step = im.interval or n
        lanes = -(-n // step)
        if len(starts) != lanes:
            im.status = "broken"
            starts = np.resize(starts, lanes)
        plain = data[~drop]
        joined.append(plain)
        cuts.append(starts + at)
        lane_units.append(np.minimum(step, n - step * np.arange(lanes)))
        owner.append(np.full(lanes, k))
        at += len(plain)
    data = np.concatenate([*joined, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    bit = np.concatenate(cuts) * 8
    count = np.concatenate(lane_units) * len(units)
    lanes, most = len(bit), int(count.max())
    top = (len(data) - 5) * 8
    # lanes by length, longest first, so that the active ones are a prefix
    order = np.argsort(-count, kind="stable")
    bit, count = bit[order], count[order]
    last = np.zeros((len(first.parts), lanes), dtype=np.int32)
    lum = np.zeros((lanes, most), dtype=np.int16)
    bad = np.zeros(lanes, dtype=bool)

    def peek(b: np.ndarray) -> np.ndarray:
        i = b >> 3
        return (((data[i] << np.uint32(16)) | (data[i + 1] << np.uint32(8)) | data[i + 2]) >> (np.uint32(8) - (b & 7).astype(np.uint32))) & np.uint32(0xFFFF)

    active = lanes
    for block in range(most):
        while active and count[active - 1] <= block:
            active = int(np.searchsorted(-count[:active], -block, side="left"))
        part = units[block % len(units)]
        (dc_value, dc_bits), (ac_value, ac_bits) = tables[part]
        b = bit[:active]
        code = peek(b)
        size, used = dc_value[code].astype(np.int32), dc_bits[code]
        bad[:active] |= (used == 0) | (size > 11)
        size = np.minimum(size, 11)
        b = b + used
        extra = (peek(b) >> (16 - size).astype(np.uint32)).astype(np.int32)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        value[size == 0] = 0
        last[part, :active] += value
        lum[:active, block] = last[part, :active]
        b = np.minimum(b + size, top)
        # AC coefficients are passed over, to the end of each block
        todo, k = np.arange(active), np.ones(active, dtype=np.int32)
        while len(todo):
            code = peek(b[todo])
            symbol, used = ac_value[code], ac_bits[code]
            bad[todo] |= used == 0
            run, size = symbol >> 4, symbol & 15
            b[todo] = np.minimum(b[todo] + used + size, top)
            k[todo] += run + np.where((size == 0) & (run != 15), 64, 1)
            todo = todo[(k[todo] < 64) & (used > 0)]
        bit[:active] = b
    back = np.empty(lanes, dtype=np.int64)
    back[order] = np.arange(lanes)
    lum, bad, count, owner = lum[back], bad[back], count[back], np.concatenate(owner)
    edges = np.searchsorted(owner, np.arange(len(images) + 1))
    own = first.scan[0][0]
    for k, (_, im) in enumerate(images):
        lo, hi = edges[k], edges[k + 1]
        if bad[lo:hi].any():
            im.status = "broken"
        if im.status != "ok":
            continue
        rows = lum[lo:hi]
        flat = rows.ravel() if (count[lo:hi] == rows.shape[1]).all() else np.concatenate([r[:c] for r, c in zip(rows, count[lo:hi])])
        if sampled:
            wide, high = -(-im.width // (8 * across)), -(-im.height // (8 * down))
            h, v = im.parts[own][1], im.parts[own][2]
            flat = flat.reshape(high, wide, len(units))[:, :, : h * v].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        else:
            flat = flat.reshape(-(-im.height // 8), -(-im.width // 8))
        step = im.quant.get(im.parts[own][3], 1)
        im.thumbnail = np.clip((flat.astype(np.int64) * step + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-im.height // 8), : -(-im.width // 8)]


def read(blobs: list[bytes]) -> list[list[Image]]:
    """The images of each stored form, thumbnails decoded."""
    out, groups = [], {}
    for blob in blobs:
        own, at = [], 0
        view = np.frombuffer(blob, dtype=np.uint8)
        while at < len(blob) or not own:
            im = _marked(blob, at)
            own.append(im)
            at = max(im.end, at + 1)
            if im.status == "ok":
                try:
                    key = (tuple(p[1:3] for p in im.parts), tuple(im.scan), tuple(id(im.tables[t, n]) for _, dc, ac in im.scan for t, n in ((0, dc), (1, ac))))
                except KeyError:
                    im.status = "broken"
                    continue
                groups.setdefault(key, []).append((view[im.data[0] : im.data[1]], im))
        out.append(own)
    for group in groups.values():
        _decode(group)
    return out


def thumbnail_hash(samples: np.ndarray) -> str:
    """64 bits as hex: the cells of an 8x8 grid over the thumbnail that are brighter than its mean."""
    h, w = samples.shape
    sums = np.zeros((h + 1, w + 1), dtype=np.int64)
    sums[1:, 1:] = samples
    np.cumsum(sums, axis=0, out=sums)
    np.cumsum(sums, axis=1, out=sums)
    y0, x0 = np.arange(8) * h // 8, np.arange(8) * w // 8
    y1, x1 = np.maximum((np.arange(8) + 1) * h // 8, y0 + 1), np.maximum((np.arange(8) + 1) * w // 8, x0 + 1)
    cell = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    bright = cell * (h * w) > sums[-1, -1] * area
    return np.packbits(bright).tobytes().hex()


def feature(images: list[Image]) -> str:
    """Dimensions and thumbnail hash of each image, or its status."""
    return ";".join(f"{i.width}x{i.height}:{thumbnail_hash(i.thumbnail)}" if i.thumbnail is not None else i.status for i in images)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payloads end to end, their units, and the bytes before padding."""
    data, offsets = column_bytes(column)
    n = np.diff(offsets)
    units = np.maximum(1, -(-n // UNIT))
    out = np.full(int(units.sum()) * UNIT, 255, dtype=np.uint8)
    at = (np.cumsum(units) - units) * UNIT
    out[ragged(at, n)] = data
    return out, units, n


def media_features(media: DataFrame, column: str) -> DataFrame:
    """media's other columns with status, width, height, feature and thumbnail (its bytes) of the first image in `column`."""
    new = {"status": pa.string(), "width": pa.int32(), "height": pa.int32(), "feature": pa.string(), "thumbnail": pa.binary()}
    rest = [c for c in media.columns if c != column and c not in new]
    source = media.select(*rest, column)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in rest] + ["status string, width int, height int, feature string, thumbnail binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, STEP):
            blobs = [b or b"" for b in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            seen = read(blobs)
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in rest}
            head = [s[0] for s in seen]
            out["status"] = pa.array([i.status for i in head], pa.string())
            out["width"], out["height"] = pa.array([i.width for i in head], pa.int32()), pa.array([i.height for i in head], pa.int32())
            out["feature"] = pa.array([feature(s) for s in seen], pa.string())
            out["thumbnail"] = pa.array([None if i.thumbnail is None else i.thumbnail.tobytes() for i in head], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, schema)


def stored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as JPEG and read back: sizes, digests of the payload read, of the stored form, and its feature; media with `with_media`."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP):
            payloads, units, n = padded(batch.column(1))
            media = store(payloads, units)
            seen = read(media)
            back = [b"".join(i.thumbnail.tobytes() for i in s) for s in seen]
            out = {
                "doc_id": batch.column(0),
                "n_bytes": pa.array(n, pa.int64()),
                "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                "feature": pa.array([feature(s) for s in seen], pa.string()),
            }
            if with_media:
                out["media"] = pa.array(media, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, schema)
