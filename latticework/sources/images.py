"""Image bytes: PNG with stored deflate, EXIF orientation, alpha; plain functions and their DataFrame form."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def stored_zlib(data: bytes) -> bytes:
    """A zlib stream of stored blocks of at most 65,535 bytes: the same bytes on every machine."""
    out = [b"\x78\x01"]
    blocks = [data[k : k + 65_535] for k in range(0, len(data), 65_535)] or [b""]
    for k, block in enumerate(blocks):
        out.append(struct.pack("<BHH", k == len(blocks) - 1, len(block), len(block) ^ 0xFFFF) + block)
    return b"".join(out) + struct.pack(">I", zlib.adler32(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(rgba: np.ndarray) -> bytes:
    """RGBA samples [y, x, 4] as an 8-bit PNG without filters or compression."""
    h, w = rgba.shape[:2]
    if not h or not w:
        raise ValueError("an image has at least one pixel")
    rows = np.zeros((h, 1 + 4 * w), dtype=np.uint8)
    rows[:, 1:] = rgba.reshape(h, 4 * w)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", stored_zlib(rows.tobytes())) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """RGBA samples of an 8-bit RGBA, RGB or gray PNG without interlacing; checks every chunk's CRC."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body = 8, None, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("unsupported PNG")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(h, 1 + channels * w)
    out = np.zeros((h, channels * w), dtype=np.uint8)
    before = np.zeros(channels * w, dtype=np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).ravel() & 255
        elif kind in (3, 4):
            for k in range(channels * w):
                left, up, corner = (line[k - channels] if k >= channels else 0), before[k], (before[k - channels] if k >= channels else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[k] = (line[k] + guess) & 255
        elif kind:
            raise ValueError("unknown filter")
        out[y], before = line, line
    samples = out.reshape(h, w, channels)
    if channels == 1:
        samples = np.repeat(samples, 3, axis=2)
    if samples.shape[2] == 3:
        samples = np.concatenate([samples, np.full((h, w, 1), 255, dtype=np.uint8)], axis=2)
    return samples


def exif_orientation(data: bytes) -> int | None:
    """1 to 8 from a JPEG's EXIF block, else None."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            t = data[at + 10 : at + 2 + n]
            order = {b"II": "<", b"MM": ">"}.get(t[:2])
            try:
                first = struct.unpack_from(order + "I", t, 4)[0]
                for k in range(struct.unpack_from(order + "H", t, first)[0]):
                    tag, kind, _, value = struct.unpack_from(order + "HHIH", t, first + 2 + 12 * k)
                    if tag == 274 and kind == 3:
                        return value if 1 <= value <= 8 else None
            except (TypeError, struct.error):
                return None
        at += 2 + n
    return None


def oriented(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """The image as it is to be seen: flips and quarter turns of the eight orientations."""
    turns = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1), 6: lambda a: a[::-1].swapaxes(0, 1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: a[:, ::-1].swapaxes(0, 1)}
    return turns.get(orientation or 1, lambda a: a)(image)


def unpremultiplied(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(np.int64)
    colour = np.where(a > 0, np.minimum(255, (rgba[..., :3].astype(np.int64) * 255 + a // 2) // np.maximum(a, 1)), 0)
    return np.concatenate([colour, a], axis=-1).astype(np.uint8)


def over(rgba: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """RGB of the image laid over a colour, rounded half up."""
    a = rgba[..., 3:].astype(np.int64)
    return ((rgba[..., :3].astype(np.int64) * a + np.array(background) * (255 - a) + 127) // 255).astype(np.uint8)


@dataclass
class CsvError(ValueError):
    offset: int

    def __str__(self) -> str:
        return f"quote opened at byte {self.offset} is never closed"


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of RFC 4180 text with CRLF, LF or CR ends; a blank line is a row of one empty field, a last empty line none."""
    rows, row, field, k, n = [], [], [], 0, len(text)
    quoted_at, fresh = -1, True
    while k < n:
        c = text[k]
        if quoted_at >= 0:
            if c == '"' and text[k + 1 : k + 2] == '"':
                field.append('"')
                k += 1
            elif c == '"':
                quoted_at = -1
            else:
                field.append(c)
        elif c == '"' and fresh:
            quoted_at = k
            fresh = False
        elif c == delimiter:
            row.append("".join(field))
            field, fresh = [], True
        elif c in "\r\n":
            if c == "\r" and text[k + 1 : k + 2] == "\n":
                k += 1
            rows.append([*row, "".join(field)])
            row, field, fresh = [], [], True
        else:
            field.append(c)
            fresh = False
        k += 1
    if quoted_at >= 0:
        raise CsvError(len(text[:quoted_at].encode()))
    if row or field or not fresh:
        rows.append([*row, "".join(field)])
    return rows


def csv_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row_no, fields, error of each text's rows; one row with the error where a quote is never closed."""
    kept = f"`{key}` {df.schema[key].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                try:
                    out += [(k, i, r, None) for i, r in enumerate(parse_csv(t or ""))]
                except CsvError as e:
                    out.append((k, -1, [], str(e)))
            yield pd.DataFrame(out, columns=[key, "row_no", "fields", "error"])

    return df.select(key, text).mapInPandas(run, f"{kept}, row_no int, fields array<string>, error string")
