"""PNG, orientation, alpha and CSV text."""

import zlib

import numpy as np
import pytest

from latticework.sources import images as I


def test_png_round_trip():
    image = np.random.default_rng(0).integers(0, 256, (50, 40, 4)).astype(np.uint8)
    data = I.write_png(image)
    assert (I.read_png(data) == image).all() and data == I.write_png(image)
    for bad in (b"x", data[:60], data[:45] + b"\0" + data[46:]):
        with pytest.raises(ValueError):
            I.read_png(bad)
    long = bytes(range(256)) * 600
    assert zlib.decompress(I.stored_zlib(long)) == long and zlib.decompress(I.stored_zlib(b"")) == b""


def test_filters():
    gray = np.array([[10, 20, 30], [15, 25, 40], [5, 6, 7], [9, 9, 9]])
    lines, before = [], np.zeros(3, dtype=int)
    for kind, row in zip((1, 2, 3, 4), gray):
        line = []
        for k in range(3):
            left, up, corner = (row[k - 1] if k else 0), before[k], (before[k - 1] if k else 0)
            p = left + up - corner
            guess = {1: left, 2: up, 3: (left + up) // 2, 4: min((left, up, corner), key=lambda v: abs(p - v))}[kind]
            line.append((row[k] - guess) & 255)
        lines.append(bytes([kind, *map(int, line)]))
        before = row
    data = I.SIGNATURE + I._chunk(b"IHDR", (3).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\x08\0\0\0\0") + I._chunk(b"IDAT", zlib.compress(b"".join(lines))) + I._chunk(b"IEND", b"")
    assert (I.read_png(data)[..., 0] == gray).all()


def test_orientation():
    exif = b"Exif\0\0MM\0\x2a\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xda"
    assert I.exif_orientation(jpeg) == 6 and I.exif_orientation(b"\xff\xd8\xff\xda") is None
    a = np.array([[1, 2], [3, 4]])
    assert [I.oriented(a, k).ravel().tolist() for k in range(1, 9)] == [[1, 2, 3, 4], [2, 1, 4, 3], [4, 3, 2, 1], [3, 4, 1, 2], [1, 3, 2, 4], [3, 1, 4, 2], [4, 2, 3, 1], [2, 4, 1, 3]]


def test_alpha():
    px = np.array([[[50, 100, 0, 128], [9, 9, 9, 0]]], dtype=np.uint8)
    assert I.unpremultiplied(px).tolist() == [[[100, 199, 0, 128], [0, 0, 0, 0]]]
    assert I.over(px, (255, 255, 255))[0, 1].tolist() == [255, 255, 255]


def test_csv(spark):
    assert I.parse_csv("a,b\r\n\r\nc,d\r\n") == [["a", "b"], [""], ["c", "d"]]
    assert I.parse_csv('"x""y\n",z\r"q"') == [['x"y\n', "z"], ["q"]] and I.parse_csv("") == [] and I.parse_csv("a,") == [["a", ""]]
    with pytest.raises(I.CsvError) as e:
        I.parse_csv('a,"unterminated')
    assert e.value.offset == 2
    df = spark.createDataFrame([(1, "a,b\nc"), (2, 'a,"b')], "id int, t string")
    got = [(r.id, r.row_no, r.fields, r.error is None) for r in I.csv_rows(df, "id", "t").orderBy("id", "row_no").collect()]
    assert got == [(1, 0, ["a", "b"], True), (1, 1, ["c"], True), (2, -1, [], False)]
