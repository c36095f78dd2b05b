"""One-page PDF sheets of filled paths, and a strict reader that checks what it was given."""

from __future__ import annotations

import re

from ..functions.svg import number, parse_path

#: Points of a sheet's pixel.
POINT = 0.75


def _draw(data: str) -> str:
    point = lambda p: f"{number(p[0])} {number(p[1])}"
    out = []
    for p in parse_path(data):
        out.append(point(p["start"]) + " m")
        out += [" ".join(map(point, s)) + (" l" if len(s) == 1 else " c") for s in p["segments"]]
        out += ["h"] * p["closed"]
    return "\n".join([*out, "f*"])


def write(width: float, height: float, placed: list[dict], title: str = "") -> bytes:
    """A page of icons (tx, ty, scale, shapes of (fill, data)), y downwards as on the sheet."""
    ops = [f"{number(POINT)} 0 0 {number(-POINT)} 0 {number(height * POINT)} cm"]
    for icon in placed:
        ops.append(f"q {number(icon['scale'])} 0 0 {number(icon['scale'])} {number(icon['tx'])} {number(icon['ty'])} cm")
        for fill, data in icon["shapes"]:
            rgb = " ".join(number(int(fill[k : k + 2], 16) / 255) for k in (1, 3, 5))
            ops.append(f"{rgb} rg\n{_draw(data)}")
        ops.append("Q")
    stream = "\n".join(ops).encode("ascii")
    safe = re.sub(r"([\\()])", r"\\\1", re.sub(r"[^\x20-\x7e]", lambda m: " " if m[0] in "\r\n\t" else "?", title))
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {number(width * POINT)} {number(height * POINT)}] /Contents 4 0 R /Resources << >> >>".encode(),
        b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream",
        f"<< /Title ({safe}) >>".encode(),
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start)
    return bytes(out)


def read(blob: bytes) -> dict:
    """pages, width, height (points) and fills of a file; ValueError names what is wrong with it."""
    if not blob.startswith(b"%PDF-"):
        raise ValueError("no header")
    tail = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", blob)
    if not tail:
        raise ValueError("no startxref")
    at = int(tail[1])
    head = re.compile(rb"xref\s+0 (\d+)\s").match(blob, at)
    if not head:
        raise ValueError(f"no xref table at {at}")
    objects = {}
    for k in range(int(head[1])):
        entry = blob[head.end() + 20 * k : head.end() + 20 * k + 20]
        m = re.fullmatch(rb"(\d{10}) (\d{5}) ([nf]) [\r\n]?\n?", entry)
        if not m:
            raise ValueError(f"xref entry {k} is malformed")
        if m[3] == b"n":
            place = int(m[1])
            body = re.compile(rb"%d %d obj\s(.*?)\sendobj" % (k, int(m[2])), re.S).match(blob, place)
            if not body:
                raise ValueError(f"object {k} isn't at {place}")
            objects[k] = body[1]
    trailer = re.search(rb"trailer\s*<<(.*?)>>\s*startxref", blob[at:], re.S)

    def follow(body: bytes, name: bytes) -> bytes:
        m = re.search(rb"/%s\s+(\d+) \d+ R" % name, body)
        if not m or int(m[1]) not in objects:
            raise ValueError(f"no /{name.decode()}")
        return objects[int(m[1])]

    pages = follow(follow(trailer[1] if trailer else b"", b"Root"), b"Pages")
    kids = re.search(rb"/Kids\s*\[([^\]]*)\]", pages)
    numbers = [int(n) for n in re.findall(rb"(\d+) \d+ R", kids[1])] if kids else []
    count = re.search(rb"/Count (\d+)", pages)
    if not numbers or not count or int(count[1]) != len(numbers):
        raise ValueError("the page tree doesn't count its pages")
    fills, size = 0, (0.0, 0.0)
    for n in numbers:
        if n not in objects:
            raise ValueError(f"page {n} is missing")
        box = re.search(rb"/MediaBox\s*\[\s*([^\]]*)\]", objects[n])
        corners = [float(v) for v in box[1].split()] if box else []
        if len(corners) != 4 or corners[2] <= corners[0] or corners[3] <= corners[1]:
            raise ValueError(f"page {n} has no box")
        size = (corners[2] - corners[0], corners[3] - corners[1])
        content = follow(objects[n], b"Contents")
        m = re.match(rb"<<.*?/Length (\d+).*?>>\s*stream\r?\n(.*)\r?\nendstream$", content, re.S)
        if not m or len(m[2]) != int(m[1]):
            raise ValueError(f"page {n}'s stream isn't as long as it says")
        fills += len(re.findall(rb"(?m)^f\*?$", m[2]))
    return {"pages": len(numbers), "width": size[0], "height": size[1], "fills": fills}
