"""SVG documents: a strict reader of a small subset, shapes with their colours, writers of icons and sheets, and their check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.svg import Affine, apply, compose, number, parse_path, parse_transform, write_path

_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\s+[A-Za-z_][\w:.-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_SKIPPED = re.compile(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*>", re.S)
# Entities, and elements whose content draws nothing.
ENTITIES = {"&quot;": '"', "&apos;": "'"}
SILENT = {"title", "desc", "metadata", "defs", "style"}


@dataclass(frozen=True)
class Shape:
    fill: str  # #rrggbbaa
    paths: tuple  # subpaths, in the document's coordinates


@dataclass(frozen=True)
class Document:
    view: tuple[float, float, float, float]
    shapes: tuple[Shape, ...]


def tags(text: str) -> Iterator[tuple[str, str, dict]]:
    """(kind, name, attributes) of each tag, kind open, close or empty; ValueError at anything else that looks like one."""
    at = 0
    while (at := text.find("<", at)) >= 0:
        if m := _SKIPPED.match(text, at):
            at = m.end()
            continue
        m = _TAG.match(text, at)
        if not m or (m[1] and (m[3].strip() or m[4])):
            raise ValueError(f"not a tag at {at}")
        attributes = {}
        for name, a, b in _ATTRIBUTE.findall(m[3]):
            if name in attributes:
                raise ValueError(f"{name} twice at {at}")
            attributes[name] = unescape(a or b, ENTITIES)
        yield "close" if m[1] else "empty" if m[4] else "open", m[2], attributes
        at = m.end()


def colour(text: str, opacity: str = "1") -> str:
    """#rrggbbaa of a hex colour or black, with an opacity."""
    body = {"black": "000000", "white": "ffffff"}.get(text, text[1:] if text.startswith("#") else "")
    if len(body) in (3, 4):
        body = "".join(2 * c for c in body)
    if not re.fullmatch(r"[0-9a-fA-F]{6}([0-9a-fA-F]{2})?", body):
        raise ValueError(f"not a colour: {text}")
    alpha = int(body[6:] or "ff", 16) * min(1.0, max(0.0, float(opacity)))
    return f"#{body[:6].lower()}{int(alpha + 0.5):02x}"


def _moved(paths: list[dict], m: Affine) -> tuple:
    return tuple({"start": apply(m, p["start"]), "segments": [tuple(apply(m, q) for q in s) for s in p["segments"]], "closed": p["closed"]} for p in paths)


def parse(text: str) -> Document:
    """The view and the filled paths of a document, transforms applied and fills inherited; ValueError rather than a guess."""
    open_tags: list[tuple[str, Affine, str, str]] = []
    view, shapes, closed = None, [], False
    for kind, name, at in tags(text):
        if closed:
            raise ValueError("content after the document")
        if kind == "close":
            if not open_tags or open_tags[-1][0] != name:
                raise ValueError(f"unexpected end of {name}")
            open_tags.pop()
            closed = not open_tags
            continue
        if view is None and name != "svg":
            raise ValueError("not an svg document")
        _, matrix, fill, opacity = open_tags[-1] if open_tags else ("", (1, 0, 0, 1, 0, 0), "black", "1")
        matrix = compose(matrix, parse_transform(at.get("transform", "")))
        fill, opacity = at.get("fill", fill), at.get("fill-opacity", opacity)
        if name == "svg":
            if view is not None:
                raise ValueError("a document inside a document")
            box = [float(v) for v in re.split(r"[\s,]+", at["viewBox"].strip())] if "viewBox" in at else [0.0, 0.0, float(at.get("width", "nan").removesuffix("px")), float(at.get("height", "nan").removesuffix("px"))]
            if len(box) != 4 or not box[2] > 0 or not box[3] > 0:
                raise ValueError("a view without area")
            view = tuple(box)
        elif name == "path" and not any(t[0] in SILENT for t in open_tags):
            if fill != "none":
                shapes.append(Shape(colour(fill, opacity), _moved(parse_path(at.get("d", "")), matrix)))
        elif name not in SILENT | {"g", "rect", "path"}:
            raise ValueError(f"{name} isn't read")
        if kind == "open":
            open_tags.append((name, matrix, fill, opacity))
        elif name == "svg":
            closed = True
    if not closed:
        raise ValueError("the document doesn't end")
    return Document(view, tuple(shapes))


def check(text: str) -> tuple[float, float]:
    """Width and height of a document that reads without an error."""
    return parse(text).view[2:]


def merged_styles(shapes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(fill, path data): neighbours of one fill as one path."""
    out: list[tuple[str, str]] = []
    for fill, data in shapes:
        if out and out[-1][0] == fill:
            out[-1] = (fill, f"{out[-1][1]} {data}")
        else:
            out.append((fill, data))
    return out


def _path(fill: str, data: str) -> str:
    alpha = int(fill[7:9] or "ff", 16)
    return f'<path d="{data}" fill="{fill[:7]}"' + (f' fill-opacity="{number(alpha / 255)}"' if alpha < 255 else "") + "/>"


def write_icon(width: float, height: float, shapes: list[tuple[str, str]]) -> str:
    """A document of (fill, path data), neighbours of one fill joined; it is read back before it is returned."""
    body = "".join(_path(*s) for s in merged_styles(shapes))
    text = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {number(width)} {number(height)}">{body}</svg>'
    check(text)
    return text


def write_sheet(width: int, height: int, placed: list[dict], title: str = "") -> str:
    """A sheet of icons (id, tx, ty, scale, shapes of (fill, data)); an icon without shapes is an error."""
    if not width or not height:
        raise ValueError("a sheet without area")
    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">' + f"<title>{escape(title)}</title>\n"]
    for icon in placed:
        if icon.get("shapes") is None:
            raise ValueError(f"no artwork for {icon['id']}")
        at = f"translate({number(icon['tx'])},{number(icon['ty'])}) scale({number(icon['scale'])})"
        out.append(f'<g transform="{at}">' + "".join(_path(*s) for s in icon["shapes"]) + "</g>\n")
    return "".join(out) + "</svg>\n"


def rewrite_paths(text: str, change) -> str:
    """The document with `change` applied to each path's data."""
    return re.sub(r'(\sd\s*=\s*)"([^"]*)"', lambda m: f'{m[1]}"{change(m[2])}"', text)


def palette(shapes: tuple[Shape, ...]) -> tuple[str, int]:
    """16 hex digits of the distinct fills in order, and how many there are."""
    fills = sorted({s.fill for s in shapes})
    return sha256("".join(fills).encode()).hexdigest()[:16], len(fills)


def outline(shapes: tuple[Shape, ...]) -> tuple[int, bool]:
    """Segments of all subpaths, and whether each is closed."""
    every = [p for s in shapes for p in s.paths]
    return sum(len(p["segments"]) for p in every), all(p["closed"] for p in every)


def read_documents(rows: DataFrame, text: str) -> DataFrame:
    """rows without the text, with width, height, fills, palette, nodes, closed and the shapes (fill, data); a document that can't be read has an error instead."""
    others = [c for c in rows.columns if c != text]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def one(value: str | None) -> dict:
        try:
            doc = parse(value or "")
        except (ValueError, KeyError) as e:
            return {"error": str(e) or "unreadable"}
        name, fills = palette(doc.shapes)
        nodes, closed = outline(doc.shapes)
        return {"width": doc.view[2], "height": doc.view[3], "fills": fills, "palette": name, "nodes": nodes, "closed": closed, "shapes": [{"fill": s.fill, "data": write_path(list(s.paths))} for s in doc.shapes]}

    shape = pa.list_(pa.struct([("fill", pa.string()), ("data", pa.string())]))
    new = [("width", pa.float64()), ("height", pa.float64()), ("fills", pa.int32()), ("palette", pa.string()), ("nodes", pa.int32()), ("closed", pa.bool_()), ("shapes", shape), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(v) for v in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *(pa.array([g.get(n) for g in got], t) for n, t in new)], names=[*others, *(n for n, _ in new)])

    return rows.select(*others, F.col(text)).mapInArrow(run, f"{kept}, width double, height double, fills int, palette string, nodes int, closed boolean, shapes array<struct<fill:string,data:string>>, error string")
