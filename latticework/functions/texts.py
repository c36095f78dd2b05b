"""Column functions for the texts, keys, ids and gestures around a sheet and its review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import percent

# Presets by document name, with colour, palette size and the two simplification limits.
PRESETS = [
    ("mono-fast", "draft", False, None, 0.6, 0.8),
    ("mono-clean", "wireframe", False, None, 0.35, 0.4),
    ("scan", "lineart", False, None, 0.25, 0.3),
    ("flat-8", "balanced", True, 8, 0.35, 0.4),
    ("flat-cutout", "detailed", True, 12, 0.3, 0.35),
    ("detailed", "high-fidelity", True, 24, 0.15, 0.15),
    ("pixel-art", "pixel", True, 32, 0.0, 0.0),
]
# The keys that decide, and those that do something else.
KEYS = {"a": "approve", "r": "reject", "f": "flag", "d": "duplicate"}
INTENTS = {" ": "overlay", "ArrowDown": "next", "j": "next", "ArrowUp": "previous", "k": "previous", "Escape": "dismiss"}
BUDGET_MS = 20 * 60 * 1000


def _lookup(c: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def preset_of(name: Column) -> Column:
    """The preset that a document name stands for, else null."""
    return _lookup(name, {p[0]: p[1] for p in PRESETS})


def key_action(key: Column, shift: Column) -> Column:
    """The decision of a bare key: shift with a approves in bulk, shift with another is none."""
    plain = _lookup(F.when(F.length(key) == 1, F.lower(key)), KEYS)
    return F.when(~shift, plain).when(plain == "approve", "bulk-approve")


def key_intent(key: Column, shift: Column, ctrl: Column, alt: Column) -> Column:
    """What a key press asks for: undo, a move, overlay, dismiss, export, or a decision; null lets it through."""
    export = shift & (F.lower(key) == "e") & (F.length(key) == 1)
    bare = F.coalesce(_lookup(key, INTENTS), F.when(export, "export"), key_action(key, shift))
    return F.when(ctrl & (F.lower(key) == "z"), "undo").when(~ctrl & ~alt, bare)


def artwork_file(slug: Column) -> Column:
    return F.concat(F.lit("svg/"), slug, F.lit(".svg"))


def sheet_stem(override: Column, path: Column) -> Column:
    """The override unless blank, else the file's name without its ending, else sheet."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    return F.coalesce(F.when(F.trim(override) != "", override), F.nullif(stem, F.lit("")), F.lit("sheet"))


def seg_key(share: Column, delta: Column, alpha: Column, passes: Column) -> Column:
    """The segmentation's parameters as a cache key part."""
    return F.format_string("bgs%.2fde%.1fa%dcp%d", share, delta, alpha, passes)


def mask_key(sheet_hash: Column, seg: Column, version: int = 1) -> Column:
    return F.concat(F.substring(sheet_hash, 1, 16), F.lit("-"), F.substring(F.sha2(seg.cast("binary"), 256), 1, 16), F.lit(f"-v{version}"))


def hex32(id16: Column) -> Column:
    """16 bytes as 32 lower-case hex digits."""
    return F.lower(F.hex(id16))


def parse_hex32(text: Column) -> Column:
    """The 16 bytes of 32 hex digits, white space around them aside, else null."""
    inner = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(inner.rlike("^[0-9a-fA-F]{32}$"), F.unhex(inner))


def session_key(sheet: Column) -> Column:
    """The 17 bytes that a sheet's review session is logged under."""
    return F.concat(F.unhex(F.lit("52")), sheet)


def group_label(index: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d · %d×%d", index, w, h)


def group_colour(index: Column) -> Column:
    """Hues a golden angle apart."""
    return F.format_string("hsl(%.1f 70%% 58%%)", (index * 137.508) % 360)


def overlay_summary(n: Column, confidence: Column, review: Column, ms: Column) -> Column:
    todo = F.when(review == 0, "none need review").otherwise(F.format_string("%d need review", review))
    return F.format_string("%d icons · %d%% confidence · %s · %.0f ms", n, F.floor(confidence * 100 + 0.5), todo, ms.cast("double"))


def split_summary(split: Column, regions: Column, ms: Column) -> Column:
    return F.when(split, F.format_string("Split Here: %d regions · %.2f ms", regions, ms)).otherwise(F.format_string("Split Here: refused (no watershed structure) · %.2f ms", ms))


def cascade_line(candidates: Column, verified: Column, confirmed: Column, icons: Column) -> Column:
    """The funnel's counts with thousands separators, and verified pairs an icon."""
    each = F.when(icons > 0, F.format_string("%.2f× icons", verified / icons)).otherwise("—")
    return F.concat(F.format_number(candidates, 0), F.lit(" band pairs → "), F.format_number(verified, 0), F.lit(" verified → "), F.format_number(confirmed, 0), F.lit(" confirmed ("), each, F.lit(")"))


def progress_line(decided: Column, total: Column, approve: Column, reject: Column, flag: Column, duplicate: Column, bulk: Column, size: Column) -> Column:
    return F.format_string("%d of %d decided · %d approved · %d rejected · %d flagged · %d duplicate · export %s", decided, total, approve + bulk, reject, flag, duplicate, size)


def short_hash(text: Column, keep: int = 4) -> Column:
    return F.when(F.length(text) <= 2 * keep, text).otherwise(F.concat(F.left(text, F.lit(keep)), F.lit("…"), F.right(text, F.lit(keep))))


def icon_key(x: Column, y: Column, w: Column, h: Column, preset: Column) -> Column:
    return F.concat(F.concat_ws(",", *[c.cast("string") for c in (x, y, w, h)]), F.lit("@"), preset)


def pdf_string(text: Column) -> Column:
    """A literal string's content: backslash and parentheses escaped, line breaks and tabs as spaces, characters beyond ASCII as ?."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]", " "), r"[^\x00-\x7F]", "?")
    return F.regexp_replace(safe, r"([\\()])", r"\\$1")


def rgb_unit(r: Column, g: Column, b: Column) -> Column:
    return F.array(r / 255, g / 255, b / 255)


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four samples as one 32-bit word, red lowest."""
    return r.cast("long") + F.shiftleft(g.cast("long"), 8) + F.shiftleft(b.cast("long"), 16) + F.shiftleft(a.cast("long"), 24)


def unpack_rgba(word: Column) -> Column:
    return F.array(*[F.shiftright(word, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(4)])


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp()).cast("string")


def flag_names(bits: Column) -> Column:
    """The leveling flags that are set, by name."""
    named = [(1, "overflow"), (2, "stroke_clamped"), (4, "solidity_clamped")]
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) > 0, n) for b, n in named]), lambda x: x.isNotNull())


def style_class(fill_ratio: Column) -> Column:
    return F.when(fill_ratio >= 0.5, "filled").otherwise("outline")


def review_background(kind: Column, r: Column, g: Column, b: Column) -> Column:
    """What a review composites against: white where the background is no colour."""
    white = kind.isin("otsu", "alpha")
    return F.array(*[F.when(white, 255).otherwise(c).cast("int") for c in (r, g, b)], F.lit(255))


def bbox(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box, or null where a side is zero."""
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def centre(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x + w / 2).alias("cx"), (y + h / 2).alias("cy"))


def preview_scale(width: Column, sheet_width: Column) -> Column:
    return F.when(sheet_width > 0, width / sheet_width).otherwise(F.lit(1.0))


def to_sheet(at: Column, scale: Column) -> Column:
    """Preview pixels as sheet pixels, halves rounded up."""
    return F.floor(at / scale + 0.5).cast("int")


def drag_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A drag in any direction as a box inside the sheet, one pixel wide and high at least."""
    left, top = F.greatest(F.lit(0), F.least(x0, x1)), F.greatest(F.lit(0), F.least(y0, y1))
    right, bottom = F.least(F.lit(width), F.greatest(x0, x1)), F.least(F.lit(height), F.greatest(y0, y1))
    whole = lambda c: F.floor(c + 0.5).cast("int")
    return F.struct(whole(left).alias("x"), whole(top).alias("y"), F.greatest(F.lit(1), whole(right - left)).alias("w"), F.greatest(F.lit(1), whole(bottom - top)).alias("h"))


def is_click(x0: Column, y0: Column, x1: Column, y1: Column, slop: int = 4) -> Column:
    return (F.abs(x1 - x0) <= slop) & (F.abs(y1 - y0) <= slop)


def cell_transform(x: Column, y: Column, ink_x: Column, ink_y: Column, scale: Column) -> Column:
    """translate(tx, ty) scale(s) from an icon's crop to the sheet."""
    return F.struct((x - scale * ink_x).alias("tx"), (y - scale * ink_y).alias("ty"), scale.alias("s"))


def pace_line(decided: Column, total: Column, elapsed_ms: Column) -> Column:
    """Minutes that a pass takes at its pace so far, and whether they fit the budget."""
    projected = F.when(decided > 0, elapsed_ms / decided).otherwise(F.lit(0.0)) * F.greatest(total, decided)
    # tenths are rounded as a double: halves that only the multiplication makes exact go up, as in SQL's round
    minutes = F.round(projected / 60000 * 10) / 10
    return F.format_string("%.1f min projected, %s", minutes, F.when(projected <= BUDGET_MS, "within budget").otherwise("over budget"))


def score_payload(svg: Column, palette: Column, score: Column) -> Column:
    """A scored document as its cached JSON."""
    return F.to_json(F.struct(svg.alias("svg"), palette.alias("palette"), score.alias("score")))


def cached_document(payload: Column) -> Column:
    """The document of a cached payload; null where it can't be read."""
    return F.from_json(payload, "svg string, palette array<string>, score double")["svg"]


def percent_text(value: Column) -> Column:
    return F.format_string("%d%%", percent(value))


def packed_fill(word: Column) -> Column:
    """#rrggbb of a number's lower 24 bits."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(word.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))
