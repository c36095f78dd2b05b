"""Column functions: numbers, names, tags, CSV fields, hashes and box predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag, grade and quality thresholds.
SOLID, HOLLOW, THICK, THIN = 0.85, 0.60, 0.30, 0.15
GRADES = [(0.97, "excellent"), (0.92, "good"), (0.85, "fair")]
COMPOSITE_LEAST, NODES_PER_ROOT_AREA = 0.80, 4.0


def round6(c: Column) -> Column:
    return F.round(c, 6)


def format_number(c: Column) -> Column:
    """Three decimals without trailing zeros; negative zero and non-finite values are 0."""
    finite = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    text = F.format_string("%.3f", finite)
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def slugify(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one dash, trimmed; empty gives icon."""
    dashed = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit("icon"))


def pad_number(n: Column, width: Column | int) -> Column:
    """Zero-padded to a width; longer numbers stay whole."""
    width = F.lit(width) if isinstance(width, int) else width
    text = n.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def expand_pattern(pattern: str, tokens: dict[str, Column]) -> Column:
    """`{name}` and `{name:N}` (zero-padded) of known tokens are replaced; unknown ones and unclosed braces are kept."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::0?(\d+))?\}", pattern):
        if m[1] in tokens:
            parts.append(F.lit(pattern[at : m.start()]))
            parts.append(pad_number(tokens[m[1]], int(m[2])) if m[2] else tokens[m[1]].cast("string"))
            at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def derive_tags(preset: Column, area: Column, stroke: Column, solidity: Column, side: Column) -> Column:
    """Four tags: solid, hollow or mixed by solidity; thick, thin or even by stroke against the longer side (1 at least); ink or empty; the preset."""
    shape = F.when(solidity >= SOLID, "solid").when(solidity <= HOLLOW, "hollow").otherwise("mixed")
    rel = stroke.cast("double") / F.greatest(side.cast("double"), F.lit(1.0))
    weight = F.when(rel <= THIN, "thin").when(rel >= THICK, "thick").otherwise("even")
    return F.concat_ws(" ", shape, weight, F.when(area == 0, "empty").otherwise("ink"), preset)


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """Quoted only if it holds the delimiter, a quote or a line break, or has a space at an end."""
    risky = c.rlike(f'[{delimiter}"\r\n]') | c.startswith(" ") | c.endswith(" ")
    return F.when(risky, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(columns: list[Column]) -> Column:
    return F.concat(F.concat_ws(",", *[csv_field(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]), F.lit("\r\n"))


def hex64(c: Column) -> Column:
    """A 64-bit pattern as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def hex_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0") for x in (r, g, b)])


def parse_hex_colour(c: Column) -> Column:
    """array(r, g, b, a) of #rgb, #rgba, #rrggbb or #rrggbbaa, else null."""
    body = F.lower(F.substring(c, 2, 8))
    wide = F.when(F.length(body).isin(3, 4), F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    wide = F.when(F.length(wide) == 6, F.concat(wide, F.lit("ff"))).otherwise(wide)
    rgba = F.array(*[F.conv(F.substring(wide, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(4)])
    return F.when(c.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), rgba)


def grade(score: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def composite(ssim: Column, mae: Column, iou: Column) -> Column:
    return 0.5 * ssim + 0.3 * (1 - mae) + 0.2 * iou


def node_budget(area: Column) -> Column:
    return F.lit(NODES_PER_ROOT_AREA) * F.sqrt(area.cast("double"))


def quality_flags(score: Column, nodes: Column, ink_area: Column, closed: Column) -> Column:
    """Flags in fixed order: low_composite, too_many_nodes (never without ink), open_outline."""
    flags = F.array(F.when(score < COMPOSITE_LEAST, "low_composite"), F.when((ink_area > 0) & (nodes > node_budget(ink_area)), "too_many_nodes"), F.when(~closed, "open_outline"))
    return F.filter(flags, lambda x: x.isNotNull())


def ramp(v: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, straight between; a step where hi <= lo."""
    if hi <= lo:
        return F.when(v >= lo, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))


def _references(c: Column) -> Column:
    """c with the characters beyond ASCII as upper-case hex references."""
    chars = F.transform(F.split(c, ""), lambda x: F.when(F.ascii(x) > 127, F.concat(F.lit("&#x"), F.hex(F.ascii(x).cast("long")), F.lit(";"))).otherwise(x))
    return F.when(F.octet_length(c) > F.char_length(c), F.array_join(chars, "")).otherwise(c)


def xml_escape(c: Column, control: str = " ") -> Column:
    """Markup characters as entities, characters under 0x20 as `control`, those beyond ASCII as hex references."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return _references(F.regexp_replace(c, r"[\x00-\x1F]", control))


def id_escape(c: Column) -> Column:
    """An id-safe name: trimmed, runs of white space as one dash, the rest escaped; empty gives icon."""
    dashed = F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}]+", "-")
    return F.coalesce(F.nullif(xml_escape(dashed, "_"), F.lit("")), F.lit("icon"))


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n / 1024 < 1024, F.format_string("%.1f kB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))


def format_ms(ms: Column) -> Column:
    ms = ms.cast("double")
    return F.when(ms < 1000, F.format_string("%.1f ms", ms)).otherwise(F.format_string("%.1f s", ms / 1000))


def percent(score: Column) -> Column:
    """A share as a whole percentage, clamped."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100).cast("int")


def status_line(n: Column, seconds: Column, score: Column, review: Column) -> Column:
    todo = F.when(review == 0, "no groups need review").when(review == 1, "1 group needs review").otherwise(F.format_string("%d groups need review", review))
    return F.format_string("Grouped %d icons in %.2f s · confidence %d%% · %s", n, seconds, percent(score), todo)
