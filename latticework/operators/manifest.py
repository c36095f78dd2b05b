"""The manifest of a leveled sheet: sixteen columns, each already text, and the file that holds some of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_field, derive_tags, expand_pattern, format_number, slugify
from ..functions.texts import artwork_file, cell_transform
from .leveling import grid_position

# All columns in order, and those that a fresh export has.
COLUMNS = ["index", "name", "slug", "tags", "file", "row", "col", "width", "height", "ink", "stroke", "solidity", "area", "preset", "colours", "id"]
DEFAULT = COLUMNS[:9]
PATTERN = "{sheet}-{index:03}"


def column_of(name: str) -> str | None:
    """The column that a header names, whatever its case and the space around it."""
    plain = name.strip().lower()
    return plain if plain in COLUMNS else None


def rows(leveled: DataFrame, columns: int, pattern: str = PATTERN) -> DataFrame:
    """sheet and the sixteen columns as text, of icons with index (from 1), stem, preset, colours, id_hex, ink_w, ink_h, area, scale, stroke, solidity."""
    at = grid_position(F.col("index"), columns)
    name = expand_pattern(pattern, {"sheet": F.col("stem"), "index": F.col("index"), "row": at["row"], "col": at["col"], "preset": F.col("preset")})
    whole = lambda c: F.greatest(F.floor(F.col(c) + 0.5), F.lit(1)).cast("long")
    side = F.greatest("ink_w", "ink_h")
    values: dict[str, Column] = {
        "index": F.col("index"),
        "name": name,
        "slug": slugify(name),
        "tags": derive_tags(F.col("preset"), F.col("area"), F.col("stroke"), F.col("solidity"), side),
        "file": artwork_file(slugify(name)),
        "row": at["row"],
        "col": at["col"],
        "width": whole("ink_w"),
        "height": whole("ink_h"),
        "ink": format_number(F.col("scale") * side),
        "stroke": format_number(F.col("stroke")),
        "solidity": format_number(F.col("solidity")),
        "area": F.col("area"),
        "preset": F.col("preset"),
        "colours": F.col("colours"),
        "id": F.col("id_hex"),
    }
    return leveled.select("sheet", F.col("index").alias("position"), *[v.cast("string").alias(c) for c, v in values.items()])


def to_csv(manifest: DataFrame, columns: list[str] = DEFAULT, delimiter: str = ",", header: bool = True) -> DataFrame:
    """sheet, csv: chosen columns by position, quoted only where needed, lines ended by CRLF."""
    if len(delimiter) != 1 or not delimiter.isascii() or delimiter in '"\r\n':
        raise ValueError("the delimiter must be one ASCII character")
    names = [column_of(c) for c in columns]
    if None in names:
        raise ValueError(f"not a column: {columns[names.index(None)]}")
    line = F.concat(F.concat_ws(delimiter, *[csv_field(F.col(c), delimiter) for c in names]), F.lit("\r\n"))
    lines = manifest.select("sheet", "position", line.alias("line")).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    head = delimiter.join(names) + "\r\n" if header else ""
    return lines.select("sheet", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("csv"))


def missing_artwork(placed: DataFrame, artwork: DataFrame, key: str) -> DataFrame:
    """The placements that have no artwork: an export of them is an error."""
    return placed.join(artwork.select(key).distinct(), key, "left_anti")


def sheet_svg(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """sheet, svg: one document for each sheet, a group for each placed icon in order of index.

    placed: sheet, index, x, y, scale, ink_x and ink_y (0 where absent) and shapes
    (fill as #rrggbb, data); an icon without shapes is left out: `missing_artwork`
    tells them.  sizes: sheet, width, height.
    """
    ink = lambda c: F.col(c) if c in placed.columns else F.lit(0)
    at = cell_transform(F.col("x"), F.col("y"), ink("ink_x"), ink("ink_y"), F.col("scale"))
    paths = F.array_join(F.transform("shapes", lambda s: F.concat(F.lit('<path d="'), s["data"], F.lit('" fill="'), s["fill"], F.lit('"/>'))), "")
    group = F.concat(F.lit('<g transform="translate('), format_number(at["tx"]), F.lit(","), format_number(at["ty"]), F.lit(") scale("), format_number(at["s"]), F.lit(')">'), paths, F.lit("</g>\n"))
    rows = placed.where(F.col("shapes").isNotNull()).select("sheet", "index", group.alias("g"))
    rows = rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("index", "g"))).alias("l"))
    size = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), size("width"), F.lit('" height="'), size("height"), F.lit('" viewBox="0 0 '), size("width"), F.lit(" "), size("height"), F.lit('">\n'))
    return rows.join(sizes, "sheet").select("sheet", F.concat(head, F.array_join(F.transform("l", lambda x: x["g"]), ""), F.lit("</svg>\n")).alias("svg"))
