"""The library of sheets: scans, content-hash dedupe, paging, cache index, versioned schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
#: Larger image files count as corrupt.
MOST_BYTES = 256 << 20
SHEETS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("source_path", T.StringType(), False), T.StructField("content_hash", T.StringType(), False), T.StructField("width", T.IntegerType(), False), T.StructField("height", T.IntegerType(), False), T.StructField("imported_at", T.StringType(), False)])
REVIEW_STATES = ["pending", "approved", "rejected", "flagged", "duplicate"]


def dimensions(head: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            kind, n = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
            at += 2 + n
    return None


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, status (ok or corrupt), content_hash, width, height of every png, jpg and jpeg below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.(png|jpe?g)$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [dimensions(x.as_py()[:65536]) if n.as_py() <= MOST_BYTES and x.is_valid else None for x, n in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_pydict({"path": b.column(0), "content_hash": b.column(3), "width": pa.array([s and s[0] for s in size], pa.int32()), "height": pa.array([s and s[1] for s in size], pa.int32())})

    found = files.select("path", "content", "length", F.sha2("content", 256).alias("content_hash")).mapInArrow(run, "path string, content_hash string, width int, height int")
    return found.withColumn("status", F.when(F.col("width") > 0, "ok").otherwise("corrupt"))


def dedupe_import(rows: DataFrame, content: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """rows with content_hash and outcome: imported for the first row (in `order`, which tells rows apart) of content that `existing` lacks, else duplicate."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    # the first of equal contents is a minimum, combined before its shuffle, and joined back
    first = hashed.groupBy(F.col("content_hash").alias("_h")).agg(F.min(F.struct(*order)).alias("_least"))
    hashed = hashed.join(first, F.col("content_hash").eqNullSafe(F.col("_h"))).withColumn("_first", F.struct(*order) == F.col("_least")).drop("_h", "_least")
    if existing is not None:
        known = existing.select("content_hash", F.lit(True).alias("_known")).distinct()
        hashed = hashed.join(known, "content_hash", "left")
        hashed = hashed.withColumn("_first", F.col("_first") & F.col("_known").isNull()).drop("_known")
    return hashed.withColumn("outcome", F.when(F.col("_first"), "imported").otherwise("duplicate")).drop("_first")


def flush(rows: DataFrame, path: str) -> dict[str, int]:
    """Append the imported rows of a batch (with outcome) in one job; how many rows had each outcome, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    outcomes = ["imported", "duplicate"]
    counted = rows.observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
    counted.where("outcome = 'imported'").write.mode("append").option("compression", "zstd").parquet(path)
    return {o: seen.get[o] for o in outcomes}


def page(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of an ordered listing; Spark keeps offset + limit rows of each partition."""
    return df.orderBy(*order).offset(offset).limit(limit)


def virtual_window(df: DataFrame, order: list[Column | str], start: int, visible: int, overscan: int = 4, total: int | None = None) -> DataFrame:
    """df with row_index of the rows start - overscan .. start + visible + overscan - 1, clamped to the listing."""
    lo = max(0, start - overscan)
    top = df.orderBy(*order).limit(max(0, start + visible + overscan))
    return top.withColumn("row_index", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("row_index") >= lo)


def latest(cache: DataFrame, key: str = "key", at: str = "created_at") -> DataFrame:
    """The newest row of each cache key: an upsert read back."""
    others = [c for c in cache.columns if c != key]
    return cache.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at])).alias("v")).select(key, "v.*").select(*cache.columns)


def cache_key(content: Column, preset: Column, segmentation: Column, version: int = SCHEMA_VERSION) -> Column:
    return F.concat_ws("-", F.sha2(content.cast("binary"), 256), preset, F.substring(F.sha2(segmentation.cast("binary"), 256), 1, 16), F.lit(f"v{version}"))


def icon_id(sheet_hash: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """32 hex digits from the sheet's hash and the icon's box."""
    return F.substring(F.sha2(F.concat_ws("|", sheet_hash, x, y, w, h).cast("binary"), 256), 1, 32)


def sheet_by_id(sheets: DataFrame, key: object, id_col: str = "id") -> DataFrame:
    """The sheet with an id, or nothing; the filter reaches the scan."""
    return sheets.where(F.col(id_col) == F.lit(key))


def icons_for_sheet(icons: DataFrame, key: object, sheet: str = "sheet") -> DataFrame:
    """A sheet's icons in (y, x) order; a missing document or preset is empty, a missing score 0."""
    rows = icons.where(F.col(sheet) == F.lit(key))
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in ("svg", "preset") if c in rows.columns}
    filled |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("mae", "ssim", "iou", "composite") if c in rows.columns}
    return rows.withColumns(filled).orderBy("y", "x")


def review_states_for(icons: DataFrame, key: object, sheet: str = "sheet", state: str = "state") -> DataFrame:
    """A sheet's review states in (y, x) order; rows with a state that isn't one are left out."""
    return icons.where((F.col(sheet) == F.lit(key)) & F.col(state).isin(REVIEW_STATES)).orderBy("y", "x")


def log_for(log: DataFrame, key: object, key_col: str, order: str) -> DataFrame:
    """The audit rows of one key in the order they were written."""
    return log.where(F.col(key_col) == F.lit(key)).orderBy(order)


def counts(sheets: DataFrame, icons: DataFrame) -> DataFrame:
    """One row: how many sheets and icons the library holds."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(sheets, "sheets").join(F.broadcast(one(icons, "icons")))


def insert_icons(icons: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows of new that icons lacks, one for each id (the smallest row), as pending: what an insert adds."""
    others = [c for c in new.columns if c != key]
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*")
    return first.join(icons.select(key), key, "left_anti").withColumn("state", F.lit("pending"))


def append_event(log: DataFrame, events: DataFrame) -> DataFrame:
    """log and, after it, events."""
    return log.unionByName(events)


def pack_payloads(rows: DataFrame, payload: str, level: int = 3) -> DataFrame:
    """rows with the payload compressed, in Arrow batches."""
    at = rows.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for b in batches:
            packed = [None if x is None else packer.compress(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def unpack_payloads(rows: DataFrame, payload: str) -> DataFrame:
    """rows with the payload as it was stored; one that is missing or damaged is null, never an error."""
    at = rows.columns.index(payload)

    def read(x: bytes | None) -> bytes | None:
        import zstandard

        try:
            return None if x is None else zstandard.ZstdDecompressor().decompress(x)
        except zstandard.ZstdError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([read(x) for x in b.column(at).to_pylist()], pa.binary()) if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def evict(entries: DataFrame, keys: list[str], touched: str, most: int) -> DataFrame:
    """The `most` entries of each key that were touched last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(touched))
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def restored_states(icons: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """icons with the state that an earlier review left, or pending."""
    return icons.drop("state").join(prior.select(key, "state"), key, "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def batch_summary(icons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok, failed, hits, min_ssim, min_composite, mean_composite of vectorised icons (failed, hit, ssim, composite); 1.0 where none succeeded."""
    fine = ~F.col("failed")
    score = lambda agg, c: F.coalesce(agg(F.when(fine, F.col(c))), F.lit(1.0))
    return icons.groupBy(*keys).agg(
        F.count_if(fine).alias("ok"),
        F.count_if(~fine).alias("failed"),
        F.count_if(fine & F.col("hit")).alias("hits"),
        score(F.min, "ssim").alias("min_ssim"),
        score(F.min, "composite").alias("min_composite"),
        score(F.avg, "composite").alias("mean_composite"),
    )


def set_state(log: DataFrame, key: str, action: str, order: list[str]) -> DataFrame:
    """Each key's last logged action: the state that an in-place update would hold."""
    return log.groupBy(key).agg(F.max_by(action, F.struct(*order)).alias("state"))


def save(df: DataFrame, path: str) -> None:
    """Write a zstd-compressed copy; the committer renames files only when the job succeeds."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def save_as(df: DataFrame, path: str) -> None:
    """A copy at another place; what df was read from isn't touched, and an existing place is refused."""
    df.write.mode("error").option("compression", "zstd").parquet(path)


def replace_partition(df: DataFrame, path: str, column: str = "sheet_id") -> None:
    """Overwrite only the partitions (sheets) that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def verify_schema(df: DataFrame, schema: T.StructType) -> list[str]:
    """What df lacks of a versioned schema: missing columns and other types."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {'missing' if f.name not in have else have[f.name].simpleString()}" for f in schema if have.get(f.name) != f.dataType]
