"""Sinks: text in order, blobs by name, JSON, archives and dumps of streams."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_BYTES = 50 << 20
BLOB_PREFIXES = {"markdown": "md_", "html": "html_", "screenshot": "shot_", "xhr": "xhr_", "hydration": "hyd_"}


def write_lines(rows: DataFrame, path: str, by: list[str], order: list[str], line: str = "line") -> None:
    """A text for each group, in order, in as many files as its size needs: ranges of (by, order), never one task for a group."""
    rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).select(*by, line).write.mode("overwrite").partitionBy(*by).text(path)


def blob_id(kind: str, fingerprint: Column) -> Column:
    return F.concat(F.lit(BLOB_PREFIXES[kind]), F.substring(fingerprint, 1, 32))


def export_file_id(job_id: Column) -> Column:
    return F.concat(F.lit("exp_"), F.substring(F.regexp_replace(job_id, "-", ""), 1, 32))


def write_blobs(rows: DataFrame, path: str, fingerprint: str, kind: str) -> None:
    """Contents partitioned by the first byte of their fingerprint, a large partition in several files; what was there of those partitions is replaced."""
    named = rows.withColumn("file_id", blob_id(kind, F.col(fingerprint))).withColumn("shard", F.substring(fingerprint, 1, 2))
    named.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def read_blobs(spark: SparkSession, path: str, file_ids: DataFrame) -> DataFrame:
    """The blobs with the ids asked for."""
    return spark.read.parquet(path).join(file_ids.select("file_id").distinct(), "file_id", "left_semi")


def archive(entries: DataFrame, manifest: dict, limit: int = ARCHIVE_BYTES) -> bytes:
    """A ZIP of entries (name, body) and a manifest; ValueError where the bodies are larger than ``limit``, before any is fetched."""
    size = entries.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"the archive would hold {size} bytes, more than {limit}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for row in entries.select("name", "body").orderBy("name").toLocalIterator():
            z.writestr(row["name"], row["body"] or "")
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    return out.getvalue()


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds a list of objects, of a schema that is stated."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decoded(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that may hold JSON in a string, as VARIANT; text that doesn't parse becomes a string value."""
    return rows.withColumns({f: F.coalesce(F.try_parse_json(F.col(f)), F.to_variant_object(F.struct(F.col(f).alias("text"))).cast("variant")) for f in fields})


def range_scan(stream: DataFrame, after: str | None = None, count: int | None = None, key: str = "message_id") -> DataFrame:
    """A stream's messages in order of their ids (time-sequence), after a cursor and at most ``count``, with the id as _message_id."""
    part = lambda n: F.split_part(F.col(key), F.lit("-"), F.lit(n)).try_cast("long")
    rows = stream.where(F.col(key).isNotNull()).withColumns({"_time": part(1), "_seq": F.coalesce(part(2), F.lit(0))})
    if after is not None:
        time, _, seq = after.partition("-")
        rows = rows.where((F.col("_time") > int(time)) | ((F.col("_time") == int(time)) & (F.col("_seq") > int(seq or 0))))
    rows = rows.orderBy(F.col("_time").asc_nulls_last(), "_seq", key)
    return (rows if count is None else rows.limit(count)).drop("_time", "_seq").withColumnRenamed(key, "_message_id")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON document a line, nulls included; appended to what is there."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def dump(stream: DataFrame, path: str, fields: list[str], clear: str | None = None, key: str = "message_id") -> DataFrame | None:
    """Write a stream's messages as JSON lines, with ``fields`` decoded; with ``clear``, what the dump doesn't have is written there and given back."""
    decoded(stream.withColumnRenamed(key, "_message_id"), fields).write.mode("overwrite").json(path)
    if clear is None:
        return None
    written = stream.sparkSession.read.schema("_message_id string").json(path)
    stream.join(written.select(F.col("_message_id").alias(key)), key, "left_anti").write.mode("overwrite").parquet(clear)
    return stream.sparkSession.read.parquet(clear)
