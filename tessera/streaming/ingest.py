"""Structured Streaming: messages in, each with its effect once.

A query's progress is its checkpoint, so a batch that fails runs again; its effects are written to a folder named by the batch's
number, which a second run overwrites. The reference's horizon for repeated messages is unbounded, and so is the state here
unless a watermark is given; with one, messages that come later than it are dropped, a difference that its caller chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.functions.payload import json_or, json_strings
from tessera.functions.urls import fingerprint

KINDS = ("results", "telemetry", "dlq")


def messages(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, or of a single file; ``files`` bounds what one batch takes."""
    reader = spark.readStream.schema(schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """One message of each key: over all time, or within ``delay`` of event time."""
    if time is None or delay is None:
        return stream.dropDuplicates(keys)
    at = stream if dict(stream.dtypes)[time] == "timestamp" else stream.withColumn(time, F.col(time).cast("timestamp"))
    return at.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def discovered(stream: DataFrame, url: str = "url") -> DataFrame:
    """A stream's addresses, each once for a crawl over all batches, with their fingerprint: the ledger of discoveries is the query's state."""
    return stream.where(F.col(url).isNotNull()).withColumn("fingerprint", fingerprint(F.col(url))).dropDuplicates(["crawl_id", "fingerprint"])


def consolidated_when_drained(stream: DataFrame, target: str, checkpoint: str, effects: Callable[[DataFrame], dict[str, DataFrame]], consolidate: Callable[[], DataFrame], report: str) -> DataFrame:
    """Take in all that there is, and then write what ``consolidate`` gives to ``report``; if the stream fails, nothing is consolidated."""
    run(stream, target, checkpoint, effects).awaitTermination()
    consolidate().write.mode("overwrite").parquet(report)
    return stream.sparkSession.read.parquet(report)


def routed(batch: DataFrame, stream_name: str = "stream_name") -> dict[str, DataFrame]:
    """A batch's rows by the kind of stream that its name ends with."""
    return {kind: batch.where(F.col(stream_name).endswith(":" + kind)) for kind in KINDS}


def decoded_results(rows: DataFrame) -> DataFrame:
    """Result messages with their JSON fields decoded; broken JSON counts as empty."""
    emails, phones = (json_strings(F.get_json_object(json_or(F.col("contacts")), f"$.{k}")) for k in ("emails", "phones"))
    return rows.withColumns(
        {
            "methods": json_strings(F.col("extraction_methods")),
            "emails": emails,
            "phones": phones,
            "security_score": F.get_json_object(json_or(F.col("metadata")), "$.security.security_score").try_cast("int"),
            "response_time_ms": F.get_json_object(json_or(F.col("metadata")), "$.runtime.response_time_ms").try_cast("double"),
            "status_code": F.coalesce(F.get_json_object(json_or(F.col("metadata")), "$.status_code").try_cast("int"), F.lit(200)),
        }
    )


def contact_rows(results: DataFrame) -> DataFrame:
    """(crawl_id, url, kind, value) of decoded results."""
    both = F.concat(F.transform("emails", lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value"))), F.transform("phones", lambda v: F.struct(F.lit("phone").alias("kind"), v.alias("value"))))
    return results.select("crawl_id", "url", F.explode(both).alias("c")).select("crawl_id", "url", "c.kind", "c.value")


def run(stream: DataFrame, target: str, checkpoint: str, effects: Callable[[DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Take in what there is now; each of a batch's effects goes to ``target/name/batch=N``, which a second run replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, rows in effects(batch).items():
                rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once by the sink's own log, until what there is now is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def budget_tickets(stream: DataFrame, limit: int) -> DataFrame:
    """(crawl_id, message_id, ticket) of the first ``limit`` messages of each crawl, numbered over all batches.

    A crawl's counter is one state, so its messages of one batch meet in one task; what is kept is a number.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for batch in batches:
            taken = batch.iloc[: max(0, limit - used)]
            if len(taken):
                yield pd.DataFrame({"crawl_id": key[0], "message_id": taken.message_id, "ticket": range(used + 1, used + 1 + len(taken))})
                used += len(taken)
        state.update((used,))

    return stream.groupBy("crawl_id").applyInPandasWithState(count, "crawl_id string, message_id string, ticket long", "used long", "append", GroupStateTimeout.NoTimeout)
