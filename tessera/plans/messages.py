"""Queries over messages delivered at least once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.exactly_once import MessageStore, repeated_deliveries
from tessera.session import scratch
from tessera.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(delivery_id) of each delivery to drop."""
    store = MessageStore(spark, scratch(spark, "messages"))
    return repeated_deliveries(table(spark, sf_dir, "result_messages"), store)


def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a store after all batches, one row for each."""
    store = MessageStore(spark, scratch(spark, "messages"))
    messages = table(spark, sf_dir, "result_messages")
    repeated_deliveries(messages, store)
    return store.messages(messages.schema).select("delivery_id", "stream_name", "message_id", "url", F.col("crawl_id"))


QUERIES = {"p3_found": p3_found, "p3_messages": p3_messages}

_RANKED = "SELECT *, row_number() OVER (PARTITION BY stream_name, message_id ORDER BY delivery_id) AS rn FROM result_messages"
ORACLE = {
    "p3_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE message_id IS NOT NULL AND stream_name IS NOT NULL AND rn > 1",
    "p3_messages": f"SELECT delivery_id, stream_name, message_id, url, crawl_id FROM ({_RANKED}) WHERE message_id IS NULL OR stream_name IS NULL OR rn = 1",
}
