"""Decisions about crawl tasks: retry, dead letters, reclaim, slots, completion. The scheduling itself is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.gates import MAX_RETRIES, with_tickets

STALE_MS, DOMAIN_SLOTS, LOGIN_LIMIT = 300_000, 2, 10


def _count(column: str) -> Column:
    return F.coalesce(F.col(column).try_cast("int"), F.lit(0))


def dead_letter(tasks: DataFrame, reason: Column, time: Column) -> DataFrame:
    """Tasks with dlq_reason and dlq_at_utc."""
    return tasks.withColumns({"dlq_reason": reason, "dlq_at_utc": time})


def after_failure(tasks: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """Failed tasks with their next retry_count and route: retry, or dlq once there were ``most`` retries."""
    return tasks.withColumn("route", F.when(_count("retry_count") >= most, "dlq").otherwise("retry")).withColumn("retry_count", F.when(F.col("route") == "retry", _count("retry_count") + 1).otherwise(_count("retry_count")))


def reclaim(pending: DataFrame, now: Column, idle_ms: int = STALE_MS, most: int = MAX_RETRIES) -> DataFrame:
    """Pending tasks (last_seen, retry_count) that were idle too long, with their route."""
    idle = (F.unix_millis(now) - F.unix_millis(F.col("last_seen"))) >= idle_ms
    return after_failure(pending.where(idle), most)


def replay(dead: DataFrame) -> DataFrame:
    """Dead letters as new tasks; their counters start again."""
    return dead.drop("dlq_reason", "dlq_at_utc").withColumn("retry_count", F.lit(0))


def failures(dead: DataFrame) -> DataFrame:
    """(url, error, retry_count, retryable) of dead letters."""
    return dead.select("url", F.col("dlq_reason").alias("error"), _count("retry_count").alias("retry_count"), F.lit(False).alias("retryable"))


def domain_slots(tasks: DataFrame, slots: int = DOMAIN_SLOTS, order: str = "seq") -> DataFrame:
    """Tasks with ``granted``: the first ``slots`` of each domain in order; the others wait with throttle_count + 1."""
    numbered = with_tickets(tasks, F.lit(True), slots, "domain", order)
    granted = F.col("ticket") <= slots
    return numbered.withColumn("granted", granted).withColumn("throttle_count", F.when(granted, _count("throttle_count")).otherwise(_count("throttle_count") + 1)).drop("ticket")


def completed(tasks: DataFrame) -> DataFrame:
    """(crawl_id, complete): whether no task of a crawl is unread, pending or locked; ``state`` says which."""
    return tasks.groupBy("crawl_id").agg((F.count_if(F.col("state").isin("unread", "pending", "locked")) == 0).alias("complete"))


def over_limit(attempts: DataFrame, who: str, time: str, limit: int = LOGIN_LIMIT) -> DataFrame:
    """(who, minute, attempts) of fixed minutes with more than ``limit`` attempts."""
    minute = F.date_trunc("minute", F.col(time))
    return attempts.groupBy(who, minute.alias("minute")).agg(F.count("*").alias("attempts")).where(F.col("attempts") > limit)
