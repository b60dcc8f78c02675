"""The durable change log: window, cursor, replay, frames; and the audit of actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, RETENTION_DAYS, ACTION_DAYS = 200, 30, 365
SAFE_NAME = r"^[A-Za-z0-9_.-]+$"
MUTATIONS = ("POST", "PUT", "PATCH", "DELETE")


def event_key(stream: Column, message_id: Column) -> Column:
    """The key that makes a persisted message's event unique."""
    return F.concat(F.lit("redis:"), F.sha2(F.concat_ws(":", stream, message_id), 256))


def retained(log: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return log.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def window(log: DataFrame) -> DataFrame:
    """(earliest, latest) id."""
    return log.agg(F.min("id").alias("earliest"), F.max("id").alias("latest"))


def parse_cursor(text: str | None) -> int | None:
    """A cursor of a client; raises ValueError for anything but a non-negative integer. Messages and frames here and below are fixed values."""
    if not text:
        return None
    try:
        cursor = int(text)
    except ValueError:
        cursor = -1
    if cursor < 0:
        raise ValueError("Last-Event-ID must be a non-negative integer.")
    return cursor


@dataclass(frozen=True)
class Start:
    """Where a client's stream goes on, and the frame that comes first."""

    after: int
    ready: int | None
    resync: bool

    @classmethod
    def of(cls, cursor: int | None, earliest: int | None, latest: int | None) -> Start:
        if cursor is not None and latest is not None and cursor > latest:
            raise ValueError("Last-Event-ID is ahead of the current event stream.")
        expired = bool(cursor) and (earliest is None or cursor < earliest)
        now = latest or 0
        return cls(now if cursor is None or expired else cursor, now if cursor is None else None, expired)

    def frame(self) -> str | None:
        if self.resync:
            return f'id: {self.after}\nevent: resync_required\ndata: {{"reason":"event_cursor_expired"}}\n\n'
        return None if self.ready is None else f'id: {self.ready}\nevent: ready\ndata: {{"cursor":{self.ready}}}\n\n'


def replay(log: DataFrame, after: int, crawl_id: str | None = None, batch: int = BATCH) -> DataFrame:
    """The next events after a cursor, in order of id, a batch at most."""
    rows = log.where(F.col("id") > after)
    if crawl_id is not None:
        rows = rows.where(F.col("crawl_id") == crawl_id)
    return rows.orderBy("id").limit(batch)


def safe_name(name: Column) -> Column:
    return F.when(name.rlike(SAFE_NAME), name).otherwise("message")


def frame(id_: Column, name: Column, data: Column) -> Column:
    return F.concat(F.lit("id: "), id_.cast("string"), F.lit("\nevent: "), safe_name(name), F.lit("\ndata: "), data, F.lit("\n\n"))


def frames(log: DataFrame) -> DataFrame:
    """(id, frame) of each event."""
    crawl = F.when(F.col("crawl_id").isNull(), "null").otherwise(F.concat(F.lit('"'), "crawl_id", F.lit('"')))
    data = F.concat(F.lit('{"crawl_id":'), crawl, F.lit(',"payload":'), F.coalesce("payload", F.lit("{}")), F.lit("}"))
    return log.select("id", frame(F.col("id"), F.col("event_type"), data).alias("frame"))


def is_auditable(method: Column, path: Column, prefix: str = "/api/") -> Column:
    return F.upper(method).isin(*MUTATIONS) & path.startswith(prefix)


def resource_ids(path: Column) -> Column:
    """(crawl_id, finding_id) that an address names."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = F.array_position(parts, "findings")
    crawl = F.when(F.try_element_at(parts, F.lit(2)) == "crawls", F.try_element_at(parts, F.lit(3)))
    return F.struct(crawl.alias("crawl_id"), F.when(at > 0, F.try_element_at(parts, at.cast("int") + 1)).alias("finding_id"))


def action_audit(requests: DataFrame) -> DataFrame:
    """Auditable requests (actor, method, path, response_status) with their resource and outcome."""
    rows = requests.where(is_auditable(F.col("method"), F.col("path"))).withColumn("r", resource_ids(F.col("path")))
    outcome = F.when(F.col("response_status") < 400, "success").otherwise("failure")
    return rows.select("actor", F.concat_ws(" ", F.upper("method"), "path").alias("action"), "r.crawl_id", "r.finding_id", outcome.alias("outcome"), "response_status")
