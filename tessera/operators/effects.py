"""What messages other than results do to the tables: dropped links, dead letters, empty results, replay, control, and the end of a crawl.

Each takes whole batches of messages and gives rows to append or to merge, so an effect is an aggregate and a join and not a loop over messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import canonicalize_url
from tessera.operators.merge import latest
from tessera.operators.tasks import dead_letter

#: Reason of a task whose fetch gave no item (fixed value).
NO_ITEMS = "spider_yielded_zero_items_or_blocked"
#: What an operator may ask of a crawl: whether it applies to a state, and the state it gives (fixed values).
CONTROL = {
    "pause": (lambda now: now.isin("running", "queued"), "paused"),
    "resume": (lambda now: now == "paused", "running"),
    "cancel": (lambda now: ~now.isin("completed", "cancelled", "finished"), "cancelled"),
}
INVENTORY = ("crawl_id", "normalized_url", "original_url", "discovery_status", "processing_status", "exclusion_reason", "matched_rule_id")


def _text(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def dropped_links(messages: DataFrame) -> DataFrame:
    """Rows for the log of dropped links, of messages (crawl_id, source_url, target_url, drop_reason, seq)."""
    return messages.select("crawl_id", "source_url", "target_url", F.coalesce("drop_reason", F.lit("UNKNOWN")).alias("drop_reason"), "seq")


def inventory_of_drops(messages: DataFrame) -> DataFrame:
    """Inventory rows of messages about dropped links that state an inventory_status; the reason of a pattern goes before the gate's."""
    rows = messages.where(F.coalesce("inventory_status", F.lit("")) != "")
    reason = F.coalesce(F.nullif("pattern_reason", F.lit("")), F.nullif("drop_reason", F.lit("")))
    return rows.select(
        "crawl_id", canonicalize_url(F.col("target_url")).alias("normalized_url"), F.col("target_url").alias("original_url"), F.col("inventory_status").alias("discovery_status"), F.col("inventory_status").alias("processing_status"),
        reason.alias("exclusion_reason"), F.nullif("matched_rule_id", F.lit("")).alias("matched_rule_id"), "seq",
    )


def dead_letter_rows(messages: DataFrame) -> DataFrame:
    """Rows for the table of dead letters, of messages (crawl_id, url, dlq_reason, seq, ...): all their fields stay as task_fields, in JSON."""
    fields = F.to_json(F.struct(*[F.col(c) for c in messages.columns if c != "seq"]))
    return messages.select("crawl_id", "url", _text("dlq_reason", "unknown_error").alias("dlq_reason"), fields.alias("task_fields"), "seq")


def inventory_of_dead(messages: DataFrame) -> DataFrame:
    """Inventory rows, failed, of dead letters that name an address."""
    rows = messages.where(F.coalesce("url", F.lit("")) != "")
    failed = F.lit("failed")
    return rows.select("crawl_id", canonicalize_url(F.col("url")).alias("normalized_url"), F.col("url").alias("original_url"), failed.alias("discovery_status"), failed.alias("processing_status"), _text("dlq_reason", "failed").alias("exclusion_reason"), F.lit(None).cast("string").alias("matched_rule_id"), "seq")


def count_failed(crawls: DataFrame, messages: DataFrame) -> DataFrame:
    """Crawls with pages_failed raised by their dead letters, counted before they are joined."""
    n = messages.groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").alias("_n"))
    return crawls.join(n, "id", "left").withColumn("pages_failed", (F.coalesce("pages_failed", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).select(*crawls.columns)


def after_fetch(tasks: DataFrame, items: DataFrame, time: Column) -> tuple[DataFrame, DataFrame]:
    """Tasks that were fetched (key "seq") and how they end, by the items (seq) they gave: those with items are visited, the others are dead letters."""
    some = items.select("seq").distinct()
    return tasks.join(some, "seq", "left_semi"), dead_letter(tasks.join(some, "seq", "left_anti"), F.lit(NO_ITEMS), time)


def retry_failed(crawls: DataFrame, dead: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dead letters of the crawls asked for (id), replayed: the crawls after it, the new tasks, the dead letters that stay.

    A crawl's pages_failed falls by its replayed letters, to 0 at least, and an ended crawl with any runs again. A task keeps its fields, with the crawl's domain
    and a retry_count of 0.
    """
    asked = ids.select(F.col("id").alias("crawl_id")).distinct()
    again = dead.join(asked, "crawl_id", "left_semi")
    n = again.groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").alias("_n"))
    counted = crawls.join(n, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    status = F.when((F.col("_n") > 0) & F.col("status").isin("completed", "cancelled"), "running").otherwise(F.col("status"))
    failed = F.when(F.col("_n") > 0, F.greatest(F.lit(0), F.coalesce("pages_failed", F.lit(0)) - F.col("_n")).cast("int")).otherwise(F.col("pages_failed"))
    after = counted.withColumns({"status": status, "pages_failed": failed}).select(*crawls.columns)
    domain = crawls.select(F.col("id").alias("crawl_id"), F.col("target_domain").alias("domain"))
    tasks = again.drop("dlq_reason", "dlq_at_utc", "domain").withColumn("retry_count", F.lit("0")).join(domain, "crawl_id", "left")
    return after, tasks, dead.join(asked, "crawl_id", "left_anti")


def control(crawls: DataFrame, requests: DataFrame) -> DataFrame:
    """Crawls after requests (id, action, seq), in order; one that doesn't apply to the state there is changes nothing."""
    asked = requests.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda r: r["action"]).alias("_asked"))  # an operator's requests: few a crawl

    def step(now: Column, action: Column) -> Column:
        out = now
        for name, (applies, to) in CONTROL.items():
            out = F.when((action == name) & applies(now), to).otherwise(out)
        return out

    after = F.aggregate(F.coalesce("_asked", F.expr("cast(array() as array<string>)")), F.col("status"), step)
    return crawls.join(asked, "id", "left").withColumn("status", after).select(*crawls.columns)


def drained(crawls: DataFrame, open_tasks: DataFrame, open_results: DataFrame) -> DataFrame:
    """The crawls, not paused or ended, that have neither tasks nor results (crawl_id) left: those to consolidate now."""
    busy = open_tasks.select("crawl_id").unionByName(open_results.select("crawl_id")).distinct()
    return crawls.where(F.col("status").isin("queued", "running", "draining")).join(busy, crawls["id"] == busy["crawl_id"], "left_anti")


def latest_inventory(rows: DataFrame) -> DataFrame:
    """The latest of inventory rows (INVENTORY, seq) of each address of a crawl."""
    return latest(rows.select(*INVENTORY, "seq"), ["crawl_id", "normalized_url"], "seq")

