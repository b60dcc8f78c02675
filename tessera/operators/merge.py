"""Merges of new rows into tables, without a table format: the result is a DataFrame to be written as the next version.

All need a total order, a column that tells later rows from earlier ones; a tie is broken by the row's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    """One row for each key by partial aggregation, so that a hot key costs a task one row."""
    by = F.struct(F.col(order), F.xxhash64(*[c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("map", "variant"))]))
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(row, by) if last else F.min_by(row, by)
    grouped = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(best.alias("_row"))
    return grouped.select("_row.*")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key; null is a key like others."""
    return _pick(df, keys, order, last=True)


def first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key."""
    return _pick(df, keys, order, last=False)


def _by_key(keys: list[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}"))
    return match


def upsert(target: DataFrame, new: DataFrame, keys: list[str], update: list[str], order: str) -> DataFrame:
    """New rows inserted, and columns ``update`` of existing rows taken from the latest new row, nulls included."""
    fresh = latest(new, keys, order)
    there, came = F.col("t._there").isNotNull(), F.col("n._came").isNotNull()
    joined = target.withColumn("_there", F.lit(1)).alias("t").join(fresh.withColumn("_came", F.lit(1)).alias("n"), _by_key(keys), "full_outer")
    out = []
    for c in target.columns:
        old, latest_value = F.col(f"t.{c}"), F.col(f"n.{c}") if c in fresh.columns else F.lit(None)
        out.append(F.when(there & ~came, old).when(there, latest_value if c in update else old).otherwise(latest_value).alias(c))
    return joined.select(*out)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The target and the first new row of each key it doesn't have."""
    fresh = first(new, keys, order)
    missing = fresh.alias("n").join(target.select(*keys).distinct().alias("t"), _by_key(keys), "left_anti")
    return target.unionByName(missing.select(*target.columns))


def append_unless_known(log: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """A log with new entries, the first of each key; entries without a key always enter."""
    keyed = new.where(F.col(key).isNotNull())
    entered = insert_ignore(log.where(F.col(key).isNotNull()), keyed, [key], order)
    return entered.unionByName(log.where(F.col(key).isNull())).unionByName(new.where(F.col(key).isNull()).select(*log.columns))


def upsert_pages(pages: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Results by (crawl_id, canonical_url): all but address, path and summary of a known page follow the latest result."""
    keys = ["crawl_id", "canonical_url"]
    return upsert(pages, results, keys, [c for c in pages.columns if c not in (*keys, "id", "url", "path", "summary")], order)


def upsert_findings(findings: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Findings by (page_id, rule_id): text, evidence, proposal and severity follow the new audit, the review stays."""
    return upsert(findings, new, ["page_id", "rule_id"], ["explanation", "evidence", "proposed", "confidence", "severity"], order)


#: From what a later message must not take back to what it may (fixed values).
STATUS_ORDER = ("queued", "excluded", "failed", "processed")


def upsert_inventory(inventory: DataFrame, new: DataFrame, order: str, keep_progress: bool = True) -> DataFrame:
    """Inventory by (crawl_id, normalized_url): all but the first original_url follow the latest row.

    With ``keep_progress`` a row that is less far doesn't take back a status or page; without it nulls overwrite.
    """
    keys = ["crawl_id", "normalized_url"]
    update = [c for c in inventory.columns if c not in (*keys, "original_url")]
    if not keep_progress:
        return upsert(inventory, new, keys, update, order)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("processing_status")), F.lit(0))
    both = inventory.withColumn(order, F.lit(None).cast(new.schema[order].dataType)).unionByName(new.select(*inventory.columns, order))
    at = F.struct(rank.alias("r"), F.col(order).isNotNull().alias("new"), F.col(order))
    picked = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in update]
    oldest = F.min_by("original_url", F.struct(F.col(order).isNotNull(), F.col(order))).alias("original_url")
    return both.groupBy(*keys).agg(oldest, *picked).select(*inventory.columns)


def update_status(findings: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Findings with the latest status of ``updates`` (id, status); ids that aren't known are ignored."""
    fresh = latest(updates.select("id", "status", order), ["id"], order).select("id", F.col("status").alias("_status"))
    return findings.join(fresh, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*findings.columns)


def delete_crawls(table: DataFrame, crawls: DataFrame, column: str = "crawl_id") -> DataFrame:
    """A child table without the rows of the crawls (id); rows without a crawl stay."""
    return table.join(crawls.select(F.col("id").alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left_anti")


def retain(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Rows that are at most ``days`` old; those exactly so old stay, those without a time go."""
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def ensure_crawls(crawls: DataFrame, seen: DataFrame) -> DataFrame:
    """Crawls with a running one for each crawl_id of ``seen`` that has none."""
    new = seen.select(F.col("crawl_id").alias("id")).where("id is not null").distinct().join(crawls.select("id"), "id", "left_anti")
    config = F.to_json(F.struct(F.col("id").alias("alias")))
    filled = {"id": F.col("id"), "status": F.lit("running"), "config": config}
    return crawls.unionByName(new.select(*[filled.get(c, F.lit(None)).cast(crawls.schema[c].dataType).alias(c) for c in crawls.columns]))
