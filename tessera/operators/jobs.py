"""States of export and preview jobs, and the look-ups of an operator who inspects crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import crawl_uuid

#: What a job may become (fixed values); the terminal states change no more.
NEXT = {
    "queued": ("processing", "cancelled", "failed"),
    "processing": ("completed", "completed_with_errors", "failed", "cancelled"),
}
TERMINAL = ("completed", "completed_with_errors", "failed", "cancelled")


def allowed(status: Column, wanted: Column) -> Column:
    hit = F.lit(False)
    for now, after in NEXT.items():
        hit = hit | ((status == now) & wanted.isin(*after))
    return hit


def advance(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs (id, status) after requests (id, wanted, seq) were applied in order; what isn't allowed is ignored.

    A job has few requests: its states are a fold over them.
    """
    asked = requests.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "wanted"))), lambda r: r["wanted"]).alias("_asked"))
    after = F.aggregate(F.coalesce("_asked", F.expr("cast(array() as array<string>)")), F.col("status"), lambda now, wanted: F.when(allowed(now, wanted), wanted).otherwise(now))
    return jobs.join(asked, "id", "left").withColumn("status", after).select(*jobs.columns)


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs with those of ``ids`` cancelled; terminal ones stay as they are, so cancelling again changes nothing."""
    return advance(jobs, ids.select("id", F.lit("cancelled").alias("wanted"), F.lit(0).alias("seq")))


def final_status(unavailable: Column, failed: Column) -> Column:
    """How a job ends: with errors where any item lacks content, excluded ones too."""
    return F.when(failed, "failed").when(unavailable > 0, "completed_with_errors").otherwise("completed")


def find_crawl(crawls: DataFrame, name: str) -> DataFrame:
    """The newest crawl with this id, or whose configuration calls it so."""
    alias = F.coalesce(F.get_json_object("config", "$.crawl_id") == name, F.lit(False)) | F.coalesce(F.get_json_object("config", "$.alias") == name, F.lit(False))
    return crawls.where((F.col("id") == crawl_uuid(F.lit(name))) | alias).orderBy(F.col("started_at").desc_nulls_last(), "id").limit(1)


def inspection(crawls: DataFrame, pages: DataFrame, contacts: DataFrame, newest: int = 5) -> DataFrame:
    """The newest crawls with their pages and contacts counted."""
    top = crawls.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(newest).select("id", "target_domain", "status")
    per_page = contacts.groupBy("page_id").agg(F.count("*").alias("n"))
    counted = pages.join(per_page.withColumnRenamed("page_id", "id"), "id", "left").groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("contacts"))
    return top.join(counted, "id", "left").withColumns({"pages": F.coalesce("pages", F.lit(0)), "contacts": F.coalesce("contacts", F.lit(0))})
