"""A crawl's consolidation: counts, contacts and the health scorecard, for all crawls at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rules import field_or_null


def _percent(part: Column, whole: Column, empty: int) -> Column:
    return F.when(whole > 0, (part / whole * 100).cast("int")).otherwise(empty)


def scorecard(pages: DataFrame) -> DataFrame:
    """(crawl_id, pages, h1, description and alt coverage, average security score): one row for each crawl with pages.

    Denominators count all pages of a crawl, those without metadata too; scores that are null don't enter the average.
    """
    get = lambda path, kind: field_or_null(pages.schema, f"metadata.{path}", kind)
    images, missing = F.coalesce(get("seo.images.total", "int"), F.lit(0)), F.coalesce(get("seo.images.missing_alt", "int"), F.lit(0))
    score = get("security.security_score", "int")
    sums = pages.groupBy("crawl_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.coalesce(get("seo.headings.h1_count", "int"), F.lit(0)) >= 1).alias("h1"),
        F.count_if(F.coalesce(get("seo.meta_description", "string"), F.lit("")) != "").alias("described"),
        F.sum(images).alias("images"),
        F.sum(missing).alias("without_alt"),
        F.sum(score.cast("long")).alias("score"),
        F.count(score).alias("scores"),
    )
    return sums.select(
        "crawl_id",
        "pages",
        _percent(F.col("h1"), F.col("pages"), 0).alias("h1_coverage_pct"),
        _percent(F.col("described"), F.col("pages"), 0).alias("meta_description_coverage_pct"),
        _percent(F.col("images") - F.col("without_alt"), F.col("images"), 100).alias("image_alt_coverage_pct"),
        F.coalesce((F.col("score") / F.nullif(F.col("scores"), F.lit(0))).cast("int"), F.lit(0)).alias("average_security_score"),
    )


def histogram(pages: DataFrame, path: str, name: str) -> DataFrame:
    """(crawl_id, name, n) over the members of an array of strings."""
    each = pages.select("crawl_id", F.explode(field_or_null(pages.schema, path, "array<string>")).alias(name))
    return each.groupBy("crawl_id", name).agg(F.count("*").alias("n"))


def missing_headers(pages: DataFrame) -> DataFrame:
    return histogram(pages, "metadata.security.missing_headers", "header")


def schema_types(pages: DataFrame) -> DataFrame:
    return histogram(pages, "metadata.seo.schema_types", "schema_type")


def contact_rollup(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_id, kind, value, occurrences); contacts are counted for each page first, so a page moves one row for each."""
    per_page = contacts.groupBy("page_id", "kind", "value").agg(F.count("*").alias("n"))
    return per_page.join(pages.select(F.col("id").alias("page_id"), "crawl_id"), "page_id").groupBy("crawl_id", "kind", "value").agg(F.sum("n").alias("occurrences"))


def anchor_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("to_url").contains("#")).groupBy("crawl_id").agg(F.count("*").alias("anchor_links_evaluated"))


def consolidate(crawls: DataFrame, pages: DataFrame, contacts: DataFrame, links: DataFrame, failed: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """One report for each crawl, those without pages too. ``failed`` and ``dropped`` have crawl_id, a row for each event."""
    rolled = contact_rollup(contacts, pages).groupBy("crawl_id").agg(F.count_if(F.col("kind") == "email").alias("unique_emails"), F.count_if(F.col("kind") == "phone").alias("unique_phones"))
    out = crawls.select(F.col("id").alias("crawl_id"))
    parts = [scorecard(pages).withColumnRenamed("pages", "pages_processed"), rolled, anchor_links(links)]
    for rows, name in ((failed, "pages_failed"), (dropped, "telemetry_dropped")):
        if rows is not None:
            parts.append(rows.groupBy("crawl_id").agg(F.count("*").alias(name)))
    for part in parts:
        out = out.join(part, "crawl_id", "left")
    filled = {c: F.coalesce(c, F.lit(100 if c == "image_alt_coverage_pct" else 0).cast(out.schema[c].dataType)) for c in out.columns if c != "crawl_id"}
    return out.withColumns(filled)
