"""Selection of a crawl's known URLs for export, by scope and rules, and its counts and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.patterns import Rule, archive_name, evaluate_url
from tessera.functions.urls import canonicalize_url, let, normalized_path, origin_of, query_map, split_url

EXTENSIONS = {"markdown": ".md", "html": ".html", "text": ".txt"}


def inventory_of(links: DataFrame, url: str = "to_url") -> DataFrame:
    """``links`` with original_url, normalized_url, origin, normalized_path and query_parameters."""
    cut = let(canonicalize_url(F.col(url)), lambda w: F.struct(w.alias("whole"), split_url(w).alias("parts")))
    rows = links.withColumn("_cut", cut)
    whole, parts = F.col("_cut.whole"), F.col("_cut.parts")
    return rows.withColumns({"original_url": F.col(url), "normalized_url": whole, "origin": origin_of(parts), "normalized_path": normalized_path(parts["path"]), "query_parameters": query_map(whole)}).drop("_cut")


def in_scope(scope_path: str, candidate: Column) -> Column:
    """Whether a path is the scope or lies under it; all do under the root."""
    return F.lit(True) if scope_path == "/" else (candidate == scope_path) | candidate.startswith(scope_path + "/")


def content_status(page: Column, markdown_id: Column, html_id: Column, form: str) -> Column:
    """available or unavailable; ``page`` is null where there is none."""
    has = {"markdown": markdown_id, "text": markdown_id, "html": html_id}.get(form, F.lit(None).cast("string"))
    return F.when(page.isNotNull() & (F.coalesce(has, F.lit("")) != ""), "available").otherwise("unavailable")


def select_inventory(inventory: DataFrame, pages: DataFrame, target_origin: Column | str, scope_path: str, form: str, include: list[Rule], exclude: list[Rule], exclude_types: tuple[str, ...] = ()) -> DataFrame:
    """The inventory's rows of the origin with decision, reason, rule_id and content_status.

    The prefix filter reaches the scan; the scope is tested again exactly. Rows that are excluded or failed and have no page keep their
    own reason; rows with a page are judged by the rules, whatever their old status.
    """
    rows = inventory.where(F.col("origin") == target_origin)
    if scope_path != "/":
        rows = rows.where(F.col("normalized_path").startswith(scope_path))
    of = pages.select(F.col("id").alias("page_id"), F.col("id").alias("_page"), "markdown_file_id", F.col("metadata.html_file_id").alias("html_file_id"))
    joined = rows.join(of, "page_id", "left")
    judged = evaluate_url(F.col("normalized_url"), target_origin, include, exclude, exclude_types)
    stale = F.col("processing_status").isin("excluded", "failed") & F.col("_page").isNull()
    null = F.lit(None).cast("string")
    fresh = let(judged, lambda j: F.struct(j["decision"].alias("decision"), j["reason"].alias("reason"), j["rule_id"].alias("rule_id")))
    answer = (
        F.when(~in_scope(scope_path, F.col("normalized_path")), F.struct(F.lit("outside_scope").alias("decision"), F.lit("outside_scope").alias("reason"), null.alias("rule_id")))
        .when(stale, F.struct(F.lit("excluded").alias("decision"), F.coalesce("exclusion_reason", F.lit("crawl_restriction")).alias("reason"), F.col("matched_rule_id").alias("rule_id")))
        .otherwise(fresh)
    )
    status = content_status(F.col("_page"), F.col("markdown_file_id"), F.col("html_file_id"), form)
    return joined.withColumn("a", answer).select(*inventory.columns, "a.decision", "a.reason", "a.rule_id", status.alias("content_status"))


def selection_counts(selected: DataFrame, by: list[str] | None = None) -> DataFrame:
    count = lambda hit: F.count_if(hit)
    return selected.groupBy(*(by or [])).agg(
        F.count("*").alias("total_candidates"),
        count(F.col("decision") == "included").alias("included"),
        count(F.col("decision") == "excluded").alias("excluded"),
        count(F.col("decision") == "outside_scope").alias("outside_scope"),
        count(F.col("content_status") == "unavailable").alias("unavailable_content"),
    )


def selection_manifest(selected: DataFrame) -> DataFrame:
    """One JSON document for each selected URL."""
    item = F.to_json(F.struct(F.col("normalized_url").alias("url"), "page_id", "decision", "reason", F.col("rule_id").alias("matched_rule_id"), "content_status"), {"ignoreNullFields": "false"})
    return selected.select("id", item.alias("item"))


def archive_entries(selected: DataFrame, form: str, by: list[str] | None = None) -> DataFrame:
    """Included rows with the name of their file; equal names are told apart by -2, -3 in order of id, case by case of a base name."""
    end = EXTENSIONS[form]
    rows = selected.where("decision = 'included'").withColumn("base", archive_name(F.col("normalized_url"), end))
    n = F.row_number().over(Window.partitionBy(*(by or []), "base").orderBy("id"))
    stem = F.regexp_replace("base", r"\.[^.]*$", "")
    suffix = F.regexp_extract("base", r"(\.[^.]*)$", 1)
    return rows.withColumn("n", n).withColumn("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(stem, F.lit("-"), F.col("n").cast("string"), suffix))).drop("n")


def preview_log(selected: DataFrame, job: Column, error: Column | None = None, cancelled: Column | None = None) -> DataFrame:
    """(preview_id, seq, event_type, payload) of preview jobs: started, an event for each evaluated URL, and completed, cancelled or failed.

    ``job`` is the id of a row's job. ``error`` is a job's message if it failed, ``cancelled`` whether it was cancelled; such a job has no event of its end besides.
    Events are in order of seq: 0, the rows' own ids, and the last of all.
    """
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = selected.withColumns({"preview_id": job, "_error": F.lit(None).cast("string") if error is None else error, "_cancelled": F.lit(False) if cancelled is None else cancelled})
    inside = F.when(F.col("decision") == "outside_scope", "outside_scope").otherwise("in_scope")
    each = rows.select(
        "preview_id", F.col("id").cast("long").alias("seq"), F.lit("url.evaluated").alias("event_type"),
        as_json(F.col("normalized_url").alias("url"), inside.alias("scope_decision"), "decision", F.col("rule_id").alias("matched_pattern"), "content_status", "reason").alias("payload"),
    )
    counts = selection_counts(rows, ["preview_id"])
    jobs = rows.groupBy("preview_id").agg(F.max("_error").alias("error"), F.max("_cancelled").alias("cancelled")).join(counts, "preview_id")
    began = jobs.select("preview_id", F.lit(-1).cast("long").alias("seq"), F.lit("preview.started").alias("event_type"), as_json("preview_id", "total_candidates").alias("payload"))
    end = F.when(F.col("error").isNotNull(), "failed").when(F.col("cancelled"), "cancelled").otherwise("completed")
    numbers = ("total_candidates", "included", "excluded", "outside_scope", "unavailable_content")
    told = (
        F.when(end == "failed", as_json("preview_id", F.lit("PREVIEW_FAILED").alias("error_code"), F.col("error").alias("message")))
        .when(end == "cancelled", as_json("preview_id"))
        .otherwise(as_json("preview_id", end.alias("status"), *numbers))
    )
    ended = jobs.select("preview_id", F.lit((1 << 63) - 1).alias("seq"), F.concat(F.lit("preview."), end).alias("event_type"), told.alias("payload"))
    return began.unionByName(each).unionByName(ended)


def preview_replay(log: DataFrame, preview_id: str, after: int | None = None) -> DataFrame:
    """The events of one job after a cursor, in order, up to its terminal event."""
    rows = log.where(F.col("preview_id") == preview_id)
    return (rows if after is None else rows.where(F.col("seq") > after)).orderBy("seq")
