"""Read models: filters, pages of results, summaries and joins over crawls, pages, findings, links and contacts.

Each is one declarative plan. Where both sides of a join are large, the many side is aggregated first, so a hot key sends one row for
each task. Orders always end in a unique column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.html import markdown_to_text
from tessera.functions.urls import path_parent
from tessera.operators.rules import CATEGORIES, SEVERITIES

MOST_PER_PAGE = 200


def severity_rank(severity: Column) -> Column:
    """critical, warning, info, anything else."""
    out = F.when(severity == SEVERITIES[0], 0)
    for n, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == name, n)
    return out.otherwise(len(SEVERITIES))


def where_equal(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows whose columns equal the values given, in lower case and trimmed; a value that is None filters nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value.strip().lower())
    return df


def contains(column: Column, term: str) -> Column:
    """Case-insensitive search in which % and _ are wildcards."""
    return column.ilike(f"%{term}%")


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of results, numbered from 1."""
    per_page = max(1, min(per_page, MOST_PER_PAGE))
    return df.orderBy(*order).offset((max(1, page) - 1) * per_page).limit(per_page)


def total_pages(total: Column, per_page: int) -> Column:
    """At least 1."""
    return F.when(total > 0, F.ceil(total / per_page)).otherwise(F.lit(1)).cast("long")


def totals(df: DataFrame, per_page: int, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total")).withColumn("total_pages", total_pages(F.col("total"), per_page))


def _filled(counts: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Counts by (crawl_id, column) with a 0 for each name of a fixed list that a crawl lacks: the list is a literal array."""
    crawl = counts.groupBy("crawl_id").agg(*[F.sum(F.when(F.col(column) == n, F.col("n")).otherwise(0)).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(column), F.col(n).alias("n")) for n in names])).alias("x")
    return crawl.select("crawl_id", pairs).select("crawl_id", f"x.{column}", "x.n")


def by_category(findings: DataFrame) -> DataFrame:
    return _filled(findings.groupBy("crawl_id", "category").agg(F.count("*").alias("n")), "category", CATEGORIES)


def by_severity(findings: DataFrame) -> DataFrame:
    return _filled(findings.groupBy("crawl_id", "severity").agg(F.count("*").alias("n")), "severity", SEVERITIES)


def pages_with_issues(findings: DataFrame) -> DataFrame:
    """Exact distinct pages, in two aggregates."""
    return findings.select("crawl_id", "page_id").distinct().groupBy("crawl_id").agg(F.count("*").alias("pages_with_issues"))


def top_findings(findings: DataFrame, detected: str, n: int = 5) -> DataFrame:
    """The n gravest findings of each crawl, the earliest first; the rank's limit is pushed below the shuffle."""
    w = Window.partitionBy("crawl_id").orderBy(severity_rank(F.col("severity")), F.col(detected).asc_nulls_last(), "id")
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_findings(pages: DataFrame, findings: DataFrame, has: bool | None = None) -> DataFrame:
    """Pages with, without or regardless of findings."""
    if has is None:
        return pages
    return pages.join(findings.select(F.col("page_id").alias("id")), "id", "left_semi" if has else "left_anti")


def severity_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("page_id").agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    joined = pages.join(counts.withColumnRenamed("page_id", "id"), "id", "left")
    return joined.select("id", "crawl_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", *SEVERITIES)])


def nested_findings(pages: DataFrame, findings: DataFrame, n: int | None = None) -> DataFrame:
    """Pages with their findings as an array in order of id; a page has at most as many as there are rules."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("id").alias("finding_id"), "rule_id", "category", "severity", "explanation")))
    per_page = findings.groupBy("page_id").agg((listed if n is None else F.slice(listed, 1, n)).alias("findings"))
    return pages.join(per_page.withColumnRenamed("page_id", "id"), "id", "left")


def page_details(pages: DataFrame, findings: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pages with findings and contacts: each side is aggregated before it is joined, so they don't multiply."""
    listed = F.array_sort(F.collect_set(F.struct("kind", "value")))
    return nested_findings(pages, findings).join(contacts.groupBy(F.col("page_id").alias("id")).agg(listed.alias("contacts")), "id", "left")


def crawl_list(crawls: DataFrame, findings: DataFrame, domain: str | None = None, status: str | None = None) -> DataFrame:
    """Crawls, filtered, with their findings counted."""
    rows = crawls if domain is None else crawls.where(contains(F.col("target_domain"), domain))
    rows = where_equal(rows, status=status)
    counts = findings.groupBy("crawl_id").agg(F.count("*").alias("findings_count"))
    return rows.join(counts.withColumnRenamed("crawl_id", "id"), "id", "left").withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))


def newest_first(time: str, key: str = "id") -> list[Column]:
    return [F.col(time).desc_nulls_first(), F.col(key).desc()]


TERMINAL, ENDED, ACTIVE = ("finished", "completed"), ("failed", "cancelled"), ("running", "queued", "paused", "draining", "consolidating")


def crawl_status(status: Column, processed: Column, reported: Column) -> Column:
    return F.when(reported, "finished").when((status == "queued") & (processed > 0), "running").otherwise(status)


def progress(status: Column, processed: Column, most: Column) -> Column:
    running = F.when(most > 0, F.least(F.lit(0.95), F.round(processed / most, 2))).otherwise(0.5)
    return F.when(status.isin(*TERMINAL), 1.0).when(status.isin(*ENDED), F.when(processed > 0, 1.0).otherwise(0.0)).when(status.isin(*ACTIVE), running).otherwise(0.0)


def next_action(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), "retrieve").when(status.isin(*ACTIVE), "wait").otherwise("none")


def max_pages(config: Column, default: int = 15) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(config, "$.max_pages").try_cast("int"), F.lit(0)), F.lit(default))


def path_counts(pages: DataFrame) -> DataFrame:
    return pages.where("path is not null").groupBy("crawl_id", "path").agg(F.count("*").alias("pages"))


def path_tree(pages: DataFrame) -> DataFrame:
    """(crawl_id, path, pages, parent, depth): a path's parent is the one directly above if the crawl has it, else the root."""
    counts = path_counts(pages)
    nodes = counts.withColumn("above", path_parent(F.col("path")))
    up = counts.select("crawl_id", F.col("path").alias("above"), F.lit(True).alias("exists"))
    joined = nodes.join(up, ["crawl_id", "above"], "left")
    parent = F.when(F.col("above").isNull(), None).when(F.col("exists"), F.col("above")).otherwise("/")
    return joined.select("crawl_id", "path", "pages", parent.alias("parent"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def contacts_of(contacts: DataFrame, pages: DataFrame, kind: str | None = None, term: str | None = None) -> DataFrame:
    """Contacts with their page's crawl and address, of one kind (None or 'all' for any) and containing a term."""
    rows = contacts if kind in (None, "all") else where_equal(contacts, kind=kind)
    rows = rows if term is None else rows.where(contains(F.col("value"), term))
    return rows.join(pages.select(F.col("id").alias("page_id"), "crawl_id", "url"), "page_id")


def contact_sources(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_id, kind, value, sources): how many different pages have a contact."""
    each = contacts_of(contacts, pages).select("crawl_id", "kind", "value", "page_id").distinct()
    return each.groupBy("crawl_id", "kind", "value").agg(F.count("*").alias("sources"))


def contact_counts(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    per_page = contacts.groupBy("page_id", "kind").agg(F.count("*").alias("n"))
    return per_page.join(pages.select(F.col("id").alias("page_id"), "crawl_id"), "page_id").groupBy("crawl_id", "kind").agg(F.sum("n").alias("n"))


def search_pages(pages: DataFrame, term: str) -> DataFrame:
    """Pages whose address or summary contains a term; a null summary doesn't match."""
    hit = contains(F.col("url"), term) | contains(F.col("canonical_url"), term) | contains(F.col("summary"), term)
    return pages.where(F.coalesce(hit, F.lit(False)))


def incoming_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, incoming): links of the same crawl to a page's canonical address, counted before they are joined."""
    counted = links.groupBy("crawl_id", F.col("canonical_to_url").alias("canonical_url")).agg(F.count("*").alias("incoming"))
    return pages.select(F.col("id").alias("page_id"), "crawl_id", "canonical_url").join(counted, ["crawl_id", "canonical_url"]).select("page_id", "incoming")


def graph_edges(links: DataFrame, pages: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(crawl_id, source, target, links): links between two different pages of a crawl, of its first pages by id if limited."""
    nodes = pages.select("crawl_id", "id", "canonical_url")
    if most_pages is not None:
        nodes = nodes.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("id"))).where(F.col("n") <= most_pages).drop("n")
    counted = links.where("from_page_id is not null").groupBy("crawl_id", F.col("from_page_id").alias("source"), F.col("canonical_to_url").alias("canonical_url")).agg(F.count("*").alias("links"))
    to = nodes.select("crawl_id", "canonical_url", F.col("id").alias("target"))
    found = counted.join(to, ["crawl_id", "canonical_url"]).where("source <> target")
    return found.join(nodes.select("crawl_id", F.col("id").alias("source")), ["crawl_id", "source"], "left_semi").select("crawl_id", "source", "target", "links")


def artifacts(pages: DataFrame) -> DataFrame:
    """(page_id, kind, file_id) of each stored file of a page."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("file_id")) for k, c in (("markdown", F.col("markdown_file_id")), ("html", F.col("metadata.html_file_id")))])).alias("a")
    return pages.select(F.col("id").alias("page_id"), rows).where(F.coalesce("a.file_id", F.lit("")) != "").select("page_id", "a.kind", "a.file_id")


def page_content(pages: DataFrame, content: DataFrame, form: Column) -> DataFrame:
    """(page_id, form, status, body): a page's text in a form, or CONTENT_UNAVAILABLE where its file is missing."""
    joined = pages.select(F.col("id").alias("page_id"), "markdown_file_id", F.col("metadata.html_file_id").alias("html_file_id")).join(content, "page_id", "left").withColumn("form", form)
    body = F.when(F.col("form") == "markdown", F.col("raw_markdown")).when(F.col("form") == "text", markdown_to_text(F.col("raw_markdown"))).otherwise(F.col("raw_html"))
    file = F.when(F.col("form") == "html", F.col("html_file_id")).otherwise(F.col("markdown_file_id"))
    there = (F.coalesce(file, F.lit("")) != "") & body.isNotNull()
    return joined.select("page_id", "form", F.when(there, "AVAILABLE").otherwise("CONTENT_UNAVAILABLE").alias("status"), F.when(there, body).alias("body"))


def active_crawl(crawls: DataFrame) -> DataFrame:
    """(domain, id, status) of the newest crawl in flight of each domain, in lower case."""
    flying = crawls.where(F.col("status").isin("queued", "running", "paused")).withColumn("domain", F.lower("target_domain"))
    newest = flying.groupBy("domain").agg(F.max(F.struct(F.col("started_at").alias("at"), "id", "status")).alias("x"))
    return newest.select("domain", "x.id", "x.status")


def crawl_total(crawls: DataFrame, domain: str | None = None, status: str | None = None) -> DataFrame:
    """The number of crawls that the filters of ``crawl_list`` leave."""
    rows = crawls if domain is None else crawls.where(contains(F.col("target_domain"), domain.strip().lower()))
    return where_equal(rows, status=status).agg(F.count("*").alias("total"))


def inventory_statistics(inventory: DataFrame) -> DataFrame:
    """(crawl_id, discovered, processed, failed, excluded, pending) by the processing_status of a crawl's addresses."""
    is_ = lambda *names: F.count_if(F.col("processing_status").isin(*names))
    return inventory.groupBy("crawl_id").agg(F.count("*").alias("discovered"), is_("processed").alias("processed"), is_("failed").alias("failed"), is_("excluded").alias("excluded"), is_("queued", "processing").alias("pending"))


def content_types(inventory: DataFrame) -> DataFrame:
    """(crawl_id, content_type, n) of addresses that have one."""
    return inventory.where(F.coalesce("content_type", F.lit("")) != "").groupBy("crawl_id", "content_type").agg(F.count("*").alias("n"))


def grouped_contacts(contacts: DataFrame, pages: DataFrame, page: int = 1, per_page: int = 50, kind: str | None = None, term: str | None = None, source_page: int | None = None) -> DataFrame:
    """(value, source_pages) of one page of contacts in order of (value, id): grouped after they were cut to the page, so a value may go on in the next."""
    rows = contacts_of(contacts, pages, kind, term)
    rows = rows if source_page is None else rows.where(F.col("page_id") == source_page)
    one = page_of(rows.select("id", "value", "page_id"), [F.col("value"), F.col("id")], page, per_page)
    return one.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "page_id"))), lambda x: x["page_id"]).alias("source_pages"))


def contacts_with_address(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, kind, value, url) of contacts whose page is known, with its canonical address, or an empty one where it has none."""
    known = contacts.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    address = pages.where("canonical_url is not null").select(F.col("id").alias("page_id"), F.col("canonical_url").alias("url"))
    return known.join(address, "page_id", "left").select("id", "kind", "value", F.coalesce("url", F.lit("")).alias("url"))


def graph_nodes(pages: DataFrame, findings: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(crawl_id, id, url, title, status_code, findings_count) of the pages of each crawl, its first ones by id if limited."""
    nodes = pages.select("crawl_id", "id", F.col("canonical_url").alias("url"), F.col("metadata.seo.title").alias("title"), "status_code")
    if most_pages is not None:
        nodes = nodes.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("id"))).where(F.col("n") <= most_pages).drop("n")
    counts = findings.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("findings_count"))
    return nodes.join(counts, "id", "left").withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))


def deliverable(crawls: DataFrame, pages: DataFrame, findings: DataFrame, contacts: DataFrame) -> DataFrame:
    """(crawl_id, part, key, item): a crawl's JSON deliverable, one document for each item, in order of (part, key).

    Part 0 is the crawl with its metrics, 1 its findings by severity and id, 2 its pages by id, 3 its contacts by id. A deliverable is as long as its crawl, so
    it is rows and never one value; ``export.write_lines`` writes them.
    """
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    of_page = pages.select(F.col("id").alias("page_id"), "crawl_id")
    found = contacts.join(of_page, "page_id")
    n_findings = findings.groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").alias("total_findings"))
    n_contacts = contacts.groupBy("page_id").agg(F.count("*").alias("n")).join(of_page, "page_id").groupBy(F.col("crawl_id").alias("id")).agg(F.sum("n").alias("total_contacts"))
    head = crawls.join(n_findings, "id", "left").join(n_contacts, "id", "left")
    metrics = F.struct("pages_processed", "pages_failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_findings", "total_contacts")]).alias("metrics")
    times = [iso_time(F.col(c)).alias(c) for c in ("started_at", "finished_at")]
    parts = [
        head.select(F.col("id").alias("crawl_id"), F.lit(0).alias("part"), F.lit("").alias("key"), as_json(F.col("id").alias("crawl_id"), "target_url", "target_domain", "status", *times, metrics).alias("item")),
        findings.select("crawl_id", F.lit(1).alias("part"), F.concat_ws(" ", "severity", "id").alias("key"), as_json("id", "rule_id", "url", "category", "severity", "canvas_zone", "explanation", "status").alias("item")),
        pages.select("crawl_id", F.lit(2).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), as_json("id", "url", "canonical_url", "status_code", "markdown_file_id", "markdown_token_count").alias("item")),
        found.select("crawl_id", F.lit(3).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), as_json("page_id", "kind", "value").alias("item")),
    ]
    return reduce(DataFrame.unionByName, parts).join(crawls.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi")


def iso_time(time: Column) -> Column:
    """A timestamp in ISO 8601, in UTC, with as many digits of a second as it has (none or six)."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def recent_dead_letters(dead: DataFrame, newest: int = 50) -> DataFrame:
    """(crawl_id, id, url, dlq_reason, failed_at_utc) of the newest dead letters of each crawl, and ``total``, how many it has."""
    w = Window.partitionBy("crawl_id").orderBy(F.col("failed_at_utc").desc_nulls_last(), F.col("id").desc())
    totals = dead.groupBy("crawl_id").agg(F.count("*").alias("total"))
    last = dead.withColumn("n", F.row_number().over(w)).where(F.col("n") <= newest).drop("n")
    return last.join(totals, "crawl_id").withColumn("failed_at_utc", iso_time(F.col("failed_at_utc"))).select("crawl_id", "id", "url", "dlq_reason", "failed_at_utc", "total")


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, repeats) of values that occur more than once: how often after the first."""
    return df.groupBy(key).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def report_lines(crawls: DataFrame, findings: DataFrame) -> DataFrame:
    """(crawl_id, severity, id, line): a crawl's Markdown report, a line for each finding, by severity in alphabetical order, then id.

    A report is as long as its crawl, so it is rows in order and never one value; ``export.write_lines`` writes it.
    """
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "rule_id", F.lit(": "), F.coalesce("url", F.lit("")))
    return findings.join(crawls.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi").select("crawl_id", "severity", "id", line.alias("line"))


def report_metrics(findings: DataFrame) -> DataFrame:
    return findings.groupBy("crawl_id").agg(F.count("*").alias("total"), F.countDistinct("rule_id").alias("rules"))
