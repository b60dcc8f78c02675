"""Queries over audit findings, which the rules give from pages' metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merge, reads
from tessera.operators.rules import evaluate_findings
from tessera.sources.tables import table

DETECTED = "fetched_at"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_findings(table(spark, sf_dir, "pages"), keep=(DETECTED,))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def audit_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("id", "rule_id", "crawl_id", "page_id", "url", "category", "severity", "canvas_zone", "explanation", "confidence", "status")


def finding_evidence(spark, sf_dir):
    out = findings(spark, sf_dir)
    return out.select("id", F.get_json_object("evidence", "$.selector").alias("selector"), "proposed")


def findings_filtered_page(spark, sf_dir):
    rows = reads.where_equal(findings(spark, sf_dir), category=" SEO ", severity="warning", status=None)
    return reads.page_of(rows.select("id", "rule_id", "page_id"), [F.col("page_id"), F.col("id")], page=2, per_page=25)


def findings_total_pages(spark, sf_dir):
    return reads.totals(findings(spark, sf_dir), 50, ["crawl_id"])


def summary_by_category(spark, sf_dir):
    return reads.by_category(findings(spark, sf_dir))


def summary_by_severity(spark, sf_dir):
    return reads.by_severity(findings(spark, sf_dir))


def pages_with_issues(spark, sf_dir):
    return reads.pages_with_issues(findings(spark, sf_dir))


def top_findings(spark, sf_dir):
    return reads.top_findings(findings(spark, sf_dir), DETECTED).select("crawl_id", "id", "severity", F.col("rank").cast("long").alias("rank"))


def pages_with_findings(spark, sf_dir):
    serious = findings(spark, sf_dir).where("severity = 'critical'")
    return reads.with_findings(pages(spark, sf_dir), serious, True).select("id", "crawl_id")


def pages_without_findings(spark, sf_dir):
    serious = findings(spark, sf_dir).where("severity = 'critical'")
    return reads.with_findings(pages(spark, sf_dir), serious, False).select("id", "crawl_id")


def page_severity_counts(spark, sf_dir):
    return reads.severity_counts(pages(spark, sf_dir), findings(spark, sf_dir))


def page_samples(spark, sf_dir):
    nested = reads.nested_findings(pages(spark, sf_dir), findings(spark, sf_dir), 5)
    return nested.select("id", F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("rules"))


def page_details(spark, sf_dir):
    nested = reads.page_details(pages(spark, sf_dir), findings(spark, sf_dir), table(spark, sf_dir, "page_contacts"))
    found = F.array_join(F.transform("findings", lambda f: f["finding_id"]), ",")
    known = F.array_join(F.array_sort(F.transform("contacts", lambda c: F.concat(c["kind"], F.lit(":"), c["value"]))), "|")
    return nested.select("id", F.coalesce(found, F.lit("")).alias("findings"), F.coalesce(known, F.lit("")).alias("contacts"))


def finding_lookup(spark, sf_dir):
    """Of each page the finding of one rule, by its key."""
    keys = pages(spark, sf_dir).select(F.concat_ws(":", F.col("id").cast("string"), F.lit("seo.thin_content")).alias("id"))
    return findings(spark, sf_dir).join(keys, "id", "left_semi").select("id", "crawl_id", "explanation")


def report_lines(spark, sf_dir):
    return reads.report_lines(table(spark, sf_dir, "crawls"), findings(spark, sf_dir))


def report_metrics(spark, sf_dir):
    return reads.report_metrics(findings(spark, sf_dir))


def finding_review(spark, sf_dir):
    """All critical findings approved, then audited again: the review stays."""
    old = findings(spark, sf_dir)
    reviews = old.where("severity = 'critical'").select("id", F.lit("approved").alias("status"), F.lit(1).alias("seq"))
    reviewed = merge.update_status(old.drop(DETECTED), reviews, "seq")
    again = old.where("category = 'seo'").drop(DETECTED).withColumn("explanation", F.lit("again")).withColumn("seq", F.lit(2))
    return merge.upsert_findings(reviewed, again, "seq").select("id", "status", "explanation")


QUERIES = {f.__name__: f for f in (
    audit_findings, finding_evidence, findings_filtered_page, findings_total_pages, summary_by_category, summary_by_severity, pages_with_issues, top_findings,
    pages_with_findings, pages_without_findings, page_severity_counts, page_samples, page_details, finding_lookup, report_lines, report_metrics, finding_review,
)}

_RULES = [
    ("seo.missing_h1", "seo", "critical", "head", "h1 = 0", "'No <h1> element was found on this page. Search engines rely on the H1 as the primary page heading.'", 0.90, "body", "'<h1>Insert descriptive page heading here</h1>'"),
    ("seo.multiple_h1", "seo", "warning", "head", "h1 > 1", "'Multiple <h1> elements found (' || h1 || '). Only one H1 per page is recommended.'", None, "h1", None),
    ("seo.missing_title", "seo", "critical", "head", "title = ''", "'No <title> tag found. The page title is critical for SEO and browser tab display.'", 0.95, "head > title", "'<title>Descriptive Page Title</title>'"),
    ("seo.missing_meta_description", "seo", "warning", "head", "descr = ''", "'No meta description tag found. Meta descriptions improve click-through rates in search results.'", 0.85, 'meta[name="description"]', "'<meta name=\"description\" content=\"Concise page summary here.\">'"),
    ("seo.missing_canonical", "seo", "warning", "head", "canonical = 'missing'", "'No canonical link tag found. Without it, duplicate content signals may confuse crawlers.'", 0.92, 'link[rel="canonical"]', "'<link rel=\"canonical\" href=\"' || url || '\" />'"),
    ("seo.thin_content", "seo", "warning", "content", "words < 300 AND status_code = 200", "'Page has only ' || words || ' words. Content under 300 words is often considered thin by search engines.'", None, "body", None),
    ("seo.missing_schema_org", "seo", "info", "content", "true", "'No JSON-LD Schema.org markup found. Structured data enables rich results in search.'", None, 'script[type="application/ld+json"]', None),
    ("security.missing_hsts", "security", "critical", "server", "list_contains(mh, 'HSTS') OR list_contains(mh, 'strict-transport-security')", "'The Strict-Transport-Security (HSTS) header is missing. This allows downgrade attacks from HTTPS to HTTP.'", 0.99, "response.headers", "'Strict-Transport-Security: max-age=31536000; includeSubDomains'"),
    ("security.missing_csp", "security", "critical", "server", "list_contains(mh, 'CSP') OR list_contains(mh, 'content-security-policy')", "'The Content-Security-Policy (CSP) header is missing, leaving the site vulnerable to XSS attacks.'", 0.85, "response.headers", "'Content-Security-Policy: default-src ''self'''"),
    ("security.missing_x_frame", "security", "warning", "server", "list_contains(mh, 'X-Frame-Options') OR list_contains(mh, 'x-frame-options')", "'X-Frame-Options header is missing. Pages can be embedded in iframes, enabling clickjacking attacks.'", 0.95, "response.headers", "'X-Frame-Options: SAMEORIGIN'"),
    ("security.missing_x_content_type", "security", "warning", "server", "list_contains(mh, 'X-Content-Type-Options') OR list_contains(mh, 'x-content-type-options')", "'X-Content-Type-Options header is missing. Browsers may MIME-sniff responses, enabling content injection.'", 0.99, "response.headers", "'X-Content-Type-Options: nosniff'"),
    ("security.missing_referrer_policy", "security", "info", "server", "list_contains(mh, 'Referrer-Policy') OR list_contains(mh, 'referrer-policy')", "'Referrer-Policy header is absent. The full URL may be sent to third parties via the Referer header.'", 0.95, "response.headers", "'Referrer-Policy: strict-origin-when-cross-origin'"),
    ("performance.slow_response", "performance", "warning", "server", "response > 800", "'Server response time is ' || CAST(round(response) AS BIGINT) || 'ms, exceeding the 800ms threshold. Slow TTFB negatively impacts Core Web Vitals.'", None, "network", None),
    ("performance.slow_load", "performance", "warning", "server", "dom > 3000", "'DOM complete time is ' || CAST(round(dom) AS BIGINT) || 'ms, exceeding 3000ms. Users on slower connections may abandon the page.'", None, "network", None),
    ("structure.broken_link", "seo", "warning", "content", "status_code IN (404, 410)", "'This page returned HTTP ' || status_code || ', indicating a broken or removed resource.'", None, "http.response", None),
]
FINDINGS_SQL = (
    """WITH base AS (
  SELECT id AS page_id, crawl_id, url, status_code, fetched_at, coalesce(metadata.seo.headings.h1_count, 0) AS h1, coalesce(metadata.seo.title, '') AS title,
         coalesce(metadata.seo.meta_description, '') AS descr, coalesce(metadata.seo.canonical_status, 'missing') AS canonical, coalesce(metadata.seo.content.word_count, 0) AS words,
         coalesce(metadata.security.missing_headers, []) AS mh, coalesce(metadata.runtime.response_time_ms, 0) AS response, metadata.runtime.dom_complete_ms AS dom
  FROM pages),
findings AS ("""
    + " UNION ALL ".join(
        f"SELECT page_id || ':{r}' AS id, '{r}' AS rule_id, crawl_id, page_id, url, '{c}' AS category, '{s}' AS severity, '{z}' AS canvas_zone, {x} AS explanation, "
        f"CAST({'NULL' if k is None else k} AS DOUBLE) AS confidence, 'open' AS status, '{sel}' AS selector, {p or 'NULL'} AS proposed, fetched_at FROM base WHERE {w}"
        for r, c, s, z, w, x, k, sel, p in _RULES
    )
    + ")\n"
)
_FILL = "SELECT c.crawl_id, d.name AS {col}, count(f.id) AS n FROM (SELECT DISTINCT crawl_id FROM findings) c CROSS JOIN (SELECT unnest([{names}]) AS name) d LEFT JOIN findings f ON f.crawl_id IS NOT DISTINCT FROM c.crawl_id AND f.{col} = d.name GROUP BY ALL"
ORACLE = {
    "audit_findings": FINDINGS_SQL + "SELECT id, rule_id, crawl_id, page_id, url, category, severity, canvas_zone, explanation, confidence, status FROM findings",
    "finding_evidence": FINDINGS_SQL + "SELECT id, selector, proposed FROM findings",
    "findings_filtered_page": FINDINGS_SQL + "SELECT id, rule_id, page_id FROM findings WHERE category = 'seo' AND severity = 'warning' ORDER BY page_id, id LIMIT 25 OFFSET 25",
    "findings_total_pages": FINDINGS_SQL + "SELECT crawl_id, count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM findings GROUP BY crawl_id",
    "summary_by_category": FINDINGS_SQL + _FILL.format(col="category", names="'seo','security','performance','accessibility'"),
    "summary_by_severity": FINDINGS_SQL + _FILL.format(col="severity", names="'critical','warning','info'"),
    "pages_with_issues": FINDINGS_SQL + "SELECT crawl_id, count(DISTINCT page_id) AS pages_with_issues FROM findings GROUP BY crawl_id",
    "top_findings": FINDINGS_SQL + "SELECT crawl_id, id, severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, fetched_at NULLS LAST, id) AS rank FROM findings) WHERE rank <= 5",
    "pages_with_findings": FINDINGS_SQL + "SELECT id, crawl_id FROM pages p WHERE EXISTS (SELECT 1 FROM findings f WHERE f.page_id = p.id AND f.severity = 'critical')",
    "pages_without_findings": FINDINGS_SQL + "SELECT id, crawl_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.page_id = p.id AND f.severity = 'critical')",
    "page_severity_counts": FINDINGS_SQL + "SELECT p.id, p.crawl_id, count(f.id) AS findings, count(*) FILTER (f.severity = 'critical') AS critical, count(*) FILTER (f.severity = 'warning') AS warning, count(*) FILTER (f.severity = 'info') AS info FROM pages p LEFT JOIN findings f ON f.page_id = p.id GROUP BY p.id, p.crawl_id",
    "page_samples": FINDINGS_SQL + "SELECT p.id, s.rules FROM pages p LEFT JOIN (SELECT page_id, string_agg(rule_id, ',' ORDER BY id) AS rules FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) AS rn FROM findings) WHERE rn <= 5 GROUP BY page_id) s ON s.page_id = p.id",
    "page_details": FINDINGS_SQL + "SELECT p.id, coalesce((SELECT string_agg(f.id, ',' ORDER BY f.id) FROM findings f WHERE f.page_id = p.id), '') AS findings, coalesce((SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT kind || ':' || value AS x, kind, value FROM page_contacts c WHERE c.page_id = p.id)), '') AS contacts FROM pages p",
    "finding_lookup": FINDINGS_SQL + "SELECT id, crawl_id, explanation FROM findings WHERE rule_id = 'seo.thin_content'",
    "report_lines": FINDINGS_SQL + "SELECT crawl_id, severity, id, '- [' || severity || '] ' || rule_id || ': ' || coalesce(url, '') AS line FROM findings WHERE crawl_id IN (SELECT id FROM crawls)",
    "report_metrics": FINDINGS_SQL + "SELECT crawl_id, count(*) AS total, count(DISTINCT rule_id) AS rules FROM findings GROUP BY crawl_id",
    "finding_review": FINDINGS_SQL + "SELECT id, CASE WHEN severity = 'critical' THEN 'approved' ELSE status END AS status, CASE WHEN category = 'seo' THEN 'again' ELSE explanation END AS explanation FROM findings",
}
