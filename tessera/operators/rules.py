"""The deterministic audit rules: one narrow projection from a page's metadata to its findings.

Each rule is a condition and a struct; the array of a page's structs, without its nulls, is exploded. There is no shuffle and no
Python. Metadata may lack any of its structs or fields; what isn't there counts as in a page without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THIN_WORDS, SLOW_RESPONSE_MS, SLOW_LOAD_MS, TEXTS_KEPT = 300, 800, 3000, 5
GONE = (404, 410)
CATEGORIES = ("seo", "security", "performance", "accessibility")
SEVERITIES = ("critical", "warning", "info")


def field_or_null(schema: T.StructType, path: str, kind: str) -> Column:
    """The field at a dotted path, or a null of the kind where the schema has none."""
    at: T.DataType = schema
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            return F.lit(None).cast(kind)
        at = at[name].dataType
    return F.col(path)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    zone: str
    condition: Column
    explanation: Column
    selector: str
    observed: Column
    expected: Column
    proposed: Column | None = None
    confidence: float | None = None

    def finding(self) -> Column:
        evidence = F.to_json(F.struct(F.lit(self.selector).alias("selector"), self.observed.alias("observed"), self.expected.alias("expected")), {"ignoreNullFields": "false"})
        proposal = F.lit(None).cast("string") if self.proposed is None else self.proposed
        return F.when(
            self.condition,
            F.struct(
                F.lit(self.rule_id).alias("rule_id"), F.lit(self.category).alias("category"), F.lit(self.severity).alias("severity"), F.lit(self.zone).alias("canvas_zone"),
                self.explanation.alias("explanation"), evidence.alias("evidence"), proposal.alias("proposed"), F.lit(self.confidence).cast("double").alias("confidence"),
            ),
        )


def _one(name: str, value: Column) -> Column:
    return F.struct(value.alias(name))


def rules(schema: T.StructType, metadata: str = "metadata", url: str = "url", status: str = "status_code") -> list[Rule]:
    """The sixteen rules, in the order in which a page's findings are given; texts and thresholds are fixed values.

    Missing headers may be given by their labels (HSTS) or by their names (strict-transport-security).
    """
    get = lambda path, kind: field_or_null(schema, f"{metadata}.{path}", kind)
    lit, null = F.lit, F.lit(None).cast("string")
    h1 = F.coalesce(get("seo.headings.h1_count", "int"), lit(0))
    texts = F.coalesce(get("seo.headings.h1_texts", "array<string>"), F.expr("cast(array() as array<string>)"))
    words = F.coalesce(get("seo.content.word_count", "int"), lit(0))
    alt = F.coalesce(get("seo.images.missing_alt", "int"), lit(0))
    linked_data = F.coalesce(F.size(get("seo.json_ld_schemas", "array<string>")), lit(0))
    headers = F.coalesce(get("security.missing_headers", "array<string>"), F.expr("cast(array() as array<string>)"))
    response = F.coalesce(get("runtime.response_time_ms", "double").cast("double"), lit(0.0))
    load = get("runtime.dom_complete_ms", "double").cast("double")
    code, address = F.col(status), F.col(url)
    absent = lambda path: F.coalesce(get(path, "string"), lit("")) == ""
    lacks = lambda label, name: F.array_contains(headers, label) | F.exists(headers, lambda h: F.lower(h) == name)
    whole = lambda ms: F.format_string("%.0f", ms)

    def header(rule_id: str, severity: str, label: str, name: str, text: str, expected: str, proposed: str, confidence: float) -> Rule:
        return Rule(rule_id, "security", severity, "server", lacks(label, name), lit(text), "response.headers", _one(name, null), _one(name, lit(expected)), lit(proposed), confidence)

    return [
        Rule("seo.missing_h1", "seo", "critical", "head", h1 == 0, lit("No <h1> element was found on this page. Search engines rely on the H1 as the primary page heading."), "body", _one("h1_count", lit(0)), _one("h1_count", lit(1)), lit("<h1>Insert descriptive page heading here</h1>"), 0.90),
        Rule("seo.multiple_h1", "seo", "warning", "head", h1 > 1, F.concat(lit("Multiple <h1> elements found ("), h1.cast("string"), lit("). Only one H1 per page is recommended.")), "h1", F.struct(h1.alias("h1_count"), F.slice(texts, 1, TEXTS_KEPT).alias("h1_texts")), _one("h1_count", lit(1))),
        Rule("seo.missing_title", "seo", "critical", "head", absent("seo.title"), lit("No <title> tag found. The page title is critical for SEO and browser tab display."), "head > title", _one("title", null), _one("title", lit("Non-empty string")), lit("<title>Descriptive Page Title</title>"), 0.95),
        Rule("seo.missing_meta_description", "seo", "warning", "head", absent("seo.meta_description"), lit("No meta description tag found. Meta descriptions improve click-through rates in search results."), 'meta[name="description"]', _one("meta_description", null), _one("meta_description", lit("120-160 chars")), lit('<meta name="description" content="Concise page summary here.">'), 0.85),
        Rule("seo.missing_canonical", "seo", "warning", "head", F.coalesce(get("seo.canonical_status", "string"), lit("missing")) == "missing", lit("No canonical link tag found. Without it, duplicate content signals may confuse crawlers."), 'link[rel="canonical"]', _one("canonical_url", null), _one("canonical_url", address), F.concat(lit('<link rel="canonical" href="'), address, lit('" />')), 0.92),
        Rule("seo.thin_content", "seo", "warning", "content", (words < THIN_WORDS) & (code == 200), F.concat(lit("Page has only "), words.cast("string"), lit(" words. Content under 300 words is often considered thin by search engines.")), "body", _one("word_count", words), _one("word_count", lit(">= 300"))),
        Rule("seo.images_missing_alt", "seo", "info", "content", alt > 0, F.concat(alt.cast("string"), lit(" image(s) are missing alt text, harming accessibility and image SEO.")), "img:not([alt])", _one("images_without_alt", alt), _one("images_without_alt", lit(0))),
        Rule("seo.missing_schema_org", "seo", "info", "content", linked_data <= 0, lit("No JSON-LD Schema.org markup found. Structured data enables rich results in search."), 'script[type="application/ld+json"]', _one("json_ld_schemas", F.expr("cast(array() as array<string>)")), _one("json_ld_schemas", lit(">= 1 entity"))),
        header("security.missing_hsts", "critical", "HSTS", "strict-transport-security", "The Strict-Transport-Security (HSTS) header is missing. This allows downgrade attacks from HTTPS to HTTP.", "max-age=31536000; includeSubDomains", "Strict-Transport-Security: max-age=31536000; includeSubDomains", 0.99),
        header("security.missing_csp", "critical", "CSP", "content-security-policy", "The Content-Security-Policy (CSP) header is missing, leaving the site vulnerable to XSS attacks.", "policy string", "Content-Security-Policy: default-src 'self'", 0.85),
        header("security.missing_x_frame", "warning", "X-Frame-Options", "x-frame-options", "X-Frame-Options header is missing. Pages can be embedded in iframes, enabling clickjacking attacks.", "DENY or SAMEORIGIN", "X-Frame-Options: SAMEORIGIN", 0.95),
        header("security.missing_x_content_type", "warning", "X-Content-Type-Options", "x-content-type-options", "X-Content-Type-Options header is missing. Browsers may MIME-sniff responses, enabling content injection.", "nosniff", "X-Content-Type-Options: nosniff", 0.99),
        header("security.missing_referrer_policy", "info", "Referrer-Policy", "referrer-policy", "Referrer-Policy header is absent. The full URL may be sent to third parties via the Referer header.", "strict-origin-when-cross-origin", "Referrer-Policy: strict-origin-when-cross-origin", 0.95),
        Rule("performance.slow_response", "performance", "warning", "server", response > SLOW_RESPONSE_MS, F.concat(lit("Server response time is "), whole(response), lit("ms, exceeding the 800ms threshold. Slow TTFB negatively impacts Core Web Vitals.")), "network", _one("response_time_ms", response), _one("response_time_ms", lit("<= 800"))),
        Rule("performance.slow_load", "performance", "warning", "server", F.coalesce(load > SLOW_LOAD_MS, lit(False)), F.concat(lit("DOM complete time is "), whole(load), lit("ms, exceeding 3000ms. Users on slower connections may abandon the page.")), "network", _one("dom_complete_ms", load), _one("dom_complete_ms", lit("<= 3000"))),
        Rule("structure.broken_link", "seo", "warning", "content", code.isin(*GONE), F.concat(lit("This page returned HTTP "), code.cast("string"), lit(", indicating a broken or removed resource.")), "http.response", _one("status_code", code), _one("status_code", lit(200))),
    ]


def evaluate_findings(pages: DataFrame, page_id: str = "id", metadata: str = "metadata", keep: tuple[str, ...] = ()) -> DataFrame:
    """The findings of pages (page_id, crawl_id, url, status_code, metadata), in the order of the rules.

    Metadata may hold the audit at its top level or under ``audit``. A page that repeats gives its findings again.
    """
    kind = pages.schema[metadata].dataType
    if isinstance(kind, T.StructType) and "audit" in kind.fieldNames():
        pages = pages.withColumn(metadata, F.col(f"{metadata}.audit"))
    found = F.explode(F.array_compact(F.array(*[r.finding() for r in rules(pages.schema, metadata)]))).alias("f")
    rows = pages.select(F.col(page_id).alias("page_id"), "crawl_id", "url", *keep, found)
    return rows.select(
        F.concat_ws(":", F.col("page_id").cast("string"), "f.rule_id").alias("id"), "f.rule_id", "crawl_id", "page_id", "url", "f.category", "f.severity", "f.canvas_zone",
        "f.explanation", "f.evidence", "f.proposed", "f.confidence", F.lit("open").alias("status"), *keep,
    )
