"""Signals of a page's HTML and headers, as Columns over regular expressions; no tree is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.urls import authority, canonicalize_url, let

#: Patterns that results depend on (fixed values).
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"(?i)<meta\s+[^>]*name=['\"]description['\"][^>]*content=['\"]([^'\"]*)['\"]|<meta\s+[^>]*content=['\"]([^'\"]*)['\"][^>]*name=['\"]description['\"]"
ROBOTS = r"(?i)<meta\s+[^>]*name=['\"]robots['\"][^>]*content=['\"]([^'\"]*)['\"]|<meta\s+[^>]*content=['\"]([^'\"]*)['\"][^>]*name=['\"]robots['\"]"
CANONICAL = r"(?i)<link\s+[^>]*rel=['\"]canonical['\"][^>]*href=['\"]([^'\"]*)['\"]|<link\s+[^>]*href=['\"]([^'\"]*)['\"][^>]*rel=['\"]canonical['\"]"
HREFLANG = r"(?i)<link\s+[^>]*rel=['\"]alternate['\"][^>]*hreflang=['\"]([^'\"]*)['\"][^>]*href=['\"]([^'\"]*)['\"]|<link\s+[^>]*hreflang=['\"]([^'\"]*)['\"][^>]*href=['\"]([^'\"]*)['\"][^>]*rel=['\"]alternate['\"]"
JSON_LD = r"(?is)<script\s+[^>]*type=['\"]application/ld\+json['\"][^>]*>(.*?)</script>"
HEADING = {n: rf"(?is)<h{n}[^>]*>(.*?)</h{n}>" for n in (1, 2, 3)}
IMAGE = r"(?i)<img\s+([^>]*)/?>"
ALT = r"(?i)alt=['\"]([^'\"]*)['\"]"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
SPACE = r"(?U)[\s\x1c-\x1f]+"
SECURITY_HEADERS = (
    ("strict-transport-security", "HSTS"),
    ("content-security-policy", "CSP"),
    ("x-frame-options", "X-Frame-Options"),
    ("x-content-type-options", "X-Content-Type-Options"),
    ("referrer-policy", "Referrer-Policy"),
    ("permissions-policy", "Permissions-Policy"),
)
COMPRESSIONS = ("gzip", "br", "zstd", "deflate")
THIN_WORDS, JSON_LD_KEPT, ERRORS_KEPT = 150, 10, 5


def collapse(text: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_text(markup: Column) -> Column:
    return collapse(F.regexp_replace(markup, r"<[^>]+>", ""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _either(text: Column, pattern: str) -> Column:
    """Of a pattern of two alternatives with a group each, the group that matched; '' without a match."""
    return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def title(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, TITLE, 1))


def meta_description(html: Column) -> Column:
    return clean_text(_either(html, DESCRIPTION))


def meta_robots(html: Column) -> Column:
    return F.lower(F.trim(_either(html, ROBOTS)))


def lower_keys(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ by case the last in order stays."""
    low = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))

    return F.map_from_entries(let(low, last))


def declared_canonical(html: Column) -> Column:
    return F.trim(_either(html, CANONICAL))


def canonical_status(declared: Column, request_url: Column, canonical_url: Column) -> Column:
    """missing, cross_domain, matches_url or mismatched_path."""

    def judge(x: Column) -> Column:
        foreign = (x["at"] != "") & (x["at"] != authority(F.coalesce(F.nullif(request_url, F.lit("")), canonical_url)))
        return F.when(x["url"] == "", "missing").when(foreign, "cross_domain").when(canonicalize_url(x["url"]).eqNullSafe(canonical_url), "matches_url").otherwise("mismatched_path")

    return let(let(declared, lambda d: F.struct(d.alias("url"), authority(d).alias("at"))), judge)


def hreflang(html: Column) -> Column:
    """The (lang, href) pairs of alternate links, both not empty."""
    def pair(tag: Column) -> Column:
        lang, href = (F.concat(F.regexp_extract(tag, HREFLANG, a), F.regexp_extract(tag, HREFLANG, b)) for a, b in ((1, 3), (2, 4)))
        return F.struct(F.trim(lang).alias("lang"), F.trim(href).alias("href"))

    return F.filter(F.transform(_all(html, HREFLANG, 0), pair), lambda p: (p["lang"] != "") & (p["href"] != ""))


def json_ld_entities(html: Column) -> Column:
    """The JSON texts of linked-data objects: each object, and the typed members of each list. Invalid JSON is skipped."""
    empty = F.expr("cast(array() as array<string>)")

    def entities(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        members = F.transform(F.from_json(text, "array<string>"), lambda x: x)
        typed = F.filter(members, lambda m: F.get_json_object(m, "$.@type").isNotNull() | F.get_json_object(m, "$['@type']").isNotNull())
        return F.when(parsed.isNull(), empty).when(F.trim(text).startswith("{"), F.array(F.trim(text))).when(F.trim(text).startswith("["), F.coalesce(typed, empty)).otherwise(empty)

    return F.flatten(F.transform(_all(html, JSON_LD), entities))


def types_of(entities: Column) -> Column:
    """The different @type values in order: of entities, and of the members of an object's @graph."""
    empty = F.expr("cast(array() as array<string>)")

    def of(entity: Column) -> Column:
        own = F.get_json_object(entity, "$['@type']")
        graph = F.from_json(F.get_json_object(entity, "$['@graph']"), "array<string>")
        nested = F.filter(F.transform(graph, lambda g: F.get_json_object(g, "$['@type']")), lambda t: t.isNotNull())
        return F.concat(F.when(own.isNotNull(), F.array(own)).otherwise(empty), F.coalesce(nested, empty))

    return F.array_distinct(F.flatten(F.transform(entities, of)))


def schema_types(html: Column) -> Column:
    return types_of(json_ld_entities(html))


def headings(html: Column) -> Column:
    found = F.struct(F.filter(F.transform(_all(html, HEADING[1]), clean_text), lambda t: t != "").alias("h1"), F.size(_all(html, HEADING[2])).alias("h2"), F.size(_all(html, HEADING[3])).alias("h3"))

    def judge(x: Column) -> Column:
        ordered = (F.size(x["h1"]) == 1) & ((x["h2"] > 0) | (x["h3"] == 0))
        return F.struct(F.size(x["h1"]).alias("h1_count"), x["h1"].alias("h1_texts"), x["h2"].alias("h2_count"), x["h3"].alias("h3_count"), ordered.alias("heading_order_valid"))

    return let(found, judge)


def images(html: Column) -> Column:
    counts = let(_all(html, IMAGE), lambda tags: F.struct(F.size(tags).alias("total"), F.size(F.filter(tags, lambda a: F.trim(F.regexp_extract(a, ALT, 1)) == "")).alias("missing")))

    def judge(x: Column) -> Column:
        covered = F.when(x["total"] > 0, ((x["total"] - x["missing"]) / x["total"] * 100).cast("int")).otherwise(100)
        return F.struct(x["total"].alias("total"), x["missing"].alias("missing_alt"), covered.alias("alt_coverage_pct"))

    return let(counts, judge)


def word_count(text: Column) -> Column:
    return let(collapse(text), lambda bare: F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))))


def content(html: Column, markdown: Column) -> Column:
    text = F.when(F.coalesce(markdown, F.lit("")) != "", markdown).otherwise(html)
    ratio = F.round(F.octet_length(text) / F.octet_length(html) * 100, 2)
    return let(word_count(text), lambda words: F.struct(words.alias("word_count"), F.char_length(text).alias("character_count"), ratio.alias("code_to_text_ratio"), (words < THIN_WORDS).alias("is_thin_content")))


def security_audit(headers: Column) -> Column:
    """The security struct of response headers; a null map counts as empty."""

    def audit(low: Column) -> Column:
        value = lambda name: F.coalesce(F.try_element_at(low, F.lit(name)), F.lit(""))
        missing = F.array_compact(F.array(*[F.when(value(name) == "", F.lit(label)) for name, label in SECURITY_HEADERS]))
        pairs = F.array_compact(F.array(*[F.when(value(name) != "", F.struct(F.lit(label).alias("key"), value(name).alias("value"))) for name, label in SECURITY_HEADERS]))
        cookies = F.filter(F.transform(F.split(value("set-cookie"), ","), F.trim), lambda c: c != "")

        def issues(cookie: Column) -> Column:
            found = F.array_compact(F.array(*[F.when(~F.lower(cookie).contains(flag.lower()), F.lit(f"missing {flag}")) for flag in ("Secure", "HttpOnly", "SameSite")]))
            name = F.trim(F.substring_index(F.substring_index(cookie, ";", 1), "=", 1))
            return let(found, lambda f: F.when(F.size(f) > 0, F.concat(name, F.lit(" ("), F.array_join(f, ", "), F.lit(")"))))

        encoding = F.trim(F.lower(F.coalesce(F.try_element_at(low, F.lit("content-encoding")), F.lit("none"))))
        return F.struct(
            ((F.lit(len(SECURITY_HEADERS)) - F.size(missing)) / len(SECURITY_HEADERS) * 100).cast("int").alias("security_score"),
            missing.alias("missing_headers"),
            F.map_from_entries(pairs).alias("present_headers"),
            F.array_compact(F.transform(cookies, issues)).alias("insecure_cookies"),
            encoding.alias("compression"),
            encoding.isin(*COMPRESSIONS).alias("is_compressed"),
        )

    return let(lower_keys(F.coalesce(headers, F.expr("cast(map() as map<string,string>)"))), audit)


def seo_audit(html: Column, headers: Column, canonical_url: Column, markdown: Column, request_url: Column) -> Column:
    """The SEO struct of a page; null for empty HTML."""
    low = lower_keys(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    once = F.struct(
        F.try_element_at(low, F.lit("x-robots-tag")).alias("x_robots"), meta_robots(html).alias("robots"), declared_canonical(html).alias("declared"),
        title(html).alias("title"), meta_description(html).alias("description"), json_ld_entities(html).alias("entities"),
    )

    def audit(x: Column) -> Column:
        header_no, page_no = F.coalesce(F.lower(x["x_robots"]).contains("noindex"), F.lit(False)), x["robots"].contains("noindex")
        both = (F.coalesce(x["x_robots"], F.lit("")) != "") & (x["robots"] != "")
        return F.struct(
            x["title"].alias("title"),
            F.char_length(x["title"]).alias("title_length"),
            x["description"].alias("meta_description"),
            F.char_length(x["description"]).alias("description_length"),
            (~(header_no | page_no)).alias("is_indexable"),
            x["x_robots"].alias("x_robots_tag"),
            F.nullif(x["robots"], F.lit("")).alias("meta_robots"),
            (both & (header_no != page_no)).alias("robots_conflict"),
            F.nullif(x["declared"], F.lit("")).alias("declared_canonical"),
            canonical_status(x["declared"], request_url, canonical_url).alias("canonical_status"),
            hreflang(html).alias("hreflang"),
            types_of(x["entities"]).alias("schema_types"),
            F.slice(x["entities"], 1, JSON_LD_KEPT).alias("json_ld_schemas"),
            headings(html).alias("headings"),
            images(html).alias("images"),
            content(html, markdown).alias("content"),
        )

    return F.when(F.coalesce(html, F.lit("")) != "", let(once, audit))


def runtime_audit(response_time: Column, fcp: Column, dom_interactive: Column, dom_complete: Column, errors: Column) -> Column:
    return F.struct(
        F.round(F.coalesce(response_time, F.lit(0.0)), 2).alias("response_time_ms"),
        F.round(fcp, 2).alias("fcp_ms"),
        F.round(dom_interactive, 2).alias("dom_interactive_ms"),
        F.round(dom_complete, 2).alias("dom_complete_ms"),
        F.coalesce(F.size(errors), F.lit(0)).alias("js_error_count"),
        F.slice(F.coalesce(errors, F.expr("cast(array() as array<string>)")), 1, ERRORS_KEPT).alias("js_errors_sample"),
    )


def full_audit(html: Column, headers: Column, canonical_url: Column, markdown: Column, request_url: Column, response_time: Column, fcp: Column, dom_interactive: Column, dom_complete: Column, errors: Column) -> Column:
    return F.struct(
        security_audit(headers).alias("security"),
        seo_audit(html, headers, canonical_url, markdown, request_url).alias("seo"),
        runtime_audit(response_time, fcp, dom_interactive, dom_complete, errors).alias("runtime"),
    )


def anchor_hrefs(html: Column) -> Column:
    """The targets of all anchors, in order."""
    return F.transform(_all(html, ANCHOR, 0), lambda tag: F.concat(*[F.regexp_extract(tag, ANCHOR, k) for k in (1, 2, 3)]))  # one of the three; the page is scanned once


def markdown_to_text(markdown: Column) -> Column:
    """Plain text: no images, links as their text, no fences of code, no marks of Markdown."""
    bare = F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", "")
    bare = F.regexp_replace(bare, r"\[([^\]]+)\]\([^)]*\)", "$1")
    bare = F.regexp_replace(bare, r"```[^\n]*\n?", "")
    return F.regexp_replace(bare, r"[*_`>#-]", "")
