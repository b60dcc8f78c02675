"""Queries over addresses and links: canonical forms, inventory, gates, rules, selection, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import patterns, urls
from tessera.operators import gates, merge, reads, selection
from tessera.sources.tables import table

#: Rules for the queries below.
INCLUDE = ["/courses/**", "/guides/**", "/library/**", "/blog/*"]
EXCLUDE = ["/blog/**", "/courses/*early*", "/**/*museum*"]


def canonical_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "id", "url")
    return rows.select("id", urls.canonicalize_url(F.col("url")).alias("canonical"), urls.fingerprint(F.col("url")).alias("fingerprint"), urls.host(F.col("url")).alias("host"), urls.origin(F.col("url")).alias("origin"))


def link_parts(spark, sf_dir):
    rows = selection.inventory_of(table(spark, sf_dir, "page_links", "id", "to_url"))
    return rows.select("id", "normalized_url", "origin", "normalized_path", F.size("query_parameters").cast("long").alias("parameters"))


def url_inventory(spark, sf_dir):
    """Each crawl's links, the latest row of an address winning."""
    rows = selection.inventory_of(table(spark, sf_dir, "page_links"))
    return merge.latest(rows.select("id", "crawl_id", "normalized_url", "original_url", "normalized_path"), ["crawl_id", "normalized_url"], "id")


def _inventory(spark, sf_dir, own=True):
    """Inventory rows of a crawl's pages and links, of its own origin or of all: pages are processed, other links queued."""
    links = selection.inventory_of(table(spark, sf_dir, "page_links", "id", "crawl_id", "to_url"))
    if own:  # before the aggregate
        crawls = table(spark, sf_dir, "crawls", F.col("id").alias("crawl_id"), urls.origin(F.col("target_url")).alias("target_origin"))
        links = links.join(crawls, "crawl_id").where("origin = target_origin")
    rows = links.groupBy("crawl_id", "normalized_url").agg(F.min("id").alias("id"), F.min_by("origin", "id").alias("origin"), F.min_by("normalized_path", "id").alias("normalized_path"))
    known = table(spark, sf_dir, "pages", "id", "crawl_id", "canonical_url").groupBy("crawl_id", F.col("canonical_url").alias("normalized_url")).agg(F.min("id").alias("page_id"))
    rows = rows.join(known, ["crawl_id", "normalized_url"], "left")
    status = F.when(F.col("page_id").isNotNull(), "processed").when(F.col("normalized_path").contains("member"), "excluded").otherwise("queued")
    return rows.withColumn("processing_status", status).withColumn("exclusion_reason", F.lit(None).cast("string")).withColumn("matched_rule_id", F.lit(None).cast("string"))


def _selected(spark, sf_dir):
    """The selection of each crawl's own origin."""
    include, exclude = patterns.compile_rules(["/**"], "include", ""), patterns.compile_rules(["/**/*login*", "/our-*"], "exclude", "")
    return selection.select_inventory(_inventory(spark, sf_dir), table(spark, sf_dir, "pages"), F.col("origin"), "/", "markdown", include, exclude, ("image",))


def selection_items(spark, sf_dir):
    return _selected(spark, sf_dir).select("id", "crawl_id", "normalized_url", "decision", "reason", "content_status")


def selection_counts(spark, sf_dir):
    return selection.selection_counts(_selected(spark, sf_dir), ["crawl_id"])


def selection_manifest(spark, sf_dir):
    rows = selection.selection_manifest(_selected(spark, sf_dir))
    return rows.select("id", *[F.get_json_object("item", f"$.{k}").alias(k) for k in ("url", "page_id", "decision", "reason", "content_status")])


def selection_scope(spark, sf_dir):
    rows = selection.select_inventory(_inventory(spark, sf_dir), table(spark, sf_dir, "pages"), F.col("origin"), "/o", "html", [], [])
    return rows.select("id", "normalized_path", "decision", "reason", "content_status")


def archive_names(spark, sf_dir):
    return selection.archive_entries(_selected(spark, sf_dir), "markdown", ["crawl_id"]).select("id", "crawl_id", "name")


def url_rule_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "pages", "id", "url")
    include, exclude = (patterns.compile_rules(p, k, "https://any.example") for p, k in ((INCLUDE, "include"), (EXCLUDE, "exclude")))
    answer = patterns.evaluate_link(F.col("url"), None, include, exclude, ("document",))
    return rows.select("id", answer.alias("a")).select("id", "a.decision", "a.reason", "a.normalized_path", "a.rule_id")


def anchor_links(spark, sf_dir):
    """Every anchor of every page, resolved against the page's address."""
    html = table(spark, sf_dir, "page_content", "page_id", F.col("raw_html").alias("html")).where("html is not null")
    pages = html.join(table(spark, sf_dir, "pages", F.col("id").alias("page_id"), "url"), "page_id")
    return gates.page_links(pages).select("page_id", F.col("at").cast("long").alias("at"), "href", "url")


def _gated(spark, sf_dir):
    html = table(spark, sf_dir, "page_content", "page_id", F.col("raw_html").alias("html")).where("html is not null")
    pages = html.join(table(spark, sf_dir, "pages", F.col("id").alias("page_id"), "url"), "page_id")
    links = gates.numbered_links(pages)
    return gates.gate_links(links, urls.host(F.col("base")), known=table(spark, sf_dir, "pages", "canonical_url"))


def link_gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("page_id", F.col("at").cast("long").alias("at"), "reason")


def telemetry_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def telemetry_recent(spark, sf_dir):
    dropped = _gated(spark, sf_dir).where("reason <> 'URL_DISCOVERED'").select("page_id", F.col("at").cast("long").alias("at"), "reason")
    return dropped.orderBy(F.col("page_id").desc(), F.col("at").desc()).limit(50)


def graph_edges(spark, sf_dir):
    return reads.graph_edges(table(spark, sf_dir, "page_links"), table(spark, sf_dir, "pages"))


def graph_limited(spark, sf_dir):
    return reads.graph_edges(table(spark, sf_dir, "page_links"), table(spark, sf_dir, "pages"), most_pages=10)


def incoming_links(spark, sf_dir):
    return reads.incoming_links(table(spark, sf_dir, "page_links"), table(spark, sf_dir, "pages"))


def outgoing_links(spark, sf_dir):
    links = table(spark, sf_dir, "page_links").where("from_page_id is not null")
    return links.groupBy(F.col("from_page_id").alias("page_id")).agg(F.count("*").alias("outgoing"), F.count_if("is_internal").alias("internal"))


def link_insert_ignore(spark, sf_dir):
    """The links of the first half of ids are known; the first of each new edge enters."""
    keys = ["crawl_id", "from_page_id", "canonical_to_url"]
    links = table(spark, sf_dir, "page_links").select("id", *keys)
    old = merge.first(links.where("id % 2 = 0"), keys, "id")
    return merge.insert_ignore(old, links.where("id % 2 = 1"), keys, "id")


def url_duplicates(spark, sf_dir):
    return reads.duplicate_counts(table(spark, sf_dir, "pages", "canonical_url"), "canonical_url")


QUERIES = {f.__name__: f for f in (
    canonical_urls, link_parts, url_inventory, selection_items, selection_counts, selection_manifest, selection_scope, archive_names, url_rule_decisions,
    anchor_links, link_gates, telemetry_reasons, telemetry_recent, graph_edges, graph_limited, incoming_links, outgoing_links, link_insert_ignore, url_duplicates,
)}


def _sql(column: str) -> dict[str, str]:
    """The parts of an address, in SQL."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
    part = lambda n: f"regexp_extract({column}, '{pattern}', {n})"
    address = f"lower(regexp_replace({part(2)}, '^.*@', ''))"
    scheme, host, written = f"lower({part(1)})", f"regexp_replace({address}, ':[0-9]*$', '')", f"regexp_extract({address}, ':([0-9]*)$', 1)"
    port = f"(CASE WHEN ({scheme} = 'http' AND {written} = '80') OR ({scheme} = 'https' AND {written} = '443') OR {written} = '' THEN '' ELSE ':' || {written} END)"
    path = f"regexp_replace(regexp_replace({part(3)}, ';[^/]*$', ''), '/+$', '')"
    path = f"(CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    query = f"(CASE WHEN {part(4)} = '' THEN '' ELSE '?' || {part(4)} END)"
    return {"canonical": f"({scheme} || '://' || {host} || {port} || {path} || {query})", "host": host, "origin": f"({scheme} || '://' || {host} || {port})", "path": path, "query": part(4)}


_U, _T = _sql("url"), _sql("to_url")
#: The rules of the query as they are meant: kind, place, pattern, what matches the parts of a path, and how specific it is.
_RULES = (
    ("include", 0, "/courses/**", "parts[1] = 'courses'", (1, -1, -2, 9)),
    ("include", 1, "/guides/**", "parts[1] = 'guides'", (1, -1, -2, 8)),
    ("include", 2, "/library/**", "parts[1] = 'library'", (1, -1, -2, 9)),
    ("include", 3, "/blog/*", "len(parts) = 2 AND parts[1] = 'blog'", (1, 0, -1, 6)),
    ("exclude", 0, "/blog/**", "parts[1] = 'blog'", (1, -1, -2, 6)),
    ("exclude", 1, "/courses/*early*", "len(parts) = 2 AND parts[1] = 'courses' AND contains(parts[2], 'early')", (1, 0, -2, 14)),
    ("exclude", 2, "/**/*museum*", "len(parts) > 0 AND contains(parts[-1], 'museum')", (0, -1, -4, 8)),
)
_DOCUMENT = "regexp_matches(lower(normalized_path), '[.](pdf|doc|docx|xls|xlsx|ppt|pptx)$')"
_HITS = " UNION ALL ".join(f"SELECT id, '{k}:' || substr(sha256('{k}:{i}:{p}'), 1, 16) AS rule_id, '{k}' AS kind, {i} AS pos, {', '.join(f'{x} AS s{n}' for n, x in enumerate(s))} FROM u WHERE {hit}" for k, i, p, hit, s in _RULES)
_DECISIONS = f"""WITH u AS (SELECT id, {_U['path']} AS normalized_path, list_filter(string_split(lower({_U['path']}), '/'), lambda x: x <> '') AS parts FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s0 DESC, s1 DESC, s2 DESC, s3 DESC, (kind = 'exclude') DESC, pos) AS rn, count(*) FILTER (kind = 'include') OVER (PARTITION BY id) AS n_include FROM ({_HITS}))
SELECT u.id, CASE WHEN {_DOCUMENT} OR coalesce(m.n_include, 0) = 0 OR m.kind = 'exclude' THEN 'excluded' ELSE 'included' END AS decision,
       CASE WHEN {_DOCUMENT} THEN 'excluded_resource_type:document' WHEN coalesce(m.n_include, 0) = 0 THEN 'include_no_match' ELSE 'matched_' || m.kind END AS reason,
       u.normalized_path, CASE WHEN coalesce(m.n_include, 0) > 0 AND NOT {_DOCUMENT} THEN m.rule_id END AS rule_id
FROM u LEFT JOIN m ON m.id = u.id AND m.rn = 1"""
_ALL_INVENTORY = f"""WITH l AS (SELECT id, crawl_id, {_T['canonical']} AS normalized_url, {_T['origin']} AS origin, {_T['path']} AS normalized_path FROM page_links),
g AS (SELECT crawl_id, normalized_url, min(id) AS id, arg_min(origin, id) AS origin, arg_min(normalized_path, id) AS normalized_path FROM l GROUP BY ALL),
k AS (SELECT crawl_id, canonical_url AS normalized_url, min(id) AS page_id FROM pages GROUP BY ALL),
inv AS (SELECT g.*, k.page_id, CASE WHEN k.page_id IS NOT NULL THEN 'processed' WHEN contains(normalized_path, 'member') THEN 'excluded' ELSE 'queued' END AS processing_status FROM g LEFT JOIN k USING (crawl_id, normalized_url))
"""
_INVENTORY = _ALL_INVENTORY.replace("USING (crawl_id, normalized_url))", f"USING (crawl_id, normalized_url) JOIN crawls w ON w.id = g.crawl_id WHERE g.origin = {_sql('w.target_url')['origin']}),")
_SELECTED = _INVENTORY + """
sel AS (SELECT i.*, CASE WHEN processing_status = 'excluded' AND page_id IS NULL THEN 'crawl_restriction' WHEN regexp_matches(normalized_path, '(?i)[.](png|jpg|jpeg|gif|webp|svg|ico|avif)$') THEN 'excluded_resource_type:image'
        WHEN regexp_matches(normalized_path, '(?i)^/our-[^/]*/?$') OR regexp_matches(normalized_path, '(?i)^(/[^/]+)*/[^/]*login[^/]*/?$') THEN 'matched_exclude' ELSE 'matched_include' END AS reason,
        CASE WHEN p.id IS NOT NULL AND coalesce(p.markdown_file_id, '') <> '' THEN 'available' ELSE 'unavailable' END AS content_status FROM inv i LEFT JOIN pages p ON p.id = i.page_id),
d AS (SELECT *, CASE WHEN reason = 'matched_include' THEN 'included' ELSE 'excluded' END AS decision FROM sel)
"""
_EDGES = "SELECT l.crawl_id, l.from_page_id AS source, t.id AS target, count(*) AS links FROM page_links l JOIN {nodes} t ON t.crawl_id = l.crawl_id AND t.canonical_url = l.canonical_to_url WHERE l.from_page_id IS NOT NULL AND l.from_page_id <> t.id AND EXISTS (SELECT 1 FROM {nodes} s WHERE s.crawl_id = l.crawl_id AND s.id = l.from_page_id) GROUP BY ALL"
_HREFS = r"""regexp_extract_all(c.raw_html, '(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1)"""
_ANCHORS = f"""WITH h AS (SELECT c.page_id, p.url AS base, {_HREFS} AS hrefs FROM page_content c JOIN pages p ON p.id = c.page_id WHERE c.raw_html IS NOT NULL),
a AS (SELECT page_id, base, n - 1 AS pos, hrefs[n] AS href FROM (SELECT *, unnest(generate_series(1, len(hrefs))) AS n FROM h)),
r AS (SELECT page_id, base, pos, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN lower(regexp_extract(base, '^([^:]*):', 1)) || ':' || href WHEN starts_with(href, '/') THEN lower(regexp_extract(base, '^([^:]*)://', 1)) || regexp_extract(base, '^[^:]*(://[^/?#]*)', 1) || href ELSE NULL END AS url FROM a)
"""
_R, _B = _sql("url"), _sql("base")
_DENIED = "|".join(gates.DENIED_PATHS)
_GATES = (
    _ANCHORS
    + f""", x AS (SELECT page_id, pos, href, url, {_R['canonical']} AS canonical, {_B['host']} AS domain, {_R['host']} AS host, {_R['path']} AS path, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, min(pos) OVER (PARTITION BY page_id, url) AS first_at FROM r),
y AS (SELECT *, CASE WHEN pos <> first_at THEN 'PAGE_DUPLICATE' WHEN scheme NOT IN ('http', 'https') THEN 'INVALID_SCHEME' WHEN NOT (host = domain OR ends_with(host, '.' || domain)) THEN 'OFFSITE_DOMAIN'
  WHEN regexp_matches(path, '(?i)/({_DENIED})') THEN 'DENY_PATTERN' END AS early FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY domain, canonical, early IS NULL ORDER BY page_id, pos) AS rn FROM y),
gated AS (SELECT page_id, pos, coalesce(early, CASE WHEN rn = 1 AND canonical NOT IN (SELECT canonical_url FROM pages WHERE canonical_url IS NOT NULL) THEN 'URL_DISCOVERED' ELSE 'DUPLICATE' END) AS reason FROM z)
"""
)
_EDGE_ROWS = "SELECT id, crawl_id, from_page_id, canonical_to_url, row_number() OVER (PARTITION BY id % 2, crawl_id, from_page_id, canonical_to_url ORDER BY id) AS rn, min(id % 2) OVER (PARTITION BY crawl_id, from_page_id, canonical_to_url) AS low FROM page_links"
ORACLE = {
    "canonical_urls": f"SELECT id, {_U['canonical']} AS canonical, sha256({_U['canonical']}) AS fingerprint, {_U['host']} AS host, {_U['origin']} AS origin FROM pages",
    "link_parts": f"SELECT id, {_T['canonical']} AS normalized_url, {_T['origin']} AS origin, {_T['path']} AS normalized_path, CAST(len(list_distinct(list_transform(list_filter(string_split({_T['query']}, '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1]))) AS BIGINT) AS parameters FROM page_links",
    "url_inventory": f"SELECT id, crawl_id, normalized_url, original_url, normalized_path FROM (SELECT id, crawl_id, to_url AS original_url, {_T['canonical']} AS normalized_url, {_T['path']} AS normalized_path, row_number() OVER (PARTITION BY crawl_id, {_T['canonical']} ORDER BY id DESC) AS rn FROM page_links) WHERE rn = 1",
    "selection_items": _SELECTED + "SELECT id, crawl_id, normalized_url, decision, reason, content_status FROM d",
    "selection_counts": _SELECTED + "SELECT crawl_id, count(*) AS total_candidates, count(*) FILTER (decision = 'included') AS included, count(*) FILTER (decision = 'excluded') AS excluded, count(*) FILTER (decision = 'outside_scope') AS outside_scope, count(*) FILTER (content_status = 'unavailable') AS unavailable_content FROM d GROUP BY crawl_id",
    "selection_manifest": _SELECTED + "SELECT id, normalized_url AS url, page_id::VARCHAR AS page_id, decision, reason, content_status FROM d",
    "selection_scope": _INVENTORY + "sel AS (SELECT i.id, i.normalized_path, i.page_id, i.processing_status, p.metadata.html_file_id AS f FROM inv i LEFT JOIN pages p ON p.id = i.page_id WHERE starts_with(normalized_path, '/o')) SELECT id, normalized_path, CASE WHEN normalized_path = '/o' OR starts_with(normalized_path, '/o/') THEN CASE WHEN processing_status = 'excluded' THEN 'excluded' ELSE 'included' END ELSE 'outside_scope' END AS decision, CASE WHEN normalized_path = '/o' OR starts_with(normalized_path, '/o/') THEN CASE WHEN processing_status = 'excluded' THEN 'crawl_restriction' ELSE 'no_rules' END ELSE 'outside_scope' END AS reason, CASE WHEN page_id IS NOT NULL AND coalesce(f, '') <> '' THEN 'available' ELSE 'unavailable' END AS content_status FROM sel",
    "archive_names": _SELECTED + ", n AS (SELECT id, crawl_id, array_to_string(list_filter(string_split(regexp_replace(normalized_url, '[?#].*$', ''), '/'), lambda x: x NOT IN ('', '.', '..')), '/') || '.md' AS base FROM d WHERE decision = 'included'), m AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, base ORDER BY id) AS rn FROM n) SELECT id, crawl_id, CASE WHEN rn = 1 THEN base ELSE regexp_replace(base, '[.]md$', '-' || rn || '.md') END AS name FROM m",
    "url_rule_decisions": _DECISIONS,
    "anchor_links": _ANCHORS + 'SELECT page_id, pos AS "at", href, url FROM r',
    "link_gates": _GATES + 'SELECT page_id, pos AS "at", reason FROM gated',
    "telemetry_reasons": _GATES + "SELECT reason, count(*) AS n FROM gated GROUP BY reason",
    "telemetry_recent": _GATES + """SELECT page_id, pos AS "at", reason FROM gated WHERE reason <> 'URL_DISCOVERED' ORDER BY page_id DESC, pos DESC LIMIT 50""",
    "graph_edges": _EDGES.format(nodes="pages"),
    "graph_limited": _EDGES.format(nodes="(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY id) AS rn FROM pages) WHERE rn <= 10)"),
    "incoming_links": "SELECT p.id AS page_id, count(*) AS incoming FROM pages p JOIN page_links l ON l.crawl_id = p.crawl_id AND l.canonical_to_url = p.canonical_url GROUP BY p.id",
    "outgoing_links": "SELECT from_page_id AS page_id, count(*) AS outgoing, count(*) FILTER (is_internal) AS internal FROM page_links WHERE from_page_id IS NOT NULL GROUP BY from_page_id",
    "link_insert_ignore": f"SELECT id, crawl_id, from_page_id, canonical_to_url FROM ({_EDGE_ROWS}) WHERE rn = 1 AND id % 2 = low",
    "url_duplicates": "SELECT canonical_url, count(*) - 1 AS repeats FROM pages GROUP BY canonical_url HAVING count(*) > 1",
}
