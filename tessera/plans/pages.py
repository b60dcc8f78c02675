"""Queries over crawls, pages, contacts and their content."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contacts as C
from tessera.functions import html as H
from tessera.functions import payload as P
from tessera.functions.urls import crawl_uuid
from tessera.operators import gates, jobs, reads, rollup
from tessera.operators.rules import evaluate_findings
from tessera.plans.findings import FINDINGS_SQL, findings
from tessera.plans.urls import _sql
from tessera.session import bound_batches
from tessera.sources.tables import table


def crawl_list(spark, sf_dir):
    rows = reads.crawl_list(table(spark, sf_dir, "crawls"), findings(spark, sf_dir), domain="o%-", status=" Completed")
    return rows.select("id", "target_domain", "status", "findings_count").orderBy(*reads.newest_first("started_at")).limit(50)


def crawl_counts(spark, sf_dir):
    return reads.crawl_list(table(spark, sf_dir, "crawls"), findings(spark, sf_dir)).select("id", "findings_count")


def crawl_status(spark, sf_dir):
    rows = table(spark, sf_dir, "crawls", "id", "status", "pages_processed", "config")
    now = reads.crawl_status(F.col("status"), F.coalesce("pages_processed", F.lit(0)), F.get_json_object("config", "$.consolidation").isNotNull())
    rows = rows.withColumn("now", now).withColumn("most", reads.max_pages(F.col("config")))
    done = reads.progress(F.col("now"), F.coalesce("pages_processed", F.lit(0)), F.col("most"))
    return rows.select("id", F.col("now").alias("status"), done.alias("progress"), reads.next_action(F.col("now")).alias("next_action"))


def crawl_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "crawls", "id", "target_domain")
    return rows.select("id", crawl_uuid(F.col("id")).alias("by_id"), crawl_uuid(F.lower("target_domain")).alias("by_name"))


def path_tree(spark, sf_dir):
    return reads.path_tree(table(spark, sf_dir, "pages", "crawl_id", "path")).select("crawl_id", "path", "pages", "parent", F.col("depth").cast("long").alias("depth"))


def page_search(spark, sf_dir):
    rows = reads.search_pages(table(spark, sf_dir, "pages"), "museum").select("id", "url")
    return reads.page_of(rows, [F.col("url"), F.col("id")], page=1, per_page=100)


def statistics(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "crawl_id", "status_code", "markdown_file_id")
    good = F.col("status_code") < 400
    return pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(good).alias("processed"), F.count_if(F.col("status_code") >= 500).alias("failed"), F.count_if(F.col("status_code").between(400, 499)).alias("excluded"), F.count_if(F.col("markdown_file_id").isNull()).alias("pending"))


def status_histogram(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "crawl_id", "status_code").where("status_code is not null")
    return pages.groupBy("crawl_id", F.col("status_code").cast("string").alias("status")).agg(F.count("*").alias("n"))


def artifacts(spark, sf_dir):
    return reads.artifacts(table(spark, sf_dir, "pages"))


def page_metadata(spark, sf_dir):
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return table(spark, sf_dir, "pages").select("id", "canonical_url", has(F.col("markdown_file_id")).alias("has_markdown"), has(F.col("metadata.html_file_id")).alias("has_html"), "markdown_byte_size", "markdown_token_count")


def contact_list(spark, sf_dir):
    rows = reads.contacts_of(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"), kind="email", term="team")
    return reads.page_of(rows.select("id", "value", "url"), [F.col("value"), F.col("id")], page=1, per_page=200)


def contact_sources(spark, sf_dir):
    return reads.contact_sources(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"))


def contact_counts(spark, sf_dir):
    return reads.contact_counts(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"))


def contact_rollup(spark, sf_dir):
    return rollup.contact_rollup(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"))


def scorecard(spark, sf_dir):
    return rollup.scorecard(table(spark, sf_dir, "pages"))


def missing_headers(spark, sf_dir):
    return rollup.missing_headers(table(spark, sf_dir, "pages"))


def consolidation(spark, sf_dir):
    failed = table(spark, sf_dir, "pages").where("status_code >= 500").select("crawl_id")
    dropped = table(spark, sf_dir, "page_links").where("not is_internal").select("crawl_id")
    return rollup.consolidate(*(table(spark, sf_dir, t) for t in ("crawls", "pages", "page_contacts", "page_links")), failed, dropped)


def seo_signals(spark, sf_dir):
    """The signals of every page's HTML."""
    pages = table(spark, sf_dir, "pages", F.col("id").alias("page_id"), "url", "canonical_url")
    rows = table(spark, sf_dir, "page_content").where("length(raw_html) > 0").join(pages, "page_id")
    seo = H.seo_audit(F.col("raw_html"), F.expr("cast(map() as map<string,string>)"), F.col("canonical_url"), F.col("raw_markdown"), F.col("url"))
    s = rows.select("page_id", seo.alias("s"))
    return s.select(
        "page_id", "s.title", "s.title_length", "s.meta_description", "s.is_indexable", "s.declared_canonical", "s.canonical_status", "s.headings.h1_count", "s.headings.h2_count", "s.headings.h3_count",
        "s.headings.heading_order_valid", F.array_join("s.headings.h1_texts", "|").alias("h1_texts"), "s.images.total", "s.images.missing_alt", "s.images.alt_coverage_pct", "s.content.word_count", "s.content.character_count",
        "s.content.code_to_text_ratio", "s.content.is_thin_content", F.size("s.schema_types").alias("schema_types"), F.size("s.hreflang").alias("hreflang"),
    )


def security_signals(spark, sf_dir):
    """The audit of headers that stand for what each page's metadata says of them."""
    pages = table(spark, sf_dir, "pages", "id", "status_code", F.col("metadata.security.missing_headers").alias("missing")).where("missing is not null")
    names = dict(H.SECURITY_HEADERS)
    pairs = [F.when(~(F.array_contains("missing", label) | F.array_contains("missing", name)), F.struct(F.lit(name.upper()).alias("k"), F.lit("on").alias("v"))) for name, label in names.items()]
    extra = [F.struct(F.lit("Set-Cookie").alias("k"), F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("=1; Secure, t=2; HttpOnly; SameSite=Lax; Secure")).alias("v")), F.struct(F.lit("Content-Encoding").alias("k"), F.when(F.col("status_code") == 200, " GZIP").otherwise("identity").alias("v"))]
    headers = F.map_from_entries(F.array_compact(F.array(*pairs, *extra)))
    a = pages.select("id", H.security_audit(headers).alias("a"))
    return a.select("id", "a.security_score", F.array_join("a.missing_headers", ",").alias("missing"), F.array_join("a.insecure_cookies", ",").alias("cookies"), "a.compression", "a.is_compressed")


def runtime_signals(spark, sf_dir):
    m = "metadata.runtime"
    pages = table(spark, sf_dir, "pages").where(f"{m} is not null")
    r = H.runtime_audit(F.col(f"{m}.response_time_ms").cast("double") / 7, F.lit(None).cast("double"), F.lit(None).cast("double"), F.col(f"{m}.dom_complete_ms"), F.array_repeat(F.lit("e"), F.coalesce(f"{m}.js_error_count", F.lit(0))))
    return pages.select("id", r.alias("r")).select("id", F.col("r.js_error_count").alias("errors"), F.size("r.js_errors_sample").alias("kept"), (F.col("r.response_time_ms") >= 100).alias("slow"), "r.dom_complete_ms")


def blocked_responses(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", F.col("id").alias("page_id"), "status_code")
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_html").join(pages, "page_id")
    rows = rows.withColumn("blocked", gates.is_blocked(F.col("status_code"), F.col("raw_html"), F.lit(True)))
    return rows.select("page_id", "blocked", gates.next_session(F.col("blocked"), F.lit("http")).alias("session"))


def contacts_extracted(spark, sf_dir):
    """The contacts in the text of all pages."""
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_markdown").where("raw_markdown is not null").select("page_id", C.contacts_in(F.col("raw_markdown")).alias("c"))
    return rows.select("page_id", F.array_join("c.emails", ",").alias("emails"), F.array_join("c.phones", ",").alias("phones"))


def document_contacts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", C.contacts_in(F.col("text")).alias("c"))
    return rows.select("doc_id", F.array_join("c.emails", ",").alias("emails"), F.array_join("c.phones", ",").alias("phones"))


def contacts_validated(spark, sf_dir):
    rows = table(spark, sf_dir, "page_contacts", "id", "value")
    return rows.select("id", C.validate_email(F.col("value")).alias("email"), C.validate_phone(F.col("value")).alias("phone"))


def page_text(spark, sf_dir):
    rows = reads.page_content(table(spark, sf_dir, "pages"), table(spark, sf_dir, "page_content"), F.lit("text"))
    return rows.select("page_id", "status", "body")


def payload_states(spark, sf_dir):
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_html", "raw_markdown")
    none = F.expr("cast(array() as array<struct<url:string,body:string>>)")
    e = P.page_extraction(F.lit(""), none, F.col("raw_html"), F.col("raw_markdown"))
    return rows.select("page_id", e.alias("e")).select("page_id", "e.hydration_state", F.array_join("e.extraction_methods", ",").alias("methods"))


def html_markdown(spark, sf_dir):
    """Every page's HTML as Markdown, by this engine's own converter."""
    bound_batches(spark)
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_html").where("length(raw_html) > 0")
    return rows.select("page_id", P.html_to_markdown(F.col("raw_html")).alias("markdown"))


def full_audits(spark, sf_dir):
    """Findings of the audit of every page's own HTML."""
    pages = table(spark, sf_dir, "pages").select(F.col("id").alias("page_id"), "crawl_id", "url", "canonical_url", "status_code", F.col("metadata.runtime").alias("runtime"))
    rows = table(spark, sf_dir, "page_content").where("length(raw_html) > 0").join(pages, "page_id")
    a = H.full_audit(F.col("raw_html"), F.lit(None).cast("map<string,string>"), F.col("canonical_url"), F.col("raw_markdown"), F.col("url"), F.col("runtime.response_time_ms").cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("runtime.dom_complete_ms").cast("double"), F.lit(None).cast("array<string>"))
    audited = rows.select("page_id", "crawl_id", "url", "status_code", a.alias("metadata"))
    return evaluate_findings(audited, "page_id").select("id", "severity")


def crawl_inspection(spark, sf_dir):
    return jobs.inspection(*(table(spark, sf_dir, t) for t in ("crawls", "pages", "page_contacts")))


def job_states(spark, sf_dir):
    """An export job for each crawl, started, ended and then cancelled."""
    crawls = table(spark, sf_dir, "crawls", "id", "pages_failed")
    queued = crawls.select("id", F.lit("queued").alias("status"))
    start = crawls.select("id", F.lit("processing").alias("wanted"), F.lit(1).alias("seq"))
    end = crawls.where("pages_failed < 4").select("id", jobs.final_status(F.col("pages_failed"), F.lit(False)).alias("wanted"), F.lit(2).alias("seq"))
    return jobs.cancel(jobs.advance(queued, start.unionByName(end)), crawls.where("pages_failed <> 1").select("id"))


QUERIES = {f.__name__: f for f in (
    crawl_list, crawl_counts, crawl_status, crawl_ids, path_tree, page_search, statistics, status_histogram, artifacts, page_metadata, contact_list, contact_sources, contact_counts,
    contact_rollup, scorecard, missing_headers, consolidation, seo_signals, security_signals, runtime_signals, blocked_responses, contacts_extracted, document_contacts, contacts_validated, page_text,
    payload_states, html_markdown, full_audits, crawl_inspection, job_states,
)}

_SCORE = """SELECT crawl_id, count(*) AS pages,
  CAST(trunc(count(*) FILTER (coalesce(metadata.seo.headings.h1_count, 0) >= 1) / count(*) * 100) AS INTEGER) AS h1_coverage_pct,
  CAST(trunc(count(*) FILTER (coalesce(metadata.seo.meta_description, '') <> '') / count(*) * 100) AS INTEGER) AS meta_description_coverage_pct,
  100 AS image_alt_coverage_pct, coalesce(CAST(trunc(sum(metadata.security.security_score) / nullif(count(metadata.security.security_score), 0)) AS INTEGER), 0) AS average_security_score
FROM pages GROUP BY crawl_id"""
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '{_SPACES}', ' ', 'g'))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _either(pattern: str) -> str:
    return f"(regexp_extract(h, '{_quoted(pattern)}', 1) || regexp_extract(h, '{_quoted(pattern)}', 2))"


_DECLARED = _sql("declared")
_SEO = f"""WITH x AS (SELECT c.page_id, c.raw_html AS h, CASE WHEN coalesce(c.raw_markdown, '') <> '' THEN c.raw_markdown ELSE c.raw_html END AS t, p.url, p.canonical_url FROM page_content c JOIN pages p ON p.id = c.page_id WHERE length(c.raw_html) > 0),
y AS (SELECT *, {_clean(f"regexp_extract(h, '{H.TITLE}', 1)")} AS title, {_clean(_either(H.DESCRIPTION))} AS descr, lower(trim({_either(H.ROBOTS)})) AS robots, trim({_either(H.CANONICAL)}) AS declared,
  list_filter(list_transform(regexp_extract_all(h, '{H.HEADING[1]}', 1), lambda v: {_clean('v')}), lambda v: v <> '') AS h1, len(regexp_extract_all(h, '{H.HEADING[2]}', 1)) AS h2, len(regexp_extract_all(h, '{H.HEADING[3]}', 1)) AS h3,
  regexp_extract_all(h, '{H.IMAGE}', 1) AS img, trim(regexp_replace(t, '{_SPACES}', ' ', 'g')) AS bare FROM x),
z AS (SELECT *, CASE WHEN bare = '' THEN 0 ELSE len(string_split(bare, ' ')) END AS words, len(list_filter(img, lambda v: trim(regexp_extract(v, '{_quoted(H.ALT)}', 1)) = '')) AS missing FROM y)
SELECT page_id, title, CAST(length(title) AS INTEGER) AS title_length, descr AS meta_description, NOT contains(robots, 'noindex') AS is_indexable, nullif(declared, '') AS declared_canonical,
  CASE WHEN declared = '' THEN 'missing' WHEN regexp_extract(declared, '^[^:/?#]+://([^/?#]*)', 1) <> '' AND regexp_extract(declared, '^[^:/?#]+://([^/?#]*)', 1) <> regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) THEN 'cross_domain' WHEN {_DECLARED['canonical']} = canonical_url THEN 'matches_url' ELSE 'mismatched_path' END AS canonical_status,
  CAST(len(h1) AS INTEGER) AS h1_count, CAST(h2 AS INTEGER) AS h2_count, CAST(h3 AS INTEGER) AS h3_count, len(h1) = 1 AND (h2 > 0 OR h3 = 0) AS heading_order_valid, array_to_string(h1, '|') AS h1_texts, CAST(len(img) AS INTEGER) AS total, CAST(missing AS INTEGER) AS missing_alt,
  CASE WHEN len(img) > 0 THEN CAST(trunc((len(img) - missing) / len(img) * 100) AS INTEGER) ELSE 100 END AS alt_coverage_pct, CAST(words AS INTEGER) AS word_count, CAST(length(t) AS INTEGER) AS character_count, round(strlen(t) / strlen(h) * 100, 2) AS code_to_text_ratio, words < 150 AS is_thin_content,
  CAST(len(regexp_extract_all(h, '{_quoted(H.JSON_LD)}', 1)) AS INTEGER) AS schema_types, CAST(0 AS INTEGER) AS hreflang FROM z"""
_EMAIL, _PHONE = C.EMAIL.replace("'", "''"), C.PHONE.replace("'", "''")


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _valid_email(x: str) -> str:
    clean = rf"lower(regexp_replace({_bare(x)}, '^[.,;:()<>\[\]\"'']+|[.,;:()<>\[\]\"'']+$', '', 'g'))"
    bad = ", ".join(f"'{e}'" for e in C.ASSET_ENDINGS)
    domains = ", ".join(f"'{d}'" for d in C.PLACEHOLDER_DOMAINS)
    local, domain = f"string_split({clean}, '@')[1]", f"regexp_extract({clean}, '^[^@]*@(.*)$', 1)"
    return f"(CASE WHEN length({clean}) BETWEEN 6 AND 254 AND contains({clean}, '@') AND length({local}) BETWEEN 1 AND 64 AND NOT starts_with({local}, '.') AND NOT ends_with({local}, '.') AND NOT contains({clean}, '..') AND string_split({domain}, '.')[-1] NOT IN ({bad}) AND {domain} NOT IN ({domains}) AND NOT regexp_matches({local}, '{C.UUID}') AND regexp_full_match({clean}, '{_EMAIL}') THEN {clean} END)"


def _valid_phone(x: str) -> str:
    raw = rf"regexp_replace({_bare(x)}, '^[.,;:<>\"''#*]+|[.,;:<>\"''#*]+$', '', 'g')"
    digits = rf"regexp_replace({raw}, '[^0-9]', '', 'g')"
    return rf"(CASE WHEN NOT regexp_matches({raw}, '^([0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}}|[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)$') AND NOT regexp_matches({raw}, '{C.ADDRESS}') AND length({digits}) BETWEEN 7 AND 15 AND length(replace({digits}, {digits}[1], '')) > 0 AND NOT contains('{C.RISING}', {digits}) AND NOT contains('{C.FALLING}', {digits}) AND regexp_matches({raw}, '^[+]|{_BLANK}|[().-]') AND NOT (length({digits}) IN (10, 13) AND regexp_matches({digits}, '^1[5-9]') AND NOT starts_with({raw}, '+')) THEN {_bare(rf"regexp_replace({raw}, '({_BLANK}|[.-])+', ' ', 'g')")} END)"


def _contacts_sql(relation: str, key: str, column: str) -> str:
    pick = lambda pattern, valid: f"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({column}, '{pattern}'), lambda x: {valid('x')}), lambda x: x IS NOT NULL))), ',')"
    return f"SELECT {key}, {pick(_EMAIL, _valid_email)} AS emails, {pick(_PHONE, _valid_phone)} AS phones FROM {relation} WHERE {column} IS NOT NULL"


def _uuid(name: str) -> str:
    digest = f"sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    part = lambda a, n: f"substr({digest}, {a}, {n})"
    variant = f"['8', '9', 'a', 'b'][(strpos('0123456789abcdef', {part(17, 1)}) - 1) % 4 + 1]"
    hashed = f"{part(1, 8)} || '-' || {part(9, 4)} || '-5' || {part(14, 3)} || '-' || {variant} || {part(18, 3)} || '-' || {part(21, 12)}"
    return f"CASE WHEN regexp_full_match(lower({name}), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') THEN lower({name}) ELSE {hashed} END"


_BODY = "lower(substr(coalesce(c.raw_html, ''), 1, 8192))"
_SIGNALS = " OR ".join(f"contains(b, '{x}')" for x in gates.BLOCK_SIGNALS)
ORACLE = {
    "crawl_inspection": "SELECT c.id, c.target_domain, c.status, (SELECT count(*) FROM pages p WHERE p.crawl_id = c.id) AS pages, (SELECT count(*) FROM page_contacts k JOIN pages p ON p.id = k.page_id WHERE p.crawl_id = c.id) AS contacts FROM (SELECT * FROM crawls ORDER BY started_at DESC NULLS LAST, id LIMIT 5) c",
    "job_states": "SELECT id, CASE WHEN pages_failed = 0 THEN 'completed' WHEN pages_failed < 4 THEN 'completed_with_errors' WHEN pages_failed <> 1 THEN 'cancelled' ELSE 'processing' END AS status FROM crawls",
    "seo_signals": _SEO,
    "crawl_list": FINDINGS_SQL + "SELECT c.id, c.target_domain, c.status, (SELECT count(*) FROM findings f WHERE f.crawl_id = c.id) AS findings_count FROM crawls c WHERE target_domain ILIKE '%o%-%' AND status = 'completed' ORDER BY started_at DESC NULLS FIRST, id DESC LIMIT 50",
    "crawl_counts": FINDINGS_SQL + "SELECT c.id, count(f.id) AS findings_count FROM crawls c LEFT JOIN findings f ON f.crawl_id = c.id GROUP BY c.id",
    "crawl_status": """WITH c AS (SELECT *, CASE WHEN json_extract(config, '$.consolidation') IS NOT NULL THEN 'finished' WHEN status = 'queued' AND pages_processed > 0 THEN 'running' ELSE status END AS now, coalesce(pages_processed, 0) AS done, coalesce(nullif(TRY_CAST(json_extract_string(config, '$.max_pages') AS INTEGER), 0), 15) AS most FROM crawls)
SELECT id, now AS status, CAST(CASE WHEN now IN ('finished', 'completed') THEN 1.0 WHEN now IN ('failed', 'cancelled') THEN CASE WHEN done > 0 THEN 1.0 ELSE 0.0 END WHEN now IN ('running', 'queued', 'paused', 'draining', 'consolidating') THEN CASE WHEN most > 0 THEN least(0.95, round(done / most, 2)) ELSE 0.5 END ELSE 0.0 END AS DOUBLE) AS progress,
  CASE WHEN now IN ('finished', 'completed') THEN 'retrieve' WHEN now IN ('running', 'queued', 'paused', 'draining', 'consolidating') THEN 'wait' ELSE 'none' END AS next_action FROM c""",
    "path_tree": "WITH c AS (SELECT crawl_id, path, count(*) AS pages FROM pages WHERE path IS NOT NULL GROUP BY ALL), n AS (SELECT *, CASE WHEN path = '/' THEN NULL WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS above FROM c) SELECT n.crawl_id, n.path, n.pages, CASE WHEN above IS NULL THEN NULL WHEN u.path IS NOT NULL THEN above ELSE '/' END AS parent, CAST(len(string_split(n.path, '/')) - 1 AS BIGINT) AS depth FROM n LEFT JOIN c u ON u.crawl_id = n.crawl_id AND u.path = n.above",
    "page_search": "SELECT id, url FROM pages WHERE url ILIKE '%museum%' OR canonical_url ILIKE '%museum%' OR summary ILIKE '%museum%' ORDER BY url, id LIMIT 100",
    "statistics": "SELECT crawl_id, count(*) AS pages, count(*) FILTER (status_code < 400) AS processed, count(*) FILTER (status_code >= 500) AS failed, count(*) FILTER (status_code BETWEEN 400 AND 499) AS excluded, count(*) FILTER (markdown_file_id IS NULL) AS pending FROM pages GROUP BY crawl_id",
    "status_histogram": "SELECT crawl_id, CAST(status_code AS VARCHAR) AS status, count(*) AS n FROM pages WHERE status_code IS NOT NULL GROUP BY ALL",
    "artifacts": "SELECT id AS page_id, 'markdown' AS kind, markdown_file_id AS file_id FROM pages WHERE coalesce(markdown_file_id, '') <> '' UNION ALL SELECT id, 'html', metadata.html_file_id FROM pages WHERE coalesce(metadata.html_file_id, '') <> ''",
    "page_metadata": "SELECT id, canonical_url, coalesce(markdown_file_id, '') <> '' AS has_markdown, coalesce(metadata.html_file_id, '') <> '' AS has_html, markdown_byte_size, markdown_token_count FROM pages",
    "contact_list": "SELECT c.id, c.value, p.url FROM page_contacts c JOIN pages p ON p.id = c.page_id WHERE c.kind = 'email' AND c.value ILIKE '%team%' ORDER BY c.value, c.id LIMIT 200",
    "contact_sources": "SELECT p.crawl_id, c.kind, c.value, count(DISTINCT c.page_id) AS sources FROM page_contacts c JOIN pages p ON p.id = c.page_id GROUP BY ALL",
    "contact_counts": "SELECT p.crawl_id, c.kind, count(*) AS n FROM page_contacts c JOIN pages p ON p.id = c.page_id GROUP BY ALL",
    "contact_rollup": "SELECT p.crawl_id, c.kind, c.value, count(*) AS occurrences FROM page_contacts c JOIN pages p ON p.id = c.page_id GROUP BY ALL",
    "scorecard": _SCORE,
    "missing_headers": "SELECT crawl_id, header, count(*) AS n FROM (SELECT crawl_id, unnest(metadata.security.missing_headers) AS header FROM pages) GROUP BY ALL",
    "consolidation": f"WITH s AS ({_SCORE}), r AS (SELECT p.crawl_id, c.kind, c.value FROM page_contacts c JOIN pages p ON p.id = c.page_id GROUP BY ALL) SELECT c.id AS crawl_id, coalesce(s.pages, 0) AS pages_processed, coalesce(h1_coverage_pct, 0) AS h1_coverage_pct, coalesce(meta_description_coverage_pct, 0) AS meta_description_coverage_pct, coalesce(image_alt_coverage_pct, 100) AS image_alt_coverage_pct, coalesce(average_security_score, 0) AS average_security_score, (SELECT count(*) FROM r WHERE r.crawl_id = c.id AND kind = 'email') AS unique_emails, (SELECT count(*) FROM r WHERE r.crawl_id = c.id AND kind = 'phone') AS unique_phones, (SELECT count(*) FROM page_links l WHERE l.crawl_id = c.id AND contains(l.to_url, '#')) AS anchor_links_evaluated, (SELECT count(*) FROM pages q WHERE q.crawl_id = c.id AND q.status_code >= 500) AS pages_failed, (SELECT count(*) FROM page_links l WHERE l.crawl_id = c.id AND NOT l.is_internal) AS telemetry_dropped FROM crawls c LEFT JOIN s ON s.crawl_id = c.id",
    "security_signals": """WITH p AS (SELECT id, status_code, metadata.security.missing_headers AS m FROM pages WHERE metadata.security.missing_headers IS NOT NULL), q AS (SELECT *, list_transform(list_filter([['HSTS', 'strict-transport-security'], ['CSP', 'content-security-policy'], ['X-Frame-Options', 'x-frame-options'], ['X-Content-Type-Options', 'x-content-type-options'], ['Referrer-Policy', 'referrer-policy'], ['Permissions-Policy', 'permissions-policy']], lambda x: list_contains(m, x[1]) OR list_contains(m, x[2])), lambda x: x[1]) AS miss FROM p)
SELECT id, CAST(trunc((6 - len(miss)) / 6 * 100) AS INTEGER) AS security_score, array_to_string(miss, ',') AS missing, 's' || id || ' (missing HttpOnly, missing SameSite)' AS cookies, CASE WHEN status_code = 200 THEN 'gzip' ELSE 'identity' END AS compression, coalesce(status_code = 200, false) AS is_compressed FROM q""",
    "runtime_signals": "SELECT id, coalesce(metadata.runtime.js_error_count, 0) AS errors, least(coalesce(metadata.runtime.js_error_count, 0), 5) AS kept, round(coalesce(CAST(metadata.runtime.response_time_ms AS DOUBLE), 0) / 7, 2) >= 100 AS slow, round(metadata.runtime.dom_complete_ms, 2) AS dom_complete_ms FROM pages WHERE metadata.runtime IS NOT NULL",
    "blocked_responses": f"""WITH x AS (SELECT c.page_id, p.status_code, {_BODY} AS b FROM page_content c JOIN pages p ON p.id = c.page_id), y AS (SELECT page_id, coalesce(status_code IN (403, 429, 503), false) OR {_SIGNALS} OR contains(b, '<div id="root"></div>') OR contains(b, '<div id="root"> </div>') OR (contains(b, '<div id="root">') AND NOT contains(b, '<a ')) OR contains(b, '<div id="app"></div>') OR contains(b, '<div id="__next"></div>') OR (length(b) < 5000 AND (contains(b, '<script') OR contains(b, '/assets/')) AND NOT contains(b, '<a ')) AS blocked FROM x) SELECT page_id, blocked, CASE WHEN blocked THEN 'stealth' ELSE 'http' END AS session FROM y""",
    "contacts_extracted": _contacts_sql("page_content", "page_id", "raw_markdown"),
    "page_text": r"""SELECT p.id AS page_id, CASE WHEN coalesce(p.markdown_file_id, '') <> '' AND c.raw_markdown IS NOT NULL THEN 'AVAILABLE' ELSE 'CONTENT_UNAVAILABLE' END AS status, CASE WHEN coalesce(p.markdown_file_id, '') <> '' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.raw_markdown, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '```[^\n]*\n?', '', 'g'), '[*_`>#-]', '', 'g') END AS body FROM pages p LEFT JOIN page_content c ON c.page_id = p.id""",
    "contacts_validated": f"SELECT id, {_valid_email('value')} AS email, {_valid_phone('value')} AS phone FROM page_contacts",
    "document_contacts": _contacts_sql("documents", "doc_id", "text"),
    "crawl_ids": f"SELECT id, {_uuid('id')} AS by_id, {_uuid('lower(target_domain)')} AS by_name FROM crawls",
    "payload_states": "SELECT page_id, CAST(NULL AS VARCHAR) AS hydration_state, CASE WHEN regexp_matches(coalesce(raw_markdown, ''), '\\S') THEN 'markitdown' ELSE 'none' END AS methods FROM page_content",
}
