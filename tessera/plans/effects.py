"""Queries over effects of messages, control of crawls, reads of crawls and deliverables, and over inputs composed from the tables' columns.

The composed inputs stand for what the tables lack: HTML with linked data, alternate links, images, addresses and states of scripts, links between pages of one crawl, metadata of
images. Their SQL tells the result from the columns and never parses what was composed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contacts as C
from tessera.functions import html as H
from tessera.functions import payload as P
from tessera.functions.urls import host
from tessera.operators import effects, export, reads, rollup, selection, tasks
from tessera.operators.rules import evaluate_findings
from tessera.plans import urls as U
from tessera.plans.findings import _RULES, FINDINGS_SQL, findings
from tessera.plans.flows import _CONTACTS, _RETRY, _stream, _tasks
from tessera.plans.urls import _inventory, _sql
from tessera.session import scratch
from tessera.sources.tables import table
from tessera.streaming import ingest

# -- effects of messages --------------------------------------------------------------------------


def _drops(spark, sf_dir):
    """Links of the tables as messages about dropped links."""
    n = F.col("id") % 4
    return table(spark, sf_dir, "page_links").select(
        "crawl_id", F.lit("from").alias("source_url"), F.col("to_url").alias("target_url"), F.when(n > 0, F.concat(F.lit("GATE_"), n.cast("string"))).alias("drop_reason"), F.when(n == 3, "matched_exclude").otherwise("").alias("pattern_reason"),
        F.when(n >= 2, "excluded").alias("inventory_status"), F.when(n == 3, "exclude:1").alias("matched_rule_id"), F.col("id").alias("seq"),
    )


def telemetry_append(spark, sf_dir):
    return effects.dropped_links(_drops(spark, sf_dir)).groupBy("crawl_id", "drop_reason").agg(F.count("*").alias("n"), F.max("seq").alias("latest"))


def telemetry_inventory(spark, sf_dir):
    rows = effects.latest_inventory(effects.inventory_of_drops(_drops(spark, sf_dir)))
    return rows.select("crawl_id", "normalized_url", "original_url", "processing_status", "exclusion_reason", "matched_rule_id")


def _dead(spark, sf_dir):
    """Messages with three retries or more as dead letters."""
    rows = table(spark, sf_dir, "result_messages").where(F.coalesce(F.col("retry_count").try_cast("int"), F.lit(0)) >= 3)
    return rows.select(F.col("delivery_id").alias("seq"), "crawl_id", "url", "depth", F.when(F.col("delivery_id") % 2 == 0, "HTTP_ERROR").alias("dlq_reason"), F.col("delivered_at").alias("failed_at_utc"))


def dlq_rows(spark, sf_dir):
    rows = effects.dead_letter_rows(_dead(spark, sf_dir))
    return rows.select("seq", "crawl_id", "dlq_reason", F.get_json_object("task_fields", "$.url").alias("url"), F.get_json_object("task_fields", "$.depth").alias("depth"))


def dlq_inventory(spark, sf_dir):
    rows = effects.latest_inventory(effects.inventory_of_dead(_dead(spark, sf_dir)))
    return rows.select("crawl_id", "normalized_url", "processing_status", "exclusion_reason")


def dlq_counters(spark, sf_dir):
    return effects.count_failed(table(spark, sf_dir, "crawls"), _dead(spark, sf_dir)).select("id", "pages_failed")


def empty_fetches(spark, sf_dir):
    """Every fifth task gives no item."""
    fetched = _tasks(spark, sf_dir).select("seq", "crawl_id", "url")
    visited, dead = effects.after_fetch(fetched, fetched.where("seq % 5 <> 0").select("seq"), F.lit("now"))
    return visited.select("seq", F.lit("visited").alias("end")).unionByName(dead.select("seq", F.col("dlq_reason").alias("end")))


def _retried(spark, sf_dir):
    dead = tasks.dead_letter(_dead(spark, sf_dir).drop("dlq_reason", "failed_at_utc"), F.lit("MAX_RETRIES"), F.lit("now"))
    crawls = table(spark, sf_dir, "crawls", "id", "target_domain", "status", "pages_failed", "worker_count")
    return effects.retry_failed(crawls, dead, crawls.where("worker_count = 2"))


def retried_crawls(spark, sf_dir):
    return _retried(spark, sf_dir)[0].select("id", "status", "pages_failed")


def retried_tasks(spark, sf_dir):
    return _retried(spark, sf_dir)[1].select("seq", "url", "domain", "retry_count")


def letters_left(spark, sf_dir):
    return _retried(spark, sf_dir)[2].select("seq", "crawl_id")


def controlled_crawls(spark, sf_dir):
    """Every crawl queued again and paused; some resumed, some cancelled, twice."""
    crawls = table(spark, sf_dir, "crawls", "id", "status", "worker_count", "pages_failed").withColumn("status", F.when(F.col("pages_failed") > 1, "queued").otherwise(F.col("status")))
    ask = lambda rows, action, seq: rows.select("id", F.lit(action).alias("action"), F.lit(seq).alias("seq"))
    asked = ask(crawls, "pause", 1).unionByName(ask(crawls.where("worker_count = 2"), "resume", 2)).unionByName(ask(crawls.where("pages_failed = 4"), "cancel", 3)).unionByName(ask(crawls, "resume", 4).where("id < '8'"))
    return effects.control(crawls, asked).select("id", "status")


def drained_crawls(spark, sf_dir):
    crawls = table(spark, sf_dir, "crawls").withColumn("status", F.lit("running"))
    left = _tasks(spark, sf_dir).where("retry_count = '3'").select("crawl_id")
    return effects.drained(crawls, left, left.limit(0)).select("id", "target_domain")


def recent_dead_letters(spark, sf_dir):
    return reads.recent_dead_letters(_dead(spark, sf_dir).withColumn("id", F.col("seq")), 5)


def stream_discovery(spark, sf_dir):
    """How many different addresses a stream discovers for each crawl."""
    out, state = scratch(spark, "discovered"), scratch(spark, "state")
    ingest.append(ingest.discovered(_stream(spark, sf_dir).select("crawl_id", "url")), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("crawl_id").agg(F.count("*").alias("discovered"))


def stream_consolidation(spark, sf_dir):
    """Contacts through a stream, consolidated once it has drained."""
    out, state, report = scratch(spark, "effects"), scratch(spark, "state"), scratch(spark, "report")
    take = lambda batch: {"contacts": ingest.contact_rows(ingest.decoded_results(ingest.routed(batch)["results"]))}
    count = lambda: spark.read.parquet(f"{out}/contacts").groupBy("crawl_id", "kind").agg(F.count("*").alias("occurrences"), F.countDistinct("value").alias("contacts"))
    return ingest.consolidated_when_drained(_stream(spark, sf_dir), out, state, take, count, report)


def stream_range(spark, sf_dir):
    rows = export.range_scan(table(spark, sf_dir, "result_messages", "message_id", "delivery_id"), "1767800000000-0", 300)
    return rows.select("_message_id", "delivery_id").groupBy("_message_id").agg(F.count("*").alias("n"))


# -- reads ----------------------------------------------------------------------------------------


def active_crawl(spark, sf_dir):
    return reads.active_crawl(table(spark, sf_dir, "crawls"))


def crawl_page(spark, sf_dir):
    rows = reads.crawl_list(table(spark, sf_dir, "crawls"), findings(spark, sf_dir), status="completed")
    return rows.select("id", "target_domain", "findings_count").orderBy(*reads.newest_first("started_at")).offset(5).limit(10)


def crawl_total(spark, sf_dir):
    return reads.crawl_total(table(spark, sf_dir, "crawls"), " O", " Completed")


def inventory_statistics(spark, sf_dir):
    return reads.inventory_statistics(_inventory(spark, sf_dir, own=False))


def inventory_types(spark, sf_dir):
    """Content types that the ends of paths stand for."""
    rows = _inventory(spark, sf_dir, own=False).withColumn("content_type", F.when(F.col("id") % 5 == 0, "").when(F.col("normalized_path").contains("-"), "text/html").when(F.col("id") % 3 > 0, "text/plain"))
    return reads.content_types(rows)


def grouped_contacts(spark, sf_dir):
    rows = reads.grouped_contacts(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"), 2, 100, "email", "a")
    return rows.select("value", F.array_join(F.transform("source_pages", lambda x: x.cast("string")), ",").alias("source_pages"))


def contacts_with_address(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "id", F.when(F.col("id") % 3 > 0, F.col("canonical_url")).alias("canonical_url"))
    return reads.contacts_with_address(table(spark, sf_dir, "page_contacts"), pages.where("id % 7 > 0"))


def deliverable(spark, sf_dir):
    rows = reads.deliverable(table(spark, sf_dir, "crawls"), table(spark, sf_dir, "pages"), findings(spark, sf_dir), table(spark, sf_dir, "page_contacts"))
    get = lambda path: F.get_json_object("item", path)
    return rows.select("crawl_id", "part", "key", get("$.started_at").alias("started_at"), get("$.metrics.total_findings").alias("findings"), get("$.metrics.total_contacts").alias("contacts"), F.coalesce(get("$.url"), get("$.value"), get("$.target_url")).alias("what"))


def page_forms(spark, sf_dir):
    """Each page's content in one of three forms."""
    form = F.when(F.col("page_id") % 3 == 0, "markdown").when(F.col("page_id") % 3 == 1, "html").otherwise("text")
    rows = reads.page_content(table(spark, sf_dir, "pages"), table(spark, sf_dir, "page_content"), form)
    return rows.select("page_id", "form", "status", F.md5("body").alias("body"))


def preview_log(spark, sf_dir):
    """A preview of each crawl's selection; some fail, some are cancelled."""
    return _log(spark, sf_dir).select("preview_id", "seq", "event_type", *[F.get_json_object("payload", f"$.{k}").alias(k) for k in ("decision", "matched_pattern", "scope_decision", "total_candidates", "included", "message")])


def _log(spark, sf_dir):
    error = F.when(F.col("crawl_id") < "4", F.lit("lost"))
    return selection.preview_log(U._selected(spark, sf_dir), F.col("crawl_id"), error, F.col("crawl_id") > "c")


def preview_replay(spark, sf_dir):
    """The events of the last crawl's preview after its start."""
    last = table(spark, sf_dir, "page_links", "crawl_id").agg(F.max("crawl_id")).first()[0] or ""
    return selection.preview_replay(_log(spark, sf_dir), last, -1).select("seq", "event_type")


def published_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", F.col("id").alias("page_id"), "url", F.when(F.col("id") % 2 == 0, F.to_json("metadata")).alias("metadata"))
    rows = table(spark, sf_dir, "page_content", "page_id", F.when(F.col("page_id") % 3 == 0, F.lit(" \n")).when(F.col("page_id") % 3 == 1, F.col("raw_markdown")).alias("text")).join(pages, "page_id")
    none = F.expr("cast(array() as array<string>)")
    kept = rows.where(P.is_published(none, F.lit(None).cast("string"), F.col("text"), F.col("metadata")))
    return kept.select("page_id", F.md5(P.published_markdown(F.col("url"), F.col("text"))).alias("text"))


# -- composed inputs -------------------------------------------------------------------------------

_SITE = "'harbour' || CAST(id % 7 AS STRING) || '-school.org'"
_MARKUP = f"""'<html><head><title>T</title>'
 || CASE WHEN id % 3 >= 1 THEN '<link rel="alternate" hreflang="en" href="/en/' || CAST(id AS STRING) || '">' ELSE '' END || CASE WHEN id % 3 = 2 THEN '<link rel=''alternate'' hreflang=''de'' href=''/de''>' ELSE '' END
 || '<script type="application/ld+json">' || CASE id % 5 WHEN 0 THEN '{{"@type": broken' WHEN 1 THEN '{{"@type":"Article","n":1}}' WHEN 2 THEN '[{{"@type":"A"}},{{"@type":"B"}},{{"x":1}}]' ELSE '{{"@graph":[{{"@type":"Person"}},{{"@type":"Person"}},{{"@type":"Org"}}]}}' END || '</script></head><body><h1>x</h1>'
 || repeat('<img src="a.png" alt="seen">', CAST(id % 4 AS INT)) || repeat('<img src="b.png" alt=" "><img src="c.png">', CAST(id % 3 AS INT))
 || CASE id % 3 WHEN 0 THEN '<a class="m" href="mailto:Team' || CAST(id AS STRING) || '@' || {_SITE} || '?subject=x">m</a>' WHEN 1 THEN '<a href="tel:+49 30-1234' || CAST(1000 + id % 9000 AS STRING) || '">t</a>' ELSE '<a href="mailto:nobody">n</a>' END || '<a href="/p">p</a></body></html>'"""
_STATES = """'<html><body><p>x</p>' || CASE id % 4 WHEN 0 THEN '<script id="__NEXT_DATA__" type="application/json">{"a":' || CAST(id AS STRING) || ',"b":[1]}</script>' WHEN 1 THEN '<script>window.__NUXT__ = {"n":' || CAST(id AS STRING) || '};</script>'
 WHEN 2 THEN '<script>window.__INITIAL_STATE__ = {broken};</script>' ELSE '' END || '</body></html>'"""


def _markup(spark, sf_dir):
    return table(spark, sf_dir, "pages", "id", "crawl_id", "url", "canonical_url").withColumn("html", F.expr(_MARKUP))


def markup_signals(spark, sf_dir):
    """Alternate links, linked data and images of composed pages, by value."""
    seo = H.seo_audit(F.col("html"), F.expr("cast(map() as map<string,string>)"), F.col("canonical_url"), F.lit("text"), F.col("url"))
    rows = _markup(spark, sf_dir).select("id", seo.alias("s"))
    links = F.array_join(F.transform("s.hreflang", lambda p: F.concat(p["lang"], F.lit("="), p["href"])), ",")
    return rows.select("id", links.alias("hreflang"), F.array_join("s.schema_types", ",").alias("schema_types"), F.size("s.json_ld_schemas").alias("entities"), F.col("s.images.total").alias("images"), "s.images.missing_alt", "s.images.alt_coverage_pct")


def markup_contacts(spark, sf_dir):
    """Contacts in the links of composed pages."""
    rows = _markup(spark, sf_dir).select("id", F.explode(H.anchor_hrefs(F.col("html"))).alias("href")).select("id", C.contact_of_href(F.col("href")).alias("c"))
    return rows.where("c is not null").select("id", "c.kind", "c.value")


def merged_contacts(spark, sf_dir):
    """Addresses of links and of text, each once."""
    pages = _markup(spark, sf_dir)
    linked = F.array_compact(F.transform(H.anchor_hrefs(F.col("html")), lambda h: C.contact_of_href(h)["value"]))
    text = F.expr(f"array('team' || CAST(id AS STRING) || '@' || {_SITE}, 'office@' || {_SITE})")
    return pages.select("id", F.array_join(C.merged(linked, text), ",").alias("values"))


def script_states(spark, sf_dir):
    """States of scripts and captured responses of composed pages, and the methods that they make."""
    body = "CASE WHEN id % 2 = 0 THEN '{\"a\":1,\"b\":2}' ELSE '{\"a\":1}' END"
    captured = F.expr(f"array(struct('https://api.x.org/v1' AS url, {body} AS body), struct('https://www.google-analytics.com/c' AS url, '{{\"a\":1,\"b\":2}}' AS body), struct('https://api.x.org/l' AS url, '[1,2]' AS body))")
    rows = table(spark, sf_dir, "pages", "id", "url").withColumn("html", F.expr(_STATES))
    e = P.page_extraction(F.col("url"), captured, F.col("html"), F.when(F.col("id") % 3 == 0, F.lit("text")).otherwise(F.lit(" \n")))
    rows = rows.select("id", e.alias("e"))
    state = F.coalesce(F.get_json_object("e.hydration_state", "$.a"), F.get_json_object("e.hydration_state", "$.n"))
    return rows.select("id", state.alias("state"), F.size("e.xhr_payloads").alias("xhr"), F.array_join("e.extraction_methods", ",").alias("methods"))


def _audited(spark, sf_dir):
    """Pages whose metadata has what the tables lack."""
    n = F.col("id")
    seo = F.struct(
        F.lit("t").alias("title"), F.lit("d").alias("meta_description"), F.lit("matches_url").alias("canonical_status"), F.struct((n % 4).cast("int").alias("h1_count"), F.array(F.lit("one"), F.lit("two")).alias("h1_texts")).alias("headings"),
        F.struct((n % 5).cast("int").alias("total"), (n % 3).cast("int").alias("missing_alt")).alias("images"), F.struct(F.lit(500).alias("word_count")).alias("content"),
        F.when(n % 2 == 0, F.array(F.lit("{}"))).alias("json_ld_schemas"), F.when(n % 2 == 0, F.array(F.lit("Article"), F.concat(F.lit("T"), (n % 3).cast("string")))).alias("schema_types"),
    )
    labels = F.when(n % 6 == 0, F.array(F.lit("HSTS"), F.lit("Referrer-Policy"))).when(n % 6 == 1, F.array(F.lit("Content-Security-Policy"), F.lit("x-frame-options"))).otherwise(F.array(F.lit("permissions-policy")))
    return table(spark, sf_dir, "pages", "id", "crawl_id", "url", "status_code").withColumn("metadata", F.struct(seo.alias("seo"), F.struct(labels.alias("missing_headers"), F.lit(80).alias("security_score")).alias("security")))


def audited_findings(spark, sf_dir):
    rows = evaluate_findings(_audited(spark, sf_dir)).where(~F.col("rule_id").isin("structure.broken_link"))
    return rows.select("id", "severity", "explanation")


def image_coverage(spark, sf_dir):
    return rollup.scorecard(_audited(spark, sf_dir)).select("crawl_id", "pages", "image_alt_coverage_pct")


def schema_histogram(spark, sf_dir):
    return rollup.schema_types(_audited(spark, sf_dir))


def _within(spark, sf_dir):
    """The links of the tables, pointed at the first or the last page of their crawl."""
    ends = table(spark, sf_dir, "pages", "id", "crawl_id", "canonical_url").groupBy("crawl_id").agg(F.min_by("canonical_url", "id").alias("a"), F.max_by("canonical_url", "id").alias("b"))
    links = table(spark, sf_dir, "page_links", "id", "crawl_id", "from_page_id").join(ends, "crawl_id")
    return links.withColumn("canonical_to_url", F.when(F.col("id") % 3 == 0, F.col("a")).otherwise(F.col("b")))


def edges_within(spark, sf_dir):
    return reads.graph_edges(_within(spark, sf_dir), table(spark, sf_dir, "pages"))


def edges_within_limited(spark, sf_dir):
    return reads.graph_edges(_within(spark, sf_dir), table(spark, sf_dir, "pages"), most_pages=10)


def incoming_within(spark, sf_dir):
    return reads.incoming_links(_within(spark, sf_dir), table(spark, sf_dir, "pages"))


def graph_nodes(spark, sf_dir):
    return reads.graph_nodes(table(spark, sf_dir, "pages"), findings(spark, sf_dir))


def graph_nodes_limited(spark, sf_dir):
    return reads.graph_nodes(table(spark, sf_dir, "pages"), findings(spark, sf_dir), 3)


def link_hosts(spark, sf_dir):
    """Links of a crawl by the host that they lead to."""
    return table(spark, sf_dir, "page_links", "crawl_id", "to_url").groupBy("crawl_id", host(F.col("to_url")).alias("host")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    telemetry_append, telemetry_inventory, dlq_rows, dlq_inventory, dlq_counters, empty_fetches, retried_crawls, retried_tasks, letters_left, controlled_crawls, drained_crawls, recent_dead_letters, stream_discovery,
    stream_consolidation, stream_range, active_crawl, crawl_page, crawl_total, inventory_statistics, inventory_types, grouped_contacts, contacts_with_address, deliverable, page_forms, preview_log, preview_replay, published_results,
    markup_signals, markup_contacts, merged_contacts, script_states, audited_findings, image_coverage, schema_histogram, edges_within, edges_within_limited, incoming_within, graph_nodes, graph_nodes_limited, link_hosts,
)}

_T, _U = _sql("to_url"), _sql("url")
_DEAD = f"SELECT delivery_id AS seq, crawl_id, url, depth, CASE WHEN delivery_id % 2 = 0 THEN 'HTTP_ERROR' END AS dlq_reason, delivered_at FROM result_messages WHERE {_RETRY} >= 3"
_ISO = "strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c} AT TIME ZONE 'UTC', '.%f') END || '+00:00'"
_LOG = U._SELECTED + """,
j AS (SELECT crawl_id AS preview_id, count(*) AS total, count(*) FILTER (decision = 'included') AS included, CASE WHEN crawl_id < '4' THEN 'failed' WHEN crawl_id > 'c' THEN 'cancelled' ELSE 'completed' END AS ended FROM d GROUP BY crawl_id),
log AS (SELECT preview_id, -1::BIGINT AS seq, 'preview.started' AS event_type, NULL AS decision, NULL AS matched_pattern, NULL AS scope_decision, total::VARCHAR AS total_candidates, NULL AS included, NULL AS message FROM j
UNION ALL SELECT crawl_id, id, 'url.evaluated', decision, CASE reason WHEN 'matched_include' THEN 'include:' || substr(sha256('include:0:/**'), 1, 16) WHEN 'matched_exclude' THEN 'exclude:' || CASE WHEN regexp_matches(normalized_path, '(?i)^(/[^/]+)*/[^/]*login[^/]*/?$') AND NOT regexp_matches(normalized_path, '(?i)^/our-[^/]*/?$') THEN substr(sha256('exclude:0:/**/*login*'), 1, 16) ELSE substr(sha256('exclude:1:/our-*'), 1, 16) END END, 'in_scope', NULL, NULL, NULL FROM d
UNION ALL SELECT preview_id, 9223372036854775807, 'preview.' || ended, NULL, NULL, NULL, CASE WHEN ended = 'completed' THEN total::VARCHAR END, CASE WHEN ended = 'completed' THEN included::VARCHAR END, CASE WHEN ended = 'failed' THEN 'lost' END FROM j)
"""
_LINKS_WITHIN = "(SELECT l.id, l.crawl_id, l.from_page_id, CASE WHEN l.id % 3 = 0 THEN e.a ELSE e.b END AS canonical_to_url FROM page_links l JOIN (SELECT crawl_id, arg_min(canonical_url, id) AS a, arg_max(canonical_url, id) AS b FROM pages GROUP BY crawl_id) e USING (crawl_id))"
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(c.raw_markdown, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '```[^\n]*\n?', '', 'g'), '[*_`>#-]', '', 'g')"


def _found(rule: str, severity: str, text: str, where: str) -> str:
    return f"SELECT id || ':{rule}' AS id, '{severity}' AS severity, {text} AS explanation FROM pages WHERE {where}"


_TEXTS = {rule: (severity, text) for rule, _, severity, _, _, text, *_ in _RULES}
_AUDITED = " UNION ALL ".join(
    [
        _found("seo.missing_h1", "critical", _TEXTS["seo.missing_h1"][1], "id % 4 = 0"),
        _found("seo.multiple_h1", "warning", "'Multiple <h1> elements found (' || id % 4 || '). Only one H1 per page is recommended.'", "id % 4 > 1"),
        _found("seo.images_missing_alt", "info", "id % 3 || ' image(s) are missing alt text, harming accessibility and image SEO.'", "id % 3 > 0"),
        _found("seo.missing_schema_org", "info", _TEXTS["seo.missing_schema_org"][1], "id % 2 = 1"),
        *[_found(rule, *_TEXTS[rule], where) for rule, where in (("security.missing_hsts", "id % 6 = 0"), ("security.missing_referrer_policy", "id % 6 = 0"), ("security.missing_csp", "id % 6 = 1"), ("security.missing_x_frame", "id % 6 = 1"))],
    ]
)
_MAIL = "'team' || id || '@harbour' || id % 7 || '-school.org'"
_METHODS = "CASE WHEN id % 2 = 0 THEN ['xhr'] ELSE [] END || CASE WHEN id % 4 < 2 THEN ['hydration'] ELSE [] END || CASE WHEN id % 3 = 0 THEN ['markitdown'] ELSE [] END"
ORACLE = {
    "telemetry_append": "SELECT crawl_id, CASE WHEN id % 4 = 0 THEN 'UNKNOWN' ELSE 'GATE_' || id % 4 END AS drop_reason, count(*) AS n, max(id) AS latest FROM page_links GROUP BY ALL",
    "telemetry_inventory": f"WITH x AS (SELECT crawl_id, id, to_url, {_T['canonical']} AS normalized_url FROM page_links WHERE id % 4 >= 2), y AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, normalized_url ORDER BY id DESC) AS rn FROM x) SELECT crawl_id, normalized_url, to_url AS original_url, 'excluded' AS processing_status, CASE WHEN id % 4 = 3 THEN 'matched_exclude' ELSE 'GATE_2' END AS exclusion_reason, CASE WHEN id % 4 = 3 THEN 'exclude:1' END AS matched_rule_id FROM y WHERE rn = 1",
    "dlq_rows": f"SELECT seq, crawl_id, coalesce(dlq_reason, 'unknown_error') AS dlq_reason, url, depth FROM ({_DEAD})",
    "dlq_inventory": f"WITH x AS (SELECT *, {_U['canonical']} AS normalized_url FROM ({_DEAD}) WHERE url <> ''), y AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, normalized_url ORDER BY seq DESC) AS rn FROM x) SELECT crawl_id, normalized_url, 'failed' AS processing_status, coalesce(dlq_reason, 'failed') AS exclusion_reason FROM y WHERE rn = 1",
    "dlq_counters": f"SELECT id, CAST(coalesce(pages_failed, 0) + (SELECT count(*) FROM ({_DEAD}) d WHERE d.crawl_id = c.id) AS INTEGER) AS pages_failed FROM crawls c",
    "empty_fetches": "SELECT delivery_id AS seq, CASE WHEN delivery_id % 5 = 0 THEN 'spider_yielded_zero_items_or_blocked' ELSE 'visited' END AS \"end\" FROM result_messages",
    "retried_crawls": f"WITH n AS (SELECT c.*, (SELECT count(*) FROM ({_DEAD}) d WHERE d.crawl_id = c.id) AS n FROM crawls c) SELECT id, CASE WHEN worker_count = 2 AND n > 0 AND status IN ('completed', 'cancelled') THEN 'running' ELSE status END AS status, CASE WHEN worker_count = 2 AND n > 0 THEN CAST(greatest(0, pages_failed - n) AS INTEGER) ELSE pages_failed END AS pages_failed FROM n",
    "retried_tasks": f"SELECT seq, url, target_domain AS domain, '0' AS retry_count FROM ({_DEAD}) d JOIN crawls c ON c.id = d.crawl_id WHERE worker_count = 2",
    "letters_left": f"SELECT seq, crawl_id FROM ({_DEAD}) d WHERE NOT EXISTS (SELECT 1 FROM crawls c WHERE c.id = d.crawl_id AND worker_count = 2)",
    "controlled_crawls": """WITH a AS (SELECT id, worker_count, pages_failed, CASE WHEN pages_failed > 1 THEN 'queued' ELSE status END AS s FROM crawls), b AS (SELECT *, CASE WHEN s IN ('running', 'queued') THEN 'paused' ELSE s END AS s1 FROM a),
c AS (SELECT *, CASE WHEN worker_count = 2 AND s1 = 'paused' THEN 'running' ELSE s1 END AS s2 FROM b), d AS (SELECT *, CASE WHEN pages_failed = 4 AND s2 NOT IN ('completed', 'cancelled', 'finished') THEN 'cancelled' ELSE s2 END AS s3 FROM c) SELECT id, CASE WHEN id < '8' AND s3 = 'paused' THEN 'running' ELSE s3 END AS status FROM d""",
    "drained_crawls": "SELECT id, target_domain FROM crawls WHERE id NOT IN (SELECT crawl_id FROM result_messages WHERE retry_count = '3' AND crawl_id IS NOT NULL)",
    "recent_dead_letters": f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY delivered_at DESC NULLS LAST, seq DESC) AS rn, count(*) OVER (PARTITION BY crawl_id) AS total FROM ({_DEAD})) SELECT crawl_id, seq AS id, url, dlq_reason, {_ISO.format(c='delivered_at')} AS failed_at_utc, total FROM d WHERE rn <= 5",
    "stream_discovery": f"SELECT crawl_id, count(DISTINCT {_U['canonical']}) AS discovered FROM result_messages WHERE url IS NOT NULL GROUP BY crawl_id",
    "stream_consolidation": f"SELECT crawl_id, kind, count(*) AS occurrences, count(DISTINCT value) AS contacts FROM ({_CONTACTS}) GROUP BY ALL",
    "stream_range": "WITH m AS (SELECT message_id, split_part(message_id, '-', 1)::BIGINT AS t, split_part(message_id, '-', 2)::BIGINT AS s FROM result_messages WHERE message_id IS NOT NULL), r AS (SELECT message_id FROM m WHERE t > 1767800000000 OR (t = 1767800000000 AND s > 0) ORDER BY t, s, message_id LIMIT 300) SELECT message_id AS _message_id, count(*) AS n FROM r GROUP BY message_id",
    "active_crawl": "SELECT lower(target_domain) AS domain, id, status FROM (SELECT *, row_number() OVER (PARTITION BY lower(target_domain) ORDER BY started_at DESC NULLS LAST, id DESC) AS rn FROM crawls WHERE status IN ('queued', 'running', 'paused')) WHERE rn = 1",
    "crawl_page": FINDINGS_SQL + "SELECT c.id, c.target_domain, (SELECT count(*) FROM findings f WHERE f.crawl_id = c.id) AS findings_count FROM crawls c WHERE status = 'completed' ORDER BY started_at DESC NULLS FIRST, id DESC LIMIT 10 OFFSET 5",
    "crawl_total": "SELECT count(*) AS total FROM crawls WHERE target_domain ILIKE '%o%' AND status = 'completed'",
    "inventory_statistics": U._ALL_INVENTORY + "SELECT crawl_id, count(*) AS discovered, count(*) FILTER (processing_status = 'processed') AS processed, 0::BIGINT AS failed, count(*) FILTER (processing_status = 'excluded') AS excluded, count(*) FILTER (processing_status = 'queued') AS pending FROM inv GROUP BY crawl_id",
    "inventory_types": U._ALL_INVENTORY + "SELECT crawl_id, content_type, count(*) AS n FROM (SELECT crawl_id, CASE WHEN id % 5 = 0 THEN NULL WHEN contains(normalized_path, '-') THEN 'text/html' WHEN id % 3 > 0 THEN 'text/plain' END AS content_type FROM inv) WHERE content_type IS NOT NULL GROUP BY ALL",
    "grouped_contacts": "SELECT value, string_agg(page_id::VARCHAR, ',' ORDER BY id) AS source_pages FROM (SELECT c.* FROM page_contacts c JOIN pages p ON p.id = c.page_id WHERE kind = 'email' AND value ILIKE '%a%' ORDER BY value, c.id LIMIT 100 OFFSET 100) GROUP BY value",
    "contacts_with_address": "SELECT c.id, c.kind, c.value, CASE WHEN p.id % 3 > 0 THEN coalesce(p.canonical_url, '') ELSE '' END AS url FROM page_contacts c JOIN pages p ON p.id = c.page_id WHERE p.id % 7 > 0",
    "deliverable": FINDINGS_SQL + f"""SELECT c.id AS crawl_id, 0 AS part, '' AS key, {_ISO.format(c='started_at')} AS started_at, CAST((SELECT count(*) FROM findings f WHERE f.crawl_id = c.id) AS VARCHAR) AS findings, CAST((SELECT count(*) FROM page_contacts k JOIN pages p ON p.id = k.page_id WHERE p.crawl_id = c.id) AS VARCHAR) AS contacts, target_url AS what FROM crawls c
UNION ALL SELECT crawl_id, 1, severity || ' ' || id, NULL, NULL, NULL, url FROM findings WHERE crawl_id IN (SELECT id FROM crawls)
UNION ALL SELECT crawl_id, 2, lpad(id::VARCHAR, 20, '0'), NULL, NULL, NULL, url FROM pages WHERE crawl_id IN (SELECT id FROM crawls)
UNION ALL SELECT p.crawl_id, 3, lpad(k.id::VARCHAR, 20, '0'), NULL, NULL, NULL, k.value FROM page_contacts k JOIN pages p ON p.id = k.page_id WHERE p.crawl_id IN (SELECT id FROM crawls)""",
    "page_forms": f"WITH x AS (SELECT p.id AS page_id, CASE p.id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' ELSE 'text' END AS form, CASE p.id % 3 WHEN 0 THEN c.raw_markdown WHEN 1 THEN c.raw_html ELSE {_PLAIN} END AS body, CASE WHEN p.id % 3 = 1 THEN p.metadata.html_file_id ELSE p.markdown_file_id END AS file FROM pages p LEFT JOIN page_content c ON c.page_id = p.id) SELECT page_id, form, CASE WHEN coalesce(file, '') <> '' AND body IS NOT NULL THEN 'AVAILABLE' ELSE 'CONTENT_UNAVAILABLE' END AS status, CASE WHEN coalesce(file, '') <> '' THEN md5(body) END AS body FROM x",
    "preview_log": _LOG + "SELECT * FROM log",
    "preview_replay": _LOG + "SELECT seq, event_type FROM log WHERE preview_id = (SELECT max(crawl_id) FROM page_links) AND seq > -1",
    "published_results": "SELECT p.id AS page_id, md5(CASE WHEN p.id % 3 = 1 AND regexp_matches(coalesce(c.raw_markdown, ''), '\\S') THEN c.raw_markdown ELSE '# ' || p.url || chr(10) || chr(10) || '*Client-rendered page or empty DOM body.*' END) AS text FROM pages p JOIN page_content c ON c.page_id = p.id WHERE (p.id % 3 = 1 AND regexp_matches(coalesce(c.raw_markdown, ''), '\\S')) OR (p.id % 2 = 0 AND p.metadata IS NOT NULL)",
    "markup_signals": "SELECT id, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'en=/en/' || id ELSE 'en=/en/' || id || ',de=/de' END AS hreflang, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Article' WHEN 2 THEN 'A,B' ELSE 'Person,Org' END AS schema_types, CAST(CASE id % 5 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS entities, CAST(id % 4 + 2 * (id % 3) AS INTEGER) AS images, CAST(2 * (id % 3) AS INTEGER) AS missing_alt, CAST(CASE WHEN id % 4 + id % 3 = 0 THEN 100 ELSE trunc((id % 4) / (id % 4 + 2 * (id % 3)) * 100) END AS INTEGER) AS alt_coverage_pct FROM pages",
    "markup_contacts": f"SELECT id, CASE WHEN id % 3 = 0 THEN 'email' ELSE 'phone' END AS kind, CASE WHEN id % 3 = 0 THEN {_MAIL} ELSE '+49 30 1234' || (1000 + id % 9000) END AS value FROM pages WHERE id % 3 < 2",
    "merged_contacts": f"SELECT id, array_to_string(list_sort(list_distinct([{_MAIL}, 'office@harbour' || id % 7 || '-school.org'] || CASE WHEN id % 3 = 1 THEN ['+49 30 1234' || (1000 + id % 9000)] ELSE [] END)), ',') AS \"values\" FROM pages",
    "script_states": f"SELECT id, CASE WHEN id % 4 < 2 THEN id::VARCHAR END AS state, CAST(CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS xhr, CASE WHEN len({_METHODS}) = 0 THEN 'none' ELSE array_to_string({_METHODS}, ',') END AS methods FROM pages",
    "audited_findings": _AUDITED,
    "image_coverage": "SELECT crawl_id, count(*) AS pages, CAST(CASE WHEN sum(id % 5) > 0 THEN trunc((sum(id % 5) - sum(id % 3)) / sum(id % 5) * 100) ELSE 100 END AS INTEGER) AS image_alt_coverage_pct FROM pages GROUP BY crawl_id",
    "schema_histogram": "SELECT crawl_id, schema_type, count(*) AS n FROM (SELECT crawl_id, unnest(['Article', 'T' || id % 3]) AS schema_type FROM pages WHERE id % 2 = 0) GROUP BY ALL",
    "edges_within": U._EDGES.format(nodes="pages").replace("page_links", _LINKS_WITHIN),
    "edges_within_limited": U._EDGES.format(nodes="(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY id) AS rn FROM pages) WHERE rn <= 10)").replace("page_links", _LINKS_WITHIN),
    "incoming_within": f"SELECT p.id AS page_id, count(*) AS incoming FROM pages p JOIN {_LINKS_WITHIN} l ON l.crawl_id = p.crawl_id AND l.canonical_to_url = p.canonical_url GROUP BY p.id",
    "graph_nodes": FINDINGS_SQL + "SELECT crawl_id, id, canonical_url AS url, metadata.seo.title AS title, status_code, (SELECT count(*) FROM findings f WHERE f.page_id = p.id) AS findings_count FROM pages p",
    "graph_nodes_limited": FINDINGS_SQL + "SELECT crawl_id, id, canonical_url AS url, metadata.seo.title AS title, status_code, (SELECT count(*) FROM findings f WHERE f.page_id = p.id) AS findings_count FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY id) AS rn FROM pages) p WHERE rn <= 3",
    "link_hosts": f"SELECT crawl_id, {_T['host']} AS host, count(*) AS n FROM page_links GROUP BY ALL",
}
