"""Queries over tasks, messages, merges, events and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import payload as P
from tessera.operators import events, gates, merge, tasks
from tessera.plans.urls import _sql
from tessera.session import scratch
from tessera.sources.tables import table
from tessera.streaming import ingest


def _tasks(spark, sf_dir):
    """Messages as tasks, in order of delivery."""
    return table(spark, sf_dir, "result_messages").select(F.col("delivery_id").alias("seq"), "crawl_id", "url", "domain", "depth", "retry_count", F.lit("0").alias("throttle_count"))


def task_gates(spark, sf_dir):
    visited = table(spark, sf_dir, "pages", "crawl_id", "url", "status_code").where("status_code <> 200")
    return gates.gate_tasks(_tasks(spark, sf_dir), visited, limit=20, max_depth=3).select("seq", "outcome", "ticket")


def budget_tickets(spark, sf_dir):
    rows = gates.with_tickets(_tasks(spark, sf_dir).select("seq", "crawl_id", "retry_count"), gates.first_attempt(F.col("retry_count"), F.lit("0")), 50)
    return rows.select("seq", "ticket", (F.col("ticket") <= 50).alias("accepted"))


def domain_slots(spark, sf_dir):
    return tasks.domain_slots(_tasks(spark, sf_dir).where("domain is not null"), 5).select("seq", "granted", "throttle_count")


def retry_routes(spark, sf_dir):
    return tasks.after_failure(_tasks(spark, sf_dir)).select("seq", "route", "retry_count")


def reclaimed(spark, sf_dir):
    rows = table(spark, sf_dir, "result_messages").select("delivery_id", "retry_count", F.col("delivered_at").alias("last_seen"))
    now = F.lit("2026-03-31 12:00:00").cast("timestamp")
    return tasks.reclaim(rows, now).select("delivery_id", "route", "retry_count")


def dead_letters(spark, sf_dir):
    dead = tasks.dead_letter(tasks.after_failure(_tasks(spark, sf_dir)).where("route = 'dlq'").drop("route"), F.lit("MAX_RETRIES"), F.lit("now"))
    return tasks.failures(dead).withColumn("url", F.coalesce("url", F.lit("")))


def dlq_replay(spark, sf_dir):
    dead = tasks.dead_letter(tasks.after_failure(_tasks(spark, sf_dir)).where("route = 'dlq'").drop("route"), F.lit("MAX_RETRIES"), F.lit("now"))
    return tasks.replay(dead).select("seq", "crawl_id", "retry_count")


def crawl_completion(spark, sf_dir):
    state = F.when(F.col("retry_count").try_cast("int") > 2, "pending").otherwise("done")
    return tasks.completed(_tasks(spark, sf_dir).withColumn("state", state))


def busy_minutes(spark, sf_dir):
    rows = tasks.over_limit(table(spark, sf_dir, "result_messages"), "domain", "delivered_at", 1).where("domain is not null")
    return rows.select("domain", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "attempts")


def result_decoding(spark, sf_dir):
    rows = ingest.decoded_results(table(spark, sf_dir, "result_messages"))
    return rows.select("delivery_id", F.array_join("methods", ",").alias("methods"), F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "security_score", "response_time_ms")


def result_contacts(spark, sf_dir):
    return ingest.contact_rows(ingest.decoded_results(table(spark, sf_dir, "result_messages")))


def page_upsert(spark, sf_dir):
    """Pages of later crawls merged into a table by address: the first page's identity, the last one's content."""
    pages = table(spark, sf_dir, "pages").select(F.lit("all").alias("crawl_id"), "canonical_url", "id", "url", "path", "summary", "status_code", "markdown_file_id")
    old = merge.first(pages.where("id % 2 = 0"), ["canonical_url"], "id")
    new = pages.where("id % 2 = 1").withColumn("seq", F.col("id"))
    return merge.upsert_pages(old, new, "seq").select("canonical_url", "id", "url", "status_code", "markdown_file_id")


def inventory_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "page_links").select("crawl_id", F.col("canonical_to_url").alias("normalized_url"), F.col("to_url").alias("original_url"), F.when(F.col("id") % 7 == 0, "processed").otherwise("queued").alias("processing_status"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("page_id"), F.col("id").alias("seq"))
    empty = rows.limit(0).drop("seq")
    return merge.upsert_inventory(empty, rows, "seq")


def message_claims(spark, sf_dir):
    """The first delivery of each message, as a claim ledger gives it."""
    rows = table(spark, sf_dir, "result_messages", "stream_name", "message_id", "delivery_id").where("message_id is not null")
    return merge.first(rows, ["stream_name", "message_id"], "delivery_id")


def event_append(spark, sf_dir):
    rows = table(spark, sf_dir, "result_messages").select(F.col("delivery_id").alias("id"), F.when(F.col("message_id").isNotNull(), events.event_key(F.col("stream_name"), F.col("message_id"))).alias("dedupe_key"), "crawl_id")
    return merge.append_unless_known(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0"), "dedupe_key", "id").select("id", "dedupe_key")


def retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return merge.retain(rows, "ts", 7, now).select("event_id", "event_type")


def crawl_deletion(spark, sf_dir):
    gone = table(spark, sf_dir, "crawls", "id", "worker_count").where("worker_count = 4")
    return merge.delete_crawls(table(spark, sf_dir, "page_links", "id", "crawl_id"), gone)


def ensured_crawls(spark, sf_dir):
    known = table(spark, sf_dir, "crawls").where("worker_count = 2")
    return merge.ensure_crawls(known, table(spark, sf_dir, "pages", "crawl_id")).select("id", "status")


def payload_offload(spark, sf_dir):
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_html").where("raw_html is not null")
    kept = P.offloaded(F.to_json(F.struct(F.repeat("raw_html", 3).alias("html"))), F.concat(F.lit("hyd_"), F.col("page_id").cast("string")))
    return rows.select("page_id", F.get_json_object(kept, "$._appwrite_file_id").alias("file_id"))


def content_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "page_content", "page_id", "raw_markdown")
    return rows.select("page_id", P.byte_size(F.col("raw_markdown")).alias("bytes"), P.token_estimate(F.col("raw_markdown")).alias("tokens"))


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("crawl_id"), F.when(F.col("event_id") % 9 == 0, F.concat("event_type", F.lit(" !"))).otherwise(F.col("event_type")).alias("event_type"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))


def event_window(spark, sf_dir):
    return events.window(events.retained(_log(spark, sf_dir), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")))


def event_replay(spark, sf_dir):
    return events.replay(_log(spark, sf_dir), 500, "c3").select("id", "event_type")


def event_frames(spark, sf_dir):
    return events.frames(_log(spark, sf_dir))


def action_audit(spark, sf_dir):
    """Events as requests."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("actor"), F.when(F.col("event_id") % 3 == 0, "get").otherwise("patch").alias("method"), (F.lit(200) + F.col("event_id") % 5 * 100).cast("int").alias("response_status"),
        F.concat(F.lit("/api/crawls/"), F.col("user_id").cast("string"), F.lit("/findings/f"), F.col("event_id").cast("string")).alias("path"),
    )
    return events.action_audit(rows)


def event_reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))


def url_repeats(spark, sf_dir):
    """Repeated addresses among messages, numbered after the first; an address that most have isn't numbered by one task."""
    rows = table(spark, sf_dir, "result_messages", "url", "delivery_id").where("url is not null")
    return gates.with_tickets(rows, F.lit(True), 0, "url", "delivery_id").where("ticket > 1").select("delivery_id", F.col("ticket").cast("long").alias("n"))


def term_difference(spark, sf_dir):
    """Words of a page's title that its h1 lacks, sorted."""
    def terms(c):
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))

    pages = table(spark, sf_dir, "pages").select("id", terms(F.col("metadata.seo.title")).alias("a"), terms(F.array_join(F.coalesce("metadata.seo.headings.h1_texts", F.expr("cast(array() as array<string>)")), " ")).alias("b"))
    return pages.select("id", F.array_join(F.array_sort(F.array_except("a", "b")), " ").alias("terms"))


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "result_messages").schema
    return ingest.messages(spark, f"{sf_dir}/result_messages.parquet", schema)


def stream_dedup_counts(spark, sf_dir):
    """Messages through a stream that keeps one of each."""
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    kept = ingest.deduplicated(_stream(spark, sf_dir).where("message_id is not null").select("stream_name", "message_id", "crawl_id"), ["stream_name", "message_id"])
    ingest.append(kept, out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("crawl_id").agg(F.count("*").alias("messages"))


def stream_effects(spark, sf_dir):
    """Results through a stream into contacts and events, each batch's effects once."""
    out, state = scratch(spark, "effects"), scratch(spark, "state")

    def effects(batch):
        results = ingest.decoded_results(ingest.routed(batch)["results"])
        return {"contacts": ingest.contact_rows(results), "events": results.select("delivery_id", events.event_key(F.col("stream_name"), F.col("message_id")).alias("dedupe_key"))}

    ingest.run(_stream(spark, sf_dir), out, state, effects).awaitTermination()
    return spark.read.parquet(f"{out}/contacts").groupBy("kind", "value").agg(F.count("*").alias("n"))


def stream_budget(spark, sf_dir):
    """How many tickets a stream gives to each crawl."""
    out, state = scratch(spark, "tickets"), scratch(spark, "state")
    ingest.append(ingest.budget_tickets(_stream(spark, sf_dir).select("crawl_id", "message_id"), 30), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("crawl_id").agg(F.max("ticket").alias("tickets"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    task_gates, budget_tickets, domain_slots, retry_routes, reclaimed, dead_letters, dlq_replay, crawl_completion, busy_minutes, result_decoding, result_contacts, page_upsert, inventory_upsert,
    message_claims, event_append, retention, crawl_deletion, ensured_crawls, payload_offload, content_sizes, event_window, event_replay, event_frames, action_audit, event_reasons, url_repeats,
    term_difference, stream_dedup_counts, stream_effects, stream_budget,
)}

_RETRY = "coalesce(TRY_CAST(retry_count AS INTEGER), 0)"
_J = "CASE WHEN json_valid({c}) THEN {c} END"
_META, _CONT, _METH = (_J.format(c=c) for c in ("metadata", "contacts", "extraction_methods"))
_LIST = "coalesce(CAST(json_extract({j}, '$.{k}') AS VARCHAR[]), [])"
_DECODED = f"SELECT *, {_LIST.format(j=_CONT, k='emails')} AS emails, {_LIST.format(j=_CONT, k='phones')} AS phones FROM result_messages"
_CONTACTS = f"SELECT crawl_id, url, 'email' AS kind, unnest(emails) AS value FROM ({_DECODED}) UNION ALL SELECT crawl_id, url, 'phone', unnest(phones) FROM ({_DECODED})"
_LOG = "SELECT event_id AS id, 'c' || (user_id % 5) AS crawl_id, CASE WHEN event_id % 9 = 0 THEN event_type || ' !' ELSE event_type END AS event_type, props AS payload, ts AS created_at FROM events"
_FP = _sql("url")["canonical"]
ORACLE = {
    "task_gates": f"""WITH t AS (SELECT delivery_id AS seq, crawl_id, coalesce(url, '') AS url, coalesce(domain, '') AS domain, coalesce(TRY_CAST(depth AS INTEGER), 0) AS depth, {_RETRY} = 0 AS fresh, {_FP} AS address FROM result_messages),
v AS (SELECT DISTINCT crawl_id, {_FP} AS address FROM pages WHERE status_code <> 200),
e AS (SELECT t.*, CASE WHEN t.url = '' OR domain = '' THEN 'MALFORMED' WHEN v.address IS NOT NULL THEN 'VISITED' END AS early FROM t LEFT JOIN v ON v.crawl_id = t.crawl_id AND v.address = t.address),
h AS (SELECT *, min(seq) FILTER (early IS NULL) OVER (PARTITION BY crawl_id, address) AS head FROM e),
o AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN seq <> head THEN 'IN_FLIGHT' WHEN depth > 3 THEN 'MAX_DEPTH_REACHED' END AS outcome FROM h),
n AS (SELECT *, CASE WHEN outcome IS NULL AND fresh THEN sum((outcome IS NULL AND fresh)::INTEGER) OVER (PARTITION BY crawl_id ORDER BY seq) END AS c FROM o)
SELECT seq, coalesce(outcome, CASE WHEN c > 20 THEN 'BUDGET_EXHAUSTED' ELSE 'ACCEPTED' END) AS outcome, CAST(c AS BIGINT) AS ticket FROM n""",
    "payload_offload": "SELECT page_id, CASE WHEN strlen(json_object('html', repeat(raw_html, 3))::VARCHAR) > 16384 THEN 'hyd_' || page_id END AS file_id FROM page_content WHERE raw_html IS NOT NULL",
    "budget_tickets": f"WITH t AS (SELECT delivery_id AS seq, crawl_id, {_RETRY} = 0 AS pays FROM result_messages), n AS (SELECT *, sum(pays::INTEGER) OVER (PARTITION BY crawl_id ORDER BY seq) AS c FROM t) SELECT seq, CASE WHEN pays THEN CAST(c AS BIGINT) END AS ticket, CASE WHEN pays THEN c <= 50 END AS accepted FROM n",
    "domain_slots": "SELECT delivery_id AS seq, rn <= 5 AS granted, CASE WHEN rn <= 5 THEN 0 ELSE 1 END AS throttle_count FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY delivery_id) AS rn FROM result_messages WHERE domain IS NOT NULL)",
    "retry_routes": f"SELECT delivery_id AS seq, CASE WHEN {_RETRY} >= 3 THEN 'dlq' ELSE 'retry' END AS route, CASE WHEN {_RETRY} >= 3 THEN {_RETRY} ELSE {_RETRY} + 1 END AS retry_count FROM result_messages",
    "reclaimed": f"SELECT delivery_id, CASE WHEN {_RETRY} >= 3 THEN 'dlq' ELSE 'retry' END AS route, CASE WHEN {_RETRY} >= 3 THEN {_RETRY} ELSE {_RETRY} + 1 END AS retry_count FROM result_messages WHERE epoch_ms(TIMESTAMPTZ '2026-03-31 12:00:00+00') - epoch_ms(delivered_at) >= 300000",
    "dead_letters": f"SELECT coalesce(url, '') AS url, 'MAX_RETRIES' AS error, {_RETRY} AS retry_count, false AS retryable FROM result_messages WHERE {_RETRY} >= 3",
    "dlq_replay": f"SELECT delivery_id AS seq, crawl_id, 0 AS retry_count FROM result_messages WHERE {_RETRY} >= 3",
    "crawl_completion": f"SELECT crawl_id, count(*) FILTER ({_RETRY} > 2) = 0 AS complete FROM result_messages GROUP BY crawl_id",
    "busy_minutes": "SELECT domain, strftime(date_trunc('minute', delivered_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M') AS minute, count(*) AS attempts FROM result_messages WHERE domain IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "result_decoding": f"SELECT delivery_id, array_to_string(coalesce(CAST({_METH} AS VARCHAR[]), []), ',') AS methods, array_to_string(emails, ',') AS emails, array_to_string(phones, ',') AS phones, TRY_CAST(json_extract_string({_META}, '$.security.security_score') AS INTEGER) AS security_score, TRY_CAST(json_extract_string({_META}, '$.runtime.response_time_ms') AS DOUBLE) AS response_time_ms FROM ({_DECODED})",
    "result_contacts": f"SELECT crawl_id, url, kind, value FROM ({_CONTACTS})",
    "page_upsert": "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY id) AS rn FROM pages WHERE id % 2 = 0) WHERE rn = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY id DESC) AS rn FROM pages WHERE id % 2 = 1) WHERE rn = 1) SELECT coalesce(o.canonical_url, n.canonical_url) AS canonical_url, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.url ELSE o.url END AS url, CASE WHEN n.id IS NULL THEN o.status_code ELSE n.status_code END AS status_code, CASE WHEN n.id IS NULL THEN o.markdown_file_id ELSE n.markdown_file_id END AS markdown_file_id FROM o FULL OUTER JOIN n ON n.canonical_url = o.canonical_url",
    "inventory_upsert": "SELECT crawl_id, canonical_to_url AS normalized_url, arg_min(to_url, id) AS original_url, CASE WHEN bool_or(id % 7 = 0) THEN 'processed' ELSE 'queued' END AS processing_status, max(id) FILTER (id % 7 = 0) AS page_id FROM page_links GROUP BY crawl_id, canonical_to_url",
    "message_claims": "SELECT stream_name, message_id, min(delivery_id) AS delivery_id FROM result_messages WHERE message_id IS NOT NULL GROUP BY ALL",
    "event_append": "WITH r AS (SELECT delivery_id AS id, CASE WHEN message_id IS NOT NULL THEN 'redis:' || sha256(stream_name || ':' || message_id) END AS dedupe_key FROM result_messages), o AS (SELECT * FROM r WHERE id % 4 = 0), n AS (SELECT * FROM r WHERE id % 4 <> 0) SELECT id, dedupe_key FROM o UNION ALL SELECT id, dedupe_key FROM n WHERE dedupe_key IS NULL UNION ALL SELECT min(id), dedupe_key FROM n WHERE dedupe_key IS NOT NULL AND dedupe_key NOT IN (SELECT dedupe_key FROM o WHERE dedupe_key IS NOT NULL) GROUP BY dedupe_key",
    "retention": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00'",
    "crawl_deletion": "SELECT id, crawl_id FROM page_links WHERE crawl_id IS NULL OR crawl_id NOT IN (SELECT id FROM crawls WHERE worker_count = 4)",
    "ensured_crawls": "SELECT id, status FROM crawls WHERE worker_count = 2 UNION ALL SELECT DISTINCT crawl_id, 'running' FROM pages WHERE crawl_id IS NOT NULL AND crawl_id NOT IN (SELECT id FROM crawls WHERE worker_count = 2)",
    "content_sizes": "SELECT page_id, CAST(strlen(coalesce(raw_markdown, '')) AS INTEGER) AS bytes, CAST(length(coalesce(raw_markdown, '')) // 4 AS INTEGER) AS tokens FROM page_content",
    "event_window": f"SELECT min(id) AS earliest, max(id) AS latest FROM ({_LOG}) WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00'",
    "event_replay": f"SELECT id, event_type FROM ({_LOG}) WHERE id > 500 AND crawl_id = 'c3' ORDER BY id LIMIT 200",
    "event_frames": f"SELECT id, 'id: ' || id || chr(10) || 'event: ' || CASE WHEN regexp_matches(event_type, '{events.SAFE_NAME}') THEN event_type ELSE 'message' END || chr(10) || 'data: {{\"crawl_id\":\"' || crawl_id || '\",\"payload\":' || payload || '}}' || chr(10) || chr(10) AS frame FROM ({_LOG})",
    "action_audit": "SELECT CAST(user_id AS VARCHAR) AS actor, 'PATCH /api/crawls/' || user_id || '/findings/f' || event_id AS action, CAST(user_id AS VARCHAR) AS crawl_id, 'f' || event_id AS finding_id, CASE WHEN event_id % 5 < 2 THEN 'success' ELSE 'failure' END AS outcome, CAST(200 + event_id % 5 * 100 AS INTEGER) AS response_status FROM events WHERE event_id % 3 <> 0",
    "event_reasons": "SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY event_type",
    "url_repeats": "SELECT delivery_id, rn AS n FROM (SELECT delivery_id, row_number() OVER (PARTITION BY url ORDER BY delivery_id) AS rn FROM result_messages WHERE url IS NOT NULL) WHERE rn > 1",
    "term_difference": r"WITH t AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(metadata.seo.title, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(array_to_string(metadata.seo.headings.h1_texts, ' '), '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS b FROM pages) SELECT id, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ' ') AS terms FROM t",
    "stream_dedup_counts": "SELECT crawl_id, count(*) AS messages FROM (SELECT DISTINCT stream_name, message_id, crawl_id FROM result_messages WHERE message_id IS NOT NULL) GROUP BY crawl_id",
    "stream_effects": f"SELECT kind, value, count(*) AS n FROM ({_CONTACTS}) GROUP BY ALL",
    "stream_budget": "SELECT crawl_id, least(30, count(*)) AS tickets, least(30, count(*)) AS n FROM result_messages GROUP BY crawl_id",
}
