"""URL, contact, HTML and payload functions, rules, patterns, merges, gates and tasks on small fixtures."""

import uuid
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tessera.functions import contacts, html, patterns, payload, urls
from tessera.operators import effects, events, export, gates, jobs, joins, merge, reads, rollup, rules, selection, tasks


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(use(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Example.COM/courses/?tag=python#intro", "https://example.com/courses?tag=python"), ("http://EX.com:80", "http://ex.com/"), ("http://ex.com:8080/a//", "http://ex.com:8080/a"),
        ("https://u:p@ex.com/A/b/;x=1?y=1&y=2", "https://ex.com/A/b?y=1&y=2"), ("https://ex.com?", "https://ex.com/"), ("https://ex.com:443/x", "https://ex.com/x"), ("http://ex.com:443/x", "http://ex.com:443/x"),
        ("http://ex.com:port/x", None), (None, None), ("  https://ex.com/a\n", "https://ex.com/a"), ("/a/b/", "/a/b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonicalize_url) == want


HREFS = ["", "x", "./x", "../x", "../../../x", "/x/../y", "?q=1", "#f", "//h/p", "http://o/p", "a/b/./c/..", "mailto:a@b", "x?y#z", "/"]


def test_urljoin_is_pythons(spark):
    base = "https://h.example/a/b/c.html?k=v"
    df = spark.createDataFrame([(h,) for h in HREFS], "h string").select("h", urls.urljoin(F.lit(base), F.col("h")).alias("u"))
    assert {r.h: r.u for r in df.collect()} == {h: urljoin(base, h) for h in HREFS}


def test_query_map_keeps_the_last_value(spark):
    assert one(spark, "http://a/?x=1&y=&x=2&z&w=a+b%21", urls.query_map) == {"x": "2", "y": "", "z": "", "w": "a b!"}


def test_crawl_uuid(spark):
    some = str(uuid.uuid4())
    for name in ("setia-01", "x.example", "ünïcode"):
        assert one(spark, name, urls.crawl_uuid) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, some.upper(), urls.crawl_uuid) == some


def test_paths(spark):
    assert [one(spark, p, urls.path_parent) for p in ("/", "/a", "/a/b")] == [None, "/", "/a"]
    assert [one(spark, p, urls.normalized_path) for p in ("", "a/", "/a//", "/")] == ["/", "/a", "/a", "/"]


GOOD_MAIL = ["john.doe@example.co.uk", "support_team+123@sub.domain.org"]
BAD_MAIL = ["logo@2x.png", "icon@3x.jpg", "font@v1.woff2", "123e4567-e89b-12d3-a456-426614174000@domain.com", "test@example.com", "user@yourdomain.com", "admin@localhost", "not-an-email", "@domain.com", "user@.com", ".user@domain.com", "user..name@domain.com"]
GOOD_PHONE = ["+65 6016 8637", "+1 (555) 123-4567", "+44 20 7946 0958", "(555) 123-4567", "020 7946 0958"]
BAD_PHONE = ["2026-08-29", "29/08/2026", "12:30:45", "192.168.1.1", "127.0.0.1", "00000000", "111111111", "123456789", "049145", "90210", "12345"]


def test_contact_validation(spark):
    mails = spark.createDataFrame([(m,) for m in GOOD_MAIL + BAD_MAIL], "x string").select("x", contacts.validate_email(F.col("x")).alias("y")).collect()
    assert {r.x for r in mails if r.y} == set(GOOD_MAIL)
    phones = spark.createDataFrame([(m,) for m in GOOD_PHONE + BAD_PHONE], "x string").select("x", contacts.validate_phone(F.col("x")).alias("y")).collect()
    assert {r.x for r in phones if r.y} == set(GOOD_PHONE)


def test_contacts_in_text(spark):
    got = one(spark, "Write to a.b@site.co or A.B@site.co, call +65 6016 8637; not 2026-08-29 nor 192.168.0.1 or 049145.", contacts.contacts_in)
    assert got.emails == ["a.b@site.co"] and len(got.phones) == 1 and "6016 8637" in got.phones[0]
    empty = one(spark, None, contacts.contacts_in)
    assert empty.emails == [] and empty.phones == []
    assert one(spark, "mailto:jo@site.co?subject=x", contacts.contact_of_href).value == "jo@site.co"
    assert one(spark, "tel:+65%206016%208637", contacts.contact_of_href).kind == "phone"


PAGE = """<html><head><title> A  <b>title</b></title><meta content='Say' name="description"><meta name="robots" content="NoIndex">
<link rel="canonical" href="https://h.example/p/"><link rel="alternate" hreflang="de" href="/de"><link hreflang='fr' href='/fr' rel='alternate'>
<script type="application/ld+json">{"@type": "Person", "@graph": [{"@type": "Org"}, {"x": 1}]}</script><script type="application/ld+json">[{"@type": "A"}, {"b": 2}]</script><script type="application/ld+json">{bad</script></head>
<body><h1></h1><h1>One</h1><h2>x</h2><img src=a alt="ok"><img src=b alt=""><img src=c alt=un><img src=d data-alt="y"></body></html>"""


def test_seo_audit(spark):
    row = spark.createDataFrame([(PAGE, "w1 w2\xa0w3")], "h string, m string")
    s = row.select(html.seo_audit(F.col("h"), F.create_map(F.lit("X-Robots-Tag"), F.lit("index")), F.lit("https://h.example/p"), F.col("m"), F.lit("https://h.example/p?x")).alias("s")).first().s
    assert (s.title, s.meta_description, s.meta_robots, s.is_indexable, s.robots_conflict) == ("A title", "Say", "noindex", False, True)
    assert s.canonical_status == "matches_url" and [(x.lang, x.href) for x in s.hreflang] == [("de", "/de"), ("fr", "/fr")]
    assert s.schema_types == ["Person", "Org", "A"] and len(s.json_ld_schemas) == 2
    assert (s.headings.h1_count, s.headings.h1_texts, s.headings.h2_count, s.headings.heading_order_valid) == (1, ["One"], 1, True)
    assert (s.images.total, s.images.missing_alt, s.images.alt_coverage_pct) == (4, 2, 50) and s.content.word_count == 3
    assert one(spark, "", lambda c: html.seo_audit(c, F.lit(None).cast("map<string,string>"), c, c, c)) is None


@pytest.mark.parametrize("declared,want", [("", "missing"), ("https://o.example/p", "cross_domain"), ("https://h.example/p/", "matches_url"), ("/p", "mismatched_path")])
def test_canonical_status(spark, declared, want):
    assert one(spark, declared, lambda c: html.canonical_status(c, F.lit("https://h.example/p"), F.lit("https://h.example/p"))) == want


def test_security_audit(spark):
    headers = {"STRICT-transport-security": "x", "content-security-policy": "", "Set-Cookie": "a=1; Secure, b=2; HttpOnly; SameSite=Lax; Secure", "Content-Encoding": " BR "}
    a = one(spark, headers, html.security_audit, "map<string,string>")
    assert a.security_score == 16 and "HSTS" not in a.missing_headers and "CSP" in a.missing_headers and a.present_headers == {"HSTS": "x"}
    assert a.insecure_cookies == ["a (missing HttpOnly, missing SameSite)"] and a.compression == "br" and a.is_compressed
    nothing = one(spark, None, html.security_audit, "map<string,string>")
    assert nothing.security_score == 0 and nothing.compression == "none"


def test_markdown(spark):
    text = payload.to_markdown("<body><h1>T</h1><p>a <a href='/x'>b</a></p><ul><li>one</li><li>two</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script></body>")
    assert text == "# T\n\na [b](/x)\n\n* one\n* two\n\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    assert payload.to_markdown("") is None and payload.to_markdown(None) is None
    assert one(spark, "![i](u) [a](b) *c* - `d`\n```py\ncode\n```\n# h", html.markdown_to_text) == " a c  d\ncode\n h"


def test_payloads(spark):
    rows = [[("https://x.example/api", '{"a": 1, "b": 2}'), ("https://www.google-analytics.com/c", '{"a": 1, "b": 2}'), ("https://x.example/ok", '{"ok": true}'), ("https://x.example/l", "[1, 2]"), ("https://x.example/bad", "{")]]
    xhr = one(spark, rows[0], payload.accepted_xhr, "array<struct<url:string,body:string>>")
    assert xhr == ['{"a": 1, "b": 2}']
    assert one(spark, '<script id="__NEXT_DATA__" type="x">{bad}</script><script>window.__NUXT__={"k":1};</script>', payload.hydration_state) == '{"k":1}'
    assert one(spark, "<p>none</p>", payload.hydration_state) is None
    assert one(spark, "x" * 16_384, lambda c: payload.offloaded(c, F.lit("f"))) == "x" * 16_384
    assert "offloaded" in one(spark, "x" * 16_385, lambda c: payload.offloaded(c, F.lit("f")))


def decide(spark, path, include=(), exclude=(), types=()):
    origin = "https://h.example"
    inc, exc = patterns.compile_rules(list(include), "include", origin), patterns.compile_rules(list(exclude), "exclude", origin)
    d = one(spark, origin + path, lambda c: patterns.evaluate_url(c, origin, inc, exc, types))
    return d.decision, d.reason


def test_url_rules(spark):
    both = dict(include=["/courses/**"], exclude=["/courses/private/**"])
    assert decide(spark, "/courses/python", **both) == ("included", "matched_include")
    assert decide(spark, "/courses/private/secret", **both) == ("excluded", "matched_exclude")
    assert decide(spark, "/courses", **both) == ("included", "matched_include")
    assert decide(spark, "/blog/team/author", include=["/blog/*/author"]) == ("included", "matched_include")
    assert decide(spark, "/blog/team/platform/author", include=["/blog/*/author"]) == ("excluded", "include_no_match")
    assert decide(spark, "/public", exclude=["/private/**"]) == ("included", "no_rule_match")
    assert decide(spark, "/assets/site.css", types=("stylesheet",)) == ("excluded", "excluded_resource_type:stylesheet")
    assert decide(spark, "/x") == ("included", "no_rules")
    assert decide(spark, "/x", include=["/x"], exclude=["/X"]) == ("excluded", "matched_exclude")
    assert decide(spark, "/a/b", include=["https://h.example/a/*"], exclude=["/a/b"])[0] == "included"  # an absolute pattern has more literal segments
    other = one(spark, "https://o.example/x", lambda c: patterns.evaluate_url(c, "https://h.example", [], []))
    assert other.reason == "outside_origin"


@pytest.mark.parametrize("pattern", ["", "courses", "/courses?draft=true", "/courses/[draft]", "/courses/***", "https://foreign.example/x", "https://[invalid/courses", "/" + "x" * 512, "/a*b*c*"])
def test_invalid_patterns(pattern):
    assert patterns.pattern_problem(pattern, "https://h.example")
    assert patterns.pattern_issues([pattern], "f", "https://h.example")[0]["code"] == "INVALID_URL_PATTERN"
    with pytest.raises(ValueError):
        patterns.compile_rules([pattern], "include", "https://h.example")


def test_too_many_patterns():
    assert patterns.pattern_issues(["/a"] * 101, "f")[0]["code"] == "TOO_MANY_PATTERNS"


META = "struct<seo:struct<title:string,meta_description:string,canonical_status:string,headings:struct<h1_count:int,h1_texts:array<string>>,images:struct<missing_alt:int>,content:struct<word_count:int>,json_ld_schemas:array<string>>,security:struct<missing_headers:array<string>>,runtime:struct<response_time_ms:double,dom_complete_ms:double>>"


def audit(spark, status=200, h1=1, title="T", desc="D", canonical="matches_url", words=500, alt=0, ld=("x",), headers=(), ms=200.0, dom=None, meta=True):
    m = (((title, desc, canonical, (h1, ["a"] * h1), (alt,), (words,), list(ld))), (list(headers),), (ms, dom)) if meta else None
    df = spark.createDataFrame([(456, "c", "https://h/p", status, m)], f"id long, crawl_id string, url string, status_code int, metadata {META}")
    return [r.rule_id for r in rules.evaluate_findings(df).collect()]


def test_rules(spark):
    assert audit(spark) == []
    assert audit(spark, h1=0) == ["seo.missing_h1"] and audit(spark, h1=2) == ["seo.multiple_h1"]
    assert audit(spark, title="") == ["seo.missing_title"] and audit(spark, desc=None) == ["seo.missing_meta_description"]
    assert audit(spark, canonical="missing") == ["seo.missing_canonical"] and audit(spark, canonical=None) == ["seo.missing_canonical"]
    assert audit(spark, words=299) == ["seo.thin_content"] and audit(spark, words=300) == []
    assert audit(spark, words=10, status=404) == ["structure.broken_link"] and audit(spark, status=410) == ["structure.broken_link"]
    assert audit(spark, alt=1) == ["seo.images_missing_alt"] and audit(spark, ld=()) == ["seo.missing_schema_org"]
    assert audit(spark, headers=["HSTS", "CSP", "X-Frame-Options", "X-Content-Type-Options", "Referrer-Policy", "Permissions-Policy"]) == ["security.missing_hsts", "security.missing_csp", "security.missing_x_frame", "security.missing_x_content_type", "security.missing_referrer_policy"]
    assert audit(spark, ms=800.0) == [] and audit(spark, ms=801.0) == ["performance.slow_response"]
    assert audit(spark, dom=3000.0) == [] and audit(spark, dom=3001.0) == ["performance.slow_load"]
    assert audit(spark, meta=False) == ["seo.missing_h1", "seo.missing_title", "seo.missing_meta_description", "seo.missing_canonical", "seo.thin_content", "seo.missing_schema_org"]
    assert audit(spark, status=None, words=10) == []


def test_metadata_under_audit(spark):
    df = spark.createDataFrame([(1, "c", "u", 200)], "id long, crawl_id string, url string, status_code int").withColumn("metadata", F.struct(F.struct(F.struct(F.lit("T").alias("title")).alias("seo")).alias("audit")))
    assert "seo.missing_title" not in [r.rule_id for r in rules.evaluate_findings(df).collect()]


def test_scorecard(spark):
    meta = "struct<seo:struct<meta_description:string,headings:struct<h1_count:int>,images:struct<total:int,missing_alt:int>>,security:struct<security_score:int>>"
    rows = [("c", (("d", (1,), (4, 1)), (80,))), ("c", (("d", (2,), (2, 0)), (100,))), ("d", None)]
    got = {r.crawl_id: r for r in rollup.scorecard(spark.createDataFrame(rows, f"crawl_id string, metadata {meta}")).collect()}
    assert (got["c"].h1_coverage_pct, got["c"].meta_description_coverage_pct, got["c"].image_alt_coverage_pct, got["c"].average_security_score) == (100, 100, 83, 90)
    assert (got["d"].h1_coverage_pct, got["d"].image_alt_coverage_pct, got["d"].average_security_score) == (0, 100, 0)


def test_merges(make):
    old = make([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k long, v string, keep string")
    new = make([(1, "c", "q", 1), (1, None, "r", 2), (3, "d", "s", 1), (None, "m", "t", 1)], "k long, v string, keep string, seq long")
    got = {r.k: (r.v, r.keep) for r in merge.upsert(old, new, ["k"], ["v"], "seq").collect()}
    assert got == {1: (None, "x"), 2: ("b", "y"), 3: ("d", "s"), None: ("m", "z")}
    got = {r.k: r.v for r in merge.insert_ignore(old, new, ["k"], "seq").collect()}
    assert got == {1: "a", 2: "b", 3: "d", None: "n"}
    log = make([(1, "e"), (2, None)], "id long, dedupe_key string")
    more = make([(3, "e"), (4, None), (5, "f"), (6, "f")], "id long, dedupe_key string")
    assert sorted(r.id for r in merge.append_unless_known(log, more, "dedupe_key", "id").collect()) == [1, 2, 4, 5]
    assert merge.latest(make([], "k long, seq long"), ["k"], "seq").count() == 0


def test_inventory_keeps_progress(make):
    cols = "crawl_id string, normalized_url string, original_url string, processing_status string, page_id long"
    old = make([("c", "u", "U", "processed", 5)], cols)
    new = make([("c", "u", "V", "queued", None, 9)], cols + ", seq long")
    kept = merge.upsert_inventory(old, new, "seq").first()
    assert (kept.original_url, kept.processing_status, kept.page_id) == ("U", "processed", 5)
    plain = merge.upsert_inventory(old, new, "seq", keep_progress=False).first()
    assert (plain.original_url, plain.processing_status, plain.page_id) == ("U", "queued", None)


def test_deletion_and_retention(make):
    child = make([(1, "a"), (2, "b"), (3, None)], "id long, crawl_id string")
    assert sorted(r.id for r in merge.delete_crawls(child, make([("a",)], "id string")).collect()) == [2, 3]
    rows = make([(1, "2024-01-01"), (2, "2023-12-31"), (3, None)], "id long, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.id for r in merge.retain(rows, "t", 30, F.lit("2024-01-31").cast("timestamp")).collect()] == [1]


def test_link_gates(make, spark):
    hrefs = ["/a", "/a", "mailto:jo@site.co", "ftp://h.example/x", "https://o.example/", "https://sub.h.example/x", "/blogger", "/a#f", "/known", "/new"]
    page = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    links = gates.numbered_links(make([(1, "https://h.example/", page), (2, "https://h.example/2", '<a href=/new>y</a>')], "page_id long, url string, html string"))
    got = gates.gate_links(links, F.lit("H.example:8080"), known=make([("https://h.example/known",)], "canonical_url string"))
    reasons = {(r.page_id, r.at): r.reason for r in got.collect()}
    assert [reasons[1, k] for k in range(10)] == ["URL_DISCOVERED", "PAGE_DUPLICATE", "CONTACT", "INVALID_SCHEME", "OFFSITE_DOMAIN", "URL_DISCOVERED", "DENY_PATTERN", "DUPLICATE", "DUPLICATE", "URL_DISCOVERED"]
    assert reasons[2, 0] == "DUPLICATE"


def test_numbered_links_are_page_links_and_mark_repeats(make):
    html = '<a href="/b">1</a><a href="/a">2</a><a href=b>3</a><a href="/a#x">4</a><a href="">5</a><a href="/a">6</a>'
    pages = make([(1, "https://h.example/", html), (2, None, html), (3, "https://h.example/", None), (4, "https://h.example/", "<p>none</p>")], "page_id long, url string, html string")
    plain = sorted(tuple(str(x) for x in r) for r in gates.page_links(pages).select("page_id", "at", "href", "url").collect())
    got = gates.numbered_links(pages)
    assert sorted(tuple(str(x) for x in r) for r in got.select("page_id", "at", "href", "url").collect()) == plain
    assert sorted((r.at, r.again) for r in got.where("page_id = 1").collect()) == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, True)]


def test_a_hot_address_does_not_multiply_its_links(make, spark):
    links = spark.range(0, 3000).selectExpr("id as page_id", "0 as at", "'/menu' as href", "'https://h.example/menu' as url", "false as again")
    got = gates.gate_links(links, F.lit("h.example")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"URL_DISCOVERED": 1, "DUPLICATE": 2999}


@pytest.mark.parametrize("status,body,primary,want", [(403, "", True, True), (200, "Just a MOMENT", False, True), (200, '<div id="root"></div>', True, True), (200, '<div id="root"></div>', False, False), (200, "<p>" + "x" * 6000 + "</p>", True, False), (None, None, True, False)])
def test_blocked(spark, status, body, primary, want):
    df = spark.createDataFrame([(status, body)], "s int, b string")
    assert df.select(gates.is_blocked(F.col("s"), F.col("b"), F.lit(primary)).alias("x")).first().x is want


def test_task_gates(make):
    rows = [(1, "c", "https://a/1", "a", "0", "0", "0"), (2, "c", "https://a/1/", "a", "0", "0", "0"), (3, "c", None, "a", "0", "0", "0"), (4, "c", "https://a/2", "", "0", "0", "0"), (5, "c", "https://a/3", "a", "9", "0", "0"), (6, "c", "https://a/4", "a", "0", "0", "0"), (7, "c", "https://a/5", "a", "0", "1", "0"), (8, "c", "https://a/6", "a", "0", "0", "0"), (9, "d", "https://a/1", "a", "0", "0", "0")]
    df = make(rows, "seq long, crawl_id string, url string, domain string, depth string, retry_count string, throttle_count string")
    got = {r.seq: (r.outcome, r.ticket) for r in gates.gate_tasks(df, make([("c", "https://a/4")], "crawl_id string, url string"), limit=1).collect()}
    assert got == {1: ("ACCEPTED", 1), 2: ("IN_FLIGHT", None), 3: ("MALFORMED", None), 4: ("MALFORMED", None), 5: ("MAX_DEPTH_REACHED", None), 6: ("VISITED", None), 7: ("ACCEPTED", None), 8: ("BUDGET_EXHAUSTED", 2), 9: ("ACCEPTED", 1)}


def test_retry_and_reclaim(make):
    rows = make([(1, "0", "2024-01-01 00:00:00"), (2, "3", "2024-01-01 00:00:00"), (3, "0", "2024-01-01 00:05:00"), (4, "x", "2024-01-01 00:00:00")], "id long, retry_count string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    got = {r.id: (r.route, r.retry_count) for r in tasks.reclaim(rows, F.lit("2024-01-01 00:05:00").cast("timestamp")).collect()}
    assert got == {1: ("retry", 1), 2: ("dlq", 3), 4: ("retry", 1)}
    dead = tasks.dead_letter(rows, F.lit("why"), F.lit("t"))
    assert {r.retry_count for r in tasks.replay(dead).collect()} == {0}


def test_event_cursor():
    start = events.Start.of
    assert start(None, 10, 12) == events.Start(12, 12, False) and start(4, 10, 12) == events.Start(12, None, True) and start(10, 10, 12) == events.Start(10, None, False)
    assert start(None, None, None).after == 0 and start(0, 10, 12).resync is False
    assert "resync_required" in start(4, 10, 12).frame() and start(10, 10, 12).frame() is None
    for bad in ("x", "-1"):
        with pytest.raises(ValueError):
            events.parse_cursor(bad)
    with pytest.raises(ValueError):
        start(13, 10, 12)


def test_selection(make):
    inv = "id long, crawl_id string, normalized_url string, origin string, normalized_path string, page_id long, processing_status string, exclusion_reason string, matched_rule_id string"
    o = "https://h.example"
    rows = [(1, "c", f"{o}/a", o, "/a", 7, "excluded", None, None), (2, "c", f"{o}/a/b", o, "/a/b", None, "failed", None, None), (3, "c", f"{o}/ab", o, "/ab", None, "queued", None, None), (4, "c", "https://x/a", "https://x", "/a", None, "queued", None, None)]
    pages = make([(7, "m", ("h",))], "id long, markdown_file_id string, metadata struct<html_file_id:string>")
    got = {r.id: (r.decision, r.reason, r.content_status) for r in selection.select_inventory(make(rows, inv), pages, o, "/a", "markdown", [], []).collect()}
    assert got == {1: ("included", "no_rules", "available"), 2: ("excluded", "crawl_restriction", "unavailable"), 3: ("outside_scope", "outside_scope", "unavailable")}
    counts = selection.selection_counts(selection.select_inventory(make(rows, inv), pages, o, "/", "html", [], [])).first()
    assert (counts.total_candidates, counts.included, counts.excluded) == (3, 2, 1)


def test_archive(make, spark, tmp_path):
    entries = make([("a.md", "x"), ("b.md", None)], "name string, body string")
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(export.archive(entries, {"n": 2})))
    assert z.namelist() == ["a.md", "b.md", "manifest.json"]
    with pytest.raises(ValueError):
        export.archive(entries, {}, limit=0)
    names = selection.archive_entries(make([(1, "https://h/a?x"), (2, "https://h/a"), (3, "https://h/")], "id long, normalized_url string").withColumn("decision", F.lit("included")), "markdown")
    assert {r.id: r.name for r in names.collect()} == {1: "https:/h/a.md", 2: "https:/h/a-2.md", 3: "https:/h.md"}
    lines = make([("c", 2, "two"), ("c", 1, "one")], "crawl_id string, id long, line string")
    export.write_lines(lines, f"file://{tmp_path}/l", ["crawl_id"], ["id"])
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/l").collect()] == ["one", "two"]
    export.write_blobs(make([("ab12", "x"), ("cd34", "y")], "fp string, body string"), f"file://{tmp_path}/b", "fp", "markdown")
    assert [r.body for r in export.read_blobs(spark, f"file://{tmp_path}/b", make([("md_ab12",)], "file_id string")).collect()] == ["x"]


def test_graph_and_reads(make):
    pages = make([(1, "c", "u1", "/"), (2, "c", "u2", "/a/b"), (3, "d", "u1", "/a")], "id long, crawl_id string, canonical_url string, path string")
    links = make([("c", 1, "u2"), ("c", 1, "u2"), ("c", 2, "u2"), ("c", None, "u1"), ("d", 3, "u2"), ("c", 9, "u1")], "crawl_id string, from_page_id long, canonical_to_url string")
    assert [(r.source, r.target, r.links) for r in reads.graph_edges(links, pages).collect()] == [(1, 2, 2)]
    assert {r.page_id: r.incoming for r in reads.incoming_links(links, pages).collect()} == {1: 2, 2: 3}
    tree = {(r.crawl_id, r.path): r.parent for r in reads.path_tree(pages).collect()}
    assert tree == {("c", "/"): None, ("c", "/a/b"): "/", ("d", "/a"): "/"}
    assert reads.graph_edges(links, pages, most_pages=1).count() == 0
    total = reads.totals(make([], "crawl_id string"), 10).first()
    assert (total.total, total.total_pages) == (0, 1)


def test_jobs(make):
    rows = make([("a", "queued"), ("b", "completed"), ("c", "processing"), ("d", "queued")], "id string, status string")
    asked = make([("a", "completed", 1), ("a", "processing", 2), ("a", "completed_with_errors", 3), ("a", "cancelled", 4), ("b", "processing", 1), ("x", "failed", 1)], "id string, wanted string, seq int")
    assert {r.id: r.status for r in jobs.advance(rows, asked).collect()} == {"a": "completed_with_errors", "b": "completed", "c": "processing", "d": "queued"}
    once = jobs.cancel(rows, rows.select("id"))
    assert {r.id: r.status for r in once.collect()} == {r.id: r.status for r in jobs.cancel(once, rows.select("id")).collect()} == {"a": "cancelled", "b": "completed", "c": "cancelled", "d": "cancelled"}
    crawls = make([("x", '{"alias": "n"}', "2024-01-01"), ("y", '{"crawl_id": "n"}', "2024-02-01"), ("z", None, None)], "id string, config string, started_at string")
    assert jobs.find_crawl(crawls, "n").first().id == "y" and jobs.find_crawl(crawls, "none").count() == 0


# -- effects of messages, control, reads ---------------------------------------------------------------


def test_effects_of_messages_with_nulls_and_empty_tables(make):
    drops = make([("c", "s", "https://H.example/a/", None, "", None, None, 1), ("c", None, None, "GATE", "rule", "excluded", "", 2), ("c", "s", "https://h.example/b", "GATE", "", "excluded", "r", 3)], "crawl_id string, source_url string, target_url string, drop_reason string, pattern_reason string, inventory_status string, matched_rule_id string, seq long")
    assert [r.drop_reason for r in effects.dropped_links(drops).orderBy("seq").collect()] == ["UNKNOWN", "GATE", "GATE"]
    rows = {r.seq: (r.normalized_url, r.exclusion_reason, r.matched_rule_id) for r in effects.inventory_of_drops(drops).collect()}
    assert rows == {2: (None, "rule", None), 3: ("https://h.example/b", "GATE", "r")}
    assert effects.inventory_of_drops(drops.limit(0)).count() == effects.dropped_links(drops.limit(0)).count() == 0
    dead = make([("c", "https://h.example/x", None, 1), ("c", None, "why", 2)], "crawl_id string, url string, dlq_reason string, seq long")
    assert [r.dlq_reason for r in effects.dead_letter_rows(dead).orderBy("seq").collect()] == ["unknown_error", "why"]
    assert [r.exclusion_reason for r in effects.inventory_of_dead(dead).collect()] == ["failed"]
    crawls = make([("c", 3, "completed", "h.example"), ("d", None, "queued", "i.example")], "id string, pages_failed int, status string, target_domain string")
    assert {r.id: r.pages_failed for r in effects.count_failed(crawls, dead).collect()} == {"c": 5, "d": 0}
    after, tasks_again, left = effects.retry_failed(crawls, dead.withColumn("retry_count", F.lit("3")), make([("c",), ("c",)], "id string"))
    assert {r.id: (r.status, r.pages_failed) for r in after.collect()} == {"c": ("running", 1), "d": ("queued", None)}
    assert [(r.retry_count, r.domain) for r in tasks_again.collect()] == [("0", "h.example")] * 2 and left.count() == 0


def test_control_ignores_what_does_not_apply(make):
    crawls = make([("a", "queued"), ("b", "completed"), ("c", "paused"), ("d", None)], "id string, status string")
    asked = make([("a", "pause", 1), ("a", "resume", 2), ("a", "cancel", 3), ("a", "resume", 4), ("b", "cancel", 1), ("c", "pause", 1), ("c", "nonsense", 2), ("d", "pause", 1)], "id string, action string, seq long")
    assert {r.id: r.status for r in effects.control(crawls, asked).collect()} == {"a": "cancelled", "b": "completed", "c": "paused", "d": None}
    busy = make([("a",)], "crawl_id string")
    assert [r.id for r in effects.drained(make([("a", "running"), ("b", "running"), ("c", "paused")], "id string, status string"), busy, busy.limit(0)).collect()] == ["b"]


def test_dump_range_and_lines(make, spark, tmp_path):
    stream = make([("9-0", "{\"a\":1}", "x"), ("10-2", "[", "y"), ("10-10", None, "z"), (None, "q", "w")], "message_id string, metadata string, name string")
    assert [r._message_id for r in export.range_scan(stream).collect()] == ["9-0", "10-2", "10-10"]
    assert [r._message_id for r in export.range_scan(stream, "10-1", 1).collect()] == ["10-2"]
    left = export.dump(stream, f"file://{tmp_path}/dump", ["metadata"], f"file://{tmp_path}/left")
    assert [r.name for r in left.collect()] == ["w"]
    assert spark.read.json(f"file://{tmp_path}/dump").count() == 4
    export.write_jsonl(stream, f"file://{tmp_path}/log")
    export.write_jsonl(stream, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 8


def test_preview_logs_end_once(make):
    rows = make([(1, "u", "included", "r", None, "available", "p", None, False), (2, "v", "outside_scope", "o", None, "unavailable", "p", None, False), (3, "w", "included", "r", "x", "available", "q", "lost", True), (4, "w", "included", "r", "x", "available", "s", None, True)], "id long, normalized_url string, decision string, reason string, rule_id string, content_status string, job string, error string, cancelled boolean")
    log = selection.preview_log(rows, F.col("job"), F.col("error"), F.col("cancelled"))
    ends = {r.preview_id: r.event_type for r in log.where("seq > 100").collect()}
    assert ends == {"p": "preview.completed", "q": "preview.failed", "s": "preview.cancelled"}
    assert [r.event_type for r in selection.preview_replay(log, "p").collect()] == ["preview.started", "url.evaluated", "url.evaluated", "preview.completed"]
    assert [r.seq for r in selection.preview_replay(log, "p", 1).collect()][:1] == [2]


def test_iso_time(spark):
    rows = spark.sql("select timestamp '2026-01-02 03:04:05' as a, timestamp '2026-01-02 03:04:05.000600' as b, cast(null as timestamp) as c")
    assert tuple(rows.select(*[reads.iso_time(F.col(c)) for c in "abc"]).first()) == ("2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.000600+00:00", None)


def test_published_results(spark):
    none = F.expr("cast(array() as array<string>)")
    rows = spark.sql("select * from values (1, ' \n', null), (2, 'x', null), (3, null, '{}') as t(id, text, metadata)")
    kept = rows.where(payload.is_published(none, F.lit(None).cast("string"), F.col("text"), F.col("metadata"))).select("id", payload.published_markdown(F.lit("https://h.example"), F.col("text")).alias("text"))
    assert {r.id: r.text for r in kept.collect()} == {2: "x", 3: "# https://h.example\n\n*Client-rendered page or empty DOM body.*"}


def test_pairs_in_blocks(make, spark):
    rows = spark.range(0, 40).selectExpr("id", "id % 3 as g")
    sizes = rows.groupBy("g").count().withColumnRenamed("count", "m")
    got = sorted((r.id, r.id_2) for r in joins.pair_up(rows, sizes, ["g"], "id", ["id"], 4).collect())
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3]
    assert joins.pair_up(rows.limit(0), sizes, ["g"], "id", ["id"]).count() == 0


def test_headers_by_name_or_label(spark):
    page = spark.sql("select 1 as id, 'c' as crawl_id, 'u' as url, 200 as status_code, named_struct('security', named_struct('missing_headers', array('HSTS', 'Content-Security-Policy', 'x-frame-options'))) as metadata")
    got = {r.rule_id for r in rules.evaluate_findings(page).where("category = 'security'").collect()}
    assert got == {"security.missing_hsts", "security.missing_csp", "security.missing_x_frame"}
