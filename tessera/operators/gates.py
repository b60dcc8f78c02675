"""The gates that decide what is crawled: of responses, of tasks and of discovered links.

A chain of gates is one ``when`` chain, so the first gate that fails gives the reason; everything is narrow but the
comparison with what is known already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.contacts import contact_of_href
from tessera.functions.html import anchor_hrefs
from tessera.functions.patterns import Rule, evaluate_link
from tessera.functions.urls import canonicalize_url, fingerprint, is_inside, let, split_url, urljoin
from tessera.session import cut

BLOCKED_STATUS = (403, 429, 503)
#: Parts of a body that tell of a block (fixed values).
BLOCK_SIGNALS = (
    "cf-browser-verification", "just a moment", "datadome", "enable javascript", "access denied", "403 forbidden", "rate limit exceeded",
    "too many requests", "<title>just a moment", "challenges.cloudflare.com/cdn-cgi/challenge-platform", "cdn-cgi/challenge-platform",
)
BODY_CHARS, SKELETON_CHARS = 8192, 5000
#: First words of a path segment that aren't followed; there is no boundary on their right (fixed values).
DENIED_PATHS = (
    "blog", "news", "press", "events", "updates", "announcements", "insights", "resources", "privacy", "terms", "legal", "cookie", "cookies", "gdpr",
    "disclaimer", "accessibility", "login", "logout", "signin", "signup", "register", "auth", "account", "password", "reset", "cart", "checkout",
    "basket", "order", "payment", "subscribe", "billing", "careers", "jobs", "vacancies", "hiring", "work-with-us", "faq", "help", "support", "sitemap",
    "rss", "feed", "search", "cdn-cgi", "wp-admin", "wp-login", "wp-json", "_next", "__nuxt", "assets", "static", "media", "images", "img", "css", "js", "fonts",
)
MAX_DEPTH, MAX_RETRIES = 2, 3


def is_denied(p: Column) -> Column:
    return p.rlike("(?i)/(" + "|".join(DENIED_PATHS) + ")")


def is_spa_skeleton(body: Column) -> Column:
    """Whether a body, in lower case, is the empty frame of a page that scripts fill; the strings are fixed values."""
    has = body.contains
    no_links = ~has("<a ")
    frame = has('<div id="root"></div>') | has('<div id="root"> </div>') | (has('<div id="root">') & no_links) | has('<div id="app"></div>') | has('<div id="__next"></div>')
    return frame | ((F.char_length(body) < SKELETON_CHARS) & (has("<script") | has("/assets/")) & no_links)


def is_blocked(status: Column, html: Column, primary: Column) -> Column:
    """Whether a response is a block or a challenge, or, in the primary session, an unrendered page."""
    body = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, BODY_CHARS))
    hit = F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False))
    for signal in BLOCK_SIGNALS:
        hit = hit | body.contains(signal)
    return hit | (primary & is_spa_skeleton(body))


def next_session(blocked: Column, session: Column) -> Column:
    """The session that fetches next: a blocked response in the primary session goes to the browser."""
    return F.when(blocked & (session == "http"), "stealth").otherwise(session)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, base, at, href, url) of each anchor of pages (page_id, url, html), resolved against the page's address."""
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(anchor_hrefs(F.col("html"))).alias("at", "href"))
    return each.withColumn("url", urljoin(F.col("base"), F.col("href")))


def numbered_links(pages: DataFrame) -> DataFrame:
    """``page_links`` with ``again``, whether an earlier anchor of the page has the same address: neighbours of its sorted anchors show it, without a shuffle."""
    hrefs = F.transform(anchor_hrefs(F.col("html")), lambda href, at: F.struct(urljoin(F.col("base"), href).alias("url"), at.alias("at"), href.alias("href")))

    def marked(anchors: Column) -> Column:
        return F.transform(anchors, lambda x, k: F.struct(x["at"].alias("at"), x["href"].alias("href"), x["url"].alias("url"), F.when(k > 0, x["url"].eqNullSafe(F.get(anchors, k - 1)["url"])).otherwise(False).alias("again")))

    each = pages.select("page_id", F.col("url").alias("base"), "html").select("page_id", "base", F.explode(let(F.array_sort(hrefs), marked)).alias("a"))
    return each.select("page_id", "base", "a.at", "a.href", "a.url", "a.again")


def gate_links(links: DataFrame, domain: Column, include: list[Rule] = [], exclude: list[Rule] = [], origin: str | None = None, known: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Links (page_id, at, href, url, again) with their reason: accepted is URL_DISCOVERED.

    In order: a repeated address of the page, an address for mail or telephone, a scheme that isn't http, another
    domain, a denied path, a URL rule, an address that is known or was discovered by an earlier link. Only links that pass all gates but the last have a canonical address;
    they alone are compared with what is known, by one row for each address, and the discoverers are joined back by their place.
    """
    mail = F.lower(F.trim("href")).rlike("^(mailto|tel):")
    cheap = F.when(F.col("again"), "PAGE_DUPLICATE").when(mail, F.when(F.col("contact").isNotNull(), "CONTACT").otherwise("INVALID_CONTACT"))

    def by_parts(p: Column) -> Column:
        return (
            F.when(~p["scheme"].isin("http", "https"), "INVALID_SCHEME")
            .when(~is_inside(p["host"], F.col("domain")), "OFFSITE_DOMAIN")
            .when(is_denied(p["path"]), "DENY_PATTERN")
        )

    rows = links.withColumn("domain", domain).withColumn("contact", F.when(mail, contact_of_href(F.col("href")))).withColumn("reason", cheap)
    rows = rows.withColumn("reason", F.coalesce("reason", let(split_url(F.col("url")), by_parts)))
    if include or exclude:
        decision = evaluate_link(F.col("url"), origin, include, exclude)["decision"]
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(decision == "excluded", "URL_PATTERN_EXCLUDED")))
    rows = rows.withColumn("canonical", F.when(F.col("reason").isNull(), canonicalize_url(F.col("url"))))
    rows = cut(rows.select("page_id", "at", "href", "url", "canonical", "domain", "contact", "reason"))  # it is read three times below, and pages' HTML only once
    passed = rows.where("reason is null")
    once = passed.groupBy("domain", "canonical").agg(F.min(F.struct("page_id", "at")).alias("by"))
    if known is not None:
        once = once.join(known.select(F.col("canonical_url").alias("canonical")).distinct(), "canonical", "left_anti")
    new = once.select("by.page_id", "by.at", F.lit("URL_DISCOVERED").alias("_new"))
    judged = passed.join(new, ["page_id", "at"], "left").withColumn("reason", F.coalesce("_new", F.lit("DUPLICATE"))).drop("_new")
    return rows.where("reason is not null").unionByName(judged)


def first_attempt(retry: Column, throttle: Column) -> Column:
    return (F.coalesce(retry.cast("int"), F.lit(0)) == 0) & (F.coalesce(throttle.cast("int"), F.lit(0)) == 0)


def gate_tasks(tasks: DataFrame, visited: DataFrame, limit: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Tasks (crawl_id, url, domain, depth, retry_count, throttle_count, seq) with their outcome.

    In order: malformed (no address or domain), visited, in flight (an earlier task has the address), too deep, over the crawl's budget
    of ``limit`` first attempts in order of arrival; what passes is accepted.
    """
    retry, throttle = F.col("retry_count"), F.col("throttle_count")
    rows = tasks.withColumn("fingerprint", fingerprint(F.col("url")))
    seen = visited.select("crawl_id", fingerprint(F.col("url")).alias("fingerprint"), F.lit(True).alias("seen")).distinct()
    rows = rows.join(seen, ["crawl_id", "fingerprint"], "left")
    malformed = (F.coalesce("url", F.lit("")) == "") | (F.coalesce("domain", F.lit("")) == "")
    early = F.when(malformed, "MALFORMED").when(F.col("seen"), "VISITED")
    rows = rows.withColumn("early", early)
    head = rows.where("early is null").groupBy("crawl_id", "fingerprint").agg(F.min("seq").alias("head"))
    rows = rows.join(head, ["crawl_id", "fingerprint"], "left")
    outcome = F.coalesce("early", F.when(F.col("seq") != F.col("head"), "IN_FLIGHT").when(F.coalesce(F.col("depth").cast("int"), F.lit(0)) > max_depth, "MAX_DEPTH_REACHED"))
    rows = rows.withColumn("outcome", outcome)
    return with_tickets(rows, F.col("outcome").isNull() & first_attempt(retry, throttle), limit).select(
        *tasks.columns, F.coalesce("outcome", F.when(F.col("ticket") > limit, "BUDGET_EXHAUSTED").otherwise("ACCEPTED")).alias("outcome"), "ticket"
    )


def with_tickets(rows: DataFrame, pays: Column, limit: int, scope: str = "crawl_id", order: str = "seq") -> DataFrame:
    """``rows`` with a ticket number in order of arrival within a scope, for those that pay; others have none.

    Numbers are ranks over range-partitioned rows: each partition numbers its own, and the counts of those before are added,
    so a crawl that holds most rows isn't numbered by one task.
    """
    rows = rows.withColumn("_pays", pays)
    placed = rows.repartitionByRange(scope, order).sortWithinPartitions(scope, order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed)  # the range's bounds are sampled, so the placement is written down before it is read twice
    inside = Window.partitionBy("_part", scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy(scope, "_part").agg(F.sum(F.col("_pays").cast("long")).alias("_n"))
    before = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(scope, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.sum(F.col("_pays").cast("long")).over(inside)
    numbered = placed.withColumn("_own", own).join(offsets, [scope, "_part"])
    return numbered.withColumn("ticket", F.when(F.col("_pays"), F.col("_own") + F.col("_before"))).drop("_pays", "_part", "_own", "_before")
