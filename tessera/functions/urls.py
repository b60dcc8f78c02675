"""URL functions as Columns.

A URL is cut once, from its end, into the parts of RFC 3986, appendix B; they are put together again in canonical form. All
functions return null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
#: Ports that a scheme implies.
DEFAULT_PORTS = {"http": "80", "https": "443"}
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _clean(url: Column) -> Column:
    """Without the control characters that URL parsers drop."""
    cleaned = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return F.when(url.rlike(r"[\x00-\x20]"), cleaned).otherwise(url)


def split_url(url: Column) -> Column:
    """The parts of a URL: scheme and host in lower case, authority, port as written, path, query, fragment; '' for those it lacks."""

    after = lambda text, taken, skip: F.substr(text, F.length(taken) + skip, F.length(text))

    def off_the_end(u: Column) -> Column:
        """The fragment, and what is before it."""
        return let(F.substring_index(u, "#", 1), lambda x: F.struct(x.alias("u"), after(u, x, 2).alias("fragment")))

    def off_the_query(x: Column) -> Column:
        return let(F.substring_index(x["u"], "?", 1), lambda y: F.struct(y.alias("u"), after(x["u"], y, 2).alias("query"), x["fragment"].alias("fragment"), F.regexp_extract(y, SCHEME, 1).alias("scheme")))

    def off_the_scheme(x: Column) -> Column:
        rest = F.when(x["scheme"] != "", after(x["u"], x["scheme"], 2)).otherwise(x["u"])
        return let(rest, lambda r: F.struct(r.alias("rest"), F.when(r.startswith("//"), F.substring_index(F.substr(r, F.lit(3), F.length(r)), "/", 1)).when(r.isNotNull(), "").alias("authority"), x["scheme"].alias("scheme"), x["query"].alias("query"), x["fragment"].alias("fragment")))

    def with_host(x: Column) -> Column:
        path = F.when(x["rest"].startswith("//"), after(x["rest"], x["authority"], 3)).otherwise(x["rest"])
        address = F.lower(F.substring_index(x["authority"], "@", -1))
        return let(
            F.struct(address.alias("address"), F.regexp_extract(address, r":([0-9]*)$", 1).alias("port")),
            lambda a: F.struct(
                F.lower(x["scheme"]).alias("scheme"), x["authority"].alias("authority"), a["address"].alias("address"), F.regexp_replace(a["address"], r":[0-9]*$", "").alias("host"),
                a["port"].alias("port"), path.alias("path"), x["query"].alias("query"), x["fragment"].alias("fragment"),
            ),
        )

    return let(let(let(let(_clean(url), off_the_end), off_the_query), off_the_scheme), with_host)


def _needed_port(p: Column) -> Column:
    """':port' where the scheme doesn't imply it."""
    implied = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        implied = implied | ((p["scheme"] == name) & (p["port"] == number))
    return F.when(implied | (p["port"] == ""), "").otherwise(F.concat(F.lit(":"), p["port"]))


def scheme(url: Column) -> Column:
    return split_url(url)["scheme"]


def authority(url: Column) -> Column:
    return split_url(url)["authority"]


def host(url: Column) -> Column:
    """The host in lower case, without port; '' when there is none."""
    return split_url(url)["host"]


def port(url: Column) -> Column:
    """The port as it is written; '' when there is none or the scheme implies it."""
    return let(split_url(url), lambda p: F.regexp_replace(_needed_port(p), "^:", ""))


def path(url: Column) -> Column:
    return split_url(url)["path"]


def query(url: Column) -> Column:
    return split_url(url)["query"]


def origin_of(p: Column) -> Column:
    """The origin of a URL's parts: scheme://host, with the port where the scheme doesn't imply it."""
    return F.concat(p["scheme"], F.lit("://"), p["host"], _needed_port(p))


def origin(url: Column) -> Column:
    return let(split_url(url), origin_of)


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no user information, default port, parameters or fragment; no trailing slashes
    but for the root; the query as it is. A port that isn't a number gives null."""

    def whole(p: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(p["path"], r";[^/]*$", ""), r"/+$", "")
        before = F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise("")
        slashes = F.when(p["authority"] != "", F.lit("//")).otherwise("")
        tail = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
        bad = p["host"].contains(":") & ~p["address"].startswith("[")
        return F.when(~bad, F.concat(before, slashes, p["host"], _needed_port(p), F.coalesce(F.nullif(bare, F.lit("")), F.lit("/")), tail))

    return let(split_url(url), whole)


def fingerprint(url: Column) -> Column:
    """The SHA-256 of the canonical URL, in hexadecimal."""
    return F.sha2(canonicalize_url(url), 256)


def _without_dots(p: Column) -> Column:
    """Dot segments resolved as by RFC 3986, section 5.2.4."""
    parts = F.split(p, "/")
    empty = F.expr("cast(array() as array<string>)")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, empty, step)
    closed = F.when(p.rlike(r"(^|/)\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def urljoin(base: Column, href: Column) -> Column:
    """``href`` resolved against the absolute URL ``base``."""

    def resolve(b: Column, ref: Column, r: Column) -> Column:
        at = F.concat(b["scheme"], F.lit("://"), b["authority"])
        marked = lambda mark, text: F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")
        ends = F.concat(marked("?", r["query"]), marked("#", r["fragment"]))
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), r["path"]))
        below = let(merged, lambda m: F.when(m.rlike(r"(^|/)\.{1,2}(/|$)"), _without_dots(m)).otherwise(m))
        same_page = F.concat(at, b["path"], F.when(r["query"] != "", marked("?", r["query"])).otherwise(marked("?", b["query"])), marked("#", r["fragment"]))
        return (
            F.when(ref == "", _clean(base))
            .when(r["scheme"] != "", ref)
            .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), ref))
            .when(r["path"] == "", same_page)
            .otherwise(F.concat(at, below, ends))
        )

    return let(F.struct(split_url(base).alias("b"), _clean(href).alias("ref"), split_url(href).alias("r")), lambda x: resolve(x["b"], x["ref"], x["r"]))


def query_pairs(url: Column) -> Column:
    """The query's (key, value) pairs in order, decoded; a key without '=' has an empty value."""

    def decode(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), F.regexp_replace(text, r"\+", " "))

    fields = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(fields, lambda x: F.struct(decode(F.regexp_extract(x, r"^([^=]*)", 1)).alias("key"), decode(F.regexp_extract(x, r"^[^=]*=?(.*)$", 1)).alias("value")))


def query_map(url: Column) -> Column:
    """The query as a map; of a key that comes twice the last value stays."""

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]))

    return F.map_from_entries(let(query_pairs(url), last))


def normalized_path(p: Column) -> Column:
    """A path with one leading slash and no trailing ones; the root for an empty one."""
    led = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.coalesce(F.nullif(F.regexp_replace(led, r"/+$", ""), F.lit("")), F.lit("/"))


def path_parent(p: Column) -> Column:
    """The path above; null above the root."""
    up = F.regexp_replace(p, r"/[^/]*$", "")
    return F.when(p == "/", None).otherwise(F.when(up == "", "/").otherwise(up))


def crawl_uuid(name: Column) -> Column:
    """A UUID stays itself, in lower case with hyphens; any other name becomes its version-5 UUID in the DNS namespace."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, r"^(?i:urn:uuid:)", ""), r"[{}-]", ""))
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    hashed = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    digits = F.when(plain.rlike(r"^[0-9a-f]{32}$"), plain).otherwise(hashed)
    return F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_inside(url_host: Column, domain: Column) -> Column:
    """Whether a host is a domain, without its port, or lies under it."""
    bare = F.regexp_replace(F.lower(domain), r":[0-9]*$", "")
    return (url_host == bare) | F.endswith(url_host, F.concat(F.lit("."), bare))
