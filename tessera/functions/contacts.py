"""E-mail addresses and phone numbers in text, found and validated by Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.urls import let

#: Patterns and word lists that results depend on (fixed values).
EMAIL = r"\b[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"
PHONE = r"(?:(?:\+|00)\d{1,3}[-.\s]?)?(?:\(?\d{1,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,5}\b"
ASSET_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "tiff", "woff", "woff2", "ttf", "eot", "otf", "css", "js", "json", "xml", "map", "ts", "mp4", "webm", "mp3", "wav", "pdf", "zip", "gz", "tar")
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "domain.com", "yourdomain.com", "yoursite.com", "test.com", "localhost", "local", "sentry.io", "ingest.sentry.io", "w3.org")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: How many digits stand between the marks of a date, and of a time.
DATE_PARTS, TIME_PARTS = ("4-2-2", "2-2-4"), ("1-2", "2-2", "1-2-2", "2-2-2")
ADDRESS = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
RISING, FALLING = "01234567890123456789", "98765432109876543210"


def _unquote(text: Column) -> Column:
    """Percent-decoding in which '+' stays; malformed text stays as it is."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


#: Classes such as \\s and \\d take in all of Unicode.
_UNICODE = "(?U)"


def _strip(text: Column, marks: str) -> Column:
    """Without white space, then without the marks, at both ends."""
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.regexp_replace(bare, f"^[{marks}]+|[{marks}]+$", "")


def validate_email(email: Column) -> Column:
    """The address in lower case, or null if it isn't one or is an asset's name, a placeholder or a machine's id."""
    return let(F.lower(_strip(_unquote(email), r".,;:()<>\[\]\"'")), _email)


def _email(clean: Column) -> Column:
    local, domain = F.substring_index(clean, "@", 1), F.regexp_extract(clean, r"^[^@]*@(.*)$", 1)
    good = (
        F.char_length(clean).between(6, 254)
        & clean.contains("@")
        & F.char_length(local).between(1, 64)
        & ~local.startswith(".")
        & ~local.endswith(".")
        & ~clean.contains("..")
        & ~F.substring_index(domain, ".", -1).isin(*ASSET_ENDINGS)
        & ~domain.isin(*PLACEHOLDER_DOMAINS)
        & ~local.rlike(UUID)
        & clean.rlike(f"{_UNICODE}^(?:{EMAIL})$")
    )
    return F.when(good, clean)


def validate_phone(phone: Column) -> Column:
    """The number with single spaces for its separators, or null if it is a date, a time, an address, a plain or dummy number."""
    return let(let(_strip(_unquote(phone), r".,;:<>\"'#*"), lambda raw: F.struct(raw.alias("raw"), F.regexp_replace(raw, r"(?U)\D", "").alias("digits"))), lambda x: _phone(x["raw"], x["digits"]))


def _parted(raw: Column, marks: str, sizes: tuple[str, ...]) -> Column:
    """Whether a text is digits parted by single marks, so many of them in each part."""
    return raw.rlike(f"^[0-9{marks}]+$") & F.array_join(F.transform(F.split(raw, f"[{marks}]"), lambda part: F.length(part).cast("string")), "-").isin(*sizes)


def _phone(raw: Column, digits: Column) -> Column:
    n = F.length(digits)
    good = (
        ~_parted(raw, "./-", DATE_PARTS)
        & ~_parted(raw, ":", TIME_PARTS)
        & ~raw.rlike(ADDRESS)
        & n.between(7, 15)
        & ~digits.rlike(r"^(\d)\1*$")
        & ~F.contains(F.lit(RISING), digits)
        & ~F.contains(F.lit(FALLING), digits)
        & raw.rlike(r"(?U)^\+|[\s\-().]")
        & ~(n.isin(10, 13) & digits.rlike("^1[5-9]") & ~raw.startswith("+"))
    )
    return F.when(good, F.trim(F.regexp_replace(raw, r"(?U)[\s.-]+", " ")))


def _found(text: Column, pattern: str, validate) -> Column:
    candidates = F.array_distinct(F.regexp_extract_all(text, F.lit(_UNICODE + pattern), 0))
    valid = F.filter(F.transform(candidates, validate), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(valid))


def emails_in(text: Column) -> Column:
    """The different valid addresses of a text, sorted; an empty array for null."""
    return F.coalesce(_found(text, EMAIL, validate_email), F.expr("cast(array() as array<string>)"))


def phones_in(text: Column) -> Column:
    """The different valid numbers of a text, sorted; an empty array for null."""
    return F.coalesce(_found(text, PHONE, validate_phone), F.expr("cast(array() as array<string>)"))


def contacts_in(text: Column) -> Column:
    return F.struct(emails_in(text).alias("emails"), phones_in(text).alias("phones"))


def contact_of_href(href: Column) -> Column:
    """(kind, value) of a mailto: or tel: link with a valid value, or null."""
    low = F.lower(F.trim(href))
    mail = validate_email(F.regexp_replace(F.substring(F.trim(href), 8, 10_000), r"\?.*$", ""))
    tel = validate_phone(F.substring(F.trim(href), 5, 10_000))
    return F.when(low.startswith("mailto:") & mail.isNotNull(), F.struct(F.lit("email").alias("kind"), mail.alias("value"))).when(
        low.startswith("tel:") & tel.isNotNull(), F.struct(F.lit("phone").alias("kind"), tel.alias("value"))
    )


def merged(a: Column, b: Column) -> Column:
    """The sorted union of two arrays of contacts."""
    return F.array_sort(F.array_union(a, b))
