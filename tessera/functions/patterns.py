"""URL rules: patterns of paths with wildcards, validated on the driver, matched as Columns.

A rule list has at most a hundred rules, so its regular expressions are folded into the plan as literals; matching is a narrow
projection, and the winner among several rules is the greatest of an array.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import repeat
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.urls import canonicalize_url, let, normalized_path, origin, origin_of, split_url

LONGEST_PATTERN, MOST_PATTERNS = 512, 100
#: Endings of paths by type of resource, in order of precedence (fixed values).
RESOURCE_ENDINGS = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".avif"),
    "document": (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"),
    "stylesheet": (".css",),
    "script": (".js", ".mjs", ".tsx", ".jsx"),
    "font": (".woff", ".woff2", ".ttf", ".otf", ".eot"),
    "media": (".mp4", ".webm", ".mp3", ".wav", ".mov", ".avi"),
}
_PORTS = {("http", 80), ("https", 443)}


@dataclass(frozen=True)
class Rule:
    source: str
    normalized: str
    kind: str  # include or exclude
    index: int

    @property
    def rule_id(self) -> str:
        key = f"{self.kind}:{self.index}:{self.normalized}"
        return f"{self.kind}:{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    @property
    def specificity(self) -> tuple[int, int, int, int]:
        """Literal segments, then few broad and few single wildcards, then literal characters."""
        literal = [s for s in self.normalized.split("/") if s and "*" not in s]
        return len(literal), -self.normalized.count("**"), -self.normalized.count("*"), len(self.normalized.replace("*", ""))

    @property
    def regex(self) -> str:
        """One expression for the whole path: '**' alone spans segments, '*' stays inside one."""
        out = []
        for segment in urlsplit(self.normalized).path.split("/"):
            if segment == "**":
                out.append("(?:/[^/]+)*")
            elif segment:
                out.append("/" + "[^/]*".join(re.escape(piece) for piece in segment.split("*")))
        return "(?i)^" + "".join(out) + "/?$"


class Parsed(NamedTuple):
    """The parts of a pattern; ``fault`` is why it can't be parsed, ``port_fault`` why its port can't be."""

    text: str
    scheme: str
    host: str
    own: str  # its origin; empty for a relative pattern
    path: str
    more: str  # query and fragment
    fault: str
    port_fault: str

    @property
    def absolute(self) -> bool:
        return bool(self.scheme or self.host or self.own)

    @property
    def normalized(self) -> str:
        """One leading and no trailing slash, after the origin of an absolute pattern."""
        return self.own + ("/" + re.sub(r"^/|/+$", "", self.path if self.absolute else self.text))


def parse_pattern(pattern: str) -> Parsed:
    text = pattern.strip()
    empty = Parsed(text, "", "", "", text, "", "", "")
    try:
        u = urlsplit(text)
    except ValueError as e:
        return empty._replace(fault=str(e))
    scheme, host = u.scheme.lower(), (u.hostname or "").lower()
    found = empty._replace(scheme=scheme, host=host, path=u.path, more=u.query + u.fragment, own=f"{scheme}://{host}" if scheme or u.netloc else "")
    try:
        port = u.port
    except ValueError as e:
        return found._replace(port_fault=str(e))
    return found if not port or (scheme, port) in _PORTS else found._replace(own=f"{found.own}:{port}")


#: What is wrong with a pattern, in the order in which it is looked for, and what is said of it; the messages are fixed values. A test gets the pattern's parts and the crawl's origin.
PROBLEMS = (
    (lambda x, origin: not x.text, "Pattern must not be empty."),
    (lambda x, origin: len(x.text) > LONGEST_PATTERN, f"Pattern must be at most {LONGEST_PATTERN} characters."),
    (lambda x, origin: x.fault, "Pattern URL is invalid: {fault}."),
    (lambda x, origin: x.more, "Patterns must not contain a query string or fragment."),
    (lambda x, origin: x.scheme not in ("", "http", "https"), "Absolute patterns must use http or https."),
    (lambda x, origin: x.absolute and not x.host, "Absolute patterns must include a hostname."),
    (lambda x, origin: x.port_fault, "{port_fault}"),
    (lambda x, origin: x.absolute and origin and x.own != origin, "Absolute patterns must use the crawl's origin."),
    (lambda x, origin: not x.absolute and x.text[:1] != "/", "Relative patterns must start with '/'."),
    (lambda x, origin: "***" in x.normalized, "Use '*' for one path segment or '**' for zero or more segments."),
    (lambda x, origin: not set(x.text).isdisjoint("[]{}\\"), "Only path segments, '*', and '**' are supported; regex syntax is not allowed."),
    (lambda x, origin: max(map(str.count, x.normalized.split("/"), repeat("*"))) > 2, "A path segment may contain one '*' or one '**' wildcard."),
)


def pattern_problem(pattern: object, target_origin: str | None = None) -> str | None:
    """Why a pattern isn't valid, or None."""
    if not isinstance(pattern, str):
        return "Pattern must be a string."
    parsed = parse_pattern(pattern)
    return next((said.format(**parsed._asdict()) for wrong, said in PROBLEMS if wrong(parsed, target_origin)), None)


def normalize_pattern(pattern: str, target_origin: str | None = None) -> str:
    """The normalized form of a pattern; ValueError where it can't be parsed or is of another origin."""
    parsed = parse_pattern(pattern)
    about = [(wrong, said) for wrong, said in PROBLEMS if "invalid" in said or "port_fault" in said or "origin" in said]
    for wrong, said in about:
        if wrong(parsed, target_origin):
            raise ValueError(said.format(**parsed._asdict()))
    return parsed.normalized


def pattern_issues(patterns: list[str], field: str, target_origin: str | None = None) -> list[dict]:
    """Structured problems of a list of patterns; of a list that is too long only that."""

    def issue(code: str, message: str, index: int | None = None) -> dict:
        return {"field": field, "code": code, "index": index, "pattern": None if index is None else patterns[index], "message": message}

    if len(patterns) > MOST_PATTERNS:
        return [issue("TOO_MANY_PATTERNS", f"{field} supports at most {MOST_PATTERNS} patterns.")]
    said = [pattern_problem(p, target_origin) for p in patterns]
    return [issue("INVALID_URL_PATTERN", why, at) for at, why in enumerate(said) if why]


def compile_rules(patterns: list[str], kind: str, target_origin: str) -> list[Rule]:
    """The rules of a list; raises ValueError with the problems if there are any."""
    issues = pattern_issues(patterns, f"config.{kind}_patterns", target_origin)
    if issues:
        raise ValueError(issues)
    return [Rule(p, normalize_pattern(p, target_origin), kind, i) for i, p in enumerate(patterns)]


def normalize_patterns(patterns: list[str], target_origin: str) -> list[str]:
    return [r.normalized for r in compile_rules(patterns, "include", target_origin)]


def resource_type(p: Column) -> Column:
    out = None
    for kind, endings in RESOURCE_ENDINGS.items():
        hit = F.lower(p).rlike("(" + "|".join(re.escape(e) for e in endings) + ")$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def evaluate_url(url: Column, target_origin: Column | str, include: list[Rule], exclude: list[Rule], exclude_types: tuple[str, ...] = ()) -> Column:
    """(decision, reason, normalized_url, normalized_path, rule_id) of a URL.

    Outside the origin it is excluded, then by its type of resource, then by the winning rule: the most specific one that
    matches, an exclude rule before an include rule, the earlier before the later.
    """
    expected = F.lit(target_origin) if isinstance(target_origin, str) else target_origin
    rules = [*include, *exclude]
    rank = [F.struct(*[F.lit(x).alias(f"s{k}") for k, x in enumerate(r.specificity)], F.lit(r.kind == "exclude").alias("exclude"), F.lit(-r.index).alias("at"), F.lit(r.rule_id).alias("rule")) for r in rules]

    def judge(whole: Column, parts: Column, where: Column) -> Column:
        squeezed = F.regexp_replace(where, r"/{2,}", "/")

        def answer(decision: str, reason: Column | str, rule: Column | None = None) -> Column:
            why = F.lit(reason) if isinstance(reason, str) else reason
            return F.struct(F.lit(decision).alias("decision"), why.alias("reason"), whole.alias("normalized_url"), where.alias("normalized_path"), (F.lit(None).cast("string") if rule is None else rule).alias("rule_id"))

        def by_rules(hits: Column) -> Column:
            included = F.exists(hits, lambda h: ~h["exclude"])
            best = F.array_max(hits)
            out = F.when(F.lit(bool(include)) & ~included, answer("excluded", "include_no_match")).when(F.size(hits) == 0, answer("included", "no_rule_match"))
            return out.when(best["exclude"], answer("excluded", "matched_exclude", best["rule"])).otherwise(answer("included", "matched_include", best["rule"]))

        out = F.when(~origin_of(parts).eqNullSafe(expected), answer("excluded", "outside_origin"))
        if exclude_types:
            kind = resource_type(where)
            out = out.when(kind.isin(*exclude_types), answer("excluded", F.concat(F.lit("excluded_resource_type:"), kind)))
        if not rules:
            return out.otherwise(answer("included", "no_rules"))
        return out.otherwise(let(squeezed, lambda p: let(F.array_compact(F.array(*[F.when(p.rlike(r.regex), c) for r, c in zip(rules, rank)])), by_rules)))

    bound = let(canonicalize_url(url), lambda w: F.struct(w.alias("whole"), split_url(w).alias("parts")))
    return let(let(bound, lambda x: F.struct(x["whole"].alias("whole"), x["parts"].alias("parts"), normalized_path(x["parts"]["path"]).alias("where"))), lambda x: judge(x["whole"], x["parts"], x["where"]))


def evaluate_link(url: Column, target_origin: str | None, include: list[Rule], exclude: list[Rule], exclude_types: tuple[str, ...] = ()) -> Column:
    """A discovered link's decision; without a target origin a link counts as inside its own."""
    return evaluate_url(url, F.lit(target_origin) if target_origin else origin(canonicalize_url(url)), include, exclude, exclude_types)


def archive_name(url: Column, extension: str) -> Column:
    """The name of a page's file in an archive, from the parts of its address."""
    parts = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda x: ~x.isin("", ".", ".."))
    base = F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("index")
    return F.when(F.endswith(F.lower(base), F.lit(extension)), base).otherwise(F.concat(base, F.lit(extension)))
