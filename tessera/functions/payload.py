"""Extraction of structured payloads: captured responses, hydration state, Markdown, and tolerant decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Parts of addresses that belong to tracking (fixed values).
TRACKING = (
    "google-analytics", "googletagmanager", "doubleclick", "hotjar", "segment.io", "mixpanel", "amplitude", "sentry", "datadog",
    "newrelic", "facebook.com/tr", "bat.bing", "clarity.ms", "analytics.", ".tracking.", "beacon", "telemetry", "pixel",
)
LEAST_KEYS = 2
#: Patterns of state that scripts leave in a page, by priority (fixed values).
HYDRATION = (
    r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>\s*(\{.*?\})\s*</script>",
    r"(?s)window\.__NUXT__\s*=\s*(\{.*?\})(?:\s*;|$)",
    r"(?s)window\.__remixContext\s*=\s*(\{.*?\})(?:\s*;|$)",
    r"(?s)window\.__(?:APP_STATE|INITIAL_STATE)__\s*=\s*(\{.*?\})(?:\s*;|$)",
)
OFFLOAD_BYTES = 16_384


def is_tracking(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    hit = F.lit(False)
    for part in TRACKING:
        hit = hit | low.contains(part)
    return hit


def object_size(json_text: Column) -> Column:
    """Keys of a JSON object; null for anything else."""
    return F.when(F.ltrim(json_text).startswith("{") & F.try_parse_json(json_text).isNotNull(), F.size(F.json_object_keys(json_text)))


def accepted_xhr(captured: Column) -> Column:
    """The bodies of captured (url, body) responses that are JSON objects of two or more keys and no tracking."""
    good = F.filter(captured, lambda x: ~is_tracking(x["url"]) & (F.coalesce(object_size(x["body"]), F.lit(0)) >= LEAST_KEYS))
    return F.coalesce(F.transform(good, lambda x: x["body"]), F.expr("cast(array() as array<string>)"))


def hydration_state(html: Column) -> Column:
    """The first state object of a page that parses, by priority of the patterns; null if there is none."""
    found = [F.regexp_extract(html, pattern, 1) for pattern in HYDRATION]
    return F.coalesce(*[F.when(object_size(text).isNotNull(), text) for text in found])


def extraction_methods(xhr: Column, hydration: Column, markdown: Column) -> Column:
    filled = has_text(markdown)
    methods = F.array_compact(F.array(F.when(F.size(xhr) > 0, "xhr"), F.when(F.coalesce(object_size(hydration), F.lit(0)) > 0, "hydration"), F.when(filled, "markitdown")))
    return F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("none")))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, quotes, tables, code and links; scripts and styles are dropped."""

    _BLOCKS = frozenset("p div section article main header footer aside nav ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 li br hr center td th body".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.text: list[str] = []
        self.mark, self.hidden, self.pre, self.href = "", 0, False, None
        self.lists: list[int | None] = []
        self.cells: list[str] | None = None
        self.header = False

    def _flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()
        text = text if self.pre else re.sub(r"\s+", " ", text).strip()
        if text:
            if self.cells is not None:
                self.cells.append(text)
            else:
                self.lines.append(self.mark + text)
                self.mark = "> " if self.mark.startswith(">") else ""

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.hidden += 1
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""
            self.text.append("[")
        elif tag in self._BLOCKS:
            self._flush()
            if re.fullmatch("h[1-6]", tag):
                self.mark = "#" * int(tag[1]) + " "
            elif tag == "blockquote":
                self.mark = "> "
            elif tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            elif tag == "li":
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                    self.mark = f"{self.lists[-1]}. "
                else:
                    self.mark = "* "
            elif tag == "tr":
                self.cells, self.header = [], False
            elif tag == "th":
                self.header = True
            elif tag == "pre":
                self.pre = True
                self.lines.append("```")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.href is not None:
            self.text.append(f"]({self.href})")
            self.href = None
        elif tag in self._BLOCKS:
            self._flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.mark = ""
            elif tag == "tr" and self.cells is not None:
                if len(self.cells) > 1:
                    self.lines.append("| " + " | ".join(self.cells) + " |")
                    if self.header:
                        self.lines.append("|" + " --- |" * len(self.cells))
                else:
                    self.lines += self.cells
                self.cells = None
            elif tag == "pre":
                self.pre = False
                self.lines.append("```")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(data)

    def result(self) -> str:
        self._flush()
        out: list[str] = []
        for line in self.lines:
            kind = line[:1] in "*|" or re.match(r"\d+\. ", line)
            if out and not (kind and (out[-1][:1] == line[:1] or re.match(r"\d+\. ", out[-1]))) and line != "```" and out[-1] != "```":
                out.append("")
            out.append(line)
        return "\n".join(out)


def to_markdown(html: str | None) -> str | None:
    """The Markdown of a page's body; null for none. It stands in for a third-party converter and isn't equal to it."""
    if not html:
        return None
    parser = _Markdown()
    body = re.search(r"(?is)<body[^>]*>(.*)", html)
    parser.feed(body.group(1) if body else html)
    parser.close()
    return parser.result() or None


@pandas_udf(StringType())
def html_to_markdown(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The one function that no Column expresses: a converter with state."""
    for batch in pages:
        yield batch.map(to_markdown, na_action="ignore")


def page_extraction(url: Column, captured: Column, html: Column, markdown: Column) -> Column:
    """All strategies at once: url, xhr_payloads, hydration_state, raw_markdown, extraction_methods."""
    xhr, state, text = accepted_xhr(captured), hydration_state(html), F.coalesce(markdown, F.lit(""))
    return F.struct(url.alias("url"), xhr.alias("xhr_payloads"), state.alias("hydration_state"), text.alias("raw_markdown"), extraction_methods(xhr, state, text).alias("extraction_methods"))


def is_published(xhr: Column, hydration: Column, markdown: Column, metadata: Column) -> Column:
    """Whether a result has anything to publish: captured responses, a state of scripts, text, or metadata (null for none)."""
    return (F.coalesce(F.size(xhr), F.lit(0)) > 0) | (F.coalesce(object_size(hydration), F.lit(0)) > 0) | has_text(markdown) | metadata.isNotNull()


def has_text(markdown: Column) -> Column:
    return F.coalesce(markdown.rlike(r"\S"), F.lit(False))


def published_markdown(url: Column, markdown: Column) -> Column:
    """The Markdown of a published result: where the text is blank, a heading of the address and a sentence (fixed value)."""
    return F.when(has_text(markdown), markdown).otherwise(F.concat(F.lit("# "), url, F.lit("\n\n*Client-rendered page or empty DOM body.*")))


def json_or(text: Column, default: Column | None = None) -> Column:
    """A JSON text that parses, else the default."""
    good = F.when(F.try_parse_json(text).isNotNull(), text)
    return good if default is None else F.coalesce(good, default)


def json_strings(text: Column) -> Column:
    """The members of a JSON array of strings; an empty array for anything else."""
    members = F.when(F.ltrim(text).startswith("[") & F.try_parse_json(text).isNotNull(), F.from_json(text, "array<string>"))
    return F.coalesce(members, F.expr("cast(array() as array<string>)"))


def offloaded(payload: Column, file_id: Column) -> Column:
    """A payload, or where it is larger than OFFLOAD_BYTES a pointer to the file that holds it; the pointer's keys are fixed values."""
    size = F.octet_length(payload)
    pointer = F.to_json(F.struct(file_id.alias("_appwrite_file_id"), size.alias("_byte_size"), F.lit(True).alias("offloaded")))
    return F.when(size > OFFLOAD_BYTES, pointer).otherwise(payload)


def byte_size(markdown: Column) -> Column:
    return F.octet_length(F.coalesce(markdown, F.lit("")))


def token_estimate(markdown: Column) -> Column:
    return F.floor(F.char_length(F.coalesce(markdown, F.lit(""))) / 4).cast("int")
