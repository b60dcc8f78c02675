"""Problem 6: pages that hold template residue, filler text, an error message or a notice that scripts are needed.

Two detectors look at one page: patterns of unfilled placeholders, in its title, meta description and visible text
without samples of code; and filler, as a stretch of text mostly of the words of the usual dummy Latin, a stock sentence alone in its element or several within texts.

Filler in any words is found by evidence of all hosts: a line that many hosts serve on a page or two each, mostly beside text of the page's own.
The stock sentences are for what too few hosts share.

Error messages and notices are found by comparison, whatever the status code: a page is a case when it has little text of its
own and the terms of its address appear neither in its title nor in its lines. Text is a page's own when it is
no link and its line neither is repeated over pages of several names of its host nor is served by several hosts, so a long message that many serve
is a case as well. A page whose address gives no verdict is a case if it is short and each of its lines is served by several hosts.

The HTML is scanned once, narrow; what is shuffled is one hash for each line of a page, and the words of the lines for the
join with the few pages that have little text of their own. Counts cover all pages and lines, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.dom import description_of, leaves, title_of
from tessera.llm.textscan import WORD, int_list
from tessera.operators.joins import split_join
from tessera.session import bound_batches, cut

#: Marks of template languages and mail merges around a name (fixed values).
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^{}%\n]+%\}|<%[^<>%\n]+%>|[$#&]\{[^{}\n]+\}|\{\$?[A-Za-z0-9_.]+\}|\[\[[^\[\]\n]+\]\]"
    r"|<<[A-Za-z][^<>\n]*>>|%%?[A-Z][A-Z0-9_]{2,}%%?|\*\|[A-Z][A-Z0-9_:]+\|\*|(?<![\w.+-])@[A-Z]\w*\.[A-Z]\w*|\[object Object\]|__[A-Z][A-Z0-9_]{2,}__|\b(?:TODO|FIXME|TKTK): "
    r"|\[(?i:(?:your|insert|enter|add|type|company|client|customer|first|last|name|title|headline|text|date|address|phone|my)\b[^\[\]\n]*)\]"
)
#: Words of the usual dummy Latin (fixed values).
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Stock sentences of page builders (fixed values).
STOCK = re.compile(
    r"your text goes here|this is a sample page|click the edit button|placeholder (?:headline|text|heading)|sample product|describe colou?r, size|short description of your service|write something about yourself"
    r"|demo block|replace this (?:paragraph|text)|insert your (?:text|content) here|add your (?:text|content) here",
    re.I,
)
#: Stock sentences that are filler where nothing else stands in their element (fixed values).
STOCK_ALONE = re.compile(
    r"(?:(?:your text goes here|replace this (?:paragraph|text) with your own (?:story|text|content)|this is a sample page|edit it or delete it, then start writing|click the edit button to change this text"
    r"|placeholder (?:headline|text|heading)(?: number)?(?: \d+)?|sample product|describe colou?r, size and materials?|(?:add a )?short description of your service(?: in this box)?"
    r"|write something about yourself(?: here)?(?:; visitors love it)?|(?:just another )?demo block(?:, to be filled in by the client)?|(?:insert|add) your (?:text|content) here)[\s.!…]*)+",
    re.I,
)
#: Filler is half dummy Latin in any stretch of this many words, or in a whole shorter text; a text of fewer words than LATIN_WORDS must be nothing else.
LATIN_STRETCH, LATIN_WORDS, LATIN_LEAST, LATIN_PART, STOCK_LINES = 60, 8, 4, 0.5, 2
#: A page with fewer words of its own has little text.
OWN_WORDS = 60
#: A line is its host's when pages of this many names there have it, copies of one page counting once; it is shared when this many hosts serve it.
HOST_PAGES, HOSTS = 3, 3
#: Filler by evidence: a text of this many words that this many hosts serve, each under at most so many names on average.
FILLER_WORDS, FILLER_HOSTS, FILLER_NAMES = 5, 8, 3
#: Part of the address's terms that a page of its own contains; terms are this long at least.
TERMS_PART, TERM_CHARS = 0.5, 4
_LETTERS = re.compile(r"[^\W\d_]+")


def is_latin(text: str) -> bool:
    """Whether a text is dummy Latin, wholly or in any stretch of its words or any of its sentences."""
    words = text.split()
    if len(words) < LATIN_LEAST:
        return False
    upto = [0, *accumulate(w.strip(".,;:!?\"'()").lower() in LATIN for w in words)]
    if len(words) < LATIN_WORDS:
        return upto[-1] == len(words)
    if upto[-1] < LATIN_WORDS * LATIN_PART:
        return False
    n = min(len(words), LATIN_STRETCH)
    if any(upto[i + n] - upto[i] >= LATIN_PART * n for i in range(len(words) - n + 1)):
        return True
    first = 0  # of a sentence that is nothing but Latin, however short the stretch
    for i, w in enumerate(words, 1):
        if w[-1] in ".!?" or i == len(words):
            if i - first >= LATIN_WORDS and upto[i] - upto[first] == i - first:
                return True
            first = i
    return False


def has_residue(title: str, description: str, texts: list[str]) -> bool:
    """Whether a page has an unfilled placeholder or filler text."""
    if PLACEHOLDER.search(title) or PLACEHOLDER.search(description):
        return True
    stock = 0
    for text in texts:
        if PLACEHOLDER.search(text):
            return True
        if STOCK.search(text):
            stock += 1
            if STOCK_ALONE.fullmatch(text.strip()):
                return True
        if is_latin(text):
            return True
    return stock >= STOCK_LINES


def terms_of(text: str) -> str:
    """The different words of a text that an address's term can begin, each after a space."""
    return "".join(sorted({" " + w for w in _LETTERS.findall(text.lower()) if len(w) >= TERM_CHARS}))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, residue, lines, sizes, titles, terms = [], [], [], [], [], []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            title = title_of(html)
            tree = leaves(html, code=False)
            texts = [leaf.text for leaf in tree if leaf.text]
            residue.append(has_residue(title, description_of(html), texts))
            own = [leaf.text for leaf in tree if not (leaf.tag == "li" and leaf.linked >= len(leaf.text.strip()))]
            ids.append(page)
            lines.append([xxhash.xxh3_64_intdigest("".join(WORD.findall(t.lower()))) >> 1 for t in own])
            sizes.append([t.count(" ") + 1 for t in own])
            titles.append(terms_of(title))
            terms.append([terms_of(t) for t in own])
        offsets = np.cumsum([0, *map(len, lines)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(residue),
                int_list(offsets, np.fromiter((x for k in lines for x in k), np.int64, int(offsets[-1]))), int_list(offsets, np.fromiter((x for k in sizes for x in k), np.int32, int(offsets[-1]))),
                pa.array(titles, pa.string()), pa.array(terms, pa.list_(pa.string())),
            ],
            names=["page_id", "residue", "lines", "sizes", "title", "terms"],
        )


_SCANNED = "page_id bigint, residue boolean, lines array<bigint>, sizes array<int>, title string, terms array<string>"


def addresses(pages: DataFrame) -> DataFrame:
    """(page_id, host, name, named) of the pages that have an address: the name in it, and the terms of that name that tell something."""
    address = F.lower("canonical_url")
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    slug = F.regexp_extract(F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"([^/]*)/*$", 1)
    parts = F.split(slug, r"[-_.]+")
    # what follows the last two marks is an id and a word that may have been cut short; the host's own words tell nothing
    named = F.when(F.size(parts) > 3, F.slice(parts, 1, F.size(parts) - 2)).otherwise(parts)
    name = F.xxhash64(F.array_join(named, "-"))
    return pages.select(F.col("id").alias("page_id"), host.alias("host"), name.alias("name"), F.filter(named, lambda x: (F.length(x) >= TERM_CHARS) & ~F.contains(host, x)).alias("named")).where("host <> ''")


def pages_without_content(page_content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id) of each page whose raw_html is template residue, filler, an error message or a notice.

    Pages with null or empty HTML are no cases, nor are such strings in code, script or noscript elements. A page that
    isn't in ``pages`` or has no address there is judged by its placeholders and filler only. Empty tables give no row.
    """
    spark = page_content.sparkSession
    bound_batches(spark)
    html = page_content.select("page_id", "raw_html").where("page_id is not null and length(raw_html) > 0")
    scanned = cut(html.mapInArrow(_scan, _SCANNED))
    sites = addresses(pages)
    placed = scanned.select("page_id", "residue", "lines", "sizes").join(sites.select("page_id", "host", "name"), "page_id")
    said = placed.select("page_id", "host", "name", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("page_id", "host", "name", F.xxhash64("host", "x.lines").alias("key"), F.col("x.lines").alias("line"), F.col("x.sizes").alias("words"))
    named = said.groupBy("host", "line", "name").agg(F.min("words").alias("words"))
    of_host = named.groupBy("host", "line").agg(F.count("*").alias("names"), F.min("words").alias("words"))
    spread = of_host.groupBy("line").agg(F.count("*").alias("hosts"), F.sum("names").alias("names"), F.min("words").alias("words")).where(F.col("hosts") >= HOSTS)
    shared = cut(spread)  # lines that several hosts serve, each once
    # neither a host's furniture nor what several hosts serve is a page's own
    common = split_join(of_host, shared.select("line", "hosts"), ["line"], "left").where((F.col("names") >= HOST_PAGES) | F.col("hosts").isNotNull())
    common = common.select(F.xxhash64("host", "line").alias("key"), (F.col("names") >= HOST_PAGES).alias("furniture"))
    mine = split_join(said, common, ["key"], "left").where("not coalesce(furniture, false)")
    own = cut(mine.groupBy("page_id").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("furniture").isNull(), F.col("words"))).alias("own_words"), F.collect_set("line").alias("own_lines")))
    no_lines = F.expr("cast(array() as array<bigint>)")
    little = placed.where("not residue").select("page_id").join(own, "page_id", "left").where(F.coalesce("own_words", F.lit(0)) < OWN_WORDS)
    little = little.select("page_id", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("own_lines", no_lines).alias("own_lines"))
    near = cut(little.join(sites.select("page_id", "named"), "page_id").join(scanned.select("page_id", "lines", "title", "terms"), "page_id"))
    spoken = F.filter(F.arrays_zip("lines", "terms"), lambda x: F.array_contains("own_lines", x["lines"]))
    text = F.concat("title", F.array_join(F.transform(spoken, lambda x: x["terms"]), ""))
    hit = F.filter("named", lambda t: F.contains(F.col("text"), F.concat(F.lit(" "), t)))
    strange = near.withColumn("text", text).where(F.size(hit) < TERMS_PART * F.size("named")).select("page_id")
    mute = near.where((F.size("named") == 0) & (F.col("words") < OWN_WORDS))
    rare = mute.select("page_id", F.explode("own_lines").alias("line")).join(shared, "line", "left_anti").select("page_id")
    errors = strange.unionByName(mute.select("page_id").join(rare, "page_id", "left_anti"))
    # filler stands on few pages a host but on many hosts, mostly beside text of the page's own; messages stand alone
    likely = shared.where((F.col("hosts") >= FILLER_HOSTS) & (F.col("names") <= FILLER_NAMES * F.col("hosts")) & (F.col("words") >= FILLER_WORDS)).select("line")
    beside = split_join(said.select("page_id", "line"), likely, ["line"], "left_semi").distinct().join(own.select("page_id", (F.coalesce("own_words", F.lit(0)) >= OWN_WORDS).alias("full")), "page_id")
    filler = beside.groupBy("line").agg(F.avg(F.col("full").cast("double")).alias("part")).where("part > 0.5").select("line")
    filled = split_join(beside.where("full"), filler, ["line"], "left_semi").select("page_id")
    rest = errors.unionByName(filled).distinct().join(scanned.where("residue").select("page_id"), "page_id", "left_anti")
    return scanned.where("residue").select("page_id").unionByName(rest)


def pages_with_content(page_content: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id) of the pages that aren't cases."""
    return page_content.select("page_id").join(pages_without_content(page_content, pages), "page_id", "left_anti")
