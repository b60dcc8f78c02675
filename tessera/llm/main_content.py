"""Problem 4: the main body of a page, without its menus, notices, sidebars, comments and footers.

Minimum-cut labelling. The blocks of a page's Markdown are nodes, of a list, table or quotation each line: a classifier's
log-odds become the capacity of its edge to the source (content) or the sink (boilerplate). Neighbours are joined by smoothness
edges, strong between the lines of a run and from a heading to what follows it, and all blocks of one DOM region are joined to a node of that region, whose own capacity is
its log-odds to be a region of the text, by its heading and words. Maximum flow then separates content from boilerplate. So a line whose words are those of
boilerplate is cut out of a region of text, and a second region that looks like text is kept.

The classifier is naive Bayes over all words, link targets and forms of a line. It is fitted on a bounded sample of pages, whose
DOM labels them: text in the region of the page's prose, in elements for prose, is content, all else isn't; a
heading goes with what follows it. Pages without HTML are cut on its costs and adjacency alone.

A page that keeps fewer than ``LEAST_WORDS`` words may hold a message or a notice and no body. It keeps nothing if the terms of its
address are neither in its title nor in its lines, or, where the address has none, if each of its lines stands on several
short pages. A page without evidence keeps its lines. Such pages take no part in training.

Fitting reads the whole table for the sample, cutting reads it once more; both are narrow and nothing is joined.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.dom import Leaf, leaves, title_of
from tessera.llm.residue import TERMS_PART, addresses, terms_of
from tessera.llm.textscan import WORD
from tessera.session import cut as cut_lineage
from tessera.session import bound_batches

#: Pages of the training sample, about; at most twice as many.
SAMPLE_PAGES = 3_000
LEAST_WORDS, LEAST_COUNT = 50, 4
#: A line of a message stands on this many short pages.
MESSAGE_PAGES = 3
#: Each word's and each region feature's log-odds and a line's sum are bounded. Words of the text stand in boilerplate too, those of boilerplate hardly in the text, so a sum may speak more strongly against a line than for it.
WORD_ODDS, REGION_ODDS, LINE_ODDS, LOW_ODDS = 2.5, 8.0, 6.0, -14.0
#: Capacities: neighbours, lines of one run, a heading that is content before something that isn't, a block and its region, a region's own for each unit of its log-odds.
NEXT, RUN, HEADING, REGION, REGION_OWN = 0.5, 4.0, 4.5, 8.0, 15.0
#: Added to the log-odds by the block's element or form: a title, prose elements, other elements of a page that has prose elements, lists of links.
TITLE, PROSE, PLAIN, LINK = 6.0, 1.0, -20.0, -8.0
#: How much a feature of a line's form counts against one of its words.
FORM_WEIGHT = 3.0

_NOT_WORD = re.compile(r"[\W_]+")
_SPEAKER = re.compile(r"^[^\W\d_]+: ")
_LINK = re.compile(r"\[([^\[\]]*)\]\(([^)\s]*)[^)]*\)")
_SEGMENT = re.compile(r"^(?:[a-z]+://[^/]*)?(/[^/?#]*)(/?)", re.I)
_ITEM = re.compile(r"^\s*(?:[*+-]|\d+[.)])\s+")
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li td th pre dd dt figcaption".split())


class Block(NamedTuple):
    first: int  # line numbers
    last: int
    kind: str  # heading, links, list, table, quote, code, text
    odds: float
    words: int
    form: str  # letters and digits of its first line
    top: bool  # a first-level heading
    run: bool = False  # of one list, table or quotation with the block before


def _kind(line: str) -> str:
    s = line.lstrip()
    if s.startswith("#"):
        return "heading"
    if s.startswith("|"):
        return "table"
    if s.startswith(">"):
        return "quote"
    if _ITEM.match(line):
        rest = _ITEM.sub("", line, count=1)
        return "links" if _LINK.sub("", rest).strip() == "" and "](" in rest else "list"
    return "text"


def _form(text: str) -> str:
    return _NOT_WORD.sub("", text.lower())


def line_features(line: str, kind: str) -> list[str]:
    """What the classifier sees of a line; features of its form, which count for more, begin with "!"."""
    out = [f"kind {kind}"]
    text = line
    if "](" in line:
        for m in _LINK.finditer(line):
            s = _SEGMENT.match(m.group(2))
            out.append("href " + (s.group(1) + s.group(2) if s and s.group(2) else "/" if s else "other"))
        if kind == "links":
            return out
        text = _LINK.sub(r"\1", line)
    words = WORD.findall(text.lower())
    out += {"#" if w.isdigit() else w for w in words}
    out.append(f"words {min(len(words) // 4, 6)}")
    if words:
        out.append("!start " + words[0])
    if _SPEAKER.match(text):
        out.append("!speaker")
    if text.count(" / ") > 1:
        out.append("!crumbs")
    for mark in "©–|·/":
        if mark in text:
            out.append("mark")
            break
    return out


def line_odds(features: list[str], odds: dict[str, float]) -> float:
    """Bounded log-odds of a line's words, and those of its form."""
    words = form = 0.0
    for f in features:
        w = odds.get(f)
        if w is not None:
            if f[0] == "!":
                form += w
            else:
                words += w
    return max(LOW_ODDS, min(LINE_ODDS, words)) + FORM_WEIGHT * form


def blocks(markdown: str, odds: dict[str, float]) -> list[Block]:
    """The blocks of a page; each list item, table row and quoted line is one, and a fence of code is one."""
    out: list[Block] = []
    kind_before, fence = "", False
    for no, line in enumerate(markdown.split("\n")):
        if not line or line.isspace():
            if not fence:
                kind_before = ""
            continue
        mark = line.lstrip().startswith("```")
        if mark:
            fence = not fence
        kind = "code" if mark or fence else _kind(line)
        size = line.count(" ") + 1
        if kind == kind_before == "code":
            b = out[-1]
            out[-1] = b._replace(last=no, words=b.words + size, form=b.form or _form(_plain(line, kind).lstrip()))
        else:
            score = line_odds(line_features(line, kind), odds) if kind != "code" else WORD_ODDS
            top = kind == "heading" and not line.lstrip().startswith("##")
            out.append(Block(no, no, kind, score, size, "" if mark else _form(_plain(line, kind).lstrip()), top, kind == kind_before and kind not in ("heading", "text")))
        kind_before = kind
    early = odds.get("early", 0.0) * FORM_WEIGHT
    if early:
        top = next((i for i, b in enumerate(out) if b.top), 0)
        out[:top] = [b._replace(odds=b.odds + early) for b in out[:top]]
    return out


def _plain(line: str, kind: str) -> str:
    if kind == "table":
        line = next((c for c in line.split("|") if c.strip()), "")
    if kind in ("links", "list"):
        line = _ITEM.sub("", line, count=1)
    return _LINK.sub(r"\1", line) if "](" in line else line


def place(found: list[Block], tree: list[Leaf]) -> list[Leaf | None]:
    """The leaf of each block, in order; a block without one takes the leaf of the block before."""
    where: dict[str, list[int]] = {}
    for i, leaf in enumerate(tree):
        text = leaf.text.lstrip()
        where.setdefault(_form(text.partition("\n")[0] if leaf.tag == "pre" else text), []).append(i)
    out: list[Leaf | None] = []
    at, before = 0, None
    for b in found:
        places = where.get(b.form) if b.form else None
        i = places[k] if places and (k := bisect_left(places, at)) < len(places) else places[0] if places else None
        if i is not None:
            at, before = i, tree[i]
            out.append(tree[i])
        else:
            out.append(before)
    return out


def prose_region(tree: list[Leaf]) -> int | None:
    """The region of the text: the one with a first-level heading, else the one with most words of prose."""
    weight: dict[int, float] = {}
    for leaf in tree:
        n = 0.0
        if leaf.tag == "h1":
            n = 1000.0
        elif leaf.tag in PROSE_TAGS and not leaf.linked:
            n = float(len(leaf.text.split()))
        weight[leaf.region] = weight.get(leaf.region, 0.0) + n
    return max(weight, key=lambda r: (weight[r], -r)) if weight else None


def region_features(tree: list[Leaf]) -> dict[int, list[str]]:
    """What tells of each region whether it is one of the text; such features begin with "@"."""
    seen: dict[int, list[int]] = {}
    for leaf in tree:
        r = seen.setdefault(leaf.region, [0, 0])
        r[0] |= leaf.tag == "h1"
        r[1] += len(leaf.text.split()) if leaf.tag in PROSE_TAGS and not leaf.linked else 0
    return {k: [f"@h1 {h1}", f"@words {min(words.bit_length(), 9)}"] for k, (h1, words) in seen.items()}


def cut(capacity: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """Minimum cut by maximum flow: True for nodes on the source's side.

    ``capacity`` is a node's edge to the source where positive, to the sink where negative; an edge (a, b, there, back)
    has a capacity each way. Flow is sent from nodes with supply to nodes with demand, along all shortest paths at once.
    """
    n = len(capacity)
    rest = list(capacity)
    to: list[list[int]] = [[] for _ in range(n)]
    left: list[float] = []
    end: list[int] = []
    for a, b, there, back in edges:
        to[a].append(len(left))
        left.append(there)
        end.append(b)
        to[b].append(len(left))
        left.append(back)
        end.append(a)
    tiny = 1e-9
    while True:
        supply = [v for v in range(n) if rest[v] > tiny]
        level = [-1] * n
        for v in supply:
            level[v] = 0
        queue, far = deque(supply), n
        while queue:
            v = queue.popleft()
            if level[v] >= far:
                break
            if rest[v] < -tiny:
                far = level[v]
                continue
            for e in to[v]:
                if left[e] > tiny and level[end[e]] < 0:
                    level[end[e]] = level[v] + 1
                    queue.append(end[e])
        if far == n:
            return [x >= 0 for x in level]
        at = [0] * n  # the edge of each node that is tried next
        for s in supply:
            path: list[int] = []
            v = s
            while rest[s] > tiny:
                if rest[v] < -tiny:
                    flow = min(rest[s], -rest[v], min(left[e] for e in path))
                    for e in path:
                        left[e] -= flow
                        left[e ^ 1] += flow
                    rest[s] -= flow
                    rest[v] += flow
                    path.clear()
                    v = s
                elif at[v] < len(to[v]):
                    e = to[v][at[v]]
                    if left[e] > tiny and level[end[e]] == level[v] + 1:
                        path.append(e)
                        v = end[e]
                    else:
                        at[v] += 1
                elif path:
                    v = end[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break


def is_short(lines: list[str]) -> bool:
    """Whether a page's main lines may be a message only."""
    return sum(line.count(" ") + 1 for line in lines) < LEAST_WORDS


def main_lines(html: str | None, markdown: str | None, odds: dict[str, float]) -> list[int]:
    """The numbers of the non-blank lines that are main body, or a message in place of it."""
    found = blocks(markdown, odds) if markdown else []
    if not found:
        return []
    tree = leaves(html) if html else []
    spots = place(found, tree) if tree else [None] * len(found)
    prose = any(leaf.tag == "p" for leaf in tree)
    told = {k: sum(odds.get(f, 0.0) for f in features) for k, features in region_features(tree).items()}
    capacity: list[float] = []
    edges: list[tuple[int, int, float, float]] = []
    regions: dict[int, int] = {}
    inside: dict[int, list[int]] = {}  # the blocks of each region, and its runs
    for b, leaf in zip(found, spots):
        if leaf is not None:
            count = inside.setdefault(leaf.region, [0, 0])
            count[0] += 1
            count[1] += not b.run
    for i, (b, leaf) in enumerate(zip(found, spots)):
        score = b.odds if leaf is None else max(LOW_ODDS, min(LINE_ODDS, b.odds))
        if b.kind == "links":
            score += LINK if leaf is not None else 0.0
        elif leaf is not None and b.kind not in ("code", "table"):
            score += TITLE if leaf.tag == "h1" else PROSE if leaf.tag in PROSE_TAGS else PLAIN if prose else 0.0
        capacity.append(score)
        if i:
            section = found[i - 1].kind == "heading" and not found[i - 1].top and b.kind != "heading"
            edges.append((i - 1, i, RUN, RUN) if b.run else (i - 1, i, HEADING if section else NEXT, NEXT))
    for i, leaf in enumerate(spots):
        if leaf is not None:
            node = regions.get(leaf.region)
            if node is None:
                node = regions[leaf.region] = len(capacity)
                lines_in, runs_in = inside[leaf.region]
                capacity.append(REGION_OWN * told[leaf.region] * lines_in / max(runs_in, 1))  # as strong against a run, however many lines it has
            edges.append((i, node, REGION, REGION))
    side = cut(capacity, edges)
    kept = [b for b, s in zip(found, side) if s]
    lines = markdown.split("\n")
    return [no for b in kept for no in range(b.first, b.last + 1) if lines[no] and not lines[no].isspace()]


def _labelled(html: str, markdown: str) -> Iterator[tuple[list[str], bool]]:
    """The features of a page's blocks and, by its DOM, whether they are content."""
    tree = leaves(html)
    main = prose_region(tree)
    found = blocks(markdown, {})
    lines = markdown.split("\n")
    spots = place(found, tree)
    good = [leaf is not None and leaf.region == main and (leaf.tag in PROSE_TAGS or b.kind in ("code", "table")) for b, leaf in zip(found, spots)]
    for i in range(len(found) - 2, -1, -1):
        if found[i].kind == "heading" and spots[i] is not None and spots[i].tag != "h1":
            good[i] = good[i] and good[i + 1]
    if is_short([line for b, g in zip(found, good) if g for line in lines[b.first : b.last + 1]]):
        return  # a message or a short body: the page alone doesn't tell
    for region, features in region_features(tree).items():
        yield ["@", *features], region == main
    top = next((i for i, b in enumerate(found) if b.top), 0)
    held: list[str] = []  # a list of links counts once, with all of its links, else menus outweigh the lines of words
    for i, (b, g) in enumerate(zip(found, good)):
        if b.kind != "code":
            held += line_features(lines[b.first], b.kind) + ["early"] * (i < top)
            if b.kind != "links" or i + 1 == len(found) or not found[i + 1].run or good[i + 1] != g:
                yield held, g
                held = []


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for html, markdown in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for features, good in _labelled(html, markdown):
                for f in {"", *features} if features[0] != "@" else features:
                    counts.setdefault(f, [0, 0])[not good] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], names=["feature", "good", "bad"])


def fit_odds(page_content: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds of features, from about ``sample_pages`` pages chosen by a hash of page_id over the whole table."""
    both = page_content.select("page_id", "raw_html", "raw_markdown").where("raw_html is not null and raw_markdown is not null")
    every = max(1, page_content.select("page_id").count() // sample_pages)
    sample = both.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("raw_html", "raw_markdown").limit(2 * sample_pages)
    counted = sample.mapInArrow(_feature_counts, "feature string, good bigint, bad bigint").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = counted.where(F.col("good") + F.col("bad") >= LEAST_COUNT).collect()  # features of a bounded sample
    total = {r.feature: (r.good, r.bad) for r in rows if r.feature in ("", "@")}
    odds: dict[str, float] = {}
    for r in rows:
        if r.feature not in total:
            good, bad = total["@" if r.feature[0] == "@" else ""]
            most = REGION_ODDS if r.feature[0] == "@" else WORD_ODDS
            odds[r.feature] = max(-most, min(most, math.log((r.good + 0.5) / (good + 1)) - math.log((r.bad + 0.5) / (bad + 1))))
    return odds


_KEPT = "page_id bigint, lines array<int>, short boolean, forms array<string>, terms string"


def main_body(page_content: DataFrame, pages: DataFrame | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, line_no) of the non-blank lines of raw_markdown that are main body.

    Lines are the pieces between line feeds, numbered from 0. A page with null or empty Markdown has none; one with null
    HTML is judged by its Markdown. Repeated rows repeat; an empty table gives no row. ``pages`` gives the addresses by
    which messages are told from short bodies; without it, or an address there, repeated lines tell them.
    """
    spark = page_content.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(fit_odds(page_content, sample_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = sent.value
        for batch in batches:
            kept, short, forms, terms = [], [], [], []
            for html, markdown in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept.append(main_lines(html, markdown, odds))
                every = markdown.split("\n")
                lines = [every[no] for no in kept[-1]]
                short.append(is_short(lines))
                forms.append([_form(line) for line in lines] if short[-1] else None)
                terms.append(terms_of("\n".join([title_of(html or ""), *lines])) if short[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(short), pa.array(forms, pa.list_(pa.string())), pa.array(terms, pa.string())], names=["page_id", "lines", "short", "forms", "terms"])

    kept = cut_lineage(page_content.select("page_id", "raw_html", "raw_markdown").where("raw_markdown is not null and page_id is not null").mapInArrow(run, _KEPT).where("size(lines) > 0"))
    low = kept.where("short").select("page_id", "forms", "terms")
    if pages is None:
        low = low.withColumn("named", F.expr("cast(array() as array<string>)"))
    else:
        low = low.join(addresses(pages).select("page_id", "named"), "page_id", "left").withColumn("named", F.coalesce("named", F.expr("cast(array() as array<string>)")))
    strange = low.where(F.size(F.filter("named", lambda t: F.contains(F.col("terms"), F.concat(F.lit(" "), t)))) < TERMS_PART * F.size("named")).select("page_id")
    form = low.select("page_id", F.explode(F.array_distinct("forms")).alias("form")).distinct()
    often = form.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= MESSAGE_PAGES).select("form")
    rare = form.join(often, "form", "left_anti").select("page_id")
    messages = strange.unionByName(low.where(F.size("named") == 0).select("page_id").join(rare, "page_id", "left_anti"))
    return kept.where("not short").select("page_id", F.explode("lines").alias("line_no")).unionByName(kept.where("short").join(messages, "page_id", "left_anti").select("page_id", F.explode("lines").alias("line_no")))
