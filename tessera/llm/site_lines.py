"""Problem 2: lines repeated across the documents of one source.

Each line becomes an identifier, the hash of its source and form; a page becomes the sequence of its identifiers.
The pages of a source are brought together and concatenated, each page ending in a separator of its own, and a
suffix array is built by prefix doubling. Suffixes with a common prefix are neighbours in it: an interval of them, as long as
their longest common prefix, is a block of consecutive lines that occurs at each of its places. One pass over the array finds all
intervals and the distinct pages of each. A block is reported when it can't be lengthened at either end without losing an
occurrence; blocks that span enough pages are deleted wherever they occur. Every line on enough pages lies in such a
block, of one line at least, so the blocks decide.

A source with more lines than an array should have is cut into chunks by page. Chunks hold different pages, so what the first
lines of their suffixes have in pages adds up exactly, and so the lines of such a source are deleted by it. Longer blocks don't add
up, since a chunk may have a block only as a part of a longer one. So the suffixes of such a source are brought together by their
first line instead, whatever page they are of, sorted by their next lines and read once in that order, which gives the same intervals as
one array over all its pages. Only lines on enough pages are kept for it, as no other can lie in a block, and a suffix ends where
one was left out. It shows a number of lines at first; where these are shared and more follow, suffixes are brought together again
by all lines so far and show twice as many. A line that follows itself is shown once with its number. The identifiers carry the source, so small sources share an array. Lines are taken as
equal when 64-bit hashes within one source are, and the lines so far when a 64-bit hash of them is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textscan import JVM_NOT_WORD, mix
from tessera.operators.joins import split_join
from tessera.session import bound_batches, cut

LEAST_PAGES, LEAST_CHARS = 6, 8
#: Lines of one suffix array, about: a source with more is cut into chunks, smaller ones share an array.
ARRAY_LINES = 200_000
#: Lines that a suffix of a larger source shows at first, and identifiers sent or compared at once there. Results don't depend on them.
WINDOW, AT_ONCE = 16, 1 << 20


def line_form(line: Column) -> Column:
    """A line's form: links become their text, lower case, digit runs become 0, only letters and digits stay."""
    text = F.lower(F.regexp_replace(line, r"\[([^\[\]]*)\]\([^)]*\)", "$1"))
    return F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", "0"), JVM_NOT_WORD, "")


def line_ids(markdown: Column, source: Column) -> Column:
    """The identifiers of a page's lines, in order; 0 for forms that don't count."""

    def one(line: Column) -> Column:
        return F.transform(F.array(line_form(line)), lambda f: F.when(F.length(f) >= LEAST_CHARS, F.xxhash64(source, f)).otherwise(F.lit(0)))[0]

    return F.transform(F.split(markdown, "\n"), one)


def suffix_array(ids: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of pages' line identifiers, in page order, and the common prefix of each suffix with the one before.

    A page's end is a symbol of its own, so that no common prefix crosses it.
    """
    ends = np.flatnonzero(np.r_[pages[1:] != pages[:-1], True])
    symbols = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    text = np.insert(symbols, ends + 1, symbols.max() + 1 + np.arange(len(ends)))
    n = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while levels[-1].max() < n - 1:
        rank = levels[-1]
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        levels.append(np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(levels[-1])
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 2, -1, -1):  # all suffixes differ at the last level
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[same] += 1 << k
        b[same] += 1 << k
        common[1:][same] += 1 << k
    return order, common


def intervals(common: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """(length, first, last, pages) of each interval of a suffix array that spans at least ``least`` pages.

    ``common`` has the common prefix of each suffix with the one before, ``pages`` the page of each. A stack holds the open intervals.
    A suffix counts one page, less one in the smallest interval that it shares with the page's suffix before.
    """
    out: list[tuple[int, int, int, int]] = []
    depths, lefts, counts = [0], [0], [0]
    last = [-1] * (int(pages.max()) + 1)
    shared, of = common.tolist(), pages.tolist()
    for i in range(len(of)):
        depth = shared[i] if i else 0
        if i:
            n, left = 1, i - 1
            while depths[-1] > depth:
                d = depths.pop()
                left = lefts.pop()
                n += counts.pop()
                if n >= least:
                    out.append((d, left, i - 1, n))
            if depths[-1] == depth:
                counts[-1] += n
            else:
                depths.append(depth)
                lefts.append(left)
                counts.append(n)
        page = of[i]
        before = last[page]
        if before >= 0:
            counts[bisect_right(lefts, before) - 1] -= 1
        last[page] = i
    n = 1
    while len(depths) > 1:
        d, left = depths.pop(), lefts.pop()
        n += counts.pop()
        if n >= least:
            out.append((d, left, len(of) - 1, n))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def block_keys(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the ``lengths`` lines from each place on, the same wherever they stand."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(ids)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)])
    back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(int(base), -1, 1 << 64), dtype=np.uint64)])
    upto = np.r_[np.uint64(0), np.cumsum(mix(ids.view(np.uint64)) * power[:n], dtype=np.uint64)]
    return mix((upto[at + lengths] - upto[at]) * back[at] + lengths.astype(np.uint64)).view(np.int64)


class Lines:
    """The suffix array of pages' line identifiers: ``ids`` without 0, and the page index of each, in page order."""

    def __init__(self, ids: np.ndarray, pages: np.ndarray) -> None:
        self.ids, self.pages = ids, pages
        order, common = suffix_array(ids, pages)
        ends = np.flatnonzero(np.r_[pages[1:] != pages[:-1], True])
        line_at = np.full(len(order), -1, dtype=np.int64)
        line_at[np.arange(len(ids)) + np.searchsorted(ends, np.arange(len(ids)))] = np.arange(len(ids))
        self.order, self.common = line_at[order[: len(ids)]], common[: len(ids)]  # separators sort last

    def blocks(self, least: int) -> np.ndarray:
        """(length, first, last, pages) of the blocks on at least ``least`` pages that no line on either side always goes with."""
        found = intervals(self.common, self.pages[self.order], least)
        found = found[found[:, 0] > 0]
        starts = np.r_[True, self.pages[1:] != self.pages[:-1]]
        before = np.where(starts, -1 - np.arange(len(self.ids)), np.r_[0, np.unique(self.ids, return_inverse=True)[1][:-1]])[self.order]
        changes = np.cumsum(np.r_[False, before[1:] != before[:-1]])
        return found[changes[found[:, 2]] > changes[found[:, 1]]]

    def covered(self, blocks: np.ndarray) -> np.ndarray:
        """Which lines lie in an occurrence of a block."""
        length = np.zeros(len(self.ids), dtype=np.int64)
        for d, first, last, _ in blocks[np.argsort(blocks[:, 0], kind="stable")].tolist():  # longer ones lie inside shorter ones
            length[first : last + 1] = d
        inside = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(inside, self.order, 1)
        np.subtract.at(inside, self.order + length, 1)
        return np.cumsum(inside)[:-1] > 0

    def first_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Each line that a suffix begins with, and its distinct pages."""
        run = np.cumsum(self.common < 1) - 1
        run -= run[0] if len(run) else 0
        pages = int(self.pages.max()) + 1
        pairs = np.sort(run * pages + self.pages[self.order])
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        return self.ids[self.order[first]], np.bincount(pairs // pages, minlength=len(first))

    def keys(self, blocks: np.ndarray) -> np.ndarray:
        """A hash of each block's lines, the same in every array."""
        return block_keys(self.ids, self.order[blocks[:, 1]], blocks[:, 0])


def _arrays(report: Callable[[Lines, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]):
    """Builds arrays of whole chunks from rows (site, chunk, page_id, ids) in order of site and chunk, and reports on each.

    ``report`` gets an array and, for each of its lines, the site, the page and the number of the line.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sites, pages, lengths, flat = (np.concatenate(x) for x in zip(*held))
        keep = flat != 0
        if not keep.any():
            return
        index = np.repeat(np.arange(len(lengths)), lengths)[keep]
        number = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[keep]
        columns = report(Lines(flat[keep], np.unique(index, return_inverse=True)[1]), sites[index], pages[index], number.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        lines, before = 0, None
        for batch in batches:
            site, chunk, page = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            ids, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            cuts = [0, *(np.flatnonzero((site[1:] != site[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if lines >= ARRAY_LINES and before != (site[a], chunk[a]):
                    yield from flush(held)
                    held, lines = [], 0
                held.append((site[a:b], page[a:b], np.diff(offsets[a : b + 1]), ids[offsets[a] : offsets[b]]))
                lines += int(offsets[b] - offsets[a])
                before = (site[b - 1], chunk[b - 1])
        if held:
            yield from flush(held)

    return run


def _report_lines(least: int):
    def report(array: Lines, site: np.ndarray, page: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        hit = array.covered(array.blocks(least))
        return [page[hit], number[hit]]

    return report


def _report_counts(array: Lines, site: np.ndarray, page: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    line, pages = array.first_lines()
    of = np.argsort(array.ids, kind="stable")
    return [site[of[np.searchsorted(array.ids, line, sorter=of)]], line, pages]


def _report_blocks(least: int):
    def report(array: Lines, site: np.ndarray, page: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        found = array.blocks(least)
        at = np.array([array.order[a : b + 1].min() for _, a, b, _ in found.tolist()], dtype=np.int64)  # the first occurrence
        return [site[at], page[at], number[at], found[:, 0], found[:, 3]]

    return report


class Starts:
    """Suffixes of a batch of pages (site, page_id, i, line_no, line, at): those at ``at`` that have more than ``depth`` lines.

    ``i`` numbers a page's lines as they were before some were left out: a suffix ends where it jumps, and at the page's end.
    ``key`` is a hash of the first ``depth`` + 1 lines.
    """

    def __init__(self, batch: pa.RecordBatch, depth: int) -> None:
        site, page = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        i, number, self.lines, at = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 6))
        offsets, marks = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(5).offsets.to_numpy()
        index = np.repeat(np.arange(len(page)), np.diff(offsets))
        breaks = np.r_[True, (index[1:] != index[:-1]) | (i[1:] != i[:-1] + 1)][: len(i)]
        end = np.r_[np.flatnonzero(breaks)[1:], len(i)][np.cumsum(breaks) - 1]
        heads = breaks | np.r_[True, self.lines[1:] != self.lines[:-1]][: len(i)]
        self.heads, self.stretch = np.r_[np.flatnonzero(heads), len(i)], np.cumsum(heads) - 1  # stretches of one line that follows itself
        at = at + np.repeat(offsets[:-1] - offsets[0], np.diff(marks))
        at = at[end[at] - at > depth]
        self.at, self.end, self.own = at, end[at], at - (offsets[:-1] - offsets[0])[index[at]]
        self.site, self.page, self.number = site[index[at]], page[index[at]], number[at]
        self.key = block_keys(self.lines, at, np.full(len(at), depth + 1)) if depth else self.lines[at]
        self.before = pa.array(self.lines[at - 1], mask=breaks[at])
        order = np.lexsort((self.key, index[at]))
        same = (index[at][order][1:] == index[at][order][:-1]) & (self.key[order][1:] == self.key[order][:-1])
        self.first, self.again = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
        self.first[order[1:]] = ~same
        self.again[order] = np.r_[same, False][: len(at)] | np.r_[False, same][: len(at)]


def _keys(depth: int):
    """(site, key, page_id, at, before, first) of each suffix; ``first`` is 1 for one of those that a page has of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = Starts(batch, depth)
            columns = [x.site, x.key, x.page, x.own.astype(np.int32), x.before, x.first.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["site", "key", "page_id", "at", "before", "first"])

    return run


def _windows(depth: int, width: int, at_once: int):
    """(site, key, page_id, line_no, before, again, lines) of each suffix, with the up to ``width`` lines after those of the key.

    ``lines`` has each line and how often it follows itself, in turn; a common beginning is still shared by neighbours in its order. ``again`` tells that the page has more suffixes with that key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = Starts(batch, depth)
            start = x.at + depth + 1
            stop = np.minimum(x.end, start + width)
            head = x.stretch[np.minimum(start, len(x.lines) - 1)]
            upto = np.r_[0, np.cumsum(np.where(stop > start, x.stretch[stop - 1] - head + 1, 0))]
            a = 0
            while a < len(start):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + at_once, side="right")) - 1)
                offsets = upto[a : b + 1] - upto[a]
                of = np.repeat(np.arange(a, b), np.diff(offsets))
                each = head[of] + np.arange(offsets[-1]) - offsets[of - a]
                times = np.minimum(x.heads[each + 1], stop[of]) - np.maximum(x.heads[each], start[of])
                taken = np.column_stack((x.lines[x.heads[each]], times)).ravel()
                columns = [pa.array(c[a:b]) for c in (x.site, x.key, x.page, x.number)] + [x.before[a:b], pa.array(x.again[a:b])]
                columns.append(pa.ListArray.from_arrays(pa.array((2 * offsets).astype(np.int32)), pa.array(taken)))
                yield pa.RecordBatch.from_arrays(columns, names=["site", "key", "page_id", "line_no", "before", "again", "lines"])
                a = b

    return run


def common_lines(rows: list[np.ndarray], at_once: int) -> np.ndarray:
    """How many lines each row but the first, of lines and how often they follow themselves, has in common with the row before."""
    lengths = np.array([len(r) for r in rows])
    step = max(1, at_once // max(1, int(lengths.max())))
    out = []
    for a in range(0, len(rows) - 1, step):
        some, n = rows[a : a + step + 1], lengths[a : a + step + 1]
        width = int(n.max())
        table = np.zeros((len(some), width + 1), dtype=np.int64)
        table[np.arange(width + 1) < n[:, None]] = np.concatenate(some)
        differ = table[1:] != table[:-1]
        differ[:, width] = True
        k = np.arange(len(some) - 1)
        at = np.minimum(differ.argmax(axis=1), np.minimum(n[1:], n[:-1]))
        whole = np.c_[np.zeros(len(k), dtype=np.int64), np.cumsum(table[1:, 1:width:2], axis=1)][k, at // 2]
        out.append(whole + np.where(at % 2 == 1, np.minimum(table[1:][k, at], table[:-1][k, at]), 0))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class OpenIntervals:
    """``intervals`` of one key over sorted suffixes that come one by one, with the line before and the first place of each.

    A line before is None where there is none or they differ. Holds the open intervals, and pages only of suffixes that have the key again.
    """

    def __init__(self, least: int, report: Callable[[int, int, tuple], None]) -> None:
        self.least, self.report = least, report
        self.clear()

    def clear(self) -> None:
        self.seen = 0
        self.depths, self.lefts, self.counts, self.befores, self.places = [0], [0], [0], [None], [()]
        self.last: dict = {}

    def close(self, depth: int) -> None:
        """The last suffix has ``depth`` lines in common with the next one; intervals of more end with it."""
        n, left, before, place = 1, self.seen - 1, self.before, self.place
        while self.depths[-1] > depth:
            d, left = self.depths.pop(), self.lefts.pop()
            n += self.counts.pop()
            if (other := self.befores.pop()) != before:
                before = None
            place = min(place, self.places.pop())
            if n >= self.least and before is None:
                self.report(d, n, place)
        if not depth:
            self.clear()
        elif self.depths[-1] == depth:
            self.counts[-1] += n
            if self.befores[-1] != before:
                self.befores[-1] = None
            self.places[-1] = min(self.places[-1], place)
        else:
            for of, x in zip((self.depths, self.lefts, self.counts, self.befores, self.places), (depth, left, n, before, place)):
                of.append(x)

    def add(self, depth: int, before: int | None, place: tuple, again: bool) -> None:
        """``depth`` is what the suffix has in common with the last one, 0 for another key."""
        if self.seen:
            self.close(depth)
        if again:
            if (page := self.last.get(place[0])) is not None:
                self.counts[bisect_right(self.lefts, page) - 1] -= 1
            self.last[place[0]] = self.seen
        self.before, self.place = before, place
        self.seen += 1


def _sorted_blocks(depth: int, width: int, least: int, at_once: int):
    """Blocks of more than ``depth`` and at most ``depth`` + ``width`` lines, from the rows of ``_windows`` in order of site, key and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        site = key = None

        def report(d: int, n: int, place: tuple) -> None:
            if d <= width:  # longer ones show as blocks of the next depth
                out.append((site, *place, depth + d, n))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["site", "page_id", "line_no", "n_lines", "n_pages"])

        opened = OpenIntervals(least, report)
        last = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            flat, offsets = batch.column(6).flatten().to_numpy(zero_copy_only=False), batch.column(6).offsets.to_numpy()
            rows = [last, *np.split(flat, offsets[1:-1] - offsets[0])]
            common = common_lines(rows, at_once).tolist()
            last = rows[-1].copy()
            for s, k, page, number, before, again, c in zip(*(batch.column(k).to_pylist() for k in range(6)), common):
                depth_here = 1 + c if s == site and k == key else 0
                if not depth_here and opened.seen:
                    opened.close(0)
                site, key = s, k
                opened.add(depth_here, before, (page, number), again)
            if out:
                yield taken()
        if opened.seen:
            opened.close(0)
        yield taken()

    return run


def page_lines(page_content: DataFrame, pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """(page_id, source, ids) of each page that has Markdown and a source, the crawl's domain in lower case."""
    domains = crawls.select(F.col("id").alias("crawl_id"), F.lower("target_domain").alias("source"))
    sources = pages.select(F.col("id").alias("page_id"), "crawl_id").join(domains, "crawl_id").where("source is not null").select("page_id", "source")
    # identifiers first, so that the join moves eight bytes a line and not the text; the source enters afterwards
    forms = page_content.select("page_id", line_ids(F.col("raw_markdown"), F.lit("")).alias("forms")).where("forms is not null")
    return forms.join(sources, "page_id").select("page_id", "source", F.transform("forms", lambda f: F.when(f == 0, f).otherwise(F.xxhash64("source", f))).alias("ids"))


def _chunked(page_content: DataFrame, pages: DataFrame, crawls: DataFrame, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """(source, site, chunk, page_id, ids) of the pages of sources that fit one array, and of those of larger ones."""
    if least_pages < 2:
        raise ValueError("a line is repeated on two pages at least")
    bound_batches(page_content.sparkSession)
    lines = cut(page_lines(page_content, pages, crawls))
    sizes = lines.groupBy("source").agg(F.ceil(F.sum(F.size("ids")) / ARRAY_LINES).alias("chunks"))
    placed = split_join(lines, sizes, ["source"]).withColumns({"site": F.xxhash64("source"), "chunk": F.pmod(F.xxhash64("page_id"), "chunks")})
    columns = ["source", "site", "chunk", "page_id", "ids"]
    return placed.where("chunks <= 1").select(*columns), placed.where("chunks > 1").select(*columns)


def _together(chunked: DataFrame) -> DataFrame:
    return chunked.select("site", "chunk", "page_id", "ids").repartition("site", "chunk").sortWithinPartitions("site", "chunk", "page_id")


def repeated_lines(page_content: DataFrame, pages: DataFrame, crawls: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, line_no) of each line whose form occurs on at least ``least_pages`` different pages of its domain.

    Pages without Markdown, crawl or domain take no part. A form counts once a page, however often it stands
    there; forms of fewer than LEAST_CHARS characters don't count. Lines are the pieces between line feeds,
    numbered from 0. Empty tables give no row. Page ids are unique in ``page_content``.
    """
    small, large = _chunked(page_content, pages, crawls, least_pages)
    found = _together(small).mapInArrow(_arrays(_report_lines(least_pages), ["page_id", "line_no"]), "page_id bigint, line_no int")
    each = large.select("page_id", "site", F.posexplode("ids").alias("line_no", "line")).where("line != 0")
    return found.unionByName(_on_enough_pages(each, large, least_pages).select("page_id", "line_no"))


def _on_enough_pages(each: DataFrame, large: DataFrame, least_pages: int) -> DataFrame:
    """The rows (site, line) of ``each`` whose line stands on enough pages of its source."""
    counts = _together(large).mapInArrow(_arrays(_report_counts, ["site", "line", "n_pages"]), "site bigint, line bigint, n_pages bigint")
    repeated = counts.groupBy("site", "line").agg(F.sum("n_pages").alias("n_pages")).where(F.col("n_pages") >= least_pages).select("site", "line")
    return split_join(each, repeated, ["site", "line"], "left_semi")


def _blocks_of_large(large: DataFrame, least_pages: int) -> list[DataFrame]:
    """(site, page_id, line_no, n_lines, n_pages) of the blocks of sources that are larger than an array, by their length."""
    lines = F.filter(F.transform("ids", lambda x, no: F.struct(no.alias("line_no"), x.alias("line"))), lambda x: x["line"] != 0)
    each = large.select("page_id", "site", F.posexplode(lines).alias("i", "x")).select("page_id", "site", "i", "x.line_no", "x.line")
    pages = _on_enough_pages(each, large, least_pages).groupBy("site", "page_id").agg(F.sort_array(F.collect_list(F.struct("i", "line_no", "line"))).alias("x"))  # bounded by the page
    starts = cut(pages.select("site", "page_id", "x.i", "x.line_no", "x.line", F.sequence(F.lit(0), F.size("x") - 1).alias("at")))
    depth, width, parts = 0, WINDOW, []
    while not starts.isEmpty():
        rows = starts.mapInArrow(_windows(depth, width, AT_ONCE), "site bigint, key bigint, page_id bigint, line_no int, before bigint, again boolean, lines array<bigint>")
        rows = rows.repartition("site", "key").sortWithinPartitions("site", "key", "lines")
        parts.append(rows.mapInArrow(_sorted_blocks(depth, width, least_pages, AT_ONCE), "site bigint, page_id bigint, line_no int, n_lines bigint, n_pages bigint"))
        depth, width = depth + width, 2 * width
        # those that go on, on enough pages; if the same line is before all of a key, no block begins there, however long
        keys = starts.mapInArrow(_keys(depth), "site bigint, key bigint, page_id bigint, at int, before bigint, first bigint")
        alive = keys.groupBy("site", "key").agg(F.sum("first").alias("n"), F.count(F.lit(1)).alias("m"), F.count("before").alias("b"), F.min("before").alias("low"), F.max("before").alias("high"))
        alive = alive.where((F.col("n") >= least_pages) & ((F.col("b") < F.col("m")) | (F.col("low") != F.col("high")))).select("site", "key")
        at = split_join(keys, alive, ["site", "key"], "left_semi").groupBy("site", "page_id").agg(F.collect_list("at").alias("at"))
        starts = cut(starts.drop("at").join(at, ["site", "page_id"]))
    return parts


def repeated_blocks(page_content: DataFrame, pages: DataFrame, crawls: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(source, page_id, line_no, n_lines, n_pages) of the blocks of lines that stand on at least ``least_pages`` pages of a domain.

    A block is a run of lines that count, consecutive but for those that don't; it is given where it first occurs, by page and line. No line before
    or after goes with all its occurrences, else the longer block is given in its place. Lines, pages and empty tables as in ``repeated_lines``.
    """
    small, large = _chunked(page_content, pages, crawls, least_pages)
    columns = ["site", "page_id", "line_no", "n_lines", "n_pages"]
    both = _together(small).mapInArrow(_arrays(_report_blocks(least_pages), columns), "site bigint, page_id bigint, line_no int, n_lines bigint, n_pages bigint")
    for part in _blocks_of_large(large, least_pages):
        both = both.unionByName(part)
    names = small.select("site", "source").unionByName(large.select("site", "source")).distinct()
    return both.join(names, "site").select("source", "page_id", "line_no", "n_lines", "n_pages")


def without_lines(page_content: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, text, removed): each page's Markdown without the lines found; null Markdown stays null."""
    drop = found.groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))  # a page's own lines: bounded by the page
    joined = page_content.select("page_id", "raw_markdown").join(drop, "page_id", "left").withColumn("drop", F.coalesce("drop", F.expr("cast(array() as array<int>)")))
    kept = F.filter(F.split("raw_markdown", "\n"), lambda line, i: ~F.array_contains(F.col("drop"), i))
    return joined.select("page_id", F.array_join(kept, "\n").alias("text"), F.size("drop").alias("removed"))
