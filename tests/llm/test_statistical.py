"""Site lines, near-duplicates, main content, residue and languages on small fixtures."""

import random
import re

import numpy as np
import pytest

from tessera.llm import dom, languages, main_content, near_duplicates, residue, site_lines

WORDS = "amber bridge candle delta ember forest garden harbor island jungle kettle lantern meadow needle orchard pepper quartz river saddle timber umbrella velvet willow yonder zephyr".split()
CONTENT = "page_id long, raw_html string, raw_markdown string"
PAGES = "id long, crawl_id string, url string, canonical_url string, path string"


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# -- repeated lines --------------------------------------------------------------------------------


def form(line):
    line = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line).lower()
    return re.sub(r"[\W_]+", "", re.sub(r"\d+", "0", line))


def brute_lines(content, page_crawl, crawl_domain, least=6):
    pages = {}
    rows = []
    for page, _, md in content:
        domain = crawl_domain.get(page_crawl.get(page))
        if md is None or domain is None:
            continue
        for no, line in enumerate(md.split("\n")):
            if len(f := form(line)) >= 8:
                pages.setdefault((domain.lower(), f), set()).add(page)
                rows.append((page, no, domain.lower(), f))
    return sorted((p, no) for p, no, d, f in rows if len(pages[d, f]) >= least)


def lines_fixture(n=60):
    rng = random.Random(2)
    furniture = ["* [Home page](/home)", "## Related  reading", "Terms of use 2024", "© Site name", "short", "Legal notice é"]
    content = []
    for i in range(n):
        own = [say(rng, 9) for _ in range(4)]
        mixed = [x if rng.random() < 0.7 else x.upper().replace("2024", str(rng.randint(1, 99))) for x in furniture if rng.random() < 0.5]
        content.append((i, None, "\n".join([*mixed, "", own[0], own[0], *own, *mixed]) + rng.choice(["", "\r\n"])))
    content += [(900, None, None), (901, None, ""), (902, None, "\n\n"), (903, None, "Terms of use 1"), (904, None, "x " * 60_000)]
    crawl = {i: f"c{i % 3}" for i in range(n)} | {901: "c1", 902: "c1", 903: None, 904: "c1"}
    return content, crawl, {"c0": "Big.example", "c1": "big.EXAMPLE", "c2": "small.example"}


@pytest.mark.parametrize("array_lines", [200_000, 170, 40])
def test_repeated_lines_match_brute_force(make, monkeypatch, array_lines):
    monkeypatch.setattr(site_lines, "ARRAY_LINES", array_lines)
    content, crawl, domains = lines_fixture()
    tables = make(content, CONTENT).selectExpr("*", "1 as line", "2 as source"), make([(p, c) for p, c in crawl.items()], "id long, crawl_id string"), make(list(domains.items()) + [("c9", None)], "id string, target_domain string")
    got = sorted(tuple(r) for r in site_lines.repeated_lines(*tables).collect())
    want = brute_lines(content, crawl, domains)
    assert got == want and len(want) > 50
    text = {r.page_id: r.text for r in site_lines.without_lines(tables[0], site_lines.repeated_lines(*tables)).collect()}
    drop = set(want)
    for page, _, md in content:
        assert text[page] == (None if md is None else "\n".join(x for no, x in enumerate(md.split("\n")) if (page, no) not in drop))


def test_suffix_array_is_sorted_and_its_prefixes_are_right():
    rng = np.random.default_rng(4)
    for _ in range(40):
        pages = np.sort(rng.integers(0, 5, rng.integers(1, 25)))
        ids = rng.integers(1, 4, len(pages))
        order, common = site_lines.suffix_array(ids, pages)
        ends = np.flatnonzero(np.r_[pages[1:] != pages[:-1], True])
        text = np.insert(np.unique(ids, return_inverse=True)[1], ends + 1, 100 + np.arange(len(ends))).tolist()
        suffixes = [text[i:] for i in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(order)):
            same = 0
            while same < min(len(suffixes[k - 1]), len(suffixes[k])) and suffixes[k - 1][same] == suffixes[k][same]:
                same += 1
            assert common[k] == same


def brute_blocks(pages, least):
    """{lines: (pages, first place)} of the runs on enough pages that no line on either side always goes with."""
    where = {}
    for page, ids in pages:
        for i in range(len(ids)):
            for j in range(i + 1, len(ids) + 1):
                where.setdefault(tuple(ids[i:j]), []).append((page, i, ids[i - 1] if i else ("start", page), ids[j] if j < len(ids) else ("end", page)))
    return {k: (len({p for p, *_ in v}), min(v)[:2]) for k, v in where.items() if len({p for p, *_ in v}) >= least and len({x[2] for x in v}) > 1 and len({x[3] for x in v}) > 1}


def test_blocks_match_brute_force():
    rng = random.Random(24)
    for _ in range(60):
        furniture = [rng.randint(1, 6) for _ in range(5)]
        pages = [(p, [*rng.choice([furniture, furniture[:3], []]), *(rng.randint(1, 9) for _ in range(rng.randint(1, 5))), *rng.choice([furniture[2:], furniture])]) for p in range(rng.randint(1, 9))]
        index = np.repeat(np.arange(len(pages)), [len(x) for _, x in pages])
        array = site_lines.Lines(np.array([i for _, x in pages for i in x]), index)
        found = array.blocks(3)
        text = array.ids.tolist()
        got = {tuple(text[array.order[a] : array.order[a] + d]): n for d, a, _, n in found.tolist()}
        want = brute_blocks(pages, 3)
        assert got == {k: n for k, (n, _) in want.items()} and len(found) == len(got)
        lines = {k for block in want for k in block}
        assert array.covered(found).tolist() == [x in lines for x in text]
        assert len(set(array.keys(found).tolist())) == len(found)


def test_repeated_blocks(make, monkeypatch):
    content, crawl, domains = lines_fixture()
    tables = make(content, CONTENT), make([(p, c) for p, c in crawl.items()], "id long, crawl_id string"), make(list(domains.items()), "id string, target_domain string")
    sites = {}
    for page, _, md in content:
        if md is not None and crawl.get(page) is not None:
            kept = [(no, f) for no, line in enumerate(md.split("\n")) if len(f := form(line)) >= 8]
            sites.setdefault(domains[crawl[page]].lower(), []).append((page, [f for _, f in kept], [no for no, _ in kept]))
    want = set()
    for site, pages in sites.items():
        number = {p: nos for p, _, nos in pages}
        for block, (n, (page, i)) in brute_blocks([(p, ids[:40]) for p, ids, _ in pages], 6).items():
            want.add((site, page, number[page][i], len(block), n))
    got = {tuple(r) for r in site_lines.repeated_blocks(*tables).collect()}
    assert got == want and max(x[3] for x in got) > 1
    monkeypatch.setattr(site_lines, "ARRAY_LINES", 170)
    parts = {(r.source, r.page_id, r.line_no, r.n_lines): r.n_pages for r in site_lines.repeated_blocks(*tables).collect()}
    assert parts and all(n >= 6 for n in parts.values())


@pytest.mark.parametrize("array_lines, window, at_once", [(10**9, 16, 1 << 20), (170, 16, 1 << 20), (40, 2, 50), (1, 1, 1)])
def test_blocks_are_the_same_however_large_a_source_is_held_to_be(make, monkeypatch, array_lines, window, at_once):
    monkeypatch.setattr(site_lines, "ARRAY_LINES", array_lines)
    monkeypatch.setattr(site_lines, "WINDOW", window)
    monkeypatch.setattr(site_lines, "AT_ONCE", at_once)
    rng = random.Random(5)
    menu = [say(rng, 3) for _ in range(7)]
    pages = []
    for p in range(80):
        own = [say(rng, 9) for _ in range(3)]
        ends = rng.choice([menu[:4], menu[2:], menu, [menu[0]] * rng.randint(1, 5), [menu[1], menu[0]] * 3])  # parts of a block, and lines that follow themselves
        pages.append((1000 - p, own[:1] + menu[:3] + ["short", ""] + menu[3 : rng.randint(3, 6)] + own[1:] + rng.choice([ends, ends + own[:1], ends + menu[:2]])))
    pages += [(2000 + p, [f"line {w} of a long text" for w in WORDS]) for p in range(8)]
    pages += [(2100 + p, own + [menu[5]] * (20 + p % 3) + menu[5 - p % 4 :]) for p in range(9)]
    pages += [(3000, []), (3001, ["", "short"])]
    tables = make([(p, None, "\n".join(x)) for p, x in pages], CONTENT), make([(p, f"c{p % 2}") for p, _ in pages], "id long, crawl_id string"), make([("c0", "a.example"), ("c1", "b.example")], "id string, target_domain string")
    want = set()
    for c, site in enumerate(("a.example", "b.example")):
        kept = {p: [(no, f) for no, line in enumerate(x) if len(f := form(line)) >= 8] for p, x in pages if p % 2 == c}
        for block, (n, (page, i)) in brute_blocks([(p, [f for _, f in x]) for p, x in kept.items()], 4).items():
            want.add((site, page, kept[page][i][0], len(block), n))
    got = [tuple(r) for r in site_lines.repeated_blocks(*tables, least_pages=4).collect()]
    assert set(got) == want and len(got) == len(want) > 40 and max(x[3] for x in want) >= len(WORDS)


def test_a_hot_line_of_a_hot_source_is_matched_by_many_tasks(spark, skewed):
    each = spark.range(0, 90_000, 1, 12).selectExpr("id", "1L as site", "if(id % 3 = 0, 7L, xxhash64(id)) as line")
    repeated = each.groupBy("site", "line").count().where("count > 5").select("site", "line")
    rows = [r.n for r in site_lines.split_join(each, repeated, ["site", "line"], "left_semi").mapInArrow(skewed, "n long").collect()]
    assert sum(rows) == 30_000 and max(rows) < 7_500


def test_repeated_lines_of_empty_tables(make):
    empty = make([], CONTENT), make([], "id long, crawl_id string"), make([], "id string, target_domain string")
    assert site_lines.repeated_blocks(*empty).count() == 0
    assert site_lines.repeated_lines(*empty).count() == 0


# -- near-duplicates --------------------------------------------------------------------------------


def shingles(text):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)} if len(ws) >= 100 else set()


def brute_pairs(content, url):
    sets = [(p, s) for p, _, md in content if (s := shingles(md)) and url.get(p) is not None]
    return sorted((min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if url[a] != url[b] and 10 * len(x & y) >= 6 * len(x | y))


def near_fixture():
    rng = random.Random(6)
    names = [f"w{i}" for i in range(3000)]
    content, url = [], {}
    for group in range(25):
        base = [rng.choice(names) for _ in range(160)]
        for copy in range(3):
            ws = list(base)
            for _ in range(rng.randint(0, 14) * copy):
                ws[rng.randrange(len(ws))] = rng.choice(names)
            page = group * 10 + copy
            content.append((page, None, " ".join(ws)))
            url[page] = f"u{group}" if rng.random() < 0.15 else f"u{page}"
    same = " ".join(names[:120])
    content += [(1000 + i, None, same if i % 2 else same.upper().replace(" ", ",\n")) for i in range(12)] + [(2000, None, None), (2001, None, ""), (2002, None, "few words"), (2003, None, same), (2004, None, " ".join(names[:99])), (2005, None, " ".join(names[:99]))]
    url |= {1000 + i: f"s{i // 2}" for i in range(12)} | {2003: None, 2004: "q", 2005: "r"}
    return content, url


@pytest.mark.parametrize("extra", [[8, 20, 40], [30, 90, 120]])
def test_recall_under_hot_keys(make, monkeypatch, extra):
    """Pages of one template, alike or not so much, so that nearly every key is hot."""
    monkeypatch.setattr(near_duplicates, "HOT", 8)
    rng = random.Random(26)
    names = [f"w{i}" for i in range(4000)]
    base = [rng.choice(names) for _ in range(130)]
    content = [(i, None, " ".join([*base, *(rng.choice(names) for _ in range(rng.choice(extra)))])) for i in range(90)]
    url = {i: f"u{i}" for i in range(90)}
    want = set(brute_pairs(content, url))
    pages = make([(p, "c", u, u, None) for p, u in url.items()], PAGES)
    got = [tuple(r) for r in near_duplicates.near_duplicate_pages(make(content, CONTENT), pages).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 200
    assert len(got) >= 0.99 * len(want)


def test_pairs_of_a_hot_class_are_made_by_many_tasks(spark, skewed):
    rows = spark.range(0, 3000, 1, 12).selectExpr("id", "if(id % 3 = 0, 0, id) as rep", "id * 2 as more")
    sizes = rows.groupBy("rep").count().withColumnRenamed("count", "m").where("m > 1")
    pairs = near_duplicates.pair_up(rows, sizes, ["rep"], "id", ["id", "more"], 100)
    assert pairs.count() == pairs.select("id", "id_2").distinct().count() == 1000 * 999 // 2
    assert pairs.where("more_2 != 2 * id_2 or id >= id_2").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a fixture's blocks are small enough for one task
    try:
        tasks = [r.n for r in pairs.mapInArrow(skewed, "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 499_500 and max(tasks) < 499_500 / 6


def test_classes_have_no_pairs_of_copies(make):
    content, url = near_fixture()
    links, members = near_duplicates.near_duplicate_classes(make(content, CONTENT))
    rep = {r.page_id: r.rep for r in members.collect()}
    sets = {p: frozenset(s) for p, _, md in content if (s := shingles(md))}
    first = {}
    for p in sorted(sets):
        first.setdefault(sets[p], p)
    assert rep == {p: first[s] for p, s in sets.items()}
    want = {(a, b) for a, b in brute_pairs(content, {p: p for p in sets}) if rep[a] == a != rep[b] == b}
    got = {(r.rep_a, r.rep_b) for r in links.collect()}
    assert got == want and got
    assert {r.page_id: r.links for r in members.collect()} == {p: sum(rep[p] in x for x in want) for p in rep}


@pytest.mark.parametrize("hot", [256, 1])
def test_near_duplicates_match_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    content, url = near_fixture()
    pages = make([(p, "c", u, u, None) for p, u in url.items()], PAGES)
    got = sorted(tuple(r) for r in near_duplicates.near_duplicate_pages(make(content, CONTENT).selectExpr("*", "1 as key", "2 as n"), pages).collect())
    want = brute_pairs(content, url)
    assert got == want and len(want) > 80


def test_groups_match_union_find(make):
    content, _ = near_fixture()
    chain = [[f"c{k}" for k in range(i * 30, i * 30 + 160)] for i in range(14)]  # each like the next, the ends unlike
    content = content + [(3000 + i, None, " ".join(ws)) for i, ws in enumerate(chain)]
    parent = {p: p for p, _, md in content if shingles(md)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(content, {p: p for p in parent}):
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r.page_id: r.group_id for r in near_duplicates.near_duplicate_groups(make(content, CONTENT)).collect()}
    assert got == {p: find(p) for p in parent} and len({got[3000 + i] for i in range(14)}) == 1
    assert near_duplicates.near_duplicate_groups(make([], CONTENT)).count() == 0


def test_near_duplicates_of_empty_tables(make):
    assert near_duplicates.near_duplicate_pages(make([], CONTENT), make([], PAGES)).count() == 0


# -- main content ---------------------------------------------------------------------------------------


def page_fixture(i, rng, error=False):
    """A page in HTML and Markdown, and the numbers of its main lines."""
    title = f"{say(rng, 4)} {i}"
    nav = ["* [Home](/home)", "* [Our teachers](/our-teachers)", "* [Press room](/press)"]
    body, md = [], []

    def add(tag, text, line, main):
        body.append(f"<{tag}>{text}</{tag}>")
        md.append((line, main))

    if error:
        add("h1", "Page not found", "# Page not found", False)
        add("p", "Sorry, the page does not exist.", "Sorry, the page does not exist.", False)
    else:
        add("h1", title, f"# {title}", True)
        add("div", f"Posted on {i % 28} March 2024 by Jo Writer", f"Posted on {i % 28} March 2024 by Jo Writer", False)
        for k in range(4):
            text = say(rng, 25)
            add("p", text, text, True)
        items = [say(rng, 6) for _ in range(3)]
        body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        md.append(("\n".join(f"* {x}" for x in items), True))
        add("div", "Share this page: mail link print", "Share this page: mail link print", False)
        add("h2", "Comments (2)", "## Comments (2)", False)
        remark = f"Ann: {say(rng, 8)}."
        add("div", remark, remark, False)
    foot = "Our workshop stands for " + "amber bridge candle delta ember forest garden harbor"
    html = f"<html><head><title>{title}</title></head><body><div class=a><ul>{''.join(f'<li><a href={h}>{t}</a></li>' for t, h in (('Home', '/home'), ('Our teachers', '/our-teachers'), ('Press room', '/press')))}</ul></div><div class=b>{''.join(body)}</div><div class=c><p>{foot}</p><div>© 2024 Site. All rights reserved.</div></div></body></html>"
    blocks = [("\n".join(nav), False), *md, (foot, False), ("© 2024 Site. All rights reserved.", False)]
    lines, main = [], []
    for text, good in blocks:
        for line in text.split("\n"):
            if good:
                main.append(len(lines))
            lines.append(line)
        lines.append("")
    return html, "\n".join(lines), main


def test_main_body(make):
    rng = random.Random(8)
    made = [page_fixture(i, rng, error=i % 9 == 8) for i in range(90)]
    rows = [(i, h, m) for i, (h, m, _) in enumerate(made)] + [(500, None, None), (501, "<p>x</p>", ""), (502, "<p>x</p>", None), (503, None, made[0][1])]
    got = {tuple(r) for r in main_content.main_body(make(rows, CONTENT).selectExpr("*", "1 as line_no")).collect()}
    want = {(i, no) for i, (_, _, main) in enumerate(made) for no in main}
    with_html = {x for x in got if x[0] < 500}
    assert len(with_html & want) >= 0.98 * len(want) and len(with_html & want) >= 0.98 * len(with_html)
    assert not {x for x in got if x[0] in (500, 501, 502)}
    alone = {no for p, no in got if p == 503}
    assert len(alone & set(made[0][2])) >= 0.8 * len(made[0][2])
    assert main_content.main_body(make([], CONTENT)).count() == 0


def test_every_word_and_every_line_is_judged():
    assert "zephyr" in main_content.line_features("word " * 300 + "zephyr", "text")
    odds = {w: 2.5 for w in WORDS[:12]} | {w: -2.5 for w in WORDS[12:]}
    good, bad = " ".join(WORDS[:12]), " ".join(WORDS[12:])
    for mark in ("> ", "* ", "| "):
        body = [good] * 5 + ["", mark + good, mark + good, mark + bad, mark + bad]
        assert main_content.main_lines(None, "\n".join(body), odds) == [0, 1, 2, 3, 4, 6, 7], mark
    late = "of " * 60
    assert main_content.main_lines(None, "\n".join([good] * 5 + ["", late + good, "", late + bad]), odds) == [0, 1, 2, 3, 4, 6]
    assert len(main_content.main_lines(None, "\n".join(["* " + good] * 20_000), odds)) == 20_000


def test_the_classifier_moves_the_cut(make):
    """Where words and DOM disagree: an advertisement inside the region of the text goes, a second region of text stays."""
    rng = random.Random(30)
    made = [page_fixture(i, rng) for i in range(80)]
    advert = "Buy velour sofas cheaply now: subscribe, order, checkout, voucher, discount"
    rows = [(i, h.replace("</body>", f"<aside><p>{advert}</p></aside></body>"), m + f"\n\n{advert}") for i, (h, m, _) in enumerate(made)]
    html, text, main = made[0]
    more = [say(rng, 60) for _ in range(2)]
    odd = html.replace("</div><div class=c>", f"<p>{advert}</p></div><div class=more><p>{more[0]}</p><p>{more[1]}</p></div><div class=c>", 1)
    lines = text.split("\n")
    foot = next(i for i, x in enumerate(lines) if x.startswith("Our workshop"))
    lines[foot:foot] = [advert, "", more[0], "", more[1], ""]
    rows.append((900, odd, "\n".join(lines)))
    got = {no for p, no in map(tuple, main_content.main_body(make(rows, CONTENT)).collect()) if p == 900}
    assert foot not in got and {foot + 2, foot + 4} <= got and set(main) <= got
    odds = main_content.fit_odds(make(rows, CONTENT))
    assert odds["@h1 1"] > 0 > odds["@words 0"]


def test_regions_below_any_wrapper_and_long_alike_beginnings():
    inner = "<div class=a><ul><li><a href=/x>Menu</a></li></ul></div><div class=b><h1>T</h1><p>text</p></div>"
    for depth in (0, 2, 9, 300):
        tree = dom.leaves("<body>" + "<div>" * depth + inner + "</div>" * depth + "</body>")
        assert [x.region for x in tree] == [0, 1, 1], depth
    same = "alpha " * 40
    tree = dom.leaves(f"<body><div><p>{same}one</p></div><div><p>{same}two</p></div></body>")
    found = main_content.blocks(f"{same}two\n\n{same}one", {})
    assert [leaf.region for leaf in main_content.place(found, tree)] == [1, 0]


def test_short_bodies_are_kept_and_messages_are_not(make):
    rng = random.Random(20)
    made = [page_fixture(i, rng, error=i % 9 == 8) for i in range(60)]
    body = "<html><head><title>Quartz kettle</title></head><body><div><ul><li><a href=/h>Home</a></li></ul></div><div><h1>Quartz kettle</h1><p>Opens again in the velvet harbor.</p></div></body></html>"
    text = "# Quartz kettle\n\nOpens again in the velvet harbor."
    rows = [(i, h, m) for i, (h, m, _) in enumerate(made)] + [(500, body, text), (501, body, text)]
    slug = {500: "quartz-kettle", 501: "meadow-timber"}
    pages = make([(i, "c", None, f"https://site.example/a/{s}", None) for i, s in slug.items()], PAGES)
    got = {tuple(r) for r in main_content.main_body(make(rows, CONTENT), pages).collect()}
    assert {x for x in got if x[0] >= 500} == {(500, 0), (500, 2)}
    assert not {p for p, _ in got if p < 500 and p % 9 == 8}


def brute_cut(capacity, edges):
    """The least cost over all labellings."""
    n, best = len(capacity), float("inf")
    for mask in range(1 << n):
        side = [mask >> i & 1 for i in range(n)]
        cost = sum(-c if s and c < 0 else c if not s and c > 0 else 0 for s, c in zip(side, capacity))
        cost += sum(w for a, b, w, _ in edges if side[a] and not side[b]) + sum(w for a, b, _, w in edges if side[b] and not side[a])
        best = min(best, cost)
    return best


def test_the_cut_is_minimal():
    rng = random.Random(10)
    for _ in range(60):
        n = rng.randint(1, 8)
        capacity = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5), rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        side = main_content.cut(list(capacity), edges)
        cost = sum(-c if s and c < 0 else c if not s and c > 0 else 0 for s, c in zip(side, capacity))
        cost += sum(w for a, b, w, _ in edges if side[a] and not side[b]) + sum(w for a, b, _, w in edges if side[b] and not side[a])
        assert abs(cost - brute_cut(capacity, edges)) < 1e-6


def test_leaves():
    found = dom.leaves("<body><div><p>A <b>b</b></p><script>x</script></div><div><ul><li><a href='/q'>Link</a></li></ul>tail</div><!-- no --></body>")
    assert [(x.text, x.tag, x.linked > 0, x.href) for x in found] == [("A b", "p", False, ""), ("Link", "li", True, "/q"), ("tail", "div", False, "")]
    assert found[0].region != found[1].region == found[2].region
    assert dom.leaves("") == [] and [x.text for x in dom.leaves("<p>open")] == ["open"]
    assert len(dom.leaves("<div>" * 3000 + "deep")) == 1


# -- residue -------------------------------------------------------------------------------------------


def real_page(rng, slug, title=None, extra="", head=""):
    text = "".join(f"<p>{say(rng, 30)}</p>" for _ in range(4))
    name = title or slug.replace("-", " ").title()
    return f"<html><head><title>{name} | Site</title>{head}</head><body><ul><li><a href=/h>Home</a></li></ul><h1>{name}</h1>{text}{extra}<div>© Site</div></body></html>"


def test_residue(make):
    rng = random.Random(12)
    slugs = [f"{rng.choice(WORDS)}-{rng.choice(WORDS)}-{rng.choice(WORDS)}-{rng.choice(WORDS)}-cut-x{i}" for i in range(30)]
    message = "<html><head><title>{t}</title></head><body><ul><li><a href=/h>Home</a></li></ul><h1>{t}</h1><p>{m}</p><div>© Site</div></body></html>"
    cases = {
        0: real_page(rng, slugs[0], extra="<p>Hello {{ user.name }}, welcome</p>"), 1: real_page(rng, slugs[1], title="%COURSE_TITLE%"), 2: real_page(rng, slugs[2], head='<meta name="description" content="[YOUR TEXT HERE]">'),
        3: real_page(rng, slugs[3], extra="<p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.</p>"), 4: real_page(rng, slugs[4], extra="<p>Your text goes here.</p><p>This is a sample page.</p>"),
        5: message.format(t="Page not found", m="Sorry, this does not exist."), 6: message.format(t="Access denied", m="You do not have permission."), 7: "<html><body><div>Please enable JavaScript to continue.</div><div id=root></div></body></html>",
        8: real_page(rng, slugs[8], extra="<p>&lt;%= price %&gt; is due</p>"),
    }
    fine = {
        10: real_page(rng, slugs[10], extra="<pre><code>{{ x }}</code></pre><script>${y}</script><noscript>Please enable JavaScript</noscript>"), 11: real_page(rng, slugs[11], extra="<p>Printers once set lorem ipsum to judge the type of a page.</p>"),
        12: real_page(rng, "why-visitors-see-page-not-found-cut-x"), 13: real_page(rng, slugs[13]), 14: "", 15: None, 16: real_page(rng, slugs[16], title="Quite Other"), 17: real_page(rng, slugs[17], extra="<p>x</p>" * 2000),
    }
    rows = [(i, h, None) for i, h in (cases | fine).items()] + [(99, "<p>" + "word " * 200_000 + "</p>", None)]
    slug = {i: slugs[i % 30] for i in (cases | fine)} | {12: "why-visitors-see-page-not-found-cut-x"}
    pages = make([(i, "c", None, f"https://site{i % 2}.example/a/{s}", None) for i, s in slug.items()] + [(98, "c", None, None, None)], PAGES)
    got = {r.page_id for r in residue.pages_without_content(make(rows, CONTENT).selectExpr("*", "1 as line", "2 as host"), pages).collect()}
    assert got == set(cases)
    kept = {r.page_id for r in residue.pages_with_content(make(rows, CONTENT), pages).collect()}
    assert kept == {i for i, _, _ in rows} - set(cases)
    assert residue.pages_without_content(make([], CONTENT), make([], PAGES)).count() == 0


def test_messages_inside_a_heavy_template(make):
    rng = random.Random(16)
    heavy = "".join(f"<div>{say(rng, 80)} mango papaya</div>" for _ in range(5))
    page = "<html><head><title>{t}</title></head><body>{h}<h1>{t}</h1>{b}</body></html>"
    names = [f"{rng.choice(WORDS)}-topic{chr(97 + i)}-{rng.choice(WORDS)}-cut-x{i}" for i in range(8)]
    rows = [(i, page.format(t=n.replace("-", " "), h=heavy, b=f"<p>{say(rng, 70)}</p>"), None) for i, n in enumerate(names)]
    rows += [(20, page.format(t="Not found", h=heavy, b="<p>Sorry.</p>"), None), (21, page.format(t="Other title", h=heavy, b=f"<p>{say(rng, 90)}</p>"), None)]
    copies = page.format(t="Other title", h=heavy, b=f"<p>{say(rng, 90)}</p>")
    rows += [(30 + i, copies, None) for i in range(4)]
    slug = dict(enumerate(names)) | {20: "mango-papaya-mango-cut-y", 21: "guava-lychee-guava-cut-y"} | {30 + i: f"guava-lychee-kumquat-cut-y?ref={i}" for i in range(4)}
    pages = make([(i, "c", None, f"https://site.example/a/{s}", None) for i, s in slug.items()], PAGES)
    assert [r.page_id for r in residue.pages_without_content(make(rows, CONTENT), pages).collect()] == [20]


def test_filler_and_long_messages_by_evidence_of_hosts(make):
    """Filler in words that no list has, and an error page of 400 words, both served by many hosts."""
    rng = random.Random(27)
    filler = "Kumquat papaya guava lychee mango durian"
    words = [f"{a}{b}" for a in WORDS for b in "aeiou"]
    long = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(80))}</p>" for _ in range(5))
    rows, urls = [], {}
    for k in range(12):
        for j in range(4):
            i, slug = 100 * k + j, f"{rng.choice(WORDS)}-{rng.choice(WORDS)}-{rng.choice(WORDS)}-cut-x{k}{j}"
            rows.append((i, real_page(rng, slug, extra=f"<p>{filler}</p>" if j == 1 else f"<p>They say {filler.lower()} on {slug}</p>" if j == 2 else ""), None))
            urls[i] = f"https://site{k}.example/a/{slug}"
        rows.append((100 * k + 50, f"<html><head><title>Sorry</title></head><body><h1>Sorry</h1>{long}</body></html>", None))
        urls[100 * k + 50] = f"https://site{k}.example/a/guava-{rng.choice('abc')}lychee-kumquat-cut-y{k}"
    pages = make([(i, "c", None, u, None) for i, u in urls.items()], PAGES)
    got = {r.page_id for r in residue.pages_without_content(make(rows, CONTENT), pages).collect()}
    assert got == {100 * k + j for k in range(12) for j in (1, 50)}


def test_placeholders_of_any_length():
    for text in ("TODO: replace this copy", "{{ " + "x" * 500 + " }}", "[your " + "very " * 100 + "name]"):
        assert residue.has_residue("", "", [f"Before {text} after"]), text
    for text in ("Todo: lo que falta", "TODO el mundo", "a {b c} d", "[note]", "50 % of 3 %"):
        assert not residue.has_residue("", "", [text]), text


def test_filler_anywhere_in_a_text():
    rng = random.Random(18)
    real, latin = say(rng, 200) + ".", "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor."
    for text in (f"{real} {latin * 1} {real}", f"{real} " + latin.replace(".", "") * 4, "Dolor sit amet elit", "Your text goes here.", "Placeholder headline number 3"):
        assert residue.has_residue("", "", [real, text]), text
    for text in (real, "Lorem ipsum", f"Printers set lorem ipsum dolor sit amet to judge a type. {real}", "Why does a page say your text goes here?", "in et id", ""):
        assert not residue.has_residue("", "", [real, text]), text


# -- languages ----------------------------------------------------------------------------------------

SAY = {
    "en": "the house of the garden was quiet and the children were playing with their friends in the morning", "de": "das haus im garten war ruhig und die kinder spielten am morgen mit ihren freunden auf der straße",
    "fr": "la maison du jardin était calme et les enfants jouaient avec leurs amis le matin dans la rue", "es": "la casa del jardín estaba tranquila y los niños jugaban con sus amigos por la mañana en la calle",
    "it": "la casa del giardino era tranquilla e i bambini giocavano con i loro amici la mattina nella strada", "nl": "het huis in de tuin was rustig en de kinderen speelden in de ochtend met hun vrienden op straat",
    "pt": "a casa do jardim estava tranquila e as crianças brincavam com os seus amigos de manhã na rua",
}


def speech(rng, lang, n=20):
    ws = SAY[lang].split()
    at = rng.randrange(len(ws))
    return " ".join((ws[at:] + ws * 3)[:n]).capitalize() + "."


@pytest.mark.parametrize("label,want", [("en-US", "en"), (" DEU ", "de"), ("français", "fr"), ("und", None), ("", None), (None, None), ("unknown", None), ("pl", "pl"), ("PT_br", "pt"), ("English", "en")])
def test_labels(label, want):
    assert languages.stated(label) == want


def test_paragraphs():
    assert languages.paragraphs("a\nb\n \t\n\n c \n\r\nd") == ["a\nb", " c ", "d"]
    assert languages.paragraphs(None) == languages.paragraphs(" \n\n ") == languages.paragraphs("") == []


def test_wrong_segments(make):
    rng = random.Random(14)
    rows, want = [], set()
    langs = list(SAY)
    for i in range(420):
        lang = langs[i % 7]
        label = rng.choice([lang, lang.upper(), lang + "-XX"]) if rng.random() > 0.15 else rng.choice([None, "und", langs[(i + 1) % 7], "sv"])
        other = langs[(i + 3) % 7] if rng.random() < 0.2 else lang
        parts = [speech(rng, lang), speech(rng, other).upper(), "12 34 | 56 == ab[1] = 7;"]
        rows.append((i, "\n \n".join(parts), label))
        for k, x in enumerate((lang, other)):
            if languages.stated(label) != x:
                want.add((i, k, x))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \n ", None), (903, "ab" * 200_000, None), (904, speech(rng, "de"), None)]
    want.add((904, 0, "de"))
    docs = make(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as stated", "2 as seg_no")
    got = {tuple(r) for r in languages.wrong_segments(docs).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)
    whole = {r.doc_id: r.lang for r in languages.label_segments(docs).where("seg_no is null").collect()}
    assert len(whole) == len(rows) and whole[904] == "de" and whole[900] is None and whole[903] is None


def test_languages_of_an_empty_table(make):
    assert languages.label_segments(make([], "doc_id long, text string, lang string")).count() == 0
