"""Folded copies, tokenizing and contamination against brute force."""

import random
import re
import time

import pytest

from tessera.llm import contacts_fold, contamination, tokenize
from tessera.llm.textscan import words


def fold(text):
    return "".join(c for c in text.lower() if c.isalnum())


def canonical(kind, value):
    return fold(kind), tuple(sorted(f for f in map(fold, re.split("[;|]", value)) if f))


def brute_copies(rows):
    groups = {}
    for i, scope, kind, value in rows:
        if None not in (i, scope, kind, value):
            groups.setdefault((scope, *canonical(kind, value)), []).append(i)
    return sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


CONTACTS = [
    (1, "a", "email", "Jo Li; jo@x.example"), (2, "a", "E-Mail", "JO@X.EXAMPLE |  jo-li;"), (3, "b", "email", "jo@x.example;jo li"), (4, "a", "phone", "+44 20"), (5, "a", "PHONE.", "(+44)20"),
    (6, "a", None, "+44 20"), (7, "a", "phone", None), (8, None, "phone", "+44 20"), (9, "a", "phone", ""), (10, "a", "phone", " ; | "), (11, "a", "phone", "x" * 50_000), (12, "a", "phone", "X-" * 50_000),
    (13, "a", "email", "a;a;b"), (14, "a", "email", "a;b;b"), (15, "a", "email", "b;A; a"), (16, "a", "email", "Pälvi​"), (17, "a", "email", "\xa0PÄLVI"), (18, "a", "email", "ab;c"), (19, "a", "email", "a;bc"),
]


def test_copies_match_brute_force(make):
    rows = make(CONTACTS, "id long, scope string, kind string, value string").selectExpr("*", "1 as n", "2 as first_id", "3 as k0")
    got = sorted(tuple(r) for r in contacts_fold.copies(rows).collect())
    assert got == brute_copies(CONTACTS)


def test_copies_of_random_values(make):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice(["email", "E-mail", "phone"]), "".join(rng.choice("aAb;| -") for _ in range(rng.randint(0, 7)))) for i in range(400)]
    df = make(rows, "id long, scope string, kind string, value string")
    assert sorted(tuple(r) for r in contacts_fold.copies(df).collect()) == brute_copies(rows)


def test_kinds_with_separators_are_one_field(make):
    rows = [(1, "a", "phone;fax", "1"), (2, "a", "fax;phone", "1"), (3, "a", "Phone|Fax", "1"), (4, "a", "e|mail", "x"), (5, "a", "email", "X;"), (6, "a", ";", "x"), (7, "a", "", "x")]
    got = sorted(tuple(r) for r in contacts_fold.copies(make(rows, "id long, scope string, kind string, value string")).collect())
    assert got == brute_copies(rows) == [(1, 3), (4, 5), (6, 7)]


def test_texts_are_compared_in_order():
    rng = random.Random(21)
    texts = ["".join(rng.choice("aAbÄ; |-") for _ in range(rng.randint(0, 6))) for _ in range(600)]
    same = contacts_fold.same_in_order(texts[:300], texts[300:])
    plain = ["".join(c for c in t.lower().replace("|", ";") if c.isalnum() or c == ";") for t in texts]
    assert same.tolist() == [x == y for x, y in zip(plain[:300], plain[300:])] and same.any()


def test_a_hot_group_is_compared_by_many_tasks(make, spark, skewed):
    """A third of all rows are one contact: no task of the comparison gets more than a part of them."""
    hot = spark.range(0, 60_000, 1, 12).selectExpr("id", "'c' as scope", "'email' as kind", "if(id % 3 = 0, if(id % 2 = 0, 'Same Value', 'same-value'), 'v' || id) as value")
    keyed = contacts_fold._keyed(hot, 0)
    groups = keyed.groupBy("v0").count().where("count > 1")
    rows = [r.n for r in contacts_fold.split_join(keyed, groups, ["v0"]).mapInArrow(skewed, "n long").collect()]
    assert sum(rows) == 20_000 and max(rows) < 5_000
    assert contacts_fold.copies(hot).count() == 19_999


def test_hash_collisions_are_told_apart(make, monkeypatch):
    """With keys that collide on purpose under the first seed, the comparison and the next seed give the exact result."""
    rows = [(i, "a", "email", v) for i, v in enumerate("xyzwxyvuxz")]
    keyed = contacts_fold._keyed
    monkeypatch.setattr(contacts_fold, "_keyed", lambda df, seed: keyed(df, seed).selectExpr("id", "scope", "kind", "value", "k0", "v0 % 2 as v0", "0L as v1") if seed == 0 else keyed(df, seed))
    got = sorted(tuple(r) for r in contacts_fold.copies(make(rows, "id long, scope string, kind string, value string")).collect())
    assert got == brute_copies(rows)


def test_copies_of_an_empty_table_and_one_hot_group(make):
    schema = "id long, scope string, kind string, value string"
    assert contacts_fold.copies(make([], schema)).count() == 0
    hot = [(i, "a", "email", "Same Value" if i % 2 else "same-value") for i in range(1000)]
    got = contacts_fold.copies(make(hot, schema)).collect()
    assert len(got) == 999 and {r.first_id for r in got} == {0}


def test_collapsed_counts_copies(make):
    contacts = make([(1, 10, "email", "a@b"), (2, 10, "EMAIL", "A@B"), (3, 11, "email", "a@b"), (4, 12, "email", "a@b"), (5, 10, None, "q")], "id long, page_id long, kind string, value string")
    pages = make([(10, "c"), (11, "c"), (12, "d")], "id long, crawl_id string")
    got = {(r.id, r.crawl_id, r.copies) for r in contacts_fold.collapsed(contacts, pages).collect()}
    assert got == {(1, "c", 3), (4, "d", 1)}


def test_same_record_skips_what_does_not_count():
    assert contacts_fold.same_record("A-b; c", "C | a.B")
    assert not contacts_fold.same_record("ab;c", "a;bc")
    assert not contacts_fold.same_record("a;a;b", "a;b;b")
    many = ";".join(f"f{i}" for i in range(20_000))
    assert contacts_fold.same_record(many, ";".join(f"F{i}" for i in reversed(range(20_000))))


@pytest.fixture(scope="module")
def encoder():
    with open(tokenize.VOCABULARY, "rb") as f:
        return tokenize.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "  \n\t ", "Hello world's", "<|endoftext|> <s>", "été ①② ﬁn 🧪👩‍🔧", "a" * 3000, "ab" * 2000, "=" * 777, "x y \xa0z", "don't 'S 'll I'VE", "12345678901234567890", "\x00\x7f\x1b[0m", "זה טקסט 中文字符", "\r\n\r\n  end  "]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_match_the_library(encoder, library, text):
    assert encoder.encode(text) == library(text)


def test_ids_of_random_bytes(encoder, library):
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("aábc deE= -_1\n") for _ in range(rng.randint(1, 80)))
        assert encoder.encode(text) == library(text)


def test_cache_stays_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokenize, "CACHED_PIECES", 5)
    e = tokenize.Encoder(b"")
    e.ranks = encoder.ranks
    assert e.encode("one two three four five six seven") == encoder.encode("one two three four five six seven") and len(e.known) <= 5


def test_corpus_ids(make):
    rows = [(1, "Hello", 5), (2, None, 5), (3, "", 5), (4, " ", 5), (4, " ", 5), (None, "x", 5)]
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(make(rows, "doc_id long, text string, ids int")).collect()]
    assert len(got) == 6 and dict(got)[2] == [] and dict(got)[3] == [] and dict(got)[4] == [220]
    assert tokenize.encode_corpus(make([], "doc_id long, text string")).count() == 0


def brute_leaks(docs, items, run=12):
    grams = {}
    for item, *texts in items:
        for text in texts:
            ws = words(text)
            for i in range(len(ws) - run + 1):
                grams.setdefault(tuple(ws[i : i + run]), set()).add(item)
    out = set()
    for doc, text in docs:
        ws = words(text)
        for i in range(len(ws) - run + 1):
            out |= {(doc, k) for k in grams.get(tuple(ws[i : i + run]), ())}
    return sorted(out)


def test_leaks_match_brute_force(make):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("red blue green tea cup".split()) for _ in range(n))
    items = [(i, say(40), say(20) if i % 3 else None) for i in range(12)] + [(12, items_text := say(30), "short"), (13, items_text, None), (14, None, None)]
    docs = [(i, say(30) + " " + (items[i % 13][1] or "")[7:90].replace(" ", ",\n") + " " + say(30)) for i in range(60)] + [(60, None), (61, ""), (62, "red"), (63, items_text.upper())]
    documents, eval_items = make(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"), make(items, "item_id long, prompt string, reference_answer string")
    want = brute_leaks(docs, items)
    assert sorted(tuple(r) for r in contamination.leaked(documents, eval_items).collect()) == want and len(want) > 50
    blocks = contamination.leaked(documents, eval_items, block_chars=300)
    assert sorted(tuple(r) for r in blocks.collect()) == want


def test_time_does_not_grow_with_items_of_one_ending():
    rng = random.Random(22)
    took = {}
    for n in (200, 20_000):
        items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(10)) + " of the") for i in range(n)]
        machine = contamination.WuManber(items)
        texts = [" ".join(f"v{rng.randrange(50)} of the" for _ in range(400))] * 20 + [items[3][1]]
        began = time.perf_counter()
        text, item = machine.search(texts)
        took[n] = time.perf_counter() - began
        assert text.tolist() == [20] and item.tolist() == [3]
    assert took[20_000] < 4 * took[200] + 0.05


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(contamination.WuManber, "_hash", lambda self, numbers, first: numbers[first].astype("uint64") % 2)
    rng = random.Random(23)
    say = lambda n: " ".join(rng.choice("red blue green tea cup".split()) for _ in range(n))
    items = [(i, say(20)) for i in range(8)] + [(8, "a b c " * 9)]
    docs = [(i, say(5) + " " + items[i % 9][1][3:]) for i in range(30)]
    text, item = contamination.WuManber(items).search([t for _, t in docs])
    assert list(zip(text.tolist(), item.tolist())) == brute_leaks(docs, items)


def test_leaks_of_empty_tables(make):
    docs, items = make([(1, "a b")], "doc_id long, text string"), make([], "item_id long, prompt string, reference_answer string")
    assert contamination.leaked(docs, items).count() == 0
    assert contamination.leaked(make([], "doc_id long, text string"), make([(1, "a", None)], "item_id long, prompt string, reference_answer string")).count() == 0
