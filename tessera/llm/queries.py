"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import contacts_fold, contamination, languages, main_content, near_duplicates, residue, site_lines, tokenize
from tessera.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts_fold.contacts_of_crawls(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"))
    return contacts_fold.copies(rows)


def p1_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts_fold.collapsed(table(spark, sf_dir, "page_contacts"), table(spark, sf_dir, "pages"))


def _site_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "page_content"), table(spark, sf_dir, "pages"), table(spark, sf_dir, "crawls")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(*_site_tables(spark, sf_dir))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, pages, crawls = _site_tables(spark, sf_dir)
    return site_lines.without_lines(content, site_lines.repeated_lines(content, pages, crawls))


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_blocks(*_site_tables(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content.main_body(table(spark, sf_dir, "page_content"), table(spark, sf_dir, "pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pages(table(spark, sf_dir, "page_content"), table(spark, sf_dir, "pages"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "page_content"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "page_content"))[0]


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "page_content"))[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.pages_without_content(table(spark, sf_dir, "page_content"), table(spark, sf_dir, "pages"))


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.pages_with_content(table(spark, sf_dir, "page_content"), table(spark, sf_dir, "pages"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_segments(table(spark, sf_dir, "documents"))


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.label_segments(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_contacts": p1_contacts,
    "p2_found": p2_found,
    "p2_text": p2_text,
    "p2_blocks": p2_blocks,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_links": p5_links,
    "p5_members": p5_members,
    "p6_found": p6_found,
    "p6_pages": p6_pages,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_labels": p9_labels,
}

_FOLDED = r"""
WITH c AS (
  SELECT c.id, p.crawl_id, c.kind, c.value, regexp_replace(lower(c.kind), '[^\p{L}\p{N}]+', '', 'g') AS k,
         list_sort(list_filter(list_transform(regexp_split_to_array(c.value, '[;|]'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) AS v
  FROM page_contacts c JOIN pages p ON p.id = c.page_id
  WHERE c.kind IS NOT NULL AND c.value IS NOT NULL AND p.crawl_id IS NOT NULL AND c.id IS NOT NULL),
g AS (SELECT *, min(id) OVER (PARTITION BY crawl_id, k, v) AS first_id, count(*) OVER (PARTITION BY crawl_id, k, v) AS copies FROM c)
"""
_LINES = r"""
WITH l AS (
  SELECT c.page_id, lower(k.target_domain) AS source, u.n - 1 AS line_no, c.raw_markdown,
         regexp_replace(regexp_replace(lower(regexp_replace(string_split(c.raw_markdown, chr(10))[u.n], '\[([^\]]*)\]\([^)]*\)', '\1', 'g')), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS form
  FROM page_content c JOIN pages p ON p.id = c.page_id JOIN crawls k ON k.id = p.crawl_id,
       LATERAL (SELECT unnest(generate_series(1, len(string_split(c.raw_markdown, chr(10))))) AS n) u
  WHERE k.target_domain IS NOT NULL),
r AS (SELECT source, form FROM l WHERE length(form) >= 8 GROUP BY ALL HAVING count(DISTINCT page_id) >= 6),
f AS (SELECT l.page_id, l.line_no FROM l JOIN r USING (source, form))
"""
def _grams(table: str, key: str, text: str, n: int) -> str:
    """The different runs of n words of a text."""
    words = f"SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM ({words}))"


_CLASSES = f"""
WITH big AS (SELECT page_id, raw_markdown FROM page_content WHERE len(regexp_extract_all(lower(raw_markdown), '[\\p{{L}}\\p{{N}}]+')) >= 100),
g AS ({_grams("big", "page_id", "raw_markdown", 3)}),
s AS (SELECT page_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS whole FROM g GROUP BY page_id),
m AS (SELECT page_id, n, min(page_id) OVER (PARTITION BY whole) AS rep FROM s),
r AS (SELECT g.page_id, gram FROM g JOIN m ON m.page_id = g.page_id AND m.rep = m.page_id),
k AS (SELECT a.page_id AS rep_a, b.page_id AS rep_b, count(*) AS k FROM r a JOIN r b ON a.gram = b.gram AND a.page_id < b.page_id GROUP BY ALL),
links AS (SELECT rep_a, rep_b, k / (x.n + y.n - k) AS similarity FROM k JOIN m x ON x.page_id = rep_a JOIN m y ON y.page_id = rep_b WHERE k * 10 >= 6 * (x.n + y.n - k))
"""
ORACLE: dict[str, str] = {
    "p5_links": _CLASSES + "SELECT * FROM links",
    "p5_members": _CLASSES + "SELECT page_id, rep, (SELECT count(*) FROM links WHERE rep IN (rep_a, rep_b)) AS links FROM m",
    "p5_found": f"""
WITH big AS (SELECT c.page_id, c.raw_markdown, p.canonical_url FROM page_content c JOIN pages p ON p.id = c.page_id WHERE p.canonical_url IS NOT NULL AND len(regexp_extract_all(lower(c.raw_markdown), '[\\p{{L}}\\p{{N}}]+')) >= 100),
g AS ({_grams("big", "page_id", "raw_markdown", 3)}),
n AS (SELECT page_id, count(*) AS n FROM g GROUP BY page_id),
common AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.page_id < b.page_id GROUP BY ALL)
SELECT a AS page_id_a, b AS page_id_b FROM common JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b JOIN big p ON p.page_id = a JOIN big q ON q.page_id = b
WHERE k * 10 >= 6 * (x.n + y.n - k) AND p.canonical_url <> q.canonical_url
""",
    "p8_found": f"""
WITH d AS ({_grams("documents", "doc_id", "text", 12)}),
e AS ({_grams("eval_items", "item_id", "prompt", 12)} UNION {_grams("eval_items", "item_id", "reference_answer", 12)})
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)
""",
    "p2_found": _LINES + "SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM f",
    "p2_blocks": _LINES
    + """,
n AS (SELECT source, page_id, line_no, form, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS i FROM l WHERE length(form) >= 8),
s AS (SELECT source, page_id, list(form ORDER BY i) AS forms, list(line_no ORDER BY i) AS nos FROM n GROUP BY ALL),
b AS (SELECT source, page_id, forms, nos, i, unnest(generate_series(i, len(forms))) AS j FROM (SELECT *, unnest(generate_series(1, len(forms))) AS i FROM s)),
o AS (SELECT source, page_id, nos[i] AS line_no, j - i + 1 AS n_lines, array_to_string(forms[i:j], chr(10)) AS block,
             CASE WHEN i > 1 THEN forms[i - 1] ELSE chr(10) || page_id END AS before, CASE WHEN j < len(forms) THEN forms[j + 1] ELSE chr(10) || page_id END AS after FROM b)
SELECT source, min(page_id) AS page_id, arg_min(line_no, page_id * 1000000 + line_no)::INTEGER AS line_no, n_lines, count(DISTINCT page_id) AS n_pages
FROM o GROUP BY source, block, n_lines HAVING count(DISTINCT page_id) >= 6 AND count(DISTINCT before) > 1 AND count(DISTINCT after) > 1
""",
    "p2_text": _LINES
    + """
SELECT c.page_id, CASE WHEN c.raw_markdown IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.removed, 0)::INTEGER AS removed
FROM page_content c LEFT JOIN (
  SELECT s.page_id, string_agg(s.line, chr(10) ORDER BY s.n) FILTER (f.line_no IS NULL) AS text, count(f.line_no) AS removed
  FROM (SELECT page_id, unnest(string_split(raw_markdown, chr(10))) AS line, unnest(generate_series(0, len(string_split(raw_markdown, chr(10))) - 1)) AS n FROM page_content) s
  LEFT JOIN f ON f.page_id = s.page_id AND f.line_no = s.n GROUP BY s.page_id) t USING (page_id)
""",
    "p1_found": _FOLDED + "SELECT first_id, id AS copy_id FROM g WHERE id <> first_id",
    "p1_contacts": _FOLDED + "SELECT id, crawl_id, kind, value, copies FROM g WHERE id = first_id",
}
