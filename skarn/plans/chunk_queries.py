"""Chunks of the documents as they are, and of the documents under headings, in lists and in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators import chunk, evaluate
from skarn.plans.common import documents, spread
from skarn.settings import DEFAULT


def _structured(text: Column, doc_id: Column) -> Column:
    """The text with headings before every third line, as many lines as lists and as tables; the rest are paragraphs.

    Even documents mark the level of headings, odd ones number them; some of these headings have no number."""

    def line(x: Column, i: Column) -> Column:
        n = i + doc_id
        title = F.array_join(F.slice(F.split(x, " "), 1, 3), " ")
        marked = F.concat(F.repeat(F.lit("#"), (F.pmod(n * 5, F.lit(4)) + 1).cast("int")), F.lit(" "), title)
        digits = F.concat((F.pmod(i, F.lit(9)) + 1).cast("string"), F.when(F.pmod(n, F.lit(2)) == 1, F.concat(F.lit("."), (F.pmod(n, F.lit(5)) + 1).cast("string"))).otherwise(""))
        numbered = F.concat(F.lit("# "), F.when(F.pmod(n, F.lit(4)) == 3, "").otherwise(F.concat(digits, F.lit(" "))), title)
        head = F.when(F.pmod(n, F.lit(3)) != 0, "").otherwise(F.concat(F.when(F.pmod(doc_id, F.lit(2)) == 0, marked).otherwise(numbered), F.lit("\n\n")))
        rows = F.concat(F.lit("| word |\n|---|\n| "), F.replace(x, F.lit(" "), F.lit(" |\n| ")), F.lit(" |"))
        items = F.concat(F.lit("- "), F.replace(x, F.lit(". "), F.lit(".\n- ")))
        body = F.when(F.pmod(n, F.lit(7)) == 2, rows).when(F.pmod(n, F.lit(7)) == 4, items).when(F.pmod(n, F.lit(7)) == 6, "").otherwise(x)
        return F.concat(head, body)

    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: line(x, i.cast("long"))), "\n\n")


def chunk_documents(spark, sf_dir: str) -> DataFrame:
    """Structured chunks of every document, each a file of one page."""
    pages = spread(documents(spark, sf_dir)).select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("number"), F.col("text").alias("markdown"))
    return chunk.chunked(pages)


def structured_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of every document under headings, with lists and tables."""
    pages = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return chunk.chunked(pages.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("number"), _structured(F.col("text"), F.col("doc_id")).alias("markdown")))


def chunk_overlaps(spark, sf_dir: str) -> DataFrame:
    """Which chunks of the documents begin with words of the chunk before."""
    return evaluate.neighbours_overlap(chunk_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (chunk_documents, structured_chunks, chunk_overlaps)}

_STRUCTURED = r"""SELECT 'd' || doc_id AS source, string_agg(head || body, chr(10) || chr(10) ORDER BY i) AS markdown FROM (SELECT *,
    CASE WHEN n % 3 <> 0 THEN '' WHEN doc_id % 2 = 0 THEN repeat('#', CAST(n * 5 % 4 + 1 AS INT)) || ' ' || title || chr(10) || chr(10)
      ELSE '# ' || CASE WHEN n % 4 = 3 THEN '' ELSE (i % 9 + 1) || CASE WHEN n % 2 = 1 THEN '.' || (n % 5 + 1) ELSE '' END || ' ' END || title || chr(10) || chr(10) END AS head,
    CASE n % 7 WHEN 2 THEN '| word |' || chr(10) || '|---|' || chr(10) || '| ' || replace(x, ' ', ' |' || chr(10) || '| ') || ' |' WHEN 4 THEN '- ' || replace(x, '. ', '.' || chr(10) || '- ') WHEN 6 THEN '' ELSE x END AS body
  FROM (SELECT doc_id, x, i, i + doc_id AS n, array_to_string(string_split(x, ' ')[1:3], ' ') AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))) GROUP BY doc_id"""


def _count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def _ends(name: str, source: str) -> str:
    """Rows (id, k, a, b) of a greedy packing: group k holds the items a+1 to b. `source` has id, budget and c, the sums of costs from 0."""
    fit = "len(list_filter(c, lambda x: x <= c[{0} + 1] + budget)) - 1"
    return f"""{name} AS (SELECT id, 0 AS k, 0::BIGINT AS a, greatest(1, {fit.format(0)}) AS b, c, budget FROM {source}
  UNION ALL SELECT id, k + 1, b, greatest(b + 1, {fit.format("b")}), c, budget FROM {name} WHERE b < len(c) - 1)"""


def _chunks_sql(pages: str) -> str:
    """The chunks of pages (source, markdown) by joins and walks over sums of words."""
    item, tokens, overlap = r"^\s*(?:[-*+]|\d+[.)])\s+", DEFAULT.chunk_tokens, DEFAULT.chunk_overlap
    return rf"""WITH RECURSIVE md AS ({pages}),
cuts AS (SELECT source, part, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS raw FROM (SELECT source, unnest(string_split_regex(markdown, '\n\s*\n')) AS raw, generate_subscripts(string_split_regex(markdown, '\n\s*\n'), 1) AS part FROM md)),
tops AS (SELECT *, split_part(raw, chr(10), 1) AS top, regexp_matches(split_part(raw, chr(10), 1), '^#{{1,6}}\s+.*\S\s*$') AS is_head FROM cuts WHERE raw <> ''),
bits AS (SELECT source, part, 0 AS sub, regexp_extract(top, '^(#{{1,6}})\s+(.*\S)\s*$', 2) AS text, length(regexp_extract(top, '^(#+)', 1)) AS level, true AS is_head FROM tops WHERE is_head
  UNION ALL SELECT source, part, 1, CASE WHEN is_head THEN regexp_replace(substr(raw, length(top) + 1), '^\s+|\s+$', '', 'g') ELSE raw END, 0, false FROM tops),
blocks AS (SELECT source, part, sub, text, level, is_head AND NOT text LIKE '%:' AS is_head, CASE WHEN is_head THEN 'paragraph' WHEN text LIKE '|%' THEN 'table' WHEN regexp_matches(text, '{item}') THEN 'list' ELSE 'paragraph' END AS kind FROM bits WHERE text <> ''),
placed AS (SELECT *, count(*) FILTER (WHERE is_head) OVER (PARTITION BY source ORDER BY part, sub) AS sec FROM blocks),
heads AS (SELECT *, count(DISTINCT level) OVER (PARTITION BY source) AS marks, nullif(regexp_extract(text, '^(\d{{1,2}}(?:\.\d{{1,2}})*)\.?\s+\S', 1), '') AS number,
  NOT EXISTS (SELECT 1 FROM placed t WHERE t.source = p.source AND t.sec = p.sec AND NOT t.is_head) AS bare FROM placed p WHERE is_head),
levels AS (SELECT source, sec, text, CASE WHEN marks > 1 THEN level ELSE coalesce(len(string_split(number, '.')), last_value(CASE WHEN number IS NOT NULL THEN len(string_split(number, '.')) + bare::INT END IGNORE NULLS)
  OVER (PARTITION BY source ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS level FROM heads),
paths AS (SELECT j.source, j.sec, list(i.text ORDER BY i.sec) AS path FROM levels j JOIN levels i ON i.source = j.source AND i.sec <= j.sec
  WHERE NOT EXISTS (SELECT 1 FROM levels k WHERE k.source = j.source AND k.sec > i.sec AND k.sec <= j.sec AND k.level <= i.level) GROUP BY ALL),
secs AS (SELECT source, sec, coalesce(array_to_string(path, ' > '), '') AS heading_path, '[' || array_to_string(list_prepend(source, coalesce(path, [])), ' > ') || ']' AS line FROM (SELECT DISTINCT source, sec FROM placed WHERE NOT is_head) LEFT JOIN paths USING (source, sec)),
held AS (SELECT b.*, row_number() OVER () AS id, {tokens} - {_count("line")} AS budget, {_count("text")} AS words FROM placed b JOIN secs USING (source, sec) WHERE NOT is_head),
lines AS (SELECT id, kind, budget, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM held WHERE words > budget AND kind <> 'paragraph'),
tops2 AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS head FROM lines WHERE kind = 'table' AND (i = 1 OR (i = 2 AND regexp_matches(x, '^\|[\s:|-]+\|$'))) GROUP BY id),
rows_ AS (SELECT l.id, head, budget - coalesce({_count("head")}, 0) AS budget, x, i, count(*) FILTER (WHERE kind = 'table' OR i = 1 OR regexp_matches(x, '{item}')) OVER (PARTITION BY l.id ORDER BY i) AS g FROM lines l LEFT JOIN tops2 USING (id) WHERE kind = 'list' OR i > len(string_split(head, chr(10)))),
items AS (SELECT id, g, any_value(head) AS head, any_value(budget) AS budget, string_agg(x, chr(10) ORDER BY i) AS x FROM rows_ GROUP BY id, g),
item_sums AS (SELECT id, any_value(head) AS head, any_value(budget) AS budget, list(x ORDER BY g) AS xs, list_prepend(0, list(c ORDER BY g)) AS c FROM (SELECT *, CAST(sum({_count("x")} + 1) OVER (PARTITION BY id ORDER BY g) AS BIGINT) AS c FROM items) GROUP BY id),
{_ends("item_groups", "item_sums")},
sentences AS (SELECT id, budget, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT id, budget, string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM held WHERE words > budget AND kind = 'paragraph')),
tokens AS (SELECT id, budget, i, unnest(t) AS x, (generate_subscripts(t, 1) - 1) // (budget // 2) AS g FROM (SELECT *, regexp_extract_all(x, '\S+') AS t FROM sentences WHERE {_count("x")} > budget)),
units AS (SELECT id, budget, i, 0 AS g, x FROM sentences WHERE x <> '' AND {_count("x")} <= budget UNION ALL SELECT id, budget, i, g, string_agg(x, ' ') FROM tokens GROUP BY id, budget, i, g),
unit_sums AS (SELECT id, any_value(budget) AS budget, list(x ORDER BY i, g) AS xs, list_prepend(0, list(c ORDER BY i, g)) AS c FROM (SELECT *, CAST(sum({_count("x")}) OVER (PARTITION BY id ORDER BY i, g) AS BIGINT) AS c FROM units) GROUP BY id),
runs AS (SELECT id, 0 AS k, 0::BIGINT AS a, greatest(1, len(list_filter(c, lambda x: x <= budget)) - 1) AS b, c, budget FROM unit_sums
  UNION ALL SELECT id, k + 1, s, greatest(b + 1, len(list_filter(c, lambda x: x <= c[s + 1] + budget)) - 1), c, budget FROM (SELECT *, CASE WHEN c[b + 2] - c[t + 1] <= budget THEN t ELSE b END AS s FROM (SELECT *, greatest(a, len(list_filter(c, lambda x: x < c[b + 1] - {overlap}))) AS t FROM runs WHERE b < len(c) - 1))),
pieces AS (SELECT id, 0 AS k, text AS x FROM held WHERE words <= budget
  UNION ALL SELECT g.id, k, CASE WHEN head IS NULL THEN '' ELSE head || chr(10) END || array_to_string(xs[a + 1:b], chr(10)) FROM item_groups g JOIN item_sums USING (id)
  UNION ALL SELECT r.id, k, array_to_string(xs[a + 1:b], ' ') FROM runs r JOIN unit_sums USING (id)),
ordered AS (SELECT source, sec, budget, x, row_number() OVER (PARTITION BY source, sec ORDER BY part, sub, k) AS n, {_count("x")} + 1 AS cost FROM pieces JOIN held USING (id)),
sums AS (SELECT (source, sec) AS id, any_value(budget) AS budget, list(x ORDER BY n) AS xs, list_prepend(0, list(c ORDER BY n)) AS c FROM (SELECT *, CAST(sum(cost) OVER (PARTITION BY source, sec ORDER BY n) AS BIGINT) AS c FROM ordered) GROUP BY source, sec),
{_ends("groups", "sums")},
made AS (SELECT source, sec, k, heading_path, line || chr(10) || array_to_string(xs[a + 1:b], chr(10) || chr(10)) AS text FROM groups g JOIN sums USING (id) JOIN secs ON id = (source, sec))
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY sec, k) - 1 AS INT) AS chunk_index, text, heading_path, CAST(NULL AS INT) AS page_start, CAST(NULL AS INT) AS page_end, CAST({_count("text")} AS INT) AS token_count FROM made"""

_PLAIN = _chunks_sql("SELECT source || '/' || doc_id AS source, text AS markdown FROM documents")
ORACLES = {
    "chunk_documents": _PLAIN,
    "structured_chunks": _chunks_sql(_STRUCTURED),
    "chunk_overlaps": rf"""SELECT source, chunk_index, coalesce(first <> '' AND contains(before, first), false) AS overlaps FROM (SELECT source, chunk_index, lag(body) OVER (PARTITION BY source ORDER BY chunk_index) AS before,
  regexp_extract(body, '(?s)^(.*?[.!?…])(?:\s|$)', 1) AS first FROM (SELECT *, regexp_replace(text, '^\[[^\n]*\]\n', '') AS body FROM ({_PLAIN})))""",
}
