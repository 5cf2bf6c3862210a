"""Labels, fingerprints, cleaning, records, chunks and history."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import day, grouped_number, is_line_candidate, line_key, record
from skarn.operators import catalog as C
from skarn.operators import chunk, clean, index, logs
from skarn.plans.common import LABELS_SQL, catalog, documents, spread
from skarn.runtime import table
from skarn.settings import DEFAULT

#: Of these pages, a line has to stand on every hundredth.
_SHARE = dataclasses.replace(DEFAULT, repeated_share=0.01)


def catalog_labels(spark, sf_dir: str) -> DataFrame:
    """Every document with its labels; what is not catalogued is restricted."""
    return C.labelled(documents(spark, sf_dir).select("doc_id", "source"), catalog(spark)).select("doc_id", "source", "access_level", "status", "replaced_by", "catalogued")


def catalog_violations(spark, sf_dir: str) -> DataFrame:
    """All broken rules of a catalog with an entry for every document, whose fields are made of its id."""
    n = F.col("doc_id")
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    raw = documents(spark, sf_dir).select(
        n.cast("int").alias("entry"), F.when(n % 17 == 0, "").when(n % 10 == 1, name(n - 1)).otherwise(name(n)).alias("file"), F.when(n % 5 == 0, "secret").otherwise("internal").alias("access_level"),
        F.when(n % 7 == 0, "superseded").when(n % 7 == 1, "draft").otherwise("active").alias("status"), F.lit("2024-01-01").alias("effective_date"), F.when(n % 3 == 0, "date").when(n % 3 == 1, "str").alias("date_kind"),
        F.when(n % 14 == 0, name(n + 1)).when(n % 28 == 9, "nowhere").alias("replaced_by"), F.when(n % 11 == 0, F.array(F.lit("file"), F.lit("acess_level"))).otherwise(F.array(F.lit("file"))).alias("fields"),
    )
    return C.violations(raw)


def missing_catalog_files(spark, sf_dir: str) -> DataFrame:
    """Catalog entries without a document; one more than the sources is listed."""
    listed = catalog(spark).select("file").unionByName(spark.createDataFrame([("src99",)], "file string"))
    return C.missing_files(listed, documents(spark, sf_dir).select(F.col("source").alias("file")).distinct())


def ocr_range_flag(spark, sf_dir: str) -> DataFrame:
    """Orders as documents and lines as pages: a chunk from the first page to the next; returned lines are OCR pages."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("number"), (F.col("l_returnflag") == "R").alias("ocr"))
    chunks = lines.groupBy("source").agg(F.min("number").alias("page_start")).withColumn("page_end", F.col("page_start") + 1)
    return C.with_ocr(chunks, lines).select(F.col("source").alias("order_key"), "page_start", "page_end", "ocr")


def _pages(spark, sf_dir: str) -> DataFrame:
    """Documents as pages of the group of their language and source."""
    return documents(spark, sf_dir).select(F.concat_ws("/", "lang", "source").alias("source"), F.col("doc_id").alias("number"), F.col("text").alias("markdown"))


def repeated_lines(spark, sf_dir: str) -> DataFrame:
    return clean.repeated_lines(spread(_pages(spark, sf_dir)), _SHARE)


def clean_repeated_lines(spark, sf_dir: str) -> DataFrame:
    """How many kinds of lines each page loses."""
    return clean.without_repeated(spread(_pages(spark, sf_dir)), _SHARE).select(F.col("number").alias("doc_id"), F.size("removed").alias("n_removed"))


def html_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return clean.with_main_text(spread(table(spark, sf_dir, "pages").select("page_id", "html"))).select("page_id", "text")


def records_from_rows(spark, sf_dir: str) -> DataFrame:
    """Orders as records."""
    o = table(spark, sf_dir, "orders")
    fields = [("Order", F.col("o_orderkey").cast("string")), ("Total", grouped_number(F.col("o_totalprice"))), ("Date", day(F.col("o_orderdate"))), ("", F.trim("o_orderpriority")), ("Note", F.lit(""))]
    return o.select("o_orderkey", record(fields).alias("record"))


def history_last3(spark, sf_dir: str) -> DataFrame:
    """Every user question with the three before it."""
    return logs.with_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.concat_ws(" / ", "history").alias("history"), F.size("history").alias("n_history"))


def _line_chunks(spark, sf_dir: str) -> DataFrame:
    """(doc_id, pos, words, part): the lines of every document, packed greedily to 450 words."""
    d = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("lines"))
    words = F.transform("lines", lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    packed = d.withColumn("words", words).withColumn("parts", chunk.greedy_groups(F.col("words"), lambda n: n, DEFAULT.chunk_tokens))
    return packed.select("doc_id", F.posexplode(F.arrays_zip("words", "parts")).alias("pos", "x")).select("doc_id", "pos", F.col("x.words").alias("words"), F.col("x.parts").alias("part"))


def greedy_chunks(spark, sf_dir: str) -> DataFrame:
    """The chunks of every document: lines and words in each."""
    return _line_chunks(spark, sf_dir).groupBy("doc_id", "part").agg(F.count("*").alias("lines"), F.sum("words").alias("words"))


def chunk_size_stats(spark, sf_dir: str) -> DataFrame:
    """Least, median and greatest chunk by source and overall."""
    sizes = greedy_chunks(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return sizes.groupingSets([["source"], []], "source").agg(F.count("*").alias("chunks"), F.min("words").alias("least"), F.median("words").alias("median"), F.max("words").alias("most"))


def _files(spark, sf_dir: str) -> DataFrame:
    """Each source as a file. Its hash is a sum over its texts, so no task ever holds a source, and their order is none."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("text")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return documents(spark, sf_dir).groupBy("source").agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), F.sum(digest).cast("string")).cast("binary"), 256).alias("file_hash"))


def fingerprints(spark, sf_dir: str) -> DataFrame:
    """A fingerprint for every source, over its texts, the settings and its labels."""
    return index.fingerprints(_files(spark, sf_dir), catalog(spark))


def sync_plan(spark, sf_dir: str) -> DataFrame:
    """What a sync would do after every third source has changed, src18 is new and src90 is gone."""
    now = fingerprints(spark, sf_dir)
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    then = now.where(n != 18).select("source", F.when(n % 3 == 0, F.concat(F.lit("old"), "fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    then = then.unionByName(spark.createDataFrame([("src90", "x"), ("src1", "half-written")], "source string, fingerprint string"))
    return index.sync_plan(now, index.stored_fingerprints(then))


def sync_actions(spark, sf_dir: str) -> DataFrame:
    return sync_plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


def duplicate_keys(spark, sf_dir: str) -> DataFrame:
    """Texts that stand in several documents, by hash."""
    return documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def lost_words(spark, sf_dir: str) -> DataFrame:
    """Words that cleaning takes away, with multiplicity."""
    lost = clean.marked_lines(spread(_pages(spark, sf_dir)), _SHARE).where("out")
    # Words stand in one line each, so those of the lines taken out are all that is lost; equal lines are cut into words once.
    lines = lost.groupBy("line").agg(F.count("*").alias("n"))
    words = lines.select("n", F.explode(F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.sum("n").alias("lost"))


def line_profile(spark, sf_dir: str) -> DataFrame:
    """Lines that could be headers or footers, by document."""
    lines = clean.page_lines(_pages(spark, sf_dir)).where(is_line_candidate(F.col("line")))
    return lines.groupBy(F.col("number").alias("doc_id")).agg(F.count("*").alias("candidates"), F.count_distinct(line_key(F.col("line"))).alias("kinds"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_labels, catalog_violations, missing_catalog_files, ocr_range_flag, repeated_lines, clean_repeated_lines, html_main_text, records_from_rows, history_last3, greedy_chunks,
        chunk_size_stats, fingerprints, sync_plan, sync_actions, duplicate_keys, lost_words, line_profile,
    )
}

_LINES = """pages AS (SELECT lang || '/' || source AS source, doc_id AS number, text FROM documents),
lines AS (SELECT source, number, unnest(string_split(text, chr(10))) AS line FROM pages),
cand AS (SELECT *, CASE WHEN trim(line) <> '' AND length(trim(line)) <= 150 AND NOT regexp_matches(trim(line), '^[#|]') THEN regexp_replace(lower(trim(line)), '\\p{Nd}+', '#', 'g') END AS line_key FROM lines),
least AS (SELECT source, greatest(2, CAST(ceil(count(DISTINCT number) * 0.01) AS BIGINT)) AS least FROM pages GROUP BY source),
repeated AS (SELECT source, line_key, count(DISTINCT number) AS pages, any_value(least) AS least FROM cand JOIN least USING (source) WHERE line_key IS NOT NULL GROUP BY source, line_key HAVING count(DISTINCT number) >= any_value(least)),
marked AS (SELECT c.*, r.line_key IS NOT NULL OR regexp_matches(c.line, '(?i)^\\s*(sayfa|page)\\s*\\p{Nd}+(\\s*(/|of)\\s*\\p{Nd}+)?\\s*$') AS out FROM cand c LEFT JOIN repeated r ON c.source = r.source AND c.line_key = r.line_key)"""
_SIG = "none|450|50|v1|k1=1.2|b=0.75|avg=60|prefix=5"
_PRINTS = f"""files AS (SELECT source, sha256(count(*) || '/' || CAST(sum(CAST(('0x' || left(sha256(concat_ws('/', doc_id, text)), 12)) AS HUGEINT)) AS VARCHAR)) AS file_hash FROM documents GROUP BY source),
{LABELS_SQL},
lab AS (SELECT source, any_value(access_level) AS access_level, any_value(status) AS status, any_value(effective_date) AS effective_date, any_value(replaced_by) AS replaced_by, any_value(catalogued) AS catalogued FROM labelled GROUP BY source),
prints AS (SELECT source, sha256(concat_ws('|', file_hash, '{_SIG}', access_level, status, coalesce(effective_date, 'None'), coalesce(replaced_by, 'None'))) AS fingerprint, catalogued FROM files JOIN lab USING (source))"""
_PLAN = f"""{_PRINTS},
num AS (SELECT *, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n FROM prints),
old AS (SELECT source, CASE WHEN n % 3 = 0 THEN 'old' || fingerprint ELSE fingerprint END AS fingerprint FROM num WHERE n <> 18 UNION ALL VALUES ('src90', 'x'), ('src1', 'half-written')),
stored AS (SELECT source, list_sort(list(DISTINCT fingerprint)) AS stored FROM old GROUP BY source),
plan AS (SELECT coalesce(p.source, s.source) AS source, CASE WHEN p.fingerprint IS NULL THEN 'remove' WHEN s.stored = [p.fingerprint] THEN 'unchanged' ELSE 'index' END AS action,
  CASE WHEN NOT coalesce(catalogued, true) THEN 'not in the catalog, restricted' ELSE '' END AS detail FROM prints p FULL JOIN stored s ON p.source = s.source)"""
_GREEDY = """items AS (SELECT doc_id, pos - 1 AS pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
walk AS (SELECT doc_id, pos, words, 0 AS part, words + 1 AS used FROM items WHERE pos = 0
  UNION ALL SELECT i.doc_id, i.pos, i.words, CASE WHEN w.used + i.words + 1 <= 450 THEN w.part ELSE w.part + 1 END, CASE WHEN w.used + i.words + 1 <= 450 THEN w.used + i.words + 1 ELSE i.words + 1 END
  FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.pos = w.pos + 1),
chunks AS (SELECT doc_id, part, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words FROM walk GROUP BY doc_id, part)"""
_WORDS = "unnest(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"

#: Pieces of a page, and a walk over its tags with the elements that are open, the root and what hides the text.
_MAIN_TEXT = r"""WITH RECURSIVE pieces AS (SELECT page_id, unnest(t) AS piece, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT page_id,
  regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|<[!?][^>]*>|<script[\s>].*?(?:</script\s*>|\z)|<style[\s>].*?(?:</style\s*>|\z)|</?[a-z](?:[^''">]|"[^"]*"|''[^'']*'')*>|[^<]+|<') AS t FROM pages)),
named AS (SELECT *, lower(regexp_extract(piece, '(?i)^</?([a-z][^\s/>]*)', 1)) AS name, piece LIKE '</%' AS ends FROM pieces),
tags AS (SELECT page_id, pos, name, ends, NOT ends AND (name IN ('nav', 'footer', 'aside', 'noscript', 'form') OR regexp_matches(piece, '(?is)\s(class|id)\s*=\s*("[^"]*|''[^'']*|[^\s>]*)(cookie|consent|banner|breadcrumb|navbar|sidebar)')) AS noisy,
  row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM named
  WHERE name NOT IN ('', 'script', 'style', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AND piece NOT LIKE '%/>'),
roots AS (SELECT page_id, CASE WHEN bool_or(name = 'main') THEN 'main' WHEN bool_or(name = 'article') THEN 'article' WHEN bool_or(name = 'body') THEN 'body' END AS root FROM tags WHERE NOT ends GROUP BY page_id),
walk AS (SELECT page_id, 0::BIGINT AS n, -1::BIGINT AS pos, CAST([] AS VARCHAR[]) AS open, NULL::BIGINT AS root_depth, false AS left_root, NULL::BIGINT AS hidden, root FROM (SELECT DISTINCT page_id FROM pages) LEFT JOIN roots USING (page_id)
  UNION ALL SELECT page_id, n, pos, now, CASE WHEN opens THEN len(was) ELSE root_depth END, left_root OR (ends AND coalesce(root_depth >= len(now), false)),
    CASE WHEN ends AND hidden >= len(now) THEN NULL WHEN hidden IS NULL AND noisy AND (root IS NULL OR root_depth IS NOT NULL) THEN len(was) ELSE hidden END, root
  FROM (SELECT w.page_id, t.n, t.pos, t.ends, t.noisy, w.open AS was, w.root_depth, w.left_root, w.hidden, w.root, NOT t.ends AND t.name = w.root AND w.root_depth IS NULL AS opens,
    CASE WHEN NOT t.ends THEN list_append(w.open, t.name) WHEN list_contains(w.open, t.name) THEN w.open[1:len(w.open) - list_position(list_reverse(w.open), t.name)] ELSE w.open END AS now
    FROM walk w JOIN tags t ON t.page_id = w.page_id AND t.n = w.n + 1)),
seen AS (SELECT p.page_id, p.pos, p.piece, p.name, (w.root IS NULL OR (w.root_depth IS NOT NULL AND NOT w.left_root)) AND w.hidden IS NULL AS shown FROM named p ASOF JOIN walk w ON p.page_id = w.page_id AND p.pos >= w.pos),
said AS (SELECT page_id, string_agg(CASE WHEN name IN ('p', 'div', 'section', 'article', 'main', 'li', 'ul', 'ol', 'table', 'tr', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'header', 'blockquote', 'pre', 'br') THEN CASE WHEN shown OR before THEN chr(10) ELSE '' END WHEN NOT shown OR (piece LIKE '<_%') THEN ''
  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') END, '' ORDER BY pos) AS text FROM (SELECT *, lag(shown, 1, false) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM seen) GROUP BY page_id)
SELECT page_id, coalesce(regexp_replace(regexp_replace(regexp_replace(text, '[\t\x0B\f\r \x1c-\x1f\p{Z}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g'), '') AS text FROM (SELECT DISTINCT page_id FROM pages) LEFT JOIN said USING (page_id)"""
ORACLES = {
    "catalog_labels": f"WITH {LABELS_SQL} SELECT doc_id, source, access_level, status, replaced_by, catalogued FROM labelled",
    "catalog_violations": """WITH r AS (SELECT CAST(doc_id AS INT) AS entry, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'f' || (doc_id - 1) ELSE 'f' || doc_id END AS file, doc_id AS n,
  CASE WHEN doc_id % 14 = 0 THEN 'f' || (doc_id + 1) WHEN doc_id % 28 = 9 THEN 'nowhere' END AS replaced_by FROM documents)
SELECT entry, file, 'no file' AS rule FROM r WHERE file = '' UNION ALL SELECT entry, file, 'unknown field' FROM r WHERE n % 11 = 0 UNION ALL SELECT entry, file, 'access level' FROM r WHERE n % 5 = 0
UNION ALL SELECT entry, file, 'status' FROM r WHERE n % 7 = 1 UNION ALL SELECT entry, file, 'date' FROM r WHERE n % 3 = 1
UNION ALL SELECT entry, file, 'superseded without replacement or the reverse' FROM r WHERE (n % 7 = 0) <> (replaced_by IS NOT NULL)
UNION ALL SELECT entry, file, 'listed more than once' FROM r WHERE file <> '' AND file IN (SELECT file FROM r GROUP BY file HAVING count(*) > 1)
UNION ALL SELECT entry, file, 'replacement is not listed' FROM r WHERE replaced_by IS NOT NULL AND replaced_by NOT IN (SELECT file FROM r)""",
    "missing_catalog_files": "SELECT file FROM (SELECT 'src' || i AS file FROM range(19) t(i) UNION ALL SELECT 'src99') WHERE file NOT IN (SELECT source FROM documents)",
    "ocr_range_flag": """WITH c AS (SELECT l_orderkey AS order_key, min(l_linenumber) AS page_start, min(l_linenumber) + 1 AS page_end FROM lineitem GROUP BY l_orderkey)
SELECT order_key, page_start, page_end, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = order_key AND l_returnflag = 'R' AND l_linenumber BETWEEN page_start AND page_end) AS ocr FROM c""",
    "repeated_lines": f"WITH {_LINES} SELECT source, line_key, pages, least FROM repeated",
    "clean_repeated_lines": f"WITH {_LINES} SELECT number AS doc_id, count(DISTINCT CASE WHEN out THEN trim(line) END) AS n_removed FROM marked GROUP BY number",
    "records_from_rows": """SELECT o_orderkey, 'Order: ' || o_orderkey || ' | Total: ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' | Date: ' ||
  CASE WHEN strftime(o_orderdate, '%H:%M:%S') = '00:00:00' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%d.%m.%Y %H:%M') END || ' | Column 4: ' || trim(o_orderpriority) AS record FROM orders""",
    "history_last3": """SELECT conv_id, turn, coalesce(array_to_string(h, ' / '), '') AS history, coalesce(len(h), 0) AS n_history FROM (
  SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h FROM conversations WHERE role = 'user' AND trim(text) <> '')""",
    "html_main_text": _MAIN_TEXT,
    "greedy_chunks": f"WITH RECURSIVE {_GREEDY} SELECT doc_id, part, lines, words FROM chunks",
    "chunk_size_stats": f"WITH RECURSIVE {_GREEDY} SELECT source, count(*) AS chunks, min(words) AS least, median(words) AS median, max(words) AS most FROM chunks JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source), ())",
    "fingerprints": f"WITH {_PRINTS} SELECT source, fingerprint, catalogued FROM prints",
    "sync_plan": f"WITH {_PLAN} SELECT source, action, detail FROM plan",
    "sync_actions": f"WITH {_PLAN} SELECT action, count(*) AS n FROM plan GROUP BY action",
    "duplicate_keys": "SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "lost_words": f"""WITH {_LINES}, gone AS (SELECT {_WORDS.format("line")} AS word FROM marked WHERE out) SELECT word, count(*) AS lost FROM gone GROUP BY word""",
    "line_profile": f"WITH {_LINES} SELECT number AS doc_id, count(*) AS candidates, count(DISTINCT line_key) AS kinds FROM cand WHERE line_key IS NOT NULL GROUP BY number",
}
