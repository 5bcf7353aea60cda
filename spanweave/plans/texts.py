"""Queries over lines, tokens and store fields, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from ..runtime import table
from ..sources import stores


def text_statistics(spark: SparkSession, d: str) -> DataFrame:
    """PRJ, STA: sizes of texts in code points, UTF-16 units, words and lines."""
    return L.statistics(table(spark, d, "documents"), "doc_id", "text")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """PRJ12: lines with offsets."""
    return L.lines(table(spark, d, "documents"), "doc_id", "text")


def line_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of lines counted by document."""
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id", L.line_class(F.col("line")).alias("line_class")).agg(F.count("*").alias("n"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in more than one document (running matter)."""
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text").where("line <> ''")
    return rows.groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("docs > 1")


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """TXT1, TXT3: words of the corpus with occurrences and documents."""
    return L.tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """TXT2: occurrences of a phrase, anchored on word positions."""
    phrase = ["on", "this", "record"]
    words = L.tokens(table(spark, d, "documents"), "doc_id", "text").where(F.col("word").isin(phrase))
    hit = words.where(F.col("word") == phrase[0]).select("doc_id", F.col("pos").alias("at"))
    for n, w in enumerate(phrase[1:], 1):
        hit = hit.join(words.where(F.col("word") == w).select("doc_id", (F.col("pos") - n).alias("at")), ["doc_id", "at"])
    return hit.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("at").alias("first_at"))


def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """STA5: SHA-256 digests of texts, and how many documents share one."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"))


def store_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, SRC9: store documents with language fallback."""
    return stores.documents(spark, d).select("document_id", "doc_type", "dataset", "citation", "name", "document_date")


def store_documents_fr(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: the same in French first."""
    return stores.documents(spark, d, "fr").select("document_id", "citation", "name", "document_date")


def store_provisions(spark: SparkSession, d: str) -> DataFrame:
    """SRC10, OUT3: provisions of statutes in order."""
    return stores.provisions(spark, d)


def store_courts(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: courts with their documents."""
    return stores.courts(spark, d)


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC31, SRC32: lines of journal pages counted by page and kind of region."""
    return stores.page_lines(spark, d).groupBy("page_id", "kind").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def link_fragments(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5, QRY22: link names of nodes."""
    n = table(spark, d, "structure_nodes").dropDuplicates(["document_id", "id"])
    return n.select("document_id", "id", T.statute_fragment(F.col("kind"), F.col("label")).alias("fragment"), T.ordinal(F.col("label")).alias("ordinal")).where("fragment is not null")


def page_values(spark: SparkSession, d: str) -> DataFrame:
    """QRY12, QRY27: page labels as numbers, Roman or Arabic."""
    p = table(spark, d, "journal_pages").select("page_id", "page_label").distinct()
    return p.select("page_id", "page_label", F.coalesce(F.col("page_label").try_cast("int"), T.roman_value(F.lower("page_label"))).alias("page_value"))


_LINES = r"""
t AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(1) || chr(10)) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, regexp_split_to_array(t, '[\n\r\x{2028}\x{2029}]') AS parts FROM t),
e AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS line_no FROM p),
l AS (SELECT doc_id, line_no, replace(part, chr(1), '') AS line,
        coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM e)"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in L.CLASSES) + " ELSE 'prose' END"


def _field(base: str, first: str = "en", second: str = "fr") -> str:
    return f"coalesce(nullif(trim({base}_{first}), ''), nullif(trim({base}_{second}), ''))"


_DOCS = "(SELECT DISTINCT * FROM source_documents)"
_ROMAN = "CASE WHEN regexp_matches(l, '^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') AND l <> '' THEN list_sum(list_transform(range(1, length(l) + 1), lambda i: CASE WHEN {v} < coalesce({w}, 0) THEN -{v} ELSE {v} END)) END"
_V = "CASE substr(l, {i}, 1) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 END"

QUERIES = {f.__name__: f for f in (text_statistics, document_lines, line_classes, repeated_lines, word_counts, phrase_hits, text_digests, store_documents, store_documents_fr, store_provisions, store_courts, page_lines, link_fragments, page_values)}
SQL = {
    "text_statistics": f"""SELECT doc_id, length(text)::INT AS n_points,
 (length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT AS n_utf16,
 len({_WORDS})::INT AS n_words, len(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{2028}}\\x{{2029}}]'))::INT AS n_lines FROM documents""",
    "document_lines": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, start_at::INT AS start_at, (start_at + length(line))::INT AS end_at, line FROM l",
    "line_classes": f"WITH {_LINES} SELECT doc_id, {_CLASS} AS line_class, count(*) AS n FROM l GROUP BY 1, 2",
    "repeated_lines": f"WITH {_LINES} SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1",
    "word_counts": f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY word",
    "phrase_hits": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'on' AND ws[i + 1] = 'this' AND ws[i + 2] = 'record')) - 1 AS at_ FROM w)
 SELECT doc_id, count(*) AS hits, min(at_)::INT AS first_at FROM h GROUP BY doc_id""",
    "text_digests": "SELECT sha256(text) AS text_sha256, count(*) AS docs, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "store_documents": f"SELECT document_id, doc_type, regexp_replace(upper(trim(dataset)), '-ARCHIVE$', '') AS dataset, {_field('citation')} AS citation, {_field('name')} AS name, {_field('document_date')} AS document_date FROM {_DOCS}",
    "store_documents_fr": f"SELECT document_id, {_field('citation', 'fr', 'en')} AS citation, {_field('name', 'fr', 'en')} AS name, {_field('document_date', 'fr', 'en')} AS document_date FROM {_DOCS}",
    "store_provisions": f"""WITH s AS (SELECT document_id, {_field('unofficial_sections')} AS j FROM {_DOCS} WHERE doc_type = 'laws'),
 k AS (SELECT document_id, unnest(json_keys(j)) AS label, j FROM s WHERE j IS NOT NULL)
 SELECT document_id, label, json_extract_string(j, '$."' || label || '"') AS text,
  row_number() OVER (PARTITION BY document_id ORDER BY TRY_CAST(label AS INT) ASC NULLS LAST, label)::INT AS ordinal FROM k""",
    "store_courts": f"""WITH c AS (SELECT doc_type, regexp_replace(upper(trim(dataset)), '-ARCHIVE$', '') AS dataset, count(*) AS documents FROM {_DOCS} GROUP BY 1, 2)
 SELECT doc_type, c.dataset, documents, court_name FROM c LEFT JOIN courts USING (dataset)""",
    "page_lines": """WITH r AS (SELECT page_id, unnest(regions) AS r FROM journal_pages), l AS (SELECT page_id, r.kind AS kind, unnest(r.lines) AS l FROM r)
 SELECT page_id, kind, count(*) AS n_lines, sum(length(l.text))::BIGINT AS n_chars FROM l GROUP BY 1, 2""",
    "link_fragments": r"""WITH n AS (SELECT DISTINCT document_id, id, kind, label FROM structure_nodes),
 b AS (SELECT *, regexp_replace(lower(label), '^(s\.|para\.?|art\.?)\s*|[().\s]', '', 'g') AS bare,
  CASE kind WHEN 'paragraph' THEN 'par' WHEN 'footnote' THEN 'fn' WHEN 'page' THEN 'page' WHEN 'section' THEN 'sec' END AS mark FROM n)
 SELECT document_id, id, mark || bare AS fragment, TRY_CAST(nullif(regexp_extract(label, '(\d{1,9})', 1), '') AS INT) AS ordinal FROM b WHERE mark IS NOT NULL AND length(bare) > 0""",
    "page_values": "WITH p AS (SELECT DISTINCT page_id, page_label, lower(page_label) AS l FROM journal_pages) SELECT page_id, page_label, coalesce(TRY_CAST(page_label AS INT), " + _ROMAN.replace("{v}", _V.replace("{i}", "i")).replace("{w}", _V.replace("{i}", "i + 1")) + ")::INT AS page_value FROM p",
}
