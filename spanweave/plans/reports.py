"""Reports over structure and the citation graph, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import lines as L
from ..runtime import table
from . import details, hierarchies, relations, structures
from .texts import _LINES

#: Code points of a text window.
BUDGET = 2000


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    """QRY3: windows of lines: a line belongs to the window in which it starts."""
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text").where("line <> ''")
    return rows.groupBy("doc_id", F.floor(F.col("start_at") / BUDGET).cast("int").alias("window")).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("n_chars"))


def paragraph_range(spark: SparkSession, d: str) -> DataFrame:
    """QRY8, QRY20: text from paragraph 2 to paragraph 4 of documents that have both."""
    p = structures.numbered_paragraphs(spark, d).where("label between 2 and 4")
    span = p.groupBy("doc_id").agg(F.min("start_at").alias("from_at"), F.max("end_at").alias("to_at"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = 2 and hi = 4")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return span.join(docs, "doc_id").select("doc_id", "from_at", "to_at", F.expr("substring(text, from_at + 1, to_at - from_at)").alias("text"))


def lint_report(spark: SparkSession, d: str) -> DataFrame:
    """DOC4, CHK1: findings on each document by kind and severity."""
    found = hierarchies.p6_found(spark, d).select("document_id", "finding").unionByName(relations.numbering_lint(spark, d).select("document_id", "finding"))
    severity = F.when(F.col("finding").isin("cycle", "missing_parent"), "error").when(F.col("finding").isin("below_cycle", "wrong_level"), "warning").otherwise("note")
    return found.groupBy("document_id", "finding", severity.alias("severity")).agg(F.count("*").alias("n"))


def same_opinion(spark: SparkSession, d: str) -> DataFrame:
    """OPN4: renditions of one opinion that share six-word places with the first: 5 % of
    the smaller set, or either empty."""
    o = table(spark, d, "opinion_records").dropDuplicates(["id"]).where("size(renditions) > 1")
    r = o.select("id", F.posexplode("renditions").alias("n", "r"), F.get("renditions", 0)["text"].alias("first")).where("n > 0")

    def places(text):
        w = words(F.coalesce(text, F.lit("")))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 5, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 6), " ")))

    s = r.select("id", "n", places(F.col("first")).alias("a"), places(F.col("r.text")).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return s.select("id", "n", shared.alias("shared"), (shared * 20 >= F.least(F.size("a"), F.size("b"))).alias("same"))


def disposition_sentences(spark: SparkSession, d: str) -> DataFrame:
    """PRJ26, PRJ27: sentences that dispose of a matter."""
    pattern = r"(?:The order stands|The motion fails|The appeal is (?:allowed|dismissed))\."
    o = table(spark, d, "opinion_records").dropDuplicates(["id"])
    texts = o.select("id", F.explode("renditions").alias("r")).unionByName(o.select("id", F.explode("cluster").alias("r")))
    return texts.select("id", F.explode(F.regexp_extract_all(F.col("r.text"), F.lit(f"({pattern})"), 1)).alias("act")).groupBy("id", "act").agg(F.count("*").alias("times"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """REL10: counters of the citation graph."""
    parts = {
        "documents": table(spark, d, "documents").select("doc_id").distinct(), "edges": relations.citation_edges(spark, d), "listed_edges": relations.store_edges(spark, d),
        "authorities": relations.citation_edges(spark, d).select("cited_key").distinct(), "commentary": details.commentary_edges(spark, d)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _summary_sql() -> str:
    e, ls, nt = relations._EDGE, relations._LISTED, details._NOTE
    return (
        f"WITH {e}, {ls}, {nt} SELECT 'documents' AS counter, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'listed_edges', count(*) FROM ls "
        "UNION ALL SELECT 'authorities', count(DISTINCT cited_key) FROM ed UNION ALL SELECT 'commentary', count(*) FROM ce")


_NUMBERED = structures.SQL["numbered_paragraphs"]
_P6 = hierarchies.SQL["p6_found"]
_LINT = relations.SQL["numbering_lint"]
_PLACES = r"list_distinct(list_transform(range(1, greatest(len({w}) - 5, 1) + 1), lambda i: array_to_string({w}[i:i + 5], ' ')))"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

QUERIES = {f.__name__: f for f in (text_windows, paragraph_range, lint_report, same_opinion, disposition_sentences, graph_summary)}
SQL = {
    "text_windows": f"WITH {_LINES} SELECT doc_id, (start_at // {BUDGET})::INT AS \"window\", min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, sum(length(line))::BIGINT AS n_chars FROM l WHERE line <> '' GROUP BY 1, 2",
    "paragraph_range": f"""WITH np AS ({_NUMBERED}), s AS (SELECT doc_id, min(start_at) AS from_at, max(end_at) AS to_at FROM np WHERE label BETWEEN 2 AND 4 GROUP BY 1 HAVING min(label) = 2 AND max(label) = 4)
 SELECT doc_id, from_at, to_at, substr(text, from_at + 1, to_at - from_at) AS text FROM s JOIN documents USING (doc_id)""",
    "lint_report": f"""WITH u AS (SELECT document_id, finding FROM ({_P6}) UNION ALL SELECT document_id, finding FROM ({_LINT}))
 SELECT document_id, finding, CASE WHEN finding IN ('cycle', 'missing_parent') THEN 'error' WHEN finding IN ('below_cycle', 'wrong_level') THEN 'warning' ELSE 'note' END AS severity, count(*) AS n FROM u GROUP BY 1, 2, 3""",
    "same_opinion": f"""WITH o AS (SELECT DISTINCT id, renditions FROM opinion_records WHERE len(renditions) > 1), r AS (SELECT id, unnest(renditions) AS r, generate_subscripts(renditions, 1) - 1 AS n, renditions[1].text AS first FROM o),
 w AS (SELECT id, n, {_WORDS.format(t='first')} AS wa, {_WORDS.format(t='r.text')} AS wb FROM r WHERE n > 0), s AS (SELECT id, n, {_PLACES.format(w='wa')} AS a, {_PLACES.format(w='wb')} AS b FROM w)
 SELECT id, n::INT AS n, len(list_intersect(a, b))::INT AS shared, len(list_intersect(a, b)) * 20 >= least(len(a), len(b)) AS same FROM s""",
    "disposition_sentences": r"""WITH o AS (SELECT DISTINCT id, renditions, "cluster" FROM opinion_records), t AS (SELECT id, unnest(renditions).text AS t FROM o UNION ALL SELECT id, unnest("cluster").text FROM o),
 a AS (SELECT id, unnest(regexp_extract_all(t, '(?:The order stands|The motion fails|The appeal is (?:allowed|dismissed))\.')) AS act FROM t) SELECT id, act, count(*) AS times FROM a GROUP BY 1, 2""",
    "graph_summary": _summary_sql(),
}
