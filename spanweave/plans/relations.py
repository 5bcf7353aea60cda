"""Queries over citations, search, nodes and statistics, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import citation_key, name_key
from ..operators import citations as C
from ..operators import lines as L
from ..operators import nodes as N
from ..operators import search as S
from ..runtime import table
from ..sources import stores
from .texts import _LINES


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return N.distinct_nodes(table(spark, d, "structure_nodes"))


def citation_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """CIT1, TXT: neutral citations with their places."""
    return C.occurrences(_docs(spark, d), "doc_id", "text")


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    """REL1, SET2: edges without a decision's own citation."""
    return C.edges(_docs(spark, d), "doc_id", "text", "citation")


def citation_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """REL2: the words around each citation."""
    return C.excerpts(_docs(spark, d), "doc_id", "text")


def authority_metric(spark: SparkSession, d: str) -> DataFrame:
    """REL9, REL18: how often each authority is cited."""
    return C.metrics(C.edges(_docs(spark, d), "doc_id", "text", "citation"))


def note_up(spark: SparkSession, d: str) -> DataFrame:
    """REL11, REL14, REL30: citing documents of each authority in order."""
    docs = _docs(spark, d)
    return C.note_up(C.edges(docs, "doc_id", "text", "citation"), docs)


def store_edges(spark: SparkSession, d: str) -> DataFrame:
    """REL6: edges a store lists."""
    return C.listed(table(spark, d, "source_documents"), "document_id", "cases_cited_en")


def confirmed_edges(spark: SparkSession, d: str) -> DataFrame:
    """SET1-SET3: keys listed by the store, mined from texts, or both."""
    mined = C.edges(_docs(spark, d), "doc_id", "text", "citation").select("cited_key", F.lit(1).alias("m"), F.lit(0).alias("l"))
    listed = store_edges(spark, d).select("cited_key", F.lit(0).alias("m"), F.lit(1).alias("l"))
    return mined.unionByName(listed).groupBy("cited_key").agg(F.max("m").alias("m"), F.max("l").alias("l")).select("cited_key", F.when(F.col("m") + F.col("l") == 2, "both").when(F.col("m") == 1, "mined").otherwise("listed").alias("origin"))


def citation_resolution(spark: SparkSession, d: str) -> DataFrame:
    """REL20, REL24: cited keys and the documents that bear them: none, one or several."""
    held = stores.documents(spark, d).select(citation_key(F.col("citation")).alias("cited_key"), "document_id").where("cited_key is not null")
    cited = store_edges(spark, d).select("cited_key").distinct()
    return cited.join(held, "cited_key", "left").groupBy("cited_key").agg(F.count("document_id").alias("documents"), F.min("document_id").alias("first_id")).withColumn("status", F.when(F.col("documents") == 0, "none").when(F.col("documents") == 1, "one").otherwise("several"))


def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """REL22, REL23: names that lead to just one document."""
    named = stores.documents(spark, d).select(name_key(F.col("name")).alias("name_key"), "document_id").where("length(name_key) > 0")
    return named.groupBy("name_key").agg(F.count("*").alias("documents"), F.min("document_id").alias("document_id")).where("documents = 1").select("name_key", "document_id")


def duplicate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """REL5: decisions entered more than once: one court and citation, several ids."""
    return stores.documents(spark, d).where("citation is not null").groupBy("dataset", citation_key(F.col("citation")).alias("key")).agg(F.count("*").alias("documents"), F.min("document_id").alias("kept")).where("key is not null and documents > 1")


def court_levels(spark: SparkSession, d: str) -> DataFrame:
    """REL13: decisions by level of court and decade."""
    level = F.when(F.col("court_name").contains("Supreme"), 5).when(F.col("court_name").contains("Appeal"), 4).when(F.col("court_name").contains("Superior") | F.col("court_name").contains("Federal") | F.col("court_name").contains("Bench"), 3).when(F.col("court_name").contains("Court"), 2).otherwise(1)
    docs = stores.documents(spark, d).where("doc_type = 'cases'").join(F.broadcast(table(spark, d, "courts")), "dataset")
    return docs.groupBy(level.alias("level"), (F.floor(F.substring("document_date", 1, 4).try_cast("int") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("decisions"))


def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """SCH1, REL28: a boolean query ranked by BM25 (a top-50 report)."""
    return S.search(_docs(spark, d), "doc_id", "text", 'appeal AND (landlord OR tenant) -"on appeal"')


def boolean_hits(spark: SparkSession, d: str) -> DataFrame:
    """SCH1: all documents that answer a query with a prefix and a phrase."""
    from ..functions.text import words

    node = S.parse('munic* AND "in my view" NOT coroner')
    return _docs(spark, d).where("text is not null").select("doc_id", words(F.col("text")).alias("ws")).where(S.condition(node, F.col("ws"))).select("doc_id")


def hit_listing(spark: SparkSession, d: str) -> DataFrame:
    """REL34, REL35: listings by case, newest first."""
    hits = table(spark, d, "search_hits").where("cluster_id is not null").distinct()
    order = Window.partitionBy("cluster_id").orderBy(F.desc("listed_at"), "hit_id")
    return hits.select("cluster_id", "hit_id", F.row_number().over(order).alias("rank"))


def late_hits(spark: SparkSession, d: str) -> DataFrame:
    """As-of: hits listed earlier than the latest listing among smaller ids, with that listing.

    The running maximum is taken inside ranges of ids and carried over the ranges' maxima, so
    no window holds more than a range of hits or one row for each range."""
    hits = table(spark, d, "search_hits").where("hit_id is not null and listed_at is not null").groupBy("hit_id").agg(F.min("listed_at").alias("listed_at"))
    ranged = hits.withColumn("range", F.floor(F.col("hit_id") / 4096))
    inside = Window.partitionBy("range").orderBy("hit_id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("range").agg(F.max("listed_at").alias("top")).select("range", F.max("top").over(over).alias("carried"))
    seen = ranged.withColumn("own", F.max("listed_at").over(inside)).join(carried, "range").withColumn("latest", F.greatest("own", "carried"))
    return seen.where("listed_at < latest").select("hit_id", F.unix_micros("listed_at").alias("listed_at"), F.unix_micros("latest").alias("latest"))


def node_order(spark: SparkSession, d: str) -> DataFrame:
    """QRY1, QRY2: nodes in served order."""
    return N.projection(_nodes(spark, d))


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """QRY7, QRY22, QRY26: section labels with their status."""
    return N.lookup(_nodes(spark, d), "section")


def smallest_container(spark: SparkSession, d: str) -> DataFrame:
    """QRY9, REL3: the line that holds each citation."""
    docs = _docs(spark, d)
    lines = L.lines(docs, "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.col("line_no").alias("id"), "start_at", "end_at")
    points = C.occurrences(docs, "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.col("start_at").alias("at"))
    return N.containing(points, lines)


def node_extents(spark: SparkSession, d: str) -> DataFrame:
    """STA4, QRY28: union of ranges by kind."""
    return N.extents(_nodes(spark, d)).select("document_id", "kind", "start_at", "end_at")


def numbering_lint(spark: SparkSession, d: str) -> DataFrame:
    """DOC1: gaps and duplicates in numbering."""
    return N.numbering(_nodes(spark, d))


def node_children(spark: SparkSession, d: str) -> DataFrame:
    """QRY19: children of each node."""
    return N.subtree_sizes(_nodes(spark, d))


def article_pages(spark: SparkSession, d: str) -> DataFrame:
    """CHK1, REL8: pages of each article, the first and last printed number, pages without one."""
    p = table(spark, d, "journal_pages").select("article_id", "pdf_page", "page_label").distinct()
    return p.groupBy("article_id").agg(
        F.count("*").alias("pages"), F.max("pdf_page").alias("last_page"), F.sum(F.col("page_label").isNull().cast("int")).alias("unlabelled"),
        F.min(F.col("page_label").try_cast("int")).alias("first_label"), F.max(F.col("page_label").try_cast("int")).alias("last_label"))


def length_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """STA1: median and quantiles of text lengths by type, nearest rank."""
    docs = _docs(spark, d).where("text is not null and doc_type is not null").groupBy("doc_type", F.length("text").alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("doc_type").orderBy("n")
    ranked = docs.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("doc_type")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q + 0.5), F.col("n")))
    return ranked.groupBy("doc_type").agg(at(0.5).alias("median"), at(0.9).alias("q90"), F.max("n").alias("longest"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the event stream (batch equivalent of the stream)."""
    from ..streaming.ingest import windowed

    return windowed(table(spark, d, "events"))


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    """SRC23: opinions with their citations and renditions."""
    o = table(spark, d, "opinion_records").dropDuplicates(["id"])
    return o.select("id", F.size("citations").alias("n_citations"), F.size("renditions").alias("n_renditions"), F.size("cluster").alias("n_cluster"), F.get(F.transform("citations", lambda c: F.concat_ws(" ", c["volume"], c["reporter"], c["page"])), 0).alias("first_citation"))


_OCC = r"""
o AS (SELECT doc_id, citation, document_date, text, regexp_extract_all(text, '\b(?:19|20)\d{2} [A-Z]{2,8} \d{1,4}\b') AS cs, regexp_split_to_array(text, '\b(?:19|20)\d{2} [A-Z]{2,8} \d{1,4}\b') AS bs FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, citation, document_date, text, unnest(cs) AS c, generate_subscripts(cs, 1) AS n, cs, bs FROM o),
oc AS (SELECT doc_id, citation, document_date, text, n::INT AS occurrence, (list_sum(list_transform(bs[:n], lambda b: length(b))) + coalesce(list_sum(list_transform(cs[:n - 1], lambda b: length(b))), 0))::INT AS start_at, replace(c, ' ', ':') AS cited_key FROM x)"""
_KEY = r"CASE WHEN regexp_matches({c}, '(\d{{4}})\s+([A-Z]{{2,6}})\s+(\d+)') THEN regexp_extract({c}, '(\d{{4}})\s+([A-Z]{{2,6}})\s+(\d+)', 1) || ':' || regexp_extract({c}, '(\d{{4}})\s+([A-Z]{{2,6}})\s+(\d+)', 2) || ':' || regexp_extract({c}, '(\d{{4}})\s+([A-Z]{{2,6}})\s+(\d+)', 3) END"
_EDGE = _OCC + ",\ned AS (SELECT doc_id AS citing_id, document_date, occurrence, start_at, cited_key FROM oc WHERE coalesce(" + _KEY.format(c="citation") + ", '') <> cited_key)"
_LISTED = "ls AS (SELECT DISTINCT document_id AS citing_id, " + _KEY.format(c="c") + r" AS cited_key FROM (SELECT document_id, unnest(regexp_split_to_array(cases_cited_en, '\s*;\s*')) AS c FROM source_documents) WHERE " + _KEY.format(c="c") + " IS NOT NULL)"
_ND = "n AS (SELECT DISTINCT document_id, id, parent_id, kind, label, start_at, end_at FROM structure_nodes)"
_F = lambda b: f"coalesce(nullif(trim({b}_en), ''), nullif(trim({b}_fr), ''))"
_ST = f"st AS (SELECT DISTINCT document_id, doc_type, regexp_replace(upper(trim(dataset)), '-ARCHIVE$', '') AS dataset, {_F('citation')} AS citation, {_F('name')} AS name, {_F('document_date')} AS document_date FROM source_documents)"
_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

QUERIES = {f.__name__: f for f in (
    citation_occurrences, citation_edges, citation_excerpts, authority_metric, note_up, store_edges, confirmed_edges, citation_resolution, name_lookup, duplicate_decisions, court_levels, ranked_search, boolean_hits,
    hit_listing, late_hits, node_order, label_lookup, smallest_container, node_extents, numbering_lint, node_children, article_pages, length_quantiles, event_windows, entity_counts)}
SQL = {
    "citation_occurrences": f"WITH {_OCC} SELECT doc_id, occurrence, start_at, cited_key FROM oc",
    "citation_edges": f"WITH {_EDGE} SELECT citing_id, occurrence, start_at, cited_key FROM ed",
    "citation_excerpts": f"WITH {_OCC} SELECT doc_id, occurrence, cited_key, trim(regexp_replace(substr(text, greatest(start_at - 250, 0) + 1, start_at - greatest(start_at - 250, 0) + 350), '\\s+', ' ', 'g'), ' ') AS excerpt FROM oc",
    "authority_metric": f"WITH {_EDGE} SELECT cited_key, count(DISTINCT citing_id) AS citing_documents, count(*) AS citations FROM ed GROUP BY 1",
    "note_up": f"""WITH {_EDGE}, g AS (SELECT cited_key, citing_id, any_value(document_date) AS document_date, min(start_at) AS first_at, count(*) AS times FROM ed GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY cited_key ORDER BY times DESC, document_date DESC NULLS LAST, citing_id)::INT AS rank FROM g QUALIFY rank <= 10""",
    "store_edges": f"WITH {_LISTED} SELECT * FROM ls",
    "confirmed_edges": f"""WITH {_EDGE}, {_LISTED}, u AS (SELECT cited_key, 1 AS m, 0 AS l FROM ed UNION ALL SELECT cited_key, 0, 1 FROM ls)
 SELECT cited_key, CASE WHEN max(m) + max(l) = 2 THEN 'both' WHEN max(m) = 1 THEN 'mined' ELSE 'listed' END AS origin FROM u GROUP BY 1""",
    "citation_resolution": f"""WITH {_LISTED}, {_ST}, h AS (SELECT {_KEY.format(c='citation')} AS k, document_id FROM st), c AS (SELECT DISTINCT cited_key FROM ls)
 SELECT cited_key, count(document_id) AS documents, min(document_id) AS first_id, CASE count(document_id) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS status FROM c LEFT JOIN h ON h.k = c.cited_key GROUP BY 1""",
    "name_lookup": f"""WITH {_ST}, k AS (SELECT trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name_key, document_id FROM st)
 SELECT name_key, min(document_id) AS document_id FROM k WHERE length(name_key) > 0 GROUP BY 1 HAVING count(*) = 1""",
    "duplicate_decisions": f"WITH {_ST} SELECT dataset, {_KEY.format(c='citation')} AS key, count(*) AS documents, min(document_id) AS kept FROM st WHERE citation IS NOT NULL GROUP BY 1, 2 HAVING key IS NOT NULL AND count(*) > 1",
    "court_levels": f"""WITH {_ST} SELECT CASE WHEN court_name LIKE '%Supreme%' THEN 5 WHEN court_name LIKE '%Appeal%' THEN 4 WHEN court_name LIKE '%Superior%' OR court_name LIKE '%Federal%' OR court_name LIKE '%Bench%' THEN 3 WHEN court_name LIKE '%Court%' THEN 2 ELSE 1 END AS level,
 (floor(TRY_CAST(substr(document_date, 1, 4) AS INT) / 10.0) * 10)::INT AS decade, count(*) AS decisions FROM st JOIN courts USING (dataset) WHERE doc_type = 'cases' GROUP BY 1, 2""",
    "ranked_search": f"""WITH w AS (SELECT doc_id, {_W} AS ws FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, len(ws) AS n, (list_contains(ws, 'appeal') AND (list_contains(ws, 'landlord') OR list_contains(ws, 'tenant')) AND NOT contains(' ' || array_to_string(ws, ' ') || ' ', ' on appeal ')) AS hit,
   len(list_filter(ws, lambda x: x = 'appeal')) AS t0, len(list_filter(ws, lambda x: x = 'landlord')) AS t1, len(list_filter(ws, lambda x: x = 'tenant')) AS t2 FROM w),
 t AS (SELECT count(*) AS docs, avg(n) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM r),
 s AS (SELECT doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / a)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / a))
   + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / a)), 6) AS score FROM r, t WHERE hit)
 SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 50""",
    "boolean_hits": f"""WITH w AS (SELECT doc_id, {_W} AS ws FROM documents WHERE text IS NOT NULL)
 SELECT doc_id FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'munic'))) > 0 AND contains(' ' || array_to_string(ws, ' ') || ' ', ' in my view ') AND NOT list_contains(ws, 'coroner')""",
    "hit_listing": "WITH h AS (SELECT DISTINCT * FROM search_hits WHERE cluster_id IS NOT NULL) SELECT cluster_id, hit_id, row_number() OVER (PARTITION BY cluster_id ORDER BY listed_at DESC, hit_id)::INT AS rank FROM h",
    "late_hits": """WITH h AS (SELECT hit_id, min(epoch_us(listed_at)) AS t FROM search_hits WHERE hit_id IS NOT NULL AND listed_at IS NOT NULL GROUP BY 1),
 w AS (SELECT hit_id, t, max(t) OVER (ORDER BY hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM h)
 SELECT hit_id, t AS listed_at, latest FROM w WHERE t < latest""",
    "node_order": f"WITH {_ND} SELECT document_id, id, kind, start_at, end_at, row_number() OVER (PARTITION BY document_id ORDER BY start_at ASC NULLS FIRST, end_at DESC NULLS LAST, label ASC NULLS LAST, id)::INT AS position FROM n",
    "label_lookup": f"""WITH {_ND} SELECT document_id, regexp_replace(lower(label), '^(s\\.|para\\.?|art\\.?)\\s*|[().\\s]', '', 'g') AS label, count(*) AS nodes, min(start_at) AS first_at, CASE count(*) WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status
 FROM n WHERE kind = 'section' AND label IS NOT NULL GROUP BY document_id, regexp_replace(lower(label), '^(s\\.|para\\.?|art\\.?)\\s*|[().\\s]', '', 'g')""",
    "smallest_container": f"""WITH {_OCC}, {_LINES}
 SELECT oc.doc_id AS document_id, oc.start_at AS "at", l.line_no::INT AS node_id, length(l.line)::INT AS size FROM oc JOIN l ON l.doc_id = oc.doc_id AND l.start_at <= oc.start_at AND oc.start_at < l.start_at + length(l.line)""",
    "node_extents": f"""WITH {_ND}, m AS (SELECT *, max(end_at) OVER (PARTITION BY document_id, kind ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n WHERE start_at < end_at),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_at > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, kind ORDER BY start_at, end_at) AS island FROM m)
 SELECT document_id, kind, min(start_at) AS start_at, max(end_at) AS end_at FROM i GROUP BY document_id, kind, island""",
    "numbering_lint": f"""WITH {_ND}, v AS (SELECT *, TRY_CAST(nullif(regexp_extract(label, '(\\d{{1,9}})', 1), '') AS INT) AS number FROM n), s AS (SELECT *, lag(number) OVER (PARTITION BY document_id, parent_id, kind ORDER BY start_at ASC NULLS FIRST, id) AS before FROM v WHERE number IS NOT NULL)
 SELECT document_id, id, number, CASE WHEN number = before THEN 'duplicate' ELSE 'gap' END AS finding, CASE WHEN number - before > 1 THEN before + 1 END AS first_missing FROM s WHERE number - before = 0 OR number - before BETWEEN 2 AND 4""",
    "node_children": f"WITH {_ND} SELECT document_id, parent_id, count(*) AS children, min(start_at) AS from_at, max(end_at) AS to_at FROM n WHERE parent_id IS NOT NULL GROUP BY 1, 2",
    "article_pages": "WITH p AS (SELECT DISTINCT article_id, pdf_page, page_label FROM journal_pages) SELECT article_id, count(*) AS pages, max(pdf_page) AS last_page, sum((page_label IS NULL)::INT)::BIGINT AS unlabelled, min(TRY_CAST(page_label AS INT)) AS first_label, max(TRY_CAST(page_label AS INT)) AS last_label FROM p GROUP BY 1",
    "length_quantiles": """WITH l AS (SELECT doc_type, length(text) AS n, row_number() OVER (PARTITION BY doc_type ORDER BY length(text)) - 1 AS r, count(*) OVER (PARTITION BY doc_type) AS total FROM documents WHERE text IS NOT NULL AND doc_type IS NOT NULL)
 SELECT doc_type, min(CASE WHEN r = floor((total - 1) * 0.5 + 0.5) THEN n END)::INT AS median, min(CASE WHEN r = floor((total - 1) * 0.9 + 0.5) THEN n END)::INT AS q90, max(n)::INT AS longest FROM l GROUP BY 1""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "entity_counts": """SELECT id, len(citations)::INT AS n_citations, len(renditions)::INT AS n_renditions, len(cluster)::INT AS n_cluster, CASE WHEN len(citations) > 0 THEN concat_ws(' ', citations[1].volume, citations[1].reporter, citations[1].page) END AS first_citation
 FROM (SELECT DISTINCT id, citations, renditions, cluster FROM opinion_records)""",
}
