"""Queries over labels, pinpoints, notes, markup and reporters, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import citation_key, name_key
from ..operators import nodes as N
from ..runtime import cut, table
from ..sources import stores

# Families of labels, the first that fits counting.
FAMILIES = (("decimal", r"^\d+(\.\d+)+\.?$"), ("number", r"^\(?\d+[.)]?$"), ("roman", r"^\(?[ivxlc]+[.)]$"), ("letter", r"^\(?[A-Za-z][.)]$"), ("named", r"^[A-Za-z]+\.?\s*\d+"))
# Patterns of references to provisions, of paragraph ranges, of notes, of reporter citations.
PROVISION = r"\b(?:s|ss|cl|art|para|al)\. \d+(?:\.\d+)*|\bRule \d+(?:\.\d+)?|\bSch\. [A-Z]\b|§ \d+"
RANGE = r"paras\.\s(\d+)-(\d+)"
NOTE = r"^(\d{1,3}) (.+), (\d{4} [A-Z]{4} \d+)\.$"
REPORTER = r"^(?:\[(\d{4})\] )?(\d+) (.+?) (\d+)(?: \((\d{4})\))?$"
TAG = r"<([a-zA-Z][a-zA-Z0-9-]*)"
STAR = r"\*(\d{1,4})</page-number>"


def label_families(spark: SparkSession, d: str) -> DataFrame:
    """INF37, QRY26: families of node labels by kind of node."""
    family = F.lit("other")
    for name, p in reversed(FAMILIES):
        family = F.when(F.col("label").rlike(p), name).otherwise(family)
    n = N.distinct_nodes(table(spark, d, "structure_nodes")).where("label is not null")
    return n.groupBy("kind", family.alias("family")).agg(F.count("*").alias("n"))


def pinpoint_ranges(spark: SparkSession, d: str) -> DataFrame:
    """REL4, QRY23, QRY24: paragraph ranges that texts pinpoint, expanded (up to 60 each)."""
    t = table(spark, d, "documents").where(F.col("text").rlike(RANGE))
    found = t.select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(RANGE), 1).alias("a"), F.regexp_extract_all("text", F.lit(RANGE), 2).alias("b"))).alias("x"))
    r = found.select("doc_id", F.col("x.a").cast("int").alias("a"), F.col("x.b").cast("int").alias("b")).where("a <= b and b - a < 60")
    return r.select("doc_id", F.explode(F.sequence("a", "b")).alias("paragraph")).groupBy("doc_id", "paragraph").agg(F.count("*").alias("times"))


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """QRY25: pinpointed paragraphs collapsed to runs."""
    p = pinpoint_ranges(spark, d)
    w = Window.partitionBy("doc_id").orderBy("paragraph")
    return p.withColumn("g", F.col("paragraph") - F.row_number().over(w)).groupBy("doc_id", "g").agg(F.min("paragraph").alias("first"), F.max("paragraph").alias("last")).select("doc_id", "first", "last")


def provision_references(spark: SparkSession, d: str) -> DataFrame:
    """INS4: references to provisions in texts."""
    t = table(spark, d, "documents").where(F.col("text").rlike(PROVISION))
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({PROVISION})"), 1)).alias("reference")).groupBy("doc_id", "reference").agg(F.count("*").alias("times"))


def commentary_edges(spark: SparkSession, d: str) -> DataFrame:
    """REL7, NOT2, NOT10: decisions that notes of journal pages cite."""
    lines = table(spark, d, "journal_pages").select("article_id", "page_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    hit = lines.where(F.col("line").rlike(NOTE))
    return hit.select("article_id", "page_id", F.regexp_extract("line", NOTE, 1).cast("int").alias("note"), F.regexp_extract("line", NOTE, 2).alias("name"), citation_key(F.regexp_extract("line", NOTE, 3)).alias("cited_key"))


def note_sequence(spark: SparkSession, d: str) -> DataFrame:
    """CHK1: notes of a page that do not go on by one."""
    w = Window.partitionBy("page_id").orderBy("note")
    n = commentary_edges(spark, d).select("page_id", "note").distinct()
    return n.withColumn("before", F.lag("note").over(w)).groupBy("page_id").agg(F.count("*").alias("notes"), F.sum(F.coalesce((F.col("note") - F.col("before") != 1).cast("int"), F.lit(0))).alias("breaks"))


def journal_citations(spark: SparkSession, d: str) -> DataFrame:
    """REL8, REL16: how often journals cite each decision, and in how many articles."""
    return commentary_edges(spark, d).groupBy("cited_key").agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("notes"))


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """TAB1, TAB2: cells of table regions, named by their place."""
    lines = stores.page_lines(spark, d).where("kind = 'table'").distinct()
    return lines.select("page_id", "region", F.concat(F.lit("R"), F.floor(F.col("line") / 2) + 1, F.lit("C"), F.col("line") % 2 + 1).alias("cell"), F.col("text").alias("display_value"), F.col("text").try_cast("int").alias("number"))


def markup_elements(spark: SparkSession, d: str) -> DataFrame:
    """MKP1: elements of opinion texts by name."""
    r = table(spark, d, "opinion_records").dropDuplicates(["id"]).select("id", F.explode("renditions").alias("r"))
    return r.select("id", F.explode(F.regexp_extract_all(F.col("r.text"), F.lit(TAG), 1)).alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("opinions"))


def markup_text(spark: SparkSession, d: str) -> DataFrame:
    """MKP1, MKP2, MKP5: opinion texts without tags, the common entities decoded, squeezed."""
    r = table(spark, d, "opinion_records").dropDuplicates(["id"]).select("id", F.posexplode("renditions").alias("n", "r")).where("r.text is not null")
    t = F.regexp_replace(F.col("r.text"), r"<[a-zA-Z/!][^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return r.select("id", "n", F.trim(F.regexp_replace(t, "[ \t\r\n]+", " ")).alias("text"))


def star_pages(spark: SparkSession, d: str) -> DataFrame:
    """MKP9, OPN8: printed pages marked in opinions."""
    r = table(spark, d, "opinion_records").dropDuplicates(["id"]).select("id", F.explode("renditions").alias("r"))
    return r.select("id", F.explode(F.regexp_extract_all(F.col("r.text"), F.lit(STAR), 1)).alias("p")).groupBy("id").agg(F.count("*").alias("marks"), F.min(F.col("p").cast("int")).alias("first_page"), F.max(F.col("p").cast("int")).alias("last_page"))


def reporter_citations(spark: SparkSession, d: str) -> DataFrame:
    """CIT3, REL21, REL34: reporter citations of cases in parts."""
    c = table(spark, d, "court_cases").select("case_id", F.explode("citations").alias("c")).distinct().where(F.col("c").rlike(REPORTER))
    e = lambda n: F.regexp_extract("c", REPORTER, n)
    year = F.when(e(1) != "", e(1)).when(e(5) != "", e(5))
    return c.select("case_id", year.cast("int").alias("year"), e(2).cast("int").alias("volume"), e(3).alias("reporter"), e(4).cast("int").alias("page"))


def citation_aliases(spark: SparkSession, d: str) -> DataFrame:
    """REL24, AUX12: reporter citations, the case they lead to, and whether to several."""
    c = table(spark, d, "court_cases").select("case_id", F.explode("citations").alias("citation")).distinct()
    return c.groupBy("citation").agg(F.count("*").alias("cases"), F.min("case_id").alias("first_id")).select("citation", "first_id", (F.col("cases") > 1).alias("ambiguous"))


def reporter_courts(spark: SparkSession, d: str) -> DataFrame:
    """REL21: courts that print in each reporter, and cases that cite it."""
    courts = table(spark, d, "courts").select("dataset", F.explode("reporters").alias("reporter"))
    printed = reporter_citations(spark, d).groupBy("reporter").agg(F.countDistinct("case_id").alias("cases"))
    return courts.groupBy("reporter").agg(F.count("*").alias("courts")).join(printed, "reporter", "left").select("reporter", "courts", F.coalesce("cases", F.lit(0)).alias("cases"))


def cited_names(spark: SparkSession, d: str) -> DataFrame:
    """REL19: names that readings cite, by name."""
    r = table(spark, d, "readings").select("reading_id", F.explode("cited_names").alias("name")).distinct().where("name is not null")
    return r.groupBy(name_key(F.col("name")).alias("name_key")).agg(F.countDistinct("reading_id").alias("readings"))


def citation_reach(spark: SparkSession, d: str) -> DataFrame:
    """QRY18: decisions reached from each store document over at most three citations, by the
    fewest steps. Cycles end, as a document keeps its first distance."""
    from .relations import store_edges

    held = stores.documents(spark, d).select(citation_key(F.col("citation")).alias("cited_key"), F.col("document_id").alias("to_id")).where("cited_key is not null")
    hops = cut(store_edges(spark, d).join(held, "cited_key").select(F.col("citing_id").alias("from_id"), "to_id").distinct())
    reach = front = hops.where("from_id <> to_id").withColumn("steps", F.lit(1))
    for n in (2, 3):
        nxt = front.select("from_id", F.col("to_id").alias("mid")).join(hops.select(F.col("from_id").alias("mid"), "to_id"), "mid").select("from_id", "to_id").where("from_id <> to_id").distinct()
        front = nxt.join(reach, ["from_id", "to_id"], "left_anti").withColumn("steps", F.lit(n))
        reach = reach.unionByName(front)
    return reach


def provider_readings(spark: SparkSession, d: str) -> DataFrame:
    """SRC11: readings by provider and kind of source."""
    r = table(spark, d, "readings").dropDuplicates(["reading_id"])
    return r.groupBy(F.col("input.provider").alias("provider"), F.col("input.source_kind").alias("source_kind")).agg(F.count("*").alias("readings"), F.countDistinct("revision").alias("revisions"), F.sum(F.length("input.text")).alias("n_chars"))


def front_roles(spark: SparkSession, d: str) -> DataFrame:
    """Opinions by type and form of the author line."""
    o = table(spark, d, "opinion_records").dropDuplicates(["id"])
    form = F.when(F.col("author").isNull(), "none").when(F.col("author").rlike(r",\s*J\.?$"), "judge after comma").when(F.col("author").rlike(r"\sJ\.?$"), "judge").otherwise("name")
    return o.groupBy("opinion_type", form.alias("author_form")).agg(F.count("*").alias("opinions"))


_N = "n AS (SELECT DISTINCT document_id, id, kind, label FROM structure_nodes WHERE label IS NOT NULL)"
_FAM = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN '{n}'" for n, p in FAMILIES) + " ELSE 'other' END"
_PIN = f"""f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RANGE}', 1)) AS a, unnest(regexp_extract_all(text, '{RANGE}', 2)) AS b FROM documents),
pp AS (SELECT doc_id, unnest(range(a::INT, b::INT + 1))::INT AS paragraph FROM f WHERE a::INT <= b::INT AND b::INT - a::INT < 60), pin AS (SELECT doc_id, paragraph, count(*) AS times FROM pp GROUP BY 1, 2)"""
_NOTE = f"""nl AS (SELECT DISTINCT article_id, page_id, unnest(string_split(text, chr(10))) AS line FROM journal_pages),
ce AS (SELECT article_id, page_id, regexp_extract(line, '{NOTE}', 1)::INT AS note, regexp_extract(line, '{NOTE}', 2) AS name, replace(regexp_extract(line, '{NOTE}', 3), ' ', ':') AS cited_key FROM nl WHERE regexp_matches(line, '{NOTE}'))"""
_OP = "op AS (SELECT DISTINCT id, renditions FROM opinion_records)"
_REP = f"""rc AS (SELECT DISTINCT case_id, unnest(citations) AS c FROM court_cases), rp AS (SELECT case_id, TRY_CAST(coalesce(nullif(regexp_extract(c, '{REPORTER}', 1), ''), nullif(regexp_extract(c, '{REPORTER}', 5), '')) AS INT) AS year,
 regexp_extract(c, '{REPORTER}', 2)::INT AS volume, regexp_extract(c, '{REPORTER}', 3) AS reporter, regexp_extract(c, '{REPORTER}', 4)::INT AS page FROM rc WHERE regexp_matches(c, '{REPORTER}'))"""

QUERIES = {f.__name__: f for f in (
    label_families, pinpoint_ranges, label_runs, provision_references, commentary_edges, note_sequence, journal_citations, page_tables, markup_elements, markup_text, star_pages, reporter_citations, citation_aliases,
    reporter_courts, cited_names, citation_reach, provider_readings, front_roles)}
SQL = {
    "label_families": f"WITH {_N} SELECT kind, {_FAM} AS family, count(*) AS n FROM n GROUP BY 1, 2",
    "pinpoint_ranges": f"WITH {_PIN} SELECT * FROM pin",
    "label_runs": f"WITH {_PIN}, g AS (SELECT doc_id, paragraph, paragraph - row_number() OVER (PARTITION BY doc_id ORDER BY paragraph) AS g FROM pin) SELECT doc_id, min(paragraph) AS first, max(paragraph) AS last FROM g GROUP BY doc_id, g",
    "provision_references": f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PROVISION}')) AS reference FROM documents) SELECT doc_id, reference, count(*) AS times FROM r GROUP BY 1, 2",
    "commentary_edges": f"WITH {_NOTE} SELECT * FROM ce",
    "note_sequence": f"WITH {_NOTE}, d AS (SELECT DISTINCT page_id, note FROM ce), b AS (SELECT page_id, note - lag(note) OVER (PARTITION BY page_id ORDER BY note) AS step FROM d) SELECT page_id, count(*) AS notes, sum(coalesce((step <> 1)::INT, 0))::BIGINT AS breaks FROM b GROUP BY 1",
    "journal_citations": f"WITH {_NOTE} SELECT cited_key, count(DISTINCT article_id) AS articles, count(*) AS notes FROM ce GROUP BY 1",
    "page_tables": """WITH r AS (SELECT page_id, unnest(regions) AS r, generate_subscripts(regions, 1) - 1 AS region FROM (SELECT DISTINCT page_id, regions FROM journal_pages)),
 l AS (SELECT page_id, region::INT AS region, r.kind AS kind, unnest(r.lines) AS l, generate_subscripts(r.lines, 1) - 1 AS line FROM r)
 SELECT DISTINCT page_id, region, 'R' || (line // 2 + 1)::INT || 'C' || (line % 2 + 1)::INT AS cell, l.text AS display_value, TRY_CAST(l.text AS INT) AS number FROM l WHERE kind = 'table'""",
    "markup_elements": f"WITH {_OP}, r AS (SELECT id, unnest(renditions) AS r FROM op), t AS (SELECT id, unnest(regexp_extract_all(r.text, '{TAG}', 1)) AS tag FROM r) SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT id) AS opinions FROM t GROUP BY 1",
    "markup_text": f"""WITH {_OP}, r AS (SELECT id, unnest(renditions) AS r, generate_subscripts(renditions, 1) - 1 AS n FROM op)
 SELECT id, n::INT AS n, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(r.text, '<[a-zA-Z/!][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM r WHERE r.text IS NOT NULL""",
    "star_pages": f"WITH {_OP}, r AS (SELECT id, unnest(renditions) AS r FROM op), t AS (SELECT id, unnest(regexp_extract_all(r.text, '{STAR}', 1))::INT AS p FROM r) SELECT id, count(*) AS marks, min(p) AS first_page, max(p) AS last_page FROM t GROUP BY 1",
    "reporter_citations": f"WITH {_REP} SELECT * FROM rp",
    "citation_aliases": "WITH c AS (SELECT DISTINCT case_id, unnest(citations) AS citation FROM court_cases) SELECT citation, min(case_id) AS first_id, count(*) > 1 AS ambiguous FROM c GROUP BY 1",
    "reporter_courts": f"WITH {_REP}, c AS (SELECT reporter, count(*) AS courts FROM (SELECT unnest(reporters) AS reporter FROM courts) GROUP BY 1), p AS (SELECT reporter, count(DISTINCT case_id) AS cases FROM rp GROUP BY 1) SELECT reporter, courts, coalesce(cases, 0) AS cases FROM c LEFT JOIN p USING (reporter)",
    "cited_names": r"WITH r AS (SELECT DISTINCT reading_id, unnest(cited_names) AS name FROM readings) SELECT trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS name_key, count(DISTINCT reading_id) AS readings FROM r WHERE name IS NOT NULL GROUP BY 1",
    "provider_readings": "WITH r AS (SELECT DISTINCT reading_id, revision, input FROM readings) SELECT input.provider AS provider, input.source_kind AS source_kind, count(*) AS readings, count(DISTINCT revision) AS revisions, sum(length(input.text))::BIGINT AS n_chars FROM r GROUP BY 1, 2",
    "front_roles": r"WITH o AS (SELECT DISTINCT id, opinion_type, author FROM opinion_records) SELECT opinion_type, CASE WHEN author IS NULL THEN 'none' WHEN regexp_matches(author, ',\s*J\.?$') THEN 'judge after comma' WHEN regexp_matches(author, '\sJ\.?$') THEN 'judge' ELSE 'name' END AS author_form, count(*) AS opinions FROM o GROUP BY 1, 2",
}


def _reach_sql() -> str:
    from .relations import _KEY, _LISTED, _ST

    return f"""WITH RECURSIVE {_LISTED}, {_ST}, h AS (SELECT DISTINCT ls.citing_id AS from_id, st.document_id AS to_id FROM ls JOIN st ON {_KEY.format(c='st.citation')} = ls.cited_key),
 r AS (SELECT from_id, to_id, 1 AS steps FROM h UNION SELECT r.from_id, h.to_id, r.steps + 1 FROM r JOIN h ON h.from_id = r.to_id WHERE r.steps < 3)
 SELECT from_id, to_id, min(steps) AS steps FROM r WHERE from_id <> to_id GROUP BY 1, 2"""


SQL["citation_reach"] = _reach_sql()
