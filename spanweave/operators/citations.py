"""Neutral citations in texts, citation edges, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_key, squeeze

# Fixed value: a neutral citation: year, court, number.
PATTERN = r"\b(?:19|20)\d{2} [A-Z]{2,8} \d{1,4}\b"


def occurrences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``occurrence`` (from 1), ``start_at`` (code points) and ``cited_key`` of every
    neutral citation in a text. Null and empty texts have none.

    Offsets come from the lengths of the pieces between citations, so no text is searched twice."""
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(f"({PATTERN})"), 1)
    between = F.split(t, PATTERN)
    ends = F.aggregate(F.zip_with(found, between, lambda c, b: F.length(b) + F.coalesce(F.length(c), F.lit(0))), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    starts = F.transform(found, lambda c, i: F.get(ends, i) + F.length(F.get(between, i)))
    rows = df.where(t.rlike(PATTERN)).select(F.col(key), F.posexplode(F.arrays_zip(found.alias("c"), starts.alias("s"))).alias("n", "x"))
    return rows.select(F.col(key), (F.col("n") + 1).alias("occurrence"), F.col("x.s").alias("start_at"), citation_key(F.col("x.c")).alias("cited_key"))


def excerpts(df: DataFrame, key: str, text: str, before: int = 250, after: int = 350) -> DataFrame:
    """Each citation with the words around it, white space squeezed."""
    found = occurrences(df, key, text)
    own = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    joined = found.join(own, F.col(key) == F.col("_k"))
    start = F.greatest(F.col("start_at") - before, F.lit(0))
    return joined.select(F.col(key), "occurrence", "cited_key", squeeze(F.substring(F.col("_t"), start + 1, F.col("start_at") - start + after)).alias("excerpt"))


def edges(df: DataFrame, key: str, text: str, own: str) -> DataFrame:
    """Citation edges of decisions: citations of a text but for its own."""
    found = occurrences(df, key, text)
    mine = df.select(F.col(key).alias("_k"), citation_key(F.col(own)).alias("_own"))
    return found.join(mine, F.col(key) == F.col("_k")).where(F.col("_own").isNull() | (F.col("_own") != F.col("cited_key"))).select(F.col(key).alias("citing_id"), "occurrence", "start_at", "cited_key")


def listed(df: DataFrame, key: str, column: str) -> DataFrame:
    """Edges that a store lists itself: ``citing_id`` and ``cited_key``, without repeats."""
    return df.select(F.col(key).alias("citing_id"), F.explode(F.split(column, r"\s*;\s*")).alias("c")).select("citing_id", citation_key(F.col("c")).alias("cited_key")).where("cited_key is not null").distinct()


def metrics(found: DataFrame) -> DataFrame:
    """How often each authority is cited: citing documents, citations."""
    return found.groupBy("cited_key").agg(F.countDistinct("citing_id").alias("citing_documents"), F.count("*").alias("citations"))


def note_up(found: DataFrame, documents: DataFrame, page: int = 10) -> DataFrame:
    """Citing documents of each authority: first place, number of citations, rank by number,
    then date (newest first, none last), then id; the first ``page`` of each."""
    grouped = found.groupBy("cited_key", "citing_id").agg(F.min("start_at").alias("first_at"), F.count("*").alias("times"))
    dated = grouped.join(documents.select(F.col("doc_id").alias("citing_id"), "document_date"), "citing_id")
    order = Window.partitionBy("cited_key").orderBy(F.desc("times"), F.desc_nulls_last("document_date"), "citing_id")
    return dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= page)
