"""Queries over node rows: lookups, containment, ranges, extents, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets of the containment join, in code points.
BUCKET = 4096


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes once: repeated rows of a node count as one."""
    return nodes.dropDuplicates(["document_id", "id"])


def projection(nodes: DataFrame) -> DataFrame:
    """Served order: by start, longer first, then label, then id."""
    order = Window.partitionBy("document_id").orderBy("start_at", F.desc("end_at"), F.asc_nulls_last("label"), "id")
    return nodes.select("document_id", "id", "kind", "start_at", "end_at", F.row_number().over(order).alias("position"))


def lookup(nodes: DataFrame, kind: str) -> DataFrame:
    """Status of every label of a kind in its document: found, or ambiguous with the number
    of nodes that bear it."""
    n = nodes.where((F.col("kind") == kind) & F.col("label").isNotNull())
    bare = F.regexp_replace(F.lower("label"), r"^(s\.|para\.?|art\.?)\s*|[().\s]", "")
    return n.groupBy("document_id", bare.alias("label")).agg(F.count("*").alias("nodes"), F.min("start_at").alias("first_at")).withColumn("status", F.when(F.col("nodes") == 1, "found").otherwise("ambiguous"))


def containing(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node that holds a place: ``points`` has ``document_id``, ``at``. An equi-join on
    document and bucket, so long documents spread; ties go to the later start, then the id."""
    spread = nodes.where("start_at < end_at").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_at") / BUCKET), F.floor((F.col("end_at") - 1) / BUCKET))))
    at = points.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    hit = at.join(spread, ["document_id", "bucket"]).where((F.col("start_at") <= F.col("at")) & (F.col("at") < F.col("end_at")))
    return hit.groupBy("document_id", "at").agg(F.min(F.struct((F.col("end_at") - F.col("start_at")).alias("size"), (-F.col("start_at")).alias("s"), "id")).alias("m")).select("document_id", "at", F.col("m.id").alias("node_id"), F.col("m.size").alias("size"))


def extents(nodes: DataFrame) -> DataFrame:
    """Union of ranges by document and kind, those that touch joined: gaps and islands."""
    w = Window.partitionBy("document_id", "kind").orderBy("start_at", "end_at")
    reach = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = nodes.where("start_at < end_at").withColumn("new", F.when(reach.isNull() | (F.col("start_at") > reach + 1), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("document_id", "kind", "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))


def numbering(nodes: DataFrame) -> DataFrame:
    """Lint of numbers among the children of one parent, in order of place: ``duplicate`` (the
    number of the one before) and ``gap`` (two to four ahead), with what is missing."""
    number = F.regexp_extract("label", r"(\d{1,9})", 1).try_cast("int")
    w = Window.partitionBy("document_id", "parent_id", "kind").orderBy("start_at", "id")
    n = nodes.withColumn("number", number).where("number is not null")
    step = n.withColumn("before", F.lag("number").over(w)).withColumn("step", F.col("number") - F.col("before"))
    return step.where("step = 0 or step between 2 and 4").select("document_id", "id", "number", F.when(F.col("step") == 0, "duplicate").otherwise("gap").alias("finding"), F.when(F.col("step") > 1, F.col("before") + 1).alias("first_missing"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Children and their span by parent."""
    return nodes.where("parent_id is not null").groupBy("document_id", "parent_id").agg(F.count("*").alias("children"), F.min("start_at").alias("from_at"), F.max("end_at").alias("to_at"))
