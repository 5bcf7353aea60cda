"""Structure of documents from their text: numbered paragraphs, headings, prose.

The marks of a document's lines are few rows even for long documents; the longest rooted
count among them is found by window functions, not by a walk over the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import line_class, lines

# Styles of paragraph numbers.
STYLES = (("bracket", r"^\s*\[(\d{1,3})\]\s"), ("paren", r"^\s*\((\d{1,3})\)\s"), ("half", r"^\s*(\d{1,3})\)\s"), ("dot", r"^\s*(\d{1,3})\.\s"), ("section", r"^\s*§ ?(\d{1,3})\.?\s"), ("decimal", r"^\s*(\d{1,3})\.1\s"))


def markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that open with a number: ``key``, ``line_no``, ``start_at``, ``style``, ``value``."""
    rows = lines(df, key, text)
    style, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(STYLES):
        hit = F.col("line").rlike(pattern)
        style = F.when(hit, F.lit(name)).otherwise(style)
        value = F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(value)
    return rows.select(key, "line_no", "start_at", style.alias("style"), value.try_cast("int").alias("value")).where("style is not null")


def counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rooted counts: of each style in a document, the run of marks that goes on by one from a
    mark of value 1; the first mark of each value after the one before counts.

    A mark goes on if the greatest value before it, of its style, is one less."""
    m = markers(df, key, text)
    w = Window.partitionBy(key, "style").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = m.withColumn("before", F.coalesce(F.max("value").over(w), F.lit(0)))
    return seen.where("value = before + 1")


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered paragraphs of documents by their longest rooted count (two marks at least; ties
    go to the style named first): ``key``, ``label``, ``start_at``, ``end_at``, ``style``. A
    paragraph ends where the next one opens."""
    c = counts(df, key, text)
    rank = F.create_map(*[x for n, (s, _) in enumerate(STYLES) for x in (F.lit(s), F.lit(n))])
    best = c.groupBy(key, "style").agg(F.count("*").alias("n")).where("n >= 2").groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), rank[F.col("style")].alias("r"), "style")).alias("b")).select(key, "b.style")
    kept = c.join(best, [key, "style"])
    sizes = df.select(key, F.length(text).alias("_n"))
    w = Window.partitionBy(key).orderBy("line_no")
    return kept.join(sizes, key).select(key, F.col("value").alias("label"), "start_at", F.coalesce(F.lead("start_at").over(w), F.col("_n")).alias("end_at"), "style")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of class heading or capitals that stand between blank lines."""
    rows = lines(df, key, text)
    w = Window.partitionBy(key).orderBy("line_no")
    blank = F.col("line").rlike(r"^\s*$")
    around = rows.withColumn("kind", line_class(F.col("line"))).withColumn("above", F.coalesce(F.lag(blank).over(w), F.lit(True))).withColumn("below", F.coalesce(F.lead(blank).over(w), F.lit(True)))
    return around.where("above and below and kind in ('heading', 'capitals')").select(key, "line_no", "start_at", F.trim("line").alias("title"))
