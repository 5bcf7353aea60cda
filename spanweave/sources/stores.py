"""Readers of the document stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_as_null, language_field
from ..runtime import table


def documents(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    """Store documents with fields in the wanted language, else the other. Repeated rows of a
    document count once; the court code is trimmed and in capitals, its archive mark gone."""
    raw = table(spark, folder, "source_documents")
    fields = {"citation": "citation", "name": "name", "document_date": "document_date", "url": "url", "unofficial_text": "text"}
    cols = [language_field(b, language).alias(out) for b, out in fields.items()]
    dataset = F.regexp_replace(F.upper(F.trim("dataset")), "-ARCHIVE$", "")
    return raw.select("document_id", "doc_type", dataset.alias("dataset"), *cols).dropDuplicates(["document_id"])


def provisions(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    """Provisions of statutes: ``document_id``, ``label``, ``text``, ``ordinal`` (integer
    labels first, ascending, then the others by name)."""
    other = "fr" if language == "en" else "en"
    raw = table(spark, folder, "source_documents").where("doc_type = 'laws'")
    sections = F.coalesce(blank_as_null(F.col(f"unofficial_sections_{language}")), blank_as_null(F.col(f"unofficial_sections_{other}")))
    pairs = raw.select("document_id", F.explode(F.map_entries(F.from_json(sections, "map<string,string>"))).alias("e")).select("document_id", F.col("e.key").alias("label"), F.col("e.value").alias("text")).distinct()
    number = F.when(F.col("label").rlike(r"^\d{1,9}$"), F.col("label").try_cast("int"))
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy(number.asc_nulls_last(), "label")
    return pairs.withColumn("ordinal", F.row_number().over(order))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of journal pages by region and order; a null order comes last in its region."""
    pages = table(spark, folder, "journal_pages")
    regions = pages.select("page_id", F.posexplode("regions").alias("region", "r"))
    return regions.select("page_id", "region", F.col("r.kind").alias("kind"), F.posexplode("r.lines").alias("line", "l")).select(
        "page_id", "region", "kind", "line", F.col("l.codex_text_order").alias("text_order"), F.col("l.text").alias("text"))


def courts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by type and court, with the court's name."""
    counted = documents(spark, folder).groupBy("doc_type", "dataset").agg(F.count("*").alias("documents"))
    # The table of courts is fixed (twelve rows).
    return counted.join(F.broadcast(table(spark, folder, "courts").select("dataset", "court_name")), "dataset", "left").select("doc_type", "dataset", "documents", "court_name")
