"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from . import encoding, markup, matching, mojibake, packing, repeats, scans, sentences, variants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings(scans.examine(spark, table(spark, d, "journal_pages")))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous repaired paragraphs of every article."""
    return scans.paragraphs(scans.examine(spark, table(spark, d, "journal_pages"), texts=True))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    documents = mojibake.find(table(spark, d, "source_documents"), "document_id", ["name_en", "name_fr", "citation_en", "citation_fr"], "source_documents")
    return documents.unionByName(mojibake.find(table(spark, d, "journal_pages"), "page_id", ["text"], "journal_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("record_table", "record_id", "field").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every affected value with what was written."""
    return _garbled(spark, d)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "opinion_records")
    parts = [records.select(F.col("id").alias("opinion_id"), F.lit(f).alias("field"), F.explode(f).alias("part")) for f in ("renditions", "cluster")]
    texts = parts[0].unionByName(parts[1]).select("opinion_id", "field", F.col("part.name").alias("part_name"), F.col("part.text").alias("text"))
    return markup.clean(texts, ["opinion_id", "field", "part_name"], "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("opinion_id", "field", "part_name", F.explode("languages").alias("markup")).distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text without its markup."""
    return _cleaned(spark, d)


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their cosine, certainty of the day and confidence."""
    # Fixed tables of authorities and courts; they do not grow.
    authorities = [(r.party_id, [n for n in [r.name, r.name_fr, *(r.short_names or [])] if n]) for r in table(spark, d, "public_parties").collect()]
    courts = [(r.dataset, r.dataset_fr, r.court_name, list(r.reporters or [])) for r in table(spark, d, "courts").collect()]
    return matching.match(spark, table(spark, d, "court_cases"), table(spark, d, "source_documents"), (authorities, courts))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("case_id", "document_id")


def _authorities(spark: SparkSession, d: str) -> list[str]:
    # Fixed table of public authorities; it does not grow.
    return [n for r in table(spark, d, "public_parties").collect() for n in [r.name, r.name_fr, *(r.short_names or [])] if n]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "source_documents").where("doc_type = 'cases'")
    names = (
        table(spark, d, "court_cases").select(F.col("case_id").alias("id"), F.col("case_name").alias("name"), F.lit(False).alias("french"))
        .unionByName(table(spark, d, "search_hits").select(F.col("hit_id").alias("id"), F.col("case_name").alias("name"), F.lit(False).alias("french")))
        .unionByName(documents.select(F.col("document_id").alias("id"), F.col("name_en").alias("name"), F.lit(False).alias("french")))
        .unionByName(documents.select(F.col("document_id").alias("id"), F.col("name_fr").alias("name"), F.lit(True).alias("french"))))
    sides = cut(variants.private_sides(names, "id", "name", "french", _authorities(spark, d)))
    return variants.link(variants.mentions(sides, variants.learn(sides)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs(_linked(spark, d))


def p5_parties(spark: SparkSession, d: str) -> DataFrame:
    """The party of every id that names one, with the number of ids that share it."""
    linked = cut(_linked(spark, d))
    return linked.join(linked.groupBy("party").agg(F.count("*").alias("links")), "party").select("id", "party", "links")


def _records(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "passages").select(F.col("passage_id").alias("id"), "text")
    return passages.unionByName(table(spark, d, "readings").select(F.col("reading_id").alias("id"), F.col("input.text").alias("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.matches(_records(spark, d), "id", "text").select("id_a", "id_b").distinct()


def p7_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record stands elsewhere too."""
    records = _records(spark, d)
    sizes = records.groupBy("id").agg(F.max(F.length("text")).alias("n_chars"))
    found = repeats.coverage(repeats.matches(records, "id", "text"))
    return sizes.join(found, "id", "left").select("id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6).alias("share"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the text of each document from its ids."""
    return encoding.decode(p8_ids(spark, d), "doc_id", "ids")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    # Fixed table of three rows; the bound of the read is the number of kinds.
    return {r.container_kind: r.capacity_tokens for r in table(spark, d, "container_sizes").collect()}


def p9_placed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(encoding.lengths(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, _capacities(spark, d), "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_placed(spark, d), _capacities(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_restored, p3_found, p3_matches, p4_found, p4_clean, p5_found, p5_parties, p7_found, p7_shared, p8_ids, p8_decoded, p9_placed, p9_fill, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
