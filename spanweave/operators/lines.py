"""Lines, tokens and line classes of documents. Narrow, JVM-side maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, utf16_length, words

# Classes of lines and the patterns that tell them, first match counting.
CLASSES = (
    ("blank", r"^\s*$"),
    ("numbered", r"^\s*(\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.)]|§ ?\d{1,3}\.?)\s"),
    ("decimal", r"^\s*\d{1,3}(\.\d{1,3})+\s"),
    ("item", r"^\s*\(?([a-z]|[ivx]{1,5})[.)]\s"),
    ("editorial", r"^\s*\[[A-Z][^\]]{2,60}\]\s*$"),
    ("date", r"^\s*(\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2}, \d{4})\s*$"),
    ("caption", r"^\s*(Figure|Table|Fig\.)\s+\d+"),
    ("capitals", r"^[^a-z]*[A-Z][^a-z]*$"),
    ("heading", r"^\s*[A-Z][^.!?;:]{0,60}$"),
)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``line_no`` (from 1), ``start_at`` and ``end_at`` (code points, half open) and
    ``line``. Null texts have no lines; an empty text has one empty line. CR, LF, CRLF and the
    Unicode line and paragraph separators end lines."""
    # CRLF counts two code points: it becomes LF plus a mark that is no text.
    t = F.regexp_replace(F.col(text), "\r\n", "\u0000\n")
    parts = F.split(t, "[\n\r  ]")
    exploded = df.where(F.col(text).isNotNull()).select(
        F.col(key), F.posexplode(F.zip_with(
            parts,
            F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + 1))),
            lambda p, o: F.when(p.isNotNull(), F.struct(p.alias("p"), o.alias("o"))))).alias("n", "x")).where("x is not null")
    line = F.regexp_replace(F.col("x.p"), "\u0000", "")
    return exploded.select(F.col(key), (F.col("n") + 1).alias("line_no"), F.col("x.o").alias("start_at"), (F.col("x.o") + F.length(line)).alias("end_at"), line.alias("line"))


def line_class(line: Column) -> Column:
    """Class of a line."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CLASSES):
        out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``pos`` (from 0) and ``word``: lower-case words in order."""
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(words(F.col(text))).alias("pos", "word"))


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sizes of every text: code points, UTF-16 units, words, lines. Null: nulls."""
    return df.select(
        F.col(key), F.length(text).alias("n_points"), utf16_length(F.col(text)).alias("n_utf16"),
        F.size(words(F.col(text))).alias("n_words"), (F.size(F.split(F.col(text), LINE_END))).alias("n_lines"))
