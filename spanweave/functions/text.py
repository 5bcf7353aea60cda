"""Column expressions over text, labels and names. JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: line ends of a document.
LINE_END = "\r\n|\n|\r| | "


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, the unit of document offsets."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def blank_as_null(text: Column) -> Column:
    """A cell, with a blank one as absent."""
    t = F.trim(text)
    return F.when(F.length(t) > 0, t)


def language_field(base: str, language: str) -> Column:
    """A bilingual field in the wanted language, else the other."""
    other = "fr" if language == "en" else "en"
    return F.coalesce(blank_as_null(F.col(f"{base}_{language}")), blank_as_null(F.col(f"{base}_{other}")))


def squeeze(text: Column) -> Column:
    """White space runs made one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def name_key(text: Column) -> Column:
    """A name as it is compared: lower case, letters and digits, words joined by a space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def citation_key(text: Column) -> Column:
    """A neutral citation as it is compared: year, court, number; nothing else has a key."""
    m = r"(\d{4})\s+([A-Z]{2,8})\s+(\d+)"
    return F.when(text.rlike(m), F.concat_ws(":", F.regexp_extract(text, m, 1), F.regexp_extract(text, m, 2), F.regexp_extract(text, m, 3)))


def roman_value(text: Column) -> Column:
    """Value of a lower-case Roman numeral; null for anything else."""
    ok = text.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(text) > 0)
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0))
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.when(ok, F.aggregate(signed, F.lit(0), lambda a, b: a + b))


def ordinal(label: Column) -> Column:
    """Number of a label such as ``s. 115``, ``(157)`` or ``52.``; null without a number."""
    return F.regexp_extract(label, r"(\d{1,9})", 1).try_cast("int")


def statute_fragment(kind: Column, label: Column) -> Column:
    """Name of a link to a node: mark of its kind and its bare label."""
    mark = F.when(kind == "paragraph", "par").when(kind == "footnote", "fn").when(kind == "page", "page").when(kind == "section", "sec")
    bare = F.regexp_replace(F.lower(label), r"^(s\.|para\.?|art\.?)\s*|[().\s]", "")
    return F.when(mark.isNotNull() & (F.length(bare) > 0), F.concat(mark, bare))
