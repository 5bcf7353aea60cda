"""Tests of lines by what they say, as column expressions, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..runtime import table

# Patterns and phrases that must be the ones readers of decisions use.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MOIS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
HISTORY = r"^(?:(?:R\.S\.C\.|R\.S\.|L\.R\.C\.|S\.R\.|S\.C\.)[, ]*(?:[0-9]{4}[, ]*)?|[0-9]{4}[, ]*)(?:c\. |ch\. |c[0-9])"
DATE = rf"^(?:\p{{Lu}}[\p{{L}}'’. -]{{2,30}},\s*)?(?:le\s+)?(?:(?:{MONTHS})\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}|[0-9]{{1,2}}(?:er)?\s+(?:{MOIS})\s+[0-9]{{4}})\.?$"
REMARKS = r"sic\)|emphasis|underlin|italics|soulign|omitted|ajouté|page |para|p\. |pp\. "


def marks(line: Column) -> dict[str, Column]:
    """Tests of a line by name; each is a boolean column."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    word = F.regexp_extract(t, r"^(\S+)", 1)
    shown = F.regexp_replace(t, r"^#+\s*", "")
    bold = shown.rlike(r"^\*\*[^*]*[^*\s][^*]*\*\*$")
    n_words = F.size(F.filter(F.split(shown, r"\s+"), lambda w: w != ""))
    bracketed = t.rlike(r"^\[[^\]]+\][.,;]*$") & ~t.rlike(r"^\[[0-9]+\]")
    dots = t.rlike(r"^[.…\[\]()\s]+$") & (t.contains("…") | t.rlike(r"\.[^.]*\.[^.]*\."))
    remark = t.rlike(r"^\([^(]*\)\.*$") & F.lower(t).rlike(REMARKS)
    return {
        "label": word.rlike(r"^\(*(?:[0-9]{1,6}|[ivxlcIVXLC]{1,6})[.)]*$"),
        "paragraph_number": t.rlike(r"^\[0*[0-9]{1,3}\]"),
        "editorial": bracketed | dots | remark,
        "bold": bold,
        "marginal_note": n_words.between(1, 16) & (bold | (shown.rlike(r"^\p{Lu}") & ~shown.rlike(r"[.;:,—-]$") & ~shown.rlike("[0-9]"))),
        "history_note": t.rlike(HISTORY) & ~t.rlike(r"\p{L}{6}"),
        "date": t.rlike(DATE),
        "figure_caption": t.rlike(r"^Figure\s+(?:[0-9]+\.*|\.+)$"),
        "sentence_end": t.rlike(r"[.?!…][\"'’”»)\]}]*$"),
        "may_cite": t.rlike(r"[0-9][^0-9]+[0-9]") | t.rlike(r"^[^0-9]*[0-9]{4}[^0-9]*$"),
        "note_label": t.rlike(r"^(?:[*∗†‡§¶#]{1,8}|[0-9]{1,4})(?:\s|[.)\],:;-](?:\s|$))"),
        "page_marker": t.rlike(r"^\[page [^\]]*\]$"),
    }


def line_marks(spark: SparkSession, d: str) -> DataFrame:
    """PRJ15, PRJ17-PRJ21, PRJ23, PRJ24, PRJ31, PRJ32, PRJ35, INF31: lines of each document
    that pass each test, and the first of them."""
    rows = L.lines(table(spark, d, "documents"), "doc_id", "text").where("line <> ''")
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in marks(F.col("line")).items()]), lambda m: m.isNotNull())
    return rows.select("doc_id", "line_no", F.explode(found).alias("mark")).groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


QUERIES = {f.__name__: f for f in (line_marks,)}
SQL = {
    "line_marks": r"""WITH t AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, regexp_split_to_array(t, '[\n\r\x{2028}\x{2029}]') AS parts FROM t),
e AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1)::INT AS line_no FROM p),
l AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM e WHERE line <> ''),
s AS (SELECT *, regexp_replace(t, '^#+\s*', '') AS shown, lower(t) AS low FROM l),
b AS (SELECT *, regexp_matches(shown, '^\*\*[^*]*[^*\s][^*]*\*\*$') AS bold, len(list_filter(regexp_split_to_array(shown, '\s+'), lambda w: w <> '')) AS k FROM s),
m AS (
 SELECT doc_id, line_no, 'label' AS mark FROM b WHERE regexp_matches(t, '^\(*(?:\d{1,6}|[ivxlcIVXLC]{1,6})[.)]*(?:\s|$)')
 UNION ALL SELECT doc_id, line_no, 'paragraph_number' FROM b WHERE TRY_CAST(nullif(regexp_extract(t, '^\[(\d{1,18})\]', 1), '') AS BIGINT) < 1000
 UNION ALL SELECT doc_id, line_no, 'editorial' FROM b WHERE (regexp_matches(t, '^\[[^\]]+\][.,;]*$') AND NOT regexp_matches(t, '^\[\d+\]'))
   OR (regexp_matches(t, '^[.…\[\]()\s]+$') AND (contains(t, '…') OR length(t) - length(replace(t, '.', '')) >= 3))
   OR (regexp_matches(t, '^\([^(]*\)\.*$') AND (contains(low, 'sic)') OR contains(low, 'emphasis') OR contains(low, 'underlin') OR contains(low, 'italics') OR contains(low, 'soulign')
     OR contains(low, 'omitted') OR contains(low, 'ajouté') OR contains(low, 'page ') OR contains(low, 'para') OR contains(low, 'p. ') OR contains(low, 'pp. ')))
 UNION ALL SELECT doc_id, line_no, 'bold' FROM b WHERE bold
 UNION ALL SELECT doc_id, line_no, 'marginal_note' FROM b WHERE k BETWEEN 1 AND 16 AND (bold OR (regexp_matches(shown, '^\p{Lu}') AND NOT right(shown, 1) IN ('.', ';', ':', ',', '—', '-') AND NOT regexp_matches(shown, '\d')))
 UNION ALL SELECT doc_id, line_no, 'history_note' FROM b WHERE NOT regexp_matches(t, '\p{L}{6}') AND regexp_matches(t, '^(R\.S\.C\.|R\.S\.|L\.R\.C\.|S\.R\.|S\.C\.|\d{4})[, ]*(\d{4}[, ]*)?(c\. |ch\. |c\d)')
   AND NOT regexp_matches(t, '^\d{4}[, ]*\d{4}')
 UNION ALL SELECT doc_id, line_no, 'date' FROM b WHERE regexp_matches(t, '^(\p{Lu}[\p{L}''’. -]{2,30},\s*)?(le\s+)?((January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(st|nd|rd|th)?,?\s+\d{4}|\d{1,2}(er)?\s+(janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s+\d{4})\.?$')
 UNION ALL SELECT doc_id, line_no, 'figure_caption' FROM b WHERE regexp_matches(t, '^Figure\s+(\d+\.*|\.+)$')
 UNION ALL SELECT doc_id, line_no, 'sentence_end' FROM b WHERE right(rtrim(t, '"''’”»)]}'), 1) IN ('.', '?', '!', '…')
 UNION ALL SELECT doc_id, line_no, 'may_cite' FROM b WHERE len(regexp_extract_all(t, '\d+')) >= 2 OR (len(regexp_extract_all(t, '\d+')) = 1 AND length(regexp_extract(t, '\d+')) = 4)
 UNION ALL SELECT doc_id, line_no, 'note_label' FROM b WHERE regexp_matches(t, '^([*∗†‡§¶#]{1,8}|\d{1,4})(\s|[.)\],:;-](\s|$))')
 UNION ALL SELECT doc_id, line_no, 'page_marker' FROM b WHERE starts_with(t, '[page ') AND regexp_matches(t, '^[^\]]*\]$'))
SELECT doc_id, mark, count(*) AS n, min(line_no)::INT AS first_line FROM m GROUP BY 1, 2""",
}
