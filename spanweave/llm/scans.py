"""Noise in text read from scanned pages: words parted at line ends, misread signs, running
headers and page numbers; and the repaired, continuous text.

1. A lexicon of the corpus: words with their counts, kept down to a share of all words, which
   bounds it whatever the corpus' size. Bigrams are counted in a sketch of fixed size.
2. Candidates for a rare word come from a symmetric-delete index over the lexicon: words and
   rare words meet when they agree after a fixed folding of look-alike signs and at most one
   deletion on either side. A weighted edit distance, cheap for known confusions, and the
   words before and behind pick among them.
3. What concerns neighbouring pages (headers, page numbers, words parted at page ends) is
   decided on small rows - the first and last lines of each page - joined by article.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import mojibake

#: A word is in the lexicon from this share of all words on (so it has at most 1/share
#: entries), but not below this count.
SHARE = 5e-6
FLOOR = 4
#: How many times more frequent than a misreading its original must be.
RATIO = 12
#: Slots of the bigram sketch.
SLOTS = 1 << 18

# What scanners take for what, with the cost of the confusion.
CONFUSED = {
    ("0", "o"): 0.2, ("1", "l"): 0.2, ("1", "i"): 0.3, ("5", "s"): 0.2, ("6", "b"): 0.2, ("9", "g"): 0.2, ("9", "q"): 0.3, ("7", "t"): 0.3, ("!", "i"): 0.2, ("!", "l"): 0.2,
    ("|", "l"): 0.2, ("|", "i"): 0.2, ("8", "b"): 0.3, ("2", "z"): 0.3, ("$", "s"): 0.2, ("c", "e"): 0.4, ("e", "c"): 0.4, ("f", "t"): 0.4, ("t", "f"): 0.4, ("o", "c"): 0.5, ("c", "o"): 0.5,
    ("l", "i"): 0.4, ("i", "l"): 0.4, ("f", "e"): 0.5, ("j", "i"): 0.5, ("u", "n"): 0.5, ("n", "u"): 0.5, ("v", "u"): 0.5, ("u", "v"): 0.5, ("h", "b"): 0.5, ("b", "h"): 0.5, ("a", "o"): 0.6, ("o", "a"): 0.6, ("v", "y"): 0.6, ("y", "v"): 0.6,
    ("rn", "m"): 0.3, ("m", "rn"): 0.4, ("ri", "n"): 0.3, ("n", "ri"): 0.5, ("ii", "u"): 0.3, ("u", "ii"): 0.5, ("ci", "a"): 0.3, ("a", "ci"): 0.5, ("cl", "d"): 0.3, ("d", "cl"): 0.4, ("li", "h"): 0.3, ("h", "li"): 0.4,
    ("vv", "w"): 0.3, ("w", "vv"): 0.5, ("m", "in"): 0.4, ("in", "m"): 0.4, ("nn", "m"): 0.5, ("m", "ni"): 0.5, ("fi", "h"): 0.6, ("tl", "d"): 0.6,
}
# Marks that part a word at a line end.
BREAK_MARKS = "-‐‑¬\xad"
# Letters that a number may show for digits.
NUMBER_LIKE = re.compile(r"^(?=.*\d)(?=.*[OolIiSsBZzgqb!|])[\dOolIiSsBZzgqb!|]{2,6}$")
ROMAN = re.compile(r"^[ivxlcdm]+$", re.I)

EDGE_MARKS = re.compile(r"^[^\w!|]+|[^\w!|]+$|[!|]+$")
SPLIT_MARK = re.compile(rf"[^\W\d_]([{BREAK_MARKS}]) ?$")


@lru_cache(maxsize=1 << 17)
def norm(token: str) -> str:
    return EDGE_MARKS.sub("", token).lower()


_DIGITS = str.maketrans({"0": "o", "1": "l", "!": "i", "|": "i", "5": "s", "$": "s", "6": "b", "8": "b", "9": "g", "7": "t", "2": "z"})
_FOLD = str.maketrans({**dict.fromkeys("1!|ij", "l"), **dict.fromkeys("vn", "u"), **dict.fromkeys("68h", "b"), "0": "o", "5": "s", "$": "s", "9": "g", "7": "t", "2": "z", "c": "e", "f": "t"})
_PAIRS = [(a, b) for a, b in CONFUSED if len(a) > 1 or len(b) > 1]


def fold(word: str) -> str:
    """A word with look-alike single signs made one."""
    return word.translate(_FOLD)


def deletes(word: str) -> set[str]:
    """A folded word, and it with one sign left out."""
    w = fold(word)
    return {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}


def undone(word: str) -> set[str]:
    """A word with one confusion of two signs undone, in every way."""
    out = set()
    for a, b in _PAIRS:
        at = word.find(a)
        while at >= 0:
            out.add(word[:at] + b + word[at + len(a):])
            at = word.find(a, at + 1)
    return out


def _plain(line: str) -> str:
    return line.translate(_DIGITS)


def distance(seen: str, meant: str, limit: float = 2.0) -> float:
    """Least cost of turning ``seen`` into ``meant``: 1 for an insertion, deletion or change,
    less for known confusions of one or two signs."""
    n, m = len(seen), len(meant)
    if abs(n - m) > 2:
        return limit + 1
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 9.0
            if i:
                best = rows[i - 1][j] + 1
            if j:
                best = min(best, rows[i][j - 1] + 1)
            if i and j:
                a, b = seen[i - 1], meant[j - 1]
                best = min(best, rows[i - 1][j - 1] + (0 if a == b else CONFUSED.get((a, b), 1.0)))
                if i > 1:
                    c = CONFUSED.get((seen[i - 2:i], b))
                    if c:
                        best = min(best, rows[i - 2][j - 1] + c)
                if j > 1:
                    c = CONFUSED.get((a, meant[j - 2:j]))
                    if c:
                        best = min(best, rows[i - 1][j - 2] + c)
            rows[i][j] = best
    return rows[n][m]


@dataclass
class Lexicon:
    """Common words with their counts, their symmetric-delete index, and the bigram sketch."""

    counts: dict[str, int]
    bigrams: np.ndarray
    index: dict[str, list[str]] = field(default_factory=dict)
    memo: dict[str, list[tuple[float, str]]] = field(default_factory=dict)
    sure: dict[str, bool] = field(default_factory=dict)
    fine: set[str] = field(default_factory=set)
    prefixes: set[str] = field(default_factory=set)

    def build(self) -> "Lexicon":
        for w in self.counts:
            if len(w) > 1 and not w.isdigit():
                for x in deletes(w):
                    self.index.setdefault(x, []).append(w)
        self.prefixes = {w[:k + 1] for w in self.counts for k, ch in enumerate(w) if ch == "-"}
        return self

    def candidates(self, word: str) -> list[tuple[float, str]]:
        """Words of the lexicon near ``word`` with their costs."""
        got = self.memo.get(word)
        if got is None:
            near = {w for x in deletes(word) for w in self.index.get(x, ())}
            once = undone(word)
            near |= {w for v in once for w in self.index.get(fold(v), ())}
            if not near and len(word) > 6:
                near = {w for v in once for u in undone(v) for w in self.index.get(fold(u), ())}
            bound = 0.55 if len(word) <= 3 else 0.95  # known confusions only
            got = sorted((c, w) for w in near if w != word and (c := distance(word, w)) <= bound)
            if len(self.memo) > 1 << 17:
                self.memo.clear()
            self.memo[word] = got
        return got

    def trusts(self, word: str) -> bool:
        """Whether ``word`` is common and no far more common word looks like it."""
        got = self.sure.get(word)
        if got is None:
            n = self.counts.get(word)
            got = n is not None and not (len(word) > 2 and not ROMAN.match(word) and any(self.counts[w] >= RATIO * n for _, w in self.candidates(word)))
            if len(self.sure) > 1 << 18:
                self.sure.clear()
            self.sure[word] = got
        return got

    def pair(self, a: str, b: str) -> int:
        return int(self.bigrams[slot(a, b)])

    def original(self, word: str, n: int, before: str = "", behind: str = "") -> str | None:
        """What ``word`` (met ``n`` times as far as known) was misread from, if anything."""
        best, top = None, -1e9
        for cost, w in self.candidates(word):
            if self.counts[w] < RATIO * max(n, 1):
                continue
            score = np.log(self.counts[w]) * 0.3 + np.log1p(self.pair(before, w)) + np.log1p(self.pair(w, behind)) - 6 * cost
            if score > top:
                best, top = w, score
        return best


def slot(a: str, b: str) -> int:
    return xxhash.xxh32_intdigest(a + "\0" + b) & (SLOTS - 1)


def _lines(text: str) -> list[str]:
    return (mojibake.restore(text)[1] or "").split("\n")


def _words(lines: list[str]) -> Iterator[str]:
    """Words of a page, those parted at line ends joined, edge halves left out."""
    carry = ""
    for n, line in enumerate(lines):
        tokens = line.split()
        if not tokens:
            carry = ""
            continue
        if carry:
            tokens[0] = carry + tokens[0]
            carry = ""
        if SPLIT_MARK.search(line):
            last = tokens.pop()
            if n + 1 < len(lines):
                carry = last.rstrip(BREAK_MARKS)
        yield from map(norm, tokens)


def learn(pages: DataFrame, text: str) -> tuple[Lexicon, int]:
    """The lexicon of all pages."""
    rows = pages.select(F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        pairs = np.zeros(SLOTS, np.int64)

        def flush():
            keys, ns = list(counts), list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(["w"] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            two: Counter = Counter()  # of one batch, so bounded
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                words = [w for w in _words(_lines(t)) if w]
                counts.update(words)
                two.update(zip(words, words[1:]))
            for (a, b), n in two.items():
                pairs[slot(a, b)] += n
            if len(counts) > 500_000:
                yield flush()
                counts.clear()
        yield flush()
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["b"] * len(at), pa.string()), pa.array([str(x) for x in at], pa.string()), pa.array(pairs[at], pa.int64())], ["kind", "key", "n"])

    counted = cut(rows.mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counted.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    least = max(FLOOR, int(total * SHARE))
    # At most 1/SHARE words, and SLOTS bigram slots, however large the corpus.
    words = {r.key: r.n for r in counted.where((F.col("kind") == "w") & (F.col("n") >= least)).collect() if r.key}
    pairs = np.zeros(SLOTS, np.int32)
    for r in counted.where("kind = 'b'").collect():
        pairs[int(r.key)] = min(r.n, 2**31 - 1)
    return Lexicon(words, pairs), total


_held: dict[str, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    """The worker's index of a broadcast lexicon."""
    key = shared.value[0]
    if key not in _held:
        _held.clear()
        _held[key] = Lexicon(shared.value[1], shared.value[2]).build()
    return _held[key]


@dataclass
class Read:
    """What one page shows by itself."""

    lines: list[str]
    parted: list[tuple[int, str, bool]]  # line, joined word, whether the mark is not its own
    misread: list[tuple[int, str, str]]  # line, seen, meant
    tail: str  # the part of a word at the end of the last line, or nothing


def whole_of(left: str, mark: str, right: str, lex: Lexicon) -> tuple[str, bool]:
    """The word parted into ``left`` and ``right`` by ``mark``: how it is written, and whether
    the mark was put in."""
    joined, compound = norm(left + right), norm(left + "-" + right)
    if lex.trusts(joined) or lex.trusts(compound):
        put_in = lex.counts.get(joined, 0) >= lex.counts.get(compound, 0)
        return (joined if put_in else compound), put_in
    near_j, near_c = lex.candidates(joined), lex.candidates(compound)
    if near_j or near_c:
        put_in = not near_c or (bool(near_j) and near_j[0][0] <= near_c[0][0])
        return (joined if put_in else compound), put_in
    if mark != "-":
        return joined, True
    own = (norm(left) + "-") in lex.prefixes or (norm(left) in lex.counts and norm(right) in lex.counts and len(left) > 3)
    return (compound if own else joined), not own


def suspicious(word: str, lex: Lexicon, before: str, behind: str) -> str | None:
    """What a word or number was misread from, or nothing."""
    if not word or lex.trusts(word):
        return None
    if word.isdigit() or "+" in word:
        return None
    mostly = sum(c.isdigit() for c in word) * 2 >= len(word) and not re.search(r"[a-z]{3}", word)
    if NUMBER_LIKE.match(word) and (mostly or (len(word) > 2 and not re.search(r"[^\dol!|]", word))):
        return word.translate(str.maketrans("oOlIiSsBbZzgq!|", "001115586229911"))
    if len(word) < 3 or not re.search(r"[^\W\d_]", word) or ROMAN.match(word):
        return None
    return lex.original(word, lex.counts.get(word, 1), before, behind)


INNER = re.compile(r"[^\w!|'’-]+")


def read(text: str, lex: Lexicon) -> Read:
    """Findings on a page that need no other page."""
    lines = _lines(text)
    parted, misread = [], []
    tail, first_of_next = "", ""
    n_lines, fine = len(lines), lex.fine
    for n, line in enumerate(lines):
        tokens = line.split()
        start = 0
        if first_of_next and tokens:
            start = 1  # the second half was looked at with the first
            first_of_next = ""
        end = len(tokens)
        m = SPLIT_MARK.search(line)
        if m and tokens:
            left = tokens[-1].rstrip(BREAK_MARKS)
            nxt = lines[n + 1].split() if n + 1 < n_lines else []
            if nxt and nxt[0][:1].isalnum():
                whole, put_in = whole_of(left, m[1], nxt[0], lex)
                parted.append((n, whole, put_in))
                end -= 1
                first_of_next = nxt[0]
                for part in INNER.split(whole):
                    meant = suspicious(part, lex, norm(tokens[-2]) if len(tokens) > 1 else "", norm(nxt[1]) if len(nxt) > 1 else "")
                    if meant:
                        misread.append((n, part, meant))
            else:
                end -= 1
                tail = tokens[-1]
                parted.append((n, "", False))
        for k in range(start, end):
            if tokens[k] in fine:
                continue
            word = norm(tokens[k])
            if lex.trusts(word):
                if len(fine) < 1 << 18:
                    fine.add(tokens[k])
                continue
            for part in INNER.split(word) if not word.isalnum() else (word,):
                part = part.strip("-'’")
                meant = suspicious(part, lex, norm(tokens[k - 1]) if k else "", norm(tokens[k + 1]) if k + 1 < len(tokens) else "")
                if meant:
                    misread.append((n, tokens[k], meant))
    return Read(lines, parted, misread, tail)


HEAD, FOOT = 3, 2


def _canon(line: str) -> str:
    """A line as headers are compared: letters only, look-alikes folded."""
    return re.sub(r"[^a-z]", "", _plain(re.sub(r"\[[^\]]*\]|(?<![^\W\d_])[\dOolIS!|]+(?![^\W\d_])", "", line).lower()))


def close(a: str, b: str) -> bool:
    """Whether two canonical lines agree but for noise, or one is the cut-off other."""
    if not a or not b:
        return False
    if a == b:
        return True
    short, long_ = sorted((a, b), key=len)
    if len(short) >= 14 and len(long_) - len(short) > 2:  # cut off
        a, b = short, long_[:len(short)]
    if abs(len(a) - len(b)) > 2 or len(short) < 5:
        return False
    budget = 1 if len(short) < 10 else 2 if len(short) < 20 else 3
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        if min(now) > budget:
            return False
        before = now
    return before[-1] <= budget


NUMBER_LINE = re.compile(r"^\W*(?:p(?:age|\.)?\s*)?([\dOolIiSsBZzgqb!|]{1,6}|[ivxlcdmIVXLCDM1!]{1,8})\W*$", re.I)
DIGIT_FORMS = str.maketrans("oOlIiSsBbZzgq!|", "001115586229911")


def _number(text: str) -> str:
    return text.translate(DIGIT_FORMS)


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def value_of(label: str | None) -> tuple[int, bool] | None:
    """A page label as a number, and whether it is Roman."""
    if not label:
        return None
    s = label.strip().lower()
    if s.isdigit():
        return int(s), False
    if ROMAN.match(s):
        vals = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        total = sum(-vals[a] if b and vals[a] < vals[b] else vals[a] for a, b in zip(s, [*s[1:], ""]))
        return (total, True) if _roman(total) == s else None
    return None


def _holds_number(line: str, printed: str) -> bool:
    """Whether ``printed`` stands on a line, misread or not, as a number of its own."""
    for m in re.finditer(r"[^\s\[\]():,;.—–\-]+", line):
        tok = m[0].strip("[]()—–-.,:;")
        if tok.lower() == printed or (printed.isdigit() and any(c.isdigit() for c in tok) and _number(tok) == printed) or (printed.isdigit() and len(tok) == len(printed) and _number(tok) == printed and len(tok) > 1):
            return True
        if not printed.isdigit() and len(tok) == len(printed) and tok.lower().replace("1", "i").replace("!", "i").replace("l", "i") == printed.replace("l", "i"):
            return True
    return False


def judge(pdf_page: int | None, printed: str | None, head: list[str], foot: list[str], names: list[str], journal: list[str]) -> tuple[int, bool, set[int]]:
    """Of the first lines: how many are header lines, whether the printed number stands on the
    page, and which of the last lines hold it."""
    headers, number = 0, False
    canon_names = [c for c in map(_canon, [*names, *journal]) if len(c) >= 4]
    together = [_canon(a + b) for a in names[1:2] for b in names[:1]]  # author and title
    kept = 0
    for n, line in enumerate(head):
        if not line.strip():
            kept = n + 1
            continue
        c = _canon(line)
        is_title_here = pdf_page == 1 and names and close(c, _canon(names[0]))
        header = not is_title_here and len(line) < 120 and any(close(c, x) for x in [*canon_names, *together])
        alone = NUMBER_LINE.match(line.strip()) is not None and printed is not None and _holds_number(line, printed)
        if header and printed is not None and _holds_number(re.sub(r"\d+:", " ", line), printed):
            number = True
        if alone:
            number = True
        if not header and not alone:
            break
        headers += header
        kept = n + 1
    low = set()
    for n in range(len(foot) - 1, max(-1, len(foot) - 3), -1):
        line = foot[n].strip()
        if printed is not None and line and NUMBER_LINE.match(line) and _holds_number(line, printed):
            number = True
            low.add(n)
            break
        if line and not NUMBER_LINE.match(line):
            break
    return headers, number, low


def examine(spark: SparkSession, pages: DataFrame, texts: bool = False) -> DataFrame:
    """One row per page (per distinct content of a ``page_id``): ``page_id``, ``article_id``,
    ``pdf_page``, flags ``hyphenation``, ``misread``, ``running_header``, ``page_number``; with
    ``texts`` also ``lines`` (repaired, without headers and page numbers).

    Null, empty and blank pages have no noise. Null article ids stand each for an article of
    its own; null page numbers are not first pages. Repeated rows count once. Other columns
    are ignored."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("article_id").cast("long").alias("article_id"), F.col("journal_abbrev").cast("string").alias("journal_abbrev"),
        F.col("pdf_page").cast("int").alias("pdf_page"), F.col("page_label").cast("string").alias("page_label"), F.col("text").cast("string").alias("text"))
    lex, _ = learn(base, "text")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, lex.counts, lex.bigrams))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for t in batch.column(5).to_pylist():
                r = read(t or "", lexicon)
                lines = [x for x in r.lines]
                values = (any(p for _, _, p in r.parted), bool(r.misread), r.tail, lines[:HEAD], lines[-FOOT - 1:], len(lines), _repaired(r) if texts else [], xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1)
                for col, x in zip(out, values):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *[pa.array(c, ty) for c, ty in zip(out, (pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.int64()))]],
                ["page_id", "article_id", "journal_abbrev", "pdf_page", "page_label", "hyphenation", "misread", "tail", "head", "foot", "n", "lines", "h"])

    schema = "page_id long, article_id long, journal_abbrev string, pdf_page int, page_label string, hyphenation boolean, misread boolean, tail string, head array<string>, foot array<string>, n int, lines array<string>, h long"
    seen = cut(base.mapInArrow(look, schema).dropDuplicates(["page_id", "article_id", "pdf_page", "h"]))
    keyed = seen.withColumn("article", F.coalesce("article_id", -F.col("page_id") - 1))
    # Of each article: title and author from its first page, how far labels are ahead of pages.
    offset = F.col("page_label").try_cast("int") - F.col("pdf_page")
    facts = keyed.groupBy("article").agg(
        F.max_by("head", F.when(F.col("pdf_page") == 1, 1)).alias("opening"), F.mode(offset).alias("offset"),
        F.max_by("page_label", F.when(F.col("page_label").rlike("^[ivxlcdm]+$"), F.struct("pdf_page", "page_label"))).alias("roman"),
        F.max_by("pdf_page", F.when(F.col("page_label").rlike("^[ivxlcdm]+$"), F.struct("pdf_page", "page_label"))).alias("roman_at"))
    # Of each journal: head lines that stand on pages of several articles, by their letters.
    letters = F.lower(F.regexp_replace(F.element_at("head", 1), r"\[[^\]]*\]|[0-9]+", " "))
    heads = keyed.where("size(head) > 0").select("journal_abbrev", "article", F.trim(F.regexp_replace(letters, r"\s+", " ")).alias("line")).where("length(line) between 5 and 80")
    # A share of the journal's pages, so at most 1/share lines a journal.
    pages_of = keyed.groupBy("journal_abbrev").agg(F.count("*").alias("of"))
    frequent = (
        heads.groupBy("journal_abbrev", "line").agg(F.count("*").alias("n"), F.approx_count_distinct("article").alias("articles"))
        .where("articles >= 2").join(pages_of, "journal_abbrev").where("n >= 3 and n >= 0.01 * of")
        .groupBy("journal_abbrev").agg(F.collect_list("line").alias("journal")))
    following = keyed.where("pdf_page is not null").groupBy("article", (F.col("pdf_page") - 1).alias("pdf_page")).agg(F.min("head").alias("next"))
    whole = keyed.join(facts, "article", "left").join(frequent, "journal_abbrev", "left").join(following, ["article", "pdf_page"], "left").select(
        "page_id", "article_id", "pdf_page", "page_label", "journal_abbrev", "hyphenation", "misread", "tail", "head", "foot", "n", "lines", "opening", "offset", "roman", "roman_at", "journal", "next")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        for batch in batches:
            d = batch.to_pydict()
            out: tuple[list, ...] = ([], [], [], [], [])
            for n in range(batch.num_rows):
                opening = [x for x in (d["opening"][n] or []) if x and x.strip()]
                names = []
                if opening:
                    opening = [x for x in opening if not NUMBER_LINE.match(x.strip())]
                    by = next((k for k, x in enumerate(opening) if re.match(r"(?:by|par|von|por)\s", x, re.I)), None)
                    if by:
                        names = [" ".join(opening[:by]), re.sub(r"^\w+\s+", "", opening[by])]
                    elif opening:
                        names = [opening[0]]
                label, page, off = d["page_label"][n], d["pdf_page"][n], d["offset"][n]
                printed = label.strip().lower() if label and label.strip() else None
                if printed is None and page is not None:
                    if off is not None:
                        printed = str(page + off)
                    elif d["roman"][n]:
                        v = value_of(d["roman"][n])
                        if v and v[0] + page - d["roman_at"][n] > 0:
                            printed = _roman(v[0] + page - d["roman_at"][n])
                journal = [*(d["journal"][n] or []), d["journal_abbrev"][n] or ""]
                head, foot = d["head"][n] or [], d["foot"][n] or []
                headers, number, low = judge(page, printed, head, foot[-FOOT:] if d["n"][n] > FOOT else [], names, journal)
                hyphenation = d["hyphenation"][n]
                # A word parted at the end of the page's text goes on behind the next page's header.
                body = [x for k, x in enumerate(foot) if not NUMBER_LINE.match(x.strip())]
                last = body[-1] if body else ""
                m = SPLIT_MARK.search(last)
                if not hyphenation and m and (d["tail"][n] or (foot and foot[-1] is not last)):
                    nxt = [x for x in d["next"][n] or [] if x.strip()]
                    at = judge(0, None, nxt, [], names, journal)[0]
                    at += sum(1 for x in nxt[at:at + 1] if NUMBER_LINE.match(x.strip()))
                    left = last.split()[-1].rstrip(BREAK_MARKS)
                    right = nxt[at].split()[0] if at < len(nxt) and nxt[at].split() else ""
                    if right:
                        hyphenation = whole_of(left, m[1], right, lexicon)[1]
                    else:
                        hyphenation = m[1] != "-" or (norm(left) + "-") not in lexicon.prefixes
                lines = d["lines"][n] or []
                if texts and lines:
                    skip = set(range(headers + sum(1 for x in head[:headers + 1] if NUMBER_LINE.match(x.strip()) and printed and _holds_number(x, printed))))
                    base_at = len(lines) - min(FOOT, len(lines))
                    lines = [x for k, x in enumerate(lines) if k not in skip and not (k >= base_at and (k - base_at) in low)]
                for col, x in zip(out, (hyphenation, d["misread"][n], headers > 0, number, lines)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, ty) for c, ty in zip(out, (pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string())))]],
                ["page_id", "article_id", "pdf_page", "hyphenation", "misread", "running_header", "page_number", "lines"])

    return whole.mapInArrow(decide, "page_id long, article_id long, pdf_page int, hyphenation boolean, misread boolean, running_header boolean, page_number boolean, lines array<string>")


def _repaired(r: Read) -> list[str]:
    """The page's lines with misread words replaced and parted words put into their first line."""
    lines = list(r.lines)
    for n, seen, meant in r.misread:
        core = EDGE_MARKS.sub("", seen)
        if core[:1].isupper() and core[1:2].isupper():
            meant = meant.upper()
        elif core[:1].isupper():
            meant = meant[:1].upper() + meant[1:]
        if core:
            lines[n] = lines[n].replace(core, meant, 1)
    for n, whole, put_in in r.parted:
        if not whole or n + 1 >= len(lines) or not lines[n + 1].split():
            continue
        left = lines[n].rstrip().rsplit(None, 1)
        head = left[0] + " " if len(left) > 1 else ""
        stem = left[-1].rstrip(BREAK_MARKS) if left else ""
        first, _, rest = lines[n + 1].partition(" ")
        lines[n] = head + stem + ("" if put_in else "-") + first
        lines[n + 1] = rest
    return lines


def findings(examined: DataFrame) -> DataFrame:
    """``page_id`` and ``noise``, one row per kind of noise on a page."""
    kinds = ("hyphenation", "misread", "running_header", "page_number")
    names = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    return examined.select("page_id", F.explode(names).alias("noise")).distinct()


def paragraphs(examined: DataFrame) -> DataFrame:
    """``article_id``, ``paragraph`` (number) and ``text``: continuous paragraphs of each
    article. A paragraph ends with a line that ends a sentence and is shorter than the page's
    usual line, or stands before a heading; one that does not end goes on on the next page."""
    rows = examined.where("size(lines) > 0").select(F.coalesce("article_id", -F.col("page_id") - 1).alias("article"), "page_id", "pdf_page", "lines")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, no, out, open_ = [], [], [], []
            for n, lines in enumerate(batch.column(3).to_pylist()):
                lines = [x.strip() for x in lines if x and x.strip()]
                if not lines:
                    continue
                width = sorted(map(len, lines))[int(len(lines) * 0.8)]
                now: list[str] = []
                k = 0
                for line in lines:
                    now.append(line)
                    ends = re.search(r"[.!?:;]['”’\")\]»]*$", line) is not None
                    if (ends and len(line) < 0.85 * width) or re.match(r"^[IVXLC]+\.\s", line):
                        index.append(n)
                        no.append(k)
                        out.append(" ".join(now))
                        open_.append(False)
                        now, k = [], k + 1
                if now:
                    index.append(n)
                    no.append(k)
                    out.append(" ".join(now))
                    open_.append(not re.search(r"[.!?]['”’\")\]»]*$", now[-1]))
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(no, pa.int32()), pa.array(out, pa.string()), pa.array(open_, pa.bool_())], ["article", "page_id", "pdf_page", "no", "text", "open"])

    parts = rows.mapInArrow(build, "article long, page_id long, pdf_page int, no int, text string, open boolean")
    order = Window.partitionBy("article").orderBy("pdf_page", "page_id", "no")
    numbered = parts.withColumn("starts", F.when(F.lag("open", 1, False).over(order), 0).otherwise(1)).withColumn("paragraph", F.sum("starts").over(order))
    joined = numbered.groupBy("article", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "page_id", "no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return joined.select(F.when(F.col("article") >= 0, F.col("article")).alias("article_id"), F.col("paragraph").cast("int").alias("paragraph"), "text")
