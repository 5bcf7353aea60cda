"""Parties in names of proceedings, as people type them.

Which words are given names, which are trades, and which short form stands for which word is
learned from the names themselves (see ``vocabulary``); only the general forms of firms,
titles and phrases around names are fixed."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from . import mojibake

# Forms of firms and their short forms.
FORMS = frozenset("cooperative coop corporation corp company co association assn assoc ass'n partnership p'ship pship llp lp brothers bros limited ltd ltee incorporated inc llc plc gmbh sa".split())
LONG_FORMS = tuple(x for x in FORMS if len(x) > 5)
HONORIFICS = frozenset("mr mrs ms miss dr prof hon sir mme mlle madame monsieur".split())

LEAD = re.compile(r"^\s*(?:(?:in\s+the\s+matter\s+of|in\s+re|re|ex\s+parte|dans\s+l[’']affaire(?:\s+de)?|affaire)\s*:?\s+)+", re.I)
TRAIL = re.compile(r"(?:[,\s]+(?:et\s+al\b\.?|and\s+others|and\s+another|et\s+autres?|&\s+others|et\s+consorts)|\s*\((?:re|appeal|no\.?\s*\d+)\))+\s*$", re.I)
ESTATE = re.compile(r"^(?:the\s+)?(?:estate\s+of(?:\s+the\s+late)?|succession\s+(?:de\s+|d[’'])?)\s*|\s*(?:\(estate\)|,?\s+estate)\s*$", re.I)
VERSUS = re.compile(r"\s+(?:-\s*v\s*-|vs?\.?|versus|c\.|contre|-\s*c\s*-)\s+")
VERSUS_UPPER = re.compile(r"\s+(?:V\.?|VS\.?|Vs\.?|C\.|-V-)\s+")


def plain(text: str) -> str:
    """Lower case without diacritics, one space between words."""
    text = text.translate(str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "đ": "d", "’": "'", "‘": "'", "œ": "oe"}))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def sides(name: str, french: bool = False) -> list[str]:
    """The sides of a proceeding's name."""
    name = LEAD.sub("", " ".join(name.split()))
    m = None
    for pattern in (VERSUS, VERSUS_UPPER):
        for m in pattern.finditer(name):
            if m[0].strip().lower().startswith("c") and not french and m[0].strip() != "c.":
                continue
            if 0 < m.start() and m.end() < len(name):
                break
        else:
            m = None
        if m:
            break
    parts = [name[: m.start()], name[m.end():]] if m else [name]
    out = []
    for p in parts:
        p = TRAIL.sub("", p).strip(" ,;")
        p = LEAD.sub("", p)
        p = ESTATE.sub("", p).strip(" ,;")
        if p:
            out.append(p)
    return out


def damerau(a: str, b: str, limit: int) -> int:
    """True Damerau-Levenshtein distance (transposed signs may be edited again, so that the
    triangle inequality holds), or ``limit`` + 1 if it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    big = n + m
    last: dict[str, int] = {}
    rows = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        rows[i + 1][1] = i
    for j in range(m + 1):
        rows[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0
        low = big
        for j in range(1, m + 1):
            i1, j1 = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            v = min(rows[i][j] + cost, rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
            rows[i + 1][j + 1] = v
            low = min(low, v)
        last[a[i - 1]] = i
        if low > limit + 1:
            return limit + 1
    return min(rows[n + 1][m + 1], limit + 1)


class Near:
    """Words of a small list that are one edit away: such an edit leaves the first two or the
    last two signs as they are (in words of four, the first or the last)."""

    def __init__(self, words):
        self.by: dict[str, list[str]] = {}
        self.words = sorted(words)
        for w in self.words:
            for k in self.keys(w):
                self.by.setdefault(k, []).append(w)

    @staticmethod
    def keys(w: str) -> set[str]:
        n = 1 if len(w) < 6 else 2
        return {"^" + w[:n], "$" + w[-n:], *({"^" + w[:2], "$" + w[-2:], "^" + w[:1], "$" + w[-1:]} if len(w) < 8 else ())}

    def find(self, word: str, limit: int = 1) -> list[str]:
        near = {w for k in self.keys(word) for w in self.by.get(k, ()) if abs(len(w) - len(word)) <= limit}
        return sorted(w for w in near if damerau(word, w, limit) <= limit)


def _within(short: str, long_: str) -> bool:
    it = iter(long_)
    return all(c in it for c in short)


@lru_cache(maxsize=1 << 16)
def form_of(token: str) -> bool:
    word = token.strip(".,").replace("-", "")
    if word in FORMS:
        return True
    return len(word) > 5 and bool(NEAR_FORMS.find(word))


NEAR_FORMS = Near(LONG_FORMS)


@dataclass
class Vocabulary:
    """Learned marks - the words beside a family's or firm's own name. ``given`` and ``trades``
    hold for each word the words it stands for, itself or the longer ones. An empty vocabulary
    leaves the order of words to decide."""

    given: dict[str, tuple[str, ...]] = field(default_factory=dict)
    trades: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.near_given = Near({x for v in self.given.values() for x in v})
        self.near_trades = Near({x for v in self.trades.values() for x in v})
        self.memo: dict[tuple[str, str], tuple[str, ...]] = {}

    def _held(self, kind: str, token: str, find) -> tuple[str, ...]:
        got = self.memo.get((kind, token))
        if got is None:
            if len(self.memo) > 1 << 17:
                self.memo.clear()
            got = self.memo[kind, token] = find(token)
        return got

    def trade_of(self, token: str) -> str | None:
        """The trade a word names: spelled out, shortened, or with a typo."""
        got = self._held("t", token, self._trade)
        return got[0] if got else None

    def _trade(self, token: str) -> tuple[str, ...]:
        word = token.strip(".,")
        if word in self.trades:
            return self.trades[word][:1]
        whole = self.near_trades.words
        if token.endswith(".") and 2 < len(word) <= 6:
            near = [t for t in whole if t.startswith(word)] or [t for t in whole if t[0] == word[0] and _within(word, t)]
            if near:
                return (near[0],)
        if len(word) >= 4:
            near = self.near_trades.find(word)
            if len(near) == 1:
                return (near[0],)
            near = [t for t in whole if len(word) >= 5 and t.startswith(word)]
            if len(near) == 1:
                return (near[0],)
        return ()

    def given_of(self, token: str) -> tuple[str, ...]:
        """Given names a word can stand for."""
        return self._held("g", token, self._given)

    def _given(self, token: str) -> tuple[str, ...]:
        word = token.strip(".,")
        if word in self.given:
            return self.given[word]
        if len(word) >= 4:
            near = self.near_given.find(word)
            if near:
                return tuple(near)
            if len(word) >= 7:
                near = [g for g in self.near_given.find(word, 2) if len(g) >= 7]
                if len(near) == 1:
                    return (near[0],)
        return ()


#: Share of all pairs of words that a mark must stand in: at most 1/SHARE words are marks.
SHARE = 5e-5
#: Pairs that a mark stands in at least.
LEAST = 4
#: How many times more partners a mark has than its partners have on average.
AHEAD = 2.0
#: Share of its partners that a short form has in common with the word it stands for.
TOGETHER = 0.2
#: Share of its partners with a form of firm beside them from which a mark is a trade.
FIRM = 0.3


def two_words(side: str) -> tuple[str, str, bool] | None:
    """The two words of a side that has just two beside titles, initials and forms of firms,
    and whether it has such a form."""
    words, form = [], False
    for t in plain(side.replace(",", ", ")).split():
        w = t.strip(".,()")
        if not w or t in ("the", "&", "of", "late") or w in HONORIFICS:
            continue
        if form_of(t):
            form = True
        elif len(w) > 1:
            words.append(w)
    return (words[0], words[1], form) if len(words) == 2 else None


def vocabulary(words: dict[str, tuple[int, float, bool]], together: dict[tuple[str, str], int]) -> Vocabulary:
    """The vocabulary of marks ``words`` (their partners, those partners' partners on average,
    whether it is a trade) where ``together`` counts the partners two marks share. A mark
    stands for the more frequent one of its kind with which it shares partners."""
    longer: dict[str, list[str]] = {}
    for (a, b), n in together.items():
        if words[a][2] == words[b][2] and (words[a][0], a) < (words[b][0], b) and words[a][0] * 1.25 <= words[b][0] and n >= 2 and n >= TOGETHER * words[a][0]:
            longer.setdefault(a, []).append(b)
    stands: dict[str, tuple[str, ...]] = {}
    for w in sorted(words, key=lambda w: (-words[w][0], w)):  # longer forms are resolved first
        of = [x for b in longer.get(w, ()) for x in stands[b]]
        stands[w] = tuple(sorted(set(of), key=lambda x: (-words[x][0], x))) or (w,)
    return Vocabulary({w: v for w, v in stands.items() if not words[w][2]}, {w: v for w, v in stands.items() if words[w][2]})


@dataclass(frozen=True)
class Party:
    """A party: kind (person or firm), stem (family or firm name), mark (given name or initial;
    trade), and middle initial."""

    kind: str
    stem: str
    mark: str
    middle: str


def party(side: str, known: Vocabulary) -> Party | None:
    """The party a side names."""
    given_of, trade_of = known.given_of, known.trade_of
    comma = "," in side
    head, _, tail = side.partition(",")
    tokens = [t for t in plain(side.replace(",", ", ")).split() if t not in ("the", "&", "of", "late")]
    tokens = [t for t in tokens if t.strip(".,") not in HONORIFICS and t.strip(".,()")]
    if not tokens:
        return None
    cut = [t.rstrip(",") for t in tokens]
    forms = [t for t in cut if form_of(t)]
    rest = [t for t in cut if not form_of(t)]
    trades = [(k, trade_of(t)) for k, t in enumerate(rest)]
    trades = [(k, t) for k, t in trades if t and (forms or len(rest) > 1) and (forms or rest[k].strip(".,") in known.trades or not given_of(rest[k]))]
    if (forms and rest) or (trades and len(rest) >= 2 and not any(given_of(t) for k, t in enumerate(rest) if k != trades[-1][0])):
        k, trade = trades[-1] if trades else (None, "")
        stem = "".join(re.sub(r"[^a-z0-9]", "", t) for n, t in enumerate(rest) if n != k)
        if not stem:
            return None
        return Party("firm", stem, trade, "")
    words = [(t.rstrip(","), t.endswith(",")) for t in tokens]
    bare = [re.sub(r"[^a-z]", "", t) for t, _ in words]
    initials = [n for n, w in enumerate(bare) if len(w) == 1]
    full = [n for n, w in enumerate(bare) if len(w) > 1]
    if not full:
        return None
    first_family = len(plain(head).split()) if comma else 0
    family: list[int] = []
    given: tuple[str, ...] = ()
    at = None
    if comma and tail.strip():
        family = [n for n in full if n < first_family]
        after = [n for n in full if n >= first_family]
        if after:
            at = after[0]
            given = given_of(bare[at]) or (bare[at],)
    if not family:
        named = [n for n in full if given_of(bare[n])]
        if named and len(full) > 1:
            exact = [n for n in named if bare[n] in known.given]
            at = (exact or named)[0] if full[0] in named or exact else named[-1]
            if full[0] in (exact or named):
                at = full[0]
            given = given_of(bare[at])
            family = [n for n in full if n != at]
        elif len(full) > 1 and not initials:
            at, family = full[0], full[1:]
            given = (bare[at],)
        else:
            family = full
    stem = "".join(bare[n] for n in family)
    if not stem:
        return None
    loose = [bare[n] for n in initials]
    if given:
        return Party("person", stem, "|".join(given), loose[0] if loose else "")
    return Party("person", stem, loose[0] if loose else "", loose[1] if len(loose) > 1 else "")


class Authorities:
    """Public authorities, which are no parties."""

    def __init__(self, names: list[str]):
        self.names = {self.key(n) for n in names if n}
        self.parts: dict[str, set[str]] = {}
        for n in self.names:
            if len(n) >= 9:  # of four parts, two edits leave one as it is
                q = len(n) // 4
                for i in range(4):
                    self.parts.setdefault(n[i * q:(i + 1) * q], set()).add(n)
        self.sizes = sorted({len(x) for x in self.parts})

    @staticmethod
    def key(name: str) -> str:
        return re.sub(r"[^a-z0-9]", "", re.sub(r"^the ", "", plain(name)))

    def __contains__(self, side: str) -> bool:
        k = self.key(side)
        if k in self.names:
            return True
        if len(k) < 8:
            return False
        near = {n for size in self.sizes for i in range(len(k) - size + 1) for n in self.parts.get(k[i:i + size], ()) if abs(len(n) - len(k)) <= 2}
        return any(damerau(k, n, 2 if len(n) >= 14 else 1) <= (2 if len(n) >= 14 else 1) for n in near)


def private_sides(name: str | None, authorities: Authorities, french: bool = False) -> list[str]:
    """The sides of a proceeding's name that are no public authority."""
    if not name or not name.strip():
        return []
    return [s for s in sides(mojibake.restore(name)[1] or "", french) if s not in authorities]


def parties(name: str | None, authorities: Authorities, known: Vocabulary, french: bool = False) -> list[Party]:
    """The private parties of a proceeding's name."""
    out = []
    for s in private_sides(name, authorities, french):
        p = party(s, known)
        if p and p not in out and len(p.stem) > 1:
            out.append(p)
    return out
