"""Sentence units of texts in many languages and scripts.

A finite transducer reads the *events* of a text - stops, quotation marks, brackets, line
ends, Thai spaces - and writes unit borders. What an event means is decided from a few
characters around it; what the transducer remembers is only which quotation marks and
brackets are open (two deep) and whether the unit has begun, so it has few states.

Long texts are cut into chunks. Each chunk is first read as a *function* from the state at
its start to the state at its end: a blank line puts every state back to the first, so the
readings of all states fall together soon. The functions are composed by a parallel prefix
scan (over blocks of chunks, then over blocks), which gives each chunk its true state and
the border before it; then all chunks write their units independently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts longer than this many code points are read in chunks of about this length.
CHUNK = 1 << 14
#: Chunks composed together in the first step of the scan.
BLOCK = 64
#: Open marks remembered.
DEPTH = 2
#: Code points a chunk sees on either side of itself.
MARGIN = 96

# Abbreviations that stand before a name or word and never end a sentence.
BEFORE_WORD = frozenset(
    """v vs dr mr mrs ms prof hon sgt rev capt gen col lt m mm me mme mlle mgr messrs st ste sr sra srta dra d dña
    e.g i.e cf c.f viz vgl z z.b zit bzw d.h u.a s.o p.ex ex al.a κ κα κος κ.κ π.χ βλ г-н г-жа см ср т.е т.д т.п
    д-р проф डॉ श्री د أ vel re sch. j.d""".split()
)
# Abbreviations that stand before a number.
BEFORE_NUMBER = frozenset(
    """no nos n nr nrn núm num p pp pg pág págs para paras par pars art arts vol vols ch c cl cls s ss sec secs sch al abs
    ziff rn fn fig ed app ex pt r rr l'art d'art άρθρ αρ σελ παρ ст п пп гл ч стр № jan feb mar apr may jun jul aug sep sept oct nov dec
    janv févr avr juill août sept oct nov déc ene abr ago dic mär okt dez тел""".split()
)
# Words before a letter that counts something, so that its stop may end a sentence.
LABELS = frozenset("sch schedule part rule form exhibit appendix app annex annexe anexo section class vitamin plan".split())
# German words before an ordinal, and months after one.
ORDINAL_BEFORE = frozenset("der die das dem den des am vom zum im beim bis seit ab dieser diesem jeder".split())
ORDINAL_AFTER = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert senat".split())
# What goes on after a closing mark in Japanese.
JA_GOES_ON = "とはがのにをもでやへ"

OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "〈": "〉", "《": "》", "【": "】"}
CLOSERS = frozenset("”»」』)]）〉》】")
BRACKETS = frozenset("([（【")
CJK_STOPS = frozenset("。！？｡")
STOPS = ".!?…؟۔।॥。！？｡։።"
SUPER = "¹²³⁰⁴-⁹"

_EVENT = r"[.!?…؟۔।॥。！？｡։።]+|[“”„«»「」『』()\[\]（）〈〉《》【】\"]|[^\S\r\n  \x85]*(?:\r\n|[\n\r  \x85])\s*"
EVENT = re.compile(_EVENT)
EVENT_GREEK = re.compile(_EVENT + r"|[;;](?=\s|$)")
_THAI_SPACE = r"|(?<=[ก-๎๚๛])[^\S\r\n]+(?=[ก-๎])"
EVENT_THAI = re.compile(_EVENT + _THAI_SPACE)
EVENT_BOTH = re.compile(_EVENT + _THAI_SPACE + r"|[;;](?=\s|$)")
THAI = re.compile("[ก-๎]")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")

_LINE = r"(?:\r\n|\n|\r(?!\n)|[\x85 ])"
BLANK = re.compile(_LINE + r"[^\S\r\n\x85  ]*" + _LINE + r"| ")
#: What belongs to the unit after its stop: closing marks, note marks.
TAIL = re.compile(rf"(?:[^\S\r\n]?[»]|[)\]\"”’'」』）*]|[{SUPER}†‡]+|\[\d{{1,3}}\])*")
NOTE = re.compile(rf"(?:[{SUPER}†‡]+|\[\d{{1,3}}\])*")
#: White space and opening marks before the first sign of what follows.
AHEAD = re.compile(r"(\s+)[\"“„«‘'(\[¿¡§–—•*「『《（-]*(.?)", re.S)
WORD = re.compile(r"[^\s(\[“\"„«,;:/—…]+\Z")
WORD_BEFORE = re.compile(r"(\S+)\s+\S*\Z")
#: A paragraph number or item mark, alone.
MARK = re.compile(
    r"\s*﻿?\s*(?:(?:§+|¶|art(?:icle)?\.?|part|partie|teil|parte|chapter|section|rule)\s*)?(?:\(?\[?(?:\d{1,4}(?:\.\d{1,3})*|[a-zA-Zα-ωΑ-Ωа-яА-Я]|[ivxlcIVXLC]{1,6})[.)\]]{0,2}|[•*–—-])\s*\Z",
    re.I)
#: A line that opens an item or numbered paragraph.
ITEM = re.compile(r"(?:\(?\d{1,4}(?:\.\d{1,3})*[.)]|\d{1,3}(?:\.\d{1,3})+\s(?=\s?[^\W\d_a-z])|\[\d{1,4}\]|§+\s?\d+\.?|\(?[a-zα-ωа-я][.)]|\(?[ivxlc]{1,5}[.)]|[•●▪‣*–—-])\s", re.I)
ITEM_AFTER = re.compile(r"[;；:：.。!！?？…؟।;)»”\"]\s*\Z|[;,]\s+(?:and|or|et|ou|und|oder|y|o|и|или|και|ή)\s*\Z")
GLUED = re.compile(r"[^\W\d_A-ZА-ЯΑ-Ω]{3}[.!?][^\W\d_a-zа-яα-ω][^\W\d_A-ZА-ЯΑ-Ω]")
DIGITS = re.compile(r"\d{1,2}")

State = tuple[tuple[tuple[str, bool], ...], bool]  # open marks with "opened the unit"; unit not begun
START: State = ((), True)


def event_pattern(text: str) -> re.Pattern:
    """The events that this text can have."""
    if text.isascii():
        return EVENT
    thai, greek = THAI.search(text), GREEK.search(text)
    return EVENT_BOTH if thai and greek else EVENT_THAI if thai else EVENT_GREEK if greek else EVENT


def _wide(ch: str) -> bool:
    return "\u3000" < ch <= "鿿" or "豈" <= ch <= "﫿" or "！" <= ch <= "～"


def _follows(text: str, at: int) -> str:
    """Kind of what follows ``at``: end, upper, lower, digit, other (a letter without
    case), sign, or none (no white space before it)."""
    m = AHEAD.match(text, at)
    if m is None:
        return "end" if at >= len(text) else "none"
    ch = m[2]
    if not ch:
        return "end"
    if ch.isupper() or ch.istitle():
        return "upper"
    if ch.islower():
        return "lower"
    if ch.isdigit():
        return "digit"
    return "other" if ch.isalpha() else "sign"


def _mark_before(text: str, begin: int, at: int) -> bool:
    """Whether the unit that began at ``begin`` is only an item mark up to ``at``."""
    return at - begin <= 28 and MARK.match(text[begin:at]) is not None


def _line_mark(text: str, at: int) -> bool:
    """Whether only an item mark stands between the last line end and ``at``, below a
    line that is complete."""
    line = max(text.rfind("\n", max(0, at - 20), at), text.rfind("\r", max(0, at - 20), at))
    if line < 0 or not MARK.match(text[line + 1:at]):
        return False
    before = text[max(0, line - 24):line]
    return bool(ITEM_AFTER.search(before)) and not _abbreviation_ends(before)


def _abbreviation_ends(before: str) -> bool:
    m = WORD.search(before.rstrip())
    if not m or not m[0].endswith("."):
        return False
    w = m[0].rstrip(".").lower()
    return w in BEFORE_WORD or w in BEFORE_NUMBER


def _stop_ends(text: str, i: int, j: int, begin: int) -> int:
    """Where the unit ends whose stop stands at ``i:j``, outside of quotation marks and
    brackets; -1 where it goes on. ``begin``: where the unit began, as far as known."""
    run = text[i:j]
    last = run[-1]
    if last in CJK_STOPS:
        return TAIL.match(text, j).end()
    tail = TAIL.match(text, j).end()
    kind = _follows(text, tail)
    if kind == "none":
        if last in "।॥" or (last in "!?؟" and tail < len(text) and _wide(text[tail])):
            return tail
        if i >= 3 and j - i == 1 and GLUED.match(text, i - 3) and text[j].isupper():  # the space between two sentences is missing
            return j
        return -1
    if kind == "end":
        return tail
    if kind == "lower":
        return -1
    if run != ".":
        return tail
    m = WORD.search(text, max(0, i - 24), i)
    word = m[0] if m else ""
    low = word.lower().replace("\xad", "").replace("’", "'")
    if len(word) == 1 and word.isupper():
        before = WORD_BEFORE.search(text, max(0, i - 24), i)
        if before and before[1].lower().rstrip(".") in LABELS:
            return tail
    if kind in ("upper", "other", "sign") and low in BEFORE_WORD:
        return -1
    if kind == "digit" and (low in BEFORE_NUMBER or low in BEFORE_WORD):
        return -1
    if low in ("sch", "n", "nr") and kind == "upper":
        return -1
    if _mark_before(text, begin, i) or _line_mark(text, i):
        return -1
    if len(word) == 1 and word.isalpha():
        ch = word
        if "؀" <= ch <= "ۿ" or "ऀ" <= ch <= "ॿ":
            return -1
        if ch.isupper():
            return -1
        if kind == "upper" and low in "zdpup":
            return -1
    if kind == "upper" and DIGITS.fullmatch(word):
        before = WORD_BEFORE.search(text, max(0, i - 24), i)
        if before and before[1].lower() in ORDINAL_BEFORE:
            return -1
        after = re.match(r"\s+(\w+)", text[tail:tail + 24])
        if after and after[1].lower() in ORDINAL_AFTER:
            return -1
    if kind == "other":
        nxt = AHEAD.match(text, tail)[2]
        if _wide(nxt) and word.isascii() and word[-1:].isalpha():
            return -1
    return tail


def _close_ends(text: str, i: int, opener: str, opened_unit: bool) -> int:
    """Where the unit ends if the mark at ``i``, which closes the outermost quotation or
    bracket, ends it; -1 where it goes on."""
    k = i - 1
    while k >= 0 and text[k].isspace() and i - k < 4:
        k -= 1
    if k < 0 or text[k] not in STOPS:
        if k < 0 or text[k] not in ")”»\"'’" or k < 1 or text[k - 1] not in STOPS:
            return -1
    end = NOTE.match(text, i + 1).end()
    if end >= len(text):
        return end
    ch = text[end]
    bracket = opener in BRACKETS
    if bracket and not opened_unit:
        return -1
    if _wide(ch) or (_wide(text[k]) and not ch.isspace()):
        if ch in "，、。！？；：,.;:」』）)" or ch in JA_GOES_ON:
            return -1
        return -1 if opened_unit and not bracket else end
    kind = _follows(text, end)
    if kind in ("none", "lower"):
        return -1
    if kind == "other" and opened_unit and not bracket and "\n" not in text[end:end + 2]:
        return -1
    return end


def read(text: str, state: State = START, lo: int = 0, hi: int | None = None, events: re.Pattern | None = None, stop_at_blank: bool = False) -> tuple[list[tuple[int, bool]], State, int]:
    """Unit borders in ``text[lo:hi]`` read from ``state``: (end, whether at a blank line),
    the state at ``hi``, and where reading stopped (after the first blank line if
    ``stop_at_blank``). Signs outside of ``lo:hi`` are only looked at."""
    hi = len(text) if hi is None else hi
    opened, fresh = list(state[0]), state[1]
    begin = lo if fresh else lo - 1000
    out: list[tuple[int, bool]] = []
    done = lo
    for m in (events or event_pattern(text)).finditer(text, max(0, lo - 1) if lo else 0):
        i = m.start()
        if i < lo:
            continue
        if i >= hi:
            break
        if i < done:
            continue
        ev = m[0]
        ch = ev[0]
        if ch in STOPS:
            if not opened:
                j = m.end()
                if ch == "." and len(ev) == 1 and j < len(text) and (text[j].islower() or text[j].isdecimal() or text[j] == ","):
                    continue
                end = _stop_ends(text, i, j, begin)
                if end >= 0:
                    out.append((end, False))
                    begin = done = end
        elif ch == '"' or ch in OPENERS or ch in CLOSERS:
            close = None
            if ch == '"':
                inside = any(o == '"' for o, _ in opened)
                close = '"' if inside else None
                if not inside and (i + 1 >= len(text) or text[i + 1].isspace()):
                    continue
            elif ch in CLOSERS or (ch == "“" and any(o == "„" for o, _ in opened)):
                close = next((o for o, _ in reversed(opened) if OPENERS.get(o) == ch), None)
                if close is None and ch == "”":
                    close = next((o for o, _ in reversed(opened) if o == "„"), None)
                if close is None:
                    continue
            if close is None:
                if len(opened) < DEPTH:
                    lead = text[begin:i] if 0 <= i - begin <= 28 else "\0"
                    opened.append((ch, not opened and (not lead.strip("﻿ \t\r\n\xa0　") or MARK.match(lead) is not None)))
            else:
                while opened:
                    o, first = opened.pop()
                    if o == close:
                        break
                if not opened:
                    end = _close_ends(text, i, close, first)
                    if end >= 0:
                        out.append((end, False))
                        begin = done = end
        elif ch.isspace() and any(c in ev for c in "\n\r  \x85"):
            if BLANK.search(ev):
                out.append((i, True))
                opened, begin = [], m.end()
                if stop_at_blank:
                    return out, START, m.end()
            elif not _mark_before(text, begin, i) and ITEM.match(text, m.end()):
                before = text[max(0, i - 24):i]
                if ITEM_AFTER.search(before) and not _abbreviation_ends(before):
                    out.append((i, False))
                    opened, begin = [], m.end()
        elif ch.isspace():  # between Thai letters
            if not opened:
                out.append((i, False))
                begin = m.end()
        else:  # Greek question mark
            if not opened and i and GREEK.match(text[i - 1]) and _follows(text, m.end()) in ("upper", "end", "sign"):
                out.append((m.end(), False))
                begin = done = m.end()
    left = text[begin:hi] if begin >= lo else "x"
    return out, (tuple(opened), not left.strip()), hi


_SPACE_RUN = re.compile(r"[\s﻿]*")


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space (and byte-order marks) around it."""
    while start < end and (text[start].isspace() or text[start] == "﻿"):
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def units(text: str | None) -> list[tuple[int, int]]:
    """Sentence units of a whole text."""
    if not text:
        return []
    out, start = [], 0
    for end, _ in read(text)[0]:
        a, b = trim(text, start, end)
        if a < b:
            out.append((a, b))
        start = max(start, end)
    a, b = trim(text, start, len(text))
    if a < b:
        out.append((a, b))
    return out


def _states() -> list[State]:
    """All states: up to ``DEPTH`` open marks, of which only the outermost can have opened the
    unit; fresh or not where none is open."""
    kinds = [*OPENERS, '"']
    stacks: list[tuple] = [()]
    for depth in range(DEPTH):
        stacks += [(*s, (k, first)) for s in stacks if len(s) == depth for k in kinds for first in ((True, False) if not s else (False,))]
    return [((), True), ((), False)] + [(s, False) for s in stacks if s]


STATES = _states()
STATE_ID = {s: i for i, s in enumerate(STATES)}


def state_id(state: State) -> int:
    stack, fresh = state
    stack = tuple((k, first and not n) for n, (k, first) in enumerate(stack))
    return STATE_ID[stack, fresh and not stack]


def chunk_function(text: str, lo: int, hi: int) -> list[int]:
    """The state after ``text[lo:hi]`` for each state before it, as a list over ``STATES``.
    Only the part up to the first blank line is read more than once; states whose stacks
    agree in what can still be closed there fall together, so few readings are needed."""
    events = event_pattern(text)
    _, _, rest = read(text, START, lo, hi, events, stop_at_blank=True)
    tail = state_id(read(text, START, rest, hi, events)[1]) if rest < hi else None
    if tail is not None:
        return [tail] * len(STATES)
    head = text[lo:hi]
    closing = {c for c in head if c in CLOSERS or c in '"“'}
    out, known = [], {}
    for stack, fresh in STATES:
        if any(OPENERS.get(k, k) in closing or (k == "„" and "”" in closing) for k, _ in stack):
            out.append(state_id(read(text, (stack, fresh), lo, hi, events)[1]))
            continue
        # None of its open marks is closed here: only its depth matters.
        key = (len(stack), fresh)
        if key not in known:
            known[key] = read(text, (stack, fresh), lo, hi, events)[1]
        got = known[key]
        out.append(state_id(((*stack, *got[0][len(stack):]), got[1])))
    return out


def cuts(text: str, chunk: int) -> list[int]:
    """Where chunks begin: the first sign after white space from each multiple on."""
    out, at = [0], chunk
    while at < len(text):
        m = re.compile(r"\s+(?=\S)").search(text, at, min(len(text), at + chunk))
        at = m.end() if m else at
        if at >= len(text):
            break
        out.append(at)
        at += chunk
    return out


def split(df: DataFrame, key: str, text: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``key``, ``start_char``, ``end_char`` of every unit of every text, in code points.

    Every text is read in chunks, of which a short one has one. The first chunk of a text begins
    in the first state; the states in which the others begin come from the scan of ``entries``.
    Null, empty and blank texts have no units. Repeated keys give repeated units. Other columns
    are ignored."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).select(F.struct("k", F.xxhash64("t").alias("h")).alias("k"), "t")
    kind = rows.schema["k"].dataType.simpleString()

    def chop(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for n, t in enumerate(batch.column(1).to_pylist()):
                    at = cuts(t, chunk)
                    for c, (lo, hi) in enumerate(zip(at, [*at[1:], len(t)])):
                        if (c == 0) is first:
                            base = max(0, lo - MARGIN)
                            for col, x in zip(out, (n, c, lo, hi, base, t[base:hi + MARGIN], hi == len(t))):
                                col.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], types))], ["k", "c", "lo", "hi", "base", "t", "last"])

        return run

    schema = f"k {kind}, c long, lo long, hi long, base long, t string, last boolean"
    # Texts up to the length of a chunk have no second one: they need not be read again here.
    long_ = rows.where(F.length("t") > chunk)
    later = long_.mapInArrow(chop(False), schema)
    heads = long_.mapInArrow(chop(True), schema)
    entered = entries(heads.unionByName(later).where("not last"), kind, block)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units inside each chunk; 1: may go on from the chunk before, 2: into the next, 3: both."""
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for n, (c, lo, hi, base, t, last, s) in enumerate(zip(*(x.to_pylist() for x in batch.columns[1:]))):
                begin = top = lo - base
                at = [e for e, _ in read(t, STATES[s], top, hi - base)[0]]
                for e in [*at, None]:
                    if e is None:
                        role = (1 if c and not at else 0) + (0 if last else 2)
                        e = hi - base
                        if begin >= e:
                            continue
                    elif e <= begin and e != top:
                        continue
                    else:
                        role = 1 if begin == top and c else 0
                    x, y = trim(t, begin, min(e, hi - base))
                    for col, v in zip(out, (n, x + base, y + base, role)):
                        col.append(v)
                    begin = max(begin, e)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["k", "c", "a", "b", "r"])

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First chunks, cut and read at once."""
        for batch in chop(True)(batches):
            yield from borders([pa.RecordBatch.from_arrays([*batch.columns, pa.array([0] * batch.num_rows, pa.int32())], [*batch.schema.names, "s"])])

    out = f"k {kind}, c long, a long, b long, r int"
    whole = rows.where((F.length("t") > 0) & (F.length("t") <= chunk)).mapInArrow(opening, out).where("a < b").select("k", "a", "b")
    rest = later.join(entered, ["k", "c"]).select("k", "c", "lo", "hi", "base", "t", "last", "s").mapInArrow(borders, out)
    # Of texts with several chunks, pieces on both sides of a chunk's edge are joined: a unit
    # begins after each piece that reaches a border. Copies of a text are read as one.
    pieces = long_.mapInArrow(opening, out).unionByName(rest).distinct()
    order = Window.partitionBy("k").orderBy("c", "a", "b")
    goes_on = F.lag("r").over(order).isin(2, 3) & F.col("r").isin(1, 3) & (F.lag("c").over(order) < F.col("c"))
    joined = (
        pieces.withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("u", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("a < b").groupBy("k", "u").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("k", "a", "b")
    )
    copies = long_.groupBy("k").agg(F.count("*").alias("copies"))
    joined = joined.join(copies, "k").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("k", "a", "b")
    return whole.unionByName(joined).select(F.col("k.k").alias(key), F.col("a").alias("start_char"), F.col("b").alias("end_char"))


def entries(chunks: DataFrame, kind: str, block: int = BLOCK) -> DataFrame:
    """``k``, ``c`` and the state ``s`` in which every chunk but the first begins, by a prefix scan
    over the functions of the chunks before it.

    Functions are composed in blocks, the blocks in blocks of blocks; a text of two gigabytes
    has at most 32 of those at the usual sizes. Then states go down the same tree."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            fs = [chunk_function(t, lo - base, hi - base) for lo, hi, base, t in zip(d["lo"], d["hi"], d["base"], d["t"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fs, pa.list_(pa.int32()))], ["k", "c", "f"])

    compose = lambda acc, x: F.transform(acc, lambda s: x[s])
    identity = F.array(*[F.lit(i) for i in range(len(STATES))])
    after = lambda fs: lambda s: F.slice(F.aggregate(fs, F.array(s), lambda acc, f: F.concat(acc, F.array(f[F.element_at(acc, -1)]))), 2, 1 << 30)

    def up(rows: DataFrame, at: str, above: str) -> DataFrame:
        """Rows of one level, ``at`` and ``f``, gathered by the place ``above`` they fall into."""
        got = rows.groupBy("k", F.floor(F.col(at) / block).alias(above)).agg(F.array_sort(F.collect_list(F.struct(at, "f"))).alias("x"))
        fs = F.transform("x", lambda x: x["f"])
        return got.select("k", above, F.element_at("x", 1)[at].alias(at), fs.alias("fs"), F.aggregate(fs, identity, compose).alias("f"))

    def down(level: DataFrame, at: str, entered: DataFrame, above: str) -> DataFrame:
        """The state after each of the places gathered, as that in which the next one begins."""
        begun = level.join(entered, ["k", above], "left").withColumn("s", F.coalesce("s", F.lit(0)))
        return begun.select("k", F.posexplode(after("fs")(F.col("s"))).alias("n", "s"), at).select("k", (F.col(at) + F.col("n") + 1).alias(at), "s")

    fn = chunks.select("k", "c", "lo", "hi", "base", "t", "last").mapInArrow(functions, f"k {kind}, c long, f array<int>").dropDuplicates(["k", "c"])
    low = up(fn, "c", "b")
    middle = up(low.select("k", "b", "f"), "b", "bb")
    top = middle.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("bb", "f"))).alias("x")).select("k", F.lit(0).cast("long").alias("bb"), F.transform("x", lambda x: x["f"]).alias("fs"))
    of_top = top.select("k", F.posexplode(after("fs")(F.lit(0))).alias("n", "s")).select("k", (F.col("n") + 1).cast("long").alias("bb"), "s")
    of_blocks = down(middle, "b", of_top, "bb")
    return down(low, "c", of_blocks, "b")
