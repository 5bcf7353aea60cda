"""Text decoded with the wrong encoding: finding it and restoring what was written.

For every pair of a true and a wrong encoding the garbled form of every expected sign is
computed beforehand and put into one Aho-Corasick automaton. Where it matches, and only
there, the sign it came from is put back; text garbled twice is read twice. Forms that
correct text may contain too are kept if their surroundings show that nothing went wrong:
a word with a correct accented letter beside the match was decoded rightly.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings in which UTF-8 is read by mistake, the likelier first.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp437", "mac_roman", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_2", "iso8859_15")
# Encodings of another script in which Western single bytes are read by mistake.
WRONG_FOR_BYTES = ("cp1251", "cp437", "cp1253", "koi8_r", "iso8859_5", "cp866")
# Blocks of signs that are expected in correct text.
EXPECTED = ((0x80, 0x9F), (0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2DD), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x1E80, 0x1E9E), (0x2010, 0x2027), (0x2030, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265))
UTF7 = re.compile(r"\+([A-Za-z0-9/]{2,})(-?)")
#: Code points on either side of a lone sign that show in what script it stands.
AROUND = 60


def decode_loosely(data: bytes, encoding: str) -> str | None:
    """``data`` in a single-byte encoding; bytes it leaves undefined become C1 controls,
    as lenient decoders have them."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            if not encoding.startswith("cp12"):
                return None
            out.append(chr(b))
    return "".join(out)


def expected_signs() -> list[str]:
    return [chr(c) for lo, hi in EXPECTED for c in range(lo, hi + 1) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]


@dataclass(frozen=True)
class Form:
    """A garbled form: what was written, by candidates, and whether it is a sequence of at
    least two signs (from UTF-8) or one sign (from a single byte)."""

    text: str
    restored: tuple[str, ...]
    sequence: bool


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    forms: dict[str, list] = {}
    signs = expected_signs()
    for wrong in WRONG_FOR_UTF8:
        for c in signs:
            form = decode_loosely(c.encode("utf-8"), wrong)
            if form and form != c and not any(x in "\r\n\t " for x in form):
                forms.setdefault(form, [True, []])[1].append(c)
    for wrong in WRONG_FOR_BYTES:
        for b in range(0x80, 0x100):
            c = decode_loosely(bytes([b]), "cp1252")
            form = decode_loosely(bytes([b]), wrong)
            if form and len(form) == 1 and form != c and c.isprintable() and foreign(form):
                forms.setdefault(form, [False, []])[1].append(c)
    a = ahocorasick.Automaton()
    for form, (sequence, restored) in forms.items():
        a.add_word(form, Form(form, tuple(dict.fromkeys(restored)), sequence))
    a.make_automaton()
    return a


def foreign(ch: str) -> bool:
    """Whether a sign is a letter of another script or a drawing sign, strange in a Latin word."""
    o = ord(ch)
    return 0x370 <= o <= 0x3FF or 0x400 <= o <= 0x4FF or 0x2200 <= o <= 0x23FF or 0x2500 <= o <= 0x25FF


def latin(ch: str) -> bool:
    return ch.isalpha() and (ch < "Ͱ" or "Ḁ" <= ch <= "ỿ")


def _word(text: str, a: int, b: int, covered: list[tuple[int, int]]) -> tuple[int, int]:
    """The word around ``a:b``: letters and matched spans without a gap."""
    starts = {x: y for x, y in covered}
    ends = {y: x for x, y in covered}
    while a > 0:
        if a in ends and ends[a] < a:
            a = ends[a]
        elif text[a - 1].isalpha():
            a -= 1
        else:
            break
    while b < len(text):
        if b in starts:
            b = starts[b]
        elif text[b].isalpha():
            b += 1
        else:
            break
    return a, b


def _spans(text: str) -> list[tuple[int, int, str]]:
    """Garbled spans of ``text`` with what was written."""
    found = [(end + 1 - len(f.text), end + 1, f) for end, f in automaton().iter(text)]
    if not found:
        return []
    found.sort(key=lambda x: (x[0], -x[1]))
    picked, at = [], 0
    for a, b, f in found:
        if a >= at:
            picked.append((a, b, f))
            at = b
    sequences = [(a, b, f) for a, b, f in picked if f.sequence]
    singles = [(a, b, f) for a, b, f in picked if not f.sequence]
    out = []
    cover = [(a, b) for a, b, _ in sequences]
    for a, b, f in sequences:
        lo, hi = _word(text, a, b, cover)
        inside = [(x, y) for x, y in cover if lo <= x and y <= hi]
        if any(ord(text[k]) > 127 and text[k].isalpha() and not any(x <= k < y for x, y in inside) for k in range(lo, hi)):
            continue
        out.append((a, b, f.restored[0]))
    if singles:
        native = {k for k in range(len(text) - 1) if foreign(text[k]) and foreign(text[k + 1]) and text[k].isalpha() and text[k + 1].isalpha()}
        native |= {k + 1 for k in native}
        near, alone = [], []
        for a, b, f in singles:
            if a in native:
                continue
            before, after = text[a - 1:a], text[b:b + 1]
            sides = [x for x in (before, after) if x]
            if any(latin(x) for x in sides):
                near.append((a, b, f))
            elif text[a].isalpha() or 0x2500 <= ord(text[a]) <= 0x25FF:
                alone.append((a, b, f))
        taken = near
        # A lone sign counts beside other garbled ones, by a digit, or in a line that is Latin around it.
        for a, b, f in alone:
            sides = text[max(0, a - 1):a] + text[b:b + 1]
            if near or (any(x.isdigit() for x in sides) and text[a] != "√") or _in_latin(text, a, b, native):
                taken = [*taken, (a, b, f)]
        for a, b, f in taken:
            out.append((a, b, _by_case(text, a, b, f.restored)))
    return sorted(out)


def _in_latin(text: str, a: int, b: int, native: set[int]) -> bool:
    """Whether the words around a sign, within AROUND code points on its line, are Latin ones."""
    lo = max(text.rfind("\n", max(0, a - AROUND), a) + 1, a - AROUND, 0)
    end = text.find("\n", b, b + AROUND)
    hi = min(len(text), b + AROUND) if end < 0 else end
    return any(latin(text[k]) for k in range(lo, hi)) and not any(k in native for k in range(lo, hi))


def _by_case(text: str, a: int, b: int, restored: tuple[str, ...]) -> str:
    """The candidate whose case suits the neighbours."""
    lower = text[b:b + 1].islower() and (text[a - 1:a].islower() or text[a].islower()) or text[a - 1:a].islower()
    upper = text[b:b + 1].isupper() or (text[a - 1:a].isupper() and not text[b:b + 1].islower())
    for c in restored:
        if (lower and c.islower()) or (upper and not lower and c.isupper()) or (not lower and not upper):
            return c
    return restored[0]


def _utf7(text: str) -> tuple[str, int]:
    """``text`` with UTF-7 runs decoded, and how many there were."""
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        body = m[1]
        for size in range(len(body), 1, -1):
            run = body[:size]
            if size != len(body) and m[2]:
                break
            try:
                raw = base64.b64decode(run + "=" * (-len(run) % 4))
                got = raw[: len(raw) // 2 * 2].decode("utf-16-be")
            except (ValueError, UnicodeDecodeError):
                continue
            bits = len(run) * 6 - len(got) * 16
            if got and bits < 6 and all(ord(c) > 127 and _likely(c) for c in got) and base64.b64encode(got.encode("utf-16-be")).rstrip(b"=").decode() == run:
                n += 1
                return got + body[size:]
        return m[0]

    return UTF7.sub(put, text), n


def _likely(c: str) -> bool:
    o = ord(c)
    return any(lo <= o <= hi for lo, hi in EXPECTED)


def restore(text: str | None) -> tuple[bool, str | None]:
    """Whether any part of ``text`` was decoded wrongly, and the text with every span that
    can be restored put right; the replacement sign U+FFFD stands where a byte was lost."""
    if not text or (text.isascii() and "+" not in text):
        return False, text
    garbled = "�" in text
    now = text
    if "+" in now:
        now, n = _utf7(now)
        garbled |= n > 0
    while not now.isascii():  # each round leaves fewer garbled signs
        spans = _spans(now)
        if not spans:
            break
        garbled = True
        parts, at = [], 0
        for a, b, c in spans:
            parts += [now[at:a], c]
            at = b
        now = "".join(parts) + now[at:]
    return garbled, now


def find(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row per garbled value of ``fields``: ``record_table`` (``name``), ``record_id``,
    ``field``, ``value``, ``restored`` and ``complete`` (no sign stays lost).

    Null and empty values are not garbled. Repeated rows give one row. Columns are read by
    name; others are ignored."""
    rows = df.select(F.col(key).cast("long").alias("k"), *[F.col(f).cast("string").alias(f"f{n}") for n, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for n, f in enumerate(fields):
                for k, v in zip(keys, batch.column(n + 1).to_pylist()):
                    bad, good = restore(v)
                    if bad:
                        for col, x in zip(out, (k, f, v, good, "�" not in good)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], ["record_id", "field", "value", "restored", "complete"])

    found = rows.mapInArrow(run, "record_id long, field string, value string, restored string, complete boolean")
    return found.dropDuplicates(["record_id", "field", "value"]).select(F.lit(name).alias("record_table"), "*")
