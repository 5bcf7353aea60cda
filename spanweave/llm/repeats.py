"""Long exact spans shared between records, by recompression.

Rounds of recompression rename the signs of all texts: one round names short runs of a sign,
the others split the names into a left and a right class by a hash bit and name every pair of
a left and a right one. A name is a fingerprint of what it stands for, so all tasks give
equal names to equal strings without talking to each other, and whether two names merge
depends on these two alone. Inside two equal substrings the names are therefore equal too,
but for at most ``EDGE`` code points at either end (4 for the runs, then the longest name of
each pair round: 4, 8 and 12).

An *anchor* is a name with the least fingerprint in some window of ``WINDOW`` positions. Every
substring of ``LEAST`` code points holds, away from its edges, a whole window, hence a common
anchor with the same ``EDGE`` signs before and ``AFTER`` signs behind it. Records that share
such a key are compared sign by sign around it; that verifies the repeat and gives its
extent. Nothing is lost: the candidates are complete, not probable.

Keys that many records share are not paired blindly: their anchors are regrouped by every
whole window of ``LEAST`` signs around them, so that only true repeats meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

LEAST = 120
RUN = 4
LONGEST = 12
ROUNDS = 3
EDGE = 28
#: Positions of a window: what is left of LEAST without the edges and one name.
WINDOW = LEAST - 2 * EDGE - LONGEST
AFTER = LEAST - EDGE - WINDOW + 1
#: Records of a key above which its anchors are regrouped by whole windows.
CROWD = 64
#: Code points handled together, and overlap of the pieces of longer texts.
PIECE, OVERLAP = 1 << 20, 512

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def recompress(codes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and lengths after naming runs and ``rounds`` rounds of naming pairs."""
    n = len(codes)
    # Runs of up to RUN equal signs; longer ones stay as they are.
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    size = np.diff(np.append(edge, n))
    short = size <= RUN
    keep = np.ones(n, bool)
    if (size > 1).any():
        inside = np.ones(n, bool)
        inside[edge] = False
        keep = ~(inside & np.repeat(short, size))
    start = np.flatnonzero(keep)
    length = np.diff(np.append(start, n))
    name = _mix(codes[start].astype(np.uint64) * _M3 + length.astype(np.uint64))
    for r in range(rounds):
        salt = np.uint64((r + 1) * 0x51ED270B % (1 << 63))
        left = (_mix(name ^ salt) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (length[:-1] + length[1:] <= LONGEST)
        at = np.flatnonzero(joins)
        name = name.copy()
        length = length.copy()
        name[at] = _mix(name[at] * _M1 + _mix(name[at + 1] + salt))
        length[at] += length[at + 1]
        stay = np.ones(len(name), bool)
        stay[at + 1] = False
        name, start, length = name[stay], start[stay], length[stay]
    return name, start, length


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` values."""
    now, have = values, 1
    while have * 2 <= width:
        now = op(now[:-have], now[have:])
        have *= 2
    if have < width:
        k = width - have
        now = op(now[:-k], now[k:])
    return now


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of the anchors of a text; none if it is shorter than LEAST.

    Of adjacent anchors with one key (inside long runs) the first and the last are kept."""
    n = len(text)
    if n < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    positions, keys = [], []
    for lo in range(0, n, PIECE):
        a, b = max(0, lo - OVERLAP), min(n, lo + PIECE + OVERLAP)
        p, k = _anchors_of(codes[a:b])
        p = p + a
        inside = (p >= lo) & (p < lo + PIECE)
        positions.append(p[inside])
        keys.append(k[inside])
    p, k = np.concatenate(positions), np.concatenate(keys)
    if len(p) > 2:
        middle = np.zeros(len(p), bool)
        middle[1:-1] = (k[1:-1] == k[:-2]) & (k[1:-1] == k[2:]) & (p[1:-1] - p[:-2] == 1) & (p[2:] - p[1:-1] == 1)
        p, k = p[~middle], k[~middle]
    return p, k


def _anchors_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(codes)
    if n < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    name, start, _ = recompress(codes)
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[start] = _mix(name ^ _M2) >> np.uint64(1)
    least = _sliding(rank, WINDOW, np.minimum)  # window i: positions i .. i+WINDOW-1
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
    most = _sliding(padded, WINDOW, np.maximum)  # of the windows that hold position i
    at = np.flatnonzero((rank == most) & (rank != np.iinfo(np.uint64).max))
    at = at[(at >= EDGE) & (at + AFTER <= n)]
    if not len(at):
        return at, np.empty(0, np.uint64)
    # Key: a polynomial fingerprint of the signs around the anchor.
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    power = np.ones(n + 1, np.uint64)
    power[1:] = base
    power = np.multiply.accumulate(power)
    inverse = np.ones(n + 1, np.uint64)
    inverse[1:] = np.uint64(pow(int(base), -1, 1 << 64))
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_mix(codes.astype(np.uint64) + _M3) * power[:n])))
    a, b = at - EDGE, at + AFTER
    return at, _mix((sums[b] - sums[a]) * inverse[a])


def _common_after(a: str, i: int, b: str, j: int) -> int:
    n = min(len(a) - i, len(b) - j)
    k = 0
    while k < n:
        step = min(32, n - k)
        if a[i + k:i + k + step] == b[j + k:j + k + step]:
            k += step
        else:
            while a[i + k] == b[j + k]:
                k += 1
            return k
    return n


def _common_before(a: str, i: int, b: str, j: int) -> int:
    k, n = 0, min(i, j)
    while k < n and a[i - k - 1] == b[j - k - 1]:
        k += 1
    return k


def matches(df: DataFrame, key: str, text: str, crowd: int = CROWD) -> DataFrame:
    """Verified repeats: ``id_a`` < ``id_b``, ``start_a``, ``start_b``, ``length`` of spans of
    at least LEAST code points that stand in both (cut to the surroundings of one anchor:
    longer repeats come in overlapping pieces that together cover them).

    Null, empty and short texts share nothing. Several rows under one key are texts of one
    record, which is not compared with itself. Null keys are left out. Other columns are
    ignored."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where(f"k is not null and length(t) >= {LEAST}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, hs, ps, fs = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, f = anchors(t)
                h = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
                ks.append(np.full(len(p), k, np.int64))
                hs.append(np.full(len(p), h, np.int64))
                ps.append(p.astype(np.int64))
                fs.append(f.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (fs, ks, hs, ps)], ["f", "k", "h", "p"])

    found = cut(rows.mapInArrow(find, "f long, k long, h long, p long"))
    # Keys of more than one record; map-side combined, two numbers a key.
    shared = found.groupBy("f").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("f", "n")
    spots = found.join(shared, "f").groupBy("k", "h").agg(F.collect_set(F.struct("f", "p", "n")).alias("spots"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), batch.column(1)], ["k", "h", "t"])

    texts = rows.mapInArrow(hashed, "k long, h long, t string").join(spots, ["k", "h"])

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, t, spots_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for s in spots_:
                    p = s["p"]
                    if s["n"] <= crowd:
                        a = max(0, p + AFTER - LEAST)
                        rows_ = [(f"{s['f'] & (1 << 64) - 1:x}", p, a, t[a:p - EDGE + LEAST])]
                    else:
                        rows_ = []
                        for a in range(max(0, p + AFTER - LEAST), min(p - EDGE, len(t) - LEAST) + 1):
                            w = t[a:a + LEAST]
                            rows_.append((xxhash.xxh128_hexdigest(w.encode("utf-8", "surrogatepass")), a, a, w))
                    for r in rows_:
                        for col, x in zip(out, (r[0], k, r[1], r[2], r[3])):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["f", "k", "p", "a", "t"])

    around = cut(texts.select("k", "t", "spots").mapInArrow(surroundings, "f string, k long, p long, a long, t string"))
    other = around.select("f", *[F.col(c).alias(c + "2") for c in ("k", "p", "a", "t")])
    pairs = around.join(other, "f").where("k < k2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, p, a, t, k2, p2, a2, t2 in zip(d["k"], d["p"], d["a"], d["t"], d["k2"], d["p2"], d["a2"], d["t2"]):
                i, j = p - a, p2 - a2
                before, after = _common_before(t, i, t2, j), _common_after(t, i, t2, j)
                if before + after >= LEAST:
                    for col, x in zip(out, (k, k2, p - before, p2 - before, before + after)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id_a", "id_b", "start_a", "start_b", "length"])

    return pairs.select("k", "p", "a", "t", "k2", "p2", "a2", "t2").mapInArrow(verify, "id_a long, id_b long, start_a long, start_b long, length long").distinct()


def coverage(found: DataFrame) -> DataFrame:
    """``id`` and the number of code points that stand in another record too, from the union
    of the spans of ``matches``."""
    spans = found.select(F.col("id_a").alias("id"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
        found.select(F.col("id_b").alias("id"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))).groupBy("id", "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(order), F.lit(0))
    return spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach))).groupBy("id").agg(F.sum("new").alias("shared_chars"))
