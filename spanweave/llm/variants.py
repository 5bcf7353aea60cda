"""Variant spellings of names, linked by exact radius joins in a metric space.

1. Given names, trades and their short forms are learned from the names: a mark stands beside
   many different words, a family's or firm's own name beside few, and a short form stands
   beside the same ones as the word it is short for.
2. Distinct names, not mentions, are compared. Their distance is the true Damerau-Levenshtein
   distance of their own names (stems), plus, where their marks can never be the same (another
   trade, another first letter of the given name), a weight above all such distances. Pivots
   are stems far from each other, each under every mark; a name's home is the cell of its
   nearest pivot, which has its own mark. If y within
   the radius r of x is at home in cell j, then by the triangle inequality x is at most 2 r
   farther from pivot j than from its own, and its distance to every pivot is within r of the
   distances that the stems at home in j have; x is copied into the cells that pass both, and
   only into later ones, so every pair meets once.
3. Each cell joins the stems at home there with all its stems, exactly: only stems that share
   what is left of them after as many deletions as edits are compared, so a cell's work grows with
   its stems, not with their pairs. Cells are cut into blocks of bounded size, so no group is
   unbounded.
4. Stems that are near, under marks that can be the same, are one party.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..runtime import cut
from . import names
from .names import Authorities, Vocabulary, damerau

#: Edits, a transposition being one, up to which two stems are spellings of one.
EDITS = 2
#: Stems from which pivots are chosen, for each pivot, and at least; a bounded sample.
CHOICE, CHOICES = 4, 4_096
#: Distances that go with a stem, to the first pivots.
HELD = 24
HOME_BLOCK, CELL_BLOCK = 20_000, 20_000
#: Words of the fullest mark that a cell is meant to be home to.
CELL = 4_000
#: Hashes of remains, and pairs that share one, that are held at a time.
HASHES, SHARED = 1 << 21, 1 << 20
#: Signs that a pivot has at most.
WIDE = 40


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of signs, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max()) if len(words) else 0
    if not width:
        return np.zeros((len(words), 0), np.uint32), sizes
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width), sizes


def distances_to(codes: np.ndarray, sizes: np.ndarray, pivot: str) -> np.ndarray:
    """True Damerau-Levenshtein distances of all rows to one word."""
    n, width = codes.shape
    if not n:
        return np.empty(0, np.int16)
    kind = np.int8 if width + len(pivot) < 120 else np.int16
    # rows[i + 1, j + 1]: distance of the first i signs of the pivot and the first j of the words.
    rows = np.empty((len(pivot) + 2, width + 2, n), kind)
    rows[0] = rows[:, 0] = width + len(pivot)
    for i in range(len(pivot) + 1):
        rows[i + 1, 1] = i
    for j in range(width + 1):
        rows[1, j + 1] = j
    last_row = np.zeros((width, n), kind)  # last row whose sign is this sign of the word
    signs = np.ascontiguousarray(codes.T)
    for i, ch in enumerate(pivot, 1):
        same = signs == ord(ch)
        change = (~same).view(np.int8)
        above = (last_row == i - 1) & (last_row > 0)
        met = last_row > 0
        last_col = np.zeros(n, kind)
        for j in range(1, width + 1):
            v = np.minimum(rows[i, j + 1], rows[i + 1, j])
            v += 1
            np.minimum(v, rows[i, j] + change[j - 1], out=v)
            # Swapped signs with others between them on both sides never cost less than changes.
            swap = above[j - 1] & (last_col > 0)
            if j > 1:
                swap |= met[j - 1] & same[j - 2]
            if swap.any():
                at = np.flatnonzero(swap)
                i1, j1 = last_row[j - 1, at], last_col[at]
                v[at] = np.minimum(v[at], rows[i1, j1, at] + (i - i1 - 1) + 1 + (j - j1 - 1))
            rows[i + 1, j + 1] = v
            np.copyto(last_col, kind(j), where=same[j - 1])
        np.copyto(last_row, kind(i), where=same)
    return rows[len(pivot) + 1, sizes + 1, np.arange(n)]


def within(left: list[str], right: list[str], limit: int) -> np.ndarray:
    """Whether each word of ``left`` is at most ``limit`` true Damerau-Levenshtein edits from
    the word of ``right`` at its place. Only the band of cells that can be so near is filled."""
    n = len(left)
    if not n:
        return np.zeros(0, bool)
    (a, la), (b, lb) = coded(left), coded(right)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = limit + 1
    rows = np.full((a.shape[0] + 2, b.shape[0] + 2, n), far, np.int8)
    for i in range(min(limit, a.shape[0]) + 1):
        rows[i + 1, 1] = i
    for j in range(min(limit, b.shape[0]) + 1):
        rows[1, j + 1] = j
    for i in range(1, a.shape[0] + 1):
        lo, hi = max(1, i - limit), min(b.shape[0], i + limit)
        for j in range(lo, hi + 1):
            v = np.minimum(rows[i, j + 1], rows[i + 1, j])
            v += 1
            np.minimum(v, rows[i, j] + (a[i - 1] != b[j - 1]), out=v)
            # A swap with k signs between on one side costs 1 + k.
            for k in range(limit):
                if i > 1 + k and j > 1:
                    np.minimum(v, np.where((a[i - 1] == b[j - 2]) & (a[i - 2 - k] == b[j - 1]), rows[i - 1 - k, j - 1] + (1 + k), far), out=v)
                if k and i > 1 and j > 1 + k:
                    np.minimum(v, np.where((a[i - 1] == b[j - 2 - k]) & (a[i - 2] == b[j - 1]), rows[i - 1, j - 1 - k] + (1 + k), far), out=v)
            rows[i + 1, j + 1] = np.minimum(v, far)
    return rows[la + 1, lb + 1, np.arange(n)] <= limit


def distances(words: list[str], pivots: list[str]) -> np.ndarray:
    """Distances of all words to all pivots, from 255 on as 255, which leaves differences of
    distances no larger than they are. Words of like length are measured together."""
    out = np.empty((len(words), len(pivots)), np.uint8)
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and len(words[order[hi]]) <= len(words[order[lo]]) + 4 and (hi - lo) * len(words[order[hi]]) < 1 << 18:
            hi += 1
        at = order[lo:hi]
        codes, sizes = coded([words[n] for n in at])
        for k, p in enumerate(pivots):
            out[at, k] = np.minimum(distances_to(codes, sizes, p).astype(np.int16), 255)
        lo = hi
    return out


def far_apart(words: list[str], k: int) -> list[str]:
    """``k`` of ``words``, each as far as can be from those before it."""
    if not words:
        return []
    codes, sizes = coded(words)
    at, least, out = int(np.argmin(sizes)), None, []
    while len(out) < min(k, len(words)):
        out.append(words[at])
        d = distances_to(codes, sizes, words[at])
        least = d if least is None else np.minimum(least, d)
        at = int(np.argmax(least))
        if least[at] == 0:
            break
    return out


def tasks(spark) -> int:
    """Tasks for work that is heavy for its few bytes, so not to be put together by size."""
    return max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bags(words: list[str]) -> np.ndarray:
    """How often each sign stands in each word, in its first five signs and in its last five,
    signs counted in 32 classes. An edit changes each of the three by two counts at most."""
    codes, sizes = coded(words)
    out = np.zeros((len(words), 3, 32), np.int8)
    at = np.arange(len(words))
    for j in range(codes.shape[1]):
        has = sizes > j
        for part, here in enumerate((has, has & (j < 5), has & (sizes - j <= 5))):
            n = at[here]
            out[n, part, codes[here, j] & 31] += 1
    return out


def remains(words: list[str], length: int, edits: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all that is left of words at ``length`` signs after up to ``edits`` deletions, and
    the words' places; only hashes of one of several parts."""
    base, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for gone in range(edits + 1):
        n = length + gone
        at = np.flatnonzero(sizes == n)
        if not len(at):
            continue
        signs = (coded([words[k] for k in at])[0].T.astype(np.uint64) + np.uint64(1)) * mix
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
        # sums[s][k]: the first k signs, moved s places to the left.
        sums = [np.concatenate((np.zeros((1, len(at)), np.uint64), np.cumsum(signs * power[np.maximum(np.arange(n) - s, 0)][:, None], axis=0, dtype=np.uint64))) for s in range(gone + 1)]
        for out in combinations(range(n), gone):
            ends = (*out, n)
            h = sums[0][ends[0]].copy()
            for s, o in enumerate(out, 1):
                h += sums[s][ends[s]] - sums[s][o + 1]
            h ^= h >> np.uint64(29)
            mine = np.flatnonzero(h % np.uint64(parts) == part) if parts > 1 else slice(None)
            hashes.append(h[mine])
            places.append(at[mine])
    return np.concatenate(hashes), np.concatenate(places)


def sharing(left: list[str], right: list[str], edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of ``left`` and ``right`` that may have in common what is left of them after
    ``edits`` deletions, as all words that many edits apart have; pairs may come again."""
    if not left or not right:
        return
    count = [np.bincount([len(w) for w in side]) for side in (left, right)]
    keys, held = [], 0
    for length in range(min(len(c) for c in count)):
        sizes = [sum(int(c[length + d]) * math.comb(length + d, d) for d in range(edits + 1) if length + d < len(c)) for c in count]
        if not all(sizes):
            continue
        parts = -(-sum(sizes) // HASHES)
        for part in range(parts):
            (hl, il), (hr, ir) = (remains(side, length, edits, part, parts) for side in (left, right))
            order = np.argsort(hr)
            hr, ir = hr[order], ir[order]
            lo = np.searchsorted(hr, hl)
            n = np.searchsorted(hr, hl, side="right") - lo
            met = np.flatnonzero(n)
            il, lo, n = il[met], lo[met], n[met]
            ends = np.cumsum(n)
            start = 0
            while start < len(n):
                before = ends[start] - n[start]
                end = max(start + 1, int(np.searchsorted(ends, before + SHARED)))
                own = n[start:end]
                at = np.repeat(lo[start:end] - (ends[start:end] - own - before), own) + np.arange(own.sum())
                keys.append(np.unique(np.repeat(il[start:end], own) * len(right) + ir[at]))
                held += len(keys[-1])
                start = end
                if held > 4 * SHARED:
                    yield np.divmod(np.unique(np.concatenate(keys)), len(right))
                    keys, held = [], 0
    if keys:
        yield np.divmod(np.unique(np.concatenate(keys)), len(right))


def placed_in_cells(words: DataFrame, radius: int, cells: int | None = None) -> DataFrame:
    """``m``, ``w``, ``c`` (cell), ``home`` and ``v`` (distances to the first pivots) of distinct
    words ``w`` under marks ``m``: each in its home cell and in every later one of its mark that
    can hold a word within ``radius``."""
    spark = words.sparkSession
    fullest = words.groupBy("m").count().agg(F.max("count")).first()[0]
    k = cells or max(4, math.ceil((fullest or 0) / CELL))
    sample = [r.w for r in words.where(F.length("w") <= WIDE).select("w").distinct().orderBy(F.xxhash64("w")).limit(max(CHOICES, CHOICE * k)).collect()]
    pivots = far_apart(sample, k)
    if not pivots:  # no word, or long ones only, all of one cell
        pivots = ["a"]
    k = len(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(batch.column(1).to_pylist(), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.argmin(axis=1), pa.int32()), pa.array([x.tobytes() for x in d], pa.binary())], ["m", "w", "c", "d"])

    measured = cut(words.select("m", "w").repartition(tasks(spark), "w").mapInArrow(measure, "m string, w string, c int, d binary"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full((k, k), 255, np.uint8), np.zeros((k, k), np.uint8)
        for batch in batches:
            if batch.num_rows:
                c = batch.column(0).to_numpy(zero_copy_only=False)
                d = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, k)
                np.minimum.at(lo, c, d)
                np.maximum.at(hi, c, d)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in lo], pa.binary()), pa.array([x.tobytes() for x in hi], pa.binary())], ["c", "lo", "hi"])

    # Two rows of k bytes for each of the k cells and each task.
    lo, hi = np.full((k, k), 255, np.int16), np.zeros((k, k), np.int16)
    for r in measured.select("c", "d").mapInArrow(spans, "c int, lo binary, hi binary").toLocalIterator():
        lo[r.c] = np.minimum(lo[r.c], np.frombuffer(r.lo, np.uint8))
        hi[r.c] = np.maximum(hi[r.c], np.frombuffer(r.hi, np.uint8))
    bounds = spark.sparkContext.broadcast((lo, hi))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = bounds.value
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column(2).to_numpy(zero_copy_only=False)
            raw = batch.column(3).to_pylist()
            d = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, k).astype(np.int16)
            near = (d <= d.min(axis=1, keepdims=True) + 2 * radius) & (np.arange(k)[None, :] > home[:, None])
            row, cell = np.nonzero(near)
            for q in range(0, k, 16):  # a few pivots at a time strike out most
                ok = ((d[row, q:q + 16] >= lo[cell, q:q + 16] - radius) & (d[row, q:q + 16] <= hi[cell, q:q + 16] + radius)).all(axis=1)
                row, cell = row[ok], cell[ok]
            row, cell = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(cell, pa.int32()), pa.array(home[row] == cell, pa.bool_()), pa.array([raw[n][:HELD] for n in row], pa.binary())], ["m", "w", "c", "home", "v"])

    return measured.mapInArrow(place, "m string, w string, c int, home boolean, v binary")


def radius_join(words: DataFrame, word: str, mark: str, edits: int = EDITS, cells: int | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct words under one mark at most ``edits`` apart
    (Damerau-Levenshtein). Null and empty words and null marks pair with nothing; repeated rows
    count once, and a pair under several marks too."""
    rows = cut(words.select(F.col(mark).alias("m"), F.col(word).alias("w")).where("length(w) > 0 and m is not null").distinct())
    placed = cut(placed_in_cells(rows, edits, cells))
    sizes = placed.groupBy("m", "c").agg(F.sum(F.col("home").cast("long")).alias("n_home"), F.count("*").alias("n_all")).where("n_home > 0")
    blocks = sizes.select("m", "c", F.ceil(F.col("n_home") / HOME_BLOCK).alias("nh"), F.ceil(F.col("n_all") / CELL_BLOCK).alias("na"))
    sized = placed.join(blocks, ["m", "c"])
    at_home = sized.where("home").withColumn("x", F.pmod(F.xxhash64("w"), F.col("nh"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)))
    inside = sized.withColumn("y", F.pmod(F.xxhash64("w"), F.col("na"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nh") - 1)))
    cols = ["m", "c", "x", "y", "w", "v", "home"]

    def near(x: list[str], y: list[str], edits: int) -> np.ndarray:
        """``within``, long words one by one."""
        short = np.array([len(p) <= WIDE and len(q) <= WIDE for p, q in zip(x, y)], bool)
        out = np.zeros(len(x), bool)
        at = np.flatnonzero(short)
        out[at] = within([x[k] for k in at], [y[k] for k in at], edits)
        for k in np.flatnonzero(~short):
            out[k] = damerau(x[k], y[k], edits) <= edits
        return out

    groups = at_home.select(*cols, F.lit(True).alias("left")).unionByName(inside.select(*cols, F.lit(False).alias("left"))).repartition(tasks(words.sparkSession), "m", "c", "x", "y").sortWithinPartitions("m", "c", "x", "y")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = None, [], []

        def flush():
            a, b = [], []
            if left and right:
                lw, rw = [r[0] for r in left], [r[0] for r in right]
                lv, rv = (np.frombuffer(b"".join(r[1] for r in side), np.uint8).reshape(len(side), -1).astype(np.int16) for side in (left, right))
                lb, rb = bags(lw), bags(rw)
                # Two words at home here meet twice, a word from another cell once.
                home, rank = np.array([r[2] for r in right]), {w: k for k, w in enumerate(sorted({*lw, *rw}))}
                lr, rr = np.array([rank[w] for w in lw]), np.array([rank[w] for w in rw])
                (ls, ll), (rs, rl) = (([k for k, w in enumerate(side) if len(w) <= WIDE], [k for k, w in enumerate(side) if len(w) > WIDE]) for side in (lw, rw))
                places = [np.array(x, np.int64) for x in (ls, rs, ll, rl)]
                short = ((places[0][i], places[1][j]) for i, j in sharing([lw[k] for k in ls], [rw[k] for k in rs], edits))
                # Long words, which are few, are compared one by one.
                long = chain(((np.full(len(rw), n), np.arange(len(rw))) for n in ll), ((np.arange(len(lw))[places[0]], np.full(len(ls), n)) for n in rl))
                for i, j in chain(short, long):
                    once = (lr[i] < rr[j]) | (~home[j] & (lr[i] != rr[j]))
                    i, j = i[once], j[once]
                    for lo in range(0, len(i), 1 << 15):
                        u, v = i[lo:lo + (1 << 15)], j[lo:lo + (1 << 15)]
                        like = (np.abs(lv[u] - rv[v]) <= edits).all(axis=1)
                        u, v = u[like], v[like]
                        like = (np.abs(lb[u] - rb[v]).sum(axis=2) <= 2 * edits).all(axis=1)
                        u, v = u[like], v[like]
                        x, y = [lw[k] for k in u], [rw[k] for k in v]
                        for k in np.flatnonzero(near(x, y, edits)):
                            a.append(min(x[k], y[k]))
                            b.append(max(x[k], y[k]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

        for batch in batches:
            for m, c, x, y, w, v, home, is_left in zip(*(col.to_pylist() for col in batch.columns)):
                if (m, c, x, y) != key:
                    if left:
                        yield flush()
                    key, left, right = (m, c, x, y), [], []
                (left if is_left else right).append((w, v, home))
        if left:
            yield flush()

    return groups.mapInArrow(join, "a string, b string").distinct()


def private_sides(rows: DataFrame, key: str, name: str, french: str, authorities: list[str]) -> DataFrame:
    """``id`` and ``side``: the sides of every name that are no public authority. Null and
    blank names, and null keys, give none."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(name).cast("string").alias("n"), F.col(french).cast("boolean").alias("f")).where("id is not null and n is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Authorities(authorities)
        for batch in batches:
            ids, out = [], []
            for i, n, f in zip(*(c.to_pylist() for c in batch.columns)):
                for s in names.private_sides(n, known, bool(f)):
                    ids.append(i)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "side"])

    return rows.mapInArrow(run, "id long, side string")


def learn(sides: DataFrame) -> Vocabulary:
    """The vocabulary of given names and trades of all ``side``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[tuple[str, str], bool] = {}
            for s in batch.column(0).to_pylist():
                two = names.two_words(s)
                if two:
                    for pair in ((two[0], two[1]), (two[1], two[0])):
                        got[pair] = got.get(pair, False) or two[2]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.bool_())], ["word", "beside", "form"])

    pairs = cut(sides.select("side").mapInArrow(run, "word string, beside string, form boolean").groupBy("word", "beside").agg(F.max("form").alias("form")))
    least = max(names.LEAST, math.ceil(pairs.count() * names.SHARE))
    counts = cut(pairs.groupBy("word").agg(F.count("*").alias("n"), F.avg(F.col("form").cast("double")).alias("firm")))
    often = counts.where(F.col("n") >= least)  # at most 1/SHARE words, by the share
    beside = pairs.join(F.broadcast(often.select("word")), "word").join(counts.select(F.col("word").alias("beside"), F.col("n").alias("m")), "beside")
    marks = cut(
        beside.groupBy("word").agg(F.avg("m").alias("mean")).join(often, "word").where(F.col("n") >= names.AHEAD * F.col("mean"))
        .select("word", "n", "mean", (F.col("firm") >= names.FIRM).alias("trade")))
    small = F.broadcast(marks.select("word", "trade"))
    own = pairs.join(small, "word").join(F.broadcast(marks.select(F.col("word").alias("beside"))), "beside", "left_anti").select("beside", "word", "trade")
    other = own.select("beside", "trade", F.col("word").alias("word2"))
    together = own.join(other, ["beside", "trade"]).where("word < word2").groupBy("word", "word2").agg(F.count("*").alias("n")).where("n >= 2")
    of = {r.word: (r.n, r["mean"], r.trade) for r in marks.collect()}
    # Only words that share much with another: a bounded number for each mark.
    a, b = marks.select("word", F.col("n").alias("n1")), marks.select(F.col("word").alias("word2"), F.col("n").alias("n2"))
    close = together.join(F.broadcast(a), "word").join(F.broadcast(b), "word2").where(F.col("n") >= names.TOGETHER * F.least("n1", "n2"))
    shared: dict[tuple[str, str], int] = {}
    for r in close.select("word", "word2", "n").collect():
        shared[r.word, r.word2] = shared[r.word2, r.word] = r.n
    return names.vocabulary(of, shared)


def mentions(sides: DataFrame, known: Vocabulary) -> DataFrame:
    """The party of every side: ``id``, ``kind``, ``stem``, ``marks`` (given names or an
    initial; the trade), ``middle``."""
    shared = sides.sparkSession.sparkContext.broadcast(known)  # at most 1/SHARE words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, s in zip(*(c.to_pylist() for c in batch.columns)):
                p = names.party(s, shared.value)
                if p and len(p.stem) > 1:
                    for col, x in zip(out, (i, p.kind, p.stem, p.mark.split("|") if p.mark else [], p.middle)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()))], ["id", "kind", "stem", "marks", "middle"])

    return sides.select("id", "side").mapInArrow(run, "id long, kind string, stem string, marks array<string>, middle string")


def apart_by(near: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``d``: 1 for words one edit apart, 2 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = within(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.where(one, 1, 2), pa.int32())], ["a", "b", "d"])

    return near.mapInArrow(run, "a string, b string, d int")


def link(found: DataFrame, cells: int | None = None) -> DataFrame:
    """``id`` and ``party`` for the mentions: spellings whose stems are near and whose given
    names (or trades) can be the same are one party. An initial joins a full given name only
    where just one party has the stems nearest to its own, farther ones notwithstanding: the more
    names there are, the more lie two edits from any. If several are as near, the spellings that
    fit the same ones stay among themselves."""
    group = F.xxhash64("kind", "stem", "mark")
    spelled = cut(found.select("id", "kind", "stem", "marks").distinct())
    groups = cut(spelled.select("kind", "stem", F.explode_outer("marks").alias("mark")).distinct().withColumn("g", group))
    apart = F.concat("kind", F.lit(":"), F.when(F.col("kind") == "person", F.substring("mark", 1, 1)).otherwise(F.col("mark")))
    near = radius_join(groups.withColumn("apart", F.coalesce(apart, F.concat("kind", F.lit("?")))), "stem", "apart", cells=cells)
    near = cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    side = lambda at, g: groups.select("kind", F.col("stem").alias(at), F.coalesce("mark", F.lit("")).alias("mark"), F.col("g").alias(g))
    # Equal marks of near stems; a spelling that can be several names joins them.
    strong = side("a", "ga").join(near.where("a < b"), "a").join(side("b", "gb"), ["b", "kind", "mark"]).select("ga", "gb")
    several = spelled.where("size(marks) > 1").select(F.transform("marks", lambda m: F.xxhash64("kind", "stem", m)).alias("gs")).distinct().select(F.element_at("gs", 1).alias("ga"), F.explode("gs").alias("gb"))
    comp = components(strong.unionByName(several), "ga", "gb")
    parties_ = cut(groups.join(comp, groups.g == comp.node, "left").select("g", "kind", "stem", "mark", F.coalesce("component", "g").alias("party")))
    person = parties_.where("kind = 'person' and mark is not null").withColumn("first", F.substring("mark", 1, 1))
    short = person.where("length(mark) = 1").select("g", F.col("stem").alias("a"), "first", "party")
    full = person.where("length(mark) > 1").groupBy(F.col("stem").alias("b"), "first").agg(F.min("party").alias("lo"), F.max("party").alias("hi"))
    alike = apart_by(near.select("a", "b")).unionByName(short.select("a", F.col("a").alias("b"), F.lit(0).alias("d")).distinct())
    at = short.join(alike, "a").join(full, ["b", "first"]).groupBy("g", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nearest = at.groupBy("g").agg(F.min(F.struct("d", "lo", "hi")).alias("m"))
    fits = cut(short.join(nearest, "g", "left").select("g", "party", F.when(F.col("m.lo") == F.col("m.hi"), F.col("m.lo")).when(F.col("m").isNotNull(), F.xxhash64("m.lo", "m.hi")).alias("target")))
    # Spellings that fit no party go where all others of their own go.
    own = fits.groupBy("party").agg(F.min("target").alias("lo"), F.max("target").alias("hi")).where("lo = hi").select("party", F.col("lo").alias("other"))
    told = fits.join(own, "party", "left").select("g", F.coalesce("target", "other").alias("target")).where("target is not null")
    final = parties_.select("g", "party").join(told, "g", "left").select("g", F.coalesce("target", "party").alias("party"))
    mine = spelled.select("id", "kind", "stem", F.when(F.size("marks") > 0, F.element_at("marks", 1)).alias("mark")).select("id", group.alias("g"))
    return mine.join(final, "g").select("id", "party").distinct()


def pairs(linked: DataFrame, salts: int = 16) -> DataFrame:
    """All pairs ``id_a`` < ``id_b`` that share a party: the result asked for holds each. One
    side is dealt over ``salts``, so a party with many ids is joined by several tasks."""
    mine = linked.select(F.col("id").alias("id_a"), "party").withColumn("salt", F.pmod(F.xxhash64("id_a"), F.lit(salts)))
    other = linked.select(F.col("id").alias("id_b"), "party").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return mine.join(other, ["party", "salt"]).where("id_a < id_b").select("id_a", "id_b").distinct()
