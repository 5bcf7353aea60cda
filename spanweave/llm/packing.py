"""Filling containers of fixed capacity with items of varying length.

1. Each item longer than the capacity is cut into full pieces and a rest; nothing else
   is divided.
2. A histogram of the rests (at most ``capacity`` entries, whatever the data's size)
   comes to the driver, where dynamic programming chooses the bucket boundaries with the
   least padding (each item is padded to its bucket's upper bound).
3. Batches under the token budget form inside each bucket, longest bucket first; the room
   that a batch leaves is offered, at the level of buckets, to batches of shorter buckets
   before these open containers of their own. The plan has a few rows a bucket.
4. Items take their places by rank inside their bucket. Ranks come from counts by bucket
   and hash salt, so that no bucket, however large, is sorted in one task.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a capacity.
BUCKETS = 192


def boundaries(hist: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of length that together hold every
    length of ``hist`` with the least total padding.

    dp[k][j] = min over i of dp[k-1][i] + len_j * (N_j - N_i) - (S_j - S_i), a minimum of
    lines in len_j whose slopes fall with i, kept as a lower hull."""
    sizes = sorted(x for x in hist if x > 0)
    d = len(sizes)
    if d <= buckets:
        return sizes
    count = np.array([hist[x] for x in sizes], dtype=object)
    total_n = [0, *np.cumsum(count)]
    total_s = [0, *np.cumsum(count * np.array(sizes, dtype=object))]
    before = [0] + [None] * d
    choice: list[list[int]] = []
    for _ in range(buckets):
        now: list[int | None] = [None] * (d + 1)
        came = [-1] * (d + 1)
        hull: list[tuple[int, int, int]] = []
        head = 0
        for j in range(1, d + 1):
            if before[j - 1] is not None:
                m, c = -total_n[j - 1], before[j - 1] + total_s[j - 1]
                while len(hull) - head >= 2:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, c, j - 1))
            x = sizes[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, c, i = hull[head]
                now[j] = m * x + c + x * total_n[j] - total_s[j]
                came[j] = i
        now[0] = None
        before = now
        choice.append(came)
    bounds, j = [], d
    for came in reversed(choice):
        if j == 0:
            break
        bounds.append(sizes[j - 1])
        j = came[j]
    return sorted(bounds)


@dataclass(frozen=True)
class Place:
    """Items of one bucket with ranks from ``rank`` on stand, ``each`` to a container, in
    the ``containers`` containers from ``first`` on, from token ``room`` on."""

    bound: int
    rank: int
    items: int
    each: int
    first: int
    room: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Place], int]:
    """The places of ``counts`` items by bucket bound, and the number of containers."""
    places: list[Place] = []
    used = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first, containers)
    order: list[int] = []  # the free sizes, ascending

    def free(tokens: int, first: int, n: int) -> None:
        if tokens > 0 and n > 0:
            if tokens not in rooms:
                bisect.insort(order, tokens)
            rooms.setdefault(tokens, []).append((first, n))

    for bound in sorted(counts, reverse=True):
        left, rank = counts[bound], 0
        while left:
            at = bisect.bisect_left(order, bound)
            if at == len(order):
                break
            tokens = order[at]
            first, n = rooms[tokens].pop()
            if not rooms[tokens]:
                del rooms[tokens]
                order.pop(at)
            each = tokens // bound
            take = min(n, left // each)
            if take:
                places.append(Place(bound, rank, take * each, each, first, capacity - tokens))
                free(tokens - each * bound, first, take)
                rank, left = rank + take * each, left - take * each
            else:
                each, take = left, 1
                places.append(Place(bound, rank, each, each, first, capacity - tokens))
                free(tokens - each * bound, first, 1)
                rank, left = rank + each, 0
            free(tokens, first + take, n - take)
        each = capacity // bound
        for per, n in ((each, left // each), (left % each, 1 if left % each else 0)):
            if n:
                places.append(Place(bound, rank, per * n, per, used, 0))
                free(capacity - per * bound, used, n)
                rank, used = rank + per * n, used + n
    return places, used


def pack(items: DataFrame, capacities: dict[str, int], key: str, size: str, buckets: int = BUCKETS, salts: int | None = None) -> DataFrame:
    """One row per item piece and kind of container: ``container_kind``, ``container_id``,
    ``piece`` (0 for undivided items), ``start_token`` and ``piece_tokens`` (the part of the
    item), ``room_start`` (where in the container it stands).

    Items of null or no size take no room and stand in container 0. Repeated keys are items
    of their own. Kinds whose capacity is null or not positive are left out."""
    spark = items.sparkSession
    salts = salts or max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    kinds = sorted((k, int(c)) for k, c in capacities.items() if c and c > 0)
    if not kinds:
        return spark.createDataFrame([], f"container_kind string, container_id long, {key} {rows.schema['k'].dataType.simpleString()}, piece long, start_token long, piece_tokens long, room_start long")

    # At most 1 + capacity rows a kind, however many items there are.
    sized = rows.groupBy("n").count()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds])).alias("c")
    hist = sized.select("n", "count", each).select("c.kind", "c.cap", F.floor(F.col("n") / F.col("c.cap")).alias("full"), F.pmod("n", "c.cap").alias("rest"), "count")
    hists: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    fulls = {k: 0 for k, _ in kinds}
    for r in hist.groupBy("kind", "rest").agg(F.sum("count").alias("m"), F.sum(F.col("full") * F.col("count")).alias("f")).collect():
        if r.rest:
            hists[r.kind][r.rest] = r.m
        fulls[r.kind] += r.f

    bound_of, place_rows, used_of = {}, [], {}
    for kind, cap in kinds:
        bounds = boundaries(hists[kind], buckets)
        by_bound: dict[int, int] = {}
        for n, m in hists[kind].items():
            b = bounds[bisect.bisect_left(bounds, n)]
            by_bound[b] = by_bound.get(b, 0) + m
        places, used = plan(by_bound, cap)
        bound_of[kind], used_of[kind] = bounds, used
        place_rows += [(kind, p.bound, p.rank, p.rank + p.items, p.each, p.first, p.room) for p in places]

    # Bucket of each rest: a lookup with at most one row for each length up to the capacity.
    lookup = spark.createDataFrame(
        [(kind, n, bound_of[kind][bisect.bisect_left(bound_of[kind], n)]) for kind, _ in kinds for n in hists[kind]] or [("", 0, 0)],
        "kind string, rest long, bound long")
    salt = F.pmod(F.xxhash64("k"), F.lit(salts))
    split = rows.withColumn("salt", salt).select("k", "n", "salt", each).select(
        "k", "n", "salt", "c.kind", "c.cap", F.floor(F.col("n") / F.col("c.cap")).alias("full"), F.pmod("n", "c.cap").alias("rest"))

    # Rank in the bucket: offset of the salt, from counts, plus rank within the salt.
    whole = split.where("rest > 0").join(F.broadcast(lookup), ["kind", "rest"])
    offsets = (
        whole.groupBy("kind", "bound", "salt").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("kind", "bound").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("kind", "bound", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        whole.withColumn("r", F.row_number().over(Window.partitionBy("kind", "bound", "salt").orderBy("k", "n")) - 1)
        .join(offsets, ["kind", "bound", "salt"])
        .withColumn("rank", F.col("r") + F.col("before"))
    )
    # The plan has a few rows a bucket: bounded by the buckets, not by the data.
    places = spark.createDataFrame(place_rows or [("", 0, 0, 0, 1, 0, 0)], "kind string, bound long, lo long, hi long, each long, first long, room long")
    by_bucket = places.groupBy("kind", "bound").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "each", "first", "room"))).alias("places"))
    rests = (
        ranked.join(F.broadcast(by_bucket), ["kind", "bound"])
        .withColumn("p", F.element_at(F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1))
        .select(
            F.col("kind").alias("container_kind"),
            (F.col("p.first") + F.floor((F.col("rank") - F.col("p.lo")) / F.col("p.each"))).alias("container_id"),
            "k", F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("start_token"), F.col("rest").alias("piece_tokens"),
            (F.col("p.room") + F.pmod(F.col("rank") - F.col("p.lo"), F.col("p.each")) * F.col("bound")).alias("room_start"))
    )

    # Full pieces take containers of their own, numbered after the others.
    long_items = split.where("full > 0")
    base = F.lit(0).cast("long")
    for kind, n in used_of.items():
        base = F.when(F.col("kind") == kind, F.lit(n).cast("long")).otherwise(base)
    full_offsets = (
        long_items.groupBy("kind", "salt").agg(F.sum("full").alias("f"))
        .withColumn("before", F.sum("f").over(Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("kind", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    fulls_out = (
        long_items.withColumn("c", F.coalesce(F.sum("full").over(Window.partitionBy("kind", "salt").orderBy("k", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(full_offsets, ["kind", "salt"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
        .select(
            F.col("kind").alias("container_kind"), (base + F.col("before") + F.col("c") + F.col("piece")).alias("container_id"),
            "k", "piece", (F.col("piece") * F.col("cap")).alias("start_token"), F.col("cap").alias("piece_tokens"), F.lit(0).cast("long").alias("room_start"))
    )
    nothing = split.where("n = 0").select(
        F.col("kind").alias("container_kind"), F.lit(0).cast("long").alias("container_id"), "k", F.lit(0).cast("long").alias("piece"),
        F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("piece_tokens"), F.lit(0).cast("long").alias("room_start"))
    return rests.unionByName(fulls_out).unionByName(nothing).withColumnRenamed("k", key)


def fill(placed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """By kind: number of containers and pieces, tokens placed, and the share of room filled."""
    cap = F.lit(None).cast("long")
    for kind, c in capacities.items():
        cap = F.when(F.col("container_kind") == kind, F.lit(c).cast("long")).otherwise(cap)
    return (
        placed.groupBy("container_kind")
        .agg((F.max(F.when(F.col("piece_tokens") > 0, F.col("container_id"))) + 1).alias("containers"), F.count("*").alias("pieces"), F.sum("piece_tokens").alias("tokens"))
        .withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * cap), 6))
    )
