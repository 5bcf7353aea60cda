"""Parent-child rows to full hierarchies: root, depth, path, descendants, cycles.

Rows form, within each scope (a document), a graph in which every node has at most one
parent. Its connected components are found first, for every input: each batch of rows is
contracted by itself, so that only nodes which several batches name are left to be joined,
and the labels they tie together are made one by ``graph.components``. Components are then
co-located one by one and walked by an iterative depth-first traversal with node colours:
white nodes are untouched, grey ones are on the current walk, black ones are done; meeting a
grey node closes a cycle. A component of more rows than one task may hold is resolved by
pointer jumping (rounds grow with the logarithm of the depth), so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import components

#: Rows of a component that one task may hold.
COLOCATE = 250_000
#: Rows of components walked together.
TOGETHER = 10_000
SEPARATOR = "/"

_OUT = "scope {scope}, node string, parent string, level int, status string, depth int, root string, path string, descendants long"


def _walk(scopes: list, ids: list[str], parents: list[str | None], paths: bool):
    """Status, depth, root, path and number of descendants of each node of whole components."""
    n = len(ids)
    at = {x: i for i, x in enumerate(zip(scopes, ids))}
    up = [-1] * n
    status: list[str | None] = [None] * n
    for i, p in enumerate(parents):
        if p is None:
            status[i] = "root"
        else:
            up[i] = at.get((scopes[i], p), -1)
            if up[i] < 0:
                status[i] = "missing_parent"
    colour = bytearray(n)  # 0 white, 1 grey, 2 black
    for start in range(n):
        if colour[start]:
            continue
        walk, i = [], start
        while i >= 0 and colour[i] == 0:
            colour[i] = 1
            walk.append(i)
            i = up[i]
        if i >= 0 and colour[i] == 1:  # the back edge of a cycle
            for k in walk[walk.index(i):]:
                status[k] = "cycle"
        for k in walk:
            colour[k] = 2
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if up[i] >= 0 and status[i] != "cycle":
            children[up[i]].append(i)
    depth: list[int | None] = [None] * n
    root: list[str | None] = [None] * n
    path: list[str | None] = [None] * n
    size = [0] * n
    for top in range(n):
        if status[top] not in ("root", "missing_parent", "cycle"):
            continue
        on_cycle = status[top] == "cycle"
        if not on_cycle:
            depth[top], root[top] = 1, ids[top]
            path[top] = ids[top] if paths else None
        below = {"root": "child", "missing_parent": "below_missing", "cycle": "below_cycle"}[status[top]]
        order, stack = [], list(children[top])
        while stack:
            i = stack.pop()
            order.append(i)
            status[i] = below
            if not on_cycle:
                u = up[i]
                depth[i], root[i] = depth[u] + 1, root[u]
                if paths:
                    path[i] = path[u] + SEPARATOR + ids[i]
            stack.extend(children[i])
        for i in reversed(order):
            size[up[i]] += size[i] + 1
    return status, depth, root, path, size


def _labels(h: np.ndarray, up: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The component label of every row of a batch, as far as its own rows tell: the least
    hash of the nodes that its links tie together. Parents without a row tie siblings."""
    ids, where = np.unique(np.concatenate((h, up[has])), return_inverse=True)
    a, b = where[:len(h)][has], where[len(h):]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            return ids[label[where[:len(h)]]]


def with_components(rows: DataFrame, scope: str = "scope", node: str = "node", parent: str = "parent") -> DataFrame:
    """``rows`` with ``comp``, equal for all rows of one connected component of a scope. (Equal
    hashes may put two components under one label; none is ever parted.)"""
    schema = rows.schema
    hashed = rows.withColumn("h", F.xxhash64(scope, node)).withColumn("up", F.when(F.col(parent).isNotNull(), F.xxhash64(scope, parent)))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            has = ~batch.column("up").is_null().to_numpy(zero_copy_only=False)
            up = batch.column("up").fill_null(0).to_numpy(zero_copy_only=False)
            label = _labels(h, up, has)
            away = has & ~np.isin(up, h)  # only these parents must be asked for elsewhere
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(away)], [*batch.schema.names, "label", "away"])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    local = cut(hashed.mapInArrow(contract, f"{typed}, h long, up long, label long, away boolean"))
    named = local.select("h", "label").unionByName(local.where("away").select(F.col("up").alias("h"), "label"))
    shared = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "lo")
    ties = cut(named.join(shared, "h").where("label <> lo").select("lo", "label").distinct())
    if ties.isEmpty():
        return local.select(*schema.names, F.col("label").alias("comp"))
    comp = components(ties, "lo", "label")
    return local.join(comp, local.label == comp.node, "left").select(*[local[c] for c in schema.names], F.coalesce("component", "label").alias("comp")) if "node" not in schema.names else (
        local.join(comp.withColumnRenamed("node", "label"), "label", "left").select(*schema.names, F.coalesce("component", "label").alias("comp")))


def _co_located(rows: DataFrame, scope_type: str, paths: bool) -> DataFrame:
    """Walks of the components, each held by one task, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush():
            first: dict[tuple, tuple] = {}
            for r in held:  # sorted: the first of rows with one key counts
                first.setdefault((r[0], r[1]), r)
            got = list(first.values())
            scopes, ids, parents = [r[0] for r in got], [r[1] for r in got], [r[2] for r in got]
            status, depth, root, path, size = _walk(scopes, ids, parents, paths)
            return pa.RecordBatch.from_arrays(
                [pa.array(scopes, scope_arrow), pa.array(ids, pa.string()), pa.array(parents, pa.string()), pa.array([r[3] for r in got], pa.int32()),
                 pa.array(status, pa.string()), pa.array(depth, pa.int32()), pa.array(root, pa.string()), pa.array(path, pa.string()), pa.array(size, pa.int64())],
                ["scope", "node", "parent", "level", "status", "depth", "root", "path", "descendants"])

        for batch in batches:
            scope_arrow = batch.column(0).type
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                k = (r[0], r[4])
                if k != key and len(held) >= TOGETHER:
                    yield flush()
                    held = []
                key = k
                held.append(r)
        if held:
            yield flush()

    placed = rows.repartition("scope", "comp").sortWithinPartitions("scope", "comp", "node", "o1", "o2", "parent")
    return placed.select("scope", "node", "parent", "level", "comp").mapInArrow(run, _OUT.format(scope=scope_type))


def resolve(nodes: DataFrame, scope: str, node: str, parent: str, level: str | None = None, order: tuple[str, ...] = (), paths: bool = True, colocate: int = COLOCATE) -> DataFrame:
    """One row per node: ``scope``, ``node``, ``parent``, ``level``, ``status`` (root, child,
    missing_parent, below_missing, cycle, below_cycle), ``depth`` (one-based, null on and
    below cycles), ``root``, ``path`` (ids from the root, null on and below cycles) and the
    number of ``descendants`` (on cycles: those off the cycle).

    Rows with a null scope or node have no key and give no row. Of rows with one key the
    first by ``order``, then by parent, counts. A null parent makes a root; any other parent
    that is no node of the scope is missing; the empty string is a value like any other. A
    node that is its own parent is a cycle. Other columns are ignored."""
    o1 = F.col(order[0]) if order else F.lit(None).cast("long")
    o2 = F.col(order[1]) if len(order) > 1 else F.lit(None).cast("long")
    rows = nodes.select(
        F.col(scope).alias("scope"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"),
        (F.col(level).cast("int") if level else F.lit(None).cast("int")).alias("level"), o1.alias("o1"), o2.alias("o2"),
    ).where("scope is not null and node is not null")
    kind = rows.schema["scope"].dataType.simpleString()
    whole = with_components(rows)
    big = cut(whole.groupBy("scope", "comp").count().where(F.col("count") > colocate).select("scope", "comp"))
    if big.isEmpty():
        return _co_located(whole, kind, paths)
    small = _co_located(whole.join(big, ["scope", "comp"], "left_anti"), kind, paths)
    return small.unionByName(_large(whole.join(big, ["scope", "comp"], "left_semi").drop("comp"), paths))


def _large(rows: DataFrame, paths: bool) -> DataFrame:
    """Results for components too large for a task."""
    first = rows.groupBy("scope", "node").agg(F.min_by(F.struct("parent", "level"), F.struct("o1", "o2", F.coalesce("parent", F.lit("")))).alias("r"))
    one = cut(first.select("scope", "node", "r.parent", "r.level"))
    there = one.select("scope", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = one.join(there, ["scope", "parent"], "left").select(
        "scope", "node", "parent", "level", F.when(F.col("parent").isNull(), "root").when(F.col("there").isNull(), "missing_parent").alias("top"))
    # far: the ancestor 'dist' steps up; open: no top met yet.
    state = cut(linked.select(
        "scope", "node", "parent", "level", "top", F.when(F.col("top").isNull(), F.col("parent")).otherwise(F.col("node")).alias("far"),
        F.when(F.col("top").isNull(), 1).otherwise(0).cast("long").alias("dist"), F.col("top").isNull().alias("open")))
    total = one.groupBy("scope").count().agg(F.max("count")).first()[0]
    reach = 1
    while True:
        step = state.select("scope", F.col("node").alias("far"), F.col("far").alias("far2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"))
        moving, done = state.where("open"), state.where("not open")
        moved = moving.join(step, ["scope", "far"]).select(
            "scope", "node", "parent", "level", "top", F.col("far2").alias("far"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("open2").alias("open"))
        state = cut(moved.unionByName(done))
        reach *= 2
        if reach > total or state.where("open").isEmpty():
            break
    # Whoever is still open leads into a cycle, and after that many steps stands on it.
    cyclic = state.where("open").select("scope", F.col("far").alias("node"), F.lit(True).alias("on")).distinct()
    tops = state.where("top is not null").select("scope", F.col("node").alias("far"), F.col("top").alias("far_top"))
    whole = (
        state.join(cyclic, ["scope", "node"], "left").join(tops, ["scope", "far"], "left")
        .select(
            "scope", "node", "parent", "level", "far", "dist",
            F.when(F.col("on"), "cycle").when(F.col("open"), "below_cycle").when(F.col("top").isNotNull(), F.col("top"))
            .when(F.col("far_top") == "root", "child").otherwise("below_missing").alias("status")))
    return _paths(cut(whole), paths)


def _ways(nodes: DataFrame) -> DataFrame:
    """``way``: ids from the top of each node to the node itself, by doubling. A node on a cycle
    is a top."""
    line = cut(nodes.select(
        "scope", "node", "status",
        F.when(F.col("status").isin("child", "below_missing", "below_cycle"), F.col("parent")).alias("next"), F.array("node").alias("way")))
    while not line.where("next is not null").isEmpty():
        other = line.select("scope", F.col("node").alias("next"), F.col("next").alias("next2"), F.col("way").alias("way2"))
        moved = line.where("next is not null").join(other, ["scope", "next"]).select("scope", "node", "status", F.col("next2").alias("next"), F.concat("way2", "way").alias("way"))
        line = cut(moved.unionByName(line.where("next is null")))
    return line


def _paths(nodes: DataFrame, paths: bool) -> DataFrame:
    """Paths by doubling and descendants by counting ancestors, for large components. Nodes on
    and below cycles have neither path nor depth; theirs are the descendants off the cycle."""
    line = _ways(nodes)
    above = line.select("scope", F.explode(F.slice("way", F.lit(1), F.size("way") - 1)).alias("node")).groupBy("scope", "node").agg(F.count("*").alias("descendants"))
    free = F.col("status").isin("root", "missing_parent", "child", "below_missing")
    return (
        nodes.join(line.select("scope", "node", "way"), ["scope", "node"]).join(above, ["scope", "node"], "left")
        .select(
            "scope", "node", "parent", "level", "status", F.when(free, F.size("way")).cast("int").alias("depth"), F.when(free, F.col("far")).alias("root"),
            F.when(free & F.lit(paths), F.array_join("way", SEPARATOR)).alias("path"), F.coalesce("descendants", F.lit(0)).alias("descendants")))


def findings(resolved: DataFrame) -> DataFrame:
    """One row per node and finding: cycle, below_cycle, missing_parent, or wrong_level (the
    way up ends at a root and the non-null level is not the depth)."""
    wrong = F.col("status").isin("root", "child") & F.col("level").isNotNull() & (F.col("level") != F.col("depth"))
    found = F.when(F.col("status").isin("cycle", "below_cycle", "missing_parent"), F.col("status")).when(wrong, "wrong_level")
    return resolved.select("scope", "node", found.alias("finding")).where("finding is not null")


def descendants(resolved: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it, with their distance; as many for each node as
    its number of descendants. Below a missing parent the topmost node there is is the first.
    Nodes on a cycle are below no node, and a node below a cycle is below that node of the
    cycle which its way up meets first."""
    return _ways(resolved).where("size(way) > 1").select("scope", F.col("node").alias("descendant"), F.size("way").alias("n"), F.posexplode(F.slice("way", F.lit(1), F.size("way") - 1)).alias("at", "node")).select(
        "scope", "node", "descendant", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
