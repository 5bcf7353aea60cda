"""Boolean ranked search: a query grammar compiled to column expressions, and BM25."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

TOKEN = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|(-(?=")|[^\s()"]+))')
# Words and signs of the operators.
AND, OR, NOT = {"AND", "ET", "&"}, {"OR", "OU", "|"}, {"NOT", "NON", "!"}
LIMIT = 32


class QueryError(ValueError):
    """A query that says nothing or breaks the grammar."""


@dataclass(frozen=True)
class Node:
    kind: str  # term, prefix, phrase, and, or, not
    value: tuple = ()

    def __str__(self) -> str:
        if self.kind in ("term", "prefix", "phrase"):
            text = " ".join(self.value)
            return f'"{text}"' if self.kind == "phrase" else text + ("*" if self.kind == "prefix" else "")
        return f"({self.kind} {' '.join(map(str, self.value))})"


def _parts(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.strip()
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m:
            raise QueryError("open quotation mark")
        at = m.end()
        if m[1] is not None:
            out.append(("phrase", m[1]))
        elif m[2] or m[3]:
            out.append(("bracket", m[2] or m[3]))
        elif m[4] in AND:
            out.append(("and", ""))
        elif m[4] in OR:
            out.append(("or", ""))
        elif m[4] in NOT or m[4] == "-":
            out.append(("not", ""))
        elif m[4].startswith("-") and len(m[4]) > 1:
            out += [("not", ""), ("word", m[4][1:])]
        else:
            out.append(("word", m[4]))
    if not any(k in ("word", "phrase") for k, _ in out):
        raise QueryError("no word to search for")
    if len(out) > LIMIT:
        raise QueryError("too many words")
    return out


def parse(query: str) -> Node:
    """Syntax tree of a query: words side by side are all wanted; OR binds weaker than AND,
    NOT strongest; ``word*`` is a prefix, quotation marks make phrases, ``-word`` excludes."""
    parts = _parts(query)
    at = 0

    def peek() -> tuple[str, str] | None:
        return parts[at] if at < len(parts) else None

    def either() -> Node:
        nonlocal at
        nodes = [both()]
        while peek() and peek()[0] == "or":
            at += 1
            nodes.append(both())
        return nodes[0] if len(nodes) == 1 else Node("or", tuple(nodes))

    def both() -> Node:
        nonlocal at
        nodes = [one()]
        while peek() and peek()[0] != "or" and peek() != ("bracket", ")"):
            if peek()[0] == "and":
                at += 1
            nodes.append(one())
        return nodes[0] if len(nodes) == 1 else Node("and", tuple(nodes))

    def one() -> Node:
        nonlocal at
        p = peek()
        if p is None:
            raise QueryError("a word is missing")
        at += 1
        if p[0] == "not":
            return Node("not", (one(),))
        if p == ("bracket", "("):
            n = either()
            if peek() != ("bracket", ")"):
                raise QueryError("open bracket")
            at += 1
            return n
        if p[0] == "phrase":
            ws = tuple(re.findall(r"[^\W_]+", p[1].lower()))
            if not ws:
                raise QueryError("empty phrase")
            return Node("phrase" if len(ws) > 1 else "term", ws)
        if p[0] == "word":
            ws = tuple(re.findall(r"[^\W_]+", p[1].lower()))
            if not ws:
                raise QueryError("a word is missing")
            if p[1].endswith("*"):
                return Node("prefix", ws[-1:]) if len(ws) == 1 else Node("phrase", ws)
            return Node("term", ws) if len(ws) == 1 else Node("phrase", ws)
        raise QueryError("a word is missing")

    node = either()
    if at < len(parts):
        raise QueryError("bracket that closes nothing")
    return node


def condition(node: Node, ws: Column) -> Column:
    """A tree as a condition on an array of words."""
    if node.kind == "term":
        return F.array_contains(ws, node.value[0])
    if node.kind == "prefix":
        return F.exists(ws, lambda w: w.startswith(node.value[0]))
    if node.kind == "phrase":
        return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")).contains(f" {' '.join(node.value)} ")
    if node.kind == "not":
        return ~condition(node.value[0], ws)
    out = condition(node.value[0], ws)
    for n in node.value[1:]:
        out = out & condition(n, ws) if node.kind == "and" else out | condition(n, ws)
    return out


def wanted(node: Node) -> list[str]:
    """Words that raise the rank: all but the excluded."""
    if node.kind == "not":
        return []
    if node.kind in ("term", "phrase"):
        return list(node.value)
    if node.kind == "prefix":
        return []
    return list(dict.fromkeys(w for n in node.value for w in wanted(n)))


def _is(term: str):
    return lambda w: w == term


def search(df: DataFrame, key: str, text: str, query: str, limit: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that answer a query, by BM25, the first ``limit`` (a top-k report): ``key``,
    ``score``, ``rank``. Ties go to the smaller key. Null texts answer nothing.

    One pass counts the words wanted and the lengths; only counts leave the map side."""
    node = parse(query)
    terms = wanted(node)
    ws = words(F.col(text))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), ws.alias("ws")).select(
        F.col(key), F.size("ws").alias("n"), condition(node, F.col("ws")).alias("hit"),
        *[F.size(F.filter("ws", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    # One row of totals; it becomes constants of the plan.
    total = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    docs, mean = total.docs, float(total.avg_n or 1.0)
    scored = rows.where("hit")
    score = F.lit(0.0)
    for i in range(len(terms)):
        df_i = total[f"df{i}"] or 0
        idf = F.lit(math.log(1 + (docs - df_i + 0.5) / (df_i + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / mean))
    top = scored.select(F.col(key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
