"""Core operators on small tables: nulls, empties, repeats, clashing columns, brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import text as T
from spanweave.operators import citations, graph, hierarchy, lines, nodes, quotes, search, structure
from spanweave.streaming import ingest

NODES = "document_id long, id string, parent_id string, level int, seq int, loaded_at long, scope string, node string, depth int"


def forest(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "x", "y", 1) for r in rows], NODES)


def resolved(df, **kw):
    return {(r.scope, r.node): r for r in hierarchy.resolve(df, "document_id", "id", "parent_id", "level", ("seq", "loaded_at"), **kw).collect()}


ROWS = [
    (1, "a", None, 1), (1, "b", "a", 2), (1, "c", "b", 2), (1, "b", "a", 2), (1, "d", "gone", 1), (1, "e", "d", 9),
    (2, "x", "y", 1), (2, "y", "x", 1), (2, "z", "y", 1), (2, "s", "s", 1), (2, "a", "z", None), (None, "q", None, 1), (3, None, None, 1), (4, "", None, 1), (4, "k", "", 2),
]


@pytest.mark.parametrize("colocate", [100, 2, 1])
def test_hierarchy(spark, colocate):
    r = resolved(forest(spark, ROWS), colocate=colocate)
    assert set(r) == {(1, x) for x in "abcde"} | {(2, x) for x in "xyzsa"} | {(4, ""), (4, "k")}
    assert (r[1, "c"].depth, r[1, "c"].root, r[1, "c"].path, r[1, "a"].descendants) == (3, "a", "a/b/c", 2)
    assert r[1, "d"].status == "missing_parent" and r[1, "e"].status == "below_missing"
    assert {k: r[2, k].status for k in "xyzsa"} == {"x": "cycle", "y": "cycle", "z": "below_cycle", "s": "cycle", "a": "below_cycle"}
    assert r[2, "a"].depth is None and r[4, "k"].root == ""


def test_hierarchy_findings(spark):
    res = hierarchy.resolve(forest(spark, ROWS), "document_id", "id", "parent_id", "level", ("seq", "loaded_at"))
    got = {tuple(x) for x in hierarchy.findings(res).collect()}
    assert got == {(1, "c", "wrong_level"), (1, "d", "missing_parent"), (2, "x", "cycle"), (2, "y", "cycle"), (2, "s", "cycle"), (2, "z", "below_cycle"), (2, "a", "below_cycle")}
    below = {tuple(x) for x in hierarchy.descendants(res).collect()}
    assert (1, "a", "c", 2) in below and (1, "b", "c", 1) in below


@pytest.mark.parametrize("colocate", [100, 1])
def test_descendants_are_as_many_as_counted(spark, colocate):
    rows = [*ROWS, (5, "a/b", None, 1), (5, "c/d", "a/b", 2), (5, "e", "c/d", 3)]
    res = hierarchy.resolve(forest(spark, rows), "document_id", "id", "parent_id", colocate=colocate)
    below = [tuple(x) for x in hierarchy.descendants(res).collect()]
    assert {x for x in below if x[0] in (2, 5)} == {(2, "y", "z", 1), (2, "y", "a", 2), (2, "z", "a", 1), (5, "a/b", "c/d", 1), (5, "a/b", "e", 2), (5, "c/d", "e", 1)}
    assert {(r.scope, r.node): r.descendants for r in res.collect()} == {(r.scope, r.node): sum(x[:2] == (r.scope, r.node) for x in below) for r in res.collect()}


def test_hierarchy_of_nothing(spark):
    assert hierarchy.resolve(forest(spark, []), "document_id", "id", "parent_id", "level").count() == 0


def test_deep_chain_both_ways(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, i + 1) for i in range(300)]
    a, b = resolved(forest(spark, rows)), resolved(forest(spark, rows), colocate=50)
    assert a.keys() == b.keys() and all(tuple(a[k]) == tuple(b[k]) for k in a) and a[1, "n299"].depth == 300


def test_components_across_batches(spark):
    """Rows in random order over many small batches: one label for each tree, shared missing
    parents and repeated rows included."""
    rng = random.Random(4)
    rows = [(t % 3, f"{t}.{i}", f"{t}.{rng.randrange(i)}" if i else None, None) for t in range(12) for i in range(40)] + [(7, f"m{i}", "gone", None) for i in range(9)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = forest(spark, [*rows, *rows[:30]]).select("document_id", "id", "parent_id").repartition(5)
        got = [tuple(r) for r in hierarchy.with_components(df, "document_id", "id", "parent_id").collect()]
        full = resolved(forest(spark, [*rows, *rows[:30]]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    label = {}
    for d, i, _, c in got:
        label.setdefault((d, i.split(".")[0] if d != 7 else "m"), set()).add(c)
    assert len(got) == len(rows) + 30 and len(label) == 13 and all(len(v) == 1 for v in label.values()) and len({min(v) for v in label.values()}) == 13
    assert len(full) == len(rows) and all(full[t % 3, f"{t}.0"].descendants == 39 for t in range(12))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges if None not in e for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    assert got == {x: top(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_lines_and_offsets(spark):
    df = spark.createDataFrame([(1, "a\r\nb😀\rc\n\nd"), (2, ""), (3, None)], "k int, t string")
    got = [tuple(r) for r in lines.lines(df, "k", "t").orderBy("k", "line_no").collect()]
    assert got == [(1, 1, 0, 1, "a"), (1, 2, 3, 5, "b😀"), (1, 3, 6, 7, "c"), (1, 4, 8, 8, ""), (1, 5, 9, 10, "d"), (2, 1, 0, 0, "")]
    assert df.select(T.utf16_length(F.col("t")).alias("n")).first().n == 11


@pytest.mark.parametrize("line,kind", [("", "blank"), ("[12] The", "numbered"), ("1.2 The", "decimal"), ("a) the", "item"), ("[Emphasis added]", "editorial"), ("1999-01-02", "date"), ("THE FACTS", "capitals"), ("The Facts", "heading"), ("The end. Yes.", "prose")])
def test_line_class(spark, line, kind):
    assert spark.createDataFrame([(line,)], "l string").select(lines.line_class(F.col("l")).alias("c")).first().c == kind


def test_roman(spark):
    rows = [("iv", 4), ("xiv", 14), ("mcmxcix", 1999), ("iix", None), ("", None), ("a", None), (None, None)]
    got = [r.v for r in spark.createDataFrame([(x,) for x, _ in rows], "s string").select(T.roman_value(F.col("s")).alias("v")).collect()]
    assert got == [v for _, v in rows]


def test_citation_places(spark):
    text = "See 1999 VLCA 12 and 2001 TOFC 3, not 12345 ABCD 1. 1999 VLCA 12"
    df = spark.createDataFrame([(1, text, "1999 VLCA 12"), (2, None, None), (3, "", None)], "k int, t string, own string")
    got = [tuple(r) for r in citations.occurrences(df, "k", "t").orderBy("occurrence").collect()]
    assert got == [(1, 1, text.index("1999"), "1999:VLCA:12"), (1, 2, text.index("2001"), "2001:TOFC:3"), (1, 3, text.rindex("1999"), "1999:VLCA:12")]
    assert [r.cited_key for r in citations.edges(df, "k", "t", "own").collect()] == ["2001:TOFC:3"]


@pytest.mark.parametrize("query,tree", [
    ("a b", "(and a b)"), ("a OR b c", "(or a (and b c))"), ('"a b" -c', '(and "a b" (not c))'), ("a AND NOT b", "(and a (not b))"), ("mun*", "mun*"), ("(a OU b) ET c", "(and (or a b) c)"), ('x -"y z"', '(and x (not "y z"))')])
def test_query_grammar(query, tree):
    assert str(search.parse(query)) == tree


@pytest.mark.parametrize("query", ["", "AND", "(a", "a)", '"a', "NOT", " ".join(["w"] * 40)])
def test_query_errors(query):
    with pytest.raises(search.QueryError):
        search.parse(query)


def test_search_ranks(spark):
    df = spark.createDataFrame([(1, "tax tax law"), (2, "tax and more words here"), (3, "none"), (4, None), (5, "tax tax law")], "k int, t string")
    assert [r.k for r in search.search(df, "k", "t", "tax").orderBy("rank").collect()] == [1, 5, 2]


def test_containment_matches_brute_force(spark):
    rng = random.Random(1)
    ns = [(d, f"n{i}", s, s + rng.randrange(1, 9000)) for d in (1, 2) for i, s in enumerate(rng.randrange(0, 20000) for _ in range(40))]
    ps = sorted({(d, rng.randrange(0, 30000)) for d in (1, 2) for _ in range(60)})
    got = {(r.document_id, r["at"]): r.node_id for r in nodes.containing(spark.createDataFrame(ps, "document_id int, at int"), spark.createDataFrame(ns, "document_id int, id string, start_at int, end_at int")).collect()}
    want = {}
    for d, p in ps:
        c = sorted((e - s, -s, i) for x, i, s, e in ns if x == d and s <= p < e)
        if c:
            want[d, p] = c[0][2]
    assert got == want


def test_extents_are_idempotent(spark):
    rows = [(1, "k", 0, 5), (1, "k", 3, 9), (1, "k", 20, 22), (1, "k", 9, 12), (1, "k", 4, 4)]
    once = nodes.extents(spark.createDataFrame(rows, "document_id int, kind string, start_at int, end_at int"))
    got = sorted((r.start_at, r.end_at) for r in once.collect())
    assert got == [(0, 12), (20, 22)]
    assert sorted((r.start_at, r.end_at) for r in nodes.extents(once).collect()) == got


def test_paragraph_counts(spark):
    text = "Intro\n[1] One.\n[2] Two, see\n[2019] 3 R. 4\n[3] Three.\n(1) other"
    got = [(r.label, r.style) for r in structure.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "k int, t string"), "k", "t").orderBy("start_at").collect()]
    assert got == [(1, "bracket"), (2, "bracket"), (3, "bracket")]


def test_marked_quotes_of_every_kind_and_length(spark):
    long = "word " * 200 + "end"
    text = f'He said "no" and “{long}” or ‘a b’ then « deux mots ».\n  > block with "marks" inside\n>\nlast "one\ntwo" lines'
    got = [tuple(r) for r in quotes.marked(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("k", "n").collect()]
    assert got == [(1, n, q) for n, q in enumerate(["no", long, "a b", "deux mots", 'block with "marks" inside'], 1)]


def test_quotes_are_located(spark):
    src = [(1, "the landlord kept the deposit of the tenant for a year and a day"), (2, "nothing of the kind was ever said by anyone at all"), (3, None)]
    qs = [(1, "kept the deposit of the tenant for a year"), (2, "short one"), (3, None), (4, "kept the deposit of the lodger for a year and a day")]
    got = {r.q: (r.s, r.exact) for r in quotes.locate(spark.createDataFrame(qs, "q int, t string"), "q", "t", spark.createDataFrame(src, "s int, t string"), "s", "t").collect()}
    assert got[1] == (1, True) and got[4] == (1, False) and set(got) == {1, 4}
    assert quotes.opcodes("a b c", "a x c") == [("replace", "b", "x")]


def test_quotes_with_spread_changes_are_located(spark, monkeypatch):
    rng = random.Random(6)
    src = [(n, " ".join(rng.choice(["the", "of", f"w{rng.randrange(60)}"]) for _ in range(40))) for n in range(30)]
    qs = [(900, "kept it")]
    for n in range(60):
        ws = rng.choice(src)[1].split()[rng.randrange(10):][:rng.randrange(2, 25)]
        qs.append((n, " ".join(w if k % rng.choice((3, 4, 5, 9)) else "changed" for k, w in enumerate(ws))))
    monkeypatch.setattr(quotes, "QUOTE_BLOCK", 20)
    monkeypatch.setattr(quotes, "SOURCE_BLOCK", 10)
    got = {r.q: (-r.score, r.s) for r in quotes.locate(spark.createDataFrame(qs, "q int, t string"), "q", "t", spark.createDataFrame(src, "s int, t string"), "s", "t").collect()}
    best = {q: min((-quotes.similarity(t, u), s) for s, u in src) for q, t in qs}
    assert got == {q: b for q, b in best.items() if -b[0] >= quotes.LEAST} and len(got) > 30


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_similarity_is_a_share(a, b):
    s = quotes.similarity(" ".join(a), " ".join(b))
    assert 0 <= s <= 1 and (not a or quotes.similarity(" ".join(a), " ".join(a)) == 1)


def test_stream_equals_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "document_id long, text string").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest.ingest(spark, src, schema, out, chk).awaitTermination()
    spark.createDataFrame([(2, "b2")], "document_id long, text string").coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, schema, out, chk).awaitTermination()
    assert {r.document_id: r.text for r in ingest.current(spark, out).collect()} == {1: "a", 2: "b2"}
    ingest.upsert_documents(spark, spark.createDataFrame([(2, "b2")], "document_id long, text string"), out, 1)  # a replay
    assert spark.read.parquet(out).count() == 3


def test_staged_write_replaces_whole_tables(spark, tmp_path):
    from spanweave.sources.sinks import write_staged

    target = str(tmp_path / "t")
    write_staged(spark.range(5), target)
    write_staged(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3 and not (tmp_path / "t.new").exists() and not (tmp_path / "t.old").exists()
