"""The text operators on small tables: nulls, repeats, clashing columns, empty tables."""

import random

import pytest

from spanweave.llm import encoding, markup, matching, mojibake, packing, repeats, scans, sentences, variants


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "the end", "x"), (2, None, "x"), (3, "", "x"), (1, "the end", "x"), (None, "né 中", "x")], "doc_id long, text string, ids string")
    got = encoding.encode(df, "doc_id", "text")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got.collect())[1:4] == [(1, 2), (1, 2), (2, 0)]
    assert {r.text for r in encoding.decode(got, "doc_id", "ids").collect()} == {"the end", "", "né 中"}
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0


def test_packing_is_whole(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 3, 3, 7, 12, 25, 40, None])) for i in range(400)]
    df = spark.createDataFrame([(*x, "c") for x in items], "k long, n long, cap string")
    out = [r.asDict() for r in packing.pack(df, {"small": 12, "large": 20, "none": None}, "k", "n", buckets=3).collect()]
    for kind, cap in (("small", 12), ("large", 20)):
        mine = [r for r in out if r["container_kind"] == kind]
        got, load = {}, {}
        for r in mine:
            got.setdefault(r["k"], []).append((r["start_token"], r["piece_tokens"]))
            load.setdefault(r["container_id"], []).append((r["room_start"], r["piece_tokens"]))
        assert {k: sum(n for _, n in v) for k, v in got.items()} == {k: n or 0 for k, n in items}
        assert all(len(got[k]) == 1 for k, n in items if (n or 0) <= cap)
        for spans in load.values():
            spans = sorted(s for s in spans if s[1])
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and (not spans or sum(spans[-1]) <= cap)
    assert packing.pack(df.limit(0), {"small": 12}, "k", "n").count() == 0


@pytest.mark.parametrize("chunk, block", [(40, 64), (150, 64), (40, 2), (40, 3)])
def test_chunked_sentences_equal_direct(spark, chunk, block):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["The end. ", "“No. Yes,” he said ", "(see p. 4) ", "\n\n", "so\n", "a) x;\n", "他走了。"]) for _ in range(60 if i else 400)), 1, 2) for i in range(25)]
    df = spark.createDataFrame([*texts, (90, None, 1, 2), (91, "", 1, 2), texts[0]], "doc_id long, text string, k int, a int")
    want = sorted(tuple(r) for r in sentences.split(df, "doc_id", "text", chunk=1 << 20).collect())
    assert sorted(tuple(r) for r in sentences.split(df, "doc_id", "text", chunk=chunk, block=block).collect()) == want and want
    assert len(want) == sum(len(sentences.units(t)) for _, t, _, _ in [*texts, texts[0]])


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha ", "beta ", "gamma ", "delta ", "epsilon "]) + str(rng.randrange(90)) + " "
    long_ = ["".join(word() for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(60):
        s = rng.choice(long_)
        at = rng.randrange(len(s) - 130)
        rows.append((i, "".join(word() for _ in range(rng.randrange(12))) + s[at:at + rng.choice([100, 119, 120, 130])] + "".join(word() for _ in range(5)), "p"))
    rows += [(70, None, "p"), (71, "", "p"), (72, "-" * 500, "p"), (73, "x" + "-" * 121, "p"), (74, "y" + "-" * 119, "p"), rows[0]]
    windows = {}
    for i, t, _ in rows:
        for k in range(len(t or "") - 119):
            windows.setdefault(t[k:k + 120], set()).add(i)
    want = {(a, b) for s in windows.values() for a in s for b in s if a < b}
    df = spark.createDataFrame(rows, "id long, text string, p string")
    for crowd in (64, 1):
        found = repeats.matches(df, "id", "text", crowd=crowd)
        assert {(r.id_a, r.id_b) for r in found.collect()} == want
    covered = {r.id: r.shared_chars for r in repeats.coverage(found).collect()}
    for i, t, _ in rows[:60]:
        n = len({c for k in range(len(t) - 119) if len(windows[t[k:k + 120]] - {i}) for c in range(k, k + 120)})
        assert covered.get(i, 0) == n
    assert repeats.matches(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("cells", [1, 4, 20])
def test_radius_join_equals_brute_force(spark, cells):
    from spanweave.llm.names import damerau

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(30)]
    words = ["x" * 300, "x" * 299 + "y"]
    for w in base:
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(8)
                v[k] = rng.choice([rng.choice("abcdefgh"), "", v[k] + rng.choice("abc")])
            words.append("".join(v))
    rows = [(w, n % 2) for n, w in enumerate(words)] + [(words[0], 0), (words[0], 1), (None, 0), ("", 0), (words[1], None)]
    df = spark.createDataFrame([(w, None if m is None else str(m), 1) for w, m in rows], "w string, m string, c int")
    got = [tuple(r) for r in variants.radius_join(df, "w", "m", cells=cells).collect()]
    held = sorted({(w, m) for w, m in rows if w and m is not None})
    want = {(a, b) for a, m in held for b, k in held if a < b and m == k and damerau(a, b, 2) <= 2}
    assert len(got) == len(set(got)) and set(got) == want and want
    if cells > 1:
        placed = variants.placed_in_cells(df.select("m", "w").where("length(w) > 0 and m is not null").distinct(), 2, cells)
        assert placed.where("home").count() == len(held) and placed.where("home").select("c").distinct().count() == cells
    assert variants.radius_join(df.limit(0), "w", "m").count() == 0


def test_distances_are_true(spark):
    from spanweave.llm.names import damerau

    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    pivots = ["", "ca", "abcabc", "bbbbbbbbb", "acbacb"]
    assert [list(map(int, r)) for r in variants.distances(words, pivots)] == [[damerau(w, p, 99) for p in pivots] for w in words]
    x, y = zip(*[(a, b) for a in words for b in words[:40]])
    for limit in (1, 2, 3):
        assert list(variants.within(list(x), list(y), limit)) == [damerau(a, b, limit) <= limit for a, b in zip(x, y)]


def test_variants_are_linked(spark):
    names_ = [(1, "R. v. Nathaniel Lilaribek"), (2, "Lilaribek, Nathaniel (Re)"), (3, "R. v. N. Lilarbek"), (4, "R. v. Susannah Lilaribek"), (5, "Re Oscar Vengulrow"), (6, None), (7, "R. v. Attorney General"), (1, "R. v. Nathaniel Lilaribek")]
    df = spark.createDataFrame([(*x, False) for x in names_], "id long, name string, french boolean")
    sides = variants.private_sides(df, "id", "name", "french", ["R.", "Attorney General"])
    m = variants.mentions(sides, variants.learn(sides))
    assert {tuple(r) for r in variants.pairs(variants.link(m)).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert variants.link(m.limit(0)).count() == 0 and variants.learn(sides.limit(0)).given == {}


def test_initials_join_the_nearest_stems(spark):
    """Another party two edits away does not keep an initial from its own; parties as near do."""
    rows = [
        (1, "numorlorkune", ["james"]), (2, "numorlorkune", ["j"]), (3, "numorlirkume", ["jonathan"]), (4, "numorlrkune", ["j"]), (5, "numorlirkume", ["j"]),
        (6, "hulenvordith", ["elise"]), (7, "hulenvordith", ["edward"]), (8, "hulenvordith", ["e"]), (9, "hulenvordit", ["e"]), (10, "vekgam", ["a"]), (11, "vekgan", ["a"]),
        (12, "samzolrin", ["f"]), (13, "samzolrinna", ["f"]), (14, "samzolrinnate", ["fred"])]
    found = spark.createDataFrame([(i, "person", stem, marks, "") for i, stem, marks in rows], "id long, kind string, stem string, marks array<string>, middle string")
    groups = {}
    for r in variants.link(found).collect():
        groups.setdefault(r.party, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 4], [3, 5], [6], [7], [8, 9], [10, 11], [12, 13, 14]]


def test_marks_are_learned_from_any_vocabulary(spark):
    """Names of a vocabulary of its own: given names, short forms, trades and typos that no list
    here holds. Links against the truth."""
    rng = random.Random(9)
    given = {"kazuhiko": "kazu", "yevgenia": "zhenya", "olumide": "olu", "siobhan": "shiv", "radoslav": "radko", "wilhelmina": "mina", "takahiro": "taka", "bronislava": "bronya"}
    trades = {"plastics": "plas.", "robotics": "robo.", "catering": "cat.", "ceramics": "cer.", "logistics": "logi."}
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))

    def typo(w):
        k = rng.randrange(1, len(w) - 1)
        return w[:k] + rng.choice(["", w[k] + rng.choice("aeiou"), rng.choice("bdgk")]) + w[k + 1:]

    rows, truth = [], {}
    for party in range(260):
        stem = word(5)
        firm = party % 2
        full = rng.choice(sorted(trades if firm else given))
        for _ in range(5):
            s = typo(stem) if rng.random() < 0.2 else stem
            m = (trades if firm else given)[full] if rng.random() < 0.25 else typo(full) if rng.random() < 0.1 else full
            if firm:
                side = rng.choice([f"{s} {m} Ltd", f"{s} {m} Limited", f"The {s} {m}", f"{m} {s} Inc."])
            else:
                side = rng.choice([f"{m} {s}", f"{s}, {m}", f"{s.upper()} {m}", f"Estate of {m} {s}"])
            rows.append((len(rows), rng.choice([f"R. v. {side.title()}", f"{side.title()} v. The King", f"Re {side}"]), False))
            truth.setdefault(party, []).append(len(rows) - 1)
    df = spark.createDataFrame(rows, "id long, name string, french boolean")
    sides = variants.private_sides(df, "id", "name", "french", ["R.", "The King"])
    known = variants.learn(sides)
    assert known.given["zhenya"] == ("yevgenia",) and known.trades["robo"] == ("robotics",)
    got = {tuple(r) for r in variants.pairs(variants.link(variants.mentions(sides, known))).collect()}
    want = {(a, b) for ids in truth.values() for a in ids for b in ids if a < b}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def test_words_of_a_cell_are_not_compared_in_pairs(monkeypatch):
    """Candidates hold all near pairs, and grow with the words, not with their pairs."""
    from spanweave.llm.names import damerau

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if damerau(a, b, 2) <= 2}
    for hashes, shared in ((1 << 21, 1 << 20), (500, 50)):
        monkeypatch.setattr(variants, "HASHES", hashes)
        monkeypatch.setattr(variants, "SHARED", shared)
        got = {(int(i), int(j)) for x, y in variants.sharing(words, words, 2) for i, j in zip(x, y)}
        assert want <= got
    monkeypatch.undo()
    made = lambda n: list(dict.fromkeys("".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(6)) for _ in range(n)))
    compared = [sum(len(i) for i, _ in variants.sharing(w, w, 2)) for w in (made(1_000), made(8_000))]
    assert compared[0] < 2_000 and compared[1] < 12 * compared[0]
    assert not list(variants.sharing([], words, 2)) and not list(variants.sharing(["a" * 9], ["a"], 2))


def test_matching(spark):
    cases = spark.createDataFrame([
        (1, "The King v. Oscar Vengulrow", "1999-03-04", ["12 Vel. R. 3"]), (2, "Oscar Vengulrow v. The King", None, ["[2005] 3 Vel. R. 3"]), (3, None, "1999-03-04", None), (4, "Re Ursula Bakenmarune", "March 4, 2001", []), (1, "The King v. Oscar Vengulrow", "1999-03-04", ["12 Vel. R. 3"])],
        "case_id long, case_name string, date_filed string, citations array<string>")
    docs = spark.createDataFrame([
        (51, "cases", "VLCA", "1999 VLCA 4", "R. v. Óscar Vengulrow", None, "1999-03-04", None), (52, "cases", "vlca ", "2005 VLCA 9", "R. v. O. Vengulrw", None, "2005-06-01", None), (53, "cases", "MHCA", "1999 MHCA 4", "R. v. Oscar Vengulrow", None, "1999-03-04", None),
        (54, "laws", None, None, "Re Ursula Bakenmarune", None, "2001-03-04", None), (55, "cases", "VLCA", None, None, "Dans l’affaire Ursula Bakenmarune", None, "2001-03-04"), (56, "cases", "VLCA", None, None, None, None, None)],
        "document_id long, doc_type string, dataset string, citation_en string, name_en string, name_fr string, document_date_en string, document_date_fr string")
    about = ([(1, ["The King", "R."])], [("VLCA", "CAVL", "Court of Appeal", ["Vel. R."]), ("MHCA", "CAMH", "Marrow Court", ["Marr. H.R."])])
    got = {(r.case_id, r.document_id): r.confidence for r in matching.match(spark, cases, docs, about).collect()}
    assert set(got) == {(1, 51), (2, 52), (4, 55)} and all(0 <= c <= 1 for c in got.values())
    assert matching.match(spark, cases.limit(0), docs.limit(0), about).count() == 0


def test_matching_does_not_hang_on_buckets(spark, monkeypatch):
    """Cut into far too many buckets, and against a comparison of all pairs."""
    import json

    monkeypatch.setattr(matching, "FILL", 0.01)
    rng = random.Random(8)
    stems = ["".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(80)]

    def changed(w):
        for _ in range(2):
            k = rng.randrange(1, len(w))
            w = w[:k] + rng.choice(["", rng.choice("aeioubdk"), w[k:k + 1] + rng.choice("nrst")]) + w[k + 1:]
        return w.title()

    cases = spark.createDataFrame([(n, f"R. v. Oscar {w.title()}", rng.choice([None, "2000-12-29", "2001"]), None) for n, w in enumerate(stems)], "case_id long, case_name string, date_filed string, citations array<string>")
    docs = spark.createDataFrame([(100 + n, "cases", "VLCA", None, f"R. v. O. {changed(w)}", None, rng.choice([None, "2001-01-02", "2000"]), None) for n, w in enumerate(stems)],
                                 "document_id long, doc_type string, dataset string, citation_en string, name_en string, name_fr string, document_date_en string, document_date_fr string")
    about = ([(1, ["The King", "R."])], [("VLCA", "CAVL", "Court of Appeal", ["Vel. R."])])
    told = {(r.side, r.id): json.loads(r.about) for r in matching.described(spark, cases, docs, (*about, matching.Vocabulary())).collect()}
    for x in told.values():
        x.update(people=[matching.Party(*p) for p in x["people"]], date=tuple(x["date"]) if x["date"] else None, dates=[tuple(d) for d in x["dates"]])
    judged = {(c, d): matching.verdict(x, y) for (s, c), x in told.items() if s == "c" for (t, d), y in told.items() if t == "d"}
    want = {pair for pair, (same, _) in judged.items() if same}
    got = {(r.case_id, r.document_id): r.cosine for r in matching.match(spark, cases, docs, about).collect()}
    assert len(want) > 20 and set(got) == want and all(-1 <= c <= 1.01 for c in got.values())


def test_names_are_joined_without_broadcasts(spark):
    """What stems leave after deletions is many times the stems, so no join of it is by broadcast,
    however small Spark takes it to be."""
    people = lambda stem: '{"people": [["person", "%s", "n", ""]], "dates": [[1990, 1, 2]], "date": [1990, 1, 2], "years": []}' % stem
    rows = spark.createDataFrame([("c", 1, people("lilaribek")), ("d", 51, people("lilarbek")), ("d", 52, people("vengulrow"))], "side string, id long, about string")
    seen, cut = [], matching.cut
    try:
        matching.cut = lambda df: (df.collect(), seen.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[2]
        got = matching.by_name(spark, rows)
    finally:
        matching.cut = cut
    assert [tuple(r) for r in got.collect()] == [(1, 51)]
    plans = [*seen, got._jdf.queryExecution().executedPlan().toString()]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_candidates_cost_little(monkeypatch):
    """Sign counts tell the pairs of a bucket whole, block by block, and no names are compared
    where days or courts differ."""
    import json

    import numpy as np

    rng = random.Random(4)
    stems = [[("".join(rng.choice("abcde") for _ in range(5))) for _ in range(rng.choice([0, 1, 1, 2, 4, 6]))] for _ in range(120)]
    signs = [np.frombuffer(matching.sign_counts(json.dumps({"people": [["firm", s, "", ""] for s in x]})), np.uint64) for x in stems]
    c, d = np.stack(signs[:70]), np.stack(signs[70:])
    near = lambda a, b: (int(a) ^ int(b)).bit_count() <= 4
    want = {
        (i, j) for i, x in enumerate(c) for j, y in enumerate(d)
        if max(len(stems[i]), len(stems[70 + j])) > matching.STEMS or all(any(near(a, b) for b in y if b) for a in x if a)}
    got = [p for i, j in matching.stems_agree(c, d, 7) for p in zip(i.tolist(), j.tolist())]
    assert set(got) == want and len(got) == len(want)
    case = {"people": [1], "public": [], "sides": 1, "courts": {"A"}, "date": (1990, 1, 2), "years": []}
    document = {"people": [1], "public": [], "sides": 1, "court": "A", "dates": [(1990, 1, 2)], "years": []}
    asked = []
    monkeypatch.setattr(matching, "same_party", lambda a, b: asked.append(1) or a == b)
    assert matching.verdict(case, document) == (True, 4) and asked
    asked.clear()
    assert matching.verdict(case, document | {"dates": [(1991, 5, 2)]}) == matching.verdict(case, document | {"court": "B"}) == (False, 0) and not asked


def test_twins_without_a_date_are_kept(spark):
    cases = spark.createDataFrame([(1, "R. v. Oscar Vengulrow", "1999-03-04", None)], "case_id long, case_name string, date_filed string, citations array<string>")
    docs = spark.createDataFrame([(51, "VLCA", "1999 VLCA 4", "1999-03-04"), (52, "VLCA", "1999 VLCA 4", None), (53, "VLCA", "1999 VLCA 7", None), (54, "VLCA", None, None), (55, "MHCA", "1999 MHCA 7", None)], "document_id long, dataset string, citation_en string, document_date_en string")
    docs = docs.selectExpr("*", "'cases' AS doc_type", "'R. v. Oscar Vengulrow' AS name_en", "string(null) AS name_fr", "string(null) AS document_date_fr")
    about = ([(1, ["The King", "R."])], [("VLCA", "CAVL", "Court of Appeal", ["Vel. R."]), ("MHCA", "CAMH", "Marrow Court", ["Marr. H.R."])])
    assert {r.document_id: r.day for r in matching.match(spark, cases, docs, about).collect()} == {51: 4, 52: 3, 54: 0, 55: 3}


def test_calibration_counts_every_candidate(spark):
    """More candidates than were once sampled; what reaches the driver is bounded by the cosines."""
    n = 150_000
    judged = spark.range(n).selectExpr("cast(0.4 + (id % 6000) / 10000 as float) AS cosine", "cast(case when id % 6000 > 3000 and id % 10 < 9 then 4 when id % 50 = 0 then 2 else -1 end as int) AS day", "id % 3 > 0 AS full")
    counts = matching.agreements(judged)
    assert sum(c[3] for c in counts) == n and len(counts) < 5_000
    fit = matching.calibrate(counts)
    assert fit != matching.Fit() and fit.slope > 0 and fit.low < 0.05 < 0.9 < fit.high < 1
    assert matching.calibrate([]) == matching.Fit()


def test_every_record_trains_the_vectors(spark, monkeypatch):
    """Records in several blocks: each has a token of its own, and walks reach them all but for chance."""
    import numpy as np

    n, half = 9_000, 200
    rows = spark.range(n).selectExpr("'c' AS side", "id", "array(cast(id as int), cast(10000 + id % 200 as int), cast(11000 + id % 200 as int)) AS slots", "array(0, 1, 2) AS kinds", "cast(id as string) AS about")
    base = matching.base_vectors()
    whole = matching.train(spark, rows, n)
    assert (np.abs(whole[:n] - base[:n]).max(axis=1) > 1e-4).mean() > 0.95  # chance alone leaves a few unvisited
    assert np.array_equal(whole[12_000:], matching.base_vectors()[12_000:] / np.linalg.norm(base[12_000:], axis=1, keepdims=True))
    monkeypatch.setattr(matching, "BLOCK", 1_000)
    monkeypatch.setattr(matching, "ROUNDS", 6)
    parts = matching.train(spark, rows.repartition(7), n)
    assert np.array_equal(parts, matching.train(spark, rows, n))
    beside = (parts[10_000:10_000 + half] * parts[11_000:11_000 + half]).sum(1).mean()
    other = (parts[10_000:10_000 + half] * parts[11_000 + np.roll(np.arange(half), 7)]).sum(1).mean()
    assert beside > other + 0.02
    assert matching.train(spark, rows.limit(0), 0).shape == base.shape


def test_garbled_values(spark):
    df = spark.createDataFrame([(1, "prÃ©", None), (2, "pré", ""), (1, "prÃ©", None), (3, None, "l�")], "id long, a string, b string")
    assert {(r.record_id, r.field, r.restored, r.complete) for r in mojibake.find(df, "id", ["a", "b"], "t").collect()} == {(1, "a", "pré", True), (3, "b", "l�", False)}


def test_markup_table(spark):
    df = spark.createDataFrame([("a", "<p>x</p>", 1), ("b", None, 1), ("c", "", 1)], "id string, t string, languages int")
    assert {(r.id, tuple(r.languages), r.clean_text) for r in markup.clean(df, ["id"], "t").collect()} == {("a", ("html",), "x"), ("b", (), None), ("c", (), "")}


def test_scanned_pages(spark):
    body = "the landlord answered the claim of the tenant and the witness\n" * 12
    pages = [(n, 7, "A.J.", n, str(40 + n), f"SHORT TITLE OF THE PAPER {40 + n}\n{body}the direct0r spoke of the valu-\nation") for n in range(2, 9)]
    pages += [(1, 7, "A.J.", 1, None, "Short Title of the Paper\nby F. Author\n" + body + "the director and the director of the valuation\n41"), (20, None, None, None, None, None), (21, 8, None, 1, "1", ""), pages[0]]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, article_id long, journal_abbrev string, pdf_page int, page_label string, text string, noise string")
    examined = scans.examine(spark, df, texts=True)
    got = {(r.page_id, r.noise) for r in scans.findings(examined).collect()}
    assert {(1, "page_number")} | {(n, k) for n in range(2, 9) for k in ("running_header", "page_number", "hyphenation")} <= got
    assert (1, "running_header") not in got and not any(p in (20, 21) for p, _ in got)
    text = " ".join(r.text for r in scans.paragraphs(examined).orderBy("paragraph").collect())
    assert "valuation" in text and "SHORT TITLE" not in text
