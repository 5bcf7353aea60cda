"""Pieces of the text operators on fixed cases and against brute force."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import bpe, markup, matching, mojibake, names, packing, repeats, scans, sentences


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst 'L\n\t.,1290"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_encoding_is_exact(reference, text):
    e = bpe.encoder()
    ids = e.encode(text)
    assert ids == reference.encode_ordinary(text) and e.decode(ids) == text and e.count(text) == len(ids)


def test_long_and_empty_texts(reference):
    e = bpe.encoder()
    t = "ab" * 20_000 + " " * 3_000 + "ÿ" * 500
    assert e.encode(t) == reference.encode_ordinary(t)
    assert e.encode(None) == [] == e.encode("")


def brute_padding(hist, k):
    sizes = sorted(hist)
    best = {0: 0}
    for _ in range(k):
        new = dict(best)
        for i, c in best.items():
            for j in range(i + 1, len(sizes) + 1):
                pad = c + sum(hist[s] * (sizes[j - 1] - s) for s in sizes[i:j])
                new[j] = min(new.get(j, 1 << 60), pad)
        best = new
    return best[len(sizes)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 5))
def test_boundaries_have_least_padding(hist, k):
    b = packing.boundaries(hist, k)
    assert len(b) <= k and max(b) == max(hist)
    assert sum(n * (min(x for x in b if x >= s) - s) for s, n in hist.items()) == brute_padding(hist, k)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_every_item_once(counts):
    places, used = packing.plan(counts, 50)
    load = {}
    for p in places:
        for r in range(p.items):
            c = p.first + r // p.each
            at = p.room + r % p.each * p.bound
            load.setdefault(c, []).append((at, at + p.bound))
    assert sum(p.items for p in places) == sum(counts.values()) and set(load) == set(range(used))
    for spans in load.values():
        spans.sort()
        assert spans[-1][1] <= 50 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("text,units", [
    (None, []), ("", []), (" \n\t ", []), ("\ufeffHello there.", ["Hello there."]),
    ("Dr. Wendeck spoke. He left at 5 p.m. Nobody saw it.", ["Dr. Wendeck spoke.", "He left at 5 p.m.", "Nobody saw it."]),
    ("“No. It was not,” he said. The rest.", ["“No. It was not,” he said.", "The rest."]),
    ("He answered: “No. It was not.” The rest.", ["He answered: “No. It was not.”", "The rest."]),
    ("The Facts\n\nOne line\ngoes on. Two.", ["The Facts", "One line\ngoes on.", "Two."]),
    ("1. First point.\n\n2. Second (see p. 4. It is there.). Third.", ["1. First point.", "2. Second (see p. 4. It is there.).", "Third."]),
    ("a) one;\nb) two.", ["a) one;", "b) two."]),
    ("他走了。“停下！”他说，“好。”完了。", ["他走了。", "“停下！”他说，“好。”", "完了。"]),
    ("債権者は「いいえ。有効です。」と述べた。次。", ["債権者は「いいえ。有効です。」と述べた。", "次。"]),
    ("Ήταν άκυρη; Ο κ. Umbrin είπε ναι.", ["Ήταν άκυρη;", "Ο κ. Umbrin είπε ναι."]),
    ("ในปี 1957 ผู้ซื้อคัดค้าน เจ้าหนี้ยกเลิก", ["ในปี 1957 ผู้ซื้อคัดค้าน", "เจ้าหนี้ยกเลิก"]),
    ("Am 1. Juli kam er. Der 4. Senat ging.", ["Am 1. Juli kam er.", "Der 4. Senat ging."]),
    ("The rate was 3.5 per cent...\r\n\r\nNext", ["The rate was 3.5 per cent...", "Next"]),
    ("The duty ended.¹² New one.", ["The duty ended.¹²", "New one."]),
])
def test_sentences(text, units):
    assert [text[a:b] for a, b in sentences.units(text)] == units


def test_units_hold_all_but_white_space():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", ".", "!", " ", "\n", "\r\n", "“", "”", "(", ")", '"', "。", "1", "\n\n", "ก", ";"]) for _ in range(60))
        last, seen = 0, set()
        for a, b in sentences.units(t):
            assert last <= a < b and not t[a].isspace() and not t[b - 1].isspace()
            seen.update(range(a, b))
            last = b
        assert all(t[i].isspace() for i in range(len(t)) if i not in seen)


def test_chunk_functions_compose():
    rng = random.Random(6)
    for _ in range(40):
        t = "".join(rng.choice(["Word ", "so. ", "“", "”", "(", ") ", "\n", "\n\n", '"', "end! "]) for _ in range(120))
        at = [*sentences.cuts(t, 90), len(t)]
        state = sentences.state_id(sentences.START)
        for lo, hi in zip(at, at[1:]):
            state = sentences.chunk_function(t, lo, hi)[state]
        assert state == sentences.state_id(sentences.read(t)[1])


@pytest.mark.parametrize("bad,good", [
    ("DÃ©cret relatif aux pÃªches", "Décret relatif aux pêches"), ("ss 4Ã¢â‚¬â€œ9", "ss 4–9"), ("S├úo", "São"), ("prot√©g√©", "protégé"), ("Йtienne", "Étienne"), ("Å\x81Ã³dka", "Łódka"), ("r+AOk-sum+AOk", "résumé"),
    ("Loi sur lвЂ™Г©quitГ©", "Loi sur l’équité")])
def test_garbled_text_is_restored(bad, good):
    assert mojibake.restore(bad) == (True, good)


@pytest.mark.parametrize("text", [None, "", "plain", "São Telmo, Łódka, MAÇÃ™, IRMÃO", "§§ 3–5, 19th‑century, √2, ±5 °C, Γάμμα", "Île-Sûre", "a + b", "Свидетель оспорил сделку"])
def test_correct_text_is_left_alone(text):
    assert mojibake.restore(text) == (False, text)


def test_lost_bytes_are_found():
    assert mojibake.restore("d�j� vu DÃ©") == (True, "d�j� vu Dé")


@pytest.mark.parametrize("text,found", [
    ("<p>One</p>", ["html"]), ("x &sect; 4", ["html"]), ("## Head\n\ntext", ["markdown"]), ("Title\n=====\n\n* a", ["markdown"]), ("== Head ==\n\n# a\n# b", ["wiki"]), ("''so'' it {{cite|x}}", ["wiki"]),
    ("\\section{A}\n\n\\begin{itemize}", ["latex"]), ("<p>x</p>\n\\( D = \\frac{P}{r} \\)", ["html", "latex"]), (None, []), ("", []),
    ("It held that 62 < 67 and 71 > 66. * * *", []), ("Item # 23 was listed. See note 26*. [sic] {bracketed}", []), ("He paid $500 and later $631. Lot 78\\B was sold. Price: $1.50 | $2.50", []), ("-- continued -- 31~33 80_81 Hale & Corrie 'Tis so'", [])])
def test_markup_languages(text, found):
    assert markup.languages(text) == found


def test_structure_is_kept():
    t = "<h2>Head</h2><p>One <b>two</b><p>Three<ul><li>a<li>b</ul><pre>if x:\n    y</pre><table><tr><td>c</td><td>1</td></tr></table><math><mi>D</mi></math>"
    assert markup.convert(t)[1] == "## Head\n\nOne two\n\nThree\n\n- a\n\n- b\n\n```\nif x:\n    y\n```\n\nc | 1\n\n$D$"


def test_repeats_have_common_anchors():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta ", " ", "ee", "----------", "abab", "x"]
    for _ in range(150):
        shared = ("".join(rng.choice(words) for _ in range(60)))[:repeats.LEAST]
        if len(shared) < repeats.LEAST:
            continue
        a = "".join(rng.choice(words) for _ in range(rng.randrange(30))) + shared + "".join(rng.choice(words) for _ in range(10))
        b = "".join(rng.choice(words) for _ in range(rng.randrange(30))) + shared + "".join(rng.choice(words) for _ in range(10))
        assert set(repeats.anchors(a)[1]) & set(repeats.anchors(b)[1]), shared
    assert len(repeats.anchors("")[0]) == 0


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abxd", 1), ("ca", "abc", 2), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_edit_metric(a, b, d):
    assert names.damerau(a, b, 5) == d == names.damerau(b, a, 5)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_metric_triangle(a, b, c):
    assert names.damerau(a, c, 20) <= names.damerau(a, b, 20) + names.damerau(b, c, 20)


WORDS = names.vocabulary({"nathaniel": (90, 2.0, False), "vincent": (80, 2.0, False), "nate": (20, 2.0, False), "holdings": (70, 2.0, True), "gas": (60, 2.0, True)}, {("nate", "nathaniel"): 14})
KNOWN = names.Authorities(["The King", "R.", "Attorney General of Veland", "AG (Veland)"])


@pytest.mark.parametrize("name,stems", [
    ("In re Bidivibin, Vincent et al.", [("person", "bidivibin", "vincent")]), ("R. v. Nate Lilaribek", [("person", "lilaribek", "nathaniel")]), ("Estate of S. Zilull ensith v AG (Veland)", [("person", "zilullensith", "s")]),
    ("Holdings Dresinanuz Corp. -v- The King", [("firm", "dresinanuz", "holdings")]), ("Nirenlentuz Gas. Association v. R.", [("firm", "nirenlentuz", "gas")]), (None, []), ("", []), ("R. v. Attorney Gneral of Veland", [])])
def test_parties(name, stems):
    assert [(p.kind, p.stem, p.mark) for p in names.parties(name, KNOWN, WORDS)] == stems


@pytest.mark.parametrize("text,date", [("1999-03-04", (1999, 3, 4)), ("1999-03", (1999, 3, 0)), ("March 4, 1999", (1999, 3, 4)), ("4 mars 1999", (1999, 3, 4)), (None, None), ("", None), ("none", None)])
def test_dates(text, date):
    assert matching.date_of(text) == date


def lexicon():
    import numpy as np

    counts = {w: 500 for w in "the deliberate witness director answered claim officer cost-sharing valuation of".split()} | {"tbe": 5}
    return scans.Lexicon(counts, np.zeros(scans.SLOTS, np.int32)).build()


@pytest.mark.parametrize("seen,meant", [("direct0r", "director"), ("clelibercite", "deliberate"), ("vvitness", "witness"), ("offlcer", "officer"), ("tbe", "the"), ("l984", "1984"), ("claim", None), ("Wexcombe", None), ("A-11", None), ("1984", None)])
def test_misread_words(seen, meant):
    assert scans.suspicious(scans.norm(seen), lexicon(), "", "") == meant


def test_words_parted_at_line_ends():
    r = scans.read("the valua-\ntion of the cost-\nsharing claim", lexicon())
    assert [(w, p) for _, w, p in r.parted] == [("valuation", True), ("cost-sharing", False)]


def test_deep_and_unclosed_markup():
    deep = "<b>" * 100_000 + "x" + "</b>" * 50_000
    assert markup.convert(deep) == (["html"], "x")
    assert markup.convert("<div>" * 30_000 + "y &amp; z")[1] == "y & z"
    assert markup.convert("<p>" * 20_000 + "w")[1] == "w"


def test_links_around_the_main_subtree_go():
    text = "<div><a href=x>Home</a></div><h1>Title</h1><div>" + "<p>The court heard both parties and gave its reasons at length.</p>" * 6 + "<ul><li><a href=y>2001 VLCA 5</a></li></ul></div>"
    clean = markup.convert(text)[1]
    assert "Home" not in clean and clean.startswith("# Title") and "2001 VLCA 5" in clean and clean.count("The court heard") == 6


def test_look_alikes_are_no_markup():
    for t in ["a < b and c > d", "costs of $5 and $6", "5 * 3 * 2", "para [12] and [see note]", "x_1 and y_2", "R & D", "1. first\n2. second", "he said: '' nothing", "# of items", "C:\\temp"]:
        assert markup.languages(t) in ([], ["markdown"]) and (markup.languages(t) == [] or t.startswith("#")), t
