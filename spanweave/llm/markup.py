"""Markup left in texts: which languages are present, and the text without it.

Structure that carries meaning is kept in light marks: ``# `` before headings (as many as
the level), ``- `` or ``1. `` before items, fences around code, ``$`` around formulas, `` | ``
between cells, ``> `` before quotations.

HTML and XML are read into a tree. Every node gets its composite text density: characters
per tag, adjusted by the share of characters that stand in links. The node with the largest
sum of child densities is the main subtree; the least density on the way from the body to it
is the threshold under which a link-heavy block counts as boilerplate and is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- what is present -------------------------------------------------------------------

TAG = re.compile(r"<(/?)([a-zA-Z][\w:.-]*)((?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*(/?)>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][a-zA-Z][^>]*>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")

LATEX_STRONG = re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}|\\[a-zA-Z]{2,}\*?\s*(?:\[[^\]\n]*\])?\{|\\(?:item|maketitle|noindent|par|newpage|hline|centering|ldots|quad|alpha|beta|gamma|sum|int|times|cdot|leq|geq)\b|\\\([^\n]*?\\\)|\\\[.*?\\\]", re.S)
LATEX_MATH = re.compile(r"(?<![\\$\w])\$(?![\s\d$])[^$\n]*[\\^_={}][^$\n]*(?<!\s)\$(?![\d$])|\$\$.+?\$\$", re.S)
WIKI_STRONG = re.compile(
    r"^={2,6}[^=\n][^\n]*?={2,6}[ \t]*$|(?<!')'{2,3}(?!')[^'\n]+(?:'[^'\n]+)*'{2,3}(?!')|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^\{\|.*$|^:+ \S|\[https?://\S+ [^\]\n]+\]|__(?:TOC|NOTOC|FORCETOC)__|</?(?:nowiki|ref|references)\b",
    re.M)
MD_STRONG = re.compile(
    r"^#{2,6}[ \t]+\S|^#[ \t]+\S[^\n]*#[ \t]*$|^(?=\S)[^\n|]+\n(?:={3,}|-{3,})[ \t]*$|\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<!`)`[^`\n]+`(?!`)|^(?:```|~~~)|^> ?\S|^[-+][ \t]+\S|^\|?[ \t]*:?-{3,}:?[ \t]*\||!?\[[^\]\n]+\]\([^)\s]+(?: \"[^\"]*\")?\)|^\[[^\]\n]+\]:\s+\S+|\[\^\w+\]|(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])|(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])",
    re.M)
STAR_ITEM = re.compile(r"^\*[ \t]+(?!\*)\S", re.M)
HASH_RUN = re.compile(r"^#[ \t]+\S[^\n]*\n#[ \t]+\S", re.M)
HASH_ONE = re.compile(r"^#[ \t]+\S", re.M)


def languages(text: str | None, root: "Node | None" = None) -> list[str]:
    """Languages of markup in ``text``, of html, markdown, wiki and latex. Null and empty
    texts have none. A sign that two languages share counts for the one that is there. HTML is
    what gives the tree nodes; the others are looked for in the text that its nodes hold."""
    if not text:
        return []
    out = []
    root = root or parse(text)
    if root.marked or ("&" in text and _entity(text)):
        out.append("html")
    latex = ("\\" in text and LATEX_STRONG.search(text)) or ("$" in text and LATEX_MATH.search(text))
    bare = held(root) if root.marked else text
    if latex:  # quotation marks and groups of LaTeX
        bare = re.sub(r"``|''|[{}]", " ", LATEX_MATH.sub(" ", LATEX_STRONG.sub(" ", bare)))
    wiki = WIKI_STRONG.search(bare)
    markdown = MD_STRONG.search(bare)
    if markdown and wiki and markdown[0].startswith("#") and not re.match(r"#{2,}", markdown[0]):
        markdown = None
    if not wiki and not markdown:
        # Signs that both have: runs of # lines number items, a lone one heads a text.
        if HASH_RUN.search(bare):
            wiki = True
        elif HASH_ONE.search(bare) or STAR_ITEM.search(bare):
            markdown = True
    if markdown:
        out.append("markdown")
    if wiki:
        out.append("wiki")
    if latex:
        out.append("latex")
    return out


def held(root: "Node") -> str:
    """The text in a tree's nodes: inline tags are spaces, all others line ends."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        mark = " " if n.tag in INLINE else "\n"
        if n is not root:
            out.append(mark)
            if n.closed:
                todo.append(mark)
        todo.extend(reversed(n.children))
    return "".join(out)


def _entity(text: str) -> bool:
    return any(html.unescape(m[0]) != m[0] for m in ENTITY.finditer(text))


# --- trees and densities ---------------------------------------------------------------

INLINE = frozenset("a abbr b bdi bdo big cite code dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var footnotemark page-number page-break extracted-citation bold italic".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr page-break".split())
HIDDEN = frozenset("script style head title noscript template".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BARRIER = frozenset("ul ol dl table body div blockquote td opinion".split())
OPENS_BLOCK = frozenset("p div ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6 center heading opinion section article".split())


@dataclass
class Node:
    tag: str
    attrs: str = ""
    children: list = field(default_factory=list)  # Node or str
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    closed: bool = False  # by a tag of its own
    marked: bool = False  # whether the text of the tree has tags or comments


def parse(text: str) -> Node:
    """A tree of ``text``; unclosed and stray tags are put right as browsers do."""
    root = Node("body")
    if "<" not in text:
        root.children.append(text)
        return root
    stack = [root]
    depth: dict[str, list[int]] = {"body": [0]}  # where each tag stands on the stack
    at = 0

    def leave(k: int) -> None:
        while len(stack) > k:
            depth[stack.pop().tag].pop()

    text, n = COMMENT.subn(lambda m: html.escape(m[1], quote=False) if m[1] else " ", text)
    root.marked = n > 0
    for m in TAG.finditer(text):
        root.marked = True
        if m.start() > at:
            stack[-1].children.append(text[at:m.start()])
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name != "body" and depth.get(name):
                k = depth[name][-1]
                stack[k].closed = True
                leave(k)
            else:  # a stray end
                stack[-1].children.append(" " if name in INLINE else "\n")
            continue
        ends = CLOSES.get(name, {"p"} if name in OPENS_BLOCK else set())
        open_ = max((depth[t][-1] for t in ends if depth.get(t)), default=0)
        if open_:
            barrier = max((depth[t][-1] for t in BARRIER if depth.get(t) and not (name == "tr" and t == "td")), default=0)
            if open_ > barrier or (open_ == barrier and stack[open_].tag in ends):
                leave(open_)
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if not m[4] and name not in VOID:
            depth.setdefault(name, []).append(len(stack))
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def measure(root: Node) -> None:
    """Composite text density of every node, and the sum of its children's densities."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node))
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
            elif c.tag not in HIDDEN:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, max(n.link_tags, 1)
    body_links, body_chars = root.link_chars, max(root.chars, 1)
    for n in reversed(order):
        c, t = max(n.chars, 1), max(n.tags, 1)
        lc, lt = max(n.link_chars, 1), max(n.link_tags, 1)
        plain = max(c - n.link_chars, 1)
        base = math.log(c / plain * n.link_chars + body_links / body_chars * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / max(math.log(base), 1e-9) if base > 1.0001 else c / t
        if n.chars == 0:
            n.density = 0.0
    for n in order:
        n.total = sum(x.density for x in n.children if isinstance(x, Node)) + sum(len(x.strip()) for x in n.children if isinstance(x, str))


def main_subtree(root: Node) -> tuple[Node, float]:
    """The node with the largest sum of densities, and the least density on the way to it."""
    best, least = root, root.density
    todo = [(root, root.density)]
    while todo:
        n, low = todo.pop()
        if n.total > best.total:
            best, least = n, low
        todo.extend((c, min(low, c.density)) for c in n.children if isinstance(c, Node) and c.tag not in HIDDEN)
    return best, least


def _boilerplate(n: Node, threshold: float) -> bool:
    return n.tag in ("nav", "footer", "aside", "ul", "div", "table", "section", "header") and n.density < threshold and n.link_chars > 0.6 * n.chars


SPACE = re.compile(r"[ \t\r\n\f\u00a0\u200b]+")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 heading center".split())


def _plain(root: Node) -> str:
    """The text below a node, as it stands."""
    out: list[str] = []
    todo: list = list(reversed(root.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(html.unescape(n))
        elif n.tag == "br":
            out.append("\n")
        elif n.tag not in HIDDEN:
            todo.extend(reversed(n.children))
    return "".join(out)


def from_html(text: str, root: Node | None = None) -> str:
    """``text`` without HTML or XML. The subtree with the largest sum of densities is kept
    whole; outside of it blocks go whose text is mostly links and whose density is under the
    threshold, the least density on the way from the body to that subtree."""
    root = root or parse(text)
    measure(root)
    main, threshold = main_subtree(root)
    lines: list[str] = []
    now: list[str] = []

    def flush(prefix: str = "") -> None:
        line = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if line:
            lines.append(prefix + line)

    # What is left to do, last first: a child of a node with the prefix of its lines, the
    # counter of its list and whether it lies in the main subtree; or a line to end.
    todo: list[tuple] = []

    def enter(n: Node, prefix: str, counter: list[int] | None, inside: bool, end: str | None = None) -> None:
        if end is not None:
            todo.append((None, end, None, False, None))
        todo.extend((c, prefix, counter, inside or n is main, n) for c in reversed(n.children))

    enter(root, "", None, False)
    while todo:
        c, prefix, counter, inside, above = todo.pop()
        if c is None:
            flush(prefix)
            continue
        if isinstance(c, str):
            kept = html.unescape(c)
            if above.tag == "body" and "\n" in kept:
                for k, part in enumerate(re.split(r"\n\s*\n", kept) if "\n\n" in kept else kept.split("\n")):
                    if k:
                        flush(prefix)
                    now.append(part)
            else:
                now.append(kept)
            continue
        tag = c.tag
        if tag in HIDDEN or (not inside and c is not main and _boilerplate(c, threshold)):
            continue
        if tag in ("br", "hr", "page-break"):
            flush(prefix)
        elif tag == "math" or tag.endswith(":math"):
            now.append("$" + SPACE.sub(" ", _plain(c)).strip() + "$")
        elif tag == "pre":
            flush(prefix)
            lines.append("```\n" + _plain(c).strip("\n") + "\n```")
        elif tag in HEADINGS or (tag == "p" and 'class="head"' in c.attrs):
            flush(prefix)
            enter(c, "", None, inside, "#" * (int(tag[1]) if tag[1:].isdigit() else 2) + " ")
        elif tag in ("ul", "ol"):
            flush(prefix)
            enter(c, prefix, [0] if tag == "ol" else None, inside, prefix)
        elif tag in ("li", "dt", "dd"):
            flush(prefix)
            mark = "- "
            if counter is not None:
                counter[0] += 1
                mark = f"{counter[0]}. "
            enter(c, prefix + mark, None, inside, prefix + mark)
        elif tag == "blockquote":
            flush(prefix)
            enter(c, prefix + "> ", None, inside, prefix + "> ")
        elif tag == "tr":
            flush(prefix)
            cells = [SPACE.sub(" ", _plain(x)).strip() for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
            if cells:
                lines.append(prefix + " | ".join(cells))
        elif tag in INLINE:
            enter(c, prefix, counter, inside)
        else:
            flush(prefix)
            enter(c, prefix, counter, inside, prefix)
    flush()
    return "\n\n".join(lines)


# --- the other languages -----------------------------------------------------------------

FENCE = re.compile(r"^(?:```|~~~)[^\n]*\n(.*?)(?:^(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)


def from_markdown(text: str) -> str:
    """``text`` without Markdown; code blocks stay as they are."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append("```\n" + m[1].rstrip("\n") + "\n```")
        return f"\0{len(kept) - 1}\0"

    t = FENCE.sub(keep, text)
    t = re.sub(r"^([^\n|]*\S[^\n|]*)\n={3,}[ \t]*$", r"# \1", t, flags=re.M)
    t = re.sub(r"^([^\n|]*\S[^\n|]*)\n-{3,}[ \t]*$", r"## \1", t, flags=re.M)
    t = re.sub(r"^(#{1,6} .*?)[ \t]*#+[ \t]*$", r"\1", t, flags=re.M)
    t = re.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", t, flags=re.M)
    t = re.sub(r"^[*+-][ \t]+(?=\S)", "- ", t, flags=re.M)
    t = re.sub(r"!?\[([^\]\n]+)\]\([^)\n]*\)", r"\1", t)
    t = re.sub(r"\*\*(\S[^*\n]*?)\*\*|__(\S[^_\n]*?)__", lambda m: m[1] or m[2], t)
    t = re.sub(r"(?<![\w_])_([^\s_][^_\n]*?)_(?![\w_])|(?<![\w*])\*([^\s*][^*\n]*?)\*(?![\w*])", lambda m: m[1] or m[2], t)
    t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", t)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], t)


def from_wiki(text: str) -> str:
    """``text`` without wiki markup."""
    t = re.sub(r"^(={2,6})[ \t]*([^\n]*?)[ \t]*=+[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2].strip("= "), text, flags=re.M)
    t = re.sub(r"\{\{[^{}|\n]*\|([^{}\n]*)\}\}", lambda m: m[1].rpartition("|")[2], t)
    t = re.sub(r"\{\{([^{}\n]*)\}\}", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"^(?:\{\|.*|\|-.*|\|\}.*)\n?", "", t, flags=re.M)
    t = re.sub(r"^[|!][ \t]*(.*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]), t, flags=re.M)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"^\*+[ \t]*(?=\S)", "- ", t, flags=re.M)
    t = _numbered(t)
    return re.sub(r"^:+[ \t]*", "> ", t, flags=re.M)


def _numbered(t: str) -> str:
    out, n = [], 0
    for line in t.split("\n"):
        if line.startswith("# "):
            n += 1
            out.append(f"{n}. {line[2:]}")
        else:
            n = 0
            out.append(line)
    return "\n".join(out)


def from_latex(text: str) -> str:
    """``text`` without LaTeX; formulas stand between dollar signs."""
    t = re.sub(r"\\\((.*?)\\\)", r"$\1$", text, flags=re.S)
    t = re.sub(r"\\\[(.*?)\\\]|\$\$(.*?)\$\$", lambda m: "$" + (m[1] or m[2]).strip() + "$", t, flags=re.S)
    formulas: list[str] = []

    def keep(m: re.Match) -> str:
        formulas.append(m[0])
        return f"\0{len(formulas) - 1}\0"

    t = re.sub(r"\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", lambda m: keep(re.match(r"(?s).*", "$" + m[1].strip() + "$")), t, flags=re.S)
    t = re.sub(r"(?<!\\)\$[^$\n]+\$", keep, t)
    t = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\n?\\end\{(?:verbatim|lstlisting)\}", r"```\n\1\n```", t, flags=re.S)
    t = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "#" * {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m[1]] + " " + m[2], t)
    t = re.sub(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: re.sub(r"[ \t]*(?<!\\)&[ \t]*", " | ", re.sub(r"\\hline\s*", "", re.sub(r"\s*\\\\\s*", "\n", m[1]))), t, flags=re.S)
    t = re.sub(r"\\begin\{quot(?:e|ation)\}(.*?)\\end\{quot(?:e|ation)\}", lambda m: "> " + m[1].strip(), t, flags=re.S)
    t = re.sub(r"^[ \t]*\\item[ \t]*(?:\[[^\]\n]*\])?[ \t]*", "- ", t, flags=re.M)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?\n?", "", t)
    for _ in range(6):
        new = re.sub(r"\\footnote\{([^{}]*)\}", r"(\1)", t)
        new = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", new)
        if new == t:
            break
        t = new
    t = re.sub(r"(?<!\\)%[^\n]*", "", t) if "\\documentclass" in text else t
    t = re.sub(r"\\([&%$#_{}])", r"\1", t)
    t = t.replace("``", "“").replace("''", "”").replace("---", "—").replace("--", "–")
    t = re.sub(r"(?<=\w)~(?=\w)", " ", t)
    return re.sub("\0(\\d+)\0", lambda m: formulas[int(m[1])], t)


def convert(text: str | None) -> tuple[list[str], str | None]:
    """The languages of markup in ``text`` and the text without it. A text without markup,
    null or empty, comes back as it is."""
    if not text:
        return [], text
    root = parse(text)
    found = languages(text, root)
    if not found:
        return found, text
    t = text
    if "html" in found:
        if root.marked and not ("markdown" in found or "wiki" in found):
            t = from_html(t, root)
        else:  # lines carry structure there
            t = html.unescape(TAG.sub(lambda m: "" if m[2].lower() in INLINE else "\n", COMMENT.sub("", t)) if root.marked else t)
    if "latex" in found:
        t = from_latex(t)
    if "wiki" in found:
        t = from_wiki(t)
    if "markdown" in found:
        t = from_markdown(t)
    return found, re.sub(r"\n{3,}", "\n\n", t).strip()


def clean(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``languages`` (array) and ``clean_text`` of every row's ``text``.

    Null or empty text: no languages, the text as it is. Repeated rows give repeated rows.
    Other columns are ignored. A narrow map without shuffle."""
    rows = df.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.col(text).cast("string").alias("t"))
    key_schema = ", ".join(f"k{n} {rows.schema[f'k{n}'].dataType.simpleString()}" for n in range(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [convert(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())],
                [*[f"k{n}" for n in range(len(keys))], "languages", "clean_text"])

    out = rows.mapInArrow(run, f"{key_schema}, languages array<string>, clean_text string")
    return out.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)], "languages", "clean_text")
