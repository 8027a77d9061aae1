"""HTML extraction: a tree-structured graphical model over the DOM says which nodes are main text.

Every block element is a variable, content or not. What an element looks like (tag, class and id
words, amount of text, share of link text) gives its own potential; parents and children are
linked by potentials that depend on the child's tag. Sum-product messages go from the leaves up
and from the root down, and each node's marginal decides on the text that it holds itself.
Potentials are smoothed counts over labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.shared import small_batches

# A value is quoted only right after its equals sign; a quote elsewhere in a tag is a plain character.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)))*+)>|<![^>]*>|<\?[^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")

#: Elements whose content is no markup and never text of the page, up to their end tag.
RAW = frozenset("script style title iframe textarea".split())
#: Elements whose content is markup, but never text of the page, from their start tag to their end tag or their parent's.
HIDDEN = frozenset("noscript template select object svg math".split())
#: Of these, elements that a slash closes, and that start tags of ``_BREAKOUT`` end.
FOREIGN = frozenset("svg math".split())
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li main article section ol p pre ruby s small span strong strike sub sup table u ul var".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are part of the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var".split()
)
#: What a start tag closes if it is open, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    chars: int = 0  # of text in it and below
    links: int = 0  # of that, in links
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Block elements in page order, each after its parent, and the pieces of text: (node, text)."""

    nodes: list[Node]
    pieces: list[tuple[int, str]]


def parse(source: str | None) -> Page:
    """Read markup leniently: unclosed and misnested elements end where HTML says or with their parent.

    Linear in the markup: an end tag looks for its start tag only if one is open.
    """
    nodes = [Node("#root", -1)]
    pieces: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = [("#root", 0)]  # names of open elements and the block node they are in
    count: Counter = Counter()  # of open elements by name
    text: list[str] = []
    hidden = 0  # open elements that hide text
    source = source or ""
    lower = source.lower()
    ends = {x: lower.rfind(f"</{x}") for x in HIDDEN}

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                node = open_[-1][1]
                pieces.append((node, joined))
                nodes[node].chars += len(joined)
            text.clear()

    def add(raw: str) -> None:
        if raw and not hidden:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if count["a"]:
                nodes[open_[-1][1]].links += len(plain.strip())

    def push(name: str, node: int) -> None:
        nonlocal hidden
        open_.append((name, node))
        count[name] += 1
        hidden += name in HIDDEN

    def cut(k: int) -> None:
        nonlocal hidden
        for name, _ in open_[k:]:
            count[name] -= 1
            hidden -= name in HIDDEN
        del open_[k:]

    def close(names: set[str], stop: set[str]) -> None:
        if any(count[x] for x in names):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in names:
                    flush()
                    cut(k)
                    return
                if open_[k][0] in stop:
                    return

    def end(name: str) -> None:
        if not count[name]:
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] == name:
                if name not in HIDDEN and (name not in INLINE or any(x not in INLINE for x, _ in open_[k:])):
                    flush()
                cut(k)
                return
            if name in INLINE and open_[k][0] not in INLINE:
                return  # an inline end tag does not end the block around it

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None:
            continue
        if m[1]:
            if name == "br":
                text.append(" ")
            elif name not in VOID:
                end(name)
            continue
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if found:
                at = found.end()
            elif name in ("script", "style"):
                at = len(source)
            continue  # any other without an end tag hides nothing
        if name in _BREAKOUT and (count["svg"] or count["math"]):
            cut(next(k for k, (x, _) in enumerate(open_) if x in FOREIGN))
        if name in VOID:
            if name in ("br", "hr"):
                text.append(" ")
            continue
        if name in HIDDEN:
            # one that is never closed hides nothing, but for svg and math, whose content shows where they end
            if not m[3].endswith("/") if name in FOREIGN else ends[name] >= at:
                push(name, open_[-1][1])
            continue
        if name in INLINE:
            if name == "a":
                end("a")  # links don't nest
            push(name, open_[-1][1])
            continue
        if name in ("html", "body", "head"):
            continue
        if hidden:
            push(name, open_[-1][1])
            continue
        flush()
        if name in _CLOSES:
            close(*_CLOSES[name])
        close({"p"}, {"td", "th", "li", "div", "article", "section"} - ({"li"} if name == "li" else set()))
        k = len(open_)
        while open_[k - 1][0] in INLINE:  # left open by what has ended
            k -= 1
        cut(k)
        parent = open_[-1][1]
        names: list[str] = []
        for x in _ATTRIBUTE.finditer(m[3]):
            names.extend(_NAME_PART.findall((x[2] or x[3] or x[4] or "").lower()))
        nodes.append(Node(name, parent, tuple(names)))
        nodes[parent].children.append(len(nodes) - 1)
        push(name, len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].chars += nodes[i].chars
        nodes[nodes[i].parent].links += nodes[i].links
    return Page(nodes, pieces)


def _looks(node: Node, own: bool) -> Iterator[str]:
    """An element's features."""
    yield f"tag:{node.tag} links:{int(3.99 * min(1.0, node.links / node.chars)) if node.chars else -1}"
    for x in set(node.names):
        yield f"name:{x}"
    if not node.names:
        yield f"bare:{node.tag}"
    yield f"chars:{min(8, int(math.log2(node.chars + 1)) // 2)} own:{own}"


@dataclass
class Model:
    """Log potentials: of features, (off, on); of (child's tag, parent's label, child's label)."""

    looks: dict[str, tuple[float, float]]
    edges: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    other: tuple[tuple[float, float], tuple[float, float]]
    root: tuple[float, float]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by one pass of sum-product messages up the tree and one down."""
        nodes = page.nodes
        holds = {i for i, _ in page.pieces}
        up0, up1 = [0.0] * len(nodes), [0.0] * len(nodes)  # own potential and messages of the children
        for i, node in enumerate(nodes):
            a, b = self.root if i == 0 else (0.0, 0.0)
            for x in _looks(node, i in holds):
                if x in self.looks:
                    u, v = self.looks[x]
                    a, b = a + u, b + v
            up0[i], up1[i] = a, b
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (e00, e01), (e10, e11) = self.edges.get(nodes[i].tag, self.other)
            m = (_logsum(e00 + up0[i], e01 + up1[i]), _logsum(e10 + up0[i], e11 + up1[i]))
            sent[i] = m
            p = nodes[i].parent
            up0[p] += m[0]
            up1[p] += m[1]
        all0, all1 = up0[:], up1[:]
        for i in range(1, len(nodes)):
            p = nodes[i].parent
            a, b = all0[p] - sent[i][0], all1[p] - sent[i][1]  # the parent without what this child said
            (e00, e01), (e10, e11) = self.edges.get(nodes[i].tag, self.other)
            all0[i] += _logsum(a + e00, b + e10)
            all1[i] += _logsum(a + e01, b + e11)
        return [1 / (1 + math.exp(max(-700.0, min(700.0, x - y)))) for x, y in zip(all0, all1, strict=True)]

    def text(self, source: str | None) -> str:
        page = parse(source)
        if not page.pieces:
            return ""
        p = self.marginals(page)
        return " ".join(x for i, x in page.pieces if p[i] >= 0.5)


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def fit(pages: Iterable[tuple[str, str]]) -> Model:
    """Count potentials over pages of known main text.

    A node that holds text is content if its pieces are among the main text's, in order; one that
    holds none is content if most text below it is. Only class and id words seen on two pages or
    more become features.
    """
    looks: Counter = Counter()
    edges: Counter = Counter()
    labels: Counter = Counter()
    seen: Counter = Counter()
    roots: Counter = Counter()
    for source, main in pages:
        page = parse(source)
        on = _labels(page, main)
        holds = {i for i, _ in page.pieces}
        roots[on[0]] += 1
        for i, node in enumerate(page.nodes):
            if i == 0 or not node.chars:
                continue
            labels[on[i]] += 1
            edges[node.tag, on[node.parent], on[i]] += 1
            for x in _looks(node, i in holds):
                looks[x, on[i]] += 1
        seen.update({f"name:{x}" for node in page.nodes for x in node.names})
    total = {y: labels[y] + 2.0 for y in (0, 1)}

    def pair(tag: str | None) -> tuple[tuple[float, float], tuple[float, float]]:
        rows = []
        for y in (0, 1):
            c = [sum(n for (t, a, b), n in edges.items() if a == y and b == z and (tag is None or t == tag)) + 0.5 for z in (0, 1)]
            rows.append((math.log(c[0] / sum(c)), math.log(c[1] / sum(c))))
        return rows[0], rows[1]

    return Model(
        {
            x: tuple(math.log((looks[x, y] + 0.5) / total[y]) for y in (0, 1))
            for x in {x for x, _ in looks}
            if not x.startswith("name:") or seen[x] > 1
        },
        {tag: pair(tag) for tag in {t for t, _, _ in edges}},
        pair(None),
        tuple(math.log((roots[y] + 0.5) / (sum(roots.values()) + 1)) for y in (0, 1)),
    )


def _labels(page: Page, main: str) -> list[int]:
    on_chars = [0] * len(page.nodes)
    at = 0
    for i, x in page.pieces:
        found = main.find(x, at)
        if found >= 0 and (found <= at + 1):
            on_chars[i] += len(x)
            at = found + len(x)
    for i in range(len(page.nodes) - 1, 0, -1):
        on_chars[page.nodes[i].parent] += on_chars[i]
    return [int(2 * n > node.chars) if node.chars else 0 for n, node in zip(on_chars, page.nodes, strict=True)]


# Names that page authors commonly give to parts of a page, by part.
_PARTS = {
    "nav": (("nav", "div", "ul"), "nav menu navbar navigation breadcrumb breadcrumbs topnav links tabs pagination pager"),
    "header": (("header", "div"), "header masthead banner top brand logo site"),
    "footer": (("footer", "div"), "footer bottom copyright legal foot colophon site"),
    "aside": (("aside", "div"), "sidebar aside related widget popular trending recommended rail secondary tags"),
    "ad": (("div", "aside", "ins", "section"), "ad ads advert advertisement sponsor sponsored promo banner promoted"),
    "notice": (("div", "section", "p"), "cookie notice consent gdpr alert newsletter subscribe signup paywall popup modal"),
    "form": (("form", "div"), "form search login contact subscribe signup"),
    "comments": (("section", "div", "ol"), "comments comment reply replies discussion responses disqus respond"),
    "share": (("div", "ul"), "share social sharing buttons follow author byline meta"),
}
_MAIN = (("article", "main", "div", "section"), "article content main post entry story body text page single")
_SYLLABLES = "ba be ci do fu ga he ki lo mu na pe qui ro su ta ve xi yo zu an en in on un ar er ir or ur st th tr".split()


def sample_pages(count: int = 400, seed: int = 3) -> Iterator[tuple[str, str]]:
    """Labelled pages: made-up markup of the usual parts, and the main text that it holds."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + r.choice([".", ".", "!", "?"])

    def attributes(names: str) -> str:
        picked = r.sample(names.split(), r.randint(1, 2))
        return r.choice(["", f' class="{" ".join(picked)}"', f' class="{"-".join(picked)}"', f' id="{picked[0]}"'])

    def link_list() -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(r.randint(2, 9)))
        return f"<ul>{items}</ul>" if r.random() < 0.8 else re.sub("</?li>", " ", items)

    def part(kind: str) -> str:
        tags, names = _PARTS[kind]
        tag = r.choice(tags)
        own = tag not in ("div", "section", "p", "ul", "ol")
        attribute = attributes(names) if own else ""
        while not own and not attribute:
            attribute = attributes(names)
        inside = {
            "nav": link_list, "share": link_list,
            "header": lambda: f"<h1>{words(1, 4)}</h1>" if r.random() < 0.3 else f'<a href="/">{words(1, 3)}</a> <p>{sentence(3, 9)}</p>',
            "footer": lambda: f"&copy; {words(1, 3)} &middot; {sentence(2, 14)}" if r.random() < 0.6 else f"<p>{sentence(3, 14)}</p>{link_list()}",
            "aside": lambda: f"<h3>{words(1, 3)}</h3>{link_list()}" if r.random() < 0.6 else f"<p>{sentence(5, 25)}</p>",
            "ad": lambda: r.choice([sentence(3, 20), f"<p>{sentence(3, 15)}</p>", f'<a href="x">{sentence(3, 9)}</a>']),
            "notice": lambda: f"<p>{sentence(6, 25)}</p><button>{words(1, 2)}</button>" if tag != "p" else sentence(6, 25),
            "form": lambda: f"<label>{words(1, 2)}</label><input name=q><p>{sentence(3, 9)}</p><button>{words(1, 1)}</button>",
            "comments": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(
                f'<{"li" if tag == "ol" else "div"} class="comment"><b>{words(1, 2)}</b><p>{sentence(4, 40)}</p></{"li" if tag == "ol" else "div"}>'
                for _ in range(r.randint(1, 6))),
        }[kind]()
        return f"<{tag}{attribute}>{inside}</{tag}>"

    for _ in range(count):
        body, main = [], []
        if r.random() < 0.9:
            title = sentence(3, 12)
            body.append(f"<h1>{title}</h1>")
            main.append(title)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                text = " ".join(sentence(2, 18) for _ in range(r.randint(1, 7)))
                body.append(f"<p>{text}</p>" if r.random() < 0.85 else f'<p><a href="/x">{text}</a></p>' if r.random() < 0.1 else f"<p>{text}")
                main.append(text)
            elif kind < 0.82:
                text = words(1, 7)
                body.append(f"<h{r.randint(2, 3)}>{text}</h{2}>".replace("</h2>", "") if r.random() < 0.1 else f"<h2>{text}</h2>")
                main.append(text)
            elif kind < 0.88:
                texts = [sentence(2, 15) for _ in range(r.randint(2, 5))]
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in texts) + "</ul>")
                main.extend(texts)
            elif kind < 0.92:
                text = sentence(5, 25)
                body.append(f"<blockquote><p>{text}</p></blockquote>")
                main.append(text)
            elif kind < 0.94:
                texts = [words(1, 3) for _ in range(4)]
                body.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in texts) + "</tr></table>")
                main.extend(texts)
            elif kind < 0.97:
                body.append(f"<p><b>{(text := sentence(2, 12))}<br>")
                main.append(text)
            else:
                body.append(part(r.choice(["ad", "share", "notice", "aside"])))
        for _ in range(r.choice([0, 0, 1, 2])):  # layout boxes around runs of the text
            a, z = sorted(r.choices(range(len(body) + 1), k=2))
            if a < z:
                box = r.choice(["div", "div", "section"])
                name = r.choice(["", "", ' class="inner"', ' class="row"', ' class="text"', ' class="section"'])
                body[a:z] = [f"<{box}{name}>{''.join(body[a:z])}</{box}>"]
        tag = r.choice(_MAIN[0])
        attribute = attributes(_MAIN[1])
        while tag in ("div", "section") and not attribute:
            attribute = attributes(_MAIN[1])
        before = [part(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
        after = [part(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        inner = f"<{tag}{attribute}>{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(["wrapper", "container", "row", "layout"])}">{inner}</div>'
        yield f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", " ".join(" ".join(main).split())


def extract(pages: DataFrame, model: Model, html: str = "html", text: str = "text", length: str = "n_chars") -> DataFrame:
    """Every row with its main text and that text's code points; columns of these names are replaced.

    Null and empty pages, and pages without main text, have an empty text. Whole pages are read,
    in time linear in their length. Each row counts by itself, repeated rows too; a piece of text
    of marginal 0.5 is content. All other columns stay, whatever their names.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    pages = pages.drop(text, length)
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [m.text(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*batch.schema.names, text, length])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField(length, T.LongType())]))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html"))
    return extract(pages, fit(sample_pages())).select("page_id", "url", "text", "n_chars")
