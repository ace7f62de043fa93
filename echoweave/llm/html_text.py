"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not. A node's evidence (its tag, the words of
its class, id and role, its own text's length, links and sentence ends) and a parent-child potential form a
tree-shaped Markov field; one pass of sum-product messages up and one down give every node's exact content marginal.
All parameters are counts over labelled pages: a written set of layouts (``LAYOUTS``) filled with invented text, or any
pages whose elements carry the attribute ``y``.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no text of the page.
_RAW = {t: re.compile(f"</{t}(?![a-z0-9:-])", re.I) for t in "script style template textarea title svg iframe select object".split()}
_WORD = re.compile(r"[a-z]+")
#: Elements of HTML without an end tag, those inside a line of text, and which open ones a start tag ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPACE = " \t\n\r\f\v"
_RUN = re.compile(r"\s+")
#: Words of an element that counts as short: its pairs of words are evidence.
SHORT = 24
_STOP = re.compile(r"[.!?…]['\")\]]*\Z")


@dataclass
class Node:
    tag: str
    names: str
    parent: int
    label: int | None = None
    texts: list[int] = field(default_factory=list)


class _Frame:
    """An open block element and the inline elements that are open in it."""

    def __init__(self, tag: str, node: int):
        self.tag, self.node = tag, node
        self.inline: list[str] = []
        self.open: dict[str, int] = {}


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all tags, in one pass; comments and the like have no name.

    A raw element runs to its end tag or the end of the page. Where no quote closes before the page ends, tags from
    there on end at their first ``>``.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while 0 <= (at := page.find("<", at)) < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        else:
            closing = page[at + 1] == "/"
            name = _NAME.match(page, at + 1 + closing)
            if not name:
                at += 1
                continue
            end = _tag_end(page, name.end()) if quoted else -1
            if end < 0:
                quoted = False
                end = page.find(">", name.end())
            tag, end = name[0].lower(), end + 1
            inside = page[name.end() : end - 1]
            if tag in _RAW and not closing and not inside.endswith("/"):
                found = _RAW[tag].search(page, end)
                end = page.find(">", found.end()) + 1 if found else len(page)
                end = end or len(page)
                tag = ""
            yield at, end, tag, closing, inside
        at = end


def _tag_end(page: str, at: int) -> int:
    """The ``>`` outside quoted values from a place on; -1 if there is none. A quote opens a value behind ``=`` alone."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        opened = min((i for i in (page.find("=", at, end),) if i >= 0), default=-1)
        if opened < 0:
            return end
        value = opened + 1
        while value < end and page[value] in _SPACE:
            value += 1
        if value < end and page[value] in "\"'":
            closed = page.find(page[value], value + 1)
            if closed < 0:
                return -1
            at = closed + 1
        else:
            at = value


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Block elements in page order (0: the document), and the blocks of text: (element, text, letters in links).

    The work is in proportion to the page. ``labelled``: the attribute ``y`` is an element's label.
    """
    nodes = [Node("document", "", -1)]
    frames = [_Frame("document", 0)]
    opened: dict[str, int] = {}
    blocks: list[tuple[int, str, int]] = []
    part: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if part:
            text = _RUN.sub(" ", html.unescape("".join(p for p, _ in part))).strip()
            if text:
                node = frames[-1].node
                nodes[node].texts.append(len(blocks))
                blocks.append((node, text, sum(len(p) for p, linked in part if linked)))
            part.clear()

    def close() -> str:
        nonlocal links
        frame = frames.pop()
        opened[frame.tag] -= 1
        links -= frame.open.get("a", 0)
        return frame.tag

    at = 0
    for start, end, tag, closing, inside in _tags(page):
        if start > at:
            part.append((page[at:start], links > 0))
        at = end
        frame = frames[-1]
        if not tag:
            continue
        if closing:
            if tag in _INLINE:
                while frame.open.get(tag, 0):
                    gone = frame.inline.pop()
                    frame.open[gone] -= 1
                    links -= gone == "a"
                    if gone == tag:
                        break
            elif opened.get(tag, 0):
                flush()
                while close() != tag:
                    pass
        elif tag in _VOID:
            if tag in ("br", "hr"):
                flush()
        elif tag in _INLINE:
            links += tag == "a"
            frame.inline.append(tag)
            frame.open[tag] = frame.open.get(tag, 0) + 1
        else:
            flush()
            ends = _ENDS.get(tag, ())
            while len(frames) > 1 and (frames[-1].tag == "p" or frames[-1].tag in ends):
                gone = close()
                if gone == "p" or tag != "tr":
                    break
            names, label = [], None
            for a in _ATTRIBUTE.finditer(inside):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() != "y":
                    names.append(value)
                elif labelled:
                    label = int(value)
            nodes.append(Node(tag, " ".join(names), frames[-1].node, label))
            if not inside.endswith("/"):
                frames.append(_Frame(tag, len(nodes) - 1))
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        part.append((page[at:], links > 0))
    flush()
    return nodes, blocks


def evidence(node: Node, blocks: list[tuple[int, str, int]]) -> list[str]:
    out = [f"tag={node.tag}"]
    out += sorted({f"name={w}" for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", node.names).lower())})
    if not node.texts:
        return [*out, "empty"]
    own = [blocks[i] for i in node.texts]
    size = sum(len(t) for _, t, _ in own)
    share = sum(n for *_, n in own) / max(size, 1)
    words = sum(t.count(" ") + 1 for _, t, _ in own)
    out.append(f"words={min(4, int(math.log2(words + 1) / 1.5))}")
    out.append(f"links={0 if share < 0.2 else 1 if share < 0.7 else 2}")
    out.append(f"stop={bool(_STOP.search(own[-1][1]))}")
    if words <= SHORT:
        said = [_WORD.findall(t.lower()) for _, t, _ in own]
        out += sorted({f"says={a} {b}" for w in said for a, b in zip(w, w[1:], strict=False)})
    return out


@dataclass
class Model:
    """Log potentials: of a feature with a label, of (parent's label, child's label), of the root's label."""

    weight: dict[str, tuple[float, float]]
    move: np.ndarray
    root: np.ndarray

    def marginals(self, nodes: list[Node], blocks: list[tuple[int, str, int]]) -> list[float]:
        """Probability of content of every node: messages up from the leaves, then down from the root."""
        none = (0.0, 0.0)
        (m00, m01), (m10, m11) = np.exp(self.move).tolist()
        up = []
        for node in nodes:
            a = b = 0.0
            told = False
            for f in evidence(node, blocks):
                x = self.weight.get(f, none)
                if x is not none and f.startswith("says="):
                    if told:  # an article may quote a notice: one pair of words counts
                        continue
                    told = True
                a += x[0]
                b += x[1]
            top = max(a, b)
            up.append([math.exp(a - top), math.exp(b - top)])
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            u0, u1 = up[i]
            s0, s1 = m00 * u0 + m01 * u1, m10 * u0 + m11 * u1
            total = s0 + s1
            sent[i] = (s0 / total, s1 / total)
            p = up[nodes[i].parent]
            p[0] *= sent[i][0]
            p[1] *= sent[i][1]
            scale = p[0] + p[1]
            if scale < 1e-100:
                p[0], p[1] = p[0] / scale, p[1] / scale
        belief: list[tuple[float, float]] = []
        for i, node in enumerate(nodes):
            if i:
                b0, b1 = belief[node.parent]
                q0, q1 = b0 / max(sent[i][0], 1e-300), b1 / max(sent[i][1], 1e-300)
                d0, d1 = q0 * m00 + q1 * m10, q0 * m01 + q1 * m11
            else:
                d0, d1 = np.exp(self.root).tolist()
            x, y = d0 * up[i][0], d1 * up[i][1]
            total = x + y
            belief.append((x / total, y / total))
        return [b for _, b in belief]


def train(pages: Iterable[str], add: float = 0.5) -> Model:
    """Counts over labelled pages. An element without ``y`` has its parent's label; the document is content."""
    counts: dict[str, list[float]] = {}
    total, move = np.zeros(2), np.full((2, 2), add)
    for page in pages:
        nodes, blocks = parse(page, labelled=True)
        labels: list[int] = []
        for i, node in enumerate(nodes):
            labels.append(1 if not i else labels[node.parent] if node.label is None else node.label)
            total[labels[i]] += 1
            if i:
                move[labels[node.parent], labels[i]] += 1
            for f in evidence(node, blocks):
                counts.setdefault(f, [add, add])[labels[i]] += 1
    # pairs of words tell if several elements outside articles hold them and none inside
    counts = {f: n for f, n in counts.items() if not f.startswith("says=") or (n[0] >= 3 and n[1] < 1)}
    weight = {f: tuple(np.log(np.array(n) / (total + 2 * add)).tolist()) for f, n in counts.items()}
    return Model(weight, np.log(move / move.sum(1, keepdims=True)), np.log(np.array([0.02, 0.98])))


#: Labelled layouts: ``y=0`` opens what is not the article, ``y=1`` what is. In the text fields S stands for some
#: words, L for a paragraph of sentences, K for links, N for a short notice.
LAYOUTS = (
    "<html><head></head><body><nav y=0><ul>K</ul></nav><div class=ad y=0>N</div><article><h1>S</h1>P</article><footer y=0>N</footer></body></html>",
    "<body><header y=0><a href=#>S</a>K</header><main><article><h1>S</h1>PP</article></main><aside class=sidebar y=0><h3>S</h3><ul>K</ul></aside><footer y=0><p>N</p><ul>K</ul></footer></body>",
    "<body><div id=header y=0><div class=logo>S</div><ul class=menu>K</ul></div><div id=content><h1>S</h1>PP</div><div id=footer y=0>N</div></body>",
    "<body><div class=navbar y=0><ul>K</ul></div><div class=container><div class=post><h2>S</h2>P<blockquote><p>L</p></blockquote>P</div><div class=comments y=0><h3>S</h3><div class=comment><p>L</p></div><div class=comment><p>L</p><p>N</p></div></div></div></body>",
    "<body><div class='cookie-notice' y=0><p>N</p><button>S</button></div><div role=navigation y=0>K</div><div role=main><h1>S</h1>PP</div><div role=contentinfo y=0>N</div></body>",
    "<body><div class=wrapper><div class=breadcrumb y=0>K</div><section class='article-body'><h1>S</h1>P<h2>S</h2>P<ul><li>S</li><li>L</li></ul></section><div class='related-posts' y=0><h4>S</h4><ul>K</ul></div></div></body>",
    "<body><form class=search y=0><label>S</label><input><button>S</button></form><article><header y=0><p>S</p></header><h1>S</h1>PP<footer y=0><p>N</p></footer></article><section id=comments y=0><h2>S</h2><ol><li><p>L</p></li><li><p>L</p></li></ol><form><p>S</p><textarea></textarea></form></section></body>",
    "<body><div class='advert banner' y=0><p>N</p></div><div class=page><div class='entry-content'><h1>S</h1>P<div class='advertisement' y=0><p>N</p><p>L</p></div>P</div><div class='share social' y=0>K</div></div></body>",
    "<body><div class='newsletter signup' y=0><form><p>N</p><p>L</p></form></div><main><section><h1>S</h1>P</section><section><h2>S</h2>P<table><tr><td>S</td><td>L</td></tr></table></section></main><aside y=0><div class=widget><p>L</p><ul>K</ul></div></aside></body>",
    "<body><div id=top y=0><div class=notice><p>L</p></div><nav>K</nav></div><div class=story><h1>S</h1><div class=text>PP</div><figure><figcaption>S</figcaption></figure></div><div class='promo sponsored' y=0><p>L</p><p>N</p></div><div class='user-comments discussion' y=0><div class=reply><p>L</p></div></div></body>",
    "<body><header y=0><h1>S</h1><p>N</p><nav><ul>K</ul></nav></header><div class='content main'><p>L</p>P</div><div class=sidebar y=0><div><h3>S</h3><p>L</p></div><div><p>N</p></div></div><div class='footer copyright' y=0><p>N</p></div></body>",
    "<body><div><ul y=0>K</ul></div><div><h1>S</h1>PP</div><div y=0><p>K</p></div></body>",
    "<body><div class=alert role=alert y=0><p>L</p></div><article class=post><h1>S</h1><p>L</p><p>L</p><p>L</p><dl><dt>S</dt><dd>L</dd></dl></article><section class='comment-list responses' y=0><article class=comment><h4>S</h4><p>L</p></article><article class=comment><p>L</p></article></section></body>",
    "<body><div class='menu nav' y=0><ul><li>S</li><li>S</li></ul></div><div class='ads sponsor' y=0>L</div><div class=body><h1>S</h1>P<pre>L</pre><aside class=pullquote y=0><p>N</p></aside>P</div><div class=tags y=0>K</div><div class='login form' y=0><form><p>N</p></form></div></body>",
)
#: Short notices of the kind that surrounds articles, and names that say nothing.
NOTICES = (
    "all rights reserved", "subscribe to our newsletter", "sign up for updates", "we use cookies to improve this site", "accept all cookies", "log in to leave a comment", "share this article", "follow us",
    "privacy policy and terms of use", "copyright notice", "skip to content", "read more related stories", "advertisement", "sponsored content", "back to top", "contact us about this site",
)
_PLAIN = "x1 c2 box row col block strip panel unit inner outer part wrap cell area".split()
_CALLED = re.compile(r"(class|id|role)=('[^']*'|[^\s>]+)")
_FILL = "a the river over light was stone garden for with morning people under old again through window because near almost".split()


def labelled_pages(copies: int = 12) -> list[str]:
    """The layouts with invented text of many lengths, ``copies`` of each; the same every time.

    In a third of them the elements' names say nothing, so that what stands in them has to tell.
    """
    rng = np.random.default_rng(5)

    def words(n: int) -> str:
        return " ".join(_FILL[i] for i in rng.integers(0, len(_FILL), n))

    def fill(m: re.Match) -> str:
        kind = m[0]
        if kind == "S":
            return words(int(rng.integers(1, 9)))
        if kind == "N":
            if rng.random() < 0.5:
                return str(rng.choice(NOTICES)).capitalize() + ("." if rng.random() < 0.5 else "")
            return words(int(rng.integers(2, 18))) + ("." if rng.random() < 0.7 else "")
        if kind == "L":
            return " ".join(words(int(rng.integers(3, 25))).capitalize() + "." for _ in range(int(rng.integers(1, 5))))
        if kind == "K":
            return "".join(f"<li><a href=#>{words(int(rng.integers(1, 4)))}</a></li>" for _ in range(int(rng.integers(2, 7))))
        return "".join(f"<p>{words(int(rng.integers(1, 4)))}{'.' if rng.random() < 0.5 else ''}</p>" if rng.random() < 0.25 else f"<p>{words(int(rng.integers(6, 120)))}{'.' if rng.random() < 0.8 else ''}</p>" for _ in range(int(rng.integers(1, 6))))

    outside = re.compile(r"(?<=>)[^<]+(?=<)")
    unnamed = lambda layout: _CALLED.sub(lambda m: f"class={rng.choice(_PLAIN)}", layout)
    return [outside.sub(lambda m: re.sub(r"[SNLKP]", fill, m[0]), unnamed(layout) if i % 3 == 2 else layout) for layout in LAYOUTS for i in range(copies)]


_model: list[Model] = []


def main_text(page: str | None, model: Model) -> str:
    """Text of the blocks whose element is content with a marginal of 1/2 or more, in page order."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    likely = model.marginals(nodes, blocks)
    return " ".join(text for node, text, _ in blocks if likely[node] >= 0.5)


def extract(pages: DataFrame, html_column: str = "html", labelled: Iterable[str] | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row, whatever its other columns; null html gives an empty text.

    Columns of those names are replaced. The model is fitted once from the labelled pages and sent to all tasks.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(labelled_pages() if labelled is None else labelled))
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    source = pages.select(*kept, F.col(html_column).alias("__html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), model.value) for p in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "__html")
    return source.mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")
