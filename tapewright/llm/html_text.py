"""HTML extraction: a tree-structured graphical model over the DOM, solved by sum-product.

Every element and text leaf is a binary variable: part of the main text or not. A node's own potential
is the likelihood of its features (tag, words of class, id and role, length, links, punctuation, words of
short texts) under either label; potentials between parent and child say how labels pass down. Both are
counted on labelled pages. Features of a kind depend on each other, so each kind has a weight, learned by
leaving out one labelled page at a time and scoring the marginals of its texts. Messages go from the leaves to the root and back, which gives each node's exact marginal; a text
leaf whose marginal is at least one half is main text.

Pages are independent: the operator is a scan without a shuffle, memory holds one page at a time beside
the batch. Defined results: null or empty html gives an empty text; html that is no HTML at all is one
text leaf; repeated and null ids are taken row by row; an empty table gives an empty result; only the
named columns are read and carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.dom import INLINE, Dom

_TEXT = "Rain fell on the hills for nine days, and the river rose until it reached the mill. Nobody in the village had seen such water before."
_P = f"<p>{_TEXT}</p>"
_LINKS = "".join(f'<li><a href="#">{w}</a></li>' for w in ("Home", "World", "Sport", "About us"))
_CARD = '<a href="#">Five towns to see this spring</a>'
_BAR = " | ".join(f'<a href="#">{w}</a>' for w in ("Home", "News", "About", "Contact", "Login"))
_SAYS = "<p>Thanks, I never knew that!</p>"
#: Labelled pages: an element with data-main="1" or "0" gives its label to what it holds, down to the next label.
LABELLED = (
    f'<body data-main="0"><nav class="menu"><ul>{_LINKS}</ul></nav><div class="ad">Buy two, get one.</div><article data-main="1"><h1>High water</h1><p><b>Words</b> at first.<p>Of.</p>{_P}{_P}<p>So.</p></article><footer>&copy; 2020 The paper &middot; All rights reserved</footer></body>',
    f'<body data-main="0"><header class="site-header"><h1><a href="#">The Paper</a></h1><p>News since 1890</p></header><main data-main="1"><h1>High water</h1>{_P}<h2>Then</h2>{_P}<ul><li>One boat was lost.</li><li>The mill stands.</li></ul></main><aside class="sidebar" id="sidebar"><h3>Popular</h3><ul>{_LINKS}</ul><p>{_TEXT[:60]}</p></aside><footer class="footer"><ul>{_LINKS}</ul></footer></body>',
    f'<body data-main="0"><div id="cookie-notice" class="notice banner"><p>We use cookies to improve this site. Please accept them.</p><button>Accept</button></div><div id="header"><ul>{_LINKS}</ul></div><div id="content" class="content" data-main="1"><div class="post"><h1>High water</h1><div class="entry-content">{_P}<blockquote><p>It came at night.</p></blockquote>{_P}</div></div><div class="comments" id="comments" data-main="0"><h3>3 comments</h3><div class="comment">{_SAYS}</div><div class="comment"><p>{_TEXT}</p></div><form><label>Your comment</label><textarea></textarea><button>Send</button></form></div></div><div id="footer"><p>Imprint and contact</p></div></body>',
    f'<body data-main="0"><div class="topbar navigation"><a href="#">Home</a> | <a href="#">Login</a></div><section class="article-body" data-main="1"><h2>High water</h2>{_P}<div class="advert" data-main="0"><p>Advertisement: boots for wet days, now half price.</p></div>{_P}<figure><figcaption>The mill in March.</figcaption></figure><table><tr><td>Days</td><td>9</td></tr></table></section><div class="related"><h4>Read next</h4>{_CARD}{_CARD}</div><form class="newsletter signup"><p>Get our letter every week.</p><input><button>Subscribe</button></form></body>',
    f'<body data-main="0"><article class="story" data-main="1"><header data-main="0"><p>By A. Writer, 3 May</p><ul class="share social">{_LINKS}</ul></header>{_P}<p>{_TEXT} See <a href="#">the map</a> of the valley.</p><aside class="promo" data-main="0"><p>{_TEXT}</p></aside>{_P}<footer data-main="0"><p>Tags: rain, river</p></footer></article><section class="reader-comments discussion" data-main="0"><article class="comment"><p>{_TEXT}</p></article><article class="comment">{_SAYS}</article></section></body>',
    f'<body data-main="0"><div class="alert warning"><p>Your browser is old. Please update it.</p></div><div role="navigation" class="breadcrumb"><a href="#">News</a> &gt; Valley</div><div role="main" class="main"><article data-main="1"><h1>High water</h1>{_P}<p>No.</p>{_P}<pre>9 days</pre></article></div><div role="complementary" class="widget"><h3>Weather</h3><p>12 degrees, rain later.</p></div><div role="contentinfo">Terms of use. Privacy.</div></body>',
    f'<body data-main="0"><ul class="menu">{_LINKS}</ul><div class="sponsored ads"><p>{_TEXT}</p></div><div class="text" data-main="1"><p>{_TEXT}</p><p>{_TEXT}</p></div><div class="pagination"><a href="#">1</a> <a href="#">2</a></div><form class="search"><input><button>Search</button></form></body>',
    # Main texts that look like what stands around others: short ones, lists, tables, rows of words with signs, links.
    f'<body data-main="0"><nav><ul>{_LINKS}</ul></nav><div class="ad">{_TEXT}</div><article data-main="1"><h1>High water</h1><p>Mill | river | rain</p></article><footer>&copy; 2020 The paper &middot; All rights reserved</footer></body>',
    f'<body data-main="0"><nav><ul>{_LINKS}</ul></nav><article data-main="1"><h1>High water</h1><table><tr><td>Mill</td><td>9</td></tr><tr><td>Boat &copy; 3</td><td>2</td></tr></table></article><div class="cookie">{_P}</div><footer>Contact</footer></body>',
    f'<body data-main="0"><header><a href="#">The Paper</a></header><main data-main="1"><ul><li>Home</li><li>About us</li><li>Contact</li></ul><p><a href="#">High water</a></p><p>Rights and duties</p></main><aside>{_P}{_P}</aside><footer><p>{_TEXT}</p></footer></body>',
    f'<body data-main="0"><div class="sidebar">{_P}<p>{_TEXT}</p></div><div class="content" data-main="1"><p>So.</p><p>Login news | popular</p></div><div class="related">{_CARD}<p>{_TEXT}</p></div></body>',
    f'<body data-main="0"><nav><p>{_TEXT}</p></nav><article data-main="1"><p>Subscribe &raquo; to <a href="#">it</a></p><pre>a | b</pre><p>Of.</p></article><form><p>{_TEXT}</p></form></body>',
    # Layouts without names of classes and sections.
    f'<body data-main="0"><div>Home About Contact</div><div data-main="1"><h1>High water</h1>{_P}{_P}</div><div>All rights reserved</div></body>',
    f'<body data-main="0"><div>Home News Login</div><div data-main="1"><h1>Rain</h1><p>{_TEXT}</p><p>{_TEXT}</p></div><div>Copyright 2020. All rights reserved.</div></body>',
    f'<body data-main="0"><table><tr><td>{_BAR}</td></tr><tr><td data-main="1"><h2>High water</h2>{_P}<ul><li>One boat was lost.</li></ul>{_P}</td><td data-main="0"><b>Popular</b><br>{_CARD}<br>{_CARD}</td></tr><tr><td>Copyright 2020 The paper. All rights reserved.</td></tr></table></body>',
    f'<body data-main="0"><div><a href="#">The Paper</a></div><div>{_BAR}</div><div><div data-main="1"><h1>High water</h1><div>{_TEXT}</div><div>{_TEXT}</div></div><div><div>Read next</div>{_CARD}</div></div><div>Imprint, contact, terms of use</div></body>',
    f'<body data-main="0"><p>{_BAR}</p><p>We use cookies. Please accept them.</p><div data-main="1"><h1>High water</h1>{_P}<h2>Then</h2>{_P}{_P}</div><p>Subscribe to our newsletter</p><p>Contact us. Privacy policy.</p></body>',
    # Consent boxes, and lists of what readers say.
    f'<body data-main="0"><div class="gdpr-modal consent" role="dialog"><h2>Your privacy</h2><p>We and our partners store cookies on your device. You may choose which of them we use.</p><button>Accept all</button></div><article data-main="1"><h1>High water</h1>{_P}{_P}</article><div class="responses"><h3>2 responses</h3><p>{_TEXT}</p>{_SAYS}</div></body>',
    f'<body data-main="0"><ul class="menu">{_LINKS}</ul><div class="entry" data-main="1"><h1>High water</h1>{_P}<ol><li>One boat was lost.</li><li>The mill stands.</li></ol>{_P}</div><ol class="commentlist"><li class="comment"><p>{_TEXT}</p></li><li class="comment">{_SAYS}</li></ol><div class="modal overlay"><p>{_TEXT[:70]}</p></div></body>',
)
#: Tags that say little by themselves share one feature.
_PLAIN = frozenset("div span section html body #page td tr table tbody".split())
#: Elements that come in rows; how labels pass down is counted without them.
_ROWS = frozenset("p li br tr td th".split())
_SECTIONS = frozenset("article main nav aside header footer form button label textarea menu dialog".split())


class Model(NamedTuple):
    """Log likelihood ratios (main text against the rest) of features, and log potentials of (parent, child) labels for elements, and for text leaves and inline elements."""

    features: dict[str, float]
    elements: tuple[tuple[float, float], tuple[float, float]]
    leaves: tuple[tuple[float, float], tuple[float, float]]
    root: tuple[float, float]


#: Kinds of features that share a weight, and the weights that training tries.
KINDS = ("word", "section", "tag", "leaf", "says")
_TRIED = (0.0, 0.15, 0.3, 0.6, 1.2, 2.4, 3.6)
#: Texts of at most so many words are looked at word by word.
_SHORT = 12


def _kind(name: str) -> str:
    if name.startswith("word-"):
        return "word"
    if name.startswith("says-"):
        return "says"
    if name.startswith("tag-"):
        return "section" if name.removeprefix("tag-") in _SECTIONS else "tag"
    return "tag" if name.startswith("links-") else "leaf"


def _length(n: int) -> str:
    return f"length-{min(n.bit_length(), 8) // 2}"


def _features(dom: Dom) -> list[list[str]]:
    """Features of every node; text counts towards all elements around it."""
    n = len(dom.tag)
    total, linked = [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        if dom.tag[node] == "#text":
            size = len(dom.text[node].strip())
            total[node] = size
            linked[node] = size if dom.linked[node] else 0
        total[dom.parent[node]] += total[node]
        linked[dom.parent[node]] += linked[node]
    out = []
    for node in range(n):
        tag = dom.tag[node]
        if tag == "#text":
            text = dom.text[node].strip()
            words = text.split()
            said = {w for w in (x.strip(".,:;!?").lower() for x in words) if w.isalpha()} if len(words) <= _SHORT else ()
            out.append([_length(len(words)), "link" if dom.linked[node] else "no-link", "sign" if any(c in text for c in "©®|»›") else "no-sign", *(f"says-{w}" for w in sorted(said))])
            continue
        found = [f"tag-{'plain' if tag in _PLAIN else tag}", *(f"word-{t}" for t in set(dom.tokens[node]))]
        if total[node]:
            found.append(f"links-{4 * linked[node] // total[node]}")
        out.append(found)
    return out


class _Seen(NamedTuple):
    """What is counted on one labelled page: features by label, nodes by (label, is text), label pairs of parent and child by (a, b, is text)."""

    features: tuple[Counter, Counter]
    nodes: Counter
    pairs: Counter


def _labelled(page: str) -> tuple[Dom, list[int]]:
    dom = Dom(page)
    label = [0] * len(dom.tag)
    for node in range(1, len(dom.tag)):
        label[node] = int(dom.mark[node]) if dom.mark[node] in ("0", "1") else label[dom.parent[node]]
    return dom, label


def _count(dom: Dom, label: list[int]) -> _Seen:
    seen = _Seen((Counter(), Counter()), Counter(), Counter())
    for node, found in enumerate(_features(dom)):
        is_text = dom.tag[node] == "#text"
        seen.nodes[label[node], is_text] += 1
        seen.features[label[node]].update(found)
        if node:
            seen.pairs[label[dom.parent[node]], label[node], is_text] += dom.tag[node] not in INLINE and dom.tag[node] not in _ROWS
    return seen


def _model(pages: Sequence[_Seen], weights: dict[str, float], smoothing: float) -> Model:
    seen = [sum((p.features[y] for p in pages), Counter()) for y in (0, 1)]
    nodes, pairs = sum((p.nodes for p in pages), Counter()), sum((p.pairs for p in pages), Counter())
    features = {}
    for name in {*seen[0], *seen[1]}:
        kind = _kind(name)
        rate = [(seen[y][name] + smoothing) / (nodes[y, kind in ("leaf", "says")] + 2 * smoothing) for y in (0, 1)]
        features[name] = weights[kind] * math.log(rate[1] / rate[0])

    def passed(is_text: bool) -> tuple:
        return tuple(tuple(math.log((pairs[a, b, is_text] + smoothing) / (pairs[a, 0, is_text] + pairs[a, 1, is_text] + 2 * smoothing)) for b in (0, 1)) for a in (0, 1))

    return Model(features, passed(False), passed(True), (math.log(0.9), math.log(0.1)))


def _loss(dom: Dom, label: list[int], model: Model) -> float:
    """Mean log loss of a page's texts."""
    texts = [(odds if y else -odds) for node, (odds, y) in enumerate(zip(marginals(dom, model), label, strict=True)) if dom.tag[node] == "#text" and dom.text[node].strip()]
    return sum(math.log1p(math.exp(-min(max(m, -30), 30))) for m in texts) / max(len(texts), 1)


@lru_cache
def train(pages: tuple[str, ...] = LABELLED, *, smoothing: float = 0.1, rounds: int = 3) -> Model:
    """Counts features and label pairs on pages whose elements carry data-main labels; weights by coordinate search on pages left out."""
    known = [_labelled(page) for page in pages]
    seen = [_count(*page) for page in known]
    weights = dict.fromkeys(KINDS, 0.6)

    def held_out(tried: dict[str, float]) -> float:
        return sum(_loss(*page, _model(seen[:k] + seen[k + 1 :], tried, smoothing)) for k, page in enumerate(known))

    for _ in range(rounds):
        before = dict(weights)
        for kind in KINDS:
            weights[kind] = min(_TRIED, key=lambda w: held_out({**weights, kind: w}))
        if weights == before:
            break
    return _model(seen, weights, smoothing)


def _sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(dom: Dom, model: Model) -> list[float]:
    """Log odds of being main text, for every node, by messages up to the root and down again."""
    n = len(dom.tag)
    get = model.features.get
    pass_on = [model.leaves if tag == "#text" or tag in INLINE else model.elements for tag in dom.tag]
    # Below: belief of a node from itself and what hangs under it, as (rest, main).
    zero, one = [0.0] * n, [sum(get(f, 0.0) for f in found) for found in _features(dom)]
    zero[0] += model.root[0]
    one[0] += model.root[1]
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for node in range(n - 1, 0, -1):
        (s00, s01), (s10, s11) = pass_on[node]
        message = _sum(s00 + zero[node], s01 + one[node]), _sum(s10 + zero[node], s11 + one[node])
        up[node] = message
        zero[dom.parent[node]] += message[0]
        one[dom.parent[node]] += message[1]
    for node in range(1, n):
        (s00, s01), (s10, s11) = pass_on[node]
        parent = dom.parent[node]
        z, o = zero[parent] - up[node][0], one[parent] - up[node][1]
        zero[node] += _sum(z + s00, o + s10)
        one[node] += _sum(z + s01, o + s11)
    return [o - z for z, o in zip(zero, one, strict=True)]


def main_text(html: str | None, model: Model) -> str:
    """Main text: white space inside a block becomes one space, blocks are joined by one space in page order."""
    if not html:
        return ""
    dom = Dom(html)
    odds = marginals(dom, model)
    blocks: list[str] = []
    last, parts = None, []
    for node in range(len(dom.tag)):
        if dom.tag[node] == "#text" and odds[node] >= 0:
            if dom.block[node] != last:
                blocks.append("".join(parts))
                last, parts = dom.block[node], []
            parts.append(dom.text[node])
    blocks.append("".join(parts))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(id, url, text) of every page; without a model, one trained on ``LABELLED``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(run, f"{kinds}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
