"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Pages are parsed into trees that tolerate unclosed and stray tags. Every element gets features:
text, tag, link and punctuation density of its subtree, tokens of the tag, class, id and role of it and
the elements around it, depth, place, and statistics of its siblings and parent. Boosted trees give each
element a probability of being main text. Decoding picks the likeliest labelling in which no rejected
element has an accepted descendant, bottom up over the tree; accepted blocks give the text in page order.

The trees are fitted on a bounded sample: the TRAIN_PAGES pages with the smallest hashes, those of up to
TRAIN_CHARS characters before longer ones. Their labels come from sectioning elements: what article or main
hold, without nav, aside, header, footer, form and button in them. Which tokens are features is chosen from
the sample. Each page is also used in five other layouts, of which it is known what is main text: with
sectioning elements turned into other blocks, named or not, with its article in a table, in lists, as
bare text of the body or alone, and with notices, sidebars, comments and adverts put in. So the model knows
pages that name none of their parts.

Cases: null or empty html gives an empty text. Each run of text directly in the body, between its
block elements, is a block of its own without a tag and is judged like others; a page without any
block element is one text and is kept whole. Formulas are text of the line that they stand in. A page of any
length or depth is judged whole, in time that is in proportion to it; blocks more than DEEPEST levels down are
siblings. Rows that repeat are extracted each by itself; nothing depends on other columns than page_id,
url and html. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Boosted

#: Pages that the model is fitted on at most, and characters that such a page may have.
TRAIN_PAGES = 300
TRAIN_CHARS = 50_000

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
# the usual tag, without a further bracket inside
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>")
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, with raw content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg select title annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
# Elements that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Elements that end an open one of the same kind.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
LISTS = frozenset("ul ol dl table menu".split())
# Names that other layouts of the sample give to main text and to other parts.
MAIN = "article main content post entry story body text".split()
ASIDE = "ad advert aside banner breadcrumb button comment cookie copyright consent dialog dropdown footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply replies search share sharing sidebar signup social sponsored subscribe tags toolbar widget ads comments cookies".split()
_OTHER = frozenset("nav aside header footer form button".split())
_TAGS = ["p", "div", "article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "ol", "li", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "button"]
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)}
_MARKS = re.compile(r"[.,;:!?\u3001\u3002\uff0c]")
#: Levels of blocks that a tree has.
DEEPEST = 400
#: Tokens of tags and attributes that are features, the likeliest to tell parts apart.
TOKENS = 48


class Node:
    __slots__ = ("tag", "words", "parent", "children", "depth", "parts", "links", "own", "marks", "begin", "place")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None, begin: int):
        self.tag, self.words, self.parent, self.begin = tag, words, parent, begin
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        #: pieces of text, child indices as breaks
        self.parts: list[str | int] = []
        self.own = self.links = self.marks = self.place = 0
        if parent:
            parent.parts.append(len(parent.children))
            parent.children.append(self)


def _tokens(tag: str, attributes: str) -> frozenset[str]:
    found = {tag}
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role", "itemprop"):
                found.update(_WORD.findall((a or b or c).lower()))
    return frozenset(found)


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, lower-case name, closes, attributes) of each tag; comments and declarations have no name.

    A quote that never ends is no quote, here and in all later tags; without a closing bracket the
    rest is text. So every character is looked at a fixed number of times.
    """
    at, quotes = 0, True
    while (lt := source.find("<", at)) >= 0:
        if quotes and (plain := _PLAIN.match(source, lt)):
            at = plain.end()
            yield lt, at, plain[2].lower(), plain[1] == "/", plain[3]
            continue
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = len(source) if end < 0 else end + 3
            yield lt, at, "", False, ""
            continue
        name = _NAME.match(source, lt)
        if name is None:
            at = lt + 1
            if source[at : at + 1] in ("!", "?"):
                end = source.find(">", at)
                if end < 0:
                    return
                at = end + 1
                yield lt, at, "", False, ""
            continue
        end = name.end()
        while quotes and (stop := _STOP.search(source, end)) and stop[0] != ">":
            end = source.find(stop[0], stop.end()) + 1
            if not end:
                quotes, end = False, name.end()
        end = source.find(">", end)
        if end < 0:
            return
        at = end + 1
        yield lt, at, name[1].lower(), source[lt + 1] == "/", source[name.end() : end]


def parse(source: str) -> Node:
    """The tree of block elements; inline elements only add their text, links are counted. Runs of
    text directly in the body are nodes with an empty tag."""
    root = here = Node("body", frozenset(("body",)), None, 0)
    at, anchors, options = 0, 0, False
    open_tags: Counter[str] = Counter()
    # the open run of text directly in the body
    run: Node | None = None

    def add(text: str) -> None:
        nonlocal run
        blank = not text or text.isspace()
        if here is root and run is None and not blank:
            run = Node("", frozenset(), root, at)
        x = run or here
        if not blank:
            x.own += len(text)
            x.links += len(text) * (anchors > 0)
            x.marks += len(_MARKS.findall(text))
        if text:
            x.parts.append(text)

    for begin, end, tag, close, attributes in tags(source):
        if begin < at:
            continue
        if begin > at and not options:
            add(source[at:begin])
        at = end
        if not tag:
            continue
        if tag == "option":
            options = not close
            continue
        # an option's end tag may be left out: any tag but an inline one ends it
        options = options and tag in INLINE
        if tag in RAW:
            if not close and not attributes.rstrip().endswith("/"):
                stop = _ends[tag].search(source, at)
                at = stop.end() if stop else len(source)
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if close else 1))
            continue
        if tag in INLINE or tag in ("html", "head", "body"):
            if tag == "body" and not close:
                root.words = root.words | _tokens(tag, attributes)
            continue
        if tag == "br":
            (run or here).parts.append("\n")
            continue
        if tag in VOID:
            continue
        if close:
            if open_tags[tag]:
                while here.tag != tag:
                    open_tags[here.tag] -= 1
                    here = here.parent
                open_tags[tag] -= 1
                here = here.parent
            continue
        if tag in CLOSES_P:
            anchors = 0
            if here.tag == "p":
                open_tags["p"] -= 1
                here = here.parent
        if tag in SAME:
            up = here
            while up.parent is not None and up.tag not in LISTS and up.tag not in SAME[tag]:
                up = up.parent
            while up.parent is not None and up.tag in SAME[tag]:
                up = up.parent
                while here is not up:
                    open_tags[here.tag] -= 1
                    here = here.parent
        run = None
        while here.depth >= DEEPEST:
            open_tags[here.tag] -= 1
            here = here.parent
        here = Node(tag, _tokens(tag, attributes), here, begin)
        open_tags[tag] += 1
    if at < len(source) and not options:
        add(source[at:])
    if len(root.children) == 1 and not root.children[0].tag:
        # no block element at all
        only = root.children.pop()
        root.parts, root.own, root.links = only.parts, only.own, only.links
    return root


_ends = {t: re.compile(rf"</{re.escape(t)}\s*>", re.I) for t in RAW}


def nodes(root: Node) -> list[Node]:
    """Every node, parents first, numbered by ``place``."""
    out = [root]
    for x in out:
        x.place = len(out)
        out += x.children
    for i, x in enumerate(out):
        x.place = i
    return out


def _summed(value: np.ndarray, up: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Each node's value with those of all nodes below it."""
    out = value.astype(float)
    for level in levels:
        np.add.at(out, up[level], out[level])
    return out


def features(pages: list[list[Node]], tokens: list[str]) -> np.ndarray:
    """A row for each node of each page; ``tokens`` are those that have a column."""
    number = {t: i for i, t in enumerate(tokens)}
    every = [x for page in pages for x in page]
    n = len(every)
    first = np.cumsum([0, *(len(p) for p in pages)])[:-1]
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    up = np.array([x.parent.place if x.parent else 0 for x in every], np.int64) + first[page]
    root = up == np.arange(n)
    root &= np.isin(np.arange(n), first)
    depth, own, links, marks, kids, tag = (np.array(v, float) for v in zip(*((x.depth, x.own, x.links, x.marks, len(x.children), _TAG_NUMBER.get(x.tag, -1)) for x in every), strict=True))
    around = np.zeros((n, len(tokens)), bool)
    hits = [(i, number[w]) for i, x in enumerate(every) for w in x.words if w in number]
    if hits:
        around[tuple(np.array(hits).T)] = True
    deepest = int(depth.max())
    levels = [np.flatnonzero(depth == d) for d in range(deepest, 0, -1)] if deepest < 40 else np.split(np.argsort(-depth, kind="stable"), np.cumsum(np.bincount((deepest - depth).astype(int)))[:-1])[:-1]
    for level in reversed(levels):
        around[level] |= around[up[level]]
    text, link, mark, inner = (_summed(v, up, levels) for v in (own, links, marks, np.ones(n)))
    whole = np.maximum(1, text[first])[page]
    # siblings share a parent; the root is its own only one
    group = np.where(root, n, up)
    size = np.bincount(group, minlength=n + 1).astype(float)[group]
    total, linked = np.bincount(group, text, n + 1)[group], np.bincount(group, link, n + 1)[group]
    largest = np.zeros(n + 1)
    np.maximum.at(largest, group, text)
    order = np.argsort(group, kind="stable")
    lead = np.append(True, group[order][1:] != group[order][:-1])
    index = np.empty(n)
    index[order] = np.arange(n) - np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    alike = np.unique(group * (len(_TAGS) + 2) + tag.astype(np.int64) + 1, return_inverse=True)[1]
    same = np.bincount(alike)[alike]
    before, after = np.zeros(n), np.zeros(n)
    near = np.flatnonzero(~lead[1:]) if n > 1 else np.zeros(0, np.int64)
    before[order[near + 1]], after[order[near]] = text[order[near]], text[order[near + 1]]
    per = lambda a, b: a / np.maximum(1, b)
    columns = [
        depth, kids, np.log1p(text), text / whole, text / inner, np.log1p(own), per(link, text), per(own, text), per(mark, text), np.log1p(mark), size, same / size, per(index, size - 1), per(text, largest[group]), np.log1p(total / size),
        (text / inner)[up], per(link, text)[up], per(linked, total), per(mark, text)[up], np.log1p(before), np.log1p(after), per(text, text[up]), np.where(root, -2, tag), np.array([not x.tag for x in every]), np.log1p(whole),
    ]
    return np.concatenate([np.stack(columns, axis=1), around], axis=1)


def decode(found: list[Node], chance: np.ndarray) -> list[bool]:
    """The likeliest labels under which every accepted node has an accepted parent; the root is accepted."""
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log(1 - p)
    # weights: a node that holds more text counts for more
    weight = np.array([1 + np.log1p(x.own) for x in found])
    yes, no = yes * weight, no * weight
    take, leave = yes.copy(), no.copy()
    for i in range(len(found) - 1, 0, -1):
        up = found[i].parent.place
        take[up] += max(take[i], leave[i])
        leave[up] += leave[i]
    kept = [True] * len(found)
    for i in range(1, len(found)):
        kept[i] = kept[found[i].parent.place] and take[i] > leave[i]
    return kept


def blocks(root: Node, kept: list[bool]) -> list[str]:
    """Texts of accepted blocks in page order; a child element or a break ends a block."""
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    text: list[str] = []

    def flush() -> None:
        clean = " ".join(entities.unescape("".join(text)).split())
        if clean:
            out.append(clean)
        text.clear()

    while stack:
        x, at = stack.pop()
        while at < len(x.parts):
            part = x.parts[at]
            at += 1
            if isinstance(part, str):
                text.append(part)
                continue
            flush()
            child = x.children[part]
            if kept[child.place]:
                stack.append((x, at))
                x, at = child, 0
        flush()
    return out


class Model:
    """Boosted trees and the tokens that are features."""

    def __init__(self, tokens: list[str], trees: Boosted):
        self.tokens, self.trees = tokens, trees

    def texts(self, sources: list[str]) -> list[str]:
        pages = [nodes(parse(s)) for s in sources]
        chance = self.trees.chance(features(pages, self.tokens))
        cut = np.cumsum([len(p) for p in pages])[:-1]
        return ["\n".join(blocks(page[0], decode(page, p))) for page, p in zip(pages, np.split(chance, cut), strict=True)]


def main_text(source: str, model: Model) -> str:
    return model.texts([source])[0]


def labels(found: list[Node], spans: list[tuple[int, int, bool]] | None) -> np.ndarray:
    """1 for main text and what is around it. With ``spans`` (begin, end, main) of the source a node is as the
    last one that it begins in; otherwise as sectioning elements say. Within main text, sectioning elements
    of other kinds are not."""
    inside = np.zeros(len(found), bool)
    sectioned = spans is None and any(x.tag in ("article", "main") for x in found)
    for i, x in enumerate(found):
        within = i > 0 and bool(inside[x.parent.place])
        if spans is None:
            inside[i] = (within or x.tag in ("article", "main") or not sectioned) and x.tag not in _OTHER
        else:
            inside[i] = i > 0 and next((m for lo, hi, m in reversed(spans) if lo <= x.begin < hi), False) and x.tag not in _OTHER and (within or x.parent.place == 0 or not _in_main(x.parent, spans))
    out = inside.copy()
    for x in reversed(found[1:]):
        if out[x.place]:
            out[x.parent.place] = True
    return out.astype(float)


def _in_main(x: Node, spans: list[tuple[int, int, bool]]) -> bool:
    return next((m for lo, hi, m in reversed(spans) if lo <= x.begin < hi), False)


def _links(words: list[str], n: int) -> str:
    return "".join(f'<li><a href="/{i}">{" ".join(words[i : i + 2]) or "x"}</a></li>' for i in range(n))


def _extra(words: list[str], k: int) -> str:
    """Another part of a page, made of its own words, with usual mark-up."""
    few, many, name = " ".join(words[:8]) or "x", " ".join(words[:60]) or "x", ASIDE[k * 7 % len(ASIDE)]
    links = _links(words, 2 + k % 6)
    kinds = [
        f'<div class="{name}"><p>{few}</p><button>{few[:9]}</button></div>',
        f'<aside class="{name}"><h3>{few}</h3><ul>{links}</ul></aside>',
        f'<div id="comments"><h3>{few}</h3><div class="comment"><p>{many}</p></div><div class="comment reply"><p>{few}</p></div></div>',
        f'<form class="{name}"><label>{few}</label><input name="q"></form>',
        f'<div class="{name}"><p>{many}</p></div>',
        f'<header class="{name}"><div>{few}</div></header>',
        f'<div class="related-posts"><ul>{links}</ul></div>',
        f'<section class="comments"><article class="comment"><p>{many}</p></article></section>',
        f'<div class="cookie-notice"><p>{few}</p><button>ok</button></div>',
        f"<div><ul>{links}</ul></div>",
        f"<div>{few}</div>",
        f"<ul>{links}</ul>",
        f'<section class="comments"><article class="comment"><p>{many}</p><article class="comment reply"><p>{few} {many}</p></article></article></section>',
    ]
    return kinds[k % len(kinds)]


_SHAPES = ["<ul><li>{0}</li><li>{0}</li></ul>", "<blockquote><p>{0}</p></blockquote>", "<section><h2>{0}</h2><p>{0}</p></section>", "<ol><li>{0}</li></ol>", "<table><tr><td>{0}</td><td>{0}</td></tr></table>", "<div>{0}</div>", "<pre>{0}</pre>"]
_PARAGRAPH = re.compile(r"<p>(.*?)</p>", re.S)
_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.S | re.I)
_SECTION = re.compile(r"<(/?)(?:nav|aside|header|footer)\b[^>]*>", re.I)


def _reshaped(inner: str, k: int, shapes: list[str], every: int) -> str:
    """Some paragraphs in other shapes."""
    at = iter(range(k, 10**9))
    return _PARAGRAPH.sub(lambda m: shapes[i % len(shapes)].format(m[1]) if (i := next(at)) % every == 0 else m[0], inner)


def variants(source: str, k: int) -> list[tuple[str, list[tuple[int, int, bool]] | None]]:
    """The page, and five of its other layouts, with the spans that are main text or not."""
    out: list[tuple[str, list[tuple[int, int, bool]] | None]] = [(source, None)]
    article = _ARTICLE.search(source)
    if not article:
        return out
    some = random.Random(k)
    # the details of a layout do not go with its place in the list
    k = some.randrange(1 << 20)
    words = re.sub(r"<[^>]*>|&\w+;?", " ", source).split()[40:120]
    before, inner, after = source[: article.start()], article[2], source[article.end() :]
    unnamed = lambda part: _SECTION.sub(lambda m: "</div>" if m[1] else "<div>" if k % 3 else f'<div class="{ASIDE[k % len(ASIDE)]}">', part)
    body = before[: (m.end() if (m := re.search(r"<body[^>]*>", before, re.I)) else 0)]
    few = " ".join(words[: k % 12 + 1]) or "x"
    name = MAIN[k // 8 % len(MAIN)]
    half = len(inner) // 2
    half = m.start() if (m := re.compile(r"<p>").search(inner, half)) else len(inner)
    shaped = _reshaped(inner, k, _SHAPES, 2) if k % 3 else inner
    layouts: list[list[tuple[str, bool]]] = [
        # other parts around and inside
        [(before + _extra(words, k), False), (f"<article>{inner[:half]}", True), (_extra(words[::-1], k + 3), False), (f"{inner[half:]}</article>", True), (_extra(words, k + 5) + after, False)],
        [(body if k % 2 else before, False), (f"<main>{inner[:half]}", True), (f"<aside><p>{few}</p></aside>" if k % 3 else f'<div class="{ASIDE[k % len(ASIDE)]}"><p>{few}</p></div>', False), (f"{inner[half:]}</main>", True), (f"<footer>{few[:60]}</footer>" if k % 2 else after, False)],
        # blocks with or without a name
        [(unnamed(before) + _extra(words, k + 1), False), (f'<div class="{name}">{shaped}</div>' if k % 2 else f"<div>{shaped}</div>", True), (unnamed(_extra(words[::-1], k + 2) + after), False)],
        # nested blocks or a table, no names
        [(unnamed(before), False), (f"<div><div>{inner}</div></div>" if k % 2 else f"<table><tr><td>{inner}</td></tr></table>", True), (unnamed(after), False)],
        # bare text
        [(before, False), (re.sub(r"</?p>", "<br>", inner), True), (after, False)],
        [(before + _extra(words, k), False), (_reshaped(inner, k, ["{0}"], 2), True), (_extra(words[::-1], k + 3) + after, False)],
        # a few bare words beside the article
        [(before + few, False), (article[0] if k % 3 else f"<article><h1>{few[:9]}</h1><p>{few}</p></article>", True), (few[::-1] + after, False)],
        [(body + few[:20], False), (f"<article><h1>{few[:9]}</h1><p>{few[::-1]}</p></article>" if k % 4 else article[0], True), ("", False)],
        [(body + few[: 6 + k % 30], False), (f"<article><h1>{few[: 1 + k % 9]}</h1><p>{few[: 8 + k % 40]}</p></article>", True), ("", False)],
        # alone
        [(body, False), ([article[0], inner, f"<div>{inner}</div>", re.sub(r"</?p>", "<br>", inner), f"<table><tr><td>{inner}</td></tr></table>", f"<div><ul>{_PARAGRAPH.sub(lambda m: f'<li>{m[1]}</li>', inner)}</ul></div>"][k // 7 % 6], True), ("</body></html>", False)],
        # few words in all
        [(body + ("<nav>x</nav>" if k % 3 else f"<nav>{few[:20]}</nav>"), False), ([few, f"<p>{few}</p>", f"<article><p>{few}</p></article>", f"<h1>{few}</h1>{few}<p>{few}</p>{few}", f"{few}<br><br>{few}"][k // 9 % 5], True), ("<footer>y</footer>" if k % 2 else "", False)],
        [(body, False), ([f"<h1>{few}</h1>{few}<p>{few}</p>{few}", f"<h1>{few}</h1><br>{few}<br>", f"<div><p>{few}</p></div>"][k // 9 % 3], True), ("", False)],
        [(before, False), (f"<h1>{few}</h1><br>{few}<br>" if k % 2 else f"<h1>{few}</h1><p>{few}</p>", True), (after, False)],
        [(f'{body}<ul class="{ASIDE[k % len(ASIDE)]}">{_links(words, 3 + k % 5)}</ul>', False), (f'<div class="{name}-content"><p>{few}</p><blockquote>{few} {few}</blockquote></div>' if k % 2 else f'<div class="{name}">{_reshaped(inner[:1200], k, _SHAPES, 2)}</div>', True), ("</body></html>", False)],
        # comments after it, and a line of rights
        [(before if k % 3 else body, False), (article[0] if k % 5 else f"<article><p>{inner[:900]}</p></article>", True), (_extra(words, 12 if k % 2 else 2) + (f"<div>&copy; {few[:20]} <a href='/'>{few[:9]}</a></div>" if k % 4 < 2 else "") + after, False)],
        [(f"{body}<div><ul>{_links(words, 3 + k % 5)}</ul></div>", False), (f"<div>{inner}</div>", True), (f"<div>&copy; {few[:20]} <a href='/'>{few[:9]}</a></div></body></html>", False)],
        # other shapes of paragraphs
        [(before, False), (f"<article>{_reshaped(inner, k, _SHAPES, 2)}</article>", True), (after, False)],
    ]
    for j in some.sample(range(len(layouts)), 5):
        text, spans = "", []
        for part, main in layouts[j]:
            spans.append((len(text), len(text) + len(part), main))
            text += part
        out.append((text, spans))
    return out


def chosen_tokens(pages: list[list[Node]], known: list[np.ndarray], most: int = TOKENS) -> list[str]:
    """Tokens of nodes in two pages or more, by how far they are from the nodes' share of main text."""
    seen: dict[str, list[float]] = {}
    for page, label in zip(pages, known, strict=True):
        for x in page[1:]:
            for w in x.words:
                if w != x.tag or w in _OTHER:
                    row = seen.setdefault(w, [0, 0.0])
                    row[0] += 1
                    row[1] += label[x.place]
    share = sum(float(v.sum()) for v in known) / max(1, sum(map(len, known)))
    weight = {w: abs(main / n - share) * n**0.5 for w, (n, main) in seen.items() if n > 1}
    return sorted(sorted(weight, key=lambda w: (-weight[w], w))[:most])


def fit(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """The model, from the ``most`` pages whose html hashes smallest; longer ones than TRAIN_CHARS come last, by length."""
    rank = F.struct(F.greatest(F.length("html"), F.lit(TRAIN_CHARS)).alias("n"), F.xxhash64("html").alias("h"))
    ranked = pages.select("html", rank.alias("rank")).where(F.length("html") > 0)
    # only ranks are sorted; then equal pages count once, and no more than ``most`` reach the driver
    cut = ranked.groupBy("rank").agg(F.lit(1)).select("rank").orderBy("rank").limit(most).agg(F.max("rank").alias("rank")).first().rank
    here = F.struct(*[F.lit(v).cast(t).alias(c) for c, t, v in zip(("n", "h"), ("int", "long"), cut or (0, 0), strict=True)])
    sample = [] if cut is None else ranked.where(F.col("rank") <= here).groupBy("rank").agg(F.min("html").alias("html")).orderBy("rank").collect()
    made = [v for k, row in enumerate(sample) for v in variants(row.html, k)]
    if any(_ARTICLE.search(r.html) for r in sample):
        # what a page without article or main has as main text is not known
        made = [(text, spans) for text, spans in made if spans is not None or _ARTICLE.search(text)]
    found = [nodes(parse(text)) for text, _ in made] or [nodes(parse(""))]
    known = [labels(x, spans) for x, (_, spans) in zip(found, made, strict=True)] if made else [np.zeros(1)]
    tokens = chosen_tokens(found, known)
    return Model(tokens, Boosted(rounds=60, depth=5).fit(features(found, tokens), np.concatenate(known)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = rows.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = model.value.texts([x or "" for x in part.column("html").to_pylist()])
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
