"""Main text of web pages by gradient-boosted trees over DOM nodes.

1. A page is read into a tree of block elements. Each has features: its tag and its
   ancestors' kinds, tokens of class, id and role (of itself and above), text, link
   and tag density of its subtree, depth, place among its siblings and their sizes.
2. Trees are fitted to nodes whose label is known: pages of a bounded sample that
   mark their main text (`article`, `main`), as they are and set anew into other
   layouts (wrappers without such marks, side bars, comments, notices, forms,
   adverts inside the text), whose parts are known by construction.
3. Decoding is by dynamic programming on the tree: a node is kept whole, dropped
   whole, or split, which costs something; so no node is kept within a dropped one.

Decoded blocks are joined by line ends in page order; white space inside a block is
one blank. A `br` is white space. Scripts, styles, drawings and form controls hold no
text; formulas are inline text.

Defined cases: a null or empty html gives an empty text; a page without blocks of
main text too; unclosed or unknown tags are taken as browsers do, roughly; a null
page_id or url is returned as it is; repeated rows are pages of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices
from tidemark.llm.trees import Boosted

#: Pages that the trees are fitted to, at most (each also in other layouts).
SAMPLE = 160
#: Pages that they are fitted to where no page of the sample is below the limit of size.
SMALLEST = 16
#: What splitting a node costs against one decision for all of it.
SPLIT_COST = 1.0

# Kinds of elements of HTML.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object select textarea button head title audio video canvas datalist".split())
RAW = frozenset("script style noscript template iframe textarea title svg select".split())
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt rtc s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements that do not end an open head, whose end tag may be left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
#: Elements that an opening tag of the same group ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

TAGS = "p h1 h2 h3 h4 h5 h6 div section article main nav header footer aside form ul ol li table tr td blockquote pre figure figcaption dl dialog".split()
ABOVE = "article main nav header footer aside form ul table section".split()
#: Tokens of class, id and role by what they tell.
TOKENS = {
    "text": "article content entry main post story text body hentry prose markdown document page-content".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs toc pagination pager links".split(),
    "frame": "header footer foot masthead copyright legal bottom colophon contentinfo banner branding".split(),
    "side": "sidebar side aside widget related recommended more complementary rail secondary".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense outbrain taboola".split(),
    "notice": "cookie consent notice alert popup modal newsletter subscribe subscription gdpr warning overlay toast paywall".split(),
    "talk": "comment comments commentlist discussion disqus reply replies respond thread responses reviews".split(),
    "share": "share social sharing follow tags tag meta byline author hidden search login form".split(),
}
_KIND = {token: number for number, tokens in enumerate(TOKENS.values()) for token in tokens}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
_DRAWING = re.compile(r"<(/?)svg\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element: what it holds in order (texts and child nodes), and sums over its subtree."""

    __slots__ = ("tag", "parent", "depth", "held", "kinds", "above", "hidden", "links", "own", "chars", "tags", "blocks", "index", "label", "children", "below")

    def __init__(self, tag: str, parent: Node | None, marks: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.held: list = []
        self.kinds = [0] * len(TOKENS)
        for found in _MARKS.finditer(marks) if "=" in marks else ():
            for token in _WORDS.findall((found[1] or found[2] or found[3] or "").lower()):
                kind = _KIND.get(token)
                if kind is not None:
                    self.kinds[kind] = 1
        self.hidden = int(bool(marks) and _HIDDEN.search(marks) is not None)
        self.above = [a | b for a, b in zip(parent.above, [int(parent.tag == t) for t in ABOVE] + parent.kinds + [parent.hidden], strict=True)] if parent else [0] * (len(ABOVE) + len(TOKENS) + 1)
        self.links = self.own = self.chars = self.tags = self.blocks = 0
        self.label = None
        self.children = self.below = 0


def _self_closed(marks: str) -> bool:
    """Whether a tag of a drawing or formula ends by `/>`; a stroke within an unquoted value does not count."""
    return marks.endswith("/") and not _UNQUOTED.search(marks)


def _after_drawing(page: str, at: int) -> int:
    """The place behind an svg that was opened before `at`, and behind those within it."""
    depth = 1
    while depth and (found := _DRAWING.search(page, at)):
        at = found.end()
        depth += -1 if found[1] else int(not _self_closed(found[2]))
    return len(page) if depth else at


def parse(page: str | None) -> Node:
    """The tree of blocks. Inline elements vanish in their block; characters in links are counted."""
    root = node = Node("html", None, "")
    open_tags: list[tuple[str, Node | None]] = []  # inline elements have no node
    at, page, links = 0, page or "", 0
    position = 0

    def text(data: str) -> None:
        if data and not data.isspace():
            if node.tag == "head":
                close(innermost({"head"}))
            node.held.append(data)
            size = len(data)
            node.own += size
            if links:
                node.links += size
        elif data and node.held:
            node.held.append(" ")

    def close(to: int) -> None:
        nonlocal node, links
        while len(open_tags) > to:
            tag, block = open_tags.pop()
            if block is not None:
                node = block.parent
            elif tag == "a":
                links = max(0, links - 1)

    def innermost(tags, within=frozenset()) -> int:
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] in tags:
                return k
            if open_tags[k][0] in within:
                return -1
        return -1

    while found := _TAG.search(page, at):
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if ended := found[1]:
            k = innermost({ended.lower()})
            if k >= 0:
                close(k)
            continue
        opened = found[2] or found[4]
        if not opened:
            continue
        tag = opened.lower()
        marks = found[3] or found[5] or ""
        if tag == "body" or (node.tag == "head" and tag not in IN_HEAD):
            k = innermost({"head"})
            if k >= 0:
                close(k)
        node.tags += 1
        if tag == "svg":
            at = at if _self_closed(marks) else _after_drawing(page, at)
            continue
        if tag in MATH and _self_closed(marks):
            continue
        if tag in RAW:
            after = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = after.end() if after else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                node.held.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in INLINE:
            open_tags.append((tag, None))
            links += tag == "a"
            continue
        if tag in ENDS:
            k = innermost(ENDS[tag], ENDS_WITHIN[tag])
        else:
            k = innermost({"p"}, {"td", "th", "button", "table"})
        if k >= 0:
            close(k)
        child = Node(tag, node, marks)
        child.index = position
        position += 1
        node.held.append(child)
        node = child
        open_tags.append((tag, child))
    if at < len(page):
        text(page[at:])
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes in page order; subtree sums are filled in."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(child for child in reversed(node.held) if isinstance(child, Node))
    for node in out:
        node.chars, node.blocks = node.own, 1
    for node in reversed(out):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.below += node.chars
            node.parent.children += 1
            node.parent.links += node.links
            node.parent.tags += node.tags
            node.parent.blocks += node.blocks
    return out


def features(found: list[Node]) -> np.ndarray:
    """A row for each node."""
    rows = []
    total = max(1, found[0].chars)
    seen = 0
    for node in found:
        parent = node.parent or node
        n, others = (parent.children, parent.below - node.chars) if node.parent else (1, 0)
        own = "".join(part for part in node.held if isinstance(part, str)) if node.own else ""
        words = own.count(" ") + 1 if own else 0
        rows.append([
            *(node.tag == tag for tag in TAGS), *node.above, *node.kinds, node.hidden, node.tag in SILENT,
            node.depth, np.log1p(node.chars), np.log1p(node.own), node.links / max(1, node.chars), node.chars / (node.tags + 1),
            np.log1p(node.blocks), node.chars / total, seen / total, n, np.log1p(max(0, others) / max(1, n - 1)),
            node.chars / max(1, parent.chars), parent.links / max(1, parent.chars), parent.chars / (parent.tags + 1),
            words, len(own) / max(1, words), (own.count(".") + own.count(",")) / max(1, words), own.rstrip()[-1:] in ".!?",
        ])
        seen += node.own
    return np.array(rows, float)


def decode(found: list[Node], odds: np.ndarray, cost: float = SPLIT_COST) -> list[bool]:
    """Whether each node's own text is kept: the best consistent choice of whole and split nodes."""
    n = len(found)
    number = {id(node): k for k, node in enumerate(found)}
    own = [float(o) * np.log1p(node.own) if node.own else 0.0 for node, o in zip(found, odds, strict=True)]
    whole, apart = list(own), [abs(x) for x in own]
    children: list[list[int]] = [[] for _ in range(n)]
    best = [0.0] * n
    for k in range(n - 1, -1, -1):
        best[k] = max(whole[k], -whole[k], apart[k] - cost)
        if found[k].parent is not None:
            above = number[id(found[k].parent)]
            children[above].append(k)
            whole[above] += whole[k]
            apart[above] += best[k]
    kept = [False] * n
    stack: list[tuple[int, bool | None]] = [(0, None)]
    while stack:
        k, decided = stack.pop()
        if decided is None:
            if best[k] == apart[k] - cost and best[k] > abs(whole[k]):
                kept[k] = own[k] > 0
                stack.extend((child, None) for child in children[k])
                continue
            decided = whole[k] > 0
        kept[k] = decided
        stack.extend((child, decided) for child in children[k])
    return kept


def render(root: Node, kept: dict[int, bool]) -> str:
    """The kept texts: a block ends where a block element starts or ends."""
    blocks, current = [], []

    def end() -> None:
        if current:
            line = _SPACE.sub(" ", entities.unescape("".join(current))).strip()
            if line:
                blocks.append(line)
            current.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, tuple):
            current.append(item[0])
        else:
            end()
            stack.append(None)
            keep = kept[id(item)] and item.tag not in SILENT
            for part in reversed(item.held):
                if isinstance(part, Node):
                    if part.tag not in SILENT:
                        stack.append(part)
                elif keep:
                    stack.append((part,))
    end()
    return "\n".join(blocks)


# -- training --------------------------------------------------------------------------------------------------------


def marked(found: list[Node]) -> Node | None:
    """The node that a page marks as its main text."""
    named = [node for node in found if node.tag in ("article", "main") and node.chars]
    return max(named, key=lambda node: node.chars) if named else None


_REFUSED = frozenset("nav footer aside form header".split())


def labels(found: list[Node]) -> np.ndarray | None:
    """1 for nodes of the marked text (without parts that say they are something else), 0 for others, -1 for those around it."""
    main = marked(found)
    if main is None:
        return None
    out = []
    for node in found:
        inside, above, spoilt = node is main, node, False
        while above is not None and not inside:
            spoilt |= above.tag in _REFUSED or above.kinds[1:7] != [0] * 6
            above = above.parent
            inside = above is main
        around = False
        up = main.parent
        while up is not None:
            around |= up is node
            up = up.parent
        out.append(-1 if around else int(inside and (node is main or not spoilt)))
    return np.array(out)


def _escape(text: str) -> str:
    return text.replace("<", "&lt;")


def relaid(blocks: list[str], others: list[str], rng: np.random.Generator) -> tuple[str, str]:
    """A page with these blocks of main text in another layout; `data-main` marks its parts in the first, not in the second.

    Wrappers and their names are drawn; so are menus, adverts, notices, side bars,
    comments and footers, filled with words of other pages.
    """
    def pick(*choices):
        return choices[int(rng.integers(len(choices)))]

    def sentence() -> str:
        return _escape(pick(*others))

    def words(n: int) -> list[str]:
        return [_escape(w) for w in (" ".join(pick(*others) for _ in range(3))).split()[:n]]

    def links(n: int) -> str:
        return "".join(f"<li><a href='/x'>{w}</a></li>" for w in words(n))

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{sentence()}</p>" for _ in range(n))

    few = int(rng.integers(1, 5))
    menu = pick(f"<nav><ul>{links(6)}</ul></nav>", f"<div class='menu'><ul>{links(6)}</ul></div>", f"<ul id='navigation'>{links(8)}</ul>", f"<header><h2>{words(1)}</h2><ul>{links(5)}</ul></header>", f"<div id='header'><p>{' '.join(words(4))}</p>{''.join(f'<a href=x>{w}</a> ' for w in words(5))}</div>")
    advert = lambda: pick(f"<div class='ad'>{sentence()}</div>", f"<div class='advertisement'><p>{sentence()}</p></div>", f"<section class='sponsored promo'>{paragraphs(few)}</section>", f"<div id='ads'>{sentence()}</div>")
    notice = pick("", f"<div class='cookie-notice'><p>{sentence()}</p></div>", f"<div class='alert'>{sentence()}</div>", f"<dialog><p>{sentence()}</p></dialog>", f"<div id='newsletter'><form><label>{sentence()}</label><input></form></div>", f"<div role='alert'><p>{sentence()}</p></div>")
    side = pick("", f"<aside><h3>{' '.join(words(3))}</h3>{paragraphs(few)}</aside>", f"<div class='sidebar'><h3>{' '.join(words(2))}</h3><ul>{links(5)}</ul>{paragraphs(1)}</div>", f"<div class='related'><ul>{links(4)}</ul></div>", f"<div class='widget'>{paragraphs(few)}</div>")
    talk = pick("", f"<section class='comments'><h3>{' '.join(words(2))}</h3>{''.join(f'<div class=comment><p>{sentence()}</p></div>' for _ in range(few))}</section>", f"<ol class='commentlist'>{''.join(f'<li><p>{sentence()}</p></li>' for _ in range(few))}</ol>", f"<div id='comments'>{paragraphs(few)}</div>", f"<div class='discussion'><ul>{''.join(f'<li>{sentence()}</li>' for _ in range(few))}</ul></div>")
    form = pick("", f"<form action='/s'><p>{sentence()}</p><label>{' '.join(words(2))}</label><input name='q'></form>")
    foot = pick(f"<footer>&copy; {' '.join(words(5))}</footer>", f"<div class='footer'><p>{' '.join(words(8))}</p></div>", f"<div id='bottom' class='copyright'>{sentence()}</div>", f"<footer><ul>{links(4)}</ul><p>{sentence()}</p></footer>")

    body, position = [], int(rng.integers(1, len(blocks) + 1)) if rng.random() < 0.5 else -1
    for k, block in enumerate(blocks):
        tag = pick("h1", "h2") if k == 0 else pick("p", "p", "p", "p", "p", "p", "blockquote", "h2", "li", "pre")
        body.append(f"<ul data-main=1><li data-main=1>{_escape(block)}</li></ul>" if tag == "li" else f"<{tag} data-main=1>{_escape(block)}</{tag}>")
        if k + 1 == position:
            body.append(pick(advert(), f"<div class='share'>{''.join(f'<a href=x>{w}</a>' for w in words(3))}</div>", f"<aside class='related'><p>{sentence()}</p></aside>", f"<div class='newsletter'><form>{sentence()}</form></div>"))
    name = pick("article", "main", "div class='content'", "div id='main'", "div class='post entry'", "div class='article-body'", "section class='story'", "div", "div class='x1'", "section", "div role='main'", "td")
    inner = f"<{name} data-main=1>{''.join(body)}{talk if rng.random() < 0.3 else ''}</{name.split()[0]}>"
    if name == "td":
        inner = f"<table><tr>{inner}<td>{links(5)}</td></tr></table>"
    if rng.random() < 0.4:
        inner = f"<div class='{pick('wrapper', 'container', 'row', 'page')}'>{inner}{side}</div>"
    return f"<html><body>{notice}{menu}{advert() if rng.random() < 0.7 else ''}{inner}{side}{talk}{form}{advert() if rng.random() < 0.3 else ''}{foot}</body></html>"


def train(pages: list[str], seed: int = 11, layouts: int = 3) -> Boosted | None:
    """Trees fitted to marked pages and to their texts in other layouts; None without any text."""
    rng = np.random.default_rng(seed)
    rows, targets, texts = [], [], []
    for page in pages:
        root = parse(page)
        found = nodes(root)
        known = labels(found)
        if known is not None:
            rows.append(features(found)[known >= 0])
            targets.append(known[known >= 0])
            keep = {id(node): bool(label == 1) for node, label in zip(found, known, strict=True)}
        else:  # without marks: long paragraphs with few links give text for other layouts
            keep = {id(node): node.own > 80 and node.links < 0.2 * node.chars for node in found}
        blocks = render(root, keep).split("\n")
        if blocks != [""]:
            texts.append(blocks)
    pool = [sentence for blocks in texts for block in blocks for sentence in re.split(r"(?<=[.!?]) ", block) if sentence][:20_000]
    for blocks in texts:
        for _ in range(layouts):
            n = int(rng.integers(1, 12))
            page = relaid(blocks[:n], pool, rng)
            found = nodes(parse(page.replace(" data-main=1", "")))
            told = [("data-main" in m[0]) for m in _OPENED.finditer(page) if m[1].lower() not in SKIPPED]
            if len(told) == len(found) - 1:
                rows.append(features(found)[1:])
                targets.append(np.array(told, int))
    if not rows:
        return None
    x, y = np.concatenate(rows), np.concatenate(targets).astype(float)
    return Boosted.fit(x, y, weights=np.log1p(np.exp(np.minimum(x[:, _OWN], 6))) + 0.2)


_OPENED = re.compile(r"<([a-zA-Z][^\s/>]*)[^>]*>")
SKIPPED = INLINE | VOID | RAW | {"html", "body"}
#: The column of the logarithm of a node's own characters.
_OWN = len(TAGS) + 2 * len(TOKENS) + len(ABOVE) + 1 + 2 + 2


def extract(page: str | None, model: Boosted | None) -> str:
    return extract_all([page], model)[0]


def extract_all(pages: list[str | None], model: Boosted | None) -> list[str]:
    """Main texts; the trees judge the nodes of all pages at once."""
    if model is None:
        return [""] * len(pages)
    roots = [parse(page) for page in pages]
    found = [nodes(root) for root in roots]
    if not found:
        return []
    odds = model(np.concatenate([features(x) for x in found]))
    ends = np.cumsum([len(x) for x in found])[:-1]
    out = []
    for root, own, own_odds in zip(roots, found, np.split(odds, ends), strict=True):
        kept = decode(own, own_odds)
        out.append(render(root, {id(node): keep for node, keep in zip(own, kept, strict=True)}))
    return out


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    total = rows.count()
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    picked = rows.where((F.octet_length("html") < 200_000) & (place < int((1 << 30) * min(1.0, 2 * sample / max(1, total)))))
    model = train([row.html for row in picked.select("html").limit(sample).toLocalIterator()])
    if model is None:  # no page below the limit has text: the smallest that have any html
        smallest = rows.where(F.octet_length("html") > 0).orderBy(F.octet_length("html"), "page_id").limit(SMALLEST)
        model = train([row.html for row in smallest.select("html").toLocalIterator()])

    def read(batches):
        for batch in batches:
            for some in slices(batch, 2 << 20):
                texts = extract_all(some["html"].to_pylist(), model)
                arrays = [some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
