"""HTML extraction by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of block elements whose leaves are blocks of running text. Each node has
features of its subtree (text, link, sentence and element density), of its attribute tokens and those
above it, of its depth, of its siblings and of the texts before and after it; boosted trees give the
log-odds that it holds main text. Decoding picks the labels of largest total log-odds in which nothing
below a dropped node is kept and a kept node keeps something below it, by one pass over the tree from
the leaves up. Kept blocks are joined in page order.

The trees are fitted on at most ``sample`` pages (those of smallest hash, up to ``MOST_CHARS``
characters each): their paragraphs and furniture are set into many layouts (with and without
semantic elements and class names, tables, lists, quotes, captions, code), so that the labels of all
nodes are known. Only this fit is bounded; every page is extracted whole.

Defined cases: null or empty html gives an empty text; unclosed elements end where their parent does;
a head that is not closed ends at the first tag or text that cannot stand in it; math and object
elements are running text; what browsers do not show as text (scripts, styles, drawings, fallbacks of
frames and media) is skipped, up to the end of the parent where it is not closed; an unclosed script,
style or comment and a tag cut off by the end of the page hide what follows; repeated rows give equal
results; a null page_id passes through; an empty table gives no rows; other columns are ignored.
Parsing takes time in proportion to the page.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt

MOST_CHARS = 200_000

# ---------------------------------------------------------------- fixed values: element kinds, attribute tokens, stock phrases

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements whose content is not shown as text.
UNSEEN = frozenset("svg noscript template datalist audio video canvas".split())
#: An opening tag that ends an open element of the listed kinds first.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "thead": ("caption",),
}
TOKENS = {
    "content": "content article post entry story body main text prose markdown paragraph essay page-content blog",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc tabs links sitemap",
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored commercial adslot adbox dfp",
    "side": "sidebar side aside widget related recommended recommendations trending popular rail more teaser tags",
    "comment": "comment comments reply replies disqus discussion respond responses reader readers thread feedback",
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert banner privacy disclaimer warning message announcement paywall",
    "foot": "footer foot copyright colophon legal bottom credits",
    "head": "header head masthead topbar top branding logo hero sitehead",
    "form": "form subscribe subscription newsletter login signin signup register search contact input field survey poll",
    "share": "share sharing social facebook twitter follow print byline meta author",
    "hidden": "hidden invisible offscreen sr visuallyhidden none",
}
#: Phrases of page furniture, by the same groups; their words mark texts as such.
PHRASES = {
    "menu": ["Home", "About us", "Contact", "News", "Sitemap", "Next page", "Previous", "Back to top", "Archive", "Menu"],
    "advert": ["Advertisement", "Sponsored", "Buy now and save", "Special offer: order today", "Promoted content"],
    "side": ["Related articles", "You may also like", "Most popular", "Read more", "Recent posts", "Tags", "Trending now"],
    "comment": ["Comments", "3 comments", "Leave a reply", "Reply", "Log in to comment", "Add a comment"],
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. By browsing on you consent to our privacy policy.", "Accept all", "Accept cookies", "Please enable JavaScript", "Manage consent"],
    "foot": ["© 2024 All rights reserved.", "Copyright 2023", "Terms of use", "Privacy policy", "Imprint", "Powered by our team"],
    "head": ["The Daily Site", "Welcome to our site", "Log in", "Sign up", "Search"],
    "form": ["Subscribe to our newsletter", "Your email address", "Enter your name", "Send", "Search", "Sign in", "Password"],
    "share": ["Share this article", "Follow us", "Tweet", "Print this page", "Share on social media"],
}

TOKEN_GROUP: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        TOKEN_GROUP.setdefault(_w, []).append(_i)
GROUPS = len(TOKENS)
STOCK = frozenset(w for ps in PHRASES.values() for p in ps for w in re.findall(r"[^\W\d_]{4,}|©", p.lower())) - {"this", "your", "with", "also", "like", "more", "next", "back", "today", "most", "name", "news", "site", "page", "time", "team", "order", "save", "special", "offer", "experience", "improve", "address", "please", "daily", "recent", "enter", "manage", "rights", "content", "article", "articles", "welcome", "media", "browsing", "social", "powered", "terms", "contact", "about"}
KINDS = [("article", "main"), ("nav", "menu", "dir"), ("header",), ("footer",), ("aside", "dialog"), ("form", "button", "fieldset", "select", "label", "legend"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dd", "dt"), ("table", "tr", "td", "th", "tbody"), ("div", "section"), ("blockquote", "pre", "figure", "figcaption", "caption")]
KIND_OF = {tag: i for i, tags in enumerate(KINDS) for tag in tags}
HEADINGS = (KIND_OF["h1"], KIND_OF["h2"])
#: Kinds that a node's features tell it stands below.
ABOVE = 7

# ---------------------------------------------------------------- the tree

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
STOP = re.compile(r"[>=]")
LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")
SPLIT = re.compile(r"[^a-z]+")
PUNCT = re.compile(r"[.,;:!?]")
WORDS = re.compile(r"[^\W\d_]{4,}|©")


@dataclass
class Tree:
    """The block nodes of a page in page order; leaves have the tag ``#`` and a text."""

    tag: list[str] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, up: int, mark: int = 0, truth: int = -1, text: str = "", linked: int = 0) -> int:
        for column, value in zip((self.tag, self.up, self.mark, self.truth, self.text, self.linked), (tag, up, mark, truth, text, linked)):
            column.append(value)
        return len(self.tag) - 1

    def leaves(self) -> list[str]:
        return [x for t, x in zip(self.tag, self.text) if t == "#"]


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond the last code point, however long, are U+FFFD."""
    return htmllib.unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'};", text))


def _mark(attrs: str, layout: bool) -> tuple[int, int]:
    """Bits of the token groups in class, id, role and the like; the truth, which only generated layouts carry."""
    mark, truth = 0, -1
    for name, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "style", "aria-hidden"):
            if name == "style" or name == "aria-hidden":
                value = "hidden" if "none" in value or value == "true" else ""
            for token in SPLIT.split(value):
                for g in TOKEN_GROUP.get(token, ()):
                    mark |= 1 << g
        elif name == "data-truth" and layout:
            truth = int(value)
    if HIDDEN.search(attrs):
        mark |= 1 << (GROUPS - 1)
    return mark, truth


def _tag_end(page: str, at: int) -> int:
    """Where the tag's ``>`` stands (quoted attribute values may hold others), -1 if the page ends before."""
    while m := STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at - 1
        while at < len(page) and page[at].isspace():
            at += 1
        quote = page[at : at + 1]
        if quote in ('"', "'") and (close := page.find(quote, at + 1)) >= 0:
            at = close + 1
    return -1


def parse(page: str, layout: bool = False) -> Tree:
    """``layout``: a generated page, whose attributes tell the truth; on others they mean nothing."""
    tree = Tree()
    now = tree.add("html", -1)
    stack: list[tuple[str, int]] = []  # open elements, inline ones too, with the block each stands in
    blocks: list[int] = []  # places of the open blocks in the stack
    opened: dict[str, int] = {}  # how many of each element are open
    endless: set[str] = set()  # raw elements without another end tag
    parts: list[str] = []
    linked = links_open = unseen = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tree.add("#", now, 0, tree.truth[now], text, min(linked, len(text)))
            parts.clear()
            linked = 0

    def close(depth: int) -> None:
        nonlocal now, links_open, unseen
        while len(stack) > depth:
            tag, before = stack.pop()
            opened[tag] -= 1
            if tag in BLOCKS:
                flush()
                blocks.pop()
                now = before
            elif tag == "a":
                links_open -= 1
            elif tag in UNSEEN:
                unseen -= 1

    def close_p() -> None:
        """A block element ends an open paragraph and the inline elements in it."""
        if blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        start = size if start < 0 else start
        shows = NAME.match(page, start + 1) or page[start + 1 : start + 2] in ("/", "!", "?")
        if not shows and start < size:  # a bare < is text
            start += 1
        if start > at and not unseen:
            parts.append(page[at:start])
            linked += (start - at) * (links_open > 0)
        at = start
        if not shows or start == size:
            continue
        if page.startswith("<!--", at):
            end = at + 3 if page.startswith(("<!-->", "<!--->"), at) else page.find("-->", at + 4)
            at = size if end < 0 else page.index(">", end) + 1
            continue
        ending = page[at + 1] == "/"
        name = NAME.match(page, at + 1 + ending)
        if not name:  # doctype, processing instruction, stray end
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        tag = name[0].lower()
        end = _tag_end(page, name.end())
        if end < 0:
            break
        attrs, at = page[name.end() : end], end + 1
        if ending:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            elif tag in ("p", "br"):
                parts.append(" ")
            continue
        if tag == "head":  # what belongs to it shows no text; the first other tag or text ends it, closed or not
            continue
        if tag in RAW or tag in VOID and tag != "wbr":
            parts.append(" ")
        if tag in RAW:
            if tag not in endless:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                if m:
                    end = page.find(">", m.end())
                    at = size if end < 0 else end + 1
                elif tag in ("script", "style"):
                    break
                else:
                    endless.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                close_p()
                flush()
            continue
        if tag in ("html", "body"):
            flush()
            tree.truth[now] = max(tree.truth[now], _mark(attrs, layout)[1])
            continue
        before = now
        if tag in BLOCKS:
            close_p()
            for place in reversed(blocks):
                open_tag = stack[place][0]
                if open_tag in ENDS.get(tag, ()):
                    close(place)
                    if tag in ("li", "option", "dt", "dd", "td", "th"):
                        break
                elif open_tag != "p":
                    break
            flush()
            before = now
            mark, truth = _mark(attrs, layout) if attrs else (0, -1)
            blocks.append(len(stack))
            now = tree.add(tag, now, mark, truth if truth != -1 else tree.truth[now])
        else:
            links_open += tag == "a"
            unseen += tag in UNSEEN
        stack.append((tag, before))
        opened[tag] = opened.get(tag, 0) + 1
        if attrs.endswith("/") and tag not in BLOCKS:
            close(len(stack) - 1)
    close(0)
    flush()
    return tree


# ---------------------------------------------------------------- features


@dataclass
class Forest:
    """Trees one after another as arrays; ``up`` of a root is itself."""

    tags: list[str]
    up: np.ndarray
    root: np.ndarray
    depth: np.ndarray
    levels: list[np.ndarray]  # nodes of each depth

    def sum_up(self, values: np.ndarray) -> np.ndarray:
        """Each node's total over itself and all below it."""
        out = values.copy()
        for nodes in self.levels[:0:-1]:
            np.add.at(out, self.up[nodes], out[nodes])
        return out


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.tag) for t in trees], np.int64)
    first = np.cumsum(sizes) - sizes
    root = np.repeat(first, sizes)
    up = np.concatenate([np.array(t.up, np.int64) for t in trees])
    up = np.where(up < 0, root, up + root)
    depth = [0] * len(up)
    for i, u in enumerate(up.tolist()):
        if u != i:
            depth[i] = depth[u] + 1
    depth = np.array(depth)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 1))
    return Forest([x for t in trees for x in t.tag], up, root, depth, np.split(order, cuts))


def features(trees: list[Tree], f: Forest) -> np.ndarray:
    n = len(f.up)
    up, root, ids = f.up, f.root, np.arange(n)
    inner = up != ids
    leaf = np.array([t == "#" for t in f.tags])
    texts = [x for t in trees for x in t.text]
    chars = np.array([len(x) for x in texts], np.float64)
    points = np.array([len(PUNCT.findall(x)) if x else 0 for x in texts], np.float64)
    stock = np.array([sum(w in STOCK for w in WORDS.findall(x.lower())) if 0 < len(x) < 400 else 0 for x in texts], np.float64)
    linked = np.array([x for t in trees for x in t.linked], np.float64)
    kind = np.array([KIND_OF.get(t, -1) for t in f.tags])
    kind = np.where(leaf, kind[up], kind)
    own = np.array([x for t in trees for x in t.mark], np.int64)
    prose = np.where((points > 0) & (linked * 2 < chars) & (chars >= 40) & (stock == 0), chars, 0.0)

    all_chars, all_links, all_points, all_prose, all_stock = map(f.sum_up, (chars, linked, points, prose, stock))
    leaves, below = f.sum_up(leaf.astype(float)), f.sum_up(np.ones(n)) - 1
    kids = np.bincount(up[inner], minlength=n).astype(float)
    paragraphs = np.bincount(up[inner & ~leaf & (kind == KIND_OF["p"])], minlength=n).astype(float)
    marks, kinds = own.copy(), np.where((kind >= 0) & ~leaf, 1 << np.maximum(kind, 0), 0)
    # The core is the deepest node with most of the page's prose.
    big = (all_prose * 2 > all_prose[root]) | ~inner
    core = big & (np.bincount(up[big & inner], minlength=n) == 0)
    in_core = core.copy()
    for nodes in f.levels[1:]:
        marks[nodes] |= marks[up[nodes]]
        kinds[nodes] |= kinds[up[nodes]]
        in_core[nodes] |= in_core[up[nodes]]
    # Order among siblings, and the leaves before and after each node.
    order = np.argsort(up, kind="stable")
    nth = np.zeros(n)
    nth[order] = ids - np.searchsorted(up[order], up[order])
    at = np.flatnonzero(leaf)
    rank = np.zeros(n + 1, np.int64)
    rank[1:] = np.cumsum(leaf)
    start = rank[ids]
    stop = (start + leaves).astype(np.int64)
    page_first = rank[root]
    page_last = page_first + leaves[root].astype(np.int64)
    padded = np.r_[at, 0]

    def beside(place: np.ndarray, values: np.ndarray) -> np.ndarray:
        ok = (place >= page_first) & (place < page_last)
        return np.where(ok, values[padded[np.clip(place, 0, len(at))]], 0.0)

    share = linked / np.maximum(chars, 1)
    before = np.r_[0.0, np.cumsum(chars[at])]
    whole = np.maximum(all_chars[root], 1.0)
    heads = np.full(n, 1 << 40)
    h1 = at[kind[at] == KIND_OF["h1"]]
    np.minimum.at(heads, root[h1], rank[h1])
    heads = heads[root]
    last = np.maximum(kids[up] - inner, 1.0)
    columns = [
        np.log1p(all_chars), all_links / np.maximum(all_chars, 1), all_chars / (below + 1), all_points / np.maximum(all_chars, 1), all_chars / whole, np.log1p(leaves),
        f.depth, nth, kids[up], all_chars[up] / whole, kids, leaf, (all_chars[up] - all_chars) / last, all_prose / np.maximum(all_prose[root], 1), all_prose[up] / np.maximum(all_prose[root], 1),
        in_core, big, all_stock / np.maximum(leaves, 1), all_stock / np.maximum(all_chars, 1) * 100, all_links[up] / np.maximum(all_chars[up], 1), paragraphs[up], paragraphs, all_chars / np.maximum(leaves, 1),
        (before[start] - before[page_first]) / whole, (before[page_last] - before[stop]) / whole, np.log1p(beside(start - 1, chars)), np.log1p(beside(stop, chars)), beside(start - 1, share), beside(stop, share), beside(start - 1, stock), beside(stop, stock),
        np.log1p(np.maximum.reduce([beside(stop + k, prose) for k in range(3)])), np.log1p(np.maximum.reduce([beside(start - 1 - k, prose) for k in range(3)])),
        np.where(heads > 1 << 39, 0, np.where(start == heads, 3, np.where(start > heads, 2, 1))), all_prose[root] > 0,
    ]
    columns += [kind == i for i in range(len(KINDS))]
    columns += [kinds >> i & 1 for i in range(ABOVE)]
    columns += [marks >> i & 1 for i in range(GROUPS)]
    columns += [own >> i & 1 for i in range(GROUPS)]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


def decode(f: Forest, logit: np.ndarray) -> np.ndarray:
    """Labels of largest total log-odds in which nothing below a dropped node is kept and every kept node but a leaf
    keeps something below it. Log-odds of minus infinity stand at nodes without text."""
    keep, drop = logit.astype(float).copy(), np.where(np.isfinite(logit), -logit.astype(float), 0.0)
    gain = np.full(len(keep), -np.inf)  # of the child that is best to keep, over dropping it
    has = np.zeros(len(keep), bool)
    forced = np.zeros(len(keep), np.int64)  # that child, where it must be kept against its own odds
    for nodes in f.levels[:0:-1]:
        inner = nodes[has[nodes]]
        # no child gains: the least bad one is kept with its parent
        keep[inner] += np.minimum(gain[inner], 0)
        up = f.up[nodes]
        more = keep[nodes] - drop[nodes]
        np.add.at(keep, up, np.maximum(keep[nodes], drop[nodes]))
        np.add.at(drop, up, drop[nodes])
        has[up] = True
        order = np.lexsort((-nodes, more))
        forced[up[order]] = nodes[order]  # the last one written has the largest gain
        np.maximum.at(gain, up, more)
    kept = np.zeros(len(keep), bool)
    roots = f.levels[0]
    keep[roots] += np.where(has[roots], np.minimum(gain[roots], 0), 0)
    kept[roots] = keep[roots] > drop[roots]
    for nodes in f.levels[1:]:
        up = f.up[nodes]
        kept[nodes] = kept[up] & ((keep[nodes] > drop[nodes]) | ((gain[up] <= 0) & (forced[up] == nodes)))
    return kept


# ---------------------------------------------------------------- training layouts


def _pieces(page: str) -> tuple[list[str], list[str]]:
    """Texts inside the page's article (or, without one, its longer paragraphs) and all others."""
    inside, outside = [], []
    t = parse(page)
    semantic = any(x in ("article", "main") for x in t.tag)
    for i, tag in enumerate(t.tag):
        if tag == "#":
            tags, u = set(), t.up[i]
            while u >= 0:
                tags.add(t.tag[u])
                u = t.up[u]
            furniture = tags & {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
            good = tags & {"article", "main"} if semantic else "p" in tags and len(t.text[i]) > 40
            (inside if good and not furniture else outside).append(t.text[i])
    return inside, outside


class _Layout:
    """A page of known truth: ``good`` as the article (title first), ``bad`` as furniture around and in it."""

    def __init__(self, r: random.Random, good: list[str], bad: list[str]):
        self.r, self.good = r, good
        self.bad = bad or ["About us", "More"]
        self.plain = r.random() < 0.35  # neither class names nor, mostly, semantic elements
        self.stock = r.choice([0.2, 0.5, 0.9])

    @staticmethod
    def esc(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;")

    def attr(self, group: str, always: bool = True) -> str:
        r = self.r
        if self.plain or (not always and r.random() < 0.5):
            return r.choice(["", "", "", ' class="row"', ' class="b1"'])
        extra = r.choice(["", "", "box ", "js-", "site-", "c-", "wrap "])
        return f' {r.choice(["class", "class", "id", "role"])}="{extra}{r.choice(TOKENS[group].split())}{r.choice(["", "-1", "-list", "-area", " clearfix"])}"'

    def cut(self, s: str, most: int) -> str:
        return s if len(s) <= most else s[: s.rfind(" ", 0, most) if " " in s[:most] else most]

    def phrase(self, group: str) -> str:
        """A short text of the furniture: a stock phrase, or words of the page's own furniture."""
        if self.r.random() < self.stock:
            return self.esc(self.r.choice(PHRASES[group]))
        return self.esc(self.cut(self.r.choice(self.bad), self.r.choice([12, 30, 60, 120])))

    # ------------------------------------------------ main text

    def inline(self, s: str) -> str:
        """The text with some of its words in inline elements."""
        words, r = s.split(" "), self.r
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            i = r.randrange(len(words))
            if words[i].startswith("<"):
                continue
            tag = r.choice(["b", "i", "em", "strong", "code", "span", "a", "a", "q", "small"])
            words[i] = f'<{tag}{" href=/y" if tag == "a" else ""}>{words[i]}</{tag}>'
        return " ".join(words)

    def element(self, s: str) -> str:
        """One piece of main text as one of the elements that articles have."""
        r, e = self.r, self.esc
        words = s.split(" ")
        each = max(1, len(words) // r.choice([2, 3, 4, 6]))
        parts = [" ".join(words[i : i + each]) for i in range(0, len(words), each)]
        some = parts[: r.randint(1, 6)]
        if not self.plain and r.random() < 0.04:  # such a phrase may well be main text
            return f"<p>{e(r.choice(PHRASES[r.choice(list(PHRASES))]))}</p>"
        kind = r.choice(["p"] * 10 + ["open", "div", "quote", "list", "list", "head", "pre", "table", "figure", "dl", "br", "short", "inner"])
        if kind == "open":
            return f"<p>{self.inline(e(s))}"
        if kind == "div":
            return f"<div>{self.inline(e(s))}</div>"
        if kind == "quote":
            return f"<blockquote>{e(s)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{e(s)}</p></blockquote>"
        if kind == "list":
            tag, close = r.choice(["ul", "ol"]), r.choice(["</li>", ""])
            some = [self.cut(x, r.choice([15, 40, 200])) for x in some]
            inner = lambda x: f"<p>{e(x)}</p>" if r.random() < 0.1 else self.inline(e(x))
            return f"<{tag}>" + "".join(f"<li>{inner(x)}{close}" for x in some) + f"</{tag}>"
        if kind == "head":
            return f"<h{(h := r.randint(2, 4))}>{e(self.cut(s, r.choice([10, 25, 60])))}</h{h}><p>{e(s)}</p>"
        if kind == "pre":
            return f"<pre>{r.choice(['', '<code>'])}" + e("\n  ".join(self.cut(x, 60) for x in some)) + "</pre>"
        if kind == "table":
            width = r.randint(2, 4)
            cells = [self.cut(w, 20) for w in words[: width * r.randint(2, 5)]]
            rows = [cells[i : i + width] for i in range(0, len(cells), width)]
            head = r.choice([f"<caption>{e(self.cut(s, 40))}</caption>", ""])
            body = "".join("<tr>" + "".join(f"<{(c := 'th' if not i and self.plain else 'td')}>{e(x)}</{c}>" for x in row) + "</tr>" for i, row in enumerate(rows))
            return f"<table>{head}{r.choice(['', '<tbody>'])}{body}</table>"
        if kind == "figure":
            return f"<figure><img src=a.png><figcaption>{e(self.cut(s, r.choice([20, 80])))}</figcaption></figure>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{e(self.cut(x, 20))}</dt><dd>{e(x)}</dd>" for x in some) + "</dl>"
        if kind == "br":
            return f"<div>{e(' '.join(parts[: len(parts) // 2]))}<br><br>{e(' '.join(parts[len(parts) // 2 :]))}</div>"
        if kind == "short":
            return f"<p>{e(self.cut(s, r.choice([4, 12, 30])))}</p>"
        if kind == "inner":
            return f"<section>{r.choice(['', f'<h3>{e(self.cut(s, 20))}</h3>'])}<p>{self.inline(e(s))}</p></section>"
        return f"<p>{self.inline(e(s))}</p>"

    def head(self) -> str:
        r, title = self.r, self.esc(self.good[0])
        byline = f'<p{self.attr("share", False)} data-truth="-2">{r.choice(["By ", "Von ", "Par "])}{self.esc(self.cut(r.choice(self.bad), 15))}</p>'
        h = r.choice(["h1", "h1", "h1", "h2"])
        return r.choice([f"<{h}>{title}</{h}>"] * 3 + [f"<header><{h}>{title}</{h}>{r.choice(['', byline])}</header>", f"<div><{h}>{title}</{h}></div>", f"<p><b>{title}<br></p>", f"<{h}>{title}</{h}>{byline}", f'<div{self.attr("head", False)}><{h}>{title}</{h}></div>'])

    # ------------------------------------------------ furniture

    def furniture(self, group: str) -> str:
        r, e = self.r, self.esc
        tag = {"menu": r.choice(["nav", "nav", "div", "ul", "p"]), "side": r.choice(["aside", "aside", "div", "section"]), "foot": r.choice(["footer", "footer", "div"]), "head": r.choice(["header", "header", "div"]), "form": "form", "comment": r.choice(["section", "div", "aside"])}.get(group, r.choice(["div", "div", "section", "p", "aside"]))
        if self.plain and tag in ("nav", "aside", "header", "footer") and r.random() < 0.6 and group not in ("side", "head"):
            tag = "div"
        open_ = f'<{tag}{self.attr(group, tag not in ("nav", "aside", "footer", "header", "form"))} data-truth="0">'
        shut = f"</{tag}>"
        link = lambda s: f'<a href="/x">{s}</a>'
        if group == "menu":
            items = [link(self.phrase("menu")) for _ in range(r.randint(3, 9))]
            if tag == "p" or r.random() < 0.2:
                return open_ + r.choice([" | ", " &middot; ", " ", " / "]).join(items) + shut
            listed = "".join(f"<li>{x}</li>" for x in items)
            return open_ + (listed if tag == "ul" else f"<ul>{listed}</ul>") + shut
        if group == "comment":
            heading = r.choice(["", f"<h3>{self.phrase('comment')}</h3>", f"<h2>{self.phrase('comment')}</h2>"] if not self.plain else [f"<h3>{e(r.choice(PHRASES['comment']))}</h3>"])
            said = [e(self.cut(r.choice(self.bad), r.choice([40, 160, 1200]))) for _ in range(r.randint(1, 6))]
            who = lambda: r.choice(["", f"<b>{e(self.cut(r.choice(self.bad), 10))}</b> ", f"<div{self.attr('share', False)}>{e(self.cut(r.choice(self.bad), 10))} {r.randint(1, 9)}:30</div>"])
            shape = r.choice(["div", "li", "p", "divp"])
            one = lambda x: {"div": f"<div{self.attr('comment', False)}>{who()}{x}</div>", "li": f"<li>{who()}{x}</li>", "p": f"<p>{x}</p>", "divp": f"<div{self.attr('comment', False)}>{who()}<p>{x}</p></div>"}[shape]
            body = "".join(map(one, said))
            return open_ + heading + (f"<ol>{body}</ol>" if shape == "li" else body) + shut
        if group == "form":
            field_ = r.choice(["<input name=q>", "<textarea name=t></textarea>", "<select><option>One</option><option>Two</option></select>"])
            return open_ + r.choice(["", f"<h3>{self.phrase('form')}</h3>"]) + f"<label>{self.phrase('form')}</label>{field_}<button>{self.phrase('form')}</button>" + r.choice(["", f"<p>{self.phrase('form')}</p>"]) + shut
        if group == "side":
            heading = f"<h{(h := r.randint(2, 4))}>{self.phrase('side')}</h{h}>" if r.random() < 0.7 else ""
            if r.random() < 0.6:
                return open_ + heading + "<ul>" + "".join(f"<li>{link(self.phrase('side'))}</li>" for _ in range(r.randint(2, 6))) + "</ul>" + shut
            return open_ + heading + f"<p>{e(self.cut(r.choice(self.bad), r.choice([60, 300])))} {r.choice(['', link(self.phrase('side'))])}</p>" + shut
        if group == "notice":
            said = e(r.choice(PHRASES["notice"])) if self.plain or r.random() < 0.6 else self.phrase("notice")
            more = r.choice(["", f" <button>{self.phrase('notice')}</button>", f" {link(self.phrase('notice'))}"])
            return open_ + (f"<p>{said}</p>{more}" if tag != "p" and r.random() < 0.5 else said + more) + shut
        if group == "head":
            name = self.phrase("head")
            return open_ + r.choice([f"<h1>{link(name)}</h1>", f"<div>{link(name)}</div>", f"<p>{name}</p>", f"<span>{name}</span>"]) + r.choice(["", f"<p>{self.phrase('head')}</p>", "<ul>" + "".join(f"<li>{link(self.phrase('menu'))}</li>" for _ in range(4)) + "</ul>"]) + shut
        if group == "foot":
            said = e(r.choice(PHRASES["foot"])) if r.random() < 0.6 else "&copy; " + self.phrase("foot")
            more = r.choice(["", "<ul>" + "".join(f"<li>{link(self.phrase('foot'))}</li>" for _ in range(3)) + "</ul>", f" {link(self.phrase('foot'))} {link(self.phrase('foot'))}"])
            return open_ + (f"<p>{said}</p>{more}" if tag != "p" and r.random() < 0.6 else said + more) + shut
        said = self.phrase(group) if r.random() < 0.6 else e(self.cut(r.choice(self.bad), r.choice([120, 400])))
        if self.plain and group == "advert":
            said = e(r.choice(PHRASES["advert"])) + " " + said
        wrap = r.choice(["p", "div", None]) if tag != "p" else None
        return open_ + (f"<{wrap}>{said}</{wrap}>" if wrap else said) + r.choice(["", link(self.phrase(group))]) + shut

    def page(self) -> str:
        r = self.r
        body = [self.element(s) for s in self.good[1:]]
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            body.insert(r.randint(0, len(body)), self.furniture(r.choice(["menu", "advert", "share", "form", "side", "notice", "notice"])))
        if r.random() < 0.25:
            body.append(self.furniture("comment"))
        inner = self.head() + "".join(body)
        tag = r.choice(["div", "div", "section", "none", "td"] if self.plain else ["article", "article", "article", "main", "div", "section", "td"])
        marked = f'{self.attr("content", tag in ("div", "section"))} data-truth="1"'
        before = [self.furniture(r.choice(["head", "head", "menu", "menu", "notice", "advert", "side", "form"])) for _ in range(r.randint(0, 4))]
        after = [self.furniture(r.choice(["foot", "foot", "comment", "comment", "side", "side", "notice", "share", "advert", "form", "menu"])) for _ in range(r.randint(0, 4))]
        if tag == "td":
            left = "".join(before)
            right = r.choice(["", f"<td>{''.join(after)}</td>"])
            whole = f"<table><tr><td>{left}</td><td{marked}>{inner}</td>{right}</tr></table>" + ("" if right else "".join(after))
        elif tag == "none":
            whole = f'{"".join(before)}{inner}{"".join(after)}'
        else:
            whole = f'{"".join(before)}<{tag}{marked}>{inner}</{tag}>{"".join(after)}'
        for _ in range(r.choice([0, 0, 1, 2])):
            whole = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{whole}</div>"
        # without an element around the article, all that is no furniture is main text
        return f'<html><body{" data-truth=1" if tag == "none" else ""}>{whole}</body></html>'


def labels(t: Tree) -> np.ndarray:
    """1: a node with main text in or below it; 0: only furniture; -1: not known."""
    truth = np.full(len(t.tag), -1)
    for i in range(len(t.tag) - 1, -1, -1):
        if t.tag[i] == "#":
            truth[i] = max(t.truth[i], -1)
        if t.up[i] >= 0:
            truth[t.up[i]] = max(truth[t.up[i]], truth[i])
    return truth


def train(pages: list[str], layouts: int = 4, seed: int = 7) -> gbdt.Trees:
    r = random.Random(seed)
    split = [_pieces(p) for p in pages]
    split = [s for s in split if s[0]] or [(["Title", "A paragraph of some words, and a few more."] * 2, ["Home", "Contact"])]
    trees = []
    for i, (good, bad) in enumerate(split):
        other = split[(i + 1) % len(split)][0]
        for _ in range(layouts):
            some = good[: r.choice([1, 2, 3, 5, 40])]
            short = [_Layout.cut(None, s, 60) for s in some] if r.random() < 0.15 else some
            trees.append(parse(_Layout(r, short, bad + other[1:4]).page(), layout=True))
    truth = np.concatenate([labels(t) for t in trees])
    known = np.flatnonzero(truth >= 0)
    return gbdt.fit(features(trees, forest(trees))[known], truth[known].astype(float), trees=80, depth=5, every=3)


# ---------------------------------------------------------------- the operator


def extract_pages(pages: list[str | None], model: gbdt.Trees) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    f = forest(trees)
    kept = decode(f, np.where(f.sum_up(np.array([t == "#" for t in f.tags], float)) > 0, model.logit(features(trees, f)), -np.inf))
    out, at = [], 0
    for t in trees:
        out.append("\n\n".join(x for x, tag, k in zip(t.text, t.tag, kept[at : at + len(t.tag)]) if k and tag == "#"))
        at += len(t.tag)
    return out


def extract(pages: DataFrame, sample: int = 300) -> DataFrame:
    """page_id, url, text, n_chars."""
    fits = pages.where(F.length("html").between(1, MOST_CHARS) & F.col("page_id").isNotNull())
    # Only ids are ranked; then at most `sample` ids pick their pages.
    chosen = [r["page_id"] for r in fits.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    fit_on = fits.where(F.col("page_id").isin(chosen)).groupBy("page_id").agg(F.min("html").alias("html")).collect()
    model = train([r["html"] for r in sorted(fit_on, key=lambda r: chosen.index(r["page_id"]))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                texts = extract_pages(pdf["html"].tolist(), model)
                yield pd.DataFrame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    # Ids pass through Python as strings, which keep null and every digit.
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
