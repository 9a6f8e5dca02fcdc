"""Main-text extraction: gradient-boosted trees over DOM nodes, then hierarchical decoding.

A page becomes a tree of block-level nodes with features of the node (tag, hashed attribute tokens, depth), of its
subtree (text, links and tags per character), and of its siblings and ancestors. Boosted trees give each node a log-odds
of being content; a second set of trees sees these also for the node's parent, its ancestors and its children. Decoding
then chooses which nodes to keep so that the summed log-odds are greatest, under the rule that nothing below a dropped
node is kept; so an ancestor and a descendant never contradict each other.

There are no labelled pages. The trees are fitted on the driver, on at most SAMPLE_PAGES pages with labels from their
semantic elements, and on LAYOUTS layouts that are put together from their words, so that it is known by construction
which nodes are content. In these, boilerplate has customary names; what holds the content has any names,
among them those of boilerplate. No feature knows a list of names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE_PAGES = 300
#: Generated layouts that are fitted, over all sampled pages.
LAYOUTS = 1800
#: Of a page with more nodes than this, every second, third ... one is fitted, so that long pages don't outweigh others.
NODES = 200
TREES = 40
DEPTH = 4
RATE = 0.3
#: Attribute tokens are hashed to so many numbers.
TOKENS = 4096

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg object audio video canvas select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul summary".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Elements that by themselves say what they hold.
APART_TAGS = frozenset("nav header footer aside form button menu dialog fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_RAW_ENDS = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "parts", "own", "links", "hidden", "mark")

    def __init__(self, tag: str, words: frozenset, parent: int, hidden: bool = False, mark: str = ""):
        self.tag, self.words, self.parent, self.hidden, self.mark = tag, words, parent, hidden, mark
        self.children: list[int] = []
        self.parts: list = []  # texts, None for a break inside, and numbers of child nodes, in page order
        self.own = self.links = 0


def attribute_words(attributes: str) -> tuple[frozenset, bool]:
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value.lower() == "true"
        else:
            words.update(w.lower() for w in _WORDS.findall(value))
    return frozenset(words), hidden


class Markup:
    """The comments, declarations and tags of a page, found from left to right in linear time.

    A quote that is never closed makes a tag end at its first `>`. Openings of quotes from which no tag can end are
    remembered, so no stretch is searched again and again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.cdata, self.dead = page, page.rfind(">"), True, set()

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, name, attributes) of the next one from a place on; the name is empty if it is no tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > self.last:
                at = start + 1
                continue
            if page.startswith(("<!", "<?"), start):
                end = page.find("]]>", start + 9) if self.cdata and page.startswith("<![CDATA[", start) else -1
                if end >= 0:
                    return start, end + 3, "", "", ""
                self.cdata = self.cdata and not page.startswith("<![CDATA[", start)
                return start, page.find(">", start + 2) + 1, "", "", ""
            m = _NAME.match(page, start)
            if m:
                end = self.tag_end(m.end())
                return start, end + 1, m[1], m[2], page[m.end() : end]
            at = start + 1
        return None

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag: outside quotes, or simply the next one."""
        page, place, seen = self.page, at, []
        while True:
            place = _PLAIN.match(page, place).end()
            if page.startswith(">", place):
                return place
            if place >= len(page) or place in self.dead:
                break
            seen.append(place)
            place = page.find(page[place], place + 1) + 1
            if not place:
                break
        self.dead.update(seen)
        return page.find(">", at)


def parsed(page: str) -> list[Node]:
    """The block-level nodes of a page in page order, the first being the root. Inline elements are part of their block."""
    nodes = [Node("#root", frozenset(), -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block that they are in
    opened: Counter[str] = Counter()
    at, links, end = 0, 0, len(page)

    def say(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            node = nodes[stack[-1][1]]
            node.parts.append(text)
            n = len(text.strip())
            node.own += n
            if links:
                node.links += n

    def close(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    markup = Markup(page)
    while at < end:
        found = markup.after(at)
        if not found:
            break
        start, stop, closing, tag, attributes = found
        say(page[at:start])
        at = stop
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag closes nothing beyond its block
            if tag == "p" or tag == "br":
                nodes[stack[-1][1]].parts.append(None)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                m = _RAW_ENDS[tag].search(page, at)
                after = page.find(">", m.start()) if m else -1
                at = end if after < 0 else after + 1
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if tag in OWN_KIND:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in OWN_KIND[tag]:
                    close(k)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[k][0] in SCOPES[tag]:
                    break
        if tag == "a":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "a":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in INLINE:
            if tag == "br":
                nodes[stack[-1][1]].parts.append(" ")
            if tag not in VOID:
                links += tag == "a"
                opened[tag] += 1
                stack.append((tag, stack[-1][1]))
            continue
        parent = stack[-1][1]
        if tag in VOID:
            nodes[parent].parts.append(None)
            continue
        words, hidden = attribute_words(attributes) if attributes else (frozenset(), False)
        number = len(nodes)
        nodes.append(Node(tag, words, parent, hidden, attributes[-len(MARK) - 1 :] if MARK in attributes else ""))
        nodes[parent].children.append(number)
        nodes[parent].parts.append(number)
        if not attributes.endswith("/") or tag in CLOSES_P:
            opened[tag] += 1
            stack.append((tag, number))
    say(page[at:])
    return nodes


FEATURES = ("depth", "apart_tag", "content_tag", "named", "above_apart", "above_content", "below_content", "heading", "paragraph", "list", "head", "text", "link_share", "text_per_node", "text_of_parent", "text_of_page", "siblings", "place", "hidden", "paragraphs_below", "names", "worst_name")


def token(word: str) -> int:
    return zlib.crc32(word.encode()) % TOKENS


def names_odds(tokens: list[list[int]], odds: np.ndarray) -> np.ndarray:
    """The sum and the least of each node's tokens' log-odds of content."""
    return np.array([(odds[t].sum(), min(0.0, odds[t].min())) if t else (0.0, 0.0) for t in tokens]).reshape(-1, 2)


def features(nodes: list[Node], odds: np.ndarray | None = None) -> np.ndarray:
    """A row per node, as FEATURES says; without `odds` (of tokens) names say nothing."""
    n = len(nodes)
    own = np.array([x.own for x in nodes], np.float64)
    link = np.array([x.links for x in nodes], np.float64)
    size, below, para = np.ones(n), np.zeros(n), np.zeros(n)
    out = np.zeros((n, len(FEATURES)))
    for i in range(n - 1, 0, -1):  # children come after their parents
        x, p = nodes[i], nodes[i].parent
        own[p] += own[i]
        link[p] += link[i]
        size[p] += size[i]
        below[p] = max(below[p], below[i], x.tag in CONTENT_TAGS)
        para[p] += para[i] + (x.tag == "p")
    for i, x in enumerate(nodes):
        p = x.parent
        row = out[i]
        row[1], row[2], row[3] = x.tag in APART_TAGS, x.tag in CONTENT_TAGS, bool(x.words)
        if p >= 0:
            up = out[p]
            row[0] = up[0] + 1
            row[4] = max(up[4], up[1])
            row[5] = max(up[5], up[2])
            row[14] = own[i] / max(own[p], 1)
            row[16] = len(nodes[p].children)
        row[7], row[8], row[9], row[10] = x.tag in HEADINGS, x.tag == "p", x.tag in ("li", "ul", "ol"), x.tag == "head" or (p >= 0 and out[p][10])
        row[18] = x.hidden
        for k, c in enumerate(x.children):
            out[c][17] = k
    out[:, 6], out[:, 11], out[:, 12] = below, np.log1p(own), link / np.maximum(own, 1)
    out[:, 13], out[:, 15], out[:, 19] = np.log1p(own / size), own / max(own[0], 1), np.log1p(para)
    if odds is not None:
        out[:, 20:] = names_odds([[token(w) for w in x.words] for x in nodes], odds)
    return out


@dataclass
class Boosted:
    """Trees as arrays: per tree and inner node a feature and a cut, per leaf a value; node k's children are 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, bins: int = 32) -> Boosted:
    """Gradient boosting of the logistic loss with histogram splits."""
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    # bin b of feature j: above b of its cuts; all features in one histogram
    binned = np.stack([np.searchsorted(c, col, "left") + j * bins for j, (c, col) in enumerate(zip(cuts, x.T, strict=True))], axis=1)
    known = np.array([[b < len(c) for b in range(bins)] for c in cuts])
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score = np.full(len(y), start)
    inner, leaves, width = 2**DEPTH - 1, 2**DEPTH, x.shape[1]
    fs, cs, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        node, f, c = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2:
                    continue
                gk, hk = g[at], h[at]
                gt, ht, best = gk.sum(), hk.sum(), 1e-6
                flat = binned[at].ravel()
                gs, hs = (np.bincount(flat, np.repeat(v, width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (gk, hk))
                gain = np.where(known, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), 0.0)
                if gain.max() > best:
                    j, b = divmod(int(gain.argmax()), bins)
                    best, f[k], c[k] = gain.max(), j, cuts[j][b]
                node[at] = 2 * k + 1 + (x[at, f[k]] > c[k])
        # rows of a node that wasn't split go on to the left
        for k in range(inner):
            node[node == k] = 2 * k + 1
        leaf = node - inner
        v = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score += v[leaf]
        fs.append(f), cs.append(c), vs.append(v)
    return Boosted(np.array(fs), np.array(cs), np.array(vs), start)


def around(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """For each node its score, its parent's, the least and the sum of its ancestors', and the greatest of its children's."""
    out = np.zeros((len(nodes), 5))
    out[:, 0], out[:, 4] = score, -9
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            out[i, 1] = score[p]
            out[i, 2] = min(out[p, 2], score[p]) if p else 0.0
            out[i, 3] = out[p, 3] + score[p] if p else 0.0
            out[p, 4] = max(out[p, 4], score[i])
    return out


@dataclass
class Model:
    odds: np.ndarray
    first: Boosted
    second: Boosted

    def __call__(self, trees: list[list[Node]]) -> np.ndarray:
        x = np.concatenate([features(t, self.odds) for t in trees])
        one, at, more = self.first(x), 0, []
        for t in trees:
            more.append(around(t, one[at : at + len(t)]))
            at += len(t)
        return self.second(np.hstack([x, np.concatenate(more)]))


MARK = "data-apart"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes inside content elements and around them, 0 for those inside boilerplate elements or marked ones, and for all others."""
    good, bad, out = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        p = x.parent
        good[i] = (p >= 0 and good[p]) or x.tag in CONTENT_TAGS or x.mark.endswith("1")
        bad[i] = (p >= 0 and bad[p]) or x.tag in APART_TAGS or x.hidden or x.tag == "head" or x.mark.endswith("0")
        out[i] = good[i] and not bad[i]
    for i in range(len(nodes) - 1, 0, -1):  # what holds content can't be dropped
        if out[i]:
            out[nodes[i].parent] = 1
    return out


# Customary boilerplate elements for the generated layouts; {} is text, {l} a link, {c} further names.
BOXES = (
    "nav||<ul><li>{l}</li><li>{l}</li><li>{l}</li></ul>", "div|nav menu|<ul><li>{l}</li><li>{l}</li></ul>", "ul|breadcrumbs breadcrumb|<li>{l}</li><li>{l}</li>", "div|navbar navigation|{l} {l} {l}",
    "header|site-header|{}", "div|header masthead banner|<p>{}</p>", "footer||{}", "div|footer site-footer|<p>{}</p>{l} {l}", "div|copyright legal|{}",
    "aside|sidebar|<p>{}</p>", "aside||<h3>{}</h3><p>{}</p>", "div|sidebar widget|<h3>{}</h3><ul><li>{l}</li><li>{l}</li></ul>", "div|widget related|{}", "section|related recommended|<h2>{}</h2><p>{l}</p><p>{l}</p>",
    "div|comments|<p>{}</p><p>{}</p>", "section|comments comment-list|<h3>{}</h3><div class=comment><p>{}</p></div><div class=comment><p>{}</p></div>", "ol|commentlist|<li>{}</li><li>{}</li>", "div|replies reply respond|<p>{}</p>",
    "div|cookie-notice consent|<p>{}</p>", "div|notice|<p>{}</p>", "div|infobox|{}", "table|infobox|<tr><td>{}</td></tr>", "div|alert notices|<p>{}</p>", "div|popup modal|<p>{}</p>", "div|disclaimer|<p>{}</p>",
    "div|ad|{}", "div|ads advert|<p>{}</p>", "div|advertisement|<p>{}</p>", "div|sponsor promo|<p>{}</p>", "section|promotion promo|{}",
    "form||<label>{}</label><input>", "div|newsletter subscribe|<p>{}</p>", "div|signup login|<form><label>{}</label><input></form>", "div|search form|<label>{}</label>",
    "div|share sharing social|{l} {l}", "div|tags|{l} {l}", "div|byline|{}", "div|pagination pager|{l} {l}", "div|toolbar tools|{}", "div|rating feedback|<p>{}</p>",
)
CONTENT_NAMES = ("article", "main", "content", "post", "entry", "story", "body", "text", "page", "blog", "prose", "main-content", "post-body", "entry-content", "article-text")
PLAIN_NAMES = ("row", "col", "container", "wrap", "wrapper", "inner", "outer", "grid", "left", "right", "clearfix", "css-1x9", "a b c", "single", "theme-dark", "lang-en", "is-open", "primary", "column", "area")
BLOCK_NAMES = ("lead", "intro", "first", "quote", "note-text", "caption", "table-wide", "code", "list")
JOINTS = ("has-{}", "with-{}", "{}-open", "no-{}", "tag-{}", "category-{}", "{}-enabled", "{}")


def layout(words: list[str], seed: int) -> str:
    """A page of these words: content in elements of any names, boilerplate around and inside it."""
    rng = random.Random(seed)
    words = words or ["word"]
    odd = sorted({w for b in BOXES for w in re.split(r"[ -]", b.split("|")[1]) if w})

    def say(least: int, most: int) -> str:
        at = rng.randrange(len(words))
        return html.escape(" ".join((words[at:] + words)[: rng.randint(least, most)]))

    def box() -> str:
        tag, names, inside = rng.choice(BOXES).split("|")
        names = names.split()
        names = rng.sample(names, rng.randint(1, len(names))) if names and not (tag in APART_TAGS and rng.random() < 0.5) else []
        if rng.random() < 0.3:
            names.append(rng.choice(PLAIN_NAMES))
        inside = re.sub(r"\{l\}", lambda _: f'<a href="/x">{say(1, 5)}</a>', inside)
        inside = re.sub(r"\{\}", lambda _: say(2, 40), inside)
        key = "id" if rng.random() < 0.2 else "class"
        return f'<{tag} {key}="{" ".join(names)}" {MARK}0>{inside}</{tag}>'

    def names(content: bool) -> str:
        out = [rng.choice(PLAIN_NAMES) for _ in range(rng.randint(0, 2))]
        if content and rng.random() < 0.6:
            out.append(rng.choice(CONTENT_NAMES))
        for _ in range(rng.choice((0, 0, 1, 2))):
            out.append(rng.choice(JOINTS).format(rng.choice(odd)))
        rng.shuffle(out)
        return f'class="{" ".join(out)}"' if out else ""

    def block() -> str:
        made = plain_block()
        if rng.random() < 0.3:  # what is named isn't boilerplate for that
            made = re.sub(r"^<(\w+)", lambda m: f'<{m[1]} class="{rng.choice(PLAIN_NAMES + BLOCK_NAMES)}"', made)
        return made

    def plain_block() -> str:
        kind = rng.random()
        if kind < 0.7:
            link = f' <a href="/y">{say(1, 4)}</a> {say(1, 9)}' if rng.random() < 0.25 else ""
            return f"<p>{say(4, 70)}{link}</p>"
        return rng.choice((f"<h2>{say(1, 8)}</h2>", f"<ul><li>{say(2, 12)}</li><li>{say(2, 12)}</li></ul>", f"<blockquote><p>{say(5, 30)}</p></blockquote>", f"<pre>{say(3, 15)}</pre>", f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>", f"<div><p>{say(5, 40)}</p></div>", f"<figure><figcaption>{say(3, 12)}</figcaption></figure>"))

    blocks = [f"<h1>{say(2, 9)}</h1>"] * (rng.random() < 0.6) + [block() for _ in range(rng.randint(1, 12))]
    for _ in range(rng.choice((0, 0, 1, 2, 3))):
        blocks.insert(rng.randint(0, len(blocks)), box())
    tag = rng.choice(("article", "main", "div", "div", "div", "section"))
    page = f"<{tag} {names(True)} {MARK}1>{''.join(blocks)}</{tag}>"
    for _ in range(rng.choice((0, 0, 1, 1, 2))):
        if rng.random() < 0.5:
            page = page + box() if rng.random() < 0.5 else box() + page
        page = f"<{rng.choice(('div', 'div', 'main', 'section'))} {names(rng.random() < 0.5)}>{page}</div>"
    before, after = "".join(box() for _ in range(rng.randint(0, 4))), "".join(box() for _ in range(rng.randint(0, 4)))
    return f"<html><head><title>{say(1, 6)}</title></head><body {names(False)}>{before}{page}{after}</body></html>"


def learned(pages: DataFrame, sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Model | None:
    """The trees fitted on the pages with the smallest hashes, at most `sample`, and on about `layouts` layouts of their words; None without pages."""
    chosen = written(pages.where("html is not null").select("html", F.xxhash64(F.lit(4), "html").alias("h")).orderBy("h").limit(sample))
    each = -(-layouts // max(1, chosen.count()))

    def rows(batches):
        for batch in batches:
            out = []
            for page, h in zip(batch["html"], batch["h"], strict=True):
                own = parsed(page)
                words = [w for x in own[1:] if x.tag in ("p", "h1", "h2", "li") for t in x.parts if isinstance(t, str) for w in t.split()]
                trees = [own] if any(x.tag in CONTENT_TAGS for x in own) else []
                trees += [parsed(layout(words, int(h) % 1_000_003 + k)) for k in range(each)]
                for k, nodes in enumerate(trees):
                    out.append((int(h), k, [x.parent for x in nodes], features(nodes).astype("<f4").tobytes(), labels(nodes).tolist(), [[token(w) for w in x.words] for x in nodes]))
            yield pd.DataFrame(out, columns=["h", "k", "parents", "x", "y", "tokens"])

    found = chosen.repartition(4).mapInPandas(rows, "h long, k int, parents array<int>, x binary, y array<double>, tokens array<array<int>>").orderBy("h", "k").collect()
    return fit([(r["parents"], np.frombuffer(r["x"], "<f4").reshape(len(r["y"]), -1), np.array(r["y"]), r["tokens"]) for r in found]) if found else None


def fit(trees: list[tuple]) -> Model:
    """Both sets of trees from (parents, features, labels, tokens) of pages."""
    use = np.concatenate([np.arange(len(y)) % max(1, len(y) // NODES) == 0 for _, _, y, _ in trees])
    x = np.concatenate([f for _, f, _, _ in trees]).astype(np.float64)
    y = np.concatenate([v for _, _, v, _ in trees])
    tokens = [t for _, _, _, found in trees for t in found]
    ids, row = np.array([t for found in tokens for t in found], np.int64), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    # rare tokens say little
    good, bad = (np.bincount(ids, v[row], TOKENS) for v in (y, 1 - y))
    odds = np.log((good + 2) / (bad + 2))
    x[:, 20:] = names_odds(tokens, odds)
    first = boost(x[use], y[use])
    score, at, more = first(x), 0, []
    for parents, _, v, _ in trees:
        nodes = [Node("", frozenset(), p) for p in parents]
        more.append(around(nodes, score[at : at + len(v)]))
        at += len(v)
    return Model(odds, first, boost(np.hstack([x, np.concatenate(more)])[use], y[use]))


def kept_nodes(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The best choice of nodes: a subtree is kept if its node's score and what is best below it sum up to more than 0."""
    weight = np.array([max(1.0, np.sqrt(x.own)) for x in nodes])
    value = score * weight
    gain = value.copy()
    for i in range(len(nodes) - 1, 0, -1):
        gain[nodes[i].parent] += max(0.0, gain[i])
    keep = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        keep[i] = (x.parent < 0 or keep[x.parent]) and (x.parent < 0 or gain[i] > 0)
    return keep


def blocks_of(nodes: list[Node], keep: np.ndarray, shown: np.ndarray) -> list[str]:
    """The texts of kept nodes in page order; own text only where the node itself is shown."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if current:
            text = _SPACE.sub(" ", "".join(current)).strip(" ")
            if text:
                out.append(text)
            current.clear()

    stack = [iter(nodes[0].parts)]
    owner = [0]
    while stack:
        part = next(stack[-1], StopIteration)
        if part is StopIteration:
            flush()
            stack.pop()
            owner.pop()
        elif part is None:
            flush()
        elif isinstance(part, str):
            if shown[owner[-1]]:
                current.append(part)
        else:
            flush()
            if keep[part]:
                stack.append(iter(nodes[part].parts))
                owner.append(part)
    flush()
    return out


def main_text(pages: list[str], model: Model) -> list[str]:
    trees = [parsed(p) for p in pages]
    scores = model(trees) if trees else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        score = scores[at : at + len(nodes)]
        at += len(nodes)
        keep = kept_nodes(nodes, score)
        out.append("\n\n".join(blocks_of(nodes, keep, keep & (score > 0))))
    return out


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row: the main text, blocks joined by an empty line; empty if there is none.

    A null or empty html has the empty text. Repeated rows get the same text. Whole pages are read, nothing is cut; other
    columns take no part; an empty table gives an empty one.
    """
    model = model or learned(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [""] * len(batch)
            full = [i for i, h in enumerate(batch["html"]) if isinstance(h, str) and h]
            for part in range(0, len(full), 64):
                at = full[part : part + 64]
                for i, t in zip(at, main_text([batch["html"].iloc[i] for i in at], shared.value), strict=True):
                    texts[i] = t
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
