"""Main text of web pages by composite text density.

Every element's density is its characters per tag, adjusted for links: with C characters, T tags,
of these LC and LT in links, and the body's own share of link characters,

    density = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + share * C + e)).

An element's density sum is the sum of its children's densities. The element with the largest sum
is the core; the least density on its path to the body is the threshold, and what stands beside
the core at that density or more belongs to it too. An article or main element around the core is
taken whole. Elements that are boilerplate by their tag, role or class never count.

A class or id is a weaker sign than a tag or role. A name that denies a word or says that something
else is there (no-sidebar, with-ads) is none; ids are also anchors, so one marks only if all its words
do, and never a heading or paragraph. A marked element stays if it contains a main or h1 element, an
article while none stands outside marked elements, or the core of the page; a name of boilerplate
words alone gives way to the core only where hardly any other text and no article is left.

Character references are decoded, white space in a block becomes one space, blocks are joined by
an empty line. Defined cases: null and empty pages, and pages without text, give an empty text;
unclosed and stray tags follow the usual rules of browsers; repeated rows are extracted each;
other columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split())
#: A start tag of the key ends an open element of the values, up to the nearest of their limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
CLOSE_P = BLOCK - {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "body", "html"}

NEVER = frozenset("head script style noscript template nav footer aside form iframe object svg canvas audio video select button textarea input menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent notice gdpr popup modal newsletter subscribe signup "
    "comment comments disqus respond share sharing social related widget pagination pager toolbar".split())
#: Words that stand beside these in names of boilerplate and say nothing of the content.
PLAIN = frozenset(
    "area article aside bar block body bottom box button buttons class col column container content count desktop div element "
    "entry footer form global google gpt header icons inner item items left link links list main mobile module outer page panel "
    "post posts primary right row secondary section site slot status sticky thread top unit wrap wrapper".split())
#: A name with one of these before a word of MARKS tells of another element, or of none.
DENIES = frozenset("has have having hide hides no non not show shows with without".split())
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORD = re.compile(r"[a-z]+")


def _marked(tag: str, attrs) -> int:
    """0: no class or id marks the element as boilerplate; 1: one does among other words; 2: one
    that has no other words does."""
    mark = 0
    for k, v in attrs:
        if not v or k != "class" and (k != "id" or tag in _ANCHORED):
            continue
        for name in v.lower().split():
            words = _WORD.findall(name)
            at = next((i for i, w in enumerate(words) if w in MARKS), None)
            if at is None or not DENIES.isdisjoint(words[:at]):
                continue
            alone = all(w in MARKS or w in PLAIN for w in words)
            if alone or k == "class":
                mark = max(mark, 1 + alone)
    return mark


def _boilerplate(tag: str, attrs, inside_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside_article:
        return True
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and _marked(tag, [(k, " ".join(n for n in v.lower().split() if "comment" in _WORD.findall(n))) for k, v in attrs if k == "class" and v]) == 2
    for k, v in attrs:
        if k == "role" and v and v.strip().lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true":
            return True
    return False


class _Tree(HTMLParser):
    """Elements in page order (a subtree is a range of numbers) and the texts between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.end, self.off, self.mark = [-1], ["#root"], [0], [False], [0]
        self.open = [0]
        self.texts: list[tuple[int, str | None]] = []  # None: a block begins or ends here

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            self.end[node] = len(self.tag)
            if self.tag[node] in BLOCK:
                self.texts.append((node, None))

    def _close(self, names, limits=frozenset()) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                self._pop_to(depth)
                return
            if tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and tag in self.tag:
            return
        if tag in CLOSE_P:
            self._close({"p"}, {"table", "td", "th", "button", "article", "section", "div"} - {tag} | {"article"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "body":
            self._close({"head"})
        if tag == "br":
            self.texts.append((self.open[-1], " "))
        node, up = len(self.tag), self.open[-1]
        inside = any(self.tag[x] in ("article", "main") for x in self.open) if tag == "header" else False
        self.parent.append(up)
        self.tag.append(tag)
        self.end.append(node + 1)
        self.off.append(self.off[up] or _boilerplate(tag, attrs, inside))
        self.mark.append(0 if tag in ("html", "body", "article", "main") else _marked(tag, attrs))
        if tag in BLOCK:
            self.texts.append((node, None))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "circle", "rect", "g"):
            self._close({tag})

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, {"table", "td", "article"} if tag in ("p", "b", "i", "em", "strong", "span", "a", "li") else frozenset())

    def handle_data(self, data):
        self.texts.append((self.open[-1], data))


def _tree(html: str) -> _Tree:
    tree = _Tree()
    try:
        tree.feed(html)
        tree.close()
    except AssertionError:  # a marked section of no known kind is text
        tree = _Tree()
        tree.feed(re.sub(r"<!\[", "&lt;![", html))
        tree.close()
    tree._pop_to(0)
    if any(tree.mark):
        _drop_marked(tree)
    return tree


def _drop_marked(tree: _Tree) -> None:
    """Turn the marked elements off that are not kept by what they contain."""
    n = len(tree.tag)
    under, size, head, article = [False] * n, [0] * n, [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n):
        under[i] = under[tree.parent[i]] or tree.mark[i] > 0
        head[i + 1] = head[i] + (not tree.off[i] and tree.tag[i] in ("main", "h1"))
        article[i + 1] = article[i] + (not tree.off[i] and tree.tag[i] == "article")
    for node, said in tree.texts:
        if said and not tree.off[node]:
            size[node] += len(" ".join(said.split()))
    apart = any(tree.tag[i] == "article" and not tree.off[i] and not under[i] for i in range(n))
    beside = sum(c for c, u in zip(size, under, strict=True) if not u)
    _, total = densities(tree)
    inner = max(range(n), key=lambda i: (total[i], -i))
    text = [0, *accumulate(size)]
    # An element with nothing but text in it is no core: it is the part that holds nearly all of it.
    i = inner + 1
    while i < (tree.end[inner] or n):
        if 11 * (text[tree.end[i]] - text[i]) > 10 * (text[tree.end[inner] or n] - text[inner]):
            inner, i = i, i + 1
        else:
            i = tree.end[i]
    held, i = set(), inner
    while i > 0:
        held.add(i)
        i = tree.parent[i]
    for i in range(1, n):
        gone = tree.mark[i] > 0 and head[tree.end[i]] == head[i] and (apart or article[tree.end[i]] == article[i])
        if gone and i in held:
            gone = tree.mark[i] == 2 and (apart or beside * 10 >= text[tree.end[i]] - text[i])
        tree.off[i] = tree.off[i] or tree.off[tree.parent[i]] or gone


def densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Density and density sum of every element that is not boilerplate (others: 0)."""
    n = len(tree.tag)
    chars, link_chars, tags, links, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.texts:
        if text and not tree.off[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            link_chars[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.off[i]:
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (tree.tag[i] == "a")
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i] and not tree.off[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], max(links[i], 1)
            value = c / t
            if share:
                base = math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e))
                value *= max(0.0, math.log(c / max(lc, 1) * t / lt)) / max(base, 0.1)
            density[i] = value
            if i:
                total[tree.parent[i]] += value
    return density, total


def core(tree: _Tree) -> list[int]:
    """The elements, in page order, whose whole text is the page's main text."""
    density, total = densities(tree)
    n = len(tree.tag)
    best = max(range(n), key=lambda i: (total[i], -i))
    if not total[best]:
        return [0]
    path = [best]
    while path[-1] and tree.tag[path[-1]] != "body":
        path.append(tree.parent[path[-1]])
    around = next((i for i in reversed(path) if tree.tag[i] in ("article", "main")), None)
    if around is not None:
        return [around]
    threshold = min(density[i] for i in path if i) if any(path) else 0.0
    chosen, i, top = [], path[-1], tree.end[path[-1]] or n
    i = path[-1] + 1 if best != path[-1] else best
    on_path = set(path) - {best}
    while i < top:
        if i == best or i not in on_path and not tree.off[i] and density[i] >= threshold and density[i] > 0:
            chosen.append(i)
            i = max(tree.end[i], i + 1)
        else:
            i += 1
    return chosen or [best]


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    tree = _tree(html)
    ranges = [(i, tree.end[i] or len(tree.tag)) for i in core(tree)]
    blocks, part = [], []
    for node, text in tree.texts:
        if text is None:
            blocks.append(part)
            part = []
        elif not tree.off[node] and any(a <= node < b for a, b in ranges):
            part.append(text)
    blocks.append(part)
    joined = (" ".join("".join(p).split()) for p in blocks)
    return "\n\n".join(b for b in joined if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` with text and n_chars in place of html."""
    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return html.map(extract)

    return pages.withColumn("text", main_text("html")).withColumn("n_chars", F.length("text").cast("bigint")).drop("html")
