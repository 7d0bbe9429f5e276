"""HTML extraction by a tree-structured graphical model over the DOM.

A page is read into a tree of its block elements; inline elements add their text to the block around them. Every element
is content or boilerplate. Unary potentials score its features (kind of element, words of its class and id, length,
links and punctuation of its own text), pair potentials score agreement with its parent. Within what is marked as article (or
as something beside it) they are firm: its lists, tables and nested elements go with the mark, however they look. Names weigh by what they name: of a container any word
of a class or id tells, of a paragraph, a cell or an article only a name as a whole, and other attributes tell nothing but
whether the element is shown. Sum-product messages go from the leaves up and from the roots down, which gives every element's exact marginal; blocks of elements whose content marginal
is at least one half are kept, in page order.

Weights are fitted by gradient ascent on the likelihood of labelled pages: pages that mark their article with <article>
or <main>, of which the ``max_labelled`` with the smallest id hashes are taken (pages of more than ``max_elements`` elements
are not fitted on). Each is fitted on twice, as it is and with all marks hidden, so that lengths, links, punctuation and
kinds of elements have to tell its article, too. Only features and labels of elements reach the driver. A Gaussian prior
holds the weights near ``PRIOR``, so that kinds of boilerplate that no labelled page has still count. All pages are then
extracted, whole, in time proportional to their length.

Scripts, styles, comments, titles and other text that a page does not show never become blocks. Character references are
decoded once; white space inside a block becomes one space; blocks without text are left out.

Defined results: a null or empty html, or one without content, gives an empty text. Broken markup is read as browsers do: an
end tag without a start is ignored, an element left open ends with its parent, a new paragraph ends an open one, a tag,
comment or script that never ends takes the rest of the page, a "<" before anything else is text. Equal pages have equal
texts. Of pages that repeat a labelled id the one with the smallest hash is fitted on. Input columns named text, n_chars,
n_blocks or kept_blocks are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import hidden, table

TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
VALUE_NEXT = re.compile(r"=\s*\Z")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements whose text is raw up to their end tag; those whose content a page does not show; elements that flow within a block; those without an end tag; those a page uses around its article;
#: those a new one of which ends; words by which authors name what is not the article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav header footer aside form menu dialog button select fieldset".split())
ARTICLE = frozenset("article main".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
UNSEEN = frozenset("svg object template canvas video audio".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOT_ARTICLE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)

#: Of these any word of a name tells what they are; of all others a whole name.
CONTAINERS = frozenset("div section ul ol nav aside header footer form table span center ins iframe details figure".split())
#: Of these even articles within them are not the page's.
ASIDE = frozenset("nav footer aside".split())
#: Roles that name what is not the article.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())

#: Words by which authors name the article.
IS_ARTICLE = frozenset("article content entry post story".split())

FEATURES = ("bias", "article", "around", "named_off", "heading", "paragraph", "list", "log_chars", "links", "sentence")
#: Mean of the weights' prior; then agreement of parent and child on boilerplate and on content. Marks of boilerplate outweigh
#: any number of paragraphs below them.
PRIOR = (-0.5, 6.0, -40.0, -40.0, 0.3, 0.5, -0.5, 0.3, -2.0, 0.5, 3.0, 1.5)
#: Log-odds of an element's state below a marked article, and of the other state below what is marked as something beside it.
FIRM = 7.5
#: How firmly the prior holds each weight: agreement most, as few pages have an article's paragraphs within boilerplate.
HOLD = (5.0,) + (1.0,) * 9 + (5.0, 5.0)
EXTRACTED = "text string, n_chars long, n_blocks int, kept_blocks int"


class Page:
    """Block elements as parallel lists (parents before children), and blocks of text with the element each belongs to."""

    __slots__ = ("parent", "tag", "off", "good", "unseen", "chars", "links", "sentence", "blocks", "around", "inside", "aside")

    def __init__(self) -> None:
        self.parent, self.tag, self.off, self.good, self.unseen, self.chars, self.links, self.sentence, self.blocks = [], [], [], [], [], [], [], [], []
        self.around, self.inside, self.aside = [], [], []

    def place(self) -> None:
        """Which elements lie around the article, which within a marked one or beside it; parents come first."""
        for up, tag, off, good in zip(self.parent, self.tag, self.off, self.good):
            below = up >= 0 and self.inside[up]
            around = tag in AROUND and not (tag == "header" and below)  # an article's own header is its
            out = up >= 0 and self.aside[up]
            self.aside.append(out or off or tag in ASIDE)
            self.around.append(around)
            self.inside.append(not around and not off and (below or ((good or tag in ARTICLE) and not out)))


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the attributes say that it is not the article or not shown; whether they say that it is the article."""
    off, whole = False, []
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden":
            off = off or value not in ("false", "until-found")
        elif name == "aria-hidden":
            off = off or value == "true"
        elif name == "style":
            off = off or bool(NOT_SHOWN.search(value))
        elif name == "role":
            off = off or not ROLES.isdisjoint(value.split())
        elif name in ("class", "id"):
            whole += value.split()
    good = not IS_ARTICLE.isdisjoint(whole) or any(not IS_ARTICLE.isdisjoint(WORDS.findall(w)) for w in whole)
    says_off = not NOT_ARTICLE.isdisjoint(whole) and tag != "main"
    if not says_off and tag in CONTAINERS and IS_ARTICLE.isdisjoint(whole):
        says_off = any(not NOT_ARTICLE.isdisjoint(WORDS.findall(w)) for w in whole)
    off = off or says_off
    return off, not off and good


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE)


def _tag_end(source: str, at: int) -> int:
    """Where the tag ends whose attributes start at ``at``: the index of its ">", -1 if it never ends. Quotes count after "="."""
    while m := QUOTE_OR_END.search(source, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if source[: m.start()][-8:].rstrip().endswith("="):
            at = source.find(m[0], at) + 1
            if not at:
                return -1
    return -1


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(text before a tag, name with a "/" for an end tag, attributes); ("...", "", "") for text that no tag follows.

    Every step goes on from where the last one ended, and a construct that never ends takes the rest.
    """
    at = begun = 0
    size = len(source)
    while (at := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), at):
            end = source.find("-->", at + 4) + 2 if source.startswith("<!--", at) else source.find(">", at)
            if source.startswith(("<!-->", "<!--->"), at):
                end = source.find(">", at)
            yield source[begun:at], "!", ""
            at = begun = size if end < at else end + 1
            continue
        m = TAG_NAME.match(source, at + 1)
        if not m:
            at += 1
            continue
        end = _tag_end(source, m.end())
        name, before = m[1].lower(), source[begun:at]
        if end < 0:
            yield before, "!", ""
            return
        if source[at + 1] == "/":
            yield before, "/" + name, ""
        elif name in RAW:
            closed = _raw_end(name).search(source, end + 1)
            end = source.find(">", closed.end()) if closed else -1
            yield before, "!", ""
            if end < 0:
                return
        else:
            yield before, name, source[m.end() : end]
        at = begun = end + 1
    if begun < size:
        yield source[begun:], "", ""


def read_page(source: str | None) -> Page:
    page = Page()
    parent, tags, off, good, unseen, blocks = page.parent, page.tag, page.off, page.good, page.unseen, page.blocks
    parent.append(-1), tags.append(""), off.append(False), good.append(False), unseen.append(False)
    stack, opened, piece, linked, in_link = [0], Counter(), [], 0, False

    def flush() -> None:
        nonlocal linked
        if piece:
            raw = "".join(piece)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            piece.clear()
        linked = 0

    for before, name, attributes in tokens(source or ""):
        if before and not unseen[stack[-1]]:
            piece.append(before)
            if in_link:
                linked += len(before)
        ends = name[:1] == "/"
        name = name[1:] if ends else name
        if name in INLINE:
            if name == "br":
                piece.append(" ")
            elif name == "a":
                in_link = not ends
            continue
        if name in ("", "!"):
            continue
        if name not in UNSEEN and not unseen[stack[-1]]:  # what is not seen does not divide the text around it
            flush()
        if ends:
            while opened[name]:
                if not unseen[stack[-1]]:
                    flush()
                    in_link = False
                last = tags[stack.pop()]
                opened[last] -= 1
                if last == name:
                    break
            continue
        closes = ENDS.get(name, {"p"} if name in CLOSES_P else ())
        if closes and tags[stack[-1]] in closes and not unseen[stack[-1]]:
            opened[tags[stack.pop()]] -= 1
            in_link = False
        if name in VOID or (attributes.endswith("/") and (unseen[stack[-1]] or name == "svg")):
            continue
        says = (False, False) if not attributes else _named(name, attributes) if len(attributes) < 300 else _named.__wrapped__(name, attributes)
        parent.append(stack[-1]), tags.append(name), off.append(says[0]), good.append(says[1]), unseen.append(unseen[stack[-1]] or name in UNSEEN)
        stack.append(len(tags) - 1)
        opened[name] += 1
    flush()
    n = len(tags)
    page.chars, page.links, page.sentence = [0] * n, [0] * n, [0] * n
    for node, text, linked_chars in blocks:
        page.chars[node] += len(text)
        page.links[node] += linked_chars
        page.sentence[node] |= text[-1] in ".!?"
    page.place()
    return page


@lru_cache(maxsize=4096)
def _kind(tag: str, off: bool, marked: bool, around: bool) -> tuple[float, ...]:
    heading, listed = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag in ("li", "ul", "ol", "dl", "dt", "dd")
    return (float(marked), float(around), float(off), float(heading), float(tag in ("p", "pre", "blockquote")), float(listed))


def node_features(page: Page) -> list[tuple[float, ...]]:
    """FEATURES of each element; an element without text of its own has no bias and goes with its relatives."""
    out = []
    for tag, off, good, around, inside, chars, links, sentence in zip(page.tag, page.off, page.good, page.around, page.inside, page.chars, page.links, page.sentence):
        own = (math.log1p(chars) / 5, links / chars, float(sentence)) if chars else (0.0, 0.0, 0.0)
        out.append((float(chars > 0), *_kind(tag, off, inside and (good or tag in ARTICLE), around), *own))
    return out


def firm_edges(page: Page) -> list[int]:
    """1 for elements whose parent lies within a marked article, -1 below what is marked as something beside it, else 0."""
    return [0 if up < 0 else 1 if page.inside[up] else -1 if page.aside[up] else 0 for up in page.parent]


def sum_product(parent: list[int], unary: list[float], stay_off: float, stay_on: float, firm: list[int] | None = None) -> tuple[list[float], list[float]]:
    """Content marginal of each node, and its message to its parent (log-odds); parents come before their children.

    A message is the log-odds that it adds to its receiver, so the product over children is a sum. The pair potential is
    the child's chance given its parent: it agrees with a boilerplate parent by the logistic of stay_off, with a content
    parent by that of stay_on; a child that says nothing about itself says nothing about its parent. Below a mark (firm) the
    mark decides the parent, so the chance is that of the mark, and the child adds nothing to its parent.
    """
    n = len(parent)
    chance = {1: _pair(-FIRM, FIRM), 0: _pair(stay_off, stay_on), -1: _pair(FIRM, -FIRM)}
    pairs = [chance[f] for f in firm] if firm else [chance[0]] * n
    exp, log = math.exp, math.log
    up, gathered = [0.0] * n, list(unary)
    for k in range(n - 1, 0, -1):
        off, on = pairs[k]
        odds = exp(min(max(gathered[k], -60.0), 60.0))
        up[k] = log((odds * on + 1 - on) / (odds * (1 - off) + off))
        gathered[parent[k]] += up[k]
    belief = list(gathered)
    for k in range(1, n):
        off, on = pairs[k]
        odds = exp(min(max(belief[parent[k]] - up[k], -60.0), 60.0))
        belief[k] += log((odds * on + 1 - off) / (odds * (1 - on) + off))
    return [1 / (1 + exp(-min(max(b, -60.0), 60.0))) for b in belief], up


def _pair(stay_off: float, stay_on: float) -> tuple[float, float]:
    return 1 / (1 + math.exp(-stay_off)), 1 / (1 + math.exp(-stay_on))


def extract(source: str | None, weights: list[float]) -> tuple[str, int, int, int]:
    page = read_page(source)
    emit = weights[:-2]
    unary = [sum(map(float.__mul__, f, emit)) for f in node_features(page)]
    marginal, _ = sum_product(page.parent, unary, weights[-2], weights[-1], firm_edges(page))
    kept = [text for node, text, _ in page.blocks if marginal[node] >= 0.5]
    text = "\n".join(kept)
    return text, len(text), len(page.blocks), len(kept)


def node_labels(page: Page) -> list[int]:
    """1 for the marked article, what it holds that is not marked otherwise, and all around it; else 0."""
    labels = [int(inside) for inside in page.inside]
    for k in range(len(labels) - 1, 0, -1):
        if labels[k]:
            labels[page.parent[k]] = 1
    return labels


#: Features that the marks of an article or of boilerplate give, and that the second reading of a labelled page hides.
MARKS = [FEATURES.index(f) for f in ("article", "around", "named_off")]


def labelled_page(source: str | None) -> tuple[list[int], np.ndarray, list[int]] | None:
    """(parents, features and kinds of edges, labels) of a page's elements, if it marks its article."""
    page = read_page(source)
    labels = node_labels(page)
    return (page.parent, np.column_stack([np.array(node_features(page)), firm_edges(page)]), labels) if any(labels) else None


def fit_tree(pages: list[tuple[list[int], np.ndarray, list[int]]], steps: int = 40, rate: float = 0.1, hold: tuple[float, ...] = HOLD) -> list[float]:
    """Maximum a posteriori weights; expected features come from the marginals of nodes and of parent-child pairs."""
    prior = np.array(PRIOR)
    data = []
    for parent, x, labels in pages:
        unmarked = x.copy()
        unmarked[:, [*MARKS, len(FEATURES)]] = 0.0
        data += [(parent, seen, np.array(labels, dtype=float)) for seen in (x, unmarked)]
    theta, first, second = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
    for step in range(1, steps + 1 if data else 1):
        grad = -np.array(hold) * (theta - prior)
        for parent, x, y in data:
            emit, off, on = theta[:-2], theta[-2], theta[-1]
            firm = x[:, len(FEATURES)].astype(int)
            x, loose = x[:, : len(FEATURES)], firm[1:] == 0
            marginal, up = sum_product(parent, (x @ emit).tolist(), off, on, firm.tolist())
            p, par = np.array(marginal), np.array(parent[1:], dtype=int)
            belief = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1))
            # Pair marginals: the parent without this child's message, the child without its parent's.
            s_off, s_on = _pair(off, on)
            above = belief[par] - np.array(up[1:])
            odds = np.exp(np.clip(above, -60, 60))
            below = belief[1:] - np.log((odds * s_on + 1 - s_off) / (odds * (1 - s_on) + s_off))
            joint = np.stack([np.full_like(above, np.log(s_off)), below + np.log(1 - s_off), above + np.log(1 - s_on), above + below + np.log(s_on)])
            joint = np.exp(joint - joint.max(0))
            joint = joint / joint.sum(0)
            grad[:-2] += (y - p) @ x / len(data)
            grad[-2] += ((1 - y[par]) * ((1 - y[1:]) - s_off) - (joint[0] * (1 - s_off) - joint[1] * s_off))[loose].sum() / len(data)
            grad[-1] += (y[par] * (y[1:] - s_on) - (joint[3] * (1 - s_on) - joint[2] * s_on))[loose].sum() / len(data)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return np.round(theta, 6).tolist()


def train_tree(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_labelled: int = 200, max_elements: int = 5000) -> list[float]:
    """Fit on at most max_labelled of the pages that mark their article; their features are computed where the pages are."""
    marked = pages.select(F.col(page_id).cast("long").alias("id"), F.col(html).alias("html")).filter(F.col("id").isNotNull() & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    ids = marked.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, t, p) for i, t, p in zip(batch["id"], batch["tie"], map(labelled_page, batch["html"])) if p and len(p[0]) <= max_elements]
            yield pd.DataFrame({"id": [i for i, _, _ in found], "tie": [t for _, t, _ in found], "parent": [p[0] for _, _, p in found], "flat": [p[1].ravel() for _, _, p in found], "labels": [p[2] for _, _, p in found]})

    chosen = marked.join(F.broadcast(ids), "id").withColumn("tie", F.xxhash64("html"))
    rows = chosen.mapInPandas(features, "id long, tie long, parent array<int>, flat array<double>, labels array<int>")
    one = rows.groupBy("id").agg(F.min_by(F.struct("parent", "flat", "labels"), "tie").alias("p")).orderBy("id").select("p.*").collect()
    return fit_tree([(list(r.parent), np.array(r.flat).reshape(-1, len(FEATURES) + 1), list(r.labels)) for r in one])


def extract_content(pages: DataFrame, weights: list[float], html: str = "html") -> DataFrame:
    """pages with the main text, its length, and how many blocks each page has and keeps."""

    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(s, weights) for s in sources], columns=["text", "n_chars", "n_blocks", "kept_blocks"])

    done = pages.withColumn("__extracted", F.pandas_udf(run, EXTRACTED)(F.col(html)))
    return hidden(done, "text", "n_chars", "n_blocks", "kept_blocks").select("*", "__extracted.*").drop("__extracted")


def op5_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_content(pages, train_tree(pages)).select("page_id", "url", "text", "n_chars", "n_blocks", "kept_blocks")
