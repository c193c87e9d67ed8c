"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, fresh, table
from .dom import Tree, parse

TAGS = ("#root", "html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl",
        "dt", "dd", "table", "tbody", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside",
        "form", "fieldset", "details", "summary", "dialog", "address", "center", "other")
#: Words of class, id and role names that speak for or against content.
GOOD = ("article", "content", "post", "entry", "main", "body", "text", "story", "paragraph")
BAD = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "navbar", "menu",
       "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "social",
       "comment", "comments", "respond", "reply", "disqus", "discussion", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal",
       "overlay", "newsletter", "subscribe", "signup", "login", "search", "form", "copyright", "legal", "toolbar", "pagination", "pager",
       "tags", "skip", "hidden", "complementary", "contentinfo", "dialog")
OWN_WORDS, ALL_WORDS, LINKED, CHILDREN = (1, 4, 9, 21, 61), (1, 20, 60, 150, 400, 1000), (0.001, 0.2, 0.5), (1, 3, 8)
STATES = ("menus and the like", "content")

_SIZES = [("tag", len(TAGS)), ("good", 1), ("bad", 1), ("own", len(OWN_WORDS) + 1), ("own_linked", len(LINKED) + 1), ("ended", 3),
          ("all", len(ALL_WORDS) + 1), ("all_linked", len(LINKED) + 1), ("paragraphs", len(CHILDREN) + 1), ("reserved", 1), ("bias", 1)]
AT = dict(zip([n for n, _ in _SIZES], np.cumsum([0] + [k for _, k in _SIZES]).tolist()))
SIZE = sum(k for _, k in _SIZES)
#: Kinds of child for the parent-child potentials.
KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), **dict.fromkeys(("p", "blockquote", "pre", "figcaption"), 2),
         **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th"), 3)}
N_KINDS = 4
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)

#: Labelled pages the model is fitted on, and the characters of a page up to which it is taken before longer ones.
TRAIN_PAGES, TRAIN_CHARS = 400, 200_000
STEPS, RATE, PULL = 150, 0.1, 0.01
THRESHOLD = 0.5


def inputs(tree: Tree) -> np.ndarray:
    """(node, input) indexes of the active inputs of each node, as a matrix of one row per node and input group."""
    n = len(tree.tags)
    own, linked, chars, ended = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for node, text, in_links in tree.blocks:
        own[node] += text.count(" ") + 1
        chars[node] += len(text)
        linked[node] += in_links
        ended[node] = 2 if text[-1] in ".!?:;…\"”»" else 1
    whole, whole_linked, whole_chars, paragraphs = own.copy(), linked.copy(), chars.copy(), np.zeros(n)
    for node in range(n - 1, 0, -1):  # children come after their parents
        up = tree.parents[node]
        whole[up] += whole[node]
        whole_linked[up] += whole_linked[node]
        whole_chars[up] += whole_chars[node]
        paragraphs[up] += tree.tags[node] == "p"
    out = np.zeros((n, len(_SIZES)), np.int64)
    for node, (tag, names) in enumerate(zip(tree.tags, tree.names)):
        out[node, 0] = _TAG_AT.get(tag, len(TAGS) - 1)
        out[node, 1] = AT["good"] if names & _GOOD else AT["reserved"]
        out[node, 2] = AT["bad"] if names & _BAD else AT["reserved"]
    out[:, 3] = AT["own"] + np.searchsorted(OWN_WORDS, own, "right")
    out[:, 4] = AT["own_linked"] + np.searchsorted(LINKED, linked / np.maximum(chars, 1), "right")
    out[:, 5] = AT["ended"] + ended
    out[:, 6] = AT["all"] + np.searchsorted(ALL_WORDS, whole, "right")
    out[:, 7] = AT["all_linked"] + np.searchsorted(LINKED, whole_linked / np.maximum(whole_chars, 1), "right")
    out[:, 8] = AT["paragraphs"] + np.searchsorted(CHILDREN, paragraphs, "right")
    out[:, 9], out[:, 10] = AT["reserved"], AT["bias"]
    return out


@dataclass
class Forest:
    """Many trees end to end: active inputs, parent (-1 at roots), kind and depth of each node."""

    inputs: np.ndarray
    parents: np.ndarray
    kinds: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree]) -> Forest:
        parents, depths, kinds, at = [], [], [], 0
        for tree in trees:
            own = [0] * len(tree.tags)
            for node in range(1, len(own)):
                own[node] = own[tree.parents[node]] + 1
            depths += own
            parents += [p + at if p >= 0 else -1 for p in tree.parents]
            kinds += [KINDS.get(t, 0) for t in tree.tags]
            at += len(own)
        depths = np.array(depths)
        order = np.argsort(depths, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1) if len(order) else []
        return cls(np.concatenate([inputs(t) for t in trees]), np.array(parents), np.array(kinds), levels)


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights to start from and to stay near: what element and class names say, and that children follow parents."""
    w = np.zeros(SIZE)
    for tag in ("nav", "header", "footer", "aside", "form", "fieldset", "dialog", "address"):
        w[_TAG_AT[tag]] = -3.0
    for tag in ("article", "main"):
        w[_TAG_AT[tag]] = 3.0
    for tag in ("p", "blockquote", "pre"):
        w[_TAG_AT[tag]] = 0.5
    w[AT["good"]], w[AT["bad"]] = 1.5, -4.0
    w[AT["own_linked"] + len(LINKED)], w[AT["all_linked"] + len(LINKED)] = -1.5, -1.5
    w[AT["reserved"]] = 0.0
    pair = np.zeros((N_KINDS, 2, 2))
    pair[:, 0, 0] = pair[:, 1, 1] = 1.5
    return w, pair


@dataclass
class TreeModel:
    """Node weights for content, and a table of parent-child potentials (parent state, child state) for each kind of child."""

    w: np.ndarray
    pair: np.ndarray

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each node's states, and of each (parent state, child state), by sum-product messages: upward
        from the leaves, then downward from the roots; exact on trees."""
        n = len(forest.parents)
        local = np.zeros((n, 2))
        local[:, 1] = self.w[forest.inputs].sum(1)
        pair = self.pair[forest.kinds]
        inside, up = local.copy(), np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):
            up[level] = np.logaddexp(pair[level, :, 0] + inside[level, :1], pair[level, :, 1] + inside[level, 1:])
            np.add.at(inside, forest.parents[level], up[level])
        belief, joint = inside.copy(), np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            rest = belief[forest.parents[level]] - up[level]  # what the parent believes without this child
            table = rest[:, :, None] + pair[level] + inside[level][:, None, :]
            table -= table.max((1, 2), keepdims=True)
            belief[level] = np.logaddexp(rest[:, :1] + pair[level, 0], rest[:, 1:] + pair[level, 1]) + inside[level]
            table = np.exp(table)
            joint[level] = table / table.sum((1, 2), keepdims=True)
        belief -= belief.max(1, keepdims=True)
        belief = np.exp(belief)
        return belief / belief.sum(1, keepdims=True), joint


def fit(trees: list[Tree], labels: list[np.ndarray]) -> TreeModel:
    """Weights of the largest likelihood of the labels, drawn towards the prior; without pages, the prior itself."""
    w, pair = prior()
    model = TreeModel(w.copy(), pair.copy())
    if not trees:
        return model
    forest, y = Forest.of(trees), np.concatenate(labels).astype(int)
    n, child = len(y), np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((n, 2, 2))
    seen[child, y[forest.parents[child]], y[child]] = 1
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):
        belief, joint = model.marginals(forest)
        wrong = y - belief[:, 1]
        grads = (np.bincount(forest.inputs.ravel(), np.repeat(wrong, forest.inputs.shape[1]), SIZE) / len(trees) - PULL * (model.w - w),
                 np.stack([(seen - joint)[child][forest.kinds[child] == k].sum(0) for k in range(N_KINDS)]) / len(trees) - PULL * (model.pair - pair))
        for i, (weights, g) in enumerate(zip((model.w, model.pair), grads)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights += RATE * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def landmark_labels(tree: Tree) -> np.ndarray | None:
    """Labels of a page that marks its main text itself: content is what lies in its only ``article`` (or else ``main``)
    element, less what is marked as something else inside. None for pages without such a mark."""
    for mark in ("article", "main"):
        if tree.tags.count(mark) == 1:
            break
    else:
        return None
    top = tree.tags.index(mark)
    label = np.zeros(len(tree.tags), bool)
    label[top] = True
    for node in range(top + 1, len(label)):
        other = tree.tags[node] in ("nav", "header", "footer", "aside", "form") or bool(tree.names[node] & _BAD)
        label[node] = label[tree.parents[node]] and not other
    return label


def unmarked(tree: Tree, named: bool) -> Tree:
    """The same page written with plain containers, as many pages are: shape and text tell, and if ``named``, class names."""
    plain = {"article": "content", "main": "content", "nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "section": "text"}
    names = [frozenset({plain[t]}) if t in plain else own for t, own in zip(tree.tags, tree.names)] if named else [frozenset()] * len(tree.tags)
    return Tree(["div" if t in plain else t for t in tree.tags], names, tree.parents, tree.blocks)


def with_section(tree: Tree, label: np.ndarray, word: str, tag: str) -> tuple[Tree, np.ndarray]:
    """The same page with the last two paragraphs of its main text put into an element named ``word``, which makes them
    something else, such as comments or related articles."""
    top = int(np.flatnonzero(label)[0])
    own = [n for n in range(top + 1, len(label)) if tree.parents[n] == top and tree.tags[n] == "p"][-2:]
    if len(own) < 2:
        return tree, label
    at = own[0]
    move = lambda n: n + (n >= at)
    parents = [move(p) if p >= 0 else p for p in tree.parents]
    for n in own:
        parents[n] = at
    out = Tree(tree.tags[:at] + [tag] + tree.tags[at:], tree.names[:at] + [frozenset({word})] + tree.names[at:],
               parents[:at] + [top] + parents[at:], [(move(n), text, linked) for n, text, linked in tree.blocks])
    label = np.insert(label, at, False)
    for n in range(at + 1, len(label)):
        label[n] = label[n] and label[out.parents[n]]
    return out, label


def labelled_pages(pages: list[str]) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and labels of the pages with landmarks; some come in other forms too: without marks, with class names
    only, or with a section that is set apart by a name for something else."""
    trees, labels, turn = [], [], -1
    for page in pages:
        tree = parse(page)
        label = landmark_labels(tree)
        if label is None:
            continue
        turn += 1
        form = turn % 4
        trees.append(tree)
        labels.append(label)
        if form in (1, 3):
            tree, label = with_section(tree, label, BAD[turn % len(BAD)], ("div", "section", "ul", "aside")[turn // 4 % 4])
        if form in (0, 3):
            tree = unmarked(tree, named=form == 3 or turn % 8 == 0)
        if form != 2:
            trees.append(tree)
            labels.append(label)
    return trees, labels


def main_texts(model: TreeModel, pages: list[str]) -> list[tuple[str, int, int]]:
    """(main text, blocks kept, blocks) of each page."""
    trees = [parse(p) for p in pages]
    belief = model.marginals(Forest.of(trees))[0][:, 1] if trees else np.zeros(0)
    out, at = [], 0
    for tree in trees:
        kept = [text for node, text, _ in tree.blocks if belief[at + node] >= THRESHOLD]
        out.append((" ".join(kept), len(kept), len(tree.blocks)))
        at += len(tree.tags)
    return out


def fitted(pages: DataFrame, most: int = TRAIN_PAGES) -> TreeModel:
    """A model fitted on at most ``most`` different pages that hold a landmark, by a hash of the page.

    Pages of at most TRAIN_CHARS characters come first; longer ones fill what is left, as long as all together have at
    most ``most`` times as many characters. Hashes alone are sorted; the pages chosen are read by a second look at the
    table, so what is sent is bounded however many pages there are, and copies count once.
    """
    marked = (pages.select(F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
              .withColumn("print", F.xxhash64("html")))
    some = (marked.select("print", F.length("html").alias("size")).distinct()
            .orderBy(F.col("size") > TRAIN_CHARS, "print", "size").limit(most).collect())
    chosen, room = [], most * TRAIN_CHARS
    for row in some:
        if row["size"] <= room:
            room -= row["size"]
            chosen.append(row["print"])
    ids = pages.sparkSession.createDataFrame([(x,) for x in sorted(set(chosen))], "print long")
    found = marked.join(F.broadcast(ids), "print").groupBy("print").agg(F.min("html").alias("html")).collect()
    return fit(*labelled_pages([r["html"] for r in sorted(found, key=lambda r: r["print"])]))


def with_main_text(pages: DataFrame, column: str = "__main", most: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` with a struct column (text, kept, blocks): the main text and how many of the page's blocks it has.

    A page is parsed into a tree of block elements. Each node is content or not; node potentials weigh its element and
    class names, words and share of links, and potentials between parent and child join the decisions. Sum-product
    messages give exact marginals, and blocks of nodes at THRESHOLD or more are joined by a space in page order. The
    weights are fitted on pages that mark their main text by a landmark element, some of them in other forms too (see
    ``labelled_pages``); without such pages the prior decides.

    NULL and empty pages, and pages without text, give the empty text. Broken markup is read as far as it goes. Pages
    are independent: repeated rows get equal texts, and an empty table gives no rows. Other columns are kept,
    and where one is named ``column`` the new one gets underscores before its name.
    """
    bounded_batches(pages.sparkSession)
    model = fitted(pages, most)
    shared = pages.sparkSession.sparkContext.broadcast((model.w, model.pair))

    @F.pandas_udf("text string, kept int, blocks int")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = TreeModel(*shared.value)
        for htmls in batches:
            yield pd.DataFrame(main_texts(own, htmls.tolist()), columns=["text", "kept", "blocks"])

    return pages.withColumn(fresh(pages, column)[0], extract(F.coalesce(F.col("html").cast("string"), F.lit(""))))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("__main.text").alias("text"), F.length("__main.text").cast("long").alias("n_chars"))
