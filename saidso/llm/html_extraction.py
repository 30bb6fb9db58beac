"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no kept node has a dropped ancestor.

A page becomes a tree of block elements. Each node gets features: size and text of its subtree, density of text and links,
tag, attribute words of its own and above it, depth, place among its siblings and how it compares with them. Boosted trees
give each node the chance that it belongs to the main text. Decoding picks, over the whole tree at once, the most likely
set of kept nodes of which every ancestor is kept too, so an advert inside an article goes, and nothing inside a dropped
sidebar stays.

The trees are trained on the SAMPLE distinct pages (url and html) of 1 to LONGEST characters with the smallest hashes,
whose nodes are labelled by what HTML itself says (article, nav, aside, class words), and on pages composed from their
texts with parts of known kind, some without telling names. Extraction covers every page, whole, one batch at a time.

Text is what blocks show: character references decoded, white space inside a block as one space (a line break too),
blocks in page order joined by an empty line. Scripts, styles, comments in the markup, form fields and what is not shown
are never text. Defined results: null or empty html, and pages without main text, give an empty text; unclosed and stray
tags are read as browsers mostly do; repeated rows are extracted alike; an input column named text is replaced; an
empty table gives an empty table; where no page can be learned from, the labels by what HTML itself says decide.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saidso.llm.sampling import smallest_hashes
from saidso.session import materialize

#: Pages that the trees are trained on, and the longest of them.
SAMPLE, LONGEST = 300, 100_000
#: Pages composed of the sample's texts.
COMPOSED = 500

# Kinds of elements, and attribute words that tell what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed".split())
HIDDEN = frozenset("head script style noscript template svg iframe object select textarea button title canvas video audio math".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset search".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus foot footer form gdpr header login masthead menu menubar meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main page post story text".split())
TAG_KINDS = ("p", "div", "section", "li", "ul", "ol", "h1", "h2", "h3", "blockquote", "pre", "td", "table", "article", "main", "body")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.S)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """Block elements in page order, and the runs of text (node, text) in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[frozenset] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str) -> int:
        self.tags.append(tag), self.parents.append(parent)
        named = [CAMEL.sub(" ", "".join(m)).lower() for m in NAMED.findall(attributes)] if "=" in attributes else []
        self.words.append(frozenset(WORDS.findall(" ".join(named))) if named else frozenset())
        self.marks.append("")
        self.own.append(0), self.linked.append(0), self.controls.append(0), self.inline.append(0)
        return len(self.tags) - 1


def parse(page: str) -> Tree:
    tree = Tree()
    node = tree.add("html", -1, "")
    opened: list[tuple[str, int]] = [("html", node)]  # every open element and the block it stands in
    # Where each tag, and any block, is open, so that no step looks through the open elements.
    places: dict[str, list[int]] = defaultdict(list)
    blocks = [0]
    hidden = links = 0
    pieces: list[str] = []
    # Behind the last bracket nothing ends a tag.
    at, reach = 0, page.rfind(">") + 1

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        if text:
            tree.runs.append((node, text))
            tree.own[node] += len(text)

    def leave(count: int) -> None:
        nonlocal node, hidden, links
        for _ in range(count):
            tag, _ = opened.pop()
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
                flush()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            node = opened[-1][1] if opened else 0

    while at < len(page):
        found = TOKEN.search(page, at, reach)
        data = page[at : found.start()] if found else page[at:].partition("<!--")[0]
        if data and not hidden:
            pieces.append(data)
            if links:
                tree.linked[node] += len(data.strip())
        if not found:
            break
        at = found.end()
        if found[0].startswith("<!--") and not found[0].endswith("-->"):
            break  # a comment that nobody closed
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag != "html" and places[tag]:
                leave(len(opened) - places[tag][-1])
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            elif tag == "input":
                tree.controls[node] += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, reach)
            at = end.end() if end else len(page)
            tree.controls[node] += tag == "textarea"
            continue
        if tag == "html" or (tag == "body" and places[tag]):
            continue
        if tag in BLOCKS:
            if opened[blocks[-1]][0] == "p":
                leave(len(opened) - blocks[-1])
            if tag in CLOSES:
                fence = max((places[f][-1] for f in FENCES[tag] if places[f]), default=0)
                # The first of these inside the fence: of each kind the list is sorted.
                after = ((places[c], bisect_right(places[c], fence)) for c in CLOSES[tag])
                same = min((where[i] for where, i in after if i < len(where)), default=0)
                if same:
                    leave(len(opened) - same)
            if tag == "body" and hidden:
                leave(len(opened) - 1)  # a head that nobody closed
            flush()
            if not hidden:
                node = tree.add(tag, node, attributes)
        else:
            tree.inline[node] += 1
            tree.controls[node] += tag in ("button", "select", "label")
        hidden += tag in HIDDEN
        links += tag == "a"
        if not attributes.endswith("/") or tag in BLOCKS:
            places[tag].append(len(opened))
            if tag in BLOCKS:
                blocks.append(len(opened))
            opened.append((tag, node))
        else:
            hidden -= tag in HIDDEN
            links -= tag == "a"
    leave(len(opened) - 1)
    flush()
    return tree


def features(tree: Tree) -> np.ndarray:
    """One row of features per node."""
    n = len(tree.tags)
    parents = tree.parents
    text, link, tags, controls, paragraphs, items, stops = (list(x) for x in (tree.own, tree.linked, [1 + i for i in tree.inline], tree.controls, [int(t == "p") for t in tree.tags], [int(t == "li") for t in tree.tags], [0] * n))
    begins = [0] * n
    seen, run_start = 0, {}
    for node, body in tree.runs:
        stops[node] += body.count(". ") + body.count(", ") + (body[-1] in ".!?")
        run_start.setdefault(node, seen)
        seen += len(body)
    for i in range(n):
        begins[i] = run_start.get(i, -1)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        link[p] += link[i]
        tags[p] += tags[i]
        controls[p] += controls[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
        stops[p] += stops[i]
        if begins[i] >= 0 and (begins[p] < 0 or begins[i] < begins[p]):
            begins[p] = begins[i]
    depth, above_aside, above_main, word_aside, word_main = ([0] * n for _ in range(5))
    place, siblings = [0] * n, [0] * n
    for i in range(n):
        p, tag, words = parents[i], tree.tags[i], tree.words[i]
        aside, main = tag in ASIDE_TAGS, tag in MAIN_TAGS
        by_word, by_main = bool(words & ASIDE_WORDS), bool(words & MAIN_WORDS)
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = siblings[p]
            siblings[p] += 1
            # An outline element inside an article (its own header or footer) is not the page's.
            above_aside[i], above_main[i] = above_aside[p] + aside, above_main[p] + main
            word_aside[i], word_main[i] = word_aside[p] + by_word, word_main[p] + by_main
    total = max(seen, 1)
    columns = []
    t, l, g = np.array(text, float), np.array(link, float), np.array(tags, float)
    up = np.maximum(np.array(parents), 0)
    count = np.array(siblings, float)
    mean = t[up] / np.maximum(count[up], 1)
    columns += [np.log1p(t), t / total, np.log1p(np.array(tree.own, float)), l / np.maximum(t, 1), np.log1p(g), t / g, np.array(stops) / np.maximum(t / 50, 1), np.log1p(np.array(paragraphs, float)), np.array(items) / g, np.log1p(np.array(controls, float))]
    columns += [np.array(depth, float), np.array(place, float), np.array(place) / np.maximum(count[up], 1), count[up], count, np.log1p(t) - np.log1p(mean), t / np.maximum(t[up], 1), np.array(begins) / total]
    columns += [np.array(x, float) for x in (above_aside, above_main, word_aside, word_main)]
    columns += [np.array([x in ASIDE_TAGS for x in tree.tags], float), np.array([bool(w & ASIDE_WORDS) for w in tree.words], float), np.array([bool(w & MAIN_WORDS) for w in tree.words], float)]
    columns += [(l / np.maximum(t, 1))[up], (t / g)[up]]
    kinds = np.array([TAG_KINDS.index(x) if x in TAG_KINDS else -1 for x in tree.tags])
    columns += [(kinds == k).astype(float) for k in range(len(TAG_KINDS))]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Trees of fixed depth as arrays: feature and limit of each inner node, value of each leaf."""

    base: float
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for f, lim, v in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > lim[at])
            out += v[at - (len(v) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss, split by second-order gain over quantile bins."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    inner, margin = (1 << depth) - 1, np.full(len(y), base)
    all_f, all_l, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, lim, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins + 1)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            local, width = at - first, 1 << level
            gains = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                key = local * (bins + 1) + binned[:, j]
                gs, hs = (np.bincount(key, w, width * (bins + 1)).reshape(width, -1) for w in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[:, len(cuts[j]) :] = 0
                best = gain.argmax(1)
                better = gain[np.arange(width), best] > gains
                for k in np.nonzero(better)[0]:
                    gains[k] = gain[k, best[k]]
                    f[first + k], lim[first + k], cut_bin[first + k] = j, cuts[j][best[k]], best[k]
            at = 2 * at + 1 + (binned[np.arange(len(y)), f[at]] > cut_bin[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        margin = margin + value[leaf]
        all_f.append(f), all_l.append(lim), all_v.append(value)
    return Trees(base, depth, np.array(all_f), np.array(all_l), np.array(all_v))


def decoded(parents: list[int], margin: np.ndarray) -> list[bool]:
    """The most likely kept nodes such that the parent of a kept node is kept: whole subtrees go or stay by their sum."""
    gain = margin.tolist()  # log odds: what keeping a node adds over dropping it
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    kept = [False] * len(gain)
    for i, p in enumerate(parents):
        kept[i] = gain[i] > 0 and (p < 0 or kept[p])
    return kept


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    rows = [features(t) for t in parsed]
    margins = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    out = []
    for tree, margin in zip(parsed, margins):
        if not len(trees.feature):  # no page could be learned from: what HTML itself says decides
            margin = 2 * labels_of(tree) - 1
        kept = decoded(tree.parents, margin)
        out.append("\n\n".join(body for node, body in tree.runs if kept[node]))
    return out


def labels_of(tree: Tree) -> np.ndarray:
    """What HTML itself says: nothing under page furniture is main text, and where there is an article, nothing beside it."""
    n = len(tree.tags)
    dropped, inside, within = [False] * n, [False] * n, [False] * n
    has_main = any(t in MAIN_TAGS for t in tree.tags)
    for i, p in enumerate(tree.parents):
        dropped[i] = (p >= 0 and dropped[p]) or tree.tags[i] in ASIDE_TAGS or bool(tree.words[i] & ASIDE_WORDS)
        within[i] = tree.tags[i] in MAIN_TAGS or (p >= 0 and within[p])
        inside[i] = not dropped[i] and (within[i] or not has_main)
    holds = [False] * n
    for i in range(n - 1, -1, -1):
        holds[i] |= inside[i] and (tree.own[i] > 0)
        if holds[i] and tree.parents[i] >= 0 and not dropped[tree.parents[i]]:
            holds[tree.parents[i]] = True
    return np.array(holds, float)


def composed(texts: list[str], count: int, seed: int = 7) -> list[str]:
    """Pages built from `texts`: main blocks carry the attribute data-k="1", everything else data-k="0"."""
    rnd = random.Random(seed)
    pick = lambda: rnd.choice(texts)
    short = lambda: " ".join(pick().split()[: rnd.randint(1, 8)])
    clue = lambda word: f' class="{word}"' if rnd.random() < 0.85 else f' class="c{rnd.randint(1, 99)}"'
    links = lambda k: "<ul data-k=0>" + "".join(f'<li data-k=0><a href="/{i}">{short()}</a></li>' for i in range(k)) + "</ul>"
    box = lambda tag, word, body: f"<{tag}{clue(word)} data-k=0>{body}</{tag}>"
    sentence = lambda: f"<p data-k=0>{pick()}</p>" if rnd.random() < 0.5 else pick()
    furniture = [
        lambda: f"<nav data-k=0>{links(rnd.randint(2, 8))}</nav>", lambda: box("div", rnd.choice(["menu", "navbar", "breadcrumbs"]), links(rnd.randint(2, 6))), lambda: f"<header data-k=0>{box('div', 'masthead', short())}{links(3)}</header>",
        lambda: f"<footer data-k=0>{sentence()}</footer>", lambda: box("div", "footer", "&copy; " + pick()), lambda: f"<aside data-k=0><h3 data-k=0>{short()}</h3>{sentence()}{links(rnd.randint(0, 4))}</aside>", lambda: box("div", "sidebar", f"<h3 data-k=0>{short()}</h3>" + sentence() + links(3)),
        lambda: f'<div class="{rnd.choice(["ad", "ads", "advert", "sponsored", "promo"])}" data-k=0>{sentence()}</div>', lambda: f'<div class="{rnd.choice(["notice", "cookie-notice", "banner", "consent"])}" data-k=0>{sentence()}</div>',
        lambda: f"<form data-k=0>{sentence()}<label>{short()}</label><input><button>{short()}</button></form>", lambda: f'<div class="{rnd.choice(["newsletter", "subscribe", "signup"])}" data-k=0>{sentence()}<input></div>',
        lambda: f'<section {rnd.choice(["id", "class"])}="comments" data-k=0><h2 data-k=0>{short()}</h2>' + "".join(f'<div class="comment" data-k=0><p data-k=0>{pick()}</p></div>' for _ in range(rnd.randint(1, 5))) + "</section>",
        lambda: box("div", rnd.choice(["related", "share", "tags"]), links(rnd.randint(2, 5))),
    ]
    main = [
        lambda: f"<p data-k=1>{pick()}</p>", lambda: f"<p data-k=1>{pick()}</p>", lambda: f"<p data-k=1>{pick()} {pick()}</p>", lambda: f"<p data-k=1>{short()}</p>", lambda: f"<h2 data-k=1>{short()}</h2>", lambda: f"<blockquote data-k=1><p data-k=1>{pick()}</p></blockquote>",
        lambda: "<ul data-k=1>" + "".join(f"<li data-k=1>{short()}</li>" for _ in range(3)) + "</ul>", lambda: f"<pre data-k=1>{short()}</pre>", lambda: f'<p data-k=1>{pick()} <a href="/x">{short()}</a> {short()}</p>', lambda: f"<table data-k=1><tr data-k=1><td data-k=1>{short()}</td><td data-k=1>{short()}</td></tr></table>",
    ]
    pages = []
    for _ in range(count):
        blocks = [rnd.choice(main)() for _ in range(rnd.randint(1, 9))]
        if rnd.random() < 0.8:
            blocks.insert(0, f"<h1 data-k=1>{short()}</h1>")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            blocks.insert(rnd.randint(0, len(blocks)), rnd.choice(furniture[5:])())
        tag, word = rnd.choice([("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("section", "story")])
        body = f"<{tag}" + (f' class="{word}"' if word else "") + " data-k=1>" + "".join(blocks) + f"</{tag}>"
        if rnd.random() < 0.3:
            body = f'<div class="{rnd.choice(["wrapper", "container", "page"])}" data-k=1>' + "".join(rnd.choice(furniture)() for _ in range(rnd.randint(0, 2))) + body + "</div>"
        before, after = ("".join(rnd.choice(furniture)() for _ in range(rnd.randint(0, 3))) for _ in range(2))
        pages.append(f"<html><head><title>{short()}</title></head><body data-k=1>{before}{body}{after}</body></html>")
    return pages


def train(pages: list[str], count: int = COMPOSED) -> Trees:
    """Trees from the sample's own pages and from pages composed of their texts."""
    own = [parse(p) for p in pages]
    x = [features(t) for t in own]
    y = [labels_of(t) for t in own]
    texts = [body[:600] for t in own for _, body in t.runs if len(body) > 20][:5000] or ["one two three four five six seven eight nine ten, and then some more."]
    if pages:
        for page in composed(texts, count):
            marks = [m == "1" for m in re.findall(r"data-k=(\d)", page)]
            tree = parse(re.sub(r" ?data-k=\d", "", page))
            # The parser adds the html node; all other nodes come in the order of their marks.
            if len(tree.tags) == len(marks) + 1:
                x.append(features(tree))
                y.append(np.array([1.0, *marks]))
    if not x:
        return Trees(-1.0, 1, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    return boost(np.concatenate(x), np.concatenate(y))


def fit(pages: DataFrame, html: str = "html", key: str = "url", sample: int = SAMPLE) -> Trees:
    """Trees fitted on the `sample` distinct pages with the smallest hashes that can be learned from; only these come to the driver."""
    usable = pages.select(key, html).where(F.length(html).between(1, LONGEST))
    # Repeated pages count once: candidates are cut by hash, as the sample is, before they are made distinct.
    hashed = materialize(usable.select(F.xxhash64(key, html).alias("_page")).distinct())
    few = F.broadcast(smallest_hashes(hashed, sample, "_page"))
    chosen = usable.withColumn("_page", F.xxhash64(key, html)).join(few, "_page", "left_semi").dropDuplicates(["_page"])
    return train([r[html] for r in sorted(chosen.collect(), key=lambda r: r["_page"])])


def main_text(html: Column, trees: Trees) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        values = pages.tolist()
        return pd.Series([t for i in range(0, len(values), 64) for t in main_texts(values[i : i + 64], trees)], dtype=object)

    return extract(html)


def extract_text(pages: DataFrame, html: str = "html", trees: Trees | None = None) -> DataFrame:
    """`pages` without their markup, with text and n_chars."""
    found = pages.withColumn("text", main_text(F.col(html), trees or fit(pages, html)))
    return found.drop(*({html} - {"text"})).withColumn("n_chars", F.length("text").cast("long"))
