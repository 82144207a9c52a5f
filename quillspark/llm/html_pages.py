"""Main text of web pages by a tree-structured graphical model.

A page becomes its element tree with a leaf for each block of text. Every node is content or not: a local potential
comes from its tag, its class, id and role words, its text length, its share of link text and its share of the page's
text; a potential on each edge, one for each sort of child, ties it to its parent, so that a notice in an article need not
pull the article with it. Sum-product messages, up from the leaves and down from the root, give each node's marginal; the
text of leaves above one half is the page's text. All potentials are trained from labelled pages: made by rule here
(training_pages), or given by the caller. An element that holds the article's blocks is content, be it the body or the page.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed, empty ones left
out, and joined by one newline in page order. Line breaks (br) are white space. Scripts, styles, templates and comments
are never text; of elements whose content is no markup, a self-closing svg is empty, and one without an end tag, scripts
and styles apart, is passed over as a tag alone. Tags that close others by HTML's rules do so here; unclosed tags end with their parent or the page.

Defined cases: null or empty html gives an empty text; text outside any element is judged as the page's own; equal rows
stay; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import slices

#: A quote begins a quoted value right after an equals sign alone, as in HTML; elsewhere it is a character like others.
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?][^>]*>|<(?=/?[a-zA-Z!?])[^>]*$", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
# fixed values: HTML's void elements, elements whose content is no markup, inline elements, and what closes what
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: What ends the attributes of a self-closing tag: a slash that no unquoted value holds. HTML heeds it in svg alone.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'/]|(?:^|\s)[^\s=\"'/]+)/$")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
KEEPS_P = INLINE | VOID - {"hr"} | RAW | {"li", "td", "th", "tr", "option", "button", "select", "label"}
#: Words of class, id and role that the model may use, each as a feature; others count as one.
WORDS = (
    "article content post entry main body story text page blog section wrapper container "
    "ad ads advert advertisement banner sponsor sponsored promo cookie consent notice alert popup modal overlay nav navigation navbar menu breadcrumb breadcrumbs sidebar aside widget "
    "footer foot copyright legal header head masthead logo comment comments reply respond disqus discussion share social follow related recommended more subscribe newsletter signup login form search tags meta pagination"
).split()
TEXT_BINS, LINK_BINS, SHARE_BINS = np.array([1, 20, 60, 150, 400, 1200, 5000]), np.array([0.01, 0.2, 0.5, 0.9]), np.array([0.05, 0.2, 0.4, 0.6, 0.8, 0.999])
LEAF = "#text"
#: Sorts of children by tag: text, blocks, the page's frame, parts that are seldom content; of others, named and nameless ones.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption hr caption address".split())
PARTS = frozenset("nav aside header footer form button fieldset menu dialog select label".split())
SORTS = 6
#: Begins a training page whose blocks stand in no element, so that the page itself is content.
ROOT_IS_CONTENT = "<!--y=1-->"


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children. kinds: (tag, attributes) of each; leaves hold text."""

    parents: list[int]
    depths: list[int]
    kinds: list[tuple[str, str]]
    texts: dict[int, str]
    linked: list[int]  # characters of link text in each leaf
    labels: list[int]


def sort_of(kind: tuple[str, str]) -> int:
    tag, attributes = kind
    return 0 if tag == LEAF else 1 if tag in BLOCKS else 2 if tag in ("html", "body", "main") else 3 if tag in PARTS else 4 if attributes else 5


def parse(page: str, label: int = 0) -> Tree:
    """label: the page's own, for training."""
    t = Tree([-1], [0], [("#page", "")], {}, [0], [label])
    stack, run, links, in_link = [(0, "#page")], [], 0, 0

    def add(kind: tuple[str, str], label: int) -> int:
        parent = stack[-1][0]
        t.parents.append(parent), t.depths.append(t.depths[parent] + 1), t.kinds.append(kind), t.linked.append(0), t.labels.append(label)
        return len(t.parents) - 1

    def flush() -> None:
        nonlocal links
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                k = add((LEAF, ""), t.labels[stack[-1][0]])
                t.texts[k], t.linked[k] = text, min(links, len(text))
            run.clear()
        links = 0

    def close(names, barriers=()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in barriers:
                return
            if stack[i][1] in names:
                flush()
                del stack[i:]
                return

    at, end, unclosed = 0, len(page), set()
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        slash, name, attributes = m[1], m[2], m[3]
        if not name:
            continue
        name = name.lower()
        if name in RAW and not slash:
            if name == "svg" and SELF_CLOSED.search(attributes):
                continue
            shut = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not shut:  # nor has any later one of that name
                unclosed.add(name)
            if shut or name in ("script", "style"):
                at = shut.end() if shut else end
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if slash else 1
            elif name == "br":
                run.append(" ")
            continue
        if slash:
            if name == "p" and not any(x == "p" for _, x in stack):
                flush()
            close({name})
            in_link = 0
            continue
        flush()
        if name not in KEEPS_P:
            close({"p"}, ("table", "button"))
        if name in CLOSES:
            for _ in range(3):
                close(CLOSES[name], BARRIERS[name])
        found = dict((k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)) if attributes.strip(" /") else {}
        label = int(found["data-y"]) if "data-y" in found else t.labels[stack[-1][0]]
        k = add((name, " ".join(found.get(x, "") for x in ("class", "id", "role")).strip()), label)
        if name not in VOID:
            stack.append((k, name))
    flush()
    return t


def _names(kind: tuple[str, str]) -> list[str]:
    """Names of the features that tag and attributes have."""
    tag, attributes = kind
    words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes).lower()) if w}
    return [f"tag={tag}", *sorted({f"word={w}" if w in WORDS else "word=?" for w in words})]


@dataclass
class Model:
    weights: dict[str, float]
    text: np.ndarray
    link: np.ndarray
    leaf_text: np.ndarray
    share: np.ndarray
    edge: np.ndarray  # log potentials [sort of child, parent, child]

    def __post_init__(self):
        self.known: dict[tuple[str, str], float] = {}

    def of(self, kind: tuple[str, str]) -> float:
        if kind not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind] = sum(self.weights.get(n, 0.0) for n in ["bias", *_names(kind)])
        return self.known[kind]


def _joined(trees: list[Tree]):
    """parents, levels, bins of text length, link share and share of the page, whether leaf, sorts: of all nodes of all trees."""
    base = np.cumsum([0] + [len(t.parents) for t in trees])
    parents = np.concatenate([np.where(np.array(t.parents) < 0, -1, np.array(t.parents) + b) for t, b in zip(trees, base, strict=False)])
    depths = np.concatenate([np.array(t.depths) for t in trees])
    length, linked = np.zeros(base[-1]), np.concatenate([np.array(t.linked, float) for t in trees])
    for t, b in zip(trees, base, strict=False):
        length[b + np.fromiter(t.texts, int, len(t.texts))] = np.fromiter(map(len, t.texts.values()), int, len(t.texts))
    leaf = length > 0
    order = np.argsort(depths, kind="stable")
    cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    levels = [order[cuts[d] : cuts[d + 1]] for d in range(depths.max() + 1)]
    for own in levels[:0:-1]:
        np.add.at(length, parents[own], length[own])
        np.add.at(linked, parents[own], linked[own])
    share = linked / np.maximum(length, 1)
    of_page = length / np.maximum(1, np.repeat(length[base[:-1]], np.diff(base)))
    sorts = np.fromiter((sort_of(k) for t in trees for k in t.kinds), int, base[-1])
    return parents, levels, np.digitize(length, TEXT_BINS), np.digitize(share, LINK_BINS), np.digitize(of_page, SHARE_BINS), leaf, sorts, base


def sum_product(local: np.ndarray, edge: np.ndarray, parents: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each node is content, probabilities [node, parent's state, own state]) for all trees at once,
    level by level. local: log potential of content against not; edge: log potentials [parent, child], of each node or
    of all."""
    edge = np.broadcast_to(edge, (len(local), 2, 2))
    below = np.stack([np.zeros_like(local), local], axis=1)
    up, down = np.zeros_like(below), np.zeros_like(below)
    for own in levels[:0:-1]:
        up[own] = np.logaddexp(edge[own, :, 0] + below[own, :1], edge[own, :, 1] + below[own, 1:])
        np.add.at(below, parents[own], up[own])
    pair = np.zeros((len(local), 2, 2))
    for own in levels[1:]:
        rest = below[parents[own]] + down[parents[own]] - up[own]
        both = rest[:, :, None] + edge[own] + below[own][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pair[own] = both / both.sum(axis=(1, 2), keepdims=True)
        down[own] = np.logaddexp(rest[:, :1] + edge[own, 0], rest[:, 1:] + edge[own, 1])
        down[own] -= down[own].max(axis=1, keepdims=True)
    belief = below + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def marginals(trees: list[Tree], model: Model) -> list[np.ndarray]:
    """The probability that each node of each tree is content."""
    parents, levels, text, link, share, leaf, sorts, base = _joined(trees)
    local = np.fromiter((model.of(k) for t in trees for k in t.kinds), float, base[-1])
    local += np.where(leaf, model.leaf_text[text], model.text[text]) + model.link[link] + model.share[share]
    return np.split(sum_product(local, model.edge[sorts], parents, levels)[0], base[1:-1])


def train(pages: list[str], rounds: int = 250) -> Model:
    """pages: html with data-y="1" on elements that are content and data-y="0" on such that aren't; children are as
    their parent unless labelled. All potentials climb the likelihood of the labels together: its slope is what the
    labels show of each feature and pair, less what the marginals expect."""
    trees = [parse(p, int(p.startswith(ROOT_IS_CONTENT))) for p in pages]
    parents, levels, text, link, share, leaf, sorts, _ = _joined(trees)
    y = np.concatenate([np.array(t.labels, float) for t in trees])
    kinds = [k for t in trees for k in t.kinds]
    distinct = sorted(set(kinds))
    names = ["bias", *sorted({n for k in distinct for n in _names(k)})]
    place, row = {n: i for i, n in enumerate(names)}, {k: i for i, k in enumerate(distinct)}
    of_kind = np.zeros((len(distinct), len(names)))
    of_kind[:, 0] = 1
    for k, i in row.items():
        of_kind[i, [place[n] for n in _names(k)]] = 1
    kind = np.array([row[k] for k in kinds])
    n_text, n_link, n_share = len(TEXT_BINS) + 1, len(LINK_BINS) + 1, len(SHARE_BINS) + 1
    slot = np.where(leaf, n_text, 0) + text
    ends = np.cumsum([0, len(names), 2 * n_text, n_link, n_share, 4 * SORTS])
    w = np.zeros(ends[-1])
    parts = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    inner = parents >= 0
    states = (sorts[inner], y[parents[inner]].astype(int), y[inner].astype(int))
    seen = np.zeros((SORTS, 2, 2))
    np.add.at(seen, states, 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        names_w, text_w, link_w, share_w, edge_w = (w[p] for p in parts)
        local = (of_kind @ names_w)[kind] + text_w[slot] + link_w[link] + share_w[share]
        p, pair = sum_product(local, edge_w.reshape(SORTS, 2, 2)[sorts], parents, levels)
        miss = y - p
        expected = np.zeros_like(seen)
        np.add.at(expected, sorts[inner], pair[inner])
        slope = np.concatenate([of_kind.T @ np.bincount(kind, miss, len(distinct)), np.bincount(slot, miss, 2 * n_text), np.bincount(link, miss, n_link), np.bincount(share, miss, n_share), (seen - expected).reshape(-1)])
        slope -= 0.5 * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w += 0.15 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    names_w, text_w, link_w, share_w, edge_w = (w[p] for p in parts)
    return Model(dict(zip(names, names_w.tolist(), strict=True)), text_w[:n_text], link_w, text_w[n_text:], share_w, edge_w.reshape(SORTS, 2, 2))


def training_pages(count: int = 900, seed: int = 5) -> list[str]:
    """Labelled pages made by rule: an article amid, and with, the usual other parts, or alone. It stands in one of the
    usual containers, in one whose name says nothing, or in none, and has one block or many, short or long, some of them
    links."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiourstlnmd") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b))).capitalize() + "."

    def items(a: int, b: int, linked: bool) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' if linked else f"<li>{words(3, 20)}</li>" for i in range(r.randint(a, b))) + "</ul>"

    def named(options: str) -> str:
        return f'{r.choice(["class", "id"])}="{r.choice(options.split(","))}"'

    def block() -> str:
        kind = r.random()
        if kind < 0.62:
            turn = r.random()
            inside = words(1, 120) if turn < 0.82 else f'{words(4, 20)} <a href="/x">{words(1, 4)}</a> {words(4, 30)}' if turn < 0.9 else f'<a href="/x">{words(3, 30)}</a>'
            return f"<p>{f'<b>{inside}<br>' if r.random() < 0.12 else inside}" + ("</p>" if r.random() < 0.9 else "")
        if kind < 0.72:
            return f"<h{(n := r.randint(2, 4))}>{words(1, 8)}</h{n}>"
        if kind < 0.8:
            return items(2, 6, r.random() < 0.3)
        if kind < 0.86:
            return f"<blockquote>{words(5, 40)}</blockquote>"
        if kind < 0.9:
            return f"<pre>{words(3, 30)}</pre>"
        if kind < 0.94:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr><tr><td>{words(1, 5)}</td></tr></table>"
        if kind < 0.97:
            return f"<section><h2>{words(1, 6)}</h2><p>{words(5, 60)}</p></section>"
        return f"<div>{words(5, 80)}</div>"

    def other() -> str:
        advert, side = "ad,ads,advert,advertisement,ad-banner,sponsored,promo,banner", "sidebar,widget,related,related-posts,more,recommended"
        notice, talk = "cookie-notice,notice,consent,alert,popup,modal,cookie-banner,overlay", "comments,comment-list,discussion,disqus,respond"
        return r.choice(
            (
                lambda: f'<nav data-y="0">{items(2, 8, True)}</nav>',
                lambda: f'<div {named("menu,nav,navbar,navigation,breadcrumb,breadcrumbs")} data-y="0">{items(2, 8, True)}</div>',
                lambda: f'<ul {named("menu,nav,social,share,tags,pagination,breadcrumb")} data-y="0"><li><a href="/">{words(1, 2)}</a></li><li><a href="/b">{words(1, 3)}</a></li></ul>',
                lambda: f'<div {named(advert)} data-y="0">{words(3, 40) if r.random() < 0.5 else f"<p>{words(3, 60)}</p>"}</div>',
                lambda: f'<aside data-y="0"{" " + named(side) if r.random() < 0.5 else ""}><h3>{words(1, 4)}</h3>{items(2, 5, r.random() < 0.6)}<p>{words(5, 50)}</p></aside>',
                lambda: f'<div {named(side)} data-y="0"><h3>{words(1, 4)}</h3><p>{words(5, 70)}</p>{items(1, 4, True)}</div>',
                lambda: f'<div {named(notice)} data-y="0"><p>{words(5, 50)}</p><button>{words(1, 2)}</button></div>',
                lambda: f'<section {named(talk)} data-y="0"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="{r.choice(["comment", "reply"])}"><p>{words(3, 80)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
                lambda: f'<div {named("comment,reply," + talk)} data-y="0"><p>{words(3, 90)}</p></div>',
                lambda: f'<ol {named(talk)} data-y="0">' + "".join(f"<li>{words(3, 60)}</li>" for _ in range(r.randint(1, 4))) + "</ol>",
                lambda: f'<form data-y="0"{" " + named("search,signup,login,newsletter,subscribe,form") if r.random() < 0.5 else ""}><label>{words(1, 4)}</label><input name="q"><p>{words(3, 20)}</p><button>{words(1, 2)}</button></form>',
                lambda: f'<div {named("newsletter,subscribe,signup,share,social,follow")} data-y="0"><p>{words(3, 30)}</p></div>',
                lambda: f'<p class="{r.choice(["copyright", "legal", "notice", "ad", "promo"])}" data-y="0">{words(3, 30)}</p>',
            )
        )()

    def plain() -> str:
        """A container whose name says nothing, or one that has no name."""
        name = r.choice(("", "", f' class="{words(1, 2)[:-1].lower()}"', ' class="c-rich__copy"', ' class="postBody"', ' id="x1"', ' class="td-prose clearfix"'))
        return f"<{r.choice(('div', 'div', 'section'))}{name}>"

    out = []
    for _ in range(count):
        kind = r.random()
        if kind < 0.55:
            opening = r.choice(["<article>", "<article>", "<article>", "<main>", "<main><article>", *(f"<div {named('content,post,entry,article,article-body,story,main-content,post-content,entry-content,text,page-content')}>" for _ in range(3)), f"<section {named('content,post,article,story')}>"])
        else:
            opening = plain() if kind < 0.78 else ""
        tags = re.findall(r"<(\w+)", opening)
        count_of = 1 if r.random() < 0.25 else r.randint(1, 3) if r.random() < 0.35 else r.randint(2, 14)
        body = [f"<h1>{words(1, 9)}</h1>" if r.random() < 0.7 else "", *(block() for _ in range(count_of))]
        if r.random() < 0.4:
            body.insert(r.randint(1, len(body)), other())
        if r.random() < 0.3:
            body.append(other())
        article = opening[:-1] + ' data-y="1">' + "".join(body) + "".join(f"</{t}>" for t in reversed(tags)) if opening else "".join(body)
        own = "" if opening else ' data-y="1"'  # the element that the blocks stand in is content
        if r.random() < 0.3:  # nothing else
            bare = words(2, 200) if not opening and r.random() < 0.3 else article
            out.append(f"{ROOT_IS_CONTENT if own else ''}{bare}" if r.random() < 0.5 else f"<html><body{own}>{bare}</body></html>")
            continue
        before = [other() for _ in range(r.randint(0, 3))]
        after = [other() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            before.insert(0, f'<header data-y="0"{" " + named("header,masthead,head") if r.random() < 0.5 else ""}><h1>{words(1, 3)}</h1><p>{words(1, 9)}</p></header>')
        elif r.random() < 0.5:
            before.insert(0, f'<div {named("header,masthead,logo,head")} data-y="0">{words(1, 6)}</div>')
        if r.random() < 0.6:
            after.append(f'<footer data-y="0">{words(1, 30) if r.random() < 0.6 else f"<p>{words(3, 40)}</p>"}</footer>')
        elif r.random() < 0.5:
            after.append(f'<div {named("footer,foot,copyright,legal")} data-y="0"><p>{words(3, 40)}</p></div>')
        inside = "".join(before) + article + "".join(after)
        if r.random() < 0.35:
            inside = f'<div {named("wrapper,container,page,main,body,site")}{own}>{inside}</div>'
            own = ""
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body{own}>{inside}</body></html>")
    return out


def extract(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    return ["\n".join(x for k, x in t.texts.items() if p[k] > 0.5) for t, p in zip(trees, marginals(trees, model), strict=True)] if trees else []


@lru_cache(maxsize=1)
def default_models() -> tuple[Model]:
    return (train(training_pages()),)


def main_text(pages: DataFrame, models: tuple[Model] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    models = models or default_models()

    def run(batches):
        for b in slices(batches, "html", 2_000_000):
            text = extract([x or "" for x in b.column("html").to_pylist()], *models)
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
