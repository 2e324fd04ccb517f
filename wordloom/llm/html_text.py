"""Main text of web pages by a minimum cut.

A page is split into blocks of text at its block elements. A logistic regression over
features of a block and of its place in the document (elements and names around it,
link density, length, sentences) gives each block a probability of content. In a
graph of the blocks, the costs of the two labels are the capacities to the two
terminals; neighbours in the page, and neighbours among the blocks of one parent,
are joined by edges that weigh more the more of their ancestors they share. The
minimum cut, found by maximum flow, labels all blocks at once.

The classifier is trained for each call on ``MADE`` pages made from templates, whose
labels are known, and on at most ``SAMPLE`` pages of the input whose article or main
element labels their blocks (those with the smallest hashes of their ids). Everything
else reads every page whole.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, renamed_clashes, table

MADE, SAMPLE, SEED = 600, 300, 11
#: Weight of the edge between blocks that share all ancestors, and what each ancestor that they don't share leaves of it.
SMOOTH, FADE = 1.2, 0.5
#: What is left of an edge between blocks of which one alone is in something that is named as no content.
BORDER = 0.2

#: A quote opens a value only after an equals sign; one that never closes is part of a name, so its tag ends at the next >.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:{_VALUE})?+)*+)>|<[/!?][^>]*+>|<(?=[a-zA-Z/!?])", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their contents are never text.
HIDDEN = frozenset("script style noscript template head title select textarea button iframe object svg canvas audio video map datalist".split())
#: What else opens in a head ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element of these closes an open one of the same group first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs toolbar topbar",
    "header": "header masthead banner logo branding", "footer": "footer foot copyright contentinfo colophon legal",
    "side": "sidebar aside side widget widgets complementary related recommended trending popular share social sharing tags rail",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall signup disclaimer message warning announcement",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp",
    "form": "form search login register contact", "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews thread",
    "content": "article post entry story content main maincontent body text articlebody postbody entrycontent page prose",
}
NAMES = {k: frozenset(v.split()) for k, v in NAMES.items()}
_ELEMENTS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "article": "content", "main": "content"}
GROUPS = list(NAMES)
FEATURES = ["one", *GROUPS, *(f"{g}_inmost" for g in GROUPS), "outside", "bare", "header_in_content", "heading", "item", "paragraph", "links", "length", "long", "sentences", "short", "copyright", "capitals"]


class Block:
    __slots__ = ("at", "groups", "linked", "parts", "path", "tag", "text")

    def __init__(self, path, tag, groups):
        self.path, self.tag, self.groups, self.parts, self.linked, self.text, self.at = path, tag, groups, [], 0, "", 0


def _groups(tag: str, attributes: str) -> frozenset:
    found, named = {_ELEMENTS[tag]} if tag in _ELEMENTS else set(), set()
    if tag not in ("html", "body") and attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            tokens = {t.lower() for t in re.findall(r"[A-Za-z][a-z]*|[A-Z]+", value)} | {t.lower() for t in re.findall(r"[A-Za-z]+", value)}
            named |= {g for g, names in NAMES.items() if names & tokens}
    return frozenset(found | (named - {"content"} or named))  # a main menu is a menu


def blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order; their white space is one space each. Elements left open end with the page."""
    page = page or ""
    stack: list[tuple[str, int, frozenset]] = []  # element, its number, its groups
    out, block, number, hidden, links, at = [], None, 0, 0, 0, 0

    def pop_to(k: int) -> None:
        nonlocal block, hidden, links
        for tag, _, _ in stack[k:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCKS:
                block = None
        del stack[k:]

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)

    def add(raw: str) -> None:
        nonlocal block
        if hidden and not raw.isspace() and raw:
            end_head()
        if hidden or not raw:
            return
        if block is None:
            if raw.isspace():
                return
            inner = [x for x in stack if x[0] in BLOCKS]
            block = Block(tuple(x[1] for x in inner), inner[-1][0] if inner else "", [x[2] for x in inner])
            out.append(block)
        block.parts.append(raw)
        if links:
            block.linked += len(raw.strip())

    size, scan = len(page), _TOKEN.search
    while at < size:
        m = scan(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<":  # a tag that never ends: the rest of the page is markup
                break
            continue
        tag, kind = m[2].lower(), m[1]
        if kind == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                if tag in BLOCKS:
                    block = None
            continue
        if kind:
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in CLOSES or tag in BLOCKS:
            ends = CLOSES.get(tag, ()) if tag in CLOSES else ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl", "article", "section", "div", "td", "body") and stack[k][0] != tag:
                    break
        if tag in BLOCKS:
            block = None
        if tag == "br":
            add(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else size
        number += 1
        stack.append((tag, number, _groups(tag, m[3])))
        hidden += tag in HIDDEN
        links += tag == "a"
    kept = []
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            b.at = len(kept)
            kept.append(b)
    return kept


def has_content(own: list[Block]) -> bool:
    return any("content" in g for b in own for g in b.groups)


def features(b: Block, marked: bool) -> list[float]:
    """``marked``: whether the page has a container of content at all."""
    around = frozenset().union(*b.groups) if b.groups else frozenset()
    inmost = next((g for g in reversed(b.groups) if g), frozenset())
    words, n = b.text.count(" ") + 1, len(b.text)
    ends = sum(map(b.text.count, ".!?"))
    letters = sum(map(str.isupper, b.text[:400]))
    return [
        1.0, *(float(g in around) for g in GROUPS), *(float(g in inmost) for g in GROUPS), float(marked and "content" not in around), float(not marked), float("header" in inmost and "content" in around), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "dd", "dt", "td", "th")), float(b.tag in ("p", "blockquote", "pre")),
        min(1.0, b.linked / n), math.log1p(words) / 5, float(words >= 12), min(1.0, ends / 5), float(words < 6), float("©" in b.text or "copyright" in b.text.lower()), letters / min(n, 400),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.003, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)) / 10, x.T @ (y - p) / len(y) - ridge * w / 10)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page from templates, and the texts of its content blocks."""
    word = lambda: "".join(rng.choice("ba de fi go lu ma ne po ri so ta ve".split()) for _ in range(rng.randrange(1, 4)))
    sentence = lambda lo=4, hi=18: " ".join(word() for _ in range(rng.randrange(lo, hi))).capitalize() + "."
    para = lambda: " ".join(sentence() for _ in range(rng.randrange(1, 6)))
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    items = lambda n=6: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, n))) + "</ul>"
    inside = lambda tag, names, body: f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(sorted(names))}">{body}</{tag.split()[0]}>'
    prose = lambda: "".join(f"<p>{para()}</p>" for _ in range(rng.randrange(1, 4)))
    junk = [
        lambda: f"<nav>{items()}</nav>", lambda: inside("div", NAMES["menu"], items()), lambda: f"<header><h1>{word()}</h1><p>{sentence()}</p></header>", lambda: inside("div", NAMES["header"], f"<h2>{sentence(1, 4)}</h2>{link()}"),
        lambda: f"<aside><h3>{word()}</h3>{rng.choice((items, prose))()}</aside>", lambda: inside("div", NAMES["side"], f"<h3>{word()}</h3>{rng.choice((items, prose))()}"), lambda: inside("div", NAMES["notice"], f"<p>{sentence()} {link()}</p>"), lambda: inside("section", NAMES["notice"], prose()),
        lambda: inside("div", NAMES["advert"], rng.choice((sentence(), f"<p>{para()}</p>"))), lambda: f"<form><label>{word()}</label><p>{sentence()}</p></form>", lambda: inside("div", NAMES["form"], f"<p>{sentence()}</p>"),
    ]
    tail = [lambda: f"<footer><p>&copy; {word()} {sentence(1, 6)}</p>{items()}</footer>", lambda: inside("div", NAMES["footer"], f"<p>{sentence()}</p>"), lambda: inside(rng.choice(("div", "section", "ol")), NAMES["comment"], "".join(f"<div><b>{word()}</b><p>{para()}</p></div>" for _ in range(rng.randrange(1, 5))))]
    own = [sentence(2, 8)] + [rng.choice((para, sentence))() for _ in range(rng.randrange(1, 12))]
    shape = lambda i, t: f"<h{rng.choice((1, 2))}>{t}</h1>" if i == 0 else rng.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</li></ul>", f"<h3>{t}</h3>"))
    body = [re.sub(r"^<h(\d)>(.*)</h\d>$", r"<h\1>\2</h\1>", shape(i, t)) for i, t in enumerate(own)]
    if rng.random() < 0.3:
        body[0] = f"<header>{body[0]}</header>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        body.insert(rng.randrange(1, len(body) + 1), rng.choice(junk[4:9])())
    if rng.random() < 0.3:
        body.append(rng.choice(tail)())
    body = "".join(body)
    wrap = rng.choice((f'<div class="{word()}">{body}</div>', f'<div id="{word()}"><div class="{word()}">{body}</div></div>', f"<section>{body}</section>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{rng.choice(sorted(NAMES["content"]))}">{body}</div>', f'<div id="{rng.choice(sorted(NAMES["content"]))}"><div>{body}</div></div>', f"<div>{body}</div>", body))
    before, after = [rng.choice(junk)() for _ in range(rng.randrange(0, 5))], [rng.choice(junk + tail + tail)() for _ in range(rng.randrange(0, 5))]
    return f"<html><body>{''.join(before)}{wrap}{''.join(after)}</body></html>", set(own)


_JUNK = frozenset(GROUPS) - {"content"}


def training(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rng, x, y = random.Random(SEED), [], []
    for _ in range(MADE):
        page, own = made_page(rng)
        found = blocks(page)
        marked = has_content(found)
        for b in found:
            x.append(features(b, marked))
            y.append(float(b.text in own))
    for page in pages:
        own = blocks(page)
        inside = [any("content" in g for g in b.groups) for b in own]
        if any(inside) and not all(inside):
            for b, main in zip(own, inside, strict=True):
                y.append(float(main and not (_JUNK & frozenset().union(*b.groups))))
                x.append(features(b, True))
                # the same page without its container
                b.groups = [g - {"content"} for g in b.groups]
                x.append(features(b, False))
                y.append(y[-1])
    return np.array(x), np.array(y)


def edges(own: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, weight): next blocks of the page, and next blocks of each parent."""
    out, last = [], {}
    junk = [frozenset().union(*b.groups) & _JUNK if b.groups else frozenset() for b in own]
    for i, b in enumerate(own):
        pairs = {i - 1} if i else set()
        for parent in b.path[-2:]:
            if parent in last:
                pairs.add(last[parent])
            last[parent] = i
        for j in pairs:
            a, shared = own[j].path, 0
            for p, q in zip(a, b.path):
                if p != q:
                    break
                shared += 1
            apart = max(len(a), len(b.path)) - shared
            out.append((j, i, SMOOTH * FADE ** max(0, apart - 1) * (1.0 if junk[i] == junk[j] else BORDER)))
    return out


def min_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |gain| of the nodes that go against its sign and of the weights of links cut.

    A node whose gain outweighs what its links to undecided nodes can change is decided
    at once, which is exact; the rest is settled by maximum flow along shortest paths.
    """
    n = len(gain)
    gain, label = list(gain), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(gain[i]) >= sum(w for j, w in near[i].items() if label[j] is None):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in rest}
    room |= {source: {}, sink: {}}
    for i in rest:
        a, b = (source, i) if gain[i] > 0 else (i, sink)
        room[a][b], room[b][a] = abs(gain[i]), 0.0
    while True:
        level, queue = {source: 0}, [source]
        for a in queue:
            for b, w in room[a].items():
                if w > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        nexts = {a: iter([b for b in room[a] if level.get(b) == level[a] + 1]) for a in level}
        path = [source]
        while path:  # blocking flow, without recursion
            a = path[-1]
            if a == sink:
                flow = min(room[p][q] for p, q in zip(path, path[1:]))
                cut = None
                for k, (p, q) in enumerate(zip(path, path[1:])):
                    room[p][q] -= flow
                    room[q][p] = room[q].get(p, 0.0) + flow
                    if cut is None and room[p][q] <= 1e-12:
                        cut = k
                del path[cut + 1 :]
                continue
            for b in nexts[a]:
                if room[a][b] > 1e-12:
                    path.append(b)
                    break
            else:
                path.pop()
                if path:
                    room_back = path[-1]
                    nexts[room_back] = (x for x in nexts[room_back] if x != a)
    for i in rest:
        label[i] = i in level
    return label


def main_blocks(page: str | None, weights: list[float]) -> list[Block]:
    own = blocks(page)
    marked = has_content(own)
    gain = [sum(w * x for w, x in zip(weights, features(b, marked))) for b in own]
    return [b for b, keep in zip(own, min_cut(gain, edges(own)), strict=True) if keep]


def sample(pages: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` pages: ids first, by the smallest hashes, then their html alone."""
    ids = [r[0] for r in pages.filter("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    return [r[0] or "" for r in pages.filter(F.col("page_id").isin(ids)).select("html").limit(most).collect()] if ids else []


def extract(pages: DataFrame, keep: list[str] | None = None, weights: list[float] | None = None) -> DataFrame:
    """Every row with text (blocks of the main text joined by an empty line) and n_chars.

    Needs page_id and html. A null or empty page has the text ''. Columns of the input
    whose names clash come back as ``<name>_in``. ``weights`` may be a trained model's.
    """
    pages = renamed_clashes(pages, ["text", "n_chars"], [])
    weights = fit(*training(sample(pages))).tolist() if weights is None else weights

    def run(htmls):
        texts = ["\n\n".join(b.text for b in main_blocks(h, weights)) for h in htmls]
        return [texts, [len(t) for t in texts]]

    return arrow_columns(pages, ["html"], "text string, n_chars bigint", run, keep)


def op8_html_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
