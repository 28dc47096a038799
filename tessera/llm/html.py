"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is walked once, with open elements on a stack and HTML's implied end tags; runs of text between
block boundaries are the leaf blocks. Each block has features of its ancestors (tags, words of class,
id and role), of its own element and of its text. A two-label chain, trained on labelled pages by the
gradient of its likelihood, is decoded by Viterbi; the blocks of the label "main" make up the text.
The labelled pages are drawn from a generator of page layouts, so training needs no data.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import adam

# Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CODE = frozenset("script style".split())
# Elements whose text is none of the page's. A start tag of BREAKOUT ends svg and math, but not within INTEGRATION.
HIDDEN = frozenset("template svg math object canvas audio video select datalist".split())
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
# A start tag of BLOCK ends an open paragraph from within PASSING elements too.
PASSING = frozenset("audio video canvas".split())
BLOCK = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table ul".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SCOPE = frozenset("table td th caption button object html body".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]{2,}")
_STRUCTURE = frozenset("article main section aside nav header footer form figure table ul ol dl div blockquote body".split())


@lru_cache(maxsize=16)
def _ends(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    link_share: float


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in its order, without text within HIDDEN elements; character references are decoded, white space is one space.

    A script or style without an end tag goes to the end of the page; other elements of plain text without one are
    passed over, and what follows them stays. Time is linear in the page's length.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = whole = links = hidden = at = 0
    path: tuple = ()
    last = html.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    unclosed: set[str] = set()
    held_open: Counter[str] = Counter()  # open elements by tag
    outers: list[int] = []  # for each open element the depth of the outermost svg or math around what it holds, -1 in none or in HTML within it

    def flush() -> None:
        nonlocal parts, linked, whole
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, linked / max(whole, 1)))
            parts, linked, whole = [], 0, 0

    def close(depth: int) -> None:
        nonlocal links, hidden
        while len(stack) > depth:
            tag, _ = stack.pop()
            outers.pop()
            held_open[tag] -= 1
            if tag == "a":
                links -= 1
            elif tag in HIDDEN:
                hidden -= 1
            elif tag not in INLINE and not hidden:
                flush()

    while True:
        m = _TOKEN.search(html, at, max(last, at))
        text = html[at : m.start() if m else len(html)]
        if text and not hidden:
            size = len(text.strip())
            if size:
                if not whole:
                    path = tuple(stack)
                whole += size
                linked += size if links else 0
            if parts or size:
                parts.append(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = name.lower()
        if m[1] or m[4]:
            inside = hidden
            for depth in range(len(stack) - 1, -1, -1) if held_open[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
            if tag not in INLINE and not inside:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        outer = outers[-1] if hidden and outers else -1
        if outer >= 0 and tag in BREAKOUT:
            close(outer)
            outer = -1
        if attributes.rstrip().endswith("/") and (outer >= 0 or tag in FOREIGN):
            continue
        if tag in RAW:
            end = None if tag in unclosed else _ends(tag).search(html, at, max(last, at))
            if end:
                at = end.end()
            elif tag in CODE:
                at = last = len(html)
            else:  # without an end tag, what follows is taken for the page's
                unclosed.add(tag)
                if tag == "title":
                    flush()
            continue
        if tag in VOID:
            if hidden:
                continue
            if tag == "hr":
                flush()
            elif parts:
                parts.append(" ")
            continue
        if tag not in INLINE and tag not in HIDDEN:
            if not hidden:
                flush()
            if stack and stack[-1][0] == "head":
                close(len(stack) - 1)
            own, within = CLOSES.get(tag, ("", ()))
            for depth in range(len(stack) - 1, -1, -1) if held_open["p"] or any(held_open[t] for t in own.split()) else ():
                held = stack[depth][0]
                if held == "p" or own and held in own.split():
                    close(depth)
                    if held != "p":
                        break
                elif held in within or held in SCOPE or held in HIDDEN and not (held in PASSING and tag in BLOCK):
                    break
        words: tuple[str, ...] = ()
        if "=" in attributes:
            words = tuple(dict.fromkeys(w for v in _NAMED.findall(attributes) for w in _WORD.findall((v[0] or v[1] or v[2]).lower())))
        if not attributes.rstrip().endswith("/") or tag not in INLINE:
            around = outers[-1] if outers else -1
            outers.append((around if around >= 0 else len(stack)) if tag in FOREIGN else -1 if tag in INTEGRATION or tag in HIDDEN else around)
            held_open[tag] += 1
            stack.append((tag, words))
            links += tag == "a"
            hidden += tag in HIDDEN
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    """Features of the elements around a block: every tag and word, the nearest ones, the block's own element."""
    names = {f"tag {t}" for t, _ in path if t not in ("html", "body")} | {f"word {w}" for _, words in path for w in words}
    structure = [(t, words) for t, words in path if t in _STRUCTURE]
    if structure:
        tag, words = structure[-1]
        names.add(f"near {tag}")
        names |= {f"near word {w}" for w in words}
    own = [t for t, _ in path if t not in INLINE]
    names.add(f"own {own[-1] if own else 'none'}")
    return sorted(names)


def text_features(block: Block) -> list[str]:
    n = block.text.count(" ") + 1
    names = ["any", f"words {1 if n < 3 else 2 if n < 7 else 3 if n < 16 else 4 if n < 41 else 5}"]
    names.append(f"links {0 if not block.link_share else 1 if block.link_share < 0.34 else 2 if block.link_share < 0.9 else 3}")
    if block.text[-1] in ".!?:;…\"'”»":
        names.append("ends")
    if "©" in block.text:
        names.append("rights")
    return names


@dataclass(frozen=True)
class Chain:
    weights: dict[str, float]  # for the label "main"; the other label has none
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, found: list[Block], known: dict) -> list[int]:
        """The likeliest labels of a page's blocks; known keeps the sums of paths."""
        best, back = None, []
        for block in found:
            base = known.get(block.path)
            if base is None:
                base = known[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
            score = base + sum(self.weights.get(f, 0.0) for f in text_features(block))
            if best is None:
                best = (self.start[0], self.start[1] + score)
                continue
            (a, b), (c, d) = self.step
            zero, one = (best[0] + a, best[1] + c), (best[0] + b, best[1] + d)
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            best = (max(zero), max(one) + score)
        if best is None:
            return []
        label = [int(best[1] > best[0])]
        for choice in reversed(back):
            label.append(choice[label[-1]])
        return label[::-1]


# Words that pages use for their parts.
MAIN = ["article", "article-body", "post", "post-content", "entry", "entry-content", "content", "main-content", "story", "story-body", "text", "body-text", "single", "page-content", "blog-post", "hentry", "prose"]
OTHER = {
    "menu": (["nav", "div", "ul", "nav"], ["nav", "navbar", "navigation", "menu", "main-menu", "breadcrumb", "breadcrumbs", "topbar", "tabs", "pagination", "pager", "toc", "links", "skip-link"]),
    "header": (["header", "div", "header"], ["header", "site-header", "masthead", "banner", "page-header", "logo", "branding", "tagline", "top"]),
    "footer": (["footer", "div", "footer"], ["footer", "site-footer", "page-footer", "copyright", "legal", "bottom", "imprint", "colophon", "credits"]),
    "sidebar": (["aside", "div", "aside", "section"], ["sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "trending", "popular", "most-read", "rail", "right-column", "tags", "teaser", "more", "secondary"]),
    "advert": (["div", "ins", "aside", "section", "div"], ["ad", "ads", "advert", "advertisement", "ad-slot", "ad-banner", "sponsored", "sponsor", "promo", "promotion", "adsbygoogle", "affiliate", "commercial", "banner-ad", "dfp"]),
    "notice": (["div", "section", "div", "dialog"], ["cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "warning", "disclaimer", "privacy", "notification", "message", "toast"]),
    "form": (["form", "form", "div", "fieldset"], ["search", "search-form", "login", "signup", "contact-form", "form", "register", "feedback"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "comment-list", "comment-body", "replies", "reply", "respond", "discussion", "disqus", "disqus-thread", "responses", "reader-comments"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "share-buttons", "social-links", "follow", "author-box", "byline", "meta", "post-meta"]),
}


def training_page(r: random.Random) -> list[tuple[str, int]]:
    """A page as (html, label) parts; text in a part of label 1 is main text."""
    said = lambda lo, hi: " ".join("".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))).capitalize()
    named = lambda words: "" if not words else f' {r.choice(["class", "class", "id"])}="{r.choice(words)}{r.choice(["", "", " " + r.choice(words), " col", "-" + str(r.randint(1, 9)), " container"])}"'
    parts: list[tuple[str, int]] = []

    def other(kind: str) -> None:
        tags, words = OTHER[kind]
        tag = r.choice(tags)
        bare = tag not in ("div", "section", "ul", "ol") and r.random() < 0.5
        html = f"<{tag}{'' if bare else named(words)}>"
        linked = kind in ("menu", "footer", "share") or kind == "sidebar" and r.random() < 0.6
        if kind == "form":
            html += "".join(f"<label>{said(1, 3)}</label><input>" for _ in range(r.randint(1, 3))) + f"<button>{said(1, 2)}</button>" + (f"<p>{said(4, 12)}.</p>" if r.random() < 0.4 else "")
        elif tag in ("ul", "ol") or linked and r.random() < 0.7:
            items = "".join(f"<li><a href=#>{said(1, 4)}</a></li>" if linked else f"<li><p>{said(4, 40)}.</p></li>" for _ in range(r.randint(2, 6)))
            html += items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        else:
            if r.random() < 0.4:
                html += f"<h{r.randint(2, 4)}>{said(1, 4)}</h3>"
            for _ in range(r.randint(1, 3)):
                body = f"<a href=#>{said(1, 5)}</a>" if linked else said(3, 45) + r.choice([".", ".", "!", ""])
                html += r.choice(["<p>{}</p>", "<div>{}</div>", "{}<br>", "<span>{}</span>"]).format(body)
            if kind == "footer" and r.random() < 0.5:
                html += f"&copy; {said(1, 3)}"
        parts.append((f"{html}</{tag}>", 0))

    def inside(n: int) -> None:
        for _ in range(n):
            x = r.random()
            if x < 0.6:
                text = said(1, 70) + r.choice([".", ".", ".", "!", "", ":"])
                if r.random() < 0.2:
                    text = f"<a href=#>{said(1, 4)}</a> {text}"
                parts.append((r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>", "<p><em>{}<br></p>"]).format(text), 1))
            elif x < 0.68:
                parts.append((f"<h{r.randint(2, 4)}>{said(1, 7)}</h2>", 1))
            elif x < 0.74:
                kind = r.choice(["ul", "ol"])
                parts.append((f"<{kind}>" + "".join(f"<li>{said(1, 20)}{r.choice(['.', ''])}" for _ in range(r.randint(2, 5))) + f"</{kind}>", 1))
            elif x < 0.78:
                parts.append((f"<blockquote><p>{said(5, 40)}.</p></blockquote>", 1))
            elif x < 0.8:
                parts.append((f"<table><tr><td>{said(1, 5)}</td><td>{said(1, 5)}</td></tr></table><pre>{said(3, 9)}</pre>", 1))
            else:
                other(r.choice(["advert", "advert", "share", "sidebar", "notice", "comments", "form", "menu"]))

    parts.append(("<html><head><title>x</title><style>p{}</style></head><body>", 0))
    if r.random() < 0.3:
        parts.append((f"<div{named(['wrapper', 'page', 'site', 'container', 'layout'])}>", 0))
    for kind in ("notice", "header", "menu", "advert", "form"):
        if r.random() < 0.55:
            other(kind)
    tag, words = r.choice([("article", []), ("article", MAIN), ("main", []), ("main", MAIN), ("div", MAIN), ("div", MAIN), ("section", MAIN), ("div", ["col", "inner", "row", "x"])])
    outer = r.random() < 0.3
    parts.append(((f"<main{named(['main', 'primary', 'content'])}>" if outer else "") + f"<{tag}{named(words)}>", 0))
    if r.random() < 0.7:
        parts.append((r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]).format(said(1, 9)), 1))
    if r.random() < 0.2:
        other("share")
    inside(r.randint(1, 10))
    if r.random() < 0.15:
        other("comments")
    parts.append((f"</{tag}>" + ("</main>" if outer else ""), 0))
    for kind in ("share", "comments", "sidebar", "advert", "sidebar", "form", "notice", "footer"):
        if r.random() < 0.5:
            other(kind)
    parts.append(("</body></html>", 0))
    return parts


def labelled(parts: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """Blocks of a page that is given in parts, with the label of the part that each one's text stands in."""
    marked = "".join(re.sub(r">([^<>]*[^<>\s][^<>]*)", lambda m, y=y: f">{m[1]}{'⑴' if y else '⑵'}", f">{html}")[1:] for html, y in parts)
    found, labels = blocks(marked), []
    for b in found:
        labels.append(int("⑴" in b.text))
        b.text = re.sub("[⑴⑵]", "", b.text) or "."
    return found, labels


@lru_cache(maxsize=2)
def train(pages: int = 600, steps: int = 250, seed: int = 5) -> Chain:
    """Fits the chain on so many generated pages: log-likelihood by forward and backward sums, all pages at once."""
    r = random.Random(seed)
    data = [labelled(training_page(r)) for _ in range(pages)]
    data = [(b, y) for b, y in data if b]
    longest = max(len(b) for b, _ in data)
    names: dict[str, int] = {}
    feature, place = [], []
    y, real = np.zeros((len(data), longest), int), np.zeros((len(data), longest), bool)
    for i, (found, labels) in enumerate(data):
        for t, block in enumerate(found):
            for f in path_features(block.path) + text_features(block):
                feature.append(names.setdefault(f, len(names)))
                place.append(i * longest + t)
            y[i, t], real[i, t] = labels[t], True
    feature, place = np.array(feature), np.array(place)
    k = len(names)
    gold = np.bincount(feature, y.reshape(-1)[place], k)
    first = np.bincount(y[:, 0], minlength=2)
    both = real[:, 1:]
    moved = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4)

    def gradient(w: np.ndarray, _: int) -> np.ndarray:
        score = np.zeros((len(data), longest, 2))
        score[:, :, 1] = np.bincount(place, w[feature], len(data) * longest).reshape(len(data), longest)
        start, step = w[k : k + 2], w[k + 2 : k + 6].reshape(2, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        g = np.concatenate([np.bincount(feature, share[:, :, 1].reshape(-1)[place], k) - gold, share[:, 0].sum(0) - first, pair.sum((0, 1)).reshape(-1) - moved])
        return g / len(data) + 2e-4 * w

    w = adam(gradient, np.zeros(k + 6), steps, 0.1)
    return Chain({f: float(w[i]) for f, i in names.items()}, tuple(w[k : k + 2]), tuple(map(tuple, w[k + 2 :].reshape(2, 2).tolist())))


EXTRACTED = "page_id long, url string, text string, blocks int, main_blocks int"


def main_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, main text and numbers of blocks of every row of pages (page_id, url, html).

    Main blocks are joined by two line feeds in page order. A null or empty html, and a page without main blocks,
    have an empty text; null ids and urls stay null; rows that repeat an id are extracted each on its own.
    """
    chain = chain or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts, counts, mains = [], [], []
            for html in batch.column(2):
                found = blocks(html.as_py() or "")
                kept = [b.text for b, y in zip(found, chain.labels(found, known), strict=True) if y]
                texts.append("\n\n".join(kept))
                counts.append(len(found))
                mains.append(len(kept))
                if len(known) > 50_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(mains, pa.int32())], ["page_id", "url", "text", "blocks", "main_blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, EXTRACTED)
