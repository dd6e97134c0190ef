"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

Each block element is ABOVE the article (it holds it and more), IN it, or OUT of it. The trees give each
state's probability from the node's subtree, attributes, depth and siblings; the decoding takes the best
assignment in which below OUT all is OUT, and below IN nothing is ABOVE. Text of IN elements is kept.
Where nothing is IN, the best ``article`` or ``main`` is. The trees are trained on pages generated from rules
(``training_page``), never on the tables; ``python -m quillspark.llm.html`` trains them and writes the fitted arrays
to the file beside this module that queries read.
"""

from __future__ import annotations

import functools
import html as _html
import pathlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.boosting import Boosted
from quillspark.llm.common import arrow_batches

ABOVE, IN, OUT = 0, 1, 2

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What a start tag ends when it is open, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
GOOD_TAGS = frozenset(("article", "main"))
BAD_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"))
#: Parts of class and id names that speak for main text, against it, and strongly against it.
GOOD = frozenset("article content post entry story main text body prose richtext markdown page".split())
BAD = frozenset(
    "nav navbar navigation menu header masthead topbar footer bottom sidebar side aside widget ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations more comment comments reply replies "
    "respond discussion disqus breadcrumb breadcrumbs pagination pager tags copyright legal skip toolbar form rating".split()
)
STRONG = frozenset(
    "nav navbar navigation menu masthead topbar footer sidebar widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login search comment comments reply replies respond disqus "
    "breadcrumb breadcrumbs pagination".split()
)
GROUPS = ("article main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl", "table tbody thead tfoot tr td th caption", "nav menu", "header", "footer", "aside", "form fieldset", "blockquote pre figure figcaption", "html body")
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("at", "bad", "blocks", "children", "depth", "elements", "good", "links", "marks", "paragraphs", "parent", "size", "start", "strong", "tag")

    def __init__(self, tag, parent, at, good=False, bad=False, strong=False):
        self.tag, self.parent, self.at, self.good, self.bad, self.strong = tag, parent, at, good, bad, strong
        self.depth = parent.depth + 1 if parent else 0
        self.children, self.blocks = [], []
        self.size = self.links = self.marks = self.elements = self.paragraphs = self.start = 0


def parse(page: str):
    """(nodes in page order, blocks (node, text) in page order) of block elements; node 0 is the page."""
    root = Node("html", None, 0)
    nodes, blocks, stack = [root], [], [("", root)]
    buffer: list[str] = []
    opened: dict[str, int] = defaultdict(int)
    link = 0
    seen = 0

    def text(s):
        nonlocal seen
        if s:
            s = _html.unescape(s) if "&" in s else s
            buffer.append(s)
            n = len(s)
            node = stack[-1][1]
            node.size += n
            seen += n
            if link:
                node.links += n
            node.marks += s.count(".") + s.count(",")

    def flush():
        if buffer:
            t = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if t:
                node = stack[-1][1]
                node.blocks.append(len(blocks))
                blocks.append((node, t))

    def close(upto):
        """Ends all open elements from place ``upto`` of the stack on."""
        nonlocal link
        while len(stack) > upto:
            if stack[-1][0] in BLOCK or (stack[-1][0] == "noscript" and stack[-1][1].tag == "noscript"):
                flush()
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag == "a":
                link -= 1

    def last(names, barrier=()):
        if not any(opened.get(x) for x in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in barrier:
                return 0
        return 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare <, or a tag that the page's end cuts off
            rest = page.find(">", lt)
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and rest < 0:
                text(page[at:lt])
                break
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            elif i := last((tag,), ("td", "th") if tag not in BLOCK else ()):
                close(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK or (tag == "noscript" and not opened.get("p")):
            if tag in ENDS and (i := last(*ENDS[tag])):
                close(i)
            elif tag not in ENDS and (i := last(("p",), ("td", "th", "button"))):
                close(i)
            flush()
            if tag in ("html", "body"):
                if tag == "body" and len(nodes) == 1:
                    root.tag = "body"
                continue
            good = bad = strong = False
            if m[3]:
                for a in _ATTR.finditer(m[3]):
                    parts = {p.lower() for p in _PART.findall(a[1] or a[2] or a[3] or "")}
                    good |= not parts.isdisjoint(GOOD)
                    bad |= not parts.isdisjoint(BAD)
                    strong |= not parts.isdisjoint(STRONG)
            if tag != "hr":
                parent = stack[-1][1]
                node = Node(tag, parent, len(nodes), good, bad, strong)
                node.start = seen
                parent.children.append(node)
                nodes.append(node)
                stack.append((tag, node))
                opened[tag] += 1
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag not in VOID and not m[3].endswith("/"):
            if tag == "a":
                link += 1
            stack.append((tag, stack[-1][1]))
            opened[tag] += 1
    close(0)
    if buffer:
        stack.append(("", root))
        flush()
    for x in reversed(nodes):
        x.elements += 1
        x.paragraphs += x.tag == "p"
        if (p := x.parent) is not None:
            for k in ("size", "links", "marks", "elements", "paragraphs"):
                setattr(p, k, getattr(p, k) + getattr(x, k))
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: subtree density, attribute tokens, depth, sibling and ancestor statistics."""
    out = np.zeros((len(nodes), 33 + len(GROUPS)), np.float32)
    total = max(1, nodes[0].size)
    holds = [False] * len(nodes)  # a descendant speaks for main text
    near = [0] * len(nodes)  # what the nearest telling ancestor or the node itself says
    for x in reversed(nodes):
        if x.parent is not None and (holds[x.at] or x.tag in GOOD_TAGS or x.good and not x.bad):
            holds[x.parent.at] = True
    good_above, bad_above, strong_above = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for x in nodes:
        p = x.parent
        own_good, own_bad = x.tag in GOOD_TAGS or x.good, x.tag in BAD_TAGS or x.bad
        own = -1 if own_bad and x.tag not in GOOD_TAGS else 1 if own_good else 0
        if p is not None:
            good_above[x.at] = good_above[p.at] or p.tag in GOOD_TAGS or p.good
            bad_above[x.at] = bad_above[p.at] or p.tag in BAD_TAGS or p.bad
            strong_above[x.at] = strong_above[p.at] or p.tag in BAD_TAGS or p.strong
        near[x.at] = own or (near[p.at] if p is not None else 0)
        size, sib = x.size, p.children if p is not None else [x]
        r = out[x.at]
        r[:33] = (
            x.depth, np.log1p(size), x.links / size if size else 0, np.log1p(x.paragraphs), np.log1p(x.elements), size / x.elements,
            x.marks / size if size else 0, x.start / total, len(sib), size / total, size / p.size if p is not None and p.size else 1,
            len(x.children), len(x.blocks), x.tag in GOOD_TAGS, x.tag in BAD_TAGS, x.good, x.bad, good_above[x.at], bad_above[x.at],
            near[x.at], holds[x.at], near[p.at] if p is not None else 0, p.links / p.size if p is not None and p.size else 0,
            np.log1p(p.paragraphs) if p is not None else 0, p.good if p is not None else 0, p.bad if p is not None else 0,
            (p.tag in BAD_TAGS) if p is not None else 0, (p.tag in GOOD_TAGS) if p is not None else 0, holds[0], x.paragraphs / x.elements,
            x.strong, strong_above[x.at], x.good and x.bad and not x.strong,
        )
        if x.tag in _GROUP:
            r[33 + _GROUP[x.tag]] = 1
    return out


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The likeliest states of all nodes under the tree's rules, by dynamic programming from the leaves."""
    best = logp.astype(float).tolist()  # of the subtree, by the node's own state
    allowed = ((ABOVE, IN, OUT), (IN, OUT), (OUT,))
    for x in reversed(nodes):
        if x.parent is not None:
            up, own = best[x.parent.at], best[x.at]
            for s in (ABOVE, IN, OUT):
                up[s] += max(own[t] for t in allowed[s])
    state = [0] * len(nodes)
    for x in nodes:
        ways = allowed[state[x.parent.at]] if x.parent is not None else (ABOVE, IN, OUT)
        state[x.at] = max(ways, key=lambda t: best[x.at][t])
    return state


def settle(nodes: list[Node], blocks, logp: np.ndarray) -> list[int]:
    """``decode``, but a page with an article or main element keeps the likeliest one where nothing else is IN."""
    state = decode(nodes, logp)
    if blocks and not any(state[x.at] == IN for x, _ in blocks):
        outside = [False] * len(nodes)
        for x in nodes:
            outside[x.at] = x.parent is not None and (outside[x.parent.at] or x.tag in BAD_TAGS)
        own = [x for x in nodes if x.tag in GOOD_TAGS and x.size and not outside[x.at]]
        if own:
            best = max(own, key=lambda x: (x.size * np.exp(logp[x.at, IN]), -x.at))
            held = logp.copy()
            held[best.at] = (-1e9, 0.0, -1e9)
            state = decode(nodes, held)
            if not any(state[x.at] == IN for x, _ in blocks):  # its inside is all OUT: then all of it counts
                inside = {best.at}
                for x in nodes[best.at + 1 :]:
                    if x.parent.at in inside and x.tag not in BAD_TAGS:
                        inside.add(x.at)
                        state[x.at] = IN
    return state


def _assemble(nodes, blocks, state) -> str:
    return "\n".join(t for x, t in blocks if state[x.at] == IN)


# --- training pages ---------------------------------------------------------------------------------


def _prose(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        w = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 14))]
        out.append(" ".join(w).capitalize() + r.choice(".....?!"))
    return " ".join(out)


def _words(r: random.Random, low: int, high: int) -> str:
    return _prose(r, 1, 1)[: -1] if r.random() < 0.3 else " ".join(_prose(r, 1, 1).strip(".?!").split()[: r.randint(low, high)] or ["ba"])


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_words(r, 1, 4)}</a></{tag}>' for i in range(n))


def _attr(r: random.Random, names: str) -> str:
    name = r.choice(names.split())
    return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} x{r.randint(1, 9)}"', f' class="col-{name}"'))


def _unlucky(r: random.Random, names: str = "more header side bottom legal tags share related notice rating skip form social copyright") -> str:
    """A class of main text with a part that speaks against it."""
    return f' class="{r.choice(names.split())}-{r.choice("text story body content prose article entry".split())}"'


def _clutter(r: random.Random) -> str:
    """One piece of a page that is no main text."""
    p = lambda a, b: f"<p>{_prose(r, a, b)}</p>" if r.random() < 0.7 else _prose(r, a, b)
    tag = lambda names: r.choice(names.split())
    kind = r.randrange(13)
    if kind == 12:
        return f"<noscript>{r.choice((p(1, 1), _words(r, 3, 9), '<div' + _attr(r, 'notice alert banner') + '>' + p(1, 2) + '</div>'))}</noscript>"
    if kind == 0:
        return f"<nav><ul>{_links(r, r.randint(2, 9))}</ul></nav>"
    if kind == 1:
        t = tag("div ul")
        return f"<{t}{_attr(r, 'menu nav navbar breadcrumb topbar pagination')}>{_links(r, r.randint(2, 9), 'li' if t == 'ul' else 'span')}</{t}>"
    if kind == 2:
        return f"<header><h1>{_words(r, 1, 4)}</h1>{p(1, 1)}</header>" if r.random() < 0.7 else f"<div{_attr(r, 'header masthead')}>{p(1, 2)}</div>"
    if kind == 3:
        return f"<footer>{p(1, 3)}</footer>" if r.random() < 0.7 else f"<div{_attr(r, 'footer copyright legal bottom')}>{p(1, 3)}</div>"
    if kind == 4:
        return f"<aside>{r.choice((p(1, 4), '<ul>' + _links(r, 5) + '</ul>', '<h3>' + _words(r, 1, 3) + '</h3>' + p(1, 3)))}</aside>"
    if kind == 5:
        return f"<div{_attr(r, 'sidebar widget related recommended more-stories')}><h3>{_words(r, 1, 3)}</h3>{r.choice((p(1, 4), '<ul>' + _links(r, 5) + '</ul>'))}</div>"
    if kind in (6, 7):
        return f"<{(t := tag('div div section p'))}{_attr(r, 'ad ads advert sponsored promo banner ad-slot')}>{_prose(r, 1, 4) if t == 'p' else p(1, 4)}</{t}>"
    if kind == 8:
        return f"<{(t := tag('div section'))}{_attr(r, 'cookie cookie-notice consent notice alert popup modal')}>{p(1, 3)}<button>ok</button></{t}>"
    if kind == 9:
        return f"<form{r.choice(('', _attr(r, 'search login newsletter subscribe')))}>{r.choice(('', '<label>' + _words(r, 1, 2) + '</label>'))}{p(1, 2)}<input><button>{_words(r, 1, 2)}</button></form>"
    if kind == 10:
        one = lambda: f"<{(t := tag('div li article'))}{_attr(r, 'comment comment-body reply')}>{p(1, 5)}</{t}>"
        return f"<{(t := tag('div section ol'))}{_attr(r, 'comments discussion replies respond')}><h2>{_words(r, 1, 2)}</h2>{''.join(one() for _ in range(r.randint(1, 4)))}</{t}>"
    return f"<div{_attr(r, 'share social newsletter subscribe signup tags rating')}>{r.choice((p(1, 2), _links(r, 4, 'span')))}</div>"


def _article(r: random.Random, marked: bool) -> str:
    """The inside of an article; now and then with clutter in it."""
    parts = [f"<h1>{_words(r, 2, 9)}</h1>"] if r.random() < 0.85 else []
    if parts and r.random() < 0.1:
        parts = [f"<div>{parts[0]}</div>"]
    for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12, 20))):
        kind = r.random()
        if kind < 0.72:
            t = _prose(r, 1, r.choice((1, 2, 6, 10)))
            parts.append(r.choice((f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p>{_words(r, 1, 3)} <a href='/'>{_words(r, 1, 3)}</a> {t}</p>")))
        elif kind < 0.8:
            parts.append(f"<h{(k := r.randint(2, 4))}>{_words(r, 1, 6)}</h{k}>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 1, 2)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            parts.append(f"<blockquote>{r.choice(('<p>' + _prose(r, 1, 3) + '</p>', _prose(r, 1, 3)))}</blockquote>")
        elif kind < 0.91:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.93:
            parts.append(f"<figure><img><figcaption>{_prose(r, 1, 1)}</figcaption></figure>")
        elif kind < 0.95:
            parts.append(f"<pre>{_prose(r, 1, 2)}</pre>")
        elif kind < 0.955:  # names that speak against text, on what is text
            parts.append(f"<{(t := r.choice(('div', 'section')))}{_unlucky(r)}><p>{_prose(r, 1, 6)}</p>{'<p>' + _prose(r, 1, 6) + '</p>' if r.random() < 0.5 else ''}</{t}>")
        elif kind < 0.96:
            parts.append(f"<noscript><p>{_prose(r, 1, 3)}</p></noscript>")
        elif kind < 0.97:
            parts.append(f"<{(t := r.choice(('div', 'section')))}><p>{_prose(r, 1, 4)}</p><p>{_prose(r, 1, 4)}</p></{t}>")
        elif marked:
            parts.append(f"<!--off-->{_clutter(r)}<!--on-->")
    return "".join(parts) or f"<p>{_prose(r, 1, 3)}</p>"


def training_page(r: random.Random) -> str:
    """A page in which comments mark what is main text: after ``on``, until ``off``."""
    kind = r.random()
    inner = _article(r, kind < 0.75)
    if kind < 0.4:
        names = _unlucky(r, " ".join(sorted(BAD))) if r.random() < 0.2 else r.choice(("", "", _attr(r, "post entry article"), f' class="post {r.choice(sorted(BAD))}-{r.choice(("policy", "open", "list", "free"))}"'))
        core = f"<article{names}><!--on-->{inner}<!--off--></article>"
    elif kind < 0.52:
        core = f"<main{_unlucky(r, ' '.join(sorted(BAD))) if r.random() < 0.1 else ''}><!--on-->{inner}<!--off--></main>"
    elif kind < 0.75:
        t = r.choice(("div", "div", "section", "td"))
        core = f"<{t}{_attr(r, 'content article post-body entry-content story main-text')}><!--on-->{inner}<!--off--></{t}>"
        core = f"<table><tr>{core}</tr></table>" if t == "td" else core
    elif kind < 0.88:
        core = f"<div><!--on-->{inner}<!--off--></div>"
    else:
        core = f"<!--on-->{inner}<!--off-->"
    if r.random() < 0.25:
        core = f"<div{_attr(r, 'wrapper container layout page content main')}>{''.join(_clutter(r) for _ in range(r.randint(0, 2)))}{core}{''.join(_clutter(r) for _ in range(r.randint(0, 2)))}</div>"
    before, after = ("".join(_clutter(r) for _ in range(r.randint(0, 4))) for _ in range(2))
    return f"<!DOCTYPE html><html><head><title>{_words(r, 1, 5)}</title></head><body>{before}{core}{after}</body></html>"


def _truth(page: str) -> tuple[list[Node], list[int]]:
    """Nodes of a training page and their states: what lies between the marks is IN; what holds such text and more is ABOVE."""
    spots = [(m.start(), m[1] == "on") for m in re.finditer(r"<!--(on|off)-->", page)]
    # a mark character before each word tells where it stands
    out, at, on = [], 0, False
    for s, flag in [*spots, (len(page), False)]:
        piece = page[at:s]
        out.append(re.sub(r"(?<=[ >])(?=\w)", "\ue000" if on else "\ue001", re.sub(r"<!--(?:on|off)-->", "", piece)))
        at, on = s, flag
    nodes, blocks = parse("".join(out))
    yes, no = [0] * len(nodes), [0] * len(nodes)
    for x, t in blocks:
        yes[x.at] += t.count("\ue000")
        no[x.at] += t.count("\ue001")
    direct = [(a, b) for a, b in zip(yes, no, strict=True)]
    for x in reversed(nodes):
        if x.parent is not None:
            yes[x.parent.at] += yes[x.at]
            no[x.parent.at] += no[x.at]
    state = []
    for x in nodes:
        up = state[x.parent.at] if x.parent is not None else ABOVE
        if not yes[x.at]:
            state.append(OUT)
        elif up == IN or not no[x.at] or direct[x.at][0]:
            state.append(IN)
        elif x.tag in GOOD_TAGS or (x.good and not x.bad and no[x.at] < 0.5 * yes[x.at] and not any(c.tag in GOOD_TAGS or c.good for c in x.children)):
            state.append(IN)  # an article with clutter in it
        else:
            state.append(ABOVE)
    return nodes, state


#: Pages that the trees are trained on, and the file that holds what they came to.
PAGES = 1500
FITTED = pathlib.Path(__file__).with_name("html_trees.npz")


def train(pages: int = PAGES, seed: int = 11) -> Boosted:
    """The trees, from ``pages`` generated pages; the same on every run."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = training_page(r)
        clean = re.sub(r"<!--(?:on|off)-->", "", page)
        nodes, _ = parse(clean)
        _, state = _truth(page)
        xs.append(features(nodes))
        ys += state
    return Boosted(3).fit(np.concatenate(xs), np.array(ys))


@functools.cache
def fitted() -> Boosted:
    """The trees of ``train`` as ``FITTED`` holds them."""
    return Boosted.load(FITTED)


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts of whole pages; empty for null or empty ones."""
    parsed = [parse(p) if p else None for p in pages]
    some = [p for p in parsed if p]
    if not some:
        return [""] * len(pages)
    logp = model.log_proba(np.concatenate([features(nodes) for nodes, _ in some]))
    out, at = [], 0
    for p in parsed:
        if not p:
            out.append("")
            continue
        nodes, blocks = p
        out.append(_assemble(nodes, blocks, settle(nodes, blocks, logp[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Blocks of the article in page order, one line each; a null or empty page has an empty text. Repeated rows give
    repeated results; an empty table gives an empty result; pages of any length are read whole; extra columns are ignored.
    """
    arrow_batches(pages.sparkSession, 256)
    told = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def run(batches):
        for b in batches:
            t = extract(b.column(2).to_pylist(), told.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


if __name__ == "__main__":
    train().save(FITTED)
