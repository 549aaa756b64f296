"""Main-text extraction from web pages by minimum cut.

A page is cut into text blocks. A logistic model gives each block the cost of being
called content or boilerplate; these costs are the capacities from the source and to
the sink. Blocks that follow each other, or that share their enclosing sections, are
joined by edges whose capacity grows with their closeness in the document tree. The
minimum cut is the labelling with the least total cost, so a short line inside an
article stays with it and a long one inside a menu goes with the menu.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partlake.llm.batches import slices_by_bytes, text_batches
from partlake.llm.sampling import bounded_sample

#: Elements that never hold main text, with all they enclose.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas button select textarea".split())
#: Silent elements whose content is skipped up to their end tag as it stands.
RAW = frozenset("script style textarea title iframe noscript template".split())
#: Silent elements that cannot hold a block: one ends them.
PHRASING = frozenset("button select".split())
#: What a head can hold; anything else ends it.
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: Blocks that end a drawing or formula when they start in it, other than in a part for foreign content.
BREAKOUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 li menu ol p pre table ul".split())
FOREIGN = frozenset("foreignobject desc annotation-xml mtext mi mo mn ms".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Sections whose edges bind the blocks inside.
SECTIONS = frozenset("article main section aside nav header footer div ul ol dl table dialog details figure form".split())
#: An open paragraph ends where one of these starts.
ENDS_P = BLOCKS - {"html", "body"} | {"hr"}
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
#: Elements that the start of the key ends, up to its container.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

#: A quote opens a string only after an equals sign; elsewhere in a tag it is a letter like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_WHITE = re.compile(r"\s+")

#: Words that mark boilerplate: at the end of a name, or before a word for a container; elsewhere they are a hint only.
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adsbygoogle breadcrumb breadcrumbs comment comments cookie cookies copyright disqus "
    "footer gdpr masthead menu nav navbar navigation newsletter outbrain pagination popup promo sidebar sitemap sponsored taboola toolbar "
    "complementary contentinfo alert".split()
)
#: Words that mark it as the last word of a name alone: ``article-share`` is boilerplate, ``share-history`` need not be.
BAD_HEADS = BAD_WORDS | frozenset(
    "banner consent dialog foot head header legal login meta notice notices notification promotion related replies reply respond "
    "search share sharing shop signup site social sponsor sticky subscribe teaser toc widget".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post story text prose".split())
#: Words at the end of a name that say nothing of what it holds.
PLAIN_WORDS = frozenset("area bar block box bottom buttons button container form group holder inner item items left links list module outer panel right row slot top unit wrap wrapper".split())

#: Words at the end of a name that say what part of the thing before them it holds: ``comment-body`` is of a comment.
PART_WORDS = frozenset("body content entry main text".split())

IN_ARTICLE, IN_MAIN, IN_NAV, IN_HEADER, IN_FOOTER, IN_ASIDE, IN_LIST, IN_TABLE, HEADING, BAD, GOOD, INNER, DIALOG, LINK, HINT = (1 << i for i in range(15))
_BITS = (
    {"article": IN_ARTICLE, "main": IN_MAIN, "nav": IN_NAV, "menu": IN_NAV, "header": IN_HEADER, "footer": IN_FOOTER, "aside": IN_ASIDE}
    | {"li": IN_LIST, "table": IN_TABLE, "dialog": DIALOG, "a": LINK}
    | {h: HEADING for h in HEADINGS}
)
_INNER_TAGS = IN_NAV | IN_ASIDE | IN_FOOTER | DIALOG


@lru_cache(maxsize=4096)
def name_bits(names: str) -> int:
    """What the names in an attribute say: boilerplate, a hint of it, content, several of these or nothing."""
    out = 0
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        known = bool(BAD_WORDS & set(words))
        if words == ["dialog"]:
            out |= HINT
            continue
        while len(words) > 1 and words[-1] in PLAIN_WORDS:
            words.pop()
        if words and words[-1] in BAD_HEADS:
            out |= BAD
            continue
        last = words[-1:]
        while known and len(words) > 1 and words[-1] in PLAIN_WORDS | PART_WORDS:
            words.pop()
        if known:
            out |= BAD if words[-1] in BAD_WORDS else HINT
        elif last and last[0] in GOOD_WORDS:
            out |= GOOD
    return out


@dataclass(slots=True)
class Block:
    text: str
    section: int  # the innermost enclosing section, 0 for none
    depth: int  # number of enclosing sections
    common: int  # how many of them enclose the block before, too
    form: int  # the enclosing form, 0 for none
    features: list[float]


FEATURES = [
    "bias", "in article", "in main", "in nav", "in header", "in footer", "in aside", "in list", "in table", "heading",
    "bad name", "good name", "link share", "log words", "sentence end", "bad name inside article", "dialog", "position", "beside article",
]


@dataclass(slots=True)
class _Open:
    tag: str
    section: int
    depth: int
    bits: int  # what this element and all around it say
    form: int
    bad: int  # the innermost enclosing part with a bad name, -1 for none
    inner: int  # the same, of those inside the innermost article


@dataclass(slots=True)
class _Part:
    """An element whose name says boilerplate, and what the page holds in it."""

    parent: int
    inner_parent: int
    hint: bool  # the name only hints at it
    hidden: bool
    inside: bool  # of an article or main part
    sentences: int = 0  # characters of blocks in sentences
    linked: int = 0
    chars: int = 0
    heads: int = 0  # first headings
    mains: int = 0
    articles: int = 0


def page_blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order. White space is one blank, references are decoded, silent elements are gone.

    A head ends where a text or an element starts that it cannot hold; a button or a list of
    options where a block starts or ends. Another silent element without its end tag ends where
    a block around it closes; if no such end tag follows in the page, also at the next block; a
    drawing or formula at the next block anyway. A form's blocks are gone, too, unless it is
    laid around the page: it holds an article, a main part or a first heading, or over half of
    the page's text in sentences. A form inside a form counts as part of it. Names of classes
    and ids count for what an element holds, but not where the element is the page itself
    (``_believed``). Work grows with the length of the page, however deep it is nested.
    """
    if not page:
        return []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where each element is in the stack
    section_at: list[int] = []
    block_at: list[int] = []  # blocks other than paragraphs
    parts: list[_Part] = []
    part_of: list[tuple[int, int]] = []  # of each block
    marks: list[tuple[str, int]] = []  # first headings, main parts and articles, and the part around each
    out: list[Block] = []
    text: list[str] = []
    linked, sections, forms, shared = 0, 0, 0, 0  # shared: sections that stayed open since the last block
    wrapping: set[int] = set()  # forms around a page
    none = _Open("", 0, 0, 0, 0, -1, -1)

    def flush() -> None:
        nonlocal linked, shared
        t = _WHITE.sub(" ", "".join(text)).strip()
        text.clear()
        n, linked = linked, 0
        if not t:
            return
        top = stack[-1] if stack else none
        b = top.bits
        f = [
            1.0, float(b & IN_ARTICLE > 0), float(b & (IN_MAIN | IN_ARTICLE) == IN_MAIN), float(b & IN_NAV > 0), float(b & IN_HEADER > 0),
            float(b & IN_FOOTER > 0), float(b & IN_ASIDE > 0), float(b & IN_LIST > 0), float(b & IN_TABLE > 0), float(b & HEADING > 0),
            0.0, float(b & GOOD > 0), min(1.0, n / max(1, len(t))), math.log1p(len(t.split())) / 5,
            float(t[-1] in ".!?:;\"”»"), float(b & INNER > 0), float(b & DIALOG > 0), 1 / (1 + len(out)), 0.0,
        ]
        out.append(Block(t, top.section, top.depth, shared, top.form, f))
        part_of.append((top.bad, top.inner))
        shared = top.depth

    def close(i: int) -> None:
        nonlocal shared
        if any(x.tag in BLOCKS for x in stack[i:]):
            flush()
        for x in stack[i:]:
            places[x.tag].pop()
        del stack[i:]
        for at in (section_at, block_at):
            while at and at[-1] >= i:
                at.pop()
        shared = min(shared, stack[-1].depth if stack else 0)

    def ends_silence(tag: str, closing: bool) -> bool:
        """Whether a tag in the silent element shows that this was over before it."""
        kind, inner = silent
        if kind == "head":
            return tag in ("body", "html", "br") if closing else tag not in HEAD
        if kind in PHRASING and tag in BLOCKS:
            return True
        if closing:
            return tag in ("body", "html") or tag in BLOCKS and tag not in inner and bool(places.get(tag))
        if kind in ("svg", "math") and tag in BREAKOUT and not FOREIGN & set(inner):
            return True
        return tag in BLOCKS and last_end(kind) < m.start()

    ends: dict[str, int] = {}

    def last_end(tag: str) -> int:
        if tag not in ends:
            ends[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
        return ends[tag]

    def up_to(tags: tuple[str, ...], stop: list[int] | tuple[str, ...]) -> int:
        """Place of the innermost of the elements, -1 if one of ``stop`` (their places, or elements) is further in."""
        at = max((places[t][-1] for t in tags if places.get(t)), default=-1)
        if isinstance(stop, tuple):
            stop = [max((places[t][-1] for t in stop if places.get(t)), default=-1)]
        return at if not stop or at >= stop[-1] else -1

    pos, silent = 0, None  # silent: the element, and the elements open in it
    while m := _TOKEN.search(page, pos):
        if silent is not None and silent[0] == "head" and page[pos : m.start()].strip():
            silent = None
        if silent is None and m.start() > pos:
            t = html_lib.unescape(page[pos : m.start()])
            text.append(t)
            if stack and stack[-1].bits & LINK:
                linked += len(t.strip())
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if silent is not None and ends_silence(tag, closing):
            silent = None
        alone = m[3].rstrip().endswith("/")
        if silent is not None:
            kind, inner = silent
            foreign = kind in ("svg", "math")
            if closing:
                if tag in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                elif tag == kind:
                    silent = None
            elif tag in RAW and not (foreign and (alone or tag == "title")):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos) if last_end(tag) >= pos else None
                if end or tag not in ("noscript", "template"):
                    pos = end.end() if end else len(page)
            elif tag == kind and tag in PHRASING:  # the one before was not closed
                inner.clear()
            elif kind != "head" and tag not in VOID and not (foreign and alone):
                inner.append(tag)
            continue
        if not closing and tag in SILENT:
            if tag not in ("button", "select", "svg", "math", "canvas", "object"):
                flush()
            if alone and tag in ("svg", "math", "iframe"):
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos) if tag in RAW and last_end(tag) >= pos else None
            if end or tag in RAW and tag not in ("noscript", "template"):
                pos = end.end() if end else len(page)
            else:
                silent = (tag, [])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if closing:
            at = up_to((tag,), [] if tag in BLOCKS else section_at)
            if at >= 0:
                close(at)
            continue
        if tag == "form" and places.get("form"):
            continue
        if tag in ENDS_P:
            at = up_to(("p",), block_at)
            if at >= 0:
                close(at)  # formatting left open in a paragraph ends with it
        if tag in SAME:
            at = up_to(SIBLINGS[tag], SAME[tag])
            if at >= 0:
                close(at)
        if tag in BLOCKS:
            flush()
        around = stack[-1] if stack else none
        own, hidden = _BITS.get(tag, 0), False
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                key = a[1].lower()
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    own |= name_bits(a[2] or a[3] or a[4] or "")
                elif key == "hidden" and tag in BLOCKS:
                    hidden = True
        bits, bad, inner = around.bits | own & ~(BAD | HINT), around.bad, around.inner
        inside = bits & (IN_ARTICLE | IN_MAIN) > 0
        if tag in ("article", "main"):
            bits &= ~INNER
            inner, inside = -1, False
            wrapping.add(around.form)
        elif tag == "h1":
            inside = False
            wrapping.add(around.form)
        elif inside and own & _INNER_TAGS:
            bits |= INNER
        if hidden or own & (BAD | HINT):
            parts.append(_Part(bad, inner, not (hidden or own & BAD), hidden, inside))
            bad = len(parts) - 1
            inner = bad if inside else inner
        if tag in ("h1", "main", "article"):
            marks.append((tag, bad))
        section, depth, form = around.section, around.depth, around.form
        if tag in SECTIONS:
            sections += 1
            section, depth = sections, depth + 1
        if tag == "form":
            forms += 1
            form = forms
        places.setdefault(tag, []).append(len(stack))
        if tag in SECTIONS:
            section_at.append(len(stack))
        if tag in BLOCKS and tag != "p":
            block_at.append(len(stack))
        stack.append(_Open(tag, section, depth, bits, form, bad, inner))
    if pos < len(page) and (silent is None or silent[0] == "head" and page[pos:].strip()):
        text.append(html_lib.unescape(page[pos:]))
    flush()
    if parts:
        bad, inner = _believed(parts, out, part_of, marks)
        for b, (i, k) in zip(out, part_of):
            b.features[_AT_BAD] = float(i >= 0 and bad[i])
            b.features[_AT_INNER] = max(b.features[_AT_INNER], float(k >= 0 and inner[k]))
    if any(b.features[1] or b.features[2] for b in out):
        for b in out:
            b.features[-1] = 1.0 - max(b.features[1], b.features[2])
    return _without_forms(out, wrapping) if forms else out


_AT_BAD, _AT_INNER, _AT_END, _AT_LINKS = (FEATURES.index(x) for x in ("bad name", "bad name inside article", "sentence end", "link share"))


def _in_sentences(b: Block) -> bool:
    return bool(b.features[_AT_END]) and b.features[_AT_LINKS] < 0.5 and len(b.text.split()) >= 8


def _believed(parts: list[_Part], blocks: list[Block], part_of: list[tuple[int, int]], marks: list[tuple[str, int]]) -> tuple[list[bool], list[bool]]:
    """For each part with a bad name, whether its blocks count as badly named: at all, and inside their article.

    A name is not believed of an element that is the page itself: it holds the main part, or the
    first heading and half of the page's sentences, or 4/5 of them while no article, main part
    or first heading stands outside. A hint in an article is believed of an element without
    sentences or with mostly links. Hidden parts are always believed. A part goes by its own
    name and by those around it.
    """
    total = 0
    for b, (i, _) in zip(blocks, part_of):
        said = len(b.text) if _in_sentences(b) else 0
        total += said
        if i >= 0:
            parts[i].sentences += said
            parts[i].chars += len(b.text)
            parts[i].linked += int(b.features[_AT_LINKS] * len(b.text))
    for tag, i in marks:
        if i >= 0:
            x = parts[i]
            x.heads, x.mains, x.articles = x.heads + (tag == "h1"), x.mains + (tag == "main"), x.articles + (tag == "article")
    for x in reversed(parts):  # what stands around comes first
        if x.parent >= 0:
            up = parts[x.parent]
            up.sentences, up.chars, up.linked = up.sentences + x.sentences, up.chars + x.chars, up.linked + x.linked
            up.heads, up.mains, up.articles = up.heads + x.heads, up.mains + x.mains, up.articles + x.articles
    bad, inner = [], []
    for x in parts:
        alone = x.heads + x.mains + x.articles == len(marks)
        page = x.mains > 0 or total > 0 and (x.heads > 0 and 2 * x.sentences >= total or alone and 5 * x.sentences >= 4 * total)
        prose = x.hint and x.inside and x.sentences > 0 and 2 * x.linked < x.chars
        own = x.hidden or not (page or prose)
        bad.append(own or x.parent >= 0 and bad[x.parent])
        inner.append(x.inside and own or x.inner_parent >= 0 and inner[x.inner_parent])
    return bad, inner


def _without_forms(blocks: list[Block], wrapping: set[int]) -> list[Block]:
    """Blocks outside forms, or in a form that is laid around the page."""
    chars: dict[int, int] = {}
    for b in blocks:
        if b.form and _in_sentences(b):
            chars[b.form] = chars.get(b.form, 0) + len(b.text)
    half = sum(len(b.text) for b in blocks) / 2
    kept, common = [], None
    for b in blocks:
        b.common = b.common if common is None else min(common, b.common)
        if b.form and b.form not in wrapping and chars.get(b.form, 0) <= half:
            common = b.common
            continue
        common = None
        kept.append(b)
    return kept


def _max_flow(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut by shortest augmenting paths (Edmonds-Karp)."""
    n = len(content)
    s, t = n, n + 1
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    cap: list[float] = []

    def add(a: int, b: int, x: float, back: float) -> None:
        to[a].append(len(head))
        head.append(b)
        cap.append(x)
        to[b].append(len(head))
        head.append(a)
        cap.append(back)

    for i in range(n):
        direct = min(content[i], boiler[i])  # the flow over i itself needs no search
        add(s, i, content[i] - direct, 0.0)
        add(i, t, boiler[i] - direct, 0.0)
    for a, b, x in edges:
        add(a, b, x, x)
    while True:
        via = {s: -1}
        queue = deque([s])
        while queue and t not in via:
            u = queue.popleft()
            for e in to[u]:
                v = head[e]
                if cap[e] > 1e-9 and v not in via:
                    via[v] = e
                    queue.append(v)
        if t not in via:
            return [i in via for i in range(n)]
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = head[via[v] ^ 1]
        flow = min(cap[e] for e in path)
        for e in path:
            cap[e] -= flow
            cap[e ^ 1] += flow


def minimum_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    ``content[i]`` is the capacity from the source (lost when i is called boilerplate),
    ``boiler[i]`` that to the sink; edges count in both directions. A node with two neighbours
    or fewer is taken out first: the least cost over its side, as a function of its neighbours'
    sides, is again terminal capacities and one edge between them, so the cut of the rest is
    the cut of the whole. Page order with edges back to a section's earlier block nests like
    brackets and is taken out whole by this, in linear time; any other rest goes to max-flow.
    """
    n = len(content)
    u = [b - c for c, b in zip(content, boiler)]  # cost of calling a node content, less that of boilerplate
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + x
            near[b][a] = near[b].get(a, 0.0) + x
    gone: list[tuple[int, dict[int, float]]] = []
    left = [True] * n
    ready = [i for i in range(n) if len(near[i]) <= 2]
    while ready:
        v = ready.pop()
        if not left[v] or len(near[v]) > 2:
            continue
        left[v] = False
        gone.append((v, near[v]))
        ends = list(near[v].items())
        for a, _ in ends:
            del near[a][v]
        if len(ends) == 1:
            (a, w), x = ends[0], u[v]
            u[a] += min(w, x) - min(0.0, x + w)
        elif len(ends) == 2:
            (a, wa), (b, wb) = ends
            none, first, second, both = min(0.0, u[v] + wa + wb), min(wa, u[v] + wb), min(wb, u[v] + wa), min(wa + wb, u[v])
            between = (first + second - none - both) / 2
            u[a] += first - none - between
            u[b] += second - none - between
            if between > 0:
                near[a][b] = near[a].get(b, 0.0) + between
                near[b][a] = near[b].get(a, 0.0) + between
        ready += [a for a, _ in ends if len(near[a]) <= 2]
    side = [False] * n
    rest = [i for i in range(n) if left[i]]
    if rest:
        at = {v: k for k, v in enumerate(rest)}
        inner = [(at[a], at[b], w) for a in rest for b, w in near[a].items() if a < b]
        for v, x in zip(rest, _max_flow([max(0.0, -u[v]) for v in rest], [max(0.0, u[v]) for v in rest], inner)):
            side[v] = x
    for v, ends in reversed(gone):
        x = u[v] + sum(-w if side[a] else w for a, w in ends.items())
        side[v] = x < -1e-9
    return side


def smoothness_edges(blocks: list[Block], strength: float) -> list[tuple[int, int, float]]:
    """Neighbours in page order, weighted by the share of enclosing sections in common; equal sections bind most."""
    out = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1], blocks[i]
        near = (1 + b.common) / (1 + max(a.depth, b.depth))
        out.append((i - 1, i, strength * near * near))
    last: dict[int, int] = {}
    for i, x in enumerate(blocks):  # the section's previous block, when others stand between
        j = last.get(x.section)
        if j is not None and j < i - 1:
            out.append((j, i, strength))
        last[x.section] = i
    return out


def main_text(page: str | None, weights: np.ndarray, strength: float = 0.5) -> str:
    """The text of the blocks on the content side, one a line."""
    blocks = page_blocks(page)
    if not blocks:
        return ""
    z = np.clip(np.array([b.features for b in blocks]) @ weights, -20, 20)
    content, boiler = np.log1p(np.exp(z)), np.log1p(np.exp(-z))
    chosen = minimum_cut(content.tolist(), boiler.tolist(), smoothness_edges(blocks, strength))
    return "\n".join(b.text for b, c in zip(blocks, chosen) if c)


#: Rows that teach what is known of page structure before any page is seen: (features set, content?, weight).
_PRIOR = [
    ({"in article"}, 1, 40), ({"in main"}, 1, 40), ({"in article", "heading"}, 1, 20), ({"in article", "in list"}, 1, 20),
    ({"in article", "in table"}, 1, 20), ({"good name"}, 1, 20), ({"in nav"}, 0, 40), ({"in footer"}, 0, 40), ({"in aside"}, 0, 40),
    ({"in header"}, 0, 30), ({"in article", "in header"}, 1, 20), ({"in article", "in header", "heading"}, 1, 20),
    ({"bad name"}, 0, 40), ({"dialog"}, 0, 40), ({"in article", "bad name", "bad name inside article"}, 0, 60),
    ({"in article", "in footer", "bad name inside article"}, 0, 60), ({"in article", "in aside", "bad name inside article"}, 0, 60),
    ({"in article", "in nav", "bad name inside article"}, 0, 60), ({"in list"}, 0, 5), ({"in article", "bad name"}, 1, 20),
    ({"in main", "bad name", "bad name inside article"}, 0, 60), ({"in main", "in footer", "bad name inside article"}, 0, 60),
    ({"in article", "in list", "bad name", "bad name inside article"}, 0, 40), ({"good name", "bad name"}, 0, 20),
    ({"in article", "good name", "bad name", "bad name inside article"}, 0, 60), ({"in article", "dialog", "bad name inside article"}, 0, 60),
    ({"in article", "in footer"}, 0, 20), ({"in article", "in nav"}, 0, 20), ({"in article", "in aside"}, 0, 20), (set(), 1, 5), ({"beside article"}, 0, 20),
]


def fit_weights(pages: list[str], rounds: int = 300, ridge: float = 0.004) -> np.ndarray:
    """Logistic weights from blocks whose enclosing elements label them, and from the prior rows.

    Pages label their own blocks: inside ``article`` or ``main`` without a marked part
    between is content; in ``nav``, ``footer`` or ``aside`` is boilerplate; others teach nothing.
    """
    at = {f: i for i, f in enumerate(FEATURES)}
    rows, ys, ws = [], [], []
    for p in pages:
        for b in page_blocks(p):
            f = b.features
            inside = f[at["in article"]] or f[at["in main"]]
            marked = f[at["in nav"]] or f[at["in footer"]] or f[at["in aside"]] or f[at["bad name inside article"]]
            if not inside and not marked and not f[at["bad name"]]:
                continue
            rows.append(f)
            ys.append(1.0 if inside and not marked else 0.0)
            ws.append(1.0)
    scale = max(1.0, len(rows) / 300)
    for names, y, w in _PRIOR:
        for words in (0.15, 0.5, 0.9):
            for end in (0.0, 1.0):
                f = [0.0] * len(FEATURES)
                f[0], f[at["log words"]], f[at["sentence end"]] = 1.0, words, end
                f[at["link share"]] = (0.8 * end if "in article" in names else 0.0) if y else 0.5  # articles hold links, too
                for x in names:
                    f[at[x]] = 1.0
                rows.append(f)
                ys.append(float(y))
                ws.append(w * scale / 6)
    x, y, w = np.array(rows), np.array(ys), np.array(ws)
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge / len(FEATURES)
    for _ in range(min(rounds, 30)):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + keep @ beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def extract_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    keep: tuple[str, ...] = ("url",),
    sample_pages: int = 200,
    strength: float = 0.5,
) -> DataFrame:
    """(id, ``keep`` columns, ``text``): each page's main text, blocks joined by one line feed.

    The classifier is fitted on ``sample_pages`` pages, 200,000 characters of each
    (a documented bound); every page is then labelled whole. Null, empty and text-free
    pages give an empty text; broken markup is read as far as it goes; rows that repeat an
    id are treated one by one. Columns not named are not read.
    """
    weights = fit_weights(bounded_sample(pages, sample_pages, html_col, id_col, 200_000))
    cols = [id_col, *keep]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in cols) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices_by_bytes(b, len(cols)):
                out = pa.array([main_text(x, weights, strength) for x in s.column(len(cols)).to_pylist()], pa.string())
                arrays = [out if c == "text" else s.column(i) for i, c in enumerate([*cols, "text"])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*cols, "text"])

    return text_batches(pages).select(*cols, html_col).mapInArrow(run, schema)
