"""HTML extraction: leaf blocks of the element tree, labelled by a linear-chain conditional random field.

A page is cut into leaf blocks (runs of text between the borders of block elements, in page order).  Each
block has features of its ancestors (tags, words of class, id and role) and of its text; the field is trained
on labelled pages and decoded by Viterbi, and the blocks it marks as content are the main text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_rows
from kerbside.llm.crf import Crf, train
from kerbside.llm.html_pages import labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Asked for by the trainer only; a page that is looked at may say what it likes there.
TRUTH = re.compile(r'\bdata-truth="([01])"')
OPEN_END = re.compile(r"<[!?]")
#: Text below these is never shown as text.
SILENT = frozenset("script style noscript template iframe object svg math head title textarea select option canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
#: What may stand in a head; anything else, and text, ends a head that is not closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An opening tag closes an open element of its own kind, up to the kind's border: kinds by tag, borders by kind.
KINDS = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4}
BORDERS = (frozenset("td th button object table".split()), frozenset("ul ol menu".split()), frozenset(["dl"]), frozenset("table tr".split()), frozenset(["table"]))
NO_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                 "main menu nav ol p pre section table ul".split())
#: Closing tags below these close nothing outside.
SEALED = frozenset("template svg math object".split())
#: Elements that hold parts of a page; blocks of one belong together.
BOX = frozenset("article body div main section td".split())
#: Elements whose classes speak of the whole page.
PAGE = frozenset(["html", "body"])
ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "ul", "ol", "table", "p", "h1", "h2", "h3",
             "blockquote", "pre", "figure", "button", "label", "li", "dialog", "a")
HINTS = (
    frozenset("article content post entry story main body text".split()),
    frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp".split()),
    frozenset("cookie cookies consent gdpr notice alert warning popup modal overlay disclaimer dialog message toast paywall".split()),
    frozenset("comment comments reply replies respond response responses discussion disqus reader readers thread feedback".split()),
    frozenset("nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip".split()),
    frozenset("header masthead topbar hero brand logo".split()),
    frozenset("footer copyright contentinfo legal imprint bottom colophon".split()),
    frozenset("sidebar side widget widgets related recommended rail aside complementary share sharing social tags tag more popular "
              "teaser trending".split()),
    frozenset("form search login signup subscribe newsletter subscription register contact".split()),
    frozenset(["hidden"]),
)
#: Words of a class that speak of a state or of layout: what else it names need not be there.
STATE = frozenset("has with without no not is show open opened closed fixed sticky enabled disabled active free left right wrap wrapper "
                  "container outer inner layout grid row col column columns root app shell template mode on in visible accepted hidden".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Tags that set a block apart.
APART = tuple(ANCESTORS.index(t) for t in ("nav", "header", "footer", "aside", "form", "button", "label", "dialog"))
FEATURES = len(ANCESTORS) + len(APART) + 4 * len(HINTS) + 25


def _groups(words) -> int:
    return sum(1 << i for i, group in enumerate(HINTS[:-1]) if not group.isdisjoint(words))


@lru_cache(maxsize=4096)
def hints(attrs: str) -> tuple[int, int]:
    """Bit sets of the hint groups named by class, id and role: by what the element is, and by words of state or layout.

    A name that holds a word of an unwanted part beside one of content (``comment-content``) counts as the part.
    """
    strong = weak = 0
    for name, *values in NAMES.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            strong |= 1 << (len(HINTS) - 1)
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                bits = _groups(words)
                bits = bits & ~1 if bits & ~1 else bits
                if STATE.isdisjoint(words):
                    strong |= bits
                else:
                    weak |= bits
    return strong, weak


class Element:
    """An open element and what holds for the text in it.

    A core is an article, a main or an element named for content; what stands above the innermost one is kept apart
    (``up_*``) from what stands between it and the text (``tags``, ``hints``).
    """

    __slots__ = ("name", "tags", "hints", "up_tags", "up_hints", "weak", "own", "core", "core_kind", "box", "linked", "silent", "open_at", "names", "attrs", "above")

    def __init__(self, name: str, above: "Element | None", attrs: str, strong: int, weak: int, depth: int, cores: int):
        self.name, self.above, self.attrs = name, above, attrs
        bit = _TAG_BIT.get(name, 0)
        if above is None:
            self.tags = self.hints = self.up_tags = self.up_hints = self.weak = self.own = self.core = self.core_kind = self.box = 0
            self.linked, self.silent, self.open_at, self.names = False, False, (0,) * len(BORDERS), {}
            return
        if name in PAGE:
            strong = weak = 0
        self.tags, self.hints, self.up_tags, self.up_hints = above.tags, above.hints, above.up_tags, above.up_hints
        self.core, self.core_kind = above.core, above.core_kind
        if name in ("article", "main") or strong & 1:
            self.up_tags, self.up_hints, self.tags, self.hints = self.up_tags | self.tags, self.up_hints | self.hints, 0, 0
            self.core, self.core_kind = cores, self.core_kind | (1 if name in ("article", "main") else 2)
        self.box = cores if name in BOX else above.box
        self.tags |= bit
        self.hints |= strong
        self.weak = above.weak | weak
        self.own = strong if name in BLOCK else above.own | strong
        self.linked = above.linked or name == "a"
        self.silent = above.silent or name in SILENT
        kind = KINDS.get(name)
        if name in SILENT:
            self.open_at = (0,) * len(BORDERS)
        else:
            self.open_at = tuple(depth if k == kind else 0 if name in border else at for k, (border, at) in enumerate(zip(BORDERS, above.open_at)))
        # how often each name is open, counted anew below a sealed element
        self.names = {} if name in SEALED else above.names


class Block:
    __slots__ = ("text", "inside", "linked")

    def __init__(self, text: str, inside: Element, linked: int):
        self.text, self.inside, self.linked = text, inside, linked

    @property
    def truth(self) -> int | None:
        """What the labelled pages of the trainer say of the block; nothing else asks."""
        e = self.inside
        while e is not None:
            if said := TRUTH.search(e.attrs):
                return int(said[1])
            e = e.above
        return None


_TAG_BIT = {t: 1 << i for i, t in enumerate(ANCESTORS)}


def blocks(html: str) -> list[Block]:
    """Leaf blocks with text, in page order; character references decoded, white space made one space.

    Time is linear in the page, however deep or broken it is.
    """
    out: list[Block] = []
    stack: list[Element] = [Element("", None, "", 0, 0, 0, 0)]
    parts: list[str] = []
    linked = cores = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        if any(e.name in BLOCK for e in stack[depth:]):
            close_block()
        for e in stack[depth:]:
            e.names[e.name] -= 1
        del stack[depth:]

    def end_head() -> None:
        while stack[-1].name == "head":
            pop_to(len(stack) - 1)

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1].name == "head" and raw and not raw.isspace():
            end_head()
        if raw and not stack[-1].silent:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].linked:
                linked += len(text.strip())

    def close(name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == name:
                pop_to(depth)
                return

    # behind the last > no tag can end, so nothing there is looked at for one again and again
    at, n, ends = 0, len(html), html.rfind(">") + 1
    while at < n:
        m = TOKEN.search(html, at, ends) if at < ends else None
        if m is None:
            hidden = OPEN_END.search(html, at)
            say(html[at:hidden.start() if hidden else n])
            break
        say(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
                break
            continue
        name = name.lower()
        if m[1] or m[4]:
            if stack[-1].names.get(name):
                close(name)
            elif name == "p":
                close_block()
            continue
        if name not in IN_HEAD:
            end_head()
        if name in ("br", "wbr", "img", "input"):
            if name != "wbr" and not stack[-1].silent:
                parts.append(" ")
            continue
        if name in NO_P and stack[-1].open_at[0]:
            pop_to(stack[-1].open_at[0])
        kind = KINDS.get(name)
        if kind and stack[-1].open_at[kind]:
            pop_to(stack[-1].open_at[kind])
        attrs = m[3] if m[2] else m[6]
        if name in BLOCK:
            close_block()
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        strong, weak = hints(attrs) if attrs and not attrs.isspace() else (0, 0)
        cores += 1
        e = Element(name, stack[-1], attrs, strong, weak, len(stack), cores)
        e.names[name] = e.names.get(name, 0) + 1
        stack.append(e)
    close_block()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row for each block: what stands between it and its core, what stands above that, and its text."""
    n = len(found)
    bits = np.array([(e.tags, e.up_tags, e.hints, e.own, e.up_hints, e.weak, e.core, e.core_kind, e.box) for e in (b.inside for b in found)], dtype=np.int64).reshape(n, 9)
    tags, up_tags, near, own, up, weak, core, kind, box = bits.T
    size = np.fromiter((len(b.text) for b in found), dtype=np.float64, count=n)
    words = np.fromiter((b.text.count(" ") + 1 for b in found), dtype=np.float64, count=n)
    link = np.fromiter((b.linked for b in found), dtype=np.float64, count=n) / np.maximum(size, 1)
    stop = np.fromiter((b.text[-1] in ".!?:;\"'" for b in found), dtype=np.float64, count=n)
    marks = np.fromiter((b.text.count(",") + b.text.count(".") for b in found), dtype=np.float64, count=n)
    sign = np.fromiter(("\xa9" in b.text for b in found), dtype=np.float64, count=n)
    place = np.arange(n) / max(n - 1, 1)
    spread = lambda v, k: (v[:, None] >> np.arange(k) & 1).astype(np.float64)
    inside, apart_up = spread(tags, len(ANCESTORS)), spread(up_tags, len(ANCESTORS))[:, APART]
    groups = [spread(v, len(HINTS)) for v in (near, own, up, weak)]
    any_of = lambda m: m.max(1, initial=0) if n else np.empty(0)
    bad, bad_own, bad_up = (any_of(g[:, 1:]) for g in groups[:3])
    apart = any_of(inside[:, APART])
    far = np.maximum(bad_up, any_of(apart_up))
    has = (core > 0).astype(np.float64)
    # text of the block's core, as a share of the page's
    of = np.unique(core, return_inverse=True)[1] if n else core
    share = has * np.bincount(of, size)[of] / max(size.sum(), 1) if n else np.empty(0)
    of = np.unique(box, return_inverse=True)[1] if n else box
    held = np.bincount(of, size)[of] / max(size.sum(), 1) if n else np.empty(0)
    clean = has * (1 - np.maximum(bad, apart))
    head = any_of(inside[:, [ANCESTORS.index(t) for t in ("h1", "h2", "h3")]])
    titled = has * inside[:, ANCESTORS.index("header")] * (1 - bad)
    return np.c_[inside, apart_up, *groups, np.log1p(size), np.log1p(words), link, link > 0.8, stop, marks / np.maximum(words, 1), sign, place,
                 bad, bad_own, apart, far, has, kind & 1, share, share > 0.4, clean, clean * (share > 0.4), clean * far * (share <= 0.4), held, (1 - has) * (1 - np.maximum(bad, apart)) * held, (1 - has) * (1 - bad) * (held > 0.4),
                 titled, titled * head, words < 4].astype(np.float64)


@lru_cache(maxsize=2)
def default_field() -> Crf:
    """Trained once for each driver on the labelled layouts of :mod:`kerbside.llm.html_pages` (600 pages)."""
    return fit(labelled_pages())


def fit(pages: list[str]) -> Crf:
    """Train on labelled pages; blocks without a truth count as not main text.  Their number is the caller's bound."""
    found = [b for b in map(blocks, pages) if b]
    x = np.concatenate([features(b) for b in found])
    y = np.array([1 if b.truth else 0 for page in found for b in page])
    return train(x, np.array([len(b) for b in found]), y, steps=250)


def main_text(found: list[Block], content: np.ndarray) -> str:
    return "\n\n".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame, html: str = "html", field: Crf | None = None) -> DataFrame:
    """Every row without its html, with ``kb_main``, the main text.

    Null or empty html, or a page without content blocks: an empty text.  Repeated rows each give a row; an
    empty table an empty one; other columns pass through.
    """
    own = field or default_field()

    def run(texts):
        found = [blocks(t) for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        x = np.concatenate([features(f) for f in found]) if lengths.sum() else np.empty((0, FEATURES))
        marks = own.viterbi(x, lengths)
        ends = np.cumsum(lengths)
        return [(main_text(f, marks[e - k:e]),) for f, e, k in zip(found, ends.tolist(), lengths.tolist())]

    return map_rows(pages, run, html, "kb_main string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of the main text of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("kb_main").alias("text"), F.char_length("kb_main").cast("long").alias("n_chars"))
