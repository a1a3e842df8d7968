"""Labelled pages for the HTML extractor: layouts whose leaf blocks carry their truth.

Layouts are built from parts by a seeded generator; in each, the attribute ``data-truth`` of an element says
whether the blocks below it are main text (1) or not (0).  Only the trainer reads that attribute.  Classes on the page, on
wrappers and on the article name parts that need not be there, as those of real themes do.
"""

from __future__ import annotations

import random

WORDS = ("river winter market letter garden window council report study teacher engine harbour village signal paper evening "
         "region method season bridge question answer history water light music field house summer road number people "
         "the of and to in that with for was on as by from had which their after before while under").split()
#: Classes of a page or of what wraps its parts, which say nothing about the text below.
STATES = ("has-sidebar no-sidebar with-sidebar left-sidebar nav-open menu-open header-fixed page-header-fixed has-header sticky-header footer-dark "
          "comment-open comments-closed single post-template single-post ad-free no-ads has-cookie-notice cookies-accepted modal-open "
          "search-enabled logged-in home blog archive theme-dark banner-visible widget-area-left topbar-on").split()
WRAPPERS = ("page wrapper container header-wrap footer-wrapper sidebar-layout more-content main-wrap site site-inner header-top related-layout "
            "outer-nav content-area widget-page story-page header-layout nav-container").split()
SHORT = "Home News Sport World About Contact Archive Login Search Topics Video Shop Help Careers Imprint Privacy".split()


def _sentence(r: random.Random, n: int | None = None) -> str:
    words = [r.choice(WORDS) for _ in range(n or r.randint(4, 28))]
    return words[0].capitalize() + " " + ", ".join(" ".join(words[i:i + 9]) for i in range(1, len(words), 9)) + r.choice([".", ".", ".", "!", "?", ""])


def _text(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 4, 8])))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{r.choice(SHORT)}</a></li>' for i in range(n))


def _no(tag: str, inner: str, attrs: str = "") -> str:
    return f'<{tag} {attrs} data-truth="0">{inner}</{tag}>'


def _aside(r: random.Random, inner: bool = False) -> str:
    """One part that is not main text; ``inner``: inside the article, where a plain header would be the article's own."""
    many = r.choice([_text(r), f"<p>{_text(r)}</p>", f"<p>{_text(r)}</p><p>{_text(r)}</p>", _sentence(r, 5)])
    kind = r.randrange(17)
    name = lambda *names: f'{r.choice(["class", "class", "id"])}="{r.choice(names)}"'
    if kind == 0:
        return _no("nav", f"<ul>{_links(r, r.randint(2, 8))}</ul>")
    if kind == 1:
        tag = r.choice(["header", "div"])
        plain = tag == "header" and not inner and r.random() < 0.6
        return _no(tag, r.choice([f"<h2>{r.choice(SHORT)}</h2><p>{_sentence(r)}</p>", many]), "" if plain else name("header", "site-header", "masthead", "topbar"))
    if kind == 2:
        tag = r.choice(["footer", "div"])
        plain = tag == "footer" and r.random() < 0.6
        return _no(tag, r.choice([f"&copy; {r.choice(SHORT)} &middot; {many}", many]), "" if plain else name("footer", "site-footer", "page-footer", "copyright"))
    if kind == 3:
        return _no("aside", f"<h3>{r.choice(SHORT)}</h3>{many}", r.choice(["", name("sidebar", "widget", "rail")]))
    if kind == 4:
        return _no("div", many, name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"))
    if kind == 5:
        return _no("div", f"<p>{_sentence(r)}</p><button>OK</button>", name("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert"))
    if kind == 6:
        return _no("form", f"<label>{_sentence(r, 3)}</label><select><option>{r.choice(SHORT)}</option></select><button>Send</button>", r.choice(["", name("newsletter", "search", "login", "subscribe")]))
    if kind in (7, 8):
        said = "".join(f'<div class="comment"><b>{r.choice(SHORT)}</b><p>{_text(r)}</p></div>' for _ in range(r.randint(1, 4)))
        return _no(r.choice(["section", "div", "ol"]), f"<h3>Comments</h3>{said}", name("comments", "comment-list", "reader-comments", "responses", "discussion", "disqus_thread"))
    if kind == 9:
        return _no("div", f"<ul>{_links(r, r.randint(2, 6))}</ul>", name("menu", "sidebar", "related", "breadcrumbs", "share", "social", "tags", "pagination"))
    if kind == 10:
        return _no("div", many, name("sidebar", "widget", "related-posts", "recommended", "popup", "modal", "disclaimer"))
    if kind == 11:
        return _no("p", " ".join(f'<a href="#">{_sentence(r, 4)}</a>' for _ in range(r.randint(1, 4))))
    if kind == 12:
        return _no("div", many, f'role="{r.choice(["navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"])}"')
    if kind == 13:
        # other articles in short, and comments that are articles
        short = "".join(f'<article {r.choice(["", name("teaser", "card", "post")])}><h3>{_sentence(r, 4)}</h3><p>{_sentence(r)}</p></article>' for _ in range(r.randint(1, 4)))
        return _no(r.choice(["aside", "section", "div"]), short, name("related", "more", "sidebar", "recommended", "teaser-list", "popular"))
    if kind == 14:
        said = "".join(f'<article class="comment"><header>{r.choice(SHORT)}</header><p>{_text(r)}</p></article>' for _ in range(r.randint(1, 4)))
        return _no(r.choice(["section", "div"]), f"<h2>{r.choice(SHORT)}</h2>{said}", name("comments", "responses", "comment-list"))
    if kind == 15:
        part = r.choice(["comment", "footer", "sidebar", "header", "nav", "ad", "widget", "form"])
        return _no("div", many, f'class="{part}-{r.choice(["content", "main", "body", "text"])}"')
    return _no("ul", _links(r, r.randint(3, 9)))


def _article(r: random.Random) -> str:
    parts = [f'<h1>{_sentence(r, r.randint(2, 9))}</h1>'] if r.random() < 0.8 else []
    if parts and r.random() < 0.35:
        # the article's own header: its headline and what stands under it belong to the text
        parts = [f'<header>{parts[0]}{r.choice(["", f"<p>{_sentence(r)}</p>"])}</header>']
    for _ in range(r.choice([1, 2, 4, 7, 12])):
        kind = r.randrange(10)
        if kind < 6:
            parts.append(f'<p>{r.choice(["", "<b>"])}{_text(r)}{r.choice(["", "<br>" + _text(r)])}{r.choice(["</p>", ""])}')
        elif kind == 6:
            parts.append(f"<h2>{_sentence(r, 3)}</h2>")
        elif kind == 7:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind == 8:
            parts.append(f"<{(t := r.choice(['blockquote', 'pre', 'figcaption', 'div']))}>{_text(r)}</{t}>")
        else:
            parts.append(f"<table><tr><td>{_sentence(r, 2)}</td><td>{_sentence(r, 2)}</td></tr></table>"
                         if r.random() < 0.5 else f'<p>{_text(r)} <a href="/x">{_sentence(r, 3)}</a> {_text(r)}</p>')
        if r.random() < 0.06:
            parts.append(_aside(r, inner=True))
    if r.random() < 0.15:
        parts.append(_aside(r, inner=True))
    tag, attrs = r.choice([("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'),
                           ("div", 'id="main-content"'), ("div", 'class="article-body"'), ("div", 'class="entry"'), ("section", 'class="story"'),
                           ("div", f'id="main" class="{r.choice(STATES)}"'), ("article", f'class="post {r.choice(STATES)}"'), ("div", "")])
    return f'<{tag} {attrs} data-truth="1">{"".join(parts)}</{tag}>'


def _class(r: random.Random, names, chance: float) -> str:
    return f' class="{" ".join(r.sample(names, r.randint(1, 3)))}"' if r.random() < chance else ""


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    pages = []
    for i in range(n):
        r = random.Random(f"{seed}:{i}")
        before = "".join(_aside(r) for _ in range(r.randint(0, 3)))
        after = "".join(_aside(r) for _ in range(r.randint(0, 4)))
        middle = _article(r)
        if r.random() < 0.3:
            # the article alone or with some of its neighbours in a wrapper
            if r.random() < 0.5:
                middle, after = middle + after, ""
            middle = f"<{(t := r.choice(['div', 'section', 'main']))}{_class(r, WRAPPERS + STATES, 0.9)}>{middle}</{t}>"
        body = before + middle + after
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            body = f"<div{_class(r, WRAPPERS, 0.8)}>{body}</div>"
        if r.random() < 0.05:
            body = f'<form id="aspnetForm" method="post">{body}</form>'
        pages.append(f"<!DOCTYPE html><html{_class(r, STATES, 0.2)}><head><title>{_sentence(r, 4)}</title><script>var a='<p>';</script></head>"
                     f"<body{_class(r, STATES, 0.6)}>{body}{r.choice(['</body></html>', ''])}")
    return pages
