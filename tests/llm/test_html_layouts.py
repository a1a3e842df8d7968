"""HTML extraction on layouts written by hand, apart from the trainer's generator, and on hostile pages."""

import time

import numpy as np
import pytest

from kerbside.llm import html

HEAD = "Council approves the new bridge"
TEXT = ["The council voted on Tuesday to build a second bridge over the river, after years of debate.",
        "Work begins in spring and should last two years, the mayor said.",
        "Residents of the old town had asked for a crossing since the ferry was closed; the nearest bridge is eleven kilometres away.",
        "Costs are put at forty million."]
PS = "".join(f"<p>{t}</p>" for t in TEXT)
FULL = f"<h1>{HEAD}</h1>{PS}"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
NAVDIV = '<div class="main-nav"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div>'
FOOT = "<footer><p>&copy; 2024 The Daily Post. All rights reserved.</p></footer>"
FOOTDIV = '<div id="footer"><p>&copy; 2024 The Daily Post</p><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul></div>'
SIDE = '<aside><h3>Most read</h3><ul><li><a href="/1">Storm warning for the coast</a></li><li><a href="/2">Cup final tonight</a></li></ul></aside>'
SIDEDIV = '<div class="sidebar"><h3>Most read</h3><p>Storm warning for the coast.</p><p>Cup final tonight.</p></div>'
COMMENTS = '<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>About time, I have waited for this bridge for years.</p></div><div class="comment"><b>Bob</b><p>Too dear.</p></div></section>'
NOTES = '<div class="cookie-notice"><p>We use cookies to make this site better.</p><button>Accept</button></div>'
ADVERT = '<div class="advert"><p>Buy two, get one free, only this week!</p></div>'
LETTER = '<form class="newsletter"><label>Your mail</label><input name="m"><button>Subscribe</button></form>'
SITE = "<header><a href='/'>The Daily Post</a><p>News for the valley</p></header>"
BODIES = [
    f"<body>{NAV}<article>{FULL}</article>{FOOT}",
    f'<body class="has-sidebar">{NAV}<article>{FULL}</article>{SIDE}{FOOT}',
    f'<body class="single post comment-open">{SITE}<article>{FULL}</article>{COMMENTS}{FOOT}',
    f'<body class="nav-open">{NAV}<main>{FULL}</main>{FOOT}',
    f'<body class="page-header-fixed">{SITE}{NAV}<main><article>{FULL}</article></main>{FOOTDIV}',
    f'<body class="no-sidebar ad-free">{NAVDIV}<article>{FULL}</article>{FOOTDIV}',
    f'<body><div class="header-wrap page">{NAV}<article>{FULL}</article></div>{FOOT}',
    f'<body><div id="main" class="with-sidebar"><article>{FULL}</article>{SIDEDIV}</div>{FOOT}',
    f'<body>{NAV}<div class="more-content"><article>{FULL}</article></div>{FOOTDIV}',
    f'<body class="archive widget-area sidebar-right">{NAV}<div class="content">{FULL}</div>{SIDEDIV}{FOOT}',
    f'<html class="js no-touch cookies-pending"><body>{NOTES}{NAV}<article>{FULL}</article>{FOOT}',
    f'<body><form id="aspnetForm" method="post">{NAVDIV}<article>{FULL}</article>{FOOTDIV}</form>',
    f'<body>{SITE}<article><header><h1>{HEAD}</h1></header>{PS}</article>{FOOT}',
    f'<body>{NAV}<main><article class="post"><header class="entry-header"><h1>{HEAD}</h1></header><div class="entry-content">{PS}</div></article>{COMMENTS}</main>{SIDE}{FOOT}',
    f'<body>{NAV}<div id="page" class="site"><div id="content" class="site-content"><article>{FULL}</article></div></div>{FOOT}',
    f"<body>{NOTES}<div class='container'><div class='row'><div class='col-md-8'><article>{FULL}</article></div><div class='col-md-4'>{SIDEDIV}</div></div></div>{FOOTDIV}",
    f'<body>{NAV}<section class="story">{FULL}</section>{ADVERT}{FOOT}',
    f'<body>{ADVERT}<div class="article-body">{FULL}</div>{LETTER}{FOOTDIV}',
    f'<body>{NAV}<article><h1>{HEAD}</h1><p>{TEXT[0]}</p>{ADVERT}<p>{TEXT[1]}</p><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article>{FOOT}',
    f'<body>{NAV}<article>{FULL}{COMMENTS}</article>{FOOT}',
    f"<body>{NAV}<article>{FULL}</article><aside class='related'><article><h3>Ferry to close</h3><p>The last trip is on Friday.</p></article><article><h3>Toll is off</h3><p>No toll, says the mayor.</p></article></aside>{FOOT}",
    f'<body>{SITE}{NAV}<div id="main-content">{FULL}</div>{SIDE}{COMMENTS}{FOOT}',
    f'<body><div role="banner"><p>The Daily Post</p></div><div role="navigation"><a href="/">Home</a></div><div role="main">{FULL}</div><div role="contentinfo"><p>All rights reserved.</p></div>',
    f'<body>{NAV}<main><h1>{HEAD}</h1><section><p>{TEXT[0]}</p><p>{TEXT[1]}</p></section><section><p>{TEXT[2]}</p><p>{TEXT[3]}</p></section></main>{FOOT}',
    f'<body><div class="modal">{"<p>Sign in to read more.</p>"}</div>{NAV}<article>{FULL}</article>{FOOT}',
    f'<body>{NAV}<article>{FULL}</article><div class="share-buttons"><a href="#">Share</a> <a href="#">Mail</a></div><div class="tags"><a href="#">bridge</a></div>{FOOT}',
    f'<body><div class="topbar"><p>Call us: one two three</p></div><div class="entry">{FULL}</div>{FOOTDIV}',
    f'<body class="home page-template">{NAV}<div class="wrapper"><article>{FULL}</article>{LETTER}</div>{FOOT}',
    f'<body>{NAV}<ul class="breadcrumbs"><li><a href="/">Home</a></li><li><a href="/l">Local</a></li></ul><article>{FULL}</article>{FOOT}',
    f'<body><header class="site-header">{NAV}</header><main id="main" class="site-main">{FULL}</main><footer class="site-footer"><p>All rights reserved.</p></footer>',
    f'<body>{NAV}<article>{FULL}</article><section class="comments"><article class="comment"><header>Ann</header><p>About time, I have waited for this bridge for years.</p></article></section>{FOOT}',
    f'<body><div class="siteHeader"><p>The Daily Post</p></div><div class="articleBody">{FULL}</div><div class="siteFooter"><p>All rights reserved.</p></div>',
    f'<body class="comments-closed">{NAV}<div class="post">{FULL}</div><div class="post-comments"><p>Comments are closed for this one.</p></div>{FOOT}',
    f'<body>{SITE}<main>{NOTES}<article>{FULL}</article></main>{FOOT}',
    f'<body>{NAV}<article>{FULL}<footer><p>Filed under local news.</p></footer></article>{FOOT}',
    f'<body>{NAV}<div class="content"><h1>{HEAD}</h1><p>{TEXT[0]}<p>{TEXT[1]}<p>{TEXT[2]}<p>{TEXT[3]}</div>{FOOTDIV}',
    f'<body>{NAV}<article>{FULL}<form class="search"><label>Search the archive</label><button>Go</button></form></article>{FOOT}',
    f'<body>{NAV}{SIDE}<article>{FULL}</article>{SIDEDIV}{FOOTDIV}',
    f'<body><div class="page sidebar-layout">{NAV}<div class="main-wrap"><main>{FULL}</main></div>{SIDEDIV}</div>{FOOT}',
    f'<body>{NAV}<div class="outer"><div class="inner"><article class="post type-post has-thumbnail"><h1>{HEAD}</h1><div class="text">{PS}</div></article></div></div>{COMMENTS}{FOOT}',
    f'<body>{NAV}<article><h1>{HEAD}</h1><p>{TEXT[0]}</p><blockquote>{TEXT[1]}</blockquote><ul><li>{TEXT[2]}</li><li>{TEXT[3]}</li></ul></article>{FOOT}',
    f'<body class="modal-open cookie-banner-visible">{NOTES}<div class="story-page"><article>{FULL}</article></div>{SIDE}{FOOT}',
]


def texts(page):
    found = html.blocks(page)
    marks = html.default_field().viterbi(html.features(found), np.array([len(found)])) if found else []
    return found, marks


def test_layouts_by_hand():
    wrong = total = whole = 0
    for body in BODIES:
        found, marks = texts(f"<!doctype html><html><head><title>{HEAD}</title></head>" * (not body.startswith("<html")) + body)
        for b, m in zip(found, marks):
            total += 1
            wrong += bool(m) != (b.text in (HEAD, *TEXT))
        whole += [b.text for b, m in zip(found, marks) if m] == [HEAD, *TEXT]
    assert len(BODIES) >= 40
    assert wrong <= 0.03 * total and whole >= 0.9 * len(BODIES)


@pytest.mark.parametrize("body", BODIES[1:9])
def test_classes_of_pages_and_wrappers_do_not_empty_the_text(body):
    found, marks = texts(body)
    assert [b.text for b, m in zip(found, marks) if m] == [HEAD, *TEXT]


def test_no_attribute_of_a_page_is_taken_for_truth():
    for page in ['<div data-truth="x">a</div>', "<p data-truth>a", '<p data-truth="">a</p>', '<p data-truth="2">a</p>', "<p data-truth=0x>a"]:
        assert [(b.text, b.truth) for b in html.blocks(page)] == [("a", None)]
    found = html.blocks('<p data-truth="1">a</p><p data-truth="0">b</p>')
    assert (html.features(found) == html.features(html.blocks("<p>a</p><p>b</p>"))).all()


def test_silent_elements_close_nothing_outside():
    said = lambda page: [b.text for b in html.blocks(page)]
    assert said("<p>a<template><p>hid</p>den</template>b</p>") == ["a", "b"] or said("<p>a<template><p>hid</p>den</template>b</p>") == ["ab"]
    assert said("<div>a<template></div><div>hidden</div></template></div><p>b") == ["a", "b"]
    assert said("<ul><li>a<svg><li>no</li></svg>b<li>c</ul>") == ["a", "b", "c"] or said("<ul><li>a<svg><li>no</li></svg>b<li>c</ul>") == ["ab", "c"]
    assert said("a<!-- x > y") == ["a"] and said("a <b>b</b> <!-- never closed") == ["a b"] and said("a<?php x") == ["a"]


@pytest.mark.parametrize("make", [
    lambda n: "<div>x" * n, lambda n: "<a " * 2 * n, lambda n: "<a '" * n + ">", lambda n: '<a "' * n, lambda n: "<p><b>" * n + "</i>" * n,
    lambda n: "<template><div>" * n + "</p>" * n, lambda n: "<li>" * n + "<dd>" * n, lambda n: "<!--" * n, lambda n: "<td><p>x" * n, lambda n: "</p>" * n,
    lambda n: "<svg>" * n + "</div>" * n, lambda n: "<p>" + "<b>" * n + "</p>" * n])
def test_time_is_linear(make):
    page = make(40_000)
    start = time.time()
    html.blocks(page)
    assert time.time() - start < 20
