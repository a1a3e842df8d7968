"""Line field, HTML extraction and quality rules."""

import itertools
import random
import re

import numpy as np
import pytest

from kerbside.llm import html, quality_rules
from kerbside.llm.crf import Crf, train
from kerbside.llm.html_pages import labelled_pages


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 6, 2])
    x = rng.normal(size=(lengths.sum(), 4))
    field = Crf(rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.zeros(4), np.ones(4))
    got, at = field.viterbi(x, lengths), 0
    for n in lengths:
        s = field.scores(x[at:at + n])
        value = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=int(n)), key=value)
        assert tuple(got[at:at + n]) == best
        at += n


def test_training_learns_chain_and_features():
    rng = np.random.default_rng(2)
    y = np.concatenate([np.repeat(rng.integers(0, 2, 10), 5) for _ in range(40)])
    x = y[:, None] + rng.normal(size=(len(y), 3)) * 0.8
    field = train(x, np.full(40, 50), y)
    assert (field.viterbi(x, np.full(40, 50)) == y).mean() > 0.9
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]


def test_held_out_pages():
    field = html.default_field()
    wrong = total = 0
    for page in labelled_pages(150, seed=31):
        found = html.blocks(page)
        if found:
            truth = np.array([1 if b.truth else 0 for b in found])
            wrong += int((field.viterbi(html.features(found), np.array([len(found)])) != truth).sum())
            total += len(truth)
    assert total > 2000 and wrong <= 0.01 * total


def test_blocks():
    page = """<!doctype html><html><head><title>T</title><style>p{a:b}</style></head><body><script>var x="<p>no</p>";</script>
    <!-- <p>gone</p> --><div class="ad">Buy<br>now</div><article><h1>A &amp; B</h1><p>one <b>two</b>
    three&nbsp;&eacute;<p>open <a href='x>y'>link</a> 1 < 2<ul><li>i<li>j</ul></article>tail<textarea>raw <p></textarea></body>"""
    assert [b.text for b in html.blocks(page)] == ["Buy now", "A & B", "one two three é", "open link 1 < 2", "i", "j", "tail"]
    for odd in ["", " ", "<", "<p", "<p>a", "a</p></div>b", "<!--", "<script>", "&#0;&bogus;", "<div " + "x " * 5000 + ">t", "<b>" * 3000 + "t"]:
        html.blocks(odd)


def test_open_head_ends_where_the_body_starts():
    top = "<html><head><meta charset=utf-8><title>T</title><style>p{a:b}</style><template><div>no</div></template><script>x</script>\n"
    for body in ["<body><p>one<p>two", "<p>one</p><p>two</p>", "one<p>two", "<div>one</div>two", "<img src=x>one<p>two"]:
        assert [b.text for b in html.blocks(top + body)] == ["one", "two"] == [b.text for b in html.blocks(top + "</head>" + body)]
    assert html.blocks(top) == []
    whole = [b.text for b in html.blocks(labelled_pages(1, seed=4)[0])]
    assert whole and [b.text for b in html.blocks(labelled_pages(1, seed=4)[0].replace("</head>", ""))] == whole


def test_extract_operator(spark):
    body = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Site name</header><article><h1>Head line</h1><p>{}</p><p>Second part of it.</p></article>"
    more = "<div class='comments'><p>A reader says that this is a long comment about it.</p></div><aside>See this too</aside><form><label>Mail</label></form><footer>&copy; all</footer>"
    text = "A first sentence, long enough, stands here. And one more."
    rows = [(1, "u", body.format(text) + more, "x"), (2, None, None, "y"), (None, "v", "", None), (1, "u", body.format(text) + more, "x"), (4, "w", "<p>" * 9, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id is None, r.page_id or 0, r.text, r.n_chars) for r in html.main_texts(df).collect()))
    main = f"Head line\n\n{text}\n\nSecond part of it."
    assert got == [(False, 1, main, len(main)), (False, 1, main, len(main)), (False, 2, "", 0), (False, 4, "", 0), (True, 0, "", 0)]
    assert html.main_texts(df.limit(0)).collect() == []


def plain_rules(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover |= set(range(i, i + 5))
    lines = t.split("\n")
    dup = sum(1 for i, s in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", s) and s in lines[:i])
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover),
            len(words) < 10 or 100 * len(cover) > 20 * len(words))


def texts():
    rng = random.Random(6)
    atoms = ["a", "b", "c ", " ", "\n", "\n", "d e f g h ", "é", "🙂 ", "#", "| ", "\x0b", "\x85", " ", "x y\n"]
    return ["".join(rng.choice(atoms) for _ in range(rng.choice([2, 20, 90]))) for _ in range(250)] + ["", "\n\n", "w " * 300, "same line\n" * 20]


def test_base_rules_equal_plain():
    for t in texts():
        n, chars, symbols, dup, repeats, f = quality_rules.measure(t.encode())
        assert (n, chars, symbols, dup, repeats, n < 10 or 100 * repeats > 20 * n) == plain_rules(t)
        assert len(f) == sum(1 for s in t.split("\n") if s.encode().split())


@pytest.fixture(scope="module")
def judged(spark):
    good = "This is a sentence of plain prose about a thing that happened, in order. It goes on for a while."
    bad = "buy | now | cheap | $$$ | click %%% | >>> | *** | ### | win | &&& | now | >>>"
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.sample((good if i % 2 else bad).split(), 12)) for _ in range(rng.randint(1, 6))), i) for i in range(200)]
    rows += [(300, None, 1), (None, good, 2), (301, "", 3), (None, good, 2), (302, "word " * 90_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_before int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()


def test_quality_operator(judged):
    rows, out = judged
    assert len(out) == len(rows)
    want = sorted((d is None, d or 0, plain_rules(t or "")[:4]) for d, t, _ in rows if d != 302)
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines)) for r in out if r.doc_id != 302) == want
    held_out = [r for r in out if r.doc_id is not None and 150 <= r.doc_id < 200]
    assert all(r.kept == (r.doc_id % 2 == 1) for r in held_out)
    assert all(not r.kept for r in out if r.doc_id in (300, 301, 302)) and all(r.kept for r in out if r.doc_id is None)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, quality_rules.fit(docs, labels)).first().kept
    assert quality_rules.judge(docs.limit(0), quality_rules.fit(docs.limit(0), labels)).collect() == []
