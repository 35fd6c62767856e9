"""Main text by density, against a plain version and on pages that mislead."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from voxmill.llm import htmltext

ARTICLE = (
    "<p>First paragraph of the article, which is long enough to be found by density.</p>"
    "<p>Second paragraph of the article, also rather long so that it counts.</p><p>Third one.</p>"
)
TEXT = "\n".join(p.removesuffix("</p>") for p in ARTICLE.split("<p>")[1:])


def tree(rng, depth=0):
    """A random (tag, children): blocks hold blocks, paragraphs hold text and links."""
    if depth > 1 and (rng.random() < 0.6 or depth > 4):
        words = lambda k: " ".join(rng.choices(["alpha", "be", "gamma", "de"], k=k))
        inner = [words(rng.choice([1, 3, 30, 80]))] if rng.random() < 0.8 else []
        for _ in range(rng.choice([0, 0, 0, 1, 6])):
            inner += [("a", [words(2)])]
        return (rng.choice(["p", "li", "h2"]), inner or ["x"])
    return ("body" if not depth else rng.choice(["div", "section", "ul"]), [tree(rng, depth + 1) for _ in range(rng.randint(1, 5))])


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"


def plain(body):
    """Composite text density by its definition, recursively."""

    def size(t):
        return sum(map(len, t.split()))

    def count(x):
        if isinstance(x, str):
            return size(x), 0, 0, 0
        parts = [count(c) for c in x[1]]
        c, t, lc, lt = (sum(p[i] for p in parts) for i in range(4))
        t += sum(not isinstance(y, str) for y in x[1])
        return (c, t, c, lt + 1) if x[0] == "a" else (c, t, lc, lt)

    cb, _, lcb, _ = count(body)

    def density(x):
        c, t, lc, lt = count(x)
        if not c:
            return 0.0
        t = t or 1
        base = math.log(c / max(c - lc, 1) * lc + lcb / cb * c + math.e)
        return c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1.0000001)) / base

    def total(x):
        own = sum(size(c) for c in x[1] if isinstance(c, str))
        extra = own * math.log(max(own, 1.0000001)) / math.log(lcb / cb * own + math.e) if own else 0
        return sum(density(c) for c in x[1] if not isinstance(c, str)) + extra

    def within(x):
        return [x] + [z for c in x[1] if not isinstance(c, str) for z in within(c)]

    def best(x):
        return max(within(x), key=total)

    top = best(body)
    path = [x for x in within(body) if any(z is top for z in within(x))]
    threshold = min(map(density, path)) - 1e-12
    chosen = [top]

    def pick(x):
        if density(x) >= threshold and count(x)[0]:
            chosen.append(best(x))
            for c in x[1]:
                if not isinstance(c, str):
                    pick(c)

    pick(body)
    out = []

    def lines(x, inside):
        inside = inside or any(x is c for c in chosen)
        if x[0] in ("p", "li", "h2") or any(isinstance(c, str) for c in x[1]):
            text = "".join(c if isinstance(c, str) else "".join(c[1]) for c in x[1])
            if inside:
                out.append(" ".join(text.split()))
            else:
                out.extend("".join(c[1]) for c in x[1] if any(c is y for y in chosen))
        else:
            for c in x[1]:
                lines(c, inside)

    lines(body, False)
    return "\n".join(out)


def test_like_the_plain_version():
    rng, differs = random.Random(11), 0
    for _ in range(400):
        body = tree(rng)
        page = "<html>" + written(body) + "</html>"
        want = plain(body)
        assert htmltext.main_text(page) == want
        differs += sum(map(len, want.split())) < len("".join(re.sub("<[^>]*>", " ", page).split()))
    assert differs > 50


def test_table_like_the_plain_version(spark):
    rng = random.Random(12)
    bodies = [tree(rng) for _ in range(30)]
    d = spark.createDataFrame([(i, written(b)) for i, b in enumerate(bodies)], "page_id long, html string")
    assert {r["page_id"]: r["main_text"] for r in htmltext.extract(d).collect()} == {i: plain(b) for i, b in enumerate(bodies)}
    assert htmltext.extract(d).where(F.col("main_text") == "").isEmpty()


@pytest.mark.parametrize("name", ["page-with-sidebar", "content header-visible", "post legal", "main-column rail-right", "article-body toc-enabled", "comments", "sidebar", "ad"])
def test_names_alone_take_nothing_away(name):
    page = f"<body><nav><a href=/>x</a></nav><div class='{name}'>{ARTICLE}</div><div><p>A short side text.</p></div></body>"
    assert TEXT in htmltext.main_text(page)


@pytest.mark.parametrize("name", ["comments", "post-comments", "sidebar-left", "ad", "cookieNotice", "main-menu", "related-posts", "page-header"])
@pytest.mark.parametrize("inside", [True, False])
def test_what_is_named_otherwise_goes(name, inside):
    aside = f"<div class='{name}'><p>A text beside the article that is long enough to look like a part of it.</p></div>"
    page = f"<body><div class=wrap>{ARTICLE}{aside if inside else ''}</div>{'' if inside else aside}</body>"
    assert htmltext.main_text(page) == TEXT


@pytest.mark.parametrize("tag", ["div", "article", "main", "section", "article><section", "form"])
def test_the_tag_of_the_article_doesn_t_matter(tag):
    ends = "".join(f"</{t}>" for t in reversed(tag.split("><")))
    page = f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><{tag}>{ARTICLE}{ends}<footer>&copy; me</footer></body>"
    assert htmltext.main_text(page) == TEXT


def test_a_short_article_tag_doesn_t_win():
    page = f"<body><div>{ARTICLE}</div><div><article><a href=1>Teaser to read next</a></article></div></body>"
    assert htmltext.main_text(page) == TEXT


@pytest.mark.parametrize("attrs", ["title=it's", "title=it\"s", "title='a > b'", 'title="a > \' b"', "it's", "a=b=\"c", "title = 'x'", "data-x=", "a / b='>'"])
def test_quotes_in_attributes(attrs):
    assert htmltext.main_text(f"<body><p>One is here</p><p>See <a href=/x {attrs}>link</a></p><p>Two words</p><p>Three</p></body>") == "One is here\nSee link\nTwo words\nThree"


def test_text_beside_blocks():
    page = "<body><div>Text that stands in the element itself, without a paragraph around it.<br><br>And <b>more</b> of it.<p>A paragraph that follows the text, long enough.</p>A last line.</div></body>"
    assert htmltext.main_text(page) == (
        "Text that stands in the element itself, without a paragraph around it. And more of it.\nA paragraph that follows the text, long enough.\nA last line."
    )


def test_white_space_and_references():
    assert htmltext.main_text("<p>a&nbsp;\n b​c﻿d &am<b></b>p; &lt;p&gt;</p>") == "a b​c﻿d &amp; <p>"


@pytest.mark.parametrize("page", ["<b>x" * 50_000 + "</i>" * 50_000, "<div>x" * 50_000 + "</b>" * 50_000, "<a ='" * 50_000, "<p>" * 50_000 + "</li>" * 50_000, "<table>" * 20_000 + "<td>" * 20_000, "&" * 100_000])
def test_time_is_linear(page):
    htmltext.main_text(page[:1000])
    t = time.process_time()
    assert isinstance(htmltext.main_text(page), str)
    assert time.process_time() - t < 2.5


def test_fifty_thousand_unclosed_tags_take_less_than_a_second():
    t = time.process_time()
    htmltext.main_text("<b>" * 50_000 + "</i>" * 50_000)
    assert time.process_time() - t < 1
