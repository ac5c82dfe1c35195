"""Page extraction: tags against the library's parser, hand-labelled pages, and malformed ones."""

import random
import time
from html.parser import HTMLParser

import pytest

from waymark.llm import html_extract

BLOG = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Why bread rises | Kitchen notes</title>
<style>.post{margin:0}</style><script>var x = "<p>not text</p>"; if (a < b && c > d) {}</script></head>
<body class="home single"><header class="site-header"><a href="/" class="logo">Kitchen notes</a>
<nav class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About us</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to make this site better. By going on you accept our policy.</p><button>Accept</button></div>
<main id="content"><article class="post"><h1>Why bread rises</h1>
<p>Yeast eats sugar, and gives off <em>carbon dioxide</em>; the gas stays in the dough
because gluten holds&nbsp;it.</p>
<p>A warm kitchen speeds this up &mdash; but not without end: above 45&deg;C the yeast dies.</p>
<h2>What to do</h2><ul><li>Weigh the flour.</li><li>Let it rest for <b>two</b> hours.</li></ul>
<blockquote><p>Time is the best ingredient, as my grandmother used to say.</p></blockquote>
<p>After that, bake it at 230&deg;C for forty minutes &amp; let it cool.</p></article>
<section class="comments" id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Mine never rises, what do I do wrong?</p></div><div class="comment"><b>Bo</b><p>Try fresh yeast, that helped me a lot.</p></div></section></main>
<aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Ten soups</a></li><li><a href="/2">Knives</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2021 Kitchen notes. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>"""
BLOG_TEXT = """Why bread rises

Yeast eats sugar, and gives off carbon dioxide; the gas stays in the dough because gluten holds it.

A warm kitchen speeds this up — but not without end: above 45°C the yeast dies.

What to do

Weigh the flour.

Let it rest for two hours.

Time is the best ingredient, as my grandmother used to say.

After that, bake it at 230°C for forty minutes & let it cool."""

SCIENCE = """<html><body><div id="nav"><a href="/">Start</a> <a href="/list">List</a> <a href="/help">Help</a></div>
<div class="ad banner"><a href="http://shop.example">Buy two lamps and get one free, this week only!</a></div>
<article><h1>Energy and mass</h1><p>The famous relation <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> says that mass is a form of energy, which the sun turns into light every second.</p>
<p>It is seen in <object data="x.svg">a drawing of the sun</object> and in many experiments that were made since then by patient people.</p>
<p>Nothing moves faster than light, as far as anyone has been able to measure until today.</p></article>
<div class="footer"><p>Imprint &middot; Privacy &middot; Contact us for more information about this site</p></div></body></html>"""
SCIENCE_TEXT = """Energy and mass

The famous relation E=mc2 says that mass is a form of energy, which the sun turns into light every second.

It is seen in a drawing of the sun and in many experiments that were made since then by patient people.

Nothing moves faster than light, as far as anyone has been able to measure until today."""

UNCLOSED = """<body><ul class=menu><li><a href=/>Home<li><a href=/news>News<li><a href=/sport>Sport</ul>
<div class=article><h1>Rain &amp; wind</h1><p>The storm came in the night and took the roof of the old barn with it.
<p>No one was hurt,<br>said the mayor, who had been up all night with the fire brigade.
<p>More rain is on its way &#8212; until Sunday at least, they say.</div>
<form action=/subscribe><p>Get our newsletter every morning<input name=mail><button>Subscribe</button></form>
<div class=footer>Copyright the Evening Post</div>"""
UNCLOSED_TEXT = """Rain & wind

The storm came in the night and took the roof of the old barn with it.

No one was hurt, said the mayor, who had been up all night with the fire brigade.

More rain is on its way — until Sunday at least, they say."""


@pytest.fixture(scope="module")
def forest():
    return html_extract.model()


@pytest.mark.parametrize(("page", "text"), [(BLOG, BLOG_TEXT), (SCIENCE, SCIENCE_TEXT), (UNCLOSED, UNCLOSED_TEXT)])
def test_labelled_pages(forest, page, text):
    assert html_extract.extracted([page], forest) == [text]


def test_nothing_of_an_article_is_dropped(forest):
    """Elements of which the text was once lost."""
    odd = ("<canvas>on canvas</canvas>", "<video src=x>no video</video>", "<audio>no sound</audio>", "<svg viewBox='0 0 1 1'><g><path d='M0'/><text>a label</text></g></svg>", "<math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>hidden</annotation></math>", "<object><param name=a>fallback</object>")
    want = ("on canvas", "no video", "no sound", "a label", "12", "fallback")
    body = "".join(f"<p>A paragraph of the article with {x} in it, and some more words after that.</p>" for x in odd)
    got = html_extract.extracted([f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1>{body}</article></body>"], forest)[0]
    assert got == "Title of it\n\n" + "\n\n".join(f"A paragraph of the article with {x} in it, and some more words after that." for x in want)


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, False))

    def handle_startendtag(self, tag, attrs):
        self.seen.append((tag, False))

    def handle_endtag(self, tag):
        self.seen.append((tag, True))


def tags(source):
    found, at, scanner = [], 0, html_extract.Tags(source)
    while m := scanner.next(at):
        at = m[1]
        if m[2]:
            found.append((m[2], m[3]))
    return found


def test_tags_are_those_of_the_library():
    rng = random.Random(3)
    for page in [BLOG.replace("<style>.post{margin:0}</style>", "").split("<script>")[0] + BLOG.split("</script>")[1], SCIENCE, UNCLOSED, *html_extract.training_pages(20, seed=4)]:
        events = Events()
        events.feed(page.replace("<title>", "<b>").replace("</title>", "</b>"))
        assert tags(page.replace("<title>", "<b>").replace("</title>", "</b>")) == events.seen
    parts = ["<a title='x>y' class=\"q'>\">", "</a>", "text > and < here", "<br/>", "<!-- <p> -->", "<DIV Id=1 >", "</div >", "<p\nclass=a>"]
    for _ in range(200):
        page = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        events = Events()
        events.feed(page)
        events.close()
        assert tags(page) == events.seen, page


def brute_end(source, at):
    """The first > outside of quotes, else the first one."""
    quote = None
    for i in range(at, len(source)):
        if quote:
            quote = None if source[i] == quote else quote
        elif source[i] in "\"'":
            quote = source[i]
        elif source[i] == ">":
            return i
    return source.find(">", at)


def test_ends_of_tags():
    rng = random.Random(5)
    for _ in range(2000):
        source = "".join(rng.choices("<a \"'>x", k=rng.randint(1, 40)))
        scanner, at = html_extract.Tags(source), 0
        while m := scanner.next(at):
            assert m[1] == brute_end(source, m[0] + (3 if m[3] else 2)) + 1 if m[2] in ("a", "ax", "axx") else m[1] > m[0]
            at = m[1]


@pytest.mark.parametrize("page", ["<a " * 150_000, "<a \">\" " * 70_000 + "'", "<a \"\" " * 70_000 + "' >", "<div>" * 80_000 + "x" + "</section>" * 80_000, "<b>" * 90_000 + "</i>" * 90_000, "<template>" * 60_000, "<ul><li>" + "<div>" * 40_000 + "<li></li>" * 40_000, "<div><tr>" * 50_000, "<!--" * 80_000, "<" * 300_000, "</" * 150_000 + ">", "<script>" + "</script " * 60_000, "<p>" * 90_000, "<svg " * 90_000 + ">", "&amp;" * 90_000])
def test_malformed_pages_take_linear_time(page):
    begun = time.process_time()
    made = html_extract.Page(page)
    made.features()
    assert time.process_time() - begun < 8


def test_depth_is_bounded():
    made = html_extract.Page("<div>" * 5000 + "<p>deep <b>" * 800 + "text</b> end")
    depth = [0] * len(made.parent)
    for i in range(1, len(depth)):
        depth[i] = depth[made.parent[i]] + 1
    assert max(depth) <= html_extract.DEEPEST and made.blocks[-1][1] == "deep text end" and len(made.blocks) == 800
