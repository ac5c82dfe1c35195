"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements. Each node has features of its tag, attribute tokens, depth, siblings and
subtree (text and link density). The trees give the probability that a node holds main text; the decoding then takes
the labelling of greatest likelihood in which nothing below a dropped node is kept, so that no descendant contradicts
its ancestors. The trees are fit on pages that training_pages() makes up, in which every node's truth is known.

Text: character references are decoded, white space within a block becomes one space (a line break counts as such),
blocks are trimmed and joined in page order by two line ends; nothing else is dropped or cut.

Formulas, drawings' labels and what stands inside media and object elements are text like any other; a formula's
annotations, which browsers don't show, are not.

Defined cases: a null or empty page has an empty text, as has one without main text; unclosed and stray tags are
mended as browsers do, roughly, and elements nested deeper than DEEPEST stand beside each other there, as in browsers;
equal pages give equal texts; rows that repeat a page_id, or have none, are pages of their own; other columns are
ignored, whatever their names. Very long and malformed pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import ship

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z][^\s/>]*|/)")
_MARK = re.compile("[\"'>]")
_ATTRIBUTES = re.compile(r"""(?:class|id|role|itemprop|aria-label|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe select textarea title annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FOREIGN = frozenset("math mrow mi mn mo ms mtext mfrac msqrt mroot mstyle mpadded mphantom menclose merror msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics svg g defs text tspan path circle rect line desc".split())
INLINE = FOREIGN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var nobr center picture slot wbr object canvas audio video map output meter progress".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
#: What closes an open element of the same group when it begins, up to the element that bounds it.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Tags with a feature of their own, in groups.
TAGS = {t: i for i, group in enumerate(("article", "main", "section div", "p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "header hgroup", "footer address", "aside", "form fieldset", "button input", "table tbody thead tfoot tr td th caption", "figure figcaption", "blockquote pre", "body html", "dialog details")) for t in group.split()}
#: Groups of attribute tokens.
GROUPS = ("nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs topbar skip", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense billboard", "footer foot bottom copyright colophon legal contentinfo", "header masthead brand logo top tagline banner hero", "comment comments commentlist reply replies disqus discussion respond reviews feedback", "sidebar side aside widget rail complementary column secondary related recommended recommendations popular trending more", "cookie cookies consent notice gdpr alert popup modal overlay notification message privacy paywall", "share sharing social follow tools toolbar actions meta byline tags", "form login signup signin subscribe newsletter search subscription register contact", "article content post entry story main text body page copy prose blog read", "hidden none display")
TOKEN_GROUP = {}
for _i, _group in enumerate(GROUPS):
    for _t in _group.split():
        TOKEN_GROUP.setdefault(_t, []).append(_i)
CONTENT_GROUP = 9
#: Open elements at most, as in browsers.
DEEPEST = 512
N_TAGS = max(TAGS.values()) + 2
WIDTH = 2 * N_TAGS + 2 * len(GROUPS) + 17


class Tags:
    """The tags of a page, found in time linear in its length."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.failed: set[int] = set()  # places outside of quotes from which the last quote is left open
        self.unclosed: set[str] = set()  # elements whose end tag doesn't come any more

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Begin, end, name, whether it is an end tag, and attributes of the next tag; a comment or declaration has no name."""
        while m := _OPEN.search(self.source, at):
            begin, name = m.start(), m[0]
            if name == "<!--":
                end = self.source.find("-->", m.end() - 2)
                return begin, len(self.source) if end < 0 else end + 3, "", False, ""
            if begin > self.last[">"]:
                return None
            if name in ("<!", "<?", "</"):
                return begin, self.source.find(">", begin) + 1, "", False, ""
            end = self._end(m.end())
            return begin, end + 1, name.lstrip("</").lower(), name[1] == "/", self.source[m.end() : end]
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: at the first > outside of quotes, or the first one if a quote stays open."""
        way, to = [], at
        while to not in self.failed and (m := _MARK.search(self.source, to)):
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last[m[0]]:
                break
            way.append(to)
            to = self.source.index(m[0], m.end()) + 1
        self.failed.update(way, [to])
        return self.source.find(">", at)

    def closing(self, name: str, at: int) -> tuple[int, int] | None:
        """Begin and end of the element's next end tag."""
        if name in self.unclosed:
            return None
        m = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(self.source, at)
        if m is None or m.start() > self.last[">"]:
            self.unclosed.add(name)
            return None
        return m.start(), self.source.find(">", m.end()) + 1


class Page:
    """Nodes in page order (parents first) and the blocks of text that belong to them."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.tokens = ["body"], [-1], [()]
        self.own, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements; inline ones share their block's node
        opened: Counter[str] = Counter()  # how many of them there are of each name
        parts: list[str] = []
        links, at, end = 0, 0, len(source)
        node = 0
        tags = Tags(source)

        def flush() -> None:
            if parts:
                text = "".join(parts)
                parts.clear()
                if text := " ".join((html.unescape(text) if "&" in text else text).split()):
                    self.blocks.append((node, text))
                    self.own[node] += len(text)

        def pop(to: int) -> None:
            nonlocal node, links
            flush()
            for tag, _ in stack[to:]:
                links -= tag == "a"
                opened[tag] -= 1
            del stack[to:]
            node = stack[-1][1]

        while at < end:
            m = tags.next(at)
            stop = m[0] if m else end
            if stop > at:
                text = source[at:stop]
                parts.append(text)
                if links and not text.isspace():
                    self.linked[node] += len(text)
            if not m:
                break
            _, at, tag, closing, attributes = m
            if not tag:
                continue
            if closing:
                if not opened[tag]:
                    continue
                if tag in INLINE:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            links -= tag == "a"
                            opened[tag] -= 1
                            del stack[i]
                            break
                        if stack[i][0] not in INLINE:
                            break
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            pop(i)
                            break
                        if tag == "p" and stack[i][0] not in INLINE:
                            break
                continue
            if tag in SKIPPED:
                close = tags.closing(tag, at)
                if tag == "head":
                    body = re.compile(r"<body\b", re.I).search(source, at, close[0] if close else end)
                    at = body.start() if body else close[1] if close else at
                elif tag in RAW:
                    at = close[1] if close else end
                elif close and not attributes.endswith("/"):
                    at = close[1]
                continue
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" " if tag == "br" else "")
                continue
            if tag in INLINE:
                # Only elements of drawings and formulas can close themselves.
                if len(stack) < DEEPEST and not (tag in FOREIGN and attributes.endswith("/")):
                    stack.append((tag, node))
                    opened[tag] += 1
                    links += tag == "a"
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag in SIBLINGS:
                closes, bounds = SIBLINGS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in closes:
                        pop(i)
                        if tag not in ("tr", "tbody"):
                            break
            flush()
            # Inline elements that are still open around a block end with it.
            while len(stack) > 1 and stack[-1][0] in INLINE:
                ended = stack.pop()[0]
                links -= ended == "a"
                opened[ended] -= 1
            if len(stack) >= DEEPEST:
                pop(len(stack) - 1)
            found = []
            if attributes:
                for a in _ATTRIBUTES.finditer(attributes):
                    found += [g for t in _TOKENS.findall(a[1] or a[2] or a[3] or a[4] or "") for g in TOKEN_GROUP.get(t.lower(), ())]
            self.tag.append(tag)
            self.parent.append(node)
            self.tokens.append(tuple(found))
            self.own.append(0)
            self.linked.append(0)
            node = len(self.tag) - 1
            stack.append((tag, node))
            opened[tag] += 1
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        text, linked, size, paragraphs, children = list(self.own), list(self.linked), [1] * n, [int(t == "p") for t in self.tag], [0] * n
        rank, depth = [0] * n, [0] * n
        above: list[int] = [0] * n  # groups of tokens and tags that any ancestor has, as bits
        own_bits = [0] * n
        for i in range(n):
            for g in self.tokens[i]:
                own_bits[i] |= 1 << g
            p = self.parent[i]
            if p >= 0:
                rank[i], depth[i] = children[p], depth[p] + 1
                children[p] += 1
                above[i] = above[p] | own_bits[p] | 1 << (len(GROUPS) + TAGS.get(self.tag[p], N_TAGS - 1))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            linked[p] += linked[i]
            size[p] += size[i]
            paragraphs[p] += paragraphs[i]
        all_text = max(1, text[0])
        log = math.log1p
        x = np.zeros((n, WIDTH))
        base = 2 * N_TAGS + 2 * len(GROUPS)
        previous: dict[int, int] = {}
        for i in range(n):
            p = max(0, self.parent[i])
            row = x[i]
            row[TAGS.get(self.tag[i], N_TAGS - 1)] = 1
            bits, up = own_bits[i], above[i]
            while bits:
                low = bits & -bits
                row[2 * N_TAGS + low.bit_length() - 1] = 1
                bits ^= low
            while up:
                low = up & -up
                k = low.bit_length() - 1
                row[N_TAGS + k - len(GROUPS) if k >= len(GROUPS) else 2 * N_TAGS + len(GROUPS) + k] = 1
                up ^= low
            before = previous.get(p, i)
            previous[p] = i
            row[base:] = (
                log(text[i]), log(self.own[i]), min(1.0, linked[i] / max(1, text[i])), text[i] / size[i], text[i] / all_text, log(size[i]), log(paragraphs[i]), depth[i],
                children[i], rank[i], rank[i] / max(1, children[p]), children[p], text[i] / max(1, text[p]), min(1.0, linked[p] / max(1, text[p])), log(text[before]), log(paragraphs[p]), log(text[p]),
            )
        return x

    def decoded(self, p: np.ndarray) -> list[bool]:
        """Labels of greatest likelihood in which a kept node's ancestors are kept."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
        for i in range(len(self.tag) - 1, 0, -1):
            up = self.parent[i]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
        kept = [True] * len(self.tag)
        kept[0] = keep[0] > drop[0]
        for i in range(1, len(self.tag)):
            kept[i] = kept[self.parent[i]] and keep[i] > drop[i]
        return kept

    def text(self, kept: list[bool]) -> str:
        return "\n\n".join(t for node, t in self.blocks if kept[node])


def training_pages(n: int, seed: int = 5) -> Iterator[str]:
    """Made-up pages of many layouts. Blocks of main text end in the word `keepme`, all others don't."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    some = lambda p: rng.random() < p
    sound = lambda: "".join(pick("ka", "lo", "mi", "ter", "an", "es", "ou", "pra", "tion", "ul", "sch", "né") for _ in range(int(rng.integers(1, 4))))

    def words(low: int, high: int) -> str:
        w = [sound() + (pick("", "", "", ",", "***", "!!", " |") if some(0.15) else "") for _ in range(int(rng.integers(low, high)))]
        return (" ".join(w).upper() if some(0.08) else " ".join(w).capitalize()) + pick(".", ".", "", "&amp;")

    def attribute(*names: str) -> str:
        if some(0.15):
            return ""
        name = pick(*names) + (pick("-", "_") + pick("wrap", "box", "area", "inner", "x1") if some(0.3) else "")
        return f" {pick('class', 'class', 'id')}={chr(34)}{name}{chr(34)}"

    def box(names: tuple[str, ...], inside: str, *tags: str) -> str:
        t = pick(*tags)
        return f"<{t}{attribute(*names) if t in ('div', 'section', 'ul', 'p') or some(0.5) else ''}>{inside}</{t}>"

    links = lambda k: "".join(f"<li><a href='/{sound()}'>{words(1, 3)}</a></li>" for _ in range(k))
    menu = lambda: box(("nav", "menu", "navbar", "breadcrumbs"), pick("<ul>" + links(int(rng.integers(2, 9))) + "</ul>", "".join(f"<a href='/x'>{words(1, 3)}</a> " for _ in range(5))), "nav", "nav", "div", "div")
    paragraphs = lambda low, high: "".join(f"<p>{words(2, 30)}{pick('</p>', '</p>', '')}" for _ in range(int(rng.integers(low, high))))
    advert = lambda: box(("ad", "ads", "advert", "sponsored", "promo"), pick(words(3, 30), paragraphs(1, 3), f"<a href='http://x'>{words(2, 9)}</a>"), "div", "div", "aside", "section")
    notice = lambda: box(("cookie", "notice", "consent-banner", "alert", "gdpr popup"), pick(words(6, 30), f"<p>{words(6, 30)}</p><button>{words(1, 3)}</button>"), "div", "div", "section", "dialog", "aside")
    side = lambda: box(("sidebar", "side", "widget", "related", "rail"), (f"<h3>{words(1, 4)}</h3>" if some(0.6) else "") + pick("<ul>" + links(4) + "</ul>", paragraphs(1, 5), words(5, 25)), "aside", "aside", "div", "section")
    form = lambda: box(("newsletter", "subscribe", "login", "search"), f"<form action='/s'>{pick(f'<p>{words(2, 12)}</p>', words(2, 9))}<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>", "div", "section") if some(0.5) else f"<form><p>{words(2, 14)}</p><input><button>{words(1, 3)}</button></form>"
    comments = lambda: box(("comments", "comment-list", "discussion", "replies"), (f"<h3>{words(1, 4)}</h3>" if some(0.7) else "") + "".join(box(("comment", "reply"), f"{pick('<b>', '<h4>')}{words(1, 3)}{pick('</b>', '</h4>')}<p>{words(3, 40)}</p>", "div", "li", "article", "section") for _ in range(int(rng.integers(1, 6)))), "div", "section", "section", "ol")
    share = lambda: box(("share", "social", "tools", "tags"), pick("<ul>" + links(3) + "</ul>", f"<a href='#'>{words(1, 2)}</a>"), "div", "div", "ul")
    header = lambda: box(("header", "masthead", "top"), pick(f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>") + (menu() if some(0.4) else ""), "header", "header", "div")
    footer = lambda: box(("footer", "bottom", "copyright", "colophon"), pick(f"&copy; {sound()}.example &middot; {words(3, 30)}\n{words(2, 20)}", paragraphs(1, 3), f"<p>{words(3, 20)}</p><ul>{links(4)}</ul>"), "footer", "footer", "footer", "div")

    def article() -> str:
        mark, out = " keepme", []
        if some(0.85):
            t = pick("h1", "h1", "h2")
            out.append(f"<{t}>{pick('A', '3', words(1, 2)) if some(0.1) else words(1, 12)}{mark}</{t}>")
        long = some(0.08)
        for _ in range(int(rng.integers(1, 4) if some(0.4) else rng.integers(1, 22))):
            kind, body = rng.random(), (words(1, 4) if some(0.25) else words(3, 60)) * (int(rng.integers(5, 60)) if long and some(0.5) else 1)
            if kind < 0.75:
                out.append(f"<p>{pick('', '', '<b>', '<i>')}{body}{mark}{pick('</p>', '</p>', '</p>', '<br>', '')}")
            elif kind < 0.81:
                t = pick("h2", "h3")
                out.append(f"<{t}>{words(1, 7)}{mark}</{t}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(1, 16)}{mark}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{body}{mark}</p></blockquote>" if some(0.5) else f"<blockquote>{body}{mark}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 4)}{mark}</td><td>{words(1, 4)}{mark}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{body}{mark}</pre>")
            elif kind < 0.95:
                out.append(f"<div>{body}{mark}</div>")
            else:
                out.append(pick(advert, share, form, side, notice)())
        if some(0.1):
            out.append(comments())
        inside = "".join(out)
        t = pick("article", "article", "article", "main", "div", "section")
        made = f"<{t}{attribute('content', 'post', 'entry', 'article-body', 'story', 'main-text') if t in ('div', 'section') or some(0.3) else ''}>{inside}</{t}>"
        return f"<{pick('main', 'div', 'section')}{attribute('main', 'content', 'page')}>{made}{side() if some(0.2) else ''}{comments() if some(0.2) else ''}</{pick('main', 'div')}>" if some(0.3) else made

    for _ in range(n):
        before = [f() for f, p in ((notice, 0.2), (header, 0.5), (menu, 0.75), (advert, 0.5), (side, 0.2), (form, 0.15)) if some(p)]
        after = [f() for f, p in ((comments, 0.3), (side, 0.3), (advert, 0.2), (form, 0.2), (share, 0.2), (notice, 0.1), (footer, 0.85)) if some(p)]
        body = "".join([*before, article() if some(0.97) else "", *after]) if some(0.93) else article()
        if some(0.2):
            body = f"<div{attribute('wrapper', 'container', 'page')}>{body}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{body}{pick('</body></html>', '')}"


@cache
def model(pages: int = 700) -> trees.Forest:
    """Trees fit on made-up pages: a node's truth is whether main text is in it or below it."""
    xs, ys = [], []
    for source in training_pages(pages):
        page = Page(source)
        truth = np.zeros(len(page.tag), bool)
        for node, text in page.blocks:
            truth[node] |= "keepme" in text
        for i in range(len(page.tag) - 1, 0, -1):
            truth[page.parent[i]] |= truth[i]
        xs.append(page.features())
        ys.append(truth)
    return trees.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees=36, depth=5, rate=0.3, bins=32)


def extracted(sources: list[str], forest: trees.Forest) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x = [p.features() for p in pages]
    scores = np.split(forest.score(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
    return [p.text(p.decoded(s)) for p, s in zip(pages, scores, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """For each page: page_id, url, text and n_chars."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                texts = extracted([s or "" for s in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
