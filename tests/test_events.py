"""One pass over parser events against whole page trees that are walked once a field and card."""

import random
import time
import tracemalloc
from collections.abc import Iterator
from html.parser import HTMLParser

import pytest
import regex
from pyspark.sql import functions as F

from posada.sources.details import BODY_CLASSES, CRUMB_CLASSES, DESCRIPTION_CLASSES, FEATURE_CLASSES, read_parts
from posada.sources.pages import DEFAULTS, PORTALS, POSTED, TIME, Rule, Way, cards, posted_dates


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def walk(self) -> Iterator:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, lines: str = "") -> str:
        """The text with blanks collapsed, or with ``lines`` given as it stands, parts joined by that."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in ("script", "style"):
                stack += reversed(node.children)
        return lines.join(parts) if lines else " ".join(" ".join(parts).split())


class Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _fits(node, tag: str, attribute: str, pattern: str) -> bool:
    return (not tag or node.tag == tag or regex.fullmatch(tag, node.tag) is not None) and (not attribute or attribute in node.attrs and regex.search(pattern, node.attrs[attribute]) is not None)


def _around(node, n: int) -> Iterator:
    while n and node.parent is not None:
        node, n = node.parent, n - 1
        yield node


def _before(node) -> str:
    """The bold text of the nearest element of the same kind before the node."""
    rows = [x for x in node.parent.children if isinstance(x, Node) and x.tag == node.tag] if node.parent else []
    at = rows.index(node) if node in rows else 0
    bold = next((x for x in rows[at - 1].walk() if x.tag == "strong"), None) if at else None
    return bold.text() if bold else ""


def _read(nodes: list, pattern: str, what: str) -> str | None:
    if what == "long":
        return " ".join(t for t in (n.text() for n in nodes) if len(t) > 40)
    for node in nodes:
        if what == "text":
            value = node.text()
        elif what == "lines":
            value = "\n".join([x for x in (line.strip() for line in node.text("\n").split("\n")) if x][:3])
        elif what == "before":
            value = _before(node) if regex.search(pattern, node.text(), regex.I) else ""
        elif what.startswith("first:"):
            value = node.attrs.get(what[6:], "") or node.text() or " "
        elif what.startswith("match:"):
            m = regex.search(what[6:], node.text())
            value = m[1] if m else ""
        else:
            value = node.attrs.get(what, "")
        if value:
            return value
    return None


def _value(card, ways: tuple[tuple[str, str, str, str], ...]) -> str | None:
    for tag, attribute, pattern, what in ways:
        if what == "own":
            if value := card.attrs.get(attribute):
                return value
            continue
        tops: list | Iterator = [card]
        if what.startswith("up "):
            n, what = what[3:].split(":", 1)
            tops = _around(card, int(n))
        for top in tops:
            nodes = [top] if not tag and not attribute else [n for n in top.walk() if n is not card and n is not top and _fits(n, tag, attribute, pattern)]
            if nodes and (value := _read(nodes, pattern, what)):
                return value
    return None


def tree_cards(html: str | None, rule: Rule) -> list[dict[str, str | None]]:
    parser = Tree()
    parser.feed(html or "")
    parser.close()
    kinds = (rule.card, *rule.other_cards)
    nodes = next((some for kind in kinds if (some := [n for n in parser.root.walk() if _fits(n, *kind)])), [])
    out = []
    for node in nodes:
        row = {f: _value(node, rule.fields.get(f, ())) or rule.defaults.get(f, DEFAULTS.get(f)) for f in ("url", "title", "price", "location", "description")}
        if row["title"] and len(row["title"]) >= rule.least_title and all(row[n] for n in rule.needs):
            out.append(row)
    return out


def tree_parts(html):
    """What ``read_parts`` gives."""
    parser = Tree()
    parser.feed(html or "")
    parser.close()
    nodes = list(parser.root.walk())
    has = lambda n, classes: regex.search(classes, n.attrs.get("class", ""), regex.I) is not None
    first = lambda on: next((n for n in nodes if on(n)), None)
    heading = first(lambda n: n.tag == "h1")
    about = first(lambda n: has(n, DESCRIPTION_CLASSES)) or first(lambda n: n.tag == "div" and has(n, BODY_CLASSES))
    trail = first(lambda n: n.tag == "nav" and regex.search("bread", n.attrs.get("aria-label", ""), regex.I)) or first(lambda n: has(n, CRUMB_CLASSES))
    crumbs = [] if trail is None else [t for n in trail.walk() if n.tag in ("a", "li", "span") and not any(x.tag in ("a", "li", "span") for x in n.walk() if x is not n) and (t := n.text())]
    lists = [n.text() for n in nodes if n.tag in ("ul", "div", "table") and has(n, FEATURE_CLASSES)]
    return heading and heading.text(), about and about.text(), crumbs, " ".join(lists)


CLASSES = ("search-list__item", "listviewtitle", "numPrice", "textintro", "item-price", "ellipsis", "item-description", "re-Card", "re-Card-title", "re-Card-price price", "location", "area",
           "name title", "list-item", "property", "description", "content", "breadcrumb", "listing-date", "publicationDate", "features", "price", "")
HREFS = ("/comprar-vivienda/espana/x.html", "/es/p12", "/es/es/exposes/7", "/es/property/hotel-1", "/otra")
TAGS = ("li", "ul", "div", "div", "p", "a", "span", "h1", "h2", "h3", "article", "body", "strong", "nav", "img", "br", "time", "table", "script", "style", "section")
WORDS = ("Ciudad", "Hotel", "€ 100.000", "250.000 €", " ", "\n", "a long text of more than forty characters, for a paragraph ", "&eacute;", "Publicado el 3/4/2020 ", "Added: 5/6/2021 ", "x")


STARTS = ('<li class="search-list__item">', '<h2 class="listviewtitle">', '<article data-element-id="5">', '<a href="/es/property/hotel-1">', '<div class="re-Card">', '<span class="numPrice">', '<span class="textintro">', "<h3>", '<a href="/es/p12">',
          '<a href="/es/es/exposes/7">', '<a href="/comprar-vivienda/espana/x.html">', '<img alt="Hotel in a town">', "<li>a town <strong>", "<body>", "<h1>Hotel name</h1>")


def random_page(rng):
    out = []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.25:
            out.append(rng.choice(STARTS))
        elif kind < 0.45:
            tag = rng.choice(TAGS)
            attrs = [f'class="{rng.choice(CLASSES)}"', f'href="{rng.choice(HREFS)}"', 'alt="Hotel in a town"', 'title="Hotel, a town"', 'data-element-id="5"', 'data-date="2020-05-06"', 'datetime="2019-01-02"', 'aria-label="Breadcrumbs"', 'alt=""']
            body = f"<{tag} {' '.join(a for a in attrs if rng.random() < 0.4)}{'/' if rng.random() < 0.05 else ''}>"
            out.append(body + (f"hidden</{tag}>" if tag in ("script", "style") else ""))
        elif kind < 0.75:
            out.append(f"</{rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(WORDS))
    return "".join(out)


OWN = (
    Rule("long and around", ("li", "class", "."), {"url": (("", "class", "", "own"),), "title": (("p|li", "", "", "long"), ("", "", "", "long"), ("", "", "", "text")), "price": (("p", "class", "price", "up 2:match:(€ [0-9.]+)"), ("li", "", "", "up 1:text"), ("", "", "", "up 9:match:([0-9.]+ €)")), "description": (("span", "", "", "lines"),)}),
    Rule("before", ("ul|div", "", ""), {"title": (("li", "", "Ciudad", "before"), ("strong", "", ".", "before"), ("a", "href", "", "href")), "description": (("", "", "", "up 1:lines"),)}, other_cards=(("article", "", ""), ("p", "", ""))),
    *(Rule(f"posted {portal}", ("#page", "", ""), {"title": ways + TIME, "description": (("", "class", "price", "first:alt"),)}) for portal, ways in POSTED.items()),
)


@pytest.mark.parametrize("rule", [*PORTALS.values(), *OWN], ids=lambda r: r.source)
def test_cards_equal_those_of_a_tree(rule):
    rng = random.Random(rule.source)
    some = 0
    for _ in range(1500):
        html = random_page(rng)
        want = tree_cards(html, rule)
        assert cards(html, rule) == want, html
        some += bool(want)
    assert some > 20


def test_parts_equal_those_of_a_tree():
    rng = random.Random(4)
    for _ in range(3000):
        html = random_page(rng)
        assert read_parts(html) == tree_parts(html), html


@pytest.mark.parametrize("html", [None, "", " ", "<", "no markup", "</div></div>", "<!-- open", "<li"])
def test_odd_pages(html):
    assert read_parts(html) == tree_parts(html)
    for rule in PORTALS.values():
        assert cards(html, rule) == tree_cards(html, rule)


def test_long_page_takes_memory_by_its_depth():
    card = '<li class="search-list__item"><a href="/es/p1"><h3>Hotel in a town</h3></a><p>' + "word " * 100 + "</p></li>"
    rule = PORTALS["LuxuryEstate"]

    def most(n):
        html = "<p>before</p>" + card.replace("search-list__item", "other") * n + card
        tracemalloc.start()
        assert len(cards(html, rule)) == 1
        top = tracemalloc.get_traced_memory()[1] - 2 * len(html)
        tracemalloc.stop()
        return top

    assert most(4000) < most(400) + 200_000


@pytest.mark.parametrize("html", ["<div class=price>x" * 20_000, "<div class=price>" * 20_000, "<li class=search-list__item>" * 20_000, "<li>" * 20_000 + "</p>" * 20_000, "<article>" * 20_000 + "<h2>x</h2>"], ids=range(5))
def test_deep_pages(html):
    start = time.time()
    for name in ("LuxuryEstate", "Habitaclia", "HotelSeVende"):
        cards(html, PORTALS[name])
    read_parts(html)
    assert time.time() - start < 10


def test_what_a_rule_cannot_ask():
    with pytest.raises(ValueError):
        Way.of("p", "", "", "up 2:long")


def test_posted_dates_of_odd_pages(spark):
    rows = [
        (1, None, None), (2, "https://kyero.example", ""), (3, "https://kyero.example", "<b class=date-added></b><time datetime=2020-01-02>x</time>"), (4, "https://x.example", "<time></time><p>2020-01-02</p>"),
        (5, None, "<p>2020-01-02"), (5, None, "<p>2020-01-02"), (None, "https://lucasfox.example", "<p>2020-01-02"), (6, "https://idealista.example", "<div>top <p>Publicado el 1/2/2020</p> 2019-03-04</div>"), (7, "u", "word " * 200_000 + "2020-01-02"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS said", "'y' AS posted")
    as_of = F.lit("2024-05-31").cast("date")
    got = sorted((r.page_id or 0, r.posted) for r in posted_dates(pages, as_of).collect())
    today = "31/05/2024"
    assert got == [(0, today), (1, today), (2, today), (3, today), (4, today), (5, "02/01/2020"), (5, "02/01/2020"), (6, "04/03/2019"), (7, "02/01/2020")]
    assert posted_dates(pages.limit(0), as_of).count() == 0
