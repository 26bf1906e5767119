"""Extraction from tables of web pages (page_id, url, html): native expressions, and one distributed job for nested markup."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.base import collapse, found, present
from posada.functions.places import place_from_slug, portal_place, portal_title
from posada.functions.prices import portal_price, price_or_request
from posada.functions.text import about_hotels, canonical_url, clean, unescape

from .events import PAGE, Element, Reader

_DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _DROPPED, " "), "<[^>]*>", " ")
    return collapse(unescape(bare))


def links(html: Column, pattern: str = "[^\"]*") -> Column:
    """Distinct link targets that match a pattern, in page order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f'(?i)<a\\b[^>]*?\\bhref="({pattern})"'), F.lit(1)))


# Meta tags that name a town, and values that name the country only.
PLACE_METAS, COUNTRY = ("og:locality", "geo.placename", "city"), ("spain", "españa")


def meta_value(html: Column, name: str) -> Column:
    either = rf'(?i)<meta\b[^>]*\b(?:name|property)="{regex.escape(name)}"[^>]*\bcontent="([^"]*)"'
    swapped = rf'(?i)<meta\b[^>]*\bcontent="([^"]*)"[^>]*\b(?:name|property)="{regex.escape(name)}"'
    return F.coalesce(present(F.regexp_extract(html, either, 1)), present(F.regexp_extract(html, swapped, 1)))


def meta_place(html: Column) -> Column:
    values = (meta_value(html, n) for n in PLACE_METAS)
    return F.coalesce(*(F.when(~F.lower(v).isin(*COUNTRY), v) for v in values))


# Crumbs that are no place.
NO_CRUMBS = ("españa", "hoteles", "inicio", "home")


def last_crumb(crumbs: Column) -> Column:
    """The last crumb that can be a place."""
    return F.try_element_at(F.filter(crumbs, lambda c: ~F.lower(F.trim(c)).isin(*NO_CRUMBS) & (F.trim(c) != "")), F.lit(-1))


def crumb_before_last(crumbs: Column) -> Column:
    return F.when(F.size(crumbs) >= 2, F.try_element_at(crumbs, F.lit(-2)))


def page_status(html: Column, text: Column) -> Column:
    """'blocked', 'consent', 'no_result' or 'ok'."""
    head = F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(500)))
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda c, *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(c, x))
    return (
        F.when(F.contains(head, F.lit("javascript")) & F.contains(head, F.lit("robot")), "blocked")
        .when(has(low, "antes de ir a google", "before you continue"), "consent")
        .when(has(low, "no se han encontrado", "no hemos encontrado", "no results"), "no_result")
        .otherwise("ok")
    )


def json_ld_items(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, script, pos, url, name, description) of all item lists in the pages' JSON-LD scripts, objects or arrays; the URL is cut at '?' and at slashes at its end."""
    bodies = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    scripts = pages.select(key, F.posexplode(bodies).alias("script", "body")).withColumn("root", F.try_parse_json("body")).where("root is not null")
    as_list = F.try_variant_get("root", "$", "array<variant>")
    roots = scripts.select(key, "script", F.posexplode(F.coalesce(as_list, F.array("root"))).alias("part", "node"))
    lists = roots.where(F.try_variant_get("node", "$.@type", "string") == "ItemList")
    items = lists.select(key, "script", "part", F.posexplode(F.try_variant_get("node", "$.itemListElement", "array<variant>")).alias("pos", "item"))
    get = lambda p: present(F.try_variant_get("item", p, "string"))
    url = F.regexp_replace(F.split_part(F.coalesce(get("$.item.url"), get("$.item.@id")), F.lit("?"), F.lit(1)), "/+$", "")
    out = items.select(key, "script", "part", "pos", url.alias("url"), get("$.item.name").alias("name"), F.coalesce(get("$.item.description"), F.lit("")).alias("description"))
    return out.where((F.col("url") != "") & F.col("name").isNotNull())


# The paths at which an app's state may hold its listings, in the order in which they are tried.
STATE_PATHS = ("$.props.pageProps.initialProps.listings", "$.props.pageProps.listings", "$.props.pageProps.result.items")


def app_state_items(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, url, title, price, location, description) from the state that an app embeds in its page."""
    body = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    roots = pages.select(key, F.try_parse_json(body).alias("root"))
    found = F.coalesce(*(F.filter(F.try_variant_get("root", p, "array<variant>"), lambda x: x.isNotNull()) for p in STATE_PATHS))
    items = roots.select(key, F.posexplode(found).alias("pos", "item"))
    get = lambda *paths: F.coalesce(*(present(F.try_variant_get("item", p, "string")) for p in paths))
    return items.select(
        key, "pos", get("$.url", "$.link").alias("url"), get("$.title", "$.name").alias("title"), get("$.price.value", "$.price").alias("price"),
        get("$.address.municipality", "$.address.province").alias("location"), F.coalesce(get("$.description"), F.lit("")).alias("description"),
    )


@dataclass(frozen=True)
class Rule:
    """How one portal's pages are read.

    ``card`` names the element of a row as (tag, attribute, pattern); an empty tag takes any, ``PAGE`` the whole page. A field is a list
    of ways, tried in order: (tag, attribute, pattern, what), where what is 'text', 'lines' (the first three lines
    of text), 'long' (texts of all such elements of more than 40 characters, joined), 'before' (the text of the bold
    part of the element of the same kind before it), 'first:NAME' (that attribute of the first such element, else its text, else a
    blank: later elements and ways are not asked), an attribute's name, or 'match:REGEX' on the text of the
    element; a tag of '' with no attribute stands for the card itself. 'up N:' before that looks in the nearest of
    N elements around the card that has such an element. A card needs all of ``needs``. ``finish`` makes the
    columns final, from those that were read.
    """

    source: str
    card: tuple[str, str, str]
    fields: dict[str, tuple[tuple[str, str, str, str], ...]]
    defaults: dict[str, str] = field(default_factory=dict)
    least_title: int = 1
    needs: tuple[str, ...] = ()
    #: Elements that are the cards where a page has none of ``card``, in order.
    other_cards: tuple[tuple[str, str, str], ...] = ()
    #: Whether only titles about hotels are listed.
    hotels: bool = False
    finish: dict[str, Callable[[], Column]] = field(default_factory=dict)


# The markup of the portals, and what stands for a missing price or place.
DEFAULTS = {"price": "Precio a consultar", "location": "España", "description": ""}
AMOUNT = r"match:(\d[\d.,]*\s*€|€\s*\d[\d.,]*)"
PORTALS = {
    r.source: r
    for r in (
        Rule("Lucas Fox", ("li", "", ""), {"url": (("a", "href", r"/comprar-vivienda/espana/.*\.html$", "href"),), "title": (("", "class", "title|name", "text"),), "price": (("", "class", "price", AMOUNT),), "location": (("", "class", "location|area", "text"),)}, least_title=5),
        Rule(
            "LuxuryEstate", ("li", "class", "search-list__item"),
            {"url": (("a", "href", r"/es/p\d+", "href"),), "title": (("h[234]", "", "", "text"), ("a", "href", r"/es/p\d+", "text")), "price": (("", "class", "price", "text"),), "description": (("p", "", "", "text"),)},
            needs=("url",), finish={"price": lambda: reordered(F.col("price")), "location": lambda: F.coalesce(place_from_slug(canonical_url(F.col("url")), "hotel-for-sale-(.+)$"), F.col("location"))},
        ),
        Rule(
            "NegociosEnVenta", ("h2", "class", "listviewtitle"),
            {"url": (("a", "href", ".", "href"),), "title": (("", "", "", "text"),), "price": (("span", "class", "numPrice", "up 8:text"),), "location": (("span", "class", "textintro", "up 1:text"),), "description": (("p", "", "", "up 1:text"),)},
            least_title=5, needs=("url",), finish={"price": lambda: price_or_request(F.col("price"))},
        ),
        Rule(
            "Engel & Völkers", ("article", "", ""),
            {"url": (("a", "href", "/es/es/exposes/", "href"),), "title": (("img", "alt", ".", "alt"),), "price": (("", "", "", r"match:(\d[\d.,]*\s*€)"),), "location": (("", "", "", "lines"),)},
            least_title=8, needs=("url",), finish={"location": lambda: place_in_lines(F.col("location"))},
        ),
        Rule(
            "HotelSeVende", ("body", "", ""),
            {"title": (("h1", "", "", "text"),), "price": (("", "", "", r"match:(€\d[\d.,]*)"),), "location": (("li", "", "^Ciudad$", "before"),), "description": (("p", "", "", "long"),)},
            least_title=8, finish={"price": lambda: price_or_request(F.col("price")), "description": lambda: F.left("description", F.lit(1500))},
        ),
        Rule(
            "Oi Real Estate", ("body", "", ""), {"title": (("h1", "", "", "text"),), "price": (("", "", "", r"match:(\d[\d.,]*\s*€)"),), "description": (("div", "class", "(?i)desc|content|text|body", "text"),)},
            least_title=8, finish={"location": lambda: F.coalesce(place_from_slug(F.col("url"), r"/propiedad/\d+/[^/]+-en-venta-en-(.+)$"), F.lit(DEFAULTS["location"])), "description": lambda: F.left("description", F.lit(1500))},
        ),
        Rule(
            "Idealista", ("article", "data-element-id", "."),
            {"url": (("", "data-element-id", ".", "own"), ), "title": (("a", "title", ".", "title"),), "price": (("span", "class", "item-price", "text"),), "description": (("p", "class", "ellipsis", "text"), ("", "class", "item-description", "text"))},
            least_title=8, needs=("url",), finish={"url": lambda: F.concat(F.lit("https://www.idealista.com/inmueble/"), F.col("url"), F.lit("/")), "location": lambda: F.coalesce(F.trim(found(F.col("title"), r",\s*[^,]+,\s*([^,]+)$")), F.col("location"))},
        ),
        Rule(
            "Kyero", ("a", "href", "/es/property/"), {"url": (("", "", "", "href"),), "title": (("img", "alt", ".", "alt"),), "price": (("", "", "", r"up 1:match:(€\s*[\d.,]+)"),)}, least_title=5, hotels=True,
            finish={"url": lambda: absolute(F.col("url"), "https://www.kyero.com"), "title": lambda: F.trim(F.split_part("title", F.lit(" - foto"), F.lit(1))), "price": lambda: F.when(F.contains("price", F.lit("€")), F.replace("price", F.lit(" "), F.lit(""))).otherwise(F.col("price")),
                    "location": lambda: F.coalesce(F.trim(found(F.split_part("title", F.lit(" - foto"), F.lit(1)), r"^.*? en (.*)$")), F.lit(DEFAULTS["location"]))},
        ),
        Rule(
            "Fotocasa", ("", "class", r"(?i)re-Card\b"),
            {"url": (("a", "href", "", "href"),), "title": (("", "class", "(?i)re-Card-title|CardTitle", "text"), ("h[234]", "", "", "text")), "price": (("", "class", "(?i)re-Card-price|CardPrice|price", "text"),), "location": (("", "class", "(?i)re-Card-location|CardLocation|location", "text"),)},
            least_title=8, other_cards=(("article", "", ""), ("li", "class", "(?i)listing|result|property")), hotels=True, finish={"url": lambda: absolute(F.col("url"), "https://www.fotocasa.es")},
        ),
        Rule(
            "Habitaclia", ("article", "", ""),
            {"url": (("a", "href", "", "href"),), "title": (("h[234]", "", "", "text"), ("", "class", "(?i)title|name", "text")), "price": (("", "class", "(?i)price|precio", "text"),), "location": (("", "class", "(?i)location|zona|area|town", "text"),)},
            least_title=8, other_cards=(("", "class", "(?i)list-item|property|result"),), finish={"url": lambda: absolute(F.col("url"), "https://www.habitaclia.com")},
        ),
        # Every page of the plain kind: its heading and first paragraph.
        Rule("plain", ("article", "", ""), {"title": (("h1", "", "", "text"),), "description": (("p", "", "", "text"),)}),
    )
}


@dataclass(frozen=True)
class Way:
    """One way to a field: as in ``Rule``, with the number of elements around the card that it looks in (0: the card)."""

    tag: str
    attribute: str
    pattern: str
    what: str
    around: int = 0

    @classmethod
    def of(cls, tag: str, attribute: str, pattern: str, what: str) -> Way:
        around = 0
        if what.startswith("up "):
            n, what = what[3:].split(":", 1)
            around = int(n)
            if what in ("long", "before"):
                raise ValueError(f"a rule can look for '{what}' within a card only")
        return cls(tag, attribute, pattern, what, around)

    @property
    def itself(self) -> bool:
        """Whether it reads the card (or the element around it) and none within."""
        return self.what == "own" or not self.tag and not self.attribute


class Plan:
    """A rule made ready for a stream of elements: which of its patterns an element of a name can fit is decided once a name."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.kinds = (rule.card, *rule.other_cards)
        self.ways: list[Way] = []
        self.fields: dict[str, list[int]] = {}
        for name, ways in rule.fields.items():
            self.fields[name] = list(range(len(self.ways), len(self.ways) + len(ways)))
            self.ways += [Way.of(*w) for w in ways]
        self.around = any(w.around for w in self.ways)
        self._by_tag: dict[str, tuple] = {}

    def of_tag(self, tag: str) -> tuple[list, list, bool]:
        """((number, attribute, pattern) of the kinds of cards, the same of the ways, whether ways look before such an element)."""
        if tag not in self._by_tag:
            named = lambda t: not t or t == tag or regex.fullmatch(t, tag) is not None
            kinds = [(i, a, regex.compile(p)) for i, (t, a, p) in enumerate(self.kinds) if named(t)]
            ways = [(i, w.attribute, regex.compile(w.pattern)) for i, w in enumerate(self.ways) if not w.itself and named(w.tag)]
            self._by_tag[tag] = kinds, ways, any(self.ways[i].what == "before" for i, _, _ in ways)
        return self._by_tag[tag]


class Card:
    """A card's element and what was read of it so far: of each field the way that found it and the value."""

    __slots__ = ("element", "got")

    def __init__(self, element: Element):
        self.element = element
        self.got: dict[str, tuple[int, str]] = {}


class CardReader(Reader):
    """Reads all cards of a page in one pass.

    Elements that fit a way are listed by way in page order while a card is open, so those of a card are the ones since
    its own number; they are read when it closes. Ways that look around a card wait in the elements around it, and
    then the text of the page is kept, else only the text since the outermost open card.
    """

    def __init__(self, plan: Plan):
        super().__init__()
        self.plan = plan
        self.kind, self.inside, self.keeps = len(plan.kinds), 0, plan.around
        self.whole = ""  # the text of the page, where it is the card
        self.cards: list[Card] = []
        self.found: list[list[Element]] = [[] for _ in plan.ways]
        self.rows: list[Element] = []  # open elements that ways may look before
        if plan.kinds[0][0] == PAGE:
            self.kind = 0
            self.enter(self.open[0])

    def opened(self, x: Element) -> None:
        kinds, ways, row = self.plan.of_tag(x.tag)
        fits = lambda attribute, pattern: not attribute or attribute in x.attrs and pattern.search(x.attrs[attribute]) is not None
        if self.keeps:
            for i, attribute, pattern in ways:
                if fits(attribute, pattern):
                    self.found[i].append(x)
            if row:
                x.before = (self.open[-1].last or {}).get(x.tag, "")
                self.rows.append(x)
            if x.tag == "strong":
                for around in reversed(self.rows):
                    if around.bold is not None:
                        break
                    around.bold = x
        kind = next((i for i, attribute, pattern in kinds if i <= self.kind and fits(attribute, pattern)), None)
        if kind is None:
            return
        if kind < self.kind:  # cards of the kinds that come later count for nothing from here on
            self.kind = kind
            self.cards.clear()
        self.enter(x)

    def enter(self, x: Element) -> None:
        x.card = Card(x)
        self.cards.append(x.card)
        self.inside += 1
        self.keeps = True

    def value(self, x: Element, way: Way) -> str:
        if way.what == "text":
            return self.text(x)
        if way.what.startswith("first:"):
            return x.attrs.get(way.what[6:], "") or self.text(x) or " "
        if way.what == "own":
            return x.attrs.get(way.attribute, "")
        if way.what == "lines":
            return "\n".join([y for y in (line.strip() for line in "\n".join(self.pieces[x.start : x.end]).split("\n")) if y][:3])
        if way.what == "before":
            return x.before if regex.search(way.pattern, self.text(x), regex.I) else ""
        if way.what.startswith("match:"):
            m = regex.search(way.what[6:], self.text(x))
            return m[1] or "" if m else ""
        return x.attrs.get(way.what, "")

    def first(self, i: int, top: Element, card: Element) -> str:
        """What way i finds in a closed element, the card itself left out. Elements that have nothing to find are forgotten."""
        way, some = self.plan.ways[i], self.found[i]
        if way.itself:
            return self.long([top]) if way.what == "long" else self.value(top, way)
        at = bisect_right(some, top.number, key=lambda x: x.number)
        if way.what == "long":
            return self.long(some[at:])
        while at < len(some):
            if some[at] is card:
                at += 1
            elif value := self.value(some[at], way):
                return value
            else:
                del some[at]
        return ""

    def long(self, some: list[Element]) -> str:
        return " ".join(t for t in map(self.text, some) if len(t) > 40)

    def closed(self, x: Element) -> None:
        if self.rows and self.rows[-1] is x:
            self.rows.pop()
            parent = self.open[-1]
            parent.last = parent.last or {}
            parent.last[x.tag] = "" if x.bold is None else self.text(x.bold)
        for card, name, i, left in x.waiting or ():
            if name in card.got and card.got[name][0] < i:
                continue
            if value := self.first(i, x, card.element):
                card.got[name] = i, value
            elif left > 1:
                self.wait(card, name, i, left - 1)
        x.waiting = None
        if x.card is None:
            return
        for name, ways in self.plan.fields.items():
            for i in ways:
                if n := self.plan.ways[i].around:
                    self.wait(x.card, name, i, n)
                elif value := self.first(i, x, x):
                    x.card.got[name] = i, value
                    break
        if x.number == 0:
            self.whole = self.text(x)
        self.inside -= 1
        if not self.inside and not self.plan.around:
            self.keeps = False
            self.pieces.clear()
            for some in self.found:
                some.clear()

    def wait(self, card: Card, name: str, i: int, left: int) -> None:
        if self.open:
            around = self.open[-1]
            around.waiting = around.waiting or []
            around.waiting.append((card, name, i, left))


def cards(html: str | None, rule: Rule | Plan) -> list[dict[str, str | None]]:
    """The cards of a page in page order, nested ones too."""
    plan = rule if isinstance(rule, Plan) else Plan(rule)
    reader = CardReader(plan)
    reader.read(html)
    out = []
    for card in reader.cards:
        row = {f: card.got.get(f, (0, ""))[1] or plan.rule.defaults.get(f, DEFAULTS.get(f)) for f in ("url", "title", "price", "location", "description")}
        if row["title"] and len(row["title"]) >= plan.rule.least_title and all(row[n] for n in plan.rule.needs):
            out.append(row)
    return out


def extract_listings(pages: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(page_id, pos, url, title, price, location, description, source) of every card on pages (page_id, url, html, source).

    A page's ``source`` picks its rule; pages of unknown sources give nothing. A card without a URL has the page's.
    """
    known = PORTALS if rules is None else rules

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = {source: Plan(rule) for source, rule in known.items()}
        for part in batches:
            out = []
            for key, url, html, source in zip(part["page_id"], part["url"], part["html"], part["source"], strict=True):
                for pos, row in enumerate(cards(html, plans[source])):
                    out.append((key, pos, row["url"] or url, row["title"], row["price"], row["location"], row["description"], source))
            yield pd.DataFrame(out, columns=["page_id", "pos", "url", "title", "price", "location", "description", "source"])

    some = pages.where(F.col("source").isin(*known)).select("page_id", "url", "html", "source")
    names = ("url", "title", "price", "location", "description")
    read = some.mapInPandas(run, "page_id long, pos int, " + ", ".join(f"{n} string" for n in names) + ", source string")

    def final(name: str) -> Column:
        value = F.col(name)
        for rule in known.values():
            if name in rule.finish:
                value = F.when(F.col("source") == rule.source, rule.finish[name]()).otherwise(value)
        return value.alias(name)

    listed = read.select("page_id", "pos", *map(final, names), "source")
    picky = [s for s, rule in known.items() if rule.hotels]
    return listed.where(~F.col("source").isin(*picky) | about_hotels(F.col("title"))) if picky else listed


def absolute(url: Column, site: str) -> Column:
    """A link of a site's page as a whole URL, without its query."""
    path = F.split_part(url, F.lit("?"), F.lit(1))
    return F.when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(site), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))


def reordered(price: Column) -> Column:
    """A price without blanks, the euro sign after the amount."""
    return F.trim(F.regexp_replace(F.replace(price, F.lit(" "), F.lit("")), r"€\s*([\d.,]+)", "$1 €"))


def place_in_lines(lines: Column) -> Column:
    """What stands before the country in the first of the lines that names it, the islands, or anything with a comma; the default if there is none."""
    named = F.filter(F.split(lines, "\n"), lambda x: F.contains(x, F.lit("España")) | F.contains(x, F.lit("Baleares")) | F.contains(x, F.lit(",")))
    places = F.transform(named, lambda x: F.trim(F.rtrim(F.trim(F.split_part(x, F.lit("España"), F.lit(1))), F.lit(","))))
    return F.coalesce(F.get(F.filter(places, lambda x: x != ""), F.lit(0)), F.lit(DEFAULTS["location"]))


def think_listings(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, price, location, description, source) of a portal whose pages list items as JSON-LD, with all but the URL in the item's name; of repeated URLs on a page the first."""
    items = json_ld_items(pages)
    title = portal_title(F.col("name"))
    rows = items.select("page_id", F.struct("script", "part", "pos").alias("at"), "url", title.alias("title"), portal_price(F.col("name")).alias("price"), portal_place(title).alias("location"), clean(F.col("description")).alias("description"))
    first = rows.groupBy("page_id", "url").agg(F.min_by(F.struct("title", "price", "location", "description"), "at").alias("x"))
    return first.select("page_id", "url", "x.*", F.lit("ThinkSpain").alias("source"))


# What cards look like to patterns, without parsing.
CARD_BODY = r'(?is)<(?:article|div)[^>]+class="[^"]*(?:property|listing|card|result)[^"]*"[^>]*>(.*?)</(?:article|div)>'
CARD_TITLE, CARD_PRICE = "(?s)<h[123][^>]*>([^<]{10,100})</h[123]>", r"(?i)([\d.]+\s*€|[\d,]+\s*EUR|Precio[^<]{0,30})"
CARD_PLACE, CARD_LINKS = r"(?i)(?:location|ciudad|ubicacion)[^>]*>\s*([^<]{3,40})\s*<", (r'(?i)href="(/es/[^"]+(?:hotel|propiedad|inmueble)[^"]*)"', r'href="(/es/propiedades/[^"]+)"')


def regex_cards(pages: DataFrame, site: str) -> DataFrame:
    """(page_id, pos, url, title, price, location) of cards about hotels, by patterns only; a card without a link has the page's URL."""
    bodies = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(CARD_BODY), F.lit(1))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(bodies).alias("pos", "card"))
    title = found(F.col("card"), CARD_TITLE)
    link = F.coalesce(*(found(F.col("card"), p) for p in CARD_LINKS))
    some = rows.where(title.isNotNull() & about_hotels(F.concat(title, F.col("card")), veto=False))
    price, place = found(F.col("card"), CARD_PRICE), found(F.col("card"), CARD_PLACE)
    return some.select(
        "page_id", "pos", F.coalesce(F.concat(F.lit(site), link), "page_url").alias("url"), clean(title).alias("title"),
        F.when(price.isNotNull(), clean(price)).otherwise(DEFAULTS["price"]).alias("price"), F.when(place.isNotNull(), clean(place)).otherwise(DEFAULTS["location"]).alias("location"),
    )


def detail_patch(pages: DataFrame) -> DataFrame:
    """(page_id, url, rooms, beds, m2, stars, location_city) read from detail pages' visible text and meta tags."""
    from posada.functions.attributes import from_text

    seen = pages.select("page_id", "url", from_text(visible_text(F.col("html"))).alias("x"), meta_place(F.col("html")).alias("location_city"))
    return seen.select("page_id", "url", "x.*", "location_city")


# Where the portals, known by a part of their URLs, say when a page was published; the portal whose pages count as of today;
# and the forms of a date in the text of a page, in the order in which they are tried.
TIME = (("time", "", "", "first:datetime"),)
POSTED = {
    "idealista": (("p|span|div|time", "", "", r"match:(?is)^(.*publicad[oa]\s+(?:el\s+)?\d.*)$"), ("", "data-date", ".", "data-date")),
    "thinkspain": (("span|p|div|time", "", "", r"match:(?is)^(.*(?:listed|added|posted|publicad|fecha)[\s:]+.*)$"),),
    "kyero": (("", "class", "listing-date|date-added|property-date", "first:"),),
    "fotocasa": (("", "class", "re-Card-date|publicationDate|date", "first:"),),
    "": (),
}
ALWAYS_TODAY = "lucasfox"
BODY_DATES = (
    r"(?i)publicad[oa]\s+(?:el\s+)?(\d{1,2}\s+de\s+[a-záéíóúñ]+(?:\s+de\s+\d{4})?)",
    r"(?i)(hace\s+\d+\s+(?:día|dia|semana|mes|año)s?)",
    r"(?i)(\d{1,2}\s+de\s+[a-záéíóúñ]+\s+(?:de\s+)?\d{4})",
    r"(\d{4}-\d{2}-\d{2})",
)


def posted_dates(pages: DataFrame, as_of: Column) -> DataFrame:
    """(page_id, url, posted) of pages (page_id, url, html): when a listing was published, as 'dd/MM/yyyy'.

    The portal's own rule comes first, then the first ``time`` element, then the forms of a date in the text. Of
    elements whose text says when, the outermost counts. Without any of these, without a page, and for one portal
    always, it is ``as_of``. A null URL is one of no portal. Repeated rows count each for itself; order and other columns do not matter.
    """
    from posada.functions.dates import listing_date

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = {portal: Plan(Rule(portal, (PAGE, "", ""), {"posted": ways + TIME})) for portal, ways in POSTED.items()}
        for part in batches:
            out = []
            for url, html in zip(part["url"], part["html"], strict=True):
                reader = CardReader(plans[next(portal for portal in plans if portal in (url or ""))])
                reader.read(html)
                page = reader.cards[0]
                said = page.got.get("posted", (0, None))[1]
                out.append((said, reader.whole if said is None else None))
            yield pd.concat([part[["page_id", "url"]].reset_index(drop=True), pd.DataFrame(out, columns=["said", "body"], dtype=object)], axis=1)

    kind = pages.schema["page_id"].dataType.simpleString()
    always = F.coalesce(F.contains("url", F.lit(ALWAYS_TODAY)), F.lit(False))
    some = pages.select("page_id", F.col("url").cast("string").alias("url"), F.when(~always, F.col("html").cast("string")).alias("html"))
    read = some.mapInPandas(run, f"page_id {kind}, url string, said string, body string")
    # A column of its own, so that the forms are searched once for all that the date is made of.
    dated = read.select("page_id", "url", F.coalesce(F.trim("said"), *(found(F.col("body"), p) for p in BODY_DATES), F.lit("")).alias("said"))
    return dated.select("page_id", "url", listing_date(F.col("said"), as_of).alias("posted"))


# The words after a count of reviews on a booking card.
REVIEW_COUNT = r"(?i)([\d.]+)\s*(?:coment|reseñ|review)"


def booking_quote(card_text: Column, shown: list[Column], name: Column, url: Column, match: Column | None = None) -> Column:
    """The quote struct of a booking card; ``match`` is how well it fits the licence."""
    from posada.functions.prices import amounts, first_number, picked, rating

    seen = amounts(card_text)
    return F.struct(
        F.lit("booking").alias("fuente"), name.alias("nombre"), picked([first_number(c) for c in shown], seen).alias("precio_noche"), seen.alias("precios_vistos"),
        rating(card_text).alias("rating"), first_number(found(card_text, REVIEW_COUNT)).alias("reviews"), url.alias("url"), (F.lit(None).cast("double") if match is None else match).alias("match"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("boolean").alias("sin_resultado"), F.lit(None).cast("int").alias("precio_sospechoso"),
    )


def travel_quote(text: Column, url: Column) -> Column:
    """The quote struct of a travel page's text."""
    from posada.functions.base import number
    from posada.functions.prices import reviewed, summary

    prices = summary(F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2,4})\s*€")), lambda x: number(x)))
    seen = reviewed(text)
    return F.struct(
        F.lit("google_travel").alias("fuente"), seen["rating"].alias("rating"), seen["reviews"].alias("reviews"), prices["typical"].alias("precio_tipico"),
        F.when(prices["least"].isNotNull(), F.array(prices["least"], prices["greatest"])).alias("rango"), url.alias("url"), F.lit(None).cast("string").alias("error"),
    )
