"""What the detail page of a listing tells, by portal.

The parts of a page that nested markup hides (its heading, description, crumbs and feature lists) are read by one
distributed job; all else is column expressions on those parts and on the visible text. A portal's ``Detail``
says which numbers it looks for and where it looks for the place; ``details`` picks it by the listing's source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.functions.attributes import from_text
from posada.functions.base import found, number, present, within

from .events import Element, Reader
from .pages import PLACE_METAS, crumb_before_last, last_crumb, meta_place, meta_value, visible_text

# The classes that mark a page's parts.
CRUMB_CLASSES, FEATURE_CLASSES = "breadcrumb|location", "feature|detail|spec|propert|info|characteristic|bedroom|bathroom"
DESCRIPTION_CLASSES, BODY_CLASSES = "description|descrip", "text|content|body"
PARTS = "heading string, description string, crumbs array<string>, features string"


#: Elements that a crumb can be.
CRUMB_TAGS = ("a", "li", "span")
CRUMBS, FEATURES, ABOUT, BODY, BREAD = (regex.compile(p, regex.I) for p in (CRUMB_CLASSES, FEATURE_CLASSES, DESCRIPTION_CLASSES, BODY_CLASSES, "bread"))


class PartsReader(Reader):
    """The parts of a detail page in one pass: the first element of each role, and all feature lists. Text is kept while one of them is open."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: dict[str, str | None] = {}
        self.crumbs: dict[str, list[str]] = {"trail": [], "trail by class": []}
        self.lists: dict[int, str] = {}
        self.wanted = self.crumb_tags = 0
        self.trails: set[str] = set()  # those open

    def opened(self, x: Element) -> None:
        classes = x.attrs.get("class", "")
        ways = (
            ("heading", x.tag == "h1"), ("about", ABOUT.search(classes)), ("body", x.tag == "div" and BODY.search(classes)),
            ("trail", x.tag == "nav" and BREAD.search(x.attrs.get("aria-label", ""))), ("trail by class", CRUMBS.search(classes)),
        )
        x.roles = [role for role, fits in ways if fits and role not in self.seen]
        self.seen.update(dict.fromkeys(x.roles))
        self.trails.update(role for role in x.roles if role in self.crumbs)
        if x.tag in ("ul", "div", "table") and FEATURES.search(classes):
            self.lists[x.number] = ""
            x.roles.append("list")
        if x.tag in CRUMB_TAGS:
            self.crumb_tags += 1
            x.inner = self.crumb_tags
        self.wanted += bool(x.roles)
        self.keeps = self.wanted > 0

    def closed(self, x: Element) -> None:
        if self.trails and x.inner and x.inner == self.crumb_tags and (text := self.text(x)):
            for role in self.trails:
                self.crumbs[role].append(text)
        for role in x.roles or ():
            if role == "list":
                self.lists[x.number] = self.text(x)
            elif role in self.crumbs:
                self.trails.discard(role)
            else:
                self.seen[role] = self.text(x)
        self.wanted -= bool(x.roles)
        if not self.wanted:
            self.keeps = False
            self.pieces.clear()


def read_parts(html: str | None) -> tuple[str | None, str | None, list[str], str]:
    """(heading, description, crumbs, features) of a page."""
    reader = PartsReader()
    reader.read(html)
    about = reader.seen.get("about") if "about" in reader.seen else reader.seen.get("body")
    crumbs = reader.crumbs["trail" if "trail" in reader.seen else "trail by class"]
    return reader.seen.get("heading"), about, crumbs, " ".join(reader.lists.values())


def parts(pages: DataFrame) -> DataFrame:
    """The rows (page_id, url, html, and others) with heading, description, crumbs and features; null or empty where a page lacks them."""
    names = [c for c in pages.columns if c not in ("heading", "description", "crumbs", "features")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame([read_parts(x) for x in part["html"]], columns=["heading", "description", "crumbs", "features"], dtype=object)], axis=1)

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.select(*names).mapInPandas(run, f"{kinds}, {PARTS}")


def after_label(text: Column, labels: tuple[str, ...], gap: str) -> list[Column]:
    """The number after each label, labels in order."""
    return [number(found(text, f"(?i)(?:{label}){gap}([0-9]{{1,9}})")) for label in labels]


def before_label(text: Column, labels: tuple[str, ...]) -> list[Column]:
    return [number(found(text, rf"(?i)([0-9]{{1,9}})\s*(?:{'|'.join(labels)})"))]


def area(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first area that a pattern finds, with points for thousands and a decimal comma."""
    values = [F.floor(F.replace(F.replace(found(text, p), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")).try_cast("int") for p in patterns]
    return F.coalesce(*values)


# The words that name an attribute on a page.
ROOMS, BEDS, BATHS = ("dormitorios?", "habitaciones?", "bedrooms?", "rooms?"), ("camas?", "beds?"), ("ba[ñn]os?",)
TITLE_ROOMS = ("habitaciones?", "bedrooms?", "rooms?", r"habs?\b")
LISTED_ROOMS = ("dormitorios", "habitaciones", "estancias", "rooms?", "bedrooms?")
AREAS = (r"(?i)([0-9][0-9.,]*)\s*m[²2]", r"(?i)superficie[\s:]*([0-9][0-9.,]*)")
LISTED_AREAS = (r"(?i)superficie[:\s]+([0-9.,]+)\s*m", r"(?i)([0-9.,]+)\s*m[²2](?![\p{L}\p{N}_])")
STARS, ANY_STARS = r"(?i)([0-9])\s*estrellas?", r"(?i)([0-9])\s*(?:estrellas?|stars?|\*)"
SLUG, IN_TITLE = "hotel-for-sale-(.+)$", r"(?i)en venta\s+([^,]+)"
CITY_IN_TITLE = r"(?i)(?<![\p{L}\p{N}_])in\s+(\p{L}[\p{L}\s-]{1,40}?)\s*(?:\(([^)]*)\)\s*)?(?:with(?![\p{L}\p{N}_])|\(|-\s*[€â]|$)"


FIELDS = ("rooms", "beds", "m2", "bathrooms", "stars", "location", "location_city", "region_hint", "title", "text")


def slug_place(url: Column) -> Column:
    """The place that a URL ends with."""
    return present(F.initcap(F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), SLUG, 1), F.lit("-"), F.lit(" "))))


def _listed(seen: Column) -> dict[str, Column]:
    """Numbers by their labels as a list of details has them."""
    return {
        "rooms": F.coalesce(*after_label(seen, LISTED_ROOMS, r"[:\s]+")), "beds": F.coalesce(*after_label(seen, BEDS, r"[:\s]+")), "m2": area(seen, LISTED_AREAS),
        "bathrooms": F.coalesce(*after_label(seen, BATHS, r"[:\s]+")), "stars": number(found(seen, STARS)),
    }


def _anywhere(seen: Column) -> dict[str, Column]:
    """Numbers near their words, within what is likely."""
    one = lambda words, gap, most: F.coalesce(*(within(x, 1, most) for x in [*after_label(seen, ("|".join(words),), rf"\D{{0,{gap}}}"), *before_label(seen, words)]))
    areas = [within(area(seen, (p,)), 20, 100_000) for p in AREAS]
    return {"rooms": one(ROOMS, 15, 500), "beds": one(BEDS, 10, 1000), "m2": F.coalesce(*areas), "stars": within(number(found(seen, ANY_STARS)), 1, 5)}


def _plain(seen: Column) -> dict[str, Column]:
    x = from_text(seen)
    return {n: x[n] for n in ("rooms", "beds", "m2", "stars")}


def luxury_listing(p: dict[str, Column]) -> dict[str, Column]:
    """The page as the first visit reads it: labelled numbers; the place from the heading, else from the crumbs."""
    place = F.trim(found(p["heading"], IN_TITLE))
    return _listed(p["seen"]) | {"title": p["heading"], "location": F.coalesce(F.when(F.length(place) > 2, place), last_crumb(p["crumbs"])), "text": F.left(F.translate(p["description"], "~", " "), F.lit(1500))}


def luxury_again(p: dict[str, Column]) -> dict[str, Column]:
    """The page as a later pass reads it: numbers near their words; the place from meta tags, else from the URL."""
    city = F.coalesce(meta_value(p["html"], PLACE_METAS[0]), meta_value(p["html"], PLACE_METAS[2]), slug_place(p["url"]))
    return _anywhere(p["seen"]) | {"location_city": city, "region_hint": city}


def think(p: dict[str, Column]) -> dict[str, Column]:
    """Rooms and the place from the listing's own title, with a province in brackets as a hint; the rest from feature lists, then from the text."""
    title = F.coalesce(p["own_title"], F.lit(""))
    city = F.trim(F.regexp_replace(found(title, CITY_IN_TITLE), r"[\s-]+$", ""))
    city = F.when(~F.lower(city).isin("spain", "españa") & (city != ""), F.initcap(city))
    hint = F.when(city.isNotNull(), F.trim(F.concat_ws(" ", city, present(found(title, CITY_IN_TITLE, 2)))))
    both = F.concat_ws(" ", p["features"], p["seen"])
    plain = _plain(both)
    rooms = within(F.coalesce(*before_label(title, TITLE_ROOMS)), 1, 500)
    return plain | {"rooms": F.coalesce(rooms, plain["rooms"]), "location_city": city, "region_hint": F.coalesce(hint, F.left(both, F.lit(2000)))}


def idealista(p: dict[str, Column]) -> dict[str, Column]:
    """Numbers from the text; the place is the last crumb but one, and all crumbs hint at the region."""
    several = F.size(p["crumbs"]) >= 2
    return _plain(p["seen"]) | {"location_city": F.when(several, crumb_before_last(p["crumbs"])), "region_hint": F.when(several, F.array_join(p["crumbs"], " "))}


def generic(p: dict[str, Column]) -> dict[str, Column]:
    """Numbers from the text, the place from meta tags; without it the listing's own place hints at the region."""
    place = meta_place(p["html"])
    return _plain(p["seen"]) | {"location_city": place, "region_hint": F.coalesce(place, present(p["own_location"]))}


@dataclass(frozen=True)
class Detail:
    sources: tuple[str, ...]
    read: Callable[[dict[str, Column]], dict[str, Column]]


# The names of the portals.
LATER = (
    Detail(("ThinkSpain",), think),
    Detail(("LuxuryEstate",), luxury_again),
    Detail(("Idealista",), idealista),
    Detail(("HotelSeVende", "NegociosEnVenta", "Lucas Fox", "Engel & Völkers", "Oi Real Estate"), generic),
)
FIRST = (Detail(("LuxuryEstate",), luxury_listing),)


def details(pages: DataFrame, rules: tuple[Detail, ...] = LATER) -> DataFrame:
    """(page_id, url, source and FIELDS) of pages (page_id, url, html, source, title, location), title and location being the listing's own.

    Pages of sources that no rule names are dropped. What a rule does not look for is null. Joined with a gazetteer,
    ``region_hint`` gives the region.
    """
    some = pages.where(F.col("source").isin(*(s for r in rules for s in r.sources)))
    some = some.select("page_id", "url", "html", "source", F.col("title").alias("own_title"), F.col("location").alias("own_location"))
    rows = parts(some).withColumn("seen", visible_text(F.col("html")))
    p = {c: F.col(c) for c in rows.columns}
    kinds = dict.fromkeys(FIELDS[:5], "int")
    patch = None
    for rule in rules:
        values = rule.read(p)
        one = F.struct(*(values.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS))
        on = F.col("source").isin(*rule.sources)
        patch = F.when(on, one) if patch is None else patch.when(on, one)
    return rows.select("page_id", "url", "source", patch.alias("x")).select("page_id", "url", "source", "x.*")
