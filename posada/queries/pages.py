"""Queries of page extraction and of the JSON sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import model
from posada.sources import details, pages, store

from . import bind
from .functions import TRIM, unescaped

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def add(query):  # noqa: ANN001, ANN202
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


_text = TRIM(unescaped("regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))


@register("s10_visible_text", f"SELECT page_id, {_text} AS visible FROM pages")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "pages").select("page_id", pages.visible_text(c("html")).alias("visible"))


@register("s11_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=\"([^\"]*)\"', 1)) AS link FROM pages")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "pages").select("page_id", F.explode(pages.links(c("html"))).alias("link"))


@register("s12_meta_place", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE NULL END AS place FROM part")
def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda n, v: F.concat(F.lit(f'<meta property="{n}" content="'), v, F.lit('">'))
    html = F.concat(tag("og:locality", bind.by_remainder("p_partkey", c("p_brand"), F.lit("España"), F.lit(""))), tag("geo.placename", bind.by_remainder("p_partkey", F.lit("x"), c("p_type"), F.lit("Spain"))))
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", pages.meta_place(html).alias("place"))


@register("s13_crumbs", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS last, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS before_last FROM part")
def crumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = F.when(c("p_partkey") % 2 == 0, F.array(F.lit("Inicio"), c("p_type"), F.lit("Hoteles"))).otherwise(F.array(F.lit("España"), c("p_brand"), F.lit("home")))
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", pages.last_crumb(trail).alias("last"), pages.crumb_before_last(trail).alias("before_last"))


@register("s14_page_status", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'no_result' WHEN 2 THEN 'consent' ELSE 'ok' END AS status FROM part")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(bind.by_remainder("p_partkey", F.lit("Enable JavaScript, no Robot "), F.lit("No se han encontrado "), F.lit("Before you continue "), F.lit("x ")), c("p_name"))
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", pages.page_status(html, pages.visible_text(html)).alias("status"))


@register("s6_json_ld_items", "SELECT p_partkey AS page_id, 'https://x.example/' || p_partkey::VARCHAR AS url, p_name AS name, p_type AS description FROM part")
def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://x.example/"), c("p_partkey").cast("string"), F.lit("/?a=b"))
    item = F.to_json(F.struct(F.struct(F.when(c("p_partkey") % 2 == 0, url).alias("url"), url.alias("@id"), c("p_name").alias("name"), c("p_type").alias("description")).alias("item")))
    one = F.concat(F.lit('{"@type":"ItemList","itemListElement":['), item, F.lit("]}"))
    body = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit('[{"@type":"Other"},'), one, F.lit("]"))).otherwise(one)
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">'), body, F.lit("</script></html>")).alias("html"))
    return pages.json_ld_items(made).select("page_id", "url", "name", "description")


@register("s7_app_state_items", "SELECT p_partkey AS page_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS price, p_type AS location FROM part")
def app_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit('{"value":'), c("p_size").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('"'), c("p_brand"), F.lit('"')))
    item = F.concat(F.lit('{"title":"'), c("p_name"), F.lit('","price":'), price, F.lit(',"address":{"province":"'), c("p_type"), F.lit('"}}'))
    listed = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit('"initialProps":{"listings":['), item, F.lit("]}"))).when(c("p_partkey") % 3 == 1, F.concat(F.lit('"listings":['), item, F.lit("]"))).otherwise(F.concat(F.lit('"result":{"items":['), item, F.lit("]}")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{'), listed, F.lit("}}}</script>"))
    return pages.app_state_items(bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "title", "price", "location")


_BLANKS = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_first_p = f"trim(regexp_replace({unescaped("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')", beginnings=True)}, '{_BLANKS}', ' ', 'g'))"


@register("s8_extract_plain", f"SELECT page_id, {_first_p} AS title, 'Precio a consultar' AS price FROM pages")
def extract_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bind.table(spark, sf_dir, "pages").withColumn("source", F.lit("plain"))
    return pages.extract_listings(made).select("page_id", "title", "price")


@register(
    "s8_extract_portals",
    "SELECT p_partkey AS page_id, 'https://www.idealista.com/inmueble/' || p_partkey::VARCHAR || '/' AS url, 'Local en ' || p_name || ', Ronda, ' || p_brand AS title, p_size::VARCHAR || '.000 €' AS price, p_brand AS location, 'Idealista' AS source FROM part WHERE p_partkey % 4 = 0 "
    "UNION ALL SELECT p_partkey, 'https://x.example/es/p' || p_partkey::VARCHAR || '/hotel-for-sale-costa-azul', p_name, 'Desde' || p_size::VARCHAR || '.000 €', 'Costa Azul', 'LuxuryEstate' FROM part WHERE p_partkey % 4 = 1 "
    "UNION ALL SELECT p_partkey, 'https://x.example/n', p_name, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || '.000 €' ELSE 'Precio a consultar' END, p_type, 'NegociosEnVenta' FROM part WHERE p_partkey % 4 = 2 AND length(p_name) >= 5 "
    "UNION ALL SELECT p_partkey, 'https://x.example/page', 'Hotel ' || p_name, 'Precio a consultar', p_type, 'HotelSeVende' FROM part WHERE p_partkey % 4 = 3",
)
def extract_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name, size, brand, kind = c("p_partkey").cast("string"), c("p_name"), c("p_size").cast("string"), c("p_brand"), c("p_type")
    title = _say("Local en ", name, ", Ronda, ", brand)
    one = _say('<div><article data-element-id="', key, '"><a href="/x" title="', title, '">x</a><span class="item-price">', size, ".000 <i>€</i></span></article></div>")
    two = _say('<ul><li class="search-list__item"><a href="https://x.example/es/p', key, '/hotel-for-sale-costa-azul"><b>', name, '</b></a><div class="the-price">Desde € ', size, ".000</div></li><li>x</li></ul>")
    price = F.when(c("p_size") % 2 == 0, _say(size, ".000 €")).otherwise("1€")
    three = _say('<div><span class="numPrice">', price, '</span><div><div><h2 class="listviewtitle"><a href="https://x.example/n">', name, '</a></h2><span class="textintro">', kind, "</span></div></div></div>")
    four = _say("<body><h1>Hotel ", name, "</h1><p>€1</p><ul><li><strong>", kind, "</strong></li><li>Ciudad</li></ul></body>")
    by = lambda *values: bind.by_remainder("p_partkey", *values)
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), F.lit("https://x.example/page").alias("url"), by(one, two, three, four).alias("html"), by(*map(F.lit, ("Idealista", "LuxuryEstate", "NegociosEnVenta", "HotelSeVende"))).alias("source"))
    return pages.extract_listings(made).select("page_id", "url", "title", "price", "location", "source")


@register(
    "s8_extract_more",
    "SELECT p_partkey AS page_id, 'Finca ' || p_name AS title, p_size::VARCHAR || '.500 €' AS price, CASE WHEN p_partkey % 2 = 0 THEN 'Ciutadella, ' || p_brand ELSE 'Costa Brava' END AS location, "
    "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'About ' || p_type END AS description, CASE WHEN p_partkey % 2 = 0 THEN 'Engel & Völkers' ELSE 'Oi Real Estate' END AS source FROM part",
)
def extract_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place out of a card's first lines, and one out of the URL."""
    name, size, even = c("p_name"), c("p_size").cast("string"), c("p_partkey") % 2 == 0
    one = _say('<article><a href="/es/es/exposes/1"><img alt="Finca ', name, '"></a>\n<p>Nuevo</p>\n<p>Ciutadella, ', c("p_brand"), ", España</p>\n<p>", size, ".500 €</p></article>")
    two = _say("<body><h1>Finca ", name, '</h1><b>', size, '.500 €</b><div class="desc">About ', c("p_type"), "</div></body>")
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(
        c("p_partkey").alias("page_id"), F.lit("https://x.example/propiedad/7/finca-en-venta-en-costa-brava").alias("url"), F.when(even, one).otherwise(two).alias("html"), F.when(even, "Engel & Völkers").otherwise("Oi Real Estate").alias("source")
    )
    return pages.extract_listings(made).select("page_id", "title", "price", "location", "description", "source")


@register(
    "s8_extract_others",
    "SELECT p_partkey AS page_id, '/comprar-vivienda/espana/x' || p_partkey::VARCHAR || '.html' AS url, 'Casa ' || p_name AS title, p_size::VARCHAR || '.000 €' AS price, p_brand AS location, 'Lucas Fox' AS source FROM part WHERE p_partkey % 4 = 0 "
    "UNION ALL SELECT p_partkey, 'https://www.kyero.com/es/property/' || p_partkey::VARCHAR, 'Hotel ' || p_name || ' en ' || p_brand, '€' || p_size::VARCHAR || '.000', p_brand, 'Kyero' FROM part WHERE p_partkey % 4 = 1 "
    "UNION ALL SELECT p_partkey, 'https://www.fotocasa.es/es/hotel/' || p_partkey::VARCHAR, 'Hotel ' || p_name, p_size::VARCHAR || '.000 €', p_brand, 'Fotocasa' FROM part WHERE p_partkey % 4 = 2 "
    "UNION ALL SELECT p_partkey, 'https://www.habitaclia.com/h' || p_partkey::VARCHAR || '.htm', 'Finca grande ' || p_name, 'Precio a consultar', p_brand, 'Habitaclia' FROM part WHERE p_partkey % 4 = 3",
)
def extract_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices beside a card, places in titles, titles that are not about hotels, and cards by their second kind of element."""
    key, name, size, brand = c("p_partkey").cast("string"), c("p_name"), c("p_size").cast("string"), c("p_brand")
    one = _say('<ul><li><a href="/comprar-vivienda/espana/x', key, '.html">x</a><h3 class="the-title">Casa ', name, '</h3><p class="price">Desde ', size, '.000 €</p><span class="area">', brand, "</span></li><li>x</li></ul>")
    two = _say('<div><a href="/es/property/', key, '?x=1"><img alt="Hotel ', name, " en ", brand, ' - foto 1"></a><b>€ ', size, '.000</b></div><div><a href="/es/property/0"><img alt="Piso ', name, '"></a></div>')
    card = lambda kind: _say('<div class="re-Card"><a href="/es/hotel/', key, '?a=1">x</a><h3 class="re-Card-title">', kind, " ", name, '</h3><i class="re-Card-price">', size, '.000 €</i><i class="re-Card-location">', brand, "</i></div>")
    three = F.concat(card("Hotel"), card("Piso"))
    four = _say('<div class="list-item"><h3>Finca grande ', name, '</h3><i class="zona">', brand, '</i><a href="h', key, '.htm?b=2">x</a></div>')
    by = lambda *values: bind.by_remainder("p_partkey", *values)
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), F.lit("https://x.example/page").alias("url"), by(one, two, three, four).alias("html"), by(*map(F.lit, ("Lucas Fox", "Kyero", "Fotocasa", "Habitaclia"))).alias("source"))
    return pages.extract_listings(made).select("page_id", "url", "title", "price", "location", "source")


@register("s9_detail_patch", "SELECT p_partkey AS page_id, CASE WHEN p_size BETWEEN 1 AND 500 THEN p_size END AS rooms, CASE WHEN p_partkey BETWEEN 20 AND 100000 THEN p_partkey::INT END AS m2, p_brand AS location_city FROM part")
def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<head><meta name="city" content="'), c("p_brand"), F.lit('"></head><ul><li><b>Habitaciones</b>: '), c("p_size").cast("string"), F.lit("</li><li>"), c("p_partkey").cast("string"), F.lit(" m²</li></ul>"))
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    return pages.detail_patch(made).select("page_id", "rooms", "m2", "location_city")


@register("s9_posted_date", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(DATE '2024-05-31' - (o_orderkey % 20)::INT, '%d/%m/%Y') ELSE '31/05/2024' END AS posted FROM orders")
def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = bind.by_remainder(
        "o_orderkey", F.concat(F.lit('<p>x</p><time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T10:00">hoy</time>')), F.concat(F.lit("<p>Publicado hace "), (c("o_orderkey") % 20).cast("string"), F.lit(" <b>días</b></p>")), F.lit("<p>nada</p>")
    )
    made = bind.dealt(spark, sf_dir, "orders", "o_orderkey").select(c("o_orderkey").alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    return pages.posted_dates(made, F.lit(bind.AS_OF).cast("date")).select(c("page_id").alias("o_orderkey"), "posted")


@register(
    "s9_posted_by_portal",
    "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN strftime(DATE '2024-05-31' - 7 * (1 + o_orderkey % 5)::INT, '%d/%m/%Y') WHEN 6 THEN '31/05/2024' "
    "WHEN 7 THEN strftime(o_orderdate, '%d') || '/05/' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS posted FROM orders",
)
def posted_by_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a page was published, by its portal's own signs, with a time element that tells something else beside them."""
    day, iso = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    other = '<time datetime="2001-01-01">x</time>'
    html = bind.by_remainder(
        "o_orderkey", _say(other, "<ul><li>2 rooms</li></ul><p>Anuncio <b>publicado el ", day, "</b></p>"), _say(other, "<p>publicado hoy</p><i data-date='", iso, "'></i>"), _say(other, "<span>Listed: ", day, "</span>"),
        _say(other, "<b class='x listing-date'>", day, "</b>"), _say(other, "<i class=re-Card-date>Hace ", (c("o_orderkey") % 5 + 1).cast("string"), " semanas</i>"), _say("<script>2001-01-01</script><p>2001-01-01</p><time>", day, "</time>"),
        _say("<time datetime='", iso, "'>x</time>"), _say("<p>2001-01-01</p><p>Publicada el ", F.date_format("o_orderdate", "d"), " <b>de mayo</b> de ", F.date_format("o_orderdate", "yyyy"), "</p>"),
    )
    site = bind.by_remainder("o_orderkey", *map(F.lit, ("idealista", "idealista", "thinkspain", "kyero", "fotocasa", "other", "lucasfox", "other")))
    made = bind.dealt(spark, sf_dir, "orders", "o_orderkey").select(c("o_orderkey").alias("page_id"), _say("https://www.", site, ".example/1").alias("url"), html.alias("html"))
    return pages.posted_dates(made, F.lit(bind.AS_OF).cast("date")).select(c("page_id").alias("o_orderkey"), "posted")


@register("s3_licence_records", "SELECT c_custkey::VARCHAR AS n_reg, c_name AS nombre FROM customer UNION ALL SELECT c_custkey::VARCHAR || 'b', 'b' FROM customer WHERE c_custkey % 4 = 2")
def licence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit('{"n_reg":"'), c("c_custkey").cast("string"), F.lit('","nombre":"'), c("c_name"), F.lit('"}'))
    other = F.concat(F.lit('{"n_reg":"'), c("c_custkey").cast("string"), F.lit('b","nombre":"b"}'))
    root = bind.by_remainder("c_custkey", F.concat(F.lit("["), record, F.lit("]")), F.concat(F.lit('{"x":1,"data":['), record, F.lit('],"results":[]}')), F.concat(F.lit('{"a":['), record, F.lit('],"b":'), other, F.lit("}")), F.concat(F.lit('{"a":'), record, F.lit(',"n":3}')))
    found = store.licence_records(bind.table(spark, sf_dir, "customer").select(root.alias("value")))
    return store.licence_fields(found, ["n_reg", "nombre"]).select("n_reg", "nombre")


@register("k4_json_validity", "SELECT event_id, event_id % 3 <> 0 AS valid FROM events")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("event_id") % 3 == 0, F.concat(F.lit("{"), c("props"))).otherwise(c("props"))
    return bind.table(spark, sf_dir, "events").select("event_id", store.is_valid_json(text).alias("valid"))


def _say(*parts):  # noqa: ANN002, ANN202
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _parts_as_pages(spark: SparkSession, sf_dir: str, source: str, html, title=None, url=None, location=None) -> DataFrame:  # noqa: ANN001
    none = F.lit(None).cast("string")
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select(
        c("p_partkey").alias("page_id"), (F.lit("https://x.example/1") if url is None else url).alias("url"), html.alias("html"), F.lit(source).alias("source"),
        (none if title is None else title).alias("title"), (none if location is None else location).alias("location"),
    )


_in = lambda e, low, high: f"CASE WHEN {e} BETWEEN {low} AND {high} THEN ({e})::INT END"


@register(
    "s9_luxury_listing",
    "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_size::INT ELSE (p_size + 1)::INT END AS rooms, (p_size * 2)::INT AS beds, (p_size * 1000 + 5)::INT AS m2, (p_size % 4)::INT AS bathrooms, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS location, "
    "'About ' || p_brand || '   x' AS text FROM part",
)
def luxury_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first visit: labels in order of preference, the place from the heading or else from the crumbs, a tilde as a blank."""
    size = c("p_size").cast("string")
    heading = F.when(c("p_partkey") % 3 == 0, "Hotel de lujo").otherwise(_say("Hotel de lujo en venta ", c("p_name"), ", España"))
    rooms = F.when(c("p_partkey") % 2 == 0, _say("Bedrooms: 77 Dormitorios: ", size)).otherwise(_say("Estancias: ", (c("p_size") + 1).cast("string"), " Rooms: 9"))
    html = _say(
        "<body><h1>", heading, '</h1><nav aria-label="breadcrumb"><a>Inicio</a><a>', c("p_type"), "</a><a>España</a></nav><div class='the-description'>About ", c("p_brand"), " ~ x</div><p>", rooms, "</p><p>Camas: ",
        (c("p_size") * 2).cast("string"), " Superficie: ", size, ".005 m2 Baños: ", (c("p_size") % 4).cast("string"), "</p></body>",
    )
    return details.details(_parts_as_pages(spark, sf_dir, "LuxuryEstate", html), details.FIRST).select("page_id", "rooms", "beds", "m2", "bathrooms", "location", "text")


@register(
    "s9_luxury_again",
    f"SELECT p_partkey AS page_id, {_in('p_size * 11', 1, 500)} AS rooms, (p_size)::INT AS beds, {_in('p_partkey', 20, 100000)} AS m2, CASE WHEN p_size % 10 BETWEEN 1 AND 5 THEN (p_size % 10)::INT END AS stars, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Costa Azul' END AS location_city FROM part",
)
def luxury_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later pass: numbers near their words within likely bounds, the place from meta tags or else from the URL."""
    meta = F.when(c("p_partkey") % 2 == 0, _say('<meta property="og:locality" content="', c("p_brand"), '">')).otherwise("")
    html = _say(
        meta, "<ul><li>Dormitorios y más: <b>", (c("p_size") * 11).cast("string"), "</b></li></ul><p>", c("p_size").cast("string"), " camas</p><p>a pie de playa y campo</p><p>", c("p_partkey").cast("string"), " m²</p><p>", (c("p_size") % 10).cast("string"), " estrellas</p>",
    )
    made = _parts_as_pages(spark, sf_dir, "LuxuryEstate", html, url=F.lit("https://x.example/es/p1-hotel-for-sale-costa-azul"))
    return details.details(made).select("page_id", "rooms", "beds", "m2", "stars", "location_city")


@register(
    "s9_think",
    "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_size::INT ELSE 12 END AS rooms, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'San Pedro' ELSE 'Aguadulce' END AS location_city, "
    "CASE WHEN p_partkey % 3 = 1 THEN 'San Pedro' WHEN p_partkey % 3 = 2 THEN 'Aguadulce Almeria' END AS region_hint, 250 AS m2 FROM part",
)
def think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms and the place from the title, a province in brackets as a hint; the country is no place."""
    rooms = F.when(c("p_partkey") % 2 == 0, _say(c("p_size").cast("string"), " bedroom Hotel")).otherwise("Hotel")
    title = _say(rooms, " en venta in ", bind.by_remainder("p_partkey", F.lit("Spain"), F.lit("san pedro with pool"), F.lit("Aguadulce (Almeria) - € 490,000")))
    html = F.lit("<p>x</p><ul class='features'><li>12 habitaciones</li><li>250 m2</li></ul><p>30 habitaciones</p>")
    out = details.details(_parts_as_pages(spark, sf_dir, "ThinkSpain", html, title=title))
    return out.select("page_id", "rooms", "location_city", F.when(c("location_city").isNotNull(), c("region_hint")).alias("region_hint"), "m2")


@register("s9_idealista", "SELECT p_partkey AS page_id, p_size::INT AS rooms, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS location_city, CASE WHEN p_partkey % 2 = 0 THEN 'Hoteles ' || p_type || ' ' || p_brand END AS region_hint FROM part")
def idealista(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place is the last crumb but one; a single crumb is none."""
    more = F.when(c("p_partkey") % 2 == 0, _say("<li>", c("p_type"), "</li><li>", c("p_brand"), "</li>")).otherwise("")
    html = _say("<ul class='breadcrumb-list'><li>Hoteles</li>", more, "</ul><p>", c("p_size").cast("string"), " hab.</p>")
    return details.details(_parts_as_pages(spark, sf_dir, "Idealista", html)).select("page_id", "rooms", "location_city", "region_hint")


@register("s9_generic", "SELECT p_partkey AS page_id, p_size::INT AS rooms, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS location_city, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS region_hint FROM part")
def generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta tags give the place, but not the country; else the listing's own place hints at the region."""
    city = F.when(c("p_partkey") % 2 == 0, c("p_brand")).otherwise("Spain")
    html = _say('<meta name="city" content="', city, '"><p>', c("p_size").cast("string"), " rooms</p>")
    return details.details(_parts_as_pages(spark, sf_dir, "HotelSeVende", html, location=c("p_type"))).select("page_id", "rooms", "location_city", "region_hint")


@register(
    "s8_think_list",
    "SELECT p_partkey AS page_id, 'https://x.example/' || p_partkey::VARCHAR AS url, p_size::VARCHAR || ',000 €' AS price, 'Hotel en venta in ' || p_brand AS title, p_brand AS location, p_type AS description, 'ThinkSpain' AS source FROM part",
)
def think_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portal's list from JSON-LD, with title, price and place out of the item's name."""
    name = _say("€ ", c("p_size").cast("string"), ",000 Hotel for sale in ", c("p_brand"), " (Ref: 7)")
    item = F.to_json(F.struct(F.struct(_say("https://x.example/", c("p_partkey").cast("string"), "/?a=b").alias("url"), name.alias("name"), _say("<b>", c("p_type"), "</b>").alias("description")).alias("item")))
    html = _say('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[', item, "]}</script>")
    return pages.think_listings(bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "url", "price", "title", "location", "description", "source")


@register(
    "s8_regex_cards",
    "SELECT p_partkey AS page_id, 0 AS pos, 'https://x.example/es/un-hotel-' || p_partkey::VARCHAR AS url, 'Hotel ' || p_name AS title, p_size::VARCHAR || '.000 €' AS price, p_type AS location FROM part "
    "UNION ALL SELECT p_partkey, 1, 'https://x.example/list', 'Hotel ' || p_brand, 'Precio a consultar', 'España' FROM part",
)
def regex_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by patterns alone: no markup is parsed, no Python runs. Cards that are not about hotels or have no title go."""
    key = c("p_partkey").cast("string")
    one = _say('<article class="property-card"><a href="/es/un-hotel-', key, '"><h2>Hotel ', c("p_name"), "</h2></a><b>", c("p_size").cast("string"), ".000 €</b><span class='location'> ", c("p_type"), " </span></article>")
    html = _say("<div>", one, '<div class="result"><h3>Hotel ', c("p_brand"), '</h3></div><div class="card"><h3>Garage of ', c("p_brand"), '</h3></div><div class="card">hotel</div></div>')
    made = bind.dealt(spark, sf_dir, "part", "p_partkey").select(c("p_partkey").alias("page_id"), F.lit("https://x.example/list").alias("url"), html.alias("html"))
    return pages.regex_cards(made, "https://x.example").select("page_id", "pos", "url", "title", "price", "location")


@register("s9_booking_card", "SELECT p_partkey, (p_size + 20)::INT AS price, [(p_size + 20)::INT, 4000] AS seen, 8.5::DOUBLE AS rating, 1234 AS reviews, (CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.35 END)::DOUBLE AS match FROM part")
def booking_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from a booking card: prices, rating, reviews, and how well the name fits the registered one."""
    even, none = c("p_partkey") % 2 == 0, F.lit(None).cast("string")
    text = _say("Hotel Sol, ", F.when(even, "Marbella").otherwise("Ronda"), " 8,5 Fabuloso 1.234 comentarios € ", (c("p_size") + 20).cast("string"), " 4.000 €")
    match = model.match_score(F.when(even, 1.0).otherwise(0.5), F.lit("Marbella"), none, text)
    quote = pages.booking_quote(text, [_say("€ ", (c("p_size") + 20).cast("string"))], F.lit("Hotel Sol"), F.lit("u"), match)
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", quote.alias("q")).select("p_partkey", c("q.precio_noche").alias("price"), c("q.precios_vistos").alias("seen"), "q.rating", "q.reviews", "q.match")


@register("s9_travel_page", "SELECT p_partkey, 4.5::DOUBLE AS rating, p_size::INT AS reviews, (p_size + 100)::INT AS typical, [(p_size + 50)::INT, (p_size + 100)::INT] AS span FROM part")
def travel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from a travel page's text."""
    text = _say("Hotel Sol 4,5 (", c("p_size").cast("string"), " reseñas) ", (c("p_size") + 50).cast("string"), " € ", (c("p_size") + 100).cast("string"), " € 9 €")
    return bind.dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", pages.travel_quote(text, F.lit("u")).alias("q")).select("p_partkey", "q.rating", "q.reviews", c("q.precio_tipico").alias("typical"), c("q.rango").alias("span"))
