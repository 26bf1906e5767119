"""Queries of the scalar functions, over listings, licences, pages and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions import attributes, base, dates, places, prices, text

from . import bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def scalar(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str] | None, source: str = "listings", key: str = "ord") -> None:
    """Registers a query of columns computed row by row from a bound table."""
    tables = {"listings": (bind.listings, bind.LISTINGS), "licences": (bind.licences, bind.LICENCES)}
    read, cte = tables.get(source, (lambda s, d: bind.dealt(s, d, source, key) if source == "part" else bind.table(s, d, source), ""))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir).select(key, *(c.alias(n) for n, c in columns().items()))

    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = (f"WITH {cte} " if cte else "") + f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {source}"


c = F.col
TRIM = lambda e: f"trim(regexp_replace({e}, '[\\s\\x{{A0}}]+', ' ', 'g'))"
NOACC = lambda e: f"strip_accents({e})"


def cut(e: str, *patterns: str) -> str:
    for p in patterns:
        flags, p = ("gi", p[4:]) if p.startswith("(?i)") else ("g", p)
        e = f"regexp_replace({e}, '{p}', '', '{flags}')"
    return e


def hit(e: str, pattern: str, group: int = 1, flags: str = "") -> str:
    """The group of the first match, null where there is none."""
    more = f", '{flags}'" if flags else ""
    return f"CASE WHEN regexp_matches({e}, '{pattern}'{more}) THEN regexp_extract({e}, '{pattern}', {group}{more}) END"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapped(entries: dict[str, str]) -> str:
    return f"MAP([{', '.join(map(quoted, entries))}], [{', '.join(map(quoted, entries.values()))}])"


def unescaped(e: str, beginnings: bool = False) -> str:
    """Character references by the rule of ``text.unescape``: whole names only. With ``beginnings`` the parser's rule: else the longest name without a semicolon with which the run begins."""
    code = "CASE WHEN r[2] NOT IN ('x', 'X') THEN try_cast(substr(rtrim(r, ';'), 2, 12) AS BIGINT) WHEN length(rtrim(r, ';')) <= 12 THEN try_cast('0x' || substr(rtrim(r, ';'), 3) AS BIGINT) ELSE 1099511627776 END"
    nothing = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR (n & 65534) = 65534"
    sign = f"CASE WHEN n NOT BETWEEN 1 AND 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {nothing} THEN '' ELSE coalesce(map_extract_value({mapped(text.WINDOWS)}, n::VARCHAR), chr(n::INT)) END"
    bare = sorted((n for n in text.REFERENCES if not n.endswith(";")), key=lambda n: (-len(n), n))
    run = "regexp_extract(p, '^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?')"
    beginning = f"regexp_extract(p, '^(?:{'|'.join(bare)})')"
    named = f"map_extract_value({mapped(text.REFERENCES)}, r)"
    r = f"CASE WHEN {run} = '' OR {run}[1] = '#' OR {named.replace(', r)', f', {run})')} IS NOT NULL THEN {run} ELSE {beginning} END" if beginnings else run
    value = f"CASE WHEN r[1] = '#' THEN list_transform([{code}], lambda n: {sign})[1] ELSE {named} END"
    one = f"list_transform([{r}], lambda r: coalesce({value} || substr(p, length(r) + 1), '&' || p))[1]"
    return f"list_transform([string_split({e}, '&')], lambda w: w[1] || array_to_string(list_transform(w[2:], lambda p: {one}), ''))[1]"


_tags = lambda e: f"regexp_replace(coalesce({e}, ''), '<[^>]+>', ' ', 'g')"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_references = lambda: F.concat(F.lit("&Aacute;&#x20AC;&#8364;&#128;&amp;lt;&ntilde;"), c("p_name"), F.lit("&nosuch; &aacute &#xD800;&#"), (c("p_size") + 64).cast("string"), F.lit(" & &NotEqualTilde;&#7;&;"))
scalar("f1_references", lambda: {"plain": text.unescape(_references())}, {"plain": "'Á€€€&lt;ñ' || p_name || '&nosuch; á �' || chr(p_size + 64) || ' & ≂̸&;'"}, "part", "p_partkey")
scalar("f1_clean", lambda: {"cleaned": text.clean(c("html"))}, {"cleaned": TRIM(unescaped(_tags("html")))}, "pages", "page_id")
scalar("f2_clean_no_brackets", lambda: {"cleaned": text.clean_no_brackets(c("html"))}, {"cleaned": TRIM(f"translate({unescaped(_tags('html'))}, '<>', '')")}, "pages", "page_id")
scalar("f3_scrub", lambda: {"cleaned": text.scrub(c("html")), "title": text.scrub(F.regexp_extract("html", "<title>(.*?)</title>", 1))}, {"cleaned": TRIM(f"translate({_tags('html')}, '<>', '')"), "title": TRIM(f"translate({_tags(_TITLE)}, '<>', '')")}, "pages", "page_id")


def without_words(e: str, words: tuple[str, ...]) -> str:
    """RE2 has no look-around: words are split at blanks, which is the same once signs are gone."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"array_to_string(list_filter(string_split_regex({e}, '[\\s\\x{{A0}}]+'), lambda w: w <> '' AND NOT list_contains([{listed}], w)), ' ')"


_title = "regexp_replace(trim(lower(coalesce(title, ''))), '[^\\p{L}\\p{N}_\\s]', '', 'g')"
scalar(
    "f4_title_key",
    lambda: {"key": text.title_key(c("title")), "key_more": text.title_key(c("title"), more=True)},
    {"key": without_words(_title, text.TITLE_STOPWORDS), "key_more": without_words(_title, text.TITLE_STOPWORDS + text.MORE_TITLE_STOPWORDS)},
)
scalar("f5_place_key", lambda: {"key": text.place_key(c("description"))}, {"key": TRIM(f"regexp_replace(lower({NOACC('description')}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")})
scalar("f6_place_key_signs", lambda: {"key": text.place_key(c("description"), keep=",./")}, {"key": TRIM(f"regexp_replace(lower({NOACC('description')}), '[^\\p{{L}}\\p{{N}}_\\s,./]', ' ', 'g')")})
scalar("f7_folded_lower", lambda: {"key": text.folded_lower(c("title"))}, {"key": f"lower({NOACC('title')})"})
scalar("f8_name_key", lambda: {"key": text.name_key(c("denominacion"))}, {"key": "trim(regexp_replace(" + without_words("lower(denominacion)", text.NAME_STOPWORDS) + ", '[^a-z0-9 ]', ' ', 'g'))"}, "licences")

WITH, GARAGE, POOL, CITY = "(?i)\\s+with\\b.*", "(?i)\\bgarage\\b.*", "(?i)\\bpool\\b.*", "(?i)\\s+city\\b.*"


def head(e: str, pattern: str) -> str:
    return f"coalesce({hit(e, '^' + pattern)}, {e})"


_f9 = "trim(" + head(cut("location", "â[\\x{00}-\\x{ff}]{0,2}", "€.*", WITH, GARAGE, POOL, "\\s*-\\s*\\d.*", "\\s*/\\s*.+", CITY), "([^,]{3,40}),\\s*.{4,}") + ")"
scalar("f9_clean_place", lambda: {"place": places.clean_place(c("location")), "place_or_empty": places.clean_place_or_empty(c("location"))}, {"place": _f9, "place_or_empty": f"coalesce({_f9}, '')"})
LET = "A-Za-záéíóúñüÁÉÍÓÚÑÜ"
_f10 = "trim(" + head(cut("location", WITH, "\\s*-\\s*[â€¬\\d].*", "\\s*[â€¬]\\s*[\\d,. ]+.*", GARAGE, POOL, "â[\\x{82}¬].*", "\\s+$", "(?i)\\s*/\\s*[\\p{L}\\p{N}_]+\\s+city\\b"), f"([{LET}][^/]+?)\\s*/\\s*.+") + ")"
scalar("f10_clean_place_first_part", lambda: {"place": places.clean_place_first_part(c("location"))}, {"place": _f10})
_f11 = "trim(" + head(cut("location", WITH, GARAGE, POOL, "\\s*-\\s*(?:â|€|£|\\d).*", "â[\\x{80}-\\x{ff}].*", "€.*"), f"([{LET}][^/]{{2,30}}?)\\s*/\\s*.+") + ")"
_f11 = "trim(" + cut(_f11, "(?i)\\bcity\\b") + ")"
scalar("f11_clean_place_sterling", lambda: {"place": places.clean_place_sterling(c("location"))}, {"place": "trim(" + head(_f11, "([^,]{3,30}),\\s*.+") + ")"})
_f12 = "trim(" + head(cut("location", WITH, GARAGE, POOL, "\\s*-\\s*(?:â|€|£|\\d).*", "â[\\x{00}-\\x{ff}]*", "€.*", "(?i)\\s*\\bwith\\b.*"), f"([{LET}''\\s\\-]{{3,35}}?)\\s*/\\s*.+") + ")"
_f12 = cut(_f12, CITY, "(?i)\\s+ciudad\\b.*")
scalar("f12_clean_place_final", lambda: {"place": places.clean_place_final(c("location"))}, {"place": "trim(" + head(_f12, "([^,]{3,35}),\\s*.{3,}") + ")"})
_f13 = "trim(" + cut("location", WITH, "\\s*-\\s*[â€¬\\d].*", "\\s*[â€¬]\\s*[\\d,. ]+.*", "\\s*\\(.*?\\)") + ")"
#: Letters whose title case is not their upper case, or not one letter.
_TITLES = {c: c.title() for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and c.lower() == c and (c.title() != c.upper() or len(c.title()) > 1)}
_titled = lambda e: f"array_to_string(list_transform(regexp_extract_all(lower({e}), '(\\p{{L}}+|\\P{{L}}+)'), lambda p: coalesce(map_extract_value({mapped(_TITLES)}, p[1]), upper(p[1])) || p[2:]), '')"
scalar("f13_clean_place_titled", lambda: {"place": places.clean_place_titled(c("location"))}, {"place": f"CASE WHEN location IS NOT NULL THEN {_titled(_f13)} END"})

# F-14: each branch of the date grammar, chosen by the row's number.
_forms = ["hoy", "Yesterday", "hace {n} días", "hace {n} semanas", "{n} months ago", "hace {n} años", "2023-0{d}-1{d}", "{d}/{d}/2022", "{d} de marzo de 2021", "1{d} sep", "publicado", "hace {n} mes"]
_said = lambda: bind.by_remainder("doc_id", *(F.replace(F.replace(F.lit(f), F.lit("{n}"), (c("doc_id") % 30).cast("string")), F.lit("{d}"), (1 + c("doc_id") % 9).cast("string")) for f in _forms))
_d0 = f"DATE '{bind.AS_OF}'"
_n, _dd = "(doc_id % 30)", "(1 + doc_id % 9)"
_fmt = lambda e: f"strftime({e}, '%d/%m/%Y')"
_mon = lambda: f"(2024 * 12 + 4 - {_n})"
_months = f"'28/' || lpad(({_mon()} % 12 + 1)::VARCHAR, 2, '0') || '/' || ({_mon()} // 12)::VARCHAR"
_branches = [
    _fmt(_d0), _fmt(f"{_d0} - 1"), _fmt(f"{_d0} - {_n}::INT"), _fmt(f"{_d0} - ({_n} * 7)::INT"), _months, f"'31/05/' || (2024 - {_n})::VARCHAR",
    f"'1' || {_dd}::VARCHAR || '/0' || {_dd}::VARCHAR || '/2023'", f"'0' || {_dd}::VARCHAR || '/0' || {_dd}::VARCHAR || '/2022'", f"'0' || {_dd}::VARCHAR || '/03/2021'", f"'1' || {_dd}::VARCHAR || '/09/2024'", _fmt(_d0), _months,
]
scalar("f14_listing_date", lambda: {"date": dates.listing_date(_said(), F.lit(bind.AS_OF).cast("date"))}, {"date": "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(_branches)) + " END"}, "documents", "doc_id")

_name = lambda: F.concat(bind.by_remainder("ord", F.concat((c("rooms") + 1).cast("string"), F.lit("00.000 € ")), F.lit("€ 490,000 "), F.lit(""), F.lit("Hotel 250.000 € ")), F.lit("3 bedroom hotel for sale in "), F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" Hotel (Ref: 77)"))
_sql_name = "(CASE ord % 4 WHEN 0 THEN (rooms + 1)::VARCHAR || '00.000 € ' WHEN 1 THEN '€ 490,000 ' WHEN 2 THEN '' ELSE 'Hotel 250.000 € ' END || '3 bedroom hotel for sale in ' || split_part(title, ' ', 1) || ' Hotel (Ref: 77)')"
_t15 = f"regexp_replace(regexp_replace(trim({cut(f'trim({cut(f'trim({cut(_sql_name, '^\\d[\\d.,]*\\s*€\\s*')})', '^€\\s*\\d[\\d.,]*\\s*')})', '\\s*\\(Ref:.*?\\)', '\\s*-\\s*€.*')}), '\\bfor sale\\b', 'en venta', 'gi'), '(\\d+)\\s+bedroom\\s+', '\\1 habitaciones ', 'gi')"
scalar("f15_portal_title", lambda: {"title": places.portal_title(_name()), "place": places.portal_place(places.portal_title(_name()))}, {"title": f"trim({_t15})", "place": f"coalesce(trim(rtrim(trim({hit(_t15, '(?:en venta en|in)\\s+(.+?)(?:\\s+Hotel|\\s+Guesthouse|$)', 1, 'i')}), ',')), 'España')"})
_p16 = [hit(f"trim({_sql_name})", "^(\\d[\\d.,]+)\\s*€"), hit(_sql_name, "€\\s*(\\d[\\d.,]+)"), hit(_sql_name, "(\\d[\\d.,]+)\\s*€")]
scalar("f16_portal_price", lambda: {"price": prices.portal_price(_name())}, {"price": "coalesce(" + ", ".join(f"({p}) || ' €'" for p in _p16) + ", 'Precio a consultar')"})
scalar("f17_price_digits", lambda: {"digits": prices.digits(c("price"))}, {"digits": "regexp_replace(coalesce(price, ''), '[^0-9]', '', 'g')"})
_t18 = "(title || ' - â¬ ' || (1000 + ord)::VARCHAR || ',500')"
scalar("f18_price_in_title", lambda: {"price": F.when(prices.on_request(c("price")), prices.price_in_title(F.concat("title", F.lit(" - â¬ "), (1000 + c("ord")).cast("string"), F.lit(",500")))).otherwise(c("price"))}, {"price": "CASE WHEN contains(lower(price), 'consultar') THEN replace(format('{:,}', ((1000 + ord)::VARCHAR || '500')::BIGINT), ',', '.') || ' €' ELSE price END"})
scalar("f19_sign_last", lambda: {"price": prices.sign_last(c("price"))}, {"price": "regexp_replace(price, '^\\s*€\\s*(\\d[\\d.,]*)\\s*$', '\\1 €')"})
_slug = "lower(replace('https://x.example/hotel-for-sale-' || source || '-' || rooms::VARCHAR || 'a', ' ', ''))"
scalar("f20_place_from_slug", lambda: {"place": places.place_from_slug(F.lower(F.concat(F.lit("https://x.example/hotel-for-sale-"), "source", F.lit("-"), c("rooms").cast("string"), F.lit("a"))), r"hotel-for-sale-([a-z0-9-]+)")}, {"place": "upper(source[1]) || source[2:] || ' ' || rooms::VARCHAR || 'a'"})
scalar("f21_canonical_url", lambda: {"canonical": text.canonical_url(c("url"))}, {"canonical": "regexp_replace(split_part(trim(coalesce(url, '')), '?', 1), '/+$', '')"}, "pages", "page_id")
_t22 = "(CASE ord % 3 WHEN 0 THEN 'Hotel en venta en ' || source || ' - foto' WHEN 1 THEN 'Hotel, calle Mayor, ' || source ELSE title END)"
scalar(
    "f22_place_from_title",
    lambda: {"place": places.place_from_title(bind.by_remainder("ord", F.concat(F.lit("Hotel en venta en "), "source", F.lit(" - foto")), F.concat(F.lit("Hotel, calle Mayor, "), "source"), c("title")))},
    {"place": f"coalesce({hit(_t22, '^.*\\s(?:en|in)\\s+([^-]+?)\\s*(?:-.*)?$')}, trim({hit(_t22, '^.*,\\s*([^,]+)$')}))"},
)
_t23 = "('3 habitaciones Hotel en venta in ' || CASE ord % 4 WHEN 0 THEN 'aguadulce (Almeria)' WHEN 1 THEN 'CALA-MILLOR with pool' WHEN 2 THEN 'Spain' ELSE 'San pedro - € 3' END)"
scalar(
    "f23_city_in_title",
    lambda: {"city": places.city_in_title(F.concat(F.lit("3 habitaciones Hotel en venta in "), bind.by_remainder("ord", F.lit("aguadulce (Almeria)"), F.lit("CALA-MILLOR with pool"), F.lit("Spain"), F.lit("San pedro - € 3"))))},
    {"city": "CASE ord % 4 WHEN 0 THEN 'Aguadulce' WHEN 1 THEN 'Cala-Millor' WHEN 3 THEN 'San Pedro' END"},
)
scalar("f24_rooms_in_title", lambda: {"rooms": places.rooms_in_title(F.concat((c("ord") * 7).cast("string"), bind.by_remainder("ord", F.lit(" habs"), F.lit(" Bedroom "), F.lit(" x")), "title"))}, {"rooms": "CASE WHEN ord % 3 < 2 AND ord * 7 BETWEEN 1 AND 500 AND (ord % 3 = 1 OR regexp_matches(title, '^[^\\p{L}\\p{N}_]')) THEN (ord * 7)::INT END"})
_said25 = lambda: F.concat(c("n_chars").cast("string"), F.lit(" habitaciones, "), (c("n_chars") % 1500).cast("string"), F.lit(" camas, superficie: "), (c("doc_id") * 3).cast("string"), F.lit(",7 y hotel "), (c("doc_id") % 8).cast("string"), F.lit("*"))
scalar(
    "f25_from_text",
    lambda: {n: attributes.from_text(_said25())[n] for n in ("rooms", "beds", "m2", "stars")},
    {"rooms": "CASE WHEN n_chars BETWEEN 1 AND 500 THEN n_chars::INT END", "beds": "CASE WHEN n_chars % 1500 BETWEEN 1 AND 1000 THEN (n_chars % 1500)::INT END", "m2": "CASE WHEN doc_id * 3 BETWEEN 20 AND 99999 THEN (doc_id * 3)::INT END", "stars": "CASE WHEN doc_id % 8 BETWEEN 1 AND 5 THEN (doc_id % 8)::INT END"},
    "documents", "doc_id",
)
scalar(
    "f28_amounts",
    lambda: {"amounts": F.array_join(prices.amounts(F.concat(F.lit("desde € "), (c("n_chars") % 9000).cast("string"), F.lit(" o "), (c("doc_id") % 90).cast("string"), F.lit(" €, total 1.200 €"))), ",")},
    {"amounts": "array_to_string(list_sort(list_distinct(list_filter([n_chars % 9000, CASE WHEN doc_id % 90 > 9 THEN doc_id % 90 ELSE 0 END, 1200], lambda v: v BETWEEN 15 AND 5000))), ',')"},
    "documents", "doc_id",
)
scalar(
    "f29_number_parsers",
    lambda: {
        "amount": prices.first_number(F.concat(F.lit("unos "), c("n_chars").cast("string"), F.lit(".000 €"))),
        "of_ten": prices.rating(F.concat((c("doc_id") % 10).cast("string"), F.lit(",5 muy bien"))),
        "of_five": prices.rating(F.concat((c("doc_id") % 10).cast("string"), F.lit(".5")), 5),
        "stars": prices.stars(F.concat(F.lit("cat "), (c("doc_id") % 6).cast("string"))),
    },
    {"amount": "(n_chars * 1000)::INT", "of_ten": "doc_id % 10 + 0.5::DOUBLE", "of_five": "CASE WHEN doc_id % 10 BETWEEN 1 AND 5 THEN doc_id % 10 + 0.5::DOUBLE END", "stars": "(doc_id % 6)::INT"},
    "documents", "doc_id",
)
_alias = lambda *names: "coalesce(" + ", ".join(f"CASE WHEN {n} NOT IN ('', '—', '-') THEN {n} END" for n in names) + ")"
scalar("f30_alias_value", lambda: {"name": attributes.alias_value(c("nombre"), c("denominacion")), "reg": attributes.alias_value(c("n_reg"))}, {"name": _alias("nombre", "denominacion"), "reg": _alias("n_reg")}, "licences")
_by_kind = "CASE WHEN tipo = 'Casa rural' THEN 6 WHEN tipo = 'Pensión' THEN 12 WHEN tipo = 'Apartamentos' THEN 15 WHEN tipo = 'Albergue' THEN 18 WHEN tipo = 'Hotel' THEN 30 END"
ROOMS_SQL = f"coalesce(nullif(habitaciones::INT, 0), CASE WHEN plazas::INT <> 0 THEN greatest(1, round_even(plazas::INT / 1.9, 0)::INT) END, {_by_kind})"
scalar("f31_rooms_of_licence", lambda: {"rooms": attributes.rooms_of_licence(c("habitaciones"), c("plazas"), c("tipo"))}, {"rooms": ROOMS_SQL}, "licences")
scalar(
    "f32_street",
    lambda: {"street": places.street(bind.by_remainder("ord", F.concat(F.lit("Calle "), "localidad", F.lit(", 12 2ºA")), F.concat(F.lit("Avda. "), "localidad"), F.concat("localidad", F.lit(" 5"))))},
    {"street": "localidad"},
    "licences",
)
scalar("f37_query_day", lambda: {"checkin": dates.query_day(F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 400).cast("int"))).cast("string")}, {"checkin": "strftime((DATE '2024-01-01' + (doc_id % 400)::INT + 35) + ((10 - isodow(DATE '2024-01-01' + (doc_id % 400)::INT + 35)) % 7)::INT, '%Y-%m-%d')"}, "documents", "doc_id")
scalar("f39_joined_paragraphs", lambda: {"joined": text.joined_paragraphs(F.split("text", "\n"))}, {"joined": "left(array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(p) > 40), ' '), 1500)"}, "documents", "doc_id")

_low = "lower(coalesce(description, ''))"
_any = lambda words: "(" + " OR ".join(f"contains({_low}, '{w}')" for w in words) + ")"
scalar("p1_about_hotels", lambda: {"hotel": text.about_hotels(c("description")), "no_veto": text.about_hotels(c("description"), veto=False)}, {"hotel": f"{_any(text.HOTEL_WORDS)} AND NOT {_any(text.SPAM_WORDS)}", "no_veto": _any(text.HOTEL_WORDS)})
scalar("p3_url_exclusion", lambda: {"excluded": base.contains_any(c("url"), ("src1.", "/es/7")) | (F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit(""))) < 4)}, {"excluded": "contains(url, 'src1.') OR contains(url, '/es/7') OR length(url) - length(replace(url, '/', '')) < 4"})
scalar("p4_needs_enrichment", lambda: {"needs": attributes.needs_enrichment(c("rooms"), c("beds"), c("m2"))}, {"needs": "coalesce(rooms, 0) = 0 AND coalesce(beds, 0) = 0 AND coalesce(m2, 0) = 0"})
scalar("p6_ranges", lambda: {"rooms": base.within(c("rooms"), 1, 500), "m2": base.within(c("m2"), 20, 100_000), "stars": base.within(c("stars"), 1, 5)}, {"rooms": "CASE WHEN rooms BETWEEN 1 AND 500 THEN rooms END", "m2": "CASE WHEN m2 BETWEEN 20 AND 100000 THEN m2 END", "stars": "CASE WHEN stars BETWEEN 1 AND 5 THEN stars END"})
scalar("p7_price_ranges", lambda: {"kept": F.array_join(F.filter(F.array(c("n_chars"), c("n_chars") % 40, c("doc_id")), lambda x: x.between(15, 3000)), ",")}, {"kept": "array_to_string(list_filter([n_chars, n_chars % 40, doc_id], lambda x: x BETWEEN 15 AND 3000), ',')"}, "documents", "doc_id")
scalar("p8_truncation", lambda: {"title": F.left("text", F.lit(120)), "description": F.left("text", F.lit(300))}, {"title": "left(text, 120)", "description": "left(text, 300)"}, "documents", "doc_id")
scalar("p9_unknown_price", lambda: {"price": prices.price_or_request(c("price"))}, {"price": "CASE WHEN price IS NULL OR price = '' OR trim(price) IN ('1€', '1 €', '€1') THEN 'Precio a consultar' ELSE price END"})
scalar("p10_defaults", lambda: {"location": F.coalesce(base.present(c("location")), F.lit("España")), "date": F.coalesce(base.present(c("date")), F.lit("31/05/2024"))}, {"location": "coalesce(nullif(location, ''), 'España')", "date": "coalesce(nullif(date, ''), '31/05/2024')"})
scalar("p11_valid_place", lambda: {"valid": places.valid_place(c("location"))}, {"valid": "location IS NOT NULL AND location NOT IN ('España', 'Espana', '')"})
scalar("p12_city_as_place", lambda: {"location": places.city_as_place(c("location"), c("location_city"))}, {"location": "CASE WHEN (location IS NULL OR location IN ('España', 'Espana', '')) AND coalesce(location_city <> '', false) THEN location_city ELSE location END"})
