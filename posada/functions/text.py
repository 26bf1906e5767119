"""Cleaning and normalising titles and names."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import BLANK, NOT_WORD, collapse, contains_any, fold_accents

# Words that make a text one about a hotel, and those that veto it.
HOTEL_WORDS = (
    "hotel", "hostal", "hostel", "pensión", "pension", "aparthotel", "posada", "parador", "fonda", "casa rural",
    "alojamiento turístico", "albergue", "resort", "casa de huespedes", "bed and breakfast", "hotel boutique",
    "boutique hotel", "complejo hotelero", "negocio hotelero", "guesthouse", "b&b", "inn ", "lodge", "rural house",
)
SPAM_WORDS = (
    "404", "página no encontrada", "page not found", "i want to advertise", "advertise on think", "sign up", "register",
    "login", "cookie", "privacy policy", "terms of use", "contact us", "about us",
)
# Words that do not tell titles apart.
TITLE_STOPWORDS = (
    "hotel", "hostal", "en", "venta", "de", "la", "el", "las", "los", "un", "una", "lujo", "boutique", "para", "sale",
    "for", "luxury", "the",
)
MORE_TITLE_STOPWORDS = ("con", "garaje", "piscina")
# Words that do not tell registered names apart.
NAME_STOPWORDS = ("hotel", "hostal", "pension", "apartamentos", "casa", "rural", "albergue", "el", "la", "los", "las", "de", "del")
#: Named character references, by their names as HTML 5 has them, with or without a semicolon.
REFERENCES = dict(html5)
#: What numbers from 80 to 9F stand for, by the rule of HTML 5.
WINDOWS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _table(entries: dict[str, str]) -> Column:
    """A map that is folded into a constant."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _reference(name: Column) -> Column:
    """What a named reference stands for; names are looked up among those of their first letter, as a map is searched from its start."""
    by_letter: dict[str, dict[str, str]] = {}
    for key, value in REFERENCES.items():
        by_letter.setdefault(key[0], {})[key] = value
    return F.try_element_at(F.try_element_at(F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>"), F.left(name, F.lit(1))), name)


def unescape(c: Column) -> Column:
    """Decodes numeric and named character references, once. A name without its semicolon counts only if it is a whole run of letters and digits."""

    def sign(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return F.when(valid & nothing, "").when(valid, F.coalesce(F.try_element_at(_table(WINDOWS), code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("\ufffd")

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", 0)
        bare = F.rtrim(ref, F.lit(";"))
        decimal = F.coalesce(F.substring(bare, 2, 12).try_cast("long"), F.lit(1 << 40))
        hexadecimal = F.when(F.length(bare) <= 12, F.conv(F.substring(bare, 3, 12), 16, 10).try_cast("long")).otherwise(F.lit(1 << 40))
        value = (
            F.when(ref == "", None)
            .when(bare.rlike("^#[xX]"), sign(hexadecimal))
            .when(F.startswith(bare, F.lit("#")), sign(decimal))
            .otherwise(_reference(ref))
        )
        return F.coalesce(F.concat(value, F.substring(part, F.length(ref) + 1, F.length(part))), F.concat(F.lit("&"), part))

    def whole(parts: Column) -> Column:
        return F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), "")))

    # A one-element array binds the parts, so that the text is worked out once.
    return F.get(F.transform(F.array(F.split(c, "&")), whole), F.lit(0))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def clean(c: Column) -> Column:
    """Without tags and references, blanks collapsed; null gives ''."""
    return collapse(unescape(strip_tags(F.coalesce(c, F.lit("")))))


def clean_no_brackets(c: Column) -> Column:
    """``clean`` that also drops angle brackets left over after decoding."""
    return collapse(F.translate(unescape(strip_tags(F.coalesce(c, F.lit("")))), "<>", ""))


def scrub(c: Column) -> Column:
    """Without tags and angle brackets; references stay."""
    return collapse(F.translate(strip_tags(F.coalesce(c, F.lit(""))), "<>", ""))


def about_hotels(c: Column, veto: bool = True) -> Column:
    """Whether a text holds a hotel word; with ``veto`` any spam word makes it false."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = contains_any(low, HOTEL_WORDS)
    return hit & ~contains_any(low, SPAM_WORDS) if veto else hit


def _without_words(c: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])", "")


def title_key(c: Column, more: bool = False) -> Column:
    """The title for comparison: lower case, without signs and stopwords."""
    plain = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), NOT_WORD, "")
    return collapse(_without_words(plain, TITLE_STOPWORDS + (MORE_TITLE_STOPWORDS if more else ())))


def place_key(c: Column, keep: str = "") -> Column:
    """A place for look-up: no accents, lower case, signs as blanks. ``keep`` names signs that stay."""
    low = F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    return collapse(F.regexp_replace(low, r"[^\p{L}\p{N}_\s" + keep + "]", " "))


def folded_lower(c: Column) -> Column:
    return F.lower(fold_accents(F.coalesce(c, F.lit(""))))


def name_key(c: Column) -> Column:
    """A registered name for comparison. Signs become blanks after blanks are collapsed, so that doubled ones may stay."""
    low = _without_words(folded_lower(c), NAME_STOPWORDS)
    return F.trim(F.regexp_replace(F.regexp_replace(low, BLANK + "+", " "), "[^a-z0-9 ]", " "))


def joined_paragraphs(paragraphs: Column, longer: int = 40, cap: int = 1500) -> Column:
    """Paragraphs of more than so many characters, joined and cut."""
    return F.left(F.array_join(F.filter(paragraphs, lambda p: F.length(p) > longer), " "), F.lit(cap))


def canonical_url(c: Column) -> Column:
    """Trimmed, cut at the first '?', without slashes at the end; a fragment stays."""
    return F.regexp_replace(F.split_part(F.trim(F.coalesce(c, F.lit(""))), F.lit("?"), F.lit(1)), "/+$", "")
