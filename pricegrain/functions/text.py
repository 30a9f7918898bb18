"""Titles and queries: words, sizes, colours, similarity and broader forms."""

from __future__ import annotations

import re
import unicodedata

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricegrain.functions.vocabulary import COLOUR_MODIFIERS, COLOURS, LADDER_COLOURS, LADDER_FILLER, NOISE_WORDS, QUERY_STOPWORDS, RETAILERS

#: Lower-case Latin letters with marks and the letters without them, by their canonical decomposition.
_MARKED = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower() and unicodedata.normalize("NFKD", chr(c))[0].isascii() and len(unicodedata.normalize("NFKD", chr(c))) > 1 and all(map(unicodedata.combining, unicodedata.normalize("NFKD", chr(c))[1:]))]
ACCENTS = ("".join(_MARKED), "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED))
# Patterns of titles and queries.
INCHES = r"(?i)\b(\d{2}(?:\.\d)?)\s*(?:\"|''|inch|inches|in\b)"
SIZES = ((r"(?i)\bcarry[-\s]?on\b", "Carry-On"), (r"(?i)\bcheck(?:ed)?[-\s]?in\b", "Check-In"), (r"(?i)\bunderseat\b", "Underseat"), (r"(?i)\blarge\b", "Large"), (r"(?i)\bmedium\b", "Medium"), (r"(?i)\bsmall\b", "Small"))
SIZE_TAGS = ((r"(?i)\bcarry[-\s]?on\b|\bcabin\b", "carry-on"), (r"(?i)\bunderseat\b", "underseat"), (r"(?i)\blarge\b", "large"), (r"(?i)\bmedium\b", "medium"), (r"(?i)\bsmall\b", "small"))
COLOUR = rf"(?i)\b({'|'.join(COLOURS)})\b"
TSA_LOCK = r"(?i)\bTSA[- ]?(?:approved )?locks?\b"
ACCESSORY = r"(?i)\b(?:cover|covers|tag|tags|strap|straps|organi[sz]er|packing cubes?|toiletry|pouch|scale|adapter|pillow|wallet|passport holder|replacement|wheel kit|handle kit|garment sleeve|lock|locks)\b"
KNOWN_BRANDS = r"(?i)\b(?:samsonite|american tourister|travelpro|delsey|briggs\s*(?:&|and)\s*riley|tumi|away|monos|rimowa|calpak|swiss\s*gear|swissgear|heys|ricardo|victorinox|herschel|nautica|kenneth cole|travelers? club|osprey|eagle creek|london fog|it luggage|coolife|rockland|traveler'?s choice|lipault|hartmann|roncato|antler|level8|bagsmart|vera bradley|ful|wrangler|amazon basics|amazonbasics)\b"
MAX_PRICE = r"(?i)(?:under|below|less than|max|up to|<)\s*\$?\s*(\d[\d,]*)"
MIN_PRICE = r"(?i)(?:over|above|more than|min|at least|>)\s*\$?\s*(\d[\d,]*)"
PRICE_PHRASE = r"(?i)(?:under|below|less than|max|up to|over|above|more than|min|at least)\s*\$?\s*\d[\d,]*"
CATEGORY_WORDS = r"(?i)\b(luggage|suitcase|suitcases|carry[-\s]?on|carryon|spinner|checked|check[-\s]?in|duffel|duffle|backpack|garment bag|travel bag|trolley|underseat|weekender|briefcase|tote)\b"
NOT_PLAIN = (
    r"(?i)\d\s*(?:dollars?|cad|\$)|\$\s*\d",
    r"(?i)\b(under|below|less than|over|above|more than|between|max|min|up to|at least|cheaper|cheapest|budget)\b",
    r"[?]",
    r"(?i)\b(show|find|get|need|want|looking|compare|best|good|vs|versus|for my|that|which|what|recommend)\b",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row: an expression named several times is computed as often, and in a lambda for each member."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _among(word: Column, words: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*map(F.lit, dict.fromkeys(words))), word)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words_of(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits, in order of appearance."""
    cut = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(cut, lambda w: w != ""))


def slug(text: Column) -> Column:
    plain = F.translate(F.lower(text), *ACCENTS)
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)


def normal_query(query: Column) -> Column:
    """Sorted distinct words, so that the same question in another order has the same key."""
    cut = F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9$.:\s-]", " "), r"\s+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(cut, lambda w: w != ""))), " ")


def cache_key(query: Column, retailers: Column, limit: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", normal_query(query), F.array_join(F.array_sort(retailers), ","), limit.cast("string")), 256), 1, 48)


def query_words(terms: Column) -> Column:
    return F.filter(words_of(F.regexp_replace(terms, r"\$\s?\d[\d,.]*", " ")), lambda w: ~_among(w, QUERY_STOPWORDS) & ((F.length(w) >= 2) | w.rlike(r"\d")))


def query_match(title: Column, terms: Column) -> Column:
    """Share of the asked words that the title has; 1 if none is asked."""
    wanted = query_words(terms)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, words_of(title))) / F.size(wanted))


def name_key(name: Column) -> Column:
    return F.array_join(F.array_sort(words_of(name)), " ")


def size_of(title: Column) -> Column:
    inches = F.regexp_extract(title, INCHES, 1)
    out = F.when(inches != "", F.concat(inches, F.lit(" inch")))
    for pattern, name in SIZES:
        out = out.when(title.rlike(pattern), name)
    return out.otherwise("")


def size_tags(title: Column) -> Column:
    """All sizes a title states; check-in counts only where nothing else is stated."""
    inches = F.regexp_extract(title, INCHES, 1)
    tags = F.array_compact(F.array(F.when(inches != "", F.concat(inches, F.lit(" inch"))), *(F.when(title.rlike(p), name) for p, name in SIZE_TAGS)))
    return F.when((F.size(tags) == 0) & title.rlike(SIZES[1][0]), F.array(F.lit("check-in"))).otherwise(tags)


def title_case(text: Column) -> Column:
    """Lower case but for the first letter of each run of ASCII letters, digits and underscores."""
    marked = F.initcap(F.regexp_replace(F.lower(text), r"(?<![A-Za-z0-9_])(?=[a-z])", "\u0001 "))
    return F.replace(marked, F.lit("\u0001 "), F.lit(""))


def colour_of(title: Column) -> Column:
    """The first colour word, with the word before it where that modifies it; empty without one."""
    first = F.regexp_extract(title, COLOUR, 1)
    before = F.regexp_extract(F.substring(title, 1, F.regexp_instr(title, F.lit(COLOUR)) - 1), r"([A-Za-z]+)\s+\z", 1)
    return F.when(first == "", "").otherwise(title_case(F.when(_among(F.lower(before), COLOUR_MODIFIERS), F.concat_ws(" ", before, first)).otherwise(first)))


def is_accessory(title: Column) -> Column:
    return F.regexp_replace(title, TSA_LOCK, "").rlike(ACCESSORY)


def without_stores(title: Column) -> Column:
    """The title without names of stores that are no brands."""
    names = "|".join(re.escape(r.name) for r in RETAILERS if r.category != "specialty")
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(title, rf"(?i)\b(?:{names})\b", ""), r"\s{2,}", " ")), r"^[\s\-–|,]+|[\s\-–|,]+$", "")


def with_brand(title: Column, brand: Column) -> Column:
    """The title with the asked brand before it, unless it names one."""
    return F.when(brand.isNull() | F.lower(title).contains(F.lower(brand)) | title.rlike(KNOWN_BRANDS), title).otherwise(F.concat_ws(" ", brand, title))


def identity_words(title: Column) -> Column:
    """What identifies a product: no noise, colours or size numbers, but model numbers."""
    cut = F.split(F.regexp_replace(F.lower(title), r'[^a-z0-9\s".]', " "), r"\s+")
    bare = F.filter(F.transform(cut, lambda w: F.regexp_replace(F.regexp_replace(w, '"+$', ""), r"^\.+|\.+$", "")), lambda w: w.rlike("[a-z0-9]"))
    colours = tuple(w for c in COLOURS for w in c.split()) + COLOUR_MODIFIERS

    def kept(w: Column) -> Column:
        number = w.rlike(r"^\d+$")
        size = w.rlike(r"^(?:1[4-9]|2\d|3[0-4])$")
        return ~_among(w, NOISE_WORDS + colours) & F.when(number, ~size & (F.length(w) != 2)).otherwise(F.length(w) > 2)

    return F.array_distinct(F.filter(bare, kept))


def brand_word(words: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), F.lit(1)), F.lit(""))


def max_price(query: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(query, MAX_PRICE, 1), ",", "").try_cast("double")


def min_price(query: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(query, MIN_PRICE, 1), ",", "").try_cast("double")


def without_prices(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(query, PRICE_PHRASE, ""), r"\$\s*\d[\d,]*", ""), r"\s{2,}", " "))


def research_query(terms: Column) -> Column:
    """The terms with the word price, unless they have it."""
    bare = F.trim(terms)
    return F.when(bare.rlike(r"(?i)\bprice\b|\bprix\b"), bare).otherwise(F.concat_ws(" ", bare, F.lit("price")))


def refresh_query(brand: Column, model: Column, name: Column, noun: str = "luggage") -> Column:
    """What to search a known product by: brand and model, or its name, and the category's noun."""
    known = F.concat_ws(" ", F.nullif(brand, F.lit("")), F.nullif(model, F.lit("")))
    return F.trim(F.concat_ws(" ", F.coalesce(F.nullif(F.trim(known), F.lit("")), name), F.lit(noun)))


def numeric_id(text: Column) -> Column:
    """The digits at the end; null without any."""
    return F.nullif(F.regexp_extract(text, r"(\d+)\s*\z", 1), F.lit(""))


def spec_line(*specs: Column) -> Column:
    """The specifications that are known, in one line."""
    return F.concat_ws(" \u00b7 ", *(F.nullif(s, F.lit("")) for s in specs))


def shorter_query(terms: Column) -> Column:
    """The broadest form of a query, unless it is the query itself."""
    return let(F.try_element_at(broader(terms), F.lit(-1)), lambda last: F.when(F.lower(last) != F.lower(squeezed(terms)), last))


def with_category(terms: Column, noun: str = "luggage") -> Column:
    """The terms with the category's noun, unless they have a word of the category."""
    bare = F.trim(terms)
    return F.when((bare == "") | bare.rlike(CATEGORY_WORDS), bare).otherwise(F.concat_ws(" ", bare, F.lit(noun)))


def is_plain_query(query: Column) -> Column:
    plain = F.trim(query) != ""
    for pattern in NOT_PLAIN:
        plain = plain & ~query.rlike(pattern)
    return plain & (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) <= 6)


def broader(query: Column, short: int = 5, noun: str = "luggage") -> Column:
    """The query and ever broader forms of it, each once: without colours if short, identifying words, the first three, brand and category."""
    original = squeezed(query)
    tokens = F.filter(F.split(F.regexp_replace(original, r'[^\w\s".\-/]', " "), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), '[".]', "")
    cut = F.transform(tokens, lambda w: F.struct(w.alias("word"), bare(w).alias("bare")))
    colourless = lambda c: F.transform(F.filter(c, lambda w: ~_among(w["bare"], LADDER_COLOURS)), lambda w: w["word"])
    identifying = lambda c: F.transform(F.filter(c, lambda w: (w["bare"] != "") & ~_among(w["bare"], LADDER_COLOURS + LADDER_FILLER)), lambda w: w["word"])
    rungs = lambda c, known: F.array(
        original,
        F.when(F.size(c) <= short, F.array_join(colourless(c), " ")),
        F.array_join(known, " "),
        F.array_join(F.slice(known, 1, 3), " "),
        F.when(F.size(known) > 1, F.concat_ws(" ", F.try_element_at(known, F.lit(1)), F.lit(noun))),
    )
    found = let(cut, lambda c: let(identifying(c), lambda known: F.filter(F.array_compact(rungs(c, known)), lambda r: r != "")))
    once = lambda some, lowered: F.filter(some, lambda r, i: F.array_position(lowered, F.lower(r)) == i + 1)
    return let(found, lambda some: let(F.transform(some, F.lower), lambda lowered: once(some, lowered)))


def decoded(text: Column) -> Column:
    """The five common HTML entities as characters, in this order."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
