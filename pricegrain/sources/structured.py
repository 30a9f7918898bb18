"""Product data in HTML: JSON-LD products with their offers and variants, meta tags, and pages that need scripts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pricegrain.functions.text import decoded

# Where structured data stands, which kinds of nodes are products, and which meta tags count.
BLOCK = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
META = r"""(?i)(<meta\s+[^>]*?(?:property|name|itemprop)\s*=\s*["'][^"']+["'][^>]*?content\s*=\s*["'][^"']*["'][^>]*>)"""
META_TURNED = r"""(?i)(<meta\s+[^>]*?content\s*=\s*["'][^"']*["'][^>]*?(?:property|name|itemprop)\s*=\s*["'][^"']+["'][^>]*>)"""
NAMED = r"""(?i)(?:property|name|itemprop)\s*=\s*["']([^"']+)["']"""
CONTENT = r"""(?i)content\s*=\s*["']([^"']*)["']"""
META_KEYS = (
    "og:type", "og:title", "og:price:amount", "og:price:currency", "product:price:amount", "product:price:currency", "product:availability",
    "product:sale_price:amount", "product:original_price:amount", "product:retailer_item_id", "product:brand", "price", "pricecurrency",
)
PRODUCT_TYPES = ("Product", "ProductGroup", "IndividualProduct")
NESTED = ("mainEntity", "itemListElement", "item")
BARCODES = ("gtin", "gtin13", "gtin12", "gtin14", "gtin8", "isbn")
LIST_PRICE = "(?i)ListPrice|StrikethroughPrice|MSRP"
NEEDS_SCRIPT, HAS_DATA, SCRIPT_TEXT = r"(?i)javascript is required|enable javascript|<noscript>[^<]*javascript", r"(?i)application/ld\+json", 50_000

_TEXT = ("type", "name", "brand", "sku", "mpn", "gtin", "color", "size")
_fields = lambda kind, *names: [pa.field(n, kind) for n in names]
_OFFER = pa.struct([*_fields(pa.float64(), "price", "list_price"), *_fields(pa.string(), "currency", "availability", "valid_until", "sku", "gtin", "url", "seller")])
_PLAIN = [*_fields(pa.string(), *_TEXT), pa.field("offers", pa.list_(_OFFER))]
#: A product; its variants are those of its variants too, in the order of the text, each with the place (from 1) of the variant that holds it.
_PRODUCT = pa.struct([*_PLAIN, pa.field("variants", pa.list_(pa.struct([*_PLAIN, pa.field("within", pa.int32())])))])
_FOUND = pa.struct([pa.field("errors", pa.int32()), pa.field("products", pa.list_(_PRODUCT))])


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parsed_json(text: str):  # noqa: ANN201
    """The value of a JSON text, as it stands or after its HTML entities are decoded; ValueError without one.

    A text nested deeper than the parser goes, some thousands of levels, has none.
    """
    entities = text.replace("&quot;", '"').replace("&#39;", "'").replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    for form in (text, entities):
        try:
            return json.loads(form, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            continue
    raise ValueError("no JSON")


def _text(value) -> str | None:  # noqa: ANN001
    """A string, a number, or an object's name as text; null if it is blank or anything else."""
    while isinstance(value, dict):
        value = value.get("name")
    if isinstance(value, str):
        # Halves of surrogate pairs are no text.
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip() or None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return str(int(value)) if value == value // 1 and abs(value) < 1e21 else repr(value)


def _number(value) -> float | None:  # noqa: ANN001
    """A number, or what a string's digits and points say; a string without any is zero, a blank one null."""
    if isinstance(value, str):
        digits = re.sub(r"[^0-9.]", "", value)
        try:
            return float(digits or 0) if value.strip() else None
        except ValueError:
            return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return float(value) if math.isfinite(value) else None
    except OverflowError:
        return None


def _listed(value) -> list:  # noqa: ANN001
    return value if isinstance(value, list) else [value] if value else []


def _object(value) -> dict:  # noqa: ANN001
    return value if isinstance(value, dict) else {}


def _types(node: dict) -> list[str]:
    kinds = node.get("@type")
    return [t for t in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(t, str)]


def _barcode(node: dict) -> str | None:
    first = next((t for t in (_text(node.get(k)) for k in BARCODES) if t), None)
    return first and (re.sub(r"\D", "", first) or first)


def product_nodes(value) -> Iterator[dict]:  # noqa: ANN001
    """The product nodes of a JSON value, depth first, through lists, graphs and entities that hold others, however deep.

    What waits is a list, not the call stack. A graph's nodes come before the node that has it; inside a product nothing is looked for.
    """
    waiting = [(value, False)]
    while waiting:
        node, walked = waiting.pop()
        if isinstance(node, list):
            waiting += [(v, False) for v in reversed(node)]
        elif isinstance(node, dict):
            if node.get("@graph") and not walked:
                waiting += [(node, True), (node["@graph"], False)]
            elif not set(_types(node)).isdisjoint(PRODUCT_TYPES):
                yield node
            else:
                waiting += [(node[k], False) for k in reversed(NESTED) if node.get(k)]


def _offer(node: dict) -> dict:
    price, listed, currency = _number(node.get("price")), None, _text(node.get("priceCurrency"))
    for spec in map(_object, filter(lambda s: isinstance(s, (dict, list)), _listed(node.get("priceSpecification")))):
        amount = _number(spec.get("price"))
        if re.search(LIST_PRICE, _text(spec.get("priceType")) or ""):
            listed = amount
        elif price is None:
            price = amount
        currency = currency if currency is not None else _text(spec.get("priceCurrency"))
    return {"price": price, "currency": currency, "sku": _text(node.get("sku")), "gtin": _barcode(node), "list_price": listed}


def offers_of(value) -> list[dict]:  # noqa: ANN001
    """A product's offers; an aggregate offer counts with its lowest price, and its own offers after it."""
    out, waiting = [], list(reversed(_listed(value)))
    while waiting:
        node = waiting.pop()
        if not isinstance(node, (dict, list)):
            continue
        node = _object(node)
        if "AggregateOffer" in _types(node):
            low = node.get("lowPrice")
            own = {"price": _number(node.get("price") if low is None else low), "currency": _text(node.get("priceCurrency")), "sku": None, "gtin": None, "list_price": _number(node.get("highPrice"))}
            waiting += reversed(_listed(node.get("offers")))
        else:
            own = _offer(node)
        shared = {"availability": node.get("availability"), "valid_until": node.get("priceValidUntil"), "url": node.get("url"), "seller": node.get("seller")}
        out.append(own | {k: _text(v) for k, v in shared.items()})
    return out


def _plain(node: dict) -> dict:
    fields = {n: _text(node.get(n)) for n in ("name", "brand", "sku", "mpn", "color", "size")}
    return fields | {"type": ",".join(_types(node)), "gtin": _barcode(node), "offers": offers_of(node.get("offers"))}


def product_of(node: dict) -> dict:
    """A product node with offers and variants, those of variants too."""
    variants: list[dict] = []
    below = lambda n, within: [(v, within) for v in reversed(n["hasVariant"]) if isinstance(v, (dict, list))] if isinstance(n.get("hasVariant"), list) else []
    waiting = below(node, None)
    while waiting:
        variant, within = waiting.pop()
        variants.append(_plain(_object(variant)) | {"within": within})
        waiting += below(_object(variant), len(variants))
    return _plain(node) | {"variants": variants}


def _read(blocks: pa.Array) -> pa.Array:
    rows = []
    for texts in blocks.to_pylist():
        errors, products = 0, []
        for text in texts or []:
            try:
                products += map(product_of, product_nodes(parsed_json(text)))
            except ValueError:
                errors += 1
        rows.append({"errors": errors, "products": products})
    return pa.array(rows, _FOUND)


def products_in(blocks: Column) -> Column:
    """(errors, products) of an array of JSON texts: how many are none, and the products of the others."""
    return F.arrow_udf(_read, from_arrow_type(_FOUND))(blocks)


def meta_tags(html: Column) -> Column:
    """The known meta tags as a map, the first of each key, tags with the name before the content first."""
    found = F.concat(F.regexp_extract_all(html, F.lit(META), F.lit(1)), F.regexp_extract_all(html, F.lit(META_TURNED), F.lit(1)))
    pairs = F.transform(found, lambda t: F.struct(F.lower(F.regexp_extract(t, NAMED, 1)).alias("key"), decoded(F.regexp_extract(t, CONTENT, 1)).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isin(*META_KEYS))
    names = F.transform(known, lambda p: p["key"])
    return F.map_from_entries(F.filter(known, lambda p, i: F.array_position(names, p["key"]) == i + 1))


def all_meta_tags(html: Column) -> Column:
    """Every meta tag that has a name and a content, as (key, value), tags with the name before the content first; keys in lower case."""
    found = F.concat(F.regexp_extract_all(html, F.lit(META), F.lit(1)), F.regexp_extract_all(html, F.lit(META_TURNED), F.lit(1)))
    return F.transform(found, lambda t: F.struct(F.lower(F.regexp_extract(t, NAMED, 1)).alias("key"), decoded(F.regexp_extract(t, CONTENT, 1)).alias("value")))


def meta_tags(html: Column) -> Column:
    """The known meta tags as a map, the first of each key."""
    known = F.filter(all_meta_tags(html), lambda p: p["key"].isin(*META_KEYS))
    names = F.transform(known, lambda p: p["key"])
    return F.map_from_entries(F.filter(known, lambda p, i: F.array_position(names, p["key"]) == i + 1))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with blocks, parse_errors, products (structs) and meta (a map) of their HTML.

    The JVM finds the blocks, so that only these reach Python; there each is parsed once and walked to
    its end. A null page has no block. Columns of pages with these names are replaced.
    """
    made = ("blocks", "parse_errors", "products", "meta")
    page = F.coalesce(F.col(html), F.lit(""))
    raw = F.transform(F.regexp_extract_all(page, F.lit(BLOCK), F.lit(1)), lambda b: F.regexp_replace(F.trim(b), r"^<!--|-->$", ""))
    rest = [c for c in pages.columns if c not in made]
    rows = pages.select(F.struct(*pages.columns).alias("_row"), meta_tags(page).alias("meta"), raw.alias("_raw"))
    rows = rows.withColumn("_found", products_in(F.col("_raw")))
    columns = {"blocks": F.size("_raw"), "parse_errors": F.col("_found.errors"), "products": F.col("_found.products"), "meta": F.col("meta")}
    return rows.select(*(F.col("_row")[c].alias(c) for c in rest), *(c.alias(n) for n, c in columns.items()))


def needs_script(html: Column) -> Column:
    return F.substring(html, 1, SCRIPT_TEXT).rlike(NEEDS_SCRIPT) & ~html.rlike(HAS_DATA)
