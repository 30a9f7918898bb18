"""Retailers, host policies and word lists. All of these are fixed values that results depend on; pass your own to replace them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retailer:
    name: str
    category: str
    domains: tuple[str, ...]


# Retailers in order of precedence, with the domains that identify them.
RETAILERS = (
    Retailer("Amazon.ca", "major", ("amazon.ca", "amazon.com")),
    Retailer("Costco.ca", "major", ("costco.ca",)),
    Retailer("Walmart.ca", "major", ("walmart.ca",)),
    Retailer("Hudson's Bay", "major", ("thebay.com", "hbc.com", "hudsonsbay.com")),
    Retailer("Canadian Tire", "major", ("canadiantire.ca",)),
    Retailer("Bentley", "major", ("bentley.ca",)),
    Retailer("Best Buy Canada", "major", ("bestbuy.ca",)),
    Retailer("London Drugs", "major", ("londondrugs.com",)),
    Retailer("Samsonite.ca", "specialty", ("samsonite.ca", "samsonite.com")),
    Retailer("TUMI.ca", "specialty", ("tumi.ca", "tumi.com")),
    Retailer("Away", "specialty", ("awaytravel.com",)),
    Retailer("Travelpro", "specialty", ("travelpro.com", "travelproluggage.ca")),
    Retailer("Monos", "specialty", ("monos.com", "monos.ca")),
    Retailer("Briggs & Riley", "specialty", ("briggs-riley.com", "briggsandriley.com", "briggs-riley.ca")),
    Retailer("RIMOWA", "specialty", ("rimowa.com",)),
    Retailer("CALPAK", "specialty", ("calpaktravel.com",)),
    Retailer("eBay.ca", "other", ("ebay.ca", "ebay.com")),
)
# Order of the categories.
CATEGORY_ORDER = {"major": 0, "specialty": 1, "other": 2}
# Labels that shopping feeds give to retailers.
ALIASES = {
    "amazon": "Amazon.ca", "amazon canada": "Amazon.ca", "amazon - canada": "Amazon.ca", "amazon.ca": "Amazon.ca",
    "costco": "Costco.ca", "costco canada": "Costco.ca", "costco wholesale": "Costco.ca", "costco wholesale canada": "Costco.ca", "costco.ca": "Costco.ca",
    "walmart": "Walmart.ca", "walmart canada": "Walmart.ca", "walmart - canada": "Walmart.ca", "walmart.ca": "Walmart.ca",
    "hudson's bay": "Hudson's Bay", "hudsons bay": "Hudson's Bay", "the bay": "Hudson's Bay", "thebay.com": "Hudson's Bay", "thebay": "Hudson's Bay",
    "canadian tire": "Canadian Tire", "canadiantire.ca": "Canadian Tire", "bentley": "Bentley", "bentley leathers": "Bentley",
    "best buy": "Best Buy Canada", "best buy canada": "Best Buy Canada", "bestbuy.ca": "Best Buy Canada",
    "london drugs": "London Drugs", "londondrugs.com": "London Drugs",
    "samsonite": "Samsonite.ca", "samsonite canada": "Samsonite.ca", "samsonite.ca": "Samsonite.ca", "tumi": "TUMI.ca", "tumi.ca": "TUMI.ca",
    "away": "Away", "away travel": "Away", "travelpro": "Travelpro", "travelpro.com": "Travelpro", "monos": "Monos", "monos.com": "Monos",
    "briggs & riley": "Briggs & Riley", "briggs and riley": "Briggs & Riley", "rimowa": "RIMOWA", "calpak": "CALPAK", "ebay": "eBay.ca", "ebay.ca": "eBay.ca",
}
#: Aliases shorter than this are not looked for inside a label.
LEAST_ALIAS = 5
# Hosts that list other people's offers.
NON_MERCHANT_HOSTS = ("google.com", "google.ca", "googleusercontent.com", "gstatic.com", "bing.com", "duckduckgo.com", "shopping.google.com")
# Stores that price in US dollars, and Canadian stores under .com.
US_STOREFRONTS = (
    "amazon.com", "walmart.com", "samsonite.com", "tumi.com", "ebay.com", "bestbuy.com", "costco.com", "target.com",
    "macys.com", "kohls.com", "nordstrom.com", "dillards.com", "jcpenney.com", "zappos.com", "ebags.com", "luggagepros.com",
)
CANADIAN_DOT_COM = ("thebay.com", "hbc.com", "hudsonsbay.com", "londondrugs.com")
# Words that do not say which product was asked for.
QUERY_STOPWORDS = (
    "luggage", "suitcase", "suitcases", "bag", "bags", "price", "prices", "cheap", "cheapest", "best", "buy", "the", "a", "an", "for", "with",
    "and", "or", "under", "over", "below", "above", "canada", "canadian", "sale", "deal", "deals", "in", "on", "of", "inch", "inches", "new",
    "online", "shop", "store", "lowest", "compare",
)
# Words of a title that identify nothing.
NOISE_WORDS = (
    "luggage", "suitcase", "spinner", "wheeled", "upright", "bag", "travel", "new", "sale", "free", "shipping", "with", "and", "the", "for", "inch",
    "in", "of", "hardside", "softside", "expandable", "lightweight", "set", "piece", "pc", "tsa", "lock", "carry", "on", "carryon", "checked",
    "black", "blue", "silver", "grey", "gray", "navy", "red", "green",
)
# Words that do not help to find a product on its own page.
ANCHOR_STOPWORDS = (
    "luggage", "suitcase", "spinner", "carry", "carry-on", "checked", "check", "hardside", "softside", "expandable", "wheeled", "travel", "with",
    "from", "size", "inch", "large", "medium", "small", "piece", "black", "blue", "grey", "gray", "navy", "silver", "price", "canada", "shop",
    "online", "free", "shipping",
)
# Colours and the words before them, longest alternatives as they are tried.
COLOURS = (
    "black", "white", "grey", "gray", "silver", "navy", "blue", "red", "green", "teal", "purple", "pink", "burgundy", "maroon", "brown", "tan",
    "beige", "gold", "rose gold", "rose", "charcoal", "graphite", "champagne", "olive", "khaki", "orange", "yellow", "ivory", "cream", "bronze",
    "copper", "coral", "lilac", "lavender", "mint", "turquoise", "aqua", "sage", "taupe", "mocha", "cognac", "indigo",
)
COLOUR_MODIFIERS = (
    "ice", "stone", "jet", "midnight", "deep", "light", "dark", "sky", "forest", "ocean", "electric", "pearl", "matte", "bright", "pale", "royal",
    "baby", "dusty", "sand", "steel", "space", "slate", "true", "classic", "cool", "warm", "soft", "blush", "moss", "sea", "storm", "graphite",
    "arctic", "cobalt", "emerald", "ruby", "sapphire", "brushed",
)
# What a longer query loses first.
LADDER_COLOURS = (
    "black", "white", "grey", "gray", "silver", "navy", "blue", "red", "green", "teal", "purple", "pink", "burgundy", "maroon", "brown", "tan",
    "beige", "gold", "rose", "charcoal", "graphite", "champagne", "olive", "khaki", "orange", "yellow", "ivory", "cream", "bronze", "copper", "coral",
)
LADDER_FILLER = (
    "expandable", "hardside", "softside", "hard", "soft", "shell", "hardshell", "lightweight", "durable", "spinner", "wheeled", "rolling", "upright",
    "double", "wheel", "wheels", "tsa", "lock", "locking", "recessed", "medium", "large", "small", "mini", "compact", "oversized",
    "new", "sale", "best", "premium", "deluxe", "classic", "collection", "series", "edition", "official", "genuine", "original",
    "luggage", "suitcase", "bag", "travel",
)
