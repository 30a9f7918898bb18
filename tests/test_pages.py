"""Golden cases of page reading, clusters and structured sources, and state machines against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pricegrain.functions import text, urls
from pricegrain.functions import vocabulary as v
from pricegrain.operators import clusters, decisions, pages, state
from pricegrain.sources import crawling, jsons, shops, structured

PRICES = [
    ("Brindle Harrow Cabin", "Our shop - Brindle Harrow Cabin\nMSRP $512.00 | Our price: $418.25\nTaxes extra", 418.25),
    ("Brindle Quill 60", "Brindle Quill 60, grey\nReg. $88.10\nSpecial $61.40 while it lasts", 61.4),
    ("Tarn Lantern Duffel", "Tarn Lantern Duffel\n$240.75\n3 payments of $80.25, or $22/month", 240.75),
    ("Sorrel Meadow Pack", "Spend $120 for a coupon of $15\nSorrel Meadow Pack, second edition\n$333.30\nTo the basket", 333.3),
    ("Sorrel Meadow Pack", "Sorrel Meadow Pack\nPrix de vente 271,05 $ taxes en sus", 271.05),
    ("Tarn Lantern Trunk", "Tarn Lantern Trunk No. 7\nToday CAD 2,045.90", 2045.9),
    ("Brindle Harrow Cabin", "Brindle Harrow Cabin\nAsk us for the price\nYou may also like\nQuill $77.70\nMeadow $66.60", None),
    ("Brindle Harrow", "Brindle Harrow, shipped from Ohio\nUSD 145.60", None),
    ("Quill Organiser", "Sizes from $31.00 to $48.00 in four colours", None),
    ("Lantern Travel Chest", "Lantern Travel Chest\n$205.00\nor $290.00", 205.0),
    ("Lantern Travel Chest", "", None),
]
EXCERPTS = [
    ("Brindle Harrow", "Brindle Harrow in moss [...] CA$ 41.20", False, None),
    ("Brindle Harrow", "Brindle Harrow in moss CA$ 141.20", False, 141.2),
    ("Brindle Harrow", "In stock now CA$ 141.20 Qty 1", True, 141.2),
    ("Brindle Harrow", "In stock now CA$ 141.20 Qty 1", False, None),
]


def test_prices_of_pages(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(PRICES)], "id int, title string, text string, want double")
    got = {r.id: r.pick.price if r.pick else None for r in pages.listing_price(df, "text", "title", "pick").collect()}
    assert got == {i: x[2] for i, x in enumerate(PRICES)}


def test_prices_of_excerpts(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(EXCERPTS)], "id int, title string, text string, product boolean, want double")
    got = {r.id: r.pick.price if r.pick else None for r in pages.listing_price(df, "text", "title", "pick", snippet=True, product_url=F.col("product")).collect()}
    assert got == {i: x[3] for i, x in enumerate(EXCERPTS)}


def test_amounts(spark):
    cases = {"CA$ 229.99 and CAD $1,129.00": [229.99, 1129.0], "199.99 CAD $5": [199.99], "1 299,99 $ ou 129,99 $": [1299.99, 129.99], "$1234567 is none": [], "US$99": [99.0], "": []}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", pages.amounts(F.col("t")).alias("a"))
    rows = df.collect()
    assert {r.t: [x.value for x in r.a] for r in rows} == cases
    for r in rows:
        assert [r.t[x.start : x.stop].strip()[-1:] != "" for x in r.a] == [True] * len(r.a)


def test_page_decisions(spark):
    rows = [
        ("https://www.quillbags.ca/collections/duffels", "Duffels | Quill", "", "\n".join(f"Duffel no. {i}: ${61 + i * 7}.40" for i in range(14))),
        ("https://www.harrowandtarn.ca/products/meadow-pack", "Sorrel Meadow Pack - Sorrel | Harrow and Tarn", "Sorrel Meadow Pack Our price $187.35", None),
        ("https://www.bestbuy.ca/en-ca/product/tarn-lantern/7654321", "Tarn Lantern Duffel | Best Buy Canada", "", "Tarn Lantern Duffel\nOur price $240.75\nCurrently unavailable"),
        (None, None, None, None),
    ]
    got = pages.analysed(spark.createDataFrame(rows, "url string, title string, content string, raw string")).collect()
    by = {r.url: r for r in got}
    assert by[rows[0][0]].offer is None and by[rows[0][0]].reason.startswith("search or category")
    assert (by[rows[1][0]].retailer, by[rows[1][0]].retailer_key, by[rows[1][0]].offer.price) == ("Harrow and Tarn", None, 187.35)
    assert by[rows[2][0]].offer.in_stock is False and by[rows[2][0]].offer.price == 240.75
    assert by[None].offer is None and by[None].reason


def test_specifications(spark):
    body = "Tarn Lantern Duffel\nWeighs 4.2 kg, dimensions 70 x 40.5 x 33 cm, capacity 88 L.\nBallistic nylon, 2-wheeled, expansion panel, TSA approved. Weight limit of most airlines: 23 kg. 5 year warranty."
    df = spark.createDataFrame([(body, "Tarn Lantern Duffel"), ("Tarn bag $61.40", "Tarn bag")], "text string, title string")
    full, none = (r.d.asDict() for r in pages.details(df, "text", "title", "d").collect())
    assert full == {"dimensions": "70 x 40.5 x 33 cm", "weight": "4.2 kg", "capacity": "88 L", "material": "Ballistic Nylon", "wheels": "2 wheels", "expandable": True, "tsa_lock": True, "colours": None, "warranty": "5-year"}
    assert set(none.values()) == {None}


def test_page_titles(spark):
    cases = {
        "Brindle Harrow Cabin Trolley : Amazon.ca: Bags": "Brindle Harrow Cabin Trolley",
        "Tarn Lantern Duffel 70 | Canadian Tire": "Tarn Lantern Duffel 70",
        "Amazon.ca: Brindle Quill Upright, Model No. 7-22": "Brindle Quill Upright",
        "Sorrel Meadow - 24'' Medium Trolley": "Sorrel Meadow 24'' Medium Trolley",
        "Sorrel 12 for two ...": "Sorrel 12 for two",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.n for r in df.select("t", pages.clean_title(F.col("t"))["name"].alias("n")).collect()} == cases


def test_tiles(spark):
    cases = {
        "Brindle Harrow Cabin Trolley\nSale price $418.25 CAD    Regular price $512.00 CAD": [("Brindle Harrow Cabin Trolley", 418.25)],
        "| | Brindle Harrow Small | Brindle Harrow Tall |\n| Price | $88.10 | $99.20 |": [],
        "Brindle Quill Upright. C$ 61.40": [],
    }
    df = pages.tiles(spark.createDataFrame([(t,) for t in cases], "t string"), "t", F.lit("brindle harrow"))
    assert {r.t: [(x.name, x.price) for x in r.tiles] for r in df.collect()} == cases


RETAILERS = [
    ("", "https://www.amazon.ca/dp/x", "Amazon.ca"), ("", "https://www.walmart.ca/en/ip/x", "Walmart.ca"), ("", "https://www.costco.ca/x", "Costco.ca"), ("", "https://www.thebay.com/x", "Hudson's Bay"),
    ("", "https://www.canadiantire.ca/x", "Canadian Tire"), ("", "https://www.samsonite.ca/x", "Samsonite.ca"), ("", "https://www.ebay.ca/itm/1", "eBay.ca"), ("", "https://www.bentley.ca/x", "Bentley"),
    ("", "https://www.londondrugs.com/x", "London Drugs"), ("Walmart Canada", "", "Walmart.ca"), ("", "https://www.luggagedepot.ca/x", None), ("Costco Canada - Seller 5", "", "Costco.ca"), ("TUMI.CA", "", "TUMI.ca"),
]


def test_retailers_of_labels_and_addresses(spark):
    df = spark.createDataFrame(RETAILERS, "label string, url string, want string")
    assert [r.got for r in df.select(urls.retailer_of(F.col("label"), F.col("url")).alias("got")).collect()] == [x[2] for x in RETAILERS]


def test_storefronts(spark):
    cases = [("https://www.amazon.ca/dp/X", "", True), ("https://www.thebay.com/p", "", True), ("https://www.amazon.com/dp/X", "$179.99", False), ("https://www.samsonite.com/p", "CA$229.99", False), ("https://www.rimowa.com/ca/en/luggage/123.html", "", True), ("https://www.travelpro.com/p", "$219.00", False), ("https://www.travelpro.com/p", "CA$219.00", True), ("https://www.bagagesmira.com/p", "Prix 179,95 $", True)]
    df = spark.createDataFrame(cases, "url string, text string, want boolean")
    assert [r.got for r in df.select(urls.is_canadian(F.col("url"), F.col("text")).alias("got")).collect()] == [x[2] for x in cases]


def plain_same(a, b):
    """Two identities as dicts: the rule in plain words."""
    if (a["brand"] and b["brand"] and a["brand"] != b["brand"]) or a["accessory"] != b["accessory"]:
        return False
    for field in ("sizes", "numbers"):
        if a[field] and b[field] and not set(a[field]) & set(b[field]):
            return False
    one, other = set(a["words"]), set(b["words"])
    shared = len(one & other)
    if not shared:
        return False
    whole = shared / min(len(one), len(other))
    return shared / len(one | other) >= 0.6 or (shared >= 3 and whole >= 0.85) or (a["size"] != "" and a["size"] == b["size"] and shared >= 2 and whole == 1)


def test_clusters_follow_their_founders_in_order(spark):
    rng = random.Random(3)
    words = ["samsonite", "freeform", "outline", "pro", "21\"", "28 inch", "carry-on", "large", "black", "2", "3", "360", "cover", "delsey", "alpha", "beta", "gamma"]
    rows = [(q, i, " ".join(rng.sample(words, rng.randint(1, 6)))) for q in range(12) for i in range(25)]
    rows += [(50, i, t) for i, t in enumerate(["21\"", "", None, "360 21\"", "samsonite 360"])]
    df = spark.createDataFrame(rows, "query_id int, seq int, title string")
    ids = {(r.query_id, r.seq): r.i.asDict() for r in df.select("query_id", "seq", clusters.identity(text.without_stores(F.coalesce("title", F.lit("")))).alias("i")).collect()}
    want = {}
    for q in {r[0] for r in rows}:
        founders = []
        for s in sorted(s for a, s, _ in rows if a == q):
            home = next((f for f in founders if plain_same(ids[q, f], ids[q, s])), None)
            if home is None:
                founders.append(s)
            want[q, s] = s if home is None else home
    assert {(r.query_id, r.seq): r.founder for r in clusters.clusters(df).collect()} == want
    assert len(set(want.values())) < len(want)


HTML = """<head><meta name="product:brand" content="Brindle"><meta property="og:price:amount" content="88.10"><meta name="Product:Brand" content="later">
<script id="x" type='application/ld+json'>{"name":"Quill 60","@type":"IndividualProduct","brand":{"name":"Brindle"},"gtin14":"0-7711-2","sku":60,
"offers":[{"price":88.1,"availability":"InStock"},{"price":"88.10 CAD","gtin8":"5511","availability":"SoldOut"}]}</script></head>"""
GROUP = """<script type="application/ld+json">[{"@type":"WebSite"},{"@graph":{"@type":["ProductGroup"],"name":"Lantern","hasVariant":[
{"sku":"L1","color":"Moss","offers":{"price":205,"priceSpecification":{"priceType":"ListPrice","price":"290.00"}}},{"sku":"L2","color":"Sand","offers":{"price":"205.00"}}]}}]</script>"""


def test_structured_data(spark):
    df = spark.createDataFrame([(1, HTML), (2, GROUP), (3, '<script type="application/ld+json">{oops</script>'), (4, None), (5, '<script type="application/ld+json">{&quot;@type&quot;:&quot;Product&quot;,&quot;name&quot;:&quot;x&quot;}</script>')], "id int, html string")
    got = {r.id: r for r in structured.extracted(df).collect()}
    one = got[1].products[0]
    assert (one.name, one.brand, one.gtin, one.sku, [o.price for o in one.offers], one.offers[1].gtin) == ("Quill 60", "Brindle", "077112", "60", [88.1, 88.1], "5511")
    assert got[1].meta == {"product:brand": "Brindle", "og:price:amount": "88.10"}
    group = got[2].products[0]
    assert group.type == "ProductGroup" and [v.color for v in group.variants] == ["Moss", "Sand"]
    assert (group.variants[0].offers[0].price, group.variants[0].offers[0].list_price) == (205.0, 290.0)
    assert [(got[i].blocks, got[i].parse_errors, len(got[i].products)) for i in (3, 4, 5)] == [(1, 1, 0), (0, 0, 0), (1, 0, 1)]
    script = spark.createDataFrame([("<body><noscript>Please switch on: javascript is required</noscript>",), (HTML,)], "h string").select(structured.needs_script(F.col("h")).alias("x")).collect()
    assert [r.x for r in script] == [True, False]


def test_agent_results(spark):
    inner = json.dumps({"products": [{"id": "gid://shopify/Product/41", "title": "Quill 60"}]})
    sse = "data: {oops\ndata: " + json.dumps({"result": {"content": [{"type": "image"}, {"type": "text", "text": inner}]}}) + "\n\n"
    ucp = json.dumps({"id": "gid://shopify/Product/41", "variants": [{"id": "v", "barcodes": [{"type": "UPC", "value": "0771"}], "price": {"amount": 8810, "currency": "CAD"}, "list_price": {"amount": 9900}, "availability": {"available": True}}]})
    rows = [(1, sse, "text/event-stream"), (2, '{"error":{"code":-3,"message":"No such tool"}}', None), (3, '{"result":{"isError":true,"content":[{"type":"text","text":"come back later"}]}}', None), (4, "x", None), (5, '{"result":' + ucp + "}", None)]
    df = spark.createDataFrame(rows, "id int, body string, kind string").select("id", jsons.tool_result(jsons.stream_message(F.col("body"), F.col("kind"))).alias("t"))
    got = {r.id: r for r in df.select("id", "t", shops.agent_products(F.col("t.result")).alias("p")).collect()}
    assert got[1].t.ok and [p.title for p in got[1].p] == ["Quill 60"]
    assert [got[i].t.error for i in (2, 3, 4)] == ["-3 No such tool", "come back later", "unparseable response"]
    v = got[5].p[0].variants[0]
    assert (v.price, v.compare_at, v.currency, v.barcode, v.available) == (88.1, 99.0, "CAD", "0771", True)


def test_robots(spark):
    quill = "User-agent: *\nDisallow: /basket\nDisallow: /find\nDisallow: /list/*order*\nAllow: /find$\nSitemap: https://quill.ca/map.xml\n\nUser-agent: OtherReader\nCrawl-delay: 4\nDisallow: /"
    files = spark.createDataFrame([("quill.ca", 200, quill), ("tarn.ca", 200, "User-agent: *\nCrawl-delay: 9\n\nUser-agent: PriceProbe\nDisallow: /"), ("meadow.ca", 200, "User-agent: *\nCrawl-delay: 2\nDisallow: /b\nAllow: /bags/"), ("gone.ca", 404, ""), ("down.ca", 503, "")], "host string, status int, text string")
    rules = crawling.robots_rules(files, "PriceProbe")
    assert {r.host: (r.grp, r.delay, r.sitemaps) for r in rules.collect()} == {"quill.ca": ("*", None, ["https://quill.ca/map.xml"]), "tarn.ca": ("named", None, []), "meadow.ca": ("*", 2.0, []), "gone.ca": ("none", None, []), "down.ca": ("none", None, [])}
    cases = [("quill.ca", "/bags/60", True), ("quill.ca", "/find?x", False), ("quill.ca", "/find", True), ("quill.ca", "/list/new?order=up", False), ("tarn.ca", "/en", False), ("meadow.ca", "/bags/a", True), ("meadow.ca", "/b", False), ("gone.ca", "/b", True), ("down.ca", "", False)]
    df = spark.createDataFrame([(h, f"https://{h}{p}") for h, p, _ in cases], "host string, url string")
    assert {r.url: r.allowed for r in crawling.allowed(df, rules).collect()} == {f"https://{h}{p}": a for h, p, a in cases}


@pytest.mark.parametrize("seed", range(2))
def test_state_machines_match_plain_python(spark, seed):
    rng = random.Random(seed)
    log = [(f"k{rng.randint(0, 3)}", i, i * 9000, rng.randint(-7, 7), rng.random() < 0.7, rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(log, "key string, seq int, moment long, units int, empty boolean, cached boolean")
    counter, quota, pause = {}, {}, {}
    total, used, sleeping = {}, {}, {}
    for key, seq, moment, units, empty, cached in log:
        if abs(units) <= 5:
            total[key] = max(0, total.get(key, 0) + units)
        counter[seq] = (abs(units) > 5, total.get(key, 0))
        allowed = True
        if abs(units) <= 5:
            used[key] = max(0, used.get(key, 0) + units)
            if units > 0 and used[key] > 12:
                used[key], allowed = max(0, used[key] - units), False
        quota[seq] = (allowed, used.get(key, 0))
        streak, until = sleeping.get(key, (0, 0))
        skipped = moment < until
        if not skipped and not cached:
            streak = streak + 1 if empty else 0
            if streak >= 3:
                streak, until = 0, moment + 86_400
        sleeping[key] = (streak, until)
        pause[seq] = (skipped, streak, until)
    assert {r.seq: (r.refused, r.total) for r in state.bounded_counter(df.select("key", "seq", F.col("units").alias("amount"))).collect()} == counter
    assert {r.seq: (r.allowed, r.total) for r in state.quota(df.select("key", "seq", "units"), 12).collect()} == quota
    assert {r.seq: (r.skipped, r.streak, r.paused_until) for r in state.empty_pauses(df.select("key", "seq", "moment", "empty", "cached")).collect()} == pause


def test_ledger_blocked_hosts_and_relaxed_queries(spark):
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    got = state.ledger(rows([("a", 5, 2), ("b", 90, 0)], "key string, calls int, since int"), rows([("a", 10)], "key string, calls int"), rows([("a", 1), ("a", 2)], "key string, units int"), 100, rows([("b", 95)], "key string, cap int"))
    assert {r.key: (r.used, r.cap, r.remaining, r.low, r.exhausted) for r in got.collect()} == {"a": (15, 100, 85, False, False), "b": (90, 95, 5, True, False)}
    reads = rows([("x", 0, True, False), ("x", 40_000, True, False), ("y", 0, True, False), ("z", 50_000, True, True)], "host string, moment long, thorough boolean, ok boolean")
    assert [(r.host, r.until) for r in state.blocked_hosts(reads, F.lit(60_000)).collect()] == [("x", 83_200)]
    queries = rows([(1, ["a b", "a"]), (2, ["c d", "c", "z"]), (3, ["q"])], "query_id int, forms array<string>")
    found = state.relaxed(queries, F.col("forms"), lambda asked: asked.where(F.col("terms").isin("a b", "a", "z")).select("query_id", F.lit(1).alias("hit")))
    assert sorted((r.query_id, r.rung) for r in found.collect()) == [(1, 0), (2, 2)]


def test_titles_slugs_and_colours(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    for title, want in {"Graphite Black": "Graphite", "Bag Ice Blue": "Ice Blue", "rose gold case": "Rose Gold", "JET black": "Jet Black", "Plain Red": "Red", "none": ""}.items():
        assert value(text.colour_of(F.lit(title))) == want
    assert value(text.slug(F.lit("Škoda Élite ŻÓW – ñandú"))) == "skoda-elite-zow-nandu"
    assert value(text.title_case(F.lit("it's o'neil-smith (big) BAG"))) == "It'S O'Neil-Smith (Big) Bag"
    assert value(text.refresh_query(F.lit("A"), F.lit(""), F.lit("n"))) == "A luggage" and value(text.refresh_query(F.lit(""), F.lit(None).cast("string"), F.lit("n"))) == "n luggage"
    assert value(text.numeric_id(F.lit("gid://x/11 "))) == "11" and value(text.research_query(F.lit(" bag "))) == "bag price"
    assert value(text.shorter_query(F.lit("samsonite"))) is None


def plain_identity(title):
    words = [re.sub(r'"+$', "", w).strip(".") for w in re.sub(r'[^a-z0-9\s".]', " ", title.lower()).split()]
    colours = {w for c in v.COLOURS for w in c.split()} | set(v.COLOUR_MODIFIERS)
    out = []
    for w in words:
        if not re.search("[a-z0-9]", w) or w in v.NOISE_WORDS or w in colours or w in out:
            continue
        if w.isdigit():
            if not (len(w) == 2) and not re.fullmatch("1[4-9]|2[0-9]|3[0-4]", w):
                out.append(w)
        elif len(w) > 2:
            out.append(w)
    return out


def plain_broader(query):
    original = " ".join(query.split())
    words = re.sub(r'[^\w\s".\-/]', " ", original).split()
    bare = lambda w: re.sub('[".]', "", w.lower())
    known = [w for w in words if bare(w) and bare(w) not in v.LADDER_COLOURS + v.LADDER_FILLER]
    rungs = [original]
    if len(words) <= 5:
        rungs.append(" ".join(w for w in words if bare(w) not in v.LADDER_COLOURS))
    rungs += [" ".join(known), " ".join(known[:3])]
    if len(known) > 1:
        rungs.append(f"{known[0]} luggage")
    out = []
    for r in rungs:
        if r and r.lower() not in [o.lower() for o in out]:
            out.append(r)
    return out


def test_identities_and_broader_queries_match_plain_python(spark):
    rng = random.Random(9)
    words = ["Samsonite", "outline", "PRO", '21"', "28", "3", "360", "black", "ice", "spinner", "hardside", "carry-on", "x", "a.b", "..", "medium", "Navy,", "set"]
    titles = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(150)] + ["", "  two   spaces "]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.identity_words(F.col("t")).alias("i"), text.broader(F.col("t")).alias("b"))
    for r in df.collect():
        assert r.i == plain_identity(r.t), r.t
        assert r.b == plain_broader(r.t), r.t


def test_decisions_on_odd_rows(spark):
    offers = spark.createDataFrame([(1, " http://x ", "12.345", "R", None), (1, "ftp://x", "1", "R", "t"), (1, "http://x", "nan", "R", "t"), (1, "http://x", "100001", "R", "t"), (1, "http://x", "1", " ", "t"), (1, None, None, None, None)], "product_id int, url string, price string, retailer string, title string")
    assert [(r.url, r.price, r.title) for r in decisions.valid_offers(offers).collect()] == [("http://x", 12.35, "R")]
    one = spark.range(1)
    for query, store in {"samsonite outline pro": "Samsonite.ca", "Briggs & Riley Baseline": "Briggs & Riley", "hardside luggage set under $400": None, "far away": "Away"}.items():
        assert one.select(decisions.brand_store(F.lit(query)).alias("x")).first().x == store
    rows = spark.createDataFrame([("a", True, -1.0), ("a", False, 1.0), ("b", True, 0.0)], "brand string, in_stock boolean, change double")
    assert decisions.filtered(rows).count() == 3 and decisions.filtered(rows, "a", "out", "up").count() == 1 and decisions.filtered(rows, "all", "in", "flat").count() == 1
    assert decisions.faceted(rows, brand="all").count() == 3 and decisions.faceted(rows, brand="b").count() == 1


def nested(depth, rng, leaf):
    """leaf under so many entities of any kind, each with other things beside it."""
    for _ in range(depth):
        kind = rng.choice(["mainEntity", "itemListElement", "item", "@graph", "list"])
        leaf = [{"@type": "Thing"}, leaf] if kind == "list" else {"@type": ["WebPage", 3], kind: leaf, "other": {"@type": "Product", "name": "not walked"}}
    return leaf


def walked(value, found):
    """The rule in plain words, by recursion."""
    if isinstance(value, list):
        for v_ in value:
            walked(v_, found)
    elif isinstance(value, dict):
        walked(value.get("@graph"), found)
        kinds = value.get("@type")
        if {"Product", "ProductGroup", "IndividualProduct"} & {k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}:
            found.append(value["name"])
        else:
            for k in ("mainEntity", "itemListElement", "item"):
                walked(value.get(k), found)


def page_of(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


def test_products_are_found_at_any_depth_in_the_order_of_the_text(spark):
    rng = random.Random(5)
    product = lambda i: {"@type": rng.choice(["Product", ["ProductGroup"], "IndividualProduct"]), "name": f"p{i}", "mainEntity": {"@type": "Product", "name": "inside"}}
    values = [nested(d, rng, product(d)) for d in range(0, 51)] + [nested(400, rng, product(400))]
    values.append([nested(rng.randint(0, 6), rng, [product(f"{i}a"), product(f"{i}b")]) for i in range(20)])
    values.append({"@type": "Product", "name": "outer", "@graph": [product("g")]})
    got = {r.id: [p.name for p in r.products] for r in structured.extracted(spark.createDataFrame([(i, page_of(x)) for i, x in enumerate(values)], "id int, html string")).collect()}
    for i, value in enumerate(values):
        want: list = []
        walked(value, want)
        assert got[i] == want and want, i


def test_variants_offers_and_odd_values_of_structured_data(spark):
    chain = {"@type": "ProductGroup", "name": "top", "hasVariant": [{"sku": 1, "hasVariant": [{"sku": 2.0, "hasVariant": [{"sku": "3"}]}, {"sku": 4}]}, {"sku": 5}, "none", None, []]}
    nest = {"@type": "Product", "name": {"name": {"name": " deep "}}, "brand": ["no"], "sku": True, "gtin": " ", "isbn": "none", "size": 1.5, "offers": {"@type": ["AggregateOffer"], "lowPrice": None, "price": "1.2.3", "highPrice": "9 $", "offers": [{"@type": "AggregateOffer", "lowPrice": 3, "offers": {"price": "call us"}}, {"price": " "}, 7, None]}}
    specs = {"@type": "Product", "name": "\ud800x", "offers": [{"priceSpecification": [{"price": "12"}, {"price": 15, "priceCurrency": "CAD"}, {"priceType": "MSRP", "price": 20}]}, {"price": 5, "seller": {"name": "s"}, "availability": "in", "url": "u", "priceValidUntil": "d", "priceSpecification": {"priceType": "x"}}]}
    pages_ = [page_of(chain), page_of(nest), page_of(specs), page_of(chain) * 2 + "<script type='application/ld+json'>NaN</script>" + page_of("text") + '<script type="application/ld+json"></script>', None, page_of({"@type": "Product"})]
    frame = spark.createDataFrame([(i, h, "own") for i, h in enumerate(pages_)], "id int, html string, meta string")
    got = {r.id: r for r in structured.extracted(frame).collect()}
    top = got[0].products[0]
    assert [(x.sku, x.within) for x in top.variants] == [("1", None), ("2", 1), ("3", 2), ("4", 1), ("5", None), (None, None)]
    odd = got[1].products[0]
    assert (odd.name, odd.brand, odd.sku, odd.gtin, odd.size) == ("deep", None, None, "none", "1.5")
    assert [(o.price, o.list_price) for o in odd.offers] == [(None, 9.0), (3.0, None), (0.0, None), (None, None)]
    first, second = got[2].products[0].offers
    assert (first.price, first.currency, first.list_price) == (12.0, "CAD", 20.0)
    assert (second.price, second.seller, second.availability, second.url, second.valid_until, second.list_price) == (5.0, "s", "in", "u", "d", None)
    assert got[2].products[0].name == "�x"
    assert (got[3].blocks, got[3].parse_errors, len(got[3].products)) == (5, 2, 2)
    assert (got[4].blocks, got[4].products, got[4].meta) == (0, [], {}) and got[5].products[0].name is None
    assert structured.extracted(frame.limit(0)).count() == 0
