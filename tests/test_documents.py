"""JSON and text documents, hosts, intervals, reports and streams against plain Python, with odd rows and hot keys."""

import datetime
import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_streaming import streamed

from pricegrain.functions import tables
from pricegrain.operators import hosts, intervals, pages, payloads, sinks, state, tracking
from pricegrain.sources import crawling, feeds
from pricegrain.streaming import hosts as host_streams
from pricegrain.streaming import tables as stream_tables


def test_intervals_that_overlap_go(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 60), rng.randint(0, 9), i) for i in range(300)]
    want, ended = set(), {}
    for key, start, size, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        if start >= ended.get(key, start):
            want.add(i)
            ended[key] = start + size
    odd = [("a", None, 5, 1000), ("a", 5, None, 1001)]
    df = spark.createDataFrame([(k, s, s + n, i) for k, s, n, i in rows] + odd, "key string, start int, stop int, i int").repartition(6)
    assert {r.i for r in intervals.without_overlaps(df, "key", "i").collect()} == want and 0 < len(want) < 200
    assert intervals.without_overlaps(df.limit(0), "key", "i").count() == 0


def test_hosts_belong_to_the_first_domain_they_are_under(spark):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "shop", "x1", "ca", "com"])
    domains = [(".".join(label() for _ in range(rng.randint(1, 3))), f"n{i}", rng.randint(0, 50)) for i in range(60)] + [("", "none", -1)]
    names = [".".join(label() for _ in range(rng.randint(1, 4))) for _ in range(200)] + [None, "", ".", "shop.ca"] + ["hot.shop.ca"] * 500
    rows = spark.createDataFrame(list(enumerate(names)), "i int, host string")
    got = {r.i: r.name for r in hosts.by_suffix(rows, spark.createDataFrame(domains, "domain string, name string, seq int")).collect()}
    for i, h in enumerate(names):
        met = [(s, n) for d, n, s in domains if h and d and (h == d or h.endswith(f".{d}"))]
        assert got[i] == (min(met)[1] if met else None), h
    assert len(got) == len(names)


def test_a_large_registry_of_domains_is_joined_not_scanned(spark):
    registry = spark.range(100_000).select(F.concat(F.lit("d"), "id", F.lit(".example")).alias("domain"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("seq"))
    rows = spark.range(2_000).select(F.concat(F.lit("www.d"), (F.col("id") * 37).cast("string"), F.lit(".example")).alias("host"), F.concat(F.lit("n"), (F.col("id") * 37).cast("string")).alias("want"))
    found = hosts.by_suffix(rows, registry)
    assert found.where("name = want").count() == 2_000
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_payloads_come_back_from_parquet(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    bodies = ['{"products":[{"name":"a","lowestPrice":1.5,"retailers":["x","y"]},{"name":7,"lowestPrice":"none"}]}', '{"products":{}}', "[1]", "{oops", None, '{"products":[]}', '"text"', "null"]
    df = spark.createDataFrame([(str(i), "q", b, at) for i, b in enumerate(bodies)], "key string, query string, body string, fetched_at timestamp")
    payloads.stored(df, 30).write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert dict(cache.dtypes)["payload"] == "variant" and cache.where("payload is null").count() == 2
    assert [(r.key, r.seq, r.name, r.lowest, r.retailers) for r in payloads.products_of(cache).orderBy("key", "seq").collect()] == [("0", 0, "a", 1.5, ["x", "y"]), ("0", 1, "7", None, None)]
    age = lambda minutes: {r.age_minutes for r in payloads.live_payloads(cache, F.lit(at + datetime.timedelta(minutes=minutes))).collect()}
    assert age(30) == {30} and age(31) == set() and age(-5) == {0} and payloads.live_payloads(cache, F.lit(at)).count() == 6


def test_reported_offers_are_counted_in_the_pass_that_returns_them(spark):
    rows = [{"title": f"bag {i}", "retailer": "r", "price": p, "url": u, "in_stock": s} for i, (p, u, s) in enumerate([(20, "https://www.amazon.ca/x", True), ("CA$1,299.005", "http://m.thebay.com/y", False), ("12.3.4", "https://tumi.ca", None), (15, "https://amazon.ca.evil.com", True), (14.99, "https://costco.ca/z", True), (6000, " https://costco.ca/z ", True), (5, "ftp://costco.ca", True), (None, "https://costco.ca/q", True)])]
    rows.append({"title": " ", "price": 50, "url": "https://costco.ca/z"})
    texts = [json.dumps(rows), "Here you are:\n```json\n" + json.dumps(rows[:1]) + "\n```", "nothing", None, "[]", '{"a":1}']
    answers = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    counted = Observation("offers")
    got = sorted((r.query_id, r.seq, r.retailer, r.price, r.in_stock) for r in feeds.grounded_offers(answers, counted).collect())
    assert got == [(0, 0, "Amazon.ca", 20.0, True), (0, 1, "Hudson's Bay", 1299.01, False), (0, 5, "Costco.ca", 6000.0, True), (1, 0, "Amazon.ca", 20.0, True)]
    assert counted.get == {"offers": 4, "unreadable": 3, "no_listing": 2, "host": 1, "price": 3}
    judged = {r.reason: r.n for r in feeds.judged_offers(answers).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert judged == {None: 4, "unreadable": 3, "no listing": 2, "host": 1, "price": 3}


def test_json_files_with_bad_ones_among_them(spark, tmp_path):
    files = {"a.json": '{"results":[{"id":1,"name":"x","other":2},\n{"id":2},null]}', "b.json": '{"results":[{"id":3', "c.json": '{"none":1}', "d.json": '{"results":[]}', "e.json": "text"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, bad = feeds.json_files(spark, str(tmp_path), "results", "id long, name string")
    assert sorted(tuple(r) for r in rows.collect()) == [("a.json", 0, 1, "x"), ("a.json", 1, 2, None), ("a.json", 2, None, None)]
    assert {r.file: r.text for r in bad.collect()} == {"b.json": files["b.json"], "e.json": "text"}


def test_an_index_of_sitemaps_is_read_by_its_first_child(spark):
    index = "<SitemapIndex><sitemap><loc> https://a.ca/one.xml?x=1&amp;y=2 </loc></sitemap><sitemap><loc>https://a.ca/two.xml</loc></sitemap></SitemapIndex>"
    roots = [("a.ca", index), ("b.ca", "<urlset><url><loc>https://b.ca/products/1</loc></url></urlset>"), ("c.ca", "<sitemapindex></sitemapindex>"), ("d.ca", None), ("e.ca", index.replace("a.ca", "e.ca"))]
    child = "<urlset><url><loc>https://a.ca/products/1</loc><lastmod>x</lastmod></url><url><loc>https://a.ca/about</loc></url></urlset>"
    fetched = [("https://a.ca/one.xml?x=1&y=2", child), ("https://a.ca/one.xml?x=1&y=2", "later"), ("https://a.ca/two.xml", "<urlset></urlset>")]
    got = crawling.followed_sitemaps(spark.createDataFrame(roots, "host string, text string"), spark.createDataFrame(fetched, "url string, text string")).collect()
    assert {r.host: (r.read_from, len(r.locations), r.products, r.dated) for r in got} == {
        "a.ca": ("https://a.ca/one.xml?x=1&y=2", 2, 1, True), "b.ca": (None, 1, 1, False), "c.ca": (None, 0, 0, False), "d.ca": (None, 0, 0, False), "e.ca": ("https://e.ca/one.xml?x=1&y=2", 2, 0, False),
    }


def test_a_text_of_many_addresses_is_read_once_and_by_pieces(spark):
    """Addresses that share a text of three pieces; neither the text nor its locations are joined where only counts are asked for."""
    index = lambda h: f"<sitemapindex><loc>https://{h}/m.xml</loc><loc>https://{h}/n.xml</loc></sitemapindex>"
    roots = spark.createDataFrame([(h, index(h)) for h in ("a", "b", "c", "d")], "host string, text string")
    pieces = [(7, k, "".join(f"<loc>https://x.ca/products/{k}-{i}</loc>" for i in range(1000)) + "<lastmod>x</lastmod>" * (k == 1)) for k in (2, 0, 1)] + [(9, 0, "<loc>https://x.ca/other</loc>")]
    fetched = spark.createDataFrame([("https://a/m.xml", 7), ("https://b/m.xml", 7), ("https://b/m.xml", 9), ("https://c/m.xml", 9), ("https://d/m.xml", 11)], "url string, body int")
    found = crawling.followed_sitemaps(roots, fetched, spark.createDataFrame(pieces, "body int, piece int, text string"))
    got = {r.host: (len(r.locations), r.locations[0], r.listed, r.products, r.dated) for r in found.collect()}
    first = "https://x.ca/products/0-0"
    assert got == {"a": (3000, first, 3000, 3000, True), "b": (3000, first, 3000, 3000, True), "c": (1, "https://x.ca/other", 1, 0, False), "d": (2, "https://d/m.xml", 2, 0, False)}
    counts = found.select("host", "listed", "products")
    assert "collect_list" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_price_candidates_are_the_amounts_of_the_expression(spark):
    rng = random.Random(3)
    parts = ["$", "CA$", "US$", "CAD ", "USD", "1,299.99", "99.5", "12", "1234567", " ", "19,99 $", "1 299,99 $", ".", "x", "45.00 CAD", "5.00USD", "é😀", "\n", ",", "-", "| $20 | $30 |\n", "|", " | "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("a", pages.amounts_expression(F.col("t")))
    want = {r.i: [tuple(x) for x in r.a or []] for r in df.collect()}
    rows = df.select("i", "t", pages.amounts(F.col("t")).alias("a")).withColumn("r", F.transform("a", lambda c: pages.in_price_row(F.col("t"), c))).collect()
    assert {r.i: [tuple(x)[:4] for x in r.a] for r in rows} == want
    assert all([x.in_row for x in r.a] == list(r.r) for r in rows) and any(x.in_row for r in rows for x in r.a)
    found = df.select("i", "t").lateralJoin(tables.price_candidates(F.col("t").outer())).collect()
    got = {i: [] for i in want}
    for r in sorted(found, key=lambda r: (r.i, r.nth)):
        assert r.nth == len(got[r.i])
        got[r.i].append((r.start, r.stop, r.value, r.usd))
    assert got == want and sum(map(len, got.values())) > 500
    tables.register(spark)
    df.select("i", "t").createOrReplaceTempView("texts_of_amounts")
    assert spark.sql("SELECT count(*) AS n FROM texts_of_amounts, LATERAL price_candidates(t)").first().n == len(found)


def test_budget_report(spark):
    usage = spark.createDataFrame([("m1", 10, None), ("m2", 0, 7)], "period string, a long, b long")
    allowances = spark.createDataFrame([("a", "A", 30, True, None), ("b", "B", 7, False, 3), ("c", "C", 1, True, None)], "provider string, label string, cap int, monthly boolean, counted int")
    got = {(r.period, r.provider): (r.used, r.remaining, r.exhausted, r.low, r.note) for r in state.budget_report(usage, allowances).collect()}
    assert got == {
        ("m1", "a"): (10, 20, False, True, "Starts again each month"), ("m1", "b"): (3, 4, False, True, "Stops before the limit"),
        ("m2", "a"): (0, 30, False, False, "Starts again each month"), ("m2", "b"): (7, 0, True, False, "Stops before the limit"),
    }


def test_report_lists_and_orders_of_odd_rows(spark):
    rows = spark.createDataFrame([("u", 1, 10.0, "r", 12.0, -2.0, True, 10.0), ("u", 2, None, None, 5.0, 1.0, True, 9.0), ("u", 3, 7.0, "r", None, 1.0, None, 8.0), ("v", 1, 10.0, "r", 9.0, 1.0, False, 50.0)], "user_id string, product_id int, lowest_price double, lowest_retailer string, previous_low double, change double, alert_enabled boolean, target_price double")
    offers = spark.createDataFrame([(1, "s", 11.0, False), (1, "r", 10.0, True), (2, "t", None, False)], "product_id int, retailer string, price double, in_stock boolean")
    got = sorted((r.user_id, r.list, r.product_id, r.retailer, r.amount) for r in tracking.report_lists(rows, offers, 1).collect())
    assert got == [
        ("u", "alerts", 1, "r", 10.0), ("u", "alerts", 3, "r", 7.0), ("u", "drops", 1, "r", -2.0), ("u", "lowest", 3, "r", 7.0), ("u", "out_of_stock", 1, "s", 11.0), ("u", "out_of_stock", 2, "t", None),
        ("v", "increases", 1, "r", 1.0), ("v", "lowest", 1, "r", 10.0), ("v", "out_of_stock", 1, "s", 11.0),
    ]
    order = lambda by: [r.product_id for r in rows.where("user_id = 'u'").orderBy(*tracking.client_order(by)).collect()]
    assert (order("price-asc"), order("price-desc"), order("drop")) == ([3, 1, 2], [1, 3, 2], [1, 2, 3])


@pytest.mark.parametrize("rows", [7, 10_000])
def test_folds_go_on_over_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        log = spark.createDataFrame([("k" if i % 3 else None, i, 1) for i in range(60)], "key string, seq int, units int").repartition(5)
        got = {(r.key, r.seq): (r.allowed, r.total) for r in state.quota(log, 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(t for (k, _), (_, t) in got.items() if k == "k") == 40 and max(t for (k, _), (_, t) in got.items() if k is None) == 20


SCHEMA = "user_id long, seq long, value string"


def test_upserts_of_a_stream_are_those_of_a_batch_and_may_run_twice(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.randint(0, 9), i, f"v{i}") for i in range(200)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, SCHEMA)
    for b in range(5):
        spark.createDataFrame(events[b * 40 : b * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    assert stream_tables.latest(spark, path, SCHEMA).count() == 0
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_tables.upsert_stream(stream, path, str(tmp_path / "state"), ["user_id"], ["seq"], SCHEMA).awaitTermination(120)
    got = sorted(map(tuple, stream_tables.latest(spark, path, SCHEMA).collect()))
    assert got == sorted(map(tuple, sinks.upsert(df.limit(0), df, ["user_id"], ["seq"]).collect()))
    # The last batch again, as after a failure before its end was noted; and an older one than is kept.
    write = stream_tables.upsert_batch(path, SCHEMA, ["user_id"], ["seq"])
    last = max(stream_tables._versions(spark, path))
    again = spark.createDataFrame(events[last * 40 : last * 40 + 40], SCHEMA)
    for _ in range(2):
        write(again, last)
        assert sorted(map(tuple, stream_tables.latest(spark, path, SCHEMA).collect())) == got
    assert len(stream_tables._versions(spark, path)) <= 3


@pytest.fixture
def keyed_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", host_streams.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_pauses_of_a_stream_are_those_of_the_batch(keyed_state, tmp_path):
    rng = random.Random(8)
    df = keyed_state.createDataFrame([(i // 30, f"k{rng.randint(0, 2)}", i, i * 9000, rng.random() < 0.7, rng.random() < 0.3) for i in range(120)], "batch int, key string, seq int, moment long, empty boolean, cached boolean")
    want = {r.seq: (r.skipped, r.streak, r.paused_until) for r in state.empty_pauses(df.drop("batch")).collect()}
    assert {r.seq: (r.skipped, r.streak, r.paused_until) for r in streamed(keyed_state, df, tmp_path, host_streams.empty_pauses)} == want


def test_blocked_hosts_open_again_when_time_has_passed(keyed_state, tmp_path):
    at = lambda seconds: datetime.datetime.fromtimestamp(1_700_000_000 + seconds)
    hour = 3600
    events = [(0, "x", 0, True, False), (0, "y", 10, True, True), (0, "z", 20, False, False), (1, "x", hour, True, False), (2, "y", 13 * hour + 100, True, True), (3, "y", 14 * hour, True, False), (4, "w", 40 * hour, True, True)]
    df = keyed_state.createDataFrame([(b, h, at(s), 1_700_000_000 + s, t, ok) for b, h, s, t, ok in events], "batch int, host string, ts timestamp, moment long, thorough boolean, ok boolean")
    got = [(r.host, r.until - 1_700_000_000, r.blocked) for r in streamed(keyed_state, df, tmp_path, host_streams.blocked_hosts)]
    assert sorted(got) == sorted([("x", 12 * hour, True), ("x", 13 * hour, True), ("x", 13 * hour, False), ("y", 26 * hour, True), ("y", 26 * hour, False)])
    # At any moment the batch form lists the hosts that the stream has not opened yet.
    batch = state.blocked_hosts(df.where("batch < 2").drop("batch", "ts"), F.lit(1_700_000_000 + 2 * hour))
    assert [(r.host, r.until - 1_700_000_000) for r in batch.collect()] == [("x", 13 * hour)]
