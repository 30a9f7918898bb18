"""robots files, sitemaps and fetch outcomes: what may be read, what is there, and what came of reading it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.functions import urls
from pricegrain.operators.pages import held

# Which answers mean what.
CHALLENGE = r"(?i)<title>\s*just a moment|cf-chl|challenge-platform|__cf_chl|captcha|access denied|px-captcha|perimeterx|robot or human|request unsuccessful\. incapsula"
INTERSTITIAL, USED_UP = r"(?i)<title>\s*just a moment|cf-chl", r"(?i)quota|credit|limit|exhaust"
CONSUMED, RETRYABLE = ("quota", "timeout", "server", "unknown"), ("timeout", "server", "network", "rate_limit")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, status, grp, delay, sitemaps, rules) of robots files (host, status, text) for one agent.

    A section of rules belongs to the agents named right before it. Sections that name us count, else those
    for all. The sections follow from a running count of the places where a new run of agents begins.
    """
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).select("host", "pos", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    shape = r"^([A-Za-z-]+)\s*:\s*(.*)$"
    said = lines.where(F.col("line").rlike(shape)).select("host", "pos", F.lower(F.regexp_extract("line", shape, 1)).alias("key"), F.trim(F.regexp_extract("line", shape, 2)).alias("value"))
    order = Window.partitionBy("host").orderBy("pos")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    numbered = said.withColumn("section", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = numbered.where("key = 'user-agent'").groupBy("host", "section").agg(F.collect_set(F.lower("value")).alias("agents"))
    named = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a))
    agents = agents.select("host", "section", named.alias("named"), F.array_contains("agents", "*").alias("star"))
    agents = agents.withColumn("any_named", F.max(F.col("named").cast("int")).over(Window.partitionBy("host")) == 1)
    chosen = agents.where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("star")))
    rules = numbered.join(chosen, ["host", "section"])
    rule = F.struct("pos", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    own = rules.groupBy("host").agg(
        F.first("any_named").alias("any_named"),
        F.min(F.when((F.col("key") == "crawl-delay") & F.col("value").try_cast("double").isNotNull(), F.struct("pos", F.col("value").try_cast("double").alias("v"))))["v"].alias("delay"),
        F.array_sort(F.collect_list(F.when(F.col("key").isin("allow", "disallow") & (F.col("value") != ""), rule))).alias("rules"),
    )
    maps = said.where("key = 'sitemap'").groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("sitemaps"))
    empty = F.array().cast("array<struct<pos:int,allow:boolean,pattern:string>>")
    grp = F.when(F.col("any_named"), "named").when(F.col("any_named").isNotNull(), "*").otherwise("none")
    return files.select("host", "status").join(own, "host", "left").join(maps, "host", "left").select("host", "status", grp.alias("grp"), "delay", F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"), F.coalesce("rules", empty).alias("rules"))


def rule_pattern(pattern: Column) -> Column:
    """A robots pattern as a regular expression over the start of a path."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.substring(pattern, 1, F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(body, r"\*"), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(ends, "$").otherwise(""))


def allowed(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (host, url) with allowed: the longest rule that fits the path or its decoded form decides, and allows on a tie.

    Without a rule it is allowed, as it is where the file was refused (status 4xx); not where the server failed.
    """
    query = F.try_parse_url("url", F.lit("QUERY"))
    path = F.concat(F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    rows = addresses.join(rules.select("host", "status", "rules"), "host", "left").withColumn("_path", path)
    plain = F.coalesce(F.try_url_decode(F.replace("_path", F.lit("+"), F.lit("%2B"))), F.col("_path"))
    fits = F.filter("rules", lambda r: F.regexp_like("_path", rule_pattern(r["pattern"])) | F.regexp_like(plain, rule_pattern(r["pattern"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    verdict = F.when(F.col("status").between(200, 299), F.coalesce(best["allow"], F.lit(True))).otherwise(F.coalesce(F.col("status").between(400, 499), F.lit(False)))
    return rows.select(*addresses.columns, verdict.alias("allowed"))


def sitemap(text: Column) -> Column:
    """(locations, products, dated, is_index) of a sitemap: its addresses, how many look like products, whether it has dates."""
    locations = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.struct(locations.alias("locations"), F.size(F.filter(locations, urls.is_product_url)).alias("products"), F.coalesce(text.rlike("(?i)<lastmod>"), F.lit(False)).alias("dated"), F.coalesce(text.rlike("(?i)<sitemapindex"), F.lit(False)).alias("is_index"))


def followed_sitemaps(sitemaps: DataFrame, fetched: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """sitemaps (host, text) with read_from, locations, products, dated, listed: of a sitemap itself or, if it is an index, of its first child.

    fetched (url, text) holds what was read of children; read_from is the child's address, or null for a sitemap
    that is no index. Where the child was not read, the index's own addresses stand. Of an address that was read twice
    the first text, in order of its bytes, counts. Where many addresses gave the same text, fetched is (url, body), of
    which the least body counts, and bodies (body, piece, text) has each text once, in any number of pieces cut between
    entries. Each text is read once and only what it says is joined; listed is the number of locations, for those
    who don't need all of them.
    """
    said = ("locations", "listed", "products", "dated")
    m = F.col("m")
    flat = [m["locations"].alias("locations"), F.size(m["locations"]).alias("listed"), m["products"].alias("products"), m["dated"].alias("dated")]
    if bodies is None:
        read = held(fetched.where("text is not null").groupBy("url").agg(F.min("text").alias("text")), m=sitemap(F.col("text"))).select("url", *flat)
    else:
        pieces = held(bodies.where("text is not null"), m=sitemap(F.col("text"))).select("body", "piece", *flat)
        whole = pieces.groupBy("body").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "locations"))), lambda x: x["locations"])).alias("locations"),
            F.sum("listed").cast("int").alias("listed"), F.sum("products").cast("int").alias("products"), F.max("dated").alias("dated"),
        )
        read = fetched.groupBy("url").agg(F.min("body").alias("body")).join(whole, "body").select("url", *said)
    rows = held(sitemaps, m=sitemap(F.col("text"))).select("host", F.when(m["is_index"], F.try_element_at(m["locations"], F.lit(1))).alias("read_from"), *(c.alias(f"own_{n}") for n, c in zip(said, flat, strict=True)))
    joined = rows.join(read.withColumn("read", F.lit(True)), F.col("read_from") == F.col("url"), "left")
    shown = {n: F.when(F.col("read"), F.col(n)).otherwise(F.col(f"own_{n}")).alias(n) for n in said}
    return joined.select("host", "read_from", *(shown[n] for n in ("locations", "products", "dated", "listed")))


def outcome(status: Column, body: Column, mitigated: Column | None = None) -> Column:
    """What came of a fetch: challenge, rate_limited, not_found, blocked, ok or error; mitigated marks answers that say so themselves."""
    head = F.coalesce(F.substring(body, 1, 20_000), F.lit(""))
    good = status.between(200, 299)
    marked = F.lit(False) if mitigated is None else F.coalesce(mitigated, F.lit(False))
    return (
        F.when(marked, "challenge").when(status == 429, "rate_limited").when(status.isin(404, 410), "not_found").when(status.isin(403, 503) & head.rlike(CHALLENGE), "challenge")
        .when(status.isin(401, 403), "blocked").when(good & head.rlike(INTERSTITIAL), "challenge").when(good, "ok").otherwise("error")
    )


def http_failure(status: Column, body: Column) -> Column:
    """(kind, consumed, retryable) of an answer that is no success: what kind it is, whether it may have been billed, whether to try again."""
    kind = (
        F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limit").when(status.isin(432, 433), "quota").when(status.isin(400, 422), "bad_request")
        .when(status >= 500, "server").when(F.coalesce(body, F.lit("")).rlike(USED_UP), "quota").otherwise("unknown")
    )
    return F.struct(kind.alias("kind"), kind.isin(*CONSUMED).alias("consumed"), kind.isin(*RETRYABLE).alias("retryable"))


def permission(channel: Column, terms: Column, may_crawl: Column) -> Column:
    """Whether a store's channel may be used, by its terms (sanctions_json, silent, unknown, restricts) and its robots file."""
    listed = channel.isin("json", "js")
    return (
        F.when(~may_crawl, "no: robots").when((channel == "ucp") & (terms == "restricts"), "yes: agent channel, with sign-off").when(channel == "ucp", "yes: agent channel")
        .when((terms == "sanctions_json") & listed, "yes: listed for agents").when(terms.isin("sanctions_json", "silent"), "likely").when(terms == "unknown", "unclear").when(terms == "restricts", "no: terms")
    )
