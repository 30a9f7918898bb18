"""Offers that a model reports as JSON, held to known hosts and believable prices, and JSON files with bad records kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import urls
from pricegrain.functions.numbers import cents
from pricegrain.operators.pages import held
from pricegrain.sources.jsons import tolerant

#: Prices outside this band are not believed.
LOW, HIGH = 15, 6_000
_ROW = "struct<title:string,retailer:string,price:string,url:string,in_stock:string,upc:string>"


def judged_offers(answers: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(query_id, seq, title, retailer, price, url, in_stock, reason) of every row of answers (query_id, text); reason is null for an offer.

    text is what the model wrote: an array of objects, bare, fenced or amid words. Reasons are, the first that holds:
    "no listing" without an address or a title, "host" where no known retailer's domain is, "price" outside
    the band. An answer that is no array has one row, with seq -1 and "unreadable". A missing stock counts as in stock.
    """
    read = held(answers.select("query_id", "text"), _json=tolerant(F.col("text"))).select("query_id", "_json")
    read = held(read, _rows=F.when(F.ltrim("_json").startswith("["), F.from_json("_json", f"array<{_ROW}>")))
    rows = F.col("_rows")
    each = read.select("query_id", rows.isNull().alias("bad"), F.posexplode_outer(rows).alias("place", "r"))
    url, title = F.trim(F.coalesce("r.url", F.lit(""))), F.trim(F.coalesce("r.title", F.lit("")))
    # The number that the digits begin with: a second point ends it.
    digits = F.regexp_extract(F.regexp_replace(F.coalesce("r.price", F.lit("")), "[^0-9.]", ""), r"^\d*\.?\d*", 0)
    each = each.where(F.col("bad") | F.col("r").isNotNull()).select("query_id", "bad", F.when(F.col("bad"), -1).otherwise(F.col("place")).alias("seq"), title.alias("title"), urls.retailer_of_url(url).alias("retailer"), cents(F.coalesce(digits.try_cast("double"), F.lit(0.0))).alias("price"), url.alias("url"), (F.coalesce("r.in_stock", F.lit("true")) != "false").alias("in_stock"))
    reason = (
        F.when(F.col("bad"), "unreadable")
        .when(~F.col("url").startswith("http") | (F.col("title") == ""), "no listing")
        .when(F.col("retailer").isNull(), "host")
        .when(~F.col("price").between(low, high), "price")
    )
    return held(each, reason=reason).select("query_id", "seq", "title", "retailer", "price", "url", "in_stock", "reason")


def grounded_offers(answers: DataFrame, counted: Observation | None = None, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The offers of judged_offers(); `counted` gets how many rows went, by reason, from the same pass that returns the offers."""
    rows = judged_offers(answers, low, high)
    if counted is not None:
        reasons = {"unreadable": "unreadable", "no_listing": "no listing", "host": "host", "price": "price"}
        rows = rows.observe(counted, F.count_if(F.col("reason").isNull()).alias("offers"), *(F.count_if(F.col("reason") == r).alias(n) for n, r in reasons.items()))
    return rows.where("reason is null").drop("reason")


def json_files(spark: SparkSession, path: str, field: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file, seq, ...) of an array field of JSON files, in its order, and the files (file, text) that are no such JSON.

    Each file is one document; row is the DDL of a member, so that no pass over the data guesses it. A file
    without the field has no row; one that can't be read as a document is kept whole in the second result.
    """
    schema = f"`{field}` array<struct<{row}>>, _corrupt string"
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    whole = whole.select(F.col("_metadata.file_name").alias("file"), F.col(field).alias("members"), "_corrupt")
    rows = whole.where("_corrupt is null").select("file", F.posexplode("members").alias("seq", "row")).select("file", "seq", "row.*")
    # Spark reads no column of bad records by itself, so the other one is looked at too.
    return rows, whole.where("_corrupt is not null and coalesce(size(members), 0) >= 0").select("file", F.col("_corrupt").alias("text"))
