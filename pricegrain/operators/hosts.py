"""Hosts joined with a registry of domains: a host belongs to every domain that it is, or is under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(host: Column) -> Column:
    """The host and what is left of it after each of its dots, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def by_suffix(rows: DataFrame, registry: DataFrame, host: str = "host") -> DataFrame:
    """rows with name: that of the first domain, by seq, of registry (domain, name, seq) that the host is or is under; null without one.

    Each different host is looked up once, by equality of its suffixes with domains, so that neither the size of
    the registry nor a host on very many rows matters; Spark broadcasts a side where its size is known
    to be small. Of a domain listed twice the first counts. Hosts and domains are in lower case.
    """
    hosts = rows.select(F.col(host).alias("_host")).where(F.coalesce(F.col(host), F.lit("")) != "").distinct()
    first = registry.where(F.col("domain") != "").groupBy("domain").agg(F.min(F.struct("seq", "name")).alias("_first"))
    met = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("domain")).join(first, "domain")
    named = met.groupBy("_host").agg(F.min("_first").alias("_first")).select("_host", F.col("_first.name").alias("name"))
    return rows.drop("name").join(named, F.col(host) == F.col("_host"), "left").drop("_host")
