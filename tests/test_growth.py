"""What queries do only once, and by how many tasks."""

import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pricegrain.functions import tables, text, urls
from pricegrain.functions.amounts import candidates
from pricegrain.functions.vocabulary import RETAILERS
from pricegrain.operators import tracking
from pricegrain.plans import documents, registry, roles
from pricegrain.session import REMOVES_SHUFFLES, once
from pricegrain.sources import feeds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["e6_details", "e7_page_decisions", "e9_tile_offers", "f29_shorter_query", "js2_nested_products", "s13_shop_documents", "x13_broader", "x13_ladder", "x20_clusters", "j6_title_classes"])
def test_parts_of_one_file_are_dealt_to_all_cores(spark, name):
    dealt = roles.spread(spark, SF, "part", "p_partkey")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and dealt.count() == roles.table(spark, SF, "part").count()
    df = registry.QUERIES[name](spark, SF)
    # The parts are read behind a shuffle, or what was made of them was written.
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString() or all("part.parquet" not in f for f in df.inputFiles())


@pytest.mark.parametrize(("name", "table"), [("x20_clusters", "identities"), ("e10_products", "identities"), ("j6_title_classes", "identities"), ("j6_title_pairs", "representatives"), ("j6_pairs_in_search", "representatives"), ("e9_tile_offers", "tiles"), ("t6_report_lists", "report")])
def test_what_several_steps_read_is_computed_once(spark, name, table):
    assert any(f"/{table}-" in f for f in registry.QUERIES[name](spark, SF).inputFiles())


@pytest.mark.parametrize(("name", "keys"), [("a12_products_per_user", r"user_id#\d+L?, product_id#\d+L?"), ("t7_all_sorts", r"user_id#\d+L?")])
def test_tasks_take_so_many_rows_however_large_the_tables(spark, monkeypatch, name, keys):
    monkeypatch.setattr(roles, "TASK_ROWS", 100)
    tasks = -(-roles.table(spark, SF, "lineitem").count() // 100)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[{keys}\], {tasks}\b", plan)


def test_reports_move_the_history_and_the_tracked_pairs_by_products_only(spark, monkeypatch):
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return once(df, name)

    for module in (documents, tracking):
        monkeypatch.setattr(module, "once", spy, raising=False)
    last = registry.QUERIES["t6_report_lists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = {name: {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)} for name, plan in plans.items()}
    assert keys["facts"] == {"product_id"} and {"product_id"} <= keys["report"] <= {"product_id", "o_orderkey", "l_orderkey"}
    # Lines are read for the tracked pairs once, and not again for the lists.
    assert len(re.findall(r"FileScan parquet \[l_", plans["report"])) == 1 and "FileScan parquet [l_" not in last


def test_reports_of_repeated_parts_and_unknown_keys_are_the_sqls(spark, tmp_path):
    con = duckdb.connect()
    changed = {
        "part": "SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE p_partkey % 5 = 0 UNION ALL SELECT * REPLACE (NULL AS p_partkey) FROM {0} WHERE p_partkey < 3",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 40 END AS o_custkey) FROM {0} WHERE o_orderkey % 17 <> 0",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 60 END AS l_partkey) FROM {0}",
    }
    for name, sql in changed.items():
        con.execute(f"COPY ({sql.format(repr(f'{SF}/{name}.parquet'))}) TO '{tmp_path}/{name}.parquet'")
    for name in (*changed, "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path if name in changed else SF}/{name}.parquet'")
    want = Counter(con.execute(registry.ORACLE_SQL["t6_report_lists"]).fetchall())
    assert Counter(map(tuple, registry.QUERIES["t6_report_lists"](spark, str(tmp_path)).collect())) == want and max(want.values()) == 4


def test_the_shuffle_files_of_what_is_written_once_are_removed(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, settings = files(), spark.conf.get(REMOVES_SHUFFLES)
    try:
        for own in (None, "true", "false"):
            spark.conf.unset(REMOVES_SHUFFLES) if own is None else spark.conf.set(REMOVES_SHUFFLES, own)
            assert len(once(spark.range(1000).repartition(3, "id").groupBy("id").count(), "counts").collect()) == 1000
            assert spark.conf.get(REMOVES_SHUFFLES) == (own or settings)
            # Soon: the driver's garbage collection would remove them some time.
            for _ in range(10):
                if left := files() - before:
                    time.sleep(0.5)
            assert not left
    finally:
        spark.conf.unset(REMOVES_SHUFFLES)


def test_broader_queries_name_each_expression_once(spark):
    plan = spark.range(1).select(text.broader(F.lit("x").substr(F.col("id"), F.lit(9)))).select("*")._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp_replace", plan)) < 20


def test_retailers_by_one_pattern_are_those_by_each(spark):
    hosts = [f"{p}{d}{s}" for r in RETAILERS for d in r.domains for p in ("", "www.", "a.b.", "not") for s in ("", ".x")] + ["", "x", "ca"]
    by_each = F.coalesce(*(F.when(urls.host(F.col("u")).rlike(urls.hosts_pattern(r.domains)), r.name) for r in RETAILERS))
    df = spark.createDataFrame([(f"https://{h}/p",) for h in hosts] + [(None,), ("none",)], "u string").select("u", urls.retailer_of_url(F.col("u")).alias("got"), by_each.alias("want"))
    assert all(r.got == r.want for r in df.collect())
    plan = spark.range(1).select(urls.retailer_of_url(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("parse_url") <= 2


def test_answers_are_read_as_json_once(spark):
    answers = spark.range(1).select(F.col("id").alias("query_id"), F.col("id").cast("string").alias("text"))
    plan = feeds.judged_offers(answers).where("reason is not null").groupBy("reason").count()._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json|JsonToStructs|jsontostructs", plan)) + plan.lower().count("evaluate(") <= 2


def test_price_candidates_are_found_batch_by_batch(spark):
    found = registry.QUERIES["e1_price_candidates"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "EvalPythonUDTF" not in plan
    texts = [None, "", "x", "CA$12.50; US$1,234.00, 12.34 CAD and 1 234,56 $", "US$ 5 99.00 USD"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    by_row = df.lateralJoin(tables.price_candidates(F.col("t").outer())).select("i", "nth", "start", "stop", "value", "usd").collect()
    by_batch = df.select("i", F.posexplode(candidates(F.col("t"))).alias("nth", "c")).select("i", "nth", "c.*").collect()
    assert len(by_row) >= 5 and {tuple(r) for r in by_row} == {tuple(r) for r in by_batch}
