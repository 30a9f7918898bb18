"""Pairs of titles and groups by founders against plain Python, with hot words, copies and odd rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_pages import plain_same

from pricegrain.functions import text
from pricegrain.operators import clusters, similar

WORDS = ["harrow", "lantern", "meadow", '21"', "28 inch", "carry-on", "large", "black", "2", "3", "360", "cover", "brindle", "quill", "tarn", "sorrel", "check-in", "medium"]


def titles(rng, n, most=6):
    return [" ".join(rng.sample(WORDS, rng.randint(0, most))) for _ in range(n)]


def identities(df):
    rows = df.select("query_id", "seq", clusters.identity(text.without_stores(F.coalesce("title", F.lit("")))).alias("i")).collect()
    return {(r.query_id, r.seq): r.i.asDict() for r in rows}


def plain_homes(ids):
    want = {}
    for q in {q for q, _ in ids}:
        founders = []
        for s in sorted(s for a, s in ids if a == q):
            home = next((f for f in founders if plain_same(ids[q, f], ids[q, s])), None)
            if home is None:
                founders.append(s)
            want[q, s] = s if home is None else home
    return want


@pytest.mark.parametrize("seed", range(2))
def test_founders_by_index_are_those_of_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(q, i, t) for q in range(6) for i, t in enumerate(titles(rng, 150))]
    # Titles of numbers alone join the brands that have these numbers, and others stay apart.
    rows += [(50, i, t) for i, t in enumerate(["harrow 360 quill", "360", "lantern 360", "360 2", "2", None, "", "meadow tarn", "meadow tarn", "3 777", "sorrel 777", "777 3"])]
    df = spark.createDataFrame(rows, "query_id int, seq int, title string").repartition(5)
    want = plain_homes(identities(df))
    assert {(r.query_id, r.seq): r.founder for r in clusters.clusters(df).collect()} == want
    assert 100 < len(set(want.items())) and any(q != s for (_, q), s in want.items())


def test_founders_by_colour_with_a_brand_and_over_batches(spark):
    rng = random.Random(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles(rng, 120))], "query_id int, seq int, title string")
        assert {(r.query_id, r.seq): r.founder for r in clusters.clusters(df).collect()} == plain_homes(identities(df))
        coloured = spark.createDataFrame([(1, 0, "harrow tarn black"), (1, 1, "harrow tarn"), (1, 2, "harrow black tarn"), (1, 3, "tarn")], "query_id int, seq long, title string")
        assert {r.seq: r.founder for r in clusters.clusters(coloured, by_colour=True).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
        assert {r.seq: r.founder for r in clusters.clusters(coloured, brand="Harrow").collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert clusters.clusters(coloured.limit(0)).count() == 0


def test_an_offer_is_compared_with_few_founders(monkeypatch):
    compared = []
    fits = clusters._Founders._fits
    monkeypatch.setattr(clusters._Founders, "_fits", lambda self, a, b: compared.append(1) or fits(self, a, b))
    for n in (1_000, 4_000):
        compared.clear()
        founders = clusters._Founders(False)
        for i in range(n):
            # The brand is in all titles and a line's name in many; copies come after.
            words = [{"n": 1, "word": f"model{i}x"}, {"n": 2, "word": f"series{i // 2}x"}, {"n": 50, "word": f"line{i // 2 % 20}"}, {"n": n, "word": "brand"}]
            e = {"ranked": words, "brand": "brand", "accessory": False, "size": "", "colour": "", "sizes": [], "numbers": []}
            assert founders.home(i, e) == (i if i % 2 == 0 else i - 1)
            assert founders.home(n + i, e) == (i if i % 2 == 0 else i - 1)
        assert len(compared) <= n


@pytest.mark.parametrize(("cell", "group"), [(4_096, []), (3, ["query_id"])])
def test_similar_titles_are_those_of_a_nested_loop(spark, monkeypatch, cell, group):
    monkeypatch.setattr(similar, "CELL", cell)
    rng = random.Random(cell)
    # A word that stands in all titles, one title that is nothing but it, titles of one word, copies and titles without any.
    values = ["brindle " + t for t in titles(rng, 150)] + ["brindle", "brindle", "harrow", "Harrow", "", None, "360", "luggage", "lantern 28 inch", "quill lantern tarn 28 inch"]
    rows = [(i, rng.randint(0, 2), t) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, query_id int, title string").repartition(4)
    classes = similar.title_classes(df, group)
    ids = identities(df.select("query_id", F.col("id").alias("seq"), "title"))
    of = {i: (q, ids[q, i]) for i, q, _ in rows}
    part = lambda i: (of[i][0],) if group else ()
    same_identity = lambda a, b: part(a) == part(b) and all(sorted(of[a][1][f]) == sorted(of[b][1][f]) for f in ("words", "sizes", "numbers")) and all(of[a][1][f] == of[b][1][f] for f in ("brand", "size", "accessory"))
    rep = {i: min(j for j in of if same_identity(i, j)) for i in of}
    assert {r.id: r.rep for r in classes.collect()} == rep
    reps = sorted(set(rep.values()))
    want = {(*part(a), a, b) for a in reps for b in reps if a < b and part(a) == part(b) and plain_same(of[a][1], of[b][1])}
    got = [tuple(r) for r in similar.similar_titles(classes, group).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert similar.similar_titles(similar.title_classes(df.limit(0), group), group).count() == 0


def test_prefixes_of_titles(spark):
    sizes = spark.range(1, 12)
    got = sizes.select(similar.prefix(F.col("id"), 0.6).alias("alike"), similar.prefix(F.col("id"), 0.85, 3).alias("inside")).collect()
    assert [r.alike for r in got] == [1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5]
    assert [r.inside for r in got] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert [clusters._looked_at(n) for n in range(1, 12)] == [r.alike for r in got]
