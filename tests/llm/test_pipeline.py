"""The pipeline against a plain version of each stage, on whole small tables."""

import numpy as np
import pyarrow as pa
from test_models import plain_score
from test_text_operators import line_dedup, passages, shingles

import corpus_pipeline
from pricegrain.llm import simhash, toxicity
from pricegrain.llm.shared import table
from pricegrain.llm.tokens import Encoder, default_tokenizer

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_stages(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if plain_score(model, t) < toxicity.THRESHOLD]
    kept = {d: x[0] for d, x in line_dedup(rows).items()}
    sets = {d: set(shingles(t, 5)) for d, t in kept.items()}
    similar = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    gone = {d for d in kept if any(c < d and similar(sets[c], sets[d]) >= 0.8 for c in kept)}
    assert gone
    kept = {d: t for d, t in kept.items() if d not in gone}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = passages(list(kept.items()), items)
    want = {d: t for d, t in kept.items() if not hit[d][1]}
    got = corpus_pipeline.run(spark, SF).collect()
    encoder, lengths = Encoder(default_tokenizer()), {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {d: len(encoder.encode(pa.array([t]))[0]) + 1 for d, t in want.items()}
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.1 * sum(fill.values()) / 1024 + 1


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_take_empty_and_odd_documents(spark, frame):
    rows = [(None, "x y z"), (None, None), (1, None), (1, None), (2, ""), (3, "\n"), (4, "word " * 3000)]
    for docs in (frame([]), frame(rows)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), SF).collect()} == {None, 1, 4}


def test_only_hashes_that_several_texts_have_are_joined(spark):
    rows = [(1, 3, [5, 6, 7]), (2, 3, [6, 8, 9]), (2, 3, [6, 8, 9]), (3, 1, [10]), (3, 1, [10])]
    shared = simhash._shared(spark.createDataFrame(rows, "node long, n int, prefix array<long>")).collect()
    assert sorted(tuple(r) for r in shared) == [(6, 1, 3, 1), (6, 2, 3, 0)]


def test_texts_are_not_moved_for_few_ids_and_many_give_the_same(spark, frame, corpus, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = simhash.without_near_duplicates(frame(corpus))
    monkeypatch.setattr(simhash, "FEW", 0)
    many = simhash.without_near_duplicates(frame(corpus))
    assert "ShuffledHashJoin" not in plan(few) and "ShuffledHashJoin" in plan(many)
    assert 0 < few.count() < len(corpus) and {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()}


def test_parities_rule_out_no_pair_that_is_similar(spark):
    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 5, 33, 200, 260, 3000):
        base = rng.integers(0, 1 << 63, n).tolist()
        sets += [base, base[: n * 9 // 10], base[: n * 4 // 5], base[: n // 2], [*base[: n // 2], *rng.integers(0, 1 << 63, n - n // 2).tolist()]]
    rows = [(i, len(set(x)), simhash.parities_of(x).tolist()) for i, x in enumerate(sets)]
    unlike = lambda a, b: len(set(a) ^ set(b))
    assert all(simhash.differing(simhash.parities_of(a), simhash.parities_of(b)) <= unlike(a, b) for a in sets for b in sets)
    sizes = [len(set(x)) for x in sets]
    asked = [(i, j) for i in range(len(sets)) for j in range(i) if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])]
    found = {(r.node, r.head) for r in simhash._not_apart(spark.createDataFrame(asked, "node long, head long"), spark.createDataFrame(rows, "node long, n int, parities array<long>"), 0.8).collect()}
    due = {(i, j) for i, j in asked if 9 * unlike(sets[i], sets[j]) <= sizes[i] + sizes[j]}
    assert due <= found and len(due) > 30 and len(found) <= 1.1 * len(due) < len(asked)
