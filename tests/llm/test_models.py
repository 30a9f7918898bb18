"""Trained operators: held-out accuracy, plain recomputation of scores, and recall against brute force."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pricegrain.llm import ann, langid, queries, toxicity
from pricegrain.llm.shared import table

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_on_held_out_documents(spark):
    rows = queries.op1_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in judged) >= 0.92 * len(judged)


def plain_score(model, text):
    """The score by loops over bytes."""
    data = [b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in (text or "").encode()]
    mask, found = (1 << 64) - 1, set()
    for n in toxicity.SIZES:
        for i in range(len(data) - n + 1):
            h = data[i]
            for b in data[i + 1 : i + n]:
                h = (h * 0x100000001B3 + b) & mask
            h = ((h + n) * 0x9E3779B97F4A7C15) & mask
            found.add((h ^ h >> 29) >> (64 - toxicity.BITS))
    return 1 / (1 + math.exp(-max(-500, min(500, sum(float(model.weights[f]) for f in found) + model.bias))))


def test_toxicity_scores_whole_texts(spark, frame, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 500)
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()] + [None, "", "a", "ab", "éß" * 300, "idiot " * 2_000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.score for r in toxicity.score(frame(rows), model).collect()}
    assert all(abs(got[d] - plain_score(model, t)) < 1e-6 for d, t in rows)


def test_toxicity_without_two_classes(spark, frame):
    labels = spark.createDataFrame([(0, None), (2, 0)], "doc_id long, toxic int")
    docs = frame([(0, "a b"), (2, "c"), (3, None)])
    assert {r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {True}
    assert toxicity.without_toxic(docs, labels).count() == 3
    empty = frame([])
    assert toxicity.without_toxic(empty, labels).count() == 0


def test_toxicity_ignores_held_out_labels(spark, frame):
    ids = [i for i in range(200) if held_out(i)]
    rows = toxicity.training_rows(frame([(i, "x") for i in range(200)]), spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, 1), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxic for r in rows.collect()}
    assert not set(got) & set(ids) and len(got) == 200 - len(ids) and got[0] == 1


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = queries.op7_language(spark, SF).collect()
    judged = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.98 * len(judged)


def test_language_of_odd_texts(spark, frame):
    filters = langid.fit(table(spark, SF, "documents"))
    texts = [None, "", "1234 !?", "é", "the and of", "der und nicht die der und das", "日本"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(list(enumerate(texts))), filters).collect()}
    assert [got[i] for i in range(3)] == ["und"] * 3
    assert got[4] == "en" and got[5] == "de" and got[3] in filters.languages and got[6] in filters.languages
    nothing = langid.identify(frame([(1, "abc")]), langid.fit(frame([]))).first()
    assert nothing.lang_pred == "und"


def plain_language(docs, text):
    """The share of each language's n-grams in a text, by sets of bytes."""
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in t.encode())
    grams = lambda t: [(n, t[i : i + n]) for n in langid.SIZES for i in range(len(t) - n + 1)]
    counts = defaultdict(lambda: defaultdict(int))
    for d, t, lang in docs:
        if lang is not None and t is not None and not held_out(d):
            for g in grams(fold(t)):
                counts[lang][g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    best = {g: max(counts[x].get(g, 0) / total[x] for x in counts) for x in counts for g in counts[x]}
    known = {x: {g for g, n in counts[x].items() if n / total[x] >= langid.SHARE * best[g] and n >= langid.LEAST} for x in counts}
    own = grams(fold(text))
    return {x: sum(g in known[x] for g in own) / max(1, len(own)) for x in sorted(counts)}


def test_language_matches_plain_sets(spark):
    rng = np.random.default_rng(6)
    letters = {"aa": "abcdefghijk", "bb": "fghijklmnop", "cc": "kéüñlmnopqr"}
    word = lambda x: "".join(rng.choice(list(letters[x]), rng.integers(2, 7)))
    docs = [(i, " ".join(word(x) for _ in range(40)), x) for i, x in enumerate(rng.choice(list(letters), 90).tolist())]
    frame = spark.createDataFrame([*docs, (500, None, "aa"), (501, "x y", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, langid.fit(frame)).collect()}
    for d, text, _ in docs[:30]:
        share = plain_language(docs, text)
        best = max(share, key=share.get)
        assert got[d].lang_pred == best
        assert abs(got[d].score - share[best] / sum(share.values())) < 0.01


def test_language_filter_keeps_the_most_frequent_grams(monkeypatch):
    monkeypatch.setattr(langid, "MOST_GRAMS", 10)
    assert langid._floors([("a", 9, 3), ("a", 5, 6), ("a", 4, 2), ("b", 3, 30), ("b", 7, 2), ("c", 1, 50), ("c", 2, 4)]) == {"a": 5, "b": 7, "c": 2}


@pytest.mark.parametrize("each", [1, 2, 3, 10])
def test_toxicity_tells_few_labelled_texts_apart(frame, spark, each):
    rng = np.random.default_rng(each)
    ids = [i for i in range(200) if not held_out(i)][: 2 * each]
    word = lambda: "".join(rng.choice(list("aeioustnr"), 5))
    docs = frame([(d, " ".join(word() for _ in range(12)) + (" you idiot" if k % 2 else "")) for k, d in enumerate(ids)])
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[d] >= toxicity.THRESHOLD) == bool(k % 2) for k, d in enumerate(ids))


def test_language_brings_only_kept_grams_to_the_driver(spark, frame, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["the same words " * 3 + "".join(rng.choice(list("bcdfghjklm"), 60)) for _ in range(40)]
    docs, brought = frame(list(enumerate(texts))), []
    whole = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: brought.append(whole(df)) or brought[-1])
    filters = langid.fit(docs)
    every = set()
    for i, text in enumerate(texts):
        if not held_out(i):
            every |= {text[a : a + n] for n in langid.SIZES for a in range(len(text) - n + 1)}
    assert filters.languages == ["en"] and 0 < sum(x.num_rows for x in brought) < len(every) / 2


def test_scores_of_tables_with_repeats_clashing_columns_and_long_texts(spark):
    schema = "doc_id long, text string, lang string, score string, toxic string, n int"
    rows = [(1, "the and of " * 40_000, "en", "s", "t", 1), (1, "the and of", "en", "s", "t", 1), (1, "the and of", "en", "s", "t", 1), (None, "der und", "de", "s", "t", 2), (2, None, None, "s", "t", 3)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id long, toxic int")
    filters = langid.fit(table(spark, SF, "documents"))
    assert sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, filters).collect()) == [(0, "de"), (1, "en"), (1, "en"), (1, "en"), (2, "und")]
    assert langid.identify(docs.limit(0), filters).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(rows)


def test_filters_hold_all_their_grams_for_many_languages():
    names = [f"l{i:03}" for i in range(130)]
    filters = langid.Filters(names, np.zeros((3, 1 << 12), np.uint64), np.zeros(130))
    rng = np.random.default_rng(0)
    grams = {i: rng.integers(0, 1 << 63, 5, dtype=np.uint64) for i in range(130)}
    for lang, values in grams.items():
        word, bit = divmod(lang, 64)
        for at in filters.positions(values):
            filters.words[word, at.astype(np.int64)] |= np.uint64(1) << np.uint64(bit)
    for lang, values in grams.items():
        word, bit = divmod(lang, 64)
        assert ((filters.lookup(values)[word] >> np.uint64(bit)) & np.uint64(1)).all()


def brute(vectors, k):
    rows = {i: np.array(v, np.float64) for i, v in vectors if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in rows.items():
        if q % 20 == 0:
            out[q] = sorted(((-(y * x).sum(), i) for i, y in rows.items() if i != q))[:k]
    return out


def test_nearest_is_exact_on_small_tables_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    hot = rng.normal(size=8).astype(np.float32).tolist()
    vectors += [(1000 + i, hot) for i in range(90)]
    vectors += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0, 2.0]), (None, hot), (2100, [float("inf")] * 8)]
    table_ = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(table_, table_.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert dict(got) == brute(vectors, 20)


def test_nearest_takes_the_least_of_several_vectors_of_one_id_and_can_be_exact(spark):
    rng = np.random.default_rng(14)
    points = rng.normal(size=(1200, 8)).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    other = [(20, [9.0] * 8), (20, [9.0] * 8), (33, [-9.0] * 8)]
    frame = spark.createDataFrame(rows + other, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), settings=ann.Settings(vectors_per_list=10, probes=2), exact=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    least = dict(rows)
    for i, v in other:
        least[i] = min(least[i], v)
    assert dict(got) == brute(list(least.items()), 20)


def test_nearest_with_few_candidates_or_none(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (3, [2.0, 0.0], 1)], schema)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, few.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    none = spark.createDataFrame([], schema)
    assert ann.search(none, none).count() == 0


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_nearest_recall(spark, scale):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16)) * scale
    points = (centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    settings = ann.Settings(vectors_per_list=30, probes=64)
    got = defaultdict(set)
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), settings=settings).collect():
        got[r.query_id].add(r.vec_id)
    wide, hits = points.astype(np.float64), 0
    for q in range(0, 6000, 20):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 300


def test_nearest_reads_more_lists_where_the_first_probes_miss_neighbours(spark):
    points = np.random.default_rng(11).normal(size=(4000, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), settings=ann.Settings(vectors_per_list=8, probes=4)).collect():
        got[r.query_id].add(r.vec_id)
    wide, hits = points.astype(np.float64), 0
    for q in range(0, 4000, 20):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200
