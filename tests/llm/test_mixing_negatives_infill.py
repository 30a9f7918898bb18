"""Mixing, hard negatives and fill-in-the-middle against plain Python, with nulls, repeats, ties and clashing names."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pricegrain.llm import infill, mixing, negatives

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
DOCS = "doc_id long, source string, text string, at int, finish string"


def aims(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets of {source: words}: excess is given to the others by weight until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(repeats * sizes[s] for s in full)
        heavy = sum(w for s, w in weight.items() if s not in full)
        over = {s for s in weight if s not in full and rest * weight[s] / heavy > repeats * sizes[s]}
        if not over:
            return {s: float(repeats * sizes[s]) if s in full else rest * weight[s] / heavy for s in weight}, weight
        full |= over


def plain_mix(rows):
    """{doc_id: (size, source_size, taken)} and targets, for rows of different doc_ids."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    total = defaultdict(int)
    for d, s, _ in rows:
        total[s] += size[d]
    target, weight = aims(total)
    copies = []
    for source in total:
        place = lambda d: (int(hashlib.md5(f"42:{'' if d is None else d}".encode()).hexdigest()[:15], 16), -1 if d is None else d)
        upto = 0
        for d in sorted((d for d, s, _ in rows if s == source), key=place):
            upto += size[d]
            copies += [((upto + k * total[source]) / weight[source], (source is None, source or ""), place(d), k, d) for k in range(2)]
    taken, words = dict.fromkeys(size, 0), 0
    for *_, d in sorted(copies):
        words += size[d]
        taken[d] += size[d] * (words <= 1.5 * sum(total.values()))
    return {d: (size[d], total[s], taken[d]) for d, s, _ in rows}, target


def mixture(n, seed=1):
    rng = random.Random(seed)
    source = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "B", "é", "", None, "zz"])
    text = lambda: None if rng.random() < 0.05 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 200])))
    return [(i, source(), text()) for i in range(n)]


def test_mix_matches_plain_python(spark):
    rows = [*mixture(400), (None, "a", "one two three"), (1000, "solo", None), (1001, "long", "x y\tz " * 5000)]
    want, target = plain_mix(rows)
    docs = spark.createDataFrame([(*r, 7, "own") for r in rows], DOCS)
    got = mixing.mix(docs).collect()
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in got} == want and len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    assert {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()} == {(r.doc_id, r.taken) for r in got}


def test_taken_words_come_near_targets_and_sources_alternate(spark):
    rows = mixture(1500, 2)
    docs = spark.createDataFrame([(*r, 7, "own") for r in rows], DOCS)
    got = mixing.mix(docs).collect()
    taken, target, most = defaultdict(int), {}, max(r.size for r in got)
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * most
    mix = mixing.mixed(docs).orderBy("at").collect()
    assert mix[0].finish == "own" and sum(len(WORD.findall(r.text or "")) for r in mix) == sum(taken.values())
    head = defaultdict(int)
    for r in mix:
        if r["at"] < 6000:
            head[r.source] += len(WORD.findall(r.text or ""))
    # Early in the mix no source has ended, and words are as the weights.
    weight = aims({s: 1 for s in target})[1]
    for s in target:
        assert abs(head[s] / 6000 - weight[s] / sum(weight.values())) < 0.08


def test_mix_takes_repeats_blanks_and_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None, 1, ""), (2, "a", " \n", 1, ""), (None, None, "", 1, "")], DOCS)
    assert sorted((r.doc_id or 0, r.size, r.target, r.taken) for r in mixing.mix(blank).collect()) == [(0, 0, 0.0, 0), (1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    same = spark.createDataFrame([(None, "a", "one two", 1, "")] * 40 + [(3, "a", "one two", 1, "")] * 2, DOCS)
    got = mixing.mix(same).collect()
    # One source: 1.5 times its 84 words, by whole documents.
    assert len(got) == 42 and sum(r.taken for r in got) == 126 and {r.taken for r in got} == {2, 4}
    assert mixing.mixed(same).count() == 63


def test_running_sums_go_on_over_ranges(spark):
    values = [(i * 7919 % 1009, i) for i in range(1000)]
    got = {r.v: r.s for r in mixing.running(spark.createDataFrame(values, "k long, v long").repartition(5), ["k", "v"], {"s": mixing.F.col("v")}).collect()}
    total = 0
    for _, v in sorted(values):
        total += v
        assert got[v] == total


def plain_negatives(rows, anchors, positives=5, most=5, low=80, high=100):
    known = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        known.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, v) in known.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in known.items() if i != a and len(w) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and low * -minus <= -100 * s[0] <= high * -minus][:most]
            out |= {(a, p, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(fit)}
    return out


def vectors(n, width=8, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("leaf", [4, 256])
def test_negatives_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    rows = vectors(900) + [(5000 + i, [0.5] * 8, i % 3) for i in range(300)]
    rows += [(6000, None, 1), (6010, [None] + [1.0] * 7, 1), (6020, [float("nan")] * 8, 1), (6030, [float("inf")] * 8, 1), (6040, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(7000, [1.0, 2.0], 1), (7001, [1.0, 2.5], 1), (7002, [1.0, 2.2], 2), (7010, [], 1), (40, [9.0] * 8, 3), (40, [9.0] * 8, 3), (41, [-9.0] * 8, 9)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, part int, block string").repartition(3)
    got = [tuple(r) for r in negatives.mine(frame, negatives.F.col("vec_id") % 10 == 0).collect()]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) > 300 and set(got) == want


def test_parts_and_blocks_leave_no_trace(spark, monkeypatch):
    rows = vectors(600, labels=500)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    for part, block in ((32_768, 8_192), (50, 16)):
        monkeypatch.setattr(negatives, "PART", part)
        monkeypatch.setattr(negatives, "BLOCK", block)
        assert {tuple(r) for r in negatives.mine(frame, negatives.F.col("vec_id") % 5 == 0).collect()} == want


def test_negatives_of_large_numbers_and_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 3e4).tolist(), i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in negatives.mine(frame, negatives.F.col("vec_id") % 10 == 0).collect()} == plain_negatives(rows, lambda i: i % 10 == 0)
    huge = [(i, [1e6 + i * 1e-3, 1.0], i % 2) for i in range(60)]
    frame = spark.createDataFrame(huge, schema)
    assert {tuple(r) for r in negatives.mine(frame, negatives.F.col("vec_id") % 10 == 0).collect()} == plain_negatives(huge, lambda i: i % 10 == 0)
    for few in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        frame = spark.createDataFrame(few, schema)
        assert negatives.mine(frame, negatives.F.col("vec_id") % 10 == 0).count() == 0


def test_nodes_out_of_the_window_are_not_searched(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 32)
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(4000, 2)) * 50)
    tree = negatives.Tree(np.arange(4000), np.zeros(4000, np.int64), rows.copy())
    asked = negatives.Asked(np.array([-1]), np.array([1]), rows[:1].copy(), np.array([100]), np.array([2000]), np.array([-(1 << 63)]), False)
    reached, exact = [], negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, b, kind: reached.append(len(b)) or exact(a, b, kind))
    _, ids, scores = negatives.search(tree, asked, 5)
    every = rows @ rows[0]
    best = sorted((-s, i) for i, s in enumerate(every) if 100 <= s <= 2000)[:5]
    assert sorted((-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))[:5] == best
    assert 0 < sum(reached) < 2000


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_matches_plain_python_and_restores(frame, corpus):
    rng = random.Random(9)
    odd = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c  aé😀<PSM>") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "a b c"), (None, None), (2000, "x <M> y"), (2001, "ab \n" * 700_000), (2002, "y" * 300_000), (2003, " " * 300_000), (2004, "<P"), (2005, "S>")]
    docs = frame(rows).withColumnRenamed("n_chars", "n").withColumnRenamed("lang", "form")
    made = infill.infilled(docs)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(made["output"], made["form"]).alias("back"), "text").collect()
    assert made.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(((r.doc_id or -1, *r[1:6]) for r in got), key=repr) == sorted(((d or -1, *plain_infill(d, t)) for d, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert infill.infilled(docs.limit(0)).count() == 0


def test_ranked_bits():
    rng = random.Random(4)
    for width in (1, 63, 64, 65, 1000, 5000):
        bits = rng.getrandbits(width) | 1 << rng.randrange(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [infill.place_of(bits, k + 1, width) for k in range(len(places))] == places
