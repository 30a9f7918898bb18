"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised items.

Both sides are lower-cased (A-Z) and cut into words, and words are numbers to the automaton. It holds
each window of ten words of each item, in flat arrays: a state is the number of its edge in the sorted
list of (state before, word), so that the list is the whole goto function, beside a failure link for
each state. A text is scanned once. The state after a word depends on the last ten words alone, so a
batch of texts is cut into lanes that begin ten words early, and all lanes take their steps together.
Hits are given as words, and as spans of characters of the original text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.llm.shared import byte_table, flat, forget, kept_for, runs, word_spans, written

WINDOW = 10
#: Bytes of benchmark text in one automaton: it takes some 25 bytes of memory for each of them, which is what is broadcast.
#: Of a larger benchmark each part of this size is scanned for on its own, and only the documents hit are written and merged.
AUTOMATON_BYTES = 24_000_000
#: Words of a lane, and bytes of text scanned at once.
LANE, CHUNK = 64, 2_000_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(65, 91))
_NORMAL = bytes(c + 32 if c in _UPPER else 32 if c in _SEPARATORS else c for c in range(256))
_WORD = byte_table(bytes(c for c in _SEPARATORS if c not in _UPPER))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


@dataclass
class Automaton:
    """State 0 is the root, state i the end of edge i - 1; keys are (state before << bits | word), in order.

    longest: words of the longest window that ends in a state (0: none); link: the next state down the
    failure links in which a window ends; cuts and items: the numbers of the items of each state's own window.
    """

    vocabulary: dict[bytes, int]
    names: list[str]
    bits: int
    keys: np.ndarray
    fail: np.ndarray
    longest: np.ndarray
    link: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    items: np.ndarray

    def edge(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states that the edges lead to; 0 where there is no edge."""
        key = (states.astype(np.int64) << self.bits) | word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0)

    def step(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; word 0 is none of the automaton's."""
        out = self.edge(states, word)
        todo = np.flatnonzero((out == 0) & (states != 0) & (word != 0))
        at = states[todo]
        while len(todo):
            at = self.fail[at]
            out[todo] = self.edge(at, word[todo])
            left = (out[todo] == 0) & (at != 0)
            todo, at = todo[left], at[left]
        return out

    def scan(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The state after each word of texts, one after the other; begin: where each text begins, and the end."""
        out = np.zeros(len(ids), np.int64)
        if not len(self.keys) or not len(ids):
            return out
        first = np.zeros(len(ids), bool)
        first[begin[:-1][begin[:-1] < len(ids)]] = True
        starts = np.arange(0, len(ids), LANE)
        states = np.zeros(len(starts), np.int64)
        for t in range(-WINDOW, LANE):
            at = starts + t
            live = (at >= 0) & (at < len(ids))
            lane, at = np.flatnonzero(live), at[live]
            before = np.where(first[at], 0, states[lane])
            states[lane] = self.step(before, ids[at])
            if t >= 0:
                out[at] = states[lane]
        return out


def build(items: list[tuple[str, bytes]]) -> Automaton:
    """The automaton of all windows of the items: level by level, all edges of a level at once."""
    vocabulary: dict[bytes, int] = {}
    names: list[str] = []
    number: dict[str, int] = {}
    texts, owners = [], []
    for name, text in items:
        found = words(text)
        if not found:
            continue
        if name not in number:
            number[name] = len(names)
            names.append(name)
        texts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in found), np.int32, len(found)))
        owners.append(number[name])
    bits = max(1, int(len(vocabulary)).bit_length())
    sizes = np.array([len(t) for t in texts], np.int64)
    stream = np.concatenate(texts) if texts else np.zeros(0, np.int32)
    begin = np.r_[0, np.cumsum(sizes)]
    # A window begins at each word that has nine more behind it, and at the first word of a shorter item.
    size = np.minimum(sizes, WINDOW)
    count = sizes - size + 1
    owner = np.repeat(np.array(owners, np.int64), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[:-1], count)
    length = np.repeat(size, count)
    state = np.zeros(len(first), np.int64)
    keys, last = [], 0
    final = np.zeros(len(first), np.int64)
    for depth in range(WINDOW):
        live = np.flatnonzero(length > depth)
        if not len(live):
            break
        level, inverse = np.unique((state[live] << bits) | stream[first[live] + depth], return_inverse=True)
        keys.append(level)
        state[live] = inverse + last + 1
        last += len(level)
        ended = live[length[live] == depth + 1]
        final[ended] = state[ended]
    every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    out = Automaton(vocabulary, names, bits, every, np.zeros(last + 1, np.int32), np.zeros(last + 1, np.int8), np.zeros(last + 1, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32))
    out.longest[final] = length
    out.longest[0] = 0
    # Failure links and what ends below, level by level: those of shorter words are ready before.
    at = 1
    for depth, level in enumerate(keys):
        here = np.arange(at, at + len(level))
        if depth:
            before = level >> bits
            out.fail[here] = out.step(out.fail[before].astype(np.int64), level & ((1 << bits) - 1))
        below = out.fail[here]
        out.link[here] = np.where(out.longest[below] > 0, np.where(_ends_here(out, below), below, out.link[below]), 0)
        out.longest[here] = np.maximum(out.longest[here], out.longest[below])
        at += len(level)
    pairs = np.unique((final << 32) | owner) if len(final) else np.zeros(0, np.int64)
    out.ends, start = np.unique(pairs >> 32, return_index=True)
    out.cuts, out.items = np.r_[start, len(pairs)].astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int32)
    return out


def _ends_here(automaton: Automaton, states: np.ndarray) -> np.ndarray:
    """Whether a window ends in the state itself, and not only below it."""
    return automaton.longest[states] > automaton.longest[automaton.fail[states]]


def hits(automaton: Automaton, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Of a run of texts: which words stand in an occurrence of a window, where each text's words begin, and the items of those windows."""
    raw, ends = data.tobytes().translate(_NORMAL), at.tolist()
    found = [raw[a:b].split() for a, b in zip(ends, ends[1:], strict=False)]
    begin = np.r_[0, np.cumsum([len(w) for w in found], dtype=np.int64)]
    of = automaton.vocabulary.get
    ids = np.fromiter((of(w, 0) for own in found for w in own), np.int64, int(begin[-1]))
    states = automaton.scan(ids, begin)
    size = automaton.longest[states].astype(np.int64)
    ended = np.flatnonzero(size)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, ended + 1 - size[ended], 1)
    np.add.at(step, ended + 1, -1)
    names: list[list[str]] = [[] for _ in found]
    # Each state that a text reached once, then all windows that end there.
    text = np.searchsorted(begin, ended, "right") - 1
    pairs = np.unique((text << 32) | states[ended])
    text, state = pairs >> 32, pairs & 0xFFFFFFFF
    state = np.where(_ends_here(automaton, state), state, automaton.link[state])
    sets: dict[int, set[int]] = {}
    while len(state):
        place = np.searchsorted(automaton.ends, state)
        for t, p in zip(text.tolist(), place.tolist(), strict=True):
            sets.setdefault(t, set()).update(automaton.items[automaton.cuts[p] : automaton.cuts[p + 1]].tolist())
        state = automaton.link[state]
        pairs = np.unique((text[state > 0] << 32) | state[state > 0])
        text, state = pairs >> 32, pairs & 0xFFFFFFFF
    for t, own in sets.items():
        names[t] = sorted(automaton.names[i] for i in own)
    return np.cumsum(step[:-1]) > 0, begin, names


_OWN = ("n_words", "n_hit", "marks", "items")


def _scanner(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("decontamination")
        automaton = broadcast.value
        for batch in batches:
            data, at = flat(batch.column("text"))
            marks, names, counts, sums = [], [], [], []
            for a, b in runs(at, CHUNK):
                hit, begin, own = hits(automaton, data[at[a] : at[b]], at[a : b + 1] - at[a])
                total = np.r_[0, np.cumsum(hit)]
                names += own
                counts.append(np.diff(begin))
                sums.append(total[begin[1:]] - total[begin[:-1]])
                marks += [np.packbits(hit[x:y]).tobytes() if n else b"" for x, y, n in zip(begin[:-1].tolist(), begin[1:].tolist(), sums[-1].tolist(), strict=True)]
            counts, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, sums))
            own = [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *_OWN])

    return scan


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put together what the parts of a large benchmark hit in each text."""
    for batch in batches:
        counts, sums, marks, names = [], [], [], []
        texts = batch.column("text")
        for text, parts in zip(texts, batch.column("parts").to_pylist(), strict=True):
            n = len(words((text.as_py() or "").encode()))
            hit = np.zeros(n, bool)
            for p in parts or ():
                hit |= np.unpackbits(np.frombuffer(p["marks"], np.uint8), count=n).astype(bool)
            counts.append(n)
            sums.append(int(hit.sum()))
            marks.append(np.packbits(hit).tobytes() if hit.any() else b"")
            names.append(sorted({x for p in parts or () for x in p["items"]}))
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "parts"]
        own = [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*rest, *own], [*[n for n in batch.schema.names if n != "parts"], *_OWN])


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in characters of the text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _WORD)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        raw, at = data.tobytes(), at.tolist()
        out = []
        for a, b, mark, n in zip(at, at[1:], batch.column("marks").to_pylist(), batch.column("n_words").to_pylist(), strict=False):
            hit = np.unpackbits(np.frombuffer(mark, np.uint8), count=n).astype(bool) if mark else None
            out.append([{"start": s, "end": e} for s, e in original_spans(raw[a:b], hit)] if mark else [])
        spans = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), spans], [*batch.schema.names, "spans"])


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """An item in parts of about `most` bytes that share nine words, so that every window lies in one."""
    if len(text) <= most:
        yield text
        return
    found, a = words(text), 0
    while a < len(found):
        b, size = a, 0
        while b < len(found) and (size <= most or b - a < 2 * WINDOW):
            size += len(found[b]) + 1
            b += 1
        yield b" ".join(found[a:b])
        if b == len(found):
            return
        a = b - WINDOW + 1


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, text in rows.toLocalIterator():
        for raw in _parts(text.encode(), AUTOMATON_BYTES):
            if block and size + len(raw) > AUTOMATON_BYTES:
                yield block
                block, size = [], 0
            block.append((name, raw))
            size += len(raw)
    yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """Columns of docs, of which doc_id and text are used, with n_words, n_hit, marks (a bit a word) and items.

    With spans, also spans: (start, end) in characters of the text of each run of hit words. Columns of
    docs with one of these names are replaced. A null text has no words. An item without words has no
    window; items with equal ids are one; a null id is the empty string. Rows that repeat are rows of
    their own with equal results; an empty table gives an empty result. The driver holds AUTOMATON_BYTES
    of the benchmark at a time, and their automaton. Up to that size the texts are scanned once; for each
    further part they are scanned again, and only (row, marks, items) of documents hit are written.
    """
    spark = docs.sparkSession
    state = docs.drop(*_OWN, "spans")
    own = T._parse_datatype_string("n_words long, n_hit long, marks binary, items array<string>").fields
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in state.schema.fields), *own])
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        state = state.mapInArrow(_scanner(spark.sparkContext.broadcast(build(first))), schema)
    else:
        key = F.xxhash64("text").alias("row")
        texts, found = docs.select("text", key).where("text is not null"), []
        inner = T.StructType([T.StructField("text", T.StringType()), T.StructField("row", T.LongType()), *own])
        for block in _chained(first, second, blocks):
            broadcast = spark.sparkContext.broadcast(build(block))
            # Equal texts have equal hits; only one row of each counts.
            found.append(written(texts.mapInArrow(_scanner(broadcast), inner).where("n_hit > 0").groupBy("row", F.xxhash64("text", F.lit(1)).alias("other")).agg(F.first(F.struct("marks", "items")).alias("part")), "hits"))
            broadcast.destroy()
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        parts = written(every.groupBy("row", "other").agg(F.collect_list("part").alias("parts")), "hits")
        forget(*found)
        rest = F.struct(*(c for c in state.columns if c != "text")).alias("rest")
        joined = state.select(rest, "text", key, F.xxhash64("text", F.lit(1)).alias("other")).join(parts.hint("shuffle_hash"), ["row", "other"], "left").select("rest", "text", "parts")
        merged = joined.mapInArrow(_merger, T.StructType([*joined.schema.fields[:2], *own]))
        state = merged.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in state.columns), *_OWN)
    if spans:
        state = state.mapInArrow(_spans, T.StructType([*schema.fields, *T._parse_datatype_string("spans array<struct<start:long,end:long>>").fields]))
    return state


def _chained(first: list, second: list, rest: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from rest


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of each document."""
    return find_passages(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold any window of an item; all columns stay as they are."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")
    found = find_passages(docs.select(rest, "text"), benchmark).where("n_hit = 0")
    return found.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
