"""Near-duplicate documents by SimHash fingerprints, found by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits are cut into two segments of 32 bits:
one of these then differs in at most one bit. (For at most five bits it is three segments, and so on.)
Each segment is indexed under its variants in which one bit is a wildcard, so both fingerprints meet in
some variant by equality; the whole fingerprints are then compared.

Sets of shingles that are 0.8 similar differ in more bits than that more often than not. So where
similar documents are dropped, least hashes of the same shingles bring candidates too, and every
candidate of either kind is judged by its shingles themselves. Few candidates of each document are looked
at so; what does not go by them is joined with all earlier documents exactly, by prefixes: sets of n
shingles, in any one order, share one of their first n - ceil(0.8 n) + 1 if they are 0.8 similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.components import components
from pricegrain.llm.shared import BLANK, flat, forget, kept_for, partitions, written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FOLD = bytes(32 if c in BLANK else b for c, b in enumerate(_LOWER))
_LANES = np.uint64(0x0101010101010101)
#: Bands of least hashes, and how many make one: sets that are 0.8 similar share one of these bands with a probability of 0.986.
BANDS, IN_BAND = 14, 6
#: How many documents that share bands with one are compared with it first; those left are joined with all.
HEADS = 3
#: Shingles that several sampled documents have come last in the order of prefixes, rarer ones first, at most MOST_COMMON of them. One document in ONE_IN
#: is sampled (more if that is less than SAMPLED), so that what counts as common is a number of documents, whatever the input. The sample decides the cost only.
ONE_IN, SAMPLED, SEVERAL, MOST_COMMON = 16, 2_000, 3, 300_000
#: The order of prefixes in one number: how common a shingle is stands in the upper bits, a hash of it below.
_LEVEL_AT = np.uint64(57)
#: Tables of at most so many ids are sent to all executors instead of moving the texts they are joined with.
FEW = 250_000
_ODD = np.random.default_rng(SEED).integers(1 << 62, dtype=np.uint64, size=(BANDS * IN_BAND, 1)) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of size words; of the whole sequence if it is shorter; none without words."""
    words = text.translate(_FOLD).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; zero without hashes.

    Bits are counted eight to a word: bytes of 255 summed values cannot overflow.
    """
    if not hashes:
        return 0
    values, counts = np.array(hashes, np.uint64), np.zeros((8, 8), np.int64)
    cuts = np.arange(0, len(values), 255)
    for bit in range(8):
        sums = np.add.reduceat((values >> np.uint64(bit)) & _LANES, cuts)
        counts[bit] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    on = 2 * counts.T.reshape(64) > len(values)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def bands_of(hashes: list[int]) -> np.ndarray:
    """BANDS numbers, each of IN_BAND least hashes of the set; none without hashes."""
    if not hashes:
        return np.zeros(0, np.int64)
    values = np.array(hashes, np.uint64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        mixed = _ODD * values[at : at + 4096]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        np.minimum(least, mixed.min(1), out=least)
    bands = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, IN_BAND).T:
        bands = (bands ^ column) * _MIX
        bands ^= bands >> np.uint64(29)
    return bands.view(np.int64)


def prefix_of(hashes: list[int], similarity: float, common: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different hashes there are, and the first in an order that puts common ones (sorted) last, by their levels (1 to 63): as many as a set so similar may miss, and one more.

    Without hashes it is one number, so that texts without a word meet.
    """
    values = np.unique(np.array(hashes, np.uint64))
    if not len(values):
        return 0, np.zeros(1, np.int64)
    order = (values * _ODD[0]) ^ (values >> np.uint64(31))
    order >>= np.uint64(64) - _LEVEL_AT
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        order |= np.where(common[at] == values, levels[at].astype(np.uint64) << _LEVEL_AT, np.uint64(0))
    first = len(values) - math.ceil(len(values) * similarity - 1e-9) + 1
    first = min(first, len(values))
    order = np.partition(order, first - 1)[:first]
    order.sort()
    return len(values), order.view(np.int64)


def parities_of(hashes: list[int]) -> np.ndarray:
    """Of each of some bits, twice as many as there are different hashes or more, whether an odd number of these fall on it; 64 bits to a word.

    Every bit in which two sets differ needs a hash that only one of them has.
    """
    values = np.unique(np.array(hashes, np.uint64))
    bits = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two parities_of() differ, the longer one folded to the shorter: no more than the sets have hashes that the other has not."""
    words = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, words), 0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The different shingles of each text."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        raw, at = data.tobytes(), at.tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(shingle_hashes(raw[a:b], size), np.uint64)).view(np.int64))], ["shingle"])


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of SEVERAL documents of a sample, sorted, and how common each is: four times the logarithm of their number.

    With a sample of a fixed size a shingle that is not common would have more and more documents as the
    input grows, and the pairs that meet by it would grow with the square.
    """
    step = min(max(docs.count() // SAMPLED, 1), ONE_IN)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    counts = some.mapInArrow(partial(_shingled, size=size), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= SEVERAL)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    common, n = rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], np.minimum(4 * np.log2(n[order]), 63).astype(np.uint8)


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, banded: bool, similarity: float, common: np.ndarray, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    kept_for("simhash")
    for batch in batches:
        data, at = flat(batch.column("text"))
        raw, at = data.tobytes(), at.tolist()
        prints, bands, prefixes, parities = np.zeros(len(at) - 1, np.uint64), [], [], []
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            hashes = shingle_hashes(raw[a:b], size)
            prints[i] = fingerprint(hashes)
            if banded:
                bands.append(bands_of(hashes))
                prefixes.append(prefix_of(hashes, similarity, common, levels))
                parities.append(parities_of(hashes))
        names = [n for n in batch.schema.names if n != "text"]
        columns = [*(batch.column(n) for n in names), pa.array(prints.view(np.int64))]
        if banded:
            longs = pa.list_(pa.int64())
            columns += [pa.array(bands, longs), pa.array([n for n, _ in prefixes], pa.int32()), pa.array([x for _, x in prefixes], longs), pa.array(parities, longs)]
            names += ["fp", "bands", "n", "prefix", "parities"]
        else:
            names += ["fp"]
        yield pa.RecordBatch.from_arrays(columns, names)


def fingerprints(docs: DataFrame, size: int = SHINGLE, banded: bool = False, similarity: float = 1.0) -> DataFrame:
    """(doc_id, one, two, fp) of every document, and bands, n, prefix_of() and parities where asked for; fp is the fingerprint as a signed long, one and two tell texts apart.

    Null and wordless texts have the fingerprint zero and no band.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"), "text")
    common, levels = _common(docs, size) if banded else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    run = partial(_fingerprints, size=size, banded=banded, similarity=similarity, common=common, levels=levels)
    return texts.mapInArrow(run, "doc_id long, one long, two long, fp long" + ", bands array<long>, n int, prefix array<long>, parities array<long>" * banded)


def _links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints, as two arrays of places.

    Breadth first: each fingerprint reached is compared with those not yet reached, so the memory
    needed is one row of comparisons, and no pair within a reached group is emitted twice.
    """
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= most
            if near.any():
                found = rest[near]
                left += [at] * len(found)
                right += found.tolist()
                queue += found.tolist()
                rest = rest[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def _bucket_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of rows sorted by bucket; a bucket may go on in the next batches, which are put together once."""
    held: list[list[np.ndarray]] = []

    def closed(columns: list[np.ndarray]) -> pa.RecordBatch:
        bit, masked, fps, docs = columns
        new = np.flatnonzero(np.r_[True, (bit[1:] != bit[:-1]) | (masked[1:] != masked[:-1])])
        size = np.diff(np.r_[new, len(bit)])
        pairs = new[size == 2]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= most]
        us, vs = [docs[pairs]], [docs[pairs + 1]]
        for first, count in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = _links(fps[first : first + count], most)
            us.append(docs[first + a])
            vs.append(docs[first + b])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        columns[2] = columns[2].view(np.uint64)
        last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if held and not cut and (held[-1][0][-1], held[-1][1][-1]) != (columns[0][0], columns[1][0]):
            yield closed([np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
        if cut:
            yield closed([np.concatenate(x) for x in zip(*held, [x[:cut] for x in columns], strict=True)])
            held = []
        held.append([x[cut:] for x in columns])
    if held:
        yield closed([np.concatenate(x) for x in zip(*held, strict=True)])


def links(classes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect all fingerprints within `most` bits of each other.

    classes has one row (fp, node) for each different fingerprint. In each bucket a spanning forest of
    its links is returned, never all pairs, so the rows are at most 64 to a fingerprint, and the same
    components result.
    """
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    masks = F.array(*(F.lit(m) for m in variant_masks(most)))
    variants = classes.select("fp", "node", bit).select(F.col("bit").cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.element_at(masks, F.col("bit") + 1)).alias("masked"), "fp", "node")
    dealt = variants.repartition(partitions(classes.sparkSession), "bit", "masked").sortWithinPartitions("bit", "masked")
    return dealt.mapInArrow(partial(_bucket_links, most=most), "u long, v long")


def variant_masks(most: int) -> list[int]:
    """Of each bit its segment without it, as a signed long: there are so many segments that one differs in at most one bit."""
    segments = (most + 2) // 2
    bounds = [64 * i // segments for i in range(segments + 1)]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        whole = (1 << high) - (1 << low)
        out += [whole & ~(1 << bit) for bit in range(low, high)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, one, two, fp, component_id) of every document; component_id is the least doc_id reachable over links.

    Fingerprints are of shingles of `size` words and link at `most` or fewer differing bits.

    Documents with equal fingerprints are one class, so that groups of copies cost one row in the
    search. Rows with a null doc_id get a null component_id and link nothing; repeated doc_ids are
    repeated rows with the component of each one's fingerprint. An empty table gives an empty result.
    """
    return _linked(written(fingerprints(docs, size), "fingerprints"), most)


def _linked(prints: DataFrame, most: int) -> DataFrame:
    """near_duplicates() of fingerprints()."""
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    # Two classes may share their least doc_id where doc_ids repeat: such a row links them.
    found = components(links(classes, most))
    labels = written(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "labels")
    return prints.join(labels, "fp", "left").select("doc_id", "one", "two", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def jaccard(a: bytes, b: bytes, size: int) -> float:
    """Shared shingles of two texts against all of them; 1 where neither has a word."""
    one, other = set(shingle_hashes(a, size)), set(shingle_hashes(b, size))
    return len(one & other) / len(one | other) if one or other else 1.0


def _similar(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows of texts that are at least so similar to the text kept for them."""
    for batch in batches:
        sides = []
        for name in ("text", "kept"):
            data, at = flat(batch.column(name))
            raw, at = data.tobytes(), at.tolist()
            sides.append([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        good = [jaccard(a, b, size) >= least for a, b in zip(*sides, strict=True)]
        yield batch.select(["doc_id", "one", "two"]).filter(pa.array(good, pa.bool_()))


def _banded(texts: DataFrame) -> DataFrame:
    """(one, two, head) of texts (one, two, node, bands): of the least nodes in a text's bands the HEADS that are so in most, without its own.

    A band's least doc_id is aggregated before the band's texts are joined with it, so that no group of texts
    is held, and Spark splits a band that very many texts share.
    """
    each = written(texts.select("one", "two", "node", F.posexplode("bands").alias("at", "band")), "bands")
    least = written(each.groupBy("at", "band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("at", "band", "head"), "heads")
    met = each.join(least, ["at", "band"]).where("head < node").groupBy("one", "two", "head").agg(F.count("*").alias("n"))
    # At most BANDS rows for each text.
    place = F.row_number().over(Window.partitionBy("one", "two").orderBy(F.desc("n"), "head"))
    return met.withColumn("place", place).where(F.col("place") <= HEADS).select("one", "two", "head")


def _shared(texts: DataFrame) -> DataFrame:
    """(token, node, n, at) of the hashes in prefixes of texts (node, n, prefix) that more than one node has.

    Most hashes are one text's only and join with nothing: all are dealt by hash once, and only shared ones go on.
    """
    each = texts.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    of_token = Window.partitionBy("token")
    several = each.withColumn("least", F.min("node").over(of_token)).withColumn("most", F.max("node").over(of_token)).where("least < most")
    return several.select("token", "node", "n", "at").distinct()


def _prefixed(shared: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """(node, head) of _shared(): each text in left (node) with every text of lesser node that may be so similar.

    They share a hash of their prefixes, neither is too small for the other, and behind the first hash they share enough is left.
    """
    mine = shared.join(left, "node", "left_semi").alias("a")
    other = shared.alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    behind = F.least(a("n") - a("at"), b("n") - b("at"))
    near = (F.least(a("n"), b("n")) >= F.greatest(a("n"), b("n")) * similarity - 1e-9) & (behind * (1 + similarity) >= (a("n") + b("n")) * similarity - 1e-9)
    met = mine.join(other, (a("token") == b("token")) & (b("node") < a("node")) & (near | (a("n") + b("n") == 0)))
    return met.select(a("node").alias("node"), b("node").alias("head")).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids as one side of a join with whole texts: if it has at most FEW rows each executor gets it, so that texts are not moved; else both are dealt, and texts not sorted."""
    return ids.hint("broadcast" if ids.count() <= FEW else "shuffle_hash")


def _possible(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(node, head, apart) of pairs whose sets do not differ in too many parities to be so similar."""
    for batch in batches:
        own, other = batch.column("parities").to_pylist(), batch.column("head_parities").to_pylist()
        apart = np.array([differing(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(own, other, strict=True)], np.int32)
        sizes = batch.column("n").to_numpy() + batch.column("head_n").to_numpy()
        good = apart * (1 + similarity) <= sizes * (1 - similarity) + 1e-6
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("head"), pa.array(apart)], ["node", "head", "apart"]).filter(pa.array(good))


def _not_apart(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(node, head, apart) of pairs (node, head) without those that the parities of rows (node, n, parities) rule out; apart is how many differ.

    Of sets that are so similar at most (1 - similarity) / (1 + similarity) of both sizes are not shared.
    """
    asked = pairs.select("node").union(pairs.select("head")).distinct()
    sides = written(rows.select("node", "n", "parities").join(asked, "node", "left_semi").distinct(), "sides")
    heads = sides.select(F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("parities").alias("head_parities"))
    both = pairs.join(sides, "node").join(heads, "head").select("node", "head", "n", "head_n", "parities", "head_parities")
    return both.mapInArrow(partial(_possible, similarity=similarity), "node long, head long, apart int").groupBy("node", "head").agg(F.min("apart").alias("apart"))


def _judged(docs: DataFrame, others: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, one, two) of others (doc_id, one, two, head_id) whose text is so similar to a different one of the document head_id."""
    ids = ["doc_id", "one", "two"]
    asked = written(others.select("doc_id").union(others.select("head_id")).distinct(), "asked")
    whole = docs.select("doc_id", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"), "text")
    texts = written(whole.join(_few(asked), "doc_id", "left_semi"), "looked_at")
    mine = written(texts.join(others, ids).select(*ids, "head_id", "text").distinct(), "mine")
    heads = others.select(F.col("head_id").alias("doc_id")).distinct()
    kept = written(texts.join(heads, "doc_id", "left_semi").select(F.col("doc_id").alias("head_id"), F.struct("one", "two").alias("head"), F.col("text").alias("kept")).distinct(), "kept")
    # Nothing is grouped after the join, so that Spark splits a head that very many documents have.
    pairs = mine.join(kept, "head_id").where(F.col("head") != F.struct("one", "two")).select(*ids, "text", "kept")
    similar = written(pairs.mapInArrow(partial(_similar, size=size, least=similarity), "doc_id long, one long, two long"), "similar")
    forget(asked, texts, mine, kept)
    return similar


def without_near_duplicates(docs: DataFrame, size: int = 5, most: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies of a document of lesser doc_id: one of each group stays, that of least doc_id.

    A document goes if it repeats a text, or if its set of shingles has a Jaccard similarity of at least `similarity` with
    that of any document of lesser doc_id, which may itself go for one before it. First it is compared with few: the
    least doc_id of its group of linked fingerprints, and the HEADS least ones that share most of its bands of least hashes.
    What is left then is joined with all by prefixes, so that no pair is missed. Rows with a null doc_id stay, and
    rows that repeat the doc_id which stays. Texts are compared only where they differ.
    """
    prints = written(fingerprints(docs, size, banded=True, similarity=similarity), "fingerprints")
    found = written(_linked(prints.select("doc_id", "one", "two", "fp"), most), "found")
    ids = ["doc_id", "one", "two"]
    linked = found.where("component_id <> doc_id").select(*ids, F.col("component_id").alias("head_id")).distinct()
    # One row for each different text, with its least doc_id: what else has the text goes.
    texts = written(prints.where("doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "texts")
    copies = written(prints.select(*ids).join(texts.select("one", "two", "node"), ["one", "two"]).where("doc_id <> node").select(*ids).distinct(), "copies")
    banded = _banded(texts)
    similar_ = texts.join(banded, ["one", "two"]).select(F.col("node").alias("doc_id"), "one", "two", F.col("head").alias("head_id"))
    own = texts.select(F.col("node").alias("doc_id"), "one", "two")
    others = written(linked.join(own, ids, "left_semi").union(similar_).distinct(), "others")
    similar = _judged(docs, others, size, similarity)
    forget(found, others)
    left = written(own.join(similar, ids, "left_anti"), "left")
    # The arrays of prefixes are not moved to leave copies out, where these are few.
    rows = prints.where("doc_id is not null").join(_few(copies), ids, "left_anti").select(F.col("doc_id").alias("node"), "n", "prefix", "parities")
    shared = written(_shared(rows), "shared")
    met = written(_prefixed(shared, left.select(F.col("doc_id").alias("node")).distinct(), similarity), "met")
    forget(shared)
    pairs = written(_not_apart(met, rows, similarity), "pairs")
    forget(met, prints)
    # Only the texts of what is left are moved, first one pair of each document: the one that differs least.
    nearest = F.row_number().over(Window.partitionBy("node").orderBy("apart", "head"))
    placed = written(pairs.select(F.col("node").alias("doc_id"), F.col("head").alias("head_id"), nearest.alias("place")).join(left, "doc_id").select(*ids, "head_id", "place"), "placed")
    forget(pairs)
    first = _judged(docs, placed.where("place = 1").drop("place"), size, similarity)
    rest = written(placed.where("place > 1").join(first, ids, "left_anti").select(*ids, "head_id"), "rest")
    similar = similar.union(first).union(_judged(docs, rest, size, similarity))
    # Of a text that goes all copies do, and they are among copies already.
    gone = written(similar.union(copies).distinct(), "gone")
    forget(texts, left, placed, rest, copies)
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_one"), F.xxhash64("text", F.lit(1)).alias("_two"))
    left = row.join(_few(gone.select(F.col("doc_id").alias("_doc"), F.col("one").alias("_one"), F.col("two").alias("_two"))), ["_doc", "_one", "_two"], "left_anti")
    return left.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
