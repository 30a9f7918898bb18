"""Secrets in text: base patterns, and spans that a linear-chain conditional random field adds.

The field tags each token as secret begin (B), inside (I) or outside (O) from the token's shape, the
words and separators beside it, and features of the whole file, and is decoded by Viterbi, a line of
text being a sequence. It is trained on a bounded sample of documents in which the tokens of the base
patterns' secrets are the positives. So that it does not only learn those patterns again, each positive
is also shown with its keyword replaced, and with the secret itself replaced by random ones of other
alphabets, and its keyword is shown before ordinary words; stretches of all kinds of other lines, those
with digits among them first, are negatives. A span counts if its beginning has a high marginal
probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.shared import flat, runs, word_spans, written

#: The base patterns, and the least length of what they must match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

#: Documents that the field is trained on, at most: so many that may hold a base secret, and as many others, those with the
#: least hashed ids. Of each, at most SECRETS of its secrets, each with its variants, and PLAIN other stretches of SPAN tokens.
SAMPLE, SECRETS, PLAIN, SPAN = 800, 2, 5, 18
EPOCHS, STEP, DECAY = 35, 0.25, 1e-5
#: The least marginal probability of a span's first token.
SURE = 0.7
OUT, BEGIN, IN = 0, 1, 2
_HEX = re.compile(rb"[0-9a-f]{16}")
#: Words that stand before secrets, for the variants of the positives.
NAMES = b"key client_key pwd pass passphrase credential credentials auth bearer authorization private_key signature session cookie access hash".split()
_MIXED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = (_MIXED, _MIXED, _MIXED + b"+/", _MIXED + b"_-", b"0123456789ABCDEF", b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
CHUNK = 1_000_000

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _of(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "lower": _of(range(97, 123)),
    "upper": _of(range(65, 91)),
    "digit": _of(range(48, 58)),
    "sign": _of(b"+/_-"),
    "other": _of(range(128, 256)),
    "hex": _of(b"0123456789abcdef"),
    "vowel": _of(b"aeiouAEIOU"),
}
_MARKS = [_of(b"="), _of(b":"), _of(b"\"'"), _of(b" \t"), _of(b"\n"), _of(b".,;!?")]
_WORDS = 1 << 12
#: Values of each feature of a token.
SIZES = {"bias": 1, "length": 16, "shape": 32, "digits": 6, "hexadecimal": 17, "turns": 8, "switches": 8, "vowels": 7, "before": 64, "after": 64, "previous": _WORDS, "second": _WORDS, "next": _WORDS, "file": 16}
OFFSETS = np.r_[0, np.cumsum(list(SIZES.values()))]


def _bucket(values: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), values, "right")


@dataclass
class Tokens:
    """Of a run of texts: where each token begins and ends in bytes, its text, its features' places, and whether a line begins."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    features: np.ndarray
    new_line: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    start, end, counts = word_spans(data, at, _TOKEN)
    n, text = len(start), np.repeat(np.arange(len(at) - 1), counts)
    size = end - start
    has = {}
    for name, table in _CLASSES.items():
        sums = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        has[name] = sums[end] - sums[start]
    digit = _CLASSES["digit"][data]
    turn = np.zeros(len(data) + 1, np.int64)
    turn[2:] = np.cumsum(digit[1:] != digit[:-1]) if len(data) > 1 else 0
    turns = turn[end] - turn[np.minimum(start + 1, end)]
    # Changes between lower and upper case, without those from the first letter on.
    switch = np.zeros(len(data) + 1, np.int64)
    upper, lower = _CLASSES["upper"][data], _CLASSES["lower"][data]
    switch[2:] = np.cumsum((upper[1:] & lower[:-1]) | (lower[1:] & upper[:-1])) if len(data) > 1 else 0
    switches = switch[end] - switch[np.minimum(start + 2, end)]
    first = np.r_[True, text[1:] != text[:-1]] if n else np.zeros(0, bool)
    last = np.r_[text[1:] != text[:-1], True] if n else np.zeros(0, bool)
    gap_start = np.where(first, at[text], np.r_[0, end[:-1]]) if n else start
    gap_end = np.where(last, at[text + 1], np.r_[start[1:], 0]) if n else end
    before, after, new_line = np.zeros(n, np.int64), np.zeros(n, np.int64), first.copy()
    for k, table in enumerate(_MARKS):
        sums = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        ahead = sums[start] > sums[gap_start]
        before |= ahead.astype(np.int64) << k
        after |= (sums[gap_end] > sums[end]).astype(np.int64) << k
        if k == 4:
            new_line |= ahead
    # A hash of each lower-cased word from the sum of its letters, its ends and its length.
    sums = np.r_[0, np.cumsum(_LOWER[data], dtype=np.int64)]
    letters = sums[end] - sums[start]
    ends = _LOWER[data[start]].astype(np.int64) * 31 + _LOWER[data[end - 1]].astype(np.int64) * 7 if n else size
    word = (letters * 131 + ends + size * 1009) % (_WORDS - 1) + 1
    previous = np.where(first, 0, np.r_[0, word[:-1]]) if n else word
    second = np.where(first, 0, np.r_[0, previous[:-1]]) if n else word
    following = np.where(last, 0, np.r_[word[1:], 0]) if n else word
    whole = at[1:] - at[:-1]
    equals = np.r_[0, np.cumsum(_MARKS[0][data], dtype=np.int64)]
    digits = np.r_[0, np.cumsum(digit, dtype=np.int64)]
    file = 4 * _bucket(equals[at[1:]] - equals[at[:-1]], [1, 2, 5]) + _bucket((digits[at[1:]] - digits[at[:-1]]) / np.maximum(whole, 1), [0.002, 0.01, 0.05])
    length = _bucket(size, [2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 32, 40, 64])
    shape = sum((has[name] > 0).astype(np.int64) << k for k, name in enumerate(("lower", "upper", "digit", "sign", "other")))
    share = size.astype(np.float64)
    columns = [
        np.zeros(n, np.int64), length, shape, _bucket(has["digit"] / share, [0.01, 0.2, 0.4, 0.6, 0.999]), np.where(has["hex"] == size, length + 1, 0),
        _bucket(turns, [1, 2, 3, 4, 6, 9, 13]), _bucket(switches, [1, 2, 3, 4, 6, 9, 13]), _bucket(has["vowel"] / share, [0.01, 0.1, 0.2, 0.3, 0.45, 0.6]),
        before, after, previous, second, following, file[text],
    ]
    return Tokens(start, end, text, np.stack(columns, 1) + OFFSETS[:-1] if n else np.zeros((0, len(SIZES)), np.int64), new_line)


def _characters(data: np.ndarray) -> np.ndarray:
    """Of each byte, and the end, how many code points begin before it."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)]


def base_spans(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the secret begins), in bytes of one UTF-8 text, in order. Kinds are places in KINDS."""
    raw = data.tobytes()
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw.decode("latin-1")) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw.decode("latin-1")) if len(m[0]) >= LEAST["access"]]
    edges = np.flatnonzero(np.diff(np.r_[False, _CLASSES["hex"][data], False].astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= LEAST["hex"]
    out += [(a, 2, b, a) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    return sorted(out)


def _tags(found: Tokens, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Tags by the base patterns; secrets of digits alone (numbers of other kinds, mostly) are left to the patterns."""
    tags = np.zeros(len(found.start), np.int8)
    for k in range(len(at) - 1):
        text = data[at[k] : at[k + 1]]
        for _, _, end, secret in base_spans(text):
            if _CLASSES["digit"][text[secret:end]].all():
                continue
            a, b = np.searchsorted(found.end, at[k] + secret, "right"), np.searchsorted(found.start, at[k] + end)
            tags[a:b] = IN
            tags[a : a + 1] = BEGIN
    return tags


def made_secret(rng: np.random.Generator) -> bytes:
    """A random secret: one alphabet, 12 to 64 characters, at times with a short prefix or in parts with points between."""
    draw = lambda n: bytes(rng.choice(np.frombuffer(ALPHABETS[kind], np.uint8), n))
    kind = int(rng.integers(len(ALPHABETS)))
    body = draw(int(rng.choice([12, 14, 16, 20, 24, 32, 36, 40, 48, 64])))
    way = rng.integers(5)
    if way == 0:
        kind = 6
        return draw(int(rng.integers(2, 5))) + bytes([int(rng.choice(list(b"_-")))]) + body
    return b".".join([body, draw(int(rng.integers(16, 60))), draw(int(rng.integers(16, 60)))]) if way == 1 else body


def variants(ahead: bytes, keyword: bytes, sign: bytes, secret: bytes, after: bytes, words: list[bytes], rng: np.random.Generator) -> Iterator[tuple[bytes, int, int]]:
    """(text, begin, end of the secret; both 0 for none): a positive as it is, and changed in its keyword, its secret or both."""
    word = lambda: words[int(rng.integers(len(words)))] if words else b""

    def made(name: bytes, between: bytes, value: bytes) -> tuple[bytes, int, int]:
        begin = len(ahead) + len(name) + len(between)
        return ahead + name + between + value + after, begin, begin + len(value)

    name = NAMES[int(rng.integers(len(NAMES)))]
    signs = (b"=", b" = ", b": ", b" ", b'="', b'": "', b" = '")
    yield made(keyword, sign, secret)
    yield made(word(), sign or b" ", secret)
    yield made(keyword, sign, made_secret(rng))
    yield made(name, signs[int(rng.integers(len(signs)))], made_secret(rng))
    yield made(name.upper() if rng.integers(2) else name, signs[int(rng.integers(len(signs)))], secret)
    yield made(word(), signs[int(rng.integers(len(signs)))], made_secret(rng))
    for value in (made_secret(rng), made_secret(rng)):
        yield made(b"", b"", value)
    for value in (word(), b" ".join([word(), word()])):
        yield made(keyword or name, sign or b" ", value)[0], 0, 0


def _stretch(found: Tokens, tags: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens a to b, which begin no secret that goes on from before them."""
    tags = tags[a:b].copy()
    tags[: int(np.argmax(tags != IN)) if (tags != IN).any() else len(tags)] = OUT
    return found.features[a:b], tags


def _positive(raw: bytes, whole: np.ndarray, span: tuple[int, int, int, int], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The variants of one base secret within its line, with the features of the whole file."""
    start, kind, end, secret = span
    keyword = re.match(rb"[A-Za-z_]+", raw[start:secret])[0] if kind == 0 else b""
    first = max(raw.rfind(b"\n", 0, start) + 1, start - 90)
    last = raw.find(b"\n", end)
    line, after = raw[first:start], raw[end : min(len(raw) if last < 0 else last, end + 60)]
    words = [w for w in re.findall(rb"[A-Za-z\x80-\xff]{2,}", raw[first:start] + b" " + after)][:40]
    for text, a, b in variants(line, keyword, raw[start + len(keyword) : secret], raw[secret:end], after, words, rng):
        data = np.frombuffer(text, np.uint8)
        found = tokens(data, np.array([0, len(data)]))
        found.features[:, -1] = whole
        tags = np.zeros(len(found.start), np.int8)
        if b:
            x, y = np.searchsorted(found.end, a, "right"), np.searchsorted(found.start, b)
            tags[x:y] = IN
            tags[x : x + 1] = BEGIN
            middle = max(0, x - SPAN // 2)
        else:
            middle = max(0, int(np.searchsorted(found.start, len(line))) - SPAN // 2)
        yield _stretch(found, tags, middle, middle + SPAN)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of tokens of each document: features and tags. What is drawn at random depends on the text alone."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            part = data[x:y]
            raw = part.tobytes()
            rng = np.random.default_rng(zlib.crc32(raw))
            found = tokens(part, np.array([0, len(part)]))
            if not len(found.start):
                continue
            tags = _tags(found, np.array([0, len(part)]), part)
            spans = [s for s in base_spans(part) if not _CLASSES["digit"][part[s[3] : s[2]]].all()]
            out = [v for s in spans[:SECRETS] for v in _positive(raw, found.features[0, -1], s, rng)]
            # Other stretches: around tokens with digits or signs first, then anywhere.
            odd = np.flatnonzero((tags == OUT) & (np.isin(found.features[:, 3] - OFFSETS[3], [0], invert=True) | (found.end - found.start > 14)))
            places = [*rng.permutation(odd)[:PLAIN], *rng.integers(0, len(tags), 2)]
            for place in places[: PLAIN + 1]:
                lines = np.flatnonzero(found.new_line)
                line = int(np.searchsorted(lines, place, "right")) - 1
                a = max(int(lines[line]), int(place) - SPAN // 2)
                b = min(a + SPAN, int(lines[line + 1]) if line + 1 < len(lines) else len(tags))
                out.append(_stretch(found, tags, a, b))
            out = [v for v in out if len(v[1])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([f.ravel().astype(np.int32) for f, _ in out], pa.list_(pa.int32())), pa.array([t for _, t in out], pa.list_(pa.int8()))], ["features", "tags"])


@dataclass
class Field:
    """weights: a row for each value of each feature, a column for each tag; moves: from tag to tag."""

    weights: np.ndarray
    moves: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(features: list[np.ndarray], tags: list[np.ndarray]) -> Field:
    """Fit by gradient steps on the log-likelihood of whole sequences (forward-backward)."""
    weights, moves = np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3))
    moves[OUT, IN] = -1e4  # a secret begins with B
    order = sorted(range(len(tags)), key=lambda i: -len(tags[i]))
    if not order or not any((t > 0).any() for t in tags):
        weights[OFFSETS[0], OUT] = 50.0
        return Field(weights.astype(np.float32), moves)
    length = np.array([len(tags[i]) for i in order])
    steps = int(length[0])
    # Tokens step by step: at step t stand the sequences longer than t, which are the first ones.
    live = [int((length > t).sum()) for t in range(steps)]
    cut = np.r_[0, np.cumsum(live)]
    ids = np.concatenate([np.stack([features[order[i]][t] for i in range(live[t])]) for t in range(steps)])
    gold = np.concatenate([np.array([tags[order[i]][t] for i in range(live[t])]) for t in range(steps)]).astype(np.int64)
    one = np.zeros((len(gold), 3))
    one[np.arange(len(gold)), gold] = 1
    gold_moves = np.zeros((3, 3))
    for t in range(1, steps):
        np.add.at(gold_moves, (gold[cut[t - 1] : cut[t - 1] + live[t]], gold[cut[t] : cut[t + 1]]), 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    total = len(order)
    for epoch in range(1, EPOCHS + 1):
        score = weights[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            score += weights[ids[:, k]]
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        first = score[: live[0]].copy()
        first[:, IN] = -1e4
        ahead[: live[0]] = first
        for t in range(1, steps):
            ahead[cut[t] : cut[t + 1]] = score[cut[t] : cut[t + 1]] + _logsum(ahead[cut[t - 1] : cut[t - 1] + live[t], :, None] + moves, 1)
        expected = np.zeros((3, 3))
        for t in range(steps - 1, 0, -1):
            step = moves + (score[cut[t] : cut[t + 1]] + back[cut[t] : cut[t + 1]])[:, None, :]
            back[cut[t - 1] : cut[t - 1] + live[t]] = _logsum(step, 2)
        whole = _logsum(ahead + back, 1)  # the same for all tokens of a sequence
        for t in range(1, steps):
            pair = ahead[cut[t - 1] : cut[t - 1] + live[t], :, None] + moves + (score[cut[t] : cut[t + 1]] + back[cut[t] : cut[t + 1]])[:, None, :]
            expected += np.exp(pair - whole[cut[t] : cut[t + 1], None, None]).sum(0)
        error = np.exp(ahead + back - whole[:, None]) - one
        slope = np.zeros_like(weights)
        for k, (low, size) in enumerate(zip(OFFSETS[:-1].tolist(), SIZES.values(), strict=True)):
            for tag in range(3):
                slope[low : low + size, tag] = np.bincount(ids[:, k] - low, error[:, tag], size)
        for x, g, (m, v) in ((weights, slope / total + DECAY * weights, state[0]), (moves, (expected - gold_moves) / total, state[1])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= STEP * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
        moves[OUT, IN] = -1e4
    return Field(weights.astype(np.float32), moves)


def _candidates(batches: Iterator[pa.RecordBatch], sample: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, draw, may_hold): of this partition the rows of least draw, `sample` that may hold a base secret and as many others."""
    kept: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
    for batch in batches:
        data, at = flat(batch.column("text"))
        raw, at = data.tobytes(), at.tolist()
        rows = zip(batch.column("draw").to_pylist(), batch.column("doc_id").to_pylist(), at, at[1:], strict=False)
        for draw, doc, a, b in rows:
            low = raw[a:b].lower()
            kept[any(k in low for k in KEYWORDS) or b"akia" in low or _HEX.search(raw, a, b) is not None].append((draw, doc))
        for own in kept.values():
            own.sort()
            del own[sample:]
    for hot, own in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([d for _, d in own], pa.int64()), pa.array([x for x, _ in own], pa.int64()), pa.array([hot] * len(own), pa.bool_())], ["doc_id", "draw", "may_hold"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on at most `sample` documents that may hold a base secret and as many others, those with the least hashed ids.

    The weak labels come from the base patterns. The chosen ids are at most 2 * `sample` rows, which is what
    is broadcast; the driver gets their stretches. Documents with a null doc_id are not drawn.
    """
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id").alias("draw"), "text")
    found = written(known.mapInArrow(partial(_candidates, sample=sample), "doc_id long, draw long, may_hold boolean"), "candidates")
    parts = [found.where(F.col("may_hold") == hot).orderBy("draw", "doc_id").limit(sample).select("doc_id") for hot in (True, False)]
    keys = parts[0].union(parts[1]).distinct()
    # Of several texts of one doc_id the least counts, so that the sample stays as small as it is said to be.
    drawn = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
    rows = drawn.select("text").mapInArrow(_sequences, "features array<int>, tags array<byte>").toArrow()
    width = len(SIZES)
    features, tags = rows.column("features").combine_chunks(), rows.column("tags").combine_chunks()
    cuts = tags.offsets.to_numpy()
    every, own = features.flatten().to_numpy().astype(np.int64).reshape(-1, width), tags.flatten().to_numpy()
    return train([every[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [own[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def viterbi(field: Field, found: Tokens) -> np.ndarray:
    """The best tags of all lines together: one step for each place in a line, over all lines that reach it."""
    n = len(found.start)
    if not n:
        return np.zeros(0, np.int8)
    score = field.weights[found.features[:, 0]].astype(np.float32)
    for k in range(1, found.features.shape[1]):
        score += field.weights[found.features[:, k]]
    start = np.flatnonzero(found.new_line)
    length = np.diff(np.r_[start, n])
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    moves = field.moves.astype(np.float32)
    best = score[start].copy()
    best[:, IN] = -1e4
    back = np.zeros((n, 3), np.int8)
    live = len(start)
    final = np.zeros(len(start), np.int8)
    for t in range(1, int(length[0]) + 1):
        now = int(np.searchsorted(-length, -t, "left"))  # lines longer than t
        final[now:live] = best[now:live].argmax(1)
        live = now
        if not live:
            break
        ways = best[:live, :, None] + moves
        at = start[:live] + t
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
    tags = np.zeros(n, np.int8)
    now, live = final, len(start)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        at = start[:live] + t
        tags[at] = now[:live]
        if t:
            now[:live] = back[at, now[:live]]
    return tags


def certainty(field: Field, features: np.ndarray) -> np.ndarray:
    """Of each token of one line the marginal probability that a secret begins there (forward-backward)."""
    score = field.weights[features].sum(1).astype(np.float64)
    # Sums over paths are brought to one at each token, so that no line is too long.
    emit, moves = np.exp(score - score.max(1, keepdims=True)).tolist(), np.exp(field.moves - field.moves.max()).tolist()
    (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = moves
    ahead, back = np.empty((len(emit), 3)), np.ones((len(emit), 3))
    x, y, z = (0.0 if k == IN else e for k, e in enumerate(emit[0]))
    for t, (p, q, r) in enumerate(emit):
        if t:
            x, y, z = (x * aa + y * ba + z * ca) * p, (x * ab + y * bb + z * cb) * q, (x * ac + y * bc + z * cc) * r
        total = x + y + z
        x, y, z = x / total, y / total, z / total
        ahead[t] = x, y, z
    x = y = z = 1.0
    for t in range(len(emit) - 2, -1, -1):
        p, q, r = emit[t + 1]
        p, q, r = p * x, q * y, r * z
        x, y, z = p * aa + q * ab + r * ac, p * ba + q * bb + r * bc, p * ca + q * cb + r * cc
        total = x + y + z
        x, y, z = x / total, y / total, z / total
        back[t] = x, y, z
    both = ahead * back
    return both[:, BEGIN] / both.sum(1)


def found_spans(field: Field, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """First and last tokens of the spans on the best path whose first token is SURE to begin a secret."""
    tags = viterbi(field, found)
    begins = np.flatnonzero(tags == BEGIN)
    if not len(begins):
        return begins, begins
    # A secret goes on over the tokens tagged inside that follow it.
    stop = np.r_[np.flatnonzero(tags != IN), len(tags)]
    ends = stop[np.searchsorted(stop, begins, "right")] - 1
    lines = np.r_[np.flatnonzero(found.new_line), len(tags)]
    of = np.searchsorted(lines, begins, "right") - 1
    sure = np.zeros(len(begins))
    for line in np.unique(of).tolist():
        mine = of == line
        sure[mine] = certainty(field, found.features[lines[line] : lines[line + 1]])[begins[mine] - lines[line]]
    return begins[sure >= SURE], ends[sure >= SURE]


def _scanner(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = broadcast.value
        for batch in batches:
            data, at = flat(batch.column("text"))
            out: list[list[dict]] = []
            for a, b in runs(at, CHUNK):
                part, offsets = data[at[a] : at[b]], at[a : b + 1] - at[a]
                found = tokens(part, offsets)
                begins, ends = found_spans(field, found)
                chars = _characters(part)
                of = found.text[begins] if len(begins) else begins
                for k in range(b - a):
                    base = [(s, kind, e) for s, kind, e, _ in base_spans(part[offsets[k] : offsets[k + 1]])]
                    more = [(int(found.start[x] - offsets[k]), 3, int(found.end[y] - offsets[k])) for x, y in zip(begins[of == k].tolist(), ends[of == k].tolist(), strict=True)] if len(begins) else []
                    more = [m for m in more if all(m[2] <= s or m[0] >= e for s, _, e in base)]
                    shift = chars[offsets[k]]
                    own = chars[offsets[k] : offsets[k + 1] + 1] - shift
                    out.append([{"kind": KINDS[kind], "start": int(own[s]), "end": int(own[e])} for s, kind, e in sorted(base + more)])
            spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    return scan


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) of every document; spans are (kind, start, end) in code points, by start, then kind.

    Kinds are assign, access and hex from the base patterns (for assign the whole match), and crf for a
    span that the field adds, which overlaps none of them. A null text has none; rows that repeat stay
    rows of their own with equal spans; an empty table gives an empty result; other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(_scanner(broadcast), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
