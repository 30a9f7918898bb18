"""Fill-in-the-middle: texts cut in three at token boundaries, which are found as bits of one large integer.

A text's bytes are translated to one digit a byte, and these read as one integer: a mask of the bytes of
words, and one of the bytes that begin a code point. A token ends where a word's byte is followed by none,
and at the text's end; shifts and boolean operations mark all ends at once, bit_count counts them, and
halving the mask again and again finds the k-th one. The JVM then cuts, as it holds the text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.shared import BLANK, flat

SEED = 42
#: Hundredths of the documents that are cut, and of these that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Below so many bits a mask is searched bit by bit.
LEAST = 64
_WORDS = bytes(48 if c in BLANK else 49 for c in range(256))
_STARTS = bytes(48 if 128 <= c < 192 else 49 for c in range(256))


def mask(data: bytes, table: bytes) -> int:
    """One bit a byte, the first byte's the lowest: whether the table has a 1 for it."""
    return int(data.translate(table)[::-1], 2) if data else 0


def token_ends(data: bytes) -> int:
    """A bit at the last byte of each token: blanks and the word after them, or the blanks at the end."""
    words = mask(data, _WORDS)
    return words & ~(words >> 1) | (1 << len(data) >> 1)


def place_of(bits: int, k: int, width: int) -> int:
    """The place of the k-th set bit, k from 1: the half that holds it is searched on, so the bits read are twice the width."""
    at = 0
    while width > LEAST:
        half = width // 2
        low = bits & ((1 << half) - 1)
        inside = low.bit_count()
        if k <= inside:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - inside
    for _ in range(k - 1):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the sha256 of seed and doc_id; a null id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def cuts(data: bytes, drawn: tuple[int, ...], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None]:
    """(n, form, prefix_chars, middle_chars) of a text's UTF-8 bytes."""
    ends = token_ends(data)
    n = ends.bit_count()
    if not data or drawn[2] % 100 >= rate or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    starts = mask(data, _STARTS)
    counts = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    upto = [(starts & ((1 << (place_of(ends, k, len(data)) + 1)) - 1)).bit_count() if k else 0 for k in counts]
    return n, "spm" if drawn[3] % 100 < suffix_first else "psm", upto[0], upto[1] - upto[0]


def _cutter(seed: int, rate: int, suffix_first: int):  # noqa: ANN202
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def cut(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        data, at = flat(text)
        raw, at = memoryview(data), at.tolist()
        rows = [cuts(bytes(raw[a:b]), draws(d, seed), rate, suffix_first) for d, a, b in zip(doc_id.to_pylist(), at, at[1:], strict=False)]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    return F.arrow_udf(cut, "struct<n:long,form:string,prefix_chars:long,middle_chars:long>")


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output.

    Prefix and middle end after as many tokens as two numbers say that are drawn from doc_id. Form is plain, and
    the output the text itself, where the text is empty or null, holds a marker, or its third number says so;
    else suffix, prefix, middle (spm) or prefix, suffix, middle (psm), each part behind its marker. Rows that
    repeat a doc_id draw alike, null ids too. Columns of docs with these names are replaced; an empty table gives an empty
    result.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*rest).alias("_row"), _cutter(seed, rate, suffix_first)(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("_cut"))
    text, cut = F.coalesce(F.col("_row.text"), F.lit("")), F.col("_cut")
    first, middle = cut["prefix_chars"].cast("int"), cut["middle_chars"].cast("int")
    parts = {PREFIX: F.substring(text, F.lit(1), first), MIDDLE: F.substring(text, first + 1, middle), SUFFIX: F.substring(text, first + middle + 1, F.length(text))}
    order = lambda *marks: F.concat(*(c for m in marks for c in (F.lit(m), parts[m])))
    output = F.when(cut["form"] == "plain", text).when(cut["form"] == "spm", order(SUFFIX, PREFIX, MIDDLE)).otherwise(order(PREFIX, SUFFIX, MIDDLE))
    return rows.select(*(F.col("_row")[c].alias(c) for c in rest), *(cut[c].alias(c) for c in made[:-1]), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: its parts lie between the markers, which no text that is cut holds."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        tail = F.substring(body, F.length(one) + len(second) + 1, F.length(output))
        two = F.substring_index(tail, MIDDLE, 1)
        return one, two, F.substring(tail, F.length(two) + len(MIDDLE) + 1, F.length(output))

    suffix, prefix, middle = parts(PREFIX)
    before, after, inner = parts(SUFFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(F.concat(before, inner, after))


_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: The same rows as the registered query, in DuckDB's SQL; the text is rebuilt from the parts of the output.
SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS tokens, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM hashed
), formed AS (
  SELECT *, len(tokens) AS n,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM formed
), parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM cut
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output ELSE p || m || s END) AS restored_sha256 FROM made
"""
