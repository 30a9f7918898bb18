"""Money amounts in a text, found in one scan from left to right.

The scan is a small Python function that Spark runs over Arrow batches: its patterns are compiled once, and
the places it gives are those of the text's code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Amounts under this are no prices.
LOW = 15.0
# Shapes of amounts.
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d{1,6})"
LEADING = rf"(?:CA\$|C\$|CAD\s?\$?|US\$|USD\s?\$?|\$)\s?{NUMBER}(?:\.\d{{1,2}})?(?!\d)"
TRAILING = rf"{NUMBER}\.\d{{2}}\s?(?:CAD|USD)(?!\w)"
FRENCH = "(?:\\d{1,3}(?:[   ]\\d{3})+|\\d{1,6}),\\d{2}\\s?\\$"
AMOUNT = rf"{LEADING}|{TRAILING}|{FRENCH}"
#: A code that ends one amount begins no other.
SCANNED = rf"(?:{LEADING}|(?:{TRAILING})(?:\s?\$?\s?{NUMBER}(?:\.\d{{1,2}})?(?!\d))?|{FRENCH})"

_SCANNED, _TRAILING, _AMOUNT = (re.compile(x, re.ASCII) for x in (SCANNED, TRAILING, AMOUNT))
_NUMBER, _FRENCH = re.compile(rf"{NUMBER}(?:\.\d{{1,2}})?", re.ASCII), re.compile(FRENCH, re.ASCII)
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.float64()), ("usd", pa.bool_()), ("in_row", pa.bool_())]))


def value_of(amount: str) -> float:
    if _FRENCH.fullmatch(amount):
        return float(re.sub(r"[\s$]", "", amount).replace(",", "."))
    return float(_NUMBER.search(amount)[0].replace(",", ""))


def scanned(text: str) -> Iterator[tuple[int, int, float, bool]]:
    """(start, stop, value, usd) of each amount, from left to right, without overlaps."""
    for m in _SCANNED.finditer(text):
        own = m[0]
        if not own[0].isdigit():
            yield m.start(), m.end(), float(_NUMBER.search(own)[0].replace(",", "")), own.startswith("US")
            continue
        own = (_TRAILING.match(own) or m)[0]
        yield m.start(), m.start() + len(own), value_of(own), own.endswith("USD")


def is_price_row(line: str) -> bool:
    """Whether a line is a row of a table that holds several prices."""
    return line.count("|") >= 3 and len({v for v in (value_of(m[0]) for m in _AMOUNT.finditer(line)) if v >= LOW}) >= 2


def _found(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        out, until, in_row = [], -1, False
        for start, stop, value, usd in scanned(text or ""):
            if stop > until:
                # The next line that has an amount, or an amount over the end of a line.
                end = text.find("\n", stop)
                until = len(text) if end < 0 else end
                in_row = is_price_row(text[text.rfind("\n", 0, start) + 1 : until])
            out.append({"start": start, "stop": stop, "value": value, "usd": usd, "in_row": in_row})
        rows.append(out)
    return pa.array(rows, _FOUND)


def found(text: Column) -> Column:
    """An array of (start, stop, value, usd, in_row) of a text's amounts."""
    return F.arrow_udf(_found, from_arrow_type(_FOUND))(text)


_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.float64()), ("usd", pa.bool_())]))


def _candidates(texts: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for text in texts.to_pylist():
        rows += scanned(text or "")
        ends.append(len(rows))
    fields = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True) if rows else [[]] * 4, _CANDIDATES.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_CANDIDATES.value_type)))


def candidates(text: Column) -> Column:
    """An array of (start, stop, value, usd) of a text's amounts, made batch by batch: a table function is called for each text."""
    return F.arrow_udf(_candidates, from_arrow_type(_CANDIDATES))(text)
