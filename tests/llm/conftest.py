import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a documents table."""

    def make(rows, schema=SCHEMA):
        full = [(d, t, "en", "src0", None if t is None else len(t)) if schema == SCHEMA else (d, t) for d, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, blanks of several kinds, long and empty ones, and nulls."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, other = words(80), words(61)
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "One two", "Ünïcode – 😀 text", None, ""]
    for k in range(60):
        body = words(rng.randint(20, 150))
        if k % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage[rng.randint(0, 20) : 80 - rng.randint(0, 9)]
        if k % 5 == 0:
            body += other
        lines = [" ".join(body[i : i + 9]) for i in range(0, len(body), 9)]
        texts.append("\n".join(lines))
        if k % 10 == 0:
            texts += [texts[-1], texts[-1].replace(" ", "\t", 3)]
            changed = body.copy()
            changed[len(body) // 2] = "changed"
            texts.append(" ".join(changed))
    texts.append(" ".join(words(12_000)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows
