import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def shipped(spark):
    from quayside.llm.scratch import ship_package

    ship_package(spark)
    return spark


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def near_copies():
    """(doc_id, text) with exact copies, near copies at many distances, short and empty texts and shared passages."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    passage = sentence(rng, words, 60)
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 150]))]
        for copy in range(rng.choice([2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [passage + " " + sentence(rng, words, 20) for _ in range(25)]
    rows += ["one", "one", "one two", "One  TWO", "one two three", "a b c d", "A b\tc\nd", "", None, " \t\n", "É b c d", "é b c d"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


MESSY = [
    (1, None, None, None, None, 5), (2, "", "en", "s", 0, 5), (3, " \n\t ", None, "s", 3, 5), (4, "word", "en", None, 4, 5),
    (4, "word", "en", None, 4, 5), (4, "another text with this id", "en", "s", 4, 5), (None, "a text without an id", "en", "s", 20, 5),
    (6, "x" * 100_000, "de", "s", 100_000, 5), (7, "lorem ipsum " * 20_000, "de", "s", 240_000, 5), (8, "漢字 🙂 ñandú   end", "es", "s", 9, 5),
    (9, "a  b   c \n d", "en", "s", 9, 5), (10, "<|endoftext|> cc by CC-BY all rights reserved", "en", "s", 9, 5), (11, "0\x00\x01\x7f", "en", "s", 4, 5),
]
CLASHING = ["id", "label", "score", "rank", "n", "rep", "x", "y", "token", "piece", "shard", "w", "start", "node", "component", "ids", "low"]


@pytest.fixture(scope="session")
def messy(shipped):
    """Nulls, empty and very long texts, repeated ids and rows, and extra columns whose names the operators use."""
    from pyspark.sql import functions as F

    df = shipped.createDataFrame([r[:5] for r in MESSY], DOCS)
    return df.withColumns({c: F.lit(5) for c in CLASHING})
