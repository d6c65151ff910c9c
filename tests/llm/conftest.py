from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, over several partitions, with clashing extra columns."""

    def make(pairs, partitions: int = 3):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS).repartition(partitions)
        for name in ("id", "h1", "key", "n_lines", "hash", "row_hash", "label", "rule", "size", "w0", "a"):
            df = df.withColumn(name, F.lit("extra"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented words."""

    def make(seed: int, n: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [
        None, "", " ", "\n", "\n\n  \t", "a", "one two", "ÄÖÜ ß İ Σς ﬁ",
        "a  b   c\t\td \n e", "x \n \n y", "   lead", "trail   ", " nb sp\u0085nl\x1cfs",
        "tok <|endoftext|> in <|startoftext|>text", "it's we'LL don't 12345 3.14", "日本語のテキスト 😀😀",
        "é combining", "word " * 3000, "y" * 5000, "\r\ncr\rlf", "a\x00b",
    ]
