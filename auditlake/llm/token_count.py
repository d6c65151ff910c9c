"""Token counts by a two-tier lookup of pre-token lengths.

A text is cut before single spaces into pieces that the tokenizer never joins
(``_CUT`` names the texts where a cut would change a run of white space; those are
cut at the start of such runs alone). Lengths come from two tiers: a compact table of
frequent pre-tokens, broadcast once, which is the vocabulary's own list of words, so
it is bounded by the vocabulary; and a cache in each worker, which encodes what the
table misses. Pre-tokens are never shuffled.

Defined cases: a null text counts as empty, with no tokens; other columns pass
unchanged, but ``n_bytes``, ``n_tokens`` and ``over_limit`` are replaced; repeated
rows are counted each. Memory: a worker's cache holds at most ``CACHE`` pieces of at
most ``PIECE`` characters; what it cannot hold is encoded each time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.llm import bpe
from auditlake.llm.words import map_batches, parts

LIMIT = 512
CACHE = 150_000
PIECE = 64
_CUT = re.compile(r"\s (?:\s|\Z)")
_RUN = re.compile(r"(?<=\S)(?= )")


def text_pieces(text: str) -> list[str]:
    """Parts of the text whose tokens, one part after another, are the text's tokens."""
    if _CUT.search(text):
        return _RUN.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Lengths(dict):
    """Token counts of pieces: the broadcast tier, and what this worker met first.

    The first ``CACHE`` pieces of at most ``PIECE`` characters stay; frequent ones come early.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer = bpe.load(path)
        self.model = self.tokenizer.model

    def __missing__(self, piece: str) -> int:
        n = self.of(piece)
        if len(self) < CACHE and len(piece) <= PIECE:
            self[piece] = n
        return n

    def of(self, piece: str) -> int:
        if plain := bpe.PLAIN.fullmatch(piece):
            n = len(self.model.tokenize(bpe.pretoken(plain[1] + plain[2])))
            return n + len(self.model.tokenize(plain[3])) if plain[3] else n
        return len(self.tokenizer.encode(piece, add_special_tokens=False))

    def count(self, texts: list[str]) -> list[int]:
        return [sum(map(self.__getitem__, text_pieces(t))) for t in texts]


def frequent_pieces(path: str) -> tuple[str, bytes]:
    """The vocabulary's words, with and without a space before, and their token counts."""
    tokenizer = bpe.load(path)
    names = [tokenizer.decode([i], skip_special_tokens=True) for i in range(tokenizer.get_vocab_size())]
    words = sorted({n for n in names if n.strip() and "\n" not in n and "�" not in n
                    and " " not in n[1:]})
    lengths = [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return "\n".join(words), np.minimum(lengths, 255).astype(np.uint8).tobytes()


def count_tokens(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = LIMIT,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (keep or docs.columns) if c not in new]
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(tokenizer_path))
    schema = T.StructType([
        *(docs.schema[c] for c in keep),
        T.StructField(new[0], T.LongType()), T.StructField(new[1], T.LongType()),
        T.StructField(new[2], T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        def make() -> Lengths:
            words, lengths = frequent.value
            return Lengths(tokenizer_path, dict(zip(words.split("\n"), lengths)))

        table = bpe.worker_table("lengths", tokenizer_path, make)
        for batch in parts(batches):
            column = batch.column(batch.schema.get_field_index(text_col))
            texts = [t or "" for t in column.to_pylist()]
            n = pa.array(table.count(texts), pa.int64())
            size = pa.compute.binary_length(column.cast(pa.binary())).cast(pa.int64()).fill_null(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep),
                 size, n, pa.compute.greater(n, limit)],
                names=[*keep, *new],
            )

    wanted = list(dict.fromkeys([*keep, text_col]))
    return map_batches(docs.select(*(f"`{c}`" for c in wanted)), run, schema)
