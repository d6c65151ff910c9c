"""Words of many texts as arrays, for tasks that run over Arrow batches.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``. Batches are cut into
small parts and these into pieces of about half a megabyte, so memory follows the
longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from auditlake.functions.scale import ship_package

PIECE_BYTES = 1 << 19
PART_ROWS = 512
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of at most ``rows``."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def pieces(raw: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` bytes, or one long text."""
    start = size = 0
    for i, text in enumerate(raw):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(raw):
        yield start, len(raw)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class Words:
    """Words of some texts: ``doc``, ``start``, ``end`` (bytes in ``data``) and ``hash``."""

    def __init__(self, raw: list[bytes]):
        self.n_docs = len(raw)
        self.data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.data) and not space[0]:
            edge = np.concatenate([[0], edge])
        edge = edge.astype(np.int64)
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in raw), dtype=np.int64, count=len(raw))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        # words of text i: first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word, equal for equal bytes wherever they stand."""
        n = len(self.data)
        up = powers(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_MIX[self.data] * up)])
        inverse = pow(_BASE, -1, 1 << 64)
        down = powers(n, inverse)
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def code_points(self) -> np.ndarray:
        """Number of code points before each byte of ``data``, ends included."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def windows(self, hashes: np.ndarray, size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one text, and their first words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        total = np.zeros(n, dtype=np.uint64)
        weight = 1
        for j in range(size):
            total += hashes[j : j + n] * np.uint64(weight)
            weight = weight * base % (1 << 64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mixed(total[at]), at
