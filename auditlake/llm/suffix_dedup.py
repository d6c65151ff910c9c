"""Repeated passages by a sparse suffix array.

Of all suffixes of a text only those are kept that begin at a minimiser: the word
position whose ``K``-word hash is smallest among those in some window of ``MIN_WORDS``
words. The choice depends on content alone, so two texts that share a window keep a
suffix at the same place of it. Kept suffixes are sorted by their first ``DEPTH`` words
over range partitions (ties by id, so many copies span many partitions) and compared
with their neighbours; neighbours of different documents that agree in ``K`` words are
extended left and right:

* as far as the windows reach that chose this minimiser, at once, by a hash of all
  their words (copies and the inside of long passages end here);
* where that differs, window by window, by the hashes of ``MIN_WORDS`` words.

So a passage is found if and only if a window of ``MIN_WORDS`` words is found in at
least two documents; overlapping windows join to the longest spans. Passages are
compared by 128 hash bits.

Defined cases: null, empty and shorter texts have no windows; rows of one id are one
document, whose repetitions inside do not count; null ids are left out; an empty table
gives no rows; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_filter, stored, storing
from auditlake.llm.words import Words, map_batches, mixed, parts, pieces, powers, texts

MIN_WORDS = 50
K = 8
DEPTH = 12
_SECOND = 0xD6E8FEB86659FD93
_WORD_BYTES = 2
_HEAD = K * _WORD_BYTES
SUFFIX = "prefix binary, id long, w0 int, n int, c0 int, c1 int, h1 long, h2 long"


def _range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the words start .. end - 1."""
    up, down = powers(len(hashes), base), powers(len(hashes), pow(base, -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
    return mixed((sums[end] - sums[start]) * down[start] ^ mixed((end - start).astype(np.uint64)))


def _two_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    first = _range_hashes(hashes, start, end, 0x9E3779B97F4A7C15)
    return [first.view(np.int64), _range_hashes(mixed(hashes), start, end, _SECOND).view(np.int64)]


def _minimisers(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Chosen word positions, and the first and last window that chose each."""
    n = len(hashes) - size + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none, none
    inside = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    if not len(inside):
        return none, none, none
    grams = np.zeros(len(hashes) - K + 1, dtype=np.uint64)
    weight = 1
    for j in range(K):
        grams += hashes[j : j + len(grams)] * np.uint64(weight)
        weight = weight * 0x9E3779B97F4A7C15 % (1 << 64)
    view = np.lib.stride_tricks.sliding_window_view(mixed(grams), size - K + 1)
    chosen = np.concatenate(
        [inside[i : i + 65536] + view[inside[i : i + 65536]].argmin(axis=1)
         for i in range(0, len(inside), 65536)]
    )
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(chosen)]]) - 1
    return chosen[at], inside[at], inside[last]


def suffixes(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """Kept suffixes of (id, text), with the words that their windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            raw, ids = texts(batch, "text"), batch.column(0).to_numpy()
            for lo, hi in pieces(raw):
                w = Words(raw[lo:hi])
                hashes = w.hashes()
                at, first, last = _minimisers(w, hashes, size)
                ends = last + size
                # big-endian, so that bytes sort like numbers; zeros behind the text's end
                short = (hashes >> np.uint64(48)).astype(">u2")
                steps = at[:, None] + np.arange(DEPTH)
                stop = w.first[w.doc[at] + 1] if len(at) else at
                prefix = np.where(steps < stop[:, None], short[np.minimum(steps, max(len(short) - 1, 0))], 0) if len(at) else np.empty((0, DEPTH))
                flat = np.ascontiguousarray(prefix.astype(">u2")).tobytes()
                width = DEPTH * _WORD_BYTES
                points = w.code_points()
                begin = points[w.doc_start[w.doc[first]]] if len(at) else at
                h1, h2 = _two_hashes(hashes, first, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(width), len(at), [None, pa.py_buffer(flat)]).cast(pa.binary()),
                        pa.array(ids[lo:hi][w.doc[at]]),
                        pa.array((first - w.first[w.doc[first]]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.array((points[w.start[first]] - begin).astype(np.int32)),
                        pa.array((points[w.end[ends - 1]] - begin).astype(np.int32)),
                        pa.array(h1), pa.array(h2),
                    ],
                    names=["prefix", "id", "w0", "n", "c0", "c1", "h1", "h2"],
                )

    return map_batches(docs.select("id", "text"), run, SUFFIX)


def shared_suffixes(kept: DataFrame, partitions: int) -> tuple[DataFrame, Callable[[], None]]:
    """Kept suffixes that agree in ``K`` words with one of another document.

    Reads sorted partitions as streams. A run is a sequence of neighbours with equal
    heads; its rows go on once two ids were seen. A run at the edge of a partition may
    continue in the next one, so rows that wait there go on with their head, and each
    such run leaves its smallest and largest id. Also returns a function that deletes
    the table behind the result.
    """
    schema = SUFFIX + ", head binary, low long, high long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*SUFFIX.replace(",", "").split()[::2]]
        head, ids, waiting, first_run = None, (0, 0), [], True

        def edge() -> list[pa.RecordBatch]:
            """The current run touches an edge: what waits, and its summary."""
            out = [b.append_column("head", pa.array([head] * len(b), pa.binary()))
                   .append_column("low", pa.nulls(len(b), pa.int64()))
                   .append_column("high", pa.nulls(len(b), pa.int64())) for b in waiting]
            empty = [pa.nulls(1, t) for t in (pa.binary(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 2)]
            out.append(pa.RecordBatch.from_arrays(
                [*empty, pa.array([head], pa.binary()), pa.array([ids[0]]), pa.array([ids[1]])],
                names=[*names, "head", "low", "high"]))
            return out

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(n, -1)
            heads = np.ascontiguousarray(flat[:, :_HEAD])
            own = batch.column(1).to_numpy()
            new = np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1
            bounds = [0, *new.tolist(), n]
            low, high = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
            take = np.zeros(n, dtype=bool)
            for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if j in (0, len(bounds) - 2) or low[j] != high[j]:
                    mine = heads[a].tobytes()
                    if mine != head:
                        if head is not None and first_run:
                            yield from edge()
                        first_run = first_run and head is None
                        head, ids, waiting = mine, (low[j], high[j]), []
                    else:
                        ids = (min(ids[0], low[j]), max(ids[1], high[j]))
                    if ids[0] != ids[1]:
                        take[a:b] = True
                        for w in waiting:
                            yield plain(w)
                        waiting = []
                    else:
                        waiting.append(batch.slice(a, b - a))
            if take.any():
                yield plain(batch.filter(pa.array(take)))
        if head is not None:
            yield from edge()

    def plain(b: pa.RecordBatch) -> pa.RecordBatch:
        return (b.append_column("head", pa.nulls(len(b), pa.binary()))
                .append_column("low", pa.nulls(len(b), pa.int64()))
                .append_column("high", pa.nulls(len(b), pa.int64())))

    order = ["prefix", "id", "w0"]
    placed = kept.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    out, done = storing(map_batches(placed, run, schema))
    edges = (
        out.where("low IS NOT NULL").groupBy("head").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low <> high").select("head")
    )
    columns = kept.columns
    hits = out.where("head IS NULL").select(*columns).unionByName(
        out.where("head IS NOT NULL AND low IS NULL").join(edges, "head", "left_semi").select(*columns)
    )
    return hits, done


def windows_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, w0, c0, c1, h1, h2) of the windows that ``wanted`` (id, w0, n) names."""
    lists = wanted.groupBy("id").agg(F.collect_set(F.struct("w0", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            raw, ids = texts(batch, "text"), batch.column(0).to_numpy()
            runs = batch.column(2)
            for lo, hi in pieces(raw):
                w = Words(raw[lo:hi])
                hashes, points = w.hashes(), w.code_points()
                starts = [np.empty(0, dtype=np.int64)]
                for i in range(lo, hi):
                    at = np.unique(np.concatenate(
                        [np.arange(r["w0"], r["w0"] + r["n"]) for r in runs[i].as_py()]))
                    first = w.first[i - lo]
                    starts.append(first + at[first + at + size <= w.first[i - lo + 1]])
                first = np.concatenate(starts)
                begin = points[w.doc_start[w.doc[first]]]
                h1, h2 = _two_hashes(hashes, first, first + size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi][w.doc[first]]),
                        pa.array((first - w.first[w.doc[first]]).astype(np.int32)),
                        pa.array((points[w.start[first]] - begin).astype(np.int32)),
                        pa.array((points[w.end[first + size - 1]] - begin).astype(np.int32)),
                        pa.array(h1), pa.array(h2),
                    ],
                    names=["id", "w0", "c0", "c1", "h1", "h2"],
                )

    joined = docs.select("id", "text").join(lists, "id")
    return map_batches(joined, run, "id long, w0 int, c0 int, c1 int, h1 long, h2 long")


def _shared(rows: DataFrame) -> DataFrame:
    """(h1, h2, low, high) of hashes found in two documents at least."""
    return (
        rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low <> high")
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Longest spans made of windows of ``min_words`` words that other documents hold too.

    Columns: ``id_col``, ``start`` and ``end`` (code points, end exclusive), ``n_words``,
    and ``first_id``, the smallest id that holds one of the span's windows.
    """
    if min_words < 2 * K:
        raise ValueError(f"min_words is {2 * K} at least")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")
    ).where("id IS NOT NULL")
    # tables that are no longer read are deleted at once: each is as large as a shuffle
    kept, drop_kept = storing(suffixes(rows, min_words))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, drop_found = shared_suffixes(kept, partitions)
    drop_kept()
    # left and right as far as the choosing windows reach
    whole, drop_whole = storing(_shared(found))
    known = stored(
        found.withColumn("head", F.substring("prefix", 1, _HEAD)).drop("prefix")
        .join(whole, ["h1", "h2"], "left")
    )
    drop_found()
    drop_whole()
    settled = known.where("low IS NOT NULL")
    rest = known.where("low IS NULL")
    # where that differs: window by window, against two documents of each settled kind
    against = salted_filter(
        settled.where("id = low OR id = high"), rest.select("head"), ["head"], ["id", "w0"]
    )
    single, drop_single = storing(windows_of(rows, rest.select("id", "w0", "n").unionByName(
        against.select("id", "w0", "n")), min_words))
    twice, drop_twice = storing(_shared(single).drop("high"))
    found = stored(single.join(twice, ["h1", "h2"]).select("id", "w0", "c0", "c1", "low"))
    drop_single()
    drop_twice()
    # other documents may hold single windows of a settled kind, with smaller ids
    inside = against.select(
        "h1", "h2", "id", F.explode(F.sequence("w0", F.col("w0") + F.col("n") - 1)).alias("w0")
    )
    smaller = inside.join(found, ["id", "w0"]).groupBy("h1", "h2").agg(F.min("low").alias("smaller"))
    settled = settled.join(smaller, ["h1", "h2"], "left").withColumn("low", F.least("low", "smaller"))
    spans = settled.select("id", "w0", (F.col("w0") + F.col("n") + (min_words - 1)).alias("w1"),
                           "c0", "c1", "low").unionByName(
        found.select("id", "w0", (F.col("w0") + min_words).alias("w1"), "c0", "c1", "low")
    )
    order = Window.partitionBy("id").orderBy("w0", "w1")
    reach = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("w0") <= reach, 0).otherwise(1)).withColumn(
        "island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return islands.groupBy("id", "island").agg(
        F.min("c0").cast("bigint").alias("start"), F.max("c1").cast("bigint").alias("end"),
        (F.max("w1") - F.min("w0")).cast("bigint").alias("n_words"), F.min("low").alias("first_id"),
    ).select(F.col("id").alias(id_col), "start", "end", "n_words", "first_id")
