"""Spelling variants: words one edit apart, found by composing automata.

Words are counted in tasks. The vocabulary is dealt out by initial state: the state of
the vocabulary's acceptor after the first ``PREFIX`` code points. In a partition the
words make a minimal acyclic acceptor A; the composition of A, a transducer that inserts,
deletes or replaces exactly one code point, and A again is walked: both copies of A read
the same prefix, so they are in one state until the edit, and must accept a common rest
after it. Every accepted pair has one canonical path, the one with the latest edit.

Two words whose first ``PREFIX`` code points differ share their last ones, as words have
``MIN_LENGTH`` of them; they are found the same way among the reversed words, where only
edits with a rest of less than ``PREFIX`` code points matter.

A partition of more than ``PART`` code points is not built in one task. Its words' common
prefix leads to a state whose own edits are found by grouping on the rest (at most one
word for each code point, and the rest itself), and each arc out of it is a partition of
its own, until all are small. Prefixes may be of any length, so nothing is left large but
a single word.

Runs of letters are ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; where ``CORRUPT``
divides the crc32 of ``<id>:<run>``, the run loses one code point (the dealt contract).

Defined cases: null or empty texts have no words; a null id counts as an empty id; repeated
rows count each; of equally frequent near words the smallest in code-point order is the
form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_filter, salted_lookup, stored
from auditlake.llm.words import map_batches, parts, pieces, texts

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
CORRUPT = 31
PREFIX = 3
PART = 1 << 18
_SHORT = 48
_CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of nothing else


def runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, start, end, code points) of the runs of ``MIN_LENGTH`` and more."""
    data = np.frombuffer(b"\n".join([b"", *raw, b""]).lower(), dtype=np.uint8)
    latin = data == _LATIN
    inside = _LETTER[data] | latin
    inside[1:] |= latin[:-1]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    points = np.cumsum((data & 0xC0) != 0x80)
    size = points[end - 1] - points[start - 1]
    long = size >= MIN_LENGTH
    start, end, size = start[long], end[long], size[long]
    first = np.cumsum([1, *(len(t) + 1 for t in raw)])
    doc = np.searchsorted(first, start, side="right") - 1
    return data, doc, start, end, size


def checksums(data: np.ndarray, before: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each run after a prefix whose crc32 is ``before``."""
    size = end - start
    out = np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    n_long = int((size > _SHORT).sum())
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    order = order[n_long:]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    at, sizes = start[order], size[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = np.searchsorted(-sizes, -j)  # runs longer than j come first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(raw: list[bytes], ids: list[bytes]) -> pa.Array:
    """The words of some texts, one value for each occurrence."""
    data, doc, start, end, size = runs(raw)
    seeds = np.array([zlib.crc32(i + b":") for i in ids], dtype=np.uint32)
    check = checksums(data, seeds[doc], start, end)
    hit = check % np.uint32(CORRUPT) == 0
    changed = []
    for a, b, h, n in zip(start[hit].tolist(), end[hit].tolist(), check[hit].tolist(), size[hit].tolist()):
        if n > MIN_LENGTH:
            run = data[a:b].tobytes().decode()
            changed.append(run[: h % n] + run[h % n + 1 :])
    start, end = start[~hit], end[~hit]
    ends = np.cumsum(end - start)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - np.concatenate([[0], ends[:-1]]) if len(ends) else start, end - start)
    plain = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[at]))
    return pa.concat_arrays([plain, pa.array(changed, pa.large_string())])


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) for words of ``MIN_LENGTH`` code points with ``MIN_COUNT`` occurrences."""

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.large_string()).value_counts()
        return pa.RecordBatch.from_arrays(
            [found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts(batches):
            raw = texts(batch, "text")
            ids = [(i or "").encode() for i in batch.column(batch.schema.get_field_index("id")).to_pylist()]
            for a, b in pieces(raw):
                held.append(words_of(raw[a:b], ids[a:b]))
                size += held[-1].nbytes
                if size > 1 << 24:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = map_batches(rows, run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words.

    States are numbers, targets before sources; the last one is initial.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[{}, False]]  # states whose language is not complete yet
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                state = known.setdefault((final, *arcs.items()), len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append(arcs)
                    self.final.append(final)
                path[-1][0][last[len(path) - 1]] = state

        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            close(shared)
            path += [[{}, False] for _ in range(len(word) - shared)]
            path[-1][1] = True
            last = word
        close(0)
        self.arcs.append(path[0][0])
        self.final.append(path[0][1])
        # lengths of accepted rests, modulo 64: states without a length in common share none
        self.lengths: list[int] = []
        self.least: list[int] = []
        for arcs, final in zip(self.arcs, self.final):
            mask, least = int(final), 0 if final else 1 << 30
            for target in arcs.values():
                one = self.lengths[target]
                mask |= (one << 1 | one >> 63) & 0xFFFFFFFFFFFFFFFF
                least = min(least, self.least[target] + 1)
            self.lengths.append(mask)
            self.least.append(least)

    def common(self, p: int, q: int, longest: int) -> list[str]:
        """Rests of at most ``longest`` code points that both states accept."""
        out = []
        todo = [(p, q, "")]
        arcs, final, lengths, least = self.arcs, self.final, self.lengths, self.least
        while todo:
            p, q, rest = todo.pop()
            if not lengths[p] & lengths[q] or len(rest) + max(least[p], least[q]) > longest:
                continue
            if final[p] and final[q]:
                out.append(rest)
            other = arcs[q]
            for c, target in arcs[p].items():
                if c in other:
                    todo.append((target, other[c], rest + c))
        return out

    def edits(self, state: int, longest: int) -> list[tuple[str, str]]:
        """Pairs of rests accepted from one state that differ by an edit right here."""
        out = []
        arcs = sorted(self.arcs[state].items())
        for i, (c, p) in enumerate(arcs):
            for d, q in arcs[i + 1 :]:
                if self.lengths[p] & self.lengths[q]:
                    out += [(c + rest, d + rest) for rest in self.common(p, q, longest)]
            # canonical: a rest that goes on with c has a later edit
            out += [(rest, c + rest) for rest in self.common(p, state, longest) if not rest.startswith(c)]
        return out

    def pairs(self, longest: int = 1 << 30) -> Iterator[tuple[str, str]]:
        """All pairs of words one edit apart, with a rest of at most ``longest``."""
        here = [self.edits(s, longest) for s in range(len(self.arcs))]
        below = []
        for s, arcs in enumerate(self.arcs):
            below.append(bool(here[s]) or any(below[t] for t in arcs.values()))
        todo = [(len(self.arcs) - 1, "")]
        while todo:
            state, prefix = todo.pop()
            if below[state]:
                for x, y in here[state]:
                    yield prefix + x, prefix + y
                todo += [(t, prefix + c) for c, t in self.arcs[state].items()]


class _Near:
    """Near words of each word: their number and the most frequent one."""

    def __init__(self, side: int, counts: dict[str, int]):
        self.side, self.counts = side, counts
        self.found: dict[str, list] = defaultdict(lambda: [0, 0, ""])

    def add(self, x: str, y: str) -> None:
        if self.side:
            if x[-PREFIX:] == y[-PREFIX:]:  # found among the words themselves
                return
            x, y = x[::-1], y[::-1]
        for a, b in ((x, y), (y, x)):
            n = self.counts[b[::-1] if self.side else b]
            have = self.found[a]
            have[0] += 1
            if n > have[1] or (n == have[1] and b < have[2]):
                have[1:] = n, b


def _near_rows(found: list[_Near]) -> pa.RecordBatch:
    rows = [(w, *x) for near in found for w, x in near.found.items()]
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
        names=["word", "n_near", "best_n", "best"])


_NEAR = "word string, n_near long, best_n long, best string"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row is a partition: (side, words)."""
    for batch in batches:
        found = []
        for side, members in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = {m["body"]: m["n"] for m in members.as_py()}
            words = sorted(counts)
            skip = len(os.path.commonprefix((words[0], words[-1])))
            start = words[0][:skip]
            near = _Near(side, counts)
            acceptor = Acceptor([w[skip:] for w in words])
            for x, y in acceptor.pairs(PREFIX - 1 if side else 1 << 30):
                near.add(start + x, start + y)
            found.append(near)
        yield _near_rows(found)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row is a rest behind one state: (side, words with the code point before the rest)."""
    for batch in batches:
        found = []
        for side, rest, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            members = members.as_py()
            near = _Near(side, {m["body"]: m["n"] for m in members})
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    # one holds the rest alone: the other's code point must not begin it
                    if (a["mark"] and b["mark"]) or not rest.startswith(a["mark"] or b["mark"]):
                        near.add(a["body"], b["body"])
            found.append(near)
        yield _near_rows(found)


def _common_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        side, key, low, high = (batch.column(i) for i in range(4))
        prefix = [os.path.commonprefix(p) for p in zip(low.to_pylist(), high.to_pylist())]
        yield pa.RecordBatch.from_arrays([side, key, pa.array(prefix, pa.string())], names=["side", "key", "prefix"])


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words; ``words`` is (word, n)."""
    rows = words.select("n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("body")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("body")),
    )).alias("x")).select("x.side", F.substring("x.body", 1, PREFIX).alias("key"), "x.body", "n")
    found = None
    while True:
        sizes = rows.groupBy("side", "key").agg(
            F.count("*").alias("k"), F.sum(F.length("body") - F.length("key") + 1).alias("size"),
            F.min("body").alias("low"), F.max("body").alias("high"),
        )
        large = stored(map_batches(
            sizes.where((F.col("size") > part) & (F.col("k") > 1)).select("side", "key", "low", "high"),
            _common_prefix, "side int, key string, prefix string"))
        over = not large.isEmpty()
        fits = salted_filter(rows, large, ["side", "key"], ["body"], anti=True) if over else rows
        groups = (
            fits.groupBy("side", "key").agg(F.collect_list(F.struct("body", "n")).alias("members"))
            .where(F.size("members") > 1).select("side", "members")
        )
        near = stored(map_batches(groups, _composed, _NEAR))
        if over:
            split = stored(
                salted_lookup(rows, large, ["side", "key"], ["body"], "inner")
                .select("side", "prefix", "body", "n", F.expr("substring(body, length(prefix) + 1)").alias("left"))
            )
            # a word that ends here has no arc, only its empty rest
            marked = split.select("side", "prefix", "body", "n", F.explode(F.expr(
                "if(left = '', array(struct('' AS mark, left AS rest)), array(struct('' AS mark, left AS rest),"
                " struct(substring(left, 1, 1) AS mark, substring(left, 2) AS rest)))")).alias("x"),
            ).select("side", "prefix", "body", "n", "x.mark", "x.rest").where(
                (F.col("side") == 0) | (F.length("rest") < PREFIX))
            rests = (
                marked.groupBy("side", "prefix", "rest")
                .agg(F.collect_list(F.struct("body", "mark", "n")).alias("members"))
                .where(F.size("members") > 1).select("side", "rest", "members")
            )
            near = near.unionByName(stored(map_batches(rests, _edited, _NEAR)))
        found = near if found is None else found.unionByName(near)
        if not over:
            break
        rows = split.where(F.col("left") != "").select(
            "side", F.expr("substring(body, 1, length(prefix) + 1)").alias("key"), "body", "n")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to.

    Each round doubles the way that is known; a form is ``RATIO`` times as frequent as
    its word, so a way is short.
    """
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(salted_lookup(known, onward, ["root"], ["word"]))
        known = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where(F.col("further").isNotNull()).isEmpty():
            return known


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Each word with its form, its root and its near words' number."""
    words = stored(count_words(docs, id_col, text_col))
    near = near_words(words, part)
    formed = stored(
        words.join(near, "word", "left")
        .withColumn("is_form", F.coalesce(F.col("best_n") >= F.col("n") * RATIO, F.lit(False)))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(F.col("is_form"), F.col("best")).alias("form"),
            F.when(F.col("is_form"), F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
