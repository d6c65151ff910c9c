"""Best-fit packing with dominance reduction.

Documents become token pieces of at most ``capacity``; only longer ones are cut. How
many pieces have each length is all that the packing depends on, so it is solved on
that histogram, which has at most ``capacity`` entries whatever the input:

1. Reduction (Martello and Toth). A set that provably dominates every other set with
   the same piece is fixed for good: a piece alone if nothing fits beside it; a
   piece with the largest one that fits, if the two fill a sequence, or no two
   others fit beside the piece, or no two others that fit together exceed that one.
   A fix covers as many sequences at once as both lengths allow.
2. What remains is packed best-fit, longest first, again many equal sequences at once.

The result is a list of patterns with multiplicities; a piece finds its place from
its length and its number among the pieces of that length. Numbers come from counters
of the writing tasks, frozen in a stored table, plus running sums over tasks.

Defined cases: null and empty texts are one piece with the end token alone; a document
of a multiple of ``capacity`` tokens has full pieces only; repeated rows are packed
each; an empty table gives no rows; of the other columns only ``id_col`` is carried.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.scale import stored
from auditlake.llm import bpe
from auditlake.llm.words import map_batches, parts

CAPACITY = 2048
END_ID = 0
CACHE = 150_000
PIECE = 64
_ORD_BITS = 44


class TokenIds(dict):
    """Ids of text parts as little-endian 32-bit values.

    For lower-casing tokenizers that drop white space: parts between spaces and line
    feeds are encoded on their own. The first ``CACHE`` parts of at most ``PIECE``
    characters stay; frequent ones come early.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = bpe.load(path)
        self.model = self.tokenizer.model
        self.names = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, part: str) -> bytes:
        ids = self.of(part)
        if len(self) < CACHE and len(part) <= PIECE:
            self[part] = ids
        return ids

    def of(self, part: str) -> bytes:
        names = self.names
        if plain := bpe.PLAIN.fullmatch(part):
            word, tail = plain[2].lower(), plain[3]
            ids = [names[t.id] for t in self.model.tokenize(word if word.isascii() else bpe.pretoken(word))]
            if tail:
                ids += [names[t.id] for t in self.model.tokenize(tail)]
        else:
            ids = [names[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document, numbered by length within the task that wrote them."""
    schema = T.StructType([
        docs.schema[id_col],
        *(T.StructField(n, t) for n, t in (
            ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
            ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("number", T.LongType()))),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table = bpe.worker_table("ids", tokenizer_path, lambda: TokenIds(tokenizer_path))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i, text in enumerate(texts):
                ids = table.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    values = (i, piece, at // 4, length, zlib.crc32(own), int(seen[length]), own)
                    for out, v in zip(rows, values):
                        out.append(v)
                    seen[length] += 1
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]),
                    pa.array(np.full(n, task, dtype=np.int32)), pa.array(rows[5], pa.int64()),
                    *([pa.array(rows[6], pa.binary())] if with_ids else []),
                ],
                names=schema.names,
            )

    return map_batches(docs.select(id_col, text_col), run, schema)


@dataclass
class Packing:
    """Patterns: (number of sequences, {length: pieces of it in each})."""

    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    fixed: int = 0  # sequences settled by dominance

    @property
    def n_sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


def _two_largest(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """Largest sum of two different pieces that fits ``room`` together; 0 if none."""
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        total = sizes[lo] + sizes[hi]
        if total <= room:
            if lo < hi or counts[sizes[lo]] > 1:
                best = max(best, total)
            lo += 1
        else:
            hi -= 1
    return best


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Pack ``counts[length]`` pieces of each length."""
    left = {s: n for s, n in counts.items() if n}
    out = Packing()
    sizes = sorted(left)

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    for j in sorted(left, reverse=True):
        while j in left:
            n_j, room = left[j], capacity - j
            others = dict(left)
            others[j] -= 1
            fits = [s for s in sizes if s <= room and others[s]]
            if not fits:
                out.patterns.append((n_j, {j: 1}))
                take(j, n_j)
                continue
            k = fits[-1]
            first = fits[0]
            second = first if others[first] > 1 else (fits[1] if len(fits) > 1 else capacity + 1)
            if not (k == room or first + second > room or _triple_free(fits, others, room) and k >= _two_largest(fits, others, room)):
                break
            # n sequences of this pair stay dominant while both lengths last and, where the
            # reason lies in what else is left, others only become fewer
            n = n_j // 2 if k == j else min(n_j, left[k])
            out.patterns.append((n, {j: 2} if k == j else {j: 1, k: 1}))
            take(j, n * (2 if k == j else 1))
            if k != j:
                take(k, n)
    out.fixed = out.n_sequences
    _best_fit(left, capacity, out)
    return out


def _triple_free(fits: list[int], counts: dict[int, int], room: int) -> bool:
    """Whether no three pieces fit ``room`` together."""
    total, need = 0, 3
    for s in fits:
        n = min(need, counts[s])
        total, need = total + n * s, need - n
        if not need:
            break
    return need > 0 or total > room


def _best_fit(left: dict[int, int], capacity: int, out: Packing) -> None:
    """Best fit, longest first; equal sequences are filled together."""
    rooms: list[int] = []  # sorted free space of open sequences
    groups: dict[int, list[tuple[int, Counter]]] = defaultdict(list)

    def put(n: int, held: Counter, room: int) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append((n, held))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                open_n, held = groups[room].pop()
                if not groups[room]:
                    rooms.pop(i)
            else:
                room, held = capacity, Counter()
                open_n = -(-n // (capacity // size))
            each = room // size
            whole = min(open_n, n // each)
            if whole:
                put(whole, held + Counter({size: each}), room - each * size)
            n -= whole * each
            open_n -= whole
            if open_n and n:  # fewer than fill one more
                put(1, held + Counter({size: n}), room - n * size)
                open_n, n = open_n - 1, 0
            if open_n:
                put(open_n, held, room)
    for room in rooms:
        out.patterns += [(n, dict(held)) for n, held in groups[room]]


def places(packing: Packing) -> dict[str, np.ndarray]:
    """Where pieces go: runs of piece numbers of a length, sorted by (length, number)."""
    rows, used, first = [], Counter(), 0
    for n, held in packing.patterns:
        offset = 0
        for size, each in sorted(held.items(), reverse=True):
            rows.append((size << _ORD_BITS | used[size], first, each, offset, size))
            used[size] += n * each
            offset += size * each
        first += n
    rows.sort()
    names = ("key", "first", "each", "offset", "size")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; ``with_ids`` adds its token ids."""
    pieces = stored(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most one row a length
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(solve(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    carried = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = pieces.join(starts, ["task", "length"]).select(
        *carried, (F.col("before") + F.col("number")).alias("number")
    )
    schema = T.StructType([
        *(numbered.schema[c] for c in carried),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            key = get("length").to_numpy() << _ORD_BITS | get("number").to_numpy()
            at = np.searchsorted(p["key"], key, side="right") - 1
            nth, each = key - p["key"][at], p["each"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(get(c) for c in carried),
                    pa.array(p["first"][at] + nth // each),
                    pa.array(p["offset"][at] + nth % each * p["size"][at]),
                ],
                names=schema.names,
            )

    return map_batches(numbered, run, schema)
