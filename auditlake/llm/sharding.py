"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (text hash, id hash, row number), all as unsigned 64-bit numbers; the
number of a row in its writing task tells repeated rows apart and is frozen in a stored
table. The 192-bit key is read in digits, 12 bits first and then 8: a round counts exact bytes and rows for
every value of the next digit under each prefix that holds an unsettled splitter,
on all partitions at once, and sends only these counts (4,096 at most, then 256 a
prefix) to the driver. A splitter whose nearest cell border is within the tolerance is
settled; the others go on inside their cell. Then the rows move once, to their
part of a shard, where they are numbered; counts of the parts before it make the
numbers of a shard gapless.

Splitters bound parts of shards: a shard has ``parts`` parts, so no task gets more
than a part, also where equal texts are a third of all rows. Equal texts are
neighbours in the order and share a shard except where a splitter falls inside
their group.

Defined cases: a null text counts as empty (1 byte); repeated
rows are placed each on its own, and a group of them is cut where a splitter falls
inside it, null ids included; an empty table gives no rows; only the named columns and ``keep`` are carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scale import stored

KEY = ("k1", "k2", "k3")
# digits of the key from the top: column, bits below the digit, bits of the digit
DIGITS = [(c, s, b) for c in KEY
          for s, b in ((52, 12), (44, 8), (36, 8), (28, 8), (20, 8), (12, 8), (4, 8), (0, 4))]
TOLERANCE = 0.001
PARTS = 8


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus one; one for null."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("bigint")


def digit(i: int) -> Column:
    c, shift, bits = DIGITS[i]
    return F.shiftrightunsigned(F.col(c), shift).bitwiseAND((1 << bits) - 1).cast("int")


def prefix(n: int) -> Column:
    """The first ``n`` digits as an array."""
    return F.array(*(digit(i) for i in range(n))) if n else F.expr("cast(array() as array<int>)")


@dataclass
class Splitters:
    """Settled borders, each the first key of the part above it, as digits."""

    borders: list[tuple[int, ...]] = field(default_factory=list)
    rounds: int = 0
    total_bytes: int = 0


def find_splitters(rows: DataFrame, n: int, tolerance: int) -> Splitters:
    """Borders that cut the bytes of (k1, k2, k3, size) into ``n`` parts, each within ``tolerance``."""
    out = Splitters()
    targets: dict[tuple[int, ...], list[tuple[int, int]]] | None = None  # prefix -> (target, bytes before)
    for depth in range(len(DIGITS)):
        cells = rows.select(prefix(depth).alias("p"), digit(depth).alias("d"), "size")
        if depth:
            wanted = rows.sparkSession.createDataFrame(
                [(list(p),) for p in targets], "p array<int>"
            )
            cells = cells.join(F.broadcast(wanted), "p")  # at most n - 1 prefixes
        counts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for p, d, size in cells.groupBy("p", "d").agg(F.sum("size")).collect():
            counts.setdefault(tuple(p), []).append((d, size))
        if depth == 0:
            out.total_bytes = sum(s for _, s in counts.get((), []))
            step = out.total_bytes / n
            targets = {(): [(round(step * j), 0) for j in range(1, n)]}
        out.rounds += 1
        deeper: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for p, goals in targets.items():
            below = goals[0][1] if goals else 0
            row = sorted(counts.get(p, []))
            goals = [g for g, _ in goals]
            for d, size in row:
                above = below + size
                while goals and goals[0] <= above:
                    goal = goals.pop(0)
                    last = depth + 1 == len(DIGITS)
                    if min(goal - below, above - goal) <= tolerance or last:
                        low = goal - below <= above - goal
                        out.borders.append((*p, d) if low else (*p, d + 1))
                    else:
                        deeper.setdefault((*p, d), []).append((goal, below))
                below = above
        if not deeper:
            break
        targets = deeper
    full = len(DIGITS)
    out.borders = sorted({(*b, *[0] * (full - len(b))) for b in out.borders})
    return out


def _key(border: tuple[int, ...]) -> tuple[int, ...] | None:
    """A border as signed 64-bit numbers in the order of the digits; None above all keys."""
    words = []
    carry = 0
    for c in reversed(KEY):
        value = carry + sum(d << s for d, (k, s, _) in zip(border, DIGITS) if k == c)
        carry, value = value >> 64, value & ((1 << 64) - 1)
        words.append(value - (1 << 63))
    return None if carry else tuple(reversed(words))


def place(rows: DataFrame, shards: int = 16, parts: int = PARTS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``shard``, and ``slot`` gapless from 0 in a shard, to stored (k1, k2, k3, size, ...).

    ``tolerance`` is a share of a shard's bytes. A shard's bytes differ from an even
    share by at most twice that, or by one row.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    found = find_splitters(rows, shards * parts, int(tolerance * total / shards))
    step = total / (shards * parts) if total else 1
    # how many bytes lie below each border decides which part begins there
    signed = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(c) for c in KEY]
    borders = [k for b in found.borders if (k := _key(b))]
    others = [c for c in rows.columns if c not in KEY]
    keyed = rows.select(*signed, *others)
    spark = rows.sparkSession
    # borders by their top digit: a row compares itself with those under its own alone
    cells: dict[int, list[tuple[int, ...]]] = {}
    for border in borders:
        cells.setdefault((border[0] + (1 << 63)) >> 52, []).append(border)
    table, before = [], 0
    for cell in range(1 << 12):
        own = cells.get(cell, [])
        table.append((cell, before, own))
        before += len(own)
    lookup = spark.createDataFrame(
        table, "cell int, before int, own array<struct<k1:bigint,k2:bigint,k3:bigint>>"
    )
    here = F.struct(*KEY)
    placed = (
        keyed.withColumn(
            "cell",
            F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(-(1 << 63))), 52).cast("int"),
        )
        .join(F.broadcast(lookup), "cell")  # 4,096 rows whatever the input
        .withColumn("part", F.col("before") + F.size(F.filter("own", lambda b: b <= here)))
        .drop("cell", "before", "own")
    )
    sums = sorted(
        (r.part, r.n, r.size)
        for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    )
    starts, below, counts = [], 0, dict.fromkeys(range(shards), 0)
    for part, n, size in sums:
        # the border nearest to a shard's due start begins it
        shard = min(shards - 1, int((below + step / 2) // (step * parts)))
        starts.append((part, shard, counts[shard]))
        counts[shard] += n
        below += size
    starts_df = spark.createDataFrame(starts, "part int, shard int, start bigint")
    order = Window.partitionBy("part").orderBy(*KEY)
    return (
        placed.withColumn("rn", F.row_number().over(order))
        .join(F.broadcast(starts_df), "part")  # one row a part
        .select(*others, "shard", (F.col("start") + F.col("rn") - 1).alias("slot"))
    )


def shard_rows(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    keep: dict[str, Column] | None = None, parts: int = PARTS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Place all rows: ``id_col``, ``size``, what ``keep`` names, ``shard`` and ``slot``.

    Narrow rows are stored once, so texts are read once; pass a text as ``keep`` to
    carry it along.
    """
    rows = docs.select(
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k1"),
        F.xxhash64(id_col).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
        F.col(id_col),
        text_bytes(F.col(text_col)).alias("size"),
        *(c.alias(name) for name, c in (keep or {}).items()),
    )
    return place(stored(rows), shards, parts, tolerance)
