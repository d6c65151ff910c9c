"""SimHash near duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half of the hashes of the text's
3-word shingles. Every bit position gets a non-zero vector of ``RADIUS + 1`` bits; the
table of mask ``v`` keeps the positions whose vector has an odd inner product with
``v``. ``RADIUS`` differing positions cannot span the whole space, so a ``v`` is
orthogonal to all of them: every pair within the radius has equal keys in some of the
``2**(RADIUS + 1) - 1`` tables, and a table compares about 34 bits.

Only different fingerprints are compared. A bucket of up to ``BUCKET`` of them is
compared in one task and gives a spanning forest of its links, not its pairs. A larger
one is covered again: its fingerprints agree on the key's bits, so masks over the
other positions alone split it exactly the same way; each round halves the open
positions, and once ``LEAF_BITS`` are open a bucket has at most ``2**LEAF_BITS``
members. No pair is lost and no bucket is cut.

Components are found by label propagation with shortcuts, on stored tables.

Defined cases: null and empty texts have fingerprint zero and are linked like others;
texts of fewer than three words have one shingle; repeated rows are each returned;
a null id takes the component of its fingerprint but never names one (a component of
null ids alone is null); other columns pass unchanged, but ``fingerprint`` and
``component_id`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.scale import salted_filter, stored
from auditlake.llm.words import map_batches, parts, texts

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 2048
LEAF_BITS = 10
# 16 counters of 4 x 16 bits cover 64 bits; a counter takes this many shingles
_STEP = 60_000
_LANES = np.uint64(0x0001000100010001)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _STEP):
        part = hashes[lo : lo + _STEP]
        for j in range(16):
            lanes = int(((part >> np.uint64(j)) & _LANES).sum(dtype=np.uint64))
            for k in range(4):
                counts[j + 16 * k] += lanes >> (16 * k) & 0xFFFF
    return counts


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - SHINGLE + 1)
    last = end[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist())),
        dtype=np.uint64, count=n,
    )


_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    return int(_WEIGHT[_bit_counts(hashes) * 2 > len(hashes)].sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``simhash``, the fingerprint as a signed number."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints = np.array([fingerprint(t) for t in texts(batch, text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep),
                 pa.array(prints.view(np.int64))],
                names=schema.names,
            )

    wanted = list(dict.fromkeys([*keep, text_col]))
    return map_batches(docs.select(*(f"`{c}`" for c in wanted)), run, schema)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks of which, for every ``radius`` of the positions, one has none of them."""
    vectors = 1 << (radius + 1)
    of = {p: 1 + i % (vectors - 1) for i, p in enumerate(positions)}
    return [
        sum(1 << p for p in positions if bin(of[p] & v).count("1") % 2)
        for v in range(1, vectors)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect what is connected within ``radius`` in one bucket."""
    n = len(prints)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1
        if len(near):
            joined = np.unique(root[np.concatenate([[i], near])])
            if len(joined) > 1:
                root[np.isin(root, joined[1:])] = joined[0]
    apart = np.flatnonzero(root != np.arange(n))
    return prints[apart], prints[root[apart]]


def link_prints(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links between different fingerprints that connect all pairs within ``radius``.

    ``prints`` has one row ``simhash`` for each; the result is (a, b).
    """
    level = prints.select("simhash", F.lit(0).cast("bigint").alias("closed"))
    closed_sets, links = [0], None
    while True:
        masks = {c: [m | c for m in covering_masks([p for p in range(64) if not c >> p & 1], radius)]
                 for c in closed_sets}
        tables = F.lit(None).cast("array<bigint>")
        for closed, own in masks.items():
            tables = F.when(
                F.col("closed") == _signed(closed), F.array(*(F.lit(_signed(m)) for m in own))
            ).otherwise(tables)
        rows = stored(
            level.select("simhash", F.explode(tables).alias("mask"))
            .select("simhash", "mask", F.col("simhash").bitwiseAND(F.col("mask")).alias("key"))
        )
        leaves = [_signed(m) for own in masks.values() for m in own if 64 - m.bit_count() <= LEAF_BITS]
        large = stored(
            rows.groupBy("mask", "key").agg(F.count("*").alias("n"))
            .where((F.col("n") > bucket) & ~F.col("mask").isin(leaves)).select("mask", "key")
        )
        # masks, of which there are 15 for each closed set
        over = [r.mask for r in large.select("mask").distinct().collect()]
        fits = salted_filter(rows, large, ["mask", "key"], ["simhash"], anti=True) if over else rows
        found = stored(bucket_links(fits, radius))
        links = found if links is None else links.unionByName(found)
        if not over:
            return links.distinct()
        level = (
            salted_filter(rows, large, ["mask", "key"], ["simhash"])
            .select("simhash", F.col("mask").alias("closed"))
        )
        closed_sets = [m & ((1 << 64) - 1) for m in over]


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links inside each (mask, key); groups are bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten().to_numpy().view(np.uint64)
            size = pa.compute.list_value_length(column).to_numpy()
            ends = np.cumsum(size)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            # most buckets hold two
            two = ends[size == 2]
            a, b = flat[two - 2], flat[two - 1]
            near = np.bitwise_count(a ^ b) <= radius
            out.append((a[near], b[near]))
            for end, n in zip(ends[size > 2], size[size > 2]):
                out.append(_forest(flat[end - n : end], radius))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    lists = rows.groupBy("mask", "key").agg(F.collect_list("simhash").alias("prints")).select("prints")
    lists = lists.where(F.size("prints") > 1)
    return map_batches(lists, run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the (a, b) links is connected with.

    Each round a node takes the smallest label around it, its old label's node learns
    of it, and labels are replaced by their own labels.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        )
        met = stored(labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("new")))
        # a label's node hears of the smallest label met by those who have it
        heard = met.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("heard"))
        hooked = stored(met.join(heard, "node", "left").select(
            "node", "old", F.least("new", "heard").alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(hooked.join(jump, "label").select("node", "old", F.col("further").alias("label")))
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    keep: list[str] | None = None, label_col: str | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) with ``fingerprint`` and ``component_id``.

    ``label_col`` names a further column, the component's smallest fingerprint.
    """
    new = ("simhash", "fingerprint", "component_id")
    keep = [c for c in (keep or docs.columns) if c not in new]
    tagged = stored(with_fingerprints(docs, text_col, keep))
    prints = stored(tagged.groupBy("simhash").agg(F.min(id_col).alias("first")))
    links = link_prints(prints.select("simhash"), radius)
    labels = components(links).withColumnRenamed("node", "simhash")
    # a fingerprint without links is a component of its own
    named = prints.join(labels, "simhash", "left").select(
        "simhash", "first", F.coalesce("label", "simhash").alias("label")
    )
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    own = [F.col("label").alias(label_col)] if label_col else []
    by_print = stored(named.join(first, "label").select("simhash", "component_id", *own))
    return tagged.join(by_print, "simhash").select(
        *keep, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id",
        *([label_col] if label_col else []),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id, once.

    Documents without id whose component has no id at all stay once for each
    fingerprint. Components are told apart by their label, as ids may repeat.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("row_hash"))
    found = near_duplicates(rows, "id", "text", keep=["id", "row_hash"], label_col="group")
    first = (
        found.where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("group", F.col("id").alias("stay_id"), F.when(F.col("id").isNull(), F.col("fingerprint")))
        .agg(F.min("row_hash").alias("stay_hash"))
        .select("stay_id", "stay_hash").distinct()
    )
    tag = max(docs.columns, key=len) + "_hash"  # longer than any other name
    tagged = docs.withColumn(tag, F.xxhash64(text_col))
    return tagged.join(
        first,
        F.col(id_col).eqNullSafe(F.col("stay_id")) & (F.col(tag) == F.col("stay_hash")),
        "left_semi",
    ).dropDuplicates([id_col, tag]).drop(tag)
