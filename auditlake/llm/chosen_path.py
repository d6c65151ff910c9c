"""Near duplicates by set similarity: a chosen-path join of shingle sets.

A document's set holds its different ``SHINGLE``-word shingles; documents are linked if
``100 * intersection >= SHARE * union``. Equal sets are one set from the start.

``TREES`` independent trees branch sets by minwise tokens. A set lies in ``BRANCHES``
nodes below a root, one for its minimum under each of the root's hash functions; two sets of
similarity s share such a node with probability s each. A node is

* dropped if its sets are known to be connected already;
* compared exhaustively if that takes at most ``COMPARED`` comparisons of sets that are not
  known to be connected (and the node at most ``MEMBERS`` rows);
* branched otherwise, by ``BRANCHES`` other hash functions that the path selects. Before,
  all members are compared with two of them, one being that which shares most minwise
  tokens with other sets, so that a large group of near copies is connected early and its
  nodes are dropped.

Pairs within the threshold survive a tree of any depth with probability 0.9375 at least
(two branches at s = 0.8: q = (0.2 + 0.8 q)**2 has the root 0.0625) and are lost by
all five with 1e-6 at most.

Comparisons first use ``FUNCTIONS`` one-byte sketches, with a margin of 4.7 standard
deviations below the threshold; every link is then confirmed on the full sets, as exact
64-bit shingle hashes. A small node first gives a star forest of likely pairs, each of
which is confirmed once. Members that still have a candidate in another component then
meet in their node with their texts, in parts of bounded size, and links are confirmed
there until all that is linked is connected. So no link between components is lost, and a group
of k near copies costs about k confirmations, not k squared.

Defined cases: null and empty texts have the empty set and are linked with nothing, also
not with each other; texts of one word have one shingle; repeated rows are each
returned; a null id never names a component (a component of null ids alone is null, and
these rows are kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.scale import salted_filter, salted_lookup, stored, storing
from auditlake.llm.collocations import bitmap, passes
from auditlake.llm.components import connected
from auditlake.llm.words import Words, map_batches, mixed, parts, pieces, texts

SHINGLE = 2
SHARE = 80
TREES = 5
BRANCHES = 2
FUNCTIONS = 128
#: Equal sketch bytes of a candidate: 128 * 0.8 less 4.7 standard deviations.
ENOUGH = 80
#: Equal sketch bytes of a pair that is tried first.
LIKELY = 102
#: The same margin for the first bytes alone.
HEAD, HEAD_ENOUGH = 32, 12
COMPARED = 1 << 22
BLOCK = 1 << 21
STAR = 128
LISTED = 1024
MEMBERS = 1 << 14
_ODD = np.random.default_rng(20250611).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_XOR = np.random.default_rng(20250612).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)


def shingle_sets(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted different shingles of text i are hashes[first[i]:first[i + 1]]."""
    words = Words([t.lower() for t in raw])
    hashes = words.hashes()
    found, at = words.windows(hashes, SHINGLE)
    doc = words.doc[at]
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < SHINGLE))
    # the whole sequence, so one word here
    found = np.concatenate([found, mixed(hashes[words.first[short]] ^ np.uint64(1))])
    doc = np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(raw) + 1))


def set_ids(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, null for the empty one."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(s)))]) for s in (5, 7)]
    n = np.diff(first)
    both = np.stack([mixed(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)) for s in sums], axis=1)
    return [row.tobytes() if k else None for row, k in zip(both, n.tolist())]


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minimum of each set under each function; sets are not empty."""
    out = np.empty((len(first) - 1, FUNCTIONS), dtype=np.uint64)
    for i in range(FUNCTIONS):
        out[:, i] = np.minimum.reduceat((hashes ^ _XOR[i]) * _ODD[i], first[:-1])
    return out


def with_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_hash, n, sid, roots, sketch) of each document."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("row_hash", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("sid", T.BinaryType()),
        T.StructField("roots", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            raw = texts(batch, "text")
            n, sid, roots, sketch = [], [], [], []
            for a, b in pieces(raw):
                hashes, first = shingle_sets(raw[a:b])
                sid += set_ids(hashes, first)
                size = np.diff(first)
                n += size.tolist()
                full = np.flatnonzero(size)
                own_roots, own_sketch = [[]] * (b - a), [None] * (b - a)
                if len(full):
                    least = minima(hashes, np.concatenate([first[full], first[-1:]]))
                    count = TREES * BRANCHES
                    tops = mixed(least[:, :count] + np.arange(1, count + 1, dtype=np.uint64)).view(np.int64)
                    bits = (mixed(least) & np.uint64(255)).astype(np.uint8)
                    for i, top, bit in zip(full.tolist(), tops.tolist(), bits):
                        own_roots[i], own_sketch[i] = top, bit.tobytes()
                roots += own_roots
                sketch += own_sketch
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("id")),
                batch.column(batch.schema.get_field_index("row_hash")),
                pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary()),
            ], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("row_hash"))
    return map_batches(rows, run, schema)


def split_sets(raw: list[bytes]) -> list[np.ndarray]:
    """The shingles of each text, sorted."""
    out = []
    for a, b in pieces(raw):
        hashes, first = shingle_sets(raw[a:b])
        out += [hashes[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    return out


def with_texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` rows with the ``text`` of their (id, row_hash), repeated rows as often."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("row_hash"))
    # texts that cannot be wanted are passed over before any text moves
    bits = bitmap(wanted.select(F.xxhash64("id", "row_hash").alias("token")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column(batch.schema.get_field_index("token")).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(passes(bits, token)))

    rows = rows.withColumn("token", F.xxhash64("id", "row_hash"))
    rows = map_batches(rows, likely, rows.schema)
    wanted = wanted.withColumnsRenamed({"id": "want_id", "row_hash": "want_hash"})
    same = rows["id"].eqNullSafe(wanted["want_id"]) & (rows["row_hash"] == wanted["want_hash"])
    return rows.join(wanted, same).select(
        *(c for c in wanted.columns if c not in ("want_id", "want_hash")), "text")


def _sizes_fit(m, n):
    return 100 * np.minimum(m, n) >= SHARE * np.maximum(m, n)


def _equal_bytes(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count((sketches == one).view(np.uint64)).sum(axis=-1)


class Node:
    """Members of one node, by ascending size of their sets."""

    def __init__(self, sids: list[bytes], n: np.ndarray, sketches: np.ndarray, labels: np.ndarray):
        order = np.lexsort((np.arange(len(n)), n))
        self.order, self.sids = order, [sids[i] for i in order.tolist()]
        self.n, self.sketches, self.labels = n[order], sketches[order], labels[order]
        self.heads = np.ascontiguousarray(self.sketches[:, :HEAD])

    def near(self, labels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, later members that are candidates of i, equal sketch bytes); a candidate has
        another label. ``labels`` may change while this runs."""
        labels = self.labels if labels is None else labels
        ends = np.searchsorted(self.n, 100 * self.n // SHARE, side="right")  # sizes that fit
        for i, last in enumerate(ends.tolist()):
            if last <= i + 1:
                continue
            head = _equal_bytes(self.heads[i + 1 : last], self.heads[i]) >= HEAD_ENOUGH
            other = np.flatnonzero(head & (labels[i + 1 : last] != labels[i])) + i + 1
            if len(other):
                equal = _equal_bytes(self.sketches[other], self.sketches[i])
                enough = equal >= ENOUGH
                if enough.any():
                    yield i, other[enough], equal[enough]

    def stars(self) -> tuple[list[tuple[bytes, bytes]], bool]:
        """(a forest of likely pairs, whether there are further candidates): a member is
        paired with the first that it is near to and that is not paired itself."""
        star = np.full(len(self.n), -1)
        pairs, more = [], False
        for i, near, equal in self.near():
            likely = near[equal >= LIKELY] if star[i] < 0 else near[:0]
            free = likely[star[likely] < 0]
            more = more or len(near) > len(free)
            star[free] = i
            pairs += [(self.sids[j], self.sids[i]) for j in free.tolist()]
        return pairs, more

    def blocks(self, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, members) of parts of the node that hold all candidate pairs between them,
        each of about twice ``size`` shingles at most."""
        block = np.cumsum(self.n) // size
        parts: dict[int, list[np.ndarray]] = {}
        for i, near, _ in self.near():
            for other in np.unique(block[near]).tolist():
                part = parts.setdefault(int(block[i]) << 20 | other, [])
                part.append(near[block[near] == other])
                part.append(np.array([i]))
        for number, members in parts.items():
            yield number, np.unique(np.concatenate(members))

    def links(self, shingles: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """A forest of confirmed links that connects all that is linked; ``shingles`` are the
        members' sets as first given."""
        shingles = [shingles[i] for i in self.order.tolist()]
        first = np.cumsum([0, *(len(x) for x in shingles)])
        codes = np.unique(np.concatenate(shingles), return_inverse=True)[1]
        held = np.zeros(int(codes.max()) + 1, dtype=bool)
        labels = self.labels.copy()
        found = []
        for i, near, _ in self.near(labels):
            own = codes[first[i] : first[i + 1]]
            held[own] = True
            inter = np.array([int(held[codes[first[j] : first[j + 1]]].sum()) for j in near.tolist()])
            held[own] = False
            linked = near[100 * inter >= SHARE * (self.n[i] + self.n[near] - inter)]
            for j in linked.tolist():
                if labels[j] != labels[i]:
                    found.append((self.sids[j], self.sids[i]))
                    labels[labels == labels[j]] = labels[i]
        return found


def _nodes(batch: pa.RecordBatch) -> Iterator[tuple[int, Node, pa.StructArray]]:
    """(number, node, its members) of each row of a (node, members) batch."""
    members = batch.column(1)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(members).to_numpy())])
    flat = members.flatten()
    sid = flat.field(0).to_pylist()
    n = flat.field(1).to_numpy()
    sketch = np.frombuffer(b"".join(flat.field(2).to_pylist()), dtype=np.uint8).reshape(-1, FUNCTIONS)
    place: dict[bytes, int] = {}
    label = np.array([place.setdefault(x, len(place)) for x in flat.field(3).to_pylist()], dtype=np.int64)
    for node, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
        yield node, Node(sid[a:b], n[a:b], sketch[a:b], label[a:b]), flat[a:b]


def _grouped(rows: DataFrame, *more: str) -> DataFrame:
    members = F.collect_list(F.struct("sid", "n", "sketch", "label", *more)).alias("members")
    return rows.groupBy("node").agg(members).where(F.size("members") > 1)


def star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, node): likely pairs with null node, and the nodes (a and b null) that hold
    further candidates. ``rows`` is (node, sid, n, sketch, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            pairs, further = set(), []
            for number, node, _ in _nodes(batch):
                got, more = node.stars()
                pairs.update(got)
                if more:
                    further.append(number)
            none = [None] * len(further)
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs] + none, pa.binary()),
                pa.array([p[1] for p in pairs] + none, pa.binary()),
                pa.array([None] * len(pairs) + further, pa.int64()),
            ], names=["a", "b", "node"])

    return map_batches(_grouped(rows), run, "a binary, b binary, node long").distinct()


def suspects(rows: DataFrame, block: int) -> DataFrame:
    """(node, part, sid): the members of each node that have candidates, in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            found = [(number, part, node.sids[i]) for number, node, _ in _nodes(batch)
                     for part, members in node.blocks(block) for i in members.tolist()]
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                names=["node", "part", "sid"])

    return map_batches(_grouped(rows), run, "node long, part long, sid binary")


def exact_links(rows: DataFrame) -> DataFrame:
    """(a, b): forests of confirmed links; ``rows`` has the members' ``text`` as well. Texts
    are smaller than their hashed shingles, so sets are made where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            for _, node, members in _nodes(batch):
                found = node.links(split_sets(members.field(4).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return map_batches(_grouped(rows, "text"), run, "a binary, b binary").distinct()


def nearest_pivots(rows: DataFrame) -> DataFrame:
    """(a, b): each member with that of its pivots whose sketch is nearest, if near at all;
    ``rows`` is (sid, n, sketch, p_sid, p_n, p_sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, FUNCTIONS)
                for i in (2, 5))
            m, n = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            equal = _equal_bytes(one, two)
            near = pa.array((equal >= ENOUGH) & _sizes_fit(m, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(near), batch.column(3).filter(near), pa.array(equal, pa.int64()).filter(near)],
                names=["a", "b", "equal"])

    chosen = rows.select("sid", "n", "sketch", "p_sid", "p_n", "p_sketch")
    met = map_batches(chosen, run, "a binary, b binary, equal long")
    return met.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("p")).select("a", F.col("p.b").alias("b"))


class Join:
    """The sets of some documents and what is known of their links."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.tagged = stored(with_sets(docs, id_col, text_col))
        self.sets = stored(self.tagged.where("n > 0").dropDuplicates(["sid"]))
        self.labels: DataFrame | None = None
        again = self.tagged.groupBy("id", "row_hash").agg(F.count("*").alias("k")).where("k > 1")
        self.repeated = not again.isEmpty()

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the links among (a, b) pairs: all a of one b meet it with their full sets, in
        groups of about ``STAR`` of them."""
        pairs, drop_pairs = storing(pairs)
        if pairs.isEmpty():
            return
        often = pairs.groupBy("b").agg((F.floor(F.count("*") / STAR) + 1).cast("int").alias("salts"))
        spread = salted_lookup(pairs, often, ["b"], ["a"], "inner").select(
            F.xxhash64("b", F.expr("pmod(xxhash64(a), salts)")).alias("node"), "a", "b")
        self.meet(
            spread.select("node", F.col("a").alias("sid")).unionByName(
                spread.select("node", F.col("b").alias("sid"))).distinct())
        drop_pairs()

    def meet(self, rows: DataFrame) -> None:
        """Adds the links that the members of (node, sid) groups have in them. A text is
        fetched once for up to about ``LISTED`` of its set's nodes."""
        rows, drop_rows = storing(rows)
        many = (
            rows.groupBy("sid").agg((F.floor(F.count("*") / LISTED) + 1).cast("int").alias("salts"))
            .where("salts > 1")
        )
        lists = (
            salted_lookup(rows, many, ["sid"], ["node"])
            .groupBy("sid", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).alias("list"))
            .agg(F.collect_list("node").alias("nodes"))
        )
        wanted, drop_wanted = storing(
            self.known(rows).join(self.sets.select("sid", "id", "row_hash"), "sid").join(lists, "sid"))
        met = with_texts(self.docs, self.id_col, self.text_col, wanted)
        if self.repeated:
            met = met.dropDuplicates(["sid", "list"])
        self.add(exact_links(met.withColumn("node", F.explode("nodes"))))
        drop_wanted()
        drop_rows()

    def add(self, links: DataFrame) -> None:
        links = stored(links)
        if not links.isEmpty():
            # the components so far stand for the links they came from
            if self.labels is not None:
                links = links.unionByName(self.labels.select(F.col("sid").alias("a"), F.col("label").alias("b")))
            self.labels = connected(links).select(F.col("node").alias("sid"), "label")

    def known(self, sids: DataFrame | None = None) -> DataFrame:
        """(sid, n, sketch, label) of each set, or of these."""
        sets = self.sets.select("sid", "n", "sketch")
        if sids is not None:
            sets = sets.join(sids.select("sid").distinct(), "sid", "left_semi")
        if self.labels is None:
            return sets.withColumn("label", F.col("sid"))
        return sets.join(self.labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    def run(self, compared: int, members: int, block: int) -> DataFrame | None:
        """(sid, label) of the sets that are linked with others. Trees are (node, sid) alone;
        sketches come in only where sets are compared."""
        rows = stored(self.sets.select(F.explode("roots").alias("node"), "sid"))
        small = None
        while True:
            sizes = stored(rows.groupBy("node").agg(F.count("*").alias("k")).where("k > 1"))
            few = (F.col("k") * (F.col("k") - 1) <= 2 * compared) & (F.col("k") <= members)
            keep = salted_filter(rows, sizes.where(few), ["node"], ["sid"])
            large = sizes.where(~few)
            rest = None
            if not large.isEmpty():
                rest = stored(salted_lookup(rows, large, ["node"], ["sid"], "inner"))
                self._pivots(rest)
                rest, settled = self._unsettled(rest.drop("k"), compared, members)
                keep = keep.unionByName(settled)
            small = stored(keep) if small is None else small.unionByName(stored(keep))
            if rest is None or rest.isEmpty():
                break
            rows = stored(self._branch(rest))
        self._small(small, block)
        return self.labels

    def _pivots(self, rest: DataFrame) -> None:
        """Compares the members of large nodes with the nearest of their nodes' pivots. A node
        has two: the most typical member, and one that differs from node to node."""
        typical = rest.groupBy("sid").agg(F.sum("k").alias("weight"))
        chosen = (
            rest.select("node", "sid").join(typical, "sid").groupBy("node")
            .agg(F.max(F.struct("weight", "sid")).alias("p"),
                 F.max(F.struct(F.xxhash64("node", "sid"), "sid")).alias("q"))
            .select("node", F.array_distinct(F.array("p.sid", "q.sid")).alias("p"))
        )
        pairs = (
            salted_lookup(rest.select("node", "sid"), chosen, ["node"], ["sid"], "inner")
            .select("sid", F.explode("p").alias("p_sid")).distinct()
        )
        known = self.sets.select("sid", "n", "sketch")
        pivots = known.join(pairs.select(F.col("p_sid").alias("sid")).distinct(), "sid", "left_semi").select(
            *(F.col(c).alias(f"p_{c}") for c in known.columns))
        met = salted_lookup(pairs, pivots, ["p_sid"], ["sid"], "inner").join(known, "sid")
        self.confirm(nearest_pivots(met.where(F.col("sid") != F.col("p_sid"))))

    def _unsettled(self, rest: DataFrame, compared: int, members: int) -> tuple[DataFrame, DataFrame]:
        """Rows of nodes to branch, and of nodes that have become small; nodes whose members
        are connected go."""
        sizes = rest.groupBy("node").agg(F.count("*").alias("k"))
        if self.labels is None:
            same = sizes.select("node", F.lit(0).cast("bigint").alias("same"))
        else:
            # pairs of members of one component; a set without links is one of its own
            same = (
                rest.join(self.labels, "sid").groupBy("node", "label").agg(F.count("*").alias("c"))
                .groupBy("node").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
            )
        cross = F.col("k") * (F.col("k") - 1) - F.coalesce("same", F.lit(0))
        counts = stored(sizes.join(same, "node", "left").select("node", cross.alias("cross"), "k").where("cross > 0"))
        few = (F.col("cross") <= 2 * compared) & (F.col("k") <= members)
        return (stored(salted_filter(rest, counts.where(~few), ["node"], ["sid"])),
                salted_filter(rest, counts.where(few), ["node"], ["sid"]))

    def _branch(self, rows: DataFrame) -> DataFrame:
        """Each row's children: the path selects the functions, their minima the nodes."""
        function = F.expr(f"cast(pmod(xxhash64(node) + 41 * branch, {FUNCTIONS}) AS int)")
        return (
            rows.join(self.sets.select("sid", "sketch"), "sid")
            .withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
            .withColumn("byte", F.substring("sketch", function + 1, F.lit(1)))
            .select(F.xxhash64("node", "branch", "byte").alias("node"), "sid")
        )

    def _small(self, small: DataFrame, block: int) -> None:
        met = stored(star_pairs(small.join(self.known(), "sid")))
        self.confirm(met.where(F.col("node").isNull()).select("a", "b"))
        further = met.where(F.col("node").isNotNull()).select("node")
        if further.isEmpty():
            return
        rest = salted_filter(small, further, ["node"], ["sid"])
        left = suspects(rest.join(self.known(), "sid"), block)
        self.meet(left.select(F.xxhash64("node", "part").alias("node"), "sid"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    compared: int = COMPARED, members: int = MEMBERS, block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    join = Join(docs, id_col, text_col)
    labels = join.run(compared, members, block)
    firsts = stored(join.tagged.where("n > 0").groupBy("sid").agg(F.min("id").alias("first")))
    if labels is None:
        named = firsts.select("sid", F.col("first").alias("component_id"))
    else:
        labelled = firsts.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        of_label = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
        named = stored(salted_lookup(labelled, of_label, ["label"], ["sid"], "inner").select("sid", "component_id"))
    rows = join.tagged.select("id", "row_hash", "n", "sid")
    found = salted_lookup(rows, named, ["sid"], ["id", "row_hash"])
    component = F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
