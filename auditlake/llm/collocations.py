"""Phrases whose words occur together far more often than apart, mined from suffixes.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
words ``[^\\x20\\x09]+``; every word starts a suffix of at most ``DEPTH`` words of its
piece. Everything is counted within a language.

1. Words are counted, so suffixes end before a word that is itself too rare. A fixed
   bitmap of ``FILTER_BITS`` bits tells which words may go on; a false positive costs
   time, never a result.
2. Suffixes are routed globally by their two leading words. A pair or triple that
   holds a thousandth of some batch's suffixes or more is hot and is routed by one word more, so its
   suffixes spread; the list of hot prefixes is bounded by that share. A task sends
   equal suffixes once with their number, packed by route; of the most frequent words, a broadcast table of bounded size, two
   bytes each are enough.
3. A route sorts its suffix pointers by multikey three-way quicksort to ``DEPTH``
   words: pointers equal to the pivot are one phrase and their number is its count;
   a partition with fewer than ``min_count`` suffixes is abandoned, together with all
   that is below it. Counts of hot prefixes are partial and added up afterwards.
4. Each phrase is cut in all places; scores and the test for longer phrases are joins
   of the phrase table with itself.

A route holds about ``Limits.route_words`` suffixes at any input size. Words are 64-bit hashes
of (language, word) on the way, with the words themselves kept once; ``mine`` fails if
two words of one hash are met, as counts would be wrong.

Defined cases: null or empty texts have no words; a null language is ``und``; repeated
rows count each; ties in score go by count, then by phrase in byte order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_lookup, stored, top_n
from auditlake.llm.words import PIECE_BYTES, Words, map_batches, mixed, parts, pieces, texts

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
LONGER_SHARE = 80
SCALE = 2_000_000
FILTER_BITS = 1 << 25


@dataclass(frozen=True)
class Limits:
    """Sizes that decide how the work is cut, never what comes out."""

    batch_bytes: int = 4 << 20
    route_words: int = 1 << 21
    #: a prefix is hot from this part of a batch's suffixes on
    hot_part: int = 1000
    #: different words that 16 bits can tell apart, the end included
    codes: int = 1 << 16
    #: most frequent words that are broadcast, below 2**16
    common: int = (1 << 16) - 1


_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_K = np.uint64(0x9E3779B97F4A7C15)


class Suffixes:
    """Words of some sections of texts: ``token`` is the hash of (language, word), ``piece``
    tells pieces apart."""

    def __init__(self, sections: list[tuple[str, bytes]], spelling: bool):
        self.names = sorted({lang for lang, _ in sections})
        place = {name: i for i, name in enumerate(self.names)}
        salts = np.array([_lang_salt(name) for name in self.names], dtype=np.uint64)
        raw = [t for _, t in sections]
        langs = np.array([place[lang] for lang, _ in sections], dtype=np.int64)
        self.blocks: list[Words] = []
        lang, token, piece, before = [], [], [], 0
        for a, b in pieces(raw):
            words = Words(raw[a:b])
            breaks = np.cumsum(words.data == 10)
            if spelling:
                self.blocks.append(words)
            lang.append(langs[a:b][words.doc])
            token.append(np.maximum(mixed(words.hashes() + salts[lang[-1]]), np.uint64(1)))
            piece.append(breaks[words.start] + before)
            before += int(breaks[-1]) + 1
        self.lang, self.token, self.piece = (
            np.concatenate(x) if x else np.empty(0, t)
            for x, t in ((lang, np.int64), (token, np.uint64), (piece, np.int64)))
        self.ends = np.cumsum([len(w.start) for w in self.blocks])

    def spelled(self, at: np.ndarray) -> list[bytes]:
        """The words at these positions."""
        out = []
        for i, block in zip(at.tolist(), np.searchsorted(self.ends, at, side="right").tolist()):
            words = self.blocks[block]
            i -= int(self.ends[block]) - len(words.start)
            out.append(words.data[words.start[i] : words.end[i]].tobytes())
        return out

    def windows(self, stays: np.ndarray, values: np.ndarray, depth: int = DEPTH, at: slice = slice(None)) -> np.ndarray:
        """The values of the next ``depth`` words of each position in ``at``, 0 once the piece
        or the run of words that stay has ended; ``values`` are those of ``at``."""
        run, stays = (self.piece + np.cumsum(~stays))[at], stays[at]
        n = len(run)
        out = np.zeros((depth, n), dtype=np.uint64)
        for j in range(min(depth, n)):
            same = (run[: n - j] == run[j:]) & stays[: n - j] & stays[j:]
            out[j, : n - j] = np.where(same, values[j:], 0)
        return out


def _lang_salt(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def sections(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased text with a line break for each end of a piece); long texts
    are cut between pieces."""
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    for lang, text in zip(langs, texts(batch, "text")):
        text = text.lower().translate(_BREAKS)
        lang = "und" if lang is None else lang
        at = 0
        while len(text) - at > PIECE_BYTES:
            cut = text.rfind(b"\n", at, at + PIECE_BYTES)
            if cut < 0:
                cut = text.find(b"\n", at + PIECE_BYTES)
            if cut < 0:
                break
            yield lang, text[at:cut]
            at = cut + 1
        yield lang, text[at:]


def batches_of(batches: Iterable[pa.RecordBatch], size_limit: int, spelling: bool = False) -> Iterator[Suffixes]:
    """Suffixes of consecutive texts, ``size_limit`` bytes or a little more at once."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for batch in parts(batches, 64):
        for section in sections(batch):
            held.append(section)
            size += len(section[1])
            if size > size_limit:
                yield Suffixes(held, spelling)
                held, size = [], 0
    if held:
        yield Suffixes(held, spelling)


def prefix_hash(columns: np.ndarray) -> np.ndarray:
    total = np.zeros(columns.shape[1], dtype=np.uint64)
    for column in columns:
        total = mixed(total * _K + column)
    return total


def hot_prefixes(columns: np.ndarray, part: int) -> Iterator[tuple[int, int, int]]:
    """(hash, length, number) of prefixes of two and three words that are hot in a batch."""
    for length in (2, 3):
        columns = columns[:, columns[length - 1] > 0]
        key, n = np.unique(prefix_hash(columns[:length]), return_counts=True)
        often = n * part >= max(part, int(columns.shape[1]))
        for k, m in zip(key[often].view(np.int64).tolist(), n[often].tolist()):
            yield k, length, m


def count_words(docs: DataFrame, text_col: str, lang_col: str, limits: Limits) -> DataFrame:
    """(lang, token, word, length 1, n) for words; for prefixes that are hot in a batch
    ``token`` is the prefix' hash and ``length`` its number of words, without lang and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches_of(batches, limits.batch_bytes, spelling=True):
            token, at, n = np.unique(found.token, return_index=True, return_counts=True)
            every = np.ones(len(found.token), dtype=bool)
            hot = list(hot_prefixes(found.windows(every, found.token, 3), limits.hot_part))
            none = [None] * len(hot)
            yield pa.RecordBatch.from_arrays([
                pa.array([found.names[i] for i in found.lang[at].tolist()] + none, pa.string()),
                pa.array(token.view(np.int64).tolist() + [h[0] for h in hot], pa.int64()),
                pa.array(found.spelled(at) + none, pa.binary()),
                pa.array([1] * len(token) + [h[1] for h in hot], pa.int32()),
                pa.array(n.tolist() + [h[2] for h in hot], pa.int64()),
            ], names=["lang", "token", "word", "length", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = map_batches(rows, run, "lang string, token long, word binary, length int, n long")
    return found.groupBy("lang", "token", "word", "length").agg(F.sum("n").alias("n"))


def bitmap(tokens: DataFrame) -> np.ndarray:
    """Which of ``FILTER_BITS`` places the tokens fall on, eight to a byte; set in tasks."""
    place = F.col("token").bitwiseAND(FILTER_BITS - 1)
    sets = (
        tokens.select(F.shiftright(place, 6).alias("at"), place.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    # at most FILTER_BITS / 64 rows
    rows = sets.toArrow()
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def passes(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    place = tokens & np.uint64(FILTER_BITS - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pack(codes: np.ndarray, n: np.ndarray, words: np.ndarray, common: np.ndarray) -> bytes:
    """Suffixes as one binary value: the words used, a place in them for each word of each
    suffix, and numbers. Of words in ``common`` (sorted) their steps there are enough."""
    used, places = np.unique(codes, return_inverse=True)
    used = words[used]
    at = np.searchsorted(common, used)
    known = at < len(common)
    known[known] = common[at[known]] == used[known]
    # known words first, both parts ascending
    order = np.argsort(~known, kind="stable")
    places = np.argsort(order)[places]
    steps = np.diff(at[known], prepend=0).astype(np.uint16)
    head = np.array([len(steps), len(used) - len(steps), len(n)], dtype=np.uint32)
    # low and high bytes apart compress better
    return zstandard.ZstdCompressor(level=1).compress(b"".join([
        head.tobytes(), steps.tobytes(), used[~known].tobytes(),
        places.astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes(), n.astype(np.uint32).tobytes()]))


def unpack(values: list[bytes], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each suffix in columns, numbers) of packed suffixes."""
    bodies = [zstandard.ZstdDecompressor().decompress(v) for v in values]
    heads = [np.frombuffer(body, dtype=np.uint32, count=3).tolist() for body in bodies]
    total = sum(m for *_, m in heads)
    columns, n = np.empty((DEPTH, total), dtype=np.uint64), np.empty(total, dtype=np.uint32)
    at = 0
    for i, (k, rare, m) in enumerate(heads):
        body, bodies[i] = bodies[i], b""
        known = common[np.cumsum(np.frombuffer(body, dtype=np.uint16, count=k, offset=12).astype(np.int64))]
        rest = 12 + 2 * k
        words = np.concatenate([known, np.frombuffer(body[rest : rest + 8 * rare], dtype=np.uint64)])
        rest += 8 * rare
        places = np.frombuffer(body, dtype=np.uint8, count=2 * DEPTH * m, offset=rest).reshape(2, -1)
        places = places[0] | places[1].astype(np.uint16) << 8
        columns[:, at : at + m] = words[places].reshape(DEPTH, m)
        n[at : at + m] = np.frombuffer(body[rest + 2 * DEPTH * m :], dtype=np.uint32)
        at += m
    return columns, n


def chunks(
    found: Suffixes, stays: np.ndarray, routes: int, hot: dict[int, np.ndarray], common: np.ndarray,
    most: int, low: int = 0, high: int | None = None,
) -> Iterator[tuple[int, int, bytes]]:
    """(route, words that route, packed suffixes) of the suffixes from ``low`` to ``high``;
    equal ones once with their number."""
    high = len(found.token) if high is None else high
    reach = slice(low, high + DEPTH - 1)  # the last ones' words too
    words, codes = np.unique(found.token[reach] * stays[reach], return_inverse=True)
    if len(words) >= most and high - low > 1:
        middle = (low + high) // 2
        yield from chunks(found, stays, routes, hot, common, most, low, middle)
        yield from chunks(found, stays, routes, hot, common, most, middle, high)
        return
    if not len(words) or words[0]:  # 0 is the end of a suffix
        words, codes = np.concatenate([[np.uint64(0)], words]), codes + 1
    columns = found.windows(stays, codes, at=reach)[:, : high - low]
    columns = columns[:, columns[1] > 0]  # a phrase has two words at least
    if not columns.shape[1]:
        return
    packed = np.zeros(columns.shape[1], dtype=np.uint64)
    for column in columns:
        packed = packed << np.uint64(16) | column
    del columns
    packed, n = np.unique(packed, return_counts=True)
    codes = np.stack([packed >> np.uint64(16 * (DEPTH - 1 - j)) & np.uint64(0xFFFF) for j in range(DEPTH)])
    codes = codes.astype(np.int64)
    full = words[codes]
    key, by = prefix_hash(full[:2]), np.full(len(packed), 2)
    for length in (2, 3):
        more = (by == length) & np.isin(key, hot[length])
        key[more] = prefix_hash(full[: length + 1, more])
        by[more] = length + 1
    route = (mixed(key) % np.uint64(routes)).astype(np.int64) * 8 + by
    order = np.argsort(route, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(route[order])) + 1):
        yield int(route[at[0]]) // 8, int(by[at[0]]), pack(codes[:, at], n[at], words, common)


def quicksort(columns: np.ndarray, n: np.ndarray, by: int, min_count: int) -> Iterator[tuple[list[int], int]]:
    """(phrase, count) by multikey three-way quicksort of pointers to the suffixes.

    Suffixes were routed by ``by`` words, so counts of shorter phrases are partial: these
    are all reported, and no partition is abandoned before that depth.
    """
    todo: list[tuple[np.ndarray, int]] = [(np.arange(columns.shape[1], dtype=np.int32), 0)]
    while todo:
        at, depth = todo.pop()
        if not len(at) or (depth + 1 >= by and int(n[at].sum()) < min_count):
            continue
        key = columns[depth][at]
        low, middle, high = sorted((int(key[0]), int(key[len(key) // 2]), int(key[-1])))
        equal = key == middle
        below = key < middle
        todo.append((at[below], depth))
        todo.append((at[~(equal | below)], depth))
        if not middle:  # the suffixes end here
            continue
        same = at[equal]
        count = int(n[same].sum())
        length = depth + 1
        if length < by or count >= min_count:
            if length > 1:
                yield columns[:length, same[0]].view(np.int64).tolist(), count
            if length < DEPTH:
                todo.append((same, length))


def count_phrases(
    docs: DataFrame, text_col: str, lang_col: str, words: DataFrame, min_count: int, limits: Limits,
) -> DataFrame:
    """(phrase, a) for the phrases of 2 to ``DEPTH`` words with ``min_count`` occurrences."""
    often = bitmap(words.where((F.col("length") == 1) & (F.col("n") >= min_count)))
    total = words.where(F.col("length") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most 4 * hot_part prefixes of each length
    prefixes = words.where((F.col("length") > 1) & (F.col("n") * 4 * limits.hot_part >= total)).toArrow()
    hot = {
        k: prefixes["token"].to_numpy()[prefixes["length"].to_numpy() == k].view(np.uint64)
        for k in (2, 3)
    }
    routes = max(16, -(-total // limits.route_words))
    # words that are sent as a step of 16 bits, the end of a suffix among them
    first = words.where(F.col("length") == 1).orderBy(F.desc("n"), "token").limit(limits.common).select("token")
    common = np.unique(np.concatenate([[0], first.toArrow()["token"].to_numpy()]).astype(np.int64).view(np.uint64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches_of(batches, limits.batch_bytes):
            rows = list(chunks(found, passes(often, found.token), routes, hot, common, limits.codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(
                    zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()))],
                names=["route", "by", "suffixes"],
            )

    def routes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
        """(words that route, packed suffixes) of one route after the other."""
        now, held = None, []
        for batch in batches:
            for r, by, value in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                if (r, by) != now:
                    if held:
                        yield now[1], held
                    now, held = (r, by), []
                held.append(value.as_py())
        if held:
            yield now[1], held

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for by, held in routes_of(batches):
            found = list(quicksort(*unpack(held, common), by, min_count))
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in found], pa.list_(pa.int64())),
                pa.array([c for _, c in found], pa.int64()),
            ], names=["phrase", "a"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    routed = map_batches(rows, route, "route long, by int, suffixes binary")
    placed = routed.repartition(routes, "route").sortWithinPartitions("route", "by")
    counted = map_batches(placed, sort, "phrase array<bigint>, a long")
    return counted.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    min_count: int = MIN_COUNT, top: int = TOP, limits: Limits = Limits(),
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words = stored(count_words(docs, text_col, lang_col, limits))
    single = words.where(F.col("length") == 1)
    if not single.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        raise ValueError("two words have one hash")
    sizes = single.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = stored(
        count_phrases(docs, text_col, lang_col, words, min_count, limits).unionByName(
            single.where(F.col("n") >= min_count).select(F.array("token").alias("phrase"), F.col("n").alias("a")))
    )
    long = phrases.where(F.size("phrase") > 1)
    # scores: every cut's two parts are looked up
    cuts = long.select("phrase", "a", F.explode(F.expr("sequence(1, size(phrase) - 1)")).alias("k"))
    sides = cuts.select("phrase", "a", "k", F.explode(F.expr(
        "array(struct(0 AS side, slice(phrase, 1, k) AS part),"
        " struct(1 AS side, slice(phrase, k + 1, size(phrase)) AS part))")).alias("p"),
    ).select("phrase", "a", "k", "p.side", "p.part")
    known = phrases.select(F.col("phrase").alias("part"), F.col("a").alias("f"))
    looked = salted_lookup(sides, known, ["part"], ["phrase", "k"], "inner", buckets=4)
    scored = (
        looked.groupBy("phrase", "a", "k")
        .agg(F.sum(F.expr("if(side = 0, f, 0)")).alias("l"), F.sum(F.expr("if(side = 1, f, 0)")).alias("r"))
        # decimals: the product may pass 64 bits
        .withColumn("score", F.expr(
            f"cast(cast({SCALE} AS decimal(19, 0)) * cast(a AS decimal(19, 0)) AS decimal(38, 0))"
            " div cast(l + r AS decimal(19, 0))"))
        .groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    inside = (
        long.where(F.size("phrase") > 2)
        .select("a", F.explode(F.expr(
            "flatten(transform(sequence(2, size(phrase) - 1), m ->"
            " transform(sequence(1, size(phrase) - m + 1), i -> slice(phrase, i, m))))")).alias("phrase"))
        .groupBy("phrase").agg(F.max("a").alias("longer"))
    )
    left = stored(
        scored.join(inside, "phrase", "left")
        .where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * LONGER_SHARE, F.lit(False)))
        .drop("longer")
    )
    spelled = (
        salted_lookup(
            left.select("phrase", F.posexplode("phrase").alias("at", "token")),
            single.where(F.col("n") >= min_count).select("token", "word", "lang"),
            ["token"], ["phrase"], "inner")
        .groupBy("phrase", "lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("phrase", "lang", F.expr(
            "array_join(transform(words, w -> decode(w.word, 'utf-8')), ' ')").alias("spelled"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = left.join(spelled, "phrase").select("lang", F.col("spelled").alias("phrase"), "a", "l", "r", "score")
    # a language's phrases meet in one task only after parts of them were cut to the first ones
    part = F.pmod(F.xxhash64("phrase"), F.lit(16)).alias("part")
    best = top_n(top_n(named.select("*", part), ["lang", "part"], order, top), ["lang"], order, top, "rank")
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
