"""Repeated passages and SimHash components against brute-force versions."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from auditlake.llm import simhash, suffix_dedup
from auditlake.llm.simhash import components, covering_masks, fingerprint, keep_one, link_prints, near_duplicates
from auditlake.llm.suffix_dedup import repeated_passages
from auditlake.llm.words import Words


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over differences of at most 3 bits."""
    different = sorted(set(prints.values()))
    root = {p: p for p in different}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(different, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(b)] = find(a)
    first = {}
    for i, p in prints.items():
        r = find(p)
        first[r] = min(first.get(r, i), i)
    return {i: first[find(p)] for i, p in prints.items()}


def edited(text, rng, n=1):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_pairs(odd_texts, prose):
    rng = random.Random(1)
    texts = [*odd_texts, *(prose(i, 30 + i) for i in range(30))]
    texts += [edited(prose(i % 5, 200 + i % 5), rng) for i in range(120)]
    texts += [prose(1, 201)] * 5
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket", [2048, 4])
def test_components_equal_brute_force(make_docs, near_pairs, bucket, monkeypatch):
    monkeypatch.setattr(simhash.link_prints, "__defaults__", (3, bucket))
    rows = near_duplicates(make_docs(near_pairs), keep=["doc_id"]).collect()
    prints = {i: brute_print(t) for i, t in near_pairs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)
    assert all(len(r.fingerprint) == 16 for r in rows) and len(rows) == len(near_pairs)


def test_long_text_counters():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 130_001, dtype=np.uint64)
    want = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash._bit_counts(hashes).tolist() == want
    assert fingerprint(b"") == 0


@pytest.mark.parametrize("positions", [list(range(64)), list(range(3, 40)), [1, 5, 6]])
def test_masks_cover_every_choice(positions):
    masks = covering_masks(positions)
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(3000):
        differ = sum(1 << p for p in rng.sample(positions, min(3, len(positions))))
        assert any(not m & differ for m in masks)


def test_dense_prints_split_without_loss(spark):
    """Many prints that differ in few positions: buckets far over the limit."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(1500)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = link_prints(spark.createDataFrame(signed, "simhash bigint"), 3, 40)
    got = {r.node: r.label for r in components(links).collect()}
    ids = {s[0]: s[0] & ((1 << 64) - 1) for s in signed}
    want = brute_components(ids)
    parts = lambda m: {frozenset(v) for v in group(m).values() if len(v) > 1}
    assert parts(got) == parts(want)


def group(mapping):
    out = defaultdict(set)
    for k, v in mapping.items():
        out[v].add(k)
    return out


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a bigint, b bigint")
    assert {r.label for r in components(links).collect()} == {0}


def test_one_of_each_component_stays(make_docs, near_pairs):
    docs = make_docs([*near_pairs, near_pairs[-1]])
    stay = keep_one(docs)
    want = set(brute_components({i: brute_print(t) for i, t in near_pairs}).values())
    assert sorted(r.doc_id for r in stay.collect()) == sorted(want)
    assert stay.columns == docs.columns


def test_simhash_of_nulls_and_empty_tables(make_docs):
    docs = make_docs([(None, None), (None, ""), (4, "")])
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs, keep=["doc_id"]).collect()} == {(None, 4), (4, 4)}
    assert near_duplicates(docs.where("doc_id > 9")).collect() == []
    only = make_docs([(None, "a b c"), (None, "A b c"), (None, "q r s t u"), (2, "something else altogether different")])
    assert {(r.doc_id, r.component_id) for r in near_duplicates(only, keep=["doc_id"]).collect()} == {(None, None), (2, 2)}
    assert sorted(str(r.doc_id) for r in keep_one(only).collect()) == ["2", "None", "None"]


def brute_passages(pairs, size=50):
    """Spans of words covered by windows that two ids hold: (id, start, end, n, first)."""
    holders = defaultdict(set)
    texts = {}
    for i, text in pairs:
        raw = text or ""
        words, at = [], 0
        for piece in raw.encode().split():
            at = raw.encode().index(piece, at)
            start = len(raw.encode()[:at].decode())
            words.append((piece, start, start + len(piece.decode())))
            at += len(piece)
        texts[i] = words
        for w in range(len(words) - size + 1):
            holders[b" ".join(x[0] for x in words[w : w + size])].add(i)
    out = set()
    for i, words in texts.items():
        spans = []
        for w in range(len(words) - size + 1):
            ids = holders[b" ".join(x[0] for x in words[w : w + size])]
            if len(ids) > 1:
                if spans and w <= spans[-1][1]:
                    spans[-1][1] = w + size
                    spans[-1][2] = min(spans[-1][2], *ids)
                else:
                    spans.append([w, w + size, min(ids)])
        out |= {(i, words[a][1], words[b - 1][2], b - a, first) for a, b, first in spans}
    return out


@pytest.fixture(scope="module")
def passage_pairs(odd_texts, prose):
    pairs = list(enumerate(odd_texts))
    shared = [prose(900 + i, n) for i, n in enumerate((49, 50, 51, 70, 200, 400))]
    for i in range(60):
        parts = [prose(i, i * 3 % 90), shared[i % 6] if i % 4 else "", "é\n " + prose(i + 500, 20)]
        if i % 7 == 0:  # a part of a passage that others hold whole
            parts.append(" ".join(shared[5].split()[100 + i : 160 + i]))
        pairs.append((100 + i, "  ".join(parts)))
    pairs += [(200 + i, prose(77, 300)) for i in range(25)]  # copies
    pairs += [(300, prose(77, 300) + " " + prose(77, 300)), (301, " ".join(prose(77, 300).split()[120:181]))]
    pairs.append((302, prose(5000, 60) + " " + prose(5000, 60)))  # repeats itself alone
    return pairs


@pytest.mark.parametrize("partitions", [1, 7])
def test_passages_equal_brute_force(spark, make_docs, passage_pairs, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = repeated_passages(make_docs(passage_pairs, partitions)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {(r.doc_id, r.start, r.end, r.n_words, r.first_id) for r in rows}
    assert got == brute_passages(passage_pairs) and len(got) == len(rows)


def test_passages_of_nulls_repeats_and_empty_tables(make_docs, prose):
    text = prose(1, 80)
    docs = make_docs([(None, text), (1, text), (1, text), (2, None)])
    assert repeated_passages(docs).collect() == []
    assert repeated_passages(docs.where("doc_id > 9")).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(docs, min_words=10)


def test_minimisers_are_sparse_and_shared(prose):
    text = prose(3, 4000, 5000).encode()
    w = Words([text, b"other words before " + text])
    at, first, last = suffix_dedup._minimisers(w, w.hashes(), 50)
    assert len(at) < 0.1 * len(w.hashes())
    assert ((first <= at) & (at <= last + 49)).all()
    one = {a for a in at if a < 4000}
    two = {a - 4003 for a in at if a >= 4003}
    assert len(one & two) >= 0.98 * len(one)


def test_repeated_id_stays_for_each_of_its_components(make_docs, prose):
    from auditlake.llm.simhash import keep_one

    one, two = prose(1, 60), prose(2, 60)
    docs = make_docs([(1, one), (1, two), (2, one), (3, two), (4, two)])
    assert sorted((r.doc_id, r.text) for r in keep_one(docs).collect()) == sorted([(1, one), (1, two)])
