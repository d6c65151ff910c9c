"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditlake.llm import packing, token_count
from auditlake.llm.packing import pack_documents, solve

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def many_texts(odd_texts, prose):
    rng = random.Random(5)
    alphabet = [" ", " ", "  ", "\n", "\t", "\r", "a", "B", "ab", "'s", "'", "1", "12", ".", "!?", "é", "é",
                " ", " ", "\x1c", "ſ", "Σ", "İ", "日", "😀", "Ça", "größe,", "ÀÉ%%%", "word.", "Ÿ", "<|endoftext|>", "-", "_", "x" * 70]
    random_texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    return [*odd_texts, *random_texts, prose(1, 4000)]


def test_counts_equal_the_library(make_docs, many_texts):
    tok = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(
        make_docs(list(enumerate(many_texts))), BYTE, keep=["doc_id"]).collect()}
    for i, text in enumerate(many_texts):
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512), repr(text)


def test_small_cache_changes_nothing(monkeypatch, many_texts):
    monkeypatch.setattr(token_count, "CACHE", 50)
    tok = Tokenizer.from_file(BYTE)
    table = token_count.Lengths(BYTE, {" the": 1})
    texts = [*(t or "" for t in many_texts), " Ça va, Übergrößen! ÆØÅ ÿ% it's O'Neil #x a<|endoftext|>."]
    assert table.count(texts) == [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_frequent_pieces_are_bounded_and_right():
    words, lengths = token_count.frequent_pieces(BYTE)
    words = words.split("\n")
    assert len(words) == len(lengths) <= 50_257
    tok = Tokenizer.from_file(BYTE)
    for i in range(0, len(words), 997):
        assert len(tok.encode(words[i], add_special_tokens=False)) == lengths[i]


def test_all_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "x")])
    df = token_count.count_tokens(docs, BYTE)
    assert df.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    assert token_count.count_tokens(docs.where("doc_id > 5"), BYTE).collect() == []


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing_equals_the_library(make_docs, many_texts):
    tok = Tokenizer.from_file(WORD)
    pairs = [*enumerate(many_texts), (3, many_texts[3]), (None, "null id")]
    rows = pack_documents(make_docs(pairs), WORD).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want, total = Counter(), 0
    for i, text in pairs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            want[(i, piece, at, len(own) // 4, zlib.crc32(own))] += 1
    assert got == want
    n = check_packing(rows, 2048)
    assert n <= -(-total // 2048) + 1


def test_packing_with_ids_and_small_cache(make_docs, prose, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    table = packing.TokenIds(WORD)
    tok = Tokenizer.from_file(WORD)
    for text in (prose(1, 50), "Ça va, Übergrößen! ÆØÅ ÿ% it's O'Neil #x a<|endoftext|>."):
        assert np.frombuffer(table.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(table) == 20
    docs = make_docs([(i, prose(i, 30)) for i in range(40)])
    rows = pack_documents(docs, WORD, capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    check_packing(rows, 64)
    assert pack_documents(docs.where("doc_id < 0"), WORD).collect() == []


def best(sizes, capacity):
    """Fewest sequences, by search over descending pieces."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1:]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return found[0]


def test_solve_places_all_and_reduction_keeps_the_optimum():
    rng = random.Random(3)
    worse = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        out = solve(Counter(sizes), capacity)
        placed = Counter()
        fixed = Counter()
        seen = 0
        for n, held in out.patterns:
            assert sum(s * c for s, c in held.items()) <= capacity
            for s, c in held.items():
                placed[s] += n * c
                if seen < out.fixed:
                    fixed[s] += n * c
            seen += n
        assert placed == Counter(sizes)
        # what the reduction fixed is part of some best packing
        rest = list((Counter(sizes) - fixed).elements())
        optimum = best(sizes, capacity)
        assert out.fixed + (best(rest, capacity) if rest else 0) == optimum
        worse += out.n_sequences - optimum
    assert worse <= 5


def test_solve_handles_large_counts():
    counts = {s: 10_000_000 + s for s in range(1, 2049)}
    out = solve(counts, 2048)
    total = sum(s * n for s, n in counts.items())
    assert out.n_sequences <= -(-total // 2048) * 1.001 and len(out.patterns) < 20_000
    assert solve({}, 2048).patterns == []
