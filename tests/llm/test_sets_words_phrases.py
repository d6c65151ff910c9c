"""Set similarity, spelling variants and collocations against brute-force versions."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.llm import chosen_path, collocations, spelling
from auditlake.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- set similarity ----------------------------------------------------------------


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def brute_sets(pairs):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(j)] = find(i)
    first = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            first[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(pairs):
        own = min(first[find(k)], default=None) if sets[k] else i
        out.append((i, len(sets[k]), own, i == own))
    return sorted(out, key=repr)


def changed(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def similar_pairs(odd_texts, prose):
    rng = random.Random(7)
    texts = [*odd_texts, *odd_texts[:6], *(prose(i, 20 + i) for i in range(20))]
    # groups around the threshold: 100 words, 1 to 7 of them changed
    texts += [changed(prose(i % 4, 100 + i % 4), rng, 1 + i % 7) for i in range(150)]
    texts += [prose(2, 102)] * 20
    texts += ["Word other Word", "word OTHER word", "single", "SINGLE ", "z " * 9]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    # null ids, a repeated id, repeated rows
    return pairs + [(None, prose(2, 102)), (None, "alone in this row"), (None, ""), (3, prose(1, 25)), pairs[0], pairs[0]]


@pytest.mark.parametrize("compared, members, block", [(1 << 20, 1 << 14, 1 << 21), (60, 40, 300)])
def test_sets_equal_brute_force(make_docs, similar_pairs, compared, members, block):
    """Also with nodes so small that trees branch, and parts so small that nodes are cut."""
    rows = chosen_path.near_duplicates(
        make_docs(similar_pairs), compared=compared, members=members, block=block)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, rows.collect()), key=repr) == brute_sets(similar_pairs)


def test_texts_are_fetched_once_for_some_nodes(make_docs, similar_pairs, monkeypatch):
    """A set in more nodes than one list takes."""
    monkeypatch.setattr(chosen_path, "LISTED", 2)
    monkeypatch.setattr(chosen_path, "STAR", 3)
    rows = chosen_path.near_duplicates(make_docs(similar_pairs), block=300)
    assert sorted(map(tuple, rows.collect()), key=repr) == brute_sets(similar_pairs)


def test_sets_of_no_rows(make_docs, spark):
    empty = make_docs([(1, "a")]).where("doc_id > 1")
    assert chosen_path.near_duplicates(empty).collect() == []
    assert [tuple(r) for r in chosen_path.near_duplicates(make_docs([(1, None), (2, " ")])).orderBy("doc_id").collect()] == [
        (1, 0, 1, True), (2, 0, 2, True)]


def test_very_long_text(make_docs, prose):
    long = prose(1, 60_000, 50_000)
    rows = chosen_path.near_duplicates(make_docs([(5, long), (2, long + " more"), (9, prose(2, 60_000, 50_000))]))
    assert {r.doc_id: r.component_id for r in rows.collect()} == {5: 2, 2: 2, 9: 9}


def test_components_of_a_star_and_a_path(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5060)] + [(7000, 7000)]
    found = connected(spark.createDataFrame(links, "a int, b int")).collect()
    assert {r.node: r.label for r in found} == {
        **{i: 0 for i in range(3000)}, **{i: 5000 for i in range(5000, 5061)}}


# --- spelling variants --------------------------------------------------------------


def brute_words(pairs):
    counts = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if near_one(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelled(odd_texts):
    rng = random.Random(11)
    letters = "abcdeàÉ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "abababab", "babababa", "xylophone", "Xylophone"]
    texts = [*odd_texts]
    for k, word in enumerate(base):
        texts += [f"{word} {word},{word}"] * rng.choice([1, 4, 40])
        for _ in range(6):
            at = rng.randrange(len(word))
            edit = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:],
                               word[:at] + rng.choice(letters) + word[at + 1 :]])
            texts += [f"{edit}9{edit}-{edit.upper()}"]
    texts += ["k" * 3000 + " " + "k" * 3001] * 2 + ["The Kingdomofx kingdomofx " * 50]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    return pairs + [(None, "wordless wordless wordles wordles"), pairs[0], pairs[0]]


@pytest.mark.parametrize("part", [1 << 18, 60, 1])
def test_variants_equal_brute_force(make_docs, misspelled, part):
    """Also with partitions so small that states hand their arcs on."""
    rows = spelling.group_variants(make_docs(misspelled), part=part)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, rows.collect())) == brute_variants(brute_words(misspelled))


def test_acceptor_is_minimal_and_finds_every_pair():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(250)})
    acceptor = spelling.Acceptor(words)
    rests = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            rests[w[:i]].add(w[i:])
    assert len(acceptor.arcs) == len({frozenset(r) for r in rests.values()})
    found = list(acceptor.pairs())
    assert {frozenset(p) for p in found} == {
        frozenset(p) for p in itertools.combinations(words, 2) if near_one(*p)}
    assert len(found) == len({frozenset(p) for p in found})


def test_variants_of_no_rows(make_docs):
    assert spelling.group_variants(make_docs([(1, None), (2, "short words only")])).collect() == []


def test_form_ties_and_chains(make_docs):
    """Of equally frequent near words the smallest is the form; a root is the end of the way."""
    words = {"lantern": 2, "lanterns": 25, "lanternx": 25, "lanternsy": 250}
    pairs = [(i, w) for i, w in enumerate(w for w, n in words.items() for _ in range(n))]
    kept = brute_words(pairs)
    got = {r.word: r for r in spelling.group_variants(make_docs(pairs)).collect()}
    assert sorted(map(tuple, got.values())) == brute_variants(kept)


# --- collocations -------------------------------------------------------------------


def brute_phrases(pairs, least, top=2000):
    langs = {}
    for lang, text in pairs:
        counts = langs.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in langs.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, a in held.items() for m in range(2, len(p))
                  for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        rows = []
        for p, a in held.items():
            if p not in inside:
                score, _, left, right = min(
                    (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, k + 1, *r) for k, r in enumerate(rows[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_docs(spark, odd_texts):
    rng = random.Random(13)
    vocabulary = ["of", "the", "Of", "new", "york", "city", "é", "日本", "x\x00y", "nb sp", "a\u0085b"]
    rows = [(lang, t) for lang in ("en", None, "und", "", "no lang") for t in odd_texts]
    for _ in range(700):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n", " ", "\t;"]) for _ in range(25)]
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    rows += [("en", "to be or not to be " * 60)] * 3 + [("de", "rare pair")] * 29
    return rows


@pytest.mark.parametrize("limits", [
    collocations.Limits(), collocations.Limits(batch_bytes=4000, route_words=300, hot_part=40, codes=8, common=5)])
def test_phrases_equal_brute_force(spark, phrase_docs, limits):
    """Also with many batches and routes, hot prefixes, and batches cut for lack of codes."""
    docs = spark.createDataFrame(
        [(i, t, lang, "w", "p") for i, (lang, t) in enumerate(phrase_docs)],
        "doc_id int, text string, lang string, word string, phrase string").repartition(3)
    rows = collocations.mine(docs, limits=limits)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, rows.collect())) == brute_phrases(phrase_docs, 30)


def test_first_phrases_only(spark, phrase_docs):
    docs = spark.createDataFrame(phrase_docs, "lang string, text string")
    got = collocations.mine(docs, min_count=5, top=7).collect()
    assert sorted(map(tuple, got)) == brute_phrases(phrase_docs, 5, 7)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert collocations.mine(docs).collect() == []
    assert collocations.mine(docs.where("lang = 'x'")).collect() == []


@pytest.mark.parametrize("by", [2, 3, 4])
def test_quicksort_counts_and_abandons(by):
    rng = np.random.default_rng(3)
    windows = rng.integers(1, 5, (4, 400)).astype(np.uint64) << np.uint64(60)
    windows[3, ::3] = 0
    windows[2, ::9] = 0
    n = rng.integers(1, 4, 400)
    want = Counter()
    for w, k in zip(windows.T.view(np.int64).tolist(), n.tolist()):
        w = w[: w.index(0)] if 0 in w else w
        for m in range(2, len(w) + 1):
            want[tuple(w[:m])] += k
    got = {tuple(p): c for p, c in collocations.quicksort(windows, n, by, 9)}
    assert got == {p: c for p, c in want.items() if c >= 9 or len(p) < by}
