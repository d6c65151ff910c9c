"""Secret scans and shards against brute-force versions."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.llm import secret_scan, sharding
from auditlake.llm.secret_scan import BlobLedger, scan_secrets, spans_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


FIRST = secret_scan.rule_version()


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@pytest.fixture(scope="module")
def texts(odd_texts):
    return [
        *odd_texts, "Password = 'Hunter22' and TOKEN:abc", "token=token:abcdefgh", "token==abcdef secret: x",
        "api_key=\"" + "k9" * 10 + "\"", "APIKEY : zzzzzz;passwd=aaaaa", "é😀 secret=" + "0a" * 20 + " tail",
        "AKIA" + "Z9" * 8, "xAKIA123 AKIAAKIA" + "Q" * 20, "f" * 23, "f" * 24 + "g" + "0" * 40, "token = \nabcdefgh",
        "secret=abcdef" * 50, "AKIAAKIA" + "1" * 12 + "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "password\"\": longenough",
    ]


def scanned(df):
    return sorted(((r.doc_id, r.s) for r in df.select("doc_id", spans_text(F.col("findings")).alias("s")).collect()), key=repr)


def test_spans_equal_brute_force(spark, make_docs, texts):
    pairs = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts)), (None, texts[-1]), (5, texts[5])]
    df = scan_secrets(make_docs(pairs), BlobLedger(spark))
    assert scanned(df) == sorted(((i, brute(t)) for i, t in pairs), key=repr)


def test_only_unseen_pairs_are_scanned(spark, make_docs, texts):
    ledger = BlobLedger(spark)
    scan_secrets(make_docs(list(enumerate(texts))), ledger).count()
    n = ledger.entries(FIRST).count()
    assert n == len({t or "" for t in texts})
    again = scan_secrets(make_docs([(1, texts[-1]), (2, "new token=abcdef")]), ledger)
    assert scanned(again) == [(1, brute(texts[-1])), (2, "assign:4:16")]
    assert ledger.entries(FIRST).count() == n + 1
    other = (secret_scan.SecretRule("hex", "[0-9a-f]{30,}", 0, 30, "[0-9a-f]{30}"),)
    scan_secrets(make_docs(list(enumerate(texts))), ledger, rules=other).count()
    assert ledger.entries(secret_scan.rule_version(other)).count() == n and ledger.entries(FIRST).count() == n + 1


def test_changed_rules_never_meet_old_findings(spark, make_docs, texts):
    docs, ledger = make_docs(list(enumerate(texts))), BlobLedger(spark)
    scan_secrets(docs, ledger).count()
    fewer = secret_scan.RULES[1:]
    found = scanned(scan_secrets(docs, ledger, rules=fewer))
    assert found == scanned(scan_secrets(docs, BlobLedger(spark), rules=fewer))
    assert not any("assign" in s for _, s in found)


def test_overlapping_runs_double_nothing(spark, make_docs, texts):
    pairs = list(enumerate(texts))
    docs, ledger = make_docs(pairs), BlobLedger(spark)
    scan_secrets(docs, ledger).count()
    ledger.append(spark.read.parquet(ledger.folder))  # what a second run at the same time appends
    assert scanned(scan_secrets(docs, ledger)) == sorted(((i, brute(t)) for i, t in pairs), key=repr)


def test_batches_meet_the_ledger_of_those_before(spark, make_docs, texts):
    pairs = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts))]
    docs, ledger = make_docs(pairs), BlobLedger(spark)
    halves = [docs.where("doc_id < 100"), docs.where("doc_id >= 100")]
    df = scan_secrets(docs, ledger, batches=halves)
    assert scanned(df) == sorted(((i, brute(t)) for i, t in pairs), key=repr)
    assert spark.read.parquet(ledger.folder).count() == len({t or "" for t in texts})


def test_very_many_matches_in_one_text(spark, make_docs):
    text = "".join(f"é token=abcdef{i} x" for i in range(1500)) + " secret=ab"
    assert scanned(scan_secrets(make_docs([(1, text)]), BlobLedger(spark))) == [(1, brute(text))]


def test_secrets_of_an_empty_table(spark, make_docs):
    assert scan_secrets(make_docs([(1, "x")]).where("doc_id > 5"), BlobLedger(spark)).collect() == []


def shards_of(df):
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, {s: sum(r.size for r in own) for s, own in by.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_bytes_law(make_docs, prose, odd_texts, hot):
    pairs = [(i, prose(1 if hot and i % 3 == 0 else i, 5 + i % 90)[: 40 if hot and i % 3 == 0 else None]) for i in range(3000)]
    pairs += [(5000 + i, t) for i, t in enumerate(odd_texts)] + [(1, pairs[1][1]), (None, None)]
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows, sizes = shards_of(sharding.shard_rows(make_docs(pairs, 5), keep={"crc": crc}))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs), key=repr)
    assert sorted(((r.doc_id, r.size, r.crc) for r in rows), key=repr) == want
    even = sum(sizes.values()) / 16
    longest = max(r.size for r in rows)
    assert set(sizes) == set(range(16))
    assert all(abs(s - even) <= 0.01 * even + longest for s in sizes.values())


@pytest.mark.parametrize("repeated", [7, None])
def test_law_among_repeated_rows(make_docs, prose, repeated):
    pairs = [(repeated, "the same row") if i % 3 == 0 else (i, prose(i, 4)) for i in range(6000)]
    rows, sizes = shards_of(sharding.shard_rows(make_docs(pairs, 5)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in pairs)
    even = sum(sizes.values()) / 16
    longest = max(r.size for r in rows)
    assert set(sizes) == set(range(16))
    assert all(abs(s - even) <= 0.01 * even + longest for s in sizes.values())


def test_equal_texts_are_neighbours(make_docs, prose):
    pairs = [(i, prose(i % 50, 30)) for i in range(2000)]
    rows, _ = shards_of(sharding.shard_rows(make_docs(pairs), keep={"text": F.col("text")}))
    shards = defaultdict(set)
    for r in rows:
        shards[r.text].add(r.shard)
    assert sum(len(s) for s in shards.values()) <= 50 + 15


def test_shards_of_small_tables(make_docs):
    docs = make_docs([(1, "a"), (2, "b")])
    rows, _ = shards_of(sharding.shard_rows(docs))
    assert len(rows) == 2
    assert sharding.shard_rows(docs.where("doc_id > 5")).collect() == []
