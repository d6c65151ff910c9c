"""Line deduplication against a brute-force version."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.llm import line_dedup
from auditlake.llm.line_dedup import LineRuns, dedup_lines, id_batches, line_totals

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(pairs, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    for doc, text in pairs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc)
    keeper = {k: max((d for d in v if d is not None), default=None)
              for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def common(i):
    return f"  The Common Line number {i} goes on and on, ÄÖ until it is long\t"


def pairs_of(odd_texts):
    pairs = list(enumerate(odd_texts))
    for i in range(100, 140):
        lines = [f"own {i} " + "z" * 50, common(i % 4).upper() if i % 3 else common(i % 4), "short", ""]
        if i % 5 == 0:
            lines.append(lines[1])
        pairs.append((i, "\n".join(lines)))
    return pairs


@pytest.mark.parametrize("fan_in", [2, 3])
def test_matches_brute_force(spark, make_docs, odd_texts, monkeypatch, fan_in):
    monkeypatch.setattr(line_dedup, "FAN_IN", fan_in)
    pairs = pairs_of(odd_texts)
    docs = make_docs(pairs)
    runs = LineRuns(spark, fan_in)
    df = dedup_lines(docs, runs=runs)
    assert result(df) == brute(pairs)
    assert max(len(x) for x in runs.levels.values()) < fan_in
    runs.close()
    assert set(docs.columns) - {"n_lines"} == set(df.columns) - {"n_lines", "n_dropped"}


def test_null_ids_repeated_rows_and_ties(make_docs):
    pairs = [(None, common(1)), (None, common(1)), (7, common(1)), (7, common(1)), (3, common(1)),
             (None, common(2)), (None, common(2)), *[(None, common(2))] * 3]
    assert result(dedup_lines(make_docs(pairs))) == brute(pairs)


def test_empty_table(make_docs, spark):
    assert dedup_lines(make_docs([(1, "x")]).where("doc_id > 5")).collect() == []


def test_later_batches_count_earlier_lines(spark, make_docs):
    first = make_docs([(i, common(0)) for i in range(4)])
    second = make_docs([(9, common(0) + "\nown line")])
    runs = LineRuns(spark)
    runs.add(line_totals(first, "doc_id", "text", 40))
    assert result(dedup_lines(second, runs=runs)) == [(9, 2, 0, common(0) + "\nown line")]
    row = runs.common(5).collect()
    assert len(row) == 1 and row[0].last_doc == 9
    runs.close()


def test_batches_hold_every_row_once(make_docs):
    docs = make_docs([(None, "n"), *((i * i, str(i)) for i in range(30))])
    seen = [r.text for b in id_batches(docs, "doc_id") for r in b.collect()]
    assert sorted(seen) == sorted(["n", *map(str, range(30))])


def test_sha_of_kept_text(make_docs):
    df = dedup_lines(make_docs([(1, "a\n"), (2, None)]))
    got = {r.doc_id: r.s for r in df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()}
    assert got == {1: hashlib.sha256(b"a\n").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
