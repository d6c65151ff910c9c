"""Benchmark leaks, and the pipeline as a whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from auditlake.llm import decontam
from auditlake.llm.decontam import drop_leaked, find_leaks

SF = "/root/testdata/sf0.001"
ITEMS = [
    (1, "A train leaves Paris at 5 hours with 120 people while another train from Lyon has 80 people at 5 hours today"),
    (2, "What is the name of the longest river that flows through the old city of Prague in central europe"),
    (3, "too short item"), (4, None), (None, "an item without any id that should never be found by anyone here"),
    (5, "one two three four five six seven"), (5, "one two three four five six seven"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def leaks(make_docs, items, texts):
    rows = find_leaks(make_docs(list(enumerate(texts))), items).collect()
    return {(r.doc_id, r.item_id): (r.n_slots, r.n_changed) for r in rows}


def test_variants(make_docs, items, prose):
    one, two = ITEMS[0][1], ITEMS[1][1]
    around = prose(1, 50) + ". ", " " + prose(2, 50)
    texts = [
        around[0] + one + around[1],
        one.replace("5", "7").replace("120", "999").replace("Paris", "Rome"),
        two.replace("longest", "shortest") + around[1],  # 9 of 14 windows: too few
        two.replace("name", "title") + around[1],  # 11 of 14: as well
        two.replace("What", "Which") + around[1],
        " ".join(two.split()[:8]), around[0], None, "", "one two three four five six seven",
        "one two THREE, four five. six; seven", "too short item",
        one.replace(" ", "\n\t"), ITEMS[4][1],
    ]
    found = leaks(make_docs, items, texts)
    assert set(found) == {(0, 1), (1, 1), (4, 2), (9, 5), (10, 5), (12, 1)}
    assert found[(1, 1)][1] > 0 and found[(0, 1)][1] == 0


def test_several_texts_under_one_id(make_docs, spark, prose):
    mine = [ITEMS[0][1], ITEMS[1][1], ITEMS[1][1]]
    item = spark.createDataFrame([(7, t) for t in mine] + [(7, None), (8, ITEMS[0][1])], "item_id bigint, text string")
    texts = [ITEMS[0][1], prose(3, 40) + " " + ITEMS[1][1], ITEMS[0][1] + " " + ITEMS[1][1], prose(4, 40)]
    rows = find_leaks(make_docs(list(enumerate(texts))), item).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 7), (0, 8), (1, 7), (2, 7), (2, 8)]
    assert all(r.n_matched == r.n_windows for r in rows)


def test_other_case_and_punctuation(make_docs, items, prose):
    text = ("The old mill stands by the river. Every spring the miller paints its wheel. Then Anna counts 12 boats. "
            "Some boats carry flour to Prague. Others bring apples back. How many boats did Anna see in the year?")
    item = items.sparkSession.createDataFrame([(9, text)], "item_id bigint, text string")
    texts = [text.replace(".", ""), text.replace(". ", " - "), text.title(), text.upper(), text.lower(),
             text.replace(". ", " - ").replace("12", "31"), text.title().replace("12", "31"),
             text.replace(". ", " - ").replace("Anna", "Peter").replace("Prague", "Lyon")]
    plain = set(leaks(make_docs, item, texts))
    around = [prose(i, 30) + " " + t + " " + prose(i, 20) for i, t in enumerate(texts)]
    assert plain == set(leaks(make_docs, item, around)) == {(i, 9) for i in range(len(texts))}
    lower = items.sparkSession.createDataFrame([(9, text.lower())], "item_id bigint, text string")
    assert set(leaks(make_docs, lower, texts[:5])) == {(i, 9) for i in range(5)}


def test_names_that_open_sentences(make_docs, items, prose):
    text = ("Natalia sold 48 clips to her friends in the morning. Natalia then sold half as many clips in the "
            "afternoon. How many clips did Natalia sell in the whole day?")
    item = items.sparkSession.createDataFrame([(9, text)], "item_id bigint, text string")
    other = text.replace("48", "62").replace("Natalia", "Peter")
    once = text.replace("did Natalia", "did she")
    texts = [text, other, prose(1, 30) + ". " + other + " " + prose(2, 9), other.replace(". ", " - "),
             other.replace("Peter", "Anna", 1).replace("Peter", "Carl", 1)]  # one name for three
    assert set(leaks(make_docs, item, texts)) == {(i, 9) for i in range(4)}
    item = items.sparkSession.createDataFrame([(9, once), (8, text.title())], "item_id bigint, text string")
    changed = prose(3, 7) + " " + once.replace("48", "62").replace("Natalia", "Peter")
    clean = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    assert {d for d, _ in leaks(make_docs, item, [changed, clean])} == {0}


def test_slots_must_agree(make_docs, items):
    """The same item value never stands for many values."""
    base = "put 5 apples and then 5 pears and then 5 plums and then 5 grapes in it"
    item = items.sparkSession.createDataFrame([(9, base)], "item_id bigint, text string")
    other = base
    for n in (1, 2, 3, 4):
        other = other.replace(" 5 ", f" {n}0 ", 1)
    assert set(leaks(make_docs, item, [base, base.replace("5", "8"), other])) == {(0, 9), (1, 9)}


def test_leaks_in_any_place_at_any_stride(make_docs, items, prose):
    two = ITEMS[1][1]
    texts = [prose(i, i) + " " + two + " " + prose(i, 3) for i in range(17)]
    assert {d for d, i in leaks(make_docs, items, texts) if i == 2} == set(range(17))


def test_stride_is_safe(spark):
    """Every way to lose windows within the similarity leaves a run as long as the stride."""
    for m in range(1, 40):
        need = -(-8 * m // 10)
        stride = int(spark.range(1).select(decontam.safe_stride(F.lit(m), 0.8)).first()[0])
        lost = m - need
        runs = lost // (decontam.WORDS - 1) + 1
        assert 1 <= stride <= -(-need // runs)


def test_dropping_and_defined_cases(make_docs, items, prose):
    pairs = [(1, ITEMS[1][1]), (1, prose(1, 40)), (None, ITEMS[1][1]), (None, None), (2, ITEMS[1][1]), (2, ITEMS[1][1])]
    docs = make_docs(pairs)
    found = find_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 2), (None, 2), (2, 2)}
    kept = drop_leaked(docs, found)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, prose(1, 40)), (None, None)], key=repr)
    assert kept.columns == docs.columns
    assert find_leaks(docs.where("doc_id > 9"), items).collect() == []
    assert find_leaks(docs, items.where("item_id > 99")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from test_lines import brute as brute_lines
    from test_near import brute_components, brute_print
    from test_quality import brute as brute_statistics

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by_name = dict(corpus_pipeline.STAGES)
    assert [n.split("_")[0] for n in by_name] == ["quality", "line", "simhash", "benchmark", "best"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = by_name["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.collect()}
    for i, text in texts.items():
        n, _, _, _, repeated = brute_statistics(text)
        if n < 20 or 100 * repeated > 30 * n:
            assert i not in left
    lined = {i: t for i, _, _, t in brute_lines([(i, texts[i]) for i in left])}
    component = brute_components({i: brute_print(t) for i, t in lined.items()})
    single = {i: lined[i] for i in component if component[i] == i}
    plain = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split())
    whole = [plain(b) for b in bench]
    out = corpus_pipeline.run(spark, SF).collect()
    packed = {r.doc_id for r in out}
    leaked = {i for i, t in single.items() if any(b in plain(t) for b in whole)}
    assert packed == set(single) - leaked
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tok.encode(single[i], add_special_tokens=False).ids) + 1 for i in packed}
