"""Building blocks against brute force, with one key holding most of the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditlake.functions import scale


def hot_rows(n=3000):
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i * 37 % 100003, rng.randrange(50))
            for i in range(n)]


def brute_total(rows):
    out, sums = {}, {}
    for g, s, v in sorted(rows, key=lambda r: r[1]):
        out[(g, s)] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    return out


def test_running_total(spark):
    rows = hot_rows()
    # spread the numbers over several blocks and levels
    rows = [(g, s * 1_000_003 % (1 << 40), v) for g, s, v in rows]
    df = spark.createDataFrame(rows, "g string, s bigint, v bigint").repartition(7)
    got = {(r.g, r.s): r.t for r in scale.running_total(df, ["g"], "s", "v", "t").collect()}
    assert got == brute_total(rows)


def test_ordinals(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, s bigint, v bigint").repartition(5)
    got = {(r.g, r.s): r.n for r in scale.ordinals(df, ["g"], ["v", "s"], "n", 6).collect()}
    expected, seen = {}, {}
    for g, s, v in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[g] = seen.get(g, 0) + 1
        expected[(g, s)] = seen[g]
    assert got == expected


def test_hot_group_is_numbered_in_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("s"))
    placed = df.repartitionByRange(4, "g", "s").withColumn("pid", F.spark_partition_id())
    assert placed.select("pid").distinct().count() == 4
    assert [r.n for r in scale.ordinals(df, ["g"], ["s"], "n", 4).orderBy("s").take(3)] == [1, 2, 3]


def test_salted_lookup_and_filter(spark):
    rows = hot_rows()
    facts = spark.createDataFrame(rows, "g string, s bigint, v bigint")
    dim = spark.createDataFrame([("hot", 1), ("k3", 2)], "g string, w int")
    got = {(r.g, r.s): r.w for r in scale.salted_lookup(facts, dim, ["g"], ["s"]).collect()}
    assert got == {(g, s): {"hot": 1, "k3": 2}.get(g) for g, s, _ in rows}
    kept = scale.salted_filter(facts, dim, ["g"], ["s"]).count()
    dropped = scale.salted_filter(facts, dim, ["g"], ["s"], anti=True).count()
    assert kept == sum(g in ("hot", "k3") for g, _, _ in rows) and kept + dropped == len(rows)


def test_salting_splits_the_hot_key(spark):
    facts = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").alias("s"))
    dim = spark.createDataFrame([("hot", 1)], "g string, w int")
    salts = facts.select(F.pmod(F.xxhash64("s"), F.lit(scale.SALT_BUCKETS))).distinct().count()
    assert salts == scale.SALT_BUCKETS
    assert scale.salted_lookup(facts, dim, ["g"], ["s"], "inner").count() == 1000


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "g string, s bigint, v bigint")
    out = scale.top_n(df, ["g"], ["v", "s"], 5)
    assert out.groupBy("g").count().agg(F.max("count")).first()[0] == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_stored_round_trip(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, scale.stored(df).collect()), key=str) == [(1, None), (2, "x")]
