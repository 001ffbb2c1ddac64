import random

from pyspark.sql import functions as F

from lociform.llm.sketch import merge_sketches, percentile_sketches, percentiles, rank_error


def table(spark, data):
    return spark.createDataFrame(data, "g string, v double").selectExpr("*", "1 as field_tag", "2 as n")


def answers(df):
    return {(r.g, r.rank): (r.n, r.value) for r in df.collect()}


def test_small_groups_are_exact(spark):
    data = [("a", float(v)) for v in range(1, 101)] + [("b", 5.0)] * 7 + [("c", None), ("c", float("nan")), ("c", float("inf")), (None, 1.0)]
    got = answers(percentiles(percentile_sketches(table(spark, data), ["g"], {"V": F.col("v")}), ["g"], [0.1, 0.5, 1.0]))
    assert got == {("a", 0.1): (100, 10.0), ("a", 0.5): (100, 50.0), ("a", 1.0): (100, 100.0), **{("b", r): (7, 5.0) for r in (0.1, 0.5, 1.0)}, **{(None, r): (1, 1.0) for r in (0.1, 0.5, 1.0)}}


def test_merged_parts_keep_the_bound(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(60_000)]
    df = table(spark, [(str(i % 30), v) for i, v in enumerate(values)])
    parts = percentile_sketches(df, ["g"], {"V": F.col("v")}, k=400)
    merged = percentiles(merge_sketches(parts, []).withColumn("g", F.lit("all")), ["g"], [0.01, 0.25, 0.5, 0.75, 0.99])
    order = sorted(values)
    for (_, rank), (n, v) in answers(merged).items():
        share = sum(x <= v for x in order) / len(order)
        assert n == 60_000 and abs(share - rank) < 2 * rank_error(400)


def test_empty(spark):
    assert percentile_sketches(table(spark, []), ["g"], {"V": F.col("v")}).count() == 0
