from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from lociform.operators import wide

SCHEMA = "id long, call long, attr string, val string, at timestamp, _attr string"


def table(spark, data):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(data)], SCHEMA)


def day(n):
    return datetime(2024, 1, n)


def made(spark, data):
    return wide.wide_table(table(spark, data), "call", "attr", "val", "at", "id")


def test_numbers(spark):
    texts = {" 12 ": 12, '"3.5"': 3.5, "+7": 7, "007": 7, "1e2": 100, "0,25": 0.25, "30.8%": 0.308, "-2": -2, "12..5": None, "nan": None, "": None, "1 2": None, "x7": None, None: None, "%": None, "inf": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", wide.number(F.col("t"))).collect()}
    for t, v in texts.items():
        assert (got[t] is None) if v is None else abs(got[t] - v) < 1e-12, t


def test_latest_number_counts_and_failures_stay(spark):
    got = made(spark, [(1, "DP", "20", day(1)), (1, "info.dp", "30", day(2)), (1, " dp ", "n/a", day(3)), (1, "QD", "low", day(1)), (1, "FRAC", "0,5", day(1))]).first()
    assert (got.DP, got.FRAC, got.QD) == (30, 0.5, None)
    assert got.cast_failures == {"DP": "n/a", "QD": "low"}


def test_other_names_are_other_attributes(spark):
    data = [(1, "LegacyDP", "5", day(1)), (1, "QD_old", "6", day(1)), (1, None, "7", day(1)), (2, "DP", "9", day(1))]
    assert rows(made(spark, data).select("entity", "DP")) == [(2, 9)]
    assert wide.unknown_attributes(table(spark, data), "call", "attr", "val").count() == 3


def test_whole_numbers_only_in_integer_columns(spark):
    got = made(spark, [(1, "DP", "20.5", day(1)), (2, "DP", "20.0", day(1)), (3, "DP", "9e20", day(1))]).orderBy("entity").collect()
    assert [r.DP for r in got] == [None, 20, None]
    assert got[0].cast_failures == {"DP": "20.5"} and got[2].cast_failures == {"DP": "9e20"}


def test_nulls_ties_repeats_empty(spark):
    assert made(spark, [(None, "DP", "1", day(1)), (1, "DP", None, day(1))]).collect()[0].DP is None
    assert made(spark, [(1, "DP", "1", None), (1, "DP", "2", day(1))]).first().DP == 2
    assert made(spark, [(1, "DP", "1", day(1)), (1, "DP", "2", day(1)), (1, "DP", "2", day(1))]).first().DP == 2
    assert made(spark, []).count() == 0
    assert made(spark, [(1, "BestGT", "AG" * 50_000, day(1))]).first().BestGT == "AG" * 50_000
