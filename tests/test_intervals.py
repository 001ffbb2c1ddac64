from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lociform.operators import intervals, reference

SCHEMA = "chrom string, start long, end long"


def brute(regions):
    out = []
    for a, b in sorted(r for r in regions if r[0] < r[1]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 25)), max_size=14), st.sampled_from([4, 16, 1000]))
def test_merge_equals_brute_force(spark, pairs, tile):
    regions = [(a, a + n) for a, n in pairs]
    df = spark.createDataFrame([("c", a, b) for a, b in regions], SCHEMA)
    assert [r[1:] for r in rows(intervals.merged(df, tile).orderBy("start"))] == sorted(brute(regions), key=repr)


def test_merge_again_changes_nothing(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 9), ("c", 4, 6), ("d", 1, 2), ("d", 1, 2), (None, 1, 2), ("d", None, 2)], SCHEMA)
    once = intervals.merged(df)
    assert rows(once) == [("c", 1, 9), ("d", 1, 2)] and rows(intervals.merged(once)) == rows(once)


def test_normalise_clip_margin(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 8, 7), ("c", 90, 120)], SCHEMA)
    assert rows(intervals.normalised(df)) == [("c", 1, 6), ("c", 91, 121)]
    lengths = spark.createDataFrame([("c", 100)], "chrom string, length long")
    assert rows(intervals.clipped(intervals.normalised(df), lengths)) == [("c", 1, 6), ("c", 91, 101)]
    assert rows(intervals.with_margin(intervals.normalised(df), 3)) == [("c", 1, 9), ("c", 88, 124)]


def test_points(spark):
    points = spark.createDataFrame([("c", p, p % 2) for p in range(1, 40)] + [("d", 5, 0), (None, 5, 0)], "chrom string, pos long, _bin int")
    regions = spark.createDataFrame([("c", 3, 6), ("c", 5, 9), ("c", 20, 30)], SCHEMA)
    got = [r.pos for r in intervals.points_in_regions(points, regions, size=4).orderBy("pos").collect()]
    assert got == [*range(3, 9), *range(20, 30)]
    assert intervals.points_in_regions(points, regions.limit(0)).count() == 0


def test_runs_and_slices(spark):
    seq = "AACCCCCCGTTTA"
    bases = spark.createDataFrame([("c", i, "ACGT".index(b)) for i, b in enumerate(seq, 1)], "chrom string, pos long, ref_code int")
    want = [("c", 1, 3, 0), ("c", 3, 9, 1), ("c", 9, 10, 2), ("c", 10, 13, 3), ("c", 13, 14, 0)]
    for tile in (1, 2, 3, 100):
        assert sorted(map(tuple, reference.base_runs(bases, tile).collect())) == want
    from pyspark.sql import functions as F

    far = bases.unionByName(spark.createDataFrame([("c", 4096 + i, 3) for i in range(1, 4)], bases.schema))
    sites = spark.createDataFrame([("c", 2), ("c", 4097), ("c", 4095), ("x", 1)], "chrom string, pos long")
    got = {r.pos: r.t for r in reference.slices(sites, reference.chunks_of_bases(far), {"t": (F.lit(0), F.lit(3))}).collect()}
    assert got == {2: "ACC", 4097: "TTT", 4095: "NNT", 1: None}
