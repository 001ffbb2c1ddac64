import math
import random

from lociform.llm.cutoff import cutoff_report, exact_positions, fraction_cutoffs, keep_fraction

SCHEMA = "src string, q double, id long, _src string, source string"


def table(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def brute(data, fraction):
    out = {}
    for s in {r[0] for r in data if r[0] is not None}:
        q = sorted((r[1] for r in data if r[0] == s and r[1] is not None and r[1] == r[1]), reverse=True)
        if q:
            cut = q[math.ceil(len(q) * fraction - 1e-9) - 1]
            out[s] = (cut, len(q), sum(x >= cut for x in q))
    return out


def test_hot_source_ties_and_repeats(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"s{i % 7}", float(rng.choice([1, 2, 2.5, 3, rng.random()])), i // 2) for i in range(3000)]
    data += [(None, 1.0, 1), ("n", None, 2), ("n", float("nan"), 3), ("inf", float("inf"), 4), ("inf", float("-inf"), 5), ("one", 0.0, 6)]
    got = {r.source: (r.cutoff, r.n_scored, r.n_kept) for r in cutoff_report(table(spark, data), "src", "q", "id", "0.3").collect()}
    assert got == brute(data, 0.3)
    kept = keep_fraction(table(spark, data), "src", "q", "id", "0.3")
    assert kept.count() == sum(v[2] for v in got.values())


def test_positions_are_exact_over_blocks(spark):
    data = [("a", float(i % 50), i) for i in range(500)] + [("b", 1.0, i) for i in range(3)]
    placed = exact_positions(table(spark, data), "src", "q", "id", partitions=7).collect()
    got = [(r._src, r._id) for r in sorted(placed, key=lambda r: (r._block, r._place))]
    assert got == [(s, i) for s, q, i in sorted(data, key=lambda r: (r[0], -r[1], r[2]))]


def test_exact_shares_and_empty(spark):
    data = [("a", float(i), i) for i in range(10)]
    got = {f: fraction_cutoffs(table(spark, data), "src", "q", "id", f).first() for f in ("0.1", "0.3", "0.31", "1")}
    assert [(r.cutoff, r.n_target) for r in got.values()] == [(9.0, 1), (7.0, 3), (6.0, 4), (0.0, 10)]
    assert cutoff_report(table(spark, []), "src", "q", "id").count() == 0
