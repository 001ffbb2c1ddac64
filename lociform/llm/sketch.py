"""Percentiles from mergeable compactor sketches (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compactor size: exact up to so many values, beyond that a rank error of about 2.3 / k**0.9 (99 %).
K = 800


def percentile_sketches(df: DataFrame, groups: list[str], values: dict[str, Column], k: int = K) -> DataFrame:
    """One sketch per group and value: ``groups..., field_tag, sketch``.

    The sketch is a hierarchy of compactors, each sorting its values and passing every
    other one, by a random start, to the level above. Spark builds it per task and merges
    it level by level after the shuffle, so a group that holds a third of all rows sends
    one small sketch per task. Null and NaN values are left out, infinite ones too; a
    group without values has no row for that field. Null groups form a group of their
    own. Sketches of separate runs, days or partitions combine with ``merge_sketches``.
    """
    kept = {f: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c.cast("double")) for f, c in values.items()}
    rows = df.select(*groups, *[c.alias(f"_v{i}") for i, c in enumerate(kept.values())])
    made = rows.groupBy(*groups).agg(
        *[F.kll_sketch_agg_double(f"_v{i}", F.lit(k)).alias(f"_s{i}") for i in range(len(values))],
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(values))],
    )
    long = F.array(*[F.struct(F.lit(f).alias("field_tag"), F.col(f"_s{i}").alias("sketch"), F.col(f"_n{i}").alias("n")) for i, f in enumerate(values)])
    return made.select(*groups, F.explode(long).alias("_x")).where("_x.n > 0").select(*groups, "_x.field_tag", "_x.sketch")


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches put together over ``groups`` and field: ``groups..., field_tag, sketch``."""
    return sketches.where("sketch is not null").groupBy(*groups, "field_tag").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(sketches: DataFrame, groups: list[str], ranks: list[float]) -> DataFrame:
    """Percentiles answered from sketches: ``groups..., field_tag, n, rank, value``.

    ``value`` is the least value whose share of values at or below it reaches ``rank``,
    within the sketch's rank error; ``n`` is exact.
    """
    if not all(0 <= r <= 1 for r in ranks):
        raise ValueError("ranks lie in [0, 1]")
    answers = F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("value")) for r in ranks])
    n = F.kll_sketch_get_n_double("sketch").alias("n")
    return sketches.select(*groups, "field_tag", n, F.explode(answers).alias("_a")).select(*groups, "field_tag", "n", "_a.rank", "_a.value")


def rank_error(k: int = K) -> float:
    """Bound on the error of a rank, as a share of the values, that holds with 99 %."""
    return 2.296 / k**0.9021
