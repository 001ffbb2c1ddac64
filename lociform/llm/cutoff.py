"""Score cutoffs per source that keep a target fraction (problem 1)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociform.plans.tables import can_materialize, materialized, shuffle_partitions

#: Row numbers of monotonically_increasing_id: partition above, place in the partition below this bit.
_PLACE_BITS = 33


def _scored(df: DataFrame, source: str, score: str, ident: str) -> DataFrame:
    rows = df.select(F.col(source).alias("_src"), F.col(score).cast("double").alias("_score"), F.col(ident).alias("_id"))
    return rows.where(F.col("_src").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score"))


def exact_positions(df: DataFrame, source: str, score: str, ident: str, partitions: int | None = None) -> DataFrame:
    """Places of rows in the order (score falling, identifier) of their source, without one task per source.

    Rows are sorted over a range partitioning of (source, score, identifier), so a source
    that holds a third of all rows is spread over as many sorted blocks as its size asks
    for. Columns: ``_src, _score, _id, _block, _place`` with ``_place`` counting from 0
    in the whole block. The sorted rows are written once to the checkpoint folder: all
    later steps see the same blocks, however Spark sizes them (unless ``partitions`` says),
    and nothing is sorted again. Without such a folder the number of blocks is fixed.
    """
    order = [F.col("_src").asc(), F.col("_score").desc(), F.col("_id").asc()]
    rows = _scored(df, source, score, ident)
    fixed = partitions or (None if can_materialize(df) else shuffle_partitions(df))
    laid = (rows.repartitionByRange(fixed, *order) if fixed else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    placed = laid.select("_src", "_score", "_id", row.alias("_row")).select(
        "_src",
        "_score",
        "_id",
        F.shiftright("_row", _PLACE_BITS).cast("int").alias("_block"),
        F.col("_row").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"),
    )
    return materialized(placed)


def _cutoffs(placed: DataFrame, fraction: str) -> DataFrame:
    if not 0 < Decimal(fraction) <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    blocks = placed.groupBy("_src", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    per_source = Window.partitionBy("_src")
    before = F.sum("_n").over(per_source.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    target = F.ceil(F.col("_total").cast("decimal(20,0)") * F.lit(Decimal(fraction))).cast("long")
    hit = (
        blocks.select("*", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(per_source).alias("_total"))
        .withColumn("_target", target)
        .where((F.col("_before") < F.col("_target")) & (F.col("_target") <= F.col("_before") + F.col("_n")))
        .select("_src", "_block", (F.col("_target") - F.col("_before") - 1 + F.col("_from")).alias("_place"), "_total", "_target")
    )
    return placed.join(hit, ["_src", "_block", "_place"]).select(
        F.col("_src").alias("source"), F.col("_score").alias("cutoff"), F.col("_total").alias("n_scored"), F.col("_target").alias("n_target")
    )


def fraction_cutoffs(
    df: DataFrame, source: str, score: str, ident: str, fraction: str = "0.3", partitions: int | None = None
) -> DataFrame:
    """The cutoff of each source: its score at the exact position ``ceil(fraction * rows)``.

    Columns: ``source, cutoff, n_scored, n_target``. Every row at or above the cutoff is
    meant to be kept, so ties at the cutoff never split. Rows whose source or score is
    null, or whose score is NaN, aren't scored; infinite scores are, at the ends.
    Repeated rows count. A source of one row has that row's score; an empty table gives
    no row. ``fraction`` is a decimal text above 0 and at most 1.
    """
    return _cutoffs(exact_positions(df, source, score, ident, partitions), fraction)


def _kept(placed: DataFrame, cutoffs: DataFrame) -> DataFrame:
    cut = cutoffs.select(F.col("source").alias("_src"), F.col("cutoff").alias("_cut"))
    kept = placed.join(cut, "_src").where(F.col("_score") >= F.col("_cut"))
    return kept.select(F.col("_src").alias("source"), F.col("_id").alias("ident"), F.col("_score").alias("score"), F.col("_cut").alias("cutoff"))


def keep_fraction(df: DataFrame, source: str, score: str, ident: str, fraction: str = "0.3") -> DataFrame:
    """The rows kept under ``fraction_cutoffs``: ``source, ident, score, cutoff``.

    Cutoffs are one row per source; how they meet the rows is left to adaptive execution,
    which splits a hot source when both sides are shuffled.
    """
    placed = exact_positions(df, source, score, ident)
    return _kept(placed, _cutoffs(placed, fraction))


def cutoff_report(df: DataFrame, source: str, score: str, ident: str, fraction: str = "0.3") -> DataFrame:
    """Cutoffs with the kept sizes: ``source, cutoff, n_scored, n_target, n_kept``; the rows are sorted once for both."""
    placed = exact_positions(df, source, score, ident)
    cutoffs = materialized(_cutoffs(placed, fraction))
    return cutoffs.join(_kept(placed, cutoffs).groupBy("source").agg(F.count(F.lit(1)).alias("n_kept")), "source")
