"""Regions: merging, clipping, and joins with points and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociform.plans.tables import fresh

#: Positions of one bin of a range join, and of one tile of a scan along a chromosome.
BIN, TILE = 4096, 1 << 20


def normalised(regions: DataFrame, source: str = "bed") -> DataFrame:
    """1-based half-open regions from BED (0-based half-open) or GFF (1-based closed) columns ``chrom, start, end``.

    Both become ``[start + 1, end + 1)`` for BED and ``[start, end + 1)`` for GFF. Null and
    empty regions are left out.
    """
    start = F.col("start") + (1 if source == "bed" else 0)
    out = regions.select("chrom", start.cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"))
    return out.where("chrom is not null and start < end")


def merged(regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Disjoint regions: overlapping ones united, touching ones kept apart.

    A region opens a new group if it starts at or behind every end before it. Along a
    chromosome that is a running maximum, taken in two levels: within tiles by start, and
    over the tiles' maxima, so one chromosome is no single task. Equal regions are one.
    """
    rows = regions.select("chrom", "start", "end").where("chrom is not null and start < end").groupBy("chrom", "start").agg(F.max("end").alias("end"))
    rows = rows.withColumn("_t", F.floor(F.col("start") / tile))
    earlier = Window.unboundedPreceding, -1
    tiles = rows.groupBy("chrom", "_t").agg(F.max("end").alias("_end"))
    tiles = tiles.select("chrom", "_t", F.max("_end").over(Window.partitionBy("chrom").orderBy("_t").rowsBetween(*earlier)).alias("_reach"))
    local = Window.partitionBy("chrom", "_t").orderBy("start")
    flagged = rows.join(tiles, ["chrom", "_t"]).withColumn("_opens", F.coalesce(F.col("start") >= F.greatest("_reach", F.max("end").over(local.rowsBetween(*earlier))), F.lit(True)))
    # within a tile the groups are numbered; those before a tile's first opening belong to the tile that opened last
    numbered = flagged.withColumn("_k", F.sum(F.col("_opens").cast("int")).over(local))
    part = numbered.groupBy("chrom", "_t", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("_opens").alias("_opens"))
    order = Window.partitionBy("chrom").orderBy("_t")
    last = part.groupBy("chrom", "_t").agg(F.max(F.when(F.col("_opens"), F.col("_k"))).alias("_last"))
    opener = F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_last").alias("k"))), ignorenulls=True)
    last = last.select("chrom", "_t", opener.over(order.rowsBetween(*earlier)).alias("_before"))
    owned = part.join(last, ["chrom", "_t"])
    own = F.when(F.col("_opens"), F.struct(F.col("_t").alias("t"), F.col("_k").alias("k"))).otherwise(F.col("_before"))
    return owned.groupBy("chrom", own.alias("_g")).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether half-open intervals share a position; touching ones don't."""
    return (a_start < b_end) & (b_start < a_end)


def clipped(regions: DataFrame, lengths: DataFrame, strict: bool = False) -> DataFrame:
    """Regions cut to their sequence (``chrom, length``); with ``strict`` one that leaves it is an error."""
    both = regions.select("chrom", "start", "end").join(lengths.select("chrom", "length"), "chrom")
    outside = (F.col("start") < 1) | (F.col("end") > F.col("length") + 1)
    if strict:
        both = both.where(F.when(outside, F.raise_error(F.lit("region outside its sequence")).cast("boolean")).otherwise(True))
    cut = both.select("chrom", F.greatest("start", F.lit(1)).alias("start"), F.least(F.col("end"), F.col("length") + 1).alias("end"))
    return cut.where("start < end")


def with_margin(regions: DataFrame, margin: int = 100) -> DataFrame:
    """Regions widened on both sides, not below position 1, and merged."""
    wide = regions.select("chrom", F.greatest(F.col("start") - margin, F.lit(1)).alias("start"), (F.col("end") + margin).alias("end"))
    return merged(wide)


def _bins(regions: DataFrame, points: DataFrame, size: int, keep: dict[str, str], reach: int = 0) -> tuple[DataFrame, Column, list[str]]:
    """Regions by the bins they touch, what joins them to points, and the columns that only do that."""
    c, s, e, b = own = [fresh(n, points) for n in ("_c", "_s", "_e", "_bin")]
    wide = regions.where("start < end").select(
        F.col("chrom").alias(c), (F.col("start") - reach).alias(s), (F.col("end") + reach).alias(e), *[F.col(x).alias(y) for x, y in keep.items()]
    )
    bins = wide.withColumn(b, F.explode(F.sequence(F.floor(F.col(s) / size), F.floor((F.col(e) - 1) / size))))
    inside = (F.col("chrom") == F.col(c)) & (F.floor(F.col("pos") / size) == F.col(b)) & (F.col("pos") >= F.col(s)) & (F.col("pos") < F.col(e))
    return bins, inside, own


def points_in_regions(points: DataFrame, regions: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of ``points`` whose (chrom, pos) lies in any region ``[start, end)``, each once.

    An equi-join on bins: a point has one bin, a region the bins it touches, so there is no
    pairwise comparison over a chromosome, and a semi-join keeps points single however many
    regions hold them.
    """
    bins, inside, _ = _bins(regions, points, size, {})
    return points.join(bins, inside, "left_semi")


def near_points(points: DataFrame, others: DataFrame, reach: int, keep: dict[str, str], size: int = BIN) -> DataFrame:
    """Pairs of a point and an interval of ``others`` (``chrom, start, end``) within ``reach`` of it.

    ``keep`` maps the columns of ``others`` that come along to new names.
    """
    bins, inside, own = _bins(others, points, size, keep, reach)
    return points.join(bins, inside).drop(*own)
