"""What lies around a site: sums over the flanks, and the neighbours' biases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.stats import base_quality_bias, strand_bias
from lociform.operators.intervals import near_points

REACH, NEAR = 100, 3
#: Positions of a bin when frames meet positions: about a frame's length, so that few positions outside it are compared.
FRAME_BIN = 256
#: The frames of strict mode lie so far to the left.
STRICT_SHIFT = 100


def _positions(totals: DataFrame) -> DataFrame:
    """Totals by position, with the change of depth to the next position (``delta``).

    Positions without reads count zero; the one before a covered position gets a row for its
    change of depth. A change next to a saturated position doesn't count.
    """
    depth = F.col("forward") + F.col("reverse")
    zero = F.lit(0).cast("long")
    here = F.struct(F.col("pos").alias("pos"), depth.alias("a"), zero.alias("b"), F.col("weight").alias("weight"), F.col("gc").cast("long").alias("gc"), F.col("g").cast("long").alias("g"), F.col("is_saturated").alias("sat"), F.lit(False).alias("sat_b"))
    before = F.struct((F.col("pos") - 1).alias("pos"), zero.alias("a"), depth.alias("b"), zero.alias("weight"), zero.alias("gc"), zero.alias("g"), F.lit(False).alias("sat"), F.col("is_saturated").alias("sat_b"))
    rows = totals.select("chrom", F.inline(F.array(here, before)))
    summed = rows.groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in ("a", "b", "weight", "gc", "g")], F.bool_or("sat").alias("sat"), F.bool_or("sat_b").alias("sat_b"))
    valid = F.when(F.col("sat"), 0).otherwise(1)
    return summed.select(
        "chrom", "pos", F.col("sat").cast("int").alias("sat"),
        *[(F.col(c) * valid).alias(n) for c, n in (("a", "depth"), ("weight", "weight"), ("gc", "gc"), ("g", "g"))],
        F.when(F.col("sat") | F.col("sat_b"), 0).otherwise(F.abs(F.col("a") - F.col("b"))).alias("delta"),
    )


def flank_metrics(sites: DataFrame, totals: DataFrame, strict: bool = False, reach: int = REACH) -> DataFrame:
    """Metrics of the ``reach`` positions left and right of each site.

    ``sites`` has ``chrom, pos, skip`` (deleted bases after the site, else 0), ``totals``
    comes from ``site_totals``. Columns added: read_pos_bias, left_gc, right_gc,
    depth_balance, left_quality, right_quality, left_g, right_g. Positions without reads
    count as zeros, saturated ones not at all, those before position 1 not either. Sums
    come from a binned join of sites with positions, so each site reads its own window and
    no chromosome is one task. ``strict`` shifts all frames to the left by 100.
    """
    shift = STRICT_SHIFT if strict else 0
    keyed = sites.select("chrom", F.col("pos").alias("site"), F.col("skip").cast("long").alias("skip")).distinct()
    frames = keyed.select("chrom", (F.col("site") - reach - shift).alias("start"), (F.col("site") + F.col("skip") + reach - shift).alias("end"), "site", "skip")
    near = near_points(_positions(totals), frames, 0, {"site": "site", "skip": "skip"}, size=FRAME_BIN)
    p = F.col("pos") + shift
    sides = {"left": (p >= F.col("site") - reach) & (p < F.col("site")), "right": (p >= F.col("site") + F.col("skip")) & (p < F.col("site") + F.col("skip") + reach)}
    tight = {"left": (p >= F.col("site") - NEAR) & (p < F.col("site")), "right": (p >= F.col("site") + F.col("skip")) & (p < F.col("site") + F.col("skip") + NEAR)}
    sums = near.groupBy("chrom", "site", "skip").agg(
        *[F.sum(F.when(sides[s], F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s in sides for c in ("depth", "weight", "gc", "delta", "sat")],
        *[F.sum(F.when(tight[s], F.col("g")).otherwise(0)).alias(f"{s}_g") for s in tight],
    )
    first = {"left": F.col("site") - reach - shift, "right": F.col("site") + F.col("skip") - shift}
    width = {s: F.lit(reach) - F.least(F.greatest(1 - first[s], F.lit(0)), F.lit(reach)) - F.coalesce(f"{s}_sat", F.lit(0)) for s in sides}
    col = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double")
    mean = lambda s, c: F.coalesce(F.try_divide(col(f"{s}_{c}"), width[s]), F.lit(0.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))
    return keyed.join(sums, ["chrom", "site", "skip"], "left").select(
        "chrom", F.col("site").alias("pos"), "skip",
        ratio(col("left_delta"), col("right_delta")).alias("read_pos_bias"),
        mean("left", "gc").alias("left_gc"), mean("right", "gc").alias("right_gc"),
        ratio(mean("left", "depth"), mean("right", "depth")).alias("depth_balance"),
        F.coalesce(F.try_divide(col("left_weight"), col("left_depth")), F.lit(0.0)).alias("left_quality"),
        F.coalesce(F.try_divide(col("right_weight"), col("right_depth")), F.lit(0.0)).alias("right_quality"),
        col("left_g").cast("int").alias("left_g"), col("right_g").cast("int").alias("right_g"),
    )


def _none(n: int = 4) -> Column:
    return F.array(*[F.lit(0).cast("long")] * n)


def neighbour_biases(sites: DataFrame, piled: DataFrame) -> DataFrame:
    """Strand and base quality biases at the site, the base before it and the base after its indel.

    Adds ``sb, sb1, sb2, bqb, bqb1, bqb2`` (arrays over A, C, G, T) to ``chrom, pos, skip``:
    for sites with ``is_indel`` in the order left, right, site; else the site's own first
    and nulls. A neighbour without reads has biases of 1.
    """
    right = F.col("pos") + F.col("skip")
    roles = F.when(F.col("is_indel"), F.array(F.col("pos") - 1, right, F.col("pos"))).otherwise(F.array(F.col("pos")))
    asked = sites.select("chrom", F.col("pos").alias("site"), "skip", "is_indel", F.posexplode(roles).alias("role", "pos"))
    found = asked.join(piled.select("chrom", "pos", "w", "f", "r"), ["chrom", "pos"], "left")
    w, f, r = (F.coalesce(F.col(x), _none()) for x in "wfr")
    biased = found.select("chrom", "site", "skip", "role", strand_bias(f, r).alias("s"), base_quality_bias(w, f, r).alias("q"))
    pick = lambda c, k: F.max_by(c, F.when(F.col("role") == k, 1))
    cols = [pick(c, k).alias(n + ("", "1", "2")[k]) for c, n in (("s", "sb"), ("q", "bqb")) for k in range(3)]
    return biased.groupBy("chrom", F.col("site").alias("pos"), "skip").agg(*cols)
