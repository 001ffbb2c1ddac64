"""Pileups: weights and strands of bases, indels and clips by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociform.functions.codes import CallerConfig

#: Counters from here on make a position invalid.
STRAND_LIMIT, WEIGHT_LIMIT, INDEL_LIMIT = 0xFFFC, 0xFFFF, 0xFFFF


def pileup(bases: DataFrame) -> DataFrame:
    """Counters of each position: arrays ``w`` (weights), ``f`` and ``r`` (strands) of A, C, G, T.

    ``is_saturated`` marks positions whose counters would leave the 16-bit range. One
    partial and one final aggregation on the position, which no chromosome can skew.
    ``sign`` (1, or -1 for reads taken back) is used where the input has it.
    """
    sign = F.col("sign") if "sign" in bases.columns else F.lit(1)
    rows = bases.select("chrom", "pos", "code", "weight", "forward", sign.alias("sign"))
    one = lambda k, v: F.coalesce(F.sum(F.when(F.col("code") == k, v)), F.lit(0)).cast("long")
    plus, minus = F.when(F.col("forward"), F.col("sign")).otherwise(0), F.when(F.col("forward"), 0).otherwise(F.col("sign"))
    made = rows.groupBy("chrom", "pos").agg(
        *[one(k, F.col("weight") * F.col("sign")).alias(f"w{k}") for k in range(4)],
        *[one(k, plus).alias(f"f{k}") for k in range(4)],
        *[one(k, minus).alias(f"r{k}") for k in range(4)],
    )
    arrays = [F.array(*[F.col(f"{x}{k}") for k in range(4)]).alias(x) for x in "wfr"]
    wide = made.select("chrom", "pos", *arrays)
    full = (F.array_max(F.concat("f", "r")) >= STRAND_LIMIT) | (F.array_max("w") >= WEIGHT_LIMIT)
    return wide.withColumn("is_saturated", full)


def retract(bases: DataFrame, gone: DataFrame) -> DataFrame:
    """Pileup of ``bases`` with whole reads taken back; what falls to zero has no row."""
    signed = bases.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
    return pileup(signed).where("exists(f, x -> x > 0) or exists(r, x -> x > 0)")


def realign(bases: DataFrame, realigned: DataFrame, start: int, end: int) -> DataFrame:
    """Pileup with the bases of realigned reads added inside ``[start, end]``."""
    return pileup(bases.unionByName(realigned.where(F.col("pos").between(start, end))))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def site_totals(piled: DataFrame) -> DataFrame:
    """Adds sums over bases that were seen at all, and flags of seen C or G, and seen G."""
    seen = F.transform(F.zip_with("f", "r", lambda a, b: a + b), lambda n: n > 0)
    weight = _total(F.zip_with(F.col("w"), seen, lambda w, s: F.when(s, w).otherwise(0)))
    return piled.select(
        "*",
        weight.alias("weight"), _total(F.col("f")).alias("forward"), _total(F.col("r")).alias("reverse"),
        (seen[1] | seen[2]).cast("int").alias("gc"), seen[2].cast("int").alias("g"),
    )


def indel_pileup(indels: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Counts of each indel: ``chrom, pos, kind, length, seq, hq, lq``.

    High quality is a weight above the settings' indel weight. Deletions are told apart by
    length, insertions by length and bases.
    """
    high = F.col("weight") > config.indel_weight
    rows = indels.select("chrom", "pos", "kind", "length", F.when(F.col("kind") == "I", F.col("seq")).alias("seq"), "weight")
    return rows.groupBy("chrom", "pos", "kind", "length", "seq").agg(F.count_if(high).alias("hq"), F.count_if(~high).alias("lq"))


def retract_indels(indels: DataFrame, gone: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Counts of ``indels`` with those of whole reads taken back, high and low quality each; what falls to zero has no row."""
    counts = indel_pileup(indels, config).unionByName(indel_pileup(gone, config).withColumns({"hq": -F.col("hq"), "lq": -F.col("lq")}))
    left = counts.groupBy("chrom", "pos", "kind", "length", "seq").agg(F.greatest(F.sum("hq"), F.lit(0)).alias("hq"), F.greatest(F.sum("lq"), F.lit(0)).alias("lq"))
    return left.where("hq > 0 or lq > 0")


def realign_indels(indels: DataFrame, realigned: DataFrame, start: int, end: int, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Counts with the indels of realigned reads added inside ``[start, end]``."""
    return indel_pileup(indels.unionByName(realigned.where(F.col("pos").between(start, end))), config)


def with_indel_saturation(piled: DataFrame, counts: DataFrame) -> DataFrame:
    """Pileup whose ``is_saturated`` also marks the positions of indels with as many reads as a 16-bit counter holds."""
    full = counts.where((F.col("hq") >= INDEL_LIMIT) | (F.col("lq") >= INDEL_LIMIT)).select("chrom", "pos", F.lit(True).alias("_full")).distinct()
    return piled.join(full, ["chrom", "pos"], "left").withColumn("is_saturated", F.col("is_saturated") | F.coalesce("_full", F.lit(False))).drop("_full")


def top_indels(counts: DataFrame) -> DataFrame:
    """The best and second indel of each anchor: ``chrom, pos, indels, total_hq, total_lq``.

    Indels are reported at the base before them. They rank by ``hq + lq``; ties go to
    insertions, then to the shorter, then to the first in order of bases, so the outcome
    doesn't depend on the order of reads. Totals go over all indels of the anchor.
    """
    anchored = counts.select("chrom", F.greatest(F.col("pos") - 1, F.lit(1)).alias("pos"), "kind", "length", "seq", "hq", "lq")
    order = (F.desc(F.col("hq") + F.col("lq")), F.asc(F.when(F.col("kind") == "I", 0).otherwise(1)), F.asc("length"), F.asc("seq"))
    place = Window.partitionBy("chrom", "pos")
    ranked = anchored.select(
        "*", F.row_number().over(place.orderBy(*order)).alias("k"), F.sum("hq").over(place).alias("total_hq"), F.sum("lq").over(place).alias("total_lq")
    ).where("k <= 2")
    best = F.transform(
        F.array_sort(F.collect_list(F.struct("k", "kind", "length", "seq", "hq", "lq"))),
        lambda x: F.struct(x["kind"].alias("kind"), x["length"].alias("length"), x["seq"].alias("seq"), x["hq"].alias("hq"), x["lq"].alias("lq")),
    )
    return ranked.groupBy("chrom", "pos").agg(best.alias("indels"), F.max("total_hq").alias("total_hq"), F.max("total_lq").alias("total_lq"))


def clip_counts(clips: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Clips by position and side, less those in ``gone``: ``chrom, pos, left_count, right_count``."""
    signed = clips.select("chrom", "pos", "side", F.lit(1).alias("n"))
    if gone is not None:
        signed = signed.unionByName(gone.select("chrom", "pos", "side", F.lit(-1).alias("n")))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0))
    counts = signed.groupBy("chrom", "pos").agg(side(0).alias("left_count"), side(1).alias("right_count"))
    return counts.where("left_count > 0 or right_count > 0")


def clips_at(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``n_clips``, the clips of both sides at each site's own position, 0 where there are none."""
    n = counts.select("chrom", "pos", (F.col("left_count") + F.col("right_count")).alias("_n"))
    return sites.join(n, ["chrom", "pos"], "left").withColumn("n_clips", F.coalesce("_n", F.lit(0))).drop("_n")


def position_support(piled: DataFrame, indel_counts: DataFrame) -> DataFrame:
    """Reads at each position, deletions included: ``chrom, pos, support``."""
    reads = piled.select("chrom", "pos", (_total(F.col("f")) + _total(F.col("r"))).alias("n"))
    gaps = indel_counts.where("kind = 'D'").select("chrom", "pos", (F.col("hq") + F.col("lq")).alias("n"))
    return reads.unionByName(gaps).groupBy("chrom", "pos").agg(F.sum("n").alias("support"))


def position_info(piled: DataFrame, indel_counts: DataFrame) -> DataFrame:
    """All counters of each position with its whole list of indels, most frequent first."""
    each = F.struct((-(F.col("hq") + F.col("lq"))).alias("o"), "kind", "length", "seq", "hq", "lq")
    lists = indel_counts.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(each)).alias("indels"))
    return piled.join(lists, ["chrom", "pos"], "left")


def share_histogram(df: DataFrame, share: Column) -> DataFrame:
    """Rows by percent bin of a share: ``bin, n``."""
    return df.where(share.isNotNull()).groupBy(F.floor(share * 100 + 0.4999).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(piled: DataFrame, lengths: DataFrame) -> DataFrame:
    """Covered share of each sequence and whether it is sparse: ``chrom, covered, length, is_sparse`` (below a tenth)."""
    seen = piled.groupBy("chrom").agg(F.count(F.lit(1)).alias("covered"))
    joined = lengths.select("chrom", "length").join(seen, "chrom", "left")
    covered = F.coalesce("covered", F.lit(0))
    return joined.select("chrom", covered.alias("covered"), "length", (covered / F.col("length") < 0.1).alias("is_sparse"))
