"""From pileups to candidate variants and their table of 98 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.codes import BASES, GENOTYPES, CallerConfig
from lociform.functions.genotype import best_two, genotype_likelihoods, likelihood_sum, posteriors, ranked
from lociform.operators.flanks import flank_metrics, neighbour_biases
from lociform.operators.intervals import near_points
from lociform.operators.pileup import site_totals
from lociform.operators.reference import slices
from lociform.plans.tables import materialized, once

#: Positions of a bin when sites meet the reference's runs, most of which are short.
RUN_BIN = 64
_INDEL = "array<struct<kind: string, length: int, seq: string, hq: bigint, lq: bigint>>"


def _indel(k: int, field: str, zero: int = 0) -> Column:
    return F.coalesce(F.try_element_at("indels", F.lit(k + 1))[field], F.lit(zero))


def sites(piled: DataFrame, top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Positions with reads or an anchored indel, their reference base and the six weights.

    Saturated positions and those off the reference (or on an uncalled base) are left out.
    Deleted bases are read from the reference. Indels weigh four times their high-quality
    reads.
    """
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    both = piled.join(top, ["chrom", "pos"], "full").select(
        "chrom", "pos", *[F.coalesce(x, zero).alias(x) for x in "wfr"],
        F.coalesce("indels", F.expr(f"cast(array() as {_INDEL})")).alias("indels"),
        F.coalesce("total_hq", F.lit(0)).alias("total_hq"), F.coalesce("total_lq", F.lit(0)).alias("total_lq"),
        F.coalesce("is_saturated", F.lit(False)).alias("is_saturated"),
    ).where("not is_saturated")
    placed = slices(both, chunks, {"ref": (F.lit(0), F.lit(1)), "after": (F.lit(1), F.lit(255))}).where("ref in ('A', 'C', 'G', 'T')")
    named = F.transform("indels", lambda x: F.struct(
        x["kind"].alias("kind"), x["length"].alias("length"),
        F.when(x["kind"] == "D", F.substring(F.col("after"), F.lit(1), x["length"])).otherwise(x["seq"]).alias("seq"), x["hq"].alias("hq"), x["lq"].alias("lq"),
    ))
    placed = placed.withColumn("indels", named).drop("after")
    return placed.withColumn("w6", F.concat("w", F.array(4 * _indel(0, "hq"), 4 * _indel(1, "hq")))).withColumn(
        "ref_code", F.array_position(F.array(*map(F.lit, BASES)), F.col("ref")).cast("int") - 1
    )


def genotyped(found: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Adds the likelihoods and the call (``gt`` as letters, best_p, second_p, p_d, flh)."""
    scored = found.withColumn("likelihood", genotype_likelihoods(F.col("w6"), F.col("ref_code"), config))
    # each step stands behind a generator, as the optimiser would copy sums and sorts of arrays into all their uses
    shares = once(once(scored.withColumn("p_d", likelihood_sum(F.col("likelihood")))).withColumn("flh", posteriors(F.col("likelihood"), F.col("ref_code"), F.col("p_d"))))
    order = once(shares.withColumn("_o", ranked(F.col("flh"))))
    call = order.withColumn("_c", best_two(F.col("_o"), F.col("p_d"), F.col("ref_code")))
    name = F.element_at(F.array(*map(F.lit, GENOTYPES)), F.col("_c.genotype") + 1)
    return call.select(*scored.columns, name.alias("gt"), "_c.best_p", "_c.second_p", "p_d", "flh")


def candidates(piled: DataFrame, top: DataFrame, chunks: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Sites whose call differs from the reference; an indel call without an indel is dropped."""
    calls = genotyped(sites(piled, top, chunks), config)
    x, y = F.col("gt").contains("X"), F.col("gt").contains("Y")
    backed = (~x | (F.size("indels") >= 1)) & (~y | (F.size("indels") >= 2))
    skip = F.when(x & (F.col("indels")[0]["kind"] == "D"), F.col("indels")[0]["length"]).otherwise(0)
    return calls.where((F.col("gt") != F.concat("ref", "ref")) & backed).withColumn("is_indel", x).withColumn("skip", skip)


def enriched(found: DataFrame, piled: DataFrame, runs: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates with flank metrics, biases and the homopolymer run they lie in.

    The candidates are used four times and the pileup twice: ``found`` is written once to the
    checkpoint folder, so that the model isn't worked out again for each; ``piled`` should be.
    """
    found = materialized(found)
    keys = found.select("chrom", "pos", "skip", "is_indel")
    flanks = flank_metrics(keys, site_totals(piled), strict)
    biases = neighbour_biases(keys, piled)
    hrun = near_points(keys.select("chrom", "pos"), runs, 0, {"start": "run_start", "end": "run_end"}, size=RUN_BIN)
    hrun = hrun.select("chrom", "pos", F.least(F.col("run_end") - F.col("run_start"), F.lit(65535)).alias("hrun"))
    out = found.join(flanks, ["chrom", "pos", "skip"], "left").join(biases, ["chrom", "pos", "skip"], "left").join(hrun, ["chrom", "pos"], "left")
    return out.withColumn("hrun", F.coalesce("hrun", F.lit(0)))


HEADER = (
    ["Chr", "Pos", "Ref", "PreBase"] + [f"p{g}" for g in GENOTYPES] + ["GT", "Optb", "Suboptb", "pD", "rfProb", "rfMode"]
    + ["optIn/Del", "Patt", "HQ", "LQ", "suboptIn/Del", "Patt", "HQ", "LQ", "Depth", *BASES] + [b + s for b in BASES for s in "+-"]
    + list(GENOTYPES) + [f"{k}-{b}" for k in ("SB", "SB1", "SB2", "BQB", "BQB1", "BQB2") for b in BASES]
    + ["RPB", "LGC", "RGC", "LG", "RG", "ASC", "LQ", "RQ", "polyrun", "totalHQ", "totalLQ"]
)


def scientific(x: Column) -> Column:
    return F.format_string("%.4e", x)


def tsv_rows(rows: DataFrame) -> DataFrame:
    """Enriched candidates as tab-separated lines of 98 fields: ``chrom, pos, line``; ``*`` marks what is missing."""
    star = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    fixed = lambda c, k: F.format_string(f"%.{k}f", c.cast("double"))

    def indel(k: int) -> list[Column]:
        x = F.when(F.col("is_indel"), F.try_element_at("indels", F.lit(k + 1)))
        return [star(F.concat(x["length"].cast("string"), x["kind"])), star(x["seq"]), star(x["hq"]), star(x["lq"])]

    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, v: s + v)
    bias = lambda n: [star(F.when(F.col(n).isNotNull(), scientific(F.col(n)[k]))) for k in range(4)]
    fields = [
        F.col("chrom"), F.col("pos").cast("string"), F.col("ref"), F.when(F.col("is_indel"), F.col("ref")).otherwise("*"),
        *[scientific(F.col("flh")[i]) for i in range(16)], F.col("gt"), scientific(F.col("best_p")), scientific(F.col("second_p")), scientific(F.col("p_d")),
        F.lit("0.0000e+00"), F.lit("0"), *indel(0), *indel(1), total.cast("string"), *[F.col("w")[k].cast("string") for k in range(4)],
        *[F.col(x)[k].cast("string") for k in range(4) for x in "fr"], *[scientific(F.col("likelihood")[i]) for i in range(16)],
        *bias("sb"), *bias("sb1"), *bias("sb2"), *bias("bqb"), *bias("bqb1"), *bias("bqb2"),
        fixed(F.col("read_pos_bias"), 4), fixed(F.col("left_gc"), 4), fixed(F.col("right_gc"), 4), F.col("left_g").cast("string"), F.col("right_g").cast("string"),
        fixed(F.col("depth_balance"), 4), fixed(F.col("left_quality"), 4), fixed(F.col("right_quality"), 4), F.col("hrun").cast("string"),
        F.col("total_hq").cast("string"), F.col("total_lq").cast("string"),
    ]
    assert len(fields) == len(HEADER) == 98
    return rows.select("chrom", "pos", F.concat_ws("\t", *fields).alias("line"))


def unbacked_calls(calls: DataFrame) -> DataFrame:
    """Indel calls without the indels they name; a sound run has none."""
    x, y = F.col("gt").contains("X"), F.col("gt").contains("Y")
    return calls.where((x & (F.size("indels") < 1)) | (y & (F.size("indels") < 2)))

