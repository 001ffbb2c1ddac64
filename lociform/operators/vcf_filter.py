"""Filter tags, known variants and indel support of VCF records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.vcf_math import max_depth
from lociform.operators.reads import cigar_ops, clean_bases
from lociform.operators.reference import slices
from lociform.operators.wide import number


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the filter tags; the defaults are the usual ones."""

    min_qual: float = 10
    min_frac_snp: float = 0.3
    min_frac_indel: float = 0.15
    max_sor_snp: float = 3
    max_fs_indel: float = 30
    min_dp: int = 3
    max_dp_multiplier: float = 5
    min_strand_count: int = 1
    min_qd_snp: float = 24
    min_qd_indel: float = 20


def info_text(info: Column, key: str) -> Column:
    """The value of an INFO entry up to the next delimiter; null where it is absent."""
    found = F.regexp_extract(info, rf"(?:^|[;|,\s]){key}\s*=\s*([^;|,\s]*)", 1)
    return F.when(found != "", found)


def info_number(info: Column, key: str) -> Column:
    return number(info_text(info, key))


def is_indel(info: Column) -> Column:
    return F.coalesce(info.rlike(r"(?:^|[;|,\s])INDEL(?:[;|,\s]|$)"), F.lit(False))


def mode_depth(vcf: DataFrame, group: str) -> DataFrame:
    """Most frequent DP of each group of records (a file, a run): ``group, mode_dp``; ties go to the larger depth."""
    counts = vcf.select(F.col(group).alias("group"), info_number(F.col("info"), "DP").cast("long").alias("dp")).where("dp is not null").groupBy("group", "dp").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group").agg(F.max_by("dp", F.struct("n", "dp")).alias("mode_dp"))


def known_alleles(dbsnp: DataFrame) -> DataFrame:
    """One row per known allele: ``chrom, pos, ref_allele, alt, rsid``; of repeated entries the last delivered counts."""
    each = dbsnp.select("snp_id", F.lower(F.trim("chrom")).alias("chrom"), "pos", "ref_allele", "rsid", F.explode(F.regexp_extract_all("alt", F.lit("(<[^<>]*>|[^,;|/\\s\"']+)"), 1)).alias("alt"))
    last = each.groupBy("chrom", "pos", "ref_allele", "alt").agg(F.max_by(F.struct("rsid"), F.struct("snp_id", "rsid")).alias("_l"))
    return last.select("chrom", "pos", "ref_allele", "alt", "_l.rsid").where("rsid is not null")


def annotated(vcf: DataFrame, dbsnp: DataFrame, ident: str) -> DataFrame:
    """``ident, rsids`` of records with known alleles, the identifiers sorted and joined by commas.

    An equi-join on the whole allele; sequence names must be spelled alike, case aside.
    """
    alts = vcf.select(F.col(ident).alias("ident"), F.lower(F.trim("chrom")).alias("chrom"), "pos", "ref_allele", F.explode(F.split("alt", ",")).alias("alt"))
    hits = alts.join(known_alleles(dbsnp), ["chrom", "pos", "ref_allele", "alt"])
    return hits.groupBy("ident").agg(F.array_join(F.array_sort(F.collect_set("rsid")), ",").alias("rsids"))


def tag_columns(t: Thresholds) -> Column:
    """Tags of a record in their fixed order, joined by ``;``, empty if there is none. Needs ``mode_dp``."""
    info, indel = F.col("info"), is_indel(F.col("info"))
    dp, frac, qd = (info_number(info, k) for k in ("DP", "FRAC", "QD"))
    fs, odds = info_number(info, "SBFisherPhredAlt"), info_number(info, "SOR")
    strands = F.split(F.regexp_extract(info, r"(?:^|[;|,\s])DP8\s*=\s*([0-9.]+(?:[,;|/\s]+[0-9.]+){7})", 1), r"[,;|/\s]+")
    place = lambda base: (F.array_position(F.array(*map(F.lit, "ACGT")), base) - 1).cast("int") * 2
    low = lambda i: F.coalesce(F.get(strands, i).try_cast("double") < t.min_strand_count, F.lit(False))
    thin = F.exists(F.split("alt", ","), lambda b: low(place(b)) | low(place(b) + 1))
    tags = [
        F.when(F.col("qual") < t.min_qual, "QUALlow"),
        F.when(dp > max_depth(F.col("mode_dp"), t.max_dp_multiplier), "DPhigh"),
        F.when(dp < t.min_dp, "DPlow"),
        F.when(indel & (fs > t.max_fs_indel), "FShigh"),
        F.when(~indel & (odds > t.max_sor_snp), "SORhigh"),
        F.when(~indel & odds.isNull() & (fs > t.max_fs_indel), "FShigh"),
        F.when(frac < F.when(indel, t.min_frac_indel).otherwise(t.min_frac_snp), "FRAClow"),
        F.when(qd < F.when(indel, t.min_qd_indel).otherwise(t.min_qd_snp), "QDlow"),
        F.when(~indel & thin, "SClow"),
    ]
    return F.concat_ws(";", *tags)


def filter_vcf(vcf: DataFrame, dbsnp: DataFrame, ident: str, group: str, t: Thresholds = Thresholds()) -> DataFrame:
    """``ident, id, filter_tag`` of every record, known ones keeping FILTER ``.`` whatever their tags.

    The most frequent depth is per ``group``. Values that are absent or no number raise no
    tag; a NaN quality raises none. ``id`` is what dbSNP has, else the record's own.
    """
    modes = mode_depth(vcf, group)
    rows = vcf.select(F.col(ident).alias("ident"), F.col(group).alias("group"), F.coalesce("id", F.lit(".")).alias("own_id"), "alt", F.when(~F.isnan("qual"), F.col("qual")).alias("qual"), "info")
    tagged = rows.join(modes, "group", "left").withColumn("tags", tag_columns(t)).select("ident", "own_id", "tags")
    out = tagged.join(annotated(vcf, dbsnp, ident), "ident", "left").withColumn("id", F.coalesce("rsids", "own_id"))
    return out.select("ident", "id", F.when((F.col("tags") == "") | (F.col("id") != "."), ".").otherwise(F.col("tags")).alias("filter_tag"))


def filter_summary(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("filter_tag").agg(F.count(F.lit(1)).alias("n"))


def indel_support(vcf: DataFrame, ident: str, reads: DataFrame, chunks: DataFrame, near: int = 10) -> DataFrame:
    """Reads that show each indel record's own indel: ``ident, alt, pos_count, neg_count, snp_mingle, indel_mingle``.

    A read counts if its first CIGAR operation of the record's kind and length, which may
    not be its very first, lies right behind the record's position. ``indel_mingle`` counts
    other indels with at most ``near`` matched bases in between, on either side;
    ``snp_mingle`` reads with a mismatch among the up to nine bases on either side. Every
    ALT gives a row, with zeros where no read shows it; records whose alleles have equal
    lengths are no indels and give none. Reads and records join on position, kind and length.
    """
    alts = vcf.select(F.col(ident).alias("ident"), "chrom", "pos", "ref_allele", F.explode(F.split("alt", ",")).alias("alt"))
    diff = F.length("alt") - F.length("ref_allele")
    indels = alts.where((diff != 0) & ~F.col("alt").startswith("<")).withColumn("kind", F.when(diff > 0, "I").otherwise("D")).withColumn("n", F.abs(diff))
    # the bases up to the record's position and the nine behind the indel, each from a start that lies in one chunk
    back = F.least(F.col("pos") - 1, F.lit(15))
    moved = indels.select("ident", "chrom", "alt", "kind", "n", F.col("pos").alias("at"), (F.col("pos") - back).alias("pos"))
    left_side = slices(moved, chunks, {"ref_text": (F.lit(0), F.lit(16))}).withColumn("lead", (F.col("at") - F.col("pos")).cast("int"))
    behind = left_side.withColumn("pos", F.col("at") + F.when(F.col("kind") == "D", F.col("n")).otherwise(0))
    around = slices(behind, chunks, {"right_text": (F.lit(2), F.lit(9))}).select("ident", "chrom", "alt", "kind", "n", F.col("at").alias("pos"), "lead", "ref_text", "right_text")

    def add(acc: Column, o: Column) -> Column:
        both = o["op"].isin("M", "D")
        new = F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["g"].alias("g"), acc["r"].alias("r"))
        return F.struct((acc["g"] + F.when(both, o["len"]).otherwise(0)).alias("g"), (acc["r"] + F.when(both | o["op"].isin("I", "S"), o["len"]).otherwise(0)).alias("r"), F.concat(acc["ops"], F.array(new)).alias("ops"))

    empty = F.expr("cast(array() as array<struct<op: string, len: int, g: int, r: int>>)")
    ops = F.aggregate(cigar_ops(F.col("cigar")), F.struct(F.lit(0).alias("g"), F.lit(0).alias("r"), empty.alias("ops")), add, lambda acc: acc["ops"])
    placed = reads.select("chrom", "pos", "flag", clean_bases(F.col("seq")).alias("bases"), ops.alias("ops")).where("pos is not null and ops is not null")
    # a read shows an indel by its first operation of that kind and length, so reads and records meet by equality
    same = lambda x: F.array_position(F.transform("ops", lambda y: (y["op"] == x["kind"]) & (y["len"] == x["n"])), F.lit(True)) == x["k"]
    own = F.transform("ops", lambda o, i: F.struct((i + 1).alias("k"), o["op"].alias("kind"), o["len"].alias("n"), (F.col("pos") + o["g"] - 1).alias("pos")))
    shown = placed.select("chrom", F.struct("pos", "flag", "bases", "ops").alias("read"), F.inline(F.filter(own, lambda x: x["kind"].isin("I", "D") & (x["k"] > 1) & same(x))))
    hits = around.join(shown, ["chrom", "pos", "kind", "n"]).withColumn("hit", F.element_at(F.col("read.ops"), F.col("k")))
    o, bases = F.col("read.ops"), F.col("read.bases")
    ix = F.sequence(F.lit(1), F.size(o))
    first = lambda found: F.get(found, F.lit(0))
    before = first(F.filter(ix, lambda i: (i + 1 < F.col("k")) & F.element_at(o, i)["op"].isin("I", "D") & (F.element_at(o, i + 1)["op"] == "M")))
    after = first(F.filter(ix, lambda i: (i > F.col("k")) & (i < F.size(o)) & (F.element_at(o, i)["op"] == "M") & F.get(o, i)["op"].isin("I", "D")))
    left_gap, right_gap = F.element_at(o, before + 1)["len"], F.element_at(o, after)["len"]
    left, right = F.when(left_gap <= near, left_gap).otherwise(10), F.when(right_gap <= near, right_gap).otherwise(10)
    ref_at = lambda i: F.substring("ref_text", F.col("lead") + i + 1, F.lit(1))  # noqa: E731 (i counts from the record's position)
    read_at = lambda i: F.substring(bases, i + 1, F.lit(1))
    ro = F.col("hit.r")
    skip = F.when(F.col("kind") == "I", F.col("n")).otherwise(0)
    differs = lambda r, ref: (r >= 0) & (r < F.length(bases)) & (ref != "") & (ref != read_at(r))
    steps = F.sequence(F.lit(1), F.lit(9))
    wrong_left = F.exists(steps, lambda i: (i < left) & (F.col("lead") + 1 - i >= 0) & differs(ro - i, ref_at(1 - i)))
    wrong_right = F.exists(steps, lambda i: (i < right) & differs(ro + skip + i, F.substring("right_text", i, F.lit(1))))
    reverse = F.col("read.flag").bitwiseAND(16) != 0
    counts = hits.groupBy("ident", "alt").agg(
        F.count_if(~reverse).alias("pos_count"), F.count_if(reverse).alias("neg_count"),
        F.count_if(F.coalesce(wrong_left | wrong_right, F.lit(False))).alias("snp_mingle"),
        F.sum(F.coalesce((left_gap <= near).cast("int"), F.lit(0)) + F.coalesce((right_gap <= near).cast("int"), F.lit(0))).alias("indel_mingle"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pos_count", "neg_count", "snp_mingle", "indel_mingle")]
    return indels.select("ident", "alt").join(counts, ["ident", "alt"], "left").select("ident", "alt", *zero)
