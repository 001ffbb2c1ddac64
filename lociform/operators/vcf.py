"""Candidates as VCF records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.codes import ALLELES, GENOTYPES
from lociform.functions.vcf_math import phred, phred_ratio, qual, sor
from lociform.operators.candidates import scientific
from lociform.operators.reference import slices
from lociform.plans.tables import once

_PLACE = {name: i for i, g in enumerate(GENOTYPES) for name in (g, g[::-1])}


def _at(array: str, allele: Column) -> Column:
    """Value of an allele in an array over A, C, G, T, X, Y."""
    return F.get(F.col(array), (F.array_position(F.array(*map(F.lit, ALLELES)), allele) - 1).cast("int"))


def _phred_shares(pairs: Column) -> Column:
    """Phred-scaled posteriors over the best one; a pair that is no genotype counts as zero."""
    place = F.create_map(*[x for k, v in _PLACE.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(pairs, lambda p: phred(F.coalesce(F.get("share", F.try_element_at(place, p)), F.lit(0.0))).cast("string")), ",")


def _list(*numbers: Column) -> Column:
    return F.concat_ws(",", *[x.cast("string") for x in numbers])


def _plan(indel: bool, alts: list[Column], counted: list[Column], gt: str, ac: str, af: str, dp: Column, ref: Column, alt: Column, odds: list[Column] | None = None) -> Column:
    """What one record is made of: its alleles, those behind quality and depth ratio, and those of the odds ratio."""
    r, names = F.col("ref"), F.array(*alts)
    every = F.concat(F.array(r), names)
    pairs = [F.concat(F.get(every, F.lit(i)), F.get(every, F.lit(j))) for j in range(len(alts) + 1) for i in range(j + 1)]
    if len(alts) == 2:  # in the order of the alleles' first member
        pairs = [pairs[k] for k in (0, 1, 3, 2, 4, 5)]
    none = F.lit(None).cast("array<string>")
    return F.struct(
        F.lit(indel).alias("indel"), names.alias("alts"), F.array(*counted).alias("counted"), F.lit(gt).alias("gt_text"), F.lit(ac).alias("ac"), F.lit(af).alias("af"),
        dp.cast("long").alias("dp"), ref.alias("ref_allele"), alt.alias("alt"), (F.array(*odds) if odds else none).alias("odds"), F.array(*pairs).alias("pairs"),
    )


def _written(rows: DataFrame) -> DataFrame:
    """Quality, INFO and sample column of planned records."""
    total = lambda array: F.aggregate(F.transform("counted", lambda a: _at(array, a).cast("double")), F.lit(0.0), lambda s, v: s + v)
    r, first, second = F.col("ref"), F.get("alts", F.lit(0)), F.get("alts", F.lit(1))
    rows = once(rows.withColumns({"nom": total("depth"), "den": total("reads"), "het": F.col("gt_text") == "0/1", "both": F.array_contains("counted", r)}))
    qd = F.try_divide(F.col("nom") * 10, F.col("den"))
    share = F.try_divide(_at("reads", first).cast("double"), _at("reads", first) + _at("reads", r))
    whole = lambda c: c.cast("long").cast("string")
    five = lambda c: F.format_string("%.5f", c)
    bias = lambda key, name: [(f"{key}Ref", F.when(F.col("both"), whole(phred(_at(name, r))))), (f"{key}Alt", whole(phred(_at(name, first)))), (f"{key}Alt2", whole(phred(_at(name, second))))]
    shown = F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.when(F.col("is_indel"), F.try_element_at("indels", k)))
    meta = F.array_join(F.transform(shown, lambda x: F.coalesce(F.concat(x["length"].cast("string"), x["kind"], F.lit(","), x["seq"], F.lit(","), x["hq"].cast("string"), F.lit(","), x["lq"].cast("string")), F.lit("*,*,*,*"))), ",")
    a, b = F.get("odds", F.lit(0)), F.get("odds", F.lit(1))
    strands = F.transform(F.arrays_zip(F.slice("f", 1, 4).alias("p"), F.slice("r", 1, 4).alias("m")), lambda x: F.concat_ws(",", x["p"].cast("string"), x["m"].cast("string")))
    pairs = [
        ("AC", F.col("ac")), ("AF", F.col("af")), ("AN", F.lit("2")), ("FRAC", F.when(F.col("both") & F.col("het"), F.format_string("%.3f", share)).otherwise("1.000")),
        *bias("BQFisherPhred", "bq6"), ("BestGT", F.col("gt")), ("DP", whole(F.col("dp"))), ("DP4", F.array_join(F.transform(F.slice("reads", 1, 4), lambda x: x.cast("string")), ",")),
        ("DP8", F.array_join(strands, ",")), ("IndelMeta", meta), *bias("SBFisherPhred", "sb6"), ("QD", F.format_string("%.3f", qd)), ("ReadPosBias", five(F.col("read_pos_bias"))),
        ("DepthBias", five(F.col("depth_balance"))), ("SOR", F.when(F.col("odds").isNotNull(), five(sor(_at("f", a), _at("r", a), _at("f", b), _at("r", b))))),
        ("LeftGCPercent", whole(F.col("left_gc") * 100)), ("RightGCPercent", whole(F.col("right_gc") * 100)), ("LeftQuality", whole(F.col("left_quality") * 10)),
        ("RightQuality", whole(F.col("right_quality") * 10)), ("OptSuboptRatio", whole(phred_ratio(F.try_divide("opt", "sub")))), ("LeftG", whole(F.col("left_g"))),
        ("RightG", whole(F.col("right_g"))), ("HRun", whole(F.col("hrun"))), ("IHDP", whole(F.col("total_hq"))), ("ILDP", whole(F.col("total_lq"))),
    ]
    info = F.concat_ws(";", F.when(F.col("indel"), "INDEL"), *[F.concat(F.lit(k + "="), v) for k, v in pairs])
    ad = F.array_join(F.transform(F.concat(F.array(r), F.col("alts")), lambda x: _at("reads", x).cast("string")), ",")
    sample = F.concat_ws(":", "gt_text", ad, whole(F.col("dp")), whole(F.floor(qd + 0.499)), _phred_shares(F.col("pairs")))
    return rows.withColumns({"qual": qual(F.col("sub"), F.col("opt"), F.col("nom"), F.col("den")), "info": info, "format_keys": F.lit("GT:AD:DP:GQ:PL"), "sample_call": sample})


def _indel_texts() -> tuple[Column, Column]:
    x, r = F.col("indels")[0], F.col("ref")
    longer = F.concat(r, x["seq"])
    return F.when(x["kind"] == "D", longer).otherwise(r), F.when(x["kind"] == "D", r).otherwise(longer)


def _two_indel_texts() -> tuple[Column, Column]:
    """REF and ALT of two indels; two deletions of one length, or of which neither holds the other, have none."""
    x, y, r = F.try_element_at("indels", F.lit(1)), F.try_element_at("indels", F.lit(2)), F.col("ref")
    long = F.when(x["length"] >= y["length"], x["seq"]).otherwise(y["seq"])
    short = F.when(x["length"] >= y["length"], y["seq"]).otherwise(x["seq"])
    at = F.instr(long, short)
    rest = F.concat(F.substring(long, F.lit(1), at - 1), F.substring(long, at + F.length(short), F.length(long)))
    kinds = F.concat(x["kind"], y["kind"])
    ref = F.when(kinds == "DD", F.when((x["length"] != y["length"]) & (at > 0), F.concat(r, long))).when(kinds == "II", r).when(kinds == "ID", F.concat(r, y["seq"])).otherwise(F.concat(r, x["seq"]))
    pair = lambda a, b: F.concat(a, F.lit(","), b)
    alt = (
        F.when(kinds == "DD", pair(r, F.concat(r, rest))).when(kinds == "II", pair(F.concat(r, x["seq"]), F.concat(r, y["seq"])))
        .when(kinds == "ID", pair(r, F.concat(r, y["seq"], x["seq"]))).otherwise(pair(r, F.concat(r, x["seq"], y["seq"])))
    )
    return ref, alt


def to_vcf(enriched: DataFrame, chunks: DataFrame) -> DataFrame:
    """VCF records of enriched candidates.

    Columns: ``chrom, pos, id, ref_allele, alt, qual, filter_tag, info, format_keys,
    sample_call``. Posteriors are rounded as the table of candidates prints them; calls
    whose best or second posterior is then zero are left out, and so are records whose REF
    isn't what the reference holds there. A base and an indel against the reference give
    two records. All columns are SQL expressions; the only join is with reference chunks.
    """
    rounded = lambda c: F.when(c.isNotNull(), scientific(c).cast("double"))
    opt, sub = rounded(F.col("best_p")), rounded(F.col("second_p"))
    reads = F.concat(F.zip_with("f", "r", lambda a, b: a + b), F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.coalesce(F.try_element_at("indels", k)["hq"] + F.try_element_at("indels", k)["lq"], F.lit(0))))
    depth = F.concat("w", F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.coalesce(4 * F.try_element_at("indels", k)["hq"], F.lit(0))))
    near = lambda n: F.array_min(F.concat(F.col(n + "1"), F.col(n + "2"), F.array(F.lit(1.0))))
    six = lambda n: F.transform(F.concat(F.col(n), F.array(near(n), near(n))), rounded)
    biased = lambda n: F.when(F.col("is_indel"), six(n)).otherwise(F.transform(F.concat(F.col(n), F.array(F.lit(1.0), F.lit(1.0))), rounded))
    four = lambda c: F.format_string("%.4f", F.col(c)).cast("double").alias(c)
    metrics = ("read_pos_bias", "left_gc", "right_gc", "depth_balance", "left_quality", "right_quality")
    rows = enriched.select(
        "chrom", "pos", "ref", "gt", "is_indel", "indels", "f", "r", "total_hq", "total_lq", "hrun", "left_g", "right_g", *[four(m) for m in metrics],
        opt.alias("opt"), sub.alias("sub"), reads.alias("reads"), depth.alias("depth"), biased("sb").alias("sb6"), biased("bqb").alias("bq6"),
        F.transform("flh", lambda x: F.try_divide(rounded(x), opt)).alias("share"),
    )
    rows = once(rows).where("opt > 0 and sub > 0")
    r, first, second = F.col("ref"), F.substring("gt", 1, 1), F.substring("gt", 2, 1)
    rows = rows.withColumn("a", F.when(first == r, second).otherwise(first)).withColumn("b", second)
    a, b, x, y = F.col("a"), F.col("b"), F.lit("X"), F.lit("Y")
    base_dp = F.aggregate(F.slice("reads", 1, 4), F.lit(0).cast("long"), lambda s, v: s + v) + F.col("total_hq") + F.col("total_lq")
    own = _at("reads", r)
    one_ref, one_alt = _indel_texts()
    two_ref, two_alt = _two_indel_texts()
    het, hom, has_x = F.col("gt").contains(r) & (first != second), first == second, F.col("is_indel")
    mixed = has_x & ~het & ~hom & (F.col("gt") != "XY")
    half, halves = "0.5", "0.500,0.500"
    main = (
        F.when(~has_x & hom, _plan(False, [a], [a], "1/1", "2", "1", base_dp, r, a, [r, a]))
        .when(~has_x & het, _plan(False, [a], [r, a], "0/1", "1", half, base_dp, r, a, [r, a]))
        .when(~has_x, _plan(False, [a, b], [a, b], "1/2", "1,1", halves, base_dp, r, F.concat(a, F.lit(","), b), [a, b]))
        .when(hom, _plan(True, [x], [x], "1/1", "2", "1", base_dp - own, one_ref, one_alt))
        .when(het, _plan(True, [x], [r, x], "0/1", "1", half, base_dp - F.floor(own / 2), one_ref, one_alt))
        .when(F.col("gt") == "XY", _plan(True, [x, y], [x, y], "1/2", "1,1", halves, base_dp - own, two_ref, two_alt))
        .otherwise(_plan(True, [x], [x], "0/1", "1", half, base_dp - own, one_ref, one_alt))
    )
    also = F.when(mixed, _plan(False, [a], [a], "0/1", "1", half, base_dp - own, r, a))
    plans = F.filter(F.array(main, also), lambda v: v.isNotNull() & v["ref_allele"].isNotNull())
    out = _written(rows.select("*", F.inline(plans))).where("qual is not null")
    checked = slices(out, chunks, {"held": (F.lit(0), F.lit(256))}).where(F.substring(F.col("held"), F.lit(1), F.length("ref_allele")) == F.col("ref_allele"))
    return checked.select(
        "chrom", "pos", F.lit(".").alias("id"), "ref_allele", "alt", F.round("qual", 1).alias("qual"), F.lit(".").alias("filter_tag"), "info", "format_keys", "sample_call"
    )
