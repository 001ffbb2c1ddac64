"""Reads: which ones count, their bases and indels by position, and their quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.codes import CallerConfig, base_code, quality_weight

_OPS = "([0-9]+)([MIDNSHP=X])"
_READ_COLUMNS = ("read_id", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual")


def clean_bases(seq: Column) -> Column:
    """Upper-case bases without white space; ``*`` and blanks are null, ``.`` is an uncalled base."""
    bare = F.replace(F.upper(F.regexp_replace(seq, r"\s+", "")), F.lit("."), F.lit("N"))
    return F.when((bare != "") & (bare != "*"), bare)


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op) of a CIGAR text; null where the text isn't a CIGAR."""
    pairs = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(_OPS), 1).alias("n"), F.regexp_extract_all(cigar, F.lit(_OPS), 2).alias("op"))
    ops = F.transform(pairs, lambda p: F.struct(p["n"].cast("int").alias("len"), p["op"].alias("op")))
    return F.when(cigar.rlike(f"^({_OPS})+$"), ops)


def read_bases(cigar: Column) -> Column:
    """Bases of the read that a CIGAR accounts for by M, I and S."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "I", "S"), o["len"]).otherwise(0))


def usable_reads(reads: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Reads that enter the pileup, with ``bases`` (cleaned) and ``forward`` added.

    Left out: mapping quality below the threshold (a null one counts as 0), no sequence or
    position, duplicates (flag 1024), reads without bases, and reads whose M, I and S
    don't add up to their length (so those with = or X, too). Secondary and supplementary
    reads stay. Only the columns of a read are kept, whatever else the table holds.
    """
    rows = reads.select(*_READ_COLUMNS, clean_bases(F.col("seq")).alias("bases"))
    return rows.where(
        (F.coalesce("mapq", F.lit(0)) >= config.mapq_threshold)
        & F.col("chrom").isNotNull() & (F.col("pos") >= 1)
        & (F.coalesce("flag", F.lit(0)).bitwiseAND(1024) == 0)
        & F.col("bases").isNotNull()
        & (read_bases(F.col("cigar")) == F.length("bases"))
    ).withColumn("forward", F.coalesce("flag", F.lit(0)).bitwiseAND(16) == 0)


def _walk(config: CallerConfig) -> Column:
    """Operations with the read offset and position where each begins; deletions in a row are one."""
    moves = ("M", "D") if config.strict else ("M", "D", "N")

    def step(acc: Column, o: Column) -> Column:
        last = F.try_element_at(acc["ops"], F.lit(-1))
        again = F.coalesce((last["op"] == "D") & (o["op"] == "D"), F.lit(False))
        new = F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["r"].alias("r"), acc["g"].alias("g"))
        longer = F.struct(last["op"].alias("op"), (last["len"] + o["len"]).alias("len"), last["r"].alias("r"), last["g"].alias("g"))
        before = F.when(again, F.slice(acc["ops"], 1, F.size(acc["ops"]) - 1)).otherwise(acc["ops"])
        return F.struct(
            (acc["r"] + F.when(o["op"].isin("M", "I", "S"), o["len"]).otherwise(0)).alias("r"),
            (acc["g"] + F.when(o["op"].isin(*moves), o["len"]).otherwise(0)).alias("g"),
            F.concat(before, F.array(F.when(again, longer).otherwise(new))).alias("ops"),
        )

    empty = F.expr("cast(array() as array<struct<op: string, len: int, r: int, g: bigint>>)")
    start = F.struct(F.lit(0).alias("r"), F.col("pos").alias("g"), empty.alias("ops"))
    return F.aggregate(cigar_ops(F.col("cigar")), start, step, lambda acc: acc["ops"])


def walked(reads: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """One row per operation of each usable read: ``chrom, op, len, r, g, last_m, bases, qual, forward``.

    ``r`` is the read offset (from 0) and ``g`` the position where the operation begins;
    ``last_m`` is the offset where the read's last untrimmed M base lies, -1 if none.
    """
    ops = reads.select("read_id", "chrom", "bases", "qual", "forward", _walk(config).alias("ops"))
    end = F.length("bases") - config.trim
    reach = F.array_max(
        F.transform("ops", lambda o: F.when((o["op"] == "M") & (F.least(o["r"] + o["len"], end) > F.greatest(o["r"], F.lit(config.trim))), F.least(o["r"] + o["len"], end) - 1))
    )
    return ops.withColumn("last_m", F.coalesce(reach, F.lit(-1))).select("read_id", "chrom", "bases", "qual", "forward", "last_m", F.inline("ops"))


def aligned_bases(reads: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Bases of usable reads by position: ``chrom, pos, code, weight, forward``.

    The first and last ``trim`` bases of a read are left out, clipped and inserted bases
    counting as bases; trimming ends the read. All in SQL, one row per base.
    """
    ops = walked(usable_reads(reads, config), config).where("op = 'M'")
    low, high = F.greatest("r", F.lit(config.trim)), F.least(F.col("r") + F.col("len"), F.length("bases") - config.trim) - 1
    part = lambda c: F.slice(c, low + 1, high - low + 1)
    quals = F.coalesce("qual", F.expr("cast(array() as array<int>)"))
    pairs = F.arrays_zip(part(F.split("bases", "")).alias("base"), part(quals).alias("q"))
    # the arrays are cut once per operation, so that a base's row holds neither read nor qualities
    spans = ops.where(high >= low).select("chrom", (F.col("g") + low - F.col("r")).alias("first"), "forward", pairs.alias("pairs"))
    each = spans.select("chrom", "first", "forward", F.posexplode("pairs").alias("k", "x"))
    return each.select(
        "chrom", (F.col("first") + F.col("k")).alias("pos"), base_code(F.col("x.base")).alias("code"),
        quality_weight(F.col("x.q"), config).alias("weight"), "forward",
    )


def read_indels(reads: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Insertions and deletions of usable reads: ``chrom, pos, kind, length, seq, weight``.

    An insertion is keyed at the position after it and weighs the whole-number mean of its
    bases; a deletion is keyed at its first deleted base and weighs its next read base.
    Insertions reaching into the trimmed ends, deletions inside the trimmed head, indels of
    more than 255 bases and those without an untrimmed M base after them don't count.
    """
    ops = walked(usable_reads(reads, config), config).where("op in ('I', 'D') and len <= 255 and r <= last_m")
    ins = (F.col("op") == "I") & (F.col("r") >= config.trim) & (F.col("r") + F.col("len") < F.length("bases"))
    dele = (F.col("op") == "D") & (F.col("r") >= config.trim)
    weights = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda k: quality_weight(F.get("qual", F.col("r") + k), config))
    mean = F.floor(F.aggregate(weights, F.lit(0), lambda s, x: s + x) / F.col("len")).cast("int")
    return ops.where(ins | dele).select(
        "chrom", F.col("g").alias("pos"), F.col("op").alias("kind"), F.col("len").alias("length"),
        F.when(F.col("op") == "I", F.substring("bases", F.col("r") + 1, F.col("len"))).alias("seq"),
        F.when(F.col("op") == "I", mean).otherwise(quality_weight(F.get("qual", F.col("r")), config)).alias("weight"),
    )


def soft_clips(reads: DataFrame, config: CallerConfig = CallerConfig()) -> DataFrame:
    """Clip events of usable reads: ``chrom, pos, side``; a leading clip has side 1, a later one side 0."""
    ops = walked(usable_reads(reads, config), config).where((F.col("op") == "S") & (F.col("len") >= config.soft_clip_threshold))
    return ops.select("chrom", F.when(F.col("r") > 0, F.col("g") - 1).otherwise(F.col("g")).alias("pos"), F.when(F.col("r") > 0, 0).otherwise(1).alias("side"))


def alignment_qc(reads: DataFrame, regions: DataFrame | None = None, config: CallerConfig = CallerConfig()) -> DataFrame:
    """One row of counters over reads that are no duplicates: reads, unaligned and soft-clipped ones, lengths.

    ``target_aligned_length`` counts aligned bases in the regions (``chrom, start, end``,
    half-open, merged); null without regions.
    """
    from lociform.operators.intervals import points_in_regions

    rows = reads.select(*_READ_COLUMNS, clean_bases(F.col("seq")).alias("bases")).where(F.coalesce("flag", F.lit(0)).bitwiseAND(1024) == 0)
    total = lambda op: F.aggregate(F.filter(cigar_ops(F.col("cigar")), lambda o: o["op"] == op), F.lit(0), lambda s, o: s + o["len"])
    unplaced = F.col("chrom").isNull() | (F.coalesce("pos", F.lit(0)) < 1) | F.col("cigar").isNull() | (F.col("cigar") == "*")
    qc = rows.agg(
        F.count(F.lit(1)).alias("total_reads"),
        F.count_if(unplaced).alias("unaligned_reads"),
        F.count_if(F.coalesce(total("S"), F.lit(0)) > 0).alias("softclipped_reads"),
        F.coalesce(F.sum(F.length("bases")), F.lit(0)).alias("total_read_length"),
        F.coalesce(F.sum(F.when(~unplaced, total("M"))), F.lit(0)).alias("total_aligned_length"),
    )
    names = qc.columns
    if regions is None:
        return qc.withColumn("target_aligned_length", F.lit(None).cast("long"))
    untrimmed = CallerConfig(mapq_threshold=config.mapq_threshold, trim=0)
    hit = points_in_regions(aligned_bases(reads, untrimmed), regions).agg(F.count(F.lit(1)).alias("target_aligned_length"))
    both = qc.unionByName(hit, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in (*names, "target_aligned_length")])
