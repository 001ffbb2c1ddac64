"""Command line: ``python -m lociform pileup | call | filter | support ...``; run it by spark-submit on a cluster."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.functions.codes import BASES, CallerConfig, read_ini
from lociform.operators import candidates, pileup, reads, reference, vcf, vcf_filter
from lociform.plans.tables import materialized, session
from lociform.sources import binary, sinks, text


def read_alignments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of SAM or BAM files, numbered."""
    if paths[0].endswith(".bam"):
        binary.register(spark)
        rows = reduce(DataFrame.unionByName, [spark.read.format("bam").load(p) for p in paths])
    else:
        rows = text.read_sam(spark, *paths)
    return rows.withColumn("read_id", F.monotonically_increasing_id())


def bases_of_chunks(chunks: DataFrame) -> DataFrame:
    """Single called bases of reference chunks: ``chrom, pos, ref_code``."""
    each = chunks.select("chrom", "chunk", F.posexplode(F.split(F.left("seq", F.lit(reference.CHUNK)), "")).alias("k", "base"))
    code = F.array_position(F.array(*map(F.lit, BASES)), F.upper("base")).cast("int") - 1
    return each.select("chrom", (F.col("chunk") * reference.CHUNK + F.col("k") + 1).alias("pos"), code.alias("ref_code")).where("ref_code >= 0")


def _pileup(aligned: DataFrame, config: CallerConfig) -> tuple[DataFrame, DataFrame]:
    counts = pileup.indel_pileup(reads.read_indels(aligned, config), config)
    return pileup.with_indel_saturation(pileup.pileup(reads.aligned_bases(aligned, config)), counts), counts


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    config = read_ini(args.ini) if getattr(args, "ini", None) else CallerConfig()
    if args.command == "pileup":
        aligned = read_alignments(spark, args.reads)
        piled, counts = _pileup(aligned, config)
        sinks.write_snapshot(piled, f"{args.out}/pileup")
        counts.write.mode("overwrite").parquet(f"{args.out}/indels")
        pileup.clip_counts(reads.soft_clips(aligned, config)).write.mode("overwrite").parquet(f"{args.out}/clips")
        regions = text.read_bed(spark, args.regions) if args.regions else None
        sinks.write_qc(reads.alignment_qc(aligned, regions, config), f"{args.out}/qc")
    elif args.command == "call":
        binary.register(spark)
        piled, counts = map(materialized, _pileup(read_alignments(spark, args.reads), config))
        chunks = materialized(spark.read.format("fasta").load(args.reference).select("chrom", "chunk", "seq"))
        found = candidates.candidates(piled, pileup.top_indels(counts), chunks, config)
        rows = materialized(candidates.enriched(found, piled, reference.base_runs(bases_of_chunks(chunks)), config.strict))
        sinks.write_candidates(rows, f"{args.out}/candidates")
        sinks.write_vcf(vcf.to_vcf(rows, chunks), f"{args.out}/vcf", args.sample)
    elif args.command == "filter":
        calls = text.read_vcf(spark, args.vcf).withColumn("rec", F.monotonically_increasing_id())
        calls = materialized(calls)
        tags = vcf_filter.filter_vcf(calls, text.read_dbsnp(spark, args.dbsnp), "rec", "file").withColumnRenamed("ident", "rec")
        header = [r.value for r in text.read_vcf_header(spark, args.vcf).limit(100_000).collect()]
        sinks.write_vcf(calls.drop("id", "filter_tag").join(tags, "rec"), args.out, thresholds=vcf_filter.Thresholds(), header=header)
    else:
        binary.register(spark)
        calls = text.read_vcf(spark, args.vcf).withColumn("rec", F.monotonically_increasing_id())
        calls = materialized(calls)
        support = vcf_filter.indel_support(calls, "rec", read_alignments(spark, args.reads), spark.read.format("fasta").load(args.reference).select("chrom", "chunk", "seq"))
        sinks.write_indel_support(support.join(calls.select(F.col("rec").alias("ident"), "chrom", "pos"), "ident"), args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lociform")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("pileup", help="counters, indels, clips and a quality report of reads")
    p.add_argument("reads", nargs="+")
    p.add_argument("--regions")
    c = commands.add_parser("call", help="candidates and VCF records of reads against a FASTA reference")
    c.add_argument("reads", nargs="+")
    c.add_argument("--reference", required=True)
    c.add_argument("--sample", default="sample")
    f = commands.add_parser("filter", help="filter tags and known identifiers for a VCF file")
    f.add_argument("vcf")
    f.add_argument("--dbsnp", required=True)
    s = commands.add_parser("support", help="reads that show each indel record")
    s.add_argument("vcf")
    s.add_argument("reads", nargs="+")
    s.add_argument("--reference", required=True)
    for x in (p, c):
        x.add_argument("--ini")
    for x in (p, c, f, s):
        x.add_argument("--out", required=True)
    run(parser.parse_args(argv), spark or session())


if __name__ == "__main__":
    main()
