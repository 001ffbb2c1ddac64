"""Where results go: snapshots, regions, candidate tables, VCF and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.operators.candidates import HEADER, tsv_rows
from lociform.operators.vcf_filter import Thresholds

_TEXT, _INT, _FLOAT = "String", "Integer", "Float"
# fixed values: the header lines of the records written
FORMAT_LINES = (("GT", "1", _TEXT, "Genotype"), ("AD", ".", _INT, "Reads of the reference and each other allele"), ("DP", "1", _INT, "Read depth"), ("GQ", "1", _INT, "Genotype quality"), ("PL", "G", _INT, "Phred-scaled genotype likelihoods over the best"))
INFO_LINES = (
    ("AC", "A", _INT, "Allele count"), ("AF", "A", _FLOAT, "Allele frequency"), ("AN", "1", _INT, "Alleles in called genotypes"), ("FRAC", "1", _FLOAT, "Fraction of reads with the other allele"),
    ("BQFisherPhredRef", "1", _FLOAT, "Base quality bias of the reference allele"), ("BQFisherPhredAlt", "1", _FLOAT, "Base quality bias of the other allele"),
    ("BQFisherPhredAlt2", "1", _FLOAT, "Base quality bias of the second other allele"), ("BestGT", "1", _TEXT, "Best genotype"), ("DP", "1", _INT, "Total depth"),
    ("DP4", "4", _INT, "Reads of A,C,G,T"), ("DP8", "8", _INT, "Reads of A,C,G,T by strand"), ("INDEL", "0", "Flag", "Call with an indel"), ("IndelMeta", "8", _TEXT, "Best and second indel"),
    ("ILDP", "1", _INT, "Indel reads of low quality"), ("IHDP", "1", _INT, "Indel reads of high quality"), ("LeftG", "1", _INT, "G on the left"), ("RightG", "1", _INT, "G on the right"),
    ("HRun", "1", _INT, "Homopolymer run"), ("QD", "1", _FLOAT, "Quality by depth"), ("SBFisherPhredRef", "1", _FLOAT, "Strand bias of the reference allele"),
    ("SBFisherPhredAlt", "1", _FLOAT, "Strand bias of the other allele"), ("SBFisherPhredAlt2", "1", _FLOAT, "Strand bias of the second other allele"),
    ("ReadPosBias", "1", _FLOAT, "Change of depth, left against right"), ("DepthBias", "1", _FLOAT, "Depth, left against right"), ("SOR", "1", _FLOAT, "Symmetric odds ratio of strands"),
    ("LeftGCPercent", "1", _INT, "GC on the left"), ("RightGCPercent", "1", _INT, "GC on the right"), ("LeftQuality", "1", _INT, "Quality on the left"),
    ("RightQuality", "1", _INT, "Quality on the right"), ("OptSuboptRatio", "1", _FLOAT, "Best over second posterior"),
)


def filter_lines(t: Thresholds) -> list[str]:
    tags = {
        "QUALlow": f"QUAL<{t.min_qual}", "DPhigh": f"DP above the most frequent by {t.max_dp_multiplier} times its root", "DPlow": f"DP<{t.min_dp}", "SORhigh": f"SOR>{t.max_sor_snp} at SNPs",
        "FShigh": f"SBFisherPhredAlt>{t.max_fs_indel} at indels", "FRAClow": f"FRAC<{t.min_frac_snp} at SNPs or <{t.min_frac_indel} at indels",
        "SClow": f"strand count of an ALT<{t.min_strand_count} at SNPs", "QDlow": f"QD<{t.min_qd_snp} at SNPs or <{t.min_qd_indel} at indels",
    }
    return [f'##FILTER=<ID={k},Description="{v}">' for k, v in tags.items()]


def with_filter_lines(header: list[str], thresholds: Thresholds | None) -> list[str]:
    """Header lines as they are, with those of the filters before ``#CHROM``."""
    at = next((i for i, line in enumerate(header) if line.startswith("#CHROM")), len(header))
    return header[:at] + (filter_lines(thresholds) if thresholds else []) + header[at:]


def vcf_header(sample: str, thresholds: Thresholds | None = None) -> list[str]:
    """Header lines of a VCF file; with thresholds, those of its filters too."""
    line = lambda kind, i, n, t, d: f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">'
    out = ["##fileformat=VCFv4.1", *([] if thresholds else ['##FILTER=<ID=LowQual,Description="Low quality">']), *[line("FORMAT", *x) for x in FORMAT_LINES], *[line("INFO", *x) for x in INFO_LINES]]
    return with_filter_lines([*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])], thresholds)


def genome_order(chrom: Column) -> list[Column]:
    """Order of sequence names without a dictionary: numbered ones by number, then the others by name, ``chr`` aside."""
    name = F.regexp_replace(chrom, "^[cC][hH][rR]", "")
    return [F.when(name.rlike("^[0-9]{1,18}$"), name.try_cast("long")).asc_nulls_last(), name.asc(), chrom.asc()]


def _ordered_text(lines: DataFrame, header: list[str], rest: list[str], seq_dict: DataFrame | None, path: str, one_file: bool) -> None:
    """Header and lines in one order over all parts, so that the first part begins with the header.

    Lines have ``chrom, value`` and the columns ``rest``; sequences come in the order of the
    dictionary (``chrom, chrom_idx``) where there is one, unknown names behind it.
    """
    spark, keys = lines.sparkSession, [f"k{i}" for i in range(len(rest))]
    if seq_dict is not None:
        known = seq_dict.select(F.col("chrom").alias("_name"), F.col("chrom_idx").cast("long").alias("idx"))
        lines = lines.join(known, F.col("chrom") == F.col("_name"), "left")
    else:
        lines = lines.withColumn("idx", F.lit(0).cast("long"))
    body = lines.select(F.lit(1).alias("part"), F.lit(0).alias("no"), "idx", "chrom", *[F.col(c).alias(k) for c, k in zip(rest, keys)], "value")
    head = spark.createDataFrame(list(enumerate(header)), "no int, value string").withColumn("part", F.lit(0))
    order = [F.col("part"), F.col("no"), F.col("idx").asc_nulls_last(), *genome_order(F.col("chrom")), *map(F.col, keys)]
    both = body.unionByName(head, allowMissingColumns=True)
    both = both.coalesce(1).sortWithinPartitions(*order) if one_file else both.orderBy(*order)
    both.select("value").write.mode("overwrite").text(path)


def write_vcf(records: DataFrame, path: str, sample: str = "sample", thresholds: Thresholds | None = None, one_file: bool = False, seq_dict: DataFrame | None = None, header: list[str] | None = None) -> None:
    """Records as VCF text in order of sequence (``seq_dict``'s, else as genomes are numbered) and position; nulls become ``.``.

    ``header`` takes the place of the usual header lines, as those of the file that the
    records were read from do when they are filtered: with thresholds, the lines of the
    filters go before ``#CHROM``, the others stay. By default a folder of ordered part
    files, the header leading the first; a single file passes through one task and is
    meant for small results.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    fields = [text("chrom"), text("pos"), text("id"), text("ref_allele"), text("alt"), F.coalesce(F.format_string("%.1f", F.col("qual")), F.lit(".")), text("filter_tag"), text("info"), text("format_keys"), text("sample_call")]
    lines = records.select("chrom", "pos", "alt", F.concat_ws("\t", *fields).alias("value"))
    first = vcf_header(sample, thresholds) if header is None else with_filter_lines(header, thresholds)
    _ordered_text(lines, first, ["pos", "alt"], seq_dict, path, one_file)


def write_candidates(enriched: DataFrame, path: str, one_file: bool = False, seq_dict: DataFrame | None = None) -> None:
    """The table of 98 columns as text, in the order of ``write_vcf``."""
    lines = tsv_rows(enriched).withColumnRenamed("line", "value")
    _ordered_text(lines, ["\t".join(HEADER)], ["pos"], seq_dict, path, one_file)


def write_qc(qc: DataFrame, path: str) -> None:
    """The quality report, a line ``counter<tab>value`` for each counter."""
    each = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in qc.columns])
    qc.select(F.inline(each)).coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def write_snapshot(piled: DataFrame, path: str) -> None:
    """A pileup as parquet by sequence; only positions with reads are kept."""
    piled.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_snapshot(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_regions(regions: DataFrame, path: str) -> None:
    regions.orderBy("chrom", "start").write.mode("overwrite").parquet(path)


def write_indel_support(support: DataFrame, path: str) -> None:
    """Tab-separated ``chrom, pos, pos_count, neg_count, snp_mingle, indel_mingle``."""
    support.select("chrom", "pos", "pos_count", "neg_count", "snp_mingle", "indel_mingle").write.mode("overwrite").csv(path, sep="\t")
