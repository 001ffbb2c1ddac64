"""Text formats: SAM, VCF, BED, GFF, candidate tables and sequence annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociform.operators.intervals import normalised


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """Reads of SAM files, several paths united: ``qname, flag, chrom, pos, mapq, cigar, seq, qual``.

    Header lines and lines of fewer than eleven fields are left out; ``*`` becomes null.
    """
    f = F.split("value", "\t")
    star = lambda c: F.nullif(c, F.lit("*"))
    text = star(f[10])
    qual = F.when(text.isNotNull(), F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33))
    rows = spark.read.text(list(paths)).where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    return rows.select(
        f[0].alias("qname"), f[1].try_cast("int").alias("flag"), star(f[2]).alias("chrom"), F.nullif(f[3].try_cast("long"), F.lit(0)).alias("pos"),
        f[4].try_cast("int").alias("mapq"), star(f[5]).alias("cigar"), star(f[9]).alias("seq"), F.filter(qual, lambda q: q >= 0).alias("qual"),
    )


_VCF = ("chrom", "pos", "id", "ref_allele", "alt", "qual", "filter_tag", "info", "format_keys", "sample_call")


def read_vcf(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of VCF files, gzipped or not, with the file each comes from (``file``).

    ``.`` stays in text columns and is null in ``qual``. Lines that may be broken belong to
    ``operators.reject``, which takes the lines as ``read_lines`` gives them.
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(list(paths)).where(~F.col("value").startswith("#") & (F.size(f) >= 8))
    kinds = {"pos": "long", "qual": "double"}
    cols = [F.get(f, F.lit(i)).try_cast(kinds[n]).alias(n) if n in kinds else F.get(f, F.lit(i)).alias(n) for i, n in enumerate(_VCF)]
    return rows.select(*cols, F.input_file_name().alias("file"))


def read_vcf_list(spark: SparkSession, path: str) -> DataFrame:
    """Records of all VCF files named in a list, one path per line; group by ``file`` what is per file."""
    names = [r[0].strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    return read_vcf(spark, *names)


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("#"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with a number that is unique over all files and increases within each."""
    return spark.read.text(list(paths)).select(F.monotonically_increasing_id().alias("line_id"), F.input_file_name().alias("file"), F.col("value").alias("line"))


def read_dbsnp(spark: SparkSession, *paths: str) -> DataFrame:
    """Known variants of a dbSNP VCF: ``snp_id`` (order of delivery), ``chrom, pos, rsid, ref_allele, alt``."""
    f = F.split("line", "\t")
    rows = read_lines(spark, *paths).where(~F.col("line").startswith("#") & (F.size(f) >= 5))
    return rows.select(F.col("line_id").alias("snp_id"), f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), F.nullif(f[2], F.lit(".")).alias("rsid"), f[3].alias("ref_allele"), f[4].alias("alt"))


def _regions(spark: SparkSession, paths: tuple[str, ...], first: int, kind: str) -> DataFrame:
    f = F.split("value", r"\s+")
    rows = spark.read.text(list(paths)).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(first)).try_cast("long").alias("start"), F.get(f, F.lit(first + 1)).try_cast("long").alias("end"))
    return normalised(cells.where("start is not null and end is not null"), kind)


def read_bed(spark: SparkSession, *paths: str) -> DataFrame:
    """Regions of BED files as 1-based half-open intervals; the rest of each line is left aside."""
    return _regions(spark, paths, 1, "bed")


def read_gff(spark: SparkSession, *paths: str) -> DataFrame:
    """Regions of GFF files as 1-based half-open intervals."""
    return _regions(spark, paths, 3, "gff")


def read_candidates(spark: SparkSession, *paths: str) -> DataFrame:
    """The table of 98 columns, gzipped or not; repeated header names get their place as suffix, ``*`` is null."""
    from lociform.operators.candidates import HEADER

    names = [n if HEADER.index(n) == i else f"{n}_{i}" for i, n in enumerate(HEADER)]
    texts = {i for i, n in enumerate(HEADER) if n in ("Chr", "Ref", "PreBase", "GT", "optIn/Del", "suboptIn/Del", "Patt")}
    # Spark tells column names apart by case alone only if asked to; the two that clash get a prefix
    seen: set[str] = set()
    unique = [n if n.lower() not in seen and not seen.add(n.lower()) else f"{n}_{i}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType() if i in texts else T.DoubleType()) for i, n in enumerate(unique)])
    # only the first part of a table begins with the header, so it is left out by what it says
    return spark.read.csv(list(paths), schema=schema, sep="\t", nullValue="*").where("coalesce(Chr, '') <> 'Chr'")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of an annotation file: ``chrom_idx, chrom, description, start, length``.

    The first line has totals; then two lines per sequence, an identifier with the name and
    a description, and start and length. One small file, so its lines are numbered whole.
    """
    text = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), "\r?\n").alias("l"))
    pairs = F.sequence(F.lit(1), F.floor((F.size("l") - 1) / 2).cast("int"))
    rows = text.where("size(l) >= 3").select(F.explode(F.transform(pairs, lambda k: F.struct(k.alias("k"), F.get("l", 2 * k - 1).alias("a"), F.get("l", 2 * k).alias("b")))).alias("x"))
    name, span = F.split("x.a", r"[ \t]+", 3), F.split(F.trim("x.b"), r"\s+")
    return rows.select(F.col("x.k").alias("chrom_idx"), F.get(name, F.lit(1)).alias("chrom"), F.get(name, F.lit(2)).alias("description"), span[0].cast("long").alias("start"), span[1].cast("long").alias("length"))


def read_region_table(spark: SparkSession, path: str) -> DataFrame:
    """Regions from a binary file: a count and pairs of 32-bit numbers, by linear position."""
    raw = spark.read.format("binaryFile").load(path).select(F.hex("content").alias("h"))
    byte = lambda i, k: F.substring(F.col("h"), i * 8 + 2 * k + 1, F.lit(2))
    word = lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    n = word(F.lit(0)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(word(2 * k + 1).alias("start"), word(2 * k + 2).alias("end")))
    return raw.where(n > 0).select(F.inline(each))
