import glob

from conftest import rows
from pyspark.sql import functions as F

from lociform.__main__ import main
from lociform.operators import pileup
from lociform.operators.sequences import with_sequence
from lociform.operators.vcf_filter import Thresholds
from lociform.sources import sinks, text

RECORD = "chrom string, pos long, id string, ref_allele string, alt string, qual double, filter_tag string, info string, format_keys string, sample_call string"


def lines_of(path):
    return [line for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part).read().splitlines()]


def records(spark, names):
    return spark.createDataFrame([(c, p, ".", "A", "C", 9.0, ".", "DP=3", "GT", "0/1") for c in names for p in (20, 3)], RECORD).repartition(7)


def test_header_first_and_genome_order(spark, tmp_path):
    names = ["chr10", "chr2", "chrX", "chr1", "chrM", "22"]
    sinks.write_vcf(records(spark, names), str(tmp_path / "a"), "s1")
    got = lines_of(tmp_path / "a")
    n = len(sinks.vcf_header("s1"))
    assert got[:n] == sinks.vcf_header("s1") and got[1].startswith("##FILTER=<ID=LowQual")
    assert [tuple(x.split("\t")[:2]) for x in got[n:]] == [(c, p) for c in ("chr1", "chr2", "chr10", "22", "chrM", "chrX") for p in ("3", "20")]
    order = spark.createDataFrame([("chrM", 1), ("chr10", 2), ("chr1", 3)], "chrom string, chrom_idx int")
    sinks.write_vcf(records(spark, names), str(tmp_path / "b"), seq_dict=order)
    assert [x.split("\t")[0] for x in lines_of(tmp_path / "b")[n:][::2]] == ["chrM", "chr10", "chr1", "chr2", "22", "chrX"]
    sinks.write_vcf(records(spark, names).limit(0), str(tmp_path / "c"))
    assert lines_of(tmp_path / "c") == sinks.vcf_header("sample")


def test_filtered_file_keeps_its_header(spark, tmp_path):
    header = ["##fileformat=VCFv4.2", "##own=1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tme"]
    body = [f"chr{c}\t{p}\t.\tA\tC\t5.0\t.\tDP=30;QD=9\tGT\t0/1" for c in (10, 9) for p in (5, 6)]
    (tmp_path / "in.vcf").write_text("\n".join(header + body) + "\n")
    (tmp_path / "known.vcf").write_text("#x\nchr9\t5\trs7\tA\tC\n")
    main(["filter", str(tmp_path / "in.vcf"), "--dbsnp", str(tmp_path / "known.vcf"), "--out", str(tmp_path / "out")], spark)
    got = lines_of(tmp_path / "out")
    assert got[:2] == header[:2] and got[2:10] == sinks.filter_lines(Thresholds()) and got[10] == header[2]
    assert [x.split("\t")[:3] + [x.split("\t")[6]] for x in got[11:]] == [["chr9", "5", "rs7", "."], ["chr9", "6", ".", "QUALlow;QDlow"], ["chr10", "5", ".", "QUALlow;QDlow"], ["chr10", "6", ".", "QUALlow;QDlow"]]


def test_command_line_from_reads_to_records(spark, tmp_path):
    ref = "ACGTTGCAACGGTCATTGCAACTGACCTGATTGCAGTCCATGACCTGTTAGC" * 3
    seq = ref[:59] + ("G" if ref[59] != "G" else "T") + ref[60:]
    (tmp_path / "r.fa").write_text(">c\n" + "\n".join(ref[i : i + 50] for i in range(0, len(ref), 50)) + "\n")
    (tmp_path / "a.sam").write_text("".join(f"r{i}\t{16 * (i % 2)}\tc\t1\t60\t{len(seq)}M\t*\t0\t0\t{seq}\t{'I' * len(seq)}\n" for i in range(30)))
    main(["call", str(tmp_path / "a.sam"), "--reference", str(tmp_path / "r.fa"), "--out", str(tmp_path / "o"), "--sample", "s"], spark)
    calls = text.read_vcf(spark, str(tmp_path / "o/vcf")).collect()
    assert [(r.chrom, r.pos, r.ref_allele, r.alt, r.sample_call[:3]) for r in calls] == [("c", 60, ref[59], seq[59], "1/1")]
    assert text.read_candidates(spark, str(tmp_path / "o/candidates")).count() == 1
    main(["pileup", str(tmp_path / "a.sam"), "--out", str(tmp_path / "p")], spark)
    assert sinks.read_snapshot(spark, str(tmp_path / "p/pileup")).count() == len(seq) - 10
    assert ["total_reads\t30"] == [x for x in lines_of(tmp_path / "p/qc") if x.startswith("total_reads")]
    main(["support", str(tmp_path / "o/vcf"), str(tmp_path / "a.sam"), "--reference", str(tmp_path / "r.fa"), "--out", str(tmp_path / "q")], spark)
    assert lines_of(tmp_path / "q") == []


def test_prefix_of_sequence_names(spark):
    names = spark.createDataFrame([("chr1", "1"), ("MT", None), ("chrMT", None), ("X", None)], "chrom string, short_name string")
    df = spark.createDataFrame([(t,) for t in ("CHR1", "1", "mt", "chrmt", "chrX", "x", "chr2", None)], "chrom string")
    got = {r.chrom: r.seq_name for r in with_sequence(df, names, prefix=True).collect()}
    assert got == {"CHR1": "chr1", "1": "chr1", "mt": "MT", "chrmt": "chrMT", "chrX": "X", "x": "X"}
    assert {r.chrom for r in with_sequence(df, names).collect()} == {"CHR1", "1", "mt", "chrmt", "x"}


def test_indels_taken_back_and_saturated(spark):
    schema = "chrom string, pos long, kind string, length int, seq string, weight int"
    a, b = ("c", 5, "I", 1, "G", 4), ("c", 5, "D", 2, None, 0)
    all_, gone = spark.createDataFrame([a] * 3 + [b] * 2, schema), spark.createDataFrame([a] + [b] * 2, schema)
    assert rows(pileup.retract_indels(all_, gone)) == [("c", 5, "I", 1, "G", 2, 0)]
    assert rows(pileup.realign_indels(all_, gone.withColumn("pos", F.lit(6)), 6, 6).groupBy("pos").agg(F.sum(F.col("hq") + F.col("lq")))) == [(5, 5), (6, 3)]
    piled = pileup.pileup(spark.createDataFrame([("c", p, 0, 4, True) for p in (5, 6)], "chrom string, pos long, code int, weight int, forward boolean"))
    counts = spark.createDataFrame([("c", 5, "D", 2, None, 0xFFFF, 0), ("c", 5, "D", 1, None, 0, 0xFFFF), ("c", 6, "D", 1, None, 0xFFFE, 9)], "chrom string, pos long, kind string, length int, seq string, hq long, lq long")
    assert rows(pileup.with_indel_saturation(piled, counts).select("pos", "is_saturated")) == [(5, True), (6, False)]
    clips = spark.createDataFrame([("c", 5, 2, 1)], "chrom string, pos long, left_count long, right_count long")
    assert rows(pileup.clips_at(piled.select("chrom", "pos"), clips).select("pos", "n_clips")) == [(5, 3), (6, 0)]
