import pytest
from conftest import rows

from lociform.functions.codes import CallerConfig
from lociform.operators import pileup, reads

SCHEMA = "read_id long, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>"
FREE = CallerConfig(trim=0)


def table(spark, cigar, seq, flag=0, qual=30, **k):
    return spark.createDataFrame([(1, flag, "c", 101, k.get("mapq", 60), cigar, seq, k.get("quals", [qual] * len(seq)))], SCHEMA)


def bases(spark, cigar, seq, config=FREE, **k):
    names = "ACGT"
    return [f"{r.pos}{names[r.code]}" for r in reads.aligned_bases(table(spark, cigar, seq, **k), config).orderBy("pos").collect()]


def indels(spark, cigar, seq, config=FREE, **k):
    return sorted((r.kind, r.pos, r.length, r.seq) for r in reads.read_indels(table(spark, cigar, seq, **k), config).collect())


@pytest.mark.parametrize(
    "cigar, seq, want, want_indels",
    [
        ("4M", "ACGT", ["101A", "102C", "103G", "104T"], []),
        ("2M1I2M", "ACGTA", ["101A", "102C", "103T", "104A"], [("I", 103, 1, "G")]),
        ("2M2D2M", "ACGT", ["101A", "102C", "105G", "106T"], [("D", 103, 2, None)]),
        ("3M2I", "ACGTA", ["101A", "102C", "103G"], []),
        ("2M1I1D2M", "ACGTA", ["101A", "102C", "104T", "105A"], [("D", 103, 1, None), ("I", 103, 1, "G")]),
        ("2M1D1I2M", "ACGTA", ["101A", "102C", "104T", "105A"], [("D", 103, 1, None), ("I", 104, 1, "G")]),
        ("2M1D1D2M", "ACGT", ["101A", "102C", "105G", "106T"], [("D", 103, 2, None)]),
        ("4M", "ANGT", ["101A", "102G", "103G", "104T"], []),
        ("4=", "ACGT", [], []),
        ("2M3N2M", "ACGT", ["101A", "102C", "106G", "107T"], []),
        ("2H4M1H", "acgt", ["101A", "102C", "103G", "104T"], []),
    ],
)
def test_cigar_walk(spark, cigar, seq, want, want_indels):
    assert bases(spark, cigar, seq) == want
    assert indels(spark, cigar, seq) == want_indels


def test_strict_walk_ignores_skips(spark):
    assert bases(spark, "2M3N2M", "ACGT", CallerConfig(trim=0, strict=True)) == ["101A", "102C", "103G", "104T"]


def test_clips(spark):
    clip = lambda c, s: rows(reads.soft_clips(table(spark, c, s), FREE))
    assert clip("5S3M", "AAAAACGT") == [("c", 101, 1)]
    assert clip("3M5S", "ACGAAAAA") == [("c", 103, 0)]
    assert clip("4S4M", "AAAAACGT") == []
    assert bases(spark, "5S3M", "AAAAACGT") == ["101C", "102G", "103T"]
    assert rows(pileup.clip_counts(reads.soft_clips(table(spark, "5S3M5S", "A" * 13), FREE))) == [("c", 101, 0, 1), ("c", 103, 1, 0)]


def test_trim_counts_clipped_bases(spark):
    assert bases(spark, "8M", "ACGTACGT", CallerConfig(trim=2)) == ["103G", "104T", "105A", "106C"]
    assert bases(spark, "2S6M", "ACGTACGT", CallerConfig(trim=2)) == ["101G", "102T", "103A", "104C"]


def test_weights(spark):
    weights = lambda q: [r.weight for r in reads.aligned_bases(table(spark, f"{len(q)}M", "A" * len(q), quals=q), FREE).orderBy("pos").collect()]
    assert weights([10, 11, 13, 14, 17, 18, 20, 21, 60]) == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert weights([255, -1, None, 40]) == [0, 0, 0, 4]
    got = reads.aligned_bases(table(spark, "2M", "AC", quals=None), FREE).collect()
    assert [r.weight for r in got] == [0, 0]


@pytest.mark.parametrize("change", [dict(flag=1024), dict(seq=None), dict(seq="*"), dict(seq=""), dict(cigar=None), dict(cigar="*"), dict(cigar="3M"), dict(chrom=None), dict(pos=None), dict(pos=0)])
def test_reads_left_out(spark, change):
    row = dict(read_id=1, flag=0, chrom="c", pos=5, mapq=None, cigar="4M", seq="ACGT", qual=[30] * 4)
    data = lambda r: spark.createDataFrame([tuple(r.values())], SCHEMA).selectExpr("*", "1 as bases", "2 as forward")
    assert reads.usable_reads(data(row)).count() == 1
    assert reads.usable_reads(data(row | change)).count() == 0
    assert reads.usable_reads(data(row), CallerConfig(mapq_threshold=1)).count() == 0


def test_indel_quality_and_top_two(spark):
    data = [("I", 10, 1, "A", 4)] * 3 + [("I", 10, 1, "C", 1)] * 3 + [("D", 10, 2, None, 4)] * 2 + [("I", 10, 2, "GG", 0)]
    df = spark.createDataFrame([("c", p, k, n, s, w) for k, p, n, s, w in data], "chrom string, pos long, kind string, length int, seq string, weight int")
    top = pileup.top_indels(pileup.indel_pileup(df)).first()
    assert (top.pos, top.total_hq, top.total_lq) == (9, 5, 4)
    assert [(x.kind, x.seq, x.hq, x.lq) for x in top.indels] == [("I", "A", 3, 0), ("I", "C", 0, 3)]


def test_retract_and_saturation(spark):
    df = spark.createDataFrame([("c", 1, 0, 4, True), ("c", 1, 1, 2, False), ("c", 2, 3, 1, True)], "chrom string, pos long, code int, weight int, forward boolean")
    left = pileup.retract(df, df.where("pos = 2 or code = 1"))
    assert rows(left.select("pos", "w", "f", "r")) == [(1, [4, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0])]
    many = df.where("pos = 2").crossJoin(spark.range(65532).select())
    assert pileup.pileup(many).first().is_saturated and not pileup.pileup(df).where("is_saturated").count()
    assert rows(pileup.realign(df, df.where("pos = 2"), 2, 2).select("pos", pileup._total(pileup.F.col("f")))) == [(1, 1), (2, 2)]


def test_qc_with_regions(spark):
    regions = spark.createDataFrame([("c", 102, 104)], "chrom string, start long, end long")
    got = reads.alignment_qc(table(spark, "1S4M", "AACGT"), regions).first()
    assert (got.total_reads, got.softclipped_reads, got.total_read_length, got.total_aligned_length, got.target_aligned_length) == (1, 1, 5, 4, 2)
