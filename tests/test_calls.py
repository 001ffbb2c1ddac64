import gzip
import struct
import zlib

from conftest import rows
from pyspark.sql import functions as F

from lociform.functions.codes import CallerConfig
from lociform.operators import candidates, pileup, reads, reference, vcf, vcf_filter
from lociform.sources import binary, sinks, text
from lociform.streaming.pileups import current_pileup, stream_pileup

READS = "qname string, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>"
REF = "ACGTTGCAACGGTCATTGCAACTGACCTGATTGCAGTCCATGACCTGTTAGC"


def ref_bases(spark):
    return spark.createDataFrame([("c", i, "ACGT".index(b)) for i, b in enumerate(REF, 1)], "chrom string, pos long, ref_code int")


def observed(spark, changes, depth=30):
    """Reads over the whole reference, as bases; changes: position -> (share, base)."""
    out = []
    for i, b in enumerate(REF, 1):
        for k in range(depth):
            base = changes[i][1] if i in changes and k < depth * changes[i][0] else b
            out.append(("c", i, "ACGT".index(base), 4, k % 2 == 0))
    return spark.createDataFrame(out, "chrom string, pos long, code int, weight int, forward boolean")


def test_calls_to_records(spark, tmp_path):
    piled = pileup.pileup(observed(spark, {10: (1.0, "T"), 20: (0.5, "G"), 30: (0.9, "C")})).cache()
    indels = spark.createDataFrame([("c", 26, "D", 2, None, 4)] * 25 + [("c", 41, "I", 1, "T", 4)] * 25, "chrom string, pos long, kind string, length int, seq string, weight int")
    top = pileup.top_indels(pileup.indel_pileup(indels))
    chunks = reference.chunks_of_bases(ref_bases(spark))
    found = candidates.candidates(piled, top, chunks)
    enriched = candidates.enriched(found, piled, reference.base_runs(ref_bases(spark))).cache()
    got = {r.pos: r for r in vcf.to_vcf(enriched, chunks).collect()}
    assert (got[10].ref_allele, got[10].alt, got[10].sample_call[:3]) == ("C", "T", "1/1")
    assert (got[20].ref_allele, got[20].alt, got[20].sample_call.split(":")[:3]) == ("A", "G", ["0/1", "15,15", "30"])
    assert "FRAC=0.500" in got[20].info and "SOR=" in got[20].info and "DP=30;DP4=15,0,15,0" in got[20].info
    assert (got[25].ref_allele, got[25].alt) == (REF[24:27], REF[24]) and got[25].info.startswith("INDEL;AC=")
    assert (got[40].ref_allele, got[40].alt) == (REF[39], REF[39] + "T") and "IndelMeta=1I,T,25,0" in got[40].info
    assert all(r.filter_tag == "." and r.qual > 0 for r in got.values())
    lines = candidates.tsv_rows(enriched).orderBy("pos").collect()
    assert all(len(x.line.split("\t")) == 98 for x in lines)
    sinks.write_candidates(enriched, str(tmp_path / "t"), one_file=True)
    back = text.read_candidates(spark, str(tmp_path / "t"))
    assert len(back.columns) == 98 and back.count() == len(lines) and back.where("Pos = 20").first().GT == "AG"
    records = vcf.to_vcf(enriched, chunks)
    sinks.write_vcf(records, str(tmp_path / "v"), "s1", vcf_filter.Thresholds(), one_file=True)
    assert rows(text.read_vcf(spark, str(tmp_path / "v")).select("pos", "alt", "info")) == rows(records.select("pos", "alt", "info"))
    assert text.read_vcf_header(spark, str(tmp_path / "v")).where("value like '##FILTER%'").count() == 8
    sinks.write_snapshot(piled, str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == piled.count()


def test_two_deletions_and_mixed_records(spark):
    piled = pileup.pileup(observed(spark, {30: (1.0, "C")}))
    data = [("c", 13, "D", 3, None, 4)] * 20 + [("c", 13, "D", 1, None, 4)] * 18 + [("c", 31, "I", 2, "GG", 4)] * 22
    top = pileup.top_indels(pileup.indel_pileup(spark.createDataFrame(data, "chrom string, pos long, kind string, length int, seq string, weight int")))
    chunks = reference.chunks_of_bases(ref_bases(spark))
    site = candidates.sites(piled, top, chunks).where("pos in (12, 30)")
    site = site.withColumn("gt", F.when(F.col("pos") == 12, "XY").otherwise("CX")).withColumn("is_indel", F.lit(True)).withColumn("skip", F.lit(0))
    site = site.withColumns({"best_p": F.lit(0.5), "second_p": F.lit(1e-9), "p_d": F.lit(1.0), "flh": F.array(*[F.lit(0.1)] * 16), "likelihood": F.array(*[F.lit(0.1)] * 16)})
    got = sorted((r.pos, r.ref_allele, r.alt, r.sample_call.split(":")[0]) for r in vcf.to_vcf(candidates.enriched(site, piled, reference.base_runs(ref_bases(spark))), chunks).collect())
    ref = REF[11:15]
    assert got[0] == (12, ref, f"{ref[0]},{ref[0]}{ref[1:].replace(ref[1], '', 1)}", "1/2")
    assert [g[1:] for g in got[1:]] == [("A", "AGG", "0/1"), ("A", "C", "0/1")] or [g[1:] for g in got[1:]] == [(REF[29], REF[29] + "GG", "0/1"), (REF[29], "C", "0/1")]


VCF = "rec_id long, run_id string, chrom string, pos long, id string, ref_allele string, alt string, qual double, info string"
OK = "DP=30;DP8=5,5,0,0,5,5,0,0;SBFisherPhredAlt=1;FRAC=0.5;QD=30;SOR=0.5"


def test_filter_tags_and_known(spark):
    data = [
        (1, OK, 50.0, "A", "G"), (2, OK, 5.0, "A", "G"), (3, OK.replace("DP=30", "DP=2"), 5.0, "A", "G"), (4, OK.replace("DP=30", "DP=90"), 50.0, "A", "G"),
        (5, OK.replace("SOR=0.5", "SOR=3.5"), 50.0, "A", "G"), (6, OK.replace(";SOR=0.5", "").replace("Alt=1", "Alt=31"), 50.0, "A", "G"),
        (7, OK.replace("FRAC=0.5", "FRAC=0.2"), 50.0, "A", "G"), (8, "INDEL;" + OK.replace("FRAC=0.5", "FRAC=0.2"), 50.0, "A", "AT"), (9, OK, 50.0, "A", "C"),
        (10, "INDEL;" + OK.replace("QD=30", "QD=19"), 50.0, "A", "AT"), (11, OK.replace("QD=30", "QD=23"), 5.0, "A", "T"), (12, None, None, "A", "G"), (13, OK, 5.0, "A", "C"),
    ]
    calls = spark.createDataFrame([(i, "r", "chr1", 100 + i, None, r, a, q, t) for i, t, q, r, a in data], VCF)
    known = spark.createDataFrame([(1, "CHR1", 102, "rs1", "A", "C,G"), (2, "chr1", 102, "rs2", "A", "G"), (3, "chr1", 103, None, "A", "G")], "snp_id long, chrom string, pos long, rsid string, ref_allele string, alt string")
    got = {r.ident: (r.id, r.filter_tag) for r in vcf_filter.filter_vcf(calls, known, "rec_id", "run_id").collect()}
    assert got[1] == (".", ".") and got[2] == ("rs2", ".") and got[3] == (".", "QUALlow;DPlow") and got[4] == (".", "DPhigh")
    assert got[5][1] == "SORhigh" and got[6][1] == "FShigh" and got[7][1] == "FRAClow" and got[8][1] == "." and got[9][1] == "SClow"
    assert got[10][1] == "QDlow" and got[11][1] == "QUALlow;QDlow;SClow" and got[12] == (".", ".") and got[13][1] == "QUALlow;SClow"
    assert vcf_filter.filter_vcf(calls.limit(0), known, "rec_id", "run_id").count() == 0


def test_mode_depth_ties(spark):
    df = spark.createDataFrame([("a", f"DP={d};") for d in [20] * 3 + [25] * 3 + [90]] + [("b", "IHDP=4;QD=1"), ("a", None)], "run_id string, info string")
    assert rows(vcf_filter.mode_depth(df, "run_id")) == [("a", 25)]


def test_indel_support(spark):
    start = 5
    own = REF[start - 1 :]
    reads_ = [
        ("a", 0, "c", start, 60, "20M2D20M", own[:20] + own[22:42], [30] * 40),  # clean, deletes 25 and 26
        ("b", 16, "c", start, 60, "20M2D20M", own[:19] + "?" + own[22:42], [30] * 40),  # mismatch beside it
        ("d", 0, "c", start, 60, "12M1I8M2D19M", own[:12] + "A" + own[12:20] + own[22:41], [30] * 40),  # another indel 8 bases before
        ("e", 0, "c", start, 60, "19M2D21M", own[:19] + own[21:42], [30] * 40),  # elsewhere
        ("f", 0, "c", start, 60, "40M", own[:40], [30] * 40),
    ]
    df = spark.createDataFrame(reads_, READS)
    calls = spark.createDataFrame([(1, "c", 24, REF[23:26], REF[23]), (2, "c", 24, "A", "C"), (3, "c", 40, "A", "AT,ATT")], "rec_id long, chrom string, pos long, ref_allele string, alt string")
    got = rows(vcf_filter.indel_support(calls, "rec_id", df, reference.chunks_of_bases(ref_bases(spark))))
    assert got == [(1, REF[23], 2, 1, 1, 1), (3, "AT", 0, 0, 0, 0), (3, "ATT", 0, 0, 0, 0)]


def test_indel_support_right_of_a_long_deletion(spark):
    seq = "ACGGTCATTGCA" * 500
    calls, reads_ = [], []
    for k, (pos, n) in enumerate([(100, 400), (3900, 400)]):  # the second one's right flank lies in the next chunk
        before, after = seq[pos - 20 : pos], seq[pos + n : pos + n + 20]
        calls.append((k, "c", pos, seq[pos - 1 : pos + n], seq[pos - 1]))
        reads_ += [(f"{k}{i}", 0, "c", pos - 19, 60, f"20M{n}D20M", before + b, [30] * 40) for i, b in enumerate([after, after[:4] + "?" + after[5:], after[:15] + "?" + after[16:]])]
    chunks = spark.createDataFrame([("c", 0, seq[: 4096 + 300]), ("c", 1, seq[4096:])], "chrom string, chunk long, seq string")
    df = spark.createDataFrame(calls, "rec_id long, chrom string, pos long, ref_allele string, alt string")
    got = rows(vcf_filter.indel_support(df, "rec_id", spark.createDataFrame(reads_, READS), chunks))
    assert [r[0:1] + r[2:] for r in got] == [(0, 3, 0, 1, 0), (1, 3, 0, 1, 0)]


def _bgzf(data):
    out = b""
    for part in [data[i : i + 100] for i in range(0, len(data), 100)] + [b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part))
    return out


def _record(name, flag, ref, pos, ops, seq, qual):
    packed = [("=ACMGRSVTWYHKDBN".index(c)) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 37, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + bytes(qual)
    return struct.pack("<i", len(body)) + body


def test_bam_and_sam_agree(spark, tmp_path):
    binary.register(spark)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 1000)
    recs = _record("r1", 16, 0, 5, [(3, "M"), (1, "I"), (1, "M")], "ACGTN", [30, 31, 32, 33, 34]) + _record("r2", 4, -1, 0, [], "AC", [255, 255]) + _record("r3", 0, 0, 9, [(4, "M")], "ACGT", [20] * 4)
    (tmp_path / "a.bam").write_bytes(_bgzf(head + recs))
    bam = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    assert rows(bam.where("qname = 'r1'")) == [("r1", 16, "c", 5, 37, "3M1I1M", "ACGTN", [30, 31, 32, 33, 34])]
    assert rows(bam.where("qname = 'r2'")) == [("r2", 4, None, None, 37, None, "AC", None)]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t16\tc\t5\t37\t3M1I1M\t*\t0\t0\tACGTN\t?@ABC\nr3\t0\tc\t9\t37\t4M\t*\t0\t0\tACGT\t5555\nr2\t4\t*\t0\t37\t*\t*\t0\t0\tAC\t*\n")
    assert rows(text.read_sam(spark, str(tmp_path / "a.sam"))) == rows(bam)
    assert text.read_sam(spark, *[str(tmp_path / "a.sam")] * 2).count() == 6


def test_bam_splits_by_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SPLIT", 1)
    head = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 1000)
    recs = [_record(f"r{i}", 0, 0, 5 + i, [(4, "M")], "ACGT", [20] * 4) for i in range(20)]
    data, at = head + b"".join(recs), len(head)
    raw = _bgzf(data)
    starts, p = [], 0
    while p < len(raw):
        starts.append(p)
        p += struct.unpack_from("<H", raw, p + 16)[0] + 1
    offsets = [starts[(at + sum(map(len, recs[:k]))) // 100] << 16 | (at + sum(map(len, recs[:k]))) % 100 for k in (0, 7, 13)]
    (tmp_path / "a.bam").write_bytes(raw)
    (tmp_path / "a.bam.bai").write_bytes(b"BAI\1" + struct.pack("<iii", 1, 0, len(offsets)) + struct.pack("<3Q", *offsets))
    reader = binary.BamReader(str(tmp_path / "a.bam"))
    names = [[n for b in reader.read(s) for n in b.column(0).to_pylist()] for s in reader.partitions()]
    assert sum(names, []) == [f"r{i}" for i in range(20)] and len(names) == 3


def test_fasta(spark, tmp_path):
    binary.register(spark)
    seq = ("acgtn" * 2000)[:9000]
    body = ">c one\n" + "\n".join(seq[i : i + 70] for i in range(0, len(seq), 70)) + "\n>d\nACGT\n"
    (tmp_path / "r.fa").write_text(body)
    plain = rows(spark.read.format("fasta").load(str(tmp_path / "r.fa")))
    assert [r[:2] for r in plain] == [("c", 0), ("c", 1), ("c", 2), ("d", 0)] and plain[0][2] == seq[: 4096 + 300].upper() and plain[3][2] == "ACGT"
    (tmp_path / "r.fa.fai").write_text(f"c\t9000\t7\t70\t71\nd\t4\t{body.index('ACGT')}\t4\t5\n")
    assert rows(spark.read.format("fasta").load(str(tmp_path / "r.fa"))) == plain


def test_small_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\nc\t0\t5\tname\nc 9 12\nc\tx\t3\n\n")
    (tmp_path / "a.gff").write_text("c\tsrc\texon\t1\t5\t.\n")
    assert rows(text.read_bed(spark, str(tmp_path / "a.bed"))) == [("c", 1, 6), ("c", 10, 13)]
    assert rows(text.read_gff(spark, str(tmp_path / "a.gff"))) == [("c", 1, 6)]
    (tmp_path / "a.ann").write_text("1000 2 11\n1 chr1 first one\n0 600 0\n2 chr2\n600 400 0\n")
    assert rows(text.read_annotation(spark, str(tmp_path / "a.ann"))) == [(1, "chr1", "first one", 0, 600), (2, "chr2", None, 600, 400)]
    (tmp_path / "r.bin").write_bytes(struct.pack("<5I", 2, 5, 9, 20, 4_000_000_000))
    assert sorted(map(tuple, text.read_region_table(spark, str(tmp_path / "r.bin")).collect())) == [(5, 9), (20, 4_000_000_000)]
    with gzip.open(tmp_path / "k.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\nc\t5\trs1\tA\tC,G\t.\t.\t.\nc\t5\t.\tA\tC\t.\t.\t.\n")
    assert rows(text.read_dbsnp(spark, str(tmp_path / "k.vcf.gz")).select("pos", "rsid", "alt")) == [(5, "rs1", "C,G"), (5, None, "C")]
    (tmp_path / "a.list").write_text(f"{tmp_path}/k.vcf.gz\n\n")
    assert text.read_vcf_list(spark, str(tmp_path / "a.list")).count() == 2


def test_streamed_pileup_equals_batch(spark, tmp_path):
    schema = "read_id long, flag int, chrom string, pos long, mapq int, cigar string, seq string, qual array<int>"
    df = spark.createDataFrame([(i, i % 2 * 16, "c", 5 + i, 60, "4M", "ACGT", [30] * 4) for i in range(6)], schema)
    free, path, out, marks = CallerConfig(trim=0), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    for half in (df.where("read_id < 3"), df.where("read_id >= 3")):
        half.write.mode("append").parquet(path)
        stream_pileup(spark, path, schema, out, marks, free).awaitTermination()
    want = pileup.pileup(reads.aligned_bases(df, free)).select("chrom", "pos", "w", "f", "r")
    assert rows(current_pileup(spark, out)) == rows(want)
