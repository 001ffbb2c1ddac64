import math

import pytest
from pyspark.sql import functions as F

from lociform.functions import codes, stats, vcf_math
from lociform.functions.genotype import agreement, called, genotype_likelihoods, likelihoods


@pytest.mark.parametrize(
    "w, best, p, second, q",
    [
        ([120, 0, 0, 0, 0, 0], "AA", 0.99999928, "AG", 3.776e-10),
        ([60, 0, 60, 0, 0, 0], "AG", 0.0021, "AA", 1.039e-14),
        ([0, 0, 120, 0, 0, 0], "GG", 0.0022049984, "AG", 3.776e-10),
        ([120, 0, 0, 0, 60, 0], "AX", 9.99999995e-5, "XX", 2.375e-13),
    ],
)
def test_golden_calls(spark, w, best, p, second, q):
    df = spark.createDataFrame([(w, 0)], "w array<int>, ref int").withColumn("l", genotype_likelihoods(F.col("w"), F.col("ref")))
    c = df.select(called(F.col("l"), F.col("ref")).alias("c")).first().c
    assert (codes.GENOTYPES[c.genotype], codes.GENOTYPES[c.second]) == (best, second)
    assert math.isclose(c.best_p, p, rel_tol=1e-6) and math.isclose(c.second_p, q, rel_tol=1e-3)


def test_empty_site_calls_the_reference(spark):
    assert likelihoods((0,) * 6, 2) == [1.0] * 16
    df = spark.createDataFrame([([0.0] * 16, 2)], "l array<double>, ref int").select(called(F.col("l"), F.col("ref")).alias("c")).first().c
    assert codes.GENOTYPES[df.genotype] == "GG" and df.best_p == 0


def test_priors():
    prior = {g: [codes.genotype_prior(r)[i] for r in range(4)] for i, g in enumerate(codes.GENOTYPES)}
    assert math.isclose(prior["GG"][0], 0.002205) and math.isclose(prior["TT"][1], 0.002205)
    assert math.isclose(prior["GX"][2], 2.1e-4) and math.isclose(prior["AX"][0], 1e-4)
    assert prior["AA"][0] == 1 and math.isclose(prior["CT"][0], 5e-7)


def test_large_counts_use_the_density():
    assert 0 < agreement(2500, 5000, 0.49, 2475) <= 1
    assert agreement(60, 60, 0.49, 0) < 0.02 < agreement(30, 60, 0.49, 0)


def test_exact_tests():
    left, right, two, below = stats.fisher_tails(3, 1, 1, 3)
    assert math.isclose(two, 0.4857142857, rel_tol=1e-9) and math.isclose(left, 69 / 70) and math.isclose(right, 17 / 70)
    assert math.isclose(below, 2 / 70 + 16 / 70)
    assert stats.fisher_tails(0, 0, 0, 0)[2] == 1
    assert math.isclose(stats.hwe_tail(57, 14, 50), 0.842279756, rel_tol=1e-6)


def test_scalars(spark):
    d = lambda x: F.lit(float(x))
    got = spark.range(1).select(
        vcf_math.phred(d(1)), vcf_math.phred(d(0.001)), vcf_math.phred(d(0)), vcf_math.phred(d(2)), vcf_math.qual(d(1e-3), d(1), d(20), d(5)),
        vcf_math.qual(d(1e-3), d(1), d(15), d(5)), vcf_math.sor(d(10), d(10), d(10), d(10)), vcf_math.max_depth(d(30)), vcf_math.phred_ratio(d(0)),
        codes.genotype_code(F.lit(5), F.lit(4)), codes.genotype_code(F.lit(5), F.lit(0)), stats.chi2_density(2, d(0)), stats.chi2_density(3, d(-1)),
    ).first()
    assert got[:4] == (0, 30, 3080, None)
    assert math.isclose(got[4], 30.00038, rel_tol=1e-6) and math.isclose(got[5], 17.07992, rel_tol=1e-6) and math.isclose(got[6], math.log(2))
    assert got[7:] == (57, 0, 15, 16, 0.5, 0.0)


def test_settings(tmp_path):
    ini = tmp_path / "a.ini"
    ini.write_text("[A]\nIni_x=1\nstatTrimSize=3\nWeight0=9\nBalanceSubError=0.02\nIndelQualityThreshold=40\n")
    c = codes.read_ini(str(ini))
    assert (c.trim, c.weight_bounds, c.balance_error, c.indel_weight, c.mapq_threshold) == (3, (9, 13, 17, 20), 0.02, 4, 0)
    assert codes.CallerConfig().indel_weight == 1
