"""Numbers of a VCF record."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phred value of a zero probability, and the quality where there is no second genotype; fixed values.
PHRED_OF_ZERO = 3080
QUAL_MAX = 4.343 * math.log(sys.float_info.max)


def phred(p: Column) -> Column:
    """-10 log10 p cut to a whole number; 3080 for zero, null outside [0, 1.01]."""
    capped = F.least(p, F.lit(1.0))
    return F.when(p == 0, PHRED_OF_ZERO).when((p > 0) & (p <= 1.01), (-10 * F.log10(capped)).cast("int"))


def phred_ratio(x: Column) -> Column:
    """10 log10 x cut to a whole number; 0 for zero, null below."""
    return F.when(x == 0, 0).when(x > 0, (10 * F.log10(x)).cast("int"))


def qual(sub: Column, opt: Column, nom: Column, den: Column) -> Column:
    """Quality from the two best posteriors, lowered as the weight per read falls below full quality."""
    depth = F.try_divide(nom.cast("double"), den.cast("double"))
    lead = F.when(sub == 0, QUAL_MAX).otherwise(-4.343 * F.ln(F.try_divide(sub, opt)) * (1 - F.log2(5 - depth) / math.log2(5)))
    return F.when(depth < 5, lead)


def sor(ref_f: Column, ref_r: Column, alt_f: Column, alt_r: Column) -> Column:
    """Symmetric odds ratio of two alleles' strands, its natural logarithm."""
    a, b, c, d = (x.cast("double") + 1 for x in (ref_f, ref_r, alt_f, alt_r))
    ratio = a * d / (b * c)
    return F.ln((ratio + 1 / ratio) * (F.least(a, b) / F.greatest(a, b)) / (F.least(c, d) / F.greatest(c, d)))


def max_depth(mode: Column, multiplier: float = 5) -> Column:
    """Depth above which a record counts as too deep, from the most frequent depth."""
    return F.floor(mode + multiplier * F.sqrt(mode) + 0.51)
