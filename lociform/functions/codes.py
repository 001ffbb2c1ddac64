"""Codes of bases and genotypes, priors, and the caller's settings."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: Alleles of a genotype: four bases, the best and the second indel.
ALLELES = (*BASES, "X", "Y")
#: Genotypes in the order of every likelihood array.
GENOTYPES = tuple(a + b for i, a in enumerate(BASES) for b in BASES[i:]) + ("AX", "CX", "GX", "TX", "XX", "XY")
PAIRS = tuple((ALLELES.index(g[0]), ALLELES.index(g[1])) for g in GENOTYPES)
#: Genotype number of pairs that are none of the sixteen.
UNKNOWN_GENOTYPE = 16

# fixed values: priors by number and kind of alleles that differ from the reference
SNP_HET, INDEL_HET, SNP_HOM, INDEL_HOM = 1e-3, 1e-4, 5e-4, 5e-5
#: Factor of each allele two codes away from the reference (transitions; and, as the codes fall, X on G and Y on T).
TRANSITION = 2.1


def genotype_prior(ref: int) -> list[float]:
    """Prior of each genotype where the reference base has the code ``ref``."""
    out = []
    for a, b in PAIRS:
        other = sorted(x for x in (a, b) if x != ref)
        indels = sum(x > 3 for x in other)
        if not other:
            p = 1.0
        elif len(other) == 1:
            p = INDEL_HET if indels else SNP_HET
        elif a == b:
            p = INDEL_HOM if indels else SNP_HOM
        else:
            p = {0: SNP_HOM * SNP_HET, 1: SNP_HOM * INDEL_HET, 2: INDEL_HOM * INDEL_HET}[indels]
        for x in other:
            p *= TRANSITION if abs(x - ref) == 2 else 1
        out.append(p)
    return out


def genotype_code(first: Column, second: Column) -> Column:
    """Number of the genotype of two allele codes in either order, 16 if there is none."""
    low, high = F.least(first, second), F.greatest(first, second)
    key = low * 6 + high
    known = F.create_map(*[x for i, (a, b) in enumerate(PAIRS) for x in (F.lit(min(a, b) * 6 + max(a, b)), F.lit(i))])
    return F.coalesce(F.try_element_at(known, key.cast("int")), F.lit(UNKNOWN_GENOTYPE))


@dataclass(frozen=True)
class CallerConfig:
    """Settings of pileup and caller; the defaults are the usual ones."""

    mapq_threshold: int = 0
    trim: int = 5
    soft_clip_threshold: int = 5
    weight_bounds: tuple[int, int, int, int] = (10, 13, 17, 20)
    indel_quality_threshold: int = 13
    balance_error: float = 0.01
    unbalance_error: float = 0.005
    strict: bool = False

    @property
    def indel_weight(self) -> int:
        """Weight above which an indel counts as of high quality."""
        q = self.indel_quality_threshold
        return 4 if q == 40 else sum(q >= b for b in self.weight_bounds[1:])


#: Keys of settings files and the settings they stand for.
INI_KEYS = {
    "statmapqthreshold": "mapq_threshold", "stattrimsize": "trim", "statsoftclipthreshold": "soft_clip_threshold",
    "indelqualitythreshold": "indel_quality_threshold", "balancesuberror": "balance_error", "unbalancesuberror": "unbalance_error",
}


def read_ini(path: str) -> CallerConfig:
    """Settings from an INI file; unknown keys are left aside, absent ones keep their defaults."""
    ini = configparser.ConfigParser(strict=False, inline_comment_prefixes=(";", "#"))
    with open(path) as lines:
        ini.read_string("[top]\n" + lines.read())
    flat = {k.lower().split(":")[-1]: v for s in ini.sections() for k, v in ini.items(s)}
    kinds = {f.name: f.type for f in fields(CallerConfig)}
    values = {name: (float if kinds[name] == "float" else int)(flat[key]) for key, name in INI_KEYS.items() if key in flat}
    bounds = tuple(int(flat.get(f"weight{i}", d)) for i, d in enumerate(CallerConfig.weight_bounds))
    return CallerConfig(**values, weight_bounds=bounds)


def quality_weight(quality: Column, config: CallerConfig = CallerConfig()) -> Column:
    """Weight 0 to 4 of a base by its quality; missing (255) and null qualities weigh 0."""
    q = F.when(quality.isNull() | (quality < 0) | (quality >= 128), 0).otherwise(F.least(quality, F.lit(40)))
    return sum(((q > b).cast("int") for b in config.weight_bounds), F.lit(0))


def base_code(base: Column) -> Column:
    """Code 0 to 3 of a base of a read: an uncalled base counts as G, other letters as A."""
    up = F.upper(base)
    return F.when(up == "C", 1).when(up.isin("G", "N"), 2).when(up == "T", 3).otherwise(0)
