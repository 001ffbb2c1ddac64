"""The sixteen-genotype model: likelihoods, posteriors and the call."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociform.functions.codes import GENOTYPES, PAIRS, CallerConfig, genotype_prior
from lociform.functions.stats import tail_table

#: Counts from here on are compared by a chi-square density instead of the exact test.
EXACT_BELOW = 2000
#: Share of the indel weight, and a half, taken off the reference base's weight.
INDEL_DIFFICULTY = 1.375
#: Products below this power of two count as zero; denormal ones as the least normal number.
LEAST_EXPONENT = -1500


def agreements(target: np.ndarray, total: np.ndarray, share: np.ndarray, error: np.ndarray) -> np.ndarray:
    """How well each ``target`` of ``total`` agrees with a share of the total.

    ``error`` is what large counts are compared with instead; it isn't used below
    ``EXACT_BELOW``.
    """
    out = np.empty(len(target))
    exact = (target < EXACT_BELOW) & (total < EXACT_BELOW)
    expected = (total.astype(np.float32) * share.astype(np.float32) + np.float32(0.5)).astype(np.int64)
    out[exact] = tail_table(np.stack((target, total, expected, total), axis=1)[exact])[:, 2]
    a, b, c = (v[~exact].astype(float) for v in (target, total, error))
    n, distance = a + b + c + b, np.zeros(len(a))
    for cell, row, col in ((a, a + b, a + c), (b, a + b, b + b), (c, c + b, a + c), (b, c + b, b + b)):
        e = row * col / np.maximum(n, 1)
        distance += np.where(e > 0, (np.abs(cell - e) - 0.5) ** 2 / np.where(e > 0, e, 1), 0.0)
    x = np.minimum((distance * 10 + 0.5).astype(np.int64), 14_999) / 10
    x1 = np.where(x == 0, 1, x)
    out[~exact] = np.where(x == 0, 1.0, np.minimum(1.0, np.exp(-x1 / 2) / np.sqrt(2 * np.pi * x1)))
    return out


def agreement(target: int, total: int, share: float, error: int) -> float:
    """``agreements`` of one count."""
    return float(agreements(*(np.array([v]) for v in (target, total, share, error)))[0])


def guarded(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Products over rows of powers, 0 below 2**-1500 and never denormal."""
    none = (values <= 0).any(1)
    ln = (np.log(np.where(values > 0, values, 1.0)) * powers).sum(1)
    none |= ln < LEAST_EXPONENT * math.log(2)
    return np.where(none, 0.0, np.clip(np.exp(np.where(none, 0.0, ln)), sys.float_info.min, 1.0))


def _error_shares(first: int, second: int, config: CallerConfig) -> float:
    """Share of bases that errors may bring to other alleles than these two."""
    s, i = config.balance_error / 4, config.unbalance_error / 2
    indels = (first > 3) + (second > 3)
    if first == second:
        return 4 * s + i if indels else 3 * s + 2 * i
    return (2 * s + 2 * i, 3 * s + i, 4 * s)[indels]


def likelihood_table(weights: np.ndarray, ref: np.ndarray, config: CallerConfig = CallerConfig()) -> np.ndarray:
    """Likelihood of each genotype from rows of weights of A, C, G, T, X, Y; equal pileups are worked out once."""
    each, back = np.unique(np.column_stack((weights, ref)).astype(np.int64), axis=0, return_inverse=True)
    w, own, at = each[:, :6].copy(), each[:, 6], np.arange(len(each))
    taken = np.trunc(w[at, own] - ((w[:, 4] + w[:, 5]) * INDEL_DIFFICULTY + 0.5)).astype(np.int64)
    w[at, own] = np.where(w[:, 4] + w[:, 5] != 0, np.maximum(0, taken), w[at, own])
    total = w.sum(1)
    part = lambda share: (total * share + 0.5).astype(np.int64)
    half, asked = part(0.5), []  # target, total, share, what large counts are compared with, genotype, power
    for g, (a, b) in enumerate(PAIRS):
        e = _error_shares(a, b, config)
        if a == b:
            asked += [(w[:, a], total, 1 - e, part(1 - e), g, 1.0), (np.maximum(0, total - w[:, a]), total, e, part(e), g, 1.0)]
        else:
            shares = [0.5 - (e if x < 4 or b < 4 else _error_shares(4, 5, config)) for x in (a, b)]
            asked += [(w[:, x], half, s, part(0.5 - e / 2), g, 0.5) for x, s in zip((a, b), shares)]
            asked.append((np.maximum(0, total - w[:, a] - w[:, b]), total, e, part(e / 2), g, 1.0))
    size = len(each)
    flat = [np.concatenate([q[i] for q in asked]) for i in (0, 1, 3)]
    found = agreements(flat[0], flat[1], np.repeat([q[2] for q in asked], size), flat[2]).reshape(len(asked), size).T
    of, powers = np.array([q[4] for q in asked]), np.array([q[5] for q in asked])
    return np.stack([guarded(found[:, of == g], powers[of == g]) for g in range(len(PAIRS))], axis=1)[back.ravel()]


def likelihoods(weights: tuple[int, ...], ref: int, config: CallerConfig = CallerConfig()) -> list[float]:
    """``likelihood_table`` of one site."""
    return likelihood_table(np.array([weights]), np.array([ref]), config)[0].tolist()


def genotype_likelihoods(w: Column, ref_code: Column, config: CallerConfig = CallerConfig()) -> Column:
    """Array of the sixteen likelihoods; equal pileups of a batch are worked out once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(weights: pd.Series, ref: pd.Series) -> pd.Series:
        table = likelihood_table(np.array(weights.tolist(), np.int64).reshape(-1, 6), ref.to_numpy(np.int64), config)
        return pd.Series(list(table), dtype=object)

    return run(w, ref_code)


def posteriors(likelihood: Column, ref_code: Column, total: Column | None = None) -> Column:
    """Likelihoods shared out over their sum (``total``, if it is known), times the prior; zeros where the sum is zero."""
    prior = F.array(*[F.array(*[F.lit(p) for p in genotype_prior(r)]) for r in range(4)])
    own = F.element_at(prior, ref_code.cast("int") + 1)
    total = likelihood_sum(likelihood) if total is None else total
    return F.zip_with(likelihood, own, lambda x, p: F.coalesce(F.try_divide(x, total), F.lit(0.0)) * p)


def ranked(flh: Column) -> Column:
    """Genotypes by falling posterior, ties by number: array of (p, its negative; g)."""
    return F.array_sort(F.transform(flh, lambda x, i: F.struct((-x).alias("p"), i.alias("g"))))


def best_two(order: Column, total: Column, ref_code: Column) -> Column:
    """Struct (genotype, second, best_p, second_p) of ``ranked`` genotypes and the sum of likelihoods.

    Where all likelihoods are zero it is the reference's own genotype with posteriors zero.
    """
    own = F.element_at(F.array(*[F.lit(GENOTYPES.index(b + b)) for b in "ACGT"]), ref_code.cast("int") + 1)
    none = total == 0
    return F.struct(
        F.when(none, own).otherwise(order[0]["g"]).cast("int").alias("genotype"),
        F.when(none, None).otherwise(order[1]["g"]).cast("int").alias("second"),
        F.when(none, 0.0).otherwise(-order[0]["p"]).alias("best_p"),
        F.when(none, 0.0).otherwise(-order[1]["p"]).alias("second_p"),
    )


def likelihood_sum(likelihood: Column) -> Column:
    return F.aggregate(likelihood, F.lit(0.0), lambda s, x: s + x)


def called(likelihood: Column, ref_code: Column) -> Column:
    """Struct of the call: genotype, best and second posterior, the sum of likelihoods and all posteriors.

    Ties go to the earlier genotype. Where all likelihoods are zero the call is the
    reference's own genotype with posteriors zero.
    """
    flh, total = posteriors(likelihood, ref_code), likelihood_sum(likelihood)
    best = best_two(ranked(flh), total, ref_code)
    return F.struct(*[best[n].alias(n) for n in ("genotype", "second", "best_p", "second_p")], total.alias("p_d"), flh.alias("flh"))
