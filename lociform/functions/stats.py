"""Exact tests and distances."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Possible tables worked out at once.
_AT_ONCE = 1 << 20


@lru_cache(maxsize=4)
def _table(size: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, size, dtype=float)))))


def ln_factorials(n: int) -> np.ndarray:
    """ln k! for k up to n at least; tables grow by doubling and stay with the worker."""
    return _table(1 << max(12, int(n + 1).bit_length()))


def tail_table(counts: np.ndarray) -> np.ndarray:
    """Left, right and two-tailed probability of 2 x 2 tables (rows a, b, c, d), and two-tailed without ties.

    Two-tailed adds the tables at most as likely as the observed one; without ties, those
    less likely. Negative counts lose their sign. Equal tables are worked out once; the
    tables that could have been observed instead stand in one flat array, in blocks.
    """
    whole = np.abs(counts.astype(np.int64)).reshape(-1, 4)
    if whole.max(initial=0) < 1 << 15:  # a table fits into one number, which sorts faster
        _, first, back = np.unique(whole @ (np.int64(1) << np.array([45, 30, 15, 0])), return_index=True, return_inverse=True)
        tables = whole[first]
    else:
        tables, back = np.unique(whole, axis=0, return_inverse=True)
    a, row, col, n = tables[:, 0], tables[:, 0] + tables[:, 1], tables[:, 0] + tables[:, 2], tables.sum(1)
    low = np.maximum(0, row + col - n)
    size = np.minimum(row, col) - low + 1
    f, out = ln_factorials(int(n.max(initial=0))), np.empty((len(tables), 4))
    block = np.cumsum(size) // _AT_ONCE
    for k in np.unique(block):
        at = np.flatnonzero(block == k)
        starts = np.cumsum(size[at]) - size[at]
        each = np.repeat(at, size[at])
        x = np.arange(len(each)) - np.repeat(starts - low[at], size[at])
        known = f[row] + f[n - row] + f[col] + f[n - col] - f[n]
        p = np.exp(known[each] - f[x] - f[row[each] - x] - f[col[each] - x] - f[(n - row - col)[each] + x])
        first = p[starts + a[at] - low[at]]
        own, other = np.repeat(first, size[at]), x != a[each]
        total = lambda keep: np.add.reduceat(np.where(keep, p, 0.0), starts)  # noqa: E731, B023
        out[at] = np.stack((total(x <= a[each]), total(x >= a[each]), total((p < own * (1 + 1e-9)) & other) + first, total((p < own * (1 - 1e-7)) & other) + first), axis=1)
    return out[back.ravel()]


def fisher_tails(a: int, b: int, c: int, d: int) -> tuple[float, float, float, float]:
    """``tail_table`` of one table."""
    return tuple(tail_table(np.array([[a, b, c, d]]))[0].tolist())


def _counts(*columns: pd.Series) -> np.ndarray:
    return np.stack([c.fillna(0).astype("int64").to_numpy() for c in columns], axis=1)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("left", "right", "two", "below")]))
def fisher_all(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """All tails of a 2 x 2 table; null counts are zero."""
    return pd.DataFrame(tail_table(_counts(a, b, c, d)), columns=["left", "right", "two", "below"])


@F.pandas_udf(T.DoubleType())
def _two_tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(tail_table(_counts(a, b, c, d))[:, 2])


@F.pandas_udf(T.DoubleType())
def _two_tail_below(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(tail_table(_counts(a, b, c, d))[:, 3])


def fisher_two_tail(a: Column, b: Column, c: Column, d: Column, ties: bool = True) -> Column:
    return (_two_tail if ties else _two_tail_below)(a, b, c, d)


def _by_allele(tables, *arrays: pd.Series) -> pd.Series:
    """The two tails without ties, at most 1, of the tables that flat counts make, as arrays like the first."""
    flat = [np.concatenate([np.empty(0, np.int64), *x.tolist()]).astype(np.int64) for x in arrays]
    tail = np.minimum(1.0, tail_table(np.stack(tables(*flat), axis=1))[:, 3])
    ends = np.cumsum(arrays[0].map(len).to_numpy(np.int64))
    return pd.Series(np.split(tail, ends[:-1]) if len(ends) else [], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def strand_bias(f: pd.Series, r: pd.Series) -> pd.Series:
    """Per allele: how far its strands depart from an even split, at most 1."""
    return _by_allele(lambda a, b: (a, b, (a + b) // 2, (a + b) // 2), f, r)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def base_quality_bias(w: pd.Series, f: pd.Series, r: pd.Series) -> pd.Series:
    """Per allele: how far its weight falls short of full quality, at most 1."""
    return _by_allele(lambda x, a, b: (x, 4 * (a + b), 4 * (a + b), 4 * (a + b)), w, f, r)


@F.pandas_udf(T.DoubleType())
def ln_binomial(n: pd.Series, k: pd.Series) -> pd.Series:
    """ln of n over k; null outside 0 <= k <= n."""
    known = n.notna() & k.notna() & (k >= 0) & (k <= n)
    a, b = n.where(known, 0).astype("int64").to_numpy(), k.where(known, 0).astype("int64").to_numpy()
    f = ln_factorials(int(a.max()) if len(a) else 0)
    return pd.Series(f[a] - f[b] - f[a - b]).where(known.reset_index(drop=True))


def hwe_tail(hets: int, hom1: int, hom2: int) -> float:
    """Exact probability of a genotype count at least as far from Hardy-Weinberg equilibrium."""
    n, rare = hets + hom1 + hom2, 2 * min(hom1, hom2) + hets
    if n == 0:
        return 1.0
    f = ln_factorials(2 * n)
    h = np.arange(rare % 2, rare + 1, 2)
    low = (rare - h) // 2
    ln = f[n] - f[h] - f[low] - f[n - h - low] + h * math.log(2)
    p = np.exp(ln - ln.max())
    return float(min(1.0, p[p <= p[h == hets] * (1 + 1e-12)].sum() / p.sum()))


@F.pandas_udf(T.DoubleType())
def hwe_exact(hets: pd.Series, hom1: pd.Series, hom2: pd.Series) -> pd.Series:
    return pd.Series([hwe_tail(*t) for t in _counts(hets, hom1, hom2).tolist()], dtype=float)


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square distance of a 2 x 2 table with continuity correction; cells expected empty are left out."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    total = F.lit(0.0)
    for cell, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = F.try_divide(row * col, n)
        total = total + F.when(e > 0, F.pow(F.abs(cell - e) - 0.5, F.lit(2)) / e).otherwise(0.0)
    return F.when(n > 0, total)


def chi2_density(dof: int, x: Column) -> Column:
    """Density of the chi-square distribution, at most 1; 0 below 0."""
    if dof < 1:
        return F.lit(0.0)
    k = dof / 2
    at_zero = 0.0 if dof > 2 else 1.0 if dof == 1 else 0.5
    value = 0.5**k / math.gamma(k) * F.pow(x, F.lit(k - 1)) * F.exp(-x / 2)
    return F.when(x < 0, 0.0).when(x == 0, at_zero).otherwise(F.least(value, F.lit(1.0)))
