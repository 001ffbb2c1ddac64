"""Cutting oversized sequences into overlapping pieces at natural boundaries (problem 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = re.compile(r"[Nn.]{10,}")
#: Cost of a cut outside a gap, against at most 1 per piece for uneven sizes.
FORCED = 1e6


def candidates(seq: str, step: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of ``seq`` with their penalties.

    Free cuts: both edges and the middle of each gap, and steps within long gaps. Where
    called bases run on for more than ``step``, a grid of forced cuts is added.
    """
    free, forced, last, n = {0, len(seq)}, set(), 0, len(seq)
    for a, b in [m.span() for m in GAP.finditer(seq)] + [(n, n)]:
        if a - last > step:
            forced.update(range(last + grid, a, grid))
        free.update((a, (a + b) // 2, b))
        free.update(range(a, b, step // 2))
        last = b
    at = np.array(sorted(free | forced), dtype=np.int64)
    return at, np.where(np.isin(at, np.fromiter(free, np.int64)), 0.0, FORCED)


def plan_cuts(seq: str, limit: int, overlap: int, grid: int = 50) -> tuple[np.ndarray, bool]:
    """Ends of the pieces of ``seq`` and whether any cut had to leave the gaps.

    Dynamic programme over the boundary positions: best[j] is the least cost of cutting
    the first at[j] bases, each piece adding at most ``limit - overlap`` new bases. The
    cost of a piece is the penalty of its end plus the squared distance of its new bases
    from the even share.
    """
    step, n = limit - overlap, len(seq)
    at, penalty = candidates(seq, step, grid)
    even = n / -(-n // step)
    best, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    penalty[-1] = 0.0
    first = np.searchsorted(at, at - step)
    for j in range(1, len(at)):
        i = first[j]
        cost = best[i:j] + ((at[j] - at[i:j] - even) / step) ** 2
        k = int(np.argmin(cost))
        best[j], back[j] = cost[k] + penalty[j], i + k
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(at[j])
        j = back[j]
    return np.array(ends[::-1]), bool(best[-1] >= FORCED)


def split_oversized(df: DataFrame, ident: str, seq: str, limit: int = 2000, overlap: int = 200, grid: int = 50) -> DataFrame:
    """Pieces of the sequences of more than ``limit`` bases, white space not counted.

    Columns: ``ident, cut_kind, n_bases, piece_no, piece_start, piece``. Pieces have at
    most ``limit`` bases, consecutive ones share ``overlap`` bases, and ``piece_start``
    counts from 0. ``cut_kind`` is ``gap`` if every cut lies in a run of ten or more
    uncalled bases (edges included), ``forced`` otherwise; so that a cut can lie in each
    gap, a piece, the first one too, adds at most ``limit - overlap`` new bases.
    Sequences that are null, empty or within the limit give no row; repeated rows each
    give theirs. Only oversized rows reach Python, one sequence at a time, and no
    shuffle is needed.
    """
    if not 0 <= overlap < limit or grid > limit - overlap:
        raise ValueError("need 0 <= overlap < limit and grid <= limit - overlap")
    big = (
        df.select(F.col(ident).alias("ident"), F.col(seq).alias("raw"))
        .where(F.length("raw") > limit)
        .select("ident", F.regexp_replace("raw", r"\s+", "").alias("bases"))
        .where(F.length("bases") > limit)
    )

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for who, text in zip(part["ident"], part["bases"]):
                ends, forced = plan_cuts(text, limit, overlap, grid)
                starts = np.maximum(np.concatenate(([0], ends[:-1])) - overlap, 0)
                starts[0] = 0
                kind = "forced" if forced else "gap"
                rows += [(who, kind, len(text), k, int(a), text[a:b]) for k, (a, b) in enumerate(zip(starts, ends), 1)]
            yield pd.DataFrame(rows, columns=["ident", "cut_kind", "n_bases", "piece_no", "piece_start", "piece"])

    kind = df.select(ident).dtypes[0][1]
    return big.mapInPandas(cut, f"ident {kind}, cut_kind string, n_bases long, piece_no int, piece_start long, piece string")
