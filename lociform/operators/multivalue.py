"""Fields that pack several values, one row per value (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of VCF files that hold delimiters themselves; fixed values.
SYMBOLIC = ("<DUP:TANDEM>", "<DEL:ME>", "<INS:ME>", "<DEL:ME|ALU>", "<INS:ME,L1>", "<CN0/CN2>", "<NON_REF>", "<*>", "<DEL>", "<INS>", "<DUP>", "<INV>", "<CNV>")
#: Characters between values; quotes are no part of a value.
_ATOM = re.compile(r"[^,;|/\s\"']+|[,;|/\s\"']+")
_BRACKETED = re.compile(r"<[^<>]*>|[^,;|/\s\"'<>]+|[<>]|[,;|/\s\"']+")
_SPLIT = frozenset(",;|/\"' \t\r\n\f\v")
#: Most values that are looked up in every task; beyond it the bracket rule alone protects delimiters.
MOST_KNOWN = 100_000
#: A run of a value costs this much; a known whole value costs less than any two runs.
_RUN, _KNOWN = 2, 3


def whole_values(df: DataFrame, *texts: Column, most: int = MOST_KNOWN) -> tuple[str, ...] | None:
    """The dictionary of values that hold delimiters themselves, taken from the data.

    These are the different texts in angle brackets that the fields hold, as far as a
    delimiter, blank or quote is among their characters; others need no protection. Spark
    reads all rows and keeps each value once. None if there are more than ``most``, which
    is found out before anything reaches the driver.
    """
    each = F.explode(F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(t, F.lit("(<[^<>]*>)"), 1), F.array().cast("array<string>")) for t in texts])))
    found = df.select(each.alias("value")).where(F.col("value").rlike(r"[,;|/\s\"']")).distinct().limit(most + 1).collect()
    return tuple(sorted(r.value for r in found)) if len(found) <= most else None


def segmenter(known: tuple[str, ...], brackets: bool = True):
    """A function that cuts a text into its values by a least-cost cover.

    A multi-pattern automaton finds the known whole values anywhere in the text. The cover
    goes over the text's atoms (runs without delimiter, runs of delimiters and, with
    ``brackets``, any text in angle brackets, known or not): a step takes one atom, or one known value over several atoms. Delimiters
    are free, an atom costs 2, a known value 3, so a known value wins wherever it spans
    two or more atoms, and of overlapping ones the cover that leaves least over. Atoms
    that touch, without delimiter between them, make one value.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for value in known:
        automaton.add_word(value, len(value))
    automaton.make_automaton()
    atom = _BRACKETED if brackets else _ATOM

    @lru_cache(maxsize=100_000)
    def cut(text: str) -> list[str]:
        spans = [m.span() for m in atom.finditer(text)]
        starts = {a: i for i, (a, _) in enumerate(spans)}
        ends = {b: i + 1 for i, (_, b) in enumerate(spans)}
        jumps: dict[int, list[int]] = {}
        for last, size in automaton.iter(text) if known else ():
            i, j = starts.get(last + 1 - size), ends.get(last + 1)
            if i is not None and j is not None and j > i + 1:
                jumps.setdefault(i, []).append(j)
        n = len(spans)
        if jumps:
            best, back = [0] + [1 << 30] * n, [0] * (n + 1)
            for i in range(n):
                step = best[i] + (0 if text[spans[i][0]] in _SPLIT else _RUN)
                if step < best[i + 1]:
                    best[i + 1], back[i + 1] = step, i
                for j in jumps.get(i, ()):
                    if best[i] + _KNOWN < best[j]:
                        best[j], back[j] = best[i] + _KNOWN, i
            path, j = [], n
            while j:
                path.append((back[j], j))
                j = back[j]
            pieces = [(spans[i][0], spans[j - 1][1], j - i) for i, j in reversed(path)]
        else:  # without a known value over several atoms there is one cover
            pieces = [(a, b, 1) for a, b in spans]
        items, touching = [], False
        for a, b, atoms in pieces:
            if atoms == 1 and text[a] in _SPLIT:
                touching = False
            else:
                if touching:
                    items[-1] += text[a:b]
                else:
                    items.append(text[a:b])
                touching = True
        return items

    return cut


def split_fields(df: DataFrame, ident: str, fields: dict[str, Column], known: tuple[str, ...] = SYMBOLIC, least: int = 2, brackets: bool = True) -> DataFrame:
    """One row per value of each packed field: ``ident, field_tag, item_no, item``.

    Values are parted by commas, semicolons, bars, slashes and blanks, also mixed; doubled
    and trailing delimiters add no value, quotes and outer blanks are no part of one, and
    delimiters inside one of the ``known`` whole values (``whole_values`` takes them from
    the data) or, with ``brackets``, inside any ``<...>`` belong to the value. ``item_no`` counts from 1. Fields of fewer than ``least`` values give no row,
    null and empty ones neither; repeated rows each give theirs. Only the ids and fields
    reach Python, in Arrow batches; there is no shuffle.
    """
    names = list(fields)
    kind = df.select(ident).dtypes[0][1]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = segmenter(known, brackets)
        for part in parts:
            made = {"ident": part["ident"]}
            for i, _ in enumerate(names):
                made[f"f{i}"] = [None if t is None else x if len(x := segment(t)) >= least else None for t in part[f"f{i}"]]
            yield pd.DataFrame(made)

    rows = df.select(F.col(ident).alias("ident"), *[c.alias(f"f{i}") for i, c in enumerate(fields.values())])
    some = F.coalesce(*[F.col(f"f{i}") for i in range(len(names))]).isNotNull()
    items = rows.where(some).mapInPandas(cut, f"ident {kind}, " + ", ".join(f"f{i} array<string>" for i in range(len(names))))
    each = F.array(*[F.struct(F.lit(n).alias("field_tag"), F.col(f"f{i}").alias("items")) for i, n in enumerate(names)])
    return (
        items.select("ident", F.inline(each))
        .where("items is not null")
        .select("ident", "field_tag", F.posexplode("items").alias("_p", "item"))
        .select("ident", "field_tag", (F.col("_p") + 1).cast("long").alias("item_no"), "item")
    )


def sample_field(format_keys: Column, sample_call: Column, key: str) -> Column:
    """The part of a sample column at the place its FORMAT column gives ``key``."""
    place = F.array_position(F.split(format_keys, ":"), key)
    return F.when(place > 0, F.get(F.split(sample_call, ":"), place.cast("int") - 1))


def info_entry(info: Column, key: str) -> Column:
    """The text of the INFO entry ``key``, up to the next entry, whatever parts entries.

    Entries are KEY=VALUE or the flag INDEL. Null where the entry is absent.
    """
    after = r"(?=[;|,/\s]+(?:[A-Za-z][A-Za-z0-9_.]*\s*=|INDEL(?:[;|,/\s]|\z))|[;|,/\s]*\z)"
    found = F.regexp_extract(info, rf"(?s)(?:^|[;|,/\s])({key}\s*=.*?){after}", 1)
    return F.when(found != "", F.regexp_replace(found, rf"^{key}\s*=\s*", ""))
