"""Records that fail to parse, apart from the valid ones (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.plans.tables import once

FIELDS = ["chrom", "pos", "id", "ref_allele", "alt", "qual", "filter_tag", "info", "format_keys", "sample_call"]
#: Types of the fields that aren't text; they are read as text, so that casts can be checked more strictly than the reader does.
TYPES = {"pos": "bigint", "qual": "double"}
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", _corrupt string"
_CSV = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "\u0000"}
_NUMBER = r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
#: Lines with more tabs outside quotes than this aren't given to the CSV reader, whose columns are bounded; they fail by count.
_MOST_TABS = 1000


def _entry(info: Column, key: str) -> Column:
    """The text of the first ``key=`` entry of an INFO field, null if there is none."""
    found = F.regexp_extract(info, f"(?:^|;)({key}=[^;]*)", 1)
    return F.when(found != "", F.substring(found, len(key) + 2, 1 << 30))


def parse_records(df: DataFrame, ident: str, line: str) -> DataFrame:
    """All records with their typed fields, the raw text of those that fail, and the reason.

    Columns: ``ident``, the ten fields (pos bigint, qual double), ``corrupt_text`` and
    ``reason``; the last two are null for valid records. Null, blank and ``#`` lines are
    no records, and one carriage return at the end is not part of a line. Each line is
    read once, permissively, under an explicit schema that keeps the corrupt text; what
    the reader flags, and whatever its leniency lets through, is classified by quoting,
    number of fields and cast checks of the fields read, in that order (``quoting,
    columns, pos, qual, info``). A position beyond the bigint
    range is valid by its digits but has a null ``pos``. One narrow pass, no shuffle.
    """
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    rows = df.select(F.col(ident).alias("ident"), text.alias("_line")).where(~F.col("_line").rlike(r"^\s*\z") & ~F.col("_line").startswith("#"))
    raw = F.col("_line")
    # quoted fields give way to a bare token; a quote that is left over is broken
    bare = F.when(raw.contains('"'), F.regexp_replace(raw, r'(^|\t)"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)', "$1q")).otherwise(raw)
    tabs = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\t"), F.lit("")))
    counted = once(rows.select("ident", "_line", bare.alias("_bare")).select("*", tabs(F.col("_bare")).alias("_tabs")))
    # the reader's columns are bounded: a line of far too many fields is corrupt without being read
    read = F.when(F.col("_tabs") <= _MOST_TABS, F.from_csv("_line", SCHEMA, _CSV | {"columnNameOfCorruptRecord": "_corrupt"}))
    parsed = once(counted.select("*", read.alias("_t")))
    # reclassification: of what the reader flagged, and of what its leniency let through
    frac, qd = _entry(F.col("_t.info"), "FRAC"), _entry(F.col("_t.info"), "QD")
    number = lambda c: F.coalesce(c.rlike(f"^{_NUMBER}\\z"), F.lit(False))
    info_ok = (
        F.coalesce(_entry(F.col("_t.info"), "DP").rlike(r"^[0-9]+\z"), F.lit(False))
        & number(frac) & number(qd) & F.coalesce(frac.try_cast("double") <= 1, F.lit(False))
    )
    pos_ok = F.coalesce(F.col("_t.pos").rlike(r"^0*[1-9][0-9]*\z"), F.lit(False))
    qual_ok = F.coalesce(F.col("_t.qual") == ".", F.lit(False)) | number(F.col("_t.qual"))
    reason = (
        F.when(F.col("_bare").contains('"'), "quoting").when(F.col("_tabs") != len(FIELDS) - 1, "columns")
        .when(~pos_ok, "pos").when(~qual_ok, "qual").when(~info_ok, "info")
    )
    checked = once(parsed.select("ident", "_line", "_t", reason.alias("reason")))
    valid = F.col("reason").isNull()
    value = lambda f: F.when(valid & (F.col(f"_t.{f}") != "."), F.col(f"_t.{f}"))
    return checked.select(
        "ident",
        *[(value(f).try_cast(TYPES[f]) if f in TYPES else value(f)).alias(f) for f in FIELDS],
        F.when(~valid, F.coalesce(F.col("_t._corrupt"), F.col("_line"))).alias("corrupt_text"),
        "reason",
    )


def valid_records(df: DataFrame, ident: str, line: str) -> DataFrame:
    return parse_records(df, ident, line).where("reason is null").drop("reason", "corrupt_text")


def rejected_records(df: DataFrame, ident: str, line: str) -> DataFrame:
    """``ident, reason, corrupt_text`` of the records that fail."""
    return parse_records(df, ident, line).where("reason is not null").select("ident", "reason", "corrupt_text")
