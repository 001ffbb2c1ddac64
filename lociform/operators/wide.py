"""Entity, attribute, value rows into one typed row per entity (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: INFO keys of the calls and the types their columns take.
INFO_TYPES = {
    "DP": "int", "FRAC": "double", "QD": "double", "AC": "string", "AF": "string", "AN": "int", "BestGT": "string", "DP4": "string",
    "DP8": "string", "IndelMeta": "string", "INDEL": "string", "BQFisherPhredRef": "int", "BQFisherPhredAlt": "int",
    "BQFisherPhredAlt2": "int", "SBFisherPhredRef": "int", "SBFisherPhredAlt": "int", "SBFisherPhredAlt2": "int", "ReadPosBias": "double",
    "DepthBias": "double", "SOR": "double", "LeftGCPercent": "int", "RightGCPercent": "int", "LeftQuality": "int", "RightQuality": "int",
    "OptSuboptRatio": "int", "LeftG": "int", "RightG": "int", "HRun": "int", "IHDP": "int", "ILDP": "int",
}

_NUMBER = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """The number a text spells, else null.

    Outer blanks and quotes, a sign, leading zeros, an exponent, a comma for the decimal
    point and a percent sign (hundredths) are understood.
    """
    bare = F.regexp_replace(text, r"""^[\s"']+|[\s"']+$""", "")
    share = bare.endswith("%")
    digits = F.when(share, F.rtrim(F.regexp_replace(bare, r"\s*%$", ""))).otherwise(bare)
    value = F.when(digits.rlike(_NUMBER), F.regexp_replace(digits, ",", ".").try_cast("double"))
    return F.when(share, value / 100).otherwise(value)


def attribute_key(attr: Column, prefix: str = "info") -> Column:
    """Attribute names without case, outer blanks and a leading ``INFO/`` or ``INFO.``."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(attr, r"[\t\r\n]", " "))), f"^{prefix}\\s*[/.:]\\s*", ""))


def resolved_pairs(df: DataFrame, entity: str, attr: str, val: str, at: str, tie: str, types: dict[str, str]) -> DataFrame:
    """The pair that counts of each entity and known attribute: ``entity, attr, text, num, failed``.

    For a numeric attribute that is the latest value (``at``, then ``tie``) that is a
    number; ``failed`` is its latest value that is none. For a text attribute it is the
    latest value that is neither null nor blank. Values without a time come last in
    order, that is they count only if no other does.
    """
    known = F.create_map(*[x for k in types for x in (F.lit(k.lower()), F.lit(k))])
    numeric = F.col("_attr").isin([k for k, t in types.items() if t != "string"])
    rows = df.select(
        F.col(entity).alias("entity"), F.try_element_at(known, attribute_key(F.col(attr))).alias("_attr"),
        F.col(val).alias("_val"), F.col(at).alias("_at"), F.col(tie).alias("_tie"),
    ).where("_attr is not null and entity is not null")
    num = number(F.col("_val"))
    good = F.when(numeric, num.isNotNull()).otherwise(F.trim("_val") != "")
    order = F.struct("_at", "_tie")
    return (
        rows.select("*", num.alias("_num"), good.alias("_good"))
        .groupBy("entity", F.col("_attr").alias("attr"))
        .agg(
            F.max_by(F.struct(F.col("_val").alias("text"), F.col("_num").alias("num")), F.when(F.col("_good"), order)).alias("_best"),
            F.max_by("_val", F.when(~F.col("_good") & F.col("_val").isNotNull(), order)).alias("failed"),
        )
        .select("entity", "attr", "_best.text", "_best.num", "failed")
    )


def wide_table(df: DataFrame, entity: str, attr: str, val: str, at: str, tie: str, types: dict[str, str] | None = None) -> DataFrame:
    """One row per entity: a typed column per known attribute, and ``cast_failures``.

    Pairs are resolved per entity and attribute (aggregated before the shuffle, so a hot
    entity sends one row per attribute and task), then put into one map per entity, whose
    size the number of known attributes bounds, and projected into columns. A value that
    doesn't fit its column's type (an integer column takes whole numbers only) leaves
    the column null and stays as text in ``cast_failures`` (map of attribute to text), as
    does the latest failing value of a column that is filled from an earlier one. An
    entity without any known attribute has no row; see ``unknown_attributes`` for the
    rest. Rows without entity are left out; an empty table gives none.
    """
    types = types or INFO_TYPES
    pairs = resolved_pairs(df, entity, attr, val, at, tie, types)
    maps = pairs.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.struct("text", "num", "failed")))).alias("_m"))
    columns, failures = [], []
    for k, t in types.items():
        pair = F.try_element_at("_m", F.lit(k))
        if t == "string":
            value = pair["text"]
        elif t == "int":
            value = F.when(pair["num"] == F.floor(pair["num"]), pair["num"].try_cast("int"))
        else:
            value = pair["num"].cast(t)
        columns.append(value.alias(k))
        failures.append(F.struct(F.lit(k), F.coalesce(pair["failed"], F.when(value.isNull(), pair["text"]))))
    failed = F.map_from_entries(F.filter(F.array(*failures), lambda x: x["col2"].isNotNull()))
    return maps.select("entity", *columns, failed.alias("cast_failures"))


def unknown_attributes(df: DataFrame, entity: str, attr: str, val: str, types: dict[str, str] | None = None) -> DataFrame:
    """The rows whose attribute has no column in the wide table: ``entity, attr, val``."""
    names = [k.lower() for k in (types or INFO_TYPES)]
    key = attribute_key(F.col(attr))
    return df.where(key.isNull() | ~key.isin(names)).select(F.col(entity).alias("entity"), F.col(attr).alias("attr"), F.col(val).alias("val"))


def attribute_cells(wide: DataFrame, attrs: list[str]) -> DataFrame:
    """Filled numeric cells of a wide table as rows: ``entity, attr, val_milli``."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.round(F.col(a).cast("double") * 1000).cast("long").alias("val_milli")) for a in attrs])
    return wide.select("entity", F.explode(cells).alias("_c")).where("_c.val_milli is not null").select("entity", "_c.attr", "_c.val_milli")
