"""Spellings of sequence names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.plans.tables import fresh


def spellings(seq_dict: DataFrame, prefix: bool = False) -> DataFrame:
    """One row per lower-case spelling (name and short name) of each sequence.

    With ``prefix``, ``chr`` taken off or put on is a spelling too, unless it is another
    sequence's own name.
    """
    both = F.array_distinct(F.array(F.lower(F.trim("chrom")), F.lower(F.trim("short_name"))))
    own = seq_dict.select(F.col("chrom").alias("seq_name"), F.explode(both).alias("spelling")).where("spelling is not null")
    if not prefix:
        return own
    other = F.when(F.col("spelling").startswith("chr"), F.substring("spelling", 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), F.col("spelling")))
    more = own.select("seq_name", other.alias("spelling")).join(own.select("spelling"), "spelling", "left_anti")
    return own.unionByName(more).groupBy("spelling").agg(F.min("seq_name").alias("seq_name"))


def with_sequence(df: DataFrame, seq_dict: DataFrame, chrom: str = "chrom", prefix: bool = False) -> DataFrame:
    """Adds ``seq_name``, the dictionary's name of the sequence spelled in ``chrom``.

    Case and outer blanks are set aside, and with ``prefix`` a ``chr`` that only one of
    the two has. Rows whose spelling is null or unknown are left out: they name no
    sequence. A column ``seq_name`` of ``df`` is replaced. The dictionary side carries no
    hint; its size on disk decides how Spark joins it.
    """
    key = fresh("_spelling", df)
    named = spellings(seq_dict, prefix).withColumnRenamed("spelling", key)
    return df.drop("seq_name").join(named, F.lower(F.trim(F.col(chrom))) == F.col(key)).drop(key)
