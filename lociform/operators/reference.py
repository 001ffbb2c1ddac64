"""The reference sequence as chunks, and what positions ask of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociform.plans.tables import fresh, once

#: Bases of a chunk, and how far each reaches into the next, so that a pattern lies in one chunk.
CHUNK, OVERLAP = 4096, 300


def chunks_of_bases(bases: DataFrame) -> DataFrame:
    """Chunks ``chrom, chunk, seq`` from single bases ``chrom, pos, ref_code``; positions without one are N.

    A chunk holds the positions ``chunk * CHUNK + 1`` on, and the next chunk's first
    ``OVERLAP`` ones. Its size bounds what one group collects.
    """
    at = F.col("pos") - 1
    own = F.floor(at / CHUNK)
    homes = F.when((at % CHUNK < OVERLAP) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = bases.groupBy("chrom", "pos").agg(F.first("ref_code").alias("ref_code")).select("chrom", "pos", "ref_code", F.explode(homes).alias("chunk"))
    letter = F.element_at(F.array(*map(F.lit, "ACGT")), F.col("ref_code").cast("int") + 1)
    place = (F.col("pos") - F.col("chunk") * CHUNK).cast("int")
    some = once(rows.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), letter.alias("b")))).alias("m")))
    # each base behind the positions without one since the base before it
    gap = lambda x, i: x["k"] - F.coalesce(F.get("m", i - 1)["k"], F.lit(0)) - 1
    seq = F.array_join(F.transform("m", lambda x, i: F.concat(F.repeat(F.lit("N"), gap(x, i)), F.coalesce(x["b"], F.lit("N")))), "")
    return some.select("chrom", "chunk", seq.alias("seq"))


def slices(sites: DataFrame, chunks: DataFrame, wanted: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds reference texts to sites: name -> (offset from the site's position, length).

    Offsets may be negative only within the site's chunk. Sites off the reference get nulls.
    """
    c, k, text = (fresh(n, sites) for n in ("_c", "_k", "_seq"))
    ref = chunks.select(F.col("chrom").alias(c), F.col("chunk").alias(k), F.col("seq").alias(text))
    own = F.floor((F.col("pos") - 1) / CHUNK)
    joined = sites.join(ref, (F.col("chrom") == F.col(c)) & (own == F.col(k)), "left")
    at = (F.col("pos") - own * CHUNK).cast("int")
    texts = [F.when(at + o >= 1, F.nullif(F.substring(text, at + o, n), F.lit(""))).alias(name) for name, (o, n) in wanted.items()]
    return joined.select(*[F.col(x) for x in sites.columns], *texts)


def base_runs(bases: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """Runs of equal reference bases: ``chrom, start, end`` (half-open), ``ref_code``.

    Found within tiles; the runs that touch a tile's edge, two per tile at most, are then
    joined along the chromosome.
    """
    rows = bases.select("chrom", "pos", "ref_code").withColumn("_t", F.floor(F.col("pos") / tile))
    local = Window.partitionBy("chrom", "_t").orderBy("pos")
    same = (F.lag("pos").over(local) == F.col("pos") - 1) & (F.lag("ref_code").over(local) == F.col("ref_code"))
    numbered = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_k", F.sum("_new").over(local))
    runs = numbered.groupBy("chrom", "_t", "_k").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("ref_code").alias("ref_code"))
    runs = runs.withColumn("_edge", (F.col("start") % tile == 0) | (F.col("end") % tile == 0))
    along = Window.partitionBy("chrom").orderBy("start")
    goes_on = (F.lag("end").over(along) == F.col("start")) & (F.lag("ref_code").over(along) == F.col("ref_code"))
    edge = runs.where("_edge").withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(along))
    joined = edge.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("ref_code").alias("ref_code"))
    cols = ("chrom", "start", "end", "ref_code")
    return runs.where("not _edge").select(*cols).unionByName(joined.select(*cols))


def previous_base(bases: DataFrame) -> DataFrame:
    """Adds ``pre_code``, the reference base one position before; 4 where there is none."""
    before = bases.select("chrom", (F.col("pos") + 1).alias("pos"), F.col("ref_code").alias("pre_code"))
    return bases.join(before, ["chrom", "pos"], "left").withColumn("pre_code", F.coalesce("pre_code", F.lit(4)))
