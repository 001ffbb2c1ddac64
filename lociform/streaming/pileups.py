"""Pileups that grow as files of reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociform.functions.codes import CallerConfig
from lociform.operators.pileup import pileup
from lociform.operators.reads import aligned_bases


def stream_pileup(spark: SparkSession, reads_path: str, schema: str, out_path: str, checkpoint: str, config: CallerConfig = CallerConfig()) -> StreamingQuery:
    """Follows a folder of read files (parquet) and adds each batch's partial pileup to ``out_path``.

    Every batch is written as its own folder, so a batch that runs again after a failure
    replaces what it wrote. ``current_pileup`` adds the parts up.
    """

    def add(batch: DataFrame, number: int) -> None:
        pileup(aligned_bases(batch, config)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    reads = spark.readStream.schema(schema).parquet(reads_path)
    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pileup(spark: SparkSession, out_path: str) -> DataFrame:
    """The sum of all batches' pileups, by position."""
    parts = spark.read.parquet(out_path)
    total = [F.sum(F.col(x)[k]).alias(f"{x}{k}") for x in "wfr" for k in range(4)]
    arrays = [F.array(*[F.col(f"{x}{k}") for k in range(4)]).alias(x) for x in "wfr"]
    return parts.groupBy("chrom", "pos").agg(*total).select("chrom", "pos", *arrays)
