"""Where tables come from and how a session is set up."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lociform", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on; on a cluster the submit settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in as many parts as tasks run at once, if it is in fewer.

    For small tables in one file whose rows are costly to work on or give many rows; a
    large table has more parts and comes back as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def at_most(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reading stops once they are passed."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Beyond the bound the frame comes back as it was, so that the join shuffles.
    """
    return F.broadcast(df) if at_most(df, max_rows) else df


def can_materialize(df: DataFrame) -> bool:
    """Whether there is a folder for ``materialized``; the session's is set up on the way.

    Where the session names none, one on a single machine (a test) takes a temporary folder,
    removed when it ends; a cluster has none, as its executors would each write to their own disk.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                return False
            folder = tempfile.mkdtemp(prefix="lociform-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return True


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that it isn't computed again.

    Without such a folder ``df`` comes back as it is and is computed wherever it is used.
    """
    return df.checkpoint() if can_materialize(df) else df


def once(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row, so that what it works out isn't worked out again by each use."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
