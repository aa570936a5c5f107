"""Session helpers shared by every operator: sizing, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count that `small_side` lets through to a broadcast.
BROADCAST_ROWS = 50_000


def local_session(cores: int | str = "*", app: str = "laudario") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAUDARIO_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    `spark.checkpoint.dir` names it on a cluster and is used as it stands. Only where the session
    has none and runs on one machine is a temporary folder made.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="laudario-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so that lost executors cost no data."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Gives Python-heavy stages at least one partition a core; larger inputs keep their file splits."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting: beyond `rows` the side stays a shuffled one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds places from 1 in a total order without gathering the rows: sorted by ranges, counted by partition."""
    ids = cut(df.sort(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__id"), 33)
    counts = sorted((r["p"], r["n"]) for r in ids.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "p bigint, offset bigint")
    placed = ids.withColumn("p", part).join(F.broadcast(table), "p")  # one row a partition
    return placed.withColumn(name, F.col("offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("p", "offset", "__id")
