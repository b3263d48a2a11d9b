"""Dense numbers in an order, without a window over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir, so that it is the same whenever it is read; a temporary folder where that is unset and all run on this machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="harvestry-"))
    return df.checkpoint()


def numbered(df: DataFrame, by: str, first: int = 1, name: str = "id") -> DataFrame:
    """df with name: first, first + 1, ... in order of by, which is unique.

    Rows are sorted by ranges and checkpointed, so that a range read again holds the same rows; a row's number is its
    place in its range and the rows of the ranges before. The driver sees one count a range.
    """
    at = settled(df.orderBy(by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, seen = [], first
    for p, n in sorted(tuple(r) for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((p, seen))
        seen += n
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    out = at.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")
