"""Stage tables in the shared folder, and small helpers that every operator uses."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and all run on this machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("harvestry.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="harvestry-")
            spark.conf.set("harvestry.shared.dir", found)
            _made.append((spark, found))
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which is removed at exit."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each Arrow batch of the session: whole texts are long, and batches count in executors' memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as one part, dots and backticks in it too."""
    return "`" + name.replace("`", "``") + "`"


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of df in order, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


_kept: dict[str, object] = {}


def release(but: str | None = None) -> None:
    """Drop what a worker keeps from task to task, but for one name: workers serve other stages next and count in their executor's memory."""
    gone = [k for k in _kept if k != but]
    for k in gone:
        del _kept[k]
    if gone:
        give_back()


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: workers stay for the next one and count in their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
