"""Helpers shared by the operators: shared scratch folders, written tables, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters; ``bytes.split()`` splits on exactly them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="groundline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/groundline-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Deletes all that this application wrote under the shared folder; frames that were not stored elsewhere can't be read after."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows with whole texts that go to a Python worker at a time.
TEXT_ROWS = 1000


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    ``arrow_rows`` bounds the rows of a batch that goes to Python while it is written.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, name), spark.conf.get(key)
    if arrow_rows:
        spark.conf.set(key, min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column is called so in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(df: DataFrame, each: int = 16 << 20, most: int = 100_000) -> int:
    """Partitions for a shuffle of what is made of ``df``: as many as the session has, or one for each ``each`` bytes of input."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 55 else 0  # Spark's figure where it has none is larger
    return max(1, session, min(most, -(-known // each)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(body, SPACE_PATTERN))).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that to texts without other letters and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def release() -> None:
    """Hands freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker holds from task to task, by its step's name.
_kept: dict[str, object] = {}


def kept(step: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, held until a task of another step runs in this worker."""
    if step not in _kept:
        _kept[step] = make()
    return _kept[step]


def forget(step: str) -> None:
    """Gives up what steps other than ``step`` kept."""
    for other in [x for x in _kept if x != step]:
        del _kept[other]
        release()


def in_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, step: str = "") -> DataFrame:
    """``mapInArrow`` whose tasks release what they freed, and what other steps kept: workers live on beside the steps that follow."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(step)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)
