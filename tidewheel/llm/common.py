"""What the operators of this subpackage share: tables, the shared folder, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    (tests on one machine), a new temporary folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidewheel-"))
        current = context.getCheckpointDir()
    return configured or current


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been materialised: its cleaner
    waits for the driver to collect its garbage, which a driver with little to do does late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD_PATTERN)).cast("long")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until it is none of columns (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(docs: DataFrame, text_col: str, keep: tuple[str, ...] | None, added: list[str]) -> tuple[DataFrame, tuple[str, ...], int]:
    """The columns keep of docs (default: all) whose names aren't among added, with the text.

    Returns the rows to read, the names of what stays, and the text's place among the columns; a
    text that doesn't stay is the last column.
    """
    lower = {c.lower() for c in added}
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() not in lower)
    columns = [F.col(quoted(c)) for c in keep]
    if text_col in keep:
        return docs.select(*columns), keep, keep.index(text_col)
    return docs.select(*columns, F.col(quoted(text_col)).alias(fresh(list(keep), "text"))), keep, len(keep)


def lean_batches(spark: SparkSession, most: int = 2_000) -> None:
    """Hand texts to Python in batches of at most so many rows, so that a worker's memory follows
    the texts and not the default of 10,000 rows. A smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


#: What this worker keeps between tasks: the operator that keeps it, and how to drop it.
_KEPT: dict = {}


def keep_between_tasks(owner: str, drop) -> None:
    _KEPT[owner] = drop


def make_room(owner: str) -> None:
    """Drop what other operators keep in this worker."""
    for name in [k for k in _KEPT if k != owner]:
        _KEPT.pop(name)()


def release() -> None:
    """Give back what Arrow holds in this worker and doesn't use."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
