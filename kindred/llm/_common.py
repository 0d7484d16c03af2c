"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.shipping import ship

#: The six ASCII white-space characters: tab, line feed, vertical tab, form feed, carriage return, space.
ASCII_SPACE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset (local tests), a temporary folder of our own."""
    sc = spark.sparkContext
    if configured := sc.getConf().get("spark.checkpoint.dir"):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-checkpoint-"))
    return os.fspath(sc.getCheckpointDir())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the shared tables, as (file system, path), that are still there.
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: like ``cut_lineage``, but compressed and with columns that can be left out.

    The folder goes when the driver's process ends, or with ``discard`` where it is known that nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kindred-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(folder)
    _folders[table] = files, folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of shared tables; every frame made from them must have been written before. Other frames stay."""
    for table in tables:
        files, folder = _folders.pop(table, (None, None))
        if files is not None:
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)


def plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is files read again at each use, with nothing but columns chosen and rows filtered: then a row has the same place each time."""
    kinds = [line.strip(" +-:*").split(" ")[0].split("(")[0].rstrip(",") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    return kinds[-1] == "Relation" and set(kinds[:-1]) <= {"Project", "Filter"}


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name made of ``name`` that none of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while (name := f"__{name}").lower() in taken:
        pass
    return name


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: Spark removes shuffle files, broadcasts and checkpoints of frames that are garbage only when the driver collects it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; ``lower`` alone would also fold letters outside ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def shuffle_width(spark: SparkSession, rows_per_task: int, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows, at least as many as the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
