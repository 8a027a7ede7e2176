"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in that of spark.checkpoint.dir; only a local session may do with a temporary one. It goes when the driver ends."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/library"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove, spark, folder)
    return folder


_FOLDERS: set[str] = set()


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written, if the session still runs."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already
        pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Files of a folder of cut() at the most, if its rows are spread by a further column.
FILES = 8


def cut(df: DataFrame, by: str | None = None, spread: str | None = None) -> DataFrame:
    """The rows as a written table, in folders by a column if one is named: the lineage ends here, and a lost executor costs nothing.

    A folder is written by one task, or, with a column to spread its rows by, by up to FILES.
    """
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession)
    if by is None:
        df.write.parquet(path)
    else:
        dealt = df.repartition(by, F.pmod(F.hash(spread), F.lit(FILES))) if spread else df.repartition(by)
        dealt.write.partitionBy(by).parquet(path)
    made = spark.read.schema(schema).parquet(path)
    made._path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._path)
