"""Reading the input tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt to all of them, as work that follows takes longer than the deal; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, parts: int = 8) -> DataFrame:
    """A scan of narrow rows from which much is made, dealt to `parts` tasks for each of its splits and each core at least two: their time then stays that of a part of a split, however its file groups rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, parts * df.rdd.getNumPartitions()))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it.

    Where it is unset on a single machine (tests) a folder of this process is set as the checkpoint directory; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sealgrove-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/sealgrove-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the tasks it held, and what reads the table again
    prunes columns. The files stay until `remove` or `clear` is called or the folder is cleaned.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that `written` made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; for when no result that reads them is needed any more."""
    _delete(spark, f"{scratch_dir(spark)}/sealgrove-{spark.sparkContext.applicationId}")
