"""Cut a plan in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there; in one process (tests) a temporary folder does."""
    settle_dir(df.sparkSession)
    return df.checkpoint()


def settle_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.match(r"local(\[[\d*,]+\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lorekeep-checkpoint-"))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    settle_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: like settle(), with a size by which Spark decides on joins."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.match(r"table-[0-9a-f]{32}$", folder.rsplit("/", 1)[1]):
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def little_disk(spark: SparkSession):
    """What an action shuffled goes when it ends, and tables are packed more tightly. For code that executes no DataFrame object twice."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
