"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, the session's warehouse, which is shared too."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of that folder which nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go when their query ends; micro-batches of a stream that its state can be taken back to; changes of the state before it is written whole.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RETAINED, SNAPSHOT = "spark.sql.streaming.minBatchesToRetain", "spark.sql.streaming.stateStore.minDeltasForSnapshot"


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with some settings, which are put back in the end; a stream keeps those that it is started with."""
    kept = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that neither a second use nor a lost executor computes it anew; the shuffle files that this took go."""
    path = new_path(df.sparkSession, name)
    with configured(df.sparkSession, **{CLEANUP: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
