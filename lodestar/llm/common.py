"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import new_path

#: A word as split by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Whether shuffle files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of a written table serve nothing any more
    try:
        (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text) -> object:
    """Number of white-space separated words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def packets(batch, column: str, limit: int = 1 << 18):
    """Slices (start, stop) of an Arrow batch that hold about `limit` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield start, stop
        start = stop


def flat_bytes(column):
    """The bytes of an Arrow string column and where each text starts, one more at the end. Null is empty."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


#: A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 16 << 20


def sized_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, measured with their texts and arrays, take at most `most` bytes; else left to a shuffled join."""
    size = F.lit(16)
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(col), F.lit(0)) + 16
        elif kind == "array":
            nested = field.dataType.elementType.typeName()
            inner = F.aggregate(col, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16) if nested == "string" else F.size(col) * 16
            size = size + F.coalesce(inner, F.lit(0)) + 32
        else:
            size = size + 8
    total = df.agg(F.sum(size.cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def running_total(rows: DataFrame, group: str, key: str, ties: list[str], value: str, n: int, span: int) -> DataFrame:
    """rows with `before`: the sum of `value` over the rows of the group that sort before by (key, ties).

    key is a long in 0..span-1, spread evenly; n is about the number of rows. No window holds more than a few
    hundred rows of a group: rows are summed in ranges of the key, the ranges' totals are run up by the same
    function, and only within a range does a window sort rows.
    """
    from pyspark.sql import Window as W

    if n <= 4096:
        order = W.partitionBy(group).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn("before", F.sum(value).over(order) - F.col(value))
    parts = max(1, n // 128)
    width = -(-span // parts)
    own = f"{key}_range"  # another name at each level, where the range of the level above is the key
    cut = rows.withColumn(own, F.expr(f"{key} div {width}L"))
    sums = cut.groupBy(group, own).agg(F.sum(value).alias("_sum"))
    bases = running_total(sums, group, own, [], "_sum", parts, parts).select(F.col(group).alias("_g"), F.col(own).alias("_r"), F.col("before").alias("_base"))
    order = W.partitionBy(group, own).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = cut.withColumn("_in", F.sum(value).over(order) - F.col(value))
    both = inner.join(bases, (F.col(group) == F.col("_g")) & (F.col(own) == F.col("_r")))
    return both.withColumn("before", F.col("_in") + F.col("_base")).drop(own, "_in", "_g", "_r", "_base")


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows as structs, so that no column of theirs clashes with an operator's own."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def unwrapped(rows: DataFrame) -> DataFrame:
    """The columns of `row`."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.schema["row"].dataType.names])
