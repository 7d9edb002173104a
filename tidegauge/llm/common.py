"""Helpers shared by the training-data operators: table access, shared staging, text cells."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is read by Spark alone, so any Hadoop file system serves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python, so that very long texts never pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: a worker that waits for its next
    task would keep it from the executor's other work. Allocators without the call are left alone."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees. On one machine alone a session without the setting stages
    under its warehouse; on a cluster that is refused, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id falls in no class (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of the scanned input, None where it has none: it chooses counts of buckets, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def bucket_count(df: DataFrame, per_bucket: int, least: int = 256) -> int:
    return int(max(least, min(1 << 20, (input_bytes(df) or 0) // per_bucket)))


def partition_count(df: DataFrame, per_partition: int, least: int = 8) -> int:
    """Partitions of so many input bytes each, however large the input; of an unknown size, the session's number."""
    size = input_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, min(1 << 17, size // per_partition)))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


MOST_KEYS = 10_000


def sampled(rows: DataFrame, key: str, n: int, salt: int) -> DataFrame:
    """About n rows of each key (all, of a key that has no more), by a hash of doc_id.

    A row is taken or left where it is read: only the counts by key move, and these are broadcast
    while there are at most MOST_KEYS of them. The number taken is binomial with mean n."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.limit(MOST_KEYS + 1).toArrow()  # Arrow goes back without Python workers of its own
    if len(found) <= MOST_KEYS:
        counts = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema))
    share = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return rows.join(counts, key).where(share * F.col("_n") <= float(n)).drop("_n")
