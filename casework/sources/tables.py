"""Read and write case tables; formats are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SMALL_INPUT_SPLITS = 64
# Input of one micro-batch unless a caller says otherwise.
TRIGGER_BYTES = 1 << 30


def read_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """``folder/name.fmt``. Formats that would infer a schema by reading the data need one."""
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema: inferring one reads the whole input")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(f"{folder}/{name}.{fmt}")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core before costly per-row work.

    A small table is often one file with one row group, which only one task
    can read. An input of more than ``SMALL_INPUT_SPLITS`` splits is left
    alone, so this never shuffles a large table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SMALL_INPUT_SPLITS) else df


def stream_table(
    spark: SparkSession, folder: str, name: str, schema: StructType, fmt: str = "parquet",
    files_per_trigger: int | None = None, bytes_per_trigger: int = TRIGGER_BYTES,
) -> DataFrame:
    """``folder/name.fmt``, a file or a folder that files arrive in, as a stream.

    A micro-batch takes about ``bytes_per_trigger`` of input, one file at
    least, or ``files_per_trigger`` files if that is given.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    # As a pattern the path may name a single file, which a stream refuses otherwise.
    return reader.load(f"{folder}/{name}[.]{fmt}")


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a table as a whole; returns its path."""
    path = f"{folder}/{name}.{fmt}"
    writer = df.write.format(fmt).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
