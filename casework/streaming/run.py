"""Run a streaming query over what has arrived and hand back its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ROCKSDB, run_dir


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input into parquet and read it back.

    Progress and output lie below the shared folder, so a lost executor or a
    restart with the same ``folder`` resumes where the last commit ended.
    """
    spark = stream.sparkSession
    folder = folder or run_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .queryName(name)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_upserts(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Process all available input in update mode and read back the last row of each key.

    Rows that changed in a micro-batch go to a folder named after its number.
    A batch that a failure or a restart repeats writes the same folder again,
    so the table is the same as without the failure. Windows that are still
    open are in it as far as they have come.
    """
    spark = stream.sparkSession
    folder = folder or run_dir(spark, name)
    out = f"{folder}/changes"

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(put)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .queryName(name)
        .start()
    )
    query.awaitTermination()
    return last_changes(spark, out, stream.schema, keys)


def last_changes(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    """One row per key: the one of the last micro-batch that changed it."""
    with_batch = StructType([*schema.fields, StructField("batch", LongType())])
    changes = spark.read.schema(with_batch).option("basePath", folder).parquet(folder)
    values = [c for c in schema.names if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in schema.names])
