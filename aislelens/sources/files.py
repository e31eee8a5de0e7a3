"""CSV in, CSV out, and appending to a target table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_csv(spark: SparkSession, path: str, schema: str | StructType, **options: str) -> DataFrame:
    """Read headed CSV files with a declared schema: no inference pass over the data.

    A header that differs from the schema, or a value that does not fit its type, fails
    the read instead of silently giving wrong columns or NULL.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.options(**options).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def load_append(df: DataFrame, target: str, partition_by: list[str] | None = None) -> None:
    """Append a cleaned table to the parquet table at ``target``."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)


def append_to_table(df: DataFrame, table: str) -> None:
    """Append a cleaned table to a catalogue table."""
    df.write.mode("append").saveAsTable(table)


def append_to_jdbc(df: DataFrame, url: str, table: str, writers: int, properties: dict[str, str]) -> None:
    """Append a cleaned table to a database over at most ``writers`` connections."""
    df.coalesce(writers).write.mode("append").jdbc(url, table, properties=properties)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder every executor can reach.

    That is ``spark.checkpoint.dir``; only a local-mode session without it gets a
    temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="aislelens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several passes read to the shared folder, once, and read it back.

    Losing an executor then costs no recomputation, and each pass reads only the columns
    and row groups it needs.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "intermediate")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
