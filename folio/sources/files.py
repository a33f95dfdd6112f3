"""Tables and page files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import numbering, snapshots
from ..schemas import EXTENSIONS


def table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the accepted files below a folder, which must be there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(text.accepted(text.basename(F.col("path")), EXTENSIONS))


def sample_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """page_files() of the given names; those that are missing are passed over, a missing folder is an error."""
    return page_files(spark, folder).where(text.basename(F.col("path")).isin(names))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, least: int | None = None, most: int | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relational table; read in parts where a numeric key and its range are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key is not None:
        reader = reader.options(partitionColumn=key, lowerBound=str(least), upperBound=str(most), numPartitions=str(parts))
    return reader.load()


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, unique: Sequence[str] = ()) -> None:
    """Adds rows to a table that may be new; with a key that must be unique, an error if it would not be, and nothing is written."""
    if unique:
        try:
            there = df.sparkSession.read.schema(df.schema).parquet(path)
        except AnalysisException:  # no such table yet
            there = df.limit(0)
        snapshots.refuse(numbering.conflicts(there, df, *unique), unique)
    df.write.mode("append").parquet(path)
