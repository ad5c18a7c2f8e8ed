"""Market data files: one CSV a ticker, in folders by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders, the first that has a ticker wins: fixed values.
FOLDERS = ("NYSE", "NASDAQ", "ETFs", "VXs", "Rates")
#: A declared schema: nothing is inferred, so no pass over the files is needed to read them.
SCHEMA = T.StructType([T.StructField("date", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])


def load(spark: SparkSession, root: str, tickers: Sequence[str] | None = None, schema: T.StructType = SCHEMA, folders: Sequence[str] = FOLDERS) -> DataFrame:
    """All rows of the tickers (None: every file) with ``code``; a ticker in several folders is
    read from the first. Files are listed by Spark, so any file system does; a ticker without a file raises FileNotFoundError."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found: dict[str, str] = {}
    for folder in folders:
        path = hadoop(f"{root}/{folder}")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            continue
        for status in system.listStatus(path):
            name = status.getPath().getName()
            if name.endswith(".csv"):
                found.setdefault(name[:-4], status.getPath().toString())
    wanted = sorted(found) if tickers is None else list(dict.fromkeys(tickers))
    missing = [t for t in wanted if t not in found]
    if missing or not wanted:
        raise FileNotFoundError(f"no file for {missing or 'any ticker'} in {list(folders)} under {root}")
    rows = spark.read.schema(schema).option("header", True).csv([found[t] for t in wanted])
    return rows.withColumn("code", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def ordered(df: DataFrame) -> DataFrame:
    """With ``seq``: positions by date within each code."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1).cast("long"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """As Parquet, by partition columns if there are any."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
