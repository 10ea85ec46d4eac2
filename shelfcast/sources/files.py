"""CSV / JSON / parquet file sources and sinks.

Every read uses an explicit schema (no inference pass over the data) and
PERMISSIVE mode: malformed lines keep their text in `_corrupt_record`
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
SERIES = ("store_id", "product_id")

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("store_id", T.IntegerType()),
    T.StructField("product_id", T.IntegerType()), T.StructField("sales", T.DoubleType()),
    T.StructField("price", T.DoubleType()), T.StructField("promotion", T.IntegerType()),
    T.StructField("inventory", T.DoubleType()), T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("is_holiday", T.IntegerType()),
])
FORECAST_SCHEMA = T.StructType([
    T.StructField("store_id", T.IntegerType()), T.StructField("product_id", T.IntegerType()),
    T.StructField("date", T.DateType()), T.StructField("horizon", T.IntegerType()),
    T.StructField("model", T.StringType()), T.StructField("actual_sales", T.DoubleType()),
    T.StructField("forecast", T.DoubleType()),
])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(_with_corrupt(schema)).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("dateFormat", "yyyy-MM-dd").csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SALES_SCHEMA)


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FORECAST_SCHEMA)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = "store_id") -> None:
    """The default sink: parquet, partitioned by store so store filters prune files."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (response / insight / instruction dataset sinks)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---------------------------------------------------------------- bucketed tables

BUCKETS = 32


def write_bucketed(panel: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The panel as a table bucketed by series and sorted by day: whatever
    groups, joins or windows it by series later reads it without a shuffle.
    Rows are dealt to their buckets before the write, so that a bucket is one
    file.  The files are in `path`; `table` names them in the session's catalog."""
    (panel.repartition(buckets, *SERIES).sortWithinPartitions(*SERIES, "date")
     .write.mode("overwrite").bucketBy(buckets, *SERIES).sortBy(*SERIES, "date").option("path", path).saveAsTable(table))
    return panel.sparkSession.table(table)
