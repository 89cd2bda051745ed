"""Broker records and tables as Spark frames: Kafka, replayed files, Parquet snapshots, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom.operators.curate import from_kafka

#: The five columns of a broker record.
RECORD_SCHEMA = "source_topic string, source_partition int, source_offset bigint, kafka_timestamp timestamp, raw_value string"


def kafka_stream(spark: SparkSession, brokers: str, topics: list[str], starting: str = "earliest", per_trigger: int = 10_000) -> DataFrame:
    """The topics' records from the start (or end) of the log; fails rather than skip lost data. Needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", ",".join(topics))
    reader = reader.option("startingOffsets", starting).option("failOnDataLoss", "true").option("maxOffsetsPerTrigger", per_trigger)
    return from_kafka(reader.load())


def replayed_stream(spark: SparkSession, path: str, schema: str | StructType = RECORD_SCHEMA, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A folder of Parquet files as a stream, in place of a broker; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def snapshot_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder with its partition columns, or no rows while it doesn't exist yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric key, so no single connection reads it all. Needs the database's driver."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.options(**options).load()


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.filter(df[key] == value).limit(1)
