"""Decoded packets, recorded or live, behind one interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.schema import PACKETS


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PACKETS).format(fmt).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files: int | None = None) -> DataFrame:
    """Packet files that arrive in a folder."""
    r = spark.readStream.schema(PACKETS).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def stream_packets_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Packets as JSON messages (needs the Kafka connector on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return (raw.select(F.from_json(F.col("value").cast("string"), PACKETS).alias("p"))
            .select("p.*"))
