"""Normalisation of records as they arrive: the same expressions as in batch, without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kinship.operators.profiles import profiles


def profile_stream(records: DataFrame, translit: Column | None = None) -> DataFrame:
    """A stream of profiles from a stream of records."""
    return profiles(records, translit)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each micro-batch once, also after a restart."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
