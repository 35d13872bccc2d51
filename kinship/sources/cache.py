"""Finished steps as Parquet folders named by the settings that they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession


def signature(*settings) -> str:
    """A short name of settings; dataclasses count with all their fields."""
    plain = [asdict(s) if is_dataclass(s) else s for s in settings]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:12]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, folder: str, name: str, settings: list, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, from its folder if an earlier run with the same settings finished it."""
    path = f"{folder}/{name}-{signature(name, *settings)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
