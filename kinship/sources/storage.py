"""Tables that all executors share for as long as the program runs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple | None] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a temporary one in local mode, as in tests; on a cluster that is an error, as each machine would have its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="kinship-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinship/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))  # which outlive the session
    return spark.read.schema(df.schema).parquet(path)


def n_stored() -> int:
    """How many stored tables there have been; drop_stored takes two such numbers."""
    return len(_MADE)


def drop_stored(first: int = 0, end: int | None = None) -> None:
    """Deletes the stored tables of these numbers, which no longer may be read. At the end of the program all go."""
    for i in range(first, len(_MADE) if end is None else end):
        made, _MADE[i] = _MADE[i], None
        if made is None:
            continue
        jvm, conf, path = made
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


atexit.register(drop_stored)
