"""Running a stream to its end over files, for queries and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex}"


def run_batches(spark: SparkSession, batches: list[DataFrame], transform, name: str) -> DataFrame:
    """Feeds each frame as one micro-batch (one file) through a streaming transform, and reads what came out."""
    folder = shared_folder(spark, name)
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = transform(stream)
    done = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
