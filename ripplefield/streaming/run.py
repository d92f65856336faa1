"""Running a stream over what is there now, into files of the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or os.path.join(tempfile.gettempdir(), "ripplefield-streams")).rstrip("/")


def drain(stream: DataFrame) -> DataFrame:
    """Process all rows available, exactly once, and return the sink as a table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/log").option("path", f"{base}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
