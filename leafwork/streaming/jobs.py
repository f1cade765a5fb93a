"""The state of jobs over a stream of events: the batch fold, kept by Spark's own stateful aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwork.operators.jobs import current_state
from leafwork.shared import scratch


def state_stream(events: DataFrame) -> DataFrame:
    """``current_state`` over a streaming frame; output mode complete or update. Late and repeated rows do not change the result."""
    return current_state(events)


def run_available(spark: SparkSession, folder: str, schema, name: str) -> DataFrame:
    """Fold all that a folder of Parquet events holds now, as a stream, and return the last state as a table."""
    out = scratch(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        stream = reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))
    else:
        stream = reader.parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:06d}")

    q = state_stream(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, name + "-offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{out}/{last:06d}")
