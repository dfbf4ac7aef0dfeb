"""The feedback log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.feedback import rating_label


def read_feedback_stream(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def daily_label_counts(log: DataFrame, late: str = "1 day", key: str = "feedback_id") -> DataFrame:
    """day, label, n kept current. Lines sent twice within `late` count once; later ones than that are dropped."""
    rows = log.withColumn("label", rating_label()).withWatermark("ts", late)
    once = rows.dropDuplicatesWithinWatermark([key])
    return once.filter("label is not null").groupBy(F.window("ts", "1 day"), "label").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "label", "n")


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Reads what is there, writes the counts that changed and stops; read_counts() reads them.

    Update mode drops the state of days beyond the watermark. Each batch has a folder of its own, so a batch that is tried
    again replaces its own rows and no others.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """day, label, n as of the last batch that changed them; counts only grow."""
    return spark.read.parquet(folder).groupBy("day", "label").agg(F.max("n").alias("n"))
