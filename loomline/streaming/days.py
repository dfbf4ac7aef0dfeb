"""Counts of all ratings by local day and the latest rows, kept in state a day and closed by a timer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomline.operators.feedback import rating_label

#: A day's rows are counted in so many parts, so that no task holds a whole busy day.
PARTS = 8
UNLABELLED = "unlabelled"
ROW = "feedback_id long, ts timestamp, question string, model string, rating int"
OUT = f"day date, part int, label string, n long, closed boolean, {ROW}"
_FIELDS = [f.split()[0] for f in ROW.split(", ")]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayCounter(StatefulProcessor):
    """State of a part of a day: counts by label and its `keep` latest rows. A timer at the day's end (in event time, so after what may still be late) gives the last counts, marks them closed and drops the state."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "label string", "n long")
        self.latest = handle.getListState("latest", ROW)

    def _rows(self, key, counts: dict[str, int], closed: bool, latest: list[tuple] = ()) -> pd.DataFrame:
        day, part = key
        rows = [(day, part, label, n, closed, *[None] * len(_FIELDS)) for label, n in counts.items()] + [(day, part, None, None, None, *row) for row in latest]
        frame = pd.DataFrame(rows, columns=["day", "part", "label", "n", "closed", *_FIELDS])
        return frame.astype({"n": "Int64", "closed": "boolean", "feedback_id": "Int64", "rating": "Int32", "part": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        added, latest, ends = Counter(), [tuple(x) for x in self.latest.get()], set()
        for frame in rows:
            added.update(frame["label"])
            ends.update(int(x) for x in frame["ends"].unique())
            own = frame[_FIELDS].astype(object).where(frame[_FIELDS].notna(), None)
            latest += [(int(r[0]), pd.Timestamp(r[1]).to_pydatetime(), r[2], r[3], None if r[4] is None else int(r[4])) for r in own.itertuples(index=False)]
            latest = sorted(latest, key=lambda r: (-r[1].timestamp(), r[0]))[: self.keep]
        counts = {}
        for label, n in added.items():
            held = self.counts.getValue((label,)) if self.counts.containsKey((label,)) else None
            counts[label] = n + (held[0] if held else 0)
            self.counts.updateValue((label,), (counts[label],))
        self.latest.put(latest)
        known = {t for t in self.handle.listTimers()}
        for end in ends - known:
            self.handle.registerTimer(end)
        yield self._rows(key, counts, False, latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        counts = {label[0]: n[0] for label, n in self.counts.iterator()}
        self.counts.clear()
        self.latest.clear()
        yield self._rows(key, counts, True)

    def close(self) -> None:
        pass


def day_rows(log: DataFrame, zone: str = "Europe/Berlin", late: str = "1 day", keep: int = 5, key: str = "feedback_id") -> DataFrame:
    """Changed counts and latest rows of the log (feedback_id, rating, ts, question, model) as a stream, as OUT. Rows sent twice within `late` count once, later ones are dropped; rows without a time are of no day."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    rows = log.filter("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    ends = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone))
    rows = rows.select(day.alias("day"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part"), F.coalesce(rating_label(), F.lit(UNLABELLED)).alias("label"), ends.alias("ends"), F.col(key).cast("long").alias("feedback_id"), "ts", "question", "model", F.col("rating").cast("int").alias("rating"))
    return rows.groupBy("day", "part").transformWithStateInPandas(DayCounter(keep), OUT, "Append", "EventTime")


def run_days(log: DataFrame, folder: str, checkpoint: str, **options) -> None:
    """Reads what is there, writes what changed and stops. Each batch has a folder of its own, which a batch tried again replaces. Timers need the state store of Spark that keeps state on disk."""
    spark = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    try:
        day_rows(log, **options).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def read_day_labels(spark: SparkSession, folder: str) -> DataFrame:
    """day, label, n, closed (all its parts are) as of the last batch: counts of a part only grow."""
    parts = spark.read.parquet(folder).filter("label is not null").groupBy("day", "part", "label").agg(F.max("n").alias("n"), F.max("closed").alias("closed"))
    return parts.groupBy("day", "label").agg(F.sum("n").alias("n"), F.min("closed").alias("closed"))


def read_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """day, n of all ratings from the first local day to the last; days without rows count 0."""
    days = read_day_labels(spark, folder).groupBy("day").agg(F.sum("n").alias("n"))
    calendar = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def read_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """label, n over all days."""
    return read_day_labels(spark, folder).filter(F.col("label") != UNLABELLED).groupBy("label").agg(F.sum("n").alias("n"))


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest rows that any batch gave, each once, for recent_questions()."""
    rows = spark.read.parquet(folder).filter("label is null").select(*_FIELDS)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("feedback_id").orderBy("ts"))).filter("_n = 1").drop("_n")
