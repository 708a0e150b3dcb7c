"""Daily intraday volatility as a stream of minute bars, by a stateful processor with event-time timers.

The state of a (symbol, day) is the list of its bars, appended to without being read; when the watermark passes the day's end,
its timer fires, the day is valued once and the state goes. Days that were asked for set their timers at the start,
so that those without bars come out as well.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.intervals import merge_intervals
from ..operators.intraday import FAILED, INCOMPLETE, MINUTE_VALUES, NO_DATA, VALID

#: What the stream puts out: finished days, minutes held with different values, and counts of bars that came after their day's end.
DAY, CONFLICT, LATE = "day", "conflict", "late"
RESULT = ("kind string, symbol string, trade_date date, datetime timestamp, volatility double, bar_count int, return_count int, "
          "status int, row_count long")
#: Timers and lists need this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(kind: str, key: tuple, **values) -> Row:
    empty = dict(datetime=None, volatility=None, bar_count=None, return_count=None, status=None, row_count=None)
    return Row(kind=kind, symbol=key[0], trade_date=key[1], **(empty | values))


def sample_deviation(closes: list[float | None]) -> tuple[float | None, int]:
    """Sample deviation of the returns between neighbours, and how many returns there are; NaN with a return from zero."""
    pairs = [(later, earlier) for later, earlier in zip(closes[1:], closes, strict=False) if later is not None and earlier is not None]
    if len(pairs) < 2:
        return None, len(pairs)
    returns = [later / earlier - 1.0 if earlier else math.nan for later, earlier in pairs]
    if not all(map(math.isfinite, returns)):
        return math.nan, len(returns)
    mean = math.fsum(returns) / len(returns)
    return math.sqrt(math.fsum((r - mean) ** 2 for r in returns) / (len(returns) - 1)), len(returns)


class DayProcessor(StatefulProcessor):
    """Bars of one (symbol, day) until the watermark passes its end."""

    def __init__(self, columns: list[str], zone: str, min_bars: int | None, finite_only: bool):
        self.columns, self.zone, self.min_bars, self.finite_only = columns, zone, min_bars, finite_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", "datetime timestamp, " + ", ".join(f"{c} double" for c in self.columns))
        self.end = handle.getValueState("end", "end long")

    def _end_of(self, key: tuple) -> int:
        midnight = dt.datetime.combine(key[1] + dt.timedelta(days=1), dt.time(), ZoneInfo(self.zone))
        return int(midnight.timestamp() * 1000)

    def _open(self, key: tuple) -> None:
        if not self.end.exists():
            end = self._end_of(key)
            self.end.update((end,))
            self.handle.registerTimer(end)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._open(key)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [(row["datetime"], *(row[c] for c in self.columns)) for row in rows]
        if timerValues.getCurrentWatermarkInMs() >= self._end_of(key):
            yield _row(LATE, key, row_count=len(found))
            return
        self._open(key)
        self.bars.appendList(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        minutes: dict[dt.datetime, list] = {}
        for time, *values in self.bars.get() if self.bars.exists() else ():
            held = minutes.setdefault(time, [values, 0, False])
            held[1] += 1
            held[2] |= held[0] != values
        conflicts = {time: n for time, (_, n, differs) in minutes.items() if differs}
        for time in sorted(conflicts):
            yield _row(CONFLICT, key, datetime=time, row_count=conflicts[time])
        close = self.columns.index("close")
        volatility, returns = sample_deviation([minutes[time][0][close] for time in sorted(minutes)])
        if conflicts:
            volatility, status = None, FAILED
        elif not minutes:
            status = NO_DATA
        else:
            unusable = volatility is None or (self.finite_only and not math.isfinite(volatility)) or len(minutes) < (self.min_bars or 1)
            status = INCOMPLETE if unusable else VALID
        yield _row(DAY, key, volatility=volatility, bar_count=len(minutes), return_count=returns, status=status)
        self.bars.clear()
        self.end.clear()


def stream_daily_volatility(bars: DataFrame, *, delay: str = "1 hour", min_bars: int | None = None, expected: DataFrame | None = None,
                            finite_only: bool = True) -> DataFrame:
    """Rows of ``RESULT`` from a stream of minute bars, in append mode.

    * ``day``: one row for each (symbol, day) once the watermark has passed its end; ``expected`` (symbol, trade_date; a table as
      it is when the stream first starts) adds the days without bars, with the no-data status. A day with conflicting
      minutes has the failed status and no volatility. A day with a close of zero before another has the volatility NaN and is
      incomplete; without ``finite_only`` it is valid if it has bars enough. Equal bars of a minute are one bar, and returns never cross a day.
    * ``conflict``: each minute held with different values, with its number of rows, as ``conflicting_minutes`` lists them.
    * ``late``: how many bars of a day came in one batch after the day was finished. They change nothing else.

    The watermark is ``delay`` behind the latest bar, and bars behind it still count while their day is open. Naive times are read in
    the session time zone, as watermarks need instants; the days are those of the same zone.
    """
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = [c for c in MINUTE_VALUES if c in bars.columns]
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    timed = bars.select("symbol", F.col("datetime").cast("timestamp").alias("event_time"), *values).withWatermark("event_time", delay)
    # A copy of the time carries no watermark, so that late bars reach the processor, which counts them.
    copied = timed.select("symbol", F.timestamp_micros(F.unix_micros("event_time")).alias("datetime"), *columns)
    keyed = copied.withColumn("trade_date", F.to_date("datetime")).groupBy("symbol", "trade_date")
    start = None if expected is None else expected.select("symbol", F.col("trade_date").cast("date").alias("trade_date")).distinct().groupBy("symbol", "trade_date")
    processor = DayProcessor(columns, spark.conf.get("spark.sql.session.timeZone"), min_bars, finite_only)
    schema = StructType.fromDDL(RESULT)
    return keyed.transformWithState(processor, schema, "Append", "EventTime", initialState=start)


def write_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """One batch of the stream's rows, in a folder that its number names: a batch that runs again replaces itself."""
    batch.write.mode("overwrite").partitionBy("kind").parquet(f"{table.rstrip('/')}/batch={batch_id}")


def start_tables(result: DataFrame, table: str, checkpoint: str, **trigger):
    """Start writing the rows of ``stream_daily_volatility`` below ``table``."""
    writer = result.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, table))
    return (writer.trigger(**trigger) if trigger else writer).start()


def stored(spark: SparkSession, table: str, kind: str) -> DataFrame:
    """The written rows of one kind."""
    return spark.read.schema(f"{RESULT}, batch long").parquet(table.rstrip("/")).filter(F.col("kind") == kind)


def stored_days(spark: SparkSession, table: str) -> DataFrame:
    return stored(spark, table, DAY).select("symbol", "trade_date", "volatility", "bar_count", "return_count", "status")


def stored_features(spark: SparkSession, table: str) -> DataFrame:
    """Volatilities of the valid days, as the batch write stores them."""
    return stored_days(spark, table).filter(F.col("status") == VALID).select("symbol", "trade_date", F.col("volatility").cast("float").alias("volatility"))


def stored_coverage(spark: SparkSession, table: str) -> DataFrame:
    """``symbol, start, end``: the stretches of days that are done, with or without bars."""
    done = stored_days(spark, table).filter(F.col("status").isin(VALID, NO_DATA))
    return merge_intervals(done.select("symbol", F.col("trade_date").alias("start"), F.col("trade_date").alias("end")), ["symbol"])


def stored_conflicts(spark: SparkSession, table: str) -> DataFrame:
    return stored(spark, table, CONFLICT).select("symbol", "datetime", "row_count")


def stored_late(spark: SparkSession, table: str) -> DataFrame:
    """How many bars of each day came too late."""
    return stored(spark, table, LATE).groupBy("symbol", "trade_date").agg(F.sum("row_count").alias("late_bars"))
