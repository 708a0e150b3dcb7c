"""Maintenance of stored tables: new content as a frame, then a staged write.

The functions ``replace_*``, ``upsert_close``, ``insert_absent`` and
``assign_ids`` compute the table's next content from its present content and an
incoming frame. ``write_snapshot`` writes a content to a new folder and then moves
one pointer file, so a reader never sees a half-written table and no path is
overwritten while it is read.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..operators import intraday
from ..operators.intervals import merge_intervals


def assign_ids(existing: DataFrame, incoming: DataFrame, value: str, id_column: str, *, id_limit: int | None = None) -> DataFrame:
    """Existing ids plus ``max + n`` for unseen values in sorted order.

    New values are numbered by range: each range of the sorted values gets the
    count of the earlier ranges as its offset.
    """
    from ..operators.cross_section import positions

    fresh = incoming.select(value).filter(F.col(value).isNotNull()).distinct().join(existing, value, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("n")).first()["n"]
    numbered = positions(fresh.withColumn("_all", F.lit(1)), ["_all"], [F.col(value).asc()], position="_n", size="_size")
    if id_limit is not None:
        size = numbered.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).first()["n"]
        if top + size > id_limit:
            raise OverflowError(f"{id_column} limit of {id_limit} exceeded")
    added = numbered.select((F.lit(top) + F.col("_n")).cast(existing.schema[id_column].dataType).alias(id_column), value)
    return existing.select(id_column, value).unionByName(added)


def _append(kept: DataFrame, incoming: DataFrame, target: DataFrame) -> DataFrame:
    typed = incoming.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in incoming.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.schema.fields
    ])
    return kept.select(*target.columns).unionByName(typed)


def conflicting_rows(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come in with different rows, with how many; equal rows are one."""
    return incoming.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def replace_by_dates(target: DataFrame, incoming: DataFrame, keys: list[str], *, validate: bool = True) -> DataFrame:
    """Rows of the incoming (key, date) pairs replaced; pairs with different incoming rows raise."""
    if validate:
        quality.require_empty(conflicting_rows(incoming, keys), f"incoming rows differ for {keys}")
    once = incoming.distinct()
    return _append(target.join(once.select(*keys), keys, "left_anti"), once, target)


def replace_by_range(target: DataFrame, incoming: DataFrame, requests: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Rows inside each requested (key, start, end) replaced, also by nothing."""
    merged = merge_intervals(requests, keys).withColumnsRenamed({"start": "_s", "end": "_e"})
    covered = target.join(merged, [*[target[k] == merged[k] for k in keys], target[date].between(merged["_s"], merged["_e"])], "left_anti")
    return _append(covered, incoming, target)


def dates_outside_requests(incoming: DataFrame, requests: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Incoming rows dated outside every requested range of their key."""
    merged = merge_intervals(requests, keys).withColumnsRenamed({"start": "_s", "end": "_e"})
    return incoming.join(merged, [*[incoming[k] == merged[k] for k in keys], incoming[date].between(merged["_s"], merged["_e"])], "left_anti")


def replace_by_key(target: DataFrame, incoming: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """All rows of the incoming keys replaced by the distinct incoming rows."""
    gone = incoming.select(key).distinct()
    return _append(target.join(gone, key, "left_anti"), incoming.dropDuplicates(unique), target)


def upsert_close(target: DataFrame, incoming: DataFrame, keys: list[str], *, validate: bool = True) -> DataFrame:
    """Matched rows get the incoming close; unmatched come in with the close alone.

    Keys with different incoming closes raise, as do missing closes.
    """
    closes = incoming.select(*keys, "close")
    if validate:
        quality.require_rules(closes, {"close is missing": F.col("close").isNull()}, "incoming closes")
        quality.require_empty(conflicting_rows(closes, keys), f"incoming closes differ for {keys}")
    source = closes.distinct().withColumnRenamed("close", "_close")
    joined = target.join(source, keys, "full_outer")
    return joined.withColumn("close", F.coalesce(F.col("_close"), F.col("close"))).select(*target.columns)


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str], *, value: str | None = None, validate: bool = True) -> DataFrame:
    """Distinct incoming rows without an equal row (nulls equal) in the target.

    Rows whose ``value`` is null are skipped; negative values, which ``negative_values``
    lists, raise and never go in.
    """
    if value is not None:
        if validate:
            quality.require_empty(negative_values(incoming, value).select(*keys), f"negative {value}")
        incoming = incoming.filter(F.col(value).isNull() | (F.col(value) >= 0))
    typed = incoming.select(*[F.col(k).cast(target.schema[k].dataType).alias(k) for k in keys])
    if value is not None:
        typed = typed.filter(F.col(value).isNotNull())
    present = target.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return _append(target, typed.distinct().join(present, same, "left_anti"), target)


def negative_values(incoming: DataFrame, value: str) -> DataFrame:
    return incoming.filter(F.col(value) < 0)


def replace_quarter(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Share counts replaced by (symbol, report date), null counts kept."""
    gone = incoming.select("symbol", "report_date").distinct()
    return _append(target.join(gone, ["symbol", "report_date"], "left_anti"), incoming.distinct(), target)


def record_points(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Point coverage: insert or ignore. The stored table is not made distinct anew."""
    fresh = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]).distinct()
    same = reduce(lambda a, b: a & b, [fresh[c].eqNullSafe(target[c]) for c in target.columns])
    return target.unionByName(fresh.join(target, same, "left_anti"))


def record_ranges(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Range coverage merged with new ranges, separately for each key and field set."""
    wrong = {"coverage start is after end": F.col("start") > F.col("end")}
    quality.require_rules(incoming, wrong, "coverage")
    return merge_intervals(target.select(*keys, "start", "end").unionByName(incoming.select(*keys, "start", "end")), keys)


def intraday_writes(bars: DataFrame, expected: DataFrame, *, min_bars: int | None = None,
                    retain_raw: bool = True, finite_only: bool = True, validate: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw bars to keep, features of valid days, and the status of every day (see ``daily_volatility`` for ``finite_only``)."""
    if validate:
        quality.require_empty(intraday.days_off_calendar(bars, expected), "minute bars on days that were not asked for")
    daily = intraday.daily_volatility(bars, expected, min_bars=min_bars, finite_only=finite_only, validate=False)
    features = daily.filter(F.col("status") == intraday.VALID).select(
        "symbol", "trade_date", F.col("volatility").cast("float").alias("volatility")
    )
    status = daily.select(
        "symbol", "trade_date", "status", "bar_count", "return_count", F.lit(True).alias("raw_saved"),
        F.col("status").isin(intraday.VALID, intraday.NO_DATA).alias("feature_saved"),
    )
    return (bars if retain_raw else bars.limit(0)), features, status


def replace_intraday(
    stored_bars: DataFrame, stored_features: DataFrame, stored_status: DataFrame, bars: DataFrame, requests: DataFrame, calendar: DataFrame,
    *, min_bars: int | None = None, validate: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of raw bars, features and day status after a minute write.

    ``requests`` has ``symbol, start_date, end_date, retain_raw``. Inside them the
    features are replaced, also by nothing; raw bars are replaced where a request
    retains them and stay as they are elsewhere; the status of every requested market
    day is replaced. Bars outside the requests raise.
    """
    days = requests.select("symbol", "retain_raw", F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    days = days.join(F.broadcast(calendar.select(F.col("date").alias("trade_date"))), "trade_date")
    expected = days.groupBy("symbol", "trade_date").agg(F.bool_or("retain_raw").alias("retain_raw"))
    _, features, status = intraday_writes(bars, expected, min_bars=min_bars, validate=validate)
    key = ["symbol", "trade_date"]
    kept = expected.filter("retain_raw").select(*key)
    dated = stored_bars.withColumn("trade_date", F.col("datetime").cast("date"))
    fresh = bars.withColumn("trade_date", F.col("datetime").cast("date")).join(kept, key, "left_semi").drop("trade_date")
    status = status.drop("raw_saved").join(expected.withColumnRenamed("retain_raw", "raw_saved"), key)
    return (
        _append(dated.join(kept, key, "left_anti").drop("trade_date"), fresh, stored_bars),
        _append(stored_features.join(expected, key, "left_anti"), features, stored_features),
        _append(stored_status.join(expected, key, "left_anti"), status, stored_status),
    )


MANIFEST = "version long, folder string"


def write_snapshot(df: DataFrame, table: str, *, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> str:
    """Write to a new folder below ``table`` and then add it to the table's manifest.

    The manifest is only ever added to, and one committed file names one version, so a
    reader finds the earlier or the new version whole at any time.
    """
    folder = f"{table.rstrip('/')}/run-{uuid.uuid4().hex}"
    out = df
    if partition_by:
        out = out.repartition(*partition_by)
    if sort_by:
        out = out.sortWithinPartitions(*[*(partition_by or []), *sort_by])
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    row = df.sparkSession.createDataFrame([(time.time_ns(), folder)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{table.rstrip('/')}/manifest")
    return folder


def current_snapshot(spark: SparkSession, table: str) -> str:
    """Folder of the table's highest version."""
    versions = spark.read.schema(MANIFEST).parquet(f"{table.rstrip('/')}/manifest")
    return versions.agg(F.max_by("folder", F.struct("version", "folder")).alias("folder")).first()["folder"]


def read_snapshot(spark: SparkSession, table: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_snapshot(spark, table))
