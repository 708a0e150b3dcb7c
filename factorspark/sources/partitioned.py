"""Stored tables that are updated partition by partition.

A table is parquet below one path, partitioned by the month of its date column or by a key column of its own. An update
finds the partitions that it touches, computes the next content of those alone with the functions of ``tables``, stages it, and puts it in
place by dynamic partition overwrite. Other partitions are neither read nor written. The touched partitions are named on
the driver: they are at most the months of the history, or the keys of an update.

``save_bucketed`` keeps a table by month and by hash of the symbol, so that date bounds choose partitions, a list of symbols chooses
buckets, and windows over a symbol find its rows together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import durable
from . import tables
from .loading import _as_date, canonicalize, select_range
from .schemas import dataset

MONTH = "month"
BUCKETS = 64


def with_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn(MONTH, F.trunc(F.col(date).cast("date"), "MONTH"))


def touched(df: DataFrame, column: str) -> list:
    """The distinct partitions that a frame names, in order."""
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def months_of_ranges(requests: DataFrame, start: str = "start", end: str = "end") -> list[dt.date]:
    months = F.sequence(F.trunc(start, "MONTH"), F.trunc(end, "MONTH"), F.expr("INTERVAL 1 MONTH"))
    return touched(requests.filter(F.col(start) <= F.col(end)).select(F.explode(months).alias(MONTH)), MONTH)


def write_partitions(df: DataFrame, path: str, partition: str, sort_by: Collection[str] = ()) -> None:
    """Replace the partitions that ``df`` has rows of, leaving all others as they are."""
    dealt = df.repartition(partition, *[c for c in sort_by if c == "symbol"])
    dealt.sortWithinPartitions(partition, *sort_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: StructType, partition: str, only: Collection | None = None) -> DataFrame:
    """The table, or of it the given partitions."""
    kind = "date" if partition == MONTH else schema[partition].dataType.simpleString()
    fields = [f for f in schema.fields if f.name != partition]
    stored = spark.read.schema(StructType(fields).add(partition, kind)).parquet(path)
    if only is not None:
        stored = stored.filter(F.col(partition).isin(list(only)))
    return stored.select(*schema.fieldNames())


def update_partitions(spark: SparkSession, path: str, schema: StructType, partition: str, names: list, change: Callable[[DataFrame], DataFrame], *,
                      date: str | None = None, sort_by: Collection[str] = ()) -> None:
    """Put ``change`` of the named partitions' content in their place; partitions left without rows become empty."""
    if not names:
        return
    following = change(read_partitions(spark, path, schema, partition, names))
    staged = durable(following if date is None else with_month(following, date), "next-partitions")
    kept = touched(staged, partition)
    if not set(kept) <= set(names):
        raise ValueError(f"an update of {path} would write to partitions that it has not read: {sorted(set(kept) - set(names))[:5]}")
    if kept:
        write_partitions(staged, path, partition, sort_by)
    for name in sorted(set(names) - set(kept)):
        staged.drop(partition).limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{partition}={name}")


def store_by_month(df: DataFrame, path: str, date: str, sort_by: Collection[str] = ()) -> None:
    write_partitions(with_month(df, date), path, MONTH, sort_by)


def read_by_month(spark: SparkSession, path: str, schema: StructType, start=None, end=None, date: str = "date") -> DataFrame:
    """The table's rows inside inclusive dates; months outside are not listed for reading."""
    stored = spark.read.schema(StructType(schema.fields).add(MONTH, "date")).parquet(path)
    if start is not None:
        stored = stored.filter((F.col(MONTH) >= F.trunc(F.lit(_as_date(start)), "MONTH")) & (F.col(date) >= F.lit(_as_date(start))))
    if end is not None:
        stored = stored.filter((F.col(MONTH) <= F.lit(_as_date(end))) & (F.col(date) < F.date_add(F.lit(_as_date(end)), 1)))
    return stored.select(*schema.fieldNames())


def replace_dates_at(path: str, schema: StructType, incoming: DataFrame, keys: list[str], date: str = "date", *, validate: bool = True) -> None:
    """``tables.replace_by_dates`` on the months of the incoming rows."""
    months = touched(with_month(incoming, date), MONTH)
    update_partitions(incoming.sparkSession, path, schema, MONTH, months, lambda old: tables.replace_by_dates(old, incoming, keys, validate=validate), date=date)


def replace_range_at(path: str, schema: StructType, incoming: DataFrame, requests: DataFrame, keys: list[str], date: str = "date") -> None:
    """``tables.replace_by_range`` on the months that the requests reach and the table has, or the incoming rows need."""
    stored = touched(incoming.sparkSession.read.schema(StructType().add(MONTH, "date")).parquet(path), MONTH)
    fresh = touched(with_month(incoming, date), MONTH)
    months = sorted((set(months_of_ranges(requests)) & set(stored)) | set(fresh))
    update_partitions(incoming.sparkSession, path, schema, MONTH, months, lambda old: tables.replace_by_range(old, incoming, requests, keys, date), date=date)


def upsert_close_at(path: str, schema: StructType, incoming: DataFrame, keys: list[str], date: str = "date", *, validate: bool = True) -> None:
    """``tables.upsert_close`` on the months of the incoming closes."""
    months = touched(with_month(incoming, date), MONTH)
    update_partitions(incoming.sparkSession, path, schema, MONTH, months, lambda old: tables.upsert_close(old, incoming, keys, validate=validate), date=date)


def replace_key_at(path: str, schema: StructType, incoming: DataFrame, key: str, unique: list[str]) -> None:
    """All rows of the incoming keys, each a partition, replaced; nothing is read."""
    typed = incoming.dropDuplicates(unique).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    write_partitions(typed, path, key)


def save_bucketed(df: DataFrame, table: str, date: str = "date", *, buckets: int = BUCKETS, path: str | None = None) -> None:
    """A catalogue table by month, with a file for each bucket of symbols in it, ordered by symbol and date.

    Months and buckets are dealt to tasks together, so a task writes one file.
    """
    dealt = with_month(df, date)
    dealt = dealt.repartition(MONTH, F.pmod(F.hash("symbol"), F.lit(buckets)))
    writer = dealt.write.mode("overwrite").partitionBy(MONTH).bucketBy(buckets, "symbol").sortBy("symbol", date)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def load_bucketed(spark: SparkSession, name: str, table: str, *, start=None, end=None, symbols: Collection[str] | DataFrame | None = None) -> DataFrame:
    """A declared dataset from its bucketed table.

    Bounds on the dates become bounds on the month, which choose partitions; a list of symbols chooses buckets. A frame of symbols is
    joined bucket by bucket, so the table's rows stay where they are.
    """
    spec = dataset(name)
    stored, start, end = spark.table(table), _as_date(start), _as_date(end)
    if spec.date_column and start is not None:
        stored = stored.filter(F.col(MONTH) >= F.trunc(F.lit(start), "MONTH"))
    if spec.date_column and end is not None:
        stored = stored.filter(F.col(MONTH) <= F.lit(end))
    return canonicalize(select_range(stored, spec, start, end, symbols), spec)
