"""As-of matching as a union and one window, with one shuffle on the key.

Each key must bring at most one event per time point (reduce with
``latest_per_key_date`` or a sum first), so the rows of a key are bounded by the
calendar and not by the number of copies in the source. For keys whose series is
longer than a task should hold, ``chunk`` cuts the series into time buckets: the
window runs inside a bucket and the last event of the earlier buckets is carried
in from one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_on: str,
    right_on: str,
    values: list[str],
    direction: str = "backward",
    inclusive: bool = True,
    chunk: str | None = None,
) -> DataFrame:
    """Attach to every left row the nearest right row at or before (after) it.

    Left rows without a match keep null values. ``chunk`` is a truncation unit
    such as ``YEAR``; ``None`` keeps the whole series of a key in one window.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    backward = direction == "backward"
    left_row = F.struct(*[F.col(c) for c in left.columns])
    right_row = F.struct(*[F.col(c) for c in values])
    left_type = left.select(left_row.alias("r")).schema["r"].dataType
    right_type = right.select(right_row.alias("r")).schema["r"].dataType
    # Side decides the order of rows on the same time point: events first when equal times match.
    event_side = 0 if inclusive else 2
    events = right.select(
        *by, F.col(right_on).alias("_at"), F.lit(event_side).alias("_side"),
        right_row.alias("_hit"), F.lit(None).cast(left_type).alias("_row"),
    )
    probes = left.select(
        *by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(right_type).alias("_hit"), left_row.alias("_row"),
    )
    both = events.unionByName(probes)
    order = [F.col("_at").asc() if backward else F.col("_at").desc(), F.col("_side").asc()]
    last_hit = F.last("_hit", ignorenulls=True)
    if chunk is None:
        seen = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        matched = both.withColumn("_match", last_hit.over(seen)).filter(F.col("_row").isNotNull())
    else:
        both = both.withColumn("_chunk", F.date_trunc(chunk, F.col("_at")))
        event_time = F.when(F.col("_hit").isNotNull(), F.col("_at"))
        edge = F.max_by("_hit", event_time) if backward else F.min_by("_hit", event_time)
        bucket_order = F.col("_chunk").asc() if backward else F.col("_chunk").desc()
        earlier = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            both.groupBy(*by, "_chunk").agg(edge.alias("_edge"))
            .withColumn("_carried", F.last("_edge", ignorenulls=True).over(earlier))
            .select(*by, "_chunk", "_carried")
        )
        seen = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        matched = (
            both.withColumn("_match", last_hit.over(seen))
            .filter(F.col("_row").isNotNull())
            .join(carried, [*by, "_chunk"], "left")
            .withColumn("_match", F.coalesce("_match", "_carried"))
        )
    return matched.select(
        *[F.col("_row")[c].alias(c) for c in left.columns],
        *[F.col("_match")[c].alias(c) for c in values],
    )


def latest_per_key_date(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``, chosen with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def valid_shares(shares: DataFrame) -> DataFrame:
    """Positive share counts, one per (symbol, publish date), last by report date."""
    kept = shares.filter(F.col("publish_date").isNotNull() & (finite("total_shares") > 0))
    order = [F.coalesce(F.col("report_date"), F.lit("9999-12-31").cast("date"))] if "report_date" in shares.columns else []
    return latest_per_key_date(kept, ["symbol", "publish_date"], [*order, F.col("total_shares")])


def asof_shares(price: DataFrame, shares: DataFrame, chunk: str | None = None) -> DataFrame:
    """Latest published share count on or before each price date, and market cap."""
    joined = asof_join(
        price, valid_shares(shares), by=["symbol"], left_on="date", right_on="publish_date",
        values=["publish_date", "total_shares"], chunk=chunk,
    )
    return joined.withColumn("total_market_cap", F.col("close") * F.col("total_shares"))


def asof_adjust_factor(price: DataFrame, factors: DataFrame, chunk: str | None = None) -> DataFrame:
    """Cumulative adjustment factor in force on each price date; one before the first event."""
    joined = asof_join(
        price, factors.select("symbol", "operate_date", "back_adjust_factor"), by=["symbol"],
        left_on="date", right_on="operate_date", values=["back_adjust_factor"], chunk=chunk,
    )
    return joined.withColumn("back_adjust_factor", F.coalesce("back_adjust_factor", F.lit(1.0)))


def asof_snapshot_date(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshot date in force on each date; both frames are one row per day at most."""
    key = F.lit(1).alias("_k")
    distinct = snapshots.select("effective_date").distinct()
    return asof_join(
        dates.withColumn("_k", key), distinct.withColumn("_k", key), by=["_k"],
        left_on="date", right_on="effective_date", values=["effective_date"],
    ).drop("_k")


def calendar_date_on_or_after(events: DataFrame, calendar: DataFrame, on: str, name: str = "calendar_date",
                              strict: bool = False) -> DataFrame:
    """First calendar date on or after (strictly after) each event date.

    Distinct event dates are matched against the calendar, which is bounded by
    days, and the answer is joined back, so the event rows themselves never meet
    in one group.
    """
    key = F.lit(1).alias("_k")
    days = events.select(F.col(on).alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    matched = asof_join(
        days.withColumn("_k", key), calendar.select(F.col("date").alias(name)).distinct().withColumn("_k", key),
        by=["_k"], left_on="_day", right_on=name, values=[name], direction="forward", inclusive=not strict,
    ).drop("_k")
    return events.join(F.broadcast(matched), events[on] == matched["_day"], "left").drop("_day")
