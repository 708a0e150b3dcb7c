"""Windows along one symbol's (or one series') dates.

Inputs hold one row per (key, date), so a window partition is bounded by the
calendar. All windows of a key share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import finite


def by_date(keys: list[str], date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def pct_change(value: Column | str, window: WindowSpec) -> Column:
    """Value over previous value minus one, without filling."""
    column = F.col(value) if isinstance(value, str) else value
    return F.try_divide(column, F.lag(column).over(window)) - F.lit(1.0)


def _last(order: WindowSpec, back: int, by_range: bool) -> WindowSpec:
    return order.rangeBetween(-(back - 1), 0) if by_range else order.rowsBetween(-(back - 1), 0)


def trailing_sum(value: Column, order: WindowSpec, back: int, *, by_range: bool = False) -> Column:
    """Sum of the last ``back`` rows (or order units), zero without values.

    Each frame adds its own values. A difference of two running sums would be cheaper
    but keep the rounding, or the NaN, of values that have left the frame.
    """
    return F.coalesce(F.sum(value).over(_last(order, back, by_range)), F.lit(0.0))


def trailing_avg(value: Column, order: WindowSpec, back: int, *, by_range: bool = False) -> Column:
    """Mean of the non-null values of the last ``back`` rows (or order units)."""
    return F.avg(value).over(_last(order, back, by_range))


def rolling_volatility(df: DataFrame, lookback: int, value: str = "close", keys: list[str] | None = None,
                       date: str = "date", name: str = "volatility") -> DataFrame:
    """Sample deviation of the ``lookback - 1`` returns between the last positive values."""
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    window = by_date(keys or ["symbol"], date)
    frame = window.rowsBetween(-(lookback - 2), 0)
    returns = df.filter(finite(value) > 0).withColumn("_r", pct_change(value, window))
    full = F.count("_r").over(frame) == lookback - 1
    return returns.withColumn(name, F.when(full, F.stddev_samp("_r").over(frame))).drop("_r")


def forward_fill(df: DataFrame, calendar: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    """Dense (date, key) rows from each key's first value on, carrying the last value.

    A quote is repeated over the calendar positions up to the key's next quote, so
    no grid is built and joined; only the bounded calendar is broadcast.
    """
    positions = calendar.select(
        "date", "market_index", F.max("market_index").over(Window.partitionBy()).alias("_last")
    )
    numbered = df.filter(F.col(value).isNotNull()).join(F.broadcast(positions), "date")
    upcoming = F.lead("market_index").over(Window.partitionBy(key).orderBy("market_index"))
    spread = numbered.withColumn("_until", F.coalesce(upcoming - 1, F.col("_last"))).select(
        key, value, F.explode(F.sequence("market_index", "_until")).alias("market_index")
    )
    return spread.join(F.broadcast(calendar.select("date", "market_index")), "market_index").select("date", key, value)


def back_fill(df: DataFrame, value: str = "close", keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """Fill nulls from the next non-null value of the key."""
    after = by_date(keys or ["symbol"], date).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.first(value, ignorenulls=True).over(after))


def compound(df: DataFrame, returns: str, keys: list[str], date: str = "date", name: str = "nav") -> DataFrame:
    """Cumulative product of one plus the return; missing returns count as zero."""
    frame = by_date(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.product(1.0 + F.coalesce(F.col(returns), F.lit(0.0))).over(frame))


def drawdown(df: DataFrame, nav: str, keys: list[str], date: str = "date", name: str = "drawdown") -> DataFrame:
    """Value over its running maximum minus one."""
    frame = by_date(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.col(nav) / F.max(nav).over(frame) - 1.0)


def previous_flag(flag: str, window: WindowSpec) -> Column:
    """The flag of the row before, false on the first row."""
    return F.lag(flag, 1, False).over(window)


def last_in_month(df: DataFrame, date: str = "date", key: str = "symbol") -> DataFrame:
    """Last row of each (month, key), chosen with map-side combining."""
    rest = [c for c in df.columns if c != key]
    month = F.date_trunc("MONTH", F.col(date)).cast("date")
    return (
        df.groupBy(month.alias("month"), key)
        .agg(F.max_by(F.struct(*rest), F.col(date)).alias("_r"))
        .select("month", key, *[F.col("_r")[c].alias(c) for c in rest])
    )


def latest_per_symbol(df: DataFrame, as_of, value: str, date: str = "date", key: str = "symbol") -> DataFrame:
    """Last positive value of each key on or before one date."""
    kept = df.filter((F.col(date) <= F.to_date(F.lit(str(as_of)))) & (finite(value) > 0))
    return kept.groupBy(key).agg(F.max_by(value, date).alias(value), F.max(date).alias(date))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def observation_count(df: DataFrame, keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """Running number of rows of each key."""
    return df.withColumn("observation_count", F.row_number().over(by_date(keys or ["symbol"], date)))


def lower_band(df: DataFrame, value: str, window_rows: int, multiplier: float, date: str = "date") -> DataFrame:
    """Rolling mean minus k population deviations, and whether the value is below it.

    The input is one row per month, so its single window is tiny.
    """
    frame = Window.orderBy(date).rowsBetween(-(window_rows - 1), 0)
    full = F.count(value).over(frame) == window_rows
    band = F.when(full, F.avg(value).over(frame) - F.lit(float(multiplier)) * F.stddev_pop(value).over(frame))
    return df.withColumn("lower_band", band).withColumn(
        "bearish_signal", F.coalesce(F.col(value) < F.col("lower_band"), F.lit(False))
    )


def last_quotes(df: DataFrame, count: int, keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """The last ``count`` rows of each key; Spark limits within the map tasks first."""
    if count <= 0:
        raise ValueError("count must be positive")
    window = Window.partitionBy(*(keys or ["symbol"])).orderBy(F.col(date).desc())
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= count).drop("_n")
