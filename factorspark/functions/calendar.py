"""Trading-calendar frames.

A calendar has one row per market date, so it is bounded by the days of the
history whatever the size of the price table; it is the only thing here that is
numbered in one task or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Period codes and the truncation units they stand for.
PERIOD_UNITS = {"D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}


def distinct_dates(df: DataFrame, date: str = "date", start=None, end=None) -> DataFrame:
    """Distinct market dates, optionally inside inclusive bounds."""
    out = df.select(F.col(date).alias("date")).filter(F.col("date").isNotNull())
    if start is not None:
        out = out.filter(F.col("date") >= F.to_date(F.lit(str(start))))
    if end is not None:
        out = out.filter(F.col("date") <= F.to_date(F.lit(str(end))))
    return out.distinct()


def market_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """``(date, market_index)`` with the dates numbered from one."""
    order = Window.orderBy("date")
    return distinct_dates(df, date).select(
        "date",
        F.row_number().over(order).alias("market_index"),
        F.lag("date").over(order).alias("previous_date"),
        F.lead("date").over(order).alias("next_date"),
    )


def period_end_dates(df: DataFrame, date: str = "date", frequency: str = "M") -> DataFrame:
    """Last available date of each calendar period."""
    unit = PERIOD_UNITS[frequency.upper()]
    period = F.date_trunc(unit, F.col(date)).cast("date")
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(period.alias("period"))
        .agg(F.max(date).alias("date"))
    )


def second_friday_of_december(year: Column) -> Column:
    """Second Friday of December of a year column."""
    november_end = F.make_date(year, F.lit(11), F.lit(30))
    return F.date_add(F.next_day(november_end, "FRI"), 7)


def annual_schedule(calendar: DataFrame, start, end) -> DataFrame:
    """``(as_of_date, effective_date)``: December signal and the next market date.

    The signal is the second Friday of December; it takes effect on the first
    calendar date strictly after it. Years without such a date are left out.
    """
    first, last = F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end)))
    inside = calendar.filter(F.col("date").between(first, last)).select("date")
    years = inside.sparkSession.range(1).select(
        F.explode(F.sequence(F.year(first), F.year(last))).alias("year")
    )
    signals = years.select(second_friday_of_december(F.col("year")).alias("as_of_date"))
    events = signals.select(
        F.col("as_of_date").alias("at"), F.col("as_of_date"), F.lit(None).cast("date").alias("date"), F.lit(1).alias("side")
    ).unionByName(
        inside.select(F.col("date").alias("at"), F.lit(None).cast("date").alias("as_of_date"), "date", F.lit(0).alias("side"))
    )
    after = (
        Window.orderBy(F.col("at").desc(), F.col("side").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # On the signal date itself the market row sorts after the signal, so only later dates are seen.
    return (
        events.withColumn("effective_date", F.last("date", ignorenulls=True).over(after))
        .filter(F.col("as_of_date").isNotNull() & F.col("effective_date").isNotNull())
        .select("as_of_date", "effective_date")
    )
