"""Back-adjusted closes from cumulative adjustment events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..operators.asof import asof_adjust_factor, calendar_date_on_or_after
from ..operators.intervals import ranges_cover
from ..session import durable


def uncovered_price_ranges(price: DataFrame, coverage: DataFrame) -> DataFrame:
    """Symbols whose first-to-last price range the coverage does not contain."""
    spans = price.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return ranges_cover(spans, coverage, ["symbol"]).filter("NOT covered")


def check_adjustment(price: DataFrame, factors: DataFrame, coverage: DataFrame, *, price_checked: bool = False,
                     positive: bool = False) -> None:
    """Raise for duplicate, missing or impossible inputs and uncovered price ranges, counted in one job.

    ``price_checked`` says that the keys of the price table are known to be unique, as after a selection from it. With
    ``positive``, closes of zero or less raise too.
    """
    quality.require_columns(price, ["date", "symbol", "close"], "price")
    quality.require_columns(factors, ["symbol", "operate_date", "back_adjust_factor"], "factors")
    quality.require_columns(coverage, ["symbol", "start", "end"], "coverage")
    factor = F.col("back_adjust_factor")
    prices = {"price: date is missing": F.col("date").isNull(), "price: close is missing": F.col("close").isNull()}
    if positive:
        prices["price is not positive"] = F.col("close") <= 0
    counts = [
        quality.count_violations(price, prices),
        quality.count_violations(factors, {
            "factors: operate_date is missing": F.col("operate_date").isNull(),
            "factors: factor is not positive and finite": factor.isNull() | (factor <= 0) | F.isnan(factor) | (factor == F.lit(float("inf"))),
        }),
        quality.count_violations(coverage, {
            "coverage: range is missing": F.col("start").isNull() | F.col("end").isNull(),
            "coverage: start is after end": F.col("start") > F.col("end"),
        }),
        quality.counted(quality.duplicate_keys(factors, ["symbol", "operate_date"]), "factors contains duplicate keys ['symbol', 'operate_date']"),
        quality.counted(quality.duplicate_keys(coverage, ["symbol", "start", "end"]), "coverage contains duplicate keys ['symbol', 'start', 'end']"),
        quality.counted(uncovered_price_ranges(price, coverage), "adjustment-factor coverage does not contain the price range"),
    ]
    if not price_checked:
        counts.append(quality.counted(quality.duplicate_keys(price, ["date", "symbol"]), "price contains duplicate keys ['date', 'symbol']"))
    quality.require_all("adjustment", *counts)


def back_adjusted_close(price: DataFrame, factors: DataFrame, coverage: DataFrame, *, validate: bool = True, price_checked: bool = False) -> DataFrame:
    """Price rows with ``adjusted_close = close * factor`` in force on the date."""
    if validate:
        check_adjustment(price, factors, coverage, price_checked=price_checked)
    return asof_adjust_factor(price, factors).withColumn(
        "adjusted_close", F.col("close").cast("double") * F.col("back_adjust_factor")
    ).drop("back_adjust_factor")


def marking_quotes(price: DataFrame, dates: DataFrame) -> DataFrame:
    """``(date, symbol, close)``: the last quote of each symbol up to each of the ``dates`` that it has since the one before.

    These are all that can be the last known price on one of the dates. They are chosen with map-side combining.
    """
    known = price.filter(F.col("close").isNotNull()).select("date", "symbol", F.col("close").cast("double").alias("close"))
    until = calendar_date_on_or_after(known, dates, "date", "_until").filter("_until IS NOT NULL")
    return until.groupBy("symbol", "_until").agg(F.max(until["date"]).alias("date"), F.max_by("close", until["date"]).alias("close")).select(
        "date", "symbol", "close")


def adjusted_marks(price: DataFrame, factors: DataFrame, coverage: DataFrame, dates: DataFrame, *, symbols: DataFrame | None = None,
                   validate: bool = True, price_checked: bool = False) -> DataFrame:
    """``(date, symbol, close)``: adjusted closes of the ``marking_quotes``, of all symbols or those given, written once.

    A portfolio valued on ``dates`` has the same values on them as on all adjusted closes, and the series are neither sorted nor
    searched for them. All prices are checked, also those that mark nothing.
    """
    if validate:
        check_adjustment(price, factors, coverage, price_checked=price_checked, positive=True)
    if symbols is not None:
        symbols = symbols.select("symbol").distinct()
        price, factors = price.join(symbols, "symbol", "left_semi"), factors.join(symbols, "symbol", "left_semi")
    adjusted = back_adjusted_close(marking_quotes(price, dates), factors, coverage, validate=False)
    return durable(adjusted.select("date", "symbol", F.col("adjusted_close").alias("close")), "marks")
