"""Valuation-spread timing of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import period_end_dates
from ..functions.values import finite
from ..operators import cross_section, series
from ..operators.asof import asof_snapshot_date
from ..session import durable
from .rules import TimingRules


def valid_pb(price: DataFrame, pb_factor: str) -> DataFrame:
    """Rows with a finite positive ratio and its reciprocal."""
    ratio = finite(pb_factor)
    return price.select("date", "symbol", ratio.alias("pb")).filter(F.col("pb") > 0).withColumn("bp", 1.0 / F.col("pb"))


def month_end_members(price: DataFrame, constituents: DataFrame, rules: TimingRules) -> DataFrame:
    """Last valid ratio of each (month, symbol), marked by membership at the valuation date.

    The valuation date is the last date of the month in the price table; the
    snapshot in force is the last one effective on or before it.
    """
    snapshots = constituents.filter(F.col("index_code") == rules.index_code)
    valuation = asof_snapshot_date(period_end_dates(price).select(F.col("period").alias("month"), "date"), snapshots)
    monthly = series.last_in_month(valid_pb(price, rules.pb_factor)).select("month", "symbol", "bp")
    placed = monthly.join(F.broadcast(valuation), "month")
    member = snapshots.select("effective_date", "symbol", F.lit(True).alias("_member")).distinct()
    return placed.join(member, ["effective_date", "symbol"], "left").select(
        "date", "effective_date", "symbol", "bp", F.coalesce("_member", F.lit(False)).alias("is_member")
    )


def check_spread_inputs(price: DataFrame, constituents: DataFrame, rules: TimingRules) -> None:
    quality.require_columns(price, ["date", "symbol", rules.pb_factor], "price")
    quality.require_columns(constituents, ["effective_date", "index_code", "symbol"], "constituents")
    quality.require_rules(price, {"date is missing": F.col("date").isNull()}, "price")
    quality.require_rules(constituents, {"effective_date is missing": F.col("effective_date").isNull()}, "constituents")
    quality.require_unique(price.select("date", "symbol"), ["date", "symbol"], "price")
    quality.require_unique(constituents, ["effective_date", "index_code", "symbol"], "constituents")
    early = period_end_dates(price).agg(F.min("date").alias("d")).first()["d"]
    first = constituents.filter(F.col("index_code") == rules.index_code).agg(F.min("effective_date").alias("d")).first()["d"]
    if first is None:
        raise quality.DataQualityError(f"No constituent snapshots found for {rules.index_code}")
    if early is not None and first > early:
        raise quality.DataQualityError(f"No constituent snapshot is available at {early}")


def bp_spread(price: DataFrame, constituents: DataFrame, rules: TimingRules, *, validate: bool = True) -> DataFrame:
    """Monthly trimmed mean of members minus non-members, its lower band and signal.

    Months in which one side is empty raise with ``validate`` and are absent without.
    """
    if validate:
        check_spread_inputs(price, constituents, rules)
    # One row a month and symbol, read some times.
    cells = durable(month_end_members(price, constituents, rules), "valuation-cells")
    sides = cross_section.trimmed_mean(
        cells, ["date", "effective_date", "is_member"], "bp", rules.trim_ratio
    )
    member = F.col("is_member")
    wide = sides.groupBy("date", "effective_date").agg(
        *[
            F.max(F.when(member if inside else ~member, F.col(column))).alias(name)
            for inside, column, name in [
                (True, "row_count", "constituent_count"), (False, "row_count", "non_constituent_count"),
                (True, "trimmed_count", "constituent_trimmed_count"), (False, "trimmed_count", "non_constituent_trimmed_count"),
                (True, "trimmed_mean", "bp_low"), (False, "trimmed_mean", "bp_high"),
            ]
        ]
    )
    if validate:
        quality.require_rules(
            wide, {"no constituent value remains": F.col("bp_low").isNull(), "no non-constituent value remains": F.col("bp_high").isNull()},
            "valuation spread",
        )
    spread = wide.withColumn("bp_spread", F.col("bp_low") - F.col("bp_high")).filter(F.col("bp_spread").isNotNull())
    return series.lower_band(spread, "bp_spread", rules.band_window_months, rules.band_std_multiplier).select(
        "date", F.col("effective_date").alias("constituent_effective_date"), "constituent_count", "non_constituent_count",
        "constituent_trimmed_count", "non_constituent_trimmed_count", "bp_low", "bp_high", "bp_spread", "lower_band", "bearish_signal",
    )


def check_timing_inputs(signal: DataFrame, benchmark: DataFrame) -> None:
    month = F.date_trunc("MONTH", "date")
    quality.require_rules(
        signal, {"date is missing": F.col("date").isNull(), "signal is missing": F.col("bearish_signal").isNull()}, "signal"
    )
    quality.require_unique(signal.select(month.alias("month")), ["month"], "signal")
    quality.require_unique(benchmark.select("date"), ["date"], "benchmark")
    quality.require_rules(benchmark, {"benchmark is not positive": F.col("close") <= 0}, "benchmark")
    have = benchmark.filter("close IS NOT NULL").select(month.alias("month")).distinct()
    quality.require_empty(signal.select(month.alias("month")).join(have, "month", "left_anti"), "Benchmark is missing signal months")


def timing_backtest(signal: DataFrame, benchmark: DataFrame, *, validate: bool = True) -> DataFrame:
    """Each month-end signal applied to the following month's benchmark return.

    A bearish month earns nothing in the cash variant and the negated return in the
    short variant. Inputs are one row per month after the benchmark is reduced.
    """
    if validate:
        check_timing_inputs(signal, benchmark)
    month = F.date_trunc("MONTH", F.col("date")).cast("date")
    monthly = benchmark.filter("close IS NOT NULL").groupBy(month.alias("_month")).agg(
        F.max_by(F.col("close").cast("double"), F.col("date")).alias("_close")
    )
    order = Window.orderBy("date")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = signal.select("date", "bearish_signal", month.alias("_month")).join(monthly, "_month").select(
        "date",
        F.lag("date").over(order).alias("signal_date"),
        (F.col("_close") / F.lag("_close").over(order) - 1.0).alias("benchmark_return"),
        series.previous_flag("bearish_signal", order).alias("bearish_position"),
    )
    bearish = F.col("bearish_position")
    variants = placed.withColumns({
        "cash_timing_return": F.when(bearish, F.lit(0.0)).otherwise(F.col("benchmark_return")),
        "short_timing_return": F.when(bearish, -F.col("benchmark_return")).otherwise(F.col("benchmark_return")),
    })
    navs = {
        f"{name}_nav": F.product(1.0 + F.coalesce(F.col(f"{name}_return"), F.lit(0.0))).over(running)
        for name in ("benchmark", "cash_timing", "short_timing")
    }
    return variants.withColumns(navs)


def signal_hits(timing: DataFrame) -> DataFrame:
    """Months held bearish, their signal date and return, and whether it fell."""
    return timing.filter("bearish_position").select(
        "date", "signal_date", "benchmark_return", F.coalesce(F.col("benchmark_return") < 0, F.lit(False)).alias("hit")
    )


def next_month_returns(timing: DataFrame) -> DataFrame:
    """Benchmark return of the month after each row's date."""
    return timing.select("date", F.lead("benchmark_return").over(Window.orderBy("date")).alias("next_return"))
