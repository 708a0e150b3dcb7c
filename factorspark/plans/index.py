"""Fixed-quantity index segments and chained or monthly rebalanced indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import annual_schedule, distinct_dates, period_end_dates
from ..functions.values import DIVIDEND_AFTER_TAX_RATIO
from ..operators.asof import asof_join
from ..operators.intervals import missing_years
from ..session import durable
from .adjustment import adjusted_marks
from .features import check_price, index_price
from .portfolio import portfolio_nav
from .rules import IntradaySelectionRules, SelectionRules
from .selection import select_constituents, select_intraday_constituents


def cash_events(dividends: DataFrame, date_column: str, symbols: DataFrame | None = None, *,
                require_dates: bool = False) -> DataFrame:
    """Positive after-tax cash per share by the chosen date column."""
    events = dividends.select("symbol", F.col(date_column).alias("date"), F.col("cash_dividend_before_tax").cast("double").alias("_c"))
    if symbols is not None:
        events = events.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if require_dates:
        quality.require_rules(
            events, {f"positive dividend lacks {date_column}": (F.col("_c") > 0) & F.col("date").isNull()}, "dividends"
        )
    return events.filter(F.col("date").isNotNull() & (F.col("_c") > 0)).select(
        "date", "symbol", (F.col("_c") * DIVIDEND_AFTER_TAX_RATIO).alias("cash_per_share")
    )


def check_members(members: DataFrame) -> None:
    quality.require_unique(members, ["segment", "symbol"], "constituents")
    quality.require_empty(quality.weight_violations(members, ["segment"], 1e-5), "constituent weights must be positive and sum to 1")


def index_coverage_gaps(members: DataFrame, dividend_queries: DataFrame) -> DataFrame:
    """Member years from the year before the effective date to the end year without coverage."""
    years = F.sequence(F.year("effective_date") - 1, F.year("end_date"))
    return missing_years(members.select("symbol", F.explode(years).alias("year")), dividend_queries)


def index_segments(price: DataFrame, dividends: DataFrame, members: DataFrame, *,
                   dividend_queries: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Daily price and total returns of fixed-quantity segments.

    ``members`` is (segment, symbol, weight, effective_date, end_date). A member's
    quantity is its weight over its last price at the effective date. The value
    moves only by the price changes of members quoted that day, so suspended
    members need no filled grid: per (segment, date) the changes are summed and
    accumulated over the segment's dates. Cash paid after the effective date is
    credited on the first market date on or after payment.
    """
    prices = index_price(price)
    if validate:
        check_price(prices)
        check_members(members)
        if dividend_queries is not None:
            quality.require_empty(index_coverage_gaps(members, dividend_queries), "Dividend query coverage missing for symbol-years")
    spans = members.select("segment", "effective_date", "end_date").distinct()
    days = spans.select("segment", "effective_date", F.explode(F.sequence("effective_date", "end_date")).alias("day"))
    market = distinct_dates(prices)
    segment_dates = days.join(F.broadcast(market), F.col("day") == F.col("date")).select("segment", "effective_date", "date")

    held = asof_join(
        members, prices.select("symbol", F.col("date").alias("_d"), F.col("close").alias("_p0")), by=["symbol"],
        left_on="effective_date", right_on="_d", values=["_p0"],
    )
    if validate:
        quality.require_rules(held, {"no price on or before the effective date": F.col("_p0").isNull()}, "constituents")
    quantities = held.select("segment", "symbol", "effective_date", "end_date", (F.col("weight") / F.col("_p0")).alias("_q"))

    # Price changes are already partitioned by symbol, so this join moves only the members.
    order = Window.partitionBy("symbol").orderBy("date")
    changes = prices.select("symbol", "date", (F.col("close") - F.lag("close").over(order)).alias("_change"))
    inside = (
        (changes["symbol"] == quantities["symbol"]) & (changes["date"] > quantities["effective_date"]) & (changes["date"] <= quantities["end_date"])
    )
    moved = changes.join(quantities, inside).groupBy("segment", "date").agg(F.sum(F.col("_q") * F.col("_change")).alias("_move"))

    pay_days = asof_join(
        days.filter(F.col("day") > F.col("effective_date")).select("segment", "day"),
        segment_dates.select("segment", F.col("date").alias("_credit")), by=["segment"], left_on="day",
        right_on="_credit", values=["_credit"], direction="forward",
    ).filter(F.col("_credit").isNotNull())
    events = cash_events(dividends, "payment_date")
    due = (
        (events["symbol"] == quantities["symbol"]) & (events["date"] > quantities["effective_date"]) & (events["date"] <= quantities["end_date"])
    )
    credited = (
        events.join(quantities, due)
        .groupBy("segment", F.col("date").alias("day")).agg(F.sum(F.col("_q") * F.col("cash_per_share")).alias("_paid"))
        .join(pay_days, ["segment", "day"])
        .groupBy("segment", F.col("_credit").alias("date")).agg(F.sum("_paid").alias("dividend_cash"))
    )
    base = members.groupBy("segment").agg(F.sum("weight").alias("_base"))
    by_segment = Window.partitionBy("segment").orderBy("date")
    running = by_segment.rowsBetween(Window.unboundedPreceding, 0)
    valued = (
        segment_dates.join(moved, ["segment", "date"], "left").join(credited, ["segment", "date"], "left").join(base, "segment")
        .withColumn("_value", F.col("_base") + F.sum(F.coalesce("_move", F.lit(0.0))).over(running))
        .withColumn("dividend_cash", F.coalesce("dividend_cash", F.lit(0.0)))
    )
    before = F.lag("_value").over(by_segment)
    returns = valued.select(
        "segment", "effective_date", "date", "dividend_cash", "_value",
        F.coalesce(F.col("_value") / before - 1.0, F.lit(0.0)).alias("price_return"),
        F.coalesce((F.col("_value") + F.col("dividend_cash")) / before - 1.0, F.lit(0.0)).alias("total_return"),
    )
    return returns.select(
        "segment", "effective_date", "date", "price_return", "total_return", "dividend_cash",
        (F.col("_value") / F.first("_value").over(by_segment)).alias("price_index"),
        F.product(1.0 + F.col("total_return")).over(running).alias("total_return_index"),
    )


def chain_segments(segments: DataFrame) -> DataFrame:
    """One continuous index: each segment starts from the end of the one before.

    The boundary date is taken from the earlier segment.
    """
    ends = segments.groupBy("segment", "effective_date").agg(
        F.max_by("price_index", "date").alias("_pe"), F.max_by("total_return_index", "date").alias("_te")
    )
    order = Window.orderBy("effective_date")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(
        "segment",
        F.coalesce(F.product("_pe").over(earlier), F.lit(1.0)).alias("_pb"),
        F.coalesce(F.product("_te").over(earlier), F.lit(1.0)).alias("_tb"),
        (F.row_number().over(order) == 1).alias("_first"),
    )
    return (
        segments.join(bases, "segment")
        .filter(F.col("_first") | (F.col("date") > F.col("effective_date")))
        .select(
            "date", "price_return", "total_return", "dividend_cash", (F.col("price_index") * F.col("_pb")).alias("price_index"),
            (F.col("total_return_index") * F.col("_tb")).alias("total_return_index"),
        )
    )


def _once(constituents: DataFrame, written: bool) -> DataFrame:
    """Constituents feed several branches; a validated selection is already written."""
    return constituents if written else durable(constituents, "constituents")


def annual_rebalanced_index(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                            start, end, rules: SelectionRules, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Index rebalanced each December and its constituents by effective date."""
    schedule = annual_schedule(distinct_dates(index_price(price)), start, end)
    constituents = _once(select_constituents(
        price, dividends, dividend_queries, shares, schedule.select("as_of_date"), rules, validate=validate
    ), validate)
    held = constituents.join(F.broadcast(schedule), "as_of_date")
    order = Window.orderBy("effective_date")
    ends = held.select("effective_date").distinct().select(
        "effective_date", F.row_number().over(order).alias("segment"),
        F.coalesce(F.lead("effective_date").over(order), F.to_date(F.lit(str(end)))).alias("end_date"),
    )
    members = held.join(F.broadcast(ends), "effective_date").select("segment", "symbol", "weight", "effective_date", "end_date")
    segments = index_segments(price, dividends, members, dividend_queries=dividend_queries, validate=validate)
    return chain_segments(segments), held


def month_end_as_of(price: DataFrame, start, end) -> DataFrame:
    """``as_of_date`` per month: the last market date inside the inclusive bounds."""
    return period_end_dates(distinct_dates(index_price(price), start=start, end=end)).select(F.col("date").alias("as_of_date"))


def monthly_portfolio(price: DataFrame, constituents: DataFrame, cost_rate: float, factors: DataFrame, coverage: DataFrame, *,
                      validate: bool = True, price_checked: bool = False) -> DataFrame:
    """Portfolio held from each selection date to the next on adjusted closes.

    Half the cost rate is charged per side, the first date is free. ``price_checked``: the selection has checked the price keys.
    """
    weights = constituents.select(F.lit("monthly").alias("portfolio"), F.col("as_of_date").alias("date"), "symbol", "weight")
    dates = constituents.select(F.col("as_of_date").alias("date")).distinct()
    adjusted = adjusted_marks(price, factors, coverage, dates, symbols=constituents, validate=validate, price_checked=price_checked)
    return portfolio_nav(adjusted, weights, dates=dates, fees=cost_rate / 2.0, validate=validate).select(
        "date", "total_return", "total_return_index"
    )


def monthly_index(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame, start, end,
                  rules: SelectionRules, factors: DataFrame, coverage: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Monthly low-volatility dividend portfolio and its constituents."""
    as_of = month_end_as_of(price, start, end)
    constituents = _once(select_constituents(
        price, dividends, dividend_queries, shares, as_of, rules, factors=factors, validate=validate
    ), validate)
    nav = monthly_portfolio(price, constituents, rules.transaction_cost_rate, factors, coverage, validate=validate, price_checked=True)
    return nav, constituents.withColumn("effective_date", F.col("as_of_date"))


def intraday_monthly_index(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                           daily_volatility: DataFrame, start, end, rules: IntradaySelectionRules, factors: DataFrame,
                           coverage: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Monthly portfolio selected by the intraday-volatility factor, and its constituents."""
    as_of = month_end_as_of(price, start, end)
    constituents = _once(select_intraday_constituents(
        price, dividends, dividend_queries, shares, daily_volatility, as_of, rules, validate=validate
    ), validate)
    nav = monthly_portfolio(price, constituents, rules.transaction_cost_rate, factors, coverage, validate=validate, price_checked=True)
    return nav, constituents.withColumn("effective_date", F.col("as_of_date"))


def monthly_index_with_selector(price: DataFrame, selector, as_of: DataFrame, cost_rate: float, factors: DataFrame,
                                coverage: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Monthly portfolio from a caller's selector.

    ``selector(as_of)`` is called once for all dates and returns (as_of_date, symbol, weight, ...).
    """
    constituents = durable(selector(as_of), "constituents")
    return monthly_portfolio(price, constituents, cost_rate, factors, coverage, validate=validate), constituents
