"""Point-in-time sample space and dividend-quality universe, for all dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import market_calendar
from ..operators import cross_section
from ..operators.asof import calendar_date_on_or_after
from ..operators.intervals import missing_years
from ..session import durable
from .features import check_price, quote_features, shifted_year, valid_price, with_dividend_quality
from .rules import UniverseRules


def build_universe(price: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    """Distinct (date, symbol) rows with optional inclusive bounds and symbols."""
    out = price.select("date", "symbol")
    if symbols is not None:
        if isinstance(symbols, DataFrame):
            out = out.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        else:
            out = out.filter(F.col("symbol").isin([str(s) for s in symbols]))
    if start is not None:
        out = out.filter(F.col("date") >= F.to_date(F.lit(str(start))))
    if end is not None:
        out = out.filter(F.col("date") <= F.to_date(F.lit(str(end))))
    return out.distinct().withColumn("in_universe", F.lit(True))


def history_counts(price: DataFrame, as_of: DataFrame, minimum: int) -> DataFrame:
    """``(as_of_date, symbol)`` with at least ``minimum`` positive closes by that date.

    The count reaches the minimum on the symbol's ``minimum``-th quote, so the first
    as-of date on or after that quote and all later ones qualify. As-of dates are
    numbered and the numbers spread, so no quotes are compared with as-of dates.
    """
    order = Window.partitionBy("symbol").orderBy("date")
    reached = (
        price.filter(F.col("close") > 0).select("date", "symbol")
        .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == minimum)
        .select("symbol", F.col("date").alias("_from"))
    )
    dates = as_of.select("as_of_date").distinct().select(
        "as_of_date", F.row_number().over(Window.orderBy("as_of_date")).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_last"),
    )
    first = calendar_date_on_or_after(
        reached, dates.select(F.col("as_of_date").alias("date")), "_from", "as_of_date"
    ).filter(F.col("as_of_date").isNotNull())
    spread = first.join(F.broadcast(dates), "as_of_date").select(
        "symbol", F.explode(F.sequence("_i", F.col("_last").cast("int"))).alias("_i")
    )
    return spread.join(F.broadcast(dates), "_i").select("as_of_date", "symbol")


def snapshot(features: DataFrame, as_of: DataFrame) -> DataFrame:
    """The feature rows of the as-of dates, written once: selection reads them several times and all features run once."""
    at = F.broadcast(as_of.select(F.col("as_of_date").alias("date")).distinct())
    return durable(features.join(at, "date"), "market-snapshot")


def market_filter(features: DataFrame, as_of: DataFrame, rules: UniverseRules, history: int) -> DataFrame:
    """Quotes on as-of dates in the top cap and amount shares with enough history.

    As-of dates before the full market window yield nothing; ``unfit_as_of`` lists them.
    """
    return _market_filter(snapshot(features, as_of), rules, history)


def _market_filter(rows: DataFrame, rules: UniverseRules, history: int) -> DataFrame:
    flagged = cross_section.flag_top_ratios(rows.filter(F.col("market_index") >= rules.lookback_days), ["date"], {
        "_cap": ("avg_market_cap_240d", rules.market_cap_keep_ratio), "_amount": ("avg_amount_240d", rules.amount_keep_ratio)})
    return flagged.filter(F.col("_cap") & F.col("_amount") & (F.col("observation_count") >= history)).drop("_cap", "_amount")


def unfit_as_of(calendar: DataFrame, as_of: DataFrame, rules: UniverseRules) -> DataFrame:
    """``(as_of_date, reason)`` of the as-of dates that no universe can be built for, from the numbered market dates."""
    quoted = calendar.select(F.col("date").alias("as_of_date"), F.col("market_index").alias("_i"))
    reason = F.when(F.col("_i").isNull(), F.lit("no quotes")).when(F.col("_i") < rules.lookback_days, F.lit("market window is not full"))
    return (
        as_of.select("as_of_date").distinct().join(quoted, "as_of_date", "left")
        .select("as_of_date", reason.alias("reason")).filter("reason IS NOT NULL")
    )


def required_years(passed: DataFrame, dividend_years: int) -> DataFrame:
    """Distinct (symbol, year) pairs whose dividend queries the filters rely on."""
    last = F.year("date") - 1 + shifted_year(F.col("date"))
    return passed.select("symbol", F.explode(F.sequence(last - (dividend_years - 1), last)).alias("year")).distinct()


def coverage_gaps(passed: DataFrame, dividend_queries: DataFrame, dividend_years: int) -> DataFrame:
    return missing_years(required_years(passed, dividend_years), dividend_queries)


def dividend_filter(passed: DataFrame, rules: UniverseRules) -> DataFrame:
    """Continuous payers without the highest payouts, negative payout or falling cash.

    The payout cut is taken over the continuous payers with a known payout.
    """
    continuous = with_dividend_quality(passed, rules.dividend_years).filter("consecutive_dividends")
    cut = cross_section.flag_top_ratio(
        continuous, ["date"], "payout_ratio", rules.payout_exclude_ratio, "_high"
    )
    return cut.filter(
        (F.col("payout_ratio") >= 0) & (F.col("dividend_growth_slope") >= 0) & ~F.col("_high")
    ).drop("_high")


def dividend_universe(
    price: DataFrame,
    dividends: DataFrame,
    dividend_queries: DataFrame,
    shares: DataFrame,
    as_of: DataFrame,
    rules: UniverseRules,
    history: int,
    *,
    features: DataFrame | None = None,
    rows: DataFrame | None = None,
    watch: quality.Watch | None = None,
    calendar: DataFrame | None = None,
    validate: bool = True,
) -> DataFrame:
    """Universe rows of every as-of date.

    ``features`` may be passed when already computed (``quote_features``, with their ``watch``), or stored ``rows`` of the as-of
    dates. With ``validate``, duplicate prices, unfit as-of dates and missing dividend coverage raise; prices are checked while
    the features are computed where they have a watch.
    """
    if validate:
        calendar = market_calendar(valid_price(price)) if calendar is None else calendar
        quality.require_empty(unfit_as_of(calendar, as_of, rules), "no universe on some as-of dates")
    if rows is None:
        if features is None:
            watch = quality.Watch() if validate else None
            features = quote_features(
                price, dividends, shares, cap_lookback=rules.lookback_days, dividend_years=rules.dividend_years,
                yield_lookback=history, watch=watch, as_of=as_of,
            )
        elif validate and watch is None:
            check_price(price)
        rows = snapshot(features, as_of)
    if watch is not None:
        watch.require()
    passed = _market_filter(rows, rules, history)
    if validate:
        # The check and the rest read the same rows.
        passed = durable(passed, "market-filter")
        quality.require_empty(
            coverage_gaps(passed, dividend_queries, rules.dividend_years), "years without a dividend query"
        )
    return dividend_filter(passed, rules)
