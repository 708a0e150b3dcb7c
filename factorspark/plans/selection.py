"""Candidate and constituent selection for all as-of dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import market_calendar
from ..operators import cross_section, intraday
from ..operators.asof import asof_shares
from ..session import durable
from .features import quote_features, valid_price
from .rules import IntradaySelectionRules, SelectionRules
from .universe import dividend_universe

CANDIDATE_COLUMNS = [
    "symbol", "as_of_date", "price_date", "avg_market_cap_240d", "avg_amount_240d", "dividend_yield_ttm", "payout_ratio",
    "dividend_growth_slope", "avg_dividend_yield_3y", "dividend_yield_rank",
]
CONSTITUENT_COLUMNS = [
    "symbol", "as_of_date", "price_date", "avg_market_cap_240d", "avg_amount_240d", "dividend_yield_ttm", "payout_ratio",
    "dividend_growth_slope", "avg_dividend_yield_3y", "volatility_240d", "dividend_yield_rank", "volatility_rank", "weight",
]
INTRADAY_CONSTITUENT_COLUMNS = [
    "symbol", "as_of_date", "price_date", "avg_market_cap_240d", "avg_amount_240d", "dividend_yield_ttm", "payout_ratio",
    "dividend_growth_slope", "avg_dividend_yield_3y", "dividend_yield_rank", "intraday_volatility_cv", "log_market_cap",
    "minute_return_volatility", "volatility_rank", "weight",
]


def selection_features(price: DataFrame, dividends: DataFrame, shares: DataFrame, rules: SelectionRules | IntradaySelectionRules,
                       factors: DataFrame | None = None, watch: quality.Watch | None = None, as_of: DataFrame | None = None,
                       calendar: DataFrame | None = None) -> DataFrame:
    """Quote features with the windows the rules need, on the ``as_of`` dates if given; volatility on adjusted closes if given factors."""
    return quote_features(
        price, dividends, shares, cap_lookback=rules.universe.lookback_days, dividend_years=rules.universe.dividend_years,
        yield_lookback=rules.dividend_yield_lookback_days,
        volatility_lookback=getattr(rules, "volatility_lookback_days", None), factors=factors, watch=watch, as_of=as_of, calendar=calendar,
    )


def rank_candidates(universe: DataFrame, rules: SelectionRules | IntradaySelectionRules) -> DataFrame:
    """Top names by mean trailing yield on each as-of date."""
    ranked = cross_section.topk_n(
        universe.filter(F.col("avg_dividend_yield_3y").isNotNull()), ["date"],
        [F.col("avg_dividend_yield_3y").desc(), F.col("symbol").asc()], rules.dividend_top_n, "dividend_yield_rank",
    )
    return ranked.withColumns({"as_of_date": F.col("date"), "price_date": F.col("date")})


def select_candidates(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                      as_of: DataFrame, rules: SelectionRules | IntradaySelectionRules, *, features: DataFrame | None = None,
                      watch: quality.Watch | None = None, calendar: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Dividend-ranked candidates of every as-of date, with every feature column."""
    if features is None:
        watch = quality.Watch() if validate else None
        features = selection_features(price, dividends, shares, rules, watch=watch, as_of=as_of)
    universe = dividend_universe(
        price, dividends, dividend_queries, shares, as_of, rules.universe, rules.dividend_yield_lookback_days,
        features=features, watch=watch, calendar=calendar, validate=validate,
    )
    return rank_candidates(universe, rules)


def weigh(candidates: DataFrame, metric: str, final_n: int) -> DataFrame:
    """Lowest ``final_n`` by metric, weighted by mean yield; short dates are left out."""
    picked = cross_section.topk_n(
        candidates.filter(F.col(metric).isNotNull()), ["as_of_date"], [F.col(metric).asc(), F.col("symbol").asc()],
        final_n, "volatility_rank",
    )
    # After the cut a date holds at most final_n rows, still partitioned by date.
    date = Window.partitionBy("as_of_date")
    summed = picked.withColumns({
        "_total": F.sum("avg_dividend_yield_3y").over(date), "_picked": F.count(F.lit(1)).over(date)
    })
    return summed.filter((F.col("_picked") == final_n) & (F.col("_total") > 0)).withColumn(
        "weight", F.col("avg_dividend_yield_3y") / F.col("_total")
    ).drop("_total", "_picked")


def select_constituents(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                        as_of: DataFrame, rules: SelectionRules, *, factors: DataFrame | None = None,
                        features: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Lowest-volatility candidates with yield weights, for every as-of date.

    With ``validate``, as-of dates that cannot be filled raise; otherwise they are
    absent and listed by ``shortfalls``.
    """
    watch = calendar = None
    if features is None:
        watch = quality.Watch() if validate else None
        calendar = durable(market_calendar(valid_price(price)), "calendar")
        features = selection_features(price, dividends, shares, rules, factors, watch, as_of, calendar)
    candidates = select_candidates(
        price, dividends, dividend_queries, shares, as_of, rules, features=features, watch=watch, calendar=calendar, validate=validate
    )
    chosen = weigh(candidates, "volatility_240d", rules.final_n).select(*CONSTITUENT_COLUMNS)
    if validate:
        chosen = durable(chosen, "constituents")
        require_filled(chosen, as_of, rules.final_n)
    return chosen


def select_intraday_candidates(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                               daily_volatility: DataFrame, as_of: DataFrame, rules: IntradaySelectionRules, *,
                               features: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Candidates joined one to one with their neutralized intraday factor.

    With ``validate``, as-of dates with fewer than ``final_n`` of them raise.
    """
    candidates = durable(select_candidates(
        price, dividends, dividend_queries, shares, as_of, rules, features=features, validate=validate
    ), "candidates")
    members = candidates.select("as_of_date", "symbol")
    # Only the candidates' own series are needed from here on.
    quotes = valid_price(price).select("symbol", "date", "close").join(members.select("symbol").distinct(), "symbol", "left_semi")
    caps = asof_shares(quotes, shares.join(members.select("symbol").distinct(), "symbol", "left_semi")).select(
        "symbol", F.col("date").alias("trade_date"), "total_market_cap"
    )
    factor = durable(intraday.volatility_factor(
        daily_volatility, caps, as_of, lookback=rules.lookback_trading_days, min_valid=rules.min_valid_days, members=members,
        finite_only=rules.finite_only, validate=validate,
    ), "intraday-factor")
    joined = candidates.join(factor, ["as_of_date", "symbol"])
    if validate:
        require_filled(joined, as_of, rules.final_n)
    return joined


def select_intraday_constituents(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                                 daily_volatility: DataFrame, as_of: DataFrame, rules: IntradaySelectionRules, *,
                                 features: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Candidates with the lowest neutralized intraday factor and yield weights."""
    candidates = select_intraday_candidates(
        price, dividends, dividend_queries, shares, daily_volatility, as_of, rules, features=features, validate=validate,
    )
    chosen = weigh(candidates, "minute_return_volatility", rules.final_n).select(*INTRADAY_CONSTITUENT_COLUMNS)
    if validate:
        chosen = durable(chosen, "constituents")
        require_filled(chosen, as_of, rules.final_n)
    return chosen


def shortfalls(selection: DataFrame, as_of: DataFrame, final_n: int) -> DataFrame:
    """As-of dates that did not get their full number of names."""
    counts = selection.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("selected"))
    return (
        as_of.select("as_of_date").distinct().join(counts, "as_of_date", "left")
        .withColumn("selected", F.coalesce("selected", F.lit(0)))
        .filter(F.col("selected") < final_n)
    )


def require_filled(selection: DataFrame, as_of: DataFrame, final_n: int) -> None:
    quality.require_empty(
        shortfalls(selection, as_of, final_n), f"as-of dates with fewer than {final_n} eligible symbols"
    )
