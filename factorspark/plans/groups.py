"""Factor group portfolios, long-short series and information coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import market_calendar
from ..functions import quality
from ..operators.cross_section import information_coefficients, quintile_groups, too_small
from ..session import durable
from .adjustment import adjusted_marks
from .features import valid_price
from .index import month_end_as_of
from .portfolio import portfolio_nav, with_marks
from .rules import IntradaySelectionRules, SelectionRules
from .selection import select_intraday_candidates, selection_features
from .universe import dividend_universe


def equal_weights(members: DataFrame) -> DataFrame:
    """Equal weights within each (portfolio, date), from one row per group and date."""
    sizes = members.groupBy("portfolio", "date").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return members.select("portfolio", "date", "symbol").join(F.broadcast(sizes), ["portfolio", "date"])


def group_navs(prices: DataFrame, grouped: DataFrame, *, groups: int = 5, validate: bool = True) -> DataFrame:
    """``(pool, group, date, total_return, nav)`` for every group and the long-short series.

    ``grouped`` is (pool, date, symbol, group). Group zero is group one minus the
    last group, compounded from its return differences.
    """
    members = grouped.select(
        F.concat_ws("#", "pool", "group").alias("portfolio"), "date", "symbol"
    )
    dates = grouped.select("date").distinct()
    nav = portfolio_nav(prices, equal_weights(members), dates=dates, validate=validate)
    returns = nav.select(
        F.substring_index("portfolio", "#", 1).alias("pool"), F.substring_index("portfolio", "#", -1).cast("int").alias("group"),
        "date", "total_return",
    )
    spread = long_short(returns, groups)
    order = Window.partitionBy("pool", "group").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.unionByName(spread).withColumn("nav", F.product(1.0 + F.col("total_return")).over(order))


def long_short(returns: DataFrame, groups: int = 5) -> DataFrame:
    """Return of group one minus the last group, as group zero."""
    difference = F.sum(
        F.when(F.col("group") == 1, F.col("total_return")).when(F.col("group") == groups, -F.col("total_return")).otherwise(0.0)
    )
    return returns.groupBy("pool", "date").agg(difference.alias("total_return")).select(
        "pool", F.lit(0).alias("group"), "date", "total_return"
    )


def factor_ic(prices: DataFrame, grouped: DataFrame, *, finite_only: bool = True) -> DataFrame:
    """``(pool, date, ic, rank_ic)`` of the factor against the return to the next date.

    The last date has no next return and is left out.
    """
    dates = market_calendar(grouped.select("date").distinct())
    held = grouped.select("pool", "date", "symbol", "factor").join(F.broadcast(dates.select("date", "next_date")), "date")
    marked = with_marks(held.filter("next_date IS NOT NULL"), prices)
    pairs = marked.select("pool", "date", "factor", (F.col("next_price") / F.col("price") - 1.0).alias("forward_return"))
    return information_coefficients(pairs, ["pool", "date"], finite_only=finite_only)


def traditional_groups(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame, as_of: DataFrame,
                       rules: SelectionRules, factors: DataFrame, *, validate: bool = True) -> DataFrame:
    """``(pool, date, symbol, factor, group)`` by trailing return volatility.

    Pool ``all_a`` holds every symbol quoted on the date with a full lookback; pool
    ``dividend_pool`` the dividend universe without yield ranking.
    """
    calendar = durable(market_calendar(valid_price(price)), "calendar")
    # Both pools read the as-of rows only, so these are written once.
    watch = quality.Watch() if validate else None
    features = durable(selection_features(price, dividends, shares, rules, factors, watch, as_of, calendar), "features")
    columns = ["date", "symbol", F.col("volatility_240d").alias("factor")]
    everything = features.select(F.lit("all_a").alias("pool"), *columns)
    universe = dividend_universe(
        price, dividends, dividend_queries, shares, as_of, rules.universe, rules.dividend_yield_lookback_days,
        rows=features, watch=watch, calendar=calendar, validate=validate,
    ).select(F.lit("dividend_pool").alias("pool"), *columns)
    return _grouped(everything.unionByName(universe), as_of, ["all_a", "dividend_pool"], validate)


def unfit_pools(rows: DataFrame, as_of: DataFrame, pools: list[str], groups: int = 5, *, finite_only: bool = True) -> DataFrame:
    """``(pool, date, names)`` of the dates on which a pool has fewer finite factors (or factors at all) than groups, or no row."""
    wanted = as_of.select(F.col("as_of_date").alias("date")).distinct().withColumn("pool", F.explode(F.array(*map(F.lit, pools))))
    counted = wanted.join(rows.select("pool", "date", "factor"), ["pool", "date"], "left")
    return too_small(counted, ["pool", "date"], groups, "factor", finite_only=finite_only)


def _grouped(rows: DataFrame, as_of: DataFrame, pools: list[str], validate: bool, finite_only: bool = True) -> DataFrame:
    if validate:
        rows = durable(rows, "pools")
        quality.require_empty(unfit_pools(rows, as_of, pools, finite_only=finite_only), "pools with fewer names than groups")
    return quintile_groups(rows, ["pool", "date"], "factor", finite_only=finite_only)


def traditional_marked_groups(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame, start, end,
                              rules: SelectionRules, factors: DataFrame, coverage: DataFrame, *,
                              validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adjusted closes that mark the groups of the volatility factor in both pools, and the groups: what their values and coefficients are made of."""
    as_of = month_end_as_of(price, start, end)
    grouped = durable(traditional_groups(
        price, dividends, dividend_queries, shares, as_of, rules, factors, validate=validate
    ), "groups")
    return adjusted_marks(price, factors, coverage, grouped.select("date").distinct(), validate=validate, price_checked=True), grouped


def traditional_group_indices(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame, start, end,
                              rules: SelectionRules, factors: DataFrame, coverage: DataFrame, *,
                              validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Group values and coefficients of the volatility factor in both pools."""
    prices, grouped = traditional_marked_groups(
        price, dividends, dividend_queries, shares, start, end, rules, factors, coverage, validate=validate)
    return group_navs(prices, grouped, validate=validate), factor_ic(prices, grouped)


def intraday_groups(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                    daily_volatility: DataFrame, as_of: DataFrame, rules: IntradaySelectionRules, *,
                    validate: bool = True) -> DataFrame:
    """``(pool, date, symbol, factor, group)`` by the neutralized intraday factor of the candidates."""
    candidates = select_intraday_candidates(
        price, dividends, dividend_queries, shares, daily_volatility, as_of, rules, validate=validate
    )
    rows = candidates.select(
        F.lit("candidates").alias("pool"), F.col("as_of_date").alias("date"), "symbol",
        F.col("minute_return_volatility").alias("factor"),
    )
    return _grouped(rows, as_of, ["candidates"], validate, rules.finite_only)


def intraday_marked_groups(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                           daily_volatility: DataFrame, start, end, rules: IntradaySelectionRules, factors: DataFrame,
                           coverage: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adjusted closes that mark the groups of the intraday factor inside the candidates, and the groups."""
    as_of = month_end_as_of(price, start, end)
    grouped = durable(intraday_groups(
        price, dividends, dividend_queries, shares, daily_volatility, as_of, rules, validate=validate
    ), "groups")
    return adjusted_marks(price, factors, coverage, grouped.select("date").distinct(), symbols=grouped, validate=validate, price_checked=True), grouped


def intraday_group_indices(price: DataFrame, dividends: DataFrame, dividend_queries: DataFrame, shares: DataFrame,
                           daily_volatility: DataFrame, start, end, rules: IntradaySelectionRules, factors: DataFrame,
                           coverage: DataFrame, *, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Group values and coefficients of the intraday factor inside the candidates."""
    prices, grouped = intraday_marked_groups(
        price, dividends, dividend_queries, shares, daily_volatility, start, end, rules, factors, coverage, validate=validate)
    return group_navs(prices, grouped, validate=validate), factor_ic(prices, grouped, finite_only=rules.finite_only)
