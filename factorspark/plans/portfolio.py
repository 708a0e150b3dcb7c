"""Target-weight portfolios: returns and values, with costs, in set form.

Between two valuation dates every holding grows by its price ratio. Trades at a
date follow from the drifted and the target weights of each holding, so returns
are sums over holdings. Post-trade weights are taken as the targets; a simulator
that fills orders one by one leaves its last purchases short by the cost of the
trade, so with costs its *next* return differs by the order of fee times turnover.
Without costs the two agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import market_calendar
from ..operators.asof import asof_join
from ..session import durable
from .rules import lies_in


def holdings_by_date(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """Weights in force on every valuation date, with that date and the next one.

    A weight set stays the target until the portfolio's next set. Valuation dates
    are numbered, and a set is spread over its numbers, so no range join is needed.
    ``dates`` is a calendar of the valuation dates.
    """
    numbered = dates.select(
        "date", "market_index", "next_date", F.max("market_index").over(Window.partitionBy()).alias("_last")
    )
    sets = weights.select("portfolio", "date").distinct().join(F.broadcast(numbered), "date")
    upcoming = F.lead("market_index").over(Window.partitionBy("portfolio").orderBy("market_index"))
    until = sets.withColumn("_until", F.coalesce(upcoming - 1, F.col("_last")))
    spans = until.select(
        "portfolio", F.col("date").alias("set_date"), F.explode(F.sequence("market_index", "_until")).alias("market_index")
    ).join(F.broadcast(numbered.select("date", "market_index", "next_date")), "market_index").drop("market_index")
    held = weights.filter(F.col("weight") > 0).select("portfolio", F.col("date").alias("set_date"), "symbol", "weight")
    # One row for each portfolio and valuation date.
    return held.join(F.broadcast(spans), ["portfolio", "set_date"]).drop("set_date")


def with_marks(holdings: DataFrame, prices: DataFrame, column: str = "close") -> DataFrame:
    """Last known price of each holding on its date and on the next valuation date.

    Each wanted (symbol, date) is looked up once, whatever the number of portfolios.
    """
    wanted = holdings.select("symbol", F.explode(F.array("date", "next_date")).alias("at")).filter("at IS NOT NULL").distinct()
    # Series of symbols never held are dropped before the shuffle where the held set is small.
    held = prices.join(wanted.select("symbol").distinct(), "symbol", "left_semi")
    known = held.filter(F.col(column).isNotNull()).select("symbol", F.col("date").alias("_d"), F.col(column).cast("double").alias("_price"))
    marks = asof_join(wanted, known, by=["symbol"], left_on="at", right_on="_d", values=["_price"])
    now = marks.select("symbol", F.col("at").alias("date"), F.col("_price").alias("price"))
    after = marks.select("symbol", F.col("at").alias("next_date"), F.col("_price").alias("next_price"))
    return holdings.join(now, ["symbol", "date"], "left").join(after, ["symbol", "next_date"], "left")


def check_weights(weights: DataFrame, prices: DataFrame, valuation: DataFrame) -> None:
    """Raise once for negative, repeated or incomplete weights and for unknown symbols and dates, counted in one job."""
    totals = weights.groupBy("portfolio", "date").agg(F.sum("weight").alias("total"))
    unknown = weights.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_anti")
    off = weights.select("date").distinct().join(valuation, "date", "left_anti")
    quality.require_all(
        "target weights",
        quality.count_violations(weights, {"weight is negative": F.col("weight") < 0}),
        quality.counted(quality.duplicate_keys(weights, ["portfolio", "date", "symbol"]), "repeated (portfolio, date, symbol)"),
        quality.counted(totals.filter(F.abs(F.col("total") - 1.0) > 1e-10), "weights of a portfolio and date that do not sum to 1"),
        quality.counted(unknown, "symbols without a price"),
        quality.counted(off, "dates that are not valuation dates"),
    )


def portfolio_nav(
    prices: DataFrame,
    weights: DataFrame,
    *,
    dates: DataFrame | None = None,
    fees: float | DataFrame = 0.0,
    slippage: float = 0.0,
    execution_price: DataFrame | None = None,
    init_cash: float = 1_000_000.0,
    validate: bool = True,
) -> DataFrame:
    """``(portfolio, date, total_return, value, total_return_index)``.

    ``prices`` is (date, symbol, close) and is carried forward over gaps; ``weights``
    is (portfolio, date, symbol, weight). ``dates`` are the valuation dates (default:
    all price dates); weights are re-targeted on each. A scalar fee spares the first
    valuation date; a fee table is (date, symbol, fee) and must cover every trade.
    ``execution_price`` is (date, symbol, price).
    """
    numbers = {"slippage": (slippage, "[0, 1)"), "init_cash": (init_cash, "(0, inf)")}
    if not isinstance(fees, DataFrame):
        numbers["fees"] = (fees, "[0, 1)")
    for name, (value, interval) in numbers.items():
        if not lies_in(value, interval):
            raise ValueError(f"{name} is {value}, allowed: {interval}")
    if "portfolio" not in weights.columns:
        weights = weights.withColumn("portfolio", F.lit("portfolio"))
    # Both feed several branches below.
    weights = durable(weights, "weights")
    valuation = durable(market_calendar(prices if dates is None else dates), "dates")
    watch = quality.Watch()
    if validate:
        check_weights(weights, prices, valuation)
        prices = watch.watch(prices, {"price is not positive": F.col("close") <= 0}, "prices")

    holdings = holdings_by_date(weights, valuation)
    if execution_price is None:
        marked = with_marks(holdings, prices).withColumn("_close_ratio", F.lit(1.0))
    else:
        marked = with_marks(holdings, execution_price, "price")
        closes = with_marks(holdings, prices).select("portfolio", "date", "symbol", F.col("price").alias("_close"))
        marked = marked.join(closes, ["portfolio", "date", "symbol"]).withColumn("_close_ratio", F.col("_close") / F.col("price"))
    if validate:
        marked = watch.watch(marked, {"price is missing while held": F.col("price").isNull()}, "portfolio")
    marked = durable(marked, "marked")
    watch.require()
    grown = F.when(F.col("next_date").isNotNull(), F.col("weight") * F.col("next_price") / F.col("price"))

    free = not isinstance(fees, DataFrame) and fees == 0.0 and slippage == 0.0
    per_date = marked.groupBy("portfolio", "date", "next_date").agg(
        F.sum(grown).alias("_growth"), F.sum(F.col("weight") * F.col("_close_ratio")).alias("_close_ratio")
    )
    grown_to = per_date.select("portfolio", F.col("next_date").alias("date"), "_growth").filter("date IS NOT NULL")
    steps = per_date.select("portfolio", "date", "_close_ratio").join(grown_to, ["portfolio", "date"], "left")
    if free:
        steps = steps.withColumn("_kept", F.lit(1.0))
    else:
        steps = steps.join(_cost_factors(marked, grown, grown_to, fees, slippage, valuation), ["portfolio", "date"])
    steps = steps.withColumn("_step", F.coalesce("_growth", F.lit(1.0)) * F.col("_kept")).select(
        "portfolio", "date", "_step", "_close_ratio"
    )

    # Valuation dates before a portfolio's first weights hold cash.
    firsts = weights.groupBy("portfolio").agg(F.min("date").alias("date")).join(
        F.broadcast(valuation.select("date", "market_index")), "date"
    )
    idle = firsts.filter("market_index > 1").select(
        "portfolio", F.explode(F.sequence(F.lit(1), F.col("market_index") - 1)).alias("market_index")
    ).join(F.broadcast(valuation.select("date", "market_index")), "market_index").select(
        "portfolio", "date", F.lit(1.0).alias("_step"), F.lit(1.0).alias("_close_ratio")
    )
    order = Window.partitionBy("portfolio").orderBy("date")
    valued = steps.unionByName(idle).withColumn(
        "value",
        F.lit(float(init_cash)) * F.product("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)) * F.col("_close_ratio"),
    )
    before = F.coalesce(F.lag("value").over(order), F.lit(float(init_cash)))
    return valued.select(
        "portfolio", "date", (F.col("value") / before - 1.0).alias("total_return"), "value",
        (F.col("value") / F.first("value").over(order)).alias("total_return_index"),
    )


def _cost_factors(marked: DataFrame, grown, grown_to: DataFrame, fees, slippage: float, valuation: DataFrame) -> DataFrame:
    """Share of the value left after the trades of each (portfolio, date).

    Sales are executed in full; purchases share the cash that the sales bring.
    """
    drifted = marked.filter("next_date IS NOT NULL").select(
        "portfolio", F.col("next_date").alias("date"), "symbol", grown.alias("_drift"), F.lit(0.0).alias("_target")
    )
    targets = marked.select("portfolio", "date", "symbol", F.lit(0.0).alias("_drift"), F.col("weight").alias("_target"))
    cells = drifted.unionByName(targets).groupBy("portfolio", "date", "symbol").agg(
        F.sum("_drift").alias("_drift"), F.sum("_target").alias("_target")
    )
    cells = cells.join(grown_to, ["portfolio", "date"], "left").withColumn(
        "_now", F.coalesce(F.col("_drift") / F.col("_growth"), F.lit(0.0))
    )
    if isinstance(fees, DataFrame):
        table = fees.select("date", "symbol", F.col("fee").cast("double").alias("_fee"))
        cells = cells.join(table, ["date", "symbol"], "left").withColumn(
            "_fee", F.coalesce("_fee", F.raise_error(F.lit("fees must cover all dates and symbols")).cast("double"))
        )
    else:
        index = valuation.select("date", "market_index")
        cells = cells.join(F.broadcast(index), "date").withColumn(
            "_fee", F.when(F.col("market_index") == 1, F.lit(0.0)).otherwise(F.lit(float(fees)))
        )
    sold = F.greatest(F.col("_now") - F.col("_target"), F.lit(0.0))
    bought = F.greatest(F.col("_target") - F.col("_now"), F.lit(0.0))
    totals = cells.groupBy("portfolio", "date").agg(
        F.sum("_now").alias("_held"),
        F.sum(F.least("_now", "_target")).alias("_base"),
        F.sum(sold * (1 - F.col("_fee")) * (1 - slippage)).alias("_proceeds"),
        F.sum(bought).alias("_wanted"),
        F.sum(bought * (1 + F.col("_fee")) * (1 + slippage)).alias("_cost"),
    )
    funds = (1.0 - F.col("_held")) + F.col("_proceeds")
    placed = F.when(F.col("_cost") > funds, F.try_divide(F.col("_wanted") * funds, F.col("_cost"))).otherwise(
        F.col("_wanted") + funds - F.col("_cost")
    )
    return totals.select("portfolio", "date", (F.col("_base") + placed).alias("_kept"))


def returns_matrix_to_long(df: DataFrame, date: str, series: list[str]) -> DataFrame:
    """Wide return columns to (series_id, date, r) rows."""
    return df.unpivot([date], series, "series_id", "r").withColumnRenamed(date, "date")
