"""Performance statistics of return series kept as (series_id, date, r) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..operators.cross_section import annual_icir


def _drawdowns(returns: DataFrame) -> DataFrame:
    order = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    navs = returns.withColumn("_nav", F.product(1.0 + F.col("r")).over(order))
    return navs.withColumn("_dd", F.col("_nav") / F.max("_nav").over(order) - 1.0)


def calc_metrics(returns: DataFrame, benchmark: DataFrame | None = None, periods_per_year: int = 252, *,
                 validate: bool = True) -> DataFrame:
    """Annual return, volatility, their ratio and the worst drawdown per series.

    With a ``benchmark`` of (date, r): mean active return and tracking error over the
    common dates. A series is one row per date, so its window is calendar-bounded.
    """
    kept = returns.filter(F.col("r").isNotNull() & ~F.isnan("r")).select("series_id", "date", F.col("r").cast("double").alias("r"))
    if validate and kept.limit(1).count() == 0:
        raise quality.DataQualityError("returns is empty")
    periods = float(periods_per_year)
    grouped = _drawdowns(kept).groupBy("series_id").agg(
        (F.pow(F.product(1.0 + F.col("r")), F.lit(periods) / F.count(F.lit(1))) - 1.0).alias("annual_return"),
        (F.stddev_pop("r") * F.sqrt(F.lit(periods))).alias("annual_vol"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
    )
    out = grouped.select(
        "series_id", "annual_return", "annual_vol",
        F.when(F.col("annual_vol") != 0, F.try_divide("annual_return", "annual_vol")).alias("sharpe"), "max_drawdown", "win_rate",
    )
    if benchmark is None:
        return out
    active = align_inner(kept, benchmark).groupBy("series_id").agg(
        (F.avg(F.col("r") - F.col("benchmark_r")) * periods).alias("excess_return"),
        (F.stddev_pop(F.col("r") - F.col("benchmark_r")) * F.sqrt(F.lit(periods))).alias("tracking_error"),
    )
    return out.join(active, "series_id", "left")


def align_inner(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Series rows with the benchmark return of the same date."""
    other = benchmark.filter(F.col("r").isNotNull()).select("date", F.col("r").cast("double").alias("benchmark_r"))
    return returns.join(other, "date")


def win_rate(value: str = "r") -> Column:
    """Share of non-null periods with a positive return."""
    return F.avg((F.col(value) > 0).cast("double"))


def performance_table(returns: DataFrame, ic: DataFrame | None = None, periods_per_year: int = 12) -> DataFrame:
    """Five statistics per series, with mean and annualized coefficients per pool when given.

    ``ic`` is (series_id, date, ic, rank_ic).
    """
    table = calc_metrics(returns, periods_per_year=periods_per_year, validate=False).select(
        "series_id", "annual_return", "annual_vol", F.col("sharpe").alias("information_ratio"),
        F.col("win_rate").alias("monthly_win_rate"), (-F.col("max_drawdown")).alias("max_drawdown"),
    )
    if ic is None:
        return table
    complete = ic.filter(F.col("ic").isNotNull() & F.col("rank_ic").isNotNull())
    stats = complete.groupBy("series_id").agg(
        F.avg("ic").alias("ic_mean"), annual_icir("ic").alias("icir"),
        F.avg("rank_ic").alias("rank_ic_mean"), annual_icir("rank_ic").alias("rank_icir"),
    )
    return table.join(stats, "series_id", "left")


def rebase_curves(curves: DataFrame) -> DataFrame:
    """Values on the dates all series share, divided by each series' first value.

    ``curves`` is (series_id, date, value) with one row per series and date.
    """
    kept = curves.filter(F.col("value").isNotNull())
    wanted = kept.agg(F.count_distinct("series_id").alias("n")).first()["n"]
    shared = kept.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == wanted).select("date")
    order = Window.partitionBy("series_id").orderBy("date")
    return kept.join(F.broadcast(shared), "date").select(
        "series_id", "date", (F.col("value") / F.first("value").over(order)).alias("value")
    )
