"""Read views: narrow fact tables joined to their dimensions.

Dimensions map ids to symbols or index codes. How they are joined is left to
adaptive execution, which knows their size in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from .schemas import PB_FACTORS


def stock_daily(facts: DataFrame, securities: DataFrame) -> DataFrame:
    """Daily bars with symbols and the percent change (times one hundred)."""
    change = 100.0 * (F.try_divide(F.col("close").cast("double"), F.col("preclose").cast("double")) - 1.0)
    return facts.join(securities, "security_id").withColumn("pct_chg", change).select(
        "symbol", F.col("trade_date").alias("date"), "open", "high", "low", "close", "preclose", "volume", "amount",
        "turn", "pct_chg", "pe_ttm", "ps_ttm", "pcf_ncf_ttm", "is_st",
    )


def index_daily(facts: DataFrame, indices: DataFrame) -> DataFrame:
    """Index bars; unlike stocks, the change is a plain ratio."""
    change = F.try_divide(F.col("close").cast("double"), F.col("preclose").cast("double")) - 1.0
    return facts.join(indices, "index_id").withColumn("pct_chg", change).select(
        F.col("trade_date").alias("date"), F.col("index_code").alias("symbol"), "open", "high", "low", "close",
        "preclose", "volume", "amount", "turn", "pct_chg", "pe_ttm", "ps_ttm", "pcf_ncf_ttm", "is_st",
    )


def _by_security(facts: DataFrame, securities: DataFrame, *columns) -> DataFrame:
    return facts.join(securities, "security_id").select("symbol", *columns)


def adjust_factors(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(facts, securities, "operate_date", "fore_adjust_factor", "back_adjust_factor", "adjust_factor")


def minute_bars(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(facts, securities, "datetime", "open", "high", "low", "close", "volume", "total_turnover")


def pb_daily(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(facts, securities, F.col("trade_date").alias("date"), *PB_FACTORS)


def dividends(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(
        facts, securities, "announce_date", "record_date", F.col("ex_date").alias("operate_date"), "payment_date",
        "cash_dividend_before_tax",
    )


def share_capital(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(facts, securities, "publish_date", "report_date", "total_shares")


def intraday_volatility(features: DataFrame, status: DataFrame, securities: DataFrame) -> DataFrame:
    """Features with the day status of the first field set, where there is one."""
    known = status.filter("field_set_id = 1").select("security_id", "trade_date", "bar_count", "return_count", "status")
    joined = features.join(known, ["security_id", "trade_date"], "left")
    return _by_security(joined, securities, "trade_date", "volatility", "bar_count", "return_count", "status")


def index_constituents(facts: DataFrame, indices: DataFrame, securities: DataFrame) -> DataFrame:
    return (
        facts.join(indices, "index_id")
        .join(securities, "security_id")
        .select("effective_date", "index_code", "symbol")
    )


def interval_coverage(facts: DataFrame, securities: DataFrame, field_sets: bool = True) -> DataFrame:
    extra = ["field_set_id"] if field_sets else []
    return _by_security(facts, securities, F.col("start_date").alias("start"), F.col("end_date").alias("end"), *extra)


def dividend_coverage(facts: DataFrame, securities: DataFrame) -> DataFrame:
    """Completed before-tax dividend years (field set two)."""
    return _by_security(facts.filter("field_set_id = 2"), securities, F.col("query_year").alias("year"))


def share_capital_coverage(facts: DataFrame, securities: DataFrame) -> DataFrame:
    return _by_security(
        facts, securities, F.col("report_year").alias("year"), F.col("report_quarter").alias("quarter")
    )


def daily_market_cap(bars: DataFrame, shares: DataFrame, securities: DataFrame) -> DataFrame:
    """Close times the latest published share count on or before the trade date."""
    published = shares.filter(F.col("publish_date").isNotNull())
    latest = published.groupBy("security_id", "publish_date").agg(
        F.max_by("total_shares", F.coalesce("report_date", F.lit("9999-12-31").cast("date"))).alias("total_shares")
    )
    joined = asof_join(
        bars.select("security_id", "trade_date", "close"), latest, by=["security_id"], left_on="trade_date",
        right_on="publish_date", values=["publish_date", "total_shares"],
    )
    return _by_security(
        joined, securities, "trade_date", "close", "publish_date", "total_shares",
        (F.col("close") * F.col("total_shares")).alias("total_market_cap"),
    )
