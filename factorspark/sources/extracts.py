"""Cleaning of outside extract files, table to table.

Every cleaner is a projection over an all-text (or loosely typed) frame. Rows
that break a rule are found by the matching ``bad_*`` frame or rule set, so a
whole batch of extracts is checked in one pass instead of file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality, values
from .schemas import PB_FACTORS, dataset

# Field names of the outside extracts.
DAILY_RENAMES = {"peTTM": "pe_ttm", "psTTM": "ps_ttm", "pcfNcfTTM": "pcf_ncf_ttm", "isST": "is_st"}
DAILY_COLUMNS = ["date", "open", "high", "low", "close", "preclose", "volume", "amount", "turn", "pe_ttm", "ps_ttm",
                 "pcf_ncf_ttm", "is_st"]
DAILY_FLOATS = ["open", "high", "low", "close", "preclose", "turn", "pctChg", "peTTM", "psTTM", "pcfNcfTTM"]
DIVIDEND_RENAMES = {
    "dividPlanAnnounceDate": "announce_date", "dividRegistDate": "record_date", "dividOperateDate": "operate_date",
    "dividPayDate": "payment_date", "dividCashPsBeforeTax": "cash_dividend_before_tax",
}
FACTOR_RENAMES = {
    "dividOperateDate": "operate_date", "foreAdjustFactor": "fore_adjust_factor",
    "backAdjustFactor": "back_adjust_factor", "adjustFactor": "adjust_factor",
}
SHARE_RENAMES = {"pubDate": "publish_date", "statDate": "report_date", "totalShare": "total_shares"}
INDEX_RENAMES = {"日期": "date", "指数代码": "symbol", "收盘": "close"}
MINUTE_TIME_COLUMNS = ["datetime", "date", "index", "level_1"]
MINUTE_FIELDS = ["open", "high", "low", "close", "volume", "total_turnover"]
DIVIDEND_DATES = ["announce_date", "record_date", "operate_date", "payment_date"]
FACTOR_VALUES = ["fore_adjust_factor", "back_adjust_factor", "adjust_factor"]


def _with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _present(df: DataFrame, name: str, fallback) -> Column:
    default = F.lit(fallback).cast("string")
    return F.coalesce(F.col(name).cast("string"), default) if name in df.columns else default


def clean_daily_bars(raw: DataFrame) -> DataFrame:
    """Traded rows only, typed; source-only fields dropped."""
    out = raw.filter(F.col("tradestatus").cast("string") == "1") if "tradestatus" in raw.columns else raw
    typed = {"date": values.day("date")}
    typed.update({c: values.number(c).cast("float") for c in DAILY_FLOATS if c in raw.columns})
    if "amount" in raw.columns:
        typed["amount"] = values.number("amount")
    if "isST" in raw.columns:
        typed["isST"] = values.number("isST").cast("boolean")
    if "volume" in raw.columns:
        typed["volume"] = values.number("volume").cast("long")
    return out.withColumns(typed).drop("code", "tradestatus", "adjustflag")


def bad_dividend_cash(raw: DataFrame) -> DataFrame:
    """Rows whose cash amount is neither blank nor a number."""
    text = F.trim(F.col("dividCashPsBeforeTax").cast("string"))
    return raw.filter(text.isNotNull() & (text != "") & text.try_cast("double").isNull())


def clean_dividends(raw: DataFrame, code: str | None = None, year: int | None = None, *, validate: bool = True) -> DataFrame:
    """Dividend events with typed dates; a blank cash amount becomes null."""
    if validate and "dividCashPsBeforeTax" in raw.columns:
        quality.require_empty(bad_dividend_cash(raw).select("dividCashPsBeforeTax"), "Invalid dividend cash values")
    out = _with_missing(raw.withColumnsRenamed(DIVIDEND_RENAMES), ["cash_dividend_before_tax", *DIVIDEND_DATES])
    year_column = F.lit(year) if year is not None else F.col("year")
    return out.select(
        _present(out, "code", code).alias("code"), year_column.cast("int").alias("year"),
        *[values.day(c).alias(c) for c in DIVIDEND_DATES],
        values.number("cash_dividend_before_tax").cast("float").alias("cash_dividend_before_tax"),
    )


def _factor_rules(df: DataFrame) -> dict[str, Column]:
    rules = {"operate_date is missing": F.col("operate_date").isNull()}
    rules.update({f"{c} is not positive": F.col(c).isNull() | (F.col(c) <= 0) for c in FACTOR_VALUES})
    return rules


def clean_adjust_factors(raw: DataFrame, code: str | None = None, *, validate: bool = True) -> DataFrame:
    """Cumulative adjustment events: dated, positive, one per code and date."""
    out = _with_missing(raw.withColumnsRenamed(FACTOR_RENAMES), ["operate_date", *FACTOR_VALUES])
    typed = out.select(
        _present(out, "code", code).alias("code"), values.day("operate_date").alias("operate_date"),
        *[values.number(c).alias(c) for c in FACTOR_VALUES],
    )
    if validate:
        quality.require_rules(typed, _factor_rules(typed), "Adjustment factors")
        quality.require_unique(typed, ["code", "operate_date"], "Adjustment factors")
    return typed


def clean_share_counts(raw: DataFrame, code: str | None = None, year: int | None = None, quarter: int | None = None) -> DataFrame:
    """Published share counts with typed dates; unreadable values become null."""
    out = _with_missing(raw.withColumnsRenamed(SHARE_RENAMES), ["publish_date", "report_date", "total_shares"])
    year_column = F.lit(year) if year is not None else F.col("year")
    quarter_column = F.lit(quarter) if quarter is not None else F.col("quarter")
    return out.select(
        _present(out, "code", code).alias("code"), year_column.cast("int").alias("year"),
        quarter_column.cast("int").alias("quarter"), values.day("publish_date").alias("publish_date"),
        values.day("report_date").alias("report_date"), values.number("total_shares").alias("total_shares"),
    )


def clean_index_history(raw: DataFrame, code: str | None = None) -> DataFrame:
    """Published index closes: three source fields renamed and typed."""
    quality.require_columns(raw, INDEX_RENAMES, "index history")
    out = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in INDEX_RENAMES.items()])
    return out.select(
        F.col("date").cast("timestamp_ntz").cast("date").alias("date"), _present(out, "symbol", code).alias("symbol"),
        values.number("close").alias("close"),
    )


def reshape_pb_panel(raw: DataFrame, symbols: DataFrame | None = None, *, validate: bool = True) -> DataFrame:
    """Valuation panel keyed by source identifiers to (date, symbol) rows.

    ``symbols`` is the requested set; identifiers outside it, unreadable keys and
    duplicates raise.
    """
    id_column = "order_book_id" if "order_book_id" in raw.columns else "level_0"
    date_column = "date" if "date" in raw.columns else "level_1"
    quality.require_columns(raw, [id_column, date_column, *PB_FACTORS], "valuation panel")
    out = raw.select(
        values.day(date_column).alias("date"), values.symbol_from_source(id_column).alias("symbol"),
        *[values.number(f).alias(f) for f in PB_FACTORS],
    )
    if validate:
        quality.require_rules(
            out, {"date is invalid": F.col("date").isNull(), "identifier is invalid": F.col("symbol").isNull()}, "valuation panel"
        )
        quality.require_unique(out, ["date", "symbol"], "valuation panel")
        if symbols is not None:
            extra = out.select("symbol").distinct().join(symbols.select("symbol").distinct(), "symbol", "left_anti")
            quality.require_empty(extra, "valuation panel holds unexpected symbols")
    return out


def reshape_minute_bars(raw: DataFrame, symbols: DataFrame | None = None, *, validate: bool = True) -> DataFrame:
    """Minute extract to (symbol, datetime, fields); the time column may have several names."""
    time_column = next((c for c in MINUTE_TIME_COLUMNS if c in raw.columns), None)
    if time_column is None:
        raise quality.DataQualityError("minute extract has no datetime column")
    id_column = next((c for c in ("order_book_id", "level_0") if c in raw.columns), None)
    quality.require_columns(raw, MINUTE_FIELDS, "minute extract")
    symbol = values.symbol_from_source(id_column) if id_column else F.col("symbol")
    out = raw.select(symbol.alias("symbol"), F.col(time_column).alias("datetime"), *MINUTE_FIELDS)
    if validate and symbols is not None:
        extra = out.select("symbol").distinct().join(symbols.select("symbol").distinct(), "symbol", "left_anti")
        quality.require_empty(extra, "minute extract holds unexpected symbols")
    return out


def listing_rules() -> dict[str, Column]:
    listed, delisted = F.col("listed_date").cast("string"), F.col("de_listed_date").cast("string")
    open_ended = delisted.isNull() | delisted.isin("0000-00-00", "")
    return {
        "listed_date is invalid": F.coalesce(listed != "2999-12-31", F.lit(True)) & values.day(listed).isNull(),
        "de_listed_date is invalid": ~open_ended & values.day(delisted).isNull(),
    }


def listed_between(instruments: DataFrame, start, end, *, validate: bool = True) -> DataFrame:
    """Distinct symbols listed on or before ``end`` and not yet delisted at ``start``."""
    if validate:
        quality.require_rules(instruments, listing_rules(), "instrument list")
    first, last = F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end)))
    listed, delisted = F.col("listed_date").cast("string"), F.col("de_listed_date").cast("string")
    listed_at = values.day(F.when(listed != "2999-12-31", listed))
    open_ended = delisted.isNull() | delisted.isin("0000-00-00", "")
    alive = (listed_at <= last) & (open_ended | (values.day(delisted) > first))
    return instruments.filter(alive).select(values.symbol_from_source("order_book_id").alias("symbol")).distinct()


def changed_snapshots(history: DataFrame, code: str) -> DataFrame:
    """Members of the dates whose member set differs from the date before.

    A set changes exactly when some symbol enters or leaves, so the sets are never
    collected: each symbol's dates are numbered against the history dates, and a
    break in that run marks the entry date or the date after leaving. A date
    without any member (null symbol) is invalid; see ``empty_snapshots``.
    """
    members = history.filter(F.col("symbol").isNotNull()).select("date", "symbol").distinct()
    dates = history.select("date").distinct().select(
        "date", F.row_number().over(Window.orderBy("date")).alias("_i"),
        F.max("date").over(Window.partitionBy()).alias("_last"),
    )
    placed = members.join(F.broadcast(dates), "date")
    run = Window.partitionBy("symbol").orderBy("_i")
    marked = placed.select(
        "date", "symbol", "_i", "_last",
        F.coalesce(F.lag("_i").over(run), F.lit(-1)).alias("_before"),
        F.coalesce(F.lead("_i").over(run), F.lit(-1)).alias("_after"),
    )
    entries = marked.filter(F.col("_before") != F.col("_i") - 1).select("_i")
    exits = marked.filter((F.col("_after") != F.col("_i") + 1) & (F.col("date") < F.col("_last"))).select(
        (F.col("_i") + 1).alias("_i")
    )
    changes = entries.unionByName(exits).distinct().join(dates, "_i").select("date")
    return members.join(F.broadcast(changes), "date").select(
        F.col("date").alias("effective_date"), F.lit(code).alias("index_code"), "symbol"
    )


def empty_snapshots(history: DataFrame) -> DataFrame:
    return history.groupBy("date").agg(F.count("symbol").alias("members")).filter("members = 0").select("date")


def prepare_daily_columns(df: DataFrame) -> DataFrame:
    """The stored daily columns in order, absent ones as null."""
    out = df.withColumnsRenamed(DAILY_RENAMES)
    keys = [c for c in ("symbol", "index_code") if c in out.columns]
    kinds = {f.name: f.dataType for f in dataset("stock_daily").schema.fields}
    kinds |= {c: kinds["date"] for c in ("trade_date",)}
    absent = {c: F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in DAILY_COLUMNS if c not in out.columns}
    return out.select(*keys, *[absent[c] if c in absent else F.col(c) for c in DAILY_COLUMNS])


def prepare_adjust_factors(df: DataFrame, *, validate: bool = True) -> DataFrame:
    """Write-side form of adjustment events."""
    quality.require_columns(df, ["operate_date", *FACTOR_VALUES], "Adjustment factors")
    keys = [c for c in ("symbol",) if c in df.columns]
    out = df.select(*keys, values.day("operate_date").alias("operate_date"), *[values.number(c).alias(c) for c in FACTOR_VALUES])
    if validate:
        quality.require_rules(out, _factor_rules(out), "Adjustment factors")
        quality.require_unique(out, [*keys, "operate_date"], "Adjustment factors")
    return out


def prepare_pb(df: DataFrame, *, validate: bool = True) -> DataFrame:
    """Write-side form of valuation rows."""
    quality.require_columns(df, ["date", "symbol", *PB_FACTORS], "PB data")
    out = df.select(
        values.day("date").alias("date"), values.security_symbol("symbol").alias("symbol"),
        *[values.number(f).alias(f) for f in PB_FACTORS],
    )
    if validate:
        quality.require_rules(
            out, {"date is missing": F.col("date").isNull(), "symbol is invalid": F.col("symbol").isNull()}, "PB data"
        )
        quality.require_unique(out, ["date", "symbol"], "PB data")
    return out


def prepare_index_daily(df: DataFrame, sequence: str, keys: list[str] | None = None, *, validate: bool = True) -> DataFrame:
    """Write-side index bars: the last row of each date by the ingest sequence."""
    quality.require_columns(df, ["date", "close", sequence], "Index daily data")
    out = df.withColumnsRenamed(DAILY_RENAMES).withColumns({"date": values.day("date"), "close": values.number("close")})
    if validate:
        quality.require_rules(
            out, {"date is missing": F.col("date").isNull(), "close is missing": F.col("close").isNull()}, "Index daily data"
        )
    group = [*(keys or []), "date"]
    rest = [c for c in out.columns if c not in (*group, sequence)]
    last = out.groupBy(*group).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_r"))
    return last.select(*group, *[F.col("_r")[c].alias(c) for c in rest])


def share_rules() -> dict[str, Column]:
    raw = F.col("total_shares")
    parsed = values.finite(raw.try_cast("double"))
    return {
        "total_shares is not a number": raw.isNotNull() & parsed.isNull(),
        "total_shares is negative": parsed < 0,
        "total_shares is not whole": F.abs(parsed - F.round(parsed)) > 1e-6,
        "total_shares is too large": parsed >= F.lit(2.0**63),
    }


def prepare_share_capital(df: DataFrame, *, validate: bool = True) -> DataFrame:
    """Whole non-negative share counts; rows without a report date are dropped."""
    if validate:
        quality.require_rules(df, share_rules(), "Share capital")
    keys = [c for c in ("symbol",) if c in df.columns]
    return df.filter(F.col("report_date").isNotNull()).select(
        *keys, "publish_date", "report_date",
        F.round(values.finite(F.col("total_shares").try_cast("double"))).try_cast("long").alias("total_shares"),
    )
