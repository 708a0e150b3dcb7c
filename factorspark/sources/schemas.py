"""Declared schemas of the stored datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "date": T.DateType(), "time": T.TimestampNTZType(), "text": T.StringType(), "float": T.FloatType(),
    "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "bool": T.BooleanType(),
}


def struct(spec: str) -> T.StructType:
    """Struct type from ``name kind, name kind`` text."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


@dataclass(frozen=True)
class Dataset:
    """One stored table: its columns, key, date column and loading rules."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    required: tuple[str, ...]
    date_column: str | None = None
    requires_dates: bool = False
    normalize_symbols: bool = True
    allowed_symbols: tuple[str, ...] = ()
    relation: str = ""
    partition_by: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def folder(self) -> str:
        return self.relation or self.name


_BAR = ("date date, symbol text, open float, high float, low float, close {close}, preclose float, volume long, "
        "amount double, turn float, pct_chg double, pe_ttm float, ps_ttm float, pcf_ncf_ttm float, is_st bool")

PB_FACTORS = ["pb_ratio_lf", "pb_ratio_lyr", "pb_ratio_ttm", "pb_ratio_1_lf", "pb_ratio_1_lyr", "pb_ratio_1_ttm"]

_ALL = [
    Dataset("stock_daily", struct(_BAR.format(close="float")), ("date", "symbol"),
            ("date", "symbol", "close", "amount", "pe_ttm"), "date", True),
    Dataset("stock_adjust_factor",
            struct("symbol text, operate_date date, fore_adjust_factor double, back_adjust_factor double, adjust_factor double"),
            ("symbol", "operate_date"), ("symbol", "operate_date", "back_adjust_factor"), "operate_date"),
    Dataset("stock_adjust_factor_coverage", struct("symbol text, start date, end date"),
            ("symbol", "start", "end"), ("symbol", "start", "end")),
    Dataset("stock_pb_daily", struct("date date, symbol text, " + ", ".join(f"{f} double" for f in PB_FACTORS)),
            ("date", "symbol"), ("date", "symbol"), "date", True),
    Dataset("stock_minute_1m",
            struct("symbol text, datetime time, open float, high float, low float, close float, volume double, total_turnover double"),
            ("symbol", "datetime"), ("symbol", "datetime", "close"), "datetime", True),
    Dataset("intraday_volatility_daily",
            struct("symbol text, trade_date date, volatility float, bar_count int, return_count int, status int"),
            ("symbol", "trade_date"), ("symbol", "trade_date"), "trade_date", True),
    Dataset("index_daily", struct(_BAR.format(close="double")), ("date", "symbol"), ("date", "symbol", "close"),
            "date", True, normalize_symbols=False),
    Dataset("csindex_daily", struct("date date, symbol text, close double"), ("date", "symbol"),
            ("date", "symbol", "close"), "date", True, normalize_symbols=False,
            allowed_symbols=("H30269", "H20269"), relation="index_daily"),
    Dataset("index_constituents", struct("effective_date date, index_code text, symbol text"),
            ("effective_date", "index_code", "symbol"), ("effective_date", "index_code", "symbol"), "effective_date"),
    Dataset("dividend",
            struct("symbol text, announce_date date, record_date date, operate_date date, payment_date date, cash_dividend_before_tax float"),
            ("symbol", "announce_date", "record_date", "operate_date", "payment_date", "cash_dividend_before_tax"),
            ("symbol", "announce_date", "cash_dividend_before_tax"), "announce_date"),
    Dataset("dividend_queries", struct("symbol text, year int"), ("symbol", "year"), ("symbol", "year")),
    Dataset("stock_profit_quarterly", struct("symbol text, publish_date date, report_date date, total_shares long"),
            ("symbol", "report_date"), ("symbol", "publish_date", "total_shares"), "publish_date"),
    Dataset("stock_profit_quarterly_queries", struct("symbol text, year int, quarter int"),
            ("symbol", "year", "quarter"), ("symbol", "year", "quarter")),
]
DATASETS = {dataset.name: dataset for dataset in _ALL}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"Unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name]
