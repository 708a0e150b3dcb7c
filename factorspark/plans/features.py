"""Per-quote features of every security, from one shuffle on the symbol.

Quotes, share publications, dividend announcements and adjustment events of a
symbol are put in one frame and answered by windows over it, instead of joining
each event table; trailing means and deviations follow from the sorted quotes in numpy. Every source is first reduced to one row per (symbol, date), so
a symbol's rows are bounded by a few times the days of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.calendar import market_calendar
from ..functions.values import DIVIDEND_AFTER_TAX_RATIO, finite, is_finite
from ..operators.asof import valid_shares

#: Quotes of one task of the feature windows, about: a task that held 485,000 quotes with their events took 512 MB before.
ROWS_PER_TASK = 500_000


def valid_price(price: DataFrame) -> DataFrame:
    """Rows with a finite positive close; amounts and ratios that are not finite, and negative amounts, become null."""
    amount = finite("amount")
    return price.filter(finite("close") > 0).select(
        "date", "symbol", F.col("close").cast("double").alias("close"), F.when(amount >= 0, amount).alias("amount"),
        finite("pe_ttm").alias("pe_ttm"),
    )


def index_price(price: DataFrame) -> DataFrame:
    """Rows with a finite close."""
    return price.filter(is_finite("close")).select("date", "symbol", F.col("close").cast("double").alias("close"))


def check_price(price: DataFrame) -> None:
    quality.require_unique(price.select("date", "symbol"), ["date", "symbol"], "price")


def daily_cash(dividends: DataFrame) -> DataFrame:
    """Before-tax cash per (symbol, announcement date), combined before the shuffle."""
    known = dividends.filter(F.col("announce_date").isNotNull() & is_finite("cash_dividend_before_tax"))
    return known.groupBy("symbol", "announce_date").agg(F.sum(F.col("cash_dividend_before_tax").cast("double")).alias("cash"))


def tasks_for(rows: int, least: int) -> int | None:
    """Tasks for a shuffle of ``rows`` rows, so that none gets more than about ROWS_PER_TASK; None where ``least`` tasks do."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > least else None


def _event(df: DataFrame, date: str, kind: int, **values: Column) -> DataFrame:
    columns = {
        "close": "double", "amount": "double", "pe_ttm": "double", "market_index": "int", "publish_date": "date",
        "total_shares": "double", "factor": "double", "cash": "double", "wanted": "boolean",
    }
    return df.select(
        "symbol", F.col(date).alias("date"), F.lit(kind).alias("kind"),
        *[(values[name] if name in values else F.lit(None)).cast(kind_).alias(name) for name, kind_ in columns.items()],
    )


def _sums(values: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sum of the values of each window ``first:after`` from its own values alone; zero for an empty one."""
    if not len(first):
        return values[:0]
    ends = np.stack([first, np.maximum(first, after)], axis=1).ravel()
    return np.where(first < after, np.add.reduceat(np.append(values, values.dtype.type(0)), ends)[::2], values.dtype.type(0))


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of doubles, zero for null, and which are not null."""
    known = np.asarray(column.is_valid())
    return np.where(known, column.to_numpy(zero_copy_only=False), 0.0), known


def _means(values: np.ndarray, known: np.ndarray, first: np.ndarray, after: np.ndarray) -> pa.Array:
    """Mean of the non-null values of each window, null without one."""
    n = _sums(known.astype(np.int64), first, after)
    return pa.array(_sums(np.where(known, values, 0.0), first, after) / np.maximum(n, 1), mask=n == 0)


def _deviations(values: np.ndarray, known: np.ndarray, last: np.ndarray, length: int, full: np.ndarray) -> pa.Array:
    """Sample deviation of the non-null values of the ``length`` rows up to each ``last``, where it is ``full``; null below two values."""
    out, empty = np.zeros(len(last)), np.ones(len(last), bool)
    if full.any():
        rows = last[full, None] + np.arange(1 - length, 1)
        known, values = known[rows], values[rows]
        # From the first value on, so that equal values deviate by exactly zero.
        away = np.where(known, values - np.take_along_axis(values, known.argmax(axis=1)[:, None], 1), 0.0)
        n = known.sum(axis=1)
        away = np.where(known, away - (away.sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
        out[full], empty[full] = np.sqrt((away * away).sum(axis=1) / np.maximum(n - 1, 1)), n < 2
    return pa.array(out, mask=empty)


def _begins(symbols: pa.Array) -> np.ndarray:
    """Whether each symbol differs from the one before; the first does."""
    differ = pc.not_equal(symbols.slice(1), symbols.slice(0, len(symbols) - 1)).fill_null(True)
    both = pc.and_(symbols.slice(1).is_null(), symbols.slice(0, len(symbols) - 1).is_null())
    return np.concatenate([[True], np.asarray(pc.and_not(differ, both))])


def _whole_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by symbol in batches that are cut where a symbol begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_begins(batch["symbol"]))
        if held and held[-1]["symbol"][-1].as_py() == batch["symbol"][0].as_py():
            starts = starts[1:]
        if held and len(starts):
            yield pa.concat_batches([*held, batch.slice(0, starts[-1])])
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _january(years: np.ndarray) -> np.ndarray:
    return (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)


def _answers(cap_lookback: int, dividend_years: int, yield_lookback: int, volatility_lookback: int | None,
             columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (symbol, day, kind) the wanted quotes with their features, and quotes that repeat a day as ``_again``."""

    def seen(marked: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Place of the last marked row of the symbol up to each row, -1 without one."""
        place = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
        return np.where(place >= start, place, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_symbols(batches):
            begins = _begins(batch["symbol"])
            kind, dated = np.asarray(batch["kind"]), np.asarray(batch["date"].is_valid())
            day = np.asarray(batch["date"].cast(pa.int32()).fill_null(-(1 << 31))).astype(np.int64)
            group = np.cumsum(begins)
            start = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
            again = np.zeros(len(kind), bool)
            again[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & (day[1:] == day[:-1]) & dated[1:] & ~begins[1:]

            # From here on the valid quotes, in order of symbol and market date.
            quote = np.flatnonzero((kind == 3) & np.asarray(batch["market_index"].is_valid()))
            close = _doubles(batch["close"])[0][quote]
            held = seen(kind == 0, start)[quote]
            shares = _doubles(batch["total_shares"])[0][held]
            factor, known = _doubles(batch["factor"])
            at = seen((kind == 2) & known, start)[quote]
            adjusted = close * np.where(at >= 0, factor[at], 1.0)
            cap = close * shares

            paid = np.flatnonzero(kind == 1)
            cash, paid_key = _doubles(batch["cash"])[0][paid], group[paid] * (1 << 34) + day[paid]
            def announced(of, low, high):
                """After-tax cash of the symbols from the day ``low`` up to ``high`` inclusive."""
                return DIVIDEND_AFTER_TAX_RATIO * _sums(cash, np.searchsorted(paid_key, of + low), np.searchsorted(paid_key, of + high, "right"))

            base = group[quote] * (1 << 34)
            ttm = announced(base, day[quote] - 364, day[quote])
            yielded = ttm / close
            number = group[quote]
            new = np.concatenate([[True], number[1:] != number[:-1]]) if len(quote) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(quote)), 0)) if len(quote) else np.zeros(0, np.int64)
            before = np.where(new, 0.0, np.roll(adjusted, 1))
            returned = ~new & (before != 0)
            change = np.where(returned, adjusted / np.where(returned, before, 1.0) - 1.0, 0.0)

            last = np.flatnonzero(np.asarray(batch["wanted"].fill_null(False))[quote])
            place = last - first[last]
            key = number * (1 << 34) + np.asarray(batch["market_index"].fill_null(0)).astype(np.int64)[quote]
            low, high = np.searchsorted(key, key[last] - (cap_lookback - 1)), np.searchsorted(key, key[last], "right")
            rows = np.maximum(last - (yield_lookback - 1), first[last])
            amount, amounts = (v[quote] for v in _doubles(batch["amount"]))
            mean = _means(yielded, np.ones(len(quote), bool), rows, last + 1)

            source = quote[last]
            own, of = batch.take(pa.array(source)), base[last]
            none = held[last] < 0
            publication = pa.array(held[last], mask=none)
            year = day[source].astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
            made = {name: own[name] for name in ("symbol", "date", "market_index", "close", "amount", "pe_ttm")} | {
                "publish_date": batch["publish_date"].take(publication), "total_shares": batch["total_shares"].take(publication),
                "total_market_cap": pa.array(cap[last], mask=none), "adjusted_close": pa.array(adjusted[last]),
                "dividend_cash_ttm": pa.array(ttm[last]), "dividend_yield_ttm": pa.array(yielded[last]),
                "observation_count": pa.array((place + 1).astype(np.int32)),
                "avg_market_cap_240d": _means(cap, held >= 0, low, high), "avg_amount_240d": _means(amount, amounts, low, high),
                "avg_dividend_yield_3y": pa.array(np.asarray(mean.fill_null(0.0)), mask=place + 1 < yield_lookback),
                "_again": pa.array(again[source]), "_wanted": pa.array(np.ones(len(last), bool)),
            }
            for back in range(dividend_years + 1):
                made[f"cash_year_{back}"] = pa.array(announced(of, _january(year - back), np.minimum(_january(year - back + 1) - 1, day[source])))
            if volatility_lookback is not None:
                made["volatility_240d"] = _deviations(change, returned, last, volatility_lookback - 1, place + 1 >= volatility_lookback)
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], names=columns)
            again[source] = False
            if again.any():
                left = batch.filter(pa.array(again))
                more = {"symbol": left["symbol"], "date": left["date"], "_again": pa.array(np.ones(len(left), bool)), "_wanted": pa.array(np.zeros(len(left), bool))}
                yield pa.RecordBatch.from_arrays([more[c] if c in more else pa.nulls(len(left), made[c].type) for c in columns], names=columns)

    return run


def quote_features(
    price: DataFrame,
    dividends: DataFrame,
    shares: DataFrame,
    *,
    cap_lookback: int,
    dividend_years: int,
    yield_lookback: int,
    volatility_lookback: int | None = None,
    factors: DataFrame | None = None,
    calendar: DataFrame | None = None,
    watch: quality.Watch | None = None,
    as_of: DataFrame | None = None,
) -> DataFrame:
    """One row per valid quote, or valid quote on one of the ``as_of`` dates if given, with everything selection needs at that date.

    Columns: market cap from the latest published shares; quote number and market
    date number; mean cap and amount over the last market dates; trailing-year
    cash and yield; the yield's mean over the last quotes; after-tax cash of this
    year so far and of each of the ``dividend_years`` years before; and the return
    volatility over the last quotes, on adjusted closes when ``factors`` is given.

    With ``watch``, repeated (date, symbol) rows of the price table, valid or not, are counted where they meet anyway.
    """
    quotes = valid_price(price)
    calendar = market_calendar(quotes) if calendar is None else calendar
    if watch is not None:
        # Rows without a usable close come along for their keys, and are dropped by their market number below.
        usable = finite("close") > 0
        amount = finite("amount")
        quotes = price.select("date", "symbol", F.when(usable, F.col("close").cast("double")).alias("close"),
                              F.when(usable & (amount >= 0), amount).alias("amount"), F.when(usable, finite("pe_ttm")).alias("pe_ttm"))
    days = F.broadcast(calendar.select("date", "market_index"))
    numbered = quotes.join(days, "date", "left" if watch is not None else "inner")
    if as_of is None:
        numbered = numbered.withColumn("wanted", F.lit(True))
    else:
        at = as_of.select(F.col("as_of_date").alias("date")).distinct().withColumn("wanted", F.lit(True))
        numbered = numbered.join(F.broadcast(at), "date", "left")
    parts = [
        _event(valid_shares(shares), "publish_date", 0, publish_date=F.col("publish_date"), total_shares=F.col("total_shares")),
        _event(daily_cash(dividends), "announce_date", 1, cash=F.col("cash")),
        _event(numbered, "date", 3, close=F.col("close"), amount=F.col("amount"), pe_ttm=F.col("pe_ttm"),
              market_index=F.when(F.col("close").isNotNull(), F.col("market_index")), wanted=F.col("wanted")),
    ]
    if factors is not None:
        parts.append(_event(factors, "operate_date", 2, factor=F.col("back_adjust_factor")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # Windows hold a task's rows sorted, so tasks follow the number of quotes, not the session's number of partitions. Where that
    # would do, adaptive execution must not merge it into fewer and larger tasks.
    count, least = price.count(), int(price.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks_for(count, least)
    if tasks is None and count > ROWS_PER_TASK:
        tasks = least
    both = both.repartition("symbol") if tasks is None else both.repartition(tasks, "symbol")

    # A symbol's rows lie behind each other in order, so arrays answer for all quotes of many symbols at once; frames of the window
    # operator add up all of their rows again for every row, wanted or not.
    kinds = {"symbol": "string", "date": "date", "market_index": "int", **dict.fromkeys(["close", "amount", "pe_ttm"], "double"), "publish_date": "date",
             **dict.fromkeys(["total_shares", "total_market_cap", "adjusted_close", "dividend_cash_ttm"], "double"),
             **{f"cash_year_{back}": "double" for back in range(dividend_years + 1)}, "dividend_yield_ttm": "double", "observation_count": "int",
             **dict.fromkeys(["avg_market_cap_240d", "avg_amount_240d", "avg_dividend_yield_3y"], "double")}
    if volatility_lookback is not None:
        kinds["volatility_240d"] = "double"
    kinds |= {"_again": "boolean", "_wanted": "boolean"}
    out = both.sortWithinPartitions("symbol", "date", "kind").mapInArrow(
        _answers(cap_lookback, dividend_years, yield_lookback, volatility_lookback, list(kinds)), ", ".join(f"{c} {k}" for c, k in kinds.items()))
    if watch is not None:
        key = ["date", "symbol"]
        out = watch.watch(out, {"duplicate keys ['date', 'symbol']": F.col("_again")}, "price",
                          lambda: quality.duplicate_keys(price, key).select(*key))
    return out.filter("_wanted").drop("_again", "_wanted")


def shifted_year(date: Column) -> Column:
    """One on or after 21 December, when the required years move on, else zero."""
    return F.when((F.month(date) == 12) & (F.dayofmonth(date) >= 21), 1).otherwise(0)


def _year_value(offset: Column, dividend_years: int) -> Column:
    """After-tax cash of the year ``offset`` years back, from the columns cash_year_k."""
    columns = F.array(*[F.col(f"cash_year_{k}") for k in range(dividend_years + 1)])
    return F.get(columns, offset)


def with_dividend_quality(features: DataFrame, dividend_years: int) -> DataFrame:
    """Continuity flag, growth slope and payout ratio of each quote row.

    The slope is least squares over the years up to this year, if cash was already
    announced this year, else up to last year; slopes within 1e-12 of zero are zero.
    """
    shift = shifted_year(F.col("date"))
    positive = [_year_value(F.lit(back) - shift, dividend_years) > 0 for back in range(1, dividend_years + 1)]
    continuous = positive[0]
    for condition in positive[1:]:
        continuous = continuous & condition
    announced = F.when(F.col("cash_year_0") > 0, 1).otherwise(0)
    centre = (dividend_years - 1) / 2
    spread = sum((x - centre) ** 2 for x in range(dividend_years))
    slope = F.lit(0.0)
    for x in range(dividend_years):
        back = F.lit(dividend_years - x) - announced
        slope = slope + F.lit((x - centre) / spread) * _year_value(back, dividend_years)
    return features.select(
        "*",
        continuous.alias("consecutive_dividends"),
        F.when(F.abs(slope) <= 1e-12, 0.0).otherwise(slope).alias("dividend_growth_slope"),
        (F.col("dividend_yield_ttm") * F.col("pe_ttm")).alias("payout_ratio"),
    )
