"""Date-range operators: merging, sweeps over endpoints, gaps, coverage and work planning.

Ranges are first reduced to one row per (key, start) with the latest end, so the
rows of a key are bounded by the days of the calendar however many copies of a
range the source holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..session import durable
from .asof import asof_join


def merge_intervals(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merge overlapping or adjacent (next day) ranges of each key."""
    reduced = ranges.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    by_start = Window.partitionBy(*keys).orderBy("_s")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    marked = reduced.withColumn("_reach", F.max("_e").over(before)).withColumn(
        "_island",
        F.sum(F.when(F.col("_reach").isNull() | (F.col("_s") > F.date_add("_reach", 1)), 1).otherwise(0)).over(
            by_start.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    return (
        marked.groupBy(*keys, "_island")
        .agg(F.min("_s").alias(start), F.max("_e").alias(end))
        .drop("_island")
    )


def swept(ends: DataFrame, keys: list[str], at: str, **deltas: str) -> DataFrame:
    """``keys, at, until`` and a running sum for each named delta: what holds from ``at`` up to the next endpoint, ``until`` exclusive.

    ``ends`` has a row for each endpoint of an interval, +1 where it starts and -1 just behind its end. Endpoints that coincide
    are added up before the shuffle, so a key has one row for each place where something changes.
    """
    summed = ends.groupBy(*keys, at).agg(*[F.sum(delta).alias(name) for name, delta in deltas.items()])
    order = Window.partitionBy(*keys).orderBy(at)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(*keys, at, F.lead(at).over(order).alias("until"), *[F.sum(name).over(running).alias(name) for name in deltas])


def gaps_between(completed: DataFrame, requests: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, _from, _to``: what no completed range of a requested key covers between its first and last endpoint of any kind."""

    def ends(ranges: DataFrame, weight: int) -> DataFrame:
        return ranges.select(*keys, F.inline(F.array(
            F.struct(F.col(start).alias("_at"), F.lit(weight).alias("_d")), F.struct(F.date_add(end, 1).alias("_at"), F.lit(-weight).alias("_d")))))

    held = completed.filter(F.col(start) <= F.col(end)).join(requests.select(*keys).distinct(), keys, "left_semi")
    # Requests only mark where gaps may begin and end.
    return swept(ends(held, 1).unionByName(ends(requests, 0)), keys, "_at", _held="_d").filter("_held = 0 AND until IS NOT NULL").select(
        *keys, F.col("_at").alias("_from"), F.date_sub("until", 1).alias("_to"))


def missing_ranges(requests: DataFrame, completed: DataFrame, keys: list[str],
                   start: str = "start", end: str = "end") -> DataFrame:
    """Parts of each requested range that no completed range covers.

    The gaps of a key come from a sweep over the endpoints of its completed ranges. They are numbered in order; running counts
    over the gaps' and the requests' ends tell each request its first and last gap, so that requests and gaps meet by
    number, once for each missing part. Nothing is spread over days or years.
    """
    asked = requests.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start), F.col(end))
    pieces = gaps_between(completed, asked, keys, start, end)
    # Neighbouring pieces, cut where a request begins or ends, are one gap again.
    gaps = merge_intervals(pieces, keys, "_from", "_to")
    gaps = durable(gaps.withColumn("_gap", F.row_number().over(Window.partitionBy(*keys).orderBy("_from"))), "gaps")

    def mark(frame: DataFrame, at: str, side: int, request=None) -> DataFrame:
        request = F.struct(F.col(start).alias("s"), F.col(end).alias("e")) if request is None else request
        return frame.select(*keys, F.col(at).alias("_at"), F.lit(side).alias("_side"), request.alias("_r"))

    # On one day: a gap begins, a request begins, a gap ends, a request ends.
    nothing = F.lit(None).cast("struct<s:date,e:date>")
    marks = mark(gaps, "_from", 0, nothing).unionByName(mark(asked, start, 1)).unionByName(mark(gaps, "_to", 2, nothing)).unionByName(mark(asked, end, 3))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.select("*", F.count_if(F.col("_side") == 0).over(order).alias("_begun"), F.count_if(F.col("_side") == 2).over(order).alias("_passed"))
    met = counted.filter("_r IS NOT NULL").groupBy(*keys, "_r").agg(
        F.max(F.when(F.col("_side") == 1, F.col("_passed"))).alias("_first"), F.max(F.when(F.col("_side") == 3, F.col("_begun"))).alias("_last"))
    met = met.filter("_first < _last").select(
        *keys, F.col("_r.s").alias("request_start"), F.col("_r.e").alias("request_end"),
        F.explode(F.sequence((F.col("_first") + 1).cast("int"), F.col("_last").cast("int"))).alias("_gap"))
    return met.join(gaps, [*keys, "_gap"]).select(
        *keys, "request_start", "request_end",
        F.greatest("_from", "request_start").alias("missing_start"), F.least("_to", "request_end").alias("missing_end"),
    )


def ranges_cover(requests: DataFrame, completed: DataFrame, keys: list[str],
                 start: str = "start", end: str = "end") -> DataFrame:
    """Whether completed ranges contain each requested range without a hole.

    After merging, a request is covered exactly when the merged range that starts
    last on or before it also reaches its end, so one as-of match per request decides.
    """
    islands = merge_intervals(completed, keys, start, end).select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e")
    )
    matched = asof_join(
        requests.select(*keys, start, end).distinct(), islands, by=keys, left_on=start, right_on="_s", values=["_e"]
    )
    return matched.select(*keys, start, end, F.coalesce(F.col("_e") >= F.col(end), F.lit(False)).alias("covered"))


def split_range_months(ranges: DataFrame, months: int, start: str = "start", end: str = "end") -> DataFrame:
    """Cut each range into consecutive chunks of ``months`` months, the last clipped.

    Each chunk begins the day after the previous one, so a start on a day the next
    month lacks (the 31st) moves to the last day of that month and stays there. The
    fold over the chunk count follows that rule inside one row.
    """
    if months <= 0:
        raise ValueError("months must be positive")
    count = F.greatest(F.lit(0), F.ceil(F.months_between(F.col(end), F.col(start)) / months).cast("int") + 2)
    starts = F.aggregate(
        F.sequence(F.lit(1), count),
        F.array(F.col(start)),
        lambda done, _: F.concat(done, F.array(F.add_months(F.element_at(done, -1), months))),
    )
    cut = ranges.filter(F.col(start) <= F.col(end)).withColumn("_starts", starts)
    keep = [c for c in ranges.columns if c not in (start, end)]
    return (
        cut.select(*keep, F.col(end).alias("_end"), F.explode("_starts").alias(start))
        .filter(F.col(start) <= F.col("_end"))
        .withColumn(end, F.least(F.col("_end"), F.date_sub(F.add_months(F.col(start), months), 1)))
        .select(*ranges.columns)
    )


def tasks_by_range(ranges: DataFrame, symbol: str = "symbol", start: str = "start", end: str = "end") -> DataFrame:
    """Symbols to fetch per identical range, kept long with the size of each task.

    One common range may hold most symbols, so the symbols stay rows; a consumer
    writes them partitioned by range instead of reading one giant list.
    """
    members = ranges.select(start, end, symbol).distinct()
    sizes = members.groupBy(start, end).agg(F.count(F.lit(1)).alias("symbol_count"))
    return members.join(sizes, [start, end])


def expand_query_years(queries: DataFrame) -> DataFrame:
    """Coverage as distinct (symbol, year): years kept, ranges expanded to years."""
    if {"symbol", "year"}.issubset(queries.columns):
        return queries.select(F.col("symbol").cast("string").alias("symbol"), F.col("year").cast("int").alias("year")).distinct()
    inside = queries.filter(F.col("start") <= F.col("end"))
    years = F.explode(F.sequence(F.year("start"), F.year("end")))
    return inside.select(F.col("symbol").cast("string").alias("symbol"), years.alias("year")).distinct()


def missing_years(required: DataFrame, completed: DataFrame) -> DataFrame:
    """Required (symbol, year) pairs that no completed query covers."""
    wanted = required.select("symbol", F.col("year").cast("int").alias("year")).distinct()
    return wanted.join(expand_query_years(completed), ["symbol", "year"], "left_anti")


def completed_minute_days(status: DataFrame) -> DataFrame:
    """Days whose status is final and whose raw bars and feature are both stored."""
    return status.filter(F.col("status").isin(1, 2) & F.col("raw_saved") & F.col("feature_saved")).select(
        "symbol", "trade_date"
    ).distinct()


def calendar_places(calendar: DataFrame) -> DataFrame:
    """``(_day, _place)`` for every day from the one before the first market date to the last: the market dates up to that day.

    One row a day of the calendar's span, and so bounded by it.
    """
    days = calendar.select("date", "market_index", F.coalesce(F.date_sub(F.lead("date").over(Window.orderBy("date")), 1), F.col("date")).alias("_until"))
    spread = days.select(F.explode(F.sequence("date", "_until")).alias("_day"), F.col("market_index").alias("_place"))
    return spread.unionByName(calendar.agg(F.date_sub(F.min("date"), 1).alias("_day"), F.lit(0).alias("_place")).filter("_day IS NOT NULL"))


def plan_minute_days(requests: DataFrame, calendar: DataFrame, completed: DataFrame) -> DataFrame:
    """Requested minus completed trading days, merged into calendar-adjacent runs.

    ``retain_raw`` is OR-ed per day; runs are split where the flag changes. Requests and completed days are intervals in places of
    the market calendar, and a sweep over their endpoints finds where something is asked for and not done: a request is
    two rows, however long it is.
    """
    bounds = calendar.agg(F.date_sub(F.min("date"), 1).alias("_first"), F.max("date").alias("_last"))
    places = calendar_places(calendar)
    clipped = requests.join(F.broadcast(bounds), F.lit(True)).filter(F.col("start_date") <= F.col("end_date"))  # one row of bounds
    clipped = clipped.select("symbol", "retain_raw", *[
        F.least(F.greatest(day, F.col("_first")), F.col("_last")).alias(name)
        for name, day in (("_a", F.date_sub("start_date", 1)), ("_b", F.col("end_date")))])
    low = places.select(F.col("_day").alias("_a"), (F.col("_place") + 1).alias("_low"))
    high = places.select(F.col("_day").alias("_b"), F.col("_place").alias("_high"))
    asked = clipped.join(F.broadcast(low), "_a").join(F.broadcast(high), "_b").filter("_low <= _high")
    kept = F.when(F.col("retain_raw"), 1).otherwise(0)
    numbered = calendar.select(F.col("date").alias("trade_date"), F.col("market_index").alias("_at"))
    done = completed.select("symbol", "trade_date").join(asked.select("symbol").distinct(), "symbol", "left_semi").join(F.broadcast(numbered), "trade_date")

    def ends(frame: DataFrame, first, last, asked_, kept_, done_) -> DataFrame:
        return frame.select("symbol", F.inline(F.array(*[
            F.struct(at.cast("int").alias("_at"), (sign * asked_).alias("_asked"), (sign * kept_).alias("_kept"), (sign * done_).alias("_done"))
            for sign, at in ((F.lit(1), first), (F.lit(-1), last + 1))])))

    zero, one = F.lit(0), F.lit(1)
    every = ends(asked, F.col("_low"), F.col("_high"), one, kept, zero).unionByName(ends(done, F.col("_at"), F.col("_at"), zero, zero, one))
    wanted = swept(every, ["symbol"], "_at", _asked="_asked", _kept="_kept", _done="_done").filter("_asked > 0 AND _done = 0")
    wanted = wanted.select("symbol", F.col("_kept").cast("int").cast("boolean").alias("retain_raw"), "_at", "until")
    order = Window.partitionBy("symbol", "retain_raw").orderBy("_at")
    fresh = F.coalesce(F.lag("until").over(order) < F.col("_at"), F.lit(True))
    runs = wanted.withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("symbol", "retain_raw", "_run").agg(F.min("_at").alias("_low"), (F.max("until") - 1).alias("_high"))
    dates = calendar.select("market_index", "date")
    return (
        runs.join(F.broadcast(dates.withColumnsRenamed({"market_index": "_low", "date": "start_date"})), "_low")
        .join(F.broadcast(dates.withColumnsRenamed({"market_index": "_high", "date": "end_date"})), "_high")
        .select("symbol", "start_date", "end_date", "retain_raw")
    )


def lookback_requests(ranked: DataFrame, calendar: DataFrame, *, lookback: int = 20, max_candidates: int = 150,
                      retain_raw: bool = True, validate: bool = True) -> DataFrame:
    """One request per first ``max_candidates`` distinct ranked symbols of each signal date.

    The request spans the last ``lookback`` calendar dates up to the signal date.
    Signal dates off the calendar, or too early for the lookback, raise; without
    ``validate`` they yield nothing.
    """
    if lookback <= 0 or max_candidates <= 0:
        raise ValueError("lookback and max_candidates must be positive")
    if validate:
        quality.require_empty(unfit_signal_dates(ranked, calendar, lookback), "signal dates without a full lookback")
    first_seen = ranked.groupBy("signal_date", "symbol").agg(F.min("position").alias("position"))
    order = Window.partitionBy("signal_date").orderBy("position", "symbol")
    capped = first_seen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_candidates)
    ends = calendar.select(F.col("date").alias("signal_date"), (F.col("market_index") - (lookback - 1)).alias("_i"))
    starts = calendar.select(F.col("date").alias("start_date"), F.col("market_index").alias("_i"))
    windows = ends.join(F.broadcast(starts), "_i").drop("_i")
    return capped.join(F.broadcast(windows), "signal_date").select(
        "symbol", "start_date", F.col("signal_date").alias("end_date"), F.lit(retain_raw).alias("retain_raw")
    )


def unfit_signal_dates(ranked: DataFrame, calendar: DataFrame, lookback: int) -> DataFrame:
    """``(signal_date, reason)`` of signal dates off the calendar or before its first full lookback."""
    days = calendar.select(F.col("date").alias("signal_date"), "market_index")
    reason = F.when(F.col("market_index").isNull(), F.lit("not a market date")).when(F.col("market_index") < lookback, F.lit("lookback is not full"))
    return (
        ranked.select("signal_date").distinct().join(days, "signal_date", "left")
        .select("signal_date", reason.alias("reason")).filter("reason IS NOT NULL")
    )
