"""Exact order statistics per group by refining value histograms.

The value at a rank is found without ordering the rows. Each group starts as one interval, from its least to its largest
value. While an interval holds more than LEAF rows, its rows are counted in BINS bins (a grouped count, combined before the
shuffle), and the bin that holds the rank becomes the interval. What is left, at most LEAF values, is picked from. So a group of
any size costs some narrow passes over (keys, value), nothing of the input is written, and the input's rows never move.

The functions here read their input once for each pass: give them a stored table or a cheap projection of one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite
from ..session import durable

#: Bins of an interval, rows that are picked from directly, and passes before the rest is ranked by a range partitioning.
BINS, LEAF, PASSES = 1024, 4096, 8


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _bounds() -> dict[str, Column]:
    """An interval's ends and, for the bins, the ends of its finite values."""
    finite = F.when(is_finite("_v"), F.col("_v"))
    return {"_lo": F.min("_v"), "_hi": F.max("_v"), "_flo": F.min(finite), "_fhi": F.max(finite)}


def kth_values(df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """``keys, name, k, n, value, below, ties`` for each group and named rank, in ascending order of the non-null values.

    ``ranks`` gives each rank (from 1) as an expression of the group's number of values ``n``; ranks outside 1..n are left out.
    ``below`` counts the smaller values and ``ties`` the equal ones. NaN is the largest value, as everywhere in Spark.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("k")) for name, rank in ranks.items()]))
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in _bounds().items()])
    state = state.select("*", named.alias("_r")).select("*", "_r.name", "_r.k", F.lit(0).cast("long").alias("_under"), F.col("n").alias("_held"))
    state = state.drop("_r").filter("k BETWEEN 1 AND n")
    columns = [*keys, "name", "k", "n", "_under", "_held", "_lo", "_hi", "_flo", "_fhi"]
    state = durable(state.select(*columns), "order-statistics")
    wide = (F.col("_held") > LEAF) & ~F.col("_lo").eqNullSafe(F.col("_hi"))
    for _ in range(PASSES):
        if state.filter(wide).isEmpty():
            break
        state = durable(state.filter(~wide).unionByName(_refined(rows, state.filter(wide), keys, columns)), "order-statistics")
    else:
        if not state.filter(wide).isEmpty():
            state = durable(state.filter(~wide).unionByName(_ranged(rows, state.filter(wide), keys, columns)), "order-statistics")
    return _picked(rows, state, keys)


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the intervals of its group that hold it."""
    state = _renamed(state, keys)
    return rows.join(state, _same(rows, state, keys)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _refined(rows: DataFrame, wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of every interval the bin that holds its rank."""
    part = F.try_divide(F.col("_v") / 2 - F.col("_flo") / 2, F.col("_fhi") / 2 - F.col("_flo") / 2)
    bin_ = F.when(F.isnan("_v"), BINS + 1).when(F.col("_v") == float("inf"), BINS).when(F.col("_v") == -float("inf"), -1)
    bin_ = bin_.otherwise(F.least(F.floor(F.coalesce(part, F.lit(0.0)) * BINS), F.lit(BINS - 1))).cast("int")
    binned = _inside(rows, wide, keys).groupBy(*keys, "name", "k", "n", "_under", bin_.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_held"), *[c.alias(a) for a, c in _bounds().items()])
    # At most BINS + 2 rows of each interval.
    earlier = Window.partitionBy(*keys, "name").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = binned.withColumn("_under", F.col("_under") + F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
    return counted.filter((F.col("_under") < F.col("k")) & (F.col("k") <= F.col("_under") + F.col("_held"))).select(*columns)


def _ranged(rows: DataFrame, wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Intervals whose values lie too unevenly for bins, by the places of their distinct values in a range partitioning."""
    from .cross_section import cumulated

    counts = _inside(rows, wide, keys).groupBy(*keys, "name", "k", "n", "_under", "_v").agg(F.count(F.lit(1)).alias("_held"))
    placed = cumulated(counts, [*keys, "name"], "_v", "_held", "_earlier")
    at = placed.withColumn("_under", F.col("_under") + F.col("_earlier"))
    hit = at.filter((F.col("_under") < F.col("k")) & (F.col("k") <= F.col("_under") + F.col("_held")))
    return hit.withColumns({c: F.col("_v") for c in ("_lo", "_hi", "_flo", "_fhi")}).select(*columns)


def _picked(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values themselves: an interval of one value is done, one of at most LEAF rows is sorted."""
    one = F.col("_lo").eqNullSafe(F.col("_hi"))
    done = state.filter(one).select(*keys, "name", "k", "n", F.col("_lo").alias("value"), F.col("_under").alias("below"), F.col("_held").alias("ties"))
    counts = _inside(rows, state.filter(~one), keys).groupBy(*keys, "name", "k", "n", "_under", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.col("_under") + F.coalesce(F.sum("_c").over(order), F.lit(0)))
    hit = counts.filter((F.col("below") < F.col("k")) & (F.col("k") <= F.col("below") + F.col("_c")))
    return done.unionByName(hit.select(*keys, "name", "k", "n", F.col("_v").alias("value"), "below", F.col("_c").alias("ties")))


def kth_rows(df: DataFrame, keys: list[str], value: str, symbol: str, ranks: Mapping[str, Column], *, descending: bool = False) -> DataFrame:
    """``keys, name, k, n, value, symbol`` of the row at each named rank, ties in ascending order of the symbol.

    With ``descending`` the largest value has rank 1. Only rows that tie with such a row are looked at for their symbols.
    """
    n = F.col("n")
    if descending:
        ranks = {name: n - rank.cast("long") + 1 for name, rank in ranks.items()}
    cuts = durable(kth_values(df, keys, value, ranks), "cuts")
    place = F.col("n") - F.col("k") + 1 - (F.col("n") - F.col("below") - F.col("ties")) if descending else F.col("k") - F.col("below")
    cuts = cuts.withColumn("_place", place)
    if descending:
        cuts = cuts.withColumn("k", F.col("n") - F.col("k") + 1)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(symbol).alias("_s"))
    named = _renamed(cuts, keys)
    tied = rows.join(named, [*_same(rows, named, keys), rows["_v"].eqNullSafe(named["value"])])
    columns = [*keys, "name", "k", "n", "value"]
    few = tied.filter(F.col("ties") <= LEAF).groupBy(*columns, "_place").agg(F.sort_array(F.collect_list("_s")).alias("_all"))
    picked = few.select(*columns, F.element_at("_all", F.col("_place").cast("int")).alias("symbol"))
    if cuts.filter(F.col("ties") > LEAF).isEmpty():
        return picked
    from .cross_section import positions

    many = positions(tied.filter(F.col("ties") > LEAF).select(*columns, "_place", "_s"), [*keys, "name"], [F.col("_s").asc()], position="_p", size="_n")
    return picked.unionByName(many.filter("_p = _place").select(*columns, F.col("_s").alias("symbol")))
