"""Per-date cross-sections: positions, top-k, groups, trimming, factors.

A date's cross-section grows with the number of securities, so it must not be
assumed to fit one task. Three rules hold here, at every size:

* statistics per date (means, deviations, regression sums, counts) are grouped
  aggregations, combined before the shuffle, and joined back from one row per date;
* top-N with a fixed N filters on ``row_number() <= N``, which Spark limits on the
  map side before the shuffle;
* cuts (ratios, quintiles, trims, medians) are order statistics, found by refining
  histograms of the values, and rows are compared with them where they are;
* positions and ranks of every row come from one range partitioning over the whole
  cluster; positions within a range are shifted by the counts of the earlier ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite
from ..session import durable
from .order_statistics import kth_rows, kth_values


def _offsets(cut: DataFrame, keys: list[str], rows: Column) -> DataFrame:
    """Per (group, range): rows of the group in earlier ranges and in all of them.

    One row for each range of a group. Ranges are consecutive, so there are at
    most ranges + groups of them.
    """
    counts = cut.groupBy(*keys, "_range").agg(rows.alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_o"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )


def _with_offsets(cut: DataFrame, keys: list[str], rows: Column) -> DataFrame:
    """``cut`` with ``_before`` and ``_total``; null keys are groups of their own."""
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return cut.join(_offsets(cut, keys, rows), [*same, F.col("_range") == F.col("_o")])


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by group and order, with their range, written once.

    Counts and rows see the same cut even after an executor is lost. Ranges follow
    the full order, so a run of equal values is split by the later order columns.
    """
    return durable(
        df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )


def positions(df: DataFrame, keys: list[str], order: list[Column], *, position: str = "position", size: str = "group_size") -> DataFrame:
    """Exact 1-based position of every row in its group and the group's size (both long)."""
    cut = _ranged(df, keys, order)
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    placed = _with_offsets(cut.withColumn("_local", local), keys, F.count(F.lit(1)))
    return placed.withColumn(position, F.col("_before") + F.col("_local")).withColumn(size, F.col("_total")).select(*df.columns, position, size)


def flag_top_ratio(df: DataFrame, keys: list[str], metric: str, ratio: float, name: str, *,
                   symbol: str = "symbol") -> DataFrame:
    """All rows, with whether each is in the top ratio of its group's non-null metrics (ties by symbol)."""
    return flag_top_ratios(df, keys, {name: (metric, ratio)}, symbol=symbol)


def flag_top_ratios(df: DataFrame, keys: list[str], flags: Mapping[str, tuple[str, float]], *, symbol: str = "symbol") -> DataFrame:
    """All rows with one flag for each ``name: (metric, ratio)``.

    The last row of every top ratio is found in common passes over (keys, metric, symbol), and the rows are flagged where they
    are, from one row a group; ``df`` is read some times (see ``order_statistics``).
    """
    stacked = df.select(*keys, symbol, F.explode(F.array(*[
        F.struct(F.lit(name).alias("of"), F.col(metric).cast("double").alias("metric")) for name, (metric, _) in flags.items()])).alias("_m"))
    stacked = stacked.select(*keys, symbol, F.col("_m.of").alias("_of"), F.col("_m.metric").alias("_metric"))
    ratio = F.lit(None).cast("double")
    for name, (_, share) in flags.items():
        ratio = F.when(F.col("_of") == name, F.lit(float(share))).otherwise(ratio)
    cuts = kth_rows(stacked, [*keys, "_of"], "_metric", symbol, {"last": F.floor(F.col("n") * ratio)}, descending=True)
    last = [F.max(F.when(F.col("_of") == name, F.struct("value", "symbol"))).alias(f"_{name}_last") for name in flags]
    cuts = cuts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*last)
    same = [df[k].eqNullSafe(cuts[f"_k{i}"]) for i, k in enumerate(keys)]
    out = df.join(F.broadcast(cuts), same, "left")
    for name, (metric, _) in flags.items():
        value, cut = F.col(metric).cast("double"), F.col(f"_{name}_last")
        inside = (value > cut["value"]) | ((value == cut["value"]) & (F.col(symbol) <= cut["symbol"]))
        out = out.withColumn(name, F.coalesce(inside, F.lit(False)))
    return out.select(*df.columns, *flags)


def topk_ratio(df: DataFrame, keys: list[str], metric: str, ratio: float, *, symbol: str = "symbol") -> DataFrame:
    """Top ``floor(n * ratio)`` by metric descending, n counting non-null metrics only."""
    return flag_top_ratio(df, keys, metric, ratio, "_top", symbol=symbol).filter("_top").drop("_top")


def topk_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group, numbered from one."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def quintile_groups(df: DataFrame, keys: list[str], factor: str, *, groups: int = 5, symbol: str = "symbol",
                    finite_only: bool = True) -> DataFrame:
    """Balanced groups ``floor(i * groups / n) + 1`` by ascending (factor, symbol).

    Rows without a finite factor (or, without ``finite_only``, without a factor; NaN is the largest) are left out. Dates with fewer names than groups
    are kept, with some groups empty; ``too_small`` lists them. A row's group is one more than the number of
    groups whose last row it follows, so rows stay where they are; ``df`` is read some times.
    """
    usable = df.filter(is_finite(factor) if finite_only else F.col(factor).isNotNull())
    last = {str(g): F.ceil(F.col("n") * g / groups) for g in range(1, groups)}
    ends = kth_rows(usable, keys, factor, symbol, last)
    ends = ends.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.collect_list(F.struct("value", "symbol")).alias("_ends"))
    same = [usable[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]
    own = F.struct(F.col(factor).cast("double").alias("value"), F.col(symbol).alias("symbol"))
    passed = F.size(F.filter("_ends", lambda end: own > end))
    return usable.join(F.broadcast(ends), same, "left").withColumn("group", (F.greatest(F.coalesce(passed, F.lit(0)), F.lit(0)) + 1).cast("int")).select(*df.columns, "group")


def too_small(df: DataFrame, keys: list[str], least: int, value: str | None = None, *, finite_only: bool = True) -> DataFrame:
    """Groups with fewer than ``least`` rows (with a finite ``value``, or one at all, if given), with their counts."""
    usable = F.count(F.lit(1)) if value is None else F.count_if(is_finite(value)) if finite_only else F.count(value)
    return df.groupBy(*keys).agg(usable.alias("names")).filter(F.col("names") < least)


def trimmed_mean(df: DataFrame, keys: list[str], value: str, ratio: float, *, symbol: str = "symbol") -> DataFrame:
    """Mean after dropping ``floor(n * ratio)`` rows on each side, with both counts.

    Equal values count alike, so only the values at the two cuts are needed, with how many of their ties stay.
    """
    if not 0 <= ratio < 0.5:
        raise ValueError("ratio must be in [0, 0.5)")
    n = F.col("n")
    dropped = F.floor(n * F.lit(float(ratio)))
    cuts = kth_values(df, keys, value, {"first": dropped + 1, "last": n - dropped})
    at = {c: F.max(F.when(F.col("name") == c, F.struct("value", "below", "ties", "n", "k"))).alias(f"_{c}") for c in ("first", "last")}
    ends = cuts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*at.values())
    same = [df[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]
    inside = (F.col(value) > F.col("_first.value")) & (F.col(value) < F.col("_last.value"))
    sums = df.join(ends, same, "left").groupBy(*keys).agg(
        F.sum(F.when(inside, F.col(value).cast("double"))).alias("_inner"), F.count(F.lit(1)).alias("row_count"),
        F.any_value("_first").alias("_first"), F.any_value("_last").alias("_last"))
    first, last = F.col("_first"), F.col("_last")
    kept = last["k"] - first["k"] + 1
    low = first["value"] * (first["below"] + first["ties"] - first["k"] + 1)
    high = last["value"] * (last["k"] - last["below"])
    total = F.when(first["value"] == last["value"], first["value"] * kept).otherwise(F.coalesce("_inner", F.lit(0.0)) + low + high)
    return sums.select(*keys, F.try_divide(total, kept).alias("trimmed_mean"), F.coalesce(kept, F.lit(0)).alias("trimmed_count"), "row_count")


def cumulated(counts: DataFrame, keys: list[str], value: str, n: str, name: str) -> DataFrame:
    """``counts``, one row for each value of a group, with how many rows (column ``n``) the smaller values have.

    Groups of any size: the values are range-partitioned and the ranges' sums shift each other.
    """
    cut = _ranged(counts, keys, [F.col(value).asc()])
    local = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(cut.withColumn("_local", F.coalesce(F.sum(n).over(local), F.lit(0))), keys, F.sum(n))
    return placed.withColumn(name, F.col("_before") + F.col("_local")).select(*counts.columns, name)


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average rank of every row, equal values sharing the mean of their positions.

    Equal values are counted before ranking, so a value held by many rows is one
    row there. Null values rank first, null keys are groups, and no row is lost.
    """
    return average_ranks(df, keys, {value: name})


def average_ranks(df: DataFrame, keys: list[str], names: Mapping[str, str]) -> DataFrame:
    """Average ranks of several columns, each under its name; the distinct values of all of them are ordered in one pass."""
    values = None
    for value in names:
        part = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_of", F.lit(value))
        values = part if values is None else values.unionByName(part)
    placed = durable(cumulated(values, [*keys, "_of"], "_v", "_c", "_below"), "ranks")
    out = df
    for value, name in names.items():
        own = placed.filter(F.col("_of") == value).select(
            *[F.col(k).alias(f"_g{i}") for i, k in enumerate([*keys, "_v"])], (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
        same = [df[k].eqNullSafe(own[f"_g{i}"]) for i, k in enumerate(keys)]
        same.append(df[value].cast("double").eqNullSafe(own[f"_g{len(keys)}"]))
        out = out.join(own, same).select(*out.columns, name)
    return out


def group_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of non-null values, one row per group."""
    n = F.col("n")
    middle = kth_values(df, keys, value, {"low": F.floor((n + 1) / 2), "high": F.ceil((n + 1) / 2)})
    return middle.groupBy(*keys).agg(F.avg("value").alias(name))


def winsor_zscore(df: DataFrame, value: str = "factor", keys: list[str] | None = None, *, winsor_n: float | None = 3.0,
                  zscore: bool = True) -> DataFrame:
    """Clip to median +- n * MAD per date, then standardize with population deviation.

    A zero MAD leaves values unclipped; a zero deviation gives zero scores.
    """
    keys = keys or ["date"]
    out = df
    if winsor_n is not None:
        medians = group_median(df, keys, value, "_median")
        centred = out.join(medians, keys, "left").withColumn(
            "_deviation", F.abs(F.col(value) - F.col("_median"))
        )
        mads = group_median(centred, keys, "_deviation", "_mad")
        reach = F.lit(float(winsor_n)) * F.col("_mad")
        clipped = F.greatest(F.least(F.col(value), F.col("_median") + reach), F.col("_median") - reach)
        out = centred.join(mads, keys, "left").withColumn(
            value, F.when(F.col(value).isNotNull() & (F.col("_mad") > 0), clipped).otherwise(F.col(value))
        ).drop("_median", "_deviation", "_mad")
    if zscore:
        stats = out.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
        out = out.join(stats, keys, "left").withColumn(
            value,
            F.when(F.col("_std") > 0, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))).otherwise(
                F.col(value) * 0.0
            ),
        ).drop("_mean", "_std")
    return out


def neutralize(df: DataFrame, keys: list[str], y: str, x: str, name: str) -> DataFrame:
    """Residual of ``y`` on a constant and ``x`` per group.

    With a constant ``x``, or a single row, the fit is the mean; ``too_small`` lists
    the groups that a caller holds too small.
    """
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_slope"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"),
    )
    fitted = F.col("_my") + F.coalesce(F.col("_slope"), F.lit(0.0)) * (F.col(x) - F.col("_mx"))
    return df.join(fit, keys).withColumn(name, F.col(y) - fitted).drop("_slope", "_my", "_mx")


def safe_correlation(left: str, right: str, *, finite_only: bool = True) -> Column:
    """Pearson correlation; null below two rows or when a side is constant (NaN for the latter without ``finite_only``)."""
    spread = F.stddev_samp(left) * F.stddev_samp(right)
    return F.when(
        (F.count(F.lit(1)) >= 2) & (F.stddev_samp(left) != 0) & (F.stddev_samp(right) != 0),
        F.try_divide(F.covar_samp(left, right), spread),
    ).when((F.count(F.lit(1)) >= 2) & F.lit(not finite_only), F.lit(float("nan")))


def information_coefficients(pairs: DataFrame, keys: list[str], factor: str = "factor",
                             forward: str = "forward_return", *, finite_only: bool = True) -> DataFrame:
    """Pearson and rank correlation of factor and next-period return per group.

    Groups that keep no complete pair still get a row with null correlations.
    """
    complete = pairs.filter(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    # The pairs are read for their values and for their ranks.
    complete = durable(complete.select(*keys, factor, forward), "pairs")
    ranked = average_ranks(complete, keys, {factor: "_rf", forward: "_rr"})
    values = ranked.groupBy(*keys).agg(
        safe_correlation(factor, forward, finite_only=finite_only).alias("ic"),
        safe_correlation("_rf", "_rr", finite_only=finite_only).alias("rank_ic"),
    )
    return pairs.select(*keys).distinct().join(values, keys, "left")


def annual_icir(column: str, periods: int = 12) -> Column:
    """Mean over sample deviation, annualized; null when the deviation is zero."""
    return F.try_divide(F.avg(column), F.stddev_samp(column)) * F.sqrt(F.lit(float(periods)))
