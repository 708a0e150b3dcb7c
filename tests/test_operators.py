"""Row-level operators against small expected values and plain Python definitions."""

import datetime as dt
import math
import random
import statistics

import pytest
from conftest import business_days, day
from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.functions import calendar as cal
from factorspark.functions import quality, values
from factorspark.operators import asof, cross_section, intervals, intraday, order_statistics, series
from factorspark.plans.features import index_price, valid_price


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_symbols_and_index_codes_conform_or_become_null(spark):
    df = spark.createDataFrame([("sh.600000",), (" 600000.sh ",), ("000001.SZ",), ("600000.HK",), ("60000.SH",), (None,)], "raw string")
    got = [r[0] for r in df.select(values.security_symbol("raw")).collect()]
    assert got == ["600000.SH", "600000.SH", "000001.SZ", None, None, None]
    df = spark.createDataFrame([("h30269",), ("SH.000300",), ("000300.SH",), ("X30269",)], "raw string")
    assert [r[0] for r in df.select(values.index_code("raw")).collect()] == ["H30269", "sh.000300", "sh.000300", None]
    df = spark.createDataFrame([("600000.XSHG",), ("830001.XBEI",), ("600000.XNYS",)], "raw string")
    assert [r[0] for r in df.select(values.symbol_from_source("raw")).collect()] == ["600000.SH", "830001.BJ", None]


def test_coercion_turns_bad_values_and_nan_into_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("",)], "raw string")
    assert [r[0] for r in df.select(values.number("raw")).collect()] == [1.5, None, None, None]
    df = spark.createDataFrame([("2024-01-02",), ("soon",)], "raw string")
    assert [r[0] for r in df.select(values.day("raw")).collect()] == [day("2024-01-02"), None]


@pytest.mark.parametrize("chunk", [None, "YEAR", "MONTH"])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_a_search_over_each_key(spark, chunk, direction, inclusive):
    rng = random.Random(7)
    base = day("2020-01-01")
    left = [(f"S{rng.randrange(3)}", base + dt.timedelta(days=rng.randrange(900)), i) for i in range(120)]
    right = sorted({(f"S{rng.randrange(3)}", base + dt.timedelta(days=rng.randrange(900))) for _ in range(40)})
    right = [(k, d, n) for n, (k, d) in enumerate(right)]
    got = asof.asof_join(
        spark.createDataFrame(left, "symbol string, date date, i int"), spark.createDataFrame(right, "symbol string, at date, v int"),
        by=["symbol"], left_on="date", right_on="at", values=["v"], direction=direction, inclusive=inclusive, chunk=chunk)
    for symbol, date, i, v in got.collect():
        fits = [(d, n) for k, d, n in right if k == symbol and (
            (d < date if direction == "backward" else d > date) or (inclusive and d == date))]
        expected = (max(fits) if direction == "backward" else min(fits))[1] if fits else None
        assert v == expected
    assert got.count() == len(left)


def test_valid_shares_keeps_the_last_report_per_publication(spark):
    df = spark.createDataFrame([
        ("A", day("2024-01-01"), day("2023-09-30"), 10), ("A", day("2024-01-01"), day("2023-12-31"), 20),
        ("A", day("2024-02-01"), day("2023-12-31"), 0), ("A", None, day("2023-12-31"), 5)],
        "symbol string, publish_date date, report_date date, total_shares long")
    assert rows(asof.valid_shares(df).select("symbol", "publish_date", "total_shares")) == [("A", day("2024-01-01"), 20)]


def test_intervals_against_day_sets(spark):
    rng = random.Random(3)
    base = day("2024-01-01")
    ranges, wanted = [], []
    for key in range(25):
        start = rng.randrange(60)
        wanted.append((f"K{key}", base + dt.timedelta(days=start), base + dt.timedelta(days=start + rng.randrange(40))))
        for _ in range(rng.randrange(6)):
            a = rng.randrange(90)
            ranges.append((f"K{key}", base + dt.timedelta(days=a), base + dt.timedelta(days=a + rng.randrange(12))))
    schema = "k string, start date, end date"
    have, ask = spark.createDataFrame(ranges, schema), spark.createDataFrame(wanted, schema)

    def days_of(items):
        return {(k, a + dt.timedelta(days=i)) for k, a, b in items for i in range((b - a).days + 1)}

    merged = rows(intervals.merge_intervals(have, ["k"]).select("k", "start", "end"), "k", "start")
    assert days_of(merged) == days_of(ranges)
    for (k1, _, b1), (k2, a2, _) in zip(merged, merged[1:]):
        assert k1 != k2 or a2 > b1 + dt.timedelta(days=1)
    gaps = rows(intervals.missing_ranges(ask, have, ["k"]).select("k", "missing_start", "missing_end"))
    assert days_of(gaps) == days_of(wanted) - days_of(ranges)
    covered = {r["k"]: r["covered"] for r in intervals.ranges_cover(ask, have, ["k"]).collect()}
    for item in wanted:
        assert covered[item[0]] == (days_of([item]) <= days_of(ranges))


def test_overlapping_and_adjacent_ranges_merge_but_a_gap_does_not(spark):
    df = spark.createDataFrame([
        ("A", day("2024-01-01"), day("2024-01-05")), ("A", day("2024-01-06"), day("2024-01-08")), ("A", day("2024-01-10"), day("2024-01-11"))],
        "symbol string, start date, end date")
    got = rows(intervals.merge_intervals(df, ["symbol"]).select("start", "end"), "start")
    assert got == [(day("2024-01-01"), day("2024-01-08")), (day("2024-01-10"), day("2024-01-11"))]


def test_month_splits_follow_the_previous_chunk(spark):
    df = spark.createDataFrame([("A", day("2023-08-31"), day("2024-05-10")), ("B", day("2024-01-15"), day("2024-01-20"))], "symbol string, start date, end date")
    got = rows(intervals.split_range_months(df, 2).select("symbol", "start", "end"), "symbol", "start")
    assert got == [
        ("A", day("2023-08-31"), day("2023-10-30")), ("A", day("2023-10-31"), day("2023-12-30")), ("A", day("2023-12-31"), day("2024-02-28")),
        ("A", day("2024-02-29"), day("2024-04-28")), ("A", day("2024-04-29"), day("2024-05-10")), ("B", day("2024-01-15"), day("2024-01-20"))]


def test_minute_plan_equals_day_sets(spark):
    """Long, overlapping, inverted and off-calendar requests against plain sets of days."""
    rng = random.Random(17)
    market = business_days("2023-12-20", 60)
    market.remove(day("2024-01-01"))
    span = [market[0] + dt.timedelta(days=i) for i in range(-20, 110)]
    asks = [(f"S{rng.randrange(4)}", (a := rng.choice(span)), a + dt.timedelta(days=rng.randrange(-3, 25)), rng.random() < 0.5) for _ in range(40)] + [("S9", day("1990-01-01"), day("2090-01-01"), False)]
    done = [(f"S{rng.randrange(5)}", d) for d in rng.choices(market, k=60)] * 2 + [("S9", market[3])]
    frames = spark.createDataFrame(asks, "symbol string, start_date date, end_date date, retain_raw boolean"), spark.createDataFrame([(d,) for d in market], "date date"), spark.createDataFrame(done, "symbol string, trade_date date")
    got = rows(intervals.plan_minute_days(frames[0], cal.market_calendar(frames[1]), frames[2]))
    flags = {}
    for s, a, b, keep in asks:
        for d in market:
            if a <= d <= b and (s, d) not in done:
                flags[s, d] = flags.get((s, d), False) or keep
    want, before = [], None
    for s in sorted({s for s, _ in flags}):
        for d in market:
            flag = flags.get((s, d))
            if flag is not None and before == (s, flag):
                want[-1][2] = d
            elif flag is not None:
                want.append([s, d, d, flag])
            before = (s, flag) if flag is not None else None
    assert sorted(got) == sorted(map(tuple, want)) and len(want) > 15


def test_planning_rows_grow_with_requests_not_with_days(spark):
    market = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2009-12-31')) AS date")
    long = spark.createDataFrame([(f"S{i:03d}", day("2000-01-01"), day("2009-12-31"), True) for i in range(300)], "symbol string, start_date date, end_date date, retain_raw boolean")
    none = spark.createDataFrame([], "symbol string, trade_date date")
    for out in (intervals.plan_minute_days(long, cal.market_calendar(market), none),
                intervals.missing_ranges(long.toDF("symbol", "start", "end", "r"), spark.createDataFrame([], "symbol string, start date, end date"), ["symbol"])):
        observed = out._jdf.queryExecution().optimizedPlan().toString()
        made = [line for line in observed.splitlines() if "Generate explode(sequence(" in line]
        assert out.count() == 300 and not [line for line in made if "symbol" in line and "start_date" in line]


def test_minute_plan_subtracts_days_and_joins_calendar_neighbours(spark):
    requests = spark.createDataFrame([
        ("600000.SH", day("2024-01-05"), day("2024-01-09"), True), ("600000.SH", day("2024-01-08"), day("2024-01-10"), True)],
        "symbol string, start_date date, end_date date, retain_raw boolean")
    market = spark.createDataFrame([(day(d),) for d in ("2024-01-05", "2024-01-08", "2024-01-09", "2024-01-10")], "date date")
    done = spark.createDataFrame([("600000.SH", day("2024-01-08"))], "symbol string, trade_date date")
    got = rows(intervals.plan_minute_days(requests, cal.market_calendar(market), done), "start_date")
    assert got == [("600000.SH", day("2024-01-05"), day("2024-01-05"), True), ("600000.SH", day("2024-01-09"), day("2024-01-10"), True)]


def test_query_years_from_ranges_and_missing_pairs(spark):
    df = spark.createDataFrame([("A", day("2022-06-01"), day("2024-01-01")), ("A", day("2023-01-01"), day("2023-02-01")), ("B", day("2024-02-01"), day("2024-01-01"))], "symbol string, start date, end date")
    assert rows(intervals.expand_query_years(df), "year") == [("A", 2022), ("A", 2023), ("A", 2024)]
    need = spark.createDataFrame([("A", 2021), ("A", 2022)], "symbol string, year int")
    assert rows(intervals.missing_years(need, df)) == [("A", 2021)]


def test_positions_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    # A third of all rows share one value in one group.
    data = [(rng.choice("xxxy"), 0.0 if rng.random() < 0.4 else rng.random(), f"{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, s string")
    got = cross_section.positions(df.repartition(5), ["g"], [F.col("v").desc(), F.col("s").asc()])
    place = {(r["g"], r["s"]): r["position"] for r in got.collect()}
    for g in "xy":
        ordered = sorted(((v, s) for k, v, s in data if k == g), key=lambda x: (-x[0], x[1]))
        assert [place[g, s] for _, s in ordered] == list(range(1, len(ordered) + 1))


def test_average_rank_keeps_rows_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", None), ("a", 1.0), (None, 3.0), ("b", None)], "g string, v double")
    got = sorted(map(tuple, cross_section.average_rank(df, ["g"], "v", "r").collect()), key=str)
    assert got == sorted([("a", 1.0, 3.5), ("a", 1.0, 3.5), ("a", None, 1.5), ("a", None, 1.5), (None, 3.0, 1.0), ("b", None, 1.0)], key=str)


def test_trailing_frames_forget_what_has_left_them(spark):
    values = [1e17, 1.0, 1.0, None, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "s string, i int, v double")
    order = Window.partitionBy("s").orderBy("i")
    got = df.select("i", series.trailing_avg(F.col("v"), order, 3).alias("m"), series.trailing_sum(F.col("v"), order, 2, by_range=True).alias("t")).orderBy("i").collect()
    assert [r["m"] for r in got][3:] == [1.0, 1.0, 1.0, 1.0]
    assert [r["t"] for r in got][2:] == [2.0, 1.0, 1.0, 2.0, 2.0]


def test_nan_prices_do_not_pass(spark):
    nan = float("nan")
    df = spark.createDataFrame([("A", day("2024-01-01"), nan, 1.0, 1.0), ("A", day("2024-01-02"), 2.0, nan, nan), ("A", day("2024-01-03"), float("inf"), 1.0, 1.0)],
                               "symbol string, date date, close double, amount double, pe_ttm double")
    assert [tuple(r)[2:] for r in valid_price(df).collect()] == [(2.0, None, None)]
    assert index_price(df).count() == 1


def test_cross_sections_equal_plain_python(spark):
    rng = random.Random(11)
    data = [(f"D{i % 2}", f"{i:04d}", None if rng.random() < 0.1 else float(rng.randrange(25))) for i in range(400)]
    df = spark.createDataFrame(data, "date string, symbol string, v double")
    kept = df.filter("v IS NOT NULL")
    flags = {(r["date"], r["symbol"]) for r in cross_section.flag_top_ratio(df, ["date"], "v", 0.3, "top").filter("top").collect()}
    ranks = {(r["date"], r["symbol"]): r["r"] for r in cross_section.average_rank(kept, ["date"], "v", "r").collect()}
    medians = {r["date"]: r["m"] for r in cross_section.group_median(df, ["date"], "v", "m").collect()}
    for name in ("D0", "D1"):
        group = sorted([(v, s) for d, s, v in data if d == name and v is not None], key=lambda x: (-x[0], x[1]))
        assert {s for d, s in flags if d == name} == {s for _, s in group[: math.floor(len(group) * 0.3)]}
        plain = sorted(v for v, _ in group)
        assert medians[name] == statistics.median(plain)
        for v, s in group:
            assert ranks[(name, s)] == plain.index(v) + (plain.count(v) + 1) / 2


@pytest.mark.parametrize("leaf, bins, passes", [(4096, 1024, 8), (3, 4, 8), (3, 4, 1)])
def test_order_statistics_equal_sorting(spark, monkeypatch, leaf, bins, passes):
    """Few or many passes, and the range partitioning for what the bins leave, give the same rows."""
    for name, number in (("LEAF", leaf), ("BINS", bins), ("PASSES", passes)):
        monkeypatch.setattr(order_statistics, name, number)
    rng = random.Random(13)
    spread = [0.0, -0.0, 1e300, -1e300, 1e-300, 5e-324, float("inf"), -float("inf"), float("nan"), None]
    data = [("even", f"{i:03d}", rng.random()) for i in range(60)] + [("ties", f"{i:03d}", float(rng.randrange(3))) for i in range(60)]
    data += [("odd", f"{i:03d}", v) for i, v in enumerate(spread * 2)] + [(None, "a", 2.0), ("one", "a", 7.0), ("none", "a", None)]
    data += [("steps", f"{i:03d}", 2.0 ** (i % 40 - 20)) for i in range(50)]
    df = spark.createDataFrame(data, "g string, s string, v double").repartition(3)
    n = F.col("n")
    ranks = {"first": F.lit(1), "third": F.ceil(n / 3), "half": F.floor((n + 1) / 2), "last": n, "beyond": n + 1, "zero": F.lit(0)}
    up = {(r["g"], r["name"]): r for r in order_statistics.kth_rows(df, ["g"], "v", "s", ranks).collect()}
    down = {(r["g"], r["name"]): r for r in order_statistics.kth_rows(df, ["g"], "v", "s", ranks, descending=True).collect()}
    values = {(r["g"], r["name"]): r for r in order_statistics.kth_values(df, ["g"], "v", ranks).collect()}
    key = {True: lambda v: (1, 0.0) if v != v else (0, v), False: lambda v: (-1, 0.0) if v != v else (0, -v)}
    wanted = 0
    for g in {d[0] for d in data}:
        own = [(v, s) for k, s, v in data if k == g and v is not None]
        for ascending, found in ((True, up), (False, down)):
            ordered = sorted(own, key=lambda x: (key[ascending](x[0]), x[1]))
            for name, k in (("first", 1), ("third", math.ceil(len(own) / 3)), ("half", (len(own) + 1) // 2), ("last", len(own))):
                if own:
                    wanted += 1
                    got = found[g, name]
                    assert (repr(got["value"] + 0.0), got["symbol"], got["k"], got["n"]) == (repr(ordered[k - 1][0] + 0.0), ordered[k - 1][1], k, len(own))
                    if ascending:
                        place = key[True](ordered[k - 1][0])
                        assert values[g, name]["below"] == sum(key[True](v) < place for v, _ in own) and values[g, name]["ties"] == sum(key[True](v) == place for v, _ in own)
    assert len(up) + len(down) == wanted


def test_selection_leaves_its_input_in_place(spark, tmp_path):
    """Flags, groups and medians neither write the input nor shuffle its wide rows."""
    spark.range(2000).selectExpr("id % 4 AS d", "cast(id AS string) AS symbol", "cast(hash(id) AS double) AS v", "repeat('x', 50) AS wide").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for out in (cross_section.flag_top_ratio(df, ["d"], "v", 0.3, "top"), cross_section.quintile_groups(df, ["d"], "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[-1]
        shuffled = [line for line in final.splitlines() if "Exchange hashpartitioning" in line]
        assert "wide" not in "".join(shuffled) and out.count() == 2000


def test_quintiles_are_balanced_like_floor_not_ntile(spark):
    df = spark.createDataFrame([("d", f"S{i:02d}", float(i)) for i in range(12)] + [("e", "A", 1.0)], "date string, symbol string, f double")
    got = cross_section.quintile_groups(df, ["date"], "f")
    sizes = [r["count"] for r in got.filter("date = 'd'").groupBy("group").count().orderBy("group").collect()]
    assert sizes == [3, 2, 3, 2, 2]
    # A date with fewer names than groups stays, and is listed.
    assert rows(got.filter("date = 'e'").select("symbol", "group")) == [("A", 1)]
    assert rows(cross_section.too_small(df, ["date"], 5, "f")) == [("e", 1)]


def test_trimmed_mean_and_ties(spark):
    df = spark.createDataFrame([("d", s, v) for s, v in zip("ABCDE", [5.0, 1.0, 1.0, 2.0, 100.0])], "date string, symbol string, v double")
    got = cross_section.trimmed_mean(df, ["date"], "v", 0.2).first()
    assert (got["trimmed_mean"], got["trimmed_count"], got["row_count"]) == (pytest.approx(8 / 3), 3, 5)


def test_factor_transform_clips_and_centres(spark):
    df = spark.createDataFrame([("d", "A", 1.0), ("d", "B", 2.0), ("d", "C", 100.0), ("e", "A", 3.0), ("e", "B", 3.0), ("e", "C", None)], "date string, symbol string, factor double")
    got = {(r["date"], r["symbol"]): r["factor"] for r in cross_section.winsor_zscore(df).collect()}
    assert sum(got[("d", s)] for s in "ABC") == pytest.approx(0.0, abs=1e-12)
    assert got[("d", "C")] == pytest.approx((5 - 8 / 3) / statistics.pstdev([1, 2, 5]))
    assert got[("e", "A")] == 0.0 and got[("e", "C")] is None


def test_neutralized_residuals_are_orthogonal_and_constant_size_uses_the_mean(spark):
    df = spark.createDataFrame([("d", 0.1, 1.0), ("d", 0.4, 2.0), ("d", 0.2, 4.0), ("e", 1.0, 7.0), ("e", 3.0, 7.0)], "date string, y double, x double")
    got = cross_section.neutralize(df, ["date"], "y", "x", "r").collect()
    d = [(r["x"], r["r"]) for r in got if r["date"] == "d"]
    assert sum(r for _, r in d) == pytest.approx(0, abs=1e-12) and sum(x * r for x, r in d) == pytest.approx(0, abs=1e-12)
    assert sorted(r["r"] for r in got if r["date"] == "e") == [-1.0, 1.0]


def test_information_coefficient_is_null_for_constant_factors(spark):
    df = spark.createDataFrame(
        [("d", 1.0, 0.1), ("d", 2.0, 0.2), ("d", 3.0, 0.25), ("e", 5.0, 0.1), ("e", 5.0, 0.3), ("f", 1.0, None)], "date string, factor double, forward_return double")
    got = {r["date"]: r for r in cross_section.information_coefficients(df, ["date"]).collect()}
    assert got["d"]["rank_ic"] == pytest.approx(1.0) and 0.9 < got["d"]["ic"] < 1
    assert got["e"]["ic"] is None and got["e"]["rank_ic"] is None and got["f"]["ic"] is None


def test_trailing_sums_equal_sliding_sums(spark):
    from pyspark.sql import Window

    rng = random.Random(2)
    data = [("A", i + rng.randrange(2) * 1000, None if rng.random() < 0.2 else rng.random()) for i in range(0, 300, 3)]
    df = spark.createDataFrame(data, "symbol string, i int, v double")
    order = Window.partitionBy("symbol").orderBy("i")
    got = df.select(
        series.trailing_avg(F.col("v"), order, 7).alias("a"), F.avg("v").over(order.rowsBetween(-6, 0)).alias("b"),
        series.trailing_avg(F.col("v"), order, 30, by_range=True).alias("c"), F.avg("v").over(order.rangeBetween(-29, 0)).alias("d")).collect()
    for r in got:
        assert (r["a"] is None) == (r["b"] is None) and (r["a"] is None or r["a"] == pytest.approx(r["b"], rel=1e-12))
        assert (r["c"] is None) == (r["d"] is None) and (r["c"] is None or r["c"] == pytest.approx(r["d"], rel=1e-12))


def test_rolling_volatility_needs_a_full_window(spark):
    closes = [10.0, 11.0, 10.5, 12.0, 0.0, 12.5]
    df = spark.createDataFrame([("A", d, c) for d, c in zip(business_days("2024-01-01", 6), closes)], "symbol string, date date, close double")
    got = [r["volatility"] for r in series.rolling_volatility(df, 4).orderBy("date").collect()]
    kept = [c for c in closes if c > 0]
    returns = [b / a - 1 for a, b in zip(kept, kept[1:])]
    assert got[:3] == [None] * 3
    assert got[3:] == [pytest.approx(statistics.stdev(returns[0:3])), pytest.approx(statistics.stdev(returns[1:4]))]


def test_forward_fill_starts_at_the_first_quote(spark):
    days = business_days("2024-01-01", 4)
    df = spark.createDataFrame([(days[0], "A", 1.0), (days[2], "A", 2.0), (days[1], "B", 5.0)], "date date, symbol string, close double")
    market = cal.market_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    got = rows(series.forward_fill(df, market).select("symbol", "date", "close"), "symbol", "date")
    assert got == [("A", days[0], 1.0), ("A", days[1], 1.0), ("A", days[2], 2.0), ("A", days[3], 2.0), ("B", days[1], 5.0), ("B", days[2], 5.0), ("B", days[3], 5.0)]


def test_second_friday_and_annual_schedule(spark):
    df = spark.createDataFrame([(2023,), (2024,)], "y int")
    assert [r[0] for r in df.select(cal.second_friday_of_december(F.col("y"))).collect()] == [day("2023-12-08"), day("2024-12-13")]
    market = spark.createDataFrame([(day(d),) for d in ("2023-12-08", "2023-12-11", "2024-12-12", "2024-12-13")], "date date")
    got = rows(cal.annual_schedule(market, "2023-01-01", "2024-12-31"))
    assert got == [(day("2023-12-08"), day("2023-12-11"))]


def test_period_ends_are_the_last_available_dates(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2024-01-30", "2024-01-31", "2024-02-05", "2024-02-28")], "date date")
    assert [r["date"] for r in cal.period_end_dates(df).orderBy("date").collect()] == [day("2024-01-31"), day("2024-02-28")]


def minutes(spark, items):
    return spark.createDataFrame(
        [(s, dt.datetime.fromisoformat(t), c, c, c, c, 1.0, 1.0) for s, t, c in items],
        "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, total_turnover double")


def test_intraday_volatility_has_no_overnight_return_and_reports_status(spark):
    bars = minutes(spark, [
        ("A", "2024-01-02 09:31:00", 10.0), ("A", "2024-01-02 09:32:00", 11.0), ("A", "2024-01-02 09:33:00", 10.0),
        ("A", "2024-01-03 09:31:00", 20.0), ("A", "2024-01-03 09:32:00", 22.0), ("A", "2024-01-03 09:33:00", 20.0), ("A", "2024-01-04 09:31:00", 5.0)])
    expected = spark.createDataFrame([("A", day(f"2024-01-0{i}")) for i in range(2, 6)], "symbol string, trade_date date")
    got = {r["trade_date"].day: r for r in intraday.daily_volatility(bars, expected).collect()}
    assert got[2]["volatility"] == pytest.approx(statistics.stdev([0.1, -1 / 11])) == got[3]["volatility"]
    assert [got[i]["status"] for i in (2, 3, 4, 5)] == [1, 1, 3, 2]
    assert [got[i]["bar_count"] for i in (2, 4, 5)] == [3, 1, 0] and got[2]["return_count"] == 2
    assert {r["status"] for r in intraday.daily_volatility(bars, min_bars=4).collect()} == {3}


def test_equal_minutes_collapse_and_conflicts_are_listed(spark):
    bars = minutes(spark, [("A", "2024-01-02 09:31:00", 10.0), ("A", "2024-01-02 09:31:00", 10.0), ("B", "2024-01-02 09:31:00", 1.0), ("B", "2024-01-02 09:31:00", 2.0)])
    assert intraday.normalize_minute_bars(bars.filter("symbol = 'A'")).count() == 1
    assert rows(intraday.conflicting_minutes(bars).select("symbol", "row_count")) == [("B", 2)]
    with pytest.raises(quality.DataQualityError, match="different values"):
        intraday.normalize_minute_bars(bars, "2024-01-02", "2024-01-02", validate=True)
    with pytest.raises(quality.DataQualityError, match="before the range"):
        intraday.normalize_minute_bars(bars.filter("symbol = 'A'"), "2024-01-03", validate=True)
    asked = spark.createDataFrame([("A", day("2024-01-02"))], "symbol string, trade_date date")
    assert [r["symbol"] for r in intraday.days_off_calendar(bars, asked).collect()] == ["B"]


def test_codes_of_long_keys_keep_all_digits(spark):
    df = spark.createDataFrame([("h123456",), ("SH.1234567",), ("1234567.sz",), ("h1234",)], "raw string")
    assert [r[0] for r in df.select(values.index_code("raw", long_keys=True)).collect()] == ["H123456", "sh.1234567", "sz.1234567", None]
    assert [r[0] for r in df.select(values.security_symbol("raw", long_keys=True)).collect()] == [None, "1234567.SH", "1234567.SZ", None]
    assert [r[0] for r in df.select(values.index_code("raw")).collect()] == [None] * 4


def test_minutes_of_close_zero_stay_where_they_are_allowed(spark):
    bars = minutes(spark, [("A", "2024-01-02 09:31:00", 0.0), ("A", "2024-01-02 09:31:00", 0.0), ("A", "2024-01-02 09:32:00", 2.0)])
    assert rows(intraday.normalize_minute_bars(bars, zero_closes=True).select("close")) == [(0.0,), (2.0,)]
    with pytest.raises(quality.DataQualityError, match="not positive"):
        intraday.normalize_minute_bars(bars)
    with pytest.raises(quality.DataQualityError, match="negative"):
        intraday.normalize_minute_bars(minutes(spark, [("A", "2024-01-02 09:31:00", -1.0)]), zero_closes=True)


def test_returns_from_a_close_of_zero_count_and_make_the_day_nan(spark):
    from factorspark.streaming.intraday import sample_deviation

    closes = [2.0, 0.0, 0.0, 3.0]
    bars = minutes(spark, [("A", f"2024-01-02 09:3{i}:00", c) for i, c in enumerate(closes)])
    for finite_only, status in ((True, 3), (False, 1)):
        got = intraday.daily_volatility(bars, finite_only=finite_only).first()
        assert got["volatility"] != got["volatility"] and (got["return_count"], got["status"]) == (3, status)
    streamed = sample_deviation(closes)
    assert streamed[0] != streamed[0] and streamed[1] == 3
    days = [day(f"2024-01-0{i}") for i in range(1, 4)]
    daily = spark.createDataFrame([("A", d, v) for d, v in zip(days, (1.0, 2.0, float("nan")))], "symbol string, trade_date date, volatility double")
    windows = spark.createDataFrame([(days[-1], d) for d in days], "as_of_date date, trade_date date")
    assert intraday.volatility_cv(daily, windows, min_valid=2).first()["intraday_volatility_cv"] == pytest.approx(2**-0.5 / 1.5)
    kept = intraday.volatility_cv(daily, windows, min_valid=3, finite_only=False).first()["intraday_volatility_cv"]
    assert kept != kept
    ranked = spark.createDataFrame([("d", s, float("nan")) for s in "edcba"], "date string, symbol string, factor double")
    assert rows(cross_section.quintile_groups(ranked, ["date"], "factor", finite_only=False).select("symbol", "group"), "symbol") == list(zip("abcde", range(1, 6)))


def test_intraday_factor_is_orthogonal_to_size_and_needs_all_days(spark):
    days = business_days("2024-01-01", 20)
    parts = [("A", 0.01, 0.0001, 100.0), ("B", 0.02, 0.0004, 200.0), ("C", 0.03, 0.0009, 500.0), ("D", 0.03, 0.0005, 300.0)]
    daily = [(s, d, b + k * i) for s, b, k, _ in parts for i, d in enumerate(days) if not (s == "D" and i == 3)]
    caps = [(s, d, c) for s, _, _, c in parts for d in days]
    got = intraday.volatility_factor(
        spark.createDataFrame(daily, "symbol string, trade_date date, volatility double"),
        spark.createDataFrame(caps, "symbol string, trade_date date, total_market_cap double"),
        spark.createDataFrame([(days[-1],)], "as_of_date date")).orderBy("symbol").collect()
    assert [r["symbol"] for r in got] == ["A", "B", "C"]
    values_a = [0.01 + 0.0001 * i for i in range(20)]
    assert got[0]["intraday_volatility_cv"] == pytest.approx(statistics.stdev(values_a) / statistics.mean(values_a))
    assert sum(r["minute_return_volatility"] for r in got) == pytest.approx(0, abs=1e-12)
    assert sum(r["minute_return_volatility"] * r["log_market_cap"] for r in got) == pytest.approx(0, abs=1e-12)


def test_member_windows_use_the_members_dates_only(spark):
    days = business_days("2024-01-01", 6)
    quotes = [("A", d) for d in days if d != days[3]] + [("B", d) for d in days if d not in (days[3], days[4])] + [("Z", d) for d in days]
    members = spark.createDataFrame([(days[5], "A"), (days[5], "B")], "as_of_date date, symbol string")
    got = intraday.member_windows(members, spark.createDataFrame(quotes, "symbol string, trade_date date"), 3)
    assert sorted(r["trade_date"] for r in got.collect()) == [days[2], days[4], days[5]]


def test_quality_reports_all_broken_rules_at_once(spark):
    df = spark.createDataFrame([("A", -1.0), ("A", None)], "symbol string, v double")
    with pytest.raises(quality.DataQualityError, match="negative.*1 rows.*missing.*1 rows"):
        quality.require_rules(df, {"v is negative": F.col("v") < 0, "v is missing": F.col("v").isNull(), "fine": F.lit(False)}, "t")
    with pytest.raises(quality.DataQualityError, match="duplicate keys"):
        quality.require_unique(df, ["symbol"], "t")


def test_missing_ranges_equal_day_sets(spark):
    rng = random.Random(17)
    start = day("2022-11-01")

    def ranges(n, longest):
        return [(rng.choice("AB"), start + dt.timedelta(days=(a := rng.randrange(600))), start + dt.timedelta(days=a + rng.randrange(longest))) for _ in range(n)]

    asked, done = ranges(25, 500), ranges(40, 20)
    schema = "symbol string, start date, end date"
    got = intervals.missing_ranges(spark.createDataFrame(asked, schema), spark.createDataFrame(done, schema), ["symbol"]).collect()
    held = {(s, a + dt.timedelta(days=k)) for s, a, b in done for k in range((b - a).days + 1)}
    found = {}
    for r in got:
        key = r["symbol"], r["request_start"], r["request_end"]
        days = {r["missing_start"] + dt.timedelta(days=k) for k in range((r["missing_end"] - r["missing_start"]).days + 1)}
        assert days and not days & found.get(key, set())
        assert (r["symbol"], r["missing_start"] - dt.timedelta(days=1)) in held or r["missing_start"] == r["request_start"]
        found[key] = found.get(key, set()) | days
    for s, a, b in set(asked):
        assert found.get((s, a, b), set()) == {a + dt.timedelta(days=k) for k in range((b - a).days + 1) if (s, a + dt.timedelta(days=k)) not in held}


def test_signal_dates_without_a_lookback_are_listed_and_raise(spark):
    days = business_days("2024-01-01", 5)
    calendar = cal.market_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    ranked = spark.createDataFrame([(days[0], "A", 1), (days[4], "A", 1), (day("2024-01-06"), "A", 1)], "signal_date date, symbol string, position int")
    assert rows(intervals.unfit_signal_dates(ranked, calendar, 3), "signal_date") == [(days[0], "lookback is not full"), (day("2024-01-06"), "not a market date")]
    with pytest.raises(quality.DataQualityError, match="full lookback"):
        intervals.lookback_requests(ranked, calendar, lookback=3)
    assert intervals.lookback_requests(ranked, calendar, lookback=3, validate=False).count() == 1


def test_bars_of_other_days_raise(spark):
    bars = minutes(spark, [("A", "2024-01-02 09:31:00", 10.0), ("A", "2024-01-03 09:31:00", 10.0)])
    asked = spark.createDataFrame([("A", day("2024-01-02"))], "symbol string, trade_date date")
    with pytest.raises(quality.DataQualityError, match="not asked for"):
        intraday.daily_volatility(bars, asked)
    assert intraday.daily_volatility(bars, asked, validate=False).count() == 1


def test_last_quotes(spark):
    df = spark.createDataFrame([(s, day(f"2024-01-0{i}")) for s in "AB" for i in range(1, 6)], "symbol string, date date")
    assert rows(series.last_quotes(df, 2), "symbol", "date") == [(s, day(f"2024-01-0{i}")) for s in "AB" for i in (4, 5)]


def test_watched_checks_count_during_the_write(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    watch = quality.Watch()
    kept = watch.watch(df, {"v is seven": F.col("v") == 7, "v is null": F.col("v").isNull()}, "numbers", lambda: df.filter("v = 7").select("id")).filter("id < 5")
    kept.write.parquet(f"{tmp_path}/t")
    with pytest.raises(quality.DataQualityError, match=r"numbers: v is seven \(10 rows\); examples: \[\(7,\)"):
        watch.require()
    watch.require()  # nothing is watched any more
    fine = watch.watch(df, {"v is negative": F.col("v") < 0}, "numbers")
    fine.write.parquet(f"{tmp_path}/u")
    watch.require()


def test_watched_checks_count_by_themselves_where_nothing_ran(spark, monkeypatch):
    monkeypatch.setattr(quality.Watch, "SECONDS", 1)
    watch = quality.Watch()
    watch.watch(spark.range(3), {"id is two": F.col("id") == 2}, "numbers")
    with pytest.raises(quality.DataQualityError, match="id is two .1 rows"):
        watch.require()


def test_rules_of_several_frames_are_counted_together(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", -2.0), ("B", 3.0)], "s string, v double")
    counts = quality.count_violations(df, {"v is negative": F.col("v") < 0, "s is missing": F.col("s").isNull()}), quality.counted(quality.duplicate_keys(df, ["s"]), "repeated s")
    with pytest.raises(quality.DataQualityError, match=r"frame: v is negative \(1 rows\); repeated s \(1 rows; such as .*A"):
        quality.require_all("frame", *counts)
    quality.require_all("frame", quality.counted(df.filter("v > 9"), "v is large"))
