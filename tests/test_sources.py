"""Loading, cleaning, writing and the stream."""

import datetime as dt
import statistics

import pytest
from conftest import day
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorspark.functions.quality import DataQualityError
from factorspark.operators import intraday
from factorspark.sources import csv_sink, extracts, loading, partitioned, tables, views
from factorspark.sources.schemas import DATASETS, dataset
from factorspark.streaming import intraday as stream


def test_the_thirteen_datasets_declare_keys_and_required_columns():
    assert len(DATASETS) == 13
    for spec in DATASETS.values():
        assert set(spec.primary_key) | set(spec.required) <= set(spec.columns)


def bars(spark, items):
    base = spark.createDataFrame(items, "date date, symbol string, close float, amount double, pe_ttm float")
    spec = dataset("stock_daily")
    return base.select(*[(F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema.fields])


def test_load_dataset_filters_and_rejects(spark, tmp_path):
    items = [(day(f"2024-01-0{i}"), s, float(i), 1.0, 1.0) for i in range(1, 6) for s in ("600000.SH", "000001.SZ")]
    bars(spark, items).write.parquet(f"{tmp_path}/stock_daily")
    out = loading.load_dataset(spark, "stock_daily", start="2024-01-02", end="2024-01-03", symbols=["sh.600000"], data_root=str(tmp_path))
    assert sorted(r["date"].day for r in out.collect()) == [2, 3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), IsNotNull(symbol), GreaterThanOrEqual(date,2024-01-02)" in plan
    with pytest.raises(ValueError, match="give start and end"):
        loading.load_dataset(spark, "stock_daily", data_root=str(tmp_path))
    with pytest.raises(ValueError, match="lies after end"):
        loading.load_dataset(spark, "stock_daily", start="2024-02-01", end="2024-01-01", data_root=str(tmp_path))
    with pytest.raises(ValueError, match="only, not"):
        loading.load_dataset(spark, "csindex_daily", start="2024-01-01", end="2024-01-02", symbols=["000300"], data_root=str(tmp_path))
    bars(spark, items[:1]).write.mode("append").parquet(f"{tmp_path}/stock_daily")
    with pytest.raises(DataQualityError, match="duplicate keys"):
        loading.load_dataset(spark, "stock_daily", start="2024-01-01", end="2024-01-03", data_root=str(tmp_path))


def test_minute_end_date_includes_the_whole_day(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 15, 0)), ("A", dt.datetime(2024, 1, 3, 0, 0))], "symbol string, datetime timestamp_ntz")
    got = loading.select_range(df, dataset("stock_minute_1m"), dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert [r["datetime"].day for r in got.collect()] == [2]


def test_standardize_price_renames_orders_and_requires(spark):
    df = spark.createDataFrame([("2024-01-02", 600000, 1.0, 5, "x")], "trade_date string, ticker int, close double, vol long, note string")
    out = loading.standardize_price(df)
    assert out.columns == ["date", "symbol", "close", "volume", "note"]
    assert out.first()["symbol"] == "600000" and out.first()["date"] == day("2024-01-02")
    with pytest.raises(ValueError, match="missing required"):
        loading.standardize_price(df.drop("close"))


def test_view_percent_change_scales_stocks_only(spark):
    columns = "open float, high float, low float, volume long, amount double, turn float, pe_ttm float, ps_ttm float, pcf_ncf_ttm float, is_st boolean"
    fact = spark.createDataFrame([(1, day("2024-01-02"), 11.0, 10.0)], "security_id int, trade_date date, close float, preclose float")
    fact = fact.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns.split(", ")})
    securities = spark.createDataFrame([(1, "600000.SH")], "security_id int, symbol string")
    indices = spark.createDataFrame([(1, "sh.000300")], "index_id int, index_code string")
    assert views.stock_daily(fact, securities).first()["pct_chg"] == pytest.approx(10.0)
    assert views.index_daily(fact.withColumnRenamed("security_id", "index_id"), indices).first()["pct_chg"] == pytest.approx(0.1)


def test_daily_cleaner_keeps_traded_rows(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "sh.600000", "1.5", "", "10.25", "1", "1"), ("2024-01-03", "sh.600000", "1.6", "100", "x", "0", "0")],
        "date string, code string, close string, volume string, amount string, tradestatus string, isST string")
    got = extracts.clean_daily_bars(raw).collect()
    assert len(got) == 1 and got[0]["volume"] is None and got[0]["amount"] == 10.25 and got[0]["isST"] is True
    assert "code" not in extracts.clean_daily_bars(raw).columns


def test_dividend_cleaner_accepts_blank_and_rejects_text(spark):
    schema = "dividPlanAnnounceDate string, dividCashPsBeforeTax string"
    out = extracts.clean_dividends(spark.createDataFrame([("2024-04-30", " "), ("bad", "0.5")], schema), "sh.600000", 2024)
    assert sorted((r["announce_date"], r["cash_dividend_before_tax"]) for r in out.collect() if r["announce_date"]) == [(day("2024-04-30"), None)]
    with pytest.raises(DataQualityError, match="Invalid dividend cash"):
        extracts.clean_dividends(spark.createDataFrame([("2024-04-30", "half")], schema), "sh.600000", 2024)


def test_adjust_factor_cleaner_rejects_bad_rows(spark):
    schema = "dividOperateDate string, foreAdjustFactor string, backAdjustFactor string, adjustFactor string"
    with pytest.raises(DataQualityError, match="not positive"):
        extracts.clean_adjust_factors(spark.createDataFrame([("2024-01-02", "1", "0", "1")], schema), "sh.600000")
    with pytest.raises(DataQualityError, match="duplicate"):
        extracts.clean_adjust_factors(spark.createDataFrame([("2024-01-02", "1", "1", "1")] * 2, schema), "sh.600000")


def test_share_counts_must_be_whole(spark):
    schema = "publish_date date, report_date date, total_shares double"
    good = extracts.prepare_share_capital(spark.createDataFrame([(day("2024-04-30"), day("2024-03-31"), 100.0000001), (None, day("2024-03-31"), None), (None, None, 5.0)], schema))
    assert sorted(r["total_shares"] or 0 for r in good.collect()) == [0, 100]
    with pytest.raises(DataQualityError, match="not whole"):
        extracts.prepare_share_capital(spark.createDataFrame([(None, day("2024-03-31"), 1.5)], schema))


def test_listing_window_is_half_open_at_delisting(spark):
    df = spark.createDataFrame([
        ("600000.XSHG", "2000-01-01", "0000-00-00"), ("600001.XSHG", "2000-01-01", "2024-01-01"), ("600002.XSHG", "2024-01-01", "2024-01-02"),
        ("600003.XSHG", "2999-12-31", "0000-00-00"), ("600004.XSHG", "2024-02-01", "")], "order_book_id string, listed_date string, de_listed_date string")
    assert sorted(r["symbol"] for r in extracts.listed_between(df, "2024-01-01", "2024-01-31").collect()) == ["600000.SH", "600002.SH"]


def test_changed_snapshots_keep_only_changes(spark):
    history = {"2024-01-02": "AB", "2024-01-03": "BA", "2024-01-04": "AC", "2024-01-05": "AC", "2024-01-08": "A", "2024-01-09": "AC"}
    df = spark.createDataFrame([(day(d), s) for d, members in history.items() for s in members], "date date, symbol string")
    got = {}
    for r in extracts.changed_snapshots(df, "H30269").collect():
        got.setdefault(r["effective_date"].isoformat(), []).append(r["symbol"])
    assert {k: "".join(sorted(v)) for k, v in got.items()} == {"2024-01-02": "AB", "2024-01-04": "AC", "2024-01-08": "A", "2024-01-09": "AC"}


def test_index_rows_keep_the_last_of_a_date(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, 1), ("2024-01-02", 2.0, 2)], "date string, close double, seq int")
    assert [r["close"] for r in extracts.prepare_index_daily(df, "seq").collect()] == [2.0]


def test_ids_are_stable_and_limited(spark):
    known = spark.createDataFrame([(1, "B"), (2, "D")], "id int, symbol string")
    incoming = spark.createDataFrame([("C",), ("A",), ("B",), ("C",)], "symbol string")
    got = {r["symbol"]: r["id"] for r in tables.assign_ids(known, incoming, "symbol", "id").collect()}
    assert got == {"B": 1, "D": 2, "A": 3, "C": 4}
    with pytest.raises(OverflowError):
        tables.assign_ids(known, incoming, "symbol", "id", id_limit=3)


def test_range_replacement_also_clears_without_rows(spark):
    schema = "symbol string, date date, v int"
    old = spark.createDataFrame([("A", day("2024-01-02"), 1), ("A", day("2024-01-05"), 2), ("B", day("2024-01-02"), 3)], schema)
    requests = spark.createDataFrame([("A", day("2024-01-01"), day("2024-01-03"))], "symbol string, start date, end date")
    got = sorted(r["v"] for r in tables.replace_by_range(old, spark.createDataFrame([], schema), requests, ["symbol"], "date").collect())
    assert got == [2, 3]
    outside = tables.dates_outside_requests(old, requests, ["symbol"], "date")
    assert sorted(r["v"] for r in outside.collect()) == [2, 3]


def test_close_upsert_changes_only_close(spark):
    old = spark.createDataFrame([("I", day("2024-01-02"), 1.0, 7)], "symbol string, date date, close double, volume int")
    new = spark.createDataFrame([("I", day("2024-01-02"), 2.0), ("I", day("2024-01-03"), 3.0)], "symbol string, date date, close double")
    got = sorted((r["date"], r["close"], r["volume"]) for r in tables.upsert_close(old, new, ["symbol", "date"]).collect())
    assert got == [(day("2024-01-02"), 2.0, 7), (day("2024-01-03"), 3.0, None)]


def test_absent_insert_treats_nulls_as_equal(spark):
    schema = "symbol string, announce_date date, record_date date, cash double"
    old = spark.createDataFrame([("A", day("2024-01-02"), None, 1.0)], schema)
    new = spark.createDataFrame([("A", day("2024-01-02"), None, 1.0), ("A", None, None, 2.0), ("A", None, None, 2.0), ("A", None, None, None)], schema)
    assert sorted(r["cash"] for r in tables.insert_absent(old, new, old.columns, value="cash").collect()) == [1.0, 2.0]


def test_snapshot_write_moves_the_pointer_last(spark, tmp_path):
    table = f"{tmp_path}/t"
    tables.write_snapshot(spark.range(3).toDF("v"), table)
    first = tables.current_snapshot(spark, table)
    held = tables.read_snapshot(spark, table)
    tables.write_snapshot(held.filter("v > 0"), table, sort_by=["v"])
    assert tables.current_snapshot(spark, table) != first
    assert sorted(r["v"] for r in tables.read_snapshot(spark, table).collect()) == [1, 2]
    assert held.count() == 3


def test_csv_sink_refuses_to_replace(spark, tmp_path):
    df = spark.range(2).toDF("v")
    path = csv_sink.save_output(df, f"{tmp_path}/deep/out.csv")
    assert spark.read.option("header", True).csv(path).count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        csv_sink.save_output(df, path)
    csv_sink.save_output(df, path, overwrite=True)
    with pytest.raises(ValueError, match="Unsupported"):
        csv_sink.save_output(df, f"{tmp_path}/out.xlsx")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


STREAMED = "symbol string, datetime timestamp_ntz, close double, volume double"


class Feed:
    """A folder of minute bars that a stream reads, and the tables that it writes."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.table, self.state = spark, f"{folder}/in", f"{folder}/out", f"{folder}/state"

    def put(self, *bars):
        rows_ = [(s, dt.datetime.fromisoformat(t), c, 1.0) for s, t, c in bars]
        self.spark.createDataFrame(rows_, STREAMED).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, expected=None):
        """Reads what has come since the last run, from the checkpoint on."""
        bars = self.spark.readStream.schema(STREAMED).parquet(self.source)
        rows_ = stream.stream_daily_volatility(bars, expected=expected, min_bars=2)
        stream.start_tables(rows_, self.table, self.state, availableNow=True).awaitTermination()

    def days(self):
        return {(r["symbol"], r["trade_date"].day): r for r in stream.stored_days(self.spark, self.table).collect()}


def test_stream_finishes_days_across_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    asked = spark.createDataFrame([(s, day(d)) for s in "AC" for d in ("2024-01-01", "2024-01-02", "2024-01-04")], "symbol string, trade_date date")
    feed.put(("A", "2024-01-02 09:33:00", 10.0), ("A", "2024-01-02 09:31:00", 10.0), ("B", "2024-01-02 09:31:00", 5.0))
    feed.run(asked)
    # The first of January is over, without bars; the second is open, and the stream has stopped in its middle.
    assert set(feed.days()) == {("A", 1), ("C", 1)} and {r["status"] for r in feed.days().values()} == {2}
    feed.put(("A", "2024-01-02 09:32:00", 11.0), ("A", "2024-01-02 09:32:00", 11.0), ("B", "2024-01-02 09:30:00", 4.0))
    feed.run(asked)
    feed.put(("A", "2024-01-04 09:31:00", 1.0))
    feed.run(asked)
    found = feed.days()
    assert set(found) == {("A", 1), ("C", 1), ("A", 2), ("B", 2), ("C", 2)}
    assert found["A", 2]["volatility"] == pytest.approx(statistics.stdev([0.1, -1 / 11])) and (found["A", 2]["bar_count"], found["A", 2]["status"]) == (3, 1)
    assert (found["B", 2]["bar_count"], found["B", 2]["return_count"], found["B", 2]["status"], found["B", 2]["volatility"]) == (2, 1, 3, None)
    assert (found["C", 2]["bar_count"], found["C", 2]["status"]) == (0, 2)
    assert [(r["symbol"], r["trade_date"].day) for r in stream.stored_features(spark, feed.table).collect()] == [("A", 2)]
    covered = {(r["symbol"], r["start"].day, r["end"].day) for r in stream.stored_coverage(spark, feed.table).collect()}
    assert covered == {("A", 1, 2), ("C", 1, 2)}


def test_stream_reports_conflicts_and_counts_late_bars(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(("A", "2024-01-02 09:31:00", 1.0), ("A", "2024-01-02 09:31:00", 2.0), ("A", "2024-01-02 09:32:00", 3.0), ("A", "2024-01-02 09:33:00", None), ("B", "2024-01-02 09:31:00", 1.0))
    feed.run()
    feed.put(("A", "2024-01-02 09:31:00", 1.0), ("A", "2024-01-02 09:33:00", 4.0), ("B", "2024-01-02 09:32:00", 2.0), ("B", "2024-01-02 09:33:00", 3.0), ("A", "2024-01-03 09:31:00", 1.0))
    feed.run()
    found = feed.days()
    assert (found["A", 2]["status"], found["A", 2]["volatility"], found["A", 2]["bar_count"]) == (4, None, 3) and found["B", 2]["status"] == 1
    conflicts = rows(stream.stored_conflicts(spark, feed.table), "datetime")
    batch = rows(intraday.conflicting_minutes(spark.read.schema(STREAMED).parquet(feed.source)), "datetime")
    assert [(c[1].minute, c[2]) for c in conflicts] == [(c[1].minute, c[2]) for c in batch] == [(31, 3), (33, 2)]
    assert stream.stored_late(spark, feed.table).count() == 0
    # Bars of the finished day are counted and change nothing, also when a batch is written again.
    feed.put(("A", "2024-01-02 10:00:00", 9.0), ("A", "2024-01-02 10:01:00", 9.0), ("A", "2024-01-03 09:32:00", 1.0))
    feed.run()
    before = sorted(map(tuple, spark.read.parquet(feed.table).collect()), key=str)
    assert [(r["symbol"], r["trade_date"].day, r["late_bars"]) for r in stream.stored_late(spark, feed.table).collect()] == [("A", 2, 2)]
    assert feed.days() == found
    for number in {r["batch"] for r in spark.read.parquet(feed.table).select("batch").distinct().collect()}:
        held = spark.read.parquet(f"{feed.table}/batch={number}").select(*[c.split()[0] for c in stream.RESULT.split(", ")]).collect()
        stream.write_batch(spark.createDataFrame(held, stream.RESULT), number, feed.table)
    assert sorted(map(tuple, spark.read.parquet(feed.table).collect()), key=str) == before


def test_allowed_symbols_hold_for_frames_and_columns_are_required(spark, tmp_path):
    rows_ = [(day("2024-01-02"), s, 1.0) for s in ("H30269", "H20269", "H00001")]
    spark.createDataFrame(rows_, "date date, symbol string, close double").write.parquet(f"{tmp_path}/{dataset('csindex_daily').folder}")
    read = dict(start="2024-01-01", end="2024-01-03", data_root=str(tmp_path))
    asked = spark.createDataFrame([("H30269",)], "symbol string")
    assert [r["symbol"] for r in loading.load_dataset(spark, "csindex_daily", symbols=asked, **read).collect()] == ["H30269"]
    with pytest.raises(DataQualityError, match="does not hold"):
        loading.load_dataset(spark, "csindex_daily", symbols=spark.createDataFrame([("H00001",)], "symbol string"), **read)
    spark.createDataFrame([(day("2024-01-02"), "600000.SH")], "date date, symbol string").write.parquet(f"{tmp_path}/short/stock_daily")
    with pytest.raises(DataQualityError, match="missing required columns"):
        loading.load_dataset(spark, "stock_daily", start="2024-01-01", end="2024-01-03", data_root=f"{tmp_path}/short")


def test_absent_daily_columns_are_typed(spark):
    out = extracts.prepare_daily_columns(spark.createDataFrame([("A", day("2024-01-02"), 1.0)], "symbol string, date date, close double"))
    assert not [c for c, kind in out.dtypes if kind == "void"]


def test_conflicting_and_negative_writes_raise(spark):
    schema = "symbol string, date date, close double"
    d = day("2024-01-02")
    old, twice = spark.createDataFrame([("A", d, 1.0)], schema), spark.createDataFrame([("A", d, 2.0), ("A", d, 3.0)], schema)
    for write in (tables.replace_by_dates, tables.upsert_close):
        with pytest.raises(DataQualityError, match="differ"):
            write(old, twice, ["symbol", "date"])
        assert [r["close"] for r in write(old, twice.filter("close = 2").union(twice.filter("close = 2")), ["symbol", "date"]).collect()] == [2.0]
    cash = spark.createDataFrame([("A", d, -1.0), ("B", d, 1.0), ("C", d, None)], schema)
    with pytest.raises(DataQualityError, match="negative"):
        tables.insert_absent(old, cash, ["symbol", "date", "close"], value="close")
    assert tables.insert_absent(old, cash, ["symbol", "date", "close"], value="close", validate=False).count() == 2
    assert tables.record_points(old, twice.union(old)).count() == 3


def test_minute_write_replaces_per_request(spark):
    bar = "symbol string, datetime timestamp_ntz, open float, high float, low float, close float, volume double, total_turnover double"

    def bars_of(items):
        return spark.createDataFrame([(s, dt.datetime(2024, 1, d, 9, m), p, p, p, p, 1.0, p) for s, d, m, p in items], bar)

    calendar = spark.createDataFrame([(day(f"2024-01-0{i}"), i) for i in range(2, 6)], "date date, market_index int")
    stored = bars_of([("A", 2, 31, 9.0), ("A", 4, 31, 9.0), ("B", 2, 31, 9.0)])
    features = spark.createDataFrame([("A", day("2024-01-03"), 0.5), ("A", day("2024-01-05"), 0.5), ("B", day("2024-01-02"), 0.5)], "symbol string, trade_date date, volatility float")
    status = spark.createDataFrame([("A", day("2024-01-03"), 1, 3, 2, True, True)], "symbol string, trade_date date, status int, bar_count int, return_count int, raw_saved boolean, feature_saved boolean")
    requests = spark.createDataFrame([("A", day("2024-01-02"), day("2024-01-03"), True), ("B", day("2024-01-02"), day("2024-01-02"), False)], "symbol string, start_date date, end_date date, retain_raw boolean")
    new = bars_of([("A", 2, 31, 10.0), ("A", 2, 32, 11.0), ("A", 2, 33, 10.5), ("B", 2, 31, 1.0), ("B", 2, 32, 1.5), ("B", 2, 33, 1.0)])
    raw, found, days = tables.replace_intraday(stored, features, status, new, requests, calendar)
    assert sorted((r["symbol"], r["datetime"].day, r["close"]) for r in raw.collect()) == [("A", 2, 10.0), ("A", 2, 10.5), ("A", 2, 11.0), ("A", 4, 9.0), ("B", 2, 9.0)]
    assert sorted((r["symbol"], r["trade_date"].day) for r in found.collect()) == [("A", 2), ("A", 5), ("B", 2)]
    assert sorted((r["symbol"], r["trade_date"].day, r["status"], r["raw_saved"]) for r in days.collect()) == [("A", 2, 1, True), ("A", 3, 2, True), ("B", 2, 1, False)]


def monthly_table(spark, path):
    """Three symbols on every day of 2023, stored by month."""
    df = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2023-12-31')) AS date").selectExpr("date", "explode(array('A', 'B', 'C')) AS symbol", "1.0D AS close", "2L AS volume")
    partitioned.store_by_month(df, path, "date", ["symbol", "date"])
    return df


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def changed_months(before, after):
    return {name.split("/")[0].split("=")[1][5:7] for name in before.keys() ^ after.keys() | {n for n in before.keys() & after.keys() if before[n] != after[n]}}


def test_updates_touch_their_months_only(spark, tmp_path, monkeypatch):
    path, read = tmp_path / "t", []
    monthly_table(spark, str(path))
    schema = StructType.fromDDL("date date, symbol string, close double, volume long")
    whole = partitioned.read_partitions
    monkeypatch.setattr(partitioned, "read_partitions", lambda *a: read.append([r[0] for r in whole(*a).select(F.input_file_name()).distinct().collect()]) or whole(*a))
    table = lambda: whole(spark, str(path), schema, partitioned.MONTH)

    def read_months():
        return {f.split("month=")[1][5:7] for files in read for f in files}

    def frame(*items):
        return spark.createDataFrame([(day(d), s, c, v) for d, s, c, v in items], schema)

    before, old = files_of(path), table().collect()
    incoming = frame(("2023-03-05", "A", 9.0, 1), ("2023-03-06", "D", 8.0, None), ("2023-11-30", "B", 7.0, 3))
    want = tables.replace_by_dates(spark.createDataFrame(old, schema), incoming, ["symbol", "date"])
    partitioned.replace_dates_at(str(path), schema, incoming, ["symbol", "date"])
    assert sorted(map(tuple, table().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert changed_months(before, files_of(path)) == read_months() == {"03", "11"}

    # A range that empties a month leaves an empty partition; months that the table lacks are not invented.
    before, old, read[:] = files_of(path), table().collect(), []
    asked = spark.createDataFrame([(s, day("2023-06-01"), day("2023-06-30")) for s in "ABC"] + [("A", day("2023-12-20"), day("2024-02-10"))], "symbol string, start date, end date")
    fresh = frame(("2024-01-05", "A", 5.0, 5))
    want = tables.replace_by_range(spark.createDataFrame(old, schema), fresh, asked, ["symbol"], "date")
    partitioned.replace_range_at(str(path), schema, fresh, asked, ["symbol"])
    assert sorted(map(tuple, table().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert changed_months(before, files_of(path)) == {"06", "12", "01"} and table().filter("month(date) = 6").count() == 0
    assert read_months() == {"06", "12"}

    before, old, read[:] = files_of(path), table().collect(), []
    closes = frame(("2023-06-02", "A", 3.0, None), ("2023-09-09", "B", 4.0, None))
    want = tables.upsert_close(spark.createDataFrame(old, schema), closes, ["symbol", "date"])
    partitioned.upsert_close_at(str(path), schema, closes, ["symbol", "date"])
    assert sorted(map(tuple, table().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert changed_months(before, files_of(path)) == {"06", "09"}
    with pytest.raises(DataQualityError, match="differ"):
        partitioned.replace_dates_at(str(path), schema, frame(("2023-01-05", "A", 1.0, 1), ("2023-01-05", "A", 2.0, 1)), ["symbol", "date"])


def test_replacing_a_key_reads_nothing(spark, tmp_path, monkeypatch):
    schema = "effective_date date, index_code string, symbol string"
    old = spark.createDataFrame([(day("2023-01-02"), i, s) for i in ("X", "Y") for s in "AB"], schema)
    path = tmp_path / "t"
    partitioned.write_partitions(old, str(path), "index_code")
    before = files_of(path)
    monkeypatch.setattr(partitioned, "read_partitions", lambda *a: pytest.fail("read"))
    new = spark.createDataFrame([(day("2023-02-02"), "Y", "C")] * 2, schema)
    partitioned.replace_key_at(str(path), old.schema, new, "index_code", ["effective_date", "index_code", "symbol"])
    monkeypatch.undo()
    got = rows(partitioned.read_partitions(spark, str(path), old.schema, "index_code"), "index_code", "symbol")
    assert got == [(day("2023-01-02"), "X", "A"), (day("2023-01-02"), "X", "B"), (day("2023-02-02"), "Y", "C")]
    assert {n.split("/")[0] for n in before.keys() & files_of(path).keys()} == {"index_code=X"}


def test_bucketed_tables_are_read_by_month_and_bucket(spark, tmp_path):
    items = [(day(f"2024-{m:02d}-{d:02d}"), f"60000{k}.SH", 1.0 + d, 1.0, 1.0) for m in range(1, 7) for d in (1, 2, 3, 30 if m != 2 else 28) for k in range(6)]
    partitioned.save_bucketed(bars(spark, items), "bucketed_bars", buckets=8, path=f"{tmp_path}/t")
    try:
        out = partitioned.load_bucketed(spark, "stock_daily", "bucketed_bars", start="2024-02-02", end="2024-03-30", symbols=["600001.SH"])
        assert [r["date"].isoformat() for r in out.orderBy("date").collect()] == ["2024-02-02", "2024-02-03", "2024-02-28", "2024-03-01", "2024-03-02", "2024-03-03", "2024-03-30"]
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
        detail = spark._jvm.PythonSQLUtils.explainString(
            partitioned.load_bucketed(spark, "stock_daily", "bucketed_bars", start="2024-02-02", end="2024-03-30", symbols=["600001.SH"])._jdf.queryExecution(), "formatted")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 8" in detail and "2024-02-01" in detail.split("PartitionFilters")[1].split("\n")[0]
        assert all("month=2024-02" in f or "month=2024-03" in f for r in out.select(F.input_file_name()).distinct().collect() for f in r)
        every = partitioned.load_bucketed(spark, "stock_daily", "bucketed_bars", start="2024-01-01", end="2024-06-30", symbols=spark.createDataFrame([("600001.SH",), ("600004.SH",)], "symbol string"))
        following = every.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))
        assert following.count() == 48
        lines = following._jdf.queryExecution().executedPlan().toString().splitlines()
        moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i in moved:  # what is below an exchange: the asked symbols alone
            below = lines[i + 1:next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(lines[i])), len(lines))]
            assert not [line for line in below if "parquet" in line]
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_bars")
