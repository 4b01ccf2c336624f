import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import score_of_z
from tidemark.operators import features, nowcast, positioning, rules
from tidemark.plans import dims, opportunity
from tidemark.sources import readers, sinks


def panel(spark, values, asset="a", start=(2000, 1)):
    months = [f"{start[0] + (start[1] - 1 + i) // 12}-{(start[1] - 1 + i) % 12 + 1:02d}" for i in range(len(values))]
    return spark.createDataFrame([(asset, m, v) for m, v in zip(months, values, strict=True) if v is not None], "asset string, month string, value double")


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    ("values", "known", "stage", "passed"),
    [
        ([1.0] * 12, False, None, False),
        ([1.0] * 13, True, "MIXED", False),
        ([float(i) for i in range(1, 14)], True, "CONFIRMED_UP", True),
        ([float(i) for i in range(13, 0, -1)], True, "CONFIRMED_DOWN", False),
        ([10.0] * 9 + [1.0, 1.0, 1.0, 2.0], True, "EARLY_UP", True),
        ([1.0] * 9 + [10.0, 9.0, 9.0, 8.0], True, "EARLY_DOWN", True),
        ([0.0] * 13, True, "MIXED", False),
    ],
)
def test_turn(spark, values, known, stage, passed):
    row = one(features.turn(panel(spark, values)))
    assert (row.available, row.stage, row["pass"]) == (known, stage, passed)


def test_turn_counts_rows_not_months(spark):
    values = [float(i) for i in range(1, 15)]
    values[5] = None
    row = one(features.turn(panel(spark, values)))
    assert row.available and row.return_3m_pct == round(100 * (14 / 11 - 1), 1)


@pytest.mark.parametrize(
    ("values", "log", "known"),
    [([1.0 + i for i in range(59)], True, False), ([1.0 + i for i in range(60)], True, True), ([5.0] * 60, True, False), ([0.0] + [1.0 + i for i in range(59)], True, False), ([0.0] + [1.0 + i for i in range(59)], False, True)],
)
def test_zscore_bounds(spark, values, log, known):
    row = one(features.dislocation(panel(spark, values), log=log))
    assert row.available == known
    if known:
        x = [math.log(v) if log else v for v in values]
        mean = sum(x) / 60
        assert row.z == pytest.approx((x[-1] - mean) / math.sqrt(sum((v - mean) ** 2 for v in x) / 59))


def test_cheapness_uses_the_raw_score(spark):
    rows = spark.createDataFrame([(-0.996,), (-1.0,), (1.0,)], "z double")
    got = rows.select(rules.short_dislocation(F.lit("RESEARCH_DATA_INCOMPLETE"), F.lit(True), F.round("z", 2)).alias("s"), (F.col("z") <= -1).alias("p")).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False)]


def test_deflator_gap_does_not_join(spark):
    cpi = spark.createDataFrame([("2000-01", 2.0), ("2000-03", 4.0)], "month string, value double")
    got = features.real_panel(panel(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), cpi).orderBy("month").collect()
    assert [(r.month, r.value) for r in got] == [("2000-02", 1.0), ("2000-04", 1.0)]


def test_month_last_drops_what_is_not_finite(spark):
    rows = [("a", "2000-01-01", 1.0, 1), ("a", "2000-01-31", float("nan"), 2), ("a", "2000-01-31", 3.0, 1), ("a", "2000-01-31", 4.0, 3), ("a", "2000-02-01", None, 1), ("a", "2000-03-01", 9.0, 1)]
    df = spark.createDataFrame(rows, "k string, d string, v double, t int").withColumn("d", F.to_date("d"))
    assert [(r.month, r.value) for r in features.month_last(df, "k", "d", "v", "t", "2000-03-15").collect()] == [("2000-01", 4.0)]


def test_goldens(spark):
    s = dims.STATE
    got = one(spark.range(1).select(score_of_z(F.lit(s["usd_z"])).alias("u"), score_of_z(F.lit(s["fxn_z"])).alias("f"), rules.regime(F.lit(s["usd_score"])).alias("ru"),
        rules.regime(F.lit(s["candidate_usd"])).alias("rc"), rules.funding_regime(F.lit(s["funding_score"])).alias("rf"), rules.agreement(F.lit(s["usd_score"]), F.lit(s["fxn_score"])).alias("ag")))
    assert got.u == pytest.approx(s["usd_score"]) and got.f == pytest.approx(s["fxn_score"])
    assert (got.ru, got.rc, got.rf, got.ag) == ("RISK-ON", "NEUTRAL", "RESTRICTIVE", "DIVERGENT")
    now = one(nowcast.summary(dims.nowcast_blocks(spark)))
    assert (now.accelerating, now.decelerating, now.stable, now.expanding, now.tilt) == (3, 1, 0, 4, "SUPPORTIVE_MIXED")


def test_direction_bounds(spark):
    rows = spark.createDataFrame([(0.25,), (0.26,), (-0.25,), (-0.26,), (None,)], "d double")
    assert [r[0] for r in rows.select(nowcast.direction(F.col("d"), F.lit(0.0))).collect()] == ["STABLE", "ACCELERATING", "STABLE", "DECELERATING", None]


@pytest.mark.parametrize(
    ("date", "value", "reason"),
    [("2026-06", 5.0, None), ("2026-05", 5.0, "date regression"), ("2026-13", 5.0, "invalid month"), (None, 5.0, "invalid month"), ("2026-07", -20.01, "implausible growth"),
     ("2026-07", 30.0, None), ("2026-07", float("nan"), "implausible growth"), ("2026-06", 10.01, "same-month revision too large")],
)
def test_refusal(spark, date, value, reason):
    got = one(spark.createDataFrame([(date, value)], "d string, v double").select(nowcast.refusal(F.lit("2026-06"), F.lit(5.0), F.col("d"), F.col("v")).alias("r")))
    assert got.r == reason


def test_positions_hit_once_and_percentile_of_ties(spark):
    rows = spark.createDataFrame([(f"2000-01-0{i}", "GOLD GOLD SILVER", None, 10.0, 5.0, 2.0) for i in range(1, 5)], "date string, market string, commodity string, oi double, long double, short double")
    terms = spark.createDataFrame([("g", ["GOLD", "SILVER"], True), ("n", ["TIN"], True)], "asset string, terms array<string>, with_commodity boolean")
    got = one(positioning.summary(positioning.series(positioning.matched(rows, positioning.named(rows, terms)))))
    assert (got.asset, got.percentile, got.z_3y, got.crowded, got["pass"]) == ("g", 100.0, None, True, False)


def test_unavailable_positions_still_count_as_crowded_in_triggers(spark):
    tilt = spark.createDataFrame([("MIXED",)], "tilt string")
    empty = panel(spark, [])
    held = dims.assets(spark).select("asset", F.lit(False).alias("available"), F.lit(False).alias("pass"), F.lit(True).alias("crowded"), F.lit(90.0).alias("percentile_3y"))
    rows = {r.asset: r for r in opportunity.opportunity(dims.assets(spark), empty, empty.select("month", "value"), empty.withColumnRenamed("asset", "series"), held, tilt).collect()}
    assert len(rows) == 17
    assert rows["SPY"].s_label == "DATA INCOMPLETE" and rows["SPY"].action == "WAIT" and rows["HYG"].action == "INSUFFICIENT HISTORY"
    assert any("crowded" in x for x in rows["SPY"].downgrade)
    assert rows["SPY"].e_label == "UNCONFIRMED"


def test_resolve_column():
    names = ["Report_Date_as_YYYY_MM_DD", "lev_money_positions_long", "Open_Interest_All"]
    assert readers.resolve_column(names, "OPEN_INTEREST_ALL") == "Open_Interest_All"
    assert readers.resolve_column(names, "x", "Lev_Money_Positions_Long_All", "lev_money") == "lev_money_positions_long"
    assert readers.resolve_column(names, "nothing") is None


def test_missing_position_column_is_an_error(spark):
    with pytest.raises(ValueError, match="long"):
        readers.positioning_rows(spark.createDataFrame([("a",)], "market_and_exchange_names string"), "financial", "2000-01-01")


@pytest.mark.parametrize(("as_of", "since"), [("2026-10-31", "2023-10-01"), ("2026-03-31", "2023-03-03"), ("2026-01-15", "2022-12-15")])
def test_look_back(as_of, since):
    assert readers.look_back(as_of) == since


def test_snapshot_is_written_only_if_changed(spark, tmp_path):
    before = dims.nowcast_blocks(spark)
    after = before.withColumn("latest_yoy", F.when(F.col("block") == "us", F.lit(9.0)).otherwise(F.col("latest_yoy")))
    assert not sinks.write_snapshot(before, before, "block", str(tmp_path / "same"))
    assert sinks.write_snapshot(before, after, "block", str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).where("latest_yoy = 9").count() == 1
    sinks.write_documents(after, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    (tmp_path / "contract.json").write_text('{\n"horizons": [1, 3],\n"paths": ["a"]}')
    assert sinks.read_settings(spark, str(tmp_path / "contract.json")).first().horizons == [1, 3]


def test_files(spark, tmp_path):
    (tmp_path / "CPI.csv").write_text("DATE,CPI\n2020-01-01,1.5\n2020-01-31,2.5\n")
    got = readers.parse_macro_csv(readers.read_lines(spark, str(tmp_path / "CPI.csv"))).collect()
    assert [tuple(r) for r in got] == [("CPI", "2020-01", 2.5)]


def test_stream_applies_updates_once(spark, tmp_path):
    from tidemark.streaming import refresh

    blocks, snapshots = dims.nowcast_blocks(spark), str(tmp_path / "snap")
    blocks.write.parquet(f"{snapshots}/version=0")
    schema = "block string, new_date string, new_yoy double"
    spark.createDataFrame([("us", "2026-07", 6.0), ("china", "2026-01", 6.0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    refresh.stream_refresh(stream, snapshots, str(tmp_path / "check")).awaitTermination()
    got = {r.block: (r.latest_date, r.latest_yoy) for r in spark.read.parquet(f"{snapshots}/version=1").collect()}
    assert got["us"] == ("2026-07", 6.0) and got["china"] == ("2026-07", 7.7)
