"""Timestamps, feature lanes and quantisation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from votegrid.functions import lanes, moments

FLAT = (
    "request_id long, amount double, installments double, requested_at timestamp, customer_avg double, tx_count_24h double, "
    "known_merchants array<string>, merchant_id string, mcc string, merchant_avg double, is_online boolean, card_present boolean, "
    "km_from_home double, last_at timestamp, last_km double"
)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=None)


def row(**change):
    base = dict(
        request_id=1, amount=41.0, installments=2.0, requested_at=at("2026-03-11T18:00:00"), customer_avg=82.0, tx_count_24h=3.0,
        known_merchants=["MERC-001"], merchant_id="MERC-001", mcc="5411", merchant_avg=60.0, is_online=False, card_present=True,
        km_from_home=29.2, last_at=None, last_km=None,
    )
    return tuple((base | change).values())


def vector(spark, table=None, **change):
    frame = spark.createDataFrame([row(**change)], FLAT)
    exprs = lanes.feature_lanes(table=table) if table is not None else lanes.feature_lanes()
    return frame.select(F.array(*exprs).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "weekday", "epoch"),
    [
        ("2026-03-11T20:23:35Z", 2, 1773260615), ("2026-03-14T00:00:00Z", 5, None), ("2026-01-04T00:00:00Z", 6, None),
        ("2026-01-05T00:00:00Z", 0, None), ("1970-01-01T00:00:00Z", 3, 0), ("2000-01-01T00:00:00Z", 5, 946684800),
    ],
)
def test_instants(spark, text, weekday, epoch):
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in moments.parts(F.col("t")).items()]).first()
    assert (got.year, got.month, got.day) == tuple(map(int, text[:10].split("-")))
    assert (got.hour, got.minute, got.second) == tuple(map(int, text[11:19].split(":")))
    assert got.weekday == weekday
    assert epoch is None or got.epoch == epoch


@pytest.mark.parametrize("text", ["2026-03-11T20:23:35", "2026/03/11T20:23:35Z", "20X6-03-11T20:23:35Z", "2026-13-01T00:00:00Z", "2026-02-30T00:00:00Z", "", None])
def test_instants_refused(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(moments.parse_instant(F.col("t")).alias("x")).first().x is None


def test_difference(spark):
    frame = spark.createDataFrame([(at("2026-03-11T18:30:00"), at("2026-03-11T18:00:00"))], "a timestamp, b timestamp")
    got = frame.select(lanes.minutes_between(F.col("a"), F.col("b")).alias("x"), lanes.minutes_between(F.col("b"), F.col("a")).alias("y")).first()
    assert (got.x, got.y) == (30.0, 0.0)


def test_ordinary_request(spark):
    expected = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert vector(spark) == pytest.approx(expected, abs=5e-4)


def test_suspicious_request(spark):
    got = vector(
        spark, {"7995": 0.75}, amount=9506.0, installments=10.0, requested_at=at("2026-03-14T05:00:00"), customer_avg=100.0, tx_count_24h=25.0,
        known_merchants=["MERC-OTHER"], merchant_id="MERC-NEW", mcc="7995", merchant_avg=55.0, km_from_home=952.3,
    )
    assert got == pytest.approx([0.9506, 0.8333, 1, 0.2174, 0.8333, -1, -1, 0.9523, 1, 0, 1, 1, 0.75, 0.0055], abs=5e-4)


def test_last_transaction(spark):
    got = vector(spark, requested_at=at("2026-03-11T18:30:00"), last_at=at("2026-03-11T18:00:00"), last_km=250.0)
    assert got[5:7] == pytest.approx([30 / 1440, 0.25])


def test_unknown_category_and_no_average(spark):
    assert vector(spark, {}, mcc="9999")[12] == 0.5
    assert vector(spark, customer_avg=0.0)[2] == 1.0


def test_category_by_number(spark):
    frame = spark.createDataFrame([(5411, "5411"), (742, "742"), (None, None)], "n int, s string")
    table = {"5411": 0.15, "742": 0.9, "x": 1.0}
    got = frame.select(lanes.category_risk_by_number(F.col("n"), table).alias("n"), lanes.category_risk(F.col("s"), table).alias("s")).collect()
    assert [tuple(r) for r in got] == [(0.15, 0.15), (0.9, 0.9), (0.5, 0.5)]


def test_quantisation(spark):
    values = [0.0, 1.0, -1.0, 0.5, 0.25, 0.0041, 0.1667, 9.0, -9.0, 0.00005, -0.00005]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.q for r in frame.select(lanes.quantize_lane(F.col("x")).alias("q")).collect()]
    assert got == [0, 10000, -10000, 5000, 2500, 41, 1667, 32767, -32768, 1, -1]
    assert [r.q for r in frame.select(lanes.truncate_lane(F.col("x")).alias("q")).limit(3).collect()] == [0, 10000, -10000]


def test_sentinels(spark):
    frame = spark.createDataFrame([row()], FLAT).select(lanes.quantize(lanes.feature_lanes()).alias("q"))
    assert frame.first().q[5:7] == [-10000, -10000]


def test_clamp_nan_and_null(spark):
    frame = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (-2.0,)], "x double")
    assert [r.c for r in frame.select(lanes.clamp(F.col("x")).alias("c")).collect()] == [0.0, None, 1.0, 0.0]
