"""Transaction requests: schema, tolerant JSON parsing and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.functions.lanes import feature_lanes, quantize
from votegrid.functions.moments import parse_instant
from votegrid.plans.config import Normalization

#: Numbers are read as doubles and checked for being integral afterwards: an
#: integer column would turn 2.0 into null.
REQUEST_SCHEMA = (
    "id STRING, transaction STRUCT<amount: DOUBLE, installments: DOUBLE, requested_at: STRING>, "
    "customer STRUCT<avg_amount: DOUBLE, tx_count_24h: DOUBLE, known_merchants: ARRAY<STRING>>, "
    "merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>, "
    "terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>, "
    "last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>, _corrupt STRING"
)
_REQUIRED = (
    "id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount",
    "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount",
    "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
)


def _integral(x: Column) -> Column:
    return x == F.floor(x)


def parse_requests(frame: DataFrame, body: str = "body", key: str = "request_id") -> DataFrame:
    """``key``, ``valid`` and the flat request columns of JSON texts.

    Keys may come in any order and others may be added.  A text is invalid if it
    is no JSON object, a required field is missing or of another type, a count is
    no integer, or a timestamp is malformed or no calendar instant.
    """
    r = F.from_json(F.col(body), REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = frame.select(F.col(key).alias("request_id"), r.alias("r"))
    f = lambda name: F.col(f"r.{name}")
    last = f("last_transaction")
    flat = read.select(
        "request_id", f("id").alias("id"), f("transaction.amount").alias("amount"), f("transaction.installments").alias("installments"),
        parse_instant(f("transaction.requested_at")).alias("requested_at"), f("customer.avg_amount").alias("customer_avg"),
        f("customer.tx_count_24h").alias("tx_count_24h"), f("customer.known_merchants").alias("known_merchants"),
        f("merchant.id").alias("merchant_id"), f("merchant.mcc").alias("mcc"), f("merchant.avg_amount").alias("merchant_avg"),
        f("terminal.is_online").alias("is_online"), f("terminal.card_present").alias("card_present"),
        f("terminal.km_from_home").alias("km_from_home"), parse_instant(f("last_transaction.timestamp")).alias("last_at"),
        f("last_transaction.km_from_current").alias("last_km"),
        (
            F.col("r").isNotNull() & f("_corrupt").isNull() & ~_any_null(f)
            & F.coalesce(_integral(f("transaction.installments")) & _integral(f("customer.tx_count_24h")), F.lit(False))
            & ~F.exists(F.coalesce(f("customer.known_merchants"), F.array().cast("array<string>")), lambda m: m.isNull())
            & parse_instant(f("transaction.requested_at")).isNotNull()
            & (last.isNull() | (parse_instant(f("last_transaction.timestamp")).isNotNull() & f("last_transaction.km_from_current").isNotNull()))
        ).alias("valid"),
    )
    return flat.withColumn("valid", F.coalesce("valid", F.lit(False)))


def _any_null(f) -> Column:
    missing = f(_REQUIRED[0]).isNull()
    for name in _REQUIRED[1:]:
        missing = missing | f(name).isNull()
    return missing


def quantised_vectors(frame: DataFrame, n: Normalization = Normalization(), body: str = "body", key: str = "request_id") -> DataFrame:
    """From JSON texts to ``request_id, valid, vec`` in one call: the quantised lanes of
    a valid request, null for any other."""
    parsed = parse_requests(frame, body, key)
    return parsed.select("request_id", "valid", F.when(F.col("valid"), quantize(feature_lanes(n), n.scale)).alias("vec"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line; ids are the requests' own."""
    return parse_requests(spark.read.text(path).select(F.monotonically_increasing_id().alias("request_id"), F.col("value").alias("body")))
