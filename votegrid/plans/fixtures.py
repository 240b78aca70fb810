"""The given test tables seen as references, queries and requests.

No labelled fraud data ships, so embeddings stand in for vectors and events for
transactions.  The definitions exist twice: as DataFrames and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.plans.config import DIM, FLAG_LANES, Normalization

#: Amounts of the event table reach 490, so that lanes 0 and 13 vary.
NORMALIZATION = Normalization(max_amount=500.0, max_merchant_avg_amount=500.0)
CATEGORY_OF = {"click": "5411", "view": "5812", "purchase": "7995", "signup": "5999", "error": "0000"}


def _vectors(frame: DataFrame) -> DataFrame:
    lanes = []
    for k in range(DIM):
        x = F.get("embedding", F.lit(k)).cast("double")
        lanes.append(F.when(x >= 0, 10000).otherwise(0) if k in FLAG_LANES else F.round(x * 10000))
    return frame.select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).cast("tinyint").alias("label"), F.array(*[x.cast("smallint") for x in lanes]).alias("vec"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of ``embeddings``.  Ids of that table are dense, so the rank of
    an id among them is arithmetic."""
    rows = _vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 10 <> 0"))
    return rows.select(F.expr("vec_id - vec_id div 10 - 1").alias("record_index"), "label", "vec")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 10 = 0"))
    return rows.select(F.col("vec_id").alias("query_id"), "vec")


def _lane_sql(k: int) -> str:
    x = f"CAST(embedding[{k + 1}] AS DOUBLE)"
    return f"CAST(CASE WHEN {x} >= 0 THEN 10000 ELSE 0 END AS BIGINT)" if k in FLAG_LANES else f"CAST(round({x} * 10000) AS BIGINT)"


_LANES_SQL = ", ".join(_lane_sql(k) for k in range(DIM))
VECTORS_SQL = f"""
E AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, [{_LANES_SQL}] AS v FROM embeddings),
R AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS record_index, label, v FROM E WHERE vec_id % 10 <> 0),
Q AS (SELECT vec_id AS query_id, v FROM E WHERE vec_id % 10 = 0)"""


def l2_sql(a: str, b: str, lanes: range = range(DIM)) -> str:
    return "(" + " + ".join(f"({a}[{k + 1}] - {b}[{k + 1}]) * ({a}[{k + 1}] - {b}[{k + 1}])" for k in lanes) + ")"


def flags_sql(a: str, b: str) -> str:
    return " AND ".join(f"{a}[{k + 1}] = {b}[{k + 1}]" for k in FLAG_LANES)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat request columns from ``events``: history comes from the user's earlier
    rows in the order (epoch second, event_id); averages are of whole cents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(
        "event_id", "user_id", "event_type", "value", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86400, -1)
    per_type = e.groupBy("event_type").agg((F.sum("cents") / F.count(F.lit(1)) / 100.0).alias("merchant_avg"))
    category = F.create_map(*[F.lit(x) for pair in CATEGORY_OF.items() for x in pair])
    avg = F.sum("cents").over(earlier) / F.count(F.lit(1)).over(earlier) / 100.0
    rows = e.select(
        F.col("event_id").alias("request_id"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("amount"),
        (F.col("k") % 12 + 1).cast("double").alias("installments"), F.timestamp_seconds("t").alias("requested_at"),
        F.when(F.count(F.lit(1)).over(earlier) > 0, avg).otherwise(0.0).alias("customer_avg"),
        F.count(F.lit(1)).over(day).cast("double").alias("tx_count_24h"),
        F.coalesce(F.array_sort(F.collect_set("event_type").over(earlier)), F.array().cast("array<string>")).alias("known_merchants"),
        F.col("event_type").alias("merchant_id"), F.try_element_at(category, F.col("event_type")).alias("mcc"),
        F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"),
        (F.col("k") * 10).cast("double").alias("km_from_home"), F.timestamp_seconds(F.lag("t").over(order)).alias("last_at"),
        (F.lag("k").over(order) * 5).cast("double").alias("last_km"),
    )
    # one row per event type
    return rows.join(per_type.withColumnRenamed("event_type", "m_id"), F.col("merchant_id") == F.col("m_id")).drop("m_id").withColumn("valid", F.lit(True))


_CATEGORY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_OF.items()) + " END"
REQUESTS_SQL = f"""
EV AS (SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
MA AS (SELECT event_type AS m_id, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS merchant_avg FROM EV GROUP BY 1),
T AS (SELECT event_id AS request_id, value AS amount, CAST(k % 12 + 1 AS DOUBLE) AS installments, t,
             CASE WHEN count(*) OVER e > 0 THEN CAST(sum(cents) OVER e AS DOUBLE) / count(*) OVER e / 100.0 ELSE 0.0 END AS customer_avg,
             CAST(count(*) OVER d AS DOUBLE) AS tx_count_24h, coalesce(list(event_type) OVER e, []) AS known_merchants,
             event_type AS merchant_id, {_CATEGORY_SQL} AS mcc, merchant_avg, event_type IN ('click', 'view') AS is_online,
             event_type = 'purchase' AS card_present, CAST(k * 10 AS DOUBLE) AS km_from_home,
             lag(t) OVER o AS last_t, CAST(lag(k) OVER o * 5 AS DOUBLE) AS last_km
      FROM EV JOIN MA ON event_type = m_id
      WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id),
             e AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             d AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))"""

_C = "least(1.0, greatest(0.0, {}))".format
_RISK_SQL = ("CASE mcc WHEN '5411' THEN 0.15 WHEN '5812' THEN 0.30 WHEN '7995' THEN 0.85 WHEN '5999' THEN 0.50 ELSE 0.5 END")
REQUEST_LANES_SQL = [
    _C("amount / 500.0"), _C("installments / 12.0"),
    f"CASE WHEN customer_avg > 0 THEN {_C('amount / customer_avg / 10.0')} ELSE 1.0 END",
    "((t % 86400) // 3600) / 23.0", "((t // 86400 + 3) % 7) / 6.0",
    f"CASE WHEN last_t IS NOT NULL THEN {_C('greatest(0, t - last_t) / 60.0 / 1440.0')} ELSE -1.0 END",
    f"CASE WHEN last_t IS NOT NULL THEN {_C('last_km / 1000.0')} ELSE -1.0 END",
    _C("km_from_home / 1000.0"), _C("tx_count_24h / 20.0"), "CASE WHEN is_online THEN 1.0 ELSE 0.0 END",
    "CASE WHEN card_present THEN 1.0 ELSE 0.0 END", "CASE WHEN list_contains(known_merchants, merchant_id) THEN 0.0 ELSE 1.0 END",
    _RISK_SQL, _C("merchant_avg / 500.0"),
]
REQUEST_VECTORS_SQL = ", ".join(f"CAST(round(({x}) * 10000) AS BIGINT)" for x in REQUEST_LANES_SQL)


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_id, kind, body``: JSON of the requests, damaged by ``kind``: 0 none,
    1 cut off, 2 no merchant, 3 wrong separator in the time, 4 reordered and extended."""
    r = requests(spark, sf_dir)
    at = F.date_format("requested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sections = {
        "id": F.col("id"),
        "transaction": F.struct("amount", F.col("installments").cast("bigint").alias("installments"), at.alias("requested_at")),
        "customer": F.struct(F.col("customer_avg").alias("avg_amount"), F.col("tx_count_24h").cast("bigint").alias("tx_count_24h"), "known_merchants"),
        "merchant": F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")),
        "terminal": F.struct("is_online", "card_present", "km_from_home"),
        "last_transaction": F.when(F.col("last_at").isNotNull(), F.struct(
            F.date_format("last_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("last_km").alias("km_from_current"))),
    }
    text = lambda names, *more: F.to_json(F.struct(*[sections[n].alias(n) for n in names], *more), {"ignoreNullFields": "false"})
    kind = F.col("request_id") % 5
    names = list(sections)
    whole = text(names)
    body = (
        F.when(kind == 1, F.substring(whole, 1, 60)).when(kind == 2, text([n for n in names if n != "merchant"]))
        .when(kind == 3, F.regexp_replace(whole, r"(\d{4})-(\d{2})-(\d{2})T", "$1/$2/$3T"))
        .when(kind == 4, text(names[::-1], F.lit("more").alias("note"))).otherwise(whole)
    )
    return r.select("request_id", kind.alias("kind"), body.alias("body"))
