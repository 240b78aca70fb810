"""Phase timings and request counters as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phases of one request; the first is recorded but never set.
PHASES = ("body_collect", "parse", "vectorize", "search", "centroid", "shortlist", "response")


def phase_stats(timings: DataFrame) -> DataFrame:
    """``phase, count, total_ns, max_ns, avg_ns`` of rows ``phase, ns``; the mean is
    an integer, 0 where nothing was counted."""
    spent = timings.groupBy("phase").agg(
        F.count("ns").alias("count"), F.coalesce(F.sum("ns"), F.lit(0)).alias("total_ns"), F.coalesce(F.max("ns"), F.lit(0)).alias("max_ns")
    )
    return spent.withColumn("avg_ns", F.when(F.col("count") > 0, F.expr("total_ns div count")).otherwise(0).cast("bigint"))


def request_counters(outcomes: DataFrame) -> DataFrame:
    """One row of counters from rows ``failed, fast_path, used_fallback, expanded``."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"), F.count_if("fast_path").alias("fast_path"),
        F.count_if(~F.col("fast_path")).alias("fallback_path"), F.count_if("used_fallback").alias("exact_fallbacks"),
        F.count_if("expanded").alias("expansions"),
    )


def since_reset(events: DataFrame, resets: DataFrame, at: str = "at") -> DataFrame:
    """The rows of ``events`` later than the last of ``resets`` (one column ``at``, a
    reset each): what a snapshot counts.  Without a reset, all rows."""
    last = resets.agg(F.max(at)).first()[0]
    return events if last is None else events.where(F.col(at) > F.lit(last))


def search_metrics(answers: DataFrame) -> DataFrame:
    """One row from ``query_id, votes, used_fallback, expanded``: searches, how many of
    them ended in exact fallback or were expanded, and the votes given."""
    return answers.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if("used_fallback").alias("exact_fallbacks"), F.count_if("expanded").alias("expansions"),
        F.coalesce(F.sum("votes"), F.lit(0)).cast("bigint").alias("votes"),
    )


def snapshot_json(stats: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("stats"))
