"""Exact deduplication: 128-bit content hash, byte comparison inside groups.

Only (id, hash) rows are shuffled for the grouping.  Texts move only in the
check for collisions, only those of groups with more than one member, and there
they are combined on the map side, so that a group of any size leaves one row
per task and distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import ascii_lower, keyed, unused, without_rows
from votegrid.storage import Scratch


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _bucket(sha: Column, hash_bits: int) -> Column:
    """The leading ``hash_bits`` bits of the digest (a multiple of 8)."""
    return F.substring(sha, 1, hash_bits // 8)


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_bits: int = 128,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256,
    doc_hash``.

    Texts are equal when they are identical after lower-casing A-Z.  ``keep``
    names the id that stays: ``smallest`` or ``largest``.

    * Null text: equal to the empty text.  Null id: orders below every id, so it
      stays only under ``smallest``.
    * Repeated rows (same id and text): exactly one of them is kept.
    * Empty table: empty result.  Extra columns are ignored.
    * A collision of the leading ``hash_bits`` bits between different texts is
      found by comparing bytes; such buckets are grouped by text instead.
    """
    if keep not in ("smallest", "largest") or hash_bits % 8:
        raise ValueError("keep is 'smallest' or 'largest'; hash_bits a multiple of 8")
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    text = ascii_lower(F.col(text_col))

    rows = scratch.stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            _sha(text).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    ).withColumn("h", _bucket(F.col("sha"), hash_bits))

    groups = scratch.stage(_elect(rows, ["h"], keep), "groups")
    repeated = keyed(groups.select(F.col("h").alias("gh")))

    suspects = (
        docs.select(text.alias("norm"))
        .withColumn("h", _bucket(_sha(F.col("norm")), hash_bits))
        .join(repeated, F.col("h") == F.col("gh"), "left_semi")
    )
    # bytes are compared by grouping on the text itself
    collided = scratch.stage(
        suspects.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
        .where("texts > 1").select(F.col("h").alias("ch")),
        "collided",
    )
    if collided.isEmpty():
        return _decide(rows, groups, ["h"])

    bad = keyed(collided)
    clean = rows.join(bad, F.col("h") == F.col("ch"), "left_anti")
    full = scratch.stage(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
        .withColumn("sha", _sha(F.col("norm")))
        .withColumn("h", _bucket(F.col("sha"), hash_bits))
        .join(bad, F.col("h") == F.col("ch"), "left_semi")
        .withColumn("row", F.monotonically_increasing_id()),
        "collided_rows",
    )
    by_text = scratch.stage(_elect(full, ["h", "norm"], keep), "collided_groups")
    return _decide(clean, groups, ["h"]).unionByName(_decide(full, by_text, ["h", "norm"]))


def _elect(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """For every key with more than one row: its size and the row that stays."""
    entrant = F.struct("doc_id", "row")
    best = F.min(entrant) if keep == "smallest" else F.max(entrant)
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .where("n > 1")
        .select(*keys, "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )


def _decide(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides come from written tables: adaptive execution can split a hot key."""
    groups = groups.withColumnsRenamed({k: f"g_{k}" for k in keys})
    alone = F.col("n").isNull()
    return rows.join(groups, [F.col(k) == F.col(f"g_{k}") for k in keys], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts (the
    one with the smallest id).

    A row is named by (id, text hash); the key table of rows to drop is broadcast
    only within a counted size.  Of rows that agree in both, one stays.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    marks = scratch.stage(mark_duplicates(docs, id_col, text_col, "smallest", scratch=scratch), "marks")
    keys = ["doc_id", "text_sha256"]
    per_key = scratch.stage(
        marks.where("group_size > 1").groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("kept").cast("int")).alias("stays")),
        "per_key",
    )
    scratch.keep("per_key")
    named = {"doc_id": F.col(id_col), "text_sha256": F.sha2(ascii_lower(F.col(text_col)), 256)}
    out = without_rows(docs, named, per_key.where("stays = 0 or rows > 1").select(*keys))
    again = per_key.where("stays = 1 and rows > 1").select(*keys)
    if not again.isEmpty():  # repeated rows: one of each
        same = without_rows(docs, named, again, "left_semi")
        own = unused(same, "key_id", "key_sha")
        first = same.withColumns(dict(zip(own, named.values(), strict=True))).dropDuplicates(own)
        out = out.unionByName(first.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; of equal texts the largest doc_id stays."""
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


#: ``translate`` keeps A-Z folding apart from other scripts, as the operator does.
SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
