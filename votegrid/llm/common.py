"""Shared pieces of the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.storage import reachable, within

#: Rows of a key table up to which it may be broadcast (about 64 bytes a row).
BROADCAST_ROWS = 500_000
#: Bytes of text in one Arrow batch handed to Python: bounds a worker's memory
#: whatever the length of the texts.
ARROW_BATCH_BYTES = 4 << 20


def python_ready(spark: SparkSession) -> None:
    """Before a Python stage: bound Arrow batches by bytes (10,000 very long texts
    would not fit), and let workers find the package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    reachable(spark)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    Spark's ``lower`` folds every script, so it serves only texts of plain ASCII
    (as many bytes as code points); the others go through ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Join condition under which nulls equal each other."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from
    every column of ``frame``: private columns beside a caller's own."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def without_rows(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, kind: str = "left_anti") -> DataFrame:
    """``docs`` without the rows whose keys are in the staged table ``gone`` (columns
    named as in ``keys``; nulls equal each other), or with ``left_semi`` those alone;
    its columns, whatever their names, stay as they are."""
    own = unused(docs, *[f"key_{name}" for name in keys])
    named = docs.withColumns(dict(zip(own, keys.values(), strict=True)))
    theirs = unused(named, *[f"gone_{name}" for name in keys])
    gone = keyed(gone).select(*[F.col(name).alias(t) for name, t in zip(keys, theirs, strict=True)])
    condition = F.lit(True)
    for a, b in zip(own, theirs, strict=True):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return named.join(gone, condition, kind).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents by a checksum of their id; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keyed(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged key table, broadcast if its counted size is within ``rows``;
    beyond that Spark shuffles both sides."""
    return F.broadcast(table) if within(table, rows) else table


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
