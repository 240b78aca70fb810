"""Labelled reference vectors: reading, validation, numbering and storage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.functions.lanes import array_lanes, quantize
from votegrid.plans.config import DIM, Normalization
from votegrid.storage import Scratch

RAW_SCHEMA = "vector ARRAY<DOUBLE>, label STRING"
STORED = ("record_index", "label", "vec")


class InvalidReference(ValueError):
    """A reference record has the wrong shape or label."""


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{vector, label}`` (plain or .gz), or one object per line
    for large sets; malformed input raises."""
    whole = spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST")
    lines = path.rsplit("/", 1)[-1].removesuffix(".gz").endswith((".jsonl", ".ndjson"))
    return whole.option("multiLine", not lines).json(path)


def encode_label(label: Column) -> Column:
    """legit 0, fraud 1; any other raises."""
    return (
        F.when(label == "legit", 0).when(label == "fraud", 1)
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))).cast("tinyint")
    )


def checked_vector(vector: Column, dim: int = DIM) -> Column:
    wrong = vector.isNull() | (F.size(vector) != dim) | F.exists(vector, lambda x: x.isNull())
    return F.when(wrong, F.raise_error(F.lit(f"a vector must have {dim} numbers"))).otherwise(vector)


def number_rows(frame: DataFrame, name: str = "record_index", scratch: Scratch | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the frame's own order, without one task that
    sees all rows: positions within partitions plus a prefix sum over partitions."""
    scratch = scratch or Scratch(frame.sparkSession, "number")
    seen = scratch.stage(
        frame.withColumn("__row", F.monotonically_increasing_id()), "numbered"
    ).withColumns({"__part": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND((1 << 33) - 1)})
    sizes = seen.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__part").alias("__p"), before.alias("__start"))  # a row per partition
    return seen.join(starts, F.col("__part") == F.col("__p")).select(
        (F.col("__start") + F.col("__at")).cast("bigint").alias(name), *[F.col(f"`{c}`") for c in frame.columns]
    )


def prepare_references(raw: DataFrame, n: Normalization = Normalization()) -> DataFrame:
    """Validated, quantised and numbered ``record_index, label, vec``."""
    vector = checked_vector(F.col("vector"))
    ready = raw.select(encode_label(F.col("label")).alias("label"), quantize(array_lanes(vector), n.scale).alias("vec"))
    return number_rows(ready).select(*STORED)


def write_references(refs: DataFrame, path: str) -> None:
    """Write, read again and compare the count and the first record."""
    refs.write.mode("overwrite").parquet(path)
    back = refs.sparkSession.read.parquet(path)
    first = lambda f: f.orderBy("record_index").limit(1).collect()
    if back.count() != refs.count() or first(back.select(*STORED)) != first(refs.select(*STORED)):
        raise OSError(f"{path} does not hold what was written")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*STORED)


def label_histogram(refs: DataFrame) -> DataFrame:
    return refs.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("legit")
    )


def load_category_risk(path: str) -> dict[str, float]:
    """Category risks from a small JSON object on the driver."""
    with open(path, encoding="utf-8") as source:
        return {str(k): float(v) for k, v in json.load(source).items()}


def warm(frame: DataFrame) -> DataFrame:
    """Keep a table in executor memory from now on."""
    frame = frame.persist()
    frame.count()
    return frame
