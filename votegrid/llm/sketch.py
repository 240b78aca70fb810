"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range.
Sketches of any two texts can be merged by union, and the share of the smaller
one that the larger one holds estimates containment however unequal they are.
Of short texts, of which a fraction would be little or nothing, every hash is
retained; two such texts are compared by all of them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import python_ready
from votegrid.llm.simhash import shingle_hashes

WORDS, FRACTION, SEED = 5, 0.25, 42
#: Of texts with fewer distinct shingles all are retained.
SHORT = 64
#: Keys sampled for each bound of a partition.
SAMPLED = 30

_OUT = (
    "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


class Sketch(NamedTuple):
    """Sorted distinct upper halves of 64-bit shingle hashes; ``whole`` if no
    threshold was applied."""

    values: np.ndarray
    whole: bool

    def below(self, fraction: float) -> np.ndarray:
        """What lies below the threshold."""
        return self.values[: np.searchsorted(self.values, _limit(fraction))]


def _limit(fraction: float) -> int:
    return int(fraction * 2**32)


def sketch(text: str | None, words: int = WORDS, fraction: float = FRACTION, seed: int = SEED) -> Sketch:
    """The sketch of a whole text."""
    every, kept = np.empty(0, np.uint64), []
    for block in shingle_hashes(text, words, seed):
        found = np.unique(block >> np.uint64(32))
        if len(every) < SHORT:
            every = np.union1d(every, found) if len(every) else found
        kept.append(found[: np.searchsorted(found, np.uint64(_limit(fraction)))])
    if len(every) < SHORT:
        return Sketch(every.astype("<u4"), True)
    return Sketch((kept[0] if len(kept) == 1 else np.unique(np.concatenate(kept))).astype("<u4"), False)


def encode(found: Sketch) -> str:
    return ("w" if found.whole else "s") + base64.b64encode(found.values.tobytes()).decode()


def decode(fingerprint: str) -> Sketch:
    return Sketch(np.frombuffer(base64.b64decode(fingerprint[1:]), dtype="<u4"), fingerprint[0] == "w")


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION) -> Sketch:
    """The sketch of both texts together."""
    if a.whole and b.whole:
        return Sketch(np.union1d(a.values, b.values), True)
    return Sketch(np.union1d(a.below(fraction), b.below(fraction)), False)


def containment(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """Estimated share of the smaller text's shingles that the larger one has; 0 where
    one of the two has nothing to compare."""
    one, two = (a.values, b.values) if a.whole and b.whole else (a.below(fraction), b.below(fraction))
    least = min(len(one), len(two))
    return len(np.intersect1d(one, two, assume_unique=True)) / least if least else 0.0


def likeness(a: Sketch, b: Sketch, fraction: float = FRACTION) -> float:
    """1 for equal fingerprints, those of two texts without words too; else the containment."""
    same = a.whole == b.whole and np.array_equal(a.values, b.values)
    return 1.0 if same else containment(a, b, fraction)


def sketches(text: Column) -> Column:
    """Fingerprint of a text column, for use in any plan."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([encode(sketch(x.as_py())) for x in texts], pa.string())

    return run(text)


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's head."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _key(doc_id, text_hash: int) -> tuple:
    """The place of a row in the order of all: nulls first, then by id and text hash."""
    return doc_id is not None, doc_id, text_hash


def _bounds(keys: DataFrame, buckets: int) -> list[tuple]:
    """Keys that cut all rows into at most ``buckets`` parts, none of them empty, from
    a sample of some tens a part.  Where they lie changes no result."""
    step = max(1, keys.count() // (buckets * SAMPLED))
    some = keys.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(step)) == 0).distinct().collect()
    ordered = sorted(_key(r.doc_id, r.h) for r in some)
    # a part holds the key at its upper end, the last one the last key of the sample
    return sorted({ordered[k * len(ordered) // buckets] for k in range(1, buckets)} - {ordered[-1]}) if ordered else []


def with_successor(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows in ascending order of (id, text hash) per partition, each partition closed
    by the row that follows it (``closing`` = 1; after the last, the first).

    The texts are shuffled once.  An id of any number of rows is spread over
    partitions; only rows that agree in id and text stay together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    bounds = _bounds(rows.select("doc_id", "h"), buckets)

    @F.arrow_udf("int")
    def part(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_left(bounds, _key(a, b)) for a, b in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)], pa.int32())

    known = F.col("doc_id").isNotNull()
    least = rows.select("doc_id", "h", part("doc_id", "h").alias("at")).groupBy("at").agg(F.min(F.struct(known, "doc_id", "h")).alias("key")).collect()
    heads, last = {_key(r.key.doc_id, r.key.h) for r in least}, len(bounds)

    @F.arrow_udf("array<struct<at:int,closing:int>>")
    def routes(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            at = bisect.bisect_left(bounds, key := _key(a, b))
            found.append([{"at": at, "closing": 0}, *([{"at": at - 1 if at else last, "closing": 1}] if key in heads else [])])
        return pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("closing", pa.int32())])))

    return (
        rows.withColumn("route", F.explode(routes("doc_id", "h")))
        .select("doc_id", "text", "route.at", "route.closing", "h")
        .repartitionById(last + 1, F.col("at"))
        .sortWithinPartitions("at", "closing", F.col("doc_id").asc_nulls_first(), "h")
    )


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    fraction: float = FRACTION,
    seed: int = SEED,
    buckets: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    * Null text counts as empty.  Null ids come before all others.
    * Rows of one id follow each other in the order of their texts' hashes;
      repeated rows are each other's next document.
    * A table of one row is its own next document; an empty one gives no rows.
    * Likeness is that of the fingerprints: 1 if they are equal, else the containment.
      Texts without words have equal fingerprints; beside a text with words they
      have likeness 0, as has a very short one of which nothing falls below the
      threshold beside a long one.
    * Extra columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _OUT.format(kind=kind)
    ordered = with_successor(docs, id_col, text_col, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor is awaited
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, closing in zip(batch.column(0), batch.column(1), batch.column(3), strict=True):
                if closing.as_py() and held is None:
                    continue
                text = text.as_py()
                mine = sketch(text, words, fraction, seed)
                if held is not None:
                    key, old, seen = held
                    changed = edited_text(old, text)
                    other = sketch(changed, words, fraction, seed)
                    out.append((
                        key, len(old), hashlib.sha256(changed.encode()).hexdigest(), encode(seen), encode(other),
                        likeness(seen, other, fraction), likeness(seen, mine, fraction),
                    ))
                held = None if closing.as_py() else (doc_id.as_py(), text, mine)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return ordered.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, its edited text and its next document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
