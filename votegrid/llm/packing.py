"""Best-fit packing planned over a histogram of lengths.

Executors tokenise and cut; the driver sees only how many pieces there are of
each of the at most ``capacity`` lengths, and runs best-fit decreasing over those
counts.  Its plan is a table of slots (length, ranks, sequences, offset); pieces
take their slots by joining on their rank within their length.  Ranks are dealt
per task and shifted by a prefix sum, so no length is gathered anywhere.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.llm.common import keyed, python_ready
from votegrid.storage import Scratch

CAPACITY = 2048
#: Words whose ids one worker remembers.
CACHED_WORDS = 200_000
#: A space that begins a word: the tokenizer's pre-tokenisation always cuts there.
_CUT = re.compile(r" (?=\S)")

_PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"
_SLOTS = "slot_length long, first_rank long, end_rank long, per_sequence long, first_sequence long, slot_offset long"


class WordTokens:
    """Token ids of texts, word by word, as little-endian unsigned 32-bit values.

    The byte-level pre-tokeniser never lets a token run across a space that is
    followed by a non-space, so ids of a text are those of its words in a row.
    ``ranks_path`` names the same vocabulary as merge ranks; a faster library
    encodes plain words from it, everything else goes through the tokenizer.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their names in a text are text
        self._quick = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        # letters up to Latin Extended-B: both libraries class them alike
        if self._quick is not None and word.replace("\n", "").isprintable() and max(word, default="") < "\u0250":
            ids = self._quick(word)
        else:
            ids = self._tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        first, *words = text.split(" ")
        get = self._known.get
        parts = [get(w) for w in words]
        if None in parts:
            new = {w for w, p in zip(words, parts, strict=True) if p is None}
            if any(not w or w[0].isspace() for w in new):  # runs of white space
                first, *words = _CUT.split(text)
                parts = [get(w) for w in words]
                new = {w for w, p in zip(words, parts, strict=True) if p is None}
            fresh = {w: self._one(" " + w) for w in new}
            if len(self._known) < CACHED_WORDS:
                self._known.update(fresh)
            parts = [fresh[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return self._one(first) + b"".join(parts)


@lru_cache(maxsize=1)
def word_tokens(*paths: str | None) -> WordTokens:
    """One per worker process: its memory of words serves all tasks of the worker."""
    return WordTokens(*paths)


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces, and the end: only the first may be shorter."""
    head = length % capacity or capacity
    return [0, *range(head, length, capacity), length] if length > capacity else [0, length]


def pieces(docs: DataFrame, vocabulary: tuple[str | None, ...], capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """Token pieces of every document, numbered per task and length."""
    python_ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = word_tokens(*vocabulary), np.zeros(capacity + 1, np.int64).tolist()
        task = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(tokens(text.as_py()) + end)
                cuts = cut_points(len(ids) // 4, capacity)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((row, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                    seen[b - a] += 1
            row, piece, start, length, crc, nth = zip(*out, strict=True) if out else [()] * 6
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return source.mapInArrow(run, _PIECES.format(kind=docs.schema[id_col].dataType.simpleString()))


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts; slots as in ``_SLOTS``.

    Sequences with equal room are ranges of numbers.  A bin with the least
    sufficient room r stays the best fit for the same length until less than
    that is left, so it takes r // length pieces at once.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots, used = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = next((r for r in range(length, capacity + 1) if room[r]), None)
            if r is None:
                r, fresh = capacity, max(1, left // (capacity // length))
                room[r].append((used, fresh))
                used += fresh
            first, count = room[r].pop()
            each = min(r // length, left)
            take = min(count, left // each)
            slots.append((length, rank, rank + take * each, each, first, capacity - r))
            rank, left = rank + take * each, left - take * each
            if count > take:
                room[r].append((first + take, count - take))
            if r - each * length:
                room[r - each * length].append((first, take))
    return slots


def pack(
    docs: DataFrame,
    vocabulary: tuple[str | None, ...],
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  Every document ends with id 0.  ``vocabulary`` has the tokenizer's
    path, and optionally the path of its merge ranks and its splitting pattern.

    * Null text counts as empty: one piece holding the end id alone.
    * Null ids are carried along; repeated rows are packed as often as they occur.
    * Documents longer than ``capacity`` are cut, the first piece may be shorter.
    * Empty table: empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut = scratch.stage(pieces(docs, vocabulary, capacity, id_col, text_col), "pieces")
    counts = scratch.stage(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most ``capacity`` rows, whatever the input
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = scratch.stage(
        spark.createDataFrame(plan_best_fit(histogram, capacity), _SLOTS).coalesce(1), "slots"
    )
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.stage(counts.select(
        F.col("task").alias("b_task"), F.col("length").alias("b_length"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"),
    ), "base")
    # a row for each task and length: counted, and beyond the bound shuffled like any table
    scratch.keep("pieces", "slots", "base")
    ranked = cut.join(keyed(base), (F.col("task") == F.col("b_task")) & (F.col("length") == F.col("b_length")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    # the slots number a few for each length: bounded by the plan, and counted
    placed = ranked.join(
        keyed(slots),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")),
    )
    turn = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - first_rank) div per_sequence")).alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(turn, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def byte_vocabulary() -> tuple[str, str, str]:
    """Where the byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary())
