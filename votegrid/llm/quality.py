"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w over hashed
text features for all grades and ordered thresholds.  Expected grade and tail
probabilities follow from the single score w.x, so Python computes that score and
the rest is arithmetic on columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import keyed, python_ready, unused
from votegrid.storage import Scratch

BITS = 20
#: Rated documents learnt from, about.
SAMPLE_DOCS = 8_000
STEPS, RATE, RIDGE = 600, 0.1, 1e-4
#: A feature is learnt if at least so many rated documents have it, and if its share in
#: a grade differs from that in the others by so many standard errors, up or down.
LEAST_DOCS, SCREEN = 5, 4.5
REMEMBERED = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: The results of :func:`rate`.
RESULTS = ("vg_grade", "vg_tail", "vg_accept")


def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    """Letters as A or a, digits as 9, runs shortened: ``THE!!`` is ``AA!!``."""
    out: list[str] = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != [kind, kind]:
            out.append(kind)
    return "".join(out)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed word, its beginnings, and its shape."""
    tokens = [f"s:{_shape(word)}"]
    for part in _LETTERS.findall(word.lower()):
        tokens.append(f"w:{part}")
        tokens += [f"p:{part[:n]}" for n in (4, 5, 6, 7) if len(part) > n]
    return tuple(map(_hash, tokens))


def features(text: str | None, remembered: dict[str, tuple[int, ...]]) -> list[int]:
    """Distinct hashed features of a whole text."""
    words = (text or "").split()
    found: set[int] = set()
    for word in set(words):
        known = remembered.get(word)
        if known is None:
            known = word_features(word)
            if len(remembered) < REMEMBERED:
                remembered[word] = known
        found.update(known)
    run = best = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    for limit in (3, 5, 8):
        if best >= limit:
            found.add(_hash(f"r:{limit}"))
    return sorted(found)


@dataclass
class Model:
    """``thresholds`` ascending, one fewer than the grades; ``top`` = highest grade."""

    weights: np.ndarray
    thresholds: list[float]

    @property
    def top(self) -> int:
        return len(self.thresholds)


def screened(docs: np.ndarray, size: np.ndarray, least: int, screen: float) -> np.ndarray:
    """Features that tell grades apart, in either direction; the rest only add noise to
    long texts, which have many of them.  ``docs`` has a row for each grade: in how
    many of its ``size`` documents each feature is.  A text without any learnt
    feature is rated by the thresholds alone."""
    every, n = docs.sum(axis=0).astype(float), int(size.sum())
    # smoothed shares: a feature seen by chance in a few documents has no say
    share = (every + 1) / (n + 2)
    keep = np.zeros(len(every), bool)
    for own, count in zip(docs, size, strict=True):
        if 0 < count < n:
            error = np.sqrt(share * (1 - share) * (1 / count + 1 / (n - count)))
            keep |= np.abs(own / count - (every - own) / (n - count)) > screen * error
    return keep & (every >= least)


def train(rows: list[np.ndarray], grades: np.ndarray, top: int) -> Model:
    """Full-batch Adam on the ordinal likelihood with a ridge penalty; ``rows`` has the
    features of each rated document that are to be learnt."""
    weights = np.zeros(1 << BITS, np.float32)
    if not rows:
        return Model(weights, [-1e3 + k for k in range(top)])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index, compact = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    n, width = len(rows), len(index)
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate([np.zeros(width), start[:1], gaps])
    mean, spread = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, cut = state[:width], np.cumsum(np.concatenate([state[width : width + 1], np.exp(state[width + 1 :])]))
        score = np.bincount(owner, w[compact], n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        up, low = edge[grades + 1] - score, edge[grades] - score
        above, below = 1 / (1 + np.exp(-up.clip(-40, 40))), 1 / (1 + np.exp(-low.clip(-40, 40)))
        above[np.isinf(up)], below[np.isinf(low)] = 1.0, 0.0
        span = np.maximum(above - below, 1e-9)
        to_up, to_low = above * (1 - above) / span, below * (1 - below) / span
        slope = np.zeros_like(state)
        slope[:width] = np.bincount(compact, ((to_up - to_low) / n)[owner], width) + RIDGE * w
        by_cut = np.array([(to_low[grades == k + 1].sum() - to_up[grades == k].sum()) / n for k in range(top)])
        slope[width] = by_cut.sum()
        for k in range(1, top):
            slope[width + k] = by_cut[k:].sum() * np.exp(state[width + k])
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        state -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    weights[index] = state[:width]
    cut = np.cumsum(np.concatenate([state[width : width + 1], np.exp(state[width + 1 :])]))
    return Model(weights, cut.tolist())


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    top: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    least_docs: int = LEAST_DOCS,
    screen: float = SCREEN,
    scratch: Scratch | None = None,
) -> Model:
    """Learn from about ``sample_docs`` rated documents, chosen by a hash of the id.

    ``grade`` is a column over ``ratings`` (0 to ``top``); rows where it is null
    are left out.  The chosen ratings are few, so they go to the documents.  The
    driver gets, for each of the 2**BITS features, in how many documents of each
    grade it is, and then of every document those features that pass
    :func:`screened`; never whole feature lists.
    """
    python_ready(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rated = ratings.select(F.col(id_col).alias("r_id"), grade.cast("int").alias("grade")).where("grade is not null and r_id is not null")
    share = min(1.0, sample_docs / max(1, rated.count()))
    chosen = scratch.stage(
        rated.where(F.pmod(F.xxhash64("r_id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20))), "chosen"
    )
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        keyed(chosen), F.col("doc_id") == F.col("r_id")
    ).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict = {}
        for batch in batches:
            found = [features(x.as_py(), remembered) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "found"])

    found = scratch.stage(sample.mapInArrow(run, "grade int, found array<int>"), "features")
    sizes = {r.grade: r["count"] for r in found.groupBy("grade").count().collect()}
    by_grade = [F.count(F.when(F.col("grade") == k, 1)).alias(f"g{k}") for k in range(top + 1)]
    counts = found.select("grade", F.explode("found").alias("feature")).groupBy("feature").agg(*by_grade).toArrow()
    docs_with = np.zeros((top + 1, 1 << BITS), np.int64)
    for k in range(top + 1):
        docs_with[k, counts["feature"].to_numpy()] = counts[f"g{k}"].to_numpy()
    keep = np.flatnonzero(screened(docs_with, np.array([sizes.get(k, 0) for k in range(top + 1)]), least_docs, screen))
    kept = docs.sparkSession.sparkContext.broadcast(keep)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(1)]
            lists = [x[np.isin(x, kept.value)] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["grade", "found"])

    table = found.mapInArrow(thin, "grade int, found array<int>").toArrow()
    scratch.keep()
    lists = table.column("found").combine_chunks() if table.num_rows else []
    return train([x.values.to_numpy(zero_copy_only=False) for x in lists], table.column("grade").to_numpy().astype(int), top)


def score(model: Model, text: Column, spark: SparkSession) -> Column:
    """The linear score of a text column."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model.weights)  # 2**BITS floats

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered: dict = {}
        for part in parts:
            yield pa.array([float(shared.value[features(x.as_py(), remembered)].sum()) for x in part], pa.float64())

    return run(text)


def tail(model: Model, linear: Column, grade: int) -> Column:
    """P(rating >= grade)."""
    if grade <= 0:
        return F.lit(1.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), F.lit(model.thresholds[grade - 1]) - linear)))


def expected(model: Model, linear: Column) -> Column:
    total = F.lit(0.0)
    for k in range(1, model.top + 1):
        total = total + tail(model, linear, k)
    return total


def rate(docs: DataFrame, model: Model, text_col: str = "text", accept: int = 2, least: float = 0.5) -> DataFrame:
    """``docs`` with ``vg_grade``, ``vg_tail`` and ``vg_accept`` added.

    A row is accepted if P(rating >= ``accept``) is at least ``least``, or if its score
    is not below 0: where few ratings are low or few were given, the thresholds alone
    turn nothing down without a mark against it.  Null texts count as empty; a text
    without known features gets the score 0; rows are neither joined nor dropped, so repeated rows, null ids and extra columns
    pass; an empty table stays empty.  A model fitted without any rating accepts
    everything.  A column added here whose name the documents have already gets
    underscores before its name.
    """
    linear, grade, chance, yes = unused(docs, "vg_score", *RESULTS)
    rated = docs.withColumn(linear, score(model, F.col(text_col), docs.sparkSession))
    rated = rated.withColumns({grade: expected(model, F.col(linear)), chance: tail(model, F.col(linear), accept)})
    return rated.withColumn(yes, (F.col(chance) >= least) | (F.col(linear) >= 0)).drop(linear)


def accepted(docs: DataFrame, model: Model, **how) -> DataFrame:
    """The documents that :func:`rate` accepts, with their own columns."""
    yes = unused(docs, "vg_accept")[0]
    return rate(docs, model, **how).where(F.col(yes)).select(*[F.col(f"`{c}`") for c in docs.columns])


def rating_grade() -> Column:
    """Grades from the two labels: a point for good writing, one for not being toxic.
    So neither fault is a step on the way to the other, and both add up."""
    return F.when(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1), F.col("quality") + 1 - F.col("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, learnt from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rating_grade(), top=2)
    rated = rate(docs, model)
    return rated.select(
        "doc_id", F.col("vg_grade").alias("expected_grade"), F.col("vg_tail").alias("p_good"), F.col("vg_accept").alias("accepted")
    )
