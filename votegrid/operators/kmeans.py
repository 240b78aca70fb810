"""Integer k-means: seeded initialisation on a bounded sample, refinement by
distributed partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votegrid.functions.distance import l2_matrix_fast
from votegrid.operators.topk import MATRIX_CELLS, _matrix
from votegrid.plans.config import DIM, IVFTraining
from votegrid.storage import reachable

_WORD = (1 << 64) - 1
#: Fixed value: the step of the generator, also between the seeds of restarts.
GOLDEN = 0x9E3779B97F4A7C15


class SplitMix64:
    """The published 64-bit generator; bounded draws are by remainder."""

    def __init__(self, seed: int):
        self.state = seed & _WORD

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & _WORD
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WORD
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        if bound <= 0:
            raise ValueError("the bound must be positive")
        return self.next() % bound


def strided_positions(count: int, wanted: int) -> list[int]:
    """Evenly spread positions, by double arithmetic; all if there are no more."""
    if wanted >= count:
        return list(range(count))
    step = count / wanted
    return [min(count - 1, int(i * step)) for i in range(wanted)]


def strided_sample(refs: DataFrame, count: int, wanted: int) -> np.ndarray:
    """Vectors of the sampled records in record order: at most ``wanted`` reach the
    driver (a training setting).  The test for membership is arithmetic on the
    record number, so nothing is joined."""
    if wanted < count:
        step = count / wanted
        r = F.col("record_index").cast("double")
        near = F.floor(r / step)
        hit = F.lit(False)
        for shift in (0, 1):  # r is sampled if floor(i * step) = r for i near r / step
            i = near + shift
            hit = hit | ((i < wanted) & (F.floor(i.cast("double") * step) == F.col("record_index")))
        refs = refs.where(hit)
    table = refs.select("record_index", "vec").toArrow()
    order = np.argsort(table.column("record_index").to_numpy())
    return _matrix(table.column("vec").combine_chunks())[order] if table.num_rows else np.zeros((0, DIM), np.int16)


def plus_plus(sample: np.ndarray, clusters: int, seed: int) -> np.ndarray:
    """k-means++ over integer vectors: weights are squared distances of at least 1."""
    rng = SplitMix64(seed)
    chosen = [rng.below(len(sample))]
    least = np.full(len(sample), np.iinfo(np.int64).max)
    lanes = np.ascontiguousarray(sample.T, np.int64)  # one after the other: whole lanes are subtracted
    for _ in range(1, clusters):
        distance = np.zeros(len(sample), np.int64)
        for lane in lanes:
            gap = lane - lane[chosen[-1]]
            distance += gap * gap
        least = np.minimum(least, distance)
        total = np.cumsum(np.maximum(1, least))
        chosen.append(int(np.searchsorted(total, rng.below(int(total[-1])), side="right")))
    return sample[chosen].copy()


def strided_start(sample: np.ndarray, clusters: int) -> np.ndarray:
    return sample[[c * len(sample) // clusters for c in range(clusters)]].copy()


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point (ties: the lowest number) and its distance."""
    label, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    step = max(1, MATRIX_CELLS // max(1, len(centroids)))
    for a in range(0, len(points), step):
        d = l2_matrix_fast(points[a : a + step], centroids)
        label[a : a + step] = d.argmin(1)
        distance[a : a + step] = d.min(1)
    return label, distance


def updated(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means cut toward zero; a cluster without members stays where it is."""
    means = np.sign(sums) * (np.abs(sums) // np.maximum(1, counts)[:, None])
    return np.where(counts[:, None] > 0, means, centroids).astype(np.int16)


def refine_local(centroids: np.ndarray, points: np.ndarray, iterations: int) -> tuple[np.ndarray, int]:
    """Lloyd's iterations on the driver's sample; inertia is that before the last update."""
    inertia = np.iinfo(np.int64).max
    for _ in range(iterations if len(points) else 0):
        label, distance = nearest(points, centroids)
        inertia = int(distance.sum())
        counts = np.bincount(label, minlength=len(centroids))
        sums = np.stack([
            np.bincount(label, points[:, j].astype(float), len(centroids)).astype(np.int64) for j in range(points.shape[1])
        ], axis=1)
        centroids = updated(centroids, sums, counts)
    return centroids, inertia


def refine_distributed(refs: DataFrame, centroids: np.ndarray, iterations: int) -> tuple[np.ndarray, int]:
    """The same over all records: tasks send a row of sums per cluster they met."""
    reachable(refs.sparkSession)
    inertia = np.iinfo(np.int64).max
    for _ in range(iterations):
        def partial(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(centroids), DIM + 2), np.int64)
            for batch in batches:
                points = _matrix(batch.column(0))
                label, distance = nearest(points, centroids)
                np.add.at(sums, label, np.column_stack([points.astype(np.int64), np.ones(len(points), np.int64), distance]))
            met = np.nonzero(sums[:, DIM])[0]
            columns = [pa.array(met, pa.int64()), *[pa.array(sums[met, j]) for j in range(DIM + 2)]]
            yield pa.RecordBatch.from_arrays(columns, ["cluster_id", *[f"s{j}" for j in range(DIM + 2)]])

        names = [f"s{j}" for j in range(DIM + 2)]
        schema = "cluster_id bigint, " + ", ".join(f"{n} bigint" for n in names)
        rows = refs.select("vec").mapInArrow(partial, schema).groupBy("cluster_id").agg(*[F.sum(n).alias(n) for n in names]).collect()
        sums, counts, inertia = np.zeros((len(centroids), DIM), np.int64), np.zeros(len(centroids), np.int64), 0
        for r in rows:  # one per cluster
            sums[r.cluster_id], counts[r.cluster_id] = [r[n] for n in names[:DIM]], r[f"s{DIM}"]
            inertia += r[f"s{DIM + 1}"]
        centroids = updated(centroids, sums, counts)
    return centroids, inertia


def train_centroids(refs: DataFrame, count: int, t: IVFTraining) -> np.ndarray:
    """Centroids for ``t``: the best of its restarts, then refined over all records."""
    if not count:
        raise ValueError("there are no references to train on")
    clusters = max(1, min(t.clusters, count))
    sample = strided_sample(refs, count, min(count, max(clusters, t.sample_count)))
    best, least = None, None
    for restart in range(max(1, t.restarts)):
        seed = (t.seed + restart * GOLDEN) & _WORD
        start = plus_plus(sample, clusters, seed) if t.plus_plus else strided_start(sample, clusters)
        centroids, inertia = refine_local(start, sample, max(1, t.iterations))
        if least is None or inertia < least:
            best, least = centroids, inertia
    if t.full_refine_iterations > 0:
        best, _ = refine_distributed(refs, best, t.full_refine_iterations)
    return best
