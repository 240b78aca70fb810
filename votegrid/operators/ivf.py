"""Inverted-file index: construction, storage layout and search.

Search is set-at-a-time.  Queries stream past the clusters, whose number training
bounds, and leave a row for each cluster to visit; these rows join the members.  Each
branch that one query could take (expansion, box extension, exact fallback) becomes a
subset of the queries that goes through the next plan; one table is staged for each
pass over the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.functions.distance import l2_matrix_fast, l2_squared
from votegrid.operators import kmeans
from votegrid.operators.scoring import votes
from votegrid.operators.topk import MATRIX_CELLS, _matrix, exact_topk, flags_equal, keep_top
from votegrid.plans.config import DIM, IVFTraining, SearchConfig
from votegrid.storage import Scratch, reachable

VEC = "array<smallint>"
#: What each version of the on-disk index could do.
STORAGES = {1: "postings", 2: "boxed postings", 3: "clustered"}


@dataclass
class IVFIndex:
    """``clusters``: cluster_id, centroid, box_low, box_high, size, first_position;
    ``members``: record_index, label, vec, cluster_id, ordered_pos (and codes if
    product-quantised).  Clusters are bounded by the training settings."""

    clusters: DataFrame
    members: DataFrame
    count: int
    cluster_count: int
    version: int = 3

    @property
    def has_boxes(self) -> bool:
        return self.version >= 2

    @property
    def has_cluster_vectors(self) -> bool:
        return self.version >= 3

    @cached_property
    def layout(self) -> "Layout":
        """The cluster table in arrays, for the driver and all tasks."""
        table = self.clusters.orderBy("cluster_id").toArrow()
        lanes = lambda name: _matrix(table.column(name).combine_chunks()).astype(np.int64)
        return Layout(lanes("centroid"), lanes("box_low"), lanes("box_high"), table.column("size").to_numpy())


@dataclass
class Layout:
    """A row per cluster, in the order of their numbers."""

    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def nearest(self, points: np.ndarray, nprobe: int) -> np.ndarray:
        """Numbers of each point's nearest clusters, ties by number: a row per point."""
        distance = l2_matrix_fast(points, self.centroids)
        key = distance * len(self.size) + np.arange(len(self.size))
        few = np.argpartition(key, nprobe - 1, axis=1)[:, :nprobe] if nprobe < key.shape[1] else np.broadcast_to(np.arange(key.shape[1]), key.shape)
        return np.take_along_axis(few, np.take_along_axis(key, few, axis=1).argsort(axis=1), axis=1)

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Least squared distance from each point to anything in each box."""
        total = np.zeros((len(points), len(self.size)), np.int64)
        for k in range(points.shape[1]):
            q = points[:, k, None].astype(np.int64)
            total += np.maximum(np.maximum(self.low[:, k] - q, q - self.high[:, k]), 0) ** 2
        return total


def assign(refs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_id`` and ``centroid_distance``; ties go to the lowest cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = kmeans.nearest(_matrix(batch.column(2)), centroids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(label, pa.int32()), pa.array(distance, pa.int64())],
                ["record_index", "label", "vec", "cluster_id", "centroid_distance"],
            )

    reachable(refs.sparkSession)
    schema = f"record_index bigint, label tinyint, vec {VEC}, cluster_id int, centroid_distance bigint"
    return refs.select("record_index", F.col("label").cast("tinyint").alias("label"), "vec").mapInArrow(run, schema)


def cluster_table(spark: SparkSession, members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Sizes, exclusive prefix sums and boxes of all clusters, empty ones too (their
    box is the centroid).  One aggregation over the members, combined on the map
    side; everything after it has a row per cluster."""
    lanes = range(DIM)
    found = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.get("vec", F.lit(k))).alias(f"low{k}") for k in lanes], *[F.max(F.get("vec", F.lit(k))).alias(f"high{k}") for k in lanes],
    )
    base = spark.createDataFrame([(c, [int(x) for x in v]) for c, v in enumerate(centroids)], f"c int, centroid {VEC}")
    table = base.join(found, F.col("c") == F.col("cluster_id"), "left")
    box = lambda side: F.when(F.col("n").isNull(), F.col("centroid")).otherwise(F.array(*[F.col(f"{side}{k}") for k in lanes])).cast(VEC)
    before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce("n", F.lit(0)).cast("bigint")
    return table.select(
        F.col("c").alias("cluster_id"), "centroid", box("low").alias("box_low"), box("high").alias("box_high"), size.alias("size"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint").alias("first_position"),
    )


#: Record numbers of one block: a task orders no more records of a cluster at a time.
BLOCK = 1 << 20


def place(members: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``ordered_pos``: the first position of the cluster, plus its records in
    earlier blocks of record numbers, plus the rank within the block."""
    cut = members.withColumn("__block", F.floor(F.col("record_index") / block).cast("bigint"))
    sizes = cut.groupBy(F.col("cluster_id").alias("c"), F.col("__block").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("c", "b", F.coalesce(earlier, F.lit(0)).alias("before")).join(
        clusters.select(F.col("cluster_id").alias("k"), "first_position"), F.col("c") == F.col("k")
    ).select("c", "b", (F.col("before") + F.col("first_position")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("cluster_id", "__block").orderBy("record_index")) - 1
    return (
        cut.withColumn("__rank", rank).join(starts, (F.col("cluster_id") == F.col("c")) & (F.col("__block") == F.col("b")))
        .withColumn("ordered_pos", F.col("start") + F.col("__rank")).drop("__rank", "__block", "c", "b", "start", "centroid_distance")
    )


def index_from_centroids(refs: DataFrame, centroids: np.ndarray, version: int = 3, scratch: Scratch | None = None) -> IVFIndex:
    spark = refs.sparkSession
    scratch = scratch or Scratch(spark, "ivf")
    members = scratch.stage(assign(refs, centroids), "assigned")
    clusters = scratch.stage(cluster_table(spark, members, centroids).coalesce(1), "clusters")
    count = clusters.agg(F.sum("size")).first()[0] or 0
    placed = scratch.stage(place(members, clusters), "members")
    return IVFIndex(clusters, placed, count, len(centroids), version)


def build_ivf(refs: DataFrame, training: IVFTraining = IVFTraining(), version: int = 3, scratch: Scratch | None = None) -> IVFIndex:
    """Train on a bounded sample, assign every record, lay out."""
    centroids = kmeans.train_centroids(refs, refs.count(), training)
    return index_from_centroids(refs, centroids, version, scratch)


def save_ivf(index: IVFIndex, path: str) -> None:
    """``clusters``, ``members`` and ``about`` (version, count) below ``path``; members
    are partitioned by cluster, so probing prunes files at run time."""
    index.clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    (
        index.members.repartition("cluster_id").sortWithinPartitions("cluster_id", "ordered_pos")
        .write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/members")
    )
    about = index.clusters.sparkSession.createDataFrame([(index.version, index.count)], "version int, count bigint")
    about.write.mode("overwrite").parquet(f"{path}/about")


def load_ivf(spark: SparkSession, path: str, count: int | None = None) -> IVFIndex:
    """``count`` is the number of references; an index over another number is refused."""
    clusters, members = spark.read.parquet(f"{path}/clusters"), spark.read.parquet(f"{path}/members")
    about, number = spark.read.parquet(f"{path}/about").first(), clusters.count()
    if count is not None and about["count"] != count:
        raise ValueError(f"the index covers {about['count']} records, the references number {count}")
    return IVFIndex(clusters, members, about["count"], number, about.version)


def _visits(ids: np.ndarray, points: np.ndarray, rows: np.ndarray, cluster: np.ndarray, rank: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """A row for each visit: point number, cluster, its rank and a figure of the point."""
    lists = pa.FixedSizeListArray.from_arrays(pa.array(points[rows].astype(np.int16).ravel()), DIM).cast(pa.list_(pa.int16()))
    columns = [pa.array(ids[rows], pa.int64()), lists, pa.array(cluster, pa.int32()), pa.array(rank, pa.int32()), pa.array(more, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "q_vec", "cluster_id", "probe_rank", "reach"])


_VISIT = f"query_id bigint, q_vec {VEC}, cluster_id int, probe_rank int, reach bigint"


def _asked(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vec").cast(VEC).alias("vec"), *more)


def probe(queries: DataFrame, index: IVFIndex, nprobe: int) -> DataFrame:
    """``query_id, q_vec, cluster_id, probe_rank`` of each query's nearest clusters, and
    in ``reach`` how many records lie in them all."""
    reachable(queries.sparkSession)
    layout, nprobe = index.layout, min(max(1, nprobe), index.cluster_count)
    step = max(1, MATRIX_CELLS // index.cluster_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for a in range(0, len(ids), step):
                near = layout.nearest(points[a : a + step], nprobe)
                rows = np.repeat(np.arange(len(near)), nprobe)
                yield _visits(ids[a : a + step], points[a : a + step], rows, near.ravel(), np.tile(np.arange(1, nprobe + 1), len(near)), layout.size[near].sum(axis=1)[rows])

    return _asked(queries).mapInArrow(run, _VISIT)


def within_reach(queries: DataFrame, index: IVFIndex, nprobe: int, k: int, enough: bool) -> DataFrame:
    """The queries whose nearest clusters hold at least ``k`` records, or the others."""
    reachable(queries.sparkSession)
    layout, nprobe = index.layout, min(max(1, nprobe), index.cluster_count)
    step = max(1, MATRIX_CELLS // index.cluster_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1))
            held = [layout.size[layout.nearest(points[a : a + step], nprobe)].sum(axis=1) for a in range(0, len(points), step)]
            yield batch.filter(pa.array((np.concatenate(held) >= k) == enough)) if held else batch

    return _asked(queries).mapInArrow(run, f"query_id bigint, vec {VEC}")


def scan(probes: DataFrame, index: IVFIndex, k: int) -> DataFrame:
    """Filtered top k of the probed clusters; cluster and flag lanes are hash keys."""
    hits = probes.join(index.members, "cluster_id").where(flags_equal("q_vec", "vec"))
    found = hits.select(
        "query_id", "record_index", "label", "probe_rank", "ordered_pos", l2_squared(F.col("q_vec"), F.col("vec")).alias("distance")
    )
    return keep_top(found, k, "probe_rank", "ordered_pos")


def boxes_within(queries: DataFrame, worst: DataFrame, index: IVFIndex, nprobe: int) -> DataFrame:
    """Clusters beyond the ``nprobe`` nearest whose box comes closer than the worst
    distance so far, numbered after the probes by (bound, cluster)."""
    reachable(queries.sparkSession)
    layout, nprobe = index.layout, min(max(1, nprobe), index.cluster_count)
    step = max(1, MATRIX_CELLS // index.cluster_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points, limits = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for a in range(0, len(ids), step):
                part, limit = points[a : a + step], limits[a : a + step]
                bound = layout.bounds(part)
                np.put_along_axis(bound, layout.nearest(part, nprobe), np.iinfo(np.int64).max, axis=1)
                rows, cluster = np.nonzero(bound < limit[:, None])
                order = np.lexsort((cluster, bound[rows, cluster], rows))
                rows, cluster = rows[order], cluster[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1 + len(layout.size)
                yield _visits(ids[a : a + step], part, rows, cluster, rank, limit[rows])

    limited = queries.join(worst.withColumnRenamed("query_id", "w_id"), F.col("query_id") == F.col("w_id"))
    return _asked(limited, "worst").mapInArrow(run, _VISIT)


def extended(queries: DataFrame, first: DataFrame, index: IVFIndex, nprobe: int, k: int) -> DataFrame:
    """``first`` (top k of the probes) improved by clusters that boxes let through.

    A record beyond the k-th distance of ``first`` cannot enter, so one pass over
    those clusters gives what scanning them one after the other would."""
    worst = first.where(F.col("rank") == k).select("query_id", F.col("distance").alias("worst"))
    more = scan(boxes_within(queries, worst, index, nprobe), index, k)
    both = first.select(*[c for c in more.columns if c != "rank"]).unionByName(more.drop("rank"))
    return keep_top(both, k, "probe_rank", "ordered_pos")


ANSWER = ["query_id", "record_index", "label", "distance", "rank"]


def with_fallback(queries: DataFrame, refs: DataFrame, top: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``top`` where it has k rows for a query, and exact search for the other queries.
    The count is a window over what the top k left, so only ``top`` is staged."""
    counted = top.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    top = scratch.stage(counted.where(F.col("found") >= k).select(*ANSWER), "top")
    short = queries.join(top.where("rank = 1").select(F.col("query_id").alias("done")), F.col("query_id") == F.col("done"), "left_anti")
    exact = exact_topk(short, refs, k).select(*ANSWER, F.lit(True).alias("used_fallback"))
    return top.withColumn("used_fallback", F.lit(False)).unionByName(exact)


def ivf_topk(
    queries: DataFrame, refs: DataFrame, index: IVFIndex, nprobe: int, k: int, boxes: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """Neighbours per query and whether they come from exact fallback
    (``query_id, record_index, label, distance, rank, used_fallback``).

    Clustered and boxed storage fall back where fewer than k records match; plain
    postings where fewer than k records lie in the probed clusters, matching or not.
    """
    scratch = scratch or Scratch(queries.sparkSession, "ivf-search")
    top = scan(probe(queries, index, nprobe), index, k)
    if boxes and index.has_boxes:
        top = extended(queries, scratch.stage(top, "probed"), index, nprobe, k)
    elif not index.has_cluster_vectors:
        kept = scan(probe(within_reach(queries, index, nprobe, k, True), index, nprobe), index, k)
        exact = exact_topk(within_reach(queries, index, nprobe, k, False), refs, k)
        return kept.select(*ANSWER, F.lit(False).alias("used_fallback")).unionByName(exact.select(*ANSWER, F.lit(True).alias("used_fallback")))
    return with_fallback(queries, refs, top, k, scratch)


def vote_table(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, votes, used_fallback`` for every query, 0 votes where nothing was found."""
    counted = found.groupBy("query_id").agg(
        F.sum(F.col("label").cast("bigint")).alias("votes"), F.bool_or("used_fallback").alias("used_fallback")
    )
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id", F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"), F.coalesce("used_fallback", F.lit(False)).alias("used_fallback")
    )


def expands(config: SearchConfig):
    """The votes after which the first stage is not enough, as a column."""
    return F.col("votes").isin([v for v in range(64) if config.expands_after(v)] or [-1])


def adaptive(queries: DataFrame, config: SearchConfig, stage, scratch: Scratch) -> DataFrame:
    """Two-stage search: ``stage(queries, nprobe, boxes)`` gives votes; the undecided
    queries take the wide stage.  ``query_id, votes, used_fallback, expanded``."""
    first = scratch.stage(stage(queries, config.initial_nprobe, config.use_boxes), "stage1").withColumn("expanded", F.lit(False))
    if not config.adaptive:
        return first
    undecided = first.where(expands(config)).select("query_id")
    second = stage(queries.join(undecided, "query_id", "left_semi"), config.nprobe, config.boxes_when_expanded)
    return first.where(~expands(config)).unionByName(second.withColumn("expanded", F.lit(True)))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query_id, hits``: how many of the true k neighbours were found."""
    return (
        truth.where(F.col("rank") <= k).select("query_id", "record_index", F.lit(1).alias("true"))
        .join(found.select("query_id", "record_index", F.lit(1).alias("got")), ["query_id", "record_index"], "left")
        .groupBy("query_id").agg(F.sum(F.coalesce("got", F.lit(0))).cast("bigint").alias("hits"))
    )


__all__ = [
    "IVFIndex", "adaptive", "assign", "boxes_within", "build_ivf", "cluster_table", "extended", "index_from_centroids", "ivf_topk",
    "load_ivf", "place", "probe", "recall", "save_ivf", "scan", "vote_table", "votes", "with_fallback", "within_reach",
]
