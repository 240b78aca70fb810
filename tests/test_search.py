"""Search, scoring and index behaviour on hand-made records (lane 0; the others 0)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from votegrid.operators import ivf, kmeans, pq, scoring, topk
from votegrid.plans.config import DIM, IVFTraining, PQTraining, SearchConfig, ServiceConfig, companion
from votegrid.plans.planner import Searcher, warm_up_queries

REFS = "record_index long, label byte, vec array<smallint>"


def vec(x):
    return [x] + [0] * (DIM - 1)


def refs_of(spark, values, labels=None):
    labels = labels or [0] * len(values)
    return spark.createDataFrame([(i, y, vec(v)) for i, (v, y) in enumerate(zip(values, labels, strict=True))], REFS)


def query_of(spark, value):
    return spark.createDataFrame([(7, vec(value))], "query_id long, vec array<smallint>")


def index_of(refs, centroids, version=3):
    return ivf.index_from_centroids(refs, np.array([vec(c) for c in centroids], dtype=np.int16), version)


def ranked(found):
    return [(r.record_index, r.distance) for r in found.orderBy("rank").collect()]


def count_votes(search, query, config, k=5):
    return search.votes(query, config, k).first().votes


def test_order(spark):
    refs = refs_of(spark, [10, 0, 3])
    assert ranked(topk.exact_topk(query_of(spark, 4), refs, 3)) == [(2, 1), (1, 16), (0, 36)]


def test_ties_of_unordered_references_go_to_the_lower_index(spark):
    stored = spark.createDataFrame([(i, 0, vec(4)) for i in (9, 5, 3, 1, 7, 0, 2)], REFS).coalesce(1)
    for bounds in ({}, {"refs_block": 2}, {"block": 1, "refs_block": 2}):
        queries = spark.createDataFrame([(q, vec(4)) for q in range(3)], "query_id long, vec array<smallint>")
        found = topk.exact_topk(queries, stored, 2, **bounds).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.record_index) for r in found] == [(q, i) for q in range(3) for i in (0, 1)]


def test_k_is_cut_and_ties_go_by_index(spark):
    assert ranked(topk.exact_topk(query_of(spark, 0), refs_of(spark, [0, 10, 20, 30, 40]), 2)) == [(0, 0), (1, 100)]
    assert ranked(topk.exact_topk(query_of(spark, 5), refs_of(spark, [10, 0, 10, 0]), 3)) == [(0, 25), (1, 25), (2, 25)]
    assert len(ranked(topk.exact_topk(query_of(spark, 0), refs_of(spark, [1, 2]), 5))) == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_array_and_join_forms_agree(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 3, (60, DIM)) * 5000
    refs = spark.createDataFrame([(i, int(i % 2), [int(x) for x in p]) for i, p in enumerate(points[:50])], REFS)
    queries = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(points[50:])], "query_id long, vec array<smallint>")
    for filtered in (False, True):
        wide = points.astype(np.int64)
        b = []
        for q in range(10):
            near = sorted((int(((wide[50 + q] - wide[i]) ** 2).sum()), i) for i in range(50) if not filtered or (points[50 + q][[9, 10, 11]] == points[i][[9, 10, 11]]).all())
            b += [(q, i, d, n) for n, (d, i) in enumerate(near[:4], 1)]
        if filtered:
            joined = topk.filtered_topk_joined(queries, refs, 4).orderBy("query_id", "rank").collect()
            assert [(r.query_id, r.record_index, r.distance, r["rank"]) for r in joined] == b
        mixed = refs.orderBy(F.rand(seed)).repartition(3)
        for bounds in ({}, {"refs_block": 7}, {"block": 4, "refs_block": 7}):  # each of the three plans
            a = topk.exact_topk(queries, mixed, 4, filtered, **bounds).orderBy("query_id", "rank").collect()
            assert [(r.query_id, r.record_index, r.distance, r["rank"]) for r in a] == b


def test_no_queries_and_no_references(spark):
    none = query_of(spark, 0).where("false")
    assert topk.exact_topk(none, refs_of(spark, [1]), 5).count() == 0
    assert topk.exact_topk(query_of(spark, 0), refs_of(spark, [1]).where("false"), 5).count() == 0


@pytest.mark.parametrize(("labels", "score", "ok"), [([1, 1, 1, 0, 0], 0.6, False), ([0, 0, 0, 1, 1], 0.4, True)])
def test_score(spark, labels, score, ok):
    found = topk.exact_topk(query_of(spark, 0), refs_of(spark, [0] * 5, labels), 5)
    got = scoring.score(found, with_neighbours=True).first()
    assert (got.fraud_score, got.approved, len(got.top_neighbours)) == (score, ok, 5)
    body = scoring.votes(found).select(scoring.response_body(F.col("votes")).alias("b")).first().b
    assert body == f'{{"approved":{str(ok).lower()},"fraud_score":{score}}}'


def test_all_probes_equal_exact(spark):
    refs = refs_of(spark, [0, 2, 50, 52], [0, 1, 1, 0])
    search = Searcher(refs, index_of(refs, [1, 51]))
    query = query_of(spark, 1)
    assert count_votes(search, query, SearchConfig(nprobe=2), 3) == count_votes(Searcher(refs), query, SearchConfig(), 3)


def test_codes_equal_exact(spark):
    refs = refs_of(spark, [0, 2, 50, 52], [0, 1, 1, 0])
    index = index_of(refs, [1, 51])
    books = np.zeros((4, 256, 4), np.int16)
    books[0, :4, 0] = [0, 2, 50, 52]
    coded = pq.encode(index, books)
    assert [r.codes[0] for r in coded.members.orderBy("ordered_pos").collect()] == [0, 1, 2, 3]
    search = Searcher(refs, index, coded, pq.codebook_table(spark, books))
    assert count_votes(search, query_of(spark, 1), SearchConfig(nprobe=2, shortlist=6), 3) == count_votes(Searcher(refs), query_of(spark, 1), SearchConfig(), 3)


def expanding(spark):
    refs = refs_of(spark, [10, 20, 30, 40, 50, 1, 2, 3, 4, 5], [1, 1, 0, 0, 0, 1, 1, 1, 0, 0])
    clusters = {r.record_index: 0 if r.record_index < 5 else 1 for r in refs.collect()}
    return refs, given_clusters(refs, [0, 1], clusters)


def given_clusters(refs, centroids, clusters, version=3):
    """An index with an assignment that its centroids would not give."""
    from votegrid.storage import Scratch

    spark = refs.sparkSession
    scratch = Scratch(spark, "test")
    points = np.array([vec(c) for c in centroids], dtype=np.int16)
    by = spark.createDataFrame(list(clusters.items()), "r long, cluster_id int")
    members = scratch.stage(refs.join(by, F.col("record_index") == F.col("r")).drop("r").withColumn("centroid_distance", F.lit(0)), "assigned")
    table = scratch.stage(ivf.cluster_table(spark, members, points), "clusters")
    return ivf.IVFIndex(table, scratch.stage(ivf.place(members, table), "members"), len(clusters), len(centroids), version)


def test_adaptive_expansion(spark):
    refs, index = expanding(spark)
    search, query = Searcher(refs, index), query_of(spark, 0)
    assert count_votes(search, query, SearchConfig(nprobe=1)) == 2
    assert count_votes(Searcher(refs), query, SearchConfig()) == 3
    got = search.votes(query, SearchConfig(nprobe=2, initial_nprobe=1)).first()
    assert (got.votes, got.expanded) == (3, True)


def test_unanimous_expansion(spark):
    refs = refs_of(spark, [100, 101, 102, 103, 104, 1, 2, 3, 4, 5], [1] * 5 + [0, 0, 0, 1, 1])
    index = given_clusters(refs, [0, 10], {i: i // 5 for i in range(10)})
    search, query = Searcher(refs, index), query_of(spark, 0)
    assert count_votes(search, query, SearchConfig(nprobe=1)) == 5
    assert count_votes(Searcher(refs), query, SearchConfig()) == 2
    assert count_votes(search, query, SearchConfig(nprobe=2, initial_nprobe=1)) == 5
    assert count_votes(search, query, SearchConfig(nprobe=2, initial_nprobe=1, expand_unanimous=True)) == 2


@pytest.mark.parametrize("version", [2, 3])
def test_boxes_recover_a_closer_cluster(spark, version):
    refs = refs_of(spark, [10, 11, 12, 1, 2, 3], [0, 0, 0, 1, 1, 1])
    index = given_clusters(refs, [0, 100], {i: i // 3 for i in range(6)}, version)
    got = Searcher(refs, index).votes(query_of(spark, 0), SearchConfig(nprobe=1, use_boxes=True), 3).first()
    assert (got.votes, got.used_fallback) == (3, False)
    boxes = [(r.box_low[0], r.box_high[0]) for r in index.clusters.orderBy("cluster_id").collect()]
    assert boxes == [(10, 12), (1, 3)]


def test_places_in_blocks(spark):
    """Positions do not depend on how many record numbers a block has."""
    refs = refs_of(spark, list(range(40)))
    members = ivf.assign(refs, np.array([vec(5), vec(30)], np.int16))
    clusters = ivf.cluster_table(spark, members, np.array([vec(5), vec(30)], np.int16))
    one, two = (sorted((r.record_index, r.ordered_pos) for r in ivf.place(members, clusters, n).collect()) for n in (1 << 20, 7))
    assert one == two == [(i, i) for i in range(40)]


def test_empty_cluster_has_its_centroid_as_box(spark):
    index = index_of(refs_of(spark, [1, 2]), [1, 900])
    last = index.clusters.orderBy("cluster_id").collect()[-1]
    assert (last["size"], last.first_position, last.box_low[0], last.box_high[0]) == (0, 2, 900, 900)


def test_fallback_differs_by_storage(spark):
    flags = lambda v, f: [v] + [0] * 8 + [f] + [0] * 4
    rows = [(i, 1, flags(i, 10000 if i < 4 else 0)) for i in range(8)]
    refs = spark.createDataFrame(rows, REFS)
    query = spark.createDataFrame([(1, flags(0, 10000))], "query_id long, vec array<smallint>")
    one = lambda v: Searcher(refs, ivf.index_from_centroids(refs, np.zeros((1, DIM), np.int16), v)).votes(query, SearchConfig(nprobe=1)).first()
    assert (one(3).votes, one(3).used_fallback) == (5, True)  # four match: exact search
    assert (one(1).votes, one(1).used_fallback) == (4, False)  # eight candidates suffice


def test_config():
    c = SearchConfig(use_boxes_on_expansion=True)
    assert (c.use_boxes, c.boxes_when_expanded) == (False, True)
    c = SearchConfig(nprobe=0, initial_nprobe=9, shortlist=0)
    assert (c.nprobe, c.initial_nprobe, c.shortlist, c.quantised, c.adaptive) == (1, 1, 1, False, False)
    assert all(SearchConfig.preset("deployed").expands_after(v) for v in range(6))
    assert [SearchConfig(nprobe=4, initial_nprobe=1).expands_after(v) for v in range(6)] == [False, False, True, True, False, False]
    assert SearchConfig.from_env({"IVF_NPROBE": "x", "IVF_USE_BBOX": "1"}) == SearchConfig(nprobe=4, use_boxes=True)
    assert ServiceConfig.from_env({"REFERENCES_BIN": "/d/references.bin"}).ivf == "/d/references.ivf"
    assert companion("refs", "pq") == "refs.pq"


def test_generator_and_positions():
    rng = kmeans.SplitMix64(0)
    assert [rng.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    assert kmeans.strided_positions(10, 4) == [0, 2, 5, 7]
    assert kmeans.strided_positions(3, 9) == [0, 1, 2]
    with pytest.raises(ValueError):
        rng.below(0)


def slow_kmeans(points, clusters, seed, rounds):
    """The definition, one record at a time."""
    rng = kmeans.SplitMix64(seed)
    points = [[int(x) for x in p] for p in points]
    centroids = [points[rng.below(len(points))]]
    d2 = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    least = [float("inf")] * len(points)
    while len(centroids) < clusters:
        least = [min(m, d2(p, centroids[-1])) for m, p in zip(least, points, strict=True)]
        target, total = rng.below(sum(max(1, m) for m in least)), 0
        for p, m in zip(points, least, strict=True):
            total += max(1, m)
            if total > target:
                centroids.append(p)
                break
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for p in points:
            groups[min(range(clusters), key=lambda c: (d2(p, centroids[c]), c))].append(p)
        centroids = [[int(sum(x) / len(g)) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return centroids


def test_training_matches_the_definition(spark):
    points = np.random.default_rng(5).integers(-9000, 9000, (80, DIM)).astype(np.int16)
    start = kmeans.plus_plus(points, 6, 42)
    fast, _ = kmeans.refine_local(start, points, 3)
    assert fast.tolist() == slow_kmeans(points, 6, 42, 3)
    refs = spark.createDataFrame([(i, 0, [int(x) for x in p]) for i, p in enumerate(points)], REFS)
    spread, _ = kmeans.refine_distributed(refs, start, 3)
    assert spread.tolist() == fast.tolist()
    assert kmeans.strided_sample(refs, 80, 30).tolist() == points[kmeans.strided_positions(80, 30)].tolist()


def test_training_refuses_nothing(spark):
    with pytest.raises(ValueError):
        ivf.build_ivf(refs_of(spark, [1]).where("false"), IVFTraining(clusters=2))


def test_store_and_load(spark, tmp_path):
    refs = refs_of(spark, [0, 2, 50, 52], [0, 1, 1, 0])
    ivf.save_ivf(index_of(refs, [1, 51]), str(tmp_path / "ivf"))
    back = ivf.load_ivf(spark, str(tmp_path / "ivf"), count=4)
    assert count_votes(Searcher(refs, back), query_of(spark, 1), SearchConfig(nprobe=2), 3) == 2
    with pytest.raises(ValueError):
        ivf.load_ivf(spark, str(tmp_path / "ivf"), count=5)


def test_pq_training(spark):
    refs = refs_of(spark, list(range(0, 600, 2)), [0] * 300)
    index = index_of(refs, [100, 500])
    books = pq.train_codebooks(index, PQTraining(iterations=1))
    assert books.shape == (4, 256, 4)
    coded = pq.encode(index, books)
    assert pq.eligible(index, coded, 6) and not pq.eligible(index, coded, 5) and not pq.eligible(index, None, 9)
    with pytest.raises(ValueError):
        pq.width_of(3)


def test_warm_up_queries_wrap(spark):
    rows = warm_up_queries(spark, np.full((1, DIM), 32767, np.int16), 3).collect()
    assert {(r.vec[0], r.vec[7], r.vec[1]) for r in rows} == {(-32752, -32746, 32767)}


def test_codes_that_are_not_nearest_are_found(spark):
    draw = np.random.default_rng(5)
    refs = spark.createDataFrame([(i, 0, [int(x) for x in v]) for i, v in enumerate(draw.integers(-3000, 3000, (300, DIM)))], REFS)
    index = ivf.index_from_centroids(refs, np.zeros((2, DIM), np.int16))
    books = pq.train_codebooks(index, PQTraining(iterations=1))
    coded = pq.encode(index, books)
    assert pq.not_nearest(coded, books).where("not_nearest").count() == 0
    other = F.when(F.col("record_index") % 7 == 0, F.transform("codes", lambda c, s: F.when(s == 2, (c + 1) % 256).otherwise(c).cast("smallint")))
    outside = F.when(F.col("record_index") % 7 == 1, F.transform("codes", lambda c: F.lit(300).cast("smallint")))
    coded.members = coded.members.withColumn("codes", F.coalesce(other, outside, "codes"))
    got = {r.record_index: r.not_nearest for r in pq.not_nearest(coded, books).collect()}
    for r in coded.members.collect():
        points, wide = np.array([*r.vec, 0, 0]).reshape(4, 4), books.astype(int)
        gaps = [((wide[s] - points[s]) ** 2).sum(1) for s in range(4)]
        assert got[r.record_index] == any(c > 255 or g[c] > g.min() for c, g in zip(r.codes, gaps))
    assert sum(got.values()) > 60


def test_trained_codes_are_checked_without_a_join(spark, sf_dir):
    """Tables of distances, 8 kB a member, must not be shuffled."""
    from votegrid.plans import catalogue

    plan = catalogue.queries()["q32_trained_codes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("count", [3, 200, 5_000])
def test_blocked_search_equals_every_distance(count):
    """Extreme lanes, copies and ties; far fewer distances than pairs are measured."""
    draw = np.random.default_rng(count)
    vectors = draw.integers(-32768, 32768, (count, DIM)).astype(np.int16)
    vectors[count // 2 :] = vectors[: count - count // 2]
    vectors[::40] = vectors[0]
    points = np.vstack([draw.integers(-32768, 32768, (600, DIM)), vectors[:100]]).astype(np.int16)
    index, label, ids = draw.permutation(count), draw.integers(0, 2, count).astype(np.int8), np.arange(len(points)) * 3
    got = topk.Blocks(index, label, vectors).nearest(ids, points, 5)
    gap = topk.l2_matrix_fast(points, vectors)
    for n, q in enumerate(ids):
        best = np.lexsort((index, gap[n]))[:5]
        rows = got[0] == q
        assert list(zip(*(x[rows].tolist() for x in got[1:]))) == [(index[b], label[b], gap[n, b]) for b in best]
    if count == 5_000:
        row, _ = topk.Blocks(index, label, vectors)._reached(points[:512].astype(float), 5)
        assert len(row) < 512 * -(-count // topk.LEAF) / 5


def test_requests_are_parsed_once(spark, sf_dir):
    from votegrid.plans import catalogue

    plan = catalogue.queries()["q29_malformed_requests"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "MapInArrow" in plan
