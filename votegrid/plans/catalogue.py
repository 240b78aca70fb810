"""Query catalogue: one query for each operator family, with its SQL twin.

All outputs are integers, texts and booleans, or quotients that both engines
compute from the same integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.functions import lanes, moments
from votegrid.functions.distance import box_bound_squared
from votegrid.operators import ivf, kmeans, pq, scoring, stats, topk
from votegrid.plans import catalogue_sql as sql
from votegrid.plans import fixtures as fx
from votegrid.plans.config import DIM, IVFTraining, PQTraining, SearchConfig
from votegrid.plans.planner import Searcher, warm_up_queries
from votegrid.sources import binary
from votegrid.sources import references as refs_io
from votegrid.sources import requests as requests_io
from votegrid.storage import Scratch

K = 5
#: Two rounds from a strided start: small enough to unroll in SQL.
SMALL = IVFTraining(clusters=8, iterations=2, plus_plus=False)
WIDE = IVFTraining(clusters=16, iterations=2, plus_plus=False)
NPROBE, SHORTLIST = 2, 20
ADAPTIVE = SearchConfig(nprobe=4, initial_nprobe=1, adaptive_min_votes=2, adaptive_max_votes=3)
DEPLOYED = SearchConfig.preset("deployed")


def _vec(name: str = "vec"):
    """Lanes as separate integer columns, which compare across engines."""
    return [F.get(name, F.lit(k)).cast("bigint").alias(f"v{k}") for k in range(DIM)]


#: Indexes of this session's queries: like a saved index they serve every search, and
#: the timed part of a search does not build them (:func:`prepare`).
_built: dict[tuple, ivf.IVFIndex] = {}


def _small(spark: SparkSession, d: str, training: IVFTraining = SMALL, version: int = 3) -> ivf.IVFIndex:
    key = (spark.sparkContext.applicationId, d, training, version)
    if key not in _built:
        _built[key] = ivf.build_ivf(fx.references(spark, d), training, version)
    return _built[key]


def prepare(spark: SparkSession, d: str) -> None:
    """Builds the indexes that the queries search."""
    for training in (SMALL, WIDE):
        _small(spark, d, training)
    _coded(spark, d)


def _votes(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.sum(F.col("label").cast("bigint")).alias("votes"))


def iso_parts(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", *[c.cast("bigint").alias(n) for n, c in moments.parts(text).items()]
    )


def vectorize_quantize(spark, d):
    r = fx.requests(spark, d)
    return r.select("request_id", lanes.quantize(lanes.feature_lanes(fx.NORMALIZATION)).alias("vec")).select("request_id", *_vec())


def quantize_refs(spark, d):
    return fx.references(spark, d).select("record_index", F.col("label").cast("bigint").alias("label"), *_vec())


def exact_topk(spark, d):
    return topk.exact_topk(fx.query_vectors(spark, d), fx.references(spark, d), K).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "record_index", "distance"
    )


def exact_topk_shuffled(spark, d):
    """The same over references stored in another order, in each of the three plans by
    turns of the queries."""
    refs = fx.references(spark, d).repartition(7, "label").sortWithinPartitions(F.xxhash64("record_index"))
    asked, number = fx.query_vectors(spark, d), F.col("query_id") % 30
    ways = [({}, number < 10), ({"refs_block": 0}, (number >= 10) & (number < 20)), ({"refs_block": 100, "block": 10}, number >= 20)]
    found = [topk.exact_topk(asked.where(some), refs, K, **bounds).select("query_id", "rank", "record_index", "distance") for bounds, some in ways]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("rank", F.col("rank").cast("bigint"))


def fraud_score(spark, d):
    found = topk.exact_topk(fx.query_vectors(spark, d), fx.references(spark, d), K)
    return scoring.votes(found).select(
        "query_id", "votes", (F.col("votes") / F.col("neighbours")).alias("fraud_score"),
        scoring.approved(F.col("votes") / F.col("neighbours")).alias("approved"),
    )


def response_body(spark, d):
    found = topk.exact_topk(fx.query_vectors(spark, d), fx.references(spark, d), K)
    return scoring.votes(found).select("query_id", scoring.response_body(F.col("votes")).alias("body"))


def filtered_topk(spark, d):
    return topk.exact_topk(fx.query_vectors(spark, d), fx.references(spark, d), K, filtered=True).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "record_index", "distance"
    )


def filtered_topk_joined(spark, d):
    return topk.filtered_topk_joined(fx.query_vectors(spark, d), fx.references(spark, d), K).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "record_index", "distance"
    )


def topk_in_candidates(spark, d, filtered=False):
    q, r = fx.query_vectors(spark, d), fx.references(spark, d)
    listed = q.select("query_id").join(
        r.select("record_index"), F.pmod(-F.col("query_id"), F.lit(7)) == F.pmod(F.col("record_index"), F.lit(7))
    ).select("query_id", "record_index", (-F.col("record_index")).alias("position"))
    return topk.topk_among(q, r, listed, K, filtered).select("query_id", F.col("rank").cast("bigint").alias("rank"), "record_index", "distance")


def category_lookup(spark, d):
    code = F.lpad(F.col("event_id").cast("string"), 4, "5")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.right(code, F.lit(4)).alias("mcc"))
    e = e.unionByName(e.select("event_id", F.lit("7995").alias("mcc")))
    return e.select("event_id", "mcc", lanes.category_risk(F.col("mcc")).alias("risk"), lanes.category_risk_by_number(F.col("mcc").cast("int")).alias("risk_by_number"))


def strided_sample(spark, d):
    r = fx.references(spark, d)
    n = r.count()
    at = spark.createDataFrame([(i, p) for i, p in enumerate(kmeans.strided_positions(n, 100))], "sample_no bigint, record_index bigint")
    return at.join(r, "record_index").select("sample_no", "record_index", *_vec())


def _start(spark, d):
    r = fx.references(spark, d)
    n = r.count()
    return r, kmeans.strided_start(kmeans.strided_sample(r, n, n), SMALL.clusters)


def assign_cluster(spark, d):
    r, start = _start(spark, d)
    return ivf.assign(r, start).select("record_index", F.col("cluster_id").cast("bigint").alias("cluster_id"), "centroid_distance")


def lloyd_two_rounds(spark, d):
    r, start = _start(spark, d)
    centroids, inertia = kmeans.refine_distributed(r, start, 2)
    rows = [(c, int(inertia), [int(x) for x in v]) for c, v in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster_id bigint, inertia bigint, vec array<smallint>").select("cluster_id", "inertia", *_vec())


def cluster_offsets(spark, d):
    return _small(spark, d).clusters.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "size", "first_position")


def postings(spark, d):
    return _small(spark, d).members.select("ordered_pos", "record_index", F.col("cluster_id").cast("bigint").alias("cluster_id"))


def bounding_boxes(spark, d):
    sides = [F.get(s, F.lit(k)).cast("bigint").alias(f"{n}{k}") for s, n in (("box_low", "low"), ("box_high", "high")) for k in range(DIM)]
    return _small(spark, d).clusters.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), *sides)


def box_lower_bound(spark, d):
    c = _small(spark, d).clusters
    pairs = fx.query_vectors(spark, d).join(F.broadcast(c), F.lit(True))  # as many clusters as SMALL has
    return pairs.select("query_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), box_bound_squared(F.col("vec"), F.col("box_low"), F.col("box_high")).alias("bound"))


def coarse_probe(spark, d):
    return ivf.probe(fx.query_vectors(spark, d), _small(spark, d), 3).select(
        "query_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("probe_rank").cast("bigint").alias("probe_rank")
    )


def _ivf_votes(spark, d, nprobe, boxes, version=3):
    q, index = fx.query_vectors(spark, d), _small(spark, d, version=version)
    return ivf.vote_table(q, ivf.ivf_topk(q, fx.references(spark, d), index, nprobe, K, boxes))


def ivf_votes(spark, d):
    return _ivf_votes(spark, d, NPROBE, False)


def ivf_box_votes(spark, d):
    return _ivf_votes(spark, d, NPROBE, True)


def adaptive_votes(spark, d):
    search = Searcher(fx.references(spark, d), _small(spark, d))
    return search.votes(fx.query_vectors(spark, d), ADAPTIVE).select("query_id", "votes", "expanded")


def deployed_score(spark, d):
    search = Searcher(fx.references(spark, d), _small(spark, d, WIDE))
    found = search.votes(fx.query_vectors(spark, d), DEPLOYED)
    score = F.col("votes") / F.lit(5)
    return found.select("query_id", "votes", score.alias("fraud_score"), scoring.approved(score).alias("approved"))


def postings_votes(spark, d):
    return _ivf_votes(spark, d, 1, False, version=1)


def boxed_postings_votes(spark, d):
    """Version 2: postings with boxes."""
    return _ivf_votes(spark, d, NPROBE, True, version=2)


def reloaded_votes(spark, d):
    """Votes of an index that was saved and loaded."""
    path = Scratch(spark, "saved").path("ivf")
    q, refs = fx.query_vectors(spark, d), fx.references(spark, d)
    ivf.save_ivf(_small(spark, d, version=1), path)
    back = ivf.load_ivf(spark, path, refs.count())
    return ivf.vote_table(q, ivf.ivf_topk(q, refs, back, 1, K))


def reloaded_pq_votes(spark, d):
    """Votes by codes that were saved and loaded."""
    path = Scratch(spark, "saved").path("pq")
    q, refs = fx.query_vectors(spark, d), fx.references(spark, d)
    pq.save_pq(*_coded(spark, d), path)
    index, books = pq.load_pq(spark, path, refs.count())
    return ivf.vote_table(q, pq.pq_topk(q, refs, index, books, NPROBE, SHORTLIST, K))


def imported_votes(spark, d):
    """Votes of an index that went through the single-file format, written and read."""
    path = Scratch(spark, "exported").path("index.ivf")
    q, refs, index = fx.query_vectors(spark, d), fx.references(spark, d), _small(spark, d)
    binary.export_ivf(index, path)
    back = binary.import_ivf(spark, path, refs)
    return ivf.vote_table(q, ivf.ivf_topk(q, refs, back, NPROBE, K))


def ingested_references(spark, d):
    """Labelled vectors as JSON, read, checked, encoded, numbered, stored and read back."""
    scratch = Scratch(spark, "ingest")
    raw = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").select(
        F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, DIM).alias("vector"), F.when(F.col("label") >= 5, "fraud").otherwise("legit").alias("label")
    )
    raw.coalesce(1).write.json(scratch.path("refs.jsonl"))
    refs_io.write_references(refs_io.prepare_references(refs_io.read_labelled(spark, scratch.path("refs.jsonl"))), scratch.path("refs"))
    return refs_io.read_references(spark, scratch.path("refs")).select("record_index", F.col("label").cast("bigint").alias("label"), *_vec())


def request_vectors(spark, d):
    """Bodies to quantised vectors in one call; malformed ones have none."""
    found = requests_io.quantised_vectors(fx.request_bodies(spark, d).select("request_id", "body"), fx.NORMALIZATION)
    return found.select("request_id", "valid", *_vec())


def warm_up_vectors(spark, d):
    """The synthetic queries of the warm-up."""
    r = fx.references(spark, d)
    return warm_up_queries(spark, kmeans.train_centroids(r, r.count(), SMALL), 500).select("query_id", *_vec())


def trained_index(spark, d):
    """What must hold of any trained index, as counts: records, clusters, records that
    lie nearer to another centroid, records outside of their box, positions used."""
    training = IVFTraining(clusters=8, iterations=4, restarts=2, full_refine_iterations=1)
    return _sound(fx.references(spark, d), _small(spark, d, training))


def _sound(refs, index):
    centroids = index.layout.centroids
    nearest = ivf.assign(refs, centroids).select("record_index", F.col("cluster_id").alias("right"))
    boxes = index.clusters.select(F.col("cluster_id").alias("c"), "box_low", "box_high", "first_position", "size")
    m = index.members.join(nearest, "record_index").join(boxes, F.col("cluster_id") == F.col("c"))
    inside = F.lit(True)
    for k in range(DIM):
        inside = inside & F.get("vec", F.lit(k)).between(F.get("box_low", F.lit(k)), F.get("box_high", F.lit(k)))
    placed = (F.col("ordered_pos") >= F.col("first_position")) & (F.col("ordered_pos") < F.col("first_position") + F.col("size"))
    return m.agg(
        F.count(F.lit(1)).alias("records"), F.lit(index.cluster_count).cast("bigint").alias("clusters"), F.count_if(F.col("cluster_id") != F.col("right")).alias("misplaced"),
        F.count_if(~inside).alias("outside"), F.count_distinct(F.when(placed, F.col("ordered_pos"))).alias("positions"),
    )


def trained_codes(spark, d):
    """The same of trained codes: members, codes per member, members that another code
    would come closer to in some subvector, code values out of range."""
    index = _small(spark, d)
    books = pq.train_codebooks(index, PQTraining(iterations=2))
    m = pq.not_nearest(pq.encode(index, books), books)
    return m.agg(
        F.count(F.lit(1)).alias("members"), F.max(F.size("codes")).cast("bigint").alias("subvectors"), F.count_if("not_nearest").alias("not_nearest"),
        F.count_if(F.exists("codes", lambda c: (c < 0) | (c > 255))).alias("out_of_range"),
    )


def _codebooks(spark, d) -> np.ndarray:
    """A given codebook: slices of records spread evenly over the references."""
    r = fx.references(spark, d)
    n = r.count()
    points = pq.padded(kmeans.strided_sample(r, n, n))
    return np.stack([points[[c * n // 256 for c in range(256)], 4 * s : 4 * s + 4] for s in range(4)])


def _coded(spark, d):
    key = (spark.sparkContext.applicationId, d, "codes")
    if key not in _built:
        books = _codebooks(spark, d)
        _built[key] = (pq.encode(_small(spark, d), books), pq.codebook_table(spark, books))
    return _built[key]


def lookup_tables(spark, d):
    """Distances of every code, as rows."""
    _, books = _coded(spark, d)
    tables = pq.lookup_tables(fx.query_vectors(spark, d), books).select("query_id", F.posexplode("lut").alias("subvector", "t"))
    return tables.select("query_id", F.col("subvector").cast("bigint").alias("subvector"), F.posexplode("t").alias("code", "distance")).withColumn(
        "code", F.col("code").cast("bigint")
    )


def pq_encode(spark, d):
    index, _ = _coded(spark, d)
    return index.members.select("record_index", *[F.get("codes", F.lit(s)).cast("bigint").alias(f"code{s}") for s in range(4)])


def adc_shortlist(spark, d):
    index, books = _coded(spark, d)
    q = fx.query_vectors(spark, d)
    found = pq.shortlist(ivf.probe(q, index, NPROBE), index, books, SHORTLIST)
    return found.select("query_id", F.col("adc_rank").cast("bigint").alias("adc_rank"), "record_index", "adc")


def ivfpq_votes(spark, d, boxes=False):
    index, books = _coded(spark, d)
    q = fx.query_vectors(spark, d)
    return ivf.vote_table(q, pq.pq_topk(q, fx.references(spark, d), index, books, NPROBE, SHORTLIST, K, boxes))


def recall_at_5(spark, d):
    q, r = fx.query_vectors(spark, d), fx.references(spark, d)
    index = _small(spark, d)
    found = ivf.scan(ivf.probe(q, index, NPROBE), index, K)
    return ivf.recall(found, topk.exact_topk(q, r, K, filtered=True), K)


def label_histogram(spark, d):
    return refs_io.label_histogram(fx.references(spark, d))


def phase_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return stats.phase_stats(e.select(F.col("event_type").alias("phase"), F.round(F.col("value") * 1000).cast("bigint").alias("ns")))


def request_counters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return stats.request_counters(e.select(
        (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 2 == 0).alias("fast_path"),
        (F.col("event_id") % 7 == 0).alias("used_fallback"), (F.col("event_id") % 3 == 0).alias("expanded"),
    ))


def malformed_requests(spark, d):
    """Every request answered; the valid ones against the references, exactly."""
    bodies = fx.request_bodies(spark, d).select("request_id", "body")
    # staged, so that bodies are made and parsed once
    parsed = Scratch(spark, "requests").stage(requests_io.quantised_vectors(bodies, fx.NORMALIZATION), "vectors")
    good = parsed.where("valid").select(F.col("request_id").alias("query_id"), "vec")
    found = topk.exact_topk(good, fx.references(spark, d), K)
    return scoring.respond(parsed, scoring.score(found))


def warm_up(spark, d):
    r = fx.references(spark, d)
    centroids = kmeans.train_centroids(r, r.count(), SMALL)
    queries = warm_up_queries(spark, centroids, 500)
    return Searcher(r, ivf.index_from_centroids(r, centroids)).votes(queries, DEPLOYED)


def plus_plus_ivf(spark, d):
    index = _small(spark, d, IVFTraining(clusters=8, iterations=4, restarts=2, full_refine_iterations=1))
    return index.clusters.select("cluster_id", "size", *_vec("centroid"))


def pq_train(spark, d):
    books = pq.train_codebooks(_small(spark, d), PQTraining(iterations=2))
    return pq.codebook_table(spark, books)


def stream_score(spark, d):
    """The streaming form of the flagship query over a file source."""
    from votegrid.streaming.score import score_stream

    schema = spark.read.parquet(f"{d}/embeddings.parquet").schema
    # a pattern: a stream refuses a plain path that is one file, and the table may be a
    # file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{d}/embeddings.parque[t]")
    queries = fx._vectors(stream.where("vec_id % 10 = 0")).select(F.col("vec_id").alias("query_id"), "vec")
    refs = fx.references(spark, d)
    work = Scratch(spark, "stream")
    out = score_stream(queries, lambda q: scoring.votes(topk.exact_topk(q, refs, K)), work.path("out"), work.path("state"))
    return out.select(
        "query_id", "votes", (F.col("votes") / F.col("neighbours")).alias("fraud_score"),
        scoring.approved(F.col("votes") / F.col("neighbours")).alias("approved"),
    )


_CATALOGUE = {
    "q01_iso_parts": (iso_parts, sql.ISO_PARTS),
    "q02_vectorize_quantize": (vectorize_quantize, sql.VECTORIZE),
    "q03_quantize_refs": (quantize_refs, sql.REFS),
    "q04_exact_topk": (exact_topk, sql.EXACT_TOPK),
    "q04_exact_topk_shuffled": (exact_topk_shuffled, sql.EXACT_TOPK),
    "q05_fraud_score": (fraud_score, sql.FRAUD_SCORE),
    "q06_response_body": (response_body, sql.RESPONSE_BODY),
    "q07_filtered_topk": (filtered_topk, sql.FILTERED_TOPK),
    "q07_filtered_topk_joined": (filtered_topk_joined, sql.FILTERED_TOPK),
    "q08_topk_in_candidates": (topk_in_candidates, sql.topk_among(False)),
    "q08_topk_in_candidates_filtered": (lambda s, d: topk_in_candidates(s, d, True), sql.topk_among(True)),
    "q09_mcc_lookup": (category_lookup, sql.CATEGORY),
    "q10_strided_sample": (strided_sample, sql.STRIDED),
    "q11_assign_cluster": (assign_cluster, sql.ASSIGN),
    "q12_lloyd_two_iterations": (lloyd_two_rounds, sql.LLOYD),
    "q13_cluster_offsets": (cluster_offsets, sql.OFFSETS),
    "q14_postings": (postings, sql.POSTINGS),
    "q15_bounding_boxes": (bounding_boxes, sql.BOXES),
    "q16_box_lower_bound": (box_lower_bound, sql.BOX_BOUND),
    "q17_coarse_probe": (coarse_probe, sql.PROBE),
    "q18_ivf_votes": (ivf_votes, sql.IVF_VOTES),
    "q19_ivf_bbox_votes": (ivf_box_votes, sql.IVF_BOX_VOTES),
    "q20_adaptive_votes": (adaptive_votes, sql.ADAPTIVE),
    "q21_deployed_score": (deployed_score, sql.DEPLOYED),
    "q22_postings_votes": (postings_votes, sql.POSTINGS_VOTES),
    "q22_boxed_postings_votes": (boxed_postings_votes, sql.IVF_BOX_VOTES),
    "q22_reloaded_votes": (reloaded_votes, sql.POSTINGS_VOTES),
    "q22_imported_votes": (imported_votes, sql.IVF_VOTES),
    "q23_pq_encode": (pq_encode, sql.PQ_ENCODE),
    "q24_lookup_tables": (lookup_tables, sql.LOOKUP),
    "q24_adc_shortlist": (adc_shortlist, sql.ADC_SHORTLIST),
    "q25_ivfpq_votes": (ivfpq_votes, sql.pq_votes(False)),
    "q25_ivfpq_bbox_votes": (lambda s, d: ivfpq_votes(s, d, True), sql.pq_votes(True)),
    "q25_reloaded_votes": (reloaded_pq_votes, sql.pq_votes(False)),
    "q26_recall_at_5": (recall_at_5, sql.RECALL),
    "q27_label_histogram": (label_histogram, sql.HISTOGRAM),
    "q28_phase_stats": (phase_stats, sql.PHASES),
    "q28_request_counters": (request_counters, sql.COUNTERS),
    "q29_malformed_requests": (malformed_requests, sql.MALFORMED),
    "q29_request_vectors": (request_vectors, sql.REQUEST_VECTORS),
    "q30_warmup_vectors": (warm_up_vectors, sql.WARM_UP),
    "q30_warmup_workload": (warm_up, None),
    "q31_kmeanspp_ivf": (plus_plus_ivf, None),
    "q31_trained_index": (trained_index, sql.TRAINED_INDEX),
    "q32_trained_codes": (trained_codes, sql.TRAINED_CODES),
    "q32_pq_train": (pq_train, None),
    "q33_stream_score": (stream_score, sql.FRAUD_SCORE),
    "q34_ingested_references": (ingested_references, sql.INGESTED),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _CATALOGUE.items()}


def oracle_sql() -> dict:
    return {name: text for name, (_, text) in _CATALOGUE.items() if text}
