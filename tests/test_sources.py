"""Reading, validation, storage and the binary formats."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from votegrid.operators import scoring, stats
from votegrid.plans import fixtures as fx
from votegrid.plans.config import DIM
from votegrid.sources import binary, references, requests

BODY = {
    "id": "tx", "transaction": {"amount": 41.0, "installments": 2, "requested_at": "2026-03-11T18:00:00Z"},
    "customer": {"avg_amount": 82.0, "tx_count_24h": 3, "known_merchants": ["M"]}, "merchant": {"id": "M", "mcc": "5411", "avg_amount": 60.0},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2}, "last_transaction": None,
}


def valid(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "request_id long, body string")
    return [r.valid for r in requests.parse_requests(frame).orderBy("request_id").collect()]


def changed(path, value):
    body = json.loads(json.dumps(BODY))
    *way, last = path.split(".")
    part = body
    for key in way:
        part = part[key]
    if value is ...:
        del part[last]
    else:
        part[last] = value
    return json.dumps(body)


def test_tolerated(spark):
    last = {"timestamp": "2026-03-11T17:00:00Z", "km_from_current": 1.5}
    texts = [json.dumps(BODY), json.dumps(dict(reversed(BODY.items())) | {"more": [1]}), changed("last_transaction", ...), changed("last_transaction", last), changed("transaction.installments", 2.0)]
    assert valid(spark, *texts) == [True] * 5


def test_refused(spark):
    texts = [
        "", None, "{", "[]", json.dumps(BODY)[:50], changed("merchant", ...), changed("merchant.mcc", None), changed("transaction.amount", "12"),
        changed("transaction.requested_at", "2026/03/11T18:00:00Z"), changed("transaction.requested_at", "2026-13-11T18:00:00Z"),
        changed("transaction.installments", 2.5), changed("customer.known_merchants", [None]), changed("last_transaction", {"timestamp": "2026-03-11T17:00:00Z"}),
    ]
    assert valid(spark, *texts) == [False] * len(texts)


def test_every_request_is_answered(spark):
    parsed = spark.createDataFrame([(1, True), (2, False), (3, True)], "request_id long, valid boolean")
    scored = spark.createDataFrame([(1, True, 0.2)], "query_id long, approved boolean, fraud_score double")
    got = {r.request_id: (r.approved, r.fraud_score, r.failed) for r in scoring.respond(parsed, scored).collect()}
    assert got == {1: (True, 0.2, False), 2: (False, 1.0, True), 3: (False, 1.0, True)}


def test_labelled_json(spark, tmp_path):
    rows = [{"vector": [0.5] * DIM, "label": "legit"}, {"vector": [0.25] * 5 + [-1, -1] + [1] * 7, "label": "fraud"}]
    path = tmp_path / "refs.json.gz"
    path.write_bytes(gzip.compress(json.dumps(rows).encode()))
    refs = references.prepare_references(references.read_labelled(spark, str(path)))
    got = [(r.record_index, r.label, r.vec) for r in refs.orderBy("record_index").collect()]
    assert got == [(0, 0, [5000] * DIM), (1, 1, [2500] * 5 + [-10000, -10000] + [10000] * 7)]
    references.write_references(refs, str(tmp_path / "store"))
    assert references.read_references(spark, str(tmp_path / "store")).count() == 2
    assert references.label_histogram(refs).first().asDict() == {"records": 2, "fraud": 1, "legit": 1}


@pytest.mark.parametrize("bad", [{"vector": [0.0] * 13, "label": "legit"}, {"vector": [None] + [0.0] * 13, "label": "legit"}, {"vector": [0.0] * 14, "label": "odd"}, {"label": "legit"}])
def test_bad_records_raise(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(json.dumps([bad]))
    with pytest.raises(Exception, match="vector|label"):
        references.prepare_references(references.read_labelled(spark, str(tmp_path / "bad.json"))).collect()


def test_numbers_are_consecutive(spark):
    frame = spark.range(1000).repartition(7)
    assert sorted(r.n for r in references.number_rows(frame, "n").collect()) == list(range(1000))


def test_category_file(tmp_path):
    (tmp_path / "risk.json").write_text('{"5411": 0.15}')
    assert references.load_category_risk(str(tmp_path / "risk.json")) == {"5411": 0.15}


def points(n):
    return np.arange(n * DIM, dtype=np.int16).reshape(n, DIM)


def test_reference_file(spark, tmp_path):
    data = binary.encode_references(np.array([0, 1, 1]), points(3), created=1_770_000_000)
    header, labels, ids, vectors = binary.decode_references(data)
    assert (header.version, header.count, header.dim, header.stride, header.scale, header.created) == (14, 3, 14, 16, 10000, 1_770_000_000)
    assert labels.tolist() == [0, 1, 1] and ids.tolist() == [0, 1, 2] and (vectors == points(3)).all()
    (tmp_path / "r.bin").write_bytes(data)
    got = binary.import_references(spark, str(tmp_path / "r.bin")).orderBy("record_index").collect()
    assert [(r.record_index, r.label, r.vec) for r in got] == [(i, y, v.tolist()) for i, (y, v) in enumerate(zip([0, 1, 1], points(3), strict=True))]


@pytest.mark.parametrize(("at", "byte", "why"), [(0, 0, "magic"), (4, 13, "version"), (16, 16, "dimensions"), (20, 8, "stride")])
def test_reference_header_refused(at, byte, why):
    data = bytearray(binary.encode_references(np.array([0]), points(1)))
    data[at] = byte
    with pytest.raises(binary.FormatError, match=why):
        binary.decode_references(bytes(data))


def test_file_sizes_are_exact():
    for data, decode in [
        (binary.encode_references(np.array([0]), points(1)), binary.decode_references),
        (binary.encode_ivf(points(1), points(1), points(1), np.array([0, 1]), np.array([0]), points(1), np.array([1])), binary.decode_ivf),
        (binary.encode_pq(np.zeros((4, 256, 4)), np.zeros((2, 4))), binary.decode_pq),
    ]:
        decode(data)
        for wrong in (data + b"\0", data[:-1], data[:16]):
            with pytest.raises(binary.FormatError):
                decode(wrong)


def test_index_files():
    got = binary.decode_ivf(binary.encode_ivf(points(2), points(2), points(2) + 1, np.array([0, 2, 3]), np.array([2, 0, 1]), points(3), np.array([1, 0, 1])))
    assert got["version"] == 3 and got["offsets"].tolist() == [0, 2, 3] and got["postings"].tolist() == [2, 0, 1]
    assert (got["box_high"] == points(2) + 1).all() and (got["vectors"] == points(3)).all() and got["labels"].tolist() == [1, 0, 1]
    books, codes = np.arange(4 * 256 * 4).reshape(4, 256, 4) % 999, np.arange(8).reshape(2, 4)
    b, c = binary.decode_pq(binary.encode_pq(books, codes))
    assert (b == books).all() and (c == codes).all()


@pytest.mark.parametrize("version", [1, 2, 3])
def test_index_files_become_tables(spark, tmp_path, version):
    import struct

    from votegrid.operators import ivf, pq

    refs = spark.createDataFrame([(i, int(i % 2), [int(10 * i + k) for k in range(DIM)]) for i in range(6)], "record_index long, label byte, vec array<smallint>")
    index = ivf.index_from_centroids(refs, np.array([[0] * DIM, [40] * DIM], np.int16), version)
    path = f"{tmp_path}/index.ivf"
    if version == 3:
        binary.export_ivf(index, f"file://{path}")
    else:  # files of the older versions end after their postings
        x = index.layout
        order = [r.record_index for r in index.members.orderBy("ordered_pos").collect()]
        head = binary.IVF_MAGIC + struct.pack("<IQIIq", version, 6, 2, binary.STRIDE, 0)
        boxes = [binary._wide(x.low), binary._wide(x.high)] if version == 2 else []
        offsets = np.array([0, x.size[0], 6], "<u4").tobytes()
        with open(path, "wb") as out:
            out.write(binary._layout(head, binary.IVF_HEADER, binary._wide(x.centroids), *boxes, offsets, np.array(order, "<u4").tobytes()))
    back = binary.import_ivf(spark, path, refs)
    assert (back.version, back.count, back.cluster_count) == (version, 6, 2)
    rows = lambda i: sorted(tuple(r) for r in i.members.select("record_index", "label", "vec", "cluster_id", "ordered_pos").collect())
    assert rows(back) == rows(index)
    assert (back.layout.low == (index.layout.low if version > 1 else index.layout.centroids)).all() and (back.layout.size == index.layout.size).all()
    with pytest.raises(binary.FormatError):
        binary.import_ivf(spark, path, refs.where("record_index < 5"))
    books = np.arange(1024 * 4, dtype=np.int16).reshape(4, 256, 4)
    codes = np.arange(24).reshape(6, 4)
    with open(f"{tmp_path}/codes.pq", "wb") as out:
        out.write(binary.encode_pq(books, codes))
    coded, table = binary.import_pq(spark, f"{tmp_path}/codes.pq", back)
    assert [r.codes for r in coded.members.orderBy("ordered_pos").collect()] == codes.tolist()
    assert (pq.codebook_array(table) == books).all()
    pq.save_pq(coded, table, f"{tmp_path}/saved")
    again, table = pq.load_pq(spark, f"{tmp_path}/saved", 6)
    assert again.version == version and (pq.codebook_array(table) == books).all()
    with pytest.raises(ValueError):
        pq.codebook_array(table.where("subvector < 3"))


def test_reset_and_metrics(spark):
    from votegrid.operators import stats

    events = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "at long, what string")
    none = spark.createDataFrame([], "at long")
    assert stats.since_reset(events, none).count() == 3
    assert [r.what for r in stats.since_reset(events, spark.createDataFrame([(2,), (5,)], "at long")).collect()] == ["c"]
    answers = spark.createDataFrame([(1, 3, True, False), (2, 0, False, True)], "query_id long, votes long, used_fallback boolean, expanded boolean")
    assert tuple(stats.search_metrics(answers).first()) == (2, 1, 1, 3)


def test_vectors_in_one_call(spark):
    from votegrid.sources import requests

    rows = requests.quantised_vectors(spark.createDataFrame([(1, "{}"), (2, None), (3, "no json")], "request_id long, body string")).collect()
    assert [(r.request_id, r.valid, r.vec) for r in rows] == [(k, False, None) for k in (1, 2, 3)]


def test_stats(spark):
    frame = spark.createDataFrame([("parse", 3), ("parse", 4), ("search", None)], "phase string, ns long")
    got = {r.phase: (r["count"], r.total_ns, r.max_ns, r.avg_ns) for r in stats.phase_stats(frame).collect()}
    assert got == {"parse": (2, 7, 4, 3), "search": (0, 0, 0, 0)}
    assert json.loads(stats.snapshot_json(stats.phase_stats(frame).where("phase = 'parse'")).first().stats)["avg_ns"] == 3


def test_fixture_numbers_are_ranks(spark, sf_dir):
    got = sorted(r.record_index for r in fx.references(spark, sf_dir).select("record_index").collect())
    assert got == list(range(len(got)))
    assert fx.query_vectors(spark, sf_dir).where(F.col("query_id") % 10 != 0).count() == 0
