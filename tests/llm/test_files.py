"""WARC, packing, fingerprints and the pipeline."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import DOCS, ODD, table
from votegrid.llm import packing, quality, sketch, warc

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- WARC ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), max_size=8), max_size=7))
def test_loser_tree(runs):
    runs = [sorted((x,) for x in r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_members_and_records():
    records = [warc.record_bytes("response", "http://a/b", k, "2024-01-01T00:00:00Z", b"x" * k * 70_000 + b"\r\n\r\n", "D", None) for k in range(4)]
    packed = b"".join((lambda c: c.compress(r) + c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31)) for r in records)
    back = list(warc.read_members(io.BytesIO(packed)))
    assert [raw for _, raw in back] == records and back[0][0] == 0
    assert [len(warc.parse_record(raw)[2]) for _, raw in back] == [k * 70_000 + 4 for k in range(4)]
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(packed[:-5])))


def test_url_keys():
    assert warc.url_key("https://www.News.example.com/A/b?Q=1#top") == "com,example,news)/a/b?q=1"
    assert warc.url_key(None) == warc.url_key(" \t") == ")/"
    assert warc.url_key("http://u:p@b.c:80?q#f") == "c,b)/?q"
    # no text is too odd
    for odd in ("http://[abc/x", "http://\u2100.com/", "//", "::", "a b\nc", "http://h:99999999/", "@", "#", "x" * 100_000):
        assert ")" in warc.url_key(odd)


def test_archives_round_trip(spark):
    rows = [(1, "http://b/x", "same"), (2, "http://a/y", "same"), (9, "http://a/y", "same"), (3, "http://a/z", None), (4, None, ""), (5, "http://c/\n1", "é \U0001f600 <p>"), (6, "http://[abc/x", "odd url"), (None, "http://a/", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keep", F.lit("clash")).repartition(3)
    assert {r.page_id: r.index_line for r in warc.archive_pages(pages, ranges=5).collect()} == {
        r.page_id: r.index_line for r in warc.archive_pages(pages, ranges=1).collect()
    }
    got = {r.page_id: r for r in warc.archive_pages(pages, ranges=2).collect()}
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    for i, _, h in rows:
        payload, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = i is not None and best[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", best[h or ""]) if again else ("response", None))
    order = sorted(got.values(), key=lambda r: r.index_line)
    assert [r.index_line for r in order] == list(range(len(rows)))
    assert [(r.url_key, r.stamp) for r in order] == sorted((r.url_key, r.stamp) for r in order)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_smaller_payloads_are_stored_whole(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_pages(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# --- packing ------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit(histogram):
    slots = packing.plan_best_fit(histogram, 30)
    bins, placed = {}, {n: [] for n in histogram}
    for length, a, b, each, first, offset in slots:
        for rank in range(a, b):
            placed[length].append(rank)
            t = rank - a
            bins.setdefault(first + t // each, []).append((offset + t % each * length, length))
    assert all(sorted(placed[n]) == list(range(c)) for n, c in histogram.items())
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 30
    rooms = []  # the definition, piece by piece
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms[rooms.index(min(fit))] -= n
            else:
                rooms.append(30 - n)
    assert sorted(set(bins)) == list(range(len(rooms)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'1 \n\t \x1c.é ", max_size=30))
def test_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.byte_vocabulary()[0])
    want = plain.encode(text, add_special_tokens=False).ids
    for paths in (packing.byte_vocabulary(), packing.byte_vocabulary()[:1]):
        assert np.frombuffer(packing.word_tokens(*paths)(text), "<u4").tolist() == want


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.byte_vocabulary()[0])
    rng = random.Random(1)
    rows = ODD + [(100 + k, " ".join(rng.choice(["the", "of", "zebra", "xq"]) for _ in range(rng.randint(0, 400))), "en", "a", 0) for k in range(80)]
    got = packing.pack(table(spark, rows), packing.byte_vocabulary()).collect()
    want = []
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or min(len(ids), 2048)
        starts = [0, *range(head, len(ids), 2048)]
        for k, a in enumerate(starts):
            b = starts[k + 1] if k + 1 < len(starts) else len(ids)
            want.append((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.pack(spark.createDataFrame([], DOCS), packing.byte_vocabulary()).count() == 0


# --- fingerprints ---------------------------------------------------------------------------


def slow_likeness(one, two):
    """From the shingles themselves: all of them where both texts have few."""
    sets = []
    for text in (one, two):
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(ASCII))
        sets.append({xxhash.xxh64_intdigest(" ".join(words[k : k + 5]).encode(), 42) >> 32 for k in range(max(1, len(words) - 4))} if words else set())
    short = [len(s) < sketch.SHORT for s in sets]
    a, b = sets if all(short) else [{h for h in s if h < sketch.FRACTION * 2**32} for s in sets]
    if short[0] == short[1] and a == b:
        return 1.0
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_a_frequent_id_is_spread(spark):
    rows = [(7 if k % 3 else k, f"text number {k} of one id", "en", "a", 0) for k in range(300)] + [(None, f"no id {k}", "en", "a", 0) for k in range(90)]
    docs = table(spark, rows, extra=False)
    parts = sketch.with_successor(docs, "doc_id", "text", 8).withColumn("pid", F.spark_partition_id()).groupBy("pid").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 150
    got = sketch.fingerprints(docs, buckets=8)
    assert got.count() == len(rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, sketch.fingerprints(docs, buckets=1).collect()))


def test_short_texts_have_fingerprints():
    texts = ["one two three four five six", "one two three four five seven", "one two", "one"]
    prints = [sketch.encode(sketch.sketch(t)) for t in texts]
    assert len(set(prints)) == len(texts) and all(len(p) > 1 for p in prints)
    assert sketch.likeness(sketch.sketch(texts[0]), sketch.sketch(texts[1])) == 0.5
    assert sketch.likeness(sketch.sketch(""), sketch.sketch(None)) == 1.0 and sketch.likeness(sketch.sketch(""), sketch.sketch("a")) == 0.0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_fingerprints_against_brute_force(spark, buckets):
    rng = random.Random(2)
    rows = ODD + [(200 + 3 * k, " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(120)), "en", "a", 0) for k in range(20)]
    got = sketch.fingerprints(table(spark, rows), buckets=buckets).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))  # ties have equal texts here
    want = []
    for k, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        a, b, c = (sketch.sketch(t) for t in (text, changed, following))
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), sketch.encode(a), sketch.encode(b), slow_likeness(text, changed), slow_likeness(text, following)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_few_rows(spark):
    one = sketch.fingerprints(spark.createDataFrame([(5, "a b c d e f g h", None, None, 0)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sketch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_properties():
    words = [f"w{i}" for i in range(4000)]
    whole, part = sketch.sketch(" ".join(words)), sketch.sketch(" ".join(words[:400]))
    assert sketch.containment(whole, part) > 0.95  # very unequal lengths
    assert sketch.containment(whole, sketch.sketch(" ".join(words[2000:] + words[:2000]))) > 0.95
    assert len(sketch.merge(whole, part).values) <= len(whole.values) + 3
    back = sketch.decode(sketch.encode(whole))
    assert (back.values == whole.values).all() and back.whole is whole.whole is False
    few = sketch.sketch(" ".join(words[:40]))
    assert few.whole and sketch.containment(few, whole) == 1.0 and not sketch.merge(few, whole).whole
    assert len(whole.values) / 3996 == pytest.approx(sketch.FRACTION, abs=0.03)


# --- pipeline ----------------------------------------------------------------------------------


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept, against plain versions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    first = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality")).select("doc_id").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in first for i in good]) > 0.95
    lower = lambda n: [r.t for r in spark.read.parquet(str(tmp_path / n)).select(F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    assert sorted(lower("exact_dedup")) == sorted(set(lower("quality")))
    shingles = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets = [shingles(t) for t in lower("near_dedup")]
    near = sum(len(a & b) >= 0.9 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert near == 0 and kept["near_dedup"] > 0.8 * kept["exact_dedup"]
    mixed = {r.doc_id for r in spark.read.parquet(str(tmp_path / "mixing")).select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == mixed
    assert quality.rating_grade() is not None


def test_stages_bear_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls, empties, ties, repeated rows, columns named like the operators' own, and
    no rows at all."""
    own = ["vg_id", "vg_tag", "vg_sha", "vg_selected", "vg_accept", "vg_score", "key_doc_id", "gone_doc_id", "cell_p", "cid", "root", "item", "doc"]
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, ODD).withColumns({n: F.lit("mine") for n in own})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        rows = kept.collect()
        assert rows
        if name != "packing":
            assert kept.columns == docs.columns and all(r[n] == "mine" for r in rows for n in own)
            docs = kept
        if name == "exact_dedup":  # 1 and 2, and 3 and 4, have equal texts; 7 occurs twice
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 3, 5, 6, 7, 8, 9, 10, 11, 12, None], key=str)
    nothing = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
