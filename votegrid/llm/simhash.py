"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Documents collapse to distinct fingerprints first.  Each fingerprint emits every
variant within half the radius; two fingerprints within the (even) radius meet in
at least one variant, and all that meet in a variant are within the radius of
each other, so a chain through each variant's members carries all its links.
Chains are deduplicated, verified by counting bits, and contracted to components.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votegrid.llm.common import keyed, python_ready, without_rows
from votegrid.llm.components import connected_components
from votegrid.storage import Scratch

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingles hashed and counted at a time; bounds memory for very long texts.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``words`` words, repeats included, in blocks.

    Fewer words make one shingle of the whole sequence; no word makes none.
    """
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.zeros(len(found), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    width = min(words, len(found))
    first = start[: len(found) - width + 1].tolist()
    last = (start + size)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), _BLOCK):
        spans = zip(first[k : k + _BLOCK], last[k : k + _BLOCK], strict=True)
        yield np.array([digest(line[a:b], seed) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set where more than half of the shingle hashes have it."""
    total, ones = 0, np.zeros(64, np.int64)
    for block in shingle_hashes(text, words, seed):
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """``doc_id``, ``tag`` (64-bit hash of the raw text) and ``fp`` (as a signed long)."""
    python_ready(docs.sparkSession)
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("tag"),
        F.col(text_col).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words, seed) for x in batch.column(2)]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed)], ["doc_id", "tag", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, tag long, fp long")


def variants(fp, radius: int):
    """All values within ``radius // 2`` flipped bits of ``fp``."""
    masks = [0]
    for flips in range(1, radius // 2 + 1):
        masks += [sum(1 << i for i in bits) for bits in itertools.combinations(range(64), flips)]
    return F.array(*[fp.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Verified edges (a, b) between distinct fingerprints ``fp``.

    A variant has at most as many members as there are values in its ball, however
    many documents there are, so the window's groups are bounded.
    """
    met = classes.select("fp", F.explode(variants(F.col("fp"), radius)).alias("variant"))
    chain = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (
        met.select(chain.alias("a"), F.col("fp").alias("b"))
        .where("a is not null").distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
    seed: int = 42,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, tag, fingerprint, component_id``.

    ``radius`` must be even.  Component ids are the smallest id in reach.

    * Null, empty and wordless texts have fingerprint zero and link like others.
    * Null ids order below all others in no component: a component's id is its
      smallest non-null id, or null if it has none.
    * Repeated rows share their fingerprint and component; an empty table gives an
      empty result; extra columns are ignored.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: only then is each variant's group a clique")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.stage(fingerprints(docs, id_col, text_col, words, seed), "rows")
    classes = scratch.stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reach = scratch.stage(connected_components(links(classes, radius), scratch), "reach")

    joined = classes.join(reach, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    joined = scratch.stage(joined, "joined")
    heads = scratch.stage(joined.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    named = scratch.stage(
        joined.join(heads.withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
        .select(F.col("fp").alias("cfp"), "component_id"),
        "named",
    )
    scratch.keep("rows", "named")
    return rows.join(named, F.col("fp") == F.col("cfp")).select(
        "doc_id", "tag", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- Jaccard similarity ------------------------------------------------------------
#
# Texts that share 80 % of their five-word shingles differ in about a seventh of
# their SimHash bits: no ball finds them all.  So candidates come from an exact prefix
# filter: in any one order of all shingles, two sets of the similarity t have a member
# in common among the first n - ceil(t * n) + 1 of each.

#: Texts that tell which shingles are frequent, and the number of those that are
#: kept.  Only the order depends on them, and so the cost, never the result.
ORDER_DOCS, ORDER_SHINGLES = 8_000, 200_000
#: Longs of a parity bitmap: bitmaps differ in no more bits than their sets in members.
PARITY = 16
#: Shingles before a shared one that are looked at to see whether a pair has met
#: already.  More meet again; the pairs are made distinct in any case.
EARLIER = 64


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    blocks = list(shingle_hashes(text, words, seed))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def set_name(hashes: np.ndarray) -> int:
    """64 bits, as a signed long, that name a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a shingle set, as a signed long; zero if it is empty."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[k : k + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def ball_pairs(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Candidates ``cid, hub`` by ball hashing of the sets' fingerprints: sets of one
    fingerprint with the first of them, and the first ones of linked fingerprints."""
    firsts = scratch.stage(classes.groupBy("fp").agg(F.min("cid").alias("first")), "firsts")
    one, two = _twice(firsts)
    linked = links(firsts, radius).join(one, F.col("a") == F.col("fp1")).join(two, F.col("b") == F.col("fp2"))
    same = classes.select("cid", F.col("fp").alias("fp_")).join(firsts, F.col("fp_") == F.col("fp"))
    return linked.select(F.col("first1").alias("cid"), F.col("first2").alias("hub")).unionByName(same.select("cid", F.col("first").alias("hub")))


def frequent(source: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of texts, ascending, and their counts."""
    step = max(1, source.count() // ORDER_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), words, seed).view(np.int64))], ["item"])

    counted = source.where(F.pmod(F.col("tag"), F.lit(step)) == 0).select("text").mapInArrow(run, "item long").groupBy("item").count()
    top = counted.where("count > 2").orderBy(F.desc("count"), "item").limit(ORDER_SHINGLES).toArrow()
    items = top["item"].to_numpy().view(np.uint64)
    order = np.argsort(items)
    return items[order], top["count"].to_numpy()[order]


def parity(hashes: np.ndarray) -> list[int]:
    """Of each residue of the shingle hashes, whether an odd number has it, as longs."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_parity(hashes: np.ndarray) -> bytes | None:
    """The same over at least four residues for each member, as many as a power of two;
    null for small sets, which :func:`parity` serves as well."""
    if 16 * len(hashes) <= 64 * PARITY:
        return None
    residues = 1 << (4 * len(hashes) - 1).bit_length()
    odd = np.bincount((hashes & np.uint64(residues - 1)).astype(np.int64), minlength=residues) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """In how many bits two wide bitmaps differ, the wider one folded to the other's
    size: sets differ in at least as many members."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (one, two)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(hashes: np.ndarray, similarity: float, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The leading shingles, rare ones first, of which similar sets share one."""
    if not len(hashes):
        return hashes
    often = np.zeros(len(hashes), np.int64)
    if len(items):
        at = np.minimum(np.searchsorted(items, hashes), len(items) - 1)
        often = np.where(items[at] == hashes, counts[at], 0)
    width = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, often))][:width]


def room(similarity: float, bits: list[str]):
    """Whether sets of ``size1`` and ``size2`` members may be similar: the smaller is
    large enough, and their bitmaps differ in few enough bits."""
    total = F.col("size1") + F.col("size2")
    enough = total * (similarity / (1 + similarity)) - 1e-6
    apart = sum((F.bit_count(F.col(f"{b}1").bitwiseXOR(F.col(f"{b}2"))) for b in bits), F.lit(0))
    return (F.least("size1", "size2") >= enough) & (total - apart >= 2 * enough)


def _twice(frame: DataFrame) -> list[DataFrame]:
    """The frame with its columns numbered 1 and 2: the sides of a join with itself."""
    return [frame.select(*[F.col(c).alias(f"{c}{k}") for c in frame.columns]) for k in (1, 2)]


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()


def roomy(pairs: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of the staged ``pairs(a, b)`` of set names whose wide bitmaps leave room for
    the similarity: a sharp test for sets of any size, at a thirtieth of their bytes."""
    maps = rows.where("wide is not null").join(_ends(pairs), F.col("cid") == F.col("end"), "left_semi").select("cid", "size", "wide")
    one, two = _twice(scratch.stage(maps.dropDuplicates(["cid"]), f"{name}_maps"))
    both = pairs.join(one, F.col("a") == F.col("cid1"), "left").join(two, F.col("b") == F.col("cid2"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two, m, n in zip(*(batch.column(k) for k in (2, 3, 4, 5)), strict=True):
                known = one.is_valid and two.is_valid
                total = m.as_py() + n.as_py() if known else 0
                enough = total * (similarity / (1 + similarity)) - 1e-6
                keep.append(not known or total - apart(one.as_py(), two.as_py()) >= 2 * enough)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "wide1", "wide2", "size1", "size2").mapInArrow(run, "a long, b long")


def verified(
    pairs: DataFrame, source: DataFrame, rows: DataFrame, classes: DataFrame, words: int, similarity: float, seed: int, scratch: Scratch, name: str
) -> DataFrame:
    """Those of the staged ``pairs(a, b)`` of set names whose sets have the Jaccard
    similarity; the sets are made again from one text of each class concerned."""
    pairs = scratch.stage(roomy(pairs, rows, similarity, scratch, name), f"{name}_roomy")
    tags = classes.join(_ends(pairs), F.col("cid") == F.col("end"), "left_semi").select("least_tag").distinct()
    tags = keyed(scratch.stage(tags, f"{name}_tags"))
    texts = source.join(tags, F.col("tag") == F.col("least_tag"), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), words, seed) for x in batch.column(0)]
            sets = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(set_name, found), pa.int64()), sets], ["cid", "items"])

    sets = scratch.stage(texts.mapInArrow(run, "cid long, items array<long>").dropDuplicates(["cid"]), f"{name}_sets")
    one, two = _twice(sets)
    both = F.size(F.array_intersect("items1", "items2"))
    return (
        pairs.join(one, F.col("a") == F.col("cid1")).join(two, F.col("b") == F.col("cid2"))
        .where(both / (F.size("items1") + F.size("items2") - both) >= similarity).select("a", "b")
    )


def set_rows(source: DataFrame, words: int, similarity: float, seed: int, bits: list[str]) -> DataFrame:
    """``doc_id, tag, cid, size``, and for the first row of a set in its task its
    fingerprint ``fp``, the prefix ``heads`` and the bitmaps, else null."""
    order = source.sparkSession.sparkContext.broadcast(frequent(source, words, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = [shingle_set(x.as_py(), words, seed) for x in batch.column(2)]
            names = [set_name(x) for x in found]
            heads, odd, wide, fps = [], [], [], []
            for x, cid in zip(found, names, strict=True):
                first = cid not in seen
                seen.add(cid)
                heads.append(prefix(x, similarity, *order.value).view(np.int64) if first else None)
                odd.append(parity(x) if first else [None] * PARITY)
                wide.append(wide_parity(x) if first else None)
                fps.append(set_fingerprint(x) if first else None)
            columns = [pa.array(names, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(fps, pa.int64())]
            columns += [pa.array(x, pa.int64()) for x in (zip(*odd, strict=True) if odd else [()] * PARITY)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "tag", "cid", "size", "heads", "wide", "fp", *bits])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, tag long, cid long, size long, heads array<long>, wide binary, fp long, " + ", ".join(f"{b} long" for b in bits))


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    seed: int = 42,
    radius: int = 2,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, tag, component_id``; texts link when their
    shingle sets have the Jaccard similarity ``similarity``, exactly.

    The first candidates meet by ball hashing of their SimHash within ``radius`` bits, as
    in :func:`near_duplicates`.  At this similarity most pairs differ in more bits, so
    others share a shingle of their prefixes: each meets, at its shingles,
    the member with most company there (copies of a text gather round it) and the
    smallest, which joins groups of copies without pairing all of them; then all
    candidates still in different components meet, once each, where sizes, places in
    the prefixes and bitmaps leave room for the similarity.  Pairs inside a component
    could not change it, so none is missed.

    Nulls, empty texts, repeated rows and empty tables are treated as by
    :func:`near_duplicates`.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "similar")
    python_ready(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    bits = [f"odd{k}_" for k in range(PARITY)]
    rows = scratch.stage(set_rows(source, words, similarity, seed, bits), "rows")
    classes = scratch.stage(
        rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("tag").alias("least_tag"), F.min("size").alias("size"), F.min("fp").alias("fp"), *[F.min(b).alias(b) for b in bits]), "classes"
    )
    # the rows of shared prefix shingles; most shingles are of one text and end here
    met = rows.where("heads is not null").select("cid", F.posexplode("heads").alias("pos", "item"))
    shared = met.groupBy(F.col("item").alias("shared")).agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("company")).where("low < high")
    crowd = scratch.stage(
        met.join(shared.drop("high"), F.col("item") == F.col("shared")).select("item", "cid", "pos", "low", "company").distinct(), "crowd"
    )
    central = crowd.groupBy(F.col("cid").alias("c")).agg((F.sum("company") / (F.max("pos") + 1)).alias("central"))
    hubs = crowd.join(central, F.col("cid") == F.col("c")).groupBy(F.col("item").alias("at")).agg(F.max_by("cid", "central").alias("hub"))
    stars = (
        crowd.join(hubs, F.col("item") == F.col("at")).select("cid", "hub")
        .unionByName(crowd.select("cid", F.col("low").alias("hub"))).unionByName(ball_pairs(classes, radius, scratch)).where("cid <> hub")
        .select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    )
    one, two = _twice(classes.select("cid", "size", *bits))
    stars = stars.join(one, F.col("a") == F.col("cid1")).join(two, F.col("b") == F.col("cid2")).where(room(similarity, bits)).select("a", "b")
    starred = scratch.stage(verified(scratch.stage(stars, "stars_pairs"), source, rows, classes, words, similarity, seed, scratch, "stars"), "starred")
    links_of_stars = Scratch(spark, "stars")
    part = scratch.stage(connected_components(starred, links_of_stars), "part")
    links_of_stars.drop()

    placed = scratch.stage(
        crowd.join(part, F.col("cid") == F.col("node"), "left").select("item", "cid", "pos", F.coalesce("root", "cid").alias("root")),
        "placed",
    )
    mixed = placed.groupBy(F.col("item").alias("mixed")).agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    odd = classes.select(F.col("cid").alias("odd_cid"), "size", *bits)
    before = Window.partitionBy("cid").orderBy("pos").rowsBetween(-EARLIER, -1)
    left = scratch.stage(
        placed.join(mixed, F.col("item") == F.col("mixed")).withColumn("prior", F.collect_list("item").over(before))
        .join(odd, F.col("cid") == F.col("odd_cid")).select("item", "cid", "size", "pos", "root", "prior", *bits), "left",
    )
    one, two = _twice(left)
    # of what similar sets share, the shingles from here on must leave room for
    enough = (F.col("size1") + F.col("size2")) * (similarity / (1 + similarity)) - 1e-6
    reached = F.least(F.col("size1") - F.col("pos1"), F.col("size2") - F.col("pos2"))
    across = one.join(
        two,
        (F.col("item1") == F.col("item2")) & (F.col("cid1") < F.col("cid2")) & (F.col("root1") != F.col("root2"))
        & (reached >= enough) & room(similarity, bits) & ~F.arrays_overlap("prior1", "prior2"),
    ).select(F.col("cid1").alias("a"), F.col("cid2").alias("b")).distinct()
    crossed = verified(scratch.stage(across, "across_pairs"), source, rows, classes, words, similarity, seed, scratch, "across")
    reach = scratch.stage(connected_components(starred.union(crossed), scratch), "reach")
    joined = scratch.stage(
        classes.join(reach, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("root", "cid").alias("root")), "joined"
    )
    heads = scratch.stage(joined.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "heads")
    named = scratch.stage(
        joined.join(heads, F.col("root") == F.col("r")).select(F.col("cid").alias("named_cid"), "component_id"), "named"
    )
    scratch.keep("rows", "named")
    return rows.join(named, F.col("cid") == F.col("named_cid")).select("doc_id", "tag", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, of each group of similar texts the row with
    the smallest id.  A row is named by id and text; the key table of rows to
    drop is broadcast only within a counted size.  Where a group has no id, or
    several rows with its smallest id, all of these stay."""
    scratch = Scratch(docs.sparkSession, "similar")
    groups = similar_groups(docs, id_col, text_col, scratch=scratch, **how)
    gone = scratch.stage(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "tag").distinct(), "gone")
    scratch.keep("gone")
    return without_rows(docs, {"doc_id": F.col(id_col), "tag": F.xxhash64(F.col(text_col))}, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: three-word shingles, at most two differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, radius=2, seed=42).drop("tag")
