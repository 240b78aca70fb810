"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import DOCS, ODD, table
from votegrid.llm import exact_dedup, simhash
from votegrid.llm.components import connected_components
from votegrid.storage import Scratch

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(ASCII)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hash_bits", [128, 8])
def test_exact_against_brute_force(spark, keep, hash_bits):
    groups = defaultdict(list)
    for r in ODD:
        groups[norm(r[1])].append(r[0])
    order = lambda x: (x is not None, x or 0)
    best = {t: (min if keep == "smallest" else max)(ids, key=order) for t, ids in groups.items()}
    got = exact_dedup.mark_duplicates(table(spark, ODD), keep=keep, hash_bits=hash_bits).collect()
    assert len(got) == len(ODD)
    key = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    seen = defaultdict(int)
    for r in got:
        t = key[r.text_sha256]
        assert r.doc_id in groups[t] and r.keep_id == best[t] and r.group_size == len(groups[t])
        assert not r.kept or r.doc_id == best[t]
        seen[t] += r.kept
    assert set(seen.values()) == {1}


def test_exact_drop_keeps_one_of_each(spark):
    docs = table(spark, ODD)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(norm(r.text) for r in left.collect()) == sorted({norm(r[1]) for r in ODD})
    assert exact_dedup.drop_duplicates(docs.where("false")).count() == 0
    assert exact_dedup.mark_duplicates(docs.where("false")).count() == 0


def slow_fingerprint(text, words=3):
    found = re.findall("[^\x20\x09-\x0d]+", norm(text))
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(ids, prints):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[j] > label[i]:
                    label[j], changed = label[i], True
    least = {}
    for i, n in zip(ids, label, strict=True):
        if i is not None:
            least[n] = min(i, least.get(n, i))
    return [least.get(n) for n in label]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB \t\né \x1c.", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_against_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [r for r in ODD if r[0] != 11]
    for k in range(12):  # a chain of edited copies
        base[3 * k] = f"changed{k}"
        rows.append((100 + k, " ".join(base), "en", "a", 0))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], slow_components([r[0] for r in rows], prints), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(table(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(table(spark, rows), radius=3)


def test_links_cover_a_crowded_ball(spark):
    prints = [0] + [1 << i for i in range(0, 40)] + [(1 << 50) | (1 << i) for i in range(5)] + [(1 << 63) - 1]
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(classes, 2)
    assert all(bin(r.a ^ r.b).count("1") <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert set(roots.values()) == {0} and set(roots) == set(prints) - {(1 << 63) - 1}


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 40)] + [(1000, 1000), (1001, 1000)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1040), 1000)}
    assert connected_components(edges.where("false"), Scratch(spark, "t")).count() == 0


def test_similar_texts_are_thinned(spark):
    long = [f"word{i}" for i in range(300)]
    rows = [(k, " ".join(long[: 20 * k] + ["other"] + long[20 * k :]), "en", "a", 0) for k in range(1, 9)]
    rows += [(50 + k, " ".join(f"t{k}x{i}" for i in range(120)), "en", "b", 0) for k in range(6)]
    docs = table(spark, rows)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 50, 51, 52, 53, 54, 55]
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.drop_near_duplicates(table(spark, ODD)).count() > 0


def shingle_sets(rows):
    found = {}
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", norm(r[1]))
        found[r[0]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return found


def slow_groups(rows, least=0.8):
    """Smallest id of each text's component under the exact Jaccard similarity."""
    sets = shingle_sets(rows)
    label = {i: i for i in sets}
    order = sorted(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x == y or (both and both / (len(x) + len(y) - both) >= least):
                one, two = sorted((root(a), root(b)))
                label[two] = one
    return {i: root(i) for i in order}


def families(count, size, shared, own, seed=3):
    """Texts in families with a passage of ``shared`` words in common, of which pairs
    are near copies of each other."""
    draw = random.Random(seed)
    rows = []
    for f in range(count):
        passage = [f"p{f}x{i}" for i in range(shared)]
        for k in range(size):
            text = passage + [f"f{f}k{k}x{i}" for i in range(own)]
            copy = list(text)
            for at in draw.sample(range(len(text)), k=draw.randint(1, 4)):
                copy[at] = f"c{f}k{k}x{at}"
            rows += [(len(rows) + j, " ".join(t), "en", "a", 0) for j, t in enumerate((text, copy))]
    return rows


@settings(max_examples=40, deadline=None)
@given(st.integers(70, 3000), st.integers(0, 900), st.integers(0, 900), st.integers(0, 99))
def test_wide_bitmaps_differ_in_no_more_than_the_sets(shared, one, two, seed):
    draw = np.random.default_rng(seed)
    pool = np.unique(draw.integers(0, 1 << 63, shared + one + two, dtype=np.uint64))
    a, b = pool[: shared + one], np.concatenate([pool[:shared], pool[shared + one :]])
    differ = len(np.setxor1d(a, b))
    found = simhash.apart(simhash.wide_parity(a), simhash.wide_parity(b))
    assert found <= differ and (differ - found) % 2 == 0
    assert 3 * len(a) < 2 * len(b) or 3 * len(b) < 2 * len(a) or found > 0.5 * differ - 3  # and sharp between sets of like size
    assert simhash.wide_parity(a[:64]) is None


def test_texts_below_the_similarity_stay_apart(spark):
    """Texts that share a long passage (0.67 to each other) are not near copies."""
    rows = families(count=2, size=40, shared=160, own=40)
    want = slow_groups(rows)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(table(spark, rows)).collect()}
    assert all(want[i] == want[g] for i, g in found.items())


def test_similar_groups_against_brute_force(spark):
    rows = families(count=6, size=12, shared=150, own=50, seed=5)
    long = [f"w{i}" for i in range(104)]
    rows += [(900, " ".join(long), "en", "a", 0), (901, "q " + " ".join(long[1:]), "en", "a", 0)]
    rows += [(910 + k, " ".join(long[: 50 + 3 * k]), "en", "a", 0) for k in range(18)]  # a chain of ever longer texts
    rows += [(1000 + r[0], *r[1:]) for r in ODD if r[0] not in (7, None)]
    want = slow_groups(rows)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(table(spark, rows)).collect()}
    assert found == want


def test_near_stage_meets_by_ball_hashing(spark, monkeypatch):
    """The stage's candidates come from ball hashing of fingerprints, too."""
    import corpus_pipeline

    draw = random.Random(3)
    words = [f"w{k}" for k in range(3_000)]
    text = draw.choices(words, k=800)
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, " ".join(draw.choices(words, k=800)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met, plain = [], simhash.ball_pairs
    monkeypatch.setattr(simhash, "ball_pairs", lambda *a: met.append(plain(*a)) or met[0])
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and len(met) == 1
    for _, t in rows:
        found = simhash.shingle_set(t, 5, 42)
        ones = [sum(int(x) >> b & 1 for x in found) for b in range(64)]
        assert simhash.set_fingerprint(found) % (1 << 64) == sum(1 << b for b in range(64) if 2 * ones[b] > len(found))
