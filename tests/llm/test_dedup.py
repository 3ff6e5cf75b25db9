"""Duplicate operators against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deltaloom.llm import exact_dedup, fuse_filter, simhash_dedup
from deltaloom.llm.components import components


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_filter_holds_its_keys(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    assert fuse_filter.contains(fuse_filter.build(keys), keys).all()


def test_filter_rules_out_most_others():
    rng = np.random.default_rng(1)
    data = fuse_filter.build(rng.integers(0, 2**63, 30_000, dtype=np.uint64))
    assert len(data) < 30_000 * 1.3
    assert fuse_filter.contains(data, rng.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 0.01


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _exact_want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(_normal(r["text"]), []).append(r["doc_id"])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(odd_docs, no_docs, weak):
    digest = (lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2))) if weak else exact_dedup.sha256
    got = exact_dedup.exact_duplicates(odd_docs, digest=digest)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == _exact_want(odd_docs.collect())
    assert exact_dedup.exact_duplicates(no_docs, digest=digest).count() == 0


@pytest.mark.parametrize("upto", [-1, 10, 10_000])
def test_any_snapshot_gives_the_same_groups(odd_docs, upto):
    got = exact_dedup.exact_duplicates(odd_docs, snapshot_upto=upto).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == _exact_want(odd_docs.collect())


def test_exact_keep_first(odd_docs, no_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [_normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({_normal(r["text"]) for r in odd_docs.collect()})
    unique = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert exact_dedup.keep_first(unique).count() == len({_normal(r["text"]) for r in unique.collect()})
    assert exact_dedup.keep_first(no_docs).count() == 0


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_near_duplicates(odd_docs, no_docs):
    rows = odd_docs.where("doc_id is null or doc_id <> 300").select("doc_id", "text").collect()
    fps = [_fingerprint(r["text"]) for r in rows]
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, _components([r["doc_id"] for r in rows], fps))), key=str)
    got = simhash_dedup.near_duplicates(odd_docs.where("doc_id is null or doc_id <> 300"))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def test_dense_group_over_several_chunks(spark, monkeypatch):
    """A ball of fingerprints and chains between balls, with chunks far smaller than the blocks."""
    monkeypatch.setattr(simhash_dedup, "CHUNK", 7)
    rnd = random.Random(2)
    fps = set()
    for centre in [rnd.getrandbits(64) for _ in range(5)]:
        for _ in range(60):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)), "a", "b")
    root = {r["node"]: r["root"] for r in found.collect()}
    got = [root.get(x, x) for x in signed]
    want = _components(signed, fps)
    assert got == want


def test_pivots_never_discard_a_link():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 2**63, 1000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rnd.integers(0, 64, 1000, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 1000, dtype=np.uint64))
    a, b = (simhash_dedup.distance_table(z).astype(int) for z in (x, y))
    assert (abs(a - b).max(axis=1) <= simhash_dedup.RADIUS).all()


def test_near_keep_one(odd_docs):
    some = odd_docs.where("doc_id < 300").dropDuplicates(["doc_id"])
    kept = simhash_dedup.keep_one(some)
    found = simhash_dedup.near_duplicates(some)
    assert kept.columns == some.columns
    assert kept.count() == found.select("component_id").distinct().count()
    again = simhash_dedup.keep_one(odd_docs.where("doc_id < 300"))
    assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)] + [(5, 5), (400, 401), (401, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 401: 400}


def test_near_stage_finds_all_pairs_of_the_similarity(spark, monkeypatch):
    """The pipeline's stage against all pairs of texts, with leaders, several chunks and common passages."""
    import corpus_pipeline
    from deltaloom.llm import near_texts

    monkeypatch.setattr(near_texts, "CHUNK", 5)
    monkeypatch.setattr(near_texts, "LEFT_A_TEXT", 0)
    monkeypatch.setattr(near_texts, "ROUNDS", 3)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(15)], []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(20, 120))]
        for _ in range(10):
            own = list(base)
            for _ in range(rnd.randint(0, 5)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own + passage * rnd.randint(0, 1)))
    texts += ["", None, "one two", "ONE  two", *(" ".join([*passage, word()]) for _ in range(20))]
    sets = [{" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i for i, p in enumerate(parent) if i == p}
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == want
    monkeypatch.setattr(near_texts, "ROUNDS", 0)
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == want


def test_fingerprints_of_small_sets_lose_no_pair_at_the_threshold():
    """Texts of ``n`` shingles against the same with as many more as the similarity allows: similarity 0.8 or more, at any size of set."""
    from deltaloom.llm import near_texts

    rnd, far = random.Random(1), near_texts.radius(0.8)
    for n in (4, 5, 8, 12, 20, 60):
        for _ in range(2500):
            text = [str(rnd.random()) for _ in range(n + 4 + n // 4)]
            a, b = (near_texts.shingles(" ".join(text[:k])) for k in (n + 4, n + 4 + n // 4))
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
            apart = int(np.bitwise_count(np.array(near_texts.fingerprint(a)).view(np.uint64) ^ np.array(near_texts.fingerprint(b)).view(np.uint64)).sum())
            assert apart <= far[min(len(a), near_texts.EXACT_SIZE)]
    assert abs(near_texts.differing(4, 5, 4) - 3 / 16) < 1e-12 and near_texts.differing(9, 9, 9) == 0


def test_shingles_of_pieces_are_those_of_the_whole(monkeypatch):
    from deltaloom.llm import common, near_texts

    rnd = random.Random(2)
    texts = ["", " ", "one", "a b c d", "a b c d e", *(" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(n)) for n in (6, 40, 300))]
    want = [near_texts.shingles(t).tolist() for t in texts]
    monkeypatch.setattr(common, "PIECE_BYTES", 16)
    assert [near_texts.shingles(t).tolist() for t in texts] == want


def test_short_near_copies_are_found(spark):
    from deltaloom.llm import near_texts

    rnd = random.Random(3)
    rows = []
    for k in range(40):
        words = [str(rnd.randrange(10**9)) for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    got = {r["doc_id"]: r["component_id"] for r in near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
