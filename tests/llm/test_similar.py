"""Near copies by wide fingerprints, against brute-force shingle similarity."""

import random

import numpy as np
import pytest

from rowloom.llm import similar
from rowloom.llm.simhash_dedup import shingle_hashes


def texts(n: int, rng: random.Random) -> list[str]:
    """Texts of 60 to 400 words, each with a copy in which every 60th word or so is another one, and one with every fourth."""
    out = []
    for _ in range(n):
        ws = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        few, many = list(ws), list(ws)
        for k in range(rng.randint(0, 30), len(ws), 60):
            few[k] = "other"
        for k in range(0, len(ws), 4):
            many[k] = f"x{k}"
        out += [" ".join(ws), " ".join(few), " ".join(many)]
    return out


def likeness(a: str, b: str) -> float:
    x, y = (set(shingle_hashes(t.encode().split(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("tile", [30_000, 7, 1])  # buckets in one tile, in several, and all of them split
def test_copies_group_and_others_do_not(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE_POINTS", tile)
    ts = texts(25, random.Random(3))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).collect()}
    assert len(got) == len(ts)
    alike = [k for k in range(0, len(ts), 3) if likeness(ts[k], ts[k + 1]) >= 0.8]
    assert len(alike) > 15
    assert all(got[k] == k and got[k + 2] == k + 2 for k in range(0, len(ts), 3))
    assert [k for k in alike if got[k + 1] != k] == []


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "one", None), (4, "One", "c"), (None, "one", "c"), (5, "a b c d e f " * 9000, "c"), (5, "a b c d e f " * 9000, "c"), (None, "alone here", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(similar.similar_groups(docs).collect(), key=str)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5)]
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [3, None]
    assert similar.similar_groups(docs.limit(0)).collect() == []


def whole(texts, similarity=0.8):
    """Components of all pairs from the similarity on, by the shingles' strings; common shingles too."""
    sets = []
    for t in texts:
        ws = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({b" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({b" ".join(ws)} if ws else set()))
    groups: dict = {}
    for k, x in enumerate(sets):
        groups.setdefault(frozenset(x), []).append(k)
    reps, posts, root, pairs = list(groups), {}, {}, 0
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for k, x in enumerate(reps):
        order = sorted(x)
        both: dict = {}
        for w in order:
            for j in posts.get(w, ()):
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if n / (len(x) + len(reps[j]) - n) >= similarity:
                pairs += 1
                root[find(k)] = find(j)
        for w in order:
            posts.setdefault(w, []).append(k)
    out: dict = {}
    for k, x in enumerate(reps):
        out.setdefault(find(k), set()).update(groups[x])
    return {min(g): g for g in out.values()}, pairs


def test_groups_of_a_whole_table_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got: dict = {}
    for r in similar.similar_groups(docs).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    want, pairs = whole([r["text"] for r in rows])
    want = {frozenset(rows[k]["doc_id"] for k in g) for g in want.values()}
    assert pairs >= 40
    several = {g for g in want if len(g) > 1}
    missed = several - {frozenset(g) for g in got.values()}
    assert len(missed) <= 0.002 * len(several), missed
    assert len(got) - len(want) <= 0.002 * len(several)


def test_rows_with_one_id_are_texts_of_their_own(spark):
    a, b, c = texts(2, random.Random(5))[0], texts(2, random.Random(6))[0], texts(2, random.Random(7))[0]
    docs = spark.createDataFrame([(2, a), (2, b), (1, b + " end"), (3, c), (None, c)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in similar.similar_groups(docs).collect()), key=str)
    assert got == sorted([(2, 2), (2, 1), (1, 1), (3, 3), (None, 3)], key=str)


def test_alike_texts_share_a_band():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(500):
        both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (80, 10, 10))
        missed += not (similar.band_keys(np.concatenate([both, a])) == similar.band_keys(np.concatenate([both, b]))).any()
    assert missed <= 2


@pytest.mark.parametrize(("points", "broadcast"), [(40_000, 200_000), (40, 0)])  # one shard a band and a broadcast, several and a shuffle
def test_short_fingerprints_meet_by_vantage_point_trees(spark, monkeypatch, points, broadcast):
    monkeypatch.setattr(similar.simhash_dedup, "SHARD_POINTS", points)
    monkeypatch.setattr(similar.common, "BROADCAST_ROWS", broadcast)
    rng, bits = np.random.default_rng(8), similar.ROWS * similar.BITS
    texts = []
    for _ in range(60):
        both = rng.integers(0, 2**63, 40)
        texts += [np.concatenate([both, rng.integers(0, 2**63, k)]).astype(np.uint64) for k in (0, 4, 10, 25)]
    keys = [similar.band_keys(x) for x in texts]
    assert [k >> bits for k in keys[0].tolist()] == list(range(similar.BANDS))
    near = {(i, j) for i in range(len(keys)) for j in range(i) if (np.bitwise_count(keys[i] ^ keys[j]) <= similar.TREE_RADIUS).any()}
    equal = {(i, j) for i, j in near if (keys[i] == keys[j]).any()}
    assert len(near) > len(equal) > 100
    rows = [(k, [*map(int, v)]) for k, v in enumerate(keys)]
    got = similar.meetings(spark.createDataFrame(rows, "rep long, keys array<long>")).collect()
    buckets: dict = {}
    for r in got:
        buckets.setdefault(r["key"], set()).add(r["rep"])
    assert len(got) == sum(map(len, buckets.values()))
    met = {(i, j) for b in buckets.values() for i in b for j in b if j < i}
    assert near <= met and len(met) <= 1.1 * len(near)


def test_texts_without_an_equal_band_are_found_within_the_radius(spark):
    rng, pairs = random.Random(12), []
    while len(pairs) < 5:  # alike from 0.5 on, no least hashes of a band all shared, some band's fingerprints within the radius
        a = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        b = list(a)
        for k in rng.sample(range(60), 3):
            b[k] = "other"
        x, y = (np.unique(shingle_hashes([w.encode() for w in t], 5)) for t in (a, b))
        apart = np.bitwise_count(similar.band_keys(x) ^ similar.band_keys(y))
        sifted = np.bitwise_count(similar.wide_fingerprint(x) ^ similar.wide_fingerprint(y)).sum() > similar.LINK_RADIUS
        if not sifted and likeness(" ".join(a), " ".join(b)) >= 0.5 and 0 < apart.min() <= similar.TREE_RADIUS:
            pairs.append((" ".join(a), " ".join(b)))
    rows = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.5).collect()}
    assert got == {k: k - k % 2 for k in range(10)}
