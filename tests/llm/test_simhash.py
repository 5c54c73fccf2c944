"""SimHash groups as a whole, against fingerprints and components by the definition."""

import random

import pytest
import xxhash

from rowloom.llm import simhash_dedup


def by_definition(text: str | None) -> int:
    ws = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("points", [40_000, 60])  # one shard, several
def test_groups_equal_brute_force(spark, monkeypatch, points):
    monkeypatch.setattr(simhash_dedup, "SHARD_POINTS", points)
    rng = random.Random(6)
    texts: list[str | None] = [None, "", "one", "ONE", "a b", " \t\n"]
    for _ in range(120):
        ws = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((5, 40, 400)))]
        texts.append(" ".join(ws))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(ws))
            texts.append("\t".join([*ws[:at], "other", *ws[at + 1 :]]))
    ids = [None if k % 50 == 7 else 1000 - k for k in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string, rep int")
    got = simhash_dedup.near_groups(docs).collect()
    fps = [by_definition(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):  # all pairs, until nothing moves
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {}
    for d, r in zip(ids, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted([(d, f"{f:016x}", least.get(r)) for d, f, r in zip(ids, fps, root, strict=True)], key=str)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=str) == want
    assert len(set(root)) < len(texts) - 40
