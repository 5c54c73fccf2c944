"""Parts that need no session, against brute force."""

import random

import numpy as np
import pytest

from rowloom.llm import chroma, ctw, licenses, mixing, packing, simhash_dedup, toxicity, vptree


def test_forest_equals_brute_force_in_clusters():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    pts = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, dtype=np.uint64), *[c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]]))
    rng.shuffle(pts)
    root = vptree.forest(pts, 3)
    near = np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3
    seen = np.full(len(pts), -1)
    for i in range(len(pts)):
        if seen[i] < 0:
            todo = [i]
            while todo:
                k = todo.pop()
                if seen[k] < 0:
                    seen[k] = i
                    todo += np.nonzero(near[k] & (seen < 0))[0].tolist()
    assert (root == seen).all()


def test_shards_hold_every_near_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(7) << rng.integers(0, 60, 2000, dtype=np.uint64))
    tree = vptree.packed(vptree.build(a[:500], 5))
    shard, idx = vptree.route(tree, np.concatenate([a, b]), 3)
    held: dict[int, set] = {}
    for s, i in zip(shard.tolist(), idx.tolist(), strict=True):
        held.setdefault(i, set()).add(s)
    assert all(held[i] & held[i + 2000] for i in range(2000))
    assert len(set(shard.tolist())) > 8


def test_fingerprint_is_the_majority_of_bits():
    h = simhash_dedup.shingle_hashes(b"a b c d e".split(), 3)
    bits = [sum(int(x) >> k & 1 for x in h) * 2 > len(h) for k in range(64)]
    assert simhash_dedup.fingerprint(h) == sum(1 << k for k, v in enumerate(bits) if v)
    assert simhash_dedup.fingerprint(simhash_dedup.shingle_hashes([], 3)) == 0
    assert len(simhash_dedup.shingle_hashes([b"one"], 3)) == 1


def test_bins_are_full_and_hold_everything():
    rng = random.Random(2)
    hist = {rng.randint(1, 600): rng.randint(1, 500) for _ in range(300)}
    plan = packing.plan_bins(hist)
    assert all(sum(b) <= 2048 for b, _ in plan)
    got: dict[int, int] = {}
    for b, n in plan:
        for x in b:
            got[x] = got.get(x, 0) + n
    assert got == hist
    assert sum(n for _, n in plan) <= -(-sum(k * v for k, v in hist.items()) // 2048) * 1.01 + 1


def test_smallest_is_replaced_by_two_that_fit_tighter():
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_words_encode_as_whole_texts_do():
    enc = packing.encoder(packing.default_tokenizer())
    texts = ["", "a", "Over and out.\nThe end", "two  blanks", " lead", "trail ", "tab\tand\r\nlines\n\n x", "l'été d'Ürs,  nbsp x1!!&&& don't z", "a.\n\nb c,.\nd", "ñ### 12.5%%% (x) 日本 語"]
    assert enc.encode(texts) == [enc.whole(t) if t else b"" for t in texts]


def test_flight_keeps_both_sums():
    rng = random.Random(4)
    size = [float(rng.randint(1, 900)) for _ in range(500)]
    p = mixing.flight([0.37] * 500, size, rng)
    left = [k for k in range(500) if 0 < p[k] < 1]
    assert len(left) <= 2
    assert sum(p) == pytest.approx(0.37 * 500, abs=1e-6)
    assert sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(0.37 * sum(size), rel=1e-9)
    assert set(mixing.landing(p, size, rng)) <= {0.0, 1.0}


def _log_gamma(x):
    import math

    return math.lgamma(x)


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.25, 50.0, 1e6])
    assert np.allclose(ctw.log_gamma(x), [_log_gamma(v) for v in x], rtol=1e-8, atol=1e-8)


def test_tree_probabilities_add_up_to_one():
    block = ctw.Block([ctw.coded(t) for t in (b"abab abba", b"x ab", b"zz zz")], [False] * 3)
    u, n, _ = block.grams(1)
    ctx = u[len(u) // 2] >> np.uint64(8)
    every = (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    rows = np.unique(np.concatenate([u, every]))
    counts = np.zeros(len(rows))
    counts[np.searchsorted(rows, u)] = n
    pred, _ = ctw.fit_tree(rows, counts, 0)
    p = np.prod(np.where(pred < 0, 0.5, pred), axis=1)[np.searchsorted(rows, every)]
    assert p.sum() == pytest.approx(1, abs=1e-9)


def test_one_context_node_is_the_half_half_mixture():
    n0, n1 = np.array([3.0]), np.array([1.0])
    kt = 0.5 * 1.5 * 2.5 * 0.5 / (1 * 2 * 3 * 4)
    assert np.exp(ctw.log_kt(n0, n1))[0] == pytest.approx(kt)


def test_toxic_sentence_is_found():
    model = {"words": {b"vile": 0}, "weights": np.array([14.0]), "leak": 0.02}
    s = toxicity.Scorer(model)
    score, at, worst = s.document(b"All is well. You are VILE! Bye.")
    assert score > 0.9 and at == 1 and worst > 0.9
    assert s.document(None) == (pytest.approx(0.02), -1, 0.0)
    assert s.document(b"clean. " * 3000)[0] < 0.2


def test_templates_are_their_own_family():
    import rowloom.llm.licenses as lc

    assert lc.cover("licensed under the apache license version 2.0".split(), "apache") == 1
    assert lc.paragraphs(b"\n\nOne\n \nTwo\r\n") == [b"one", b"two"]
    assert lc.features(["a", "license", "b"], {"license"}) == {"license", "a license", "license b", "a license b"}
    assert licenses.paragraphs(None) == []


def test_recordings_align_after_a_shift():
    rng = np.random.default_rng(8)
    a = chroma.tones(rng.normal(size=64))
    x, y = chroma.fingerprint(a), chroma.fingerprint(a[chroma.HOP * 10 :])
    assert (x[10 : 10 + len(y)] == y).mean() > 0.95
    other = chroma.fingerprint(chroma.tones(rng.normal(size=64)))
    assert np.bitwise_count(x ^ other).mean() / 32 > 0.25
    assert len(chroma.fingerprint(np.zeros(100))) == 0


def test_the_cube_keeps_each_inclusion_probability():
    """Over many draws each document is taken as often as its probability says, and both totals stay as near as one landing allows."""
    size, prob = [3.0, 50.0, 7.0, 7.0, 120.0, 33.0, 1.0, 18.0], [0.3, 0.62, 0.3, 0.9, 0.11, 0.5, 0.77, 0.45]
    draws, taken = 6_000, np.zeros(8)
    for seed in range(draws):
        rng = random.Random(seed)
        p = mixing.flight(prob, size, rng)
        assert sum(p) == pytest.approx(sum(prob), abs=1e-6) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(sum(a * b for a, b in zip(prob, size, strict=True)), abs=1e-6)
        out = mixing.landing(p, size, rng)
        assert abs(sum(out) - sum(prob)) < 2.0 and abs(sum(a * b for a, b in zip(out, size, strict=True)) - sum(a * b for a, b in zip(prob, size, strict=True))) <= max(size)
        taken += out
    error = np.sqrt(np.array(prob) * (1 - np.array(prob)) / draws)
    assert (np.abs(taken / draws - prob) < 5 * error).all(), taken / draws
