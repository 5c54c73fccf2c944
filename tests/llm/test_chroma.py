"""Matches of fingerprints, against every pair at every offset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import chroma


def brute_force(ints: dict[int, list[int]]) -> dict[int, tuple]:
    out = {}
    for q, a in ints.items():
        if q % chroma.QUERY_EVERY:
            continue
        found = []
        for k, b in ints.items():
            best = None
            for o in sorted(range(1 - len(a), len(b)), key=lambda o: (abs(o), -o)):
                x, y = a[max(-o, 0) :], b[max(o, 0) :]
                n = min(len(x), len(y))
                if n and n >= chroma.LEAST_SHARE * min(len(a), len(b)):
                    e = sum(((s ^ t) & 0xFFFFFFFF).bit_count() for s, t in zip(x, y, strict=False)) / (32.0 * n)
                    best = min(best or (9.0, 0), (e, o), key=lambda z: z[0])
            if k != q and best and best[0] <= chroma.MOST_ERRORS:
                found.append((best[0], k, best[1]))
        out[q] = (len(found), *(min(found) if found else (None, None, None)))
    return out


@pytest.mark.parametrize("block", [32_000, 300])
def test_noisy_and_short_copies_match_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chroma, "BLOCK_INTS", block, raising=False)
    rng = np.random.default_rng(6)
    ints: dict[int, list[int]] = {}
    for k, (length, errors) in enumerate([(76, 0.05), (76, 0.1), (76, 0.15), (76, 0.2), (12, 0.1), (5, 0.1), (1, 0.1), (400, 0.2), (0, 0.0)]):
        x = rng.integers(-(2**31), 2**31, length).astype(np.int32)
        flips = np.packbits(rng.random((length, 32)) < errors, axis=1).view(np.int32).ravel()
        ints[50 * k], ints[50 * k + 1] = x.tolist(), (x ^ flips)[length // 6 :].tolist()
    media = spark.createDataFrame(list(ints.items()), "media_id long, ints array<int>")
    monkeypatch.setattr(chroma, "fingerprints", lambda m: m.withColumn("digest", F.sha2(F.array_join(F.transform("ints", F.hex), ","), 256)))
    got = {r["media_id"]: (r["n_matches"], r["bit_errors"], r["best_class"], r["frame_offset"]) for r in chroma.match(media).collect()}
    want = brute_force(ints)
    assert all(want[50 * k][0] and want[50 * k][2] == 50 * k + 1 for k in (0, 1, 2, 3, 4, 7))
    assert {q: got[q] for q in want} == want
