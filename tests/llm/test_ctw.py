"""Context-tree weighting against brute force: every node a dictionary entry, by the definition."""

import math
import random
import zlib

import pytest

from rowloom.llm import ctw

D = ctw.DEPTH


def symbols(text):
    data = b" " * D + b"".join(w + b" " for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()) + b"\n"
    return [(data[i - D : i][::-1], data[i]) for i in range(D, len(data))]


def brute(rows):
    counts: dict = {}
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    for k, t in rows:
        for before, byte in symbols(t) if not held[k] else ():
            for j in range(8):
                for d in range(D + 1):
                    n = counts.setdefault((before[:d], j, byte >> (8 - j)), [0, 0])
                    n[byte >> (7 - j) & 1] += 1
    weighted: dict = {}
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    children: dict = {}
    for c, j, b in counts:
        if c:
            children.setdefault((c[:-1], j, b), []).append((c, j, b))
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[node])
        below = sum(weighted[x] for x in children.get(node, ()))
        weighted[node] = own if len(node[0]) == D else math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
    out = []
    for _, t in rows:
        total = 0.0
        for before, byte in symbols(t):
            for j in range(8):
                p = None
                for d in range(D, -1, -1):
                    node = (before[:d], j, byte >> (8 - j))
                    n = counts.get(node)
                    if n is None:
                        continue
                    own = (n[byte >> (7 - j) & 1] + 0.5) / (sum(n) + 1)
                    share = 1.0 if p is None or d == D else math.exp(math.log(0.5) + kt(n) - weighted[node])
                    p = own if p is None else share * own + (1 - share) * p
                total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


@pytest.mark.parametrize("small", [False, True])  # one block and part, several
def test_scores_equal_the_definition(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ctw, "PART_BYTES", 300)
    rng = random.Random(9)
    words = ["the", "Then", "there", "a", "abba", "über", "日本", "12", "x-y"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(40)] + [(None, "the null id"), (50, None), (51, " \t\n"), (52, "zebra quilt"), (52, "zebra quilt")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, part int").repartition(3)
    got = sorted(((r["doc_id"], r["score"]) for r in ctw.lm_scores(docs).collect()), key=str)
    want = sorted(((k, s) for (k, _), s in zip(rows, brute(rows), strict=True)), key=str)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(abs(a - b) <= 1e-5 for (_, a), (_, b) in zip(got, want, strict=True)), list(zip(got, want, strict=True))


def test_base_scores_and_counts_on_a_whole_table(spark, folder):
    from collections import Counter

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: [*bytes(c + 32 if 65 <= c <= 90 else c for c in (r["text"] or "").encode()).split(), None] for r in docs.select("doc_id", "text").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    train = Counter(w for k, ws in rows.items() if not held[k] for w in ws)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in ctw.lm_scores(docs).collect()}
    assert got.keys() == rows.keys()
    for k, ws in rows.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def test_better_than_the_base_on_held_out_rows(spark):
    got = [r for r in ctw.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()]
    tokens = sum(r["n_tokens"] for r in got)
    score, base = (sum(r[c] for r in got) / tokens for c in ("score", "base_score"))
    print("log10 a token", score, base)
    assert score > base + 0.08
