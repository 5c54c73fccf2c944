"""The Merkle manifest against its definition in plain Python and, on a whole table, against SQL."""

import hashlib
import random
import zlib

import pytest

from rowloom.llm import manifest, ranks
from rowloom.llm.common import documents
from tests.oracle import differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return _h(*map(_field, (r[0], r[3], r[2], r[4], text)))


def _reduce(nodes):
    """(last node, for each leaf its ancestors' runs from below as (before, after))."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
        nodes = [_h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, held = [], []
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        sub, paths = _reduce([_leaf(r, r[1]) for r in mine])
        subs.append(sub)
        held.append((mine, paths))
    root, above = _reduce(subs)
    out = []
    for (mine, paths), sub, over in zip(held, subs, above, strict=True):
        for r, own in zip(mine, paths, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = _leaf(r, text)
            for a, b in own + over:
                x = _h(a, x, b)
            out.append((r[0], _leaf(r, r[1]), sub, root, _h(*(a + b for a, b in own + over)), x, x == root))
    return sorted(out, key=repr)


def _got(spark, rows):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).select(cols).collect()), key=repr)


def _rows(seed, n, sources):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ünïcode A-Z", "lower", "Some WORDS " * rng.randint(1, 5)])
    return [(rng.choice([None, rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 400)]), text(), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 3, -7])) for _ in range(n)]


def test_equals_the_definition(spark):
    sources = [None, "", "a", "a\0", "ab", "é", "zz", "source with a long name", "source with a long nama", "😀"]
    rows = _rows(1, 900, sources + ["hot"] * 12)
    rows += rows[:40] + [(5, "same", "en", "hot", 1)] * 50
    assert _got(spark, rows) == expected(rows)


def test_many_sources_and_one_row_each(spark):
    rows = [(k, "T", None, f"s{k}", 1) for k in range(300)] + [(None, None, None, None, None)]
    assert _got(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, n):
    rows = [(k - 3, f"Text {k}", "en", "only", k) for k in range(n)]
    assert _got(spark, rows) == expected(rows)


def test_clustered_keys_and_ties_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 8)
    monkeypatch.setattr(ranks, "DIGIT_BITS", 2)
    rows = [(k, f"T{k}", "en", "a", k) for k in range(300)] + [(2**62 + k % 7, f"T{k}", "en", "a", k) for k in range(200)]
    rows += [(7, "Same", "en", "a", 1)] * 150 + [(None, "X", "en", "a", 1)] * 60 + [(k * 10**15, "y", "en", "b", 1) for k in range(200)]
    assert _got(spark, rows) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = _rows(4, 30, ["a", None])
    more = [r + (1, "x", 2, "y") for r in rows]
    df = spark.createDataFrame(more, SCHEMA + ", leaf int, tree string, rank long, uid string")
    assert sorted(r["leaf"] for r in manifest.manifest(df).collect()) == sorted(r[1] for r in expected(rows))


def test_very_long_text(spark):
    rows = [(0, "A very LONG text " * 200_000, "en", "a", 1), (1, None, None, "a", None)]
    assert _got(spark, rows) == expected(rows)


def test_whole_table_equals_sql(spark, folder):
    assert differences(manifest.manifest(documents(spark, folder)), folder, manifest.manifest_sql()) == []


def test_running_sums_by_digits(spark):
    rng = random.Random(3)
    counts = {(g, at): rng.randint(1, 9) for g in "ab" for at in rng.sample(range(5000), 120)}
    df = spark.createDataFrame([(g, at, n) for (g, at), n in counts.items()], "g string, at long, n long")
    for r in ranks.before(df, ["g"], "at", bits=3).collect():
        assert r["before"] == sum(n for (g, at), n in counts.items() if g == r["g"] and at < r["at"])
