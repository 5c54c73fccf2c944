"""Near copies by similarity of word shingles: vantage-point trees over short fingerprints propose, wide SimHash fingerprints sift, the shingles decide.

A text has BANDS short fingerprints, each of BITS bits of the least hash under ROWS reorderings of its distinct shingles'
hashes (b-bit minwise hashing). op5's vantage-point tree search (`simhash_dedup.links`) finds, band by band, all that differ in
TREE_RADIUS bits at most; only texts that it ties in one shard meet in a bucket. At a similarity of 0.8 a least hash
is shared with probability 0.8: a band's fingerprints are equal for 41% of the pairs and within two bits for another 2%,
so all but one pair in 8500 meet (one in 4500 by equal ones alone). Similarity above 0.8 is missed less still.

At 0.8 two SimHash fingerprints differ in 15% of their bits on average, so a short
one at a small radius misses such pairs, and no Hamming ball that wide lets a vantage point part unrelated ones (of 512 bits
they stand 256 apart, give or take 11). They only sift inside a bucket: a wide fingerprint has eight words of 64 bits, made of the
distinct shingles' hashes. Differing bits estimate a similarity to about 0.04, too little to decide by: up to
LINK_RADIUS differing bits of 512 (the mean at 0.8 and nearly five standard deviations) two texts are compared by the
share of shingles that they have in common, counted over their 32-bit hashes, and link from SIMILARITY on.

Buckets with the same members count once. Only members of shared buckets carry their shingles on. Inside a bucket vantage points do
prune, as its members are mostly alike: what is similar to the point is one component, and of the rest only
texts within twice the distance (1 - similarity, a metric) can link to it, by the triangle bound. Buckets
beyond TILE_POINTS are split by the same rule over tasks: members similar to the bucket's vantage point
never meet each other, only the others. No bucket is capped.

Nulls: a null text is empty; texts without words link with each other. Fewer words than a shingle
are one shingle. Rows with a null id take a component but never name one. Repeated rows, and other texts with one
fingerprint and number of shingles, are one class. Very long texts are hashed whole. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash_dedup
from .components import components
from .simhash_dedup import shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 8
#: Differing bits (mean 77 and 118, deviation 9) beyond which texts are not compared: for a link, for being within twice its distance.
LINK_RADIUS, EDGE_RADIUS = 120, 160
#: Texts of fewer shingles are compared whatever their fingerprints: so few hashes make rough ones.
FEW = 20
#: Short fingerprints of a text, least hashes that make one, and bits of each: 40 in all, so that of a billion unrelated texts few come near one.
BANDS, ROWS, BITS = 16, 4, 10
#: Differing bits up to which the trees tie short fingerprints of one band.
TREE_RADIUS = 2
#: Rows of one number that may be broadcast (some 64 MB).
ONE_LONG_ROWS = 2_000_000
#: Rows of one tile, about; larger buckets are split.
TILE_POINTS = 6_000


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Words of bits set in over half of what each distinct hash is mixed to."""
    out = np.zeros(WORDS, np.uint64)
    if not len(hashes):
        return out
    for k in range(WORDS):
        ones = np.zeros(64, np.int64)
        for s in range(0, len(hashes), 8192):
            x = mixed(hashes[s : s + 8192] + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: its number above its fingerprint, BITS bits of the least of each of ROWS reorderings of the hashes. No hashes: no keys."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[s : s + 4096, None] * MULTIPLIERS[None, :]).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = key << np.uint64(BITS) | mixed(least[r::ROWS]) >> np.uint64(64 - BITS)
    return key


#: Odd numbers, so that multiplying reorders all hashes.
MULTIPLIERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def packed(hashes: np.ndarray) -> bytes:
    """Sorted distinct 32-bit hashes as differences, which compress."""
    return np.diff(np.unique((hashes >> np.uint64(32)).astype(np.uint32)), prepend=np.uint32(0)).astype("<u4").tobytes()


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the number of distinct shingles and the words, keys (of the bands), shingles (packed hashes)."""
    common.small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys, sets = [], [], []
            for t in b.column("text").to_pylist():
                hashes = np.unique(shingle_hashes((t or b"").lower().split(), shingle))
                fps.append(np.uint32(len(hashes)).astype("<u4").tobytes() + wide_fingerprint(hashes).astype("<u8").tobytes())
                keys.append(band_keys(hashes).view(np.int64))
                sets.append(packed(hashes))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "fp", "keys", "shingles"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(hashed, "doc_id long, fp binary, keys array<long>, shingles binary")


class Texts:
    """Fingerprints and shingles of texts, by number."""

    def __init__(self, fps: list[bytes], shingles: list[bytes]):
        raw = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 4 + 8 * WORDS)
        self.sizes = raw[:, :4].copy().view("<u4").ravel().astype(np.int64)
        self.words = raw[:, 4:].copy().view("<u8")
        self.sets = [np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint32) for x in shingles]

    def near(self, i: int, others: np.ndarray, radius: int, similarity: float) -> np.ndarray:
        """Which others may be as similar to i, by sizes and fingerprints."""
        low, high = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        bits = np.bitwise_count(self.words[others] ^ self.words[i]).sum(1, dtype=np.int64)
        return (low >= similarity * high) & ((bits <= radius) | (low < FEW))

    def similarity(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shared shingles over all shingles of i and each other."""
        own = self.sets[i]
        if not len(others):
            return np.zeros(0)
        n = np.array([len(self.sets[k]) for k in others], np.int64)
        if not len(own):
            return (n == 0).astype(float)
        every = np.concatenate([self.sets[k] for k in others])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        upto = np.concatenate([[0], np.cumsum(own[at] == every)])
        ends = np.cumsum(n)
        both = upto[ends] - upto[ends - n]
        return both / np.maximum(n + len(own) - both, 1)


def linked_blocks(texts: Texts, members: np.ndarray, similarity: float, step: int = 64):
    """Yield (i, j) of links that have the components of all linked pairs of the members, block by block."""
    todo = members
    loose = max(0.0, 2 * similarity - 1)  # similarity at twice the distance
    while len(todo) > 1:
        p, rest = todo[0], todo[1:]
        some = rest[texts.near(p, rest, EDGE_RADIUS, loose)]
        s = texts.similarity(p, some)
        ball, edge = some[s >= similarity], some[(s < similarity) & (s >= loose)]
        if len(ball):
            yield np.full(len(ball), p), ball
        for x in edge if len(ball) else ():
            y = ball[texts.near(x, ball, LINK_RADIUS, similarity)]
            for t in range(0, len(y), step):  # one link ties x to the whole ball
                hit = y[t : t + step][texts.similarity(x, y[t : t + step]) >= similarity]
                if len(hit):
                    yield np.array([x]), hit[:1]
                    break
        todo = rest[~np.isin(rest, ball)]


def _tile_edges(table: pa.Table, similarity: float) -> pa.Table:
    """a, b from key, rep, fp, shingles: a spanning forest of the links of each key's texts."""
    key, rep = table["key"].to_numpy(), table["rep"].to_numpy()
    _, first, text = np.unique(rep, return_index=True, return_inverse=True)  # a text may stand in several buckets
    texts = Texts(table["fp"].take(first).to_pylist(), table["shingles"].take(first).to_pylist())
    order = np.lexsort((rep, key))
    key, rep, text = key[order], rep[order], text[order]
    start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
    out, names = [np.zeros((0, 2), np.int64)], rep[np.argsort(text, kind="stable")[np.searchsorted(np.sort(text), np.arange(len(first)))]]
    for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        for i, j in linked_blocks(texts, text[s:e], similarity):
            out.append(np.sort(np.stack([names[i], names[j]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def meetings(nodes: DataFrame, radius: int = TREE_RADIUS) -> DataFrame:
    """nodes(rep, keys), rep distinct -> rep, key, a row once: texts that have a band's fingerprints within the radius share a key.

    A key is the least band key of what a vantage-point tree ties in one shard. Equal fingerprints are one point of the
    tree, so many copies do not fill a shard; a point that has no other near it is a key by itself where several texts have it.
    """
    posts = nodes.select("rep", F.explode("keys").alias("point"))
    points = common.materialize(posts.groupBy("point").agg(F.count(F.lit(1)).alias("n")), "similar-points")
    bits = ROWS * BITS
    tree = points.select(F.shiftright("point", bits).alias("band"), F.col("point").bitwiseAND((1 << bits) - 1).alias("fp"), F.col("point").alias("rep"))
    tied = simhash_dedup.links(tree, nodes.count(), radius, ("band",)).select(F.explode(F.array("a", "b")).alias("point"), F.col("a").alias("key"), F.lit(1).cast("long").alias("n"))
    alone = points.where("n > 1").select("point", F.lit(None).cast("long").alias("key"), "n")
    met = tied.unionByName(alone).groupBy("point").agg(F.max("n").alias("n"), F.collect_set("key").alias("keys"))
    met = common.materialize(met.select("point", "n", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array("point")).alias("keys")), "similar-met")
    many = met.count()
    if many <= common.BROADCAST_ROWS:
        posts = posts.join(F.broadcast(met), "point")
    else:
        posts = common.join_groups(posts, met, "point", "n", points.agg(F.sum("n")).first()[0])
    return posts.select("rep", F.explode("keys").alias("key"))


def links(nodes: DataFrame, fps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """nodes(fp, rep, keys), fp and rep distinct, fps(uid, shingles) with a row for each rep -> a, b: edges between reps that have the components of all links of texts that share one of `meetings`."""
    most, edges = TILE_POINTS, "a long, b long"
    posts = common.materialize(meetings(nodes), "similar-posts")
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    # buckets with the same members are one
    shared = common.materialize(shared.groupBy("n", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "pivot"), "similar-keys")
    rows, total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > most, F.col("n"))), F.lit(0))).first()
    posts = common.materialize(common.join_groups(posts, shared, "key", "n", rows).where("n > 1"), "similar-members")
    needed = common.materialize(posts.select("rep").distinct(), "similar-needed")
    needed = common.broadcast_if_small(needed, needed.count(), ONE_LONG_ROWS)
    needed = common.materialize(fps.select(F.col("uid").alias("rep"), "fp", "shingles").join(needed, "rep"), "similar-texts")
    held = posts.join(needed, "rep")

    def forest(table: pa.Table) -> pa.Table:
        return _tile_edges(table, similarity)

    tile = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // most))))
    out = held.where(F.col("n") <= most).select(tile.alias("tile"), "key", "rep", "fp", "shingles").groupBy("tile").applyInArrow(forest, edges)
    if not total:
        return out

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            texts = Texts([*b.column("fp").to_pylist(), *b.column("pivot_fp").to_pylist()], [*b.column("shingles").to_pylist(), *b.column("pivot_shingles").to_pylist()])
            ball = [bool(texts.similarity(n + k, np.array([k]))[0] >= similarity) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(ball, pa.bool_())], [*names, "ball"])

    names = ["key", "rep", "fp", "shingles", "pivot"]
    hot = held.where(F.col("n") > most)
    pivots = hot.where("rep = pivot").select("key", "n", F.col("fp").alias("pivot_fp"), F.col("shingles").alias("pivot_shingles"))
    pivots = common.materialize(pivots, "similar-pivots")  # one row for each TILE_POINTS rows at most
    hot = common.join_groups(hot.drop("n"), pivots, "key", "n", rows).select(*names, "pivot_fp", "pivot_shingles")
    hot = common.materialize(hot.mapInArrow(flag, "key long, rep long, fp binary, shingles binary, pivot long, ball boolean"), "similar-hot")
    parts = lambda c: F.ceil(F.count_if(c) / most).cast("int")
    per = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts(F.col("ball")).alias("balls"), parts(~F.col("ball")).alias("others"))
    near = hot.where("ball and rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    hot = common.join_groups(hot, common.materialize(per, "similar-parts"), "key", "n", rows).where("others > 0")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    mixed_tiles = F.when(F.col("ball"), F.transform(upto("others"), lambda j: F.struct(F.lit(0).alias("kind"), own("balls").alias("i"), j.alias("j"))))
    mixed_tiles = mixed_tiles.otherwise(
        F.concat(
            F.transform(upto("balls"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), own("others").alias("j"))),
            F.transform(upto("others"), lambda j: F.struct(F.lit(1).alias("kind"), F.least(j, own("others")).alias("i"), F.greatest(j, own("others")).alias("j"))),
        )
    )
    dealt = hot.select("key", "rep", "fp", "shingles", F.explode(mixed_tiles).alias("t")).select("key", "rep", "fp", "shingles", "t.*")
    return out.unionByName(near).unionByName(dealt.groupBy("key", "kind", "i", "j").applyInArrow(forest, edges))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **cols: str) -> DataFrame:
    """doc_id, component_id (the least id that can be reached): one row per input row."""
    fps = common.materialize(wide_fingerprints(docs, shingle, **cols).withColumn("uid", F.monotonically_increasing_id()), "similar-fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("uid").alias("rep"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
    nodes = common.materialize(nodes, "similar-nodes")
    count, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = components(links(nodes, fps, similarity))
    named = nodes.select("fp", "n", "least", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = common.materialize(named, "similar-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("texts"))
    named = common.join_groups(named, common.materialize(least, "similar-least"), "component", "texts", count)
    keyed = fps.select("doc_id", F.xxhash64("fp").alias("key"), "fp")
    out = common.join_groups(keyed, named.select(F.xxhash64("fp").alias("key"), F.col("fp").alias("own"), "n", "component_id"), "key", "n", total).where("fp = own")
    return out.select("doc_id", "component_id")
