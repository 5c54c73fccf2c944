"""SimHash near-duplicates found through vantage-point trees.

Python workers make the fingerprints. Distinct fingerprints, each with its least id, are dealt out
by a vantage-point tree; every shard links its fingerprints within the radius and returns one edge
a fingerprint at most (a spanning forest has all components). Components over shards are found by
star contraction in DataFrames. Fingerprints with a large share of the rows are joined apart.

Nulls: a null text is empty and has fingerprint zero, linked like any other; a row with a null id
takes its fingerprint's component but never names one. Repeated rows share a fingerprint. Ties (bits set in
just half the shingles) are 0. Very long texts are hashed whole. Other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vptree
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of one shard.
SHARD_POINTS = 40_000


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    each = zip(*[words[i:] for i in range(k)], strict=False)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), seed) for s in each), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 8192):
        part = hashes[s : s + 8192].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    common.small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes((t or b"").lower().split(), shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(hashed, "doc_id long, fp long")


def links(nodes: DataFrame, total: int, radius: int = RADIUS, within: tuple[str, ...] = ()) -> DataFrame:
    """nodes(fp, rep) with distinct fp and rep -> a, b: edges between reps, a < b, that have the components of all links within the radius.

    Nodes link only where the columns `within` agree; fp need only be distinct there, and total is the number of nodes there.
    A shard's edges are stars: of what hangs together in it, one node is the a of all others.
    """
    depth = min(vptree.MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / SHARD_POINTS)))))
    most = vptree.SAMPLE_PER_LEAF << depth
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(most).toArrow() if depth else None  # 32 MB at most
    tree = vptree.packed(vptree.build(sample["fp"].to_numpy().view(np.uint64) if depth else np.zeros(0, np.uint64), depth))
    shared = nodes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, idx = vptree.route(shared.value, b.column("fp").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[b.column(c).take(pa.array(idx)) for c in names]], ["shard", *names])

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        rep, fp = table["rep"].to_numpy()[order], table["fp"].to_numpy()[order].view(np.uint64)
        root = vptree.forest(fp, radius)
        b = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": rep[root[b]], "b": rep[b]})

    names = [*within, "fp", "rep"]
    dealt = nodes.select(*[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(deal, ", ".join(f"{c} long" for c in ["shard", *names]))
    return dealt.groupBy("shard", *within).applyInArrow(join, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **cols: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id that can be reached): one row per input row."""
    fps = common.materialize(fingerprints(docs, shingle, **cols), "simhash-fps")
    # a fingerprint that only rows without an id have still needs a name: above all ids
    nameless = F.lit(1 << 62) + F.abs(F.xxhash64("fp") % (1 << 61))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = common.materialize(nodes.withColumn("rep", F.coalesce("least", nameless)), "simhash-nodes")
    counts = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = components(links(nodes, counts[0], radius))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = common.join_groups(fps, named, "fp", "n", counts[1] or 0)
    component = F.when(F.col("component_id") < (1 << 62), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
