"""Merkle manifest of a dataset: a trie over exact ranks, with a proof for each row.

A row's leaf is the SHA-256 of its fields. Its rank in its source comes from digit histograms of
doc_id (`ranks.py`), so no source is sorted as a whole. The base-16 digits of a rank key the trie: rows
that share all but the last two digits form one block of 256 leaves at most, which is reduced by two
levels to one digest; blocks are the leaves of the next tier, until each source has one digest, its
subroot, and the subroots, ranked by source, have one, the root. On the way back each block hands
its children the siblings above them, from which a proof and a folded root are computed.

Nulls: a null field hashes as `-`; a null doc_id sorts as the least long; a null source is a source of its own, the
first. Rows of one doc_id follow each other by digest; rows that are equal in all five fields
have equal leaves and share out their places in any order. Texts are hashed whole whatever their length. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks

FANOUT_BITS, BLOCK_LEVELS = 4, 2
FANOUT, BLOCK_BITS = 1 << FANOUT_BITS, FANOUT_BITS * BLOCK_LEVELS
#: Blocks of one Arrow batch; a block is some 40 KB.
BATCH_BLOCKS = 256
#: Bytes of a source that make one key of its rank; with seven a key is never negative.
KEY_BYTES = 7


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n leaves until one node is left."""
    d = 0
    while n > 1:
        n, d = -(-n // FANOUT), d + 1
    return d


def reduced(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level of a block, leaves first."""
    out = [leaves]
    for _ in range(levels):
        out.append([_hash(out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after the leaf's ancestor in its run, level by level below the block's own digest."""
    out = []
    for nodes in levels[:-1]:
        run = at // FANOUT * FANOUT
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FANOUT])))
        at //= FANOUT
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = _hash([left, digest, right])
    return digest


_NODE = "tree long, rank long, size long, digest string"
_PATH = "tree long, rank long, path array<struct<left:string,right:string>>"


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """tree, block, size (leaves of the tree at this tier) and the block's items in order of rank; 256 at most."""
    block = F.shiftright("rank", BLOCK_BITS).alias("block")
    return nodes.groupBy("tree", block).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "digest", *more))).alias("items"))


def _batches(blocks: DataFrame) -> DataFrame:
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
    return blocks


def _up(blocks: DataFrame) -> DataFrame:
    """The blocks' digests as leaves of the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, block, size = (b.column(c).to_pylist() for c in ("tree", "block", "size"))
            found = [reduced([i["digest"] for i in items], min(BLOCK_LEVELS, depth(n)))[-1][0] for items, n in zip(b.column("items").to_pylist(), size, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(block, pa.int64()), pa.array([-(-n >> BLOCK_BITS) if n > 1 else 1 for n in size], pa.int64()), pa.array(found, pa.string())], ["tree", "rank", "size", "digest"])

    return _batches(blocks).mapInArrow(run, _NODE)


def _with_path(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.join(paths.select("tree", F.col("rank").alias("block"), "path"), ["tree", "block"])


def _down(blocks: DataFrame) -> DataFrame:
    """Blocks with their own `path` -> the path of each of their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for b in batches:
            rows = []
            for tree, n, items, above in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "items", "path")), strict=True):
                levels = reduced([i["digest"] for i in items], min(BLOCK_LEVELS, depth(n)))
                rows += [(tree, i["rank"], [{"left": x, "right": y} for x, y in siblings(levels, k)] + above) for k, i in enumerate(items)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["tree", "rank", "path"])

    return _batches(blocks).mapInArrow(run, _PATH)


def _proofs(blocks: DataFrame) -> DataFrame:
    """The last tier down: a row for each leaf."""
    out = "tree long, doc_id long, leaf string, proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tree, n, items, above in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "items", "path")), strict=True):
                levels = reduced([i["digest"] for i in items], min(BLOCK_LEVELS, depth(n)))
                over = [(p["left"], p["right"]) for p in above]
                tail = "".join(x + y for x, y in over)
                known: dict[str, str] = {}  # untampered leaves of a block fold through one block digest
                for k, i in enumerate(items):
                    own = siblings(levels, k)
                    top = fold(i["other"] or i["digest"], own)
                    if top not in known:
                        known[top] = fold(top, over)
                    rows.append((tree, i["doc_id"], i["digest"], _hash([*(x + y for x, y in own), tail]), known[top]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    return _batches(blocks).mapInArrow(run, out)


class Trie:
    """Tiers of blocks over nodes(tree, rank, size, digest); `tops` has one row a tree."""

    def __init__(self, nodes: DataFrame, name: str, *more: str):
        self.tiers: list[DataFrame] = []
        while True:
            blocks = common.materialize(_blocks(nodes, *more), f"{name}-blocks{len(self.tiers)}")
            self.tiers.append(blocks)
            nodes, more = common.materialize(_up(blocks), f"{name}-nodes{len(self.tiers)}"), ()
            if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
                break
        self.tops = nodes.select("tree", "digest")
        self.name = name

    def paths(self, tops: DataFrame, last: int) -> DataFrame:
        """From the paths (tree, rank 0, path) of the trees' tops down to those of the blocks of tier `last`; tier -1 gives the leaves' own."""
        for k in range(len(self.tiers) - 1, last, -1):
            tops = common.materialize(_down(_with_path(self.tiers[k], tops)), f"{self.name}-paths{k}")
        return tops


def _source_keys(longest: int) -> list[Column]:
    """Keys that order sources like their UTF-8 bytes, null first."""
    raw = F.col("source").cast("binary")
    out = [F.when(F.col("source").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")]
    for at in range(0, max(longest, 1), KEY_BYTES):
        part = F.rpad(F.hex(F.substring(raw, F.lit(at + 1), F.lit(KEY_BYTES))), 2 * KEY_BYTES, "0")
        out.append(F.coalesce(F.conv(part, 16, 10).cast("long"), F.lit(0)))
    return [*out, F.coalesce(F.octet_length("source"), F.lit(0)).cast("long")]


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text")]
    fields = docs.select(*cols)
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    fields = fields.withColumn("other_text", F.when(chosen, tampered_text(F.col("text"))))
    changed = chosen & ~F.col("text").eqNullSafe(F.col("other_text"))
    leaves = fields.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("skey"),
        F.unhex(leaf(*known, F.col("text"))).alias("leaf"), F.when(changed, F.unhex(leaf(*known, F.col("other_text")))).alias("other"),
        F.monotonically_increasing_id().alias("uid"),
    )
    leaves = common.materialize(leaves, "manifest-leaves")
    total = leaves.count()
    sources = leaves.groupBy("skey").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.when(F.col("skey") != "-", F.expr("substring(skey, 2)")))
    longest = sources.agg(F.max(F.octet_length("source"))).first()[0] or 0
    keys = _source_keys(longest)
    keyed = common.materialize(sources.select("skey", "n", F.lit(0).cast("long").alias("all"), *[k.alias(f"key{i}") for i, k in enumerate(keys)]), "manifest-sources")
    n_sources = keyed.count()
    trees = ranks.ranked(keyed, "all", [f"key{i}" for i in range(len(keys))], n_sources).select("skey", "n", F.col("rank").alias("tree"))
    trees = common.materialize(trees, "manifest-trees")

    rows = common.join_groups(leaves, trees, "skey", "n", total).drop("skey", "n")
    digest_key = F.conv(F.hex(F.substring("leaf", 1, KEY_BYTES)), 16, 10).cast("long")
    rows = rows.withColumns({"k0": F.coalesce("doc_id", F.lit(-(1 << 63))), "k1": digest_key})
    rows = common.materialize(rows, "manifest-rows")
    rows = ranks.ranked(rows, "tree", ["k0", "k1", "uid"], total)
    text = lambda c: F.lower(F.hex(c))
    nodes = rows.select("tree", "rank", F.col("group_size").alias("size"), text("leaf").alias("digest"), "doc_id", text("other").alias("other"))
    trie = Trie(nodes, "manifest-rows", "doc_id", "other")
    subroots = trie.tops.select("tree", F.col("digest").alias("subroot"))
    top = Trie(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(n_sources).cast("long").alias("size"), F.col("subroot").alias("digest")), "manifest-top")
    root = top.tops.first()
    empty = docs.sparkSession.createDataFrame([(0, 0, [])], _PATH)
    above = top.paths(empty, -1)  # a path for each subroot
    above = above.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "path")
    proofs = _proofs(_with_path(trie.tiers[0], trie.paths(above, 0)))
    named = common.materialize(trees.join(subroots, "tree").select("tree", "n", "subroot", F.when(F.col("skey") != "-", F.expr("substring(skey, 2)")).alias("source")), "manifest-subroots")
    out = common.join_groups(proofs, named, "tree", "n", total)
    root_digest = F.lit(root["digest"] if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", root_digest.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_digest).alias("verified"), "source")


def manifest_sql(row_levels: int = 6, source_levels: int = 4) -> str:
    """DuckDB SQL for the same rows, for up to 16 ** row_levels documents a source and 16 ** source_levels sources."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    whole = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> k) & 1 AS BIGINT))))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(a >> 1, 3988292384 * xor(a & 1, b))), 4294967295)"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = [
        f"d AS (SELECT *, doc_id IS NOT NULL AND {crc} % 5 = 0 AS chosen, {whole('text')} AS leaf FROM documents)",
        f"e AS (SELECT doc_id, source, leaf, CASE WHEN chosen THEN {whole(lower)} ELSE leaf END AS f0, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)",
        "r0 AS (SELECT source AS tree, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM e)",
    ]
    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"{name}r{k} AS (SELECT tree, idx // 16 AS up, any_value(n) AS n, list(digest ORDER BY idx) AS ds FROM {name}{k} GROUP BY tree, idx // 16)")
            steps.append(f"{name}s{k} AS (SELECT x.tree, x.idx, CASE WHEN x.n > 1 THEN array_to_string(ds[1 : x.idx % 16], '') ELSE '' END AS lft, CASE WHEN x.n > 1 THEN array_to_string(ds[x.idx % 16 + 2 :], '') ELSE '' END AS rgt, x.n FROM {name}{k} x JOIN {name}r{k} y ON x.tree IS NOT DISTINCT FROM y.tree AND x.idx // 16 = y.up)")
            steps.append(f"{name}{k + 1} AS (SELECT tree, up AS idx, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS digest, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM {name}r{k})")
    climb("r", row_levels)
    steps.append(f"q0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n, tree AS source FROM r{row_levels})")
    climb("q", source_levels)
    last = f"SELECT e.*, '' AS p0, q0.idx AS sidx, q0.digest AS subroot FROM e JOIN q0 ON e.source IS NOT DISTINCT FROM q0.source"
    steps.append(f"w0 AS ({last})")
    for k in range(row_levels + source_levels):
        name, j, at = ("r", k, "w.idx") if k < row_levels else ("q", k - row_levels, "w.sidx")
        same = "s.tree IS NOT DISTINCT FROM w.source AND " if name == "r" else ""
        steps.append(f"w{k + 1} AS (SELECT w.* EXCLUDE (f0, p0), CASE WHEN s.n > 1 THEN sha256(s.lft || w.f0 || s.rgt) ELSE w.f0 END AS f0, w.p0 || s.lft || s.rgt AS p0 FROM w{k} w JOIN {name}s{j} s ON {same}s.idx = {at} // {16 ** j})")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, digest AS root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = digest AS verified, source FROM w{row_levels + source_levels}, (SELECT digest FROM q{source_levels})"
