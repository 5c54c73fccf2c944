"""Language-model scores by context-tree weighting over bytes.

Texts are tokens: words, then one end. A text is coded as its words' bytes with a space after each,
then a line feed. The contexts of a byte are the up to DEPTH bytes before it, whatever words they belong to; before
a text stand spaces. Each byte is eight binary decisions, and every pair of context and decided bits is a node with
Krichevsky-Trofimov counts. A node's weighted probability is half its own estimate and half the product of its
children's, so that all depths are mixed; the posterior share of the two parts predicts the next bit. A child that
training never saw leaves its share to the parent.

How it runs: each task turns its texts into blocks. A block sends its distinct words and its distinct grams (a context
and the byte after it) with their training counts, cut into parts by hash and packed, so that they are counted over all blocks:
the tables grow with the corpus. Words give the unigram base. A part has all grams whose last TOP bytes of context are
the same, so its tree is fitted down from there on its own; nodes nearer the root meet by their two bytes in one
aggregate, and are few (65,536 pairs of bytes at most). Each part then answers every block with the log probabilities of
its grams, in the order in which it got them, and the block's texts are summed up.

Nulls: a null text is empty, so it is the end alone; a row with a null id is not held out. Repeated rows count as often
as they occur. Very long texts are scored whole, in a block of their own if need be. Other columns are ignored,
whatever their names. Without training rows all nodes are unseen and each bit costs one bit. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context, and those of them that decide the part.
DEPTH, TOP = 5, 3
PAD = b" " * 8
#: Text of one block, of what is looked at at once, and of the table for each part of it.
BLOCK_BYTES, CHUNK_BYTES, PART_BYTES = 14 << 20, 1 << 20, 96 << 20
HALF = np.log(0.5)
#: Kinds of rows: a block's texts, words and grams; answers to words and grams; how many words there are.
TEXTS, WORDS, GRAMS, OF_WORDS, OF_GRAMS, TOTALS = range(6)
PACKED = "kind int, part int, block long, data binary, more binary, v long, n long"


# packed columns ----------------------------------------------------------------------------------


def squeezed(values: np.ndarray) -> bytes:
    """An array as planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def opened(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _row(kind: int, part: int, block: int, data: bytes, more: bytes = b"", v: int = 0, n: int = 0) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, part, block, data, more, v, n), types, strict=True)], ["kind", "part", "block", "data", "more", "v", "n"])


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows) if rows else pa.Table.from_batches([_row(0, 0, 0, b"")]).slice(0, 0)


# blocks of texts ---------------------------------------------------------------------------------


def coded(text: bytes | None) -> bytes:
    return b"".join(w + b" " for w in (text or b"").lower().split()) + b"\n"


class Block:
    """Coded texts of a block, with PAD before each."""

    def __init__(self, texts: list[bytes], held: list[bool]):
        self.texts, self.held = texts, np.array(held, bool)
        self.data = b"".join(x for t in texts for x in (PAD, t))
        self.starts = np.cumsum([0, *[len(PAD) + len(t) for t in texts]])

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, texts) of the coded bytes, some at a time. A key has the byte before in its highest bits, then the one before that, ..., and the coded byte last."""
        for s in range(0, len(self.data), CHUNK_BYTES):
            e = min(len(self.data), s + CHUNK_BYTES)
            cuts = np.clip(self.starts, s, e)
            text = np.repeat(np.arange(len(self.texts)), np.diff(cuts))
            at = np.arange(s, e)
            real = at - self.starts[text] >= len(PAD)
            at, text = at[real], text[real]
            window = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))[at - 7]
            before = (window << np.uint64(8)) >> np.uint64(64 - 8 * DEPTH)
            yield (before << np.uint64(8)) | (window >> np.uint64(56)), text

    def grams(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys by part, training counts of each, first place of each part."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for key, text in self.chunks():
            both = (key << np.uint64(1)) | self.held[text]
            both.sort()
            first = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0] if len(both) else np.zeros(0, int)
            n, u = np.diff(np.append(first, len(both))), both[first]
            keys.append(u >> np.uint64(1))
            counts.append(np.where(u & np.uint64(1), 0, n))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        part = part_of(key, parts)
        order = np.argsort(part, kind="stable")
        return key[order], n[order], np.searchsorted(part[order], np.arange(parts + 1))

    def words(self, parts: int) -> tuple[dict[bytes, int], np.ndarray]:
        """Distinct words by number, and the part of each."""
        known = dict.fromkeys(chain.from_iterable(map(bytes.split, self.texts)))
        known.update(zip(known, range(len(known)), strict=True))
        return known, np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % parts


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """By a hash of the last TOP bytes of the context."""
    top = keys >> np.uint64(8 * (DEPTH - TOP + 1))
    return ((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of kind TEXTS (an Arrow stream of doc_id, held_out, text), WORDS and GRAMS: one of each of the latter a block and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in batches:
            for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(d)
                held.append(h)
                texts.append(coded(t))
                size += len(texts[-1])
                if size > BLOCK_BYTES:
                    yield from _sent((task << 24) + seq, ids, held, texts, parts)
                    seq, held, ids, texts, size = seq + 1, [], [], [], 0
        if texts:
            yield from _sent((task << 24) + seq, ids, held, texts, parts)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id", 7, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(run, PACKED)


def _sent(number: int, ids: list, held: list[bool], texts: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    sink = pa.BufferOutputStream()
    rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts, pa.large_binary())], ["doc_id", "held_out", "text"])
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    yield _row(TEXTS, -1, number, zstandard.compress(sink.getvalue().to_pybytes(), 3))
    block = Block(texts, held)
    keys, counts, cuts = block.grams(parts)
    for k in np.nonzero(np.diff(cuts))[0].tolist():
        own = slice(cuts[k], cuts[k + 1])
        yield _row(GRAMS, k, number, squeezed(np.diff(keys[own], prepend=np.uint64(0))), squeezed(counts[own]))
    known, part = block.words(parts)
    own = chain.from_iterable(t.split() for t, h in zip(texts, held, strict=True) if not h)
    train = np.bincount(np.fromiter(map(known.__getitem__, own), np.int64), minlength=len(known))
    names = list(known)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.nonzero(np.diff(cuts))[0].tolist():
        own = order[cuts[k] : cuts[k + 1]]
        yield _row(WORDS, k, number, zstandard.compress(b"\n".join([names[i] for i in own.tolist()]), 1), squeezed(train[own]))


# words -------------------------------------------------------------------------------------------


def _count_words(table: pa.Table) -> pa.Table:
    """Training counts of a part's words over all blocks, back to each block; and the part's number of trained words and tokens."""
    words = [zstandard.decompress(x).split(b"\n") for x in table["data"].to_pylist()]
    train = np.concatenate([opened(x, "<i8") for x in table["more"].to_pylist()])
    coded_words = pa.chunked_array([pa.array(w, pa.binary()) for w in words]).combine_chunks().dictionary_encode()
    code = coded_words.indices.to_numpy()
    c = np.bincount(code, train, len(coded_words.dictionary)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    part = table["part"][0].as_py()
    rows = [_row(OF_WORDS, part, b, squeezed(c[code[e - len(w) : e]])) for b, w, e in zip(table["block"].to_pylist(), words, ends.tolist(), strict=True)]
    return _table([*rows, _row(TOTALS, part, -1, b"", v=int((c > 0).sum()), n=int(train.sum()))])


# the weighted tree -------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):  # the series is exact enough from 8 on
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


class Level:
    """Nodes of one depth: rows are distinct (context, byte), sorted; for bit j, node[j] is the node of each row."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.node, self.first, self.n0, self.n1, self.log_w, self.share = rows, [], [], [], [], [], []
        for j in range(8):
            prefix = rows >> np.uint64(8 - j)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            self.node.append(np.cumsum(new) - 1)
            self.first.append(np.nonzero(new)[0])
            one = (rows >> np.uint64(7 - j)) & np.uint64(1) == 1
            self.n1.append(np.add.reduceat(np.where(one, counts, 0), self.first[j]).astype(float))
            self.n0.append(np.add.reduceat(np.where(one, 0, counts), self.first[j]).astype(float))

    def own(self, j: int) -> np.ndarray:
        """Predicted probability of each row's own bit."""
        one = (self.rows >> np.uint64(7 - j)) & np.uint64(1) == 1
        n0, n1 = self.n0[j][self.node[j]], self.n1[j][self.node[j]]
        return (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)

    def weigh(self, j: int, children: np.ndarray | None) -> None:
        kt = log_kt(self.n0[j], self.n1[j])
        w = kt if children is None else np.logaddexp(HALF + kt, HALF + children)
        self.log_w.append(w)
        self.share.append(np.ones_like(kt) if children is None else np.exp(HALF + kt - w))


def _coarser(rows: np.ndarray) -> np.ndarray:
    return (rows >> np.uint64(16) << np.uint64(8)) | (rows & np.uint64(255))


def fit_tree(keys: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, Level]:
    """For sorted distinct keys: predicted probabilities of each row's 8 bits as seen from depth `top`, and that level. -1: training has nothing there."""
    levels = {DEPTH: Level(keys, counts)}
    ups = {}
    for d in range(DEPTH - 1, top - 1, -1):
        rows, up = np.unique(_coarser(levels[d + 1].rows), return_inverse=True)
        ups[d] = up
        below = levels[d + 1]
        n = np.bincount(up, np.asarray(_row_counts(below)), len(rows))
        levels[d] = Level(rows, n)
    for d in range(DEPTH, top - 1, -1):
        for j in range(8):
            if d == DEPTH:
                levels[d].weigh(j, None)
            else:
                below = levels[d + 1]
                parent = levels[d].node[j][ups[d][below.first[j]]]
                levels[d].weigh(j, np.bincount(parent, below.log_w[j], len(levels[d].n0[j])))
    pred = np.empty((len(keys), 8))
    for j in range(8):
        row = np.arange(len(keys))
        p = levels[DEPTH].own(j)
        seen = (levels[DEPTH].n0[j] + levels[DEPTH].n1[j])[levels[DEPTH].node[j]] > 0
        for d in range(DEPTH - 1, top - 1, -1):
            row = ups[d][row]
            node = levels[d].node[j][row]
            share = np.where(seen, levels[d].share[j][node], 1.0)
            p = share * levels[d].own(j)[row] + (1 - share) * p
            seen = (levels[d].n0[j] + levels[d].n1[j])[node] > 0
        pred[:, j] = np.where(seen, p, -1.0)
    return pred, levels[top]


def _row_counts(level: Level) -> np.ndarray:
    """Counts of the rows themselves: the last bit's node has a zero row and a one row."""
    one = level.rows & np.uint64(1) == 1
    return np.where(one, level.n1[7][level.node[7]], level.n0[7][level.node[7]])


def _fit_part(table: pa.Table) -> pa.Table:
    """Two kinds of rows: the part's keys with their predictions as seen from depth TOP, and its sums over nodes of depth TOP by the two bytes before and the decided bits."""
    keys = np.concatenate([np.cumsum(opened(x, "<u8"), dtype=np.uint64) for x in table["data"].to_pylist()])
    counts = np.concatenate([opened(x, "<i8") for x in table["more"].to_pylist()])
    keys, back = np.unique(keys, return_inverse=True)
    pred, level = fit_tree(keys, np.bincount(back, counts, len(keys)), TOP)
    at, logs, n0, n1 = [], [], [], []
    for j in range(8):
        rows = level.rows[level.first[j]]
        pair = (rows >> np.uint64(8 * (TOP - 1))).astype(np.int64)  # the two bytes nearest to the coded one
        at.append((pair << 8) | (1 << j) | ((rows & np.uint64(255)) >> np.uint64(8 - j)).astype(np.int64))
        logs.append(level.log_w[j])
        n0.append(level.n0[j])
        n1.append(level.n1[j])
    node, back = np.unique(np.concatenate(at), return_inverse=True)
    sums = [np.bincount(back, np.concatenate(x), len(node)) for x in (logs, n0, n1)]
    none, part = pa.nulls, table["part"][0].as_py()
    fitted = pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([squeezed(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "pred": pa.array([squeezed(pred.astype("<f4").ravel())], pa.binary()), **dict(zip(("node", "log_w", "n0", "n1"), [none(1, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64())], strict=True))})
    m = len(node)
    nodes = pa.table({"part": none(m, pa.int32()), "keys": none(m, pa.binary()), "pred": none(m, pa.binary()), "node": node, "log_w": sums[0], "n0": sums[1], "n1": sums[2]})
    return pa.concat_tables([fitted, nodes])


class Upper:
    """Shares and counts of the nodes of depths TOP - 1, ..., 0, from sums over the depth below."""

    def __init__(self, node: np.ndarray, log_w: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        """node: the bytes before, nearest first, then 8 bits with the decided ones after a leading 1."""
        self.levels = []
        for d in range(TOP - 1, -1, -1):
            kt = log_kt(n0, n1)
            w = np.logaddexp(HALF + kt, HALF + log_w)
            self.levels.append((node, np.exp(HALF + kt - w), n0, n1))
            up = node & 255 if d <= 1 else ((node >> 16) << 8) | (node & 255)
            node, back = np.unique(up, return_inverse=True)
            log_w, n0, n1 = (np.bincount(back, x, len(node)).astype(float) for x in (w, n0, n1))

    def finish(self, keys: np.ndarray, pred: np.ndarray) -> np.ndarray:
        """log10 probability of each key, from its predictions as seen from depth TOP."""
        byte, total = (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
        for j in range(8):
            bits = (1 << j) | (byte >> (8 - j))
            one = (byte >> (7 - j)) & 1 == 1
            p, seen = np.maximum(pred[:, j], 0.0), pred[:, j] >= 0
            for d, (node, share, n0, n1) in zip(range(TOP - 1, -1, -1), self.levels, strict=True):
                before = (keys >> np.uint64(8 * (DEPTH - d + 1))).astype(np.int64) if d else np.zeros(len(keys), np.int64)
                at = np.searchsorted(node, (before << 8) | bits)
                s = np.where(seen, share[at], 1.0)
                p = s * (np.where(one, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1) + (1 - s) * p
                seen = n0[at] + n1[at] > 0
            total += np.log10(p)
        return total


def gram_answers(grams: DataFrame) -> DataFrame:
    """Rows of kind OF_GRAMS for rows of kind GRAMS."""
    spark = grams.sparkSession
    sent = grams.select("part", "block", "data", "more")
    fitted = common.materialize(sent.groupBy("part").applyInArrow(_fit_part, "part int, keys binary, pred binary, node long, log_w double, n0 double, n1 double"), "ctw-fitted")
    nodes = fitted.where("node is not null").groupBy("node").agg(F.sum("log_w").alias("log_w"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("node").toArrow()  # 65,536 pairs of bytes x 255 at most
    upper = spark.sparkContext.broadcast(Upper(nodes["node"].to_numpy(), *[nodes[c].to_numpy().astype(float) for c in ("log_w", "n0", "n1")]))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.cumsum(opened(known["keys"][0].as_py(), "<u8"), dtype=np.uint64)
        logp = upper.value.finish(keys, opened(known["pred"][0].as_py(), "<f4").reshape(-1, 8)).astype("<f4")
        part = asked["part"][0].as_py()
        return _table([_row(OF_GRAMS, part, b, squeezed(logp[np.searchsorted(keys, np.cumsum(opened(x, "<u8"), dtype=np.uint64))])) for b, x in zip(asked["block"].to_pylist(), asked["data"].to_pylist(), strict=True)])

    known = fitted.where("node is null").select(F.col("part").alias("of_part"), "keys", "pred")
    return sent.select("part", "block", "data").groupBy("part").cogroup(known.groupBy("of_part")).applyInArrow(answer, PACKED)


# scores of documents -----------------------------------------------------------------------------


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learns from rows whose crc32 of the id mod 7 is not 2."""
    common.small_batches(docs.sparkSession)
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("binary"))), F.lit(0)), F.count_if(~common.held_out("doc_id", 7, 2))).first()
    parts = max(1, -(-size // PART_BYTES))
    sent = common.materialize(blocks(docs, parts), "ctw-blocks")
    of_words = common.materialize(sent.where(F.col("kind") == WORDS).select("part", "block", "data", "more").groupBy("part").applyInArrow(_count_words, PACKED), "ctw-words")
    v, n = of_words.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends
    answers = of_words.where(F.col("kind") == OF_WORDS).unionByName(gram_answers(sent.where(F.col("kind") == GRAMS)))
    log_all, end_base = float(np.log10(n + v + 1)), float(np.log10(ends + 1))

    def total(texts: pa.Table, got: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(zstandard.decompress(texts["data"][0].as_py())).read_all()
        block = Block(rows["text"].to_pylist(), rows["held_out"].to_pylist())
        answer = {(k, p): x for k, p, x in zip(got["kind"].to_pylist(), got["part"].to_pylist(), got["data"].to_pylist(), strict=True)}
        keys, _, cuts = block.grams(parts)
        logp = np.concatenate([np.zeros(0, "<f4"), *[opened(answer[OF_GRAMS, k], "<f4") for k in np.nonzero(np.diff(cuts))[0].tolist()]])
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order].astype(float)
        score = np.zeros(len(rows))
        for key, text in block.chunks():
            code, u = _factorized(key)
            score += np.bincount(text, logp[np.searchsorted(keys, u)][code], len(rows))
        known, part = block.words(parts)
        c = np.zeros(len(known), np.int64)
        order = np.argsort(part, kind="stable")
        if len(known):
            c[order] = np.concatenate([opened(answer[OF_WORDS, k], "<i8") for k in np.unique(part).tolist()])
        logc, tokens, hits, base = np.log10(c + 1), [], [], []
        for t in block.texts:
            i = np.fromiter(map(known.__getitem__, t.split()), np.int64)
            tokens.append(len(i) + 1)
            hits.append(int((c[i] > 0).sum()) + (ends > 0))
            base.append(float(logc[i].sum()) + end_base - (len(i) + 1) * log_all)
        sizes = pa.array([len(t) for t in block.texts], pa.int64())
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(hits, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": score, "coded": sizes})

    texts = sent.where(F.col("kind") == TEXTS).select("block", "data")
    own = answers.select(F.col("block").alias("of_block"), "kind", "part", "data")
    scored = texts.groupBy("block").cogroup(own.groupBy("of_block")).applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, coded long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("coded")).alias("bits_per_byte"))


def _factorized(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, distinct keys)."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()
