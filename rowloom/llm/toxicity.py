"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences of which only the document's label is known. A sentence's
probability is a logistic of the weights of its words; the document's is their noisy-or with a leak
for labels that no sentence explains: 1 - (1 - leak) x product(1 - p). Weights are fitted to
document labels, and then tell which sentence is to blame.

The model is fitted to a bounded sample of labelled rows (SAMPLE_ROWS) on all words whose document
counts differ between the labels by LEAST_Z standard deviations. Scoring covers all rows and whole texts.

Nulls: a null text is empty; texts without a known word score the leak alone. A null label is not
learnt from. Without labels of both kinds every score is 0. Repeated rows are scored alike; a label given twice
is toxic if one of them says so. Ties of two sentences blame the first. Very long texts are scored whole.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 12_000
#: A word needs so many sampled documents and so many standard deviations between the labels.
LEAST_DOCS, LEAST_Z = 4, 2.5
#: Log odds of a sentence without any known word; low, so that long clean texts stay clean.
BIAS = -11.0
ROUNDS, RATE, DECAY = 300, 0.3, 1e-3
THRESHOLD = 0.7

#: ASCII letters in lower case and bytes of other letters; sentence ends become a mark, the rest blanks.
_MARK = b"\x01"
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 1 if c in b".!?\n\r" else 32 for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, with a mark at the end of each sentence."""
    return ((text or b"").translate(_ASCII).replace(_MARK, b" \x01 ") + b" \x01").split()


def sentences(text: bytes | None) -> list[list[bytes]]:
    out: list[list[bytes]] = [[]]
    for w in tokens(text):
        if w == _MARK:
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def _word_counts(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                for w in set(tokens(t)):
                    if w != _MARK:
                        seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["word", "clean", "toxic"])

    return rows.mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _bags(rows: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """label, sentence (numbers of sentences), feature (word of each): sentences without a known word are left out, as they only add the bias."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, what = [], []
            for t in b.column("text").to_pylist():
                pairs = [(k, f) for k, s in enumerate(sentences(t)) for f in sorted({words[w] for w in s if w in words})]
                where.append([p[0] for p in pairs])
                what.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(where, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.int32()))], ["label", "sentence", "feature"])

    return rows.mapInArrow(bag, "label int, sentence array<int>, feature array<int>")


def fit(bags: list[tuple[int, list[int], list[int]]], start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and leak by full-batch gradient steps on the noisy-or likelihood."""
    y = np.array([b[0] for b in bags], float)
    feat = np.concatenate([np.asarray(b[2], np.int64) for b in bags]) if bags else np.zeros(0, np.int64)
    doc_of_pair = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sent = np.concatenate([np.asarray(b[1], np.int64) for b in bags]) if bags else feat
    key, sent_of_pair = np.unique(doc_of_pair * (1 << 32) + sent, return_inverse=True)
    doc_of_sent = key >> 32
    w, leak = start.copy(), np.log(0.05 / 0.95)
    step_w, step_l = np.full(len(w), 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(BIAS + np.bincount(sent_of_pair, w[feat], len(key)))))
        lam = 1 / (1 + np.exp(-leak))
        log_none = np.log1p(-lam) + np.bincount(doc_of_sent, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        none = np.exp(log_none)
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)  # times p: the gradient by a sentence's score
        gw = np.bincount(feat, (pull[doc_of_sent] * p)[sent_of_pair], len(w)) + DECAY * w
        gl = float((pull * lam).sum())
        step_w += gw * gw
        step_l += gl * gl
        w -= 10 * RATE * gw / np.sqrt(step_w)
        leak = min(-1.0, leak - RATE * gl / np.sqrt(step_l))
    return w, float(1 / (1 + np.exp(-leak)))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from rows (id, text, label 0 or 1)."""
    common.small_batches(labelled.sparkSession)
    rows = common.materialize(common.bounded_sample(labelled.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label")), sample_rows), "toxicity-sample")
    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    model = {"words": {}, "weights": np.zeros(0), "leak": 0.0, "key": uuid.uuid4().hex}
    if not by_label.get(0) or not by_label.get(1):
        return model
    n0, n1 = float(by_label[0]), float(by_label[1])
    share = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    z = (F.col("toxic") - n1 * share) / F.sqrt(n1 * share * (1 - share) + 0.25)
    kept = _word_counts(rows).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    kept = kept.orderBy("word").collect()  # words of the bounded sample
    words = {bytes(r["word"]): k for k, r in enumerate(kept)}
    start = np.array([np.log((r["toxic"] + 0.5) / n1) - np.log((r["clean"] + 0.5) / n0) for r in kept])
    bags = [(r["label"], r["sentence"], r["feature"]) for r in _bags(rows, words).toLocalIterator()]
    model["words"] = words
    model["weights"], model["leak"] = fit(bags, np.where(start > 0, start + 4, start)) if words else (start, n1 / (n0 + n1))
    return model


class Scorer:
    def __init__(self, model: dict):
        self.weight = {w: float(model["weights"][k]) for w, k in model["words"].items()}
        self.leak = model["leak"]

    def document(self, text: bytes | None) -> tuple[float, int, float]:
        """Score, number of the sentence to blame (-1: none) and its probability."""
        log_none, k, worst, at, total, words = np.log1p(-self.leak), 0, 0.0, -1, 0.0, 0
        seen: set[bytes] = set()
        toks = tokens(text)
        if not self.weight.keys() & set(toks):
            n = sum(a != _MARK and b == _MARK for a, b in zip(toks, toks[1:], strict=False))
            return float(-np.expm1(log_none + n * _QUIET)), -1, 0.0
        for w in toks:
            if w != _MARK:
                words += 1
                if w in self.weight and w not in seen:
                    seen.add(w)
                    total += self.weight[w]
            elif words:
                p = 1 / (1 + np.exp(-(BIAS + total))) if seen else _QUIET_P
                log_none += np.log1p(-min(p, 1 - 1e-12))
                if seen and p > worst:
                    worst, at = float(p), k
                k, total, words = k + 1, 0.0, 0
                seen.clear()
        return float(-np.expm1(log_none)), at, worst


_QUIET_P = float(1 / (1 + np.exp(-BIAS)))
_QUIET = float(np.log1p(-_QUIET_P))


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, score, predicted, worst_sentence, worst_score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            out = [s.document(t) for t in b.column("__text").to_pylist()]
            cols = [pa.array([o[0] for o in out], pa.float64()), pa.array([int(o[0] >= THRESHOLD) for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *cols], [*names, "score", "predicted", "worst_sentence", "worst_score"])

    rows = docs.select("doc_id", *keep, F.col("text").cast("binary").alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "score double, predicted int, worst_sentence int, worst_score double"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, ...; learns from labels whose crc32 of the id mod 3 is not 1."""
    flagged = docs.select("doc_id", "text", common.held_out("doc_id", 3, 1).alias("held_out"))
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~common.held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    usable = common.materialize(common.bounded_sample(usable, SAMPLE_ROWS), "toxicity-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # about SAMPLE_ROWS rows
    return score(flagged, train(labelled), keep=("held_out",))
