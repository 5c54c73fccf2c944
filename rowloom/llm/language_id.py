"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word that it does
not know is scored by character n-grams of its padded form: the longest order of which at least
one gram is known, tried from GRAM_ORDERS[0] down. Scores add up over the text, and the posterior
of the best language is the row's score.

The model is learnt from a bounded sample of labelled rows (SAMPLE_ROWS at most, drawn by a hash of the row)
and has every word and gram that the sample holds at least LEAST_COUNT times, so its size is that of the
sample's vocabulary. Counting is distributed.

A word is a run of letters with the combining marks on them, by Unicode category; digits that look
like letters, signs and numerals are none. Workers remember scores of runs between ASCII blanks and signs,
up to CACHE_BYTES of them and none longer than CACHE_WORD, so scripts without blanks are scored as they come.

Nulls: a null text, or one without letters, is `und` with score 0; so is everything when no
labelled row was there to learn from. A null language is not learnt from. Repeated rows count as often as they
occur. Ties of two languages go to the first by name. Very long texts are scored whole. An empty table gives
an empty result. Of columns to keep, one that is named like a column of the result gives way to it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 8_000
#: A word or gram that the sample holds less often says too little of its frequency.
LEAST_COUNT = 3
GRAM_ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
UNKNOWN = "und"
#: Bytes of the words that a worker remembers the scores of, and the longest such word.
CACHE_BYTES, CACHE_WORD = 96 << 20, 64
#: What a word in the cache costs beside its bytes and scores.
ENTRY_BYTES = 150

#: ASCII letters in lower case, everything else in ASCII a blank; other bytes stay.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_scorers: dict[str, "Scorer"] = {}


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_ASCII).split()


def letters(word: bytes) -> list[str]:
    return _LETTERS.findall(word.decode("utf-8", "replace").lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


class Scorer:
    """Sums of log scores for texts; keeps the scores of words that it met."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams, self.logs, self.prior = (model[k] for k in ("langs", "words", "grams", "logs", "prior"))
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.table = np.zeros((1 << 12, len(self.langs) + 1))  # row 0 stays zero: words that are not remembered

    def word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.logs[at]
        for n in GRAM_ORDERS:
            found = [g for g in map(self.grams.get, grams(word, n)) if g is not None]
            if found:
                return self.logs[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def _row(self, word: bytes) -> np.ndarray:
        """Scores of a run's words, and their number."""
        parts, row = letters(word), np.zeros(len(self.langs) + 1)
        for p in parts:
            row[:-1] += self.word(p)
        row[-1] = len(parts)
        return row

    def _learn(self, new: list[bytes]) -> None:
        need = len(self.index) + len(new) + 1
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, len(self.table)), self.table.shape[1]))])
        for w in new:
            at = len(self.index) + 1
            self.table[at] = self._row(w)
            self.index[w] = at
            self.held += len(w) + 8 * self.table.shape[1] + ENTRY_BYTES

    def score(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if self.held > CACHE_BYTES:
            self.forget()
        split = [split_words(t) for t in texts]
        new = {w for s in split for w in s}.difference(self.index)
        long = {w for w in new if len(w) > CACHE_WORD}
        self._learn(list(new - long))
        sizes = np.array([len(s) for s in split])
        ids = np.fromiter((i for s in split for i in map(self.index.get, s, repeat(0))), np.int64, sizes.sum())
        total = np.zeros((len(texts), self.table.shape[1]))
        full = np.nonzero(sizes)[0]
        if len(full):
            total[full] = np.add.reduceat(self.table[ids], (np.cumsum(sizes) - sizes)[full], axis=0)
        if long:
            for row, s in zip(total, split, strict=True):
                for w in s:
                    if len(w) > CACHE_WORD:
                        row += self._row(w)
        logs = total[:, :-1] + self.prior
        best = logs.argmax(1)
        p = 1 / np.exp(logs - logs[np.arange(len(best)), best][:, None]).sum(1)
        none = total[:, -1] == 0
        return [UNKNOWN if n else self.langs[k] for n, k in zip(none, best, strict=True)], np.where(none, 0.0, p)


def _counted(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts, summed in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w, n in Counter(split_words(t)).items():
                    for p in letters(w):
                        seen[lang, p] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _with_grams(words: DataFrame) -> DataFrame:
    """lang, k (0: the word itself), key, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                seen[lang, 0, w] += n
                for k in GRAM_ORDERS:
                    for g in grams(w, k):
                        seen[lang, k, g] += n
            if len(seen) > 200_000:
                yield _flushed(seen)
        yield _flushed(seen)

    return words.mapInArrow(count, "lang string, k int, key string, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))


def _flushed(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "k", "key", "n"])
    seen.clear()
    return out


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, least_count: int = LEAST_COUNT) -> dict:
    """Model from rows with text and lang; the caller has taken out what must not be learnt from."""
    common.small_batches(labelled.sparkSession)
    rows = common.bounded_sample(labelled.where("lang is not null and text is not null").select("lang", "text"), sample_rows)
    rows = common.materialize(rows, "langid-sample")
    words = _counted(rows).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # few bytes, but much to count in each word
    counts = common.materialize(_with_grams(words), "langid-counts")
    docs_by = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    totals = {(r["lang"], r["k"]): r["n"] for r in counts.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    prior = np.log(np.array([docs_by[x] for x in langs], float) / max(1, sum(docs_by[x] for x in langs))) if langs else np.zeros(0)
    by_key = counts.groupBy("k", "key").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)], F.sum("n").alias("total"))
    kept = by_key.where(F.col("total") >= least_count).drop("total").toArrow()  # the bounded sample's vocabulary
    order, n = kept["k"].to_numpy(), np.stack([kept[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1) if langs else np.zeros((0, 0))
    sizes = np.bincount(order, minlength=max(GRAM_ORDERS) + 1) + 1
    all_of = np.array([[totals.get((x, k), 0) for x in langs] for k in range(len(sizes))], float).reshape(len(sizes), len(langs))
    logs = np.log((n + SMOOTH) / (all_of + SMOOTH * sizes[:, None])[order]) if len(order) else np.zeros((0, len(langs)))
    keys, is_word = kept["key"].to_pylist(), (order == 0).tolist()
    words = {w: i for i, (w, own) in enumerate(zip(keys, is_word, strict=True)) if own}
    parts = {g: i for i, (g, own) in enumerate(zip(keys, is_word, strict=True)) if not own}
    return {"langs": langs, "prior": prior, "words": words, "grams": parts, "logs": logs, "key": uuid.uuid4().hex}


def _scorer(model: dict) -> Scorer:
    if model["key"] not in _scorers:
        _scorers.clear()
        _scorers[model["key"]] = Scorer(model)
    return _scorers[model["key"]]


def _scored(model: dict, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    if not model["langs"]:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    return _scorer(model).score([t or b"" for t in texts])


def with_language(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, with all their columns, whatever their names."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, _ = _scored(shared.value, b.column(at).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, lang_pred, score for each row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, p = _scored(shared.value, b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], pa.array(langs, pa.string()), pa.array(p, pa.float64())], [*names, "lang_pred", "score"])

    keep = tuple(c for c in keep if c not in ("doc_id", "lang_pred", "score"))
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep)
    names, kinds = kept.columns, {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("binary").alias("__" + "_".join(names)))  # a name that no other column has
    return rows.mapInArrow(score, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "lang_pred string, score double"]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32 of the id mod 4 is not 2."""
    flagged = docs.select("doc_id", "text", "lang", common.held_out("doc_id", 4, 2).alias("held_out"))
    return predict(flagged, train(flagged.where("not held_out")), keep=("held_out",))
