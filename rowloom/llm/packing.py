"""Best-two-fit packing of token sequences.

Texts become token ids in Python workers; from there only lengths matter, and there are no more
different lengths than tokens in a sequence. The driver gets the histogram of lengths (2048 rows
at most), fills bins greedily, replaces a bin's smallest piece by two unpacked ones that fit its
widened gap more tightly, and repeats a pattern as often as the counts allow. The plan says which
ranks of a length go where; every piece finds its place by its rank among pieces of its length.

Nulls: a null text is empty and packs as the end id alone; a null id is kept. Repeated rows and rows
with one id are packed apart, ties among equal lengths go by id, piece, checksum and row. Very long texts,
runs of blanks among them, are encoded whole; only documents longer than a sequence are cut. Other columns of the table are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
END_ID = 0
#: Rows of one slice of a length, in which ranks are counted.
SLICE_ROWS = 500

#: Fixed value: how byte-level tokenizers of this kind cut a text before merging bytes.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and their ids if the file is a plain byte-level BPE whose ids are in order of merging, else None."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole.get("pre_tokenizer") or {}
    plain = whole.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or odd or model.get("type") != "BPE":
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if len(model["vocab"]) != 256 + len(merged) or any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merged)):
        return None
    chars = byte_chars()
    return {bytes(chars[c] for c in token): k for token, k in model["vocab"].items()}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizers library.

    A plain byte-level BPE whose ids are in order of merging runs in tiktoken over the file's own vocabulary, which
    gives the same ids several times faster. Texts with an added token in them, and other files, take tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(name=os.path.basename(path), pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return self.whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its regex gives up on runs of some million blanks
            return self.whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: a document of up to `sequence` ids is one piece; of a longer one the first piece takes the remainder."""
    common.small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for uid, d, ids in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % sequence or sequence
                    rows.append((uid, d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    cols = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(cut, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), in order of filling."""
    count = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in count):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    sizes = sorted(count)
    out: list[tuple[list[int], int]] = []

    def largest(most: int, used: Counter) -> int:
        k = bisect_right(sizes, most) - 1
        while k >= 0 and count[sizes[k]] <= used[sizes[k]]:
            k -= 1
        return sizes[k] if k >= 0 else 0

    while sizes:
        used: Counter = Counter()
        gap = capacity
        while gap and (x := largest(gap, used)):
            used[x] += 1
            gap -= x
        while gap:
            least = min(used)
            used[least] -= 1
            pair = _two(sizes, count, used, least, least + gap)
            if pair is None:
                used[least] += 1
                break
            used += Counter()  # drops zeros
            for x in pair:
                used[x] += 1
            gap = least + gap - sum(pair)
        used += Counter()
        times = min(count[x] // n for x, n in used.items())
        for x, n in used.items():
            count[x] -= n * times
        sizes = [x for x in sizes if count[x]]
        out.append((sorted(used.elements(), reverse=True), times))
    return out


def _two(sizes: list[int], count: dict[int, int], used: Counter, least: int, room: int) -> tuple[int, int] | None:
    """Two free lengths whose sum is the largest in (least, room]."""
    free = [x for x in sizes if x < room and count[x] > used[x]]
    best, found, i, j = least, None, 0, len(free) - 1
    while i <= j:
        s = free[i] + free[j]
        if s > room:
            j -= 1
            continue
        if s > best and (i < j or count[free[i]] - used[free[i]] >= 2):
            best, found = s, (free[j], free[i])
            if s == room:
                break
        i += 1
    return found


def ranges(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset) for each place of each pattern."""
    taken: Counter = Counter()
    out, base = [], 0
    for lengths, times in plan:
        at = 0
        for x in lengths:
            out.append((x, taken[x], times, base, at))
            taken[x] += times
            at += x
        base += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, **cols: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = common.materialize(pieces(docs, tokenizer or default_tokenizer(), sequence, **cols), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `sequence` rows at most
    found = ranges(plan_bins(histogram, sequence))
    places = spark.createDataFrame(found, "length long, first long, ranks long, base long, offset long")
    # a length that many pieces share is counted in slices
    slices = spark.createDataFrame([(x, -(-n // SLICE_ROWS)) for x, n in histogram.items()], "length long, slices long")
    cut = cut.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "uid"), F.col("slices"))).drop("slices")
    per_slice = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    start = per_slice.select("length", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "uid")) - 1
    ranked = cut.withColumn("own", own).join(start, ["length", "slice"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slice")
    places = common.broadcast_if_small(places, len(found))
    out = ranked.join(places, (ranked["length"] == places["length"]) & (ranked["rank"] >= places["first"]) & (ranked["rank"] < places["first"] + places["ranks"]))
    return out.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
