"""Packing by minimum bin slack: each window takes the remaining lengths whose sum is closest to its capacity.

Texts become token ids in Python workers; from there only lengths matter. The driver holds the
histogram of lengths (one row a length, 2048 at most) and plans windows: the longest remaining length
opens a window, and a bitset of reachable sums over the remaining lengths and their counts finds
the multiset that fills the rest of it best; walking back through the bitsets gives the counts, and the
pattern is repeated as often as they allow. A length whose windows cannot be filled exactly any more is
put aside. What was put aside is laid end to end and cut at the windows' ends, so these are full
too, and its last tokens fill sequences whose sizes are powers of two. No sequence is padded.

Documents longer than a sequence give full sequences and one shorter rest. Others are cut only if they
were put aside and lie across an end.

Nulls: a null text is empty and packs as the end id alone; a null id is kept. Repeated rows and rows
with one id are packed apart; among equal lengths a hash of row and ids decides. Very long texts are
encoded whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranks
from .packing import byte_chars

SEQUENCE = 2048
END_ID = 1
#: Rows of a length that are ranked in one window.
BUCKET_ROWS = 1_000
#: Bytes of the words that a worker remembers the ids of, and the longest such word.
CACHE_BYTES, CACHE_WORD = 96 << 20, 128
#: What an entry of the cache costs beside its bytes.
ENTRY_BYTES = 200
#: Fixed value: how tokenizers of this kind cut a text into words, digits and signs.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Small letters whose capital is one letter of as many bytes, and runs of them, of capitals and of ASCII signs but `'` and `<`.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_SIMPLE = re.compile(rf"[!-&(-;=-~{_LETTERS}{_LETTERS.upper()}]+")
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|\n|[^0-9{_LETTERS}\n]+")
#: An id that no vocabulary has, between the ids of words.
_STOP_ID = 0xFFFFFFFF
_STOP = b"\xff\xff\xff\xff"
_encoders: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizers library.

    Where the file's tokens never cross white space, a text's ids are those of its runs without white
    space, one after the other, so each different run is encoded once and remembered. Words of plain
    letters in such a run are merged by tiktoken over the file's own merges (`word_ranks`). Other files
    take whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.by_runs = splits_at_white_space(whole)
        ranks = word_ranks(whole["model"]) if self.by_runs else None
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(name=os.path.basename(path), pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[b"\n"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": _STOP}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of plain letters: each word's last letter is a capital, which stands for the word's end."""
        ids = self.fast.encode_to_numpy("\n".join([w[:-1] + w[-1].upper() for w in words])).astype("<u4")
        ids[ids == self.line] = _STOP_ID
        return ids.tobytes().split(_STOP)

    def _simple(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of plain letters, digits and signs: all their words at once."""
        parts = _PARTS.findall("\n".join(runs).lower())
        new = set(parts).difference(self.parts)
        words = [p for p in new if p[0] in _LETTERS]
        rest = [p for p in new if p[0] not in _LETTERS]
        for names, found in ((words, self._words(words) if words else []), (rest, self.whole(rest))):
            self._keep(self.parts, names, found)
        return b"".join(map(self.parts.__getitem__, parts)).split(_STOP)

    def _keep(self, where: dict, names: list, found: list[bytes]) -> None:
        where.update(zip(names, found, strict=True))
        self.held += sum(map(len, names)) + sum(map(len, found)) + ENTRY_BYTES * len(names)

    def _runs(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs without white space."""
        texts = b"\n".join(runs).decode("utf-8", "replace").split("\n")
        if self.fast is None:
            return dict(zip(runs, self.whole(texts), strict=True))
        plain = [_SIMPLE.fullmatch(t) is not None for t in texts]
        simple, odd = list(compress(texts, plain)), [k for k, x in enumerate(plain) if not x]
        out = dict(zip(compress(runs, plain), self._simple(simple), strict=True)) if simple else {}
        out.update(zip([runs[k] for k in odd], self.whole([texts[k] for k in odd]), strict=True))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_runs:
            return self.whole([t.decode("utf-8", "replace") for t in texts])
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        long = [w for w in new if len(w) > CACHE_WORD]
        short = [w for w in new if len(w) <= CACHE_WORD] if long else new
        if short:
            found = self._runs(short)
            self._keep(self.known, list(found), list(found.values()))
        get = self.known.__getitem__
        if long:  # these are not remembered
            own = dict(zip(long, self.whole([w.decode("utf-8", "replace") for w in long]), strict=True))
            get = lambda w: own[w] if w in own else self.known[w]
        out = [b"".join(map(get, s)) for s in split]
        if self.held > CACHE_BYTES:
            self.forget()
        return out


def splits_at_white_space(whole: dict) -> bool:
    """Whether the file cuts texts by WORD_PATTERN alone, after composing, folding white space and lower-casing."""
    steps = (whole.get("normalizer") or {}).get("normalizers") or []
    cuts = (whole.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return False
    folds = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    plain = cuts[0]["pattern"] == {"Regex": WORD_PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    added = any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in whole.get("added_tokens") or [])
    return folds and plain and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or added)


def word_ranks(model: dict) -> dict[bytes, int] | None:
    """The merges of words of plain letters as bytes and ids, capitals standing for letters at a word's end; None for other models.

    A letter's UTF-8 bytes are its symbols, and the end of a word is part of the last. Its capital has
    the same bytes but for a last one that no small letter has, so that is the last symbol.
    """
    suffix = model.get("end_of_word_suffix")
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token", "fuse_unk"))
    if model.get("type") != "BPE" or not suffix or odd:
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(m) for m in merged]
    if None in ids or sorted(ids) != ids:
        return None
    chars = byte_chars()
    ends = {c.encode()[-1]: c.upper().encode()[-1] for c in _LETTERS}
    used = {b for c in _LETTERS + _LETTERS.upper() for b in c.encode()}
    ranks: dict[bytes, int] = {}
    for token, at in model["vocab"].items():
        word = token.endswith(suffix) and token != suffix
        raw = [chars.get(c) for c in (token[: -len(suffix)] if word else token)]
        if None in raw or (word and raw[-1] not in ends):
            continue
        mapped = bytes([*raw[:-1], ends[raw[-1]]] if word else raw)
        if len(mapped) > 1 and set(mapped[:-1]) & set(ends.values()) or not word and mapped[-1] in ends.values():
            continue  # what no word of plain letters has
        if set(mapped) <= used:
            ranks[mapped] = at
    spare = max(model["vocab"].values()) + 1
    for b in range(256):  # bytes that no such word has, for tiktoken's sake; the line end among them
        if bytes([b]) not in ranks:
            ranks[bytes([b])] = spare
            spare += 1
    return ranks


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, doc_tokens, start, length, ids_crc32, ids: full sequences of long documents (their ids null, they are never cut), and rests."""
    common.small_batches(docs.sparkSession)
    types = {"uid": pa.int64(), "doc_id": pa.int64(), "doc_tokens": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            uids, doc_ids, texts = (b.column(c).to_pylist() for c in ("uid", "doc_id", "text"))
            for uid, d, ids in zip(uids, doc_ids, enc.encode([t or b"" for t in texts]), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    own = ids[4 * at : 4 * (at + sequence)]
                    rows.append((uid, d, n, at, len(own) // 4, zlib.crc32(own), own if len(own) < 4 * sequence else None))
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))

    cols = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(cut, "uid long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary")


def fill(gap: int, free: list[tuple[int, int]]) -> tuple[int, Counter]:
    """(sum, counts by length): the multiset of free(length, count) whose sum is closest to gap from below.

    Counts go in as powers of two and a rest. The walk back takes a part only where the sum was not
    reachable before it.
    """
    reach, stages = 1, []
    for x, count in free:
        left, part = min(count, gap // x), 1
        while left > 0 and not reach >> gap & 1:
            k = min(part, left)
            stages.append((x, k, reach))
            reach |= (reach << x * k) & ((1 << gap + 1) - 1)
            left, part = left - k, part * 2
        if reach >> gap & 1:
            break
    best = at = reach.bit_length() - 1
    used: Counter = Counter()
    for x, k, before in reversed(stages):
        if not before >> at & 1:
            used[x] += k
            at -= x * k
    return best, used


def plan_windows(histogram: dict[int, int], capacity: int = SEQUENCE) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Full windows as (lengths, how many such windows), and the lengths put aside with their counts."""
    count = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= capacity for k in count):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    windows, aside = [], {}
    while count:
        longest = max(count)
        gap = capacity - longest
        free = [(x, n - (x == longest)) for x, n in sorted(count.items(), reverse=True) if x <= gap]
        best, used = fill(gap, free)
        if best < gap:
            aside[longest] = count.pop(longest)
            continue
        used[longest] += 1
        times = min(count[x] // n for x, n in used.items())
        for x, n in used.items():
            count[x] -= n * times
            if not count[x]:
                del count[x]
        windows.append((sorted(used.elements(), reverse=True), times))
    return windows, aside


def ends(tokens: int, capacity: int) -> list[int]:
    """Where the sequences after the last full one end: the rest as a sum of powers of two, largest first."""
    at, rest = tokens // capacity * capacity, tokens % capacity
    out = []
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            at += 1 << k
            out.append(at)
    return out


def _laid(rows: DataFrame, aside: DataFrame, first_sequence: int, tokens: int, capacity: int) -> DataFrame:
    """Rows put aside, with their position end to end, cut at the ends of sequences: sub_start, sub_length, sequence_id, offset."""
    full, last = tokens // capacity, ends(tokens, capacity)
    rows = rows.join(F.broadcast(aside), "length").where("rank >= taken").withColumn("at", F.col("base") + (F.col("rank") - F.col("taken")) * F.col("length"))
    stop = F.col("at") + F.col("length")
    next_end = (F.floor(F.col("at") / capacity) + 1) * capacity
    own_ends = F.array(F.when(next_end <= full * capacity, next_end), *[F.lit(e).cast("long") for e in last])
    inner = F.array_sort(F.array_distinct(F.filter(own_ends, lambda e: e.isNotNull() & (e > F.col("at")) & (e < stop))))
    zipped = F.arrays_zip(F.concat(F.array("at"), inner).alias("from"), F.concat(inner, F.array(stop)).alias("to"))
    cut = rows.withColumn("cut", F.explode(zipped))
    begin = F.col("cut")["from"]
    starts = F.array(*[F.lit(s).cast("long") for s in [full * capacity, *last[:-1]]])
    passed = F.filter(starts, lambda s: s <= begin)
    sequence = F.when(begin < full * capacity, F.floor(begin / capacity)).otherwise(full + F.size(passed) - 1)
    offset = F.when(begin < full * capacity, begin % capacity).otherwise(begin - F.coalesce(F.array_max(passed), F.lit(0)))
    return cut.select("uid", "doc_id", "doc_tokens", "start", "length", "ids_crc32", (begin - F.col("at")).alias("sub_start"), (F.col("cut")["to"] - begin).alias("sub_length"), (first_sequence + sequence).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _sub_crc(ids: Column) -> Column:
    return F.crc32(F.substring(ids, (4 * F.col("sub_start") + 1).cast("int"), (4 * F.col("sub_length")).cast("int")))


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, **cols: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    spark = docs.sparkSession
    found = common.materialize(pieces(docs, tokenizer or default_tokenizer(), sequence, **cols), "slack-pieces")
    names = ["uid", "doc_id", "doc_tokens", "start", "length", "ids_crc32"]
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `sequence` rows at most
    total = sum(histogram.values())
    keyed = found.select(*names, F.xxhash64("doc_id", "ids_crc32", "uid", "start").alias("draw"))
    rows = ranks.ranked(keyed, "length", ["draw", "uid", "start"], total, BUCKET_ROWS).select(*names, "rank")
    windows, aside = plan_windows(histogram, sequence)
    places, taken, base = [], Counter(), 0
    for lengths, times in windows:
        at = 0
        for x in lengths:
            places.append((x, taken[x], times, base, at))
            taken[x] += times
            at += x
        base += times
    rows = common.materialize(rows, "slack-ranked")
    table = spark.createDataFrame(places, "length long, first long, ranks long, base long, offset long")
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    out = rows.join(common.broadcast_if_small(table, len(places)), "length").where(inside)
    out = out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    if not aside:
        return out
    laid, tokens = [], 0
    for x in sorted(aside, reverse=True):
        laid.append((x, taken[x], tokens))
        tokens += x * aside[x]
    cut = _laid(rows, spark.createDataFrame(laid, "length long, taken long, base long"), base, tokens, sequence)
    cut = common.materialize(cut, "slack-cut")
    whole = cut.where("sub_length = length").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    parted = cut.where("sub_length < length").drop("ids_crc32").join(found.where(F.col("length").isin(sorted(aside))).select("uid", "start", "ids"), ["uid", "start"])
    parted = parted.select("doc_id", (F.col("start") + F.col("sub_start")).alias("start"), F.col("sub_length").alias("length"), _sub_crc(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return out.unionByName(whole).unionByName(parted)
