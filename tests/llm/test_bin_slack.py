"""Minimum bin slack: sums by brute force, ids by the plain tokenizer, places of a whole table."""

import itertools
import random
import zlib

import numpy as np
import pytest

from rowloom.llm import bin_slack
from rowloom.llm.common import documents

BITS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\xa0", " ", "\x1c", "\x85", "　", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'LL", "don't", "l'été", "ÜRS", "ΣΑΣ", "İ", "ß", "word", "Word", "12", "3.14", "½", "²", "日本", "語", "नमस्ते", "e", "́", "!!", "&&&", ".", "_", "🙂", "\x00", "​", "x" * 200, "=" * 70]


def _plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bin_slack.default_tokenizer())


def test_ids_are_the_plain_tokenizers():
    rng = random.Random(7)
    texts = ["", " ", " " * 100_000 + "x", "y" * 3000, "a <|endoftext|> b"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    plain, enc = _plain(), bin_slack.WordEncoder(bin_slack.default_tokenizer())
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        for t, ids in zip(some, enc.encode([t.encode() for t in some]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_of_plain_letters_are_merged_alike():
    rng = random.Random(8)
    letters = bin_slack._LETTERS
    plain, enc = _plain(), bin_slack.WordEncoder(bin_slack.default_tokenizer())
    assert enc.by_runs and enc.fast is not None
    vocabulary = [t.removesuffix("</w>") for t in plain.get_vocab()]
    words = [w for w in vocabulary if w and set(w) <= set(letters[:26])]
    words += ["".join(rng.choice(words)[:9] for _ in range(3)) for _ in range(30_000)] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(30_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)] + ["ÀB-c12.5,É!É$$$ Ðx×y÷z ÿß ẞ Ÿ ªº ²³ naïve+Œuvre"]
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_tokens_encode_as_themselves():
    """Then merging by ranks alone gives what merging by pairs does."""
    plain = _plain()
    held = [(t, k) for t, k in plain.get_vocab().items() if t.endswith("</w>") and t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha() and t.islower()]
    assert len(held) > 20_000
    assert [t for t, k in held if plain.encode(t.removesuffix("</w>"), add_special_tokens=False).ids != [k]] == []


def test_other_files_take_whole_texts():
    from rowloom.llm import packing

    enc = bin_slack.WordEncoder(packing.default_tokenizer())
    assert not enc.by_runs
    assert enc.encode([b"two  words\n x"])[0] == packing.encoder(packing.default_tokenizer()).whole("two  words\n x")


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bin_slack, "CACHE_BYTES", 5_000)
    enc = bin_slack.WordEncoder(bin_slack.default_tokenizer())
    for k in range(50):
        enc.encode([b" ".join(b"w%d" % (20 * k + j) for j in range(20)) + b" " + b"z" * 500])
        assert enc.held <= 5_000 and len(enc.known) <= 25 and len(enc.parts) <= 50


def test_fill_is_closest():
    rng = random.Random(5)
    for _ in range(300):
        free = [(x, rng.randint(1, 4)) for x in sorted(rng.sample(range(2, 30), 4), reverse=True)]
        gap = rng.randint(1, 60)
        sums = {sum(x * k for (x, _), k in zip(free, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for _, n in free])}
        best, used = bin_slack.fill(gap, free)
        assert best == max(s for s in sums if s <= gap) == sum(x * n for x, n in used.items())
        assert all(n <= dict(free)[x] for x, n in used.items())


@pytest.mark.parametrize(("longest", "share"), [(600, 0.01), (1200, 0.1), (2048, 0.5)])
def test_windows_hold_everything_and_are_full(longest, share):
    rng = random.Random(6)
    hist = {rng.randint(1, longest): rng.randint(1, 500) for _ in range(600)}
    windows, aside = bin_slack.plan_windows(hist)
    got = dict(aside)
    for lengths, times in windows:
        assert sum(lengths) == 2048
        for x in lengths:
            got[x] = got.get(x, 0) + times
    assert got == hist and sum(aside.values()) < share * sum(hist.values())
    assert bin_slack.plan_windows({700: 9})[1] == {700: 9}


def test_the_rest_ends_at_powers_of_two():
    assert bin_slack.ends(3 * 2048 + 1500, 2048) == [6144 + x for x in (1024, 1280, 1408, 1472, 1488, 1496, 1500)]
    assert bin_slack.ends(4096, 2048) == []


def _check(docs, got, sequence):
    """docs: (doc_id, text) rows; every id lies in one piece, sequences have no gap and need no padding."""
    plain = _plain()
    want: dict = {}
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, []).append(ids)
    have: dict = {}
    places: dict = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have.keys() == want.keys()
    for d, texts in want.items():
        if len(texts) > 1:  # repeated ids: their pieces cover as many tokens
            assert sum(n for _, n, _, _ in have[d]) == sum(map(len, texts))
            continue
        at = 0
        for start, n, crc, tokens in sorted(have[d]):
            assert start == at and tokens == len(texts[0]) and crc == zlib.crc32(np.array(texts[0][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(texts[0])
    for ps in places.values():
        stops = np.cumsum([0, *[n for _, n in sorted(ps)]]).tolist()
        assert [o for o, _ in sorted(ps)] == stops[:-1]
        assert stops[-1] == sequence or stops[-1] < sequence and stops[-1] & (stops[-1] - 1) == 0
    assert sum(sum(n for _, n in ps) < sequence for ps in places.values()) <= sequence.bit_length()


def test_whole_table(spark, folder):
    docs = documents(spark, folder)
    got = bin_slack.pack(docs).collect()
    _check([(r["doc_id"], r["text"]) for r in docs.collect()], got, 2048)


@pytest.mark.parametrize("sequence", [16, 64])
def test_odd_rows(spark, sequence):
    rng = random.Random(sequence)
    rows = [(k, rng.choice([None, "", "one two", "Word " * rng.randint(1, 90), "日本 " * 7])) for k in range(300)]
    rows += [(None, None), (None, "a b")] + [(900, "same words here")] * 50
    df = spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, text string, length int, uid string")
    _check(rows, bin_slack.pack(df, sequence=sequence).collect(), sequence)


def test_one_length_alone_and_no_row(spark):
    rows = [(k, "one two three four") for k in range(101)]
    _check(rows, bin_slack.pack(spark.createDataFrame(rows, "doc_id long, text string"), sequence=16).collect(), 16)
    assert bin_slack.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    rows = [(0, " " * 2_000_000 + "x"), (1, "word " * 300_000), (2, "z" * 300_000), (3, "日" * 100_000)]
    _check(rows, bin_slack.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 2048)
