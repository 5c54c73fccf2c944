"""Packing against the plain tokenizer and by brute force over a whole table."""

import random
import zlib

import numpy as np

from rowloom.llm import packing
from rowloom.llm.common import documents

BITS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "<|endoftext|>", "<|endoftext|", "'s", "'ll", "don't", "l'été", "Ürs", "word", "Word", "WORDS", "12", "3.14", "½", "²", "日本", "語", "नमस्ते", "é", "é", "!!", "&&&", ".", ",", "_", "%", "🙂", "\x00", "​", "x" * 40, "=" * 70]


def test_ids_are_the_plain_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = ["", "\n hello", "first line\nsecond line", " \n", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " " * 5000 + "x", "y" * 3000]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    plain = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.encoder(packing.default_tokenizer())
    assert enc.fast is not None
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_whole_table_by_brute_force(spark, folder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    docs = documents(spark, folder)
    want = {}
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 2048 or min(len(ids), 2048)
        for k, (s, e) in enumerate(zip([0, *range(cut, len(ids), 2048)], [*range(cut, len(ids), 2048), len(ids)], strict=True)):
            want[r["doc_id"], k] = (s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
    got = packing.pack(docs).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for ps in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(ps)]]).tolist()
        assert [o for o, _ in sorted(ps)] == ends[:-1] and ends[-1] <= 2048
    tokens = sum(n for _, n, _ in want.values())
    assert len(places) <= -(-tokens // 2048) * 1.01 + 1


def test_a_hot_length_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    docs = spark.createDataFrame([(k % 40 or None, "one two" if k % 3 else None) for k in range(200)], "doc_id long, text string")
    got = packing.pack(docs, sequence=16).collect()
    assert len(got) == 200 and len({(r["sequence_id"], r["offset"]) for r in got}) == 200
    full = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-full // 16)
