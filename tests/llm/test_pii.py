"""Personal data: fixed formats against Python's re on a whole table, discoveries against planted identifiers."""

import hashlib
import random
import re
import time

from rowloom.llm import pii
from rowloom.llm.common import documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    ok = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d),
        "phone": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_fixed_formats_on_a_whole_table_and_odd_texts(spark, folder):
    rng = random.Random(5)
    bits = ["a@b.c", "x_y@d-e.f.g", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.4", "4000 0000 0000 0002", "4000-0000-0000-0002", "+1 (017) 555-7713", "+", "(", ")", " ", "-", "9", "12345678901234567890", "é", "🙂", "\n", "word", "%"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3_000)]
    texts = [r["text"] or "" for r in documents(spark, folder).collect()] + odd
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], "doc_id long, text string, kind string, uid int, matches string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = base(t)
        assert got[k]["base_sha256"] == digest(want), t
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(w[0] == x for w in want) for x in pii.KINDS]
        assert {f"{x}:{s}:{e}" for x, s, e in want} <= set(got[k]["spans"].split(","))


def test_planted_identifiers_of_other_formats_are_found(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "lo mi ra te su ven kor".split() for b in "ta ne ri go".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cues = {"phone": ("call", lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: rng.choice([f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(100, 999)} 555 {rng.randint(1000, 9999)}"])),
            "email": ("mail", lambda: f"{rng.choice(words)}{rng.randint(1, 99)}@{rng.choice(words)}.example", lambda: f"{rng.choice(words)}{rng.randint(1, 99)}@{rng.choice(words)}"),
            "ip": ("host", lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), lambda: f"10.{rng.randint(0, 9)}.{rng.randint(0, 9)}")}
    rows, planted = [], {}
    for k in range(1_200):
        kind = rng.choice(list(cues))
        cue, known, unseen = cues[kind]
        if k % 4 == 0:  # an identifier that no format has, in the same words
            value = unseen()
            text = f"{prose(6)} {cue} "
            planted[k] = f"{kind}:{len(text)}:{len(text) + len(value)}"
            rows.append((k, f"{text}{value} soon {prose(5)}"))
        elif k % 4 == 1:  # a number that is none, elsewhere
            rows.append((k, f"{prose(4)} {rng.choice(words)} {rng.randint(1, 99999)} {prose(6)}"))
        else:
            rows.append((k, f"{prose(6)} {cue} {known()} soon {prose(5)}"))
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(v in got[k]["spans"].split(",") for k, v in planted.items())
    added = sum(r["n_added"] for r in got.values())
    assert right >= 0.9 * len(planted), (right, len(planted))
    assert right >= 0.9 * added, (right, added)
    assert all(got[k]["n_added"] == 0 for k in got if k % 4 == 1)


def test_a_megabyte_of_matches_takes_seconds(spark):
    text = "10.0.0.1 abc123x " * 60_000
    docs = spark.createDataFrame([(1, text), (2, "7" * 300_000), (3, "+1 " + "(" * 300_000), (None, "1 " * 200_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(docs).select("doc_id", "n_ip", "base_sha256").collect()}
    assert got[1]["n_ip"] == 60_000 and got[1]["base_sha256"] == digest(base(text))
    assert time.time() - began < 90
