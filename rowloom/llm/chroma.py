"""Chroma audio fingerprints of media columns.

Audio (16-bit mono PCM) becomes pitch-class frames: windowed spectra folded into 12 classes,
smoothed over time and normalised. Sixteen Haar-like filters on the integral image of the frames
are quantised to two Gray-coded bits each: one packed 32-bit integer a frame. Two recordings are
compared at every offset at which they overlap enough, and aligned where the share of differing
bits is least, then at the offset nearest to 0.

Equal fingerprints are one class, so copies are compared once. Queries are the recordings whose
id is divisible by QUERY_EVERY; each meets every class, block by block, so no match is missed. A pair's
histogram of offsets counts, for each offset, the bits of frames that far apart that agree, less those that
differ. All its counts come at once, from the Fourier transforms of the two recordings' bits, and are exact whole numbers,
so they also are the bit errors by which the best offset is taken.

Nulls: null or too short audio has no frames, an empty fingerprint and no match. A null id is
indexed but never queried. Repeated rows share a class. Of ties the class of the least id counts, then the offset
nearest to 0. Very long recordings are compared whole. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, WINDOW, HOP = 8000, 2048, 683
LOW_HZ, HIGH_HZ = 60.0, 3500.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3.0
#: Frames that a filter spans at most.
SPAN = 12
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
QUERY_EVERY = 50
#: Aligned recordings match if at most this share of bits differs over at least this share of the shorter one.
MOST_ERRORS, LEAST_SHARE = 0.25, 0.5
#: Integers of one block of classes or queries, and of what is transformed at once; longer recordings stand alone.
BLOCK_INTS, CHUNK_INTS, CHUNK_ROWS = 32_000, 6_000, 128
#: Transforms up to this size are in single precision: sums of bits stay exact after rounding, and shares of them apart.
FINE = 1024


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest class, classes, frames): six kinds of halves, thirds and quarters over growing areas."""
    return [(k % 6, (k * 5) % 9, 3 + k % 2 * 3 if k % 3 else 12, 2 + (k * 7) % (SPAN - 2)) for k in range(16)]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12."""
    n = (len(samples) - WINDOW) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP][:n] * np.hanning(WINDOW)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    classes = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    fold = np.zeros((use.sum(), 12))
    fold[np.arange(len(classes)), classes] = 1
    image = power[:, use] @ fold
    image = sum(SMOOTH[i] * image[i : len(image) - len(SMOOTH) + 1 + i] for i in range(len(SMOOTH)))
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > 1e-6, image / np.maximum(norm, 1e-12), 0.0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One uint32 for each place of the widest filter."""
    image = chroma(np.asarray(samples, float), rate)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, low, tall, wide in filters():
        c0, c1 = (0, 12) if tall == 12 else (low, min(12, low + tall))
        c, t = (c0 + c1) // 2, wide // 2
        whole = area(0, wide, c0, c1)
        part = {
            0: lambda: area(0, wide, c0, c),
            1: lambda: area(0, t, c0, c1),
            2: lambda: area(0, t, c0, c) + area(t, wide, c, c1),
            3: lambda: area(0, wide, c0 + (c1 - c0) // 3, c1 - (c1 - c0) // 3),
            4: lambda: area(wide // 3, wide - wide // 3, c0, c1),
            5: lambda: area(0, wide, c0, c1) - area(0, wide, c, c1),
        }[kind]()
        ratio = np.log((part + 0.01) / (whole - part + 0.01))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(CUTS, ratio)]
    return out


def tones(vector: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A recording made of a vector: each number is a note of 1/8 s whose pitch follows it, with an octave above."""
    v = np.asarray(vector, float)
    notes = np.clip(np.round(v / max(float(v.std()), 1e-9) * 6), -18, 18)
    t = np.arange(rate // 8) / rate
    hz = 440.0 * 2 ** (notes / 12)
    wave = np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(4 * np.pi * hz[:, None] * t)
    return (wave * 10_000).astype(np.int16).ravel()


def recordings(embeddings: DataFrame) -> DataFrame:
    """media_id, audio: the synthetic media column, one recording per vector."""
    common.small_batches(embeddings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audio = [None if v is None else tones(np.array([x or 0.0 for x in v])).tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array(audio, pa.binary())], ["media_id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long").alias("media_id"), "embedding").repartition(F.xxhash64("media_id", "embedding")).mapInArrow(run, "media_id long, audio binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """media_id, ints (the fingerprint), class (a hash of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [fingerprint(np.frombuffer(a or b"", np.int16)).view(np.int32) for a in b.column("audio").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array(ints, pa.list_(pa.int32()))], ["media_id", "ints"])

    return media.mapInArrow(run, "media_id long, ints array<int>").withColumn("digest", F.sha2(F.array_join(F.transform("ints", F.hex), ","), 256))


def _spectra(ints: list[np.ndarray], size: int) -> np.ndarray:
    """Frequency x recording x bit: transforms of the bits as -1 and 1, with 0 after the end."""
    bits = np.zeros((len(ints), size, 32), np.float32 if size <= FINE else np.float64)
    for k, x in enumerate(ints):
        bits[k, : len(x)] = np.unpackbits(x.astype("<i4").view(np.uint8).reshape(-1, 4), axis=1) * 2.0 - 1
    return np.fft.rfft(bits, axis=1).transpose(1, 0, 2)


def least_errors(own: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """own x others: the least share of differing bits over all offsets of enough overlap, and that offset. Nothing is empty."""
    m, n = (np.array([len(x) for x in side]) for side in (own, others))
    alone = [x[:1] if (x == x[0]).all() else x for x in (m, n)]  # one length has one overlap an offset
    o = np.array(sorted(range(1 - int(m.max()), int(n.max())), key=lambda o: (abs(o), -o)))[:, None, None]
    y, z = alone[0][:, None], alone[1][None, :]
    frames = np.minimum(y - np.maximum(-o, 0), z - np.maximum(o, 0))
    enough = (frames > 0) & (frames >= LEAST_SHARE * np.minimum(y, z))
    use = enough.any((1, 2))
    o, frames, enough = o[use].ravel(), frames[use], enough[use]
    # the histogram of offsets: votes of agreeing bits; other offsets may fall on each other, but not on these
    size = max(int(o.max() + m.max()), int(n.max() - o.min()))
    while not _smooth(size):
        size += 1
    same = np.fft.irfft(np.conj(_spectra(own, size)) @ _spectra(others, size).transpose(0, 2, 1), size, axis=0)[o]
    np.rint(same, out=same)  # equal less differing bits
    same /= np.maximum(frames, 1).astype(same.dtype)
    if not enough.all():
        same = np.where(enough, same, -np.inf)
    at = same.argmax(0)
    best = np.take_along_axis(same, at[None], 0)[0].astype(float)
    i, j = np.ogrid[: len(m), : len(n)]
    frames = frames[at, i if len(alone[0]) > 1 else 0, j if len(alone[1]) > 1 else 0]
    return np.rint((32 * frames - best * frames) / 2) / (32.0 * frames), o[at]


def _smooth(n: int) -> bool:
    for k in (2, 3, 5):
        while n % k == 0:
            n //= k
    return n == 1


def _chunks(ints: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Places of recordings of like lengths, `most` integers and CHUNK_ROWS recordings a chunk, or one recording."""
    order, out = np.argsort([len(x) for x in ints], kind="stable"), []
    for k in order.tolist():
        if out and len(out[-1]) < CHUNK_ROWS and len(ints[k]) * (len(out[-1]) + 1) <= most and len(ints[k]) <= 2 * len(ints[out[-1][0]]):
            out[-1].append(k)
        else:
            out.append([k])
    return [np.array(c) for c in out]


def _best_of_block(table: pa.Table) -> pa.Table:
    """query, n, bit_errors, class_id, frame_offset: what each query of a block matches among the block's classes."""
    digest, asks = np.array(table["digest"].to_pylist()), np.array(table["asks"].to_pylist(), bool)
    ints = [np.array(x, np.int32) for x in table["ints"].to_pylist()]
    ids = table["class_id"].to_pylist()
    q, c = np.nonzero(asks)[0], np.nonzero(~asks)[0]
    n, best = [0] * len(q), [None] * len(q)
    for x in _chunks([ints[k] for k in q], CHUNK_INTS):
        for y in _chunks([ints[k] for k in c], CHUNK_INTS):
            share, offset = least_errors([ints[k] for k in q[x]], [ints[k] for k in c[y]])
            hit = (share <= MOST_ERRORS) & (digest[q[x]][:, None] != digest[c[y]])
            share = np.where(hit, share, np.inf)
            for i, k in enumerate(x.tolist()):
                if not (found := int(hit[i].sum())):
                    continue
                n[k] += found
                for j in np.nonzero(share[i] == share[i].min())[0].tolist():
                    name = ids[c[y[j]]]
                    new = (float(share[i, j]), name is not None, name or 0, int(offset[i, j]))
                    best[k] = new if best[k] is None else min(best[k], new)
    rows = [(digest[q[k]], n[k], b[0], b[2] if b[1] else None, b[3]) for k, b in enumerate(best) if b]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    types = {"query": pa.string(), "n": pa.int64(), "bit_errors": pa.float64(), "class_id": pa.int64(), "frame_offset": pa.int32()}
    return pa.table({name: pa.array([*v], t) for (name, t), v in zip(types.items(), cols, strict=True)})


def aligned(classes: DataFrame) -> DataFrame:
    """classes(digest, class_id, ints, asked) -> query, n, bit_errors, class_id, frame_offset: up to one row for each block of classes that a query meets."""
    size = F.size("ints").cast("long")
    every, queries = (max(1, -(-(n or 0) // BLOCK_INTS)) for n in classes.agg(F.sum(size), F.sum(F.when(F.col("asked"), size))).first())
    own = lambda n: F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols, some = ["digest", "class_id", "ints"], classes.where(F.size("ints") > 0)
    dealt = some.select(F.lit(False).alias("asks"), own(every).alias("c"), upto(queries).alias("q"), *cols)
    dealt = dealt.unionByName(some.where("asked").select(F.lit(True).alias("asks"), upto(every).alias("c"), own(queries).alias("q"), *cols))
    return dealt.groupBy("c", "q").applyInArrow(_best_of_block, "query string, n long, bit_errors double, class_id long, frame_offset int")


def match(media: DataFrame) -> DataFrame:
    """media_id, n_frames, fp_sha256, class_id, n_matches, best_class, frame_offset, bit_errors: one row per recording.

    n_matches counts other classes that align with the query's; both are null for rows that are no
    queries, best_class, frame_offset and bit_errors also where nothing aligns.
    """
    fps = common.materialize(fingerprints(media), "chroma-fps")
    classes = common.materialize(fps.groupBy("digest").agg(F.min("media_id").alias("class_id"), F.first("ints").alias("ints"), F.max(F.coalesce(F.col("media_id") % QUERY_EVERY == 0, F.lit(False))).alias("asked"), F.count(F.lit(1)).alias("n")), "chroma-classes")
    total = fps.count()
    top = aligned(classes).groupBy("query").agg(F.sum("n").alias("n_matches"), F.min(F.struct("bit_errors", "class_id", "frame_offset")).alias("top"))
    named = classes.join(top.withColumnRenamed("query", "digest"), "digest", "left").select("digest", "class_id", "n", "n_matches", "top")
    out = fps.select("media_id", "digest", F.size("ints").alias("n_frames"))
    keyed = out.withColumn("key", F.xxhash64("digest"))
    joined = common.join_groups(keyed, named.withColumn("key", F.xxhash64("digest")).drop("digest"), "key", "n", total)
    query = F.coalesce(F.col("media_id") % QUERY_EVERY == 0, F.lit(False))
    return joined.select("media_id", "n_frames", F.col("digest").alias("fp_sha256"), "class_id", F.when(query, F.coalesce("n_matches", F.lit(0))).alias("n_matches"), *[F.when(query, F.col(f"top.{a}")).alias(b) for a, b in (("class_id", "best_class"), ("frame_offset", "frame_offset"), ("bit_errors", "bit_errors"))])
