"""Product codes of vectors, assigned through a vector-approximation file of the codebook entries.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of
integer entries. To find a part's nearest entry, the entries' coordinates are kept as numbers of cells
(CELL_BITS a coordinate). A part makes one table for each of its coordinates, of the least and the
greatest squared distance to each cell; sums of looked-up numbers bound the distance to each entry
from below and above. Only entries whose lower bound does not exceed the least upper bound are
measured, in integers. Sums and counts of the entries' parts are added up in each task, then by Spark;
the driver holds the codebooks and 128 sums.

Dropped are rows whose vector is null or holds a null or a component that is not finite. Rows whose
vector has not the commonest length (of equally common ones the longest) are dropped too. Vectors whose length the
number of parts does not divide are filled up with zeros. Scaled components beyond LIMIT either way
count as LIMIT. Null ids sort last; of equal ids the lesser vector is first. Repeated rows count as often as they
occur, and get equal rows. Fewer rows than entries give smaller codebooks. A sum of errors that no long
holds is null. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of an entry's coordinate in the approximation.
CELL_BITS = 3
#: Scaled components lie within this, so that squared distances of 64 components fit a long.
LIMIT = 1 << 24
BATCH_ROWS = 8_192


class Approximation:
    """One part's codebook (entries x width, integers) as cells and their bounds."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = np.asarray(entries, np.int64)
        self.cells = np.empty(self.entries.shape, np.int64)
        self.bounds = []  # for each coordinate the least and greatest value in each cell
        for j, x in enumerate(self.entries.T):
            ranked = np.unique(x)
            cuts = ranked[np.linspace(0, len(ranked), min(1 << bits, len(ranked)) + 1).astype(int)[1:-1]]
            self.cells[:, j] = np.searchsorted(cuts, x, side="right")
            members = [x[self.cells[:, j] == c] for c in range(len(cuts) + 1)]
            self.bounds.append((np.array([m.min() for m in members]), np.array([m.max() for m in members])))

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """parts x entries: whether the bounds leave the entry in the running."""
        low = np.zeros((len(parts), len(self.entries)), np.int64)
        high = low.copy()
        for j, (lo, hi) in enumerate(self.bounds):
            q = parts[:, j, None]
            from_low, from_high = lo - q, q - hi
            nearest = np.maximum(np.maximum(from_low, from_high), 0)
            farthest = np.maximum(np.abs(from_low), np.abs(from_high))
            low += (nearest * nearest)[:, self.cells[:, j]]
            high += (farthest * farthest)[:, self.cells[:, j]]
        return low <= high.min(axis=1, keepdims=True)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, the lower index among equals, and its squared distance."""
        rows, cols = np.nonzero(self.candidates(parts))
        gap = parts[rows] - self.entries[cols]
        found = np.full((len(parts), len(self.entries)), np.iinfo(np.int64).max)
        found[rows, cols] = (gap * gap).sum(axis=1)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(parts)), best]


def scaled(rows: DataFrame, vector_col: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """rows with `v`, the integer vector in place of vector_col, for those whose vector is whole; and its length. Written."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = rows.where(whole)
    common_length = kept.groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    length = common_length["d"] if common_length else 0
    width = -(-length // parts) * parts
    whole_part = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    out = kept.where(F.size(x) == length).withColumn("v", F.concat(whole_part, F.array_repeat(F.lit(0), width - length))).drop(vector_col)
    return common.materialize(out, "codes-vectors"), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def first_codebooks(vectors: DataFrame, id_col: str, width: int, parts: int, entries: int) -> list[np.ndarray]:
    rows = vectors.orderBy(F.col(id_col).asc_nulls_last(), "v").select("v").limit(entries).collect()
    first = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)
    return np.split(first, parts, axis=1)


def moved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    width, size = books[0].shape[1], len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        total, count = np.zeros((len(books), size, width), np.int64), np.zeros((len(books), size), np.int64)
        for b in batches:
            v = _matrix(b.column(0), width * len(books))
            for p, a in enumerate(near):
                own = v[:, p * width : (p + 1) * width]
                best, _ = a.assign(own)
                count[p] += np.bincount(best, minlength=size)
                np.add.at(total[p], best, own)
        at = np.argwhere(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[tuple(at.T)], pa.int64()), pa.array(list(total[tuple(at.T)]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"]
        )

    found = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
    exact = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]  # one row a task and entry
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # parts x entries rows at most
        out[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def codes(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vectors with `code` and `error` in place of v."""
    width, names = books[0].shape[1], [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        for b in batches:
            v = _matrix(b.column(len(names)), width * len(books))
            found = [a.assign(v[:, p * width : (p + 1) * width]) for p, a in enumerate(near)]
            digits = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            text = pa.array([row.tobytes().hex() for row in digits], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names))], text, pa.array(sum(e for _, e in found), pa.int64())], [*names, "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select(*names, "v").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "code string, error long"]))


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label: a row for each kept row."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    vectors, width = scaled(rows, "x", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    books = first_codebooks(vectors, "vec_id", width, parts, entries)
    if not len(books[0]) or not width:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, label long")
    for _ in range(rounds):
        books = moved(vectors, books)
    flat = ",".join(str(int(x)) for b in books for e in b for x in e)
    coded = common.materialize(codes(vectors, books).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("-"))), "codes-coded")
    by_label = common.materialize(coded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.try_sum("error").alias("label_error")), "codes-labels")
    out = common.join_groups(coded, by_label, "key", "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256"), "label")


def compress_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same rows over embeddings(vec_id, embedding, label) of equal lengths that 8 divides."""
    near = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    best = lambda k: (
        f"a{k} AS (SELECT p.row, p.part, any_value(p.v) AS v, arg_min(c.entry, ({near}, c.entry)) AS entry, min({near}) AS dist FROM parts p JOIN c{k} c USING (part) GROUP BY p.row, p.part)"
    )
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT row, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM kept CROSS JOIN range(8) r(part))",
        "c0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 16)",
        best(0),
    ]
    for k in range(rounds):
        steps.append(f"m{k} AS (SELECT part, entry, list(m ORDER BY j) AS v FROM (SELECT part, entry, j, CAST(floor(sum(v[j + 1]) / count(*)) AS BIGINT) AS m FROM a{k} CROSS JOIN range(64) r(j) WHERE j < len(v) GROUP BY part, entry, j) GROUP BY part, entry)")
        steps.append(f"c{k + 1} AS (SELECT part, entry, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (part, entry))")
        steps.append(best(k + 1))
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY row)")
    return f"WITH {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, CAST(label AS BIGINT) AS label FROM coded JOIN kept USING (row), digest"
