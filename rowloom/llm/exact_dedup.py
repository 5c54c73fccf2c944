"""Exact duplicates through a log-structured merge index, with DataFrame functions only.

Memtables are slices of the rows. Each flushes one run sorted by digest, with the best row and the row
count of each digest, and a bitmap filter. Every digest of a run then asks the filters of the other
runs: what none of them may hold and was met once is in no group, and takes no part in the
compaction, which merges the rest of the runs by digest and keeps the smallest identifier. Digests met more than
once are hits: the smallest and largest normalised text of each must be the same bytes. A digest
that fails this is split by the text itself.

Filters have FILTER_BITS bits a row, so a digest passes wrongly about once in FILTER_BITS a run; passing only
costs its share of the compaction. Filters stand in buckets that digests ask by a join; (counted) small ones are
broadcast for it, and larger ones meet the digests of their bucket, some thousand rows, by a shuffle.

Nulls: a null text counts as empty; a null id is a row of its own and sorts last among ties.
Repeated rows, also with one id, are copies of which one is kept. Very long texts are digested and compared whole.
Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
#: Bits of a run's filter for each of its rows; they stand in buckets of BUCKET_BITS.
FILTER_BITS, BUCKET_BITS = 16, 32_768
#: Bytes of all filters up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: What a run's files hold; an empty memtable writes none.
RUN_SCHEMA = "digest long, best struct<short:int,no_id:boolean,doc_id:long,uid:long>, n long, run int"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """Runs in the shared folder. `flush` adds runs and their filters, `compact` merges what may be in several, `probe` asks the filters first."""

    def __init__(self, spark, memtables: int = 4):
        self.spark, self.memtables = spark, memtables
        self.path, self.levels, self.buckets = common.new_path(spark, "lsm"), 0, 0

    def flush(self, log: DataFrame, total: int) -> None:
        """Each memtable is a slice of the log; its rows meet by digest before they are written."""
        run = (F.pmod(F.xxhash64("uid"), F.lit(self.memtables)) + self.levels * self.memtables).cast("int")
        level = f"{self.path}/level={self.levels}"
        (
            log.groupBy(run.alias("run"), "digest")
            .agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
            .sortWithinPartitions("run", "digest")
            .write.option("compression", "zstd").parquet(level)
        )
        self.buckets = max(self.buckets, -(-FILTER_BITS * -(-total // self.memtables) // BUCKET_BITS), 1)
        self.levels += 1

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.path}/level={k}" for k in range(self.levels)])

    def _place(self) -> tuple[Column, Column]:
        bit = F.pmod("digest", F.lit(self.buckets * BUCKET_BITS))
        return F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)

    def filters(self) -> DataFrame:
        """bucket, filters: of each run that has the bucket, (run, bits)."""
        bucket, place = self._place()
        bits = self.runs().groupBy(bucket.alias("bucket"), "run").agg(F.bitmap_construct_agg(place).alias("bits"))
        return common.materialize(bits.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters")), "lsm-filters")

    def small(self) -> bool:
        return self.buckets * self.memtables * self.levels * BUCKET_BITS // 8 <= BROADCAST_BYTES

    def _beside(self, rows: DataFrame) -> DataFrame:
        """Rows with the filters of their digest's bucket."""
        filters = self.filters()
        return rows.withColumn("bucket", self._place()[0]).join(F.broadcast(filters) if self.small() else filters, "bucket")

    def _asked(self, rows: DataFrame, of_run: Column) -> Column:
        """Whether a filter of a run for which of_run(run) holds may have the row's digest; rows stand beside their bucket's filters."""
        _, place = self._place()
        at, mask = F.floor(place / 8).cast("int") + 1, F.pmod(place, F.lit(8)).cast("int")
        byte = lambda bits: F.conv(F.hex(F.substring(bits, at, F.lit(1))), 16, 10).cast("int")
        return F.exists("filters", lambda x: of_run(x["run"]) & (byte(x["bits"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), mask + 1)) != 0))

    def compact(self) -> DataFrame:
        """digest, best, n over all runs, for every digest that was met more than once (and some others)."""
        beside = self._beside(self.runs())
        rows = beside.where((F.col("n") > 1) | self._asked(beside, lambda run: run != F.col("run"))).drop("bucket", "filters")
        merged = rows.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        return common.materialize(merged.sortWithinPartitions("digest"), "lsm-compact")

    def probe(self, batch: DataFrame) -> DataFrame:
        """Rows of batch(digest, ...) that the index holds. The filters rule out most others before the runs are read."""
        beside = self._beside(batch)
        maybe = beside.where(self._asked(beside, lambda run: run.isNotNull())).drop("bucket", "filters")
        return maybe.join(self.runs().select("digest").distinct(), "digest", "left_semi")


def _rank() -> Column:
    return F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, memtables: int = 4, uid_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and `uid` if uid_col names a column that tells rows apart.

    Of equal texts the row with the most code points stays, then the smallest id, then the first
    read. `digest` maps the normalised text to a long; a weak one only costs time.
    """
    spark = docs.sparkSession
    digest = digest or F.xxhash64
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(uid_col).cast("long").alias("uid")] if uid_col else []))
    uid = F.col("uid") if uid_col else F.monotonically_increasing_id()
    texts = texts.withColumn("norm", normalised(F.col("text")))
    log = common.materialize(
        texts.select("doc_id", digest(F.col("norm")).cast("long").alias("digest"), F.length("text").alias("points"), F.sha2("norm", 256).alias("text_sha256"), uid.alias("uid")),
        "dedup-log",
    )
    total = log.count()
    index = DigestIndex(spark, memtables)
    index.flush(log, total)
    groups = index.compact()
    hits = groups.where("n > 1")
    n_hits = hits.count()
    met = texts.withColumn("digest", digest(F.col("norm")).cast("long")).join(common.broadcast_if_small(hits.select("digest"), n_hits), "digest", "left_semi")
    checked = common.materialize(met.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same")), "dedup-verified")
    differ = checked.where("not same").select("digest")
    if not differ.isEmpty():
        out = _split(texts.withColumn("uid", uid), log, hits, differ, total, digest)
    else:
        out = _assign(log, hits, total)
    return out if uid_col else out.drop("uid")


def _assign(log: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    out = common.join_groups(log, groups.select("digest", "best", "n"), "digest", "n", total)
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = F.col("best").isNull() | (F.col("best.uid") == F.col("uid"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "uid")


def _split(texts: DataFrame, log: DataFrame, hits: DataFrame, differ: DataFrame, total: int, digest) -> DataFrame:
    """Rows whose digest stands for several texts are grouped by the texts; the others stay as they are."""
    sound = _assign(log.join(differ, "digest", "left_anti"), hits.join(differ, "digest", "left_anti"), total)
    odd = texts.withColumn("points", F.length("text")).withColumn("digest", digest(F.col("norm")).cast("long"))
    odd = common.materialize(odd.join(differ, "digest", "left_semi").select("doc_id", "norm", "points", "uid", F.sha2("norm", 256).alias("text_sha256")), "dedup-odd")
    by_text = odd.groupBy("norm").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
    out = odd.join(by_text, "norm")
    return sound.unionByName(out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.uid") == F.col("uid")).alias("kept"), "text_sha256", "uid"))
