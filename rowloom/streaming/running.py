"""Running statistics over a stream of files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lowrank, quantiles, sampling
from ..sources.shared import new_folder

#: Triggers after which the parts of a state are merged into one.
PARTS = 8


def running_stats(spark: SparkSession, folder: str, schema, key: str, value: str, per_trigger: int = 1, checkpoint: str | None = None) -> DataFrame:
    """key, n, s, q after all files were read: sums are the state, so a restart from the checkpoint goes on where it was.

    Each trigger's totals replace those before in a folder of their own; the last one's are the result."""
    base = checkpoint or new_folder(spark, "running")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    sums = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/totals/trigger={number}")

    writer = sums.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/totals")
    return rows.join(rows.agg(F.max("trigger").alias("trigger")), "trigger", "left_semi").drop("trigger")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time counts by type; works on streams and on tables."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stream_windows(spark: SparkSession, folder: str, schema, width: str = "1 hour", late: str = "10 minutes", per_trigger: int = 1, checkpoint: str | None = None) -> DataFrame:
    """window, event_type, n, total after all files were read: each trigger's windows replace those before, so nothing that comes late is lost."""
    base = checkpoint or new_folder(spark, "windows")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/windows/trigger={number}")

    writer = windowed_counts(stream, width, late).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/windows")
    return rows.join(rows.agg(F.max("trigger").alias("trigger")), "trigger", "left_semi").drop("trigger")


def running_quantiles(spark: SparkSession, folder: str, schema, key: str, value: str, per_trigger: int = 1, checkpoint: str | None = None, size: int = quantiles.SIZE) -> DataFrame:
    """key, sketch after all files were read. Each trigger adds its own sketches as a part; a trigger that is run
    again replaces its part, so a restart from the checkpoint counts no file twice. Parts of earlier triggers are merged every PARTS triggers."""
    base = checkpoint or new_folder(spark, "quantiles")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        own = quantiles.sketches(batch, key, value, size)
        if number % PARTS == PARTS - 1:  # all so far in one part, which stands for the ones before it
            own = quantiles.merged(own.unionByName(_parts(spark, base, key, number)), key, size) if number else own
        own.write.mode("overwrite").parquet(f"{base}/parts/upto={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return quantiles.merged(_parts(spark, base, key, None), key, size)


def _parts(spark: SparkSession, base: str, key: str, before: int | None) -> DataFrame:
    """The last part that stands for all before it, and those after it; below trigger `before` if that is given."""
    parts = spark.read.parquet(f"{base}/parts")
    if before is not None:
        parts = parts.where(F.col("upto") < before)
    top = parts.agg(F.max("upto")).first()[0]
    full = -1 if top is None else (top + 1) // PARTS * PARTS - 1
    return parts.where(F.col("upto") >= full).select(key, "sketch")


def running_svd(spark: SparkSession, folder: str, schema, genes: list, k: int, per_trigger: int = 1, checkpoint: str | None = None, correct: bool = True) -> lowrank.Fit:
    """The merged fit of a stream of files of whole cells (cell_id, gene_id, x). Each trigger fits its own cells and merges that with the
    state of the trigger before; a trigger that is run again starts from the same state, so a restart equals one pass."""
    base = checkpoint or new_folder(spark, "svd")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        n = batch.select("cell_id").distinct().count()
        own = lowrank.fit(lowrank.sparse_rows(batch, genes), genes, n, k, correct, seed=number) if n else lowrank.Fit(np.zeros((0, len(genes))), np.zeros(0), np.zeros(len(genes)), genes, 0, 0.0)
        if number:
            own = lowrank.merge(lowrank.load(spark, f"{base}/state{number - 1}"), own, k, correct)
        lowrank.save(spark, own, f"{base}/state{number}")
        spark.createDataFrame([(number,)], "done long").coalesce(1).write.mode("overwrite").parquet(f"{base}/done/trigger={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{base}/done").agg(F.max("done")).first()[0]
    return lowrank.load(spark, f"{base}/state{last}")


def running_sample(spark: SparkSession, folder: str, schema, key: str, most: int, seed: int, group: str | None = None, per_trigger: int = 1, checkpoint: str | None = None) -> DataFrame:
    """A uniform sample of `most` rows a group over all files: the state is the sample so far, and each trigger samples that and its own
    rows. It is the batch sample of the same keys, whatever the files' order and the restarts."""
    base = checkpoint or new_folder(spark, "sample")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        if number:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{base}/state{number - 1}"))
        sampling.priority_sample(batch, key, most, seed, group).write.mode("overwrite").parquet(f"{base}/state{number}")
        spark.createDataFrame([(number,)], "done long").coalesce(1).write.mode("overwrite").parquet(f"{base}/done/trigger={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{base}/done").agg(F.max("done")).first()[0]
    return spark.read.parquet(f"{base}/state{last}")


def running_passes(spark: SparkSession, folder: str, schema, passes: list[tuple[Callable[[DataFrame, DataFrame | None], DataFrame], Callable[[DataFrame], DataFrame]]], per_trigger: int = 1, checkpoint: str | None = None) -> DataFrame:
    """Several passes over one stream of files, each with the result of the pass before.

    A pass is (part, result): part(batch, before) gives mergeable rows of a trigger, result(all parts) what the next pass gets. Parts are
    kept by trigger, so a restart goes on in the pass and at the file where it was; files that come later are seen by passes that are not done."""
    base, before = checkpoint or new_folder(spark, "passes"), None
    for k, (part, result) in enumerate(passes):
        own = f"{base}/pass{k}"
        try:
            before = spark.read.parquet(f"{own}/result")
            continue
        except AnalysisException:  # not done yet
            pass
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)

        def keep(batch: DataFrame, number: int, own: str = own, part: Callable = part, before: DataFrame | None = before) -> None:
            part(batch, before).write.mode("overwrite").parquet(f"{own}/parts/trigger={number}")

        stream.writeStream.option("checkpointLocation", f"{own}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        result(spark.read.parquet(f"{own}/parts").drop("trigger")).write.mode("overwrite").parquet(f"{own}/result")
        before = spark.read.parquet(f"{own}/result")
    return before
