"""A sentinel over arriving files: each batch is appended to the stored cases, and new spikes become alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from casemill.functions.roles import RoleMap
from casemill.operators import reports, signals, states
from casemill.plans.lineage import cut

ALERTS = "area string, category string, baseline_daily double, recent_daily double, pct_change double, z_score double, batch long"
GROUPS = ["area", "category"]


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def process(batch: DataFrame, batch_id: int, stored: str, alerts: str, roles: RoleMap, z_threshold: float = 3.0) -> None:
    """Appends a batch's new cases and the alerts that they raise; a repeated batch changes nothing.

    Cases are new by their ids: null ids and ids that recur within the batch stay, as in any append. Each batch writes a
    partition of its own, of cases and of their daily counts, so that it can be written again, and spikes are found from
    the daily counts. Stored cases are not read: their ids are in an index of hash buckets beside them, which is never
    shuffled, and of which a batch of few ids reads only the buckets and parts that may hold them.
    """
    spark = batch.sparkSession
    daily_path, id_col = f"{stored.rstrip('/')}_daily", roles.first("id")
    index, empty = states.open_index(spark, f"{stored.rstrip('/')}_ids", batch.schema[id_col].dataType.simpleString())
    if empty and (old := stored_or_none(spark, stored)) is not None:  # cases from before there was an index
        states.store_ids(old, id_col, index, batch=F.col("batch"))
    # a batch that is repeated must not find its own rows stored
    new = cut(states.new_ids(batch, id_col, index, but_batch=batch_id))
    _write(new, batch_id, stored)
    states.store_ids(new, id_col, index, batch=batch_id)
    kept = stored_or_none(spark, stored)
    if kept is None:  # nothing yet
        return
    mine = kept.filter(F.col("batch") == batch_id)
    groups = {"area": roles.area, "category": roles.first("category")}
    _write(signals.daily_counts(mine.select(*batch.columns), roles.time, groups), batch_id, daily_path)
    counts = stored_or_none(spark, daily_path)
    if counts is None:
        return
    daily = counts.groupBy(*GROUPS, "day").agg(F.sum("n").alias("n"))
    known = stored_or_none(spark, alerts)
    known = spark.createDataFrame([], ALERTS) if known is None else known.filter(F.col("batch") != batch_id)
    _write(reports.new_alerts(daily, GROUPS, known, z_threshold=z_threshold), batch_id, alerts)


def _write(df: DataFrame, batch_id: int, path: str) -> None:
    """Replaces the batch's own partition (of whatever size; an empty one is none)."""
    df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def start(spark: SparkSession, incoming: str, schema: StructType | str, stored: str, alerts: str, checkpoint: str, roles: RoleMap, every: str | None = "6 hours", z_threshold: float = 3.0, files: int | None = None) -> StreamingQuery:
    """Watches a folder of Parquet files; every=None: works off what is there and stops. files: those of a batch at most."""
    reader = spark.readStream.schema(schema)
    source = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(incoming)
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: process(df, i, stored, alerts, roles, z_threshold))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
