"""Stored states that an append merges instead of reading what is stored: column profiles as sketches, and an index of ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.operators.profile import dtype_of

#: log2 of the registers of a distinct sketch (a standard error of 0.8 %); the accuracy of a quantile sketch.
REGISTERS, ACCURACY = 14, 400
#: Buckets of an id index, and incoming ids that are looked up one by one at most.
BUCKETS, FEW_IDS = 64, 1_000
QUANTILES = (0.25, 0.5, 0.75)


def profile_state(df: DataFrame, table: str) -> DataFrame:
    """table, column, position, dtype, row_count, present, lo, hi, total, distinct, quantiles: a row a column, from one pass.

    Counts, ends and totals are exact, the last two are sketches. lo and hi are numbers; times count as seconds since
    1970. A column that cannot be sketched (a map) counts as its JSON text.
    """
    rows, aggs = [], [F.count("*").alias("rows")]
    none = lambda kind: F.lit(None).cast(kind)
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), dtype_of(f.dataType)
        text = F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else c.cast("string")
        number = c.cast("double") if kind in ("integer", "float") else F.unix_timestamp(c.cast("timestamp")).cast("double") if kind in ("timestamp", "date") else None
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(F.when(c.isNotNull(), text), F.lit(REGISTERS)).alias(f"d{i}")]
        if number is not None:
            aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.kll_sketch_agg_double(number, F.lit(ACCURACY)).alias(f"q{i}")]
        aggs += [F.sum(number).alias(f"t{i}")] if kind in ("integer", "float") else []
        own = lambda name, kind, there: F.col(name) if there else none(kind)
        rows.append(F.struct(
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(kind).alias("dtype"), F.col("rows").alias("row_count"), F.col(f"n{i}").alias("present"),
            own(f"lo{i}", "double", number is not None).alias("lo"), own(f"hi{i}", "double", number is not None).alias("hi"), own(f"t{i}", "double", kind in ("integer", "float")).alias("total"),
            F.col(f"d{i}").alias("distinct"), own(f"q{i}", "binary", number is not None).alias("quantiles"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all tables' rows together, from their states; a column that some lack counts as missing there."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)
    return every.groupBy("table", "column").agg(
        F.min("position").alias("position"), F.first("dtype").alias("dtype"), F.sum("row_count").alias("row_count"), F.sum("present").alias("present"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("total").alias("total"), F.hll_union_agg("distinct", F.lit(True)).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def stats_of(state: DataFrame) -> DataFrame:
    """What column_stats gives, and quartiles, from a state."""
    nulls = F.when(F.col("row_count") > 0, F.round(1 - F.col("present") / F.col("row_count"), 4)).otherwise(0.0)
    some = (F.col("present") > 0) & F.col("lo").isNotNull()
    at = [F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"q{round(q * 100)}") for q in QUANTILES]
    mean = F.round(F.try_divide("total", "present"), 4).alias("mean")
    return state.select("table", "column", "position", "dtype", "row_count", nulls.alias("null_fraction"), F.hll_sketch_estimate("distinct").alias("distinct"), "lo", "hi", mean, *at)


def between_percentiles(df: DataFrame, values: dict[str, float | None], low: float, high: float) -> DataFrame:
    """column, between: whether each column's value lies between two of its exact percentiles (interpolated; nulls left out).

    Ranks are counted instead of values kept: how many lie below and up to the value, and the neighbours on either side.
    """
    aggs, rows = [], []
    for i, (c, value) in enumerate(values.items()):
        v, q = F.col(f"`{c}`").cast("double"), F.lit(value).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v < q).alias(f"less{i}"), F.count_if(v <= q).alias(f"upto{i}"), F.max(F.when(v <= q, v)).alias(f"lo{i}"), F.min(F.when(v > q, v)).alias(f"hi{i}")]
        less, upto = F.col(f"less{i}"), F.col(f"upto{i}")

        def at(p, i=i):
            pos = p * (F.col(f"n{i}") - 1)
            a, b = F.floor(pos), F.ceil(pos)
            return a, b, (b - pos) * F.col(f"lo{i}") + (pos - a) * F.col(f"hi{i}")  # between the neighbours

        (a, b, mixed), (a2, b2, mixed2) = at(low), at(high)
        over = F.when(b < upto, True).when(a >= upto, False).otherwise(q >= mixed)
        under = F.when(a2 >= less, True).when(b2 < upto, False).otherwise(q <= mixed2)
        rows.append(F.struct(F.lit(c).alias("column"), F.when(q.isNotNull() & (F.col(f"n{i}") > 0), over & under).alias("between")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def open_index(spark: SparkSession, path: str, id_type: str, buckets: int = BUCKETS) -> tuple[str, bool]:
    """An index of ids in a folder as a table of the catalogue, and whether it is new. It outlives the session with the folder."""
    name = f"ids_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        options = "OPTIONS ('parquet.bloom.filter.enabled#id' 'true', 'parquet.bloom.filter.adaptive.enabled' 'true')"
        spark.sql(f"CREATE TABLE {name} (id {id_type}, batch BIGINT) USING parquet {options} CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name, spark.table(name).isEmpty()


def store_ids(df: DataFrame, id_col: str, index: str, buckets: int = BUCKETS, batch: Column | int = 0) -> None:
    """Adds a table's ids to the index (a table of the catalogue): in hash buckets, sorted, with a Bloom filter for each part."""
    batch = F.lit(batch) if isinstance(batch, int) else batch
    ids = df.select(F.col(id_col).alias("id"), batch.cast("long").alias("batch")).filter("id IS NOT NULL")
    writer = ids.repartition(buckets, "id").distinct().write.mode("append").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.bucketBy(buckets, "id").sortBy("id").saveAsTable(index)


def new_ids(incoming: DataFrame, id_col: str, index: str, but_batch: int | None = None) -> DataFrame:
    """Incoming rows whose id isn't in the index (or only from one batch); null ids and repetitions among the incoming rows stay.

    The index is never shuffled: incoming rows are brought to its buckets. Of a few incoming ids only the buckets they
    fall into are read, and of these only the parts whose Bloom filters may hold them.
    """
    known = incoming.sparkSession.table(index)
    known = (known if but_batch is None else known.filter(F.col("batch") != but_batch)).select(F.col("id").alias("__id"))
    few = [r[0] for r in incoming.select(id_col).filter(F.col(id_col).isNotNull()).distinct().limit(FEW_IDS + 1).collect()]
    if len(few) <= FEW_IDS:
        known = known.filter(F.col("__id").isin(few))
    return incoming.join(known.hint("merge"), incoming[id_col] == F.col("__id"), "left_anti")
