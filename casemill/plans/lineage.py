"""Cut lineage with reliable checkpoints and broadcast only what was measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast at most, as its rows take in memory.
BROADCAST_BYTES = 64_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all is one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="casemill-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet once and read again.

    Like ``cut``, but later steps read only the columns and rows they need, and the optimizer starts anew: what it has
    inferred about a checkpoint stays with it, and grows from round to round in loops.
    """
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_or_not(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows and ``most_bytes`` bytes; otherwise unhinted.

    Numbers and dates take 8 bytes, other values as many as their JSON text. ``df`` should be cheap to compute (a stored
    table or one that was cut); no more than most_rows + 1 rows of it are looked at.
    """
    fixed = ("int", "bigint", "smallint", "tinyint", "double", "float", "date", "timestamp", "timestamp_ntz", "boolean")
    wide = [c for c, t in df.dtypes if t not in fixed]
    size = F.lit(16 + 8 * len(df.columns)) + (F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))) if wide else F.lit(0))
    seen = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if seen.n <= most_rows and (seen.bytes or 0) <= most_bytes else df
