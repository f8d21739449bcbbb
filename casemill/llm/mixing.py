"""Mix sources to target weights by Poisson replication.

A document of source s is repeated n ~ Poisson(rate_s) times, rate_s being the target share of s over its share now,
times the epochs. n comes from inverting the Poisson distribution at a uniform number hashed from the document's id, so
a rerun gives the same copies. The copies are dealt out and sorted by another hash: a global shuffle.
Only DataFrame functions are used.

Odd input: a null source is a source of its own; a null text counts as empty; a null id is replaced by the md5 of the
text; repeated rows are repeated equally; a very long text is moved like any other and never taken apart; an empty table
gives an empty result; further columns are kept (one named as ``copy_col`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.plans.lineage import cut

SEED = "mix-1"
#: Mean of one draw at most; larger rates are the sum of several independent draws, which is Poisson again.
DRAW = 16.0
#: Sources that are broadcast at most; beyond it the rates are joined by shuffle.
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts: 52 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0 to far beyond the mean."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["c"])


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = 0.5, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each source: __source, rate, draws, cdf (of one draw).

    weights: columns source, weight; without it the weight is a source's size ** power. A source without a weight gets
    none. Sizes are characters plus one a document.
    """
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        w = weights.select(F.col("source").alias("__w"), F.col("weight").cast("double"))
        sizes = sizes.join(w, F.col("__source").eqNullSafe(F.col("__w")), "left").select("__source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = cut(sizes)
    total = sizes.agg(F.sum("size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    all_size, all_weight = (F.lit(v).cast("double") for v in total)
    rate = F.lit(float(epochs)) * F.try_divide(all_size * F.col("weight"), all_weight * F.col("size"))
    return (
        sizes.select("__source", F.coalesce(rate, F.lit(0.0)).alias("rate"))
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW)).cast("int"))
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = 0.5, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """The documents, each as often as its Poisson count, in shuffled order; ``copy_col`` numbers the copies from 1."""
    rate = cut(rates(docs, weights, epochs, power, text_col, source_col))
    rate = F.broadcast(rate) if rate.count() <= BROADCAST_SOURCES else rate
    kept = [c for c in docs.columns if c != copy_col]
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string")), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(seed), F.col("__key"), j.cast("string")))
    draws = F.transform(drawn, lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    n = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(kept)], F.col(f"`{source_col}`").alias("__s"), key.alias("__key"))
    n_copies = renamed.join(rate, F.col("__s").eqNullSafe(F.col("__source")), "inner").withColumn("__n", n).filter("__n > 0")
    out = n_copies.select(*[F.col(f"d{i}") for i in range(len(kept))], "__key", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    out = out.withColumn("__at", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "__key", F.col("__copy").cast("string"))))
    out = out.repartition("__at").sortWithinPartitions("__at")  # the number of partitions is left to adaptive execution
    cols = [F.col(f"d{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*cols, *([F.col("__copy").alias(copy_col)] if copy_col else []))


def op8_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, replicated to source weights proportional to the root of the sources' sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, CAST((SELECT sum(size) FROM sizes) AS DOUBLE) * sqrt(CAST(size AS DOUBLE))
         / ((SELECT sum(sqrt(CAST(size AS DOUBLE))) FROM sizes) * size) AS rate FROM sizes
), means AS (
  SELECT source, greatest(1, ceil(rate / {DRAW}))::INT AS draws, rate / greatest(1, ceil(rate / {DRAW})) AS mean FROM rates
), cdf AS (
  SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
  WHERE k < ceil(mean + 12 * sqrt(mean) + 24)
), drawn AS (
  SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS key, j
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.draws + 1)) AS t(j)
), counts AS (
  SELECT doc_id, text, lang, x.source, n_chars, key, j, count(c) AS n
  FROM (SELECT *, CAST('0x' || substr(md5('{SEED}:' || key || ':' || j), 1, 13) AS BIGINT) / {float(2**52)} AS u FROM drawn) x
  LEFT JOIN cdf ON x.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= x.u
  GROUP BY ALL
), totals AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INT) AS copy FROM totals, unnest(range(1, n + 1)) AS t(c)
"""
