"""Exact top-k inner-product search by distributed histogram selection.

Queries are taken in blocks of bounded size. For one block every candidate is scored, and each query's histogram of
scores is refined, range by range, until its k-th value is known exactly. A last pass keeps the scores above that value
and, of the scores equal to it, the smallest ids. Each task sends a few bins or rows a query, however many candidates it
scored: bins below a task's own k-th score cannot hold the global k-th score and are left out without loss.

Scores are exact integers for all finite vectors. Products of vectors whose length allows it are taken in doubles (every
sum below 2^52), larger ones in 64-bit integers (below 2^62), the rest in Python's integers. Where a block meets larger
ones, histograms are over doubles nearest to the scores, which keep the order, and ties among these are told apart by
the integers in full. A score beyond a long is shown as the nearest long; its rank is that of the integer.

Odd input: a vector that is null, empty or holds a null or non-finite component, and a row with a null id, take no part.
A query scores only candidates of its own length. Rows with the query's own id are not its candidates; a query id that
occurs in several rows is searched once, with the smallest of its vectors; repeated candidate rows are ranked one by one.
Fewer than k candidates give fewer rows. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.plans.lineage import place

K = 5
CHOSEN = "query_id long, vec_id long, score long, exact binary"
#: Queries of a block, and bytes of their vectors, at most.
BLOCK, BLOCK_BYTES = 4_096, 32_000_000
BINS = 256
#: Candidates scored at once in a task, times the queries of a block.
CELLS = 4_000_000
#: Lengths of vectors below which products of two fit doubles (2^52) and 64-bit integers (2^62).
SMALL, MIDDLE = 2.0**26, 2.0**31
#: Exact scores are compared as bytes: shifted to positive numbers of this many bytes (components go up to 2^1032).
WIDE_BYTES = 272


def vectors_of(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length in a batch of (id, array of doubles); bad rows are left out."""
    ids, lists = batch.column(0), batch.column(1)
    good = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool) & np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(good)
    if not len(rows):
        return
    lists, key = lists.take(pa.array(rows)), ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN here
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    for d in np.unique(n[n > 0]):
        at = np.flatnonzero(n == d)
        x = flat[start[at][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            yield key[at[ok]], x[ok]


def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x), exact in doubles where that is finite, and the lengths of the rows (infinite if beyond doubles)."""
    with np.errstate(over="ignore"):
        z = np.floor(256.0 * x)
        return z, np.sqrt((z * z).sum(axis=1))


def _kind(length: np.ndarray) -> np.ndarray:
    """0: small, 1: middle, 2: beyond."""
    return (length >= SMALL).astype(np.int64) + (length >= MIDDLE)


def _integers(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python's integers; z is the same in doubles, where it is finite."""
    whole_part = [int(b) if np.isfinite(b) else 256 * int(a) for a, b in zip(x.ravel().tolist(), z.ravel().tolist(), strict=True)]
    return np.array(whole_part, object).reshape(x.shape)


def _nearest(s: np.ndarray) -> np.ndarray:
    """Doubles nearest to integers, in the same order; what is beyond them becomes the largest."""

    def one(v: int) -> float:
        try:
            return float(v)
        except OverflowError:
            return np.finfo(float).max * (1 if v > 0 else -1)

    return np.array([one(v) for v in s.ravel()], np.float64).reshape(s.shape) if s.dtype == object else s.astype(np.float64)


def ordered(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles."""
    bits = (x + 0.0).view(np.int64)  # no negative zero
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _long(v: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(v)))


class Block:
    """The queries of one block by vector length and size."""

    def __init__(self, table: pa.Table):
        ids: dict[tuple[int, int], list] = {}
        rows: dict[tuple[int, int], list] = {}
        for batch in table.to_batches():
            for key, x in vectors_of(batch):
                kind = _kind(whole(x)[1])
                for c in np.unique(kind):
                    ids.setdefault((x.shape[1], int(c)), []).append(key[kind == c])
                    rows.setdefault((x.shape[1], int(c)), []).append(x[kind == c])
        order = sorted(ids)
        self.ids = {g: np.concatenate(ids[g]) for g in order}
        self.rows = {g: np.concatenate(rows[g]) for g in order}
        ends = np.cumsum([0, *(len(self.ids[g]) for g in order)]).tolist()
        self.at = dict(zip(order, ends, strict=False))
        self.n = ends[-1]

    def key_bounds(self, longest: dict[int, float], wide: bool) -> np.ndarray:
        """What no key of a query's scores exceeds, up or down."""
        if wide:
            return np.full(self.n, int(ordered(np.array([np.finfo(float).max]))[0]), np.int64)
        return np.concatenate([np.ceil(whole(x)[1] * longest.get(d, 0.0)) + 1 for (d, _), x in self.rows.items()]).astype(np.int64)

    def scores(self, batches):
        """(first query number, query ids, candidate ids, exact integer scores as a queries x candidates matrix)."""
        own = {g: whole(x)[0] for g, x in self.rows.items()}
        for batch in batches:
            for key, x in vectors_of(batch):
                z, length = whole(x)
                kind = _kind(length)
                for (d, c), ids in self.ids.items():
                    if d != x.shape[1]:
                        continue
                    for e in np.unique(kind):
                        at, worst = np.flatnonzero(kind == e), max(c, int(e))
                        step = max(1, CELLS // len(ids) // (1 if worst < 2 else 16))
                        for i in range(0, len(at), step):
                            j = at[i : i + step]
                            if worst == 0:
                                s = own[d, c] @ z[j].T
                            elif worst == 1:
                                s = own[d, c].astype(np.int64) @ z[j].astype(np.int64).T
                            else:
                                s = _integers(self.rows[d, c], own[d, c]) @ _integers(x[j], z[j]).T
                            yield self.at[d, c], ids, key[j], s


def keys_of(s: np.ndarray, wide: bool) -> np.ndarray:
    """64-bit integers in the order of the scores; equal ones of unequal scores only if wide."""
    return ordered(_nearest(s)) if wide else s.astype(np.int64)


def _norms(batches):
    most: dict[int, float] = {}
    for batch in batches:
        for _, x in vectors_of(batch):
            d = x.shape[1]
            most[d] = max(most.get(d, 0.0), float(whole(x)[1].max()))
    yield pa.RecordBatch.from_pydict({"d": pa.array(list(most), pa.int64()), "m": pa.array(list(most.values()), pa.float64())})


def _histogram(block, wide: bool, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, need: np.ndarray):
    """Counts of the keys in [lo, hi], in bins of the given widths; bins below the one with the task's own k-th are left out."""

    def run(batches):
        own = block.value
        hist = np.zeros((own.n, BINS), np.int64)
        for at, qids, key, s in own.scores(batches):
            q, k = len(qids), keys_of(s, wide)
            low, high = lo[at : at + q, None], hi[at : at + q, None]
            row, col = np.nonzero((k >= low) & (k <= high) & (qids[:, None] != key[None, :]))
            # differences of keys may need 64 bits without a sign
            bins = (k[row, col].view(np.uint64) - low[row, 0].view(np.uint64)) // width[at : at + q][row]
            hist[at : at + q] += np.bincount(row * BINS + bins.astype(np.int64), minlength=q * BINS).reshape(q, BINS)
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist  # in higher bins of this task
        row, col = np.nonzero((hist > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_pydict({"q": pa.array(row, pa.int64()), "b": pa.array(col, pa.int64()), "c": pa.array(hist[row, col], pa.int64())})

    return run


def _select(block, wide: bool, lo: np.ndarray, k: int):
    """Every score whose key is above the k-th, and of those of the same key the task's best, as many as may be wanted."""

    def rows(found: list[tuple[int, int, int]]):
        exact = pa.array([(s + (1 << (8 * WIDE_BYTES - 1))).to_bytes(WIDE_BYTES, "big") if wide else b"" for *_, s in found], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([_long(f[2]) for f in found], pa.int64()), exact], ["query_id", "vec_id", "score", "exact"])

    def run(batches):
        own = block.value
        ties: dict[int, list[tuple[int, int, int]]] = {}
        for at, qids, key, s in own.scores(batches):
            q, keys = len(qids), keys_of(s, wide)
            v = lo[at : at + q, None]
            other = qids[:, None] != key[None, :]
            row, col = np.nonzero((keys > v) & other)
            if len(row):
                yield rows([(a, b, int(c)) for a, b, c in zip(qids[row].tolist(), key[col].tolist(), s[row, col].tolist(), strict=True)])
            row, col = np.nonzero((keys == v) & other)
            if not wide:  # equal scores: each query's smallest ids of this step
                order = np.lexsort((key[col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
            for r, i, c in zip(row.tolist(), key[col].tolist(), s[row, col].tolist(), strict=True):
                ties.setdefault(r + at, []).append((-int(c), i, int(qids[r])))
            for r in np.unique(row) + at:
                ties[int(r)] = sorted(ties[int(r)])[:k]
        yield rows([(q, i, -c) for best in ties.values() for c, i, q in best])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over floor(256 * x), ties to smaller ids."""
    spark = vectors.sparkSession
    pair = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    everything = pair(vectors)
    asked = pair(queries).filter("i IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))").groupBy("i").agg(F.min("v").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-(size.bytes or 0) // BLOCK_BYTES))
    longest = {r.d: r.m for r in everything.mapInArrow(_norms, "d long, m double").groupBy("d").agg(F.max("m").alias("m")).collect()}
    found, results = None, place(spark, "chosen")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        own = Block(part.toArrow())  # a block of bounded size
        if not own.n:
            continue
        wide = any(c or longest.get(d, 0.0) >= SMALL for d, c in own.ids)
        sent = spark.sparkContext.broadcast(own)  # bounded by BLOCK and BLOCK_BYTES
        bound = own.key_bounds(longest, wide)
        lo, hi, need = -bound, bound.copy(), np.full(own.n, k)
        while (hi > lo).any():
            width = (hi.view(np.uint64) - lo.view(np.uint64)) // np.uint64(BINS) + np.uint64(1)
            counts = everything.mapInArrow(_histogram(sent, wide, lo, hi, width, need), "q long, b long, c long").groupBy("q", "b").agg(F.sum("c").alias("c"))
            wanted = spark.createDataFrame(pa.table({"q": np.arange(own.n), "need": need}))
            down = W.partitionBy("q").orderBy(F.desc("b"))
            here = (
                counts.withColumn("upto", F.sum("c").over(down)).join(F.broadcast(wanted), "q")  # one row a query of the block
                .filter("upto >= need AND upto - c < need")
                .select("q", "b", (F.col("need") - (F.col("upto") - F.col("c"))).alias("need"))
                .toArrow()
            )
            q, bins = here["q"].to_numpy(), here["b"].to_numpy()
            few = np.ones(own.n, bool)  # fewer candidates than k: all are wanted
            few[q] = False
            low = lo[q] + (bins.astype(np.uint64) * width[q]).view(np.int64)
            # the bin's upper end, unless that is beyond the range's
            left = hi[q].view(np.uint64) - low.view(np.uint64)
            hi[q] = low + np.minimum(left, width[q] - np.uint64(1)).view(np.int64)
            lo[q], need[q] = low, here["need"].to_numpy()
            hi[few] = lo[few] = -bound[few] - 1
        chosen = everything.mapInArrow(_select(sent, wide, lo, k), CHOSEN)
        if blocks == 1:
            found = chosen
        else:  # each block once, all in one table
            chosen.write.mode("append").parquet(results)
            sent.destroy()
            found = spark.read.schema(CHOSEN).parquet(results)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_histogram_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each one whose vec_id is divisible by 50."""
    every = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(every, every.filter(F.col("vec_id") % 50 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
