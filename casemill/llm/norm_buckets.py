"""Ranked lexical search over norm buckets of impact vectors.

A document is a vector of impacts, an integer for each term of the queries that it holds, and a query is a vector of term
weights; a score is their inner product. Queries go out in blocks of bounded size. For a block, one scan counts documents,
terms and the documents that hold each term of the block, a second one writes each document's impact vector and length.

Vectors are taken in the order of their lengths, longest first, in buckets whose lengths differ by a factor of RATIO; a
few neighbouring buckets are searched at once, twice as many rows each time. By the Cauchy-Schwarz inequality no vector
of a bucket scores more than the query's length times the bucket's largest, so once a query has k results, it is done
with all buckets that cannot reach its k-th score. Inside a bucket, coordinates bound each vector: what the query's
heaviest terms give exactly, and the product of the two remaining lengths for the rest. Vectors that pass are scored in
64-bit integers over all terms. Bounds are in doubles with slack for rounding, so no result is lost; vectors that may tie
with the k-th stay. A task sends its k best for each query, whatever number it has scored.

Odd input: a null text has no term and is no document; a null doc_id comes after all others of its score; repeated rows
are ranked one by one. Items of a null id take no part, rows of one item_id are one item with the terms of all of them;
an item without a term, or with none that a document holds, has no row. Very long texts are split piece by piece. Empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.plans.lineage import cut, place, stored

K = 10
#: Items of a block, and bytes of their terms, at most (an item is never split).
BLOCK, BLOCK_BYTES = 4_096, 8_000_000
#: Between the longest and the shortest vector of a bucket; the share of all vectors that is searched first; heaviest terms that bound a score.
RATIO, FIRST, FOCUS = 1.25, 1 / 64, 6
#: Bytes of text that are split at once, vectors that are searched at once.
PIECE, STEP = 1_000_000, 4_096
SLACK = 1e-9
#: Terms are runs of ASCII letters, digits and all other characters beyond ASCII; A-Z are taken as a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: str | None):
    """Lists of a text's terms, as bytes."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Block:
    """Items of a block: their ids, and their terms as numbers."""

    def __init__(self, table: pa.Table):
        terms = table["terms"].to_pylist()
        self.items: list[int] = table["item_id"].to_pylist()
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
        self.of = [np.array(sorted(self.vocabulary[t] for t in own), np.int64) for own in terms]


def _items(batches):
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = sorted({t for piece in pieces(text) for t in piece})
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([item], pa.int64()), "terms": pa.array([terms], pa.list_(pa.binary()))})


def _held(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's number of terms, and which of the vocabulary it holds how often."""
    n, found = 0, []
    for piece in pieces(text):
        n += len(piece)
        own = np.array([i for i in map(vocabulary.get, piece) if i is not None], np.int64)
        found.append(np.unique(own, return_counts=True))
    if len(found) == 1:
        return n, *found[0]
    if not found:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    tf = np.zeros(len(terms), np.int64)
    np.add.at(tf, at, np.concatenate([f[1] for f in found]))
    return n, terms, tf


def _counts(sent):
    """Each task's documents (term -1), terms with repeats (-2) and documents that hold each term of the block."""

    def run(batches):
        vocabulary = sent.value.vocabulary
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, terms, _ = _held(text.as_py(), vocabulary)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                df[terms] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, -2, *at.tolist()], pa.int64()), "n": pa.array([n_docs, n_terms, *df[at].tolist()], pa.int64())})

    return run


def _vectors(sent, weights: np.ndarray, n_docs: int, n_terms: int):
    """Each document's impacts of the block's terms that weigh anything, and the vector's length."""

    def run(batches):
        vocabulary = sent.value.vocabulary
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                ids, norms, held, impacts = [], [], [], []
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    n, terms, tf = _held(text.as_py(), vocabulary)
                    m = 10 + 90 * n * n_docs // n_terms if n else 10
                    impact = 1_000_000_000 * tf // (1_000 * tf + 8 * m)
                    counts = (impact > 0) & (weights[terms] > 0)
                    if counts.any():
                        ids.append(key.as_py())
                        held.append(terms[counts].astype(np.int32))
                        impacts.append(impact[counts].astype(np.int32))  # below 1,000,000
                        norms.append(math.sqrt((impacts[-1].astype(np.float64) ** 2).sum()))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "norm": pa.array(norms, pa.float64()), "terms": pa.array(held, pa.list_(pa.int32())), "impacts": pa.array(impacts, pa.list_(pa.int32()))})

    return run


class Best:
    """The k best (score, id) so far, higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.null, null)))
        at = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[at], ids[at], null[at]

    def least(self) -> int:
        """What a score must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def _search(sent, weights: np.ndarray, least: np.ndarray, k: int):
    """Each task's k best for each query that isn't done (least: the score it must reach, or -1 where it is done)."""

    def run(batches):
        own = sent.value
        best: dict[int, Best] = {q: Best(k) for q in np.flatnonzero(least >= 0).tolist()}
        plan = {}
        for q in best:
            terms = own.of[q][weights[own.of[q]] > 0]
            terms = terms[np.argsort(-weights[terms], kind="stable")]
            w = weights[terms]
            plan[q] = terms, w, math.sqrt(float((w.astype(np.float64) ** 2).sum())), math.sqrt(float((w[FOCUS:].astype(np.float64) ** 2).sum()))
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                n, norm, null = batch.num_rows, batch.column(1).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                lists = batch.column(2)
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                term, impact = (batch.column(c).flatten().to_numpy() for c in (2, 3))
                order = np.argsort(term, kind="stable")
                term, row, impact = term[order], row[order], impact[order].astype(np.int64)
                first = np.searchsorted(term, np.arange(len(own.vocabulary) + 1))
                longest = norm.max() if n else 0.0
                for q, (terms, w, length, rest) in plan.items():
                    must = max(int(least[q]), best[q].least())
                    reach = must * (1 - SLACK)
                    if length * longest < reach or not len(terms):
                        continue
                    spans = [slice(first[t], first[t + 1]) for t in terms]
                    rows, values = [row[s] for s in spans], [impact[s] for s in spans]
                    heavy, part = np.concatenate(rows[:FOCUS]), np.concatenate(values[:FOCUS]).astype(np.float64)
                    exact = np.bincount(heavy, np.repeat(w[:FOCUS], [len(x) for x in rows[:FOCUS]]) * part, n)
                    left = np.sqrt(np.maximum(norm**2 * (1 + SLACK) - np.bincount(heavy, part**2, n), 0.0))
                    stays = (exact + rest * left >= reach) & (length * norm >= reach)
                    if not stays.any():
                        continue
                    at, of = np.concatenate(rows), np.concatenate(values) * np.repeat(w, [len(x) for x in rows])
                    keep = stays[at]
                    score = np.zeros(n, np.int64)
                    np.add.at(score, at[keep], of[keep])
                    good = np.flatnonzero(score >= must)
                    if len(good):
                        best[q].add(score[good], ids[good], null[good])
        items = [own.items[q] for q, b in best.items() for _ in b.score]
        join = lambda of, kind: np.concatenate([of(b) for b in best.values()]) if best else np.zeros(0, kind)
        docs = pa.array(join(lambda b: b.id, np.int64), pa.int64(), mask=join(lambda b: b.null, bool))
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, pa.int64()), "doc_id": docs, "score": pa.array(join(lambda b: b.score, np.int64), pa.int64())})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _steps(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """Buckets (lowest, highest) that are searched at once, longest vectors first: each time as many rows as before."""
    total, done, out = sum(sizes.values()), 0, []
    high, rows = None, 0
    for b in sorted(sizes, reverse=True):
        high = b if high is None else high
        rows += sizes[b]
        if rows >= max(done, total * FIRST):
            out.append((b, high))
            done, high, rows = done + rows, None, 0
    return out + ([(min(sizes), high)] if high is not None else [])


def _search_block(docs: DataFrame, own: Block, k: int) -> DataFrame | None:
    """The block's results: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(own)  # bounded by BLOCK and BLOCK_BYTES
    counts = docs.select("text").mapInArrow(_counts(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counts.collect()}  # a row a term of the block
    n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
    weights = np.zeros(len(own.vocabulary), np.int64)
    for term, n in df.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    if not weights.any():
        sent.destroy()
        return None
    made = docs.mapInArrow(_vectors(sent, weights, n_docs, n_terms), "doc_id long, norm double, terms array<int>, impacts array<int>")
    made = made.withColumn("bucket", F.floor(F.log("norm") / math.log(RATIO)).cast("int"))
    vectors = stored(made.sortWithinPartitions(F.desc("norm")), "impact-vectors")
    sizes = {r.bucket: r.n for r in vectors.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket: lengths are between 1 and 10^6 times a root of the terms
    lengths = np.array([math.sqrt(float((weights[t].astype(np.float64) ** 2).sum())) for t in own.of])
    least = np.ones(len(own.items), np.int64)
    number = {item: q for q, item in enumerate(own.items)}
    best = None
    for low, high in _steps(sizes):
        at = np.where(lengths * RATIO ** (high + 1) * (1 + SLACK) >= least, least, -1)  # Cauchy-Schwarz for the whole buckets
        if (at < 0).all():
            break
        here = vectors.filter(F.col("bucket").between(low, high)).select("doc_id", "norm", "terms", "impacts")
        found = here.mapInArrow(_search(sent, weights, at, k), "item_id long, doc_id long, score long")
        best = cut(_ranked(found if best is None else found.unionByName(best.drop("rank")), k))
        for r in best.filter(F.col("rank") == k).select("item_id", "score").collect():  # a row a query of the block
            least[number[r.item_id]] = r.score
    sent.destroy()
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").mapInArrow(_items, "item_id long, terms array<binary>")
    asked = cut(terms.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).filter(F.size("terms") > 0))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16)).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-(size.bytes or 0) // BLOCK_BYTES))
    results, schema = place(spark, "ranked"), "item_id long, rank int, doc_id long, score long"
    written = False
    for b in range(blocks):
        part = Block(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow())  # a block of bounded size
        found = _search_block(own, part, k) if part.items else None
        if found is not None:
            found.write.mode("append").parquet(results)
            written = True
    return spark.read.schema(schema).parquet(results) if written else spark.createDataFrame([], schema)


def op12_norm_buckets(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), whole AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), s AS (
  SELECT i.item_id, d.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len(d.terms) * whole.docs) // whole.n)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), whole GROUP BY i.item_id, d.r, d.doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
