"""Toxicity severity by cumulative-link ordinal regression.

Labels say only whether a text is toxic, so grades are derived. A lexicon of words with a high log-odds ratio between
toxic and other labelled texts is counted over all training labels. A toxic training text's grade is 1, 2 or 3 by its
weight, cut at the terciles of the toxic ones (other texts: grade 0). The weight is cross-fitted: the sum, over the text's
words, of the log-odds that the other half of the training labels (by hash of the id) gives to the word's entry, so a
text's own label is not in its weight, and weights are not the counts that the features hold.
P(grade <= k) = logistic(cut_k - w.x): one weight vector, ordered cuts. Features are sparse: 1 + log of the
counts of the lexicon's entries, which are words and beginnings of words; they are counted under 64-bit hashes, and
only those that pass the tests are looked up in the toxic texts. The severity is the expected grade. The regression is fitted on at most SAMPLE
labelled rows: all, or else half of them toxic if there are so many, of each label those of the smallest hashes.
Probabilities are then put back to the shares of all training labels (Bayes: the odds of grade 1 or more change by a
factor, the grades among toxic texts don't). Lexicon and scores cover everything.

Odd input: a null text is empty; a null id has no label and belongs to fold crc32(''); null labels are left out, the
largest label of an id counts; without toxic training labels every severity is 0. Entries of equal z-scores are in
alphabetical order, which changes no score; a weight equal to a cut has the lower grade. A very long text's words are held
once, as counts of the entries it has. Repeated rows give repeated rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.lattice import fold
from casemill.llm.quality import hashed_sample
from casemill.plans.lineage import cut, small_or_not

FOLDS, HELD_OUT = 5, 0
#: The z-score of the log-odds ratio and the toxic texts that a lexicon entry needs; every entry that has them is kept.
LEAST_Z, LEAST_TEXTS = 3.0, 5
#: And the log-odds ratio: such an entry is about twelve times as frequent in toxic texts.
LEAST_ODDS = 2.5
#: Labels that are broadcast at most (12 bytes each); more meet the texts in a shuffled join.
BROADCAST_LABELS = 1_000_000
#: Labelled rows that the regression is fitted on at most.
SAMPLE = 20_000
GRADES, STEPS, RATE, DECAY = 4, 600, 0.1, 5e-4
#: A text counts as toxic from this probability of grade 1 or more.
THRESHOLD = 0.5
GATHERED = 300_000
BEGINNINGS = (3, 4, 5, 6, 7)
#: Words whose entries a worker keeps.
KEPT = 300_000
_TRIM = ".,;:!?\"'()[]{}|#$%&*+-/<=>@\\^_`~"


def entries_of_word(raw: str) -> tuple[str, ...]:
    """A lower-cased word without marks around it, and its beginnings, which inflected forms share."""
    word = raw.strip(_TRIM)
    return (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)) if word else ()


class Kept(dict):
    """What a function gives for words, kept until there are too many."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, raw: str):
        if len(self) > KEPT:
            self.clear()
        self[raw] = out = self.make(raw)
        return out


def hash_of(entry: str) -> int:
    """An entry's key while it is counted: 64 bits, so an entry of the lexicon shares it with hardly any other."""
    return xxhash.xxh3_64_intdigest(entry.encode("utf-8", "surrogatepass")) - (1 << 63)


_hashes = Kept(lambda raw: tuple(map(hash_of, entries_of_word(raw))))


def hashes_of(text: str | None) -> set[int]:
    """The hashes of the entries that a text has."""
    return set().union(*map(_hashes.__getitem__, set((text or "").lower().split())))


def _count(batches):
    """Of the entries of (text, y, half) rows: hash, texts and toxic texts of all rows (n, t) and of half 1 (n1, t1)."""
    all_of, names = Counter(), ("n", "t", "n1", "t1")
    toxic, second, toxic_second = Counter(), Counter(), Counter()
    counts = (all_of, toxic, second, toxic_second)

    def flush():
        keys = list(all_of)
        out = pa.RecordBatch.from_pydict({"h": pa.array(keys, pa.int64()), **{k: pa.array([c[h] for h in keys], pa.int64()) for k, c in zip(names, counts, strict=True)}})
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = hashes_of(text)
            for c, counts_it in zip(counts, (True, y, half, y and half), strict=True):
                if counts_it:
                    c.update(own)
            if len(all_of) > GATHERED:
                yield flush()
    yield flush()


def _written(hashes: set[int]):
    """(hash, word) of the entries of (text) rows that have one of the hashes."""

    def run(batches):
        found: set[tuple[int, str]] = set()
        known = Kept(lambda raw: tuple((h, e) for e in entries_of_word(raw) if (h := hash_of(e)) in hashes))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(*map(known.__getitem__, set((text or "").lower().split())))
        yield pa.RecordBatch.from_pydict({"h": pa.array([h for h, _ in found], pa.int64()), "word": pa.array([e for _, e in found], pa.string())})

    return run


class Ordinal:
    """A proportional-odds model over lexicon features."""

    def __init__(self, lexicon: dict[str, int], rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, odds: float = 1.0):
        """odds: those of toxic rows among all training labels by those among ``rows``."""
        self.lexicon, self.odds = lexicon, odds
        n, k = len(grades), GRADES - 1
        at = np.concatenate([np.full(len(i), r) for r, (i, _) in enumerate(rows)]).astype(np.int64) if n else np.zeros(0, np.int64)
        col = np.concatenate([i for i, _ in rows]) if n else np.zeros(0, np.int64)
        val = np.concatenate([v for _, v in rows]) if n else np.zeros(0)
        # cuts are a first one and positive gaps, so that they stay ordered
        p = [np.zeros(len(lexicon)), np.array([2.0]), np.ones(k - 1)]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        for step in range(1, STEPS + 1 if n else 1):
            _, g = self.loss(p, at, col, val, grades)
            for i in range(3):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.cuts = p[0], self._cuts(p)

    @classmethod
    def loss(cls, p, at, col, val, grades) -> tuple[float, list[np.ndarray]]:
        """The mean negative log-likelihood with its penalty, and its gradient by weights, first cut and logs of the gaps."""
        n, k, cuts = len(grades), GRADES - 1, cls._cuts(p)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
        score = np.bincount(at, weights=val * p[0][col], minlength=n)
        upper = np.where(grades < k, sig(cuts[np.minimum(grades, k - 1)] - score), 1.0)
        lower = np.where(grades > 0, sig(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        prob = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        d_score = (up - down) / n  # of the loss, by the score
        d_cut = np.bincount(np.minimum(grades, k - 1), weights=np.where(grades < k, -up, 0) / n, minlength=k)
        d_cut += np.bincount(np.maximum(grades - 1, 0), weights=np.where(grades > 0, down, 0) / n, minlength=k)
        tail = np.cumsum(d_cut[::-1])[::-1]
        penalty = DECAY / 20 * (p[0] ** 2).sum()
        return float(-np.log(prob).mean() + penalty), [np.bincount(col, weights=val * d_score[at], minlength=len(p[0])) + DECAY * p[0] / 10, tail[:1], tail[1:] * np.exp(p[2])]

    @staticmethod
    def _cuts(p) -> np.ndarray:
        return np.cumsum(np.concatenate([p[1], np.exp(p[2])]))

    def at_least(self, text: str | None, hits: Kept | None = None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        i, v, _ = sparse(text, hits if hits is not None else hits_in(self.lexicon))
        p = 1 / (1 + np.exp(np.clip(self.cuts - v @ self.weights[i], -35, 35)))
        return self.odds * p / (self.odds * p[0] + 1 - p[0])


def hits_in(lexicon: dict[str, int]) -> Kept:
    """Of each word, the numbers of its entries that are in the lexicon."""
    starts = {e[: BEGINNINGS[0]] for e in lexicon}  # most words begin like no entry

    def make(raw: str) -> tuple[int, ...]:
        if raw.strip(_TRIM)[: BEGINNINGS[0]] not in starts:
            return ()
        return tuple(i for e in entries_of_word(raw) if (i := lexicon.get(e)) is not None)

    return Kept(make)


def sparse(text: str | None, hits: Kept) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Lexicon entries of a text, their values, and the entries of each of its words that have some."""
    found = [h for h in map(hits.__getitem__, (text or "").lower().split()) if h]
    own = Counter(i for h in found for i in h)
    return np.fromiter(own, np.int64, len(own)), 1 + np.log(np.fromiter(own.values(), float, len(own))), found


def weight_of(found: list[tuple[int, ...]], odds: np.ndarray) -> float:
    """The sum of the highest log-odds of each word's entries."""
    return float(sum(max(odds[i] for i in h) for h in found))


def log_odds(t, n, toxic: int, every: int):
    """(log-odds ratio, variance) of an entry in t of the toxic texts and in n of all; columns or numbers."""
    a, b = t + 0.5, n - t + 0.5
    log = F.log if not isinstance(t, (int, float)) else math.log
    return log(a / (toxic - t + 0.5)) - log(b / (every - toxic - (n - t) + 0.5)), 1 / a + 1 / b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """The model learned from the labels that are not held out; None without toxic ones."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    y = y.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = cut(y)
    half = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int")
    learned = own.join(small_or_not(y, BROADCAST_LABELS), "doc_id").withColumn("half", half)
    names = ("n", "t", "n1", "t1")
    counts = learned.select("text", "y", "half").mapInArrow(_count, "h long, n long, t long, n1 long, t1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in names])
    size = learned.agg(F.count("*").alias("n"), F.sum("y").alias("t"), F.sum("half").alias("n1"), F.sum(F.col("y") * F.col("half")).alias("t1")).first()
    if not size.t:
        return None
    c = {k: F.col(k) for k in names}
    odds, variance = log_odds(c["t"], c["n"], size.t, size.n)
    halves = [log_odds(c["t"] - c["t1"], c["n"] - c["n1"], size.t - size.t1, size.n - size.n1)[0], log_odds(c["t1"], c["n1"], size.t1, size.n1)[0]]
    # both parts: enough evidence, and words that are rare in other texts
    tested = counts.filter(F.col("t") >= LEAST_TEXTS).select("h", (odds / F.sqrt(variance)).alias("z"), odds.alias("odds"), *[F.greatest(o, F.lit(0.0)).alias(f"odds{i}") for i, o in enumerate(halves)])
    chosen = tested.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).toArrow()
    z_of = dict(zip(chosen["h"].to_pylist(), chosen["z"].to_pylist(), strict=True))
    half_of = dict(zip(chosen["h"].to_pylist(), zip(chosen["odds0"].to_pylist(), chosen["odds1"].to_pylist(), strict=True), strict=True))
    # each of them is in some toxic text
    spelled = learned.filter("y = 1").select("text").mapInArrow(_written(set(z_of)), "h long, word string").distinct().toArrow()
    ranked = sorted(zip(spelled["word"].to_pylist(), spelled["h"].to_pylist(), strict=True), key=lambda e: (-z_of[e[1]], e[0]))
    lexicon = {w: i for i, (w, _) in enumerate(ranked)}
    odds_of = np.array([half_of[h] for _, h in ranked], float).reshape(-1, 2)
    # both labels are drawn by themselves, of ids that have a text, so that rare toxic ones are in the sample
    known = cut(learned.groupBy("doc_id").agg(F.max("y").alias("y")))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = min(share.get(1, 0), max(SAMPLE // 2, SAMPLE - share.get(0, 0)))
    parts = [hashed_sample(known.filter(F.col("y") == k), "doc_id", m) for k, m in ((1, most), (0, SAMPLE - most))]
    sample = cut(parts[0].unionByName(parts[1]))

    def rows(batches):
        hits = hits_in(lexicon)
        for batch in batches:
            found = [sparse(t, hits) for t in batch.column(0).to_pylist()]
            weight = [weight_of(f[2], odds_of[:, 1 - h]) for f, h in zip(found, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "i": pa.array([f[0] for f in found], pa.list_(pa.int64())), "v": pa.array([f[1] for f in found], pa.list_(pa.float64())), "weight": pa.array(weight, pa.float64())})

    few = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # at most SAMPLE rows
    table = few.orderBy("doc_id").select("text", "y", half).mapInArrow(rows, "y int, i array<long>, v array<double>, weight double").toArrow()
    toxic, weight = table["y"].to_numpy() > 0, table["weight"].to_numpy()
    if not toxic.any():
        return None
    drawn = sample.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    odds = 1.0 if drawn.n == sum(share.values()) or drawn.t == drawn.n else share[1] / share[0] * (drawn.n - drawn.t) / drawn.t
    cuts = np.quantile(weight[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic, 1 + np.searchsorted(cuts, weight, side="left"), 0).astype(np.int64)
    return Ordinal(lexicon, [(np.array(i, np.int64), np.array(v)) for i, v in zip(table["i"].to_pylist(), table["v"].to_pylist(), strict=True)], grades, odds)


def severity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, severity (expected grade), grade (the likeliest of a toxic text, else 0), p_toxic, toxic for each row."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches):
        none = np.zeros(GRADES - 1)
        hits = None if model is None else hits_in(model.lexicon)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                p = np.array([none if model is None else model.at_least(t, hits) for t in batch.column(1).to_pylist()]).reshape(-1, GRADES - 1)
                each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
                grade = np.where(p[:, 0] >= threshold, 1 + each[:, 1:].argmax(axis=1), 0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2), "severity": pa.array(p.sum(axis=1)), "grade": pa.array(grade.astype(np.int32)), "p_toxic": pa.array(p[:, 0]), "toxic": pa.array((p[:, 0] >= threshold).astype(np.int32))})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).mapInArrow(run, "doc_id long, held_out boolean, severity double, grade int, p_toxic double, toxic int")


def op4_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    return severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
