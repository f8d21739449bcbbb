"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: each document has a sparse random vector (a few +1 and -1, worked out from its hash), and so has each of
BUCKETS buckets of subwords: a word as it stands (case, digits and marks kept), and the three-byte stretches of the word
and its ends, fall into buckets by hash. A bucket's context vector is the sum of the random vectors of the documents, for
each time a subword of it occurs, less what all buckets have in common, scaled to length one. A bucket's vector is its
random vector and its context vector, weighted down the more often it occurs. A word's vector is the sum of its
subwords' vectors scaled to length one, so every word has one, however rare, and the model has the same size whatever the
corpus' is. A document's features are the mean of its words' vectors and the mean likeness (inner product) of two of its
words and of two neighbouring ones: nothing that isn't from the vectors. A two-layer network in numpy
learns quality from them, on at most SAMPLE labelled training rows (the smallest hashes); a temperature, fitted on a fifth
of that sample, calibrates its probabilities.

Long texts are taken apart in parts of PART bytes, cut between words, to bound memory; the sums over a text's words are
then added up, so that features don't depend on PART.

Odd input: a null text is empty and is scored like an empty one (its vector is zero). A null id belongs to fold crc32('')
and has no label. Labels that are null or repeated: nulls are left out, the least label of an id counts. With labels of
one class only, or none, the score is that class's share (0.5 without any). Equal scores give equal predictions. Repeated
rows give repeated rows; an empty table gives an empty result; other columns are not read (accepted keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.llm.lattice import fold
from casemill.plans.lineage import cut

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled rows that the network is fitted on at most.
SAMPLE = 20_000
DIM, NONZERO = 64, 4
WIDTH = DIM + 2
#: Buckets of subwords; the share of all subwords from which on a bucket counts less than half.
BUCKETS, RARE = 1 << 14, 1e-3
HIDDEN, EPOCHS, RATE, DECAY = 24, 40, 3e-3, 3e-3
#: Bytes of text, and texts, that are taken apart at once. Longer words are taken apart one by one.
PART, TEXTS = 100_000, (1 << 17) - 1
#: What stands for a word's ends among its bytes, none of UTF-8's.
_OPENS, _CLOSES = 0xFE, 0xFF
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The NONZERO places and signs of the random vectors of hashes; each place is in its own part of the vector."""
    part = DIM // NONZERO
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = (h[:, None] >> (np.arange(NONZERO, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)
    return (bits >> np.uint64(1)).astype(np.int64) % part + np.arange(NONZERO) * part, 1.0 - 2.0 * (bits & np.uint64(1)).astype(np.float64)


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(core: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, wherever it stands."""
    n = len(core)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((core.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, n))])
    return _mixed((sums[end] - sums[start]) * _powers(_BACK, n + 1)[start])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of words (stretches of data), word by word, and where each word's begin.

    whole: the words' hashes, which give the last bucket of each.
    """
    size = end - start
    n = size + 1  # stretches of three among the bytes and two ends, and the word itself
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(start)), n - 1)
    i = np.arange(len(word)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)  # the middle byte's place in its word
    at = start[word] + i
    left = np.where(i == 0, np.uint64(_OPENS), data[at - (i > 0)].astype(np.uint64))
    right = np.where(i == size[word] - 1, np.uint64(_CLOSES), data[np.minimum(at + 1, len(data) - 1)].astype(np.uint64))
    code = (left | (data[at].astype(np.uint64) << np.uint64(8)) | (right << np.uint64(16)) | np.uint64(1 << 24)) * _STEP
    out = np.zeros(int(n.sum()), np.int64)
    last = first + n - 1
    inside = np.ones(len(out), bool)
    inside[last] = False
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out[inside] = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift
    out[last] = whole * np.uint64(0x94D049BB133111EB) >> shift
    return out, first


class Words:
    """The words of a batch of texts: for each text its distinct words and their counts, and the words' subwords."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        of_text = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)
        blank = _BLANK[data]
        start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
        text = np.searchsorted(of_text, start, side="right")
        h = _hashes(data, start, end) >> np.uint64(17)  # a text's number takes 17 bits, a word's hash the other 47
        key, self.counts = np.unique((text.astype(np.uint64) << np.uint64(47)) | h, return_counts=True)
        self.text = (key >> np.uint64(47)).astype(np.int64)
        own, at, self.tokens = np.unique(h, return_index=True, return_inverse=True)
        ends = np.searchsorted(text, np.arange(n), side="right")
        self.tokens_of = list(zip((ends - np.bincount(text, minlength=n)).tolist(), ends.tolist(), strict=True))
        self.word = np.searchsorted(own, key & np.uint64((1 << 47) - 1))
        self.buckets, self.first = subwords(data, start[at], end[at], own)
        self.sizes = np.diff(np.r_[self.first, len(self.buckets)])
        begins = [*np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]).tolist(), len(key)] if len(key) else []
        self.spans = [(int(self.text[i]), i, j) for i, j in zip(begins, begins[1:], strict=False)]

    def times_by_text(self):
        """(text, how often each bucket occurs in it)."""
        for i, a, b in self.spans:
            word = self.word[a:b]
            sizes = self.sizes[word]
            at = np.repeat(self.first[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            yield i, np.bincount(self.buckets[at], np.repeat(self.counts[a:b], sizes), BUCKETS).astype(np.int64)

    def sums_by_text(self, vectors: np.ndarray):
        """(text, number of words, sum of their vectors, sum of the likeness of neighbours, the first and the last word's vector)."""
        word = np.zeros((len(self.first), DIM), np.float32)
        order = np.argsort(self.sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(self.sizes[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:  # words of one length together
            size = int(self.sizes[own[0]])
            word[own] = vectors[self.buckets[self.first[own][:, None] + np.arange(size)]].sum(axis=1, dtype=np.float64)
        word = _scaled(word)
        for i, a, b in self.spans:
            t = self.tokens[slice(*self.tokens_of[i])]
            near = np.einsum("ij,ij->", word[t[:-1]], word[t[1:]], dtype=np.float64)
            yield i, len(t), self.counts[a:b].astype(np.float64) @ word[self.word[a:b]], near, word[t[0]], word[t[-1]]


class LongWord:
    """The same of a text that is one very long word, its subwords counted."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.times, h, zero = np.zeros(BUCKETS, np.int64), 0, np.zeros(1, np.uint64)
        for at in range(0, len(b), PART):  # a byte more on either side tells what stands there
            stop = min(len(b), at + PART)
            low, high = max(0, at - 1), min(len(b), stop + 1)
            found, _ = subwords(b[low:high], np.array([0]), np.array([high - low]), zero)
            self.times += np.bincount(found[at - low : stop - low], minlength=BUCKETS)
            own = np.sum((b[at:stop].astype(np.uint64) + np.uint64(1)) * _powers(_STEP, stop - at))
            h = (h + int(own) * pow(int(_STEP), at, 1 << 64)) % (1 << 64)
        whole = _mixed(np.array([h], np.uint64)) >> np.uint64(17)
        self.times[subwords(b[:1], np.array([0]), np.array([1]), whole)[0][-1]] += 1

    def times_by_text(self):
        yield 0, self.times

    def sums_by_text(self, vectors: np.ndarray):
        v = _scaled((self.times @ vectors)[None])[0]
        yield 0, 1, v, 0.0, v, v


_WORD_END, _BLANKS = re.compile(rb"[\x20\x09-\x0d]"), b" \t\n\x0b\x0c\r"


def _cut_text(data: bytes):
    """(stretch, whether it is a single word of over PART bytes): cut between words only."""
    at = 0
    while at < len(data):
        end = at + PART
        if end < len(data):
            blank = max(data.rfind(b, at, end + 1) for b in (_BLANKS[i : i + 1] for i in range(6)))
            if blank < 0:  # a word as long as that
                m = _WORD_END.search(data, end)
                end = m.start() if m else len(data)
                yield data[at:end], True
                at = end
                continue
            end = blank + 1
        yield data[at:end], False
        at = end


def parts_of(texts: list[str | None]):
    """(numbers of the texts, Words or LongWord) for groups of about PART bytes; a long text is in several of them."""
    group, of, size = [], [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode()
        if len(data) > PART:
            for piece, long_word in _cut_text(data):
                yield np.array([i]), LongWord(piece) if long_word else Words([piece])
            continue
        if group and (size + len(data) > PART or len(group) == TEXTS):
            yield np.array(of), Words(group)
            group, of, size = [], [], 0
        group.append(data)
        of.append(i)
        size += len(data)
    if group:
        yield np.array(of), Words(group)


def _slices(batches, rows: int = 250):
    """The texts of the batches, a few rows at a time: as Python's texts they take several times their room."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.column(0).slice(i, rows).to_pylist()


def _contexts(batches):
    """For each bucket how often it occurs, and the sums of the random vectors of the documents, for each time."""
    total = np.zeros((DIM + 1, BUCKETS), np.int64)
    for texts in _slices(batches):
        place, sign = index_entries(np.fromiter((xxhash.xxh64_intdigest((t or "").encode()) for t in texts), np.uint64, len(texts)))
        for of, p in parts_of(texts):
            for i, times in p.times_by_text():
                for k, one in zip(place[of[i]].tolist(), sign[of[i]].tolist(), strict=True):
                    total[k] += times if one > 0 else -times
                total[DIM] += times
    for i in range(0, BUCKETS, 4_096):
        part = total[:, i : i + 4_096]
        used = np.flatnonzero(part[DIM])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used + i, pa.int64()), *(pa.array(part[k, used]) for k in range(DIM + 1))], ["b", *(f"v{k}" for k in range(DIM + 1))])


def bucket_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vectors of all buckets: BUCKETS rows of DIM."""
    schema = T.StructType([T.StructField("b", T.LongType()), *(T.StructField(f"v{i}", T.LongType()) for i in range(DIM + 1))])
    sums = docs.select(F.col(text_col)).mapInArrow(_contexts, schema).groupBy("b").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM + 1)])
    context = np.zeros((BUCKETS, DIM + 1))
    for batch in sums.toArrow().to_batches():  # a row a bucket
        context[batch["b"].to_numpy()] = np.stack([batch[f"v{i}"].to_numpy() for i in range(DIM + 1)], axis=1)
    return weighted(context[:, :DIM], context[:, DIM])


def weighted(context: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Vectors of buckets from their context sums and how often they occur."""
    total = max(times.sum(), 1.0)
    own = context - times[:, None] * (context.sum(axis=0) / total)  # less what any subword of this number would have
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    place, sign = index_entries(np.arange(BUCKETS, dtype=np.uint64) * _STEP)
    random = np.zeros((BUCKETS, DIM))
    np.put_along_axis(random, place, sign / NONZERO**0.5, axis=1)
    return ((RARE / (RARE + times / total))[:, None] * (random + own)).astype(np.float32)


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text (WIDTH numbers): the mean of its words' vectors, the mean likeness of two of its words, which
    follows from their sum's length, and that of neighbouring words."""
    n = len(texts)
    total, words, near, last = np.zeros((n, DIM)), np.zeros(n), np.zeros(n), {}
    for of, p in parts_of(texts):
        for i, k, v, own, first, end in p.sums_by_text(vectors):
            at = of[i]
            near[at] += own + (last[at] @ first if words[at] else 0.0)  # parts of a text come in turn
            total[at] += v
            words[at] += k
            last[at] = end
    known = (vectors != 0).any()  # of length one, if words have vectors at all
    alike = ((total**2).sum(axis=1) - words * known) / np.maximum(words * (words - 1), 1) * (words > 1)
    return np.concatenate([total / np.maximum(words, 1)[:, None], alike[:, None], (near / np.maximum(words - 1, 1))[:, None]], axis=1)


def gradients(w: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss and half DECAY times the squared weights, by the two layers' weights and biases."""
    h = np.tanh(z @ w[0] + w[1])
    d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y) / len(y)
    back = d[:, None] * w[2] * (1 - h * h)
    return [z.T @ back + DECAY * w[0], back.sum(axis=0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]


class Network:
    """Two layers, tanh between them; scores are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.constant = None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        check, learn = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-3
        z, n_in = (x - self.mean) / self.scale, x.shape[1]
        w = [rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                step += 1
                for i, g in enumerate(gradients(w, z[part], y[part])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logit = self.logits(x[check] if len(check) else x[learn])
        truth = y[check] if len(check) else y[learn]
        loss = lambda t: np.logaddexp(0, np.where(truth > 0, -logit, logit) / t).mean()
        self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes. A filter near the wanted share comes first, so that the one
    task that orders them gets little more than it keeps, however many rows there are."""
    n = rows.count()
    near = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    share = 1.0 if n <= most else (most + 10 * most**0.5) / n
    return rows.filter(near <= share).orderBy(near, key).limit(most)


def training_labels(labels: DataFrame, column: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """doc_id, y: at most ``sample`` of the labelled ids outside the held-out fold, by hash."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", folds) != held_out))
    return hashed_sample(own.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id", sample)


def _features(vectors):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                x = features(batch.column(1).to_pylist(), vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """(broadcast bucket vectors, network) learned from the labels that are not held out."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(bucket_vectors(own))
    chosen = cut(training_labels(labels, column, FOLDS, HELD_OUT, SAMPLE))
    few = F.broadcast(chosen)  # at most SAMPLE rows of two numbers
    of_ids = own.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # one text for an id
    table = of_ids.mapInArrow(_features(vectors), "doc_id long, x array<double>").join(few, "doc_id").orderBy("doc_id").select("x", "y").toArrow()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(table.num_rows, WIDTH)
    return vectors, Network(x, table["y"].to_numpy().astype(np.float64))


def _scored(vectors, network: Network, at: int):
    """A function from a batch to its scores."""
    return lambda batch: network.scores(features(batch.column(at).to_pylist(), vectors.value))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    vectors, network = fit(docs, labels, "quality", id_col, text_col)

    def run(batches):
        score = _scored(vectors, network, 1)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                s = score(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    vectors, network = fit(docs, labels, "quality", id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        score = _scored(vectors, network, at)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                yield batch.filter(pa.array(score(batch) >= threshold))

    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op5_random_indexing_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
