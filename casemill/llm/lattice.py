"""Language-model scores by subword lattice likelihood.

Words of the training texts are counted over the whole corpus. An existing subword vocabulary gives the pieces; a word's
probability is the sum over all its segmentations into pieces, by forward recursion in log space, and a text's is the
product over its words and one end symbol: its marginal probability. Every single byte is a piece too, so that no word is
impossible.

A piece's unigram probability starts from the vocabulary's scores (a piece ranked r has weight 1 / (r + ZIPF); this prior
counts as PRIOR pieces) and its count in the training words as the vocabulary's own tokenizer splits them. ROUNDS rounds
of expectation-maximisation follow: forward and backward sums over all segmentations of each distinct training word give
the expected counts of pieces, weighted by the word's count, and these and the prior the next probabilities.

The base score is a word unigram model with one added to each count.

Both are functions of a word, so they are worked out once for each distinct word. The words that occur most, in whatever
texts, go to all tasks: those whose occurrences reach a threshold, which a histogram of them sets so that they are HOT
words and HOT_BYTES bytes at most. All other words meet their scores in a shuffled join, under SALTS keys each if they
occur more often than a task should see.

Odd input: a null text is empty: one end token. A null id counts as the id ''. Repeated rows give repeated rows and count
repeatedly. Without training text N is 0, every c is 0 and the pieces have their prior. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.plans.lineage import cut

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
ZIPF, PRIOR = 2.7, 32_000.0
ROUNDS = 2
#: Expected counts are added up in these parts of one.
UNIT = 1 << 20
#: Words of more texts than this meet their scores under so many keys.
OFTEN, SALTS = 100_000, 64
#: Words that are broadcast at most, and their bytes in all at most.
HOT, HOT_BYTES = 262_144, 8_000_000
#: Steps of the histogram of counts to a factor of two.
STEPS = 8
#: Distinct words that a task gathers before it sends their counts, and their bytes.
GATHERED, GATHERED_BYTES = 300_000, 64_000_000
#: Longer words meet their scores under a 128-bit hash, so that they aren't shuffled as a whole.
LONG = 48
SPACE = "▁".encode()
#: A factor for each byte of a piece; bytes from which on a word is taken by itself; words that are taken at once.
SCALE, LONGEST, TOGETHER = 16.0, 64, 40_000
#: Stretches of words that are looked up at once, and the base of their hashes (odd).
CELLS, _BASE = 1_000_000, 0x9E3779B97F4A7C15


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lowered words between ASCII blanks."""
    return (text or "").encode().lower().split()


def join_key(word: bytes) -> bytes:
    """The word, or of a long one the hash (no word begins with a line feed)."""
    return word if len(word) <= LONG else b"\n\n" + xxhash.xxh3_128_digest(word)


def least_count(counts: DataFrame, most: int, most_bytes: int | None = None, count: str = "n", word: str = "word") -> int:
    """The count from which rows are at most ``most`` (and, if given, have ``most_bytes`` bytes of words at most).

    Counts are gathered in bins of powers of 2^(1/STEPS), some hundreds of rows; no row is sorted or sent anywhere.
    """
    size = F.octet_length(word) if most_bytes is not None else F.lit(0)
    # a bin's lowest count is worked out from whole numbers, so that it holds the very counts that fell into it
    step = F.floor(F.log2(F.col(count)) * STEPS + 1e-9).cast("int")
    bins = counts.filter(F.col(count) > 0).groupBy(step.alias("step")).agg(F.min(count).alias("low"), F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    rows = total = 0
    least = None
    for r in sorted(bins, key=lambda r: -r.step):
        rows, total = rows + r.n, total + r.bytes
        if rows > most or (most_bytes is not None and total > most_bytes):
            break
        least = r.low
    return least if least is not None else (1 << 62)


class Pieces:
    """The vocabulary's pieces as bytes, and their prior."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p, n = self.processor, self.processor.get_piece_size()
        rank = np.full(n, float(n))  # bytes: as rare as the last piece
        self.bytes_of: list[bytes | None] = []
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                self.bytes_of.append(None)
                rank[i] = math.inf
            else:
                self.bytes_of.append(piece.encode())
                rank[i] = -p.get_score(i)
        self.prior = 1 / (rank + ZIPF)
        self.prior /= self.prior.sum()

    def count(self, words: list[bytes], n: list[int], into: np.ndarray) -> None:
        for own, k in zip(self.processor.encode([w.decode(errors="replace") for w in words], num_threads=1), n, strict=True):
            for i in own:
                into[i] += k


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _upto(data: np.ndarray) -> np.ndarray:
    """Hashes of the starts of all rows of bytes, by length: (length + 1, rows)."""
    out = np.zeros((data.shape[1] + 1, len(data)), np.uint64)
    for i in range(data.shape[1]):
        out[i + 1] = out[i] * np.uint64(_BASE) + data[:, i] + np.uint64(1)
    return out


class Lattice:
    """log10 probabilities of words, from pieces' counts. A byte and a one-byte piece are two ways to write the same."""

    def __init__(self, pieces: Pieces, counts: np.ndarray, ends: int):
        mass = counts + PRIOR * pieces.prior
        total = mass.sum() + ends + 1
        self.end = math.log10((ends + 1) / total)
        self.logp: dict[bytes, float | None] = {}
        #: For each piece its place in the expected counts and its probability; for each place the piece's numbers in
        #: the vocabulary and their shares.
        self.parts: dict[bytes, tuple[int, float] | None] = {}
        self.shares: list[list[tuple[int, float]]] = []
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        same: dict[bytes, list[int]] = {}
        for i, (piece, m) in enumerate(zip(pieces.bytes_of, mass, strict=True)):
            if piece and m > 0:
                same.setdefault(piece, []).append(i)
        for piece, own in same.items():
            m = sum(mass[i] for i in own)
            self.logp[piece] = math.log(m / total)
            self.parts[piece] = len(self.shares), m / total
            self.shares.append([(i, mass[i] / m) for i in own])
        for piece in list(same):
            for j in range(1, len(piece)):  # the start of a piece
                self.logp.setdefault(piece[:j], None)
                self.parts.setdefault(piece[:j], None)

    def expect(self, word: bytes, n: float, into) -> None:
        """Adds the expected counts of pieces in n occurrences of a word, over all its segmentations, by place."""
        data = SPACE + word
        size, get, log, exp = len(data), self.parts.get, math.log, math.exp
        forward, edges = [0.0] + [-math.inf] * size, []
        plus = lambda a, b: b if a == -math.inf else max(a, b) + log(1.0 + exp(-abs(a - b)))
        for i in range(size):
            for j in range(i + 1, size + 1):
                own = get(data[i:j], 0)
                if own:
                    k, q = own[0], log(own[1])
                    forward[j] = plus(forward[j], forward[i] + q)
                    edges.append((i, j, k, q))
                elif own == 0:  # no piece starts like this
                    break
        backward = [-math.inf] * size + [log(n) - forward[size]]
        for i, j, k, q in reversed(edges):  # all edges from j on come before those to j
            backward[i] = plus(backward[i], q + backward[j])
            into[k] += exp(forward[i] + q + backward[j])

    def expect_all(self, words: list[bytes], n: list[int], into: np.ndarray) -> None:
        """The same for many words: those of one length together, their pieces found by hashes of all stretches.

        Sums are taken as they are, with SCALE for each byte, which changes no share. Words whose sums leave the range of
        doubles, and long ones, are taken by themselves, in logarithms.
        """
        if self.tables is None:
            by: dict[int, list[tuple[int, int, float]]] = {}
            for piece, own in self.parts.items():
                if own:
                    by.setdefault(len(piece), []).append((int(_upto(np.frombuffer(piece, np.uint8)[None])[-1, 0]), *own))
            self.tables = {}
            for size, rows in by.items():
                rows.sort()
                h, k, q = zip(*rows, strict=True)
                known = np.array(h, np.uint64)
                maybe = np.zeros(1 << 16, bool)
                maybe[known >> np.uint64(48)] = True
                self.tables[size] = known, maybe, np.array(k, np.int64), np.array(q) * SCALE**size
        sizes = np.array([len(w) for w in words], np.int64) + len(SPACE)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size > LONGEST:
                for i in own:
                    self.expect(words[i], n[i], into)
                continue
            step = max(1, CELLS // (size * min(size, max(self.tables))))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                data = np.frombuffer(b"".join(SPACE + words[i] for i in part), np.uint8).reshape(-1, size)
                for i in part[self._expect_group(data, np.array([n[i] for i in part], np.float64), into)]:
                    self.expect(words[i], n[i], into)

    def _expect_group(self, data: np.ndarray, n: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Adds what rows of bytes are expected to hold; gives the rows that are out of range, of which nothing was added."""
        rows, size = data.shape
        upto = _upto(data)
        edges: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []  # start, end, which rows, places, probabilities
        for length, (known, maybe, places, q) in self.tables.items():
            power = np.uint64(pow(_BASE, length, 1 << 64))
            for i in range(size - length + 1):
                h = upto[i + length] - upto[i] * power
                hit = np.flatnonzero(maybe[h >> np.uint64(48)])
                at = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
                same = known[at] == h[hit]
                if same.any():
                    hit, at = hit[same], at[same]
                    edges.append((i, i + length, hit, places[at], q[at]))
        forward, backward = np.zeros((size + 1, rows)), np.zeros((size + 1, rows))
        forward[0] = 1.0
        edges.sort(key=lambda e: e[0])
        for i, j, hit, _, q in edges:
            forward[j, hit] += forward[i, hit] * q
        fits = (forward[size] > 1e-250) & (forward[size] < 1e250)
        backward[size, fits] = n[fits] / forward[size, fits]
        shares = []
        for i, j, hit, _, q in reversed(edges):  # all edges from j on come before those to j
            share = q * backward[j, hit]
            backward[i, hit] += share
            shares.append(share * forward[i, hit])
        if edges:
            into += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.concatenate(shares), len(into))
        return np.flatnonzero(~fits)

    def counts(self, into, size: int) -> np.ndarray:
        """Expected counts by the vocabulary's numbers."""
        out = np.zeros(size)
        for own, n in zip(self.shares, into, strict=True):
            for i, share in own:
                out[i] += n * share
        return out

    def score(self, word: bytes) -> float:
        """log10 of the sum over all segmentations of the word, after a space."""
        data = SPACE + word
        n, logp, log, exp = len(data), self.logp, math.log, math.exp
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            for j in range(i + 1, n + 1):
                p = logp.get(data[i:j], 0.0)
                if p is None:
                    continue
                if p == 0.0:  # no piece starts like this
                    break
                p += here
                old = forward[j]
                if old == -math.inf:
                    forward[j] = p
                elif p > old:
                    forward[j] = p + log(1.0 + exp(old - p))
                else:
                    forward[j] = old + log(1.0 + exp(p - old))
        return forward[n] / math.log(10)


def _count_words(batches):
    """(word, n, times) of (text, learned) rows: how often it occurs in training texts, and in all."""
    seen: Counter = Counter()
    other: Counter = Counter()
    held = 0

    def flush():
        words = [*seen, *(w for w in other if w not in seen)]
        n = [seen[w] for w in words]
        times = [k + other[w] for w, k in zip(words, n, strict=True)]
        seen.clear()
        other.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "n": pa.array(n, pa.int64()), "times": pa.array(times, pa.int64())})

    for batch in batches:
        for text, learned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if learned:
                seen.update(words_of(text))
            else:
                other.update(words_of(text))
            held += len(text or "")
            if len(seen) + len(other) > GATHERED or (held > GATHERED_BYTES and sum(map(len, seen)) + sum(map(len, other)) > GATHERED_BYTES):
                held = 0
                yield flush()
            elif held > GATHERED_BYTES:
                held = 0
    yield flush()


def _count_pieces(path: str):
    def run(batches):
        p = pieces_of(path)
        counts = np.zeros(len(p.bytes_of), np.int64)
        for batch in batches:
            p.count(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    return run


_lattices: dict[str, Lattice] = {}


def _lattice(path: str, counts: np.ndarray, ends: int) -> Lattice:
    name = xxhash.xxh64_hexdigest(counts.tobytes() + str((path, ends)).encode())
    if name not in _lattices:
        _lattices.clear()
        _lattices[name] = Lattice(pieces_of(path), counts, ends)
    return _lattices[name]


def _expected(path: str, counts: np.ndarray, ends: int):
    """Each task's expected counts of pieces, in UNIT parts."""

    def run(batches):
        lattice = _lattice(path, counts, ends)
        into = np.zeros(len(lattice.shares))
        words, n = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            n += batch.column(1).to_pylist()
            if len(words) >= TOGETHER:
                lattice.expect_all(words, n, into)
                words, n = [], []
        lattice.expect_all(words, n, into)
        total = np.rint(lattice.counts(into, len(counts)) * UNIT).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def piece_counts(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Counts of the vocabulary's pieces in words (word, n): as its tokenizer splits them, then expected ones."""
    size = len(pieces_of(path).bytes_of)

    def gathered(made: DataFrame, unit: float) -> np.ndarray:
        counts = np.zeros(size)
        for r in made.groupBy("i").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # as many rows as the vocabulary has pieces
            counts[r["i"]] = r["n"] / unit
        return counts

    counts = gathered(words.mapInArrow(_count_pieces(path), "i long, n long"), 1)
    for _ in range(rounds if counts.any() else 0):
        counts = gathered(words.mapInArrow(_expected(path, counts, ends), "i long, n long"), UNIT)
    return counts


def _score_words(path: str, counts: np.ndarray, ends: int):
    def run(batches):
        score = _lattice(path, counts, ends).score
        for batch in batches:
            own = np.array([score(w) for w in batch.column(0).to_pylist()], np.float64)
            keys = pa.array(map(join_key, batch.column(0).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array(own, pa.float64())], ["word", "n", "times", "key", "s"])

    return run


_hot: dict[str, dict] = {}


def _score_texts(hot, name: str, bottom: float, ends: int, end_score: float):
    """Per text a row of what its hot words and its end give, and a row for each distinct other word."""

    def run(batches):
        if name not in _hot:
            _hot.clear()
            words, n, s = hot.value
            base = np.log10(n + 1.0) - bottom
            _hot[name] = {w: (b, x, int(c > 0)) for w, b, x, c in zip(words, base.tolist(), s.tolist(), n.tolist(), strict=True)}
        known = _hot[name]
        end_base = math.log10(ends + 1.0) - bottom
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                out: list[tuple] = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    h = xxhash.xxh64_intdigest((text or "").encode(), 7) - (1 << 63)
                    base, score, k = [end_base], [end_score], int(ends > 0)
                    for w, n in Counter(words).items():
                        v = known.get(w)
                        if v is None:
                            out.append((key, h, join_key(w), n, 0, 0, 0, 0.0, 0.0))
                        else:
                            base.append(n * v[0])
                            score.append(n * v[1])
                            k += n * v[2]
                    # the text's own row meets no word: b'\n' and a hash are in none
                    out.append((key, h, b"\n%d" % h, 0, 1, len(words) + 1, k, math.fsum(base), math.fsum(score)))
                kinds = (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, *[pa.float64()] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "h", "word", "n", "copies", "n_tokens", "n_known", "base", "score"])

    return run


def score_texts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learned = fold("doc_id", FOLDS) != HELD_OUT
    ends = own.filter(learned).count()
    words = cut(own.select("text", learned.alias("learned")).mapInArrow(_count_words, "word binary, n long, times long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("times").alias("times")))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    train_tokens, distinct = sums.n + ends, sums.v + (ends > 0)
    bottom = math.log10(train_tokens + 1 * (distinct + 1))
    counts = piece_counts(words.filter("n > 0").select("word", "n"), path, ends)
    name = xxhash.xxh64_hexdigest(counts.tobytes() + str((ends, train_tokens, distinct)).encode())
    scored = cut(words.mapInArrow(_score_words(path, counts, ends), "word binary, n long, times long, key binary, s double"))
    least = least_count(words, HOT, HOT_BYTES, "times")
    top = scored.filter(F.col("times") >= least).toArrow()
    hot = spark.sparkContext.broadcast((top["word"].to_pylist(), top["n"].to_numpy(), top["s"].to_numpy()))
    end_score = Lattice(pieces_of(path), counts, ends).end
    # words of many texts that are still too many to be sent everywhere stand under several keys
    often = least > OFTEN
    salt = (lambda of: F.pmod(F.xxhash64(*of), F.lit(SALTS))) if often else (lambda of: F.lit(0).cast("long"))
    keys = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1 if often else 0).cast("long")))
    rows = own.mapInArrow(_score_texts(hot, name, bottom, ends, end_score), "doc_id long, h long, word binary, n long, copies long, n_tokens long, n_known long, base double, score double")
    table = scored.filter(F.col("times") < least).select(F.col("key").alias("word"), F.col("n").alias("c"), "s", keys.alias("salt"))
    met = rows.withColumn("salt", salt(["doc_id", "h"])).join(table, ["word", "salt"], "left")
    c = F.coalesce("c", F.lit(0))
    texts = met.groupBy("doc_id", "h").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * (F.log10(c + 1.0) - bottom)).alias("base_score"),
        F.sum(F.col("score") + F.when(F.col("n") > 0, F.col("n") * F.col("s")).otherwise(0.0)).alias("score"),
    )
    # equal rows were summed up together
    each = texts.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    share = lambda col: (F.col(col) / F.col("copies"))
    return each.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"),
    )


def op3_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by models learned from all but those held out."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
