"""Substring dedup by De Bruijn compaction: words of windows that also start earlier are removed.

The edges of the graph are windows of WINDOW words. Each window picks an anchor, the ANCHOR words in it that have the
smallest hash, and consecutive windows with the same anchor are one path of edges, so a path is known by its anchor and
the digest of its words. Equal windows pick equal anchors, so a window can only repeat where its anchor does:

* paths meet by anchor, in order, and are read once: an anchor with one path is unique and goes no further; of equal
  paths all but the first are repeated as a whole, without a branch, and leave;
* where one anchor has several different paths, the graph branches: the first of each of these, and only they, are opened
  into single windows, which are joined to their first occurrences;
* paths and windows that have an earlier source are put together to the spans of each document that go.

Anchors are rolling hashes, which only propose; what must agree besides are digests of the words themselves, read from
the text at the coordinates (document, first word) of path, window and source, so a span goes because its words are
there. A path has a few windows, which is what bounds the rows that are shuffled. Anchors that a sample of the documents
shows often are dealt out by document too: each share finds its own first paths, and these are then reduced to the first
of all; what the sample says changes no result. Texts are compressed when they are shuffled.

Odd input: a null text has no words; very long texts are read piece by piece (paths end with a piece, which changes no
result); null ids come before all others; rows of equal ids follow by a hash of their text, and are one document if their
texts are equal too, so each gets the same result. A text of fewer than WINDOW words keeps them all. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.lineage import cut, small_or_not, stored

WINDOW, ANCHOR = 20, 8
#: Bytes of text that are read at once, documents of a step, and rows that are sent at once.
PIECE, STEP, SENT = 1_000_000, 256, 200_000
#: Rows of a table that is broadcast at most; its bytes are measured too.
SMALL = 1_000_000
#: The share of documents in which anchors are counted to find those to be dealt out; these are at most 1 / SHARE anchors.
SAMPLE, SHARE, LEAST = 1 / 16, 1 / 10_000, 8
#: Bases of the hashes over bytes and over words, odd, and the first one's inverse modulo 2^64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BACK = pow(_BYTE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        many = np.full(max(n, 1 << 16), base, np.uint64)
        many[0] = 1
        _powers[base] = np.cumprod(many, dtype=np.uint64)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Piece:
    """A stretch of a text: its words, joined by single spaces. first: the number of its first word in the text."""

    def __init__(self, raw: bytes, first: int):
        b = np.frombuffer(raw, np.uint8)
        blank = np.r_[True, (b == 32) | ((b >= 9) & (b <= 13)), True]
        opens = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        closes = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        self.opens = opens  # in the raw bytes
        keep = ~blank[1:-1]
        keep[opens[1:] - 1] = True
        own = np.where(blank[1:-1], np.uint8(32), b)[keep]
        self.text = own.tobytes()
        lengths = closes - opens
        self.stop = np.cumsum(lengths + 1) - 1
        self.start = self.stop - lengths
        self.first = first

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        n = len(self.text)
        b = (np.frombuffer(self.text, np.uint8).astype(np.uint64) + np.uint64(1)) * _power(_BYTE, n)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b, dtype=np.uint64)])
        return _mixed((upto[self.stop] - upto[self.start]) * _power(_BACK, n + 1)[self.start])

    def digest(self, at: int, words: int) -> bytes:
        """Of some words as they stand in the text."""
        return xxhash.xxh3_128_digest(self.text[self.start[at] : self.stop[at + words - 1]])

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, number of windows) of each path."""
        h = self.hashes()
        n = len(h) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = len(h) - ANCHOR + 1
        g = np.zeros(grams, np.uint64)
        for i in range(ANCHOR):
            g = g * np.uint64(_WORD) + h[i : i + grams]
        g = _mixed(g)
        at = np.lib.stride_tricks.sliding_window_view(g, WINDOW - ANCHOR + 1).argmin(axis=1) + np.arange(n)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return g[at[first]].view(np.int64), first, np.diff(np.r_[first, n])


def pieces(text: str | None, whole: bool = True):
    """A text's pieces; each but the first begins with the last WINDOW - 1 words of the one before (not if not whole)."""
    data = (text or "").encode()
    at = first = 0
    back = WINDOW - 1 if whole else 0
    size = PIECE
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        piece = Piece(data[at:end], first)
        if end >= len(data):
            yield piece
            return
        if len(piece) <= back:  # too few words to go on from: a longer stretch
            size *= 2
            continue
        size = PIECE
        yield piece
        n = len(piece) - back
        first += n
        at = at + int(piece.opens[n]) if back else end


def _rows(batches, at: int):
    """The rows of batches (d, th, text, ...), a few at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, STEP):
            part = whole.slice(i, STEP)
            for row in zip(*(part.column(c) for c in range(at)), strict=True):
                yield [v.as_py() for v in row]


def _anchors(batches):
    held, n = [], 0
    for (text,) in _rows(batches, 1):
        for piece in pieces(text):
            held.append(piece.paths()[0])
            n += len(held[-1])
        if n >= SENT:
            yield pa.RecordBatch.from_pydict({"anchor": np.concatenate(held)})
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"anchor": np.concatenate(held)})


class _Sender:
    """Rows of numbers with the id and the tie of their document, sent in batches."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.n = names, [], 0

    def add(self, d, th, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append((d, th, columns))
            self.n += len(columns[0])

    def batch(self) -> pa.RecordBatch:
        counts = [len(c[0]) for _, _, c in self.parts]
        d = np.repeat(np.array([x or 0 for x, *_ in self.parts], np.int64), counts)
        null = np.repeat(np.array([x is None for x, *_ in self.parts], bool), counts)
        th = np.repeat(np.array([x for _, x, _ in self.parts], np.int64), counts)
        columns = [np.concatenate(c) for c in zip(*(c for *_, c in self.parts), strict=True)]
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(d, mask=null), pa.array(th), *map(pa.array, columns)], ["d", "th", *self.names])


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _paths(batches):
    sender = _Sender(["anchor", "p", "start", "n"])
    for d, th, text in _rows(batches, 3):
        for piece in pieces(text):
            anchor, first, n = piece.paths()
            digests = [piece.digest(a, k) for a, k in zip(first.tolist(), (n + WINDOW - 1).tolist(), strict=True)]
            sender.add(d, th, anchor, _words(digests)[0], first + piece.first, n)
            if sender.n >= SENT:
                yield sender.batch()
    if sender.n:
        yield sender.batch()


REPEATED, OPEN, SHARED = 0, 1, 2


def _met(batches):
    """Rows (d, th, anchor, p, start, n, hot), sorted by anchor, p and coordinates, to what becomes of them.

    REPEATED: there is an earlier equal path. OPEN: the first of its kind, its anchor has others. SHARED: the first of its
    kind in this share of an anchor that is dealt out. A row with the first one's coordinates is the same document again.
    Only the last row's kind and the last first path are held.
    """
    last, origin = None, None  # anchor, p of the last row; the coordinates of the first of these
    held, told = None, False  # the last first path (a batch of one row); whether it has been sent as open

    def sent(batch, kind: int):
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(batch.column(c) for c in ("d", "th", "start", "n", "anchor", "p"))], ["kind", "d", "th", "start", "n", "anchor", "p"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, p = batch.column("anchor").to_numpy(), batch.column("p").to_numpy()
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        first = np.r_[last != (anchor[0], p[0]), (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1])]
        at = np.flatnonzero(first)
        of = np.cumsum(first) - first[0]  # each row's kind, the one that goes on from before being the first
        later = np.zeros(len(first), bool)
        null = batch.column("d").is_null().to_numpy(zero_copy_only=False)
        ends = []
        for i, c in enumerate((null, *(batch.column(x).fill_null(0).to_numpy(zero_copy_only=False) for x in ("d", "th", "start")))):
            begins = c[at] if first[0] else np.r_[np.array([origin[i]], c.dtype), c[at]]
            later |= c != begins[of]
            ends.append(begins[-1])
        origin = ends
        last = anchor[-1], p[-1]
        yield sent(batch.filter(pa.array(later)), REPEATED)
        yield sent(batch.filter(pa.array(first & hot)), SHARED)
        at = np.flatnonzero(first & ~hot)
        if not len(at):
            continue
        own = anchor[at]
        same = own[1:] == own[:-1]
        goes_on = held is not None and held.column("anchor")[0].as_py() == own[0]
        if goes_on and not told:
            yield sent(held, OPEN)
        several = np.r_[goes_on, same] | np.r_[same, False]
        yield sent(batch.take(pa.array(at[several])), OPEN)
        held, told = batch.slice(int(at[-1]), 1), bool(several[-1])


def _packed(batches):
    """Rows (d, th, text) with the text's bytes compressed."""
    packer = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for i in range(0, whole.num_rows, STEP):
            part = whole.slice(i, STEP)
            texts = [packer.compress((t.as_py() or "").encode()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["d", "th", "packed"])


def _text(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def _windows(batches):
    """Rows (d, th, packed text, open: paths to be opened) to the windows of these paths."""
    sender = _Sender(["p", "q", "start"])
    for d, th, packed, open_paths in _rows(batches, 4):
        wanted = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in open_paths]))
        for piece in pieces(_text(packed)):
            low, high = np.searchsorted(wanted, [piece.first, piece.first + len(piece) - WINDOW + 1])
            at = wanted[low:high]
            sender.add(d, th, *_words([piece.digest(a, WINDOW) for a in (at - piece.first).tolist()]), at)
            if sender.n >= SENT:
                yield sender.batch()
    if sender.n:
        yield sender.batch()


def _keep(batches):
    """Rows (id, packed text, gone: paths that go) to the words that are kept, joined by single spaces."""
    for whole in batches:
        for i in range(0, whole.num_rows, STEP):
            part = whole.slice(i, STEP)
            totals, removed, texts = [], [], []
            for packed, gone in zip(part.column(1), part.column(2), strict=True):
                spans = np.array([(p["start"], p["start"] + p["n"] + WINDOW - 1) for p in gone.as_py() or ()], np.int64).reshape(-1, 2)
                kept, n, left = [], 0, 0
                for piece in pieces(_text(packed.as_py()), whole=False):
                    turn = np.zeros(len(piece) + 1, np.int64)
                    np.add.at(turn, np.clip(spans[:, 0] - n, 0, len(piece)), 1)
                    np.add.at(turn, np.clip(spans[:, 1] - n, 0, len(piece)), -1)
                    stays = np.cumsum(turn[:-1]) == 0
                    runs = np.flatnonzero(np.diff(np.r_[False, stays, False])).reshape(-1, 2)
                    kept += [piece.text[piece.start[a] : piece.stop[b - 1]] for a, b in runs.tolist()]
                    n, left = n + len(piece), left + int(stays.sum())
                totals.append(n)
                removed.append(n - left)
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _later(of: DataFrame, *by: str) -> DataFrame:
    """d, th, start, n: the rows that aren't the first of their key (by d, th, start)."""
    here = F.struct("d", "th", "start")
    first = of.groupBy(*by).agg(F.count("*").alias("times"), F.min(here).alias("f")).filter("times > 1").drop("times")
    return of.join(first, [*by]).filter(~here.eqNullSafe(F.col("f"))).select("d", "th", "start", "n")


def _of_doc(found: DataFrame, name: str) -> DataFrame:
    """o_d, o_th and the list of what was found for each document; repeated rows of a document count once."""
    one = found.groupBy(F.col("d").alias("o_d"), F.col("th").alias("o_th"), "start").agg(F.max("n").alias("n"))
    return one.groupBy("o_d", "o_th").agg(F.collect_list(F.struct("start", "n")).alias(name))


def repeats(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(d, th, start, n): n windows from the word ``start`` on that also start earlier.

    docs: d, th (which tells apart rows of one id), text; packed: the same with compressed texts.
    """
    spark = docs.sparkSession
    seen = cut(docs.select("text").sample(SAMPLE, seed=1).mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("times")))
    total = seen.agg(F.sum("times")).first()[0] or 0
    often = F.broadcast(cut(seen.filter(F.col("times") > max(LEAST, total * SHARE)).select("anchor", F.lit(True).alias("hot"))))  # at most 1 / SHARE rows
    paths = docs.mapInArrow(_paths, "d long, th long, anchor long, p long, start long, n long").join(often, "anchor", "left")
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = paths.select("d", "th", "anchor", "p", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = paths.repartition("anchor", F.when(F.col("hot"), F.pmod(F.xxhash64("d", "th"), F.lit(shares)))).sortWithinPartitions("anchor", "p", "d", "th", "start")
    met = stored(dealt.mapInArrow(_met, "kind int, d long, th long, start long, n long, anchor long, p long"), "met")
    shared = met.filter(F.col("kind") == SHARED)
    first = shared.groupBy("anchor", "p").agg(F.min(F.struct("d", "th", "start")).alias("f"), F.first("n").alias("n"))
    opened = met.filter(F.col("kind") == OPEN).select("d", "th", "start", "n").unionByName(first.select("f.d", "f.th", "f.start", "n"))
    texts = _with(packed, _of_doc(opened, "open"), "inner").select("d", "th", "packed", "open")
    windows = stored(texts.mapInArrow(_windows, "d long, th long, p long, q long, start long"), "windows").withColumn("n", F.lit(1).cast("long"))
    whole = met.filter(F.col("kind") == REPEATED).select("d", "th", "start", "n")
    return whole.unionByName(_later(shared, "anchor", "p")).unionByName(_later(windows, "p", "q"))


def _with(packed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return packed.join(found, packed.d.eqNullSafe(F.col("o_d")) & (packed.th == F.col("o_th")), how)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text of the words that stay) for each row."""
    own = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"))
    again = cut(own.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1 OR d IS NULL").select(F.col("d").alias("a_d"), F.lit(True).alias("again")))
    if again.isEmpty():
        own = own.withColumn("th", F.lit(0).cast("long"))
    else:
        own = own.join(small_or_not(again, SMALL), F.col("d").eqNullSafe(F.col("a_d")), "left")
        own = own.select("d", "text", F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0)).alias("th"))
    own = own.select("d", "th", "text")
    packed = own.mapInArrow(_packed, "d long, th long, packed binary")
    gone = _of_doc(repeats(own, packed), "gone")
    return _with(packed, gone, "left").select("d", "packed", "gone").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


def op13_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    """What all documents keep."""
    kept = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS u(p)
), again AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, q FROM again, unnest(range(p, p + 20)) AS u(q)
), word AS (
  SELECT doc_id, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(q)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
