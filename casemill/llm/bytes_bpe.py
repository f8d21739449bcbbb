"""Byte-level BPE: overlapping chunk encoding and decoding.

A text longer than CHUNK is cut into chunks that overlap. The chunks are dealt out and pre-tokenised in parallel, each
from its own start. Pre-token boundaries of a chunk are trusted up to its last run of white space (a match that ends
there saw all it depends on). Where boundaries of the text so far and of the next chunk coincide, both go on alike, so
the chunk's boundaries are taken over from there; until then (for a chunk without white space, right through it)
matching goes on from the last boundary. Chunks' pre-tokens are encoded by rank where the chunks are; stitching joins
their ids and encodes only what had to be matched anew. Decoding joins the ids' raw bytes. Shorter texts are chunks of
their own and need no stitching or shuffle.

Odd input: a null text is empty; an empty text has no ids; repeated rows give repeated rows; a null id is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, and those it shares with the next.
CHUNK, OVERLAP = 16_384, 512
#: Pre-tokens whose ids a worker keeps.
KEPT = 400_000

_BLANK_RUN = regex.compile(r"\s+")


class Codec:
    """Encodes pre-tokens with a rank file, keeping the ids of those it has seen."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.narrow = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.seen: dict[str, bytes] = {}

    def each(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        seen = self.seen
        try:
            return list(map(seen.__getitem__, pieces))
        except KeyError:
            if len(seen) > KEPT:
                seen.clear()
            one = self.encoding._encode_single_piece
            for p in set(pieces).difference(seen):
                seen[p] = np.array(one(p), "<u4").tobytes()
            return list(map(seen.__getitem__, pieces))

    def ids(self, pieces: list[str]) -> bytes:
        """The ids of the pieces, one after the other."""
        return b"".join(self.each(pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def trusted_boundaries(pattern, text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that further text cannot change."""
    ends = [m.end() for m in pattern.finditer(text)]
    if last:
        return ends
    tail = len(text.rstrip())  # the last run of white space may be at the end: then the one before counts
    limit = max((m.start() for m in _BLANK_RUN.finditer(text, max(0, tail - OVERLAP), tail)), default=None)
    if limit is None:
        limit = max((m.start() for m in _BLANK_RUN.finditer(text, 0, tail)), default=0)
    return ends[: int(np.searchsorted(ends, limit, side="right"))]


def stitch(pattern, text: str, starts: list[int], boundaries: list[np.ndarray]):
    """The pre-tokens of the whole text, from each chunk's start and trusted boundaries (relative to it).

    Yields (chunk, i, j) where the chunk's pre-tokens i to j stand, and (None, a, b) for a stretch that is matched anew.
    """
    held, ends, i, at = 0, np.zeros(0, np.int64), 0, 0  # of chunk ``held``, pre-tokens from i on are next
    for n, (start, own) in enumerate(zip(starts, boundaries, strict=True)):
        own = start + np.asarray(own, np.int64)
        if n:
            # boundaries of earlier chunks beyond this chunk's start: the first shared one is where both resynchronise
            k = max(i, int(np.searchsorted(ends, start, side="right")))
            shared = np.flatnonzero(np.isin(ends[k:], own))
            stop = k + int(shared[0]) + 1 if len(shared) else len(ends)
            if stop > i:
                yield held, i, stop
                at = int(ends[stop - 1])
            if not len(shared) and len(own):
                known = set(own.tolist())
                while at < own[-1] and at not in known:
                    end = pattern.match(text, at).end()
                    yield None, at, end
                    at = end
        held, ends, i = n, own, int(np.searchsorted(own, at, side="right"))
        if n and i < len(own) and at not in own:  # beyond all that it knows together with the text
            i = len(own)
    if i < len(ends):
        yield held, i, len(ends)
        at = int(ends[-1])
    while at < len(text):
        end = pattern.match(text, at).end()
        yield None, at, end
        at = end


def _result(doc_ids, encoded: list[bytes], decoded: list[bytes], with_ids: bool) -> pa.RecordBatch:
    return _table(doc_ids, encoded, [hashlib.sha256(e).hexdigest() for e in encoded], [hashlib.sha256(d).hexdigest() for d in decoded], with_ids)


def _table(doc_ids, encoded: list[bytes], ids_sha: list[str], decoded_sha: list[str], with_ids: bool) -> pa.RecordBatch:
    out = {"doc_id": doc_ids, "n_tokens": pa.array([len(e) // 4 for e in encoded], pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
    if with_ids:
        flat = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_pydict(out)


def _encode_short(path: str, pattern: str, with_ids: bool):
    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                encoded = [c.ids(c.pattern.findall(t)) for t in batch.column(1).to_pylist()]
                yield _result(batch.column(0), encoded, [c.decode(e) for e in encoded], with_ids)

    return run


def _cut_chunks(path: str, pattern: str):
    """Of each chunk: lengths, numbers of ids (16 bits each, as a chunk is short) and ids of its trusted pre-tokens, and
    what text follows them. The rest of the text is in the ids."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, last in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                ends = trusted_boundaries(c.pattern, text, last)
                each = c.each([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])  # none, if no end is trusted
                n = np.fromiter(map(len, each), np.int64, len(each)) // 4
                ids = np.frombuffer(b"".join(each), "<u4").astype(c.narrow)
                rest = text[ends[-1] if ends else 0 :]
                for column, value in zip(out, (np.diff(np.array([0, *ends])).astype("<u2").tobytes(), n.astype("<u2").tobytes(), ids.tobytes(), rest), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", "key", "copies", "chunk", "lengths", "n", "ids", "rest"])

    return run


def _join_chunks(path: str, pattern: str, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        table = table.sort_by("chunk")
        boundaries = [np.cumsum(np.frombuffer(x, "<u2"), dtype=np.int64) for x in table["lengths"].to_pylist()]
        begins = [np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u2"), dtype=np.int64)]) for x in table["n"].to_pylist()]
        ids = [np.frombuffer(x, c.narrow).astype("<u4") for x in table["ids"].to_pylist()]
        parts = [c.decode(i.tobytes()).decode() + rest for i, rest in zip(ids, table["rest"].to_pylist(), strict=True)]
        text = "".join([*(p[:CHUNK] for p in parts[:-1]), parts[-1]])
        encoded, decoded = [], hashlib.sha256()
        for n, a, b in stitch(c.pattern, text, [k * CHUNK for k in table["chunk"].to_pylist()], boundaries):
            encoded.append(c.ids([text[a:b]]) if n is None else ids[n][begins[n][a] : begins[n][b]].tobytes())
            decoded.update(c.decode(encoded[-1]))
        whole, copies = b"".join(encoded), table["copies"][0].as_py()
        doc_ids = pa.array([table["doc_id"][0].as_py()] * copies, pa.int64())
        return pa.Table.from_batches([_table(doc_ids, [whole] * copies, [hashlib.sha256(whole).hexdigest()] * copies, [decoded.hexdigest()] * copies, with_ids)])

    return run


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array of int) for each row."""
    path = ranks or public_tokenizers.path(RANKS)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    short = own.filter(n <= CHUNK).mapInArrow(_encode_short(path, pattern, with_ids), schema)
    last = F.greatest(F.ceil((n - OVERLAP) / F.lit(CHUNK)).cast("int") - 1, F.lit(0))  # what follows the last chunk is an overlap at most
    cut_up = own.filter(n > CHUNK).select("doc_id", F.xxhash64("text").alias("key"), "text", last.alias("last")).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    part = F.substring("text", F.col("chunk") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("part")
    chunks = (
        cut_up.select("doc_id", "key", "chunk", part, (F.col("chunk") == F.col("last")).alias("is_last"))
        .groupBy("doc_id", "key", "chunk", "part", "is_last").agg(F.count("*").alias("copies"))  # deals the chunks out; equal rows are one
        .select("doc_id", "key", "copies", "chunk", "part", "is_last")
        .mapInArrow(_cut_chunks(path, pattern), "doc_id long, key long, copies long, chunk int, lengths binary, n binary, ids binary, rest string")
    )
    return short.unionByName(chunks.groupBy("doc_id", "key").applyInArrow(_join_chunks(path, pattern, with_ids), schema))


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token count, the digest of its ids and that of the bytes they decode to."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
