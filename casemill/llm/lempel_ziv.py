"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into LZ78 phrases: each is the longest phrase known so far and one more byte. The set of
phrases is hashed and kept as a minimum-hash signature: SLOTS slots, each phrase falls into one and each slot keeps the
smallest hash, of which 16 bits are written (0: an empty slot). The likeness of two fingerprints is the share of equal
slots among those that are not empty in both; texts that compress alike share phrases.

Neighbours (the next document by id) are found without a global sort in one task: ids are cut into ranges at quantiles,
about RANGE_BYTES of text each, every range is a partition, and the first row of each range is also sent to the range
before. An id with more rows than a range (null, say) is cut further by the hash of the text.

Odd input: a null text is empty; two empty fingerprints have likeness 1, an empty and another one 0; null ids come before
all others; rows of equal ids follow by a hash of their text; a single row is its own next one. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 128
#: Bytes of text of a range, and the number of ranges at most.
RANGE_BYTES, MOST_RANGES = 8_000_000, 100_000
#: Bits of the hash that rows of equal ids are ordered by.
BITS = 52
_MASK = (1 << 64) - 1


class Parse:
    """An LZ78 parse that can be copied and continued."""

    def __init__(self, nodes=None, hashes=None, at: int = 0):
        self.nodes: dict[int, int] = nodes if nodes is not None else {}
        self.hashes: list[int] = hashes if hashes is not None else [0x9E3779B97F4A7C15]
        self.at = at

    def copy(self) -> Parse:
        return Parse(self.nodes.copy(), self.hashes.copy(), self.at)

    def feed(self, data: bytes) -> Parse:
        nodes, hashes, at = self.nodes, self.hashes, self.at
        find, add, n = nodes.get, hashes.append, len(hashes)
        for byte in data:
            key = at | byte
            node = find(key)
            if node is None:
                nodes[key] = n << 8
                n += 1
                h = (hashes[at >> 8] ^ byte) * 0xD6E8FEB86659FD93 & _MASK
                add(h ^ h >> 32)
                at = 0
            else:
                at = node
        self.at = at
        return self

    def signature(self) -> np.ndarray:
        """The 16-bit signature of the phrases."""
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = np.full(SLOTS, _MASK, np.uint64)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(least, slot, h)
        short = ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16)
        return np.where(least == np.uint64(_MASK), 0, np.maximum(short, 1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum() / used) if used else 1.0


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """A text's fingerprint: SLOTS numbers of four hex digits."""
    return to_hex(Parse().feed((text or "").encode()).signature())


def compare(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """The signatures of a text and of its edited text, and the edited text: its second half comes from the next one."""
    half = len(text) // 2
    head = text[: len(text) - half]
    parse = Parse().feed(head.encode())
    tail = following[:half]
    other = parse.copy().feed(tail.encode())  # the parse of the shared head is not done twice
    return parse.feed(text[len(head) :].encode()).signature(), other.signature(), head + tail


def _pairs(batches):
    """Rows sorted by range, extra and id: each but a range's extra rows with the row after it."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = None  # the row that waits for its next one: range, id, text
    waiting = None  # its result but for the likeness to the next one: own signature and columns
    out: list[tuple] = []
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            for part, key, text, extra in zip(*(whole.slice(i, 500).column(c).to_pylist() for c in range(4)), strict=True):
                if held is not None and held[0] == part:
                    own, other, edited = compare(held[2], text)
                    if waiting is not None:
                        out.append((*waiting[1], likeness(waiting[0], own)))
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    waiting = own, (held[1], len(held[2]), sha, to_hex(own), to_hex(other), likeness(own, other))
                    if extra:  # the last row of the range is done; further extra rows have nothing to wait for them
                        out.append((*waiting[1], likeness(own, Parse().feed(text.encode()).signature())))
                        waiting = None
                held = None if extra else (part, key, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))
                out = []


def _nested(values: list, width: int) -> list[list]:
    return [values[i : i + width] for i in range(0, len(values), width)]


def with_next(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, extra): rows in ranges of ids; a range's extra row is the next one after its last row.

    docs: doc_id long, text string. Each range is a partition; its rows are sorted by extra, id, hash and text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS)
    size = docs.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    wanted = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    found = docs.select(key.alias("k")).approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    cuts = sorted({int(x) for x in found})
    times = [sum(1 for _ in g) for _, g in itertools.groupby(sorted(int(x) for x in found))]  # a cut that recurs is an id of many rows
    base = [0, *itertools.accumulate([1, *times])]  # ranges before the first cut (one), then those of each cut
    width = max(1, int(len(cuts) ** 0.5))
    groups = _nested(cuts, width)  # two short searches instead of a long one
    lit = lambda v, kind="array<array<bigint>>": F.from_json(F.lit(json.dumps(v)), kind)
    look = lambda table, i: F.element_at(F.element_at(table, (i / width).cast("int") + 1), (i % width).cast("int") + 1)
    g = F.size(F.filter(lit([x[0] for x in groups], "array<bigint>"), lambda c: c <= F.col("k")))
    at = F.when(g == 0, F.lit(-1)).otherwise((g - 1) * width + F.size(F.filter(F.element_at(lit(groups or [[0]]), F.greatest(g, F.lit(1))), lambda c: c <= F.col("k"))) - 1)
    rows = docs.select("doc_id", "text", key.alias("k"), tie.alias("u")).withColumn("at", at)
    # of an id of many rows: its part by the hash; larger ids up to the next cut follow in the last part
    here = F.greatest(F.col("at"), F.lit(0))
    several, own = look(lit(_nested(times or [1], width)), here), F.col("k") == look(lit(_nested(cuts or [0], width)), here)
    sub = F.when(own, F.floor(F.col("u") / F.lit(float(1 << BITS)) * several)).otherwise(several - 1)
    part = F.when(F.col("at") < 0, F.lit(0)).otherwise(look(lit(_nested(base[1:] if cuts else [0], width)), here) + sub).cast("int")
    rows = rows.select("doc_id", "text", "k", "u", part.alias("part"))
    ends = rows.groupBy("part").agg(F.min(F.struct("k", "u")).alias("f")).collect()  # a row a range
    first = {r.part: (r.f.k, r.f.u) for r in ends}
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first one's is the last
    n = base[-1]
    table = lambda of: lit(_nested([of(p) for p in range(n)], width))
    to_before = look(table(before.get), F.col("part")).cast("int")
    is_first = (F.col("k") == look(table(lambda p: first.get(p, (None,))[0]), F.col("part"))) & (F.col("u") == look(table(lambda p: first.get(p, (0, None))[1]), F.col("part")))
    stay = F.struct("part", F.lit(False).alias("extra"))
    to = F.when(is_first, F.array(stay, F.struct(to_before.alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(stay))
    dealt = rows.select("doc_id", "text", "k", "u", F.explode(to).alias("to")).select("to.part", "doc_id", "text", "to.extra", "k", "u")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", "k", "u", "text").select("part", "doc_id", "text", "extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(own).mapInArrow(_pairs, schema)


def op7_lempel_ziv(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
