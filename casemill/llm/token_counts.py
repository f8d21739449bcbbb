"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are laid end to end in one ragged array of symbols. In each round every sequence finds
its lowest-rank adjacent pair, all sequences apply theirs at once (each occurrence, from the left), and sequences without
a known pair drop out. What survives is counted. Counts of pre-tokens seen before are kept by the worker. A pre-token of
over LONG bytes would need a round for each of its many pairs over all of it, so its merges are taken from a heap.

Normalisation (NFC, white space to one space, character-wise lower case) and splitting follow the vocabulary file; its
special strings inside a text are one token each.

Odd input: a null text is empty and has 0 bytes and tokens; a null id is kept; repeated rows give repeated rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a worker keeps.
KEPT = 600_000
#: Bytes from which a pre-token is merged by a heap, and is too long to be kept.
LONG = 2_000
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Merges:
    """Ranks and results of symbol pairs, found by hashing."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        suffix = model["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.final = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size = len(vocab) + len(model["added_tokens"])
        keys, first = np.unique(pairs[:, 0] * self.size + pairs[:, 1], return_index=True)  # the first rank of a pair counts
        self.bits = int(np.ceil(np.log2(len(keys)))) + 3
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.made = np.zeros(1 << self.bits, np.int64)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):  # linear probing, all keys of a round at once
            free = self.keys[slot] < 0
            _, winner = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = winner[free[winner]]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[left[put]], first[left[put]], made[first[left[put]]]
            rest = np.setdiff1d(np.arange(len(left)), put)
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

        self.pairs = {k: (r, m) for k, r, m in zip(keys.tolist(), first.tolist(), made[first].tolist(), strict=True)}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = a * self.size + b
        slot, out, open_ = self.slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = slot[hit]
            go = ~hit & (held >= 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) piece."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.first[raw]
        last = np.cumsum(n) - 1
        sym[last] = self.final[raw[last]]
        seq = np.repeat(np.arange(len(pieces)), n)
        counts = n.copy()
        slot = self._slots(sym, seq)
        while len(sym):
            rank = np.where(slot >= 0, self.ranks[slot], NO_RANK)
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[start, len(seq)])
            low = np.repeat(np.minimum.reduceat(rank, start), size)
            go = low < NO_RANK  # whole sequences
            if not go.all():
                sym, seq, slot, rank, low = sym[go], seq[go], slot[go], rank[go], low[go]
                if not len(sym):
                    break
            pick = rank == low
            # of overlapping occurrences (a pair of equal symbols) every other one counts, from the left
            at = np.flatnonzero(pick)
            run = np.r_[True, np.diff(at) > 1]
            odd = (np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
            at = at[~odd]
            sym[at] = self.made[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.zeros(len(sym), bool)
            new[at] = True
            counts -= np.bincount(seq[at], minlength=len(counts))
            sym, seq, slot, new = sym[keep], seq[keep], slot[keep], new[keep]
            old = np.flatnonzero(new | np.r_[new[1:], False])  # pairs that have changed
            slot[old] = -1
            old = old[old + 1 < len(sym)]
            old = old[seq[old] == seq[old + 1]]
            slot[old] = self.find(sym[old], sym[old + 1])
        return counts

    def count_long(self, piece: bytes) -> int:
        """Tokens of one long piece: the lowest-rank pair, leftmost first, from a heap."""
        sym = [int(self.first[b]) for b in piece[:-1]] + [int(self.final[piece[-1]])]
        n, size, pairs = len(sym), self.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (p := pairs.get(sym[i] * size + sym[i + 1]))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one of them was merged in the meantime
                continue
            sym[i], sym[j] = pairs[a * size + b][1], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get(sym[i] * size + sym[k]):
                    heapq.heappush(heap, (p[0], i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (p := pairs.get(sym[h] * size + sym[i])):
                heapq.heappush(heap, (p[0], h, sym[h], sym[i]))
        return left

    def _slots(self, sym, seq):
        out = np.full(len(sym), -1, np.int64)
        pair = np.flatnonzero(seq[1:] == seq[:-1])
        out[pair] = self.find(sym[pair], sym[pair + 1])
        return out


class Counter:
    """Counts tokens of texts as the library does."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)))
        self.seen: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: characters are lowered one by one
        return self.split.findall(text.lower())

    def counts(self, texts: list[str | None]) -> list[int]:
        per_text, specials = [], []
        for t in texts:
            t = t or ""
            if "<|" in t and (k := len(self.special.findall(t))):
                specials.append(k)
                per_text.append([p for part in self.special.split(t) for p in self.pieces(part)])
            else:
                specials.append(0)
                per_text.append(self.pieces(t))
        if len(self.seen) > KEPT:
            self.seen.clear()
        new = list(set().union(*per_text).difference(self.seen))
        long = {p: self.merges.count_long(b) for p in new if len(p) * 4 > LONG and len(b := p.encode()) > LONG}
        if new := [p for p in new if p not in long]:
            self.seen.update(zip(new, self.merges.count([p.encode() for p in new]).tolist(), strict=True))
        count = self.seen.__getitem__ if not long else lambda p: long[p] if p in long else self.seen[p]
        return [k + sum(map(count, own)) for k, own in zip(specials, per_text, strict=True)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = counter(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                n = np.array(c.counts(batch.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_rank_merge_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
