"""SimHash near-duplicate classes by a binary trie self-join.

Fingerprints are joined with themselves by walking pairs of trie nodes: children are paired, differing bits added up, and
a pair is pruned as soon as it exceeds the error budget. A sorted array of fingerprints is the trie: a node is a range
of it. To spread the walk over tasks, the root level is dealt out by exact bits: of ``m`` blocks of the 64 bits, a pair
within a budget of e agrees on at least m - e, so for each choice of m - e blocks the fingerprints that agree there form
a trie of their own. Choices with more fingerprints than GROUP are not walked but dealt out again by more, finer blocks
(the next of LEVELS), so that a hot group falls apart. At the last level a group's fingerprints agree on 48 bits, so it
has at most 2^16 of them, and memory is bounded. Linked pairs join their classes as they are found and are then
forgotten, and node pairs of one class are left out: only a spanning forest of the links is kept, in memory too.

Odd input: a null text is empty and has fingerprint zero; fingerprint zero is linked like any other. A null id is never
a class's smallest id, unless all are null. Repeated rows give repeated rows (one_of_each: one row; of rows that share id
and fingerprint, the one whose columns have the smallest hash). A very long text's shingles are hashed some thousands at a
time; its words are held once. An empty table gives an empty result. Other columns are not read (one_of_each keeps them,
whatever their names).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.plans.lineage import cut

BUDGET = 4
#: Blocks of the 64 bits at each level: pairs agree on 2 of 6 (21 bits), 4 of 8 (32), 6 of 10 (38), 12 of 16 (48 bits).
LEVELS = (6, 8, 10, 16)
#: Fingerprints of one trie that are walked in one task before the finer level takes over.
GROUP = 1_000
#: Fingerprints whose tries are walked together, and node pairs that are held at once.
BATCH, FRONTIER = 100_000, 200_000
SHINGLE = 4
HASHED_AT_ONCE = 65_536


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode().lower().split()  # ASCII only: A-Z, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = (ends[-1:] if len(words) < shingle else ends[shingle - 1 :]).tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, HASHED_AT_ONCE):
        j = min(n, i + HASHED_AT_ONCE)
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i:j], stops[i:j], strict=True)], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def _append_fingerprints(at: int):
    def run(batches):
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "__fp"])

    return run


def with_fingerprints(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` and the column __fp (the fingerprint's bits as a signed long)."""
    schema = T.StructType([*df.schema.fields, T.StructField("__fp", T.LongType())])
    return df.mapInArrow(_append_fingerprints(df.columns.index(text_col)), schema)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Puts i and j of each link into one class; a class is named by its smallest position."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def _classes(fps: np.ndarray, group: np.ndarray, budget: int) -> np.ndarray:
    """For each fingerprint the smallest position of its class. fps: unsigned, sorted within the groups, distinct."""
    n = len(fps)
    label = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], n]
    several = last - first > 1
    ones = {}  # ones[d][i]: fingerprints before i whose bit d is set
    stack = [(0, first[several], last[several], first[several], last[several], np.zeros(int(several.sum()), np.int8))]
    turns = None  # turns[i]: places before i where the class changes
    while stack:
        d, a, b, x, y, diff = stack.pop()
        leaf = (b - a == 1) & (y - x == 1)
        if leaf.any():
            i, j = a[leaf], x[leaf]
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (label[i] != label[j])
            if near.any():
                _join(label, i[near], j[near])
                turns = None
            a, b, x, y, diff = (v[~leaf] for v in (a, b, x, y, diff))
        if turns is None:
            turns = np.concatenate([[0, 0], np.cumsum(label[1:] != label[:-1])])
        one_class = (turns[b] == turns[a + 1]) & (turns[y] == turns[x + 1]) & (label[a] == label[x])
        if one_class.any():
            a, b, x, y, diff = (v[~one_class] for v in (a, b, x, y, diff))
        if not len(a):
            continue
        if len(a) > FRONTIER:  # one half after the other: memory stays bounded
            h = len(a) // 2
            stack += [(d, a[:h], b[:h], x[:h], y[:h], diff[:h]), (d, a[h:], b[h:], x[h:], y[h:], diff[h:])]
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]).astype(np.int32)
        c = ones[d]
        mid, at = b - (c[b] - c[a]), y - (c[y] - c[x])
        same = a == x
        parts = [(a, mid, x, at, diff), (mid, b, at, y, diff), (a, mid, at, y, diff + 1), (*(v[~same] for v in (mid, b, x, at, diff + 1)),)]
        a, b, x, y, diff = (np.concatenate(v) for v in zip(*parts, strict=True))
        ok = (b > a) & (y > x) & (diff <= budget) & ~((a == x) & (b - a == 1))
        if ok.any():
            stack.append((d + 1, *(v[ok] for v in (a, b, x, y, diff))))
    return label


def _links(budget: int):
    """Sorted (combo, block, fp) rows to the links of a spanning forest of each (combo, block)."""

    def solve(combo, block, fp):
        group = np.cumsum(np.r_[True, (combo[1:] != combo[:-1]) | (block[1:] != block[:-1])])
        order = np.lexsort((fp.view(np.uint64), group))
        fps = fp[order].view(np.uint64)
        label = _classes(fps, group, budget)
        at = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_pydict({"src": pa.array(fps[at].view(np.int64)), "dst": pa.array(fps[label[at]].view(np.int64))})

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows += batch.num_rows
            if rows < BATCH:
                continue
            combo, block, fp = np.concatenate(held, axis=1)
            done = np.flatnonzero((combo == combo[-1]) & (block == block[-1]))[0]  # the last group may go on
            if done:
                yield solve(combo[:done], block[:done], fp[:done])
            held = [np.stack([combo[done:], block[done:], fp[done:]])]
            rows = len(fp) - done if done else 0
        if held:
            yield solve(*np.concatenate(held, axis=1))

    return run


def _masks(blocks: int, budget: int) -> list[int]:
    """The bits of each choice of blocks - budget blocks, as signed longs."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [m - (1 << 64) if (m := sum(block[i] for i in own)) >> 63 else m for own in combinations(range(blocks), blocks - budget)]


def links(fps: DataFrame, budget: int = BUDGET, levels: tuple[int, ...] = LEVELS, group: int = GROUP) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp, signed long) that span all classes."""
    found = []
    for level, blocks in enumerate(levels):
        masks = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(_masks(blocks, budget))])
        keys = fps.select("fp", F.explode(masks).alias("k")).select("k.combo", "k.block", "fp")
        if level + 1 < len(levels):
            hot = cut(keys.groupBy("combo", "block").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("combo", "block"))
            n_hot = hot.limit(10_001).count()
            if n_hot:
                at = F.broadcast(hot) if n_hot <= 10_000 else hot
                crowded = cut(keys.join(at, ["combo", "block"], "left_semi").select("fp").distinct())
                keys = keys.join(at, ["combo", "block"], "left_anti")
        else:
            n_hot = 0
        walked = keys.repartition(F.col("combo"), F.col("block")).sortWithinPartitions("combo", "block")
        found.append(walked.select("combo", "block", "fp").mapInArrow(_links(budget), "src long, dst long"))
        if not n_hot:
            break
        fps = crowded
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (src, dst); label: the same node for all of a component.

    Each round every node points at its smallest neighbour, pointers are followed to their ends by doubling, edges are
    moved to where their ends point, and loops and repetitions go, until no edge is left. A component that is left
    loses at least half of its nodes a round.
    """
    edges = cut(edges.filter("src <> dst"))
    labels = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.u", "e.v")
        up = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        while True:
            further = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = cut(up.join(further, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            if up.filter("moved").isEmpty():
                break
        to = lambda a, b: up.select(F.col("u").alias(a), F.col("p").alias(b))
        moved = edges.join(to("src", "s"), "src").select("s", "dst").join(to("dst", "d"), "dst").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
        labels = cut(labels.join(to("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        edges = cut(moved.filter("src <> dst").distinct())
    return labels


def classes(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, label, component_id) for each distinct fingerprint of ``rows`` (doc_id, fp), which should be cut.

    label names the class: ids may occur in several classes, so the smallest id doesn't.
    """
    smallest = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(smallest.select("fp"), budget))
    linked = cut(labels.join(smallest, labels.node == smallest.fp).groupBy("label").agg(F.min("least").alias("component_id")))
    linked = cut(labels.join(linked, "label").select(F.col("node").alias("fp"), "label", "component_id"))
    return cut(smallest.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(with_fingerprints(own, "text").select("doc_id", F.col("__fp").alias("fp")))
    return rows.join(classes(rows, budget), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One document of each class: the one with the smallest id (rows with a null id come last). All columns stay.

    Texts are fingerprinted once; only rows whose ids are null or occur again are fingerprinted a second time, as their
    ids don't say which of them is meant.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)])
    own_id, text = F.col(f"d{names.index(id_col)}").cast("long"), f"d{names.index(text_col)}"
    rows = cut(with_fingerprints(plain.select(own_id.alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", F.col("__fp").alias("fp")))
    kind = classes(rows, budget)
    again = cut(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    members = rows.select("doc_id", "fp").distinct().join(kind, "fp")
    # a class of null ids only has no id of its own; its smallest fingerprint stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("m")
    stay = cut(members.groupBy("label").agg(first).select("m.doc_id", "m.fp"))
    alone = stay.filter("doc_id IS NOT NULL").join(again, "doc_id", "left_anti").select(F.col("doc_id").alias("__id"))
    kept = plain.join(alone, own_id == F.col("__id"), "left_semi")
    unclear = stay.join(again, "doc_id", "left_semi").unionByName(stay.filter("doc_id IS NULL"))
    if not unclear.isEmpty():
        known = again.select(F.col("doc_id").alias("__id"))
        marked = with_fingerprints(plain.filter(own_id.isNull()).unionByName(plain.join(known, own_id == F.col("__id"), "left_semi")), text)
        whole = F.struct(*[F.col(c) for c in plain.columns])
        order = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind_of else F.col(c) for c, kind_of in plain.dtypes])
        few = marked.groupBy(own_id.alias("__id"), "__fp").agg(F.min_by(whole, order).alias("r"))  # pre-aggregated: many rows may be equal
        few = few.join(unclear, (F.col("__fp") == F.col("fp")) & F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi")
        kept = kept.unionByName(few.select("r.*"))
    return kept.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])


def op2_simhash_trie(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
