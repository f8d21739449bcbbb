"""Histogram gradient boosting over binned features, and permutation importance in one pass.

Every feature has at most BINS bins, bin 0 for what is missing or unknown: numbers by their values or quantiles, categories
each its own bin, or, if there are more, bins of categories whose mean label is alike. A tree is grown level by level:
each task sums the gradients of its rows by node, feature and bin, the sums are added up by Spark, and the driver, which
sees a bounded number of bins, picks each node's best split: numbers in order, with the missing ones on either side,
categories in the order of their gradients. Gradients are summed as integers, so results don't depend on the order. Rows
of equal bins are one row with their number and the sum of their labels, so that all passes are over distinct rows only.

Importance: rows have dense numbers, and a Feistel network on numbers deals a feature's values out anew; all features and
repeats are dealt out in one shuffle and scored in one pass.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.plans.lineage import small_or_not, stored

BINS = 256
#: Gradients are rounded to this part of one; the smoothing that categories are ordered with; the least rows of a leaf.
UNIT, SMOOTH, LEAST_LEAF = 1 << 20, 10.0, 20
MOST_CODES = 200_000
LEFT = 0.02


@dataclass
class Tree:
    """Nodes in the order they were made: a leaf has feature -1 and leads to itself."""

    feature: np.ndarray
    left_bins: np.ndarray  # node, bin: goes left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            to = np.where(self.left_bins[at, x[rows, np.maximum(f, 0)]], self.left[at], self.right[at])
            at = np.where(f < 0, at, to)


@dataclass
class Boosted:
    """A fitted model: bins of numbers, codes of categories (feature, value, bin), trees."""

    categories: list[str]
    numbers: list[str]
    cuts: dict[str, list[float]]
    codes: DataFrame
    loss: str
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, df: DataFrame) -> DataFrame:
        """``df`` with the column __x, a byte for each feature; categories meet their codes in a join, broadcast if they are few."""
        for i, c in enumerate(self.categories):
            own = self.codes.filter(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("bin").alias(f"__c{i}"))
            df = df.join(small_or_not(own, MOST_CODES), df[c].cast("string") == F.col("__v"), "left").drop("__v")
        cuts = [np.array(self.cuts[n]) for n in self.numbers]

        @F.pandas_udf("binary")
        def pack(codes: pd.DataFrame, numbers: pd.DataFrame) -> pd.Series:
            x = np.zeros((len(codes), len(codes.columns) + len(cuts)), np.uint8)
            x[:, : len(codes.columns)] = codes.fillna(0).to_numpy(np.uint8)
            for j, c in enumerate(cuts):
                v = numbers.iloc[:, j].to_numpy(np.float64)
                x[:, len(codes.columns) + j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, side="left"))
            return pd.Series([r.tobytes() for r in x])

        none = F.lit(0)
        codes = F.struct(*([F.col(f"__c{i}").alias(f"c{i}") for i in range(len(self.categories))] or [none.alias("c")]))
        numbers = F.struct(*([F.col(n).cast("double").alias(n) for n in self.numbers] or [none.cast("double").alias("n")]))
        return df.withColumn("__x", pack(codes, numbers)).drop(*[f"__c{i}" for i in range(len(self.categories))])

    def width(self) -> int:
        return max(1, len(self.categories)) + len(self.numbers)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf(x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with raw, probability and prediction (0 or 1), or with the predicted number."""
        plain = Boosted([], [], {}, None, self.loss, self.base, self.trees)  # tasks need the trees only
        width = self.width()

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(plain.raw(np.frombuffer(b"".join(x), np.uint8).reshape(-1, width)))

        out = self.binned(df).withColumn("raw", score("__x")).drop("__x")
        if self.loss == "squared":
            return out.withColumnRenamed("raw", "prediction")
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("raw")))).withColumn("prediction", (F.col("raw") > 0).cast("double"))

    def save(self, path: str) -> None:
        """Codes as Parquet, the rest as a text."""
        trees = [{k: (np.packbits(v, axis=1) if v.ndim == 2 else v).tolist() for k, v in vars(t).items()} for t in self.trees]
        text = json.dumps({"categories": self.categories, "numbers": self.numbers, "cuts": self.cuts, "loss": self.loss, "base": self.base, "trees": trees})
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.codes.sparkSession.createDataFrame([(text,)], "model string").write.mode("overwrite").parquet(f"{path}/model")


def load(spark, path: str) -> Boosted:
    """A saved model."""
    m = json.loads(spark.read.parquet(f"{path}/model").first().model)
    trees = [Tree(np.array(t["feature"]), np.unpackbits(np.array(t["left_bins"], np.uint8), axis=1).astype(bool), np.array(t["left"]), np.array(t["right"]), np.array(t["value"], float)) for t in m["trees"]]
    return Boosted(m["categories"], m["numbers"], m["cuts"], spark.read.parquet(f"{path}/codes"), m["loss"], m["base"], trees)


def number_cuts(df: DataFrame, numbers: list[str]) -> dict[str, list[float]]:
    """Upper ends of bins: between neighbouring values if these are few, else quantiles."""
    if not numbers:
        return {}
    v = [F.col(n).cast("double").alias(n) for n in numbers]
    some = df.select(*v)
    about = some.agg(*[F.approx_count_distinct(n).alias(n) for n in numbers]).first()
    cuts = {}
    for n in numbers:
        own = [r[0] for r in some.select(n).filter(f"{n} IS NOT NULL AND NOT isnan({n})").distinct().limit(BINS).collect()] if about[n] < BINS else None
        if own is not None and len(own) < BINS:
            own.sort()
            cuts[n] = [(a + b) / 2 for a, b in zip(own, own[1:], strict=False)][: BINS - 2]
        else:
            cuts[n] = sorted(set(some.approxQuantile(n, [i / (BINS - 1) for i in range(1, BINS - 1)], 0.0005)))
    return cuts


def category_codes(df: DataFrame, categories: list[str], label: str) -> DataFrame:
    """feature, value, bin (from 1): each category a bin, commonest first; of more than there are bins, those of like mean labels share one."""
    out = df.sparkSession.createDataFrame([], "feature string, value string, bin int")
    for c in categories:
        counts = stored(df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.avg(F.col(label)).alias("mean")), "categories")
        few = counts.orderBy(F.desc("n"), "value").limit(BINS).collect()
        if len(few) < BINS:
            own = df.sparkSession.createDataFrame([(c, r.value, i + 1) for i, r in enumerate(few)], out.schema)
        else:
            ends = sorted(set(counts.approxQuantile("mean", [i / (BINS - 1) for i in range(1, BINS - 1)], 0.0005)))
            at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("mean"))) + 1
            own = counts.select(F.lit(c).alias("feature"), "value", at.cast("int").alias("bin"))
        out = out.unionByName(own)
    return out


def grouped(rows: DataFrame, unit: float) -> DataFrame:
    """x, n, s, y: rows (x, y) of equal bins as one, with their number, the sum of their labels in units, and as it is."""
    return rows.groupBy("x").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("y") * unit).cast("long")).alias("s"), F.sum("y").alias("y"))


def _gradients(loss: str, raw: np.ndarray, n: np.ndarray, s: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of first and second gradients of n rows each, in whole units; s: the sum of their labels in units."""
    if loss == "squared":
        return n * np.rint(raw * unit) - s, n * np.rint(unit)
    p = 1 / (1 + np.exp(-raw))
    return n * np.rint(p * unit) - s, n * np.rint(p * (1 - p) * unit)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _histograms(model: Boosted, tree: Tree, width: int, unit: float):
    """Each task's sums of gradients (in units), second ones and rows by leaf of the growing tree, feature and bin."""

    def run(batches):
        nodes = len(tree.feature)
        total = np.zeros((3, nodes * width * BINS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n, s = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            g, h = _gradients(model.loss, model.raw(x), n, s, unit)
            at = tree.leaf(x)[:, None] * (width * BINS) + np.arange(width) * BINS + x
            for i, v in enumerate((g, h, n)):
                total[i] += np.bincount(at.ravel(), np.repeat(v, width), nodes * width * BINS).astype(np.int64)  # whole numbers below 2^53
        cell = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "g": total[0][cell], "h": total[1][cell], "n": total[2][cell]})

    return run


def _gain(g, h):
    return np.where(h > 0, g * g / np.where(h > 0, h, 1.0), 0.0)


def best_split(sums: np.ndarray, category: bool, least: int = LEAST_LEAF) -> tuple[float, np.ndarray]:
    """The gain of a feature's best split of one node, and the bins that go left. sums: gradients, second ones and rows by bin."""
    g, h, n = sums
    there = np.flatnonzero(n)
    if category:
        ways = [there[np.lexsort((there, g[there] / (h[there] + SMOOTH)))]]
    else:
        known = there[there > 0]
        ways = [known] if not n[0] else [np.r_[0, known], np.r_[known, 0]]  # the missing ones left or right
    best, bins = 0.0, np.zeros(BINS, bool)
    whole = _gain(g.sum(), h.sum())
    for order in ways:
        a, b, c = (np.cumsum(v[order])[:-1] for v in (g, h, n))
        fits = (c >= least) & (n.sum() - c >= least)
        if fits.any():
            gains = np.where(fits, _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - whole, 0.0)
            k = int(gains.argmax())
            if gains[k] > best + 1e-12:
                best, bins = float(gains[k]), np.isin(np.arange(BINS), order[: k + 1])
    return best, bins


def _unit(df: DataFrame, loss: str) -> float:
    """Gradients in these parts of one; labels of any size keep sums within 64 bits."""
    most = 1.0 if loss == "log" else max(1.0, df.agg(F.max(F.abs("y"))).first()[0] or 1.0)
    return UNIT / 2 ** math.ceil(math.log2(most))


def fit(df: DataFrame, label: str, categories: list[str], numbers: list[str], loss: str = "log", trees: int = 20, depth: int = 3, rate: float | None = None) -> Boosted:
    """A boosted model of ``label`` (0 or 1 with loss "log", a number with "squared"); rows without a label are left out.

    Without a rate, fewer trees take larger steps: at most LEFT of a signal that a tree can express is left after all.
    """
    rate = rate if rate is not None else max(0.2, 1 - LEFT ** (1 / max(trees, 1)))
    df = df.filter(F.col(label).isNotNull())
    model = Boosted(categories, numbers, number_cuts(df, numbers), category_codes(df, categories, label).persist(), loss, 0.0)
    unit, width = _unit(df.select(F.col(label).cast("double").alias("y")), loss), model.width()
    rows = stored(grouped(model.binned(df).select(F.col("__x").alias("x"), F.col(label).cast("double").alias("y")), unit), "binned").persist()
    try:
        mean = rows.agg(F.sum("y") / F.sum("n")).first()[0]
        if mean is None:
            return model
        model.base = mean if loss == "squared" else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
        for _ in range(trees):
            model.trees.append(_grow(rows, model, width, unit, depth, rate))
        return model
    finally:
        rows.unpersist()


def sums_of(rows: DataFrame, model: Boosted, tree: Tree, width: int, unit: float) -> np.ndarray:
    """sum, node, feature, bin: over all rows (x, y, or grouped); at most as many numbers as a tree has leaves, times all bins."""
    rows = (rows if "n" in rows.columns else grouped(rows, unit)).select("x", "n", "s")
    plain = Boosted([], [], {}, None, model.loss, model.base, model.trees)
    cells = rows.mapInArrow(_histograms(plain, tree, width, unit), "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = np.zeros((3, len(tree.feature) * width * BINS))
    at = cells["cell"].to_numpy()
    for i, c in enumerate("ghn"):
        out[i, at] = cells[c].to_numpy() / (unit if c != "n" else 1.0)
    return out.reshape(3, len(tree.feature), width, BINS)


def root() -> Tree:
    return Tree(np.array([-1]), np.zeros((1, BINS), bool), np.array([0]), np.array([0]), np.zeros(1))


def _grow(rows: DataFrame, model: Boosted, width: int, unit: float, depth: int, rate: float) -> Tree:
    tree, open_nodes = root(), [0]
    for level in range(depth):
        sums = sums_of(rows, model, tree, width, unit)
        made = []
        for node in open_nodes:
            if level == 0:
                g, h, _ = sums[:, node, 0].sum(axis=1)
                tree.value[node] = -rate * g / h if h > 0 else 0.0
            splits = [best_split(sums[:, node, f], f < max(1, len(model.categories))) for f in range(width)]
            f = max(range(width), key=lambda i: splits[i][0])  # the first of equal ones
            gain, bins = splits[f]
            if gain <= 0:
                continue
            n = len(tree.feature)
            tree.feature[node], tree.left_bins[node], tree.left[node], tree.right[node] = f, bins, n, n + 1
            for own in (bins, ~bins):
                g, h = sums[0, node, f, own].sum(), sums[1, node, f, own].sum()
                tree = Tree(np.r_[tree.feature, -1], np.vstack([tree.left_bins, np.zeros(BINS, bool)]), np.r_[tree.left, len(tree.left)], np.r_[tree.right, len(tree.right)], np.r_[tree.value, -rate * g / h if h > 0 else 0.0])
            made += [n, n + 1]
        open_nodes = made
        if not made:
            break
    return tree


def feistel(i: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of 0 to n - 1, applied to numbers: a Feistel network on as many bits as are needed, again while beyond n."""
    half = np.uint64(max(1, math.ceil(max(n - 1, 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v):
        left, right = v >> half, v & mask
        for r in range(rounds):
            m = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
            m = (m ^ (m >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((m ^ (m >> np.uint64(29))) & mask)
        return (left << half) | right

    out = once(np.asarray(i).astype(np.uint64))
    while (beyond := out >= n).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` (stored) with dense numbers __i from 0, and how many there are; one number a partition meets the rows."""
    rows = stored(df.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("n"), F.min("__m").alias("low")).orderBy("__p").collect()  # a row a partition
    first, at = [], 0
    for r in sizes:
        first.append((r["__p"], at - r["low"]))
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(first or [(0, 0)], "__p long, __o long")
    return rows.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("__i", F.col("__m") + F.col("__o")).drop("__p", "__m", "__o"), at


def importance(model: Boosted, test: DataFrame, label: str = "label", repeats: int = 5) -> DataFrame:
    """feature, importance: the mean fall of the share of right predictions when a feature's values are dealt out anew."""
    spark, width = test.sparkSession, model.width()
    rows, n = numbered(model.binned(test).select(F.col("__x").alias("x"), F.col(label).cast("double").alias("y")))
    names = [*(model.categories or ["-"]), *model.numbers]
    trees = Boosted([], [], {}, None, model.loss, model.base, model.trees)

    def deal(batches):
        for batch in batches:
            x, i = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            for c in range(width * repeats):
                yield pa.RecordBatch.from_pydict({"to": feistel(i, n, c + 1), "c": np.full(len(i), c, np.int32), "v": x[:, c // repeats].astype(np.int32)})

    def right(batches):
        hits = np.zeros(width * repeats + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0), width), batch.column(1).to_numpy() > 0.5
            hits[-1] += ((trees.raw(x) > 0) == y).sum()
            dealt = batch.column(2).flatten()
            v = np.zeros((len(y), width * repeats), np.uint8)
            v[np.repeat(np.arange(len(y)), width * repeats), dealt.field(0).to_numpy()] = dealt.field(1).to_numpy()
            for c in range(width * repeats):
                other = x.copy()
                other[:, c // repeats] = v[:, c]
                hits[c] += ((trees.raw(other) > 0) == y).sum()
        yield pa.RecordBatch.from_pydict({"c": np.arange(len(hits), dtype=np.int32), "n": hits})

    dealt = rows.select("x", "__i").mapInArrow(deal, "to long, c int, v int").groupBy("to").agg(F.collect_list(F.struct("c", "v")).alias("dealt"))
    met = rows.join(dealt, F.col("__i") == F.col("to")).select("x", "y", "dealt")
    hits = {r.c: r.n for r in met.mapInArrow(right, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    base = hits.get(width * repeats, 0)
    falls = [(f, sum(base - hits.get(j * repeats + i, 0) for i in range(repeats)) / repeats / max(n, 1)) for j, f in enumerate(names)]
    return spark.createDataFrame([(f, float(v)) for f, v in falls if f != "-"], "feature string, importance double").orderBy(F.desc("importance"), "feature")
