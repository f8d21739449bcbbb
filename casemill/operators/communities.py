"""Communities by modularity: local moves in aggregates, then contraction, repeated.

All nodes start alone. In a round, a share of the nodes (by a hash that changes from cycle to cycle, so that no two
neighbours swap for ever) each moves to the neighbouring community of the highest gain, all at once. Since moves made at
once may get into each other's way, the modularity is taken each round: a round that lowers it is undone, and from then
on fewer nodes move at once. When a cycle gains too little, communities become the nodes of a smaller weighted graph and
the same is done to that; nodes that have no neighbours left stay behind. Ties go to the node's own community, then to
the smaller name, so results repeat.

The pairs of a level are dealt by their first node to blocks of some PAIRS pairs, packed once. A round sends each node's
community once to each block that its pairs occur in, not along each pair, and a block finds its own nodes' best moves.
Pairs of nodes with more than HUB neighbours are in no block: they meet the communities in joins and are summed before
they are shuffled. The driver sees scalars only, as no table of more than FEW_NODES nodes is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.plans.lineage import stored

#: Gains of a cycle below this end a level; nodes of a graph in whose joins Spark may broadcast what is small.
LEAST_GAIN, FEW_NODES = 1e-5, 5_000
#: Pairs of a block, about; neighbours of a node whose pairs are in a block.
PAIRS, HUB = 2_000_000, 500_000
BLOCK = "p int, ids binary, heads binary, degrees binary, ends binary, w binary"


def _met(left: DataFrame, right: DataFrame, on: str, few: bool, how: str = "inner") -> DataFrame:
    """A shuffled join unless the graph has few nodes: what is broadcast goes through the driver, in each round anew."""
    return left.join(right if few else right.hint("merge"), on, how)


def _once(edges: DataFrame, weight: str | None) -> DataFrame:
    """x, y, w: each pair of different nodes with its summed weight (each distinct pair: 1)."""
    pair = edges.filter("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return pair.groupBy("x", "y").agg(F.sum("w").alias("w") if weight else F.max("w").alias("w"))


def _both(x: str, y: str) -> Column:
    """a, b, w from either end."""
    return F.inline(F.array(F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "w"), F.struct(F.col(y).alias("a"), F.col(x).alias("b"), "w")))


def weighted(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """a, b, w: each pair of different nodes from either end, with its summed weight (each distinct pair: 1)."""
    return _once(edges, weight).select(_both("x", "y"))


def modularity(edges: DataFrame, labels: DataFrame, column: str = "community", resolution: float = 1.0, weight: str | None = None) -> DataFrame:
    """modularity, communities: of a partition (id, column) of the edges' nodes; nodes without a label count by themselves."""
    pairs = weighted(edges, weight)
    own = labels.select("id", F.col(column).cast("string").alias("c"))
    end = lambda df, at, c: df.join(own.select(F.col("id").alias(at), F.col("c").alias(c)), at, "left").withColumn(c, F.coalesce(c, F.concat(F.lit("alone:"), F.col(at).cast("string"))))
    both = end(end(pairs, "a", "ca"), "b", "cb")
    each = both.groupBy("ca").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("within"))
    total = F.sum("tot")
    return each.agg((F.sum("within") / total - resolution * F.sum(F.col("tot") * F.col("tot")) / (total * total)).alias("modularity"), F.count("*").alias("communities"))


def _packed(pairs: pa.Table) -> pa.Table:
    """A block's pairs as one row: its nodes, and the pairs as positions in them, by their first nodes."""
    a, b, w = (pairs.column(c).to_numpy() for c in "abw")
    order = np.lexsort((b, a))
    ids, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    heads, degrees = np.unique(at[: len(a)], return_counts=True)
    columns = ids, heads.astype("i4"), degrees.astype("i4"), at[len(a) :].astype("i4"), w[order] if (w != 1).any() else w[:0]
    return pa.table({"p": pairs.column("p").slice(0, 1).cast(pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("ids", "heads", "degrees", "ends", "w"), columns)}})


def _part(block: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(block.column(name)[0].as_buffer(), kind)


def _places(block: pa.Table) -> pa.Table:
    """id, p, home: the nodes of a block; home: all their pairs are in it."""
    ids = _part(block, "ids", "i8")
    home = np.zeros(len(ids), bool)
    home[_part(block, "heads", "i4")] = True
    return pa.table({"id": ids, "p": np.full(len(ids), block.column("p")[0].as_py(), "i4"), "home": home})


def _unpacked(block: pa.Table, seen: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """The pairs' first and second nodes as rows of the last table, their weights, and the nodes' rows.

    Nodes that are not among ``seen`` have left, and all their neighbours with them.
    """
    heads, ends, w = np.repeat(_part(block, "heads", "i4").astype("i8"), _part(block, "degrees", "i4")), _part(block, "ends", "i4"), _part(block, "w", "f8")
    w, seen = w if len(w) else np.ones(len(ends)), seen.sort_by("id")
    here = np.isin(_part(block, "ids", "i8"), seen.column("id").to_numpy(), assume_unique=True)
    if not here.all():
        row, some = np.cumsum(here) - 1, here[heads]
        heads, ends, w = row[heads[some]], row[ends[some]], w[some]
    return heads, ends, w, seen


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of w of each."""
    if key.max(initial=0) < 4 * len(key):  # keys lie close
        first = np.flatnonzero(np.bincount(key))
        return first, np.bincount(key, w)[first]
    order = np.argsort(key)
    first = _firsts(key[order])
    return key[order][first], np.add.reduceat(w[order], first)


def _chosen(resolution: float, m2: float):
    """Of a block and its nodes' communities: the rows of its own nodes with the best move of each."""

    def choose(block: pa.Table, seen: pa.Table) -> pa.Table:
        heads, ends, w, seen = _unpacked(block, seen)
        own, k = heads[_firsts(heads)], seen.column("k").to_numpy()
        names, code = np.unique(seen.column("c").to_numpy(), return_inverse=True)
        tot = np.empty(len(names))
        tot[code] = seen.column("tot").to_numpy()
        # each node's weights to the communities around it, its own among them (which may be 0)
        key, w = _summed(np.concatenate([heads * len(names) + code[ends], own * len(names) + code[own]]), np.concatenate([w, np.zeros(len(own))]))
        node, to = key // len(names), key % len(names)
        stays = to == code[node]
        gain = w - resolution * k[node] * (tot[to] - np.where(stays, k[node], 0.0)) / m2
        first = _firsts(node)
        best = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(node)))))
        best = best[np.lexsort((~stays[best], node[best]))]
        best = best[_firsts(node[best])]
        more = {"w": w[stays], "to": names[to[best]], "moves": ~stays[best], "inside": np.diff(np.append(first, len(node))) == 1}
        return pa.table({**{c: seen.column(c).take(pa.array(own)) for c in seen.column_names if c != "p"}, **more})

    return choose


def _contracted(block: pa.Table, seen: pa.Table) -> pa.Table:
    """x, y, w: a block's pairs between communities, summed."""
    heads, ends, w, seen = _unpacked(block, seen)
    names, code = np.unique(seen.column("c").to_numpy(), return_inverse=True)
    key, w = _summed(code[heads] * len(names) + code[ends], w)
    return pa.table({"x": names[key // len(names)], "y": names[key % len(names)], "w": w})


def _dealt(pairs: DataFrame, own: DataFrame, few: bool) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The pairs' blocks, the pairs of hubs if there are any, and ``own`` with the blocks of each node (``at``).

    The first of ``at`` is the block of the node's own pairs, -1 for a hub.
    """
    n, hubs = own.agg(F.sum("n"), F.count_if(F.col("n") > HUB)).first()
    hub = None
    if hubs:
        large = F.broadcast(own.filter(F.col("n") > HUB).select(F.col("id").alias("a")))  # at most a row for HUB pairs
        pairs, hub = pairs.join(large, "a", "left_anti"), stored(pairs.join(large, "a", "left_semi"))
    p = F.pmod(F.xxhash64("a"), F.lit(-(-n // PAIRS))).cast("int").alias("p")
    blocks = stored(pairs.select(p, "a", "b", "w").groupBy("p").applyInArrow(_packed, BLOCK))
    place = blocks.groupBy("p").applyInArrow(_places, "id long, p int, home boolean").groupBy("id")
    place = place.agg(F.max(F.when(F.col("home"), F.col("p"))).alias("home"), F.collect_list(F.when(~F.col("home"), F.col("p"))).alias("others"))
    at = F.concat(F.array(F.coalesce("home", F.lit(-1))), F.coalesce("others", F.array().cast("array<int>"))).alias("at")
    return blocks, hub, stored(_met(own, place, "id", few, "left").select("id", "name", "k", "inner", at))


def _sent(state: DataFrame, *own: str) -> DataFrame:
    """Each node's row for each of its blocks; the columns ``own`` go to the block of its own pairs only."""
    rows = state.select("*", F.posexplode("at").alias("i", "p")).filter("p >= 0")
    return rows.select("p", *[F.when(F.col("i") == 0, F.col(c)).alias(c) if c in own else c for c in state.columns])


def _moves_of_hubs(hub: DataFrame, state: DataFrame, m2: float, resolution: float, few: bool) -> DataFrame:
    """The rows of hubs with the best move of each, as of ``_chosen``."""
    here = state.filter("at[0] < 0")
    near = _met(hub, state.select(F.col("id").alias("b"), "c", "tot"), "b", few).select(F.col("a").alias("id"), "c", "tot", "w")
    around = near.unionByName(here.select("id", "c", "tot", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"))
    around = _met(around, here.select("id", "k", F.col("c").alias("now")), "id", few)
    stays = F.col("c") == F.col("now")
    gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
    to = around.groupBy("id").agg(F.sum(F.when(stays, F.col("w"))).alias("w"), F.min(F.struct((-gain).alias("g"), (~stays).alias("moves"), "c")).alias("m"), (F.count("*") == 1).alias("inside"))
    return _met(here, to.select("id", "w", F.col("m.c").alias("to"), "m.moves", "inside"), "id", few)


def _level(blocks: DataFrame, hub: DataFrame | None, own: DataFrame, m2: float, resolution: float, rounds: int, few: bool, rest: tuple[float, float]) -> tuple[DataFrame, float]:
    """id, name, k, inner, at, c after local moves, and the modularity.

    own: id, name, k (weight of all ends), inner (of ends within), at; rest: inner and squares of k of the nodes left behind.
    Communities without neighbours can't change any more; once they are many, they leave the rounds.
    """
    state, left, leaving = own.select("*", F.col("id").alias("c"), F.col("k").alias("tot")), [], True
    best, score, parts, quiet, seed = None, None, 2, 0, 0
    columns = [*own.columns, "c"]
    for turn in range(rounds):
        sent = _sent(state, "name", "k", "inner", "at")
        out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", w double, to long, moves boolean, inside boolean"
        found = blocks.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(_chosen(resolution, m2), out)
        found = stored(found.unionByName(_moves_of_hubs(hub, state, m2, resolution, few)) if hub else found)
        sums = F.sum(F.col("w") + F.col("inner")).alias("within"), F.sum(F.col("k") * F.col("tot")).alias("squares")
        seen = found.agg(*sums, F.count("*").alias("n"), F.count_if("moves").alias("moves"), F.count_if("inside").alias("inside")).first()
        now = (seen.within + rest[0]) / m2 - resolution * (seen.squares + rest[1]) / (m2 * m2)
        if score is not None and now < score - 1e-12:
            parts *= 2  # undone: fewer at once from here on
            quiet = 0
        else:
            quiet = quiet + 1 if score is not None and now - score < LEAST_GAIN else 0
            score, best, moving = now, found, seen.moves
            if moving and leaving and seen.inside * 2 > seen.n:
                closed = found.groupBy("c").agg(F.bool_and("inside").alias("closed"))
                found = stored(_met(found, closed if few else stored(closed), "c", few))
                left.append(found.filter("closed"))
                gone = left[-1].agg(*sums, F.count("*").alias("n")).first()
                rest = rest[0] + (gone.within or 0.0), rest[1] + (gone.squares or 0.0)
                best, leaving, few = found.filter("NOT closed"), gone.n * 2 > seen.inside, seen.n - gone.n <= FEW_NODES
        if quiet >= 2 * parts or parts > 64 or turn + 1 == rounds or not moving:
            break
        seed += turn % parts == 0
        turns = F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(parts)) == turn % parts
        state = best.select(*own.columns, F.when(turns, F.col("to")).otherwise(F.col("c")).alias("c"))
        tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
        state = _met(state, tot if few else stored(tot), "c", few).select(*columns, "tot")
    for part in left:
        best = best.select(*columns).unionByName(part.select(*columns))
    return best.select(*columns), score


def communities(edges: DataFrame, resolution: float = 1.0, weight: str | None = None, rounds: int = 40, levels: int = 20) -> DataFrame:
    """id, community: a partition of the edges' nodes of high modularity; a community is named after its smallest node.

    edges: src, dst (loops are left out, repeated pairs count once, or by their summed weight). No edge, no row.
    """
    one = stored(_once(edges, weight))
    own = one.select(F.explode(F.array("x", "y")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("k"), F.count("*").alias("n"))
    # numbers in the order of the names
    own = stored(own.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name", "k", "n", F.lit(0.0).alias("inner")))
    m2 = own.agg(F.sum("k")).first()[0]
    if not m2:
        return own.select(F.col("name").alias("id"), F.col("name").alias("community"))
    number = lambda at, name: own.select(F.col("name").alias(at), F.col("id").alias(name))
    pairs = _met(_met(one, number("x", "a"), "x", False), number("y", "b"), "y", False).select(_both("a", "b"))
    names, labels, score, rest = own.select("id", "name"), own.select("id", F.col("id").alias("community")), None, (0.0, 0.0)
    for _ in range(levels):
        few = own.count() <= FEW_NODES
        blocks, hub, own = _dealt(pairs, own, few)
        moved, now = _level(blocks, hub, own, m2, resolution, rounds, few, rest)
        if score is not None and now - score < LEAST_GAIN:
            break
        score = now
        least = stored(moved.groupBy("c").agg(F.min("id").alias("least")))
        moved = stored(_met(moved, least, "c", few).select(*own.columns, F.col("least").alias("c")))
        to = lambda at, name: moved.select(F.col("id").alias(at), F.col("c").alias(name))
        labels = stored(_met(labels, to("community", "to"), "community", False, "left").select("id", F.coalesce("to", "community").alias("community")))
        joined = blocks.groupBy("p").cogroup(_sent(moved.select("id", "c", "at"), "at").groupBy("p")).applyInArrow(_contracted, "x long, y long, w double")
        if hub:
            joined = joined.unionByName(_met(_met(hub, to("a", "x"), "a", few), to("b", "y"), "b", few).select("x", "y", "w"))
        joined = stored(joined.groupBy("x", "y").agg(F.sum("w").alias("w")))
        around = joined.groupBy(F.col("x").alias("id")).agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("more"), F.count_if(F.col("x") != F.col("y")).alias("n"))
        own = moved.groupBy(F.col("c").alias("id")).agg(F.min(F.struct("id", "name")).alias("m"), F.sum("k").alias("k"), F.sum("inner").alias("inner"))
        own = stored(_met(own, around, "id", few).select("id", F.col("m.name").alias("name"), "k", "n", (F.col("inner") + F.col("more")).alias("inner")))
        behind = own.filter("n = 0").agg(F.coalesce(F.sum("inner"), F.lit(0.0)), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()
        rest = rest[0] + behind[0], rest[1] + behind[1]
        own, pairs = own.filter("n > 0"), joined.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "w")
        if own.isEmpty():
            break
    called = lambda at, name: names.select(F.col("id").alias(at), F.col("name").alias(name))
    return _met(_met(labels, called("id", "own"), "id", False), called("community", "by"), "community", False).select(F.col("own").alias("id"), F.col("by").alias("community"))
