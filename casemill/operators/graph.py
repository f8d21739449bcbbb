"""Links over shared identifiers: nodes and edges, key players, components, neighbourhoods and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.expressions import hour_band, token_key
from casemill.plans.lineage import cut, small_or_not, stored

#: Nodes of a neighbourhood that are broadcast to the edges.
FRONTIER = 500_000
EDGES = "src string, dst string, kind string, value string"


def node_id(entity: str, key: Column) -> Column:
    return F.concat(F.lit(f"{entity}:"), key.cast("string"))


def nodes(df: DataFrame, entity: str, key: str, label: str, order: str) -> DataFrame:
    """id, kind, label: one node an id, labelled by its last row."""
    return df.filter(F.col(key).isNotNull()).groupBy(node_id(entity, F.col(key)).alias("id")).agg(F.lit(entity).alias("kind"), F.max_by(F.col(label).cast("string"), order).alias("label"))


def shared_edges(df: DataFrame, entity: str, key: str, column: str, order: str, least: int = 2, most: int = 20) -> DataFrame:
    """Chains of the ids that share a value, in the order of their first rows; values of too many ids are no evidence."""
    first = df.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "") & F.col(key).isNotNull()).groupBy(F.col(column).cast("string").alias("value"), node_id(entity, F.col(key)).alias("src")).agg(F.min(order).alias("at"))
    few = first.groupBy("value").agg(F.count("*").alias("m")).filter(F.col("m").between(least, most)).select("value")
    chain = first.join(few, "value").withColumn("dst", F.lead("src").over(W.partitionBy("value").orderBy("at", "src")))
    return chain.filter("dst IS NOT NULL").select("src", "dst", F.lit(f"shared_{column}").alias("kind"), "value")


def fuzzy_edges(df: DataFrame, entity: str, key: str, label: str, address: str, order: str, most: int = 4) -> DataFrame:
    """Pairs of ids whose names have the same tokens at the same place, but are written differently."""
    one = df.filter(F.col(key).isNotNull()).groupBy(node_id(entity, F.col(key)).alias("id")).agg(F.min_by(F.struct(F.col(label).cast("string").alias("label"), F.col(address).cast("string").alias("address")), order).alias("r"))
    keyed = one.select("id", F.col("r.label").alias("label"), token_key(F.col("r.label"), F.col("r.address")).alias("value")).filter(~F.col("value").startswith("|"))
    few = keyed.groupBy("value").agg(F.count("*").alias("m")).filter(F.col("m").between(2, most)).select("value")  # so pairs stay few
    own = keyed.join(few, "value")
    other = own.select("value", F.col("id").alias("dst"), F.col("label").alias("l2"))
    return own.join(other, "value").filter("id < dst AND NOT label <=> l2").select(F.col("id").alias("src"), "dst", F.lit("possible_same_person").alias("kind"), "value")


def fk_edges(df: DataFrame, entity: str, key: str, fk: str) -> DataFrame:
    """Edges from entities to the cases they refer to."""
    return df.filter(F.col(key).isNotNull() & F.col(fk).isNotNull()).select(node_id(entity, F.col(key)).alias("src"), node_id("case", F.col(fk)).alias("dst"), F.lit("involved_in").alias("kind"), F.lit(None).cast("string").alias("value")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b: each pair of neighbours once from either end."""
    pair = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return edges.filter("src <> dst").select(pair.alias("p")).select("p.a", "p.b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: neighbours of each node."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def key_players(edges: DataFrame, top: int = 25) -> DataFrame:
    """The nodes other than cases with most neighbours."""
    return degrees(edges).filter(~F.col("id").startswith("case:")).orderBy(F.desc("degree"), "id").limit(top)


def repeat_entities(edges: DataFrame, least: int = 2, top: int = 25) -> DataFrame:
    """id, cases: nodes of several cases."""
    n = edges.filter(F.col("dst").startswith("case:")).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("cases"))
    return n.filter(F.col("cases") >= least).orderBy(F.desc("cases"), "id").limit(top)


def labelled(found: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """``found`` with its nodes' labels; a node without one is called by its id. found: few rows (a top list)."""
    few = F.broadcast(found)
    names = all_nodes.join(few.select("id"), "id", "left_semi").groupBy("id").agg(F.max("label").alias("label"))
    return found.join(F.broadcast(names), "id", "left").withColumn("label", F.coalesce("label", "id"))


def projection(shared: DataFrame, involved: DataFrame, most: int = 20) -> DataFrame:
    """src, dst: shared-identifier edges, and chains of the entities of cases with 2 to ``most`` of them."""
    own = involved.select("src", F.col("dst").alias("case")).distinct()
    few = own.groupBy("case").agg(F.count("*").alias("m")).filter(F.col("m").between(2, most)).select("case")
    chain = own.join(few, "case").withColumn("dst", F.lead("src").over(W.partitionBy("case").orderBy("src"))).filter("dst IS NOT NULL")
    both = shared.select("src", "dst").unionByName(chain.select("src", "dst")).filter("src <> dst")
    return both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached.

    Each round every node points at its smallest neighbour, pointers are doubled to their ends, and edges move there.
    """
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    labels = cut(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("component", F.col("id")))
    while not left.isEmpty():
        up = cut(both_ways(left).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("p")))
        while True:
            up = cut(up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            if up.filter("moved").isEmpty():
                break
        to = lambda a, b: up.select(F.col("u").alias(a), F.col("p").alias(b))
        moved = left.join(to("src", "s"), "src").join(to("dst", "d"), "dst").filter("s <> d")
        labels = cut(labels.join(to("component", "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        left = cut(moved.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct())
    return labels


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community: each node takes the commonest label around it (ties to the smaller), a few times over."""
    pairs = cut(both_ways(edges))
    labels = cut(pairs.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        # a node's own label counts as one vote, which keeps pairs from swapping labels for ever
        own = labels.select(F.col("id").alias("a"), "community", F.lit(1).cast("long").alias("n"))
        votes = votes.unionByName(own).groupBy("a", "community").agg(F.sum("n").alias("n"))
        labels = cut(votes.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("m"), "community")).alias("v")).select("id", "v.community"))
    return labels


def community_sizes(labels: DataFrame, column: str, least: int = 3, top: int = 10) -> DataFrame:
    """The largest classes: label, size."""
    return labels.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("size")).filter(F.col("size") >= least).orderBy(F.desc("size"), "label").limit(top)


def ego(edges: DataFrame, centre: str, hops: int = 2, most: int = 150) -> DataFrame:
    """src, dst, kind, value: edges among the centre and its neighbourhood's ``most`` nodes of most neighbours in it.

    An unknown centre is a LookupError.
    """
    own = edges.filter("src <> dst").select("src", "dst")
    if own.filter((F.col("src") == centre) | (F.col("dst") == centre)).isEmpty():
        raise LookupError(f"node {centre!r} is not in the graph")
    seen = edges.sparkSession.createDataFrame([(centre,)], "id string")
    at = lambda column: small_or_not(seen, FRONTIER).select(F.col("id").alias(column))
    for _ in range(hops):  # the stored edges are read again each time, never written
        seen = cut(seen.union(own.join(at("src"), "src", "left_semi").select("dst")).union(own.join(at("dst"), "dst", "left_semi").select("src")).distinct())
    within = cut(both_ways(own.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")))
    degree = within.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    kept = cut(degree.orderBy((F.col("id") == centre).desc(), F.desc("d"), "id").limit(most).select("id"))
    few = F.broadcast(kept)  # at most ``most`` rows
    end = lambda c: few.select(F.col("id").alias(c))
    inside = edges.filter("src <> dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi")
    return inside.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind", "value").distinct()


def ego_nodes(around: DataFrame, all_nodes: DataFrame, centre: str) -> DataFrame:
    """id, kind, label, is_centre: the nodes of an ego network; those without a row are cases, or of their prefix's kind."""
    ids = around.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = all_nodes.join(F.broadcast(cut(ids)), "id", "left_semi").groupBy("id").agg(F.max(F.struct("kind", "label")).alias("n"))
    name = F.substring_index("id", ":", 1)
    out = ids.join(F.broadcast(known), "id", "left")  # both are few: an ego network is bounded
    return out.select("id", F.coalesce("n.kind", name).alias("kind"), F.coalesce("n.label", F.expr("substr(id, length(substring_index(id, ':', 1)) + 2)")).alias("label"), (F.col("id") == centre).alias("is_centre"))


def profiles(involved: DataFrame, cases: DataFrame, case_id: str, area: str, kind: str, time: Column) -> DataFrame:
    """id, n_cases, areas, top_kind, peak_band, cases (25): each entity's cases in short."""
    own = cases.select(node_id("case", F.col(case_id)).alias("dst"), F.col(area).cast("string").alias("area"), F.col(kind).cast("string").alias("kind"), hour_band(F.hour(time)).alias("band"), F.hour(time).alias("h"))
    own = own.withColumn("band", F.when(F.col("h").isNotNull(), F.col("band"))).drop("h")
    rows = stored(involved.select(F.col("src").alias("id"), "dst").distinct().join(own, "dst"), "involved")  # read twice
    # an entity's cases are counted by kind and band first, so that a group stays small; its first cases are cut off before the shuffle
    parts = rows.groupBy("id", "kind", "band").agg(F.count("*").alias("n"), F.collect_set("area").alias("a"))
    parts = parts.groupBy("id").agg(F.sum("n").alias("n_cases"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("a")))).alias("areas"), F.collect_list(F.struct("kind", "band", "n")).alias("k"))
    first = rows.select("id", "dst").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("dst"))).filter("r <= 25")
    parts = parts.join(first.groupBy("id").agg(F.sort_array(F.collect_list("dst")).alias("cases")), "id")

    def commonest(column: str) -> Column:
        names = F.array_distinct(F.filter(F.transform("k", lambda x: x[column]), lambda v: v.isNotNull()))
        total = lambda v: F.aggregate(F.filter("k", lambda x: x[column] == v), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.array_min(F.transform(names, lambda v: F.struct((-total(v)).alias("m"), v.alias("v"))))["v"]

    return parts.select("id", "n_cases", "areas", commonest("kind").alias("top_kind"), commonest("band").alias("peak_band"), "cases")


def profile_of(all_profiles: DataFrame, node: str) -> DataFrame:
    """One entity's profile; an unknown one has no cases."""
    asked = all_profiles.sparkSession.createDataFrame([(node,)], "id string")
    empty = F.array().cast("array<string>")
    out = F.broadcast(asked).join(all_profiles.filter(F.col("id") == node), "id", "left")
    return out.select("id", F.coalesce("n_cases", F.lit(0)).alias("n_cases"), F.coalesce("areas", empty).alias("areas"), "top_kind", "peak_band", F.coalesce("cases", empty).alias("cases"))


def search(all_nodes: DataFrame, edges: DataFrame, text: str, top: int = 20) -> DataFrame:
    """id, label, degree of nodes that have the text in their id or label."""
    low = text.lower()
    hit = all_nodes.filter(F.lower("id").contains(low) | F.lower(F.coalesce("label", F.lit(""))).contains(low)).orderBy("id").limit(top)
    few = cut(hit)  # at most ``top`` rows
    end = lambda c: edges.select("src", "dst").join(F.broadcast(few.select(F.col("id").alias(c))), c, "left_semi").select("src", "dst")
    return few.join(degrees(end("src").unionByName(end("dst"))), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
