"""Registered queries on links, triage, findings, reports and alerts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from casemill import bindings as B
from casemill import queries as own
from casemill.bindings import CASE_ROLES, CASES_SQL, EVENT_ROLES, cases, events, table
from casemill.functions.expressions import try_ts
from casemill.operators import boosting, communities, findings, graph, profile, reports, signals, triage
from casemill.operators.query import Kpi
from casemill.plans.lineage import cut
from casemill.queries import register


def people(spark, sf_dir):
    """Customers as persons; three at a time share a phone, and each a place."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Cust "), F.translate(F.floor(F.col("c_custkey") / 2).cast("string"), "0123456789", "abcdefghij"), F.when(F.col("c_custkey") % 2 == 1, " Jr").otherwise(" jr"))
    return c.select("c_custkey", name.alias("name"), F.floor(F.col("c_custkey") / 3).alias("phone"), F.concat(F.lit("1 Road, Town"), (F.floor(F.col("c_custkey") / 2) % 50).cast("string")).alias("address"))


PEOPLE_SQL = """people AS (SELECT c_custkey, 'customer:' || CAST(c_custkey AS VARCHAR) AS id, c_custkey // 3 AS phone, c_custkey // 2 AS pair FROM customer)"""


def involved(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    return graph.fk_edges(li, "supplier", "l_suppkey", "l_orderkey")


INV_SQL = "inv AS (SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS src, 'case:' || CAST(l_orderkey AS VARCHAR) AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL)"


@register(f"WITH {PEOPLE_SQL} SELECT id, 'customer' AS kind, c_name AS label FROM people JOIN customer USING (c_custkey)")
def g1_nodes(spark, sf_dir):
    """G1: entity nodes."""
    return graph.nodes(table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_name", "c_custkey")


SHARED_SQL = f"""{PEOPLE_SQL}, sh AS (SELECT id AS src, lead(id) OVER (PARTITION BY phone ORDER BY c_custkey) AS dst, 'shared_phone' AS kind, CAST(phone AS VARCHAR) AS value
FROM people QUALIFY count(*) OVER (PARTITION BY phone) BETWEEN 2 AND 20)"""


@register(f"WITH {SHARED_SQL} SELECT * FROM sh WHERE dst IS NOT NULL")
def g2_shared(spark, sf_dir):
    """Chains of customers that share a phone."""
    return graph.shared_edges(people(spark, sf_dir), "customer", "c_custkey", "phone", "c_custkey")


@register(f"WITH {PEOPLE_SQL} SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, 'possible_same_person' AS kind FROM people a JOIN people b ON a.pair = b.pair AND a.c_custkey < b.c_custkey")
def g3_fuzzy(spark, sf_dir):
    """Names of the same tokens at the same place."""
    return graph.fuzzy_edges(people(spark, sf_dir), "customer", "c_custkey", "name", "address", "c_custkey").select("src", "dst", "kind")


@register(f"WITH {INV_SQL} SELECT src, dst, 'involved_in' AS kind, CAST(NULL AS VARCHAR) AS value FROM inv")
def g4_involved(spark, sf_dir):
    """Suppliers of orders."""
    return involved(spark, sf_dir)


def suppliers(spark, sf_dir):
    return graph.nodes(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name", "s_suppkey")


_NAMED = lambda source: f"SELECT x.*, s_name AS label FROM ({source}) x JOIN supplier ON x.id = 'supplier:' || CAST(s_suppkey AS VARCHAR)"
REPEATS_SQL = f"WITH {INV_SQL} SELECT src AS id, count(DISTINCT dst) AS cases FROM inv GROUP BY ALL HAVING count(DISTINCT dst) >= 2 ORDER BY cases DESC, id LIMIT 25"


@register(_NAMED(f"WITH {INV_SQL} SELECT src AS id, count(*) AS degree FROM inv GROUP BY ALL ORDER BY degree DESC, id LIMIT 25"))
def g5_key_players(spark, sf_dir):
    """Nodes of most neighbours."""
    return graph.labelled(graph.key_players(involved(spark, sf_dir)), suppliers(spark, sf_dir))


@register(_NAMED(REPEATS_SQL))
def g6_repeats(spark, sf_dir):
    """Suppliers of several orders."""
    return graph.labelled(graph.repeat_entities(involved(spark, sf_dir)), suppliers(spark, sf_dir))


PROJ_SQL = f"""{INV_SQL}, {SHARED_SQL}, ch AS (SELECT src, lead(src) OVER (PARTITION BY dst ORDER BY src) AS dst FROM inv QUALIFY count(*) OVER (PARTITION BY inv.dst) BETWEEN 2 AND 20),
proj AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT src, dst FROM sh UNION ALL SELECT src, dst FROM ch) WHERE dst IS NOT NULL)"""


@register(f"WITH {PROJ_SQL} SELECT * FROM proj")
def g7_projection(spark, sf_dir):
    """The graph for communities."""
    return graph.projection(g2_shared(spark, sf_dir), involved(spark, sf_dir))


@register(f"WITH {SHARED_SQL} SELECT id, min(id) OVER (PARTITION BY phone) AS component FROM people QUALIFY count(*) OVER (PARTITION BY phone) > 1")
def g8_components(spark, sf_dir):
    """Connected customers."""
    return graph.connected_components(g2_shared(spark, sf_dir))


@register()
def g8_communities(spark, sf_dir):
    """Communities by modularity."""
    return graph.community_sizes(communities.communities(g7_projection(spark, sf_dir)), "community")


def cliques(spark, sf_dir):
    """Customers by sixes (the last ones a few more), each a clique, and the cliques linked to a ring; and their number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    low, high, n = c.agg(F.min("k"), F.max("k"), F.count("*")).first()
    c = c.withColumn("q", F.least(F.floor((F.col("k") - low) / 6), F.lit(n // 6 - 1)))
    other = c.select("q", F.col("k").alias("k2"))
    inside = c.join(other, "q").filter("k < k2").select("k", "k2")
    ends = c.groupBy("q").agg(F.max("k").alias("k")).filter(F.col("k") < high).select("k", (F.col("k") + 1).alias("k2"))
    ring = spark.createDataFrame([(low, high)], "k long, k2 long")
    both = inside.unionByName(ends).unionByName(ring).select(*[F.concat(F.lit("customer:"), F.col(k).cast("string")).alias(a) for k, a in (("k", "src"), ("k2", "dst"))])
    return both, n // 6


@register("""WITH c AS (SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS id, least((c_custkey - min(c_custkey) OVER ()) // 6, count(*) OVER () // 6 - 1) AS q FROM customer)
SELECT id, min(id) OVER (PARTITION BY q) AS community FROM c""")
def g8_ring(spark, sf_dir):
    """Cliques in a ring; the resolution is high enough for neighbours to stay apart, however many there are."""
    edges, n = cliques(spark, sf_dir)
    return communities.communities(edges, resolution=n / 8)


@register(f"""WITH {PROJ_SQL}, e AS (SELECT DISTINCT src AS a, dst AS b FROM proj WHERE src <> dst), p AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a, b, split_part(a, ':', 1) || right(a, 1) AS ca, split_part(b, ':', 1) || right(b, 1) AS cb FROM p), t AS (SELECT ca, count(*)::DOUBLE AS tot, count(*) FILTER (ca = cb)::DOUBLE AS within FROM c GROUP BY ca)
SELECT round(sum(within) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) AS modularity, count(*) AS communities FROM t""")
def g8_modularity(spark, sf_dir):
    """The modularity of a given partition (by kind and last digit)."""
    g = g7_projection(spark, sf_dir)
    labels = g.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.concat(F.substring_index("id", ":", 1), F.substring("id", -1, 1)))
    return communities.modularity(g, labels).withColumn("modularity", F.round("modularity", 9))


EGO_SQL = f"""WITH {INV_SQL}, p AS (SELECT src AS a, dst AS b FROM inv UNION SELECT dst, src FROM inv),
s AS (SELECT 'supplier:1' AS id UNION SELECT b FROM p WHERE a = 'supplier:1' UNION SELECT b FROM p WHERE a IN (SELECT b FROM p WHERE a = 'supplier:1')),
w AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM s) AND b IN (SELECT id FROM s)),
k AS (SELECT a AS id FROM (SELECT a, count(*) AS d FROM w GROUP BY a) ORDER BY a = 'supplier:1' DESC, d DESC, a LIMIT 150),
eg AS (SELECT a AS src, b AS dst, 'involved_in' AS kind, CAST(NULL AS VARCHAR) AS value FROM w WHERE a < b AND a IN (SELECT id FROM k) AND b IN (SELECT id FROM k))"""


@register(f"{EGO_SQL} SELECT * FROM eg")
def g9_ego(spark, sf_dir):
    """The neighbourhood of a supplier."""
    return graph.ego(involved(spark, sf_dir), "supplier:1")


@register(f"""{EGO_SQL}, i AS (SELECT src AS id FROM eg UNION SELECT dst FROM eg)
SELECT id, split_part(id, ':', 1) AS kind, coalesce(s_name, split_part(id, ':', 2)) AS label, id = 'supplier:1' AS is_centre FROM i LEFT JOIN supplier ON id = 'supplier:' || CAST(s_suppkey AS VARCHAR)""")
def g9_ego_nodes(spark, sf_dir):
    """The nodes of this neighbourhood."""
    return graph.ego_nodes(graph.ego(involved(spark, sf_dir), "supplier:1"), suppliers(spark, sf_dir), "supplier:1")


@register(f"""WITH {INV_SQL}, {CASES_SQL}, r AS (SELECT DISTINCT src AS id, inv.dst, area, category, (case_id % 19)::INT AS h FROM inv JOIN cases ON inv.dst = 'case:' || CAST(case_id AS VARCHAR)),
b AS (SELECT id, CASE WHEN h <= 5 THEN 'Night' WHEN h <= 11 THEN 'Morning' WHEN h <= 17 THEN 'Afternoon' ELSE 'Evening' END AS band, count(*) AS n FROM r GROUP BY ALL),
bb AS (SELECT id, band AS peak_band FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, band) = 1),
k AS (SELECT id, category, count(*) AS n FROM r GROUP BY ALL), kk AS (SELECT id, category AS top_kind FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, category) = 1)
SELECT r.id, count(DISTINCT dst) AS n_cases, list_sort(list(DISTINCT area)) AS areas, any_value(top_kind) AS top_kind, any_value(peak_band) AS peak_band, list_sort(list(DISTINCT dst))[1:25] AS cases FROM r JOIN kk ON r.id = kk.id JOIN bb ON r.id = bb.id GROUP BY r.id""")
def g10_profiles(spark, sf_dir):
    """suppliers' orders in short; order dates are at midnight, so hours come from the keys."""
    c = cases(spark, sf_dir)
    c = c.withColumn("ts", F.col("ts") + F.make_dt_interval(hours=(F.col("case_id") % 19).cast("int")))
    return graph.profiles(involved(spark, sf_dir), c, "case_id", "area", "category", try_ts(c, "ts"))


@register(f"WITH {INV_SQL} SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS label, (SELECT count(*) FROM inv WHERE src = 'supplier:' || CAST(s_suppkey AS VARCHAR)) AS degree FROM supplier WHERE lower(s_name) LIKE '%1%' OR CAST(s_suppkey AS VARCHAR) LIKE '%1%' ORDER BY id LIMIT 20")
def g11_search(spark, sf_dir):
    """Nodes by a part of their name."""
    return graph.search(graph.nodes(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name", "s_suppkey"), involved(spark, sf_dir), "1")


def triage_cases(spark, sf_dir):
    c = cases(spark, sf_dir)
    status = F.when(F.col("status") == "F", "Charge sheeted").when(F.col("status") == "P", "Undetected").otherwise("Under Investigation")
    priced = F.when((F.col("status") == "F") & (F.col("case_id") % 3 > 0), F.col("money")).otherwise(F.col("money") * 0.8)
    return c.withColumns({"status": status, "money": priced})


TRIAGE_SQL = f"""{CASES_SQL}, tc AS (SELECT case_id, area, category, ts, CASE status WHEN 'F' THEN 'detected' WHEN 'P' THEN 'undetected' ELSE 'open' END AS state,
  CASE WHEN status = 'F' AND case_id % 3 > 0 THEN money ELSE money * 0.8 END AS money FROM cases),
lk AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)"""


@register(f"WITH {TRIAGE_SQL} SELECT state, count(*) AS n FROM tc GROUP BY ALL")
def l1_states(spark, sf_dir):
    """L1: detected, undetected and open cases."""
    from casemill.functions.expressions import status_label

    return triage_cases(spark, sf_dir).groupBy(status_label(F.col("status")).alias("state")).agg(F.count("*").alias("n"))


def features(spark, sf_dir, training):
    linked = triage.linked_counts(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return triage.features(triage_cases(spark, sf_dir), CASE_ROLES, linked, training=training)


@register(f"""WITH {TRIAGE_SQL} SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(state = 'detected' AS INT)::DOUBLE AS label, category AS crime_type, '__missing__' AS gravity, area, hour(ts)::DOUBLE AS hour,
(isodow(ts) - 1)::DOUBLE AS dow, 0.0::DOUBLE AS report_delay_h, round(money, 4) AS property_loss, coalesce(n, 0)::DOUBLE AS n_linked FROM tc LEFT JOIN lk ON l_orderkey = case_id WHERE state <> 'open'""")
def l3_features(spark, sf_dir):
    """L2, L3: training features."""
    return features(spark, sf_dir, True).withColumn("property_loss", F.round("property_loss", 4))


@register(f"""WITH {TRIAGE_SQL}, t AS (SELECT * FROM tc WHERE state <> 'open'), i AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS i FROM t GROUP BY category),
j AS (SELECT area, row_number() OVER (ORDER BY count(*) DESC, area) - 1 AS i FROM t GROUP BY area)
SELECT CAST(case_id AS VARCHAR) AS case_id, i.i::DOUBLE AS crime_type_i, 0.0::DOUBLE AS gravity_i, j.i::DOUBLE AS area_i FROM t JOIN i USING (category) JOIN j USING (area)""")
def l4_encoded(spark, sf_dir):
    """L4: categories as numbers."""
    rows = features(spark, sf_dir, True)
    return Pipeline(stages=triage.indexers()).fit(rows).transform(rows).select("case_id", *[f"{c}_i" for c in triage.CATEGORIES])


@register(f"""WITH {TRIAGE_SQL}, t AS (SELECT (case_id % 97)::INT AS s, state = 'detected' AS y FROM tc WHERE state <> 'open'), g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM t GROUP BY s),
c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 9) AS auc FROM c""")
def l6_auc(spark, sf_dir):
    """The area under the ROC curve of a score with ties."""
    rows = features(spark, sf_dir, True).withColumn("s", (F.col("case_id").cast("long") % 97).cast("double"))
    return spark.createDataFrame([(round(triage.auc(rows, "s"), 9),)], "auc double")


@register(f"""WITH {TRIAGE_SQL}, o AS (SELECT case_id, category, money, coalesce(n, 0) AS k FROM tc LEFT JOIN lk ON l_orderkey = case_id WHERE state = 'open'), m AS (SELECT avg(money) AS a, avg(k) AS b FROM o)
SELECT CAST(case_id AS VARCHAR) AS case_id, ['property_loss ' || CASE WHEN money > a + abs(a) * 0.15 THEN 'above' WHEN money < a - abs(a) * 0.15 THEN 'below' ELSE 'near' END || ' average',
  'n_linked ' || CASE WHEN k > b + abs(b) * 0.15 THEN 'above' WHEN k < b - abs(b) * 0.15 THEN 'below' ELSE 'near' END || ' average', 'crime_type: ' || category] AS factors FROM o, m""")
def l12_factors(spark, sf_dir):
    """Texts on three features of open cases."""
    return triage.factors(features(spark, sf_dir, False), ["property_loss", "n_linked", "crime_type", "hour"]).select("case_id", "factors")


@register(f"WITH {TRIAGE_SQL} SELECT area, round(avg((case_id % 89) / 88.0::DOUBLE), 4) AS rate, count(*) AS n FROM tc WHERE state = 'open' GROUP BY ALL")
def l13_mean_rates(spark, sf_dir):
    """The areas' means of a score of open cases."""
    return triage.mean_by_area(features(spark, sf_dir, False).withColumn("p", (F.col("case_id").cast("long") % 89) / 88.0))


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS case_id, epoch(min(l_shipdate) - any_value(o_orderdate))::DOUBLE / 86400 AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING min(l_shipdate) >= any_value(o_orderdate)""")
def l9_durations(spark, sf_dir):
    """Days to the first shipment."""
    return triage.durations(cases(spark, sf_dir), "case_id", "ts", table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate")


def bundles(spark, sf_dir, repeats=5):
    train = cut(features(spark, sf_dir, True))
    timed = cut(train.drop("label").join(l9_durations(spark, sf_dir), "case_id"))  # read several times
    with ThreadPoolExecutor(2) as pool:  # each is a chain of small jobs
        models = [pool.submit(inheritable_thread_target(spark)(f)) for f in (lambda: triage.train_detection(train, repeats=repeats), lambda: triage.train_duration(timed))]
    return tuple(m.result() for m in models)


def _gains(feature, value, source, order):
    """The best gain of a feature's splits at the root, by prefix sums over its values."""
    return f"""{feature}_v AS (SELECT {value} AS v, sum(g)::DOUBLE / 1048576 AS g, sum(h)::DOUBLE / 1048576 AS h, count(*) AS n FROM {source} GROUP BY 1),
{feature}_p AS (SELECT sum(g) OVER o AS a, sum(h) OVER o AS b, sum(n) OVER o AS c, sum(g) OVER () AS g, sum(h) OVER () AS h, sum(n) OVER () AS n FROM {feature}_v WINDOW o AS (ORDER BY {order} ROWS UNBOUNDED PRECEDING)),
{feature}_s AS (SELECT '{feature}' AS feature, round(coalesce(max(a * a / b + (g - a) * (g - a) / (h - b) - g * g / h) FILTER (c >= 20 AND n - c >= 20), 0), 6) AS gain FROM {feature}_p)"""


@register(f"""WITH {TRIAGE_SQL}, t AS (SELECT area, category, (isodow(ts) - 1) AS dow, coalesce(n, 0) AS n_linked, CAST(state = 'detected' AS INT)::DOUBLE AS y FROM tc LEFT JOIN lk ON l_orderkey = case_id WHERE state <> 'open'),
b AS (SELECT avg(y) AS p FROM t), x AS (SELECT t.*, CAST(round_even((p - y) * 1048576, 0) AS BIGINT) AS g, CAST(round_even(p * (1 - p) * 1048576, 0) AS BIGINT) AS h FROM t, b),
{", ".join(_gains(f, c, "x", o) for f, c, o in (("crime_type", "category", "g / (h + 10)"), ("area", "area", "g / (h + 10)"), ("dow", "dow", "v"), ("n_linked", "n_linked", "v")))}
SELECT * FROM crime_type_s UNION ALL SELECT * FROM area_s UNION ALL SELECT * FROM dow_s UNION ALL SELECT * FROM n_linked_s""")
def l5_root_gains(spark, sf_dir):
    """The gain of each feature's best split of all closed cases: categories by their gradients, numbers in order."""
    rows = features(spark, sf_dir, True)
    names = ["crime_type", "area", "dow", "n_linked"]
    model = boosting.fit(rows, "label", names[:2], names[2:], trees=0)
    own = model.binned(rows).select(F.col("__x").alias("x"), F.col("label").alias("y"))
    sums = boosting.sums_of(own, model, boosting.root(), model.width(), boosting.UNIT)
    return spark.createDataFrame([(f, round(boosting.best_split(sums[:, 0, i], i < 2)[0], 6)) for i, f in enumerate(names)], "feature string, gain double")


@register()
def l5_detection_metrics(spark, sf_dir):
    """The models' figures."""
    detection, duration = bundles(spark, sf_dir)
    rows = [(f"{n}_{k}", float(v)) for n, b in (("detection", detection), ("duration", duration)) for k, v in (b.metrics or {}).items()]
    out = spark.createDataFrame(rows, "metric string, value double")
    return out if detection.importance is None else out.unionByName(detection.importance.select(F.concat(F.lit("importance_"), "feature").alias("metric"), F.col("importance").alias("value")))


@register()
def l11_open_cases(spark, sf_dir):
    """Open cases, the least likely to be detected first."""
    detection, duration = bundles(spark, sf_dir)
    if detection.model is None:
        return spark.createDataFrame([], "case_id string, area string, probability double, days double, stall boolean, factors array<string>")
    return triage.score_open(features(spark, sf_dir, False), detection, duration)


@register()
def l13_rates(spark, sf_dir):
    """Predicted rates of areas."""
    detection, _ = bundles(spark, sf_dir, repeats=0)
    if detection.model is None:
        return spark.createDataFrame([], "area string, rate double, n long")
    return triage.rate_by_area(features(spark, sf_dir, False), detection)


def stated(spark):
    """Two models that SQL can state: of one tree each, on the loss and on the number of linked persons."""
    def one(number, cut_at, low, high, loss, base):
        tree = boosting.Tree(np.array([1, -1, -1]), np.array([[b < 2 for b in range(boosting.BINS)]] * 3), np.array([1, 1, 2]), np.array([2, 1, 2]), np.array([0.0, low, high]))
        codes = spark.createDataFrame([], "feature string, value string, bin int")
        return boosting.Boosted([], [number], {number: [cut_at]}, codes, loss, base, [tree])

    order = spark.createDataFrame([("property_loss",), ("n_linked",), ("crime_type",)], "feature string")
    detection = triage.Bundle(one("property_loss", 100_000.0, -1.0, 0.5, "log", 0.25), importance=order)
    return detection, triage.Bundle(one("n_linked", 3.0, -50.0, 25.5, "squared", 300.0), metrics={"median": 300.0})


STATED_SQL = f"""{TRIAGE_SQL}, o AS (SELECT CAST(case_id AS VARCHAR) AS case_id, area, category, money, coalesce(n, 0) AS k FROM tc LEFT JOIN lk ON l_orderkey = case_id WHERE state = 'open'), m AS (SELECT avg(money) AS a, avg(k) AS b FROM o),
sc AS (SELECT case_id, area, 1 / (1 + exp(-CASE WHEN money > 100000 THEN 0.75 ELSE -0.75 END)) AS p, 300 + CASE WHEN k > 3 THEN 25.5 ELSE -50 END AS days,
  ['property_loss ' || CASE WHEN money > a + abs(a) * 0.15 THEN 'above' WHEN money < a - abs(a) * 0.15 THEN 'below' ELSE 'near' END || ' average',
  'n_linked ' || CASE WHEN k > b + abs(b) * 0.15 THEN 'above' WHEN k < b - abs(b) * 0.15 THEN 'below' ELSE 'near' END || ' average', 'crime_type: ' || category] AS factors FROM o, m),
pr AS (SELECT case_id, area, round(p, 4)::DOUBLE AS probability, round(days, 1)::DOUBLE AS days, days > 300 AS stall, factors FROM sc ORDER BY probability, case_id LIMIT 25)"""


@register(f"WITH {STATED_SQL} SELECT * FROM pr")
def l11_stated(spark, sf_dir):
    """Open cases by two stated models, the least likely to be detected first."""
    return triage.score_open(features(spark, sf_dir, False), *stated(spark))


@register(f"WITH {STATED_SQL} SELECT area, round(avg(p), 4)::DOUBLE AS rate, count(*) AS n FROM sc GROUP BY area")
def l13_stated(spark, sf_dir):
    """areas' rates by a stated model."""
    return triage.rate_by_area(features(spark, sf_dir, False), stated(spark)[0])


@register(f"""WITH {STATED_SQL}, n AS (SELECT count(*) AS n, avg(1 - probability) AS risk, count(*) FILTER (stall) AS stall FROM pr)
SELECT 'predicted_undetected' AS type, round_even(least(95, 35 + n * 1.5 + risk * 40), 0)::INT AS severity FROM n WHERE n > 0
UNION ALL SELECT 'predicted_stall', round_even(least(90, 40 + 5 * stall), 0)::INT FROM n WHERE stall > 0""")
def f11_stated(spark, sf_dir):
    """findings on the predictions of two stated models."""
    return findings.from_triage(triage.score_open(features(spark, sf_dir, False), *stated(spark))).select("type", "severity")


def predictions(spark, sf_dir):
    """Open cases with their predictions; without a model there are none. The factors are of no use here, so no importances."""
    detection, duration = bundles(spark, sf_dir, repeats=0)
    if detection.model is None:
        raise ValueError(detection.reason)
    return triage.score_open(features(spark, sf_dir, False), detection, duration)


#: The types of the findings that each signal can give.
TYPES = {
    "spikes": {"spike"}, "risk": {"rising_risk"}, "anomalies": {"anomaly"}, "repeats": {"network_hub"}, "gaps": {"data_gap"}, "clusters": {"spatiotemporal"},
    "correlation": {"socio_correlation"}, "emerging": {"emerging_typology"}, "methods": {"mo_signature"}, "predictions": {"predicted_undetected", "predicted_stall"},
}


def all_findings(spark, sf_dir, types: set[str] | None = None):
    """Findings of all signals, or of those that can give one of the types."""
    c, e = cases(spark, sf_dir), events(spark, sf_dir)
    daily = cut(signals.daily_counts(c, "ts", {"area": "area", "category": "category"}))  # three signals read it
    demo = cut(signals.demographics(B.demographics(spark, sf_dir), "area"))
    made = {
        "spikes": lambda: findings.from_spikes(signals.spike_alerts(daily, ["area", "category"], z_threshold=0.0)),
        "risk": lambda: findings.from_risk(signals.area_risk(daily, demo=demo)),
        "anomalies": lambda: findings.from_anomalies(signals.anomalies(c, CASE_ROLES, "case_id", limit=20)),
        "repeats": lambda: findings.from_repeats(graph.repeat_entities(involved(spark, sf_dir))),
        "gaps": lambda: findings.from_digest(profile.digest(c.select("area", "status"))),
        "clusters": lambda: findings.from_clusters(signals.time_clusters(e, EVENT_ROLES, 0.2)),
        "correlation": lambda: findings.from_correlation(signals.correlation(c, "area", demo)),
        "emerging": lambda: findings.from_emerging(signals.emerging(daily)),
        "methods": lambda: findings.from_methods(signals.mo_signatures(e, EVENT_ROLES, "event_id")),
        "predictions": lambda: findings.from_triage(predictions(spark, sf_dir)),
    }
    return findings.build(spark, {k: f for k, f in made.items() if types is None or TYPES[k] & types})[0]


@register()
def f16_findings(spark, sf_dir):
    """Ranked findings."""
    return findings.select(all_findings(spark, sf_dir)).withColumn("evidence", F.to_json("evidence"))


@register(f"""WITH r AS ({own.ORACLE_SQL['a13_area_risk']}), h AS (SELECT max(o_orderdate::DATE) - min(o_orderdate::DATE) AS days FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT count(*) AS n FROM r)
SELECT r.*, CASE WHEN days >= 180 AND n >= 5 THEN 'high' WHEN days >= 60 THEN 'medium' ELSE 'low' END AS confidence FROM r, h, n ORDER BY risk_score DESC, area LIMIT 5""")
def f16_forecast(spark, sf_dir):
    """The five areas of the highest risk, with the forecast's confidence."""
    daily = signals.daily_counts(cases(spark, sf_dir), "ts", {"area": "area", "category": "category"})
    return findings.forecast(signals.area_risk(daily, demo=signals.demographics(B.demographics(spark, sf_dir), "area")), daily)


@register()
def f15_brief(spark, sf_dir):
    """the brief."""
    return findings.brief(findings.select(all_findings(spark, sf_dir)), own.f13_capture_at_k(spark, sf_dir))


HUBS_SQL = f"SELECT 'network_hub:' || id AS id, 'network_hub' AS type, round_even(least(95, 35 + 6 * cases), 0)::INT AS severity FROM (SELECT * FROM ({REPEATS_SQL}) ORDER BY cases DESC, id LIMIT 3)"
METHODS_SQL = f"SELECT 'mo_signature:' || subtype || ':' || band AS id, 'mo_signature' AS type, round_even(least(92, 40 + 4 * n), 0)::INT AS severity FROM (SELECT * FROM ({own.ORACLE_SQL['a10_mo_signatures']}) ORDER BY n DESC, subtype, band LIMIT 2)"
#: The findings that SQL can express, of the same shape.
FOUND_SQL = f"""{HUBS_SQL} UNION ALL {METHODS_SQL}
UNION ALL SELECT 'rising_risk:' || area, 'rising_risk', round_even(least(100, greatest(0, risk_score)), 0)::INT FROM (SELECT * FROM ({own.ORACLE_SQL['a13_area_risk']}) WHERE trend_slope > 0 ORDER BY risk_score DESC, area LIMIT 3)
UNION ALL SELECT 'spatiotemporal:' || category || ':' || area, 'spatiotemporal', round_even(least(95, 45 + share * 45), 0)::INT FROM ({own.ORACLE_SQL['a7_time_clusters']})
UNION ALL SELECT 'socio_correlation:' || factor, 'socio_correlation', round_even(least(95, 40 + abs(r) * 55), 0)::INT FROM (SELECT * FROM ({own.ORACLE_SQL['a8_correlation']}) ORDER BY abs(r) DESC, factor LIMIT 1)
UNION ALL SELECT 'emerging_typology:' || category, 'emerging_typology', round_even(least(95, 45 + growth_pct / 4), 0)::INT FROM (SELECT * FROM ({own.ORACLE_SQL['a9_emerging']}) ORDER BY slope DESC, category LIMIT 2)
UNION ALL SELECT 'anomaly:records', 'anomaly', round_even(least(85, 40 + 2 * least(20, count(*))), 0)::INT FROM orders HAVING count(*) > 0
UNION ALL SELECT 'spike:' || area || ':' || category, 'spike', round_even(least(100, greatest(0, 40 + (z_score - 2.0) * 15)), 0)::INT FROM ({own.ORACLE_SQL['a3_spikes'].replace('>= -1', '>= 0')})"""
FOUND = {"network_hub", "mo_signature", "rising_risk", "spatiotemporal", "socio_correlation", "emerging_typology", "anomaly", "spike"}


@register(FOUND_SQL)
def f3_to_f10_findings(spark, sf_dir):
    """All findings of the signals that SQL can express."""
    return all_findings(spark, sf_dir, FOUND).select("id", "type", "severity")


@register(f"""WITH f AS ({FOUND_SQL}), c AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY severity DESC, id) AS r FROM f QUALIFY r <= 3)
SELECT id, type, severity FROM c ORDER BY CASE WHEN r = 1 AND type = 'spike' THEN 0 WHEN r = 1 AND type = 'rising_risk' THEN 1 ELSE 2 END, severity DESC, id LIMIT 7""")
def f12_selected(spark, sf_dir):
    """the most severe of these findings, some of each type, the headlines in any case."""
    return findings.select(all_findings(spark, sf_dir, FOUND)).select("id", "type", "severity")


@register(f"SELECT * FROM ({HUBS_SQL} UNION ALL {METHODS_SQL})")
def f17_mission(spark, sf_dir):
    """findings of one mission; only its signals are computed."""
    return findings.mission(all_findings(spark, sf_dir, set(findings.MISSIONS["case-linkage"])), "case-linkage").select("id", "type", "severity")


@register("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE '9876543210' END AS phone FROM orders),
g AS (SELECT 'status' AS c, round(1 - count(status) / count(*), 3) AS rate FROM m UNION ALL SELECT 'phone', round(1 - round(count(*) FILTER (phone <> '12') / count(*), 3), 3) FROM m)
SELECT 'data_gap:' || c AS id, round_even(least(80, 30 + rate * 60), 0)::INT AS severity FROM g WHERE rate > 0.1 ORDER BY rate DESC, c LIMIT 1""")
def f6_data_gap(spark, sf_dir):
    """the column with the worst gap."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 5 == 0, "12").otherwise("9876543210").alias("phone"))
    return findings.from_digest(profile.digest(o.select("status", "phone"))).select("id", "severity")


#: The formulas of all severities, over figures of each area.
SEVERITIES_SQL = {
    "spike": "least(100, greatest(0, 40 + (z - threshold) * 15))", "rising_risk": "least(100, greatest(0, risk))", "network_hub": "least(95, 35 + 6 * cases)", "anomaly": "least(85, 40 + 2 * n)",
    "data_gap": "least(80, 30 + rate * 60)", "spatiotemporal": "least(95, 45 + share * 45)", "socio_correlation": "least(95, 40 + abs(r) * 55)", "emerging_typology": "least(95, greatest(0, 45 + growth / 4))",
    "mo_signature": "least(92, 40 + 4 * n)", "predicted_undetected": "least(95, 35 + n * 1.5 + risk * 40)", "predicted_stall": "least(90, 40 + 5 * n)",
}


@register(f"""WITH {CASES_SQL}, a AS (SELECT area, count(*) AS k, count(*) FILTER (status = 'F') / count(*)::DOUBLE AS share FROM cases GROUP BY ALL),
x AS (SELECT area, (k % 9)::DOUBLE - 3 AS z, 2.0::DOUBLE AS threshold, share AS risk, k % 13 AS cases, k % 11 AS n, share AS rate, share, share - 1 AS r, (k % 400)::DOUBLE - 200 AS growth FROM a)
{" UNION ALL ".join(f"SELECT area, '{t}' AS type, round_even({f}, 0)::INT AS severity FROM x" for t, f in SEVERITIES_SQL.items())}""")
def f1_severities(spark, sf_dir):
    """the eleven formulas over figures of areas."""
    a = cases(spark, sf_dir).groupBy("area").agg(F.count("*").alias("k"), (F.count_if(F.col("status") == "F") / F.count("*")).alias("share"))
    k, share = F.col("k"), F.col("share")
    c = {"z": (k % 9).cast("double") - 3, "threshold": F.lit(2.0), "risk": share, "cases": k % 13, "n": k % 11, "rate": share, "share": share, "r": share - 1, "growth": (k % 400).cast("double") - 200}
    found = [F.struct(F.lit(t).alias("type"), s.alias("severity")) for t, s in findings.severities(c).items()]
    return a.select("area", F.inline(F.array(*found)))


SEV_SQL = own.ORACLE_SQL["a3_spikes"]


@register(f"SELECT 'spike:' || area || ':' || category AS id, round_even(least(100, greatest(0, 40 + (z_score - 2.0) * 15)), 0)::INT AS severity FROM ({SEV_SQL})")
def f2_spike_findings(spark, sf_dir):
    """severities of spikes."""
    return findings.from_spikes(own.a3_spikes(spark, sf_dir)).select("id", "severity")


_LONG = lambda section, key, metrics, source: " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({source})" for m in metrics)
YEAR_SQL = f"(WITH {CASES_SQL} SELECT * FROM cases WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1997-12-31 23:59:59')"
_PER_LAKH = f"WITH {own.DEMO_SQL} SELECT area, population, density, urbanization, CAST(NULL AS DOUBLE) AS literacy FROM demo"


@register(" UNION ALL ".join([
    f"SELECT 'kpi' AS section, 'total' AS key, 'value' AS metric, count(*)::DOUBLE AS value FROM {YEAR_SQL}", f"SELECT 'kpi', 'areas', 'value', count(DISTINCT area) FROM {YEAR_SQL}", f"SELECT 'kpi', 'value', 'value', sum(money) FROM {YEAR_SQL}",
    *[_LONG(s, c, ["count"], f"SELECT {c}, count(*) AS count FROM {YEAR_SQL} GROUP BY ALL ORDER BY count DESC, {c} LIMIT {top}") for s, c, top in (("area", "area", 100), ("category", "category", 50), ("status", "status", 20))],
    _LONG("month", "strftime(period, '%Y-%m-%d %H:%M:%S')", ["count"], f"SELECT date_trunc('month', ts)::TIMESTAMP AS period, count(*) AS count FROM {YEAR_SQL} GROUP BY ALL"),
    _LONG("spike", "area || ' / ' || category", ["z_score", "pct_change"], f"SELECT * FROM ({own.ORACLE_SQL['a3_spikes'].replace('>= -1', '>= 2.5')}) ORDER BY z_score DESC, area, category LIMIT 10"),
    _LONG("risk", "area", ["risk_score", "forecast_daily"], own.ORACLE_SQL["a13_area_risk"]), _LONG("demographics", "area", ["population", "density", "urbanization", "literacy"], _PER_LAKH),
    _LONG("network", "id", ["cases"], REPEATS_SQL),
]).replace("sum(money)", "round(sum(money), 2)"))
def r1_handbook(spark, sf_dir):
    """The handbook of a year."""
    specs = [Kpi("total"), Kpi("areas", "distinct", "area"), Kpi("value", "sum", "money")]
    demo = signals.demographics(B.demographics(spark, sf_dir), "area")
    out = reports.handbook(cases(spark, sf_dir), CASE_ROLES, specs, demo, graph.repeat_entities(involved(spark, sf_dir)), 1997)
    money = (F.col("section") == "kpi") & (F.col("key") == "value")  # sums of doubles end differently
    return out.withColumn("value", F.when(money, F.round("value", 2)).otherwise(F.col("value")))


@register(f"SELECT area, category, z_score FROM ({own.ORACLE_SQL['a3_spikes']}) WHERE category <> '1-URGENT'")
def r2_new_alerts(spark, sf_dir):
    """R2: spikes that are not on file."""
    daily = own.daily(spark, sf_dir)
    known = cases(spark, sf_dir).filter("category = '1-URGENT'").select("area", "category").distinct()
    return reports.new_alerts(daily, ["area", "category"], known, z_threshold=-1.0).select("area", "category", "z_score")


@register(f"""WITH {CASES_SQL}, ru(rule_id, s, e, threshold, cmp) AS (VALUES (1, TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-01', -50.0, 'gte'), (2, TIMESTAMP '1997-01-01', TIMESTAMP '1997-02-01', -90.0, 'lte'), (3, TIMESTAMP '1998-01-01', TIMESTAMP '1998-07-01', -100.0, 'gte')),
n AS (SELECT rule_id, threshold, cmp, count(*) FILTER (ts >= s) AS c, count(*) FILTER (ts < s) AS p FROM ru JOIN cases ON ts >= s - (e - s) AND ts < e GROUP BY ALL),
x AS (SELECT rule_id, threshold, cmp, round((c - p) * 100.0::DOUBLE / nullif(p, 0), 1) AS percent_change FROM n)
SELECT rule_id, percent_change FROM x WHERE CASE WHEN cmp = 'gte' THEN percent_change >= threshold ELSE percent_change <= threshold END""")
def r4_watch(spark, sf_dir):
    """Watch rules over windows."""
    d = datetime
    rows = [(1, d(1996, 1, 1), d(1996, 3, 1), -50.0, "gte", True), (2, d(1997, 1, 1), d(1997, 2, 1), -90.0, "lte", True), (3, d(1998, 1, 1), d(1998, 7, 1), -100.0, "gte", True), (4, d(1998, 1, 1), d(1998, 7, 1), -100.0, "gte", False)]
    rules = spark.createDataFrame(rows, "rule_id int, start timestamp_ntz, end timestamp_ntz, threshold double, comparison string, enabled boolean")
    return reports.watch(rules, cases(spark, sf_dir), CASE_ROLES, version="v1").select("rule_id", "percent_change")
