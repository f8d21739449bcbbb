"""Reports, alerts and watch rules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.expressions import pct_delta, try_ts
from casemill.functions.roles import RoleMap
from casemill.operators import query, signals
from casemill.operators.query import Kpi, Query
from casemill.plans.lineage import cut

LONG = "section string, key string, metric string, value double"


def _long(df: DataFrame, section: str, key: str, metrics: list[str]) -> DataFrame:
    facts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.inline(facts))


def handbook(df: DataFrame, roles: RoleMap, kpis: list[Kpi], demo: DataFrame | None = None, network: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """section, key, metric, value. A year limits the aggregates, not the spikes and the risk."""
    time = roles.time
    span = {time: {"from": datetime(year, 1, 1), "to": datetime(year, 12, 31, 23, 59, 59)}} if year and time else {}
    out = _long(query.kpis(df, kpis, span), "kpi", "id", ["value"])
    for section, column, top in (("area", roles.area, 100), ("category", roles.first("category"), 50), ("status", roles.first("status"), 20)):
        if column:
            out = out.unionByName(_long(query.run(df, Query([column], filters=span, order_by="count", limit=top)), section, column, ["count"]))
    if time:
        out = out.unionByName(_long(query.run(df, Query(time_dimension=time, time_grain="month", filters=span)), "month", "period", ["count"]))
    if time and roles.area:
        by = {"area": roles.area} | ({"category": roles.first("category")} if roles.first("category") else {})
        daily = signals.daily_counts(df, time, by)
        spikes = signals.spike_alerts(daily, list(by), top=10).withColumn("key", F.concat_ws(" / ", *by))
        out = out.unionByName(_long(spikes, "spike", "key", ["z_score", "pct_change"])).unionByName(_long(signals.area_risk(daily, demo=demo), "risk", "area", ["risk_score", "forecast_daily"]))
    if demo is not None:
        out = out.unionByName(_long(demo, "demographics", "area", ["population", "density", "urbanization", "literacy"]))
    if network is not None:
        out = out.unionByName(_long(network, "network", "id", [c for c in ("degree", "cases") if c in network.columns]))
    return out


def new_alerts(daily: DataFrame, groups: list[str], existing: DataFrame, window_days: int = 28, z_threshold: float = 3.0) -> DataFrame:
    """Spikes of groups that no existing alert has."""
    found = signals.spike_alerts(daily, groups, window_days, z_threshold)
    known = existing.select(*[F.col(g).alias(f"__{g}") for g in groups]).distinct()
    same = F.lit(True)
    for g in groups:
        same = same & found[g].eqNullSafe(F.col(f"__{g}"))
    return found.join(known, same, "left_anti")


def scan_all(spark: SparkSession, datasets: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """dataset, alerts: new alerts of each data set; one whose job fails, at whatever point, doesn't stop the others."""
    out, failed = [], {}
    for name, make in datasets.items():
        try:
            out.append((name, make().count()))
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    return spark.createDataFrame(out, "dataset string, alerts long"), failed


def latest_alerts(alerts: DataFrame, at: str = "created_at", limit: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc(at), *[c for c in alerts.columns if c != at]).limit(limit)


def counts_before(rows: DataFrame, points: DataFrame) -> DataFrame:
    """at, before: for each distinct time of ``points`` (at), the rows (ts) earlier than it.

    Whole days are added up over a row a day; within its own day each point meets the times of that day only.
    """
    times = rows.groupBy(F.col("ts").cast("date").alias("day"), "ts").agg(F.count("*").alias("n"))
    asked = points.select("at").distinct().withColumn("day", F.col("at").cast("date"))
    days = times.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.lit(1).alias("own"), "n", F.lit(None).cast("timestamp_ntz").alias("at"))
    marks = days.unionByName(asked.select("day", F.lit(0).alias("own"), F.lit(0).cast("long").alias("n"), "at"))
    upto = W.orderBy("day", "own").rowsBetween(W.unboundedPreceding, W.currentRow)  # days and points: few rows
    earlier = marks.withColumn("before", F.sum("n").over(upto)).filter("own = 0").select("at", "before")
    same_day = asked.join(times, "day").filter(F.col("ts") < F.col("at")).groupBy("at").agg(F.sum("n").alias("same"))
    return earlier.join(same_day, "at", "left").select("at", (F.col("before") + F.coalesce("same", F.lit(0))).alias("before"))


def watch(rules: DataFrame, df: DataFrame, roles: RoleMap, existing: DataFrame | None = None, version: str = "") -> DataFrame:
    """rule_id, percent_change, event: enabled rules whose window changed enough against the one before.

    rules: rule_id, start, end (timestamp_ntz), threshold, comparison (gte or lte), enabled. Each is counted once a
    version: events (column event) that exist already are left out. A window's cases are those before its end less those
    before its start, so rules and cases never meet in a range join.
    """
    own = rules.filter("enabled").select("rule_id", "start", "end", "threshold", "comparison", (F.col("start") - (F.col("end") - F.col("start"))).alias("before"))
    rows = df.select(try_ts(df, roles.time).alias("ts")).filter("ts IS NOT NULL")
    points = own.select(F.explode(F.array("before", "start", "end")).alias("at"))
    counts = cut(counts_before(rows, points))
    n = own
    for c in ("before", "start", "end"):
        n = n.join(counts.select(F.col("at").alias(c), F.col("before").alias(f"n_{c}")), c)
    n = n.withColumns({"current": F.col("n_end") - F.col("n_start"), "previous": F.col("n_start") - F.col("n_before")})
    n = n.withColumn("percent_change", pct_delta(F.col("current"), F.col("previous")))
    hit = F.when(F.col("comparison") == "gte", F.col("percent_change") >= F.col("threshold")).otherwise(F.col("percent_change") <= F.col("threshold"))
    event = F.sha2(F.concat_ws("|", F.col("rule_id").cast("string"), F.lit(version), F.date_format("start", "yyyy-MM-dd HH:mm:ss"), F.date_format("end", "yyyy-MM-dd HH:mm:ss")), 256)
    out = n.filter(hit).select("rule_id", "percent_change", event.alias("event"))
    return out if existing is None else out.join(existing.select("event").distinct(), "event", "left_anti").select("rule_id", "percent_change", "event")
