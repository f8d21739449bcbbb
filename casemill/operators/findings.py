"""Findings: signals as ranked rows of one shape, and a brief of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.expressions import severity
from casemill.plans.lineage import cut

#: Signals that are computed at once.
AT_ONCE = 4
SHAPE = "id string, type string, severity int, title string, evidence map<string,string>, area string, category string, suggested_action string, surface string"
PER_TYPE, TOP, HEADLINES = 3, 7, ("spike", "rising_risk")
# The signal families that each mission shows.
MISSIONS = {
    "emerging-threat": ("spike", "emerging_typology", "rising_risk", "predicted_undetected", "predicted_stall"),
    "hotspot-patrol": ("spatiotemporal", "spike", "rising_risk", "socio_correlation", "anomaly"),
    "case-linkage": ("network_hub", "mo_signature"),
}


def severities(c: dict[str, Column]) -> dict[str, Column]:
    """The severity of each signal type from its figure (fixed values: offsets, slopes and tops)."""
    z = F.lit(0.0)
    get = lambda k: c.get(k, z)
    return {
        "spike": severity(40 + (get("z") - get("threshold")) * 15, 100.0),
        "rising_risk": severity(get("risk"), 100.0),
        "network_hub": severity(35 + 6 * get("cases"), 95.0),
        "anomaly": severity(40 + 2 * get("n"), 85.0),
        "data_gap": severity(30 + get("rate") * 60, 80.0),
        "spatiotemporal": severity(45 + get("share") * 45, 95.0),
        "socio_correlation": severity(40 + F.abs(get("r")) * 55, 95.0),
        "emerging_typology": severity(45 + get("growth") / 4, 95.0),
        "mo_signature": severity(40 + 4 * get("n"), 92.0),
        "predicted_undetected": severity(35 + get("n") * 1.5 + get("risk") * 40, 95.0),
        "predicted_stall": severity(40 + 5 * get("n"), 90.0),
    }


def _shape(df: DataFrame, kind: str, ident: Column, sev: Column, title: Column, evidence: list[str], action: Column, area: Column | None = None, category: Column | None = None, surface: str = "dashboard") -> DataFrame:
    none = F.lit(None).cast("string")
    facts = F.create_map(*[x for e in evidence for x in (F.lit(e), F.col(e).cast("string"))]) if evidence else F.create_map().cast("map<string,string>")
    return df.select(F.concat(F.lit(f"{kind}:"), ident).alias("id"), F.lit(kind).alias("type"), sev.alias("severity"), title.alias("title"), facts.alias("evidence"), (none if area is None else area.cast("string")).alias("area"), (none if category is None else category.cast("string")).alias("category"), action.alias("suggested_action"), F.lit(surface).alias("surface"))


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def from_spikes(spikes: DataFrame, threshold: float = 2.0) -> DataFrame:
    sev = severities({"z": F.col("z_score"), "threshold": F.lit(threshold)})["spike"]
    title = _s(F.col("category"), " in ", F.col("area"), " changed by ", F.col("pct_change"), "% (z=", F.col("z_score"), ")")
    return _shape(spikes, "spike", _s(F.col("area"), ":", F.col("category")), sev, title, ["z_score", "baseline_daily", "recent_daily", "pct_change"], _s("Check the staffing of ", F.col("area"), " for ", F.col("category")), F.col("area"), F.col("category"))


def from_risk(risk: DataFrame, top: int = 3) -> DataFrame:
    rising = risk.filter("trend_slope > 0").orderBy(F.desc("risk_score"), "area").limit(top)
    return _shape(rising, "rising_risk", F.col("area"), severities({"risk": F.col("risk_score")})["rising_risk"], _s("Rising risk in ", F.col("area"), ": ", F.col("risk_score")), ["risk_score", "trend_slope", "forecast_daily"], _s("Plan patrols in ", F.col("area")), F.col("area"), surface="map")


def from_repeats(repeats: DataFrame, top: int = 3) -> DataFrame:
    hubs = repeats.orderBy(F.desc("cases"), "id").limit(top)
    return _shape(hubs, "network_hub", F.col("id"), severities({"cases": F.col("cases")})["network_hub"], _s(F.col("id"), " is linked to ", F.col("cases"), " cases"), ["cases"], _s("Review the cases of ", F.col("id"), " together"), surface="network")


def from_anomalies(anomalies: DataFrame) -> DataFrame:
    n = anomalies.agg(F.count("*").alias("n")).filter("n > 0")
    return _shape(n, "anomaly", F.lit("records"), severities({"n": F.col("n")})["anomaly"], _s(F.col("n"), " records flagged as outliers"), ["n"], F.lit("Check the flagged records"))


def from_digest(digest: DataFrame, threshold: float = 0.10) -> DataFrame:
    """The worst gap: missing values, or phone numbers of a wrong length."""
    phone = F.when((F.col("phone_like_rate") > 0.3) & (F.col("phone_like_rate") < 0.9), 1 - F.col("phone_like_rate"))
    rate = F.greatest(F.coalesce("null_pct", F.lit(0.0)), F.coalesce(phone, F.lit(0.0)))
    worst = digest.withColumn("rate", F.round(rate, 3)).filter(F.col("rate") > threshold).orderBy(F.desc("rate"), "column").limit(1)
    return _shape(worst, "data_gap", F.col("column"), severities({"rate": F.col("rate")})["data_gap"], _s("Column ", F.col("column"), " has gaps in ", F.col("rate"), " of its rows"), ["rate"], F.lit("Clean the column before use"))


def from_clusters(clusters: DataFrame) -> DataFrame:
    return _shape(clusters, "spatiotemporal", _s(F.col("category"), ":", F.col("area")), severities({"share": F.col("share")})["spatiotemporal"], _s(F.col("category"), " in ", F.col("area"), " concentrates at ", F.col("band")), ["band", "share", "n"], _s("Patrol at ", F.col("band")), F.col("area"), F.col("category"), "map")


def from_correlation(corr: DataFrame) -> DataFrame:
    one = corr.orderBy(F.abs("r").desc(), "factor").limit(1)
    return _shape(one, "socio_correlation", F.col("factor"), severities({"r": F.col("r")})["socio_correlation"], _s("Rates go with ", F.col("factor"), " (r=", F.col("r"), ")"), ["r", "n_areas", "direction"], F.lit("Take the factor into account; it proves no cause"))


def from_emerging(emerging: DataFrame, top: int = 2) -> DataFrame:
    own = emerging.orderBy(F.desc("slope"), "category").limit(top)
    return _shape(own, "emerging_typology", F.col("category"), severities({"growth": F.col("growth_pct")})["emerging_typology"], _s(F.col("category"), " grows by ", F.col("growth_pct"), "%"), ["slope", "mean_per_week", "growth_pct"], _s("Look into ", F.col("category")), category=F.col("category"))


def from_methods(methods: DataFrame, top: int = 2) -> DataFrame:
    own = methods.orderBy(F.desc("n"), "subtype", "band").limit(top)
    return _shape(own, "mo_signature", _s(F.col("subtype"), ":", F.col("band")), severities({"n": F.col("n")})["mo_signature"], _s(F.col("subtype"), " at ", F.col("band"), " in ", F.col("n_areas"), " areas"), ["n", "n_areas"], F.lit("Compare the cases"), category=F.col("subtype"), surface="network")


def from_triage(scored: DataFrame) -> DataFrame:
    """One finding on the flagged cases (those that score_open gives: the least likely to be detected), and one on cases that will take long."""
    n = scored.agg(F.count("*").alias("n"), F.coalesce(F.avg(1 - F.col("probability")), F.lit(0.0)).alias("risk"), F.count_if("stall").alias("stall"))
    low = _shape(n.filter("n > 0"), "predicted_undetected", F.lit("open"), severities({"n": F.col("n"), "risk": F.col("risk")})["predicted_undetected"], _s(F.col("n"), " open cases will hardly be detected (advisory)"), ["n", "risk"], F.lit("Review these cases first"))
    slow = n.select(F.col("stall").alias("n")).filter("n > 0")
    return low.unionByName(_shape(slow, "predicted_stall", F.lit("open"), severities({"n": F.col("n")})["predicted_stall"], _s(F.col("n"), " open cases may take longer than usual (advisory)"), ["n"], F.lit("Check for what holds them up")))


def select(findings: DataFrame, per_type: int = PER_TYPE, top: int = TOP) -> DataFrame:
    """The most severe findings, some of each type at most; the first spike and rising risk come first in any case."""
    own = W.partitionBy("type").orderBy(F.desc("severity"), "id")
    capped = findings.withColumn("__r", F.row_number().over(own)).filter(F.col("__r") <= per_type)
    head = F.when((F.col("__r") == 1) & F.col("type").isin(*HEADLINES), F.when(F.col("type") == HEADLINES[0], 0).otherwise(1)).otherwise(2)
    return capped.withColumn("__h", head).orderBy("__h", F.desc("severity"), "id").limit(top).drop("__r", "__h")


def mission(findings: DataFrame, name: str) -> DataFrame:
    return findings.filter(F.col("type").isin(*MISSIONS[name]))


def confidence(history_days: Column, n_areas: Column) -> Column:
    return F.when((history_days >= 180) & (n_areas >= 5), "high").when(history_days >= 60, "medium").otherwise("low")


def forecast(risk: DataFrame, daily: DataFrame, top: int = 5) -> DataFrame:
    """The areas of the highest risk, and the confidence by the days of history and the number of areas."""
    history = daily.agg(F.datediff(F.max("day"), F.min("day")).alias("history_days"))  # a row
    size = risk.agg(F.count("*").alias("n_areas")).crossJoin(F.broadcast(history))
    own = risk.orderBy(F.desc("risk_score"), "area").limit(top).crossJoin(F.broadcast(size))
    return own.withColumn("confidence", confidence(F.col("history_days"), F.col("n_areas"))).orderBy(F.desc("risk_score"), "area").drop("history_days", "n_areas")


def brief(selected: DataFrame, backtest: DataFrame | None = None) -> DataFrame:
    """One row of text on the selected findings."""
    rows = selected.withColumn("h", F.when(F.col("type") == "spike", 0).when(F.col("type") == "rising_risk", 1).otherwise(2))
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.struct((-F.col("severity")).alias("s"), "id", "title")))["title"]
    sums = rows.agg(F.count("*").alias("n"), F.min(F.struct("h", (-F.col("severity")).alias("s"), "id", "title"))["title"].alias("top"), first("rising_risk").alias("risk"), first("data_gap").alias("gap"))
    if backtest is not None:
        sums = sums.join(F.broadcast(backtest.select("capture_rate").limit(1)), F.lit(True), "left")
    else:
        sums = sums.withColumn("capture_rate", F.lit(None).cast("double"))
    text = F.concat_ws(
        " ", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " priority finding.").otherwise(" priority findings.")), F.concat(F.lit("Most urgent: "), F.col("top"), F.lit(".")),
        F.concat(F.lit("Watch: "), F.col("risk"), F.lit(".")), F.concat(F.lit("Data caveat: "), F.col("gap"), F.lit(".")),
        F.concat(F.lit("Back-test: the leading areas held "), F.round(F.col("capture_rate") * 100, 0).cast("int").cast("string"), F.lit("% of the next week's cases.")),
    )
    return sums.select(F.when(F.col("n") == 0, "No significant problems detected in this dataset.").otherwise(text).alias("brief"))


def build(spark: SparkSession, signals: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """All findings of the signals, and why the others gave none: a failing signal contributes nothing.

    Each signal is computed here (it is a few rows), so that one that fails only while its job runs is contained too.
    Signals run side by side, AT_ONCE at a time: most are chains of small jobs that leave executors idle.
    """
    out, failed = spark.createDataFrame([], SHAPE), {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        made = {name: pool.submit(inheritable_thread_target(spark)(lambda make=make: cut(make()))) for name, make in signals.items()}
    for name, result in made.items():
        try:
            out = out.unionByName(result.result())
        except Exception as e:  # the other signals still count
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    return out, failed
