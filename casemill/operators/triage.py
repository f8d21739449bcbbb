"""Case triage: will a case be detected, and how long will it take? Results are advisory.

Features come from an allow-list of roles; names, identifiers and personal attributes can never be among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.expressions import status_label, try_ts
from casemill.functions.roles import RoleMap
from casemill.operators import boosting
from casemill.plans.lineage import cut, small_or_not, stored

CATEGORIES, NUMBERS = ("crime_type", "gravity", "area"), ("hour", "dow", "report_delay_h", "property_loss", "n_linked")
ALLOWED_ROLES = ("category", "subcategory", "status", "admin_area_1", "timestamp", "date", "money", "measure")
LEAST_ROWS, SEED, TREES = 200, 42, 20
RESOLUTION = r"(?i)csdate|chargesheet|disposal|closed"


@dataclass
class Bundle:
    """A fitted model (None: unavailable, with the reason) and its figures."""

    model: boosting.Boosted | None
    reason: str | None = None
    metrics: dict | None = None
    importance: DataFrame | None = None


def linked_counts(child: DataFrame, fk: str) -> DataFrame:
    """case_key, n_linked: linked persons of each case."""
    return child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).cast("string").alias("case_key")).agg(F.count("*").alias("n_linked"))


def features(df: DataFrame, roles: RoleMap, linked: DataFrame | None = None, gravity: str | None = None, training: bool = True) -> DataFrame:
    """case_id, label (1: detected) if training, and the features of closed (training) or open cases."""
    state = status_label(F.col(roles.first("status")))
    times = roles.all("timestamp", "date")
    allowed = {roles.first("category"), roles.first("subcategory"), roles.area, roles.first("money"), gravity, *times} - {None}
    if bad := {c for c in allowed if roles.columns.get(c) not in ALLOWED_ROLES and c != gravity}:
        raise ValueError(f"not allowed as features: {sorted(bad)}")
    when = try_ts(df, times[0])
    later = (F.unix_timestamp(try_ts(df, times[1]).cast("timestamp")) - F.unix_timestamp(when.cast("timestamp"))) / 3600.0 if len(times) > 1 else F.lit(None).cast("double")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) if c else F.lit("__missing__")
    rows = df.withColumn("__state", state).filter("__state IN ('detected', 'undetected')" if training else "__state = 'open'")
    out = rows.select(
        F.col(roles.first("id")).cast("string").alias("case_id"), (F.col("__state") == "detected").cast("double").alias("label"),
        text(roles.first("category")).alias("crime_type"), text(gravity).alias("gravity"), text(roles.area).alias("area"),
        F.coalesce(F.hour(when), F.lit(-1)).cast("double").alias("hour"), F.coalesce(F.weekday(when), F.lit(-1)).cast("double").alias("dow"),
        F.greatest(later, F.lit(0.0)).alias("report_delay_h"), (F.coalesce(F.col(roles.first("money")).cast("double"), F.lit(0.0)) if roles.first("money") else F.lit(0.0)).alias("property_loss"),
    )
    median = out.agg(F.percentile("report_delay_h", 0.5)).first()[0] if len(times) > 1 else None  # before the join, which it doesn't need
    if linked is not None:
        out = out.join(linked, out.case_id == linked.case_key, "left").drop("case_key")
    else:
        out = out.withColumn("n_linked", F.lit(0))
    out = out.withColumns({"report_delay_h": F.coalesce("report_delay_h", F.lit(median), F.lit(0.0)), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("double")})
    return out if training else out.drop("label")


def indexers() -> list:
    """Categories as numbers, the commonest first, equal ones in alphabetical order."""
    return [StringIndexer(inputCols=list(CATEGORIES), outputCols=[f"{c}_i" for c in CATEGORIES], handleInvalid="keep")]


def auc(df: DataFrame, score: str, label: str = "label") -> float:
    """The area under the ROC curve over all distinct scores (no bins)."""
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0).evaluate(df)


def split(df: DataFrame, share: float = 0.75, key: str = "case_id", label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A split by the hash of the id, the same in each run; with a label, each of its values gives its share."""
    u = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(10_000))
    if label is None:
        return df.filter(u < 10_000 * share), df.filter(u >= 10_000 * share)
    ends = df.groupBy(F.col(label).alias("__l")).agg(F.percentile(u, F.lit(share)).alias("__end"))  # of 10,000 values a label
    marked = df.join(small_or_not(cut(ends), 10_000), F.col(label).eqNullSafe(F.col("__l")))
    return marked.filter(u <= F.col("__end")).select(*df.columns), marked.filter(u > F.col("__end")).select(*df.columns)


def train_detection(df: DataFrame, repeats: int = 5, trees: int = TREES) -> Bundle:
    """A boosted classifier of detected against undetected cases."""
    df = stored(df, "triage")
    n = {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sum(n.values()) < LEAST_ROWS or len(n) < 2:
        return Bundle(None, "needs 200 closed cases of two outcomes")
    train, test = split(df, label="label")
    model = boosting.fit(train, "label", list(CATEGORIES), list(NUMBERS), "log", trees)
    test = stored(test, "triage-test")
    return Bundle(model, None, {"auc": auc(model.transform(test), "raw"), "n_train": sum(n.values()), "base_rate": n.get(1.0, 0) / sum(n.values())}, boosting.importance(model, test, "label", repeats) if repeats else None)


def resolution_table(profile: DataFrame, relations: DataFrame, primary: str) -> DataFrame:
    """table, column: date columns named like a charge sheet or disposal, of tables that refer to the primary one."""
    dates = profile.filter(F.col("role").isin("timestamp", "date") & (F.col("column").rlike(RESOLUTION) | F.col("table").rlike(RESOLUTION)) & (F.col("table") != primary))
    tied = relations.select(F.explode(F.array("from_table", "to_table")).alias("table")).distinct()
    return dates.join(tied, "table", "left_semi").orderBy("table", "position").select("table", "column").limit(1)


def durations(cases: DataFrame, case_id: str, occurred: str, resolutions: DataFrame, fk: str, resolved: str) -> DataFrame:
    """case_id, days: from a case to its first resolution, if that isn't before it."""
    first = resolutions.groupBy(F.col(fk).cast("string").alias("k")).agg(F.min(try_ts(resolutions, resolved)).alias("end"))
    own = cases.select(F.col(case_id).cast("string").alias("case_id"), try_ts(cases, occurred).alias("start")).join(first, F.col("case_id") == F.col("k"))
    days = (F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 86_400.0
    return own.select("case_id", days.alias("days")).filter("days >= 0")


def train_duration(df: DataFrame, trees: int = TREES) -> Bundle:
    """A boosted regressor of ``days``."""
    if df.count() < LEAST_ROWS:
        return Bundle(None, "needs 200 resolved cases")
    train, test = split(df)
    model = boosting.fit(train, "days", list(CATEGORIES), list(NUMBERS), "squared", trees)
    mae = model.transform(test).agg(F.avg(F.abs(F.col("prediction") - F.col("days")))).first()[0]
    m = df.agg(F.percentile("days", 0.5).alias("median"), F.percentile("days", 0.9).alias("p90"), F.count("*").alias("n")).first()
    return Bundle(model, None, {"mae": mae, "median": m["median"], "p90": m["p90"], "n_train": m["n"]})


def factors(df: DataFrame, importance: list[str], near: float = 0.15) -> DataFrame:
    """``df`` with texts on its three most important features, against the mean of the open cases."""
    top = importance[:3]
    means = df.agg(*[F.avg(F.col(f).try_cast("double")).alias(f) for f in top]).first()
    texts = []
    for f in top:
        m, v = means[f], F.col(f).try_cast("double")
        if f in CATEGORIES or m is None:
            texts.append(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")))
        else:
            texts.append(F.when(v > m + abs(m) * near, f"{f} above average").when(v < m - abs(m) * near, f"{f} below average").otherwise(f"{f} near average"))
    return df.withColumn("factors", F.array_compact(F.array(*texts)))


def score_open(open_cases: DataFrame, detection: Bundle, duration: Bundle | None = None, limit: int = 25) -> DataFrame:
    """case_id, probability, days, stall, factors: open cases, the least likely to be detected first."""
    out = detection.model.transform(open_cases)
    out = out.select(*open_cases.columns, F.round("probability", 4).alias("probability"))
    if duration is not None and duration.model is not None:
        out = duration.model.transform(out).select(*out.columns, F.round("prediction", 1).alias("days"))
        out = out.withColumn("stall", F.col("days") > duration.metrics["median"])
    else:
        out = out.withColumns({"days": F.lit(None).cast("double"), "stall": F.lit(False)})
    order = [r.feature for r in detection.importance.collect()] if detection.importance is not None else list(NUMBERS)
    out = factors(out, order)
    return out.select("case_id", "area", "probability", "days", "stall", "factors").orderBy("probability", "case_id").limit(limit)


def rate_by_area(open_cases: DataFrame, detection: Bundle) -> DataFrame:
    """area, rate, n: the mean predicted probability, lowest first."""
    return mean_by_area(detection.model.transform(open_cases).withColumnRenamed("probability", "p"))


def mean_by_area(scored: DataFrame) -> DataFrame:
    """area, rate, n: the mean of p, lowest first."""
    return scored.groupBy("area").agg(F.round(F.avg("p"), 4).alias("rate"), F.count("*").alias("n")).orderBy("rate", "area")
