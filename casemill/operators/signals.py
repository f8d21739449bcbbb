"""Statistical signals over cases: hotspots, spikes, trends, correlation and risk."""

from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.expressions import day_of, frequencies, hour_band, per_lakh, ratio, try_ts
from casemill.functions.roles import RoleMap, unavailable
from casemill.plans.lineage import cut, small_or_not, stored

# Kilometres of a degree, weights of the risk score, patterns of demographic columns.
KM_LAT, KM_LNG, LEAST_COS, NO_LAT = 110.574, 111.320, 0.2, 13.0
#: Areas whose spans are broadcast.
MOST_AREAS = 200_000
RISK_PLAIN, RISK_EXPOSED = (0.5, 0.3, 0.2), (0.40, 0.25, 0.15, 0.20)
DEMOGRAPHIC = (("population", r"population|^pop($|_)"), ("density", "densit"), ("urbanization", "urban"), ("literacy", "litera"))


def grid_hotspots(df: DataFrame, roles: RoleMap, cell_km: float = 2.0, category: str | None = None, hour_from: int | None = None, hour_to: int | None = None, least: int = 3, top: int = 2000) -> DataFrame:
    """lat, lng, n, intensity: cells of a grid with at least ``least`` cases; the 95th percentile of n has intensity 1."""
    lat, lng = roles.first("latitude"), roles.first("longitude")
    if not lat or not lng:
        return unavailable(df.sparkSession, "lat double, lng double, n long, intensity double", "no coordinates")
    mid = df.agg(F.avg(lat)).first()[0] or NO_LAT  # of all rows, whatever the filters
    dlat, dlng = cell_km / KM_LAT, cell_km / (KM_LNG * max(math.cos(math.radians(mid)), LEAST_COS))
    rows = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    if category is not None and roles.first("category"):
        rows = rows.filter(F.col(roles.first("category")) == category)
    if hour_from is not None and hour_to is not None and roles.first("timestamp"):
        rows = rows.filter(F.hour(try_ts(df, roles.first("timestamp"))).between(hour_from, hour_to))
    cells = rows.groupBy(F.round(F.col(lat) / dlat).alias("i"), F.round(F.col(lng) / dlng).alias("j")).agg(F.count("*").alias("n"))
    cells = cells.filter(F.col("n") >= least).orderBy(F.desc("n"), "i", "j").limit(top)
    p95 = cells.agg(F.percentile("n", 0.95).alias("p"))
    return cells.crossJoin(F.broadcast(p95)).select(F.round(F.col("i") * dlat, 5).alias("lat"), F.round(F.col("j") * dlng, 5).alias("lng"), "n", F.round(F.least(ratio(F.col("n"), F.col("p")), F.lit(1.0)), 4).alias("intensity"))


def daily_counts(df: DataFrame, time: str, groups: dict[str, str]) -> DataFrame:
    """Rows of each day and group (name: column); days without rows are absent, rows without a time are left out."""
    keys = [F.col(c).alias(name) for name, c in groups.items()]
    return df.select(*keys, day_of(df, time).alias("day")).filter("day IS NOT NULL").groupBy(*groups, "day").agg(F.count("*").alias("n"))


def spike_alerts(daily: DataFrame, groups: list[str], window_days: int = 28, z_threshold: float = 2.5, top: int = 50, least_days: int = 30) -> DataFrame:
    """Groups whose recent mean day is far above their baseline (means are over the days that occur)."""
    last = F.broadcast(daily.agg(F.max("day").alias("__last")))
    rows = daily.filter(" AND ".join(f"`{g}` IS NOT NULL" for g in groups) or "true").crossJoin(last)
    recent = F.col("day") >= F.date_sub("__last", window_days)
    old, new = F.when(~recent, F.col("n")), F.when(recent, F.col("n"))
    stats = rows.groupBy(*groups).agg(F.avg(old).alias("mu"), F.stddev_samp(old).alias("sd"), F.count(old).alias("days"), F.avg(new).alias("now"))
    stats = stats.filter((F.col("days") >= least_days) & F.col("now").isNotNull())
    z = (F.col("now") - F.col("mu")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(0.5))
    out = stats.withColumn("z", z).filter(F.col("z") >= z_threshold)
    out = out.select(*groups, F.round("mu", 2).alias("baseline_daily"), F.round("now", 2).alias("recent_daily"), F.round(ratio((F.col("now") - F.col("mu")) * 100, F.col("mu")), 1).alias("pct_change"), F.round("z", 2).alias("z_score"))
    return out.orderBy(F.desc("z_score"), *groups).limit(top)


ANOMALIES = "key string, score double, flagged boolean, record map<string,string>"


def anomalies(df: DataFrame, roles: RoleMap, key: str, limit: int = 50, trees: int = 100, sample: int = 256, seed: int = 42, contamination: float = 0.02) -> DataFrame:
    """key, score, flagged, record: the rows that an isolation forest splits off soonest, by score (the higher the odder).

    A score is above 0, and the row flagged, if it is among the share ``contamination`` of the oddest rows; the record is
    the whole row as texts. Rows of equal scores follow by key.
    """
    scored = anomaly_scores(df, roles, key, trees, sample, seed, contamination)
    if getattr(scored, "unavailable", None):
        return scored
    top = cut(scored.orderBy(F.desc("score"), "key").limit(limit))
    texts = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in df.columns]))
    records = df.select(F.col(key).cast("string").alias("key"), texts.alias("record")).join(F.broadcast(top.select("key").distinct()), "key", "left_semi")  # at most ``limit`` keys
    one = records.groupBy("key").agg(F.min_by("record", F.to_json("record")).alias("record"))
    return top.join(one, "key").select("key", "score", "flagged", "record").orderBy(F.desc("score"), "key")


def anomaly_scores(df: DataFrame, roles: RoleMap, key: str, trees: int = 100, sample: int = 256, seed: int = 42, contamination: float = 0.02) -> DataFrame:
    """key, score, flagged: for all rows.

    Each tree is grown from its own hashed sample of at most ``sample`` rows in a task of its own; the forest (a bounded
    number of nodes) then scores all rows, and a mergeable sketch of the scores gives the one that parts the oddest off.
    A row beyond the ends of a tree's sample would, were it in the sample, be split off at the root with the chance that a
    cut falls between; its path is that much shorter, so that odd rows stand out however few of them are drawn.
    """
    spark = df.sparkSession
    x, names = df, []
    for c in roles.all("measure", "money", "age"):
        x, names = x.withColumn(f"x_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0))), [*names, f"x_{c}"]
    shares: dict[str, str] = {}
    for c in roles.all("category", "subcategory", "status", "admin_area_1", "admin_area_2"):
        shares[c] = f"x_{c}"
    x, names = frequencies(x, shares), [*names, *shares.values()]
    if times := roles.all("timestamp"):
        ts = try_ts(df, times[-1])
        x, names = x.withColumn("x_hour", F.coalesce(F.hour(ts), F.lit(12)).cast("double")).withColumn("x_dow", F.coalesce(F.weekday(ts), F.lit(3)).cast("double")), [*names, "x_hour", "x_dow"]
    if len(names) < 2:
        return unavailable(spark, ANOMALIES, "fewer than two features")
    rows = cut(x.select(F.col(key).cast("string").alias("key"), F.array(*names).alias("x")))
    n = rows.count()
    if not n:
        return unavailable(spark, ANOMALIES, "no rows")
    size = min(sample, n)
    # each row is dealt to a tree by its hash; only with few rows are there copies to deal
    wanted = trees * (2 * size + 20)
    copies = min(trees, max(1, -(-wanted // n)))
    u = F.pmod(F.xxhash64("key", "copy", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.select("key", "x", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).filter(u <= wanted / (n * copies))
    drawn = drawn.withColumn("tree", F.pmod(F.xxhash64("copy", "key", F.lit(seed)), F.lit(trees)).cast("int")).drop("copy")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + t)
        pdf = pdf.sort_values("key")
        data = np.stack(pdf["x"].to_numpy())
        data = data[rng.permutation(len(data))[:size]]
        nodes = []

        def split(part, depth):
            at = len(nodes)
            nodes.append(None)
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(data.shape[1])
            if len(part) <= 1 or depth >= math.ceil(math.log2(max(size, 2))) or not (width > 0).any():
                nodes[at] = (t, at, -1, 0.0, -1, -1, float(depth + expected_path(len(part))))
                return at
            f = int(rng.choice(np.flatnonzero(width > 0)))
            v = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] < v
            nodes[at] = (t, at, f, v, split(part[left], depth + 1), split(part[~left], depth + 1), 0.0)
            return at

        split(data, 0)
        ends = [(data.min(axis=0).tolist(), data.max(axis=0).tolist()), *[(None, None)] * (len(nodes) - 1)]  # the root's
        return pd.DataFrame([n + e for n, e in zip(nodes, ends, strict=True)], columns=["tree", "node", "f", "v", "l", "r", "path", "lo", "hi"])

    schema = "tree int, node int, f int, v double, l int, r int, path double, lo array<double>, hi array<double>"
    forest = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas()  # at most trees x 2 x sample nodes
    grown, boxes = [], []
    for _, g in forest.groupby("tree"):
        g = g.sort_values("node")
        leaf, own = (g["f"] < 0).to_numpy(), np.arange(len(g))
        # a leaf leads to itself, so that all rows take the same number of steps
        grown.append((np.where(leaf, 0, g["f"]).astype(np.int64), np.where(leaf, np.inf, g["v"]), np.where(leaf, own, g["l"]).astype(np.int64), np.where(leaf, own, g["r"]).astype(np.int64), g["path"].to_numpy()))
        boxes.append((np.array(g["lo"].iloc[0]), np.array(g["hi"].iloc[0])))
    steps = math.ceil(math.log2(max(size, 2)))
    scale = expected_path(size) or 1.0
    inner_lo, inner_hi = (f([b[i] for b in boxes], axis=0) for i, f in ((0, np.max), (1, np.min)))  # what lies within is beyond no sample

    def off_at_root(x, lo, hi):
        more = np.fmax(lo - x, 0.0) + np.fmax(x - hi, 0.0)
        width = hi - lo + more
        can = width > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(can, np.where(np.isinf(more), 1.0, more / width), 0.0)
        return share.sum(axis=1) / np.maximum(can.sum(axis=1), 1)

    def score(batches):
        for pdf in batches:
            data = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
            total, flat, first = np.zeros(len(data)), data.ravel(), np.arange(len(data)) * len(names)
            out = np.flatnonzero(((data < inner_lo) | (data > inner_hi)).any(axis=1))
            for (f, v, left, right, path), (lo, hi) in zip(grown, boxes, strict=True):
                at = np.zeros(len(data), np.int64)
                for _ in range(steps):
                    at = np.where(flat[first + f[at]] < v[at], left[at], right[at])
                total += path[at]
                if len(out):
                    total[out] += off_at_root(data[out], lo, hi) * (1.0 - path[at[out]])
            yield pd.DataFrame({"key": pdf["key"], "score": 2 ** (-total / max(len(grown), 1) / scale)})

    scored = stored(rows.mapInPandas(score, "key string, score double"), "scores")
    end = scored.agg(F.percentile_approx("score", F.lit(1.0 - contamination), F.lit(100_000))).first()[0]
    return scored.select("key", (F.col("score") - end).alias("score"), (F.col("score") > end).alias("flagged"))


def expected_path(n: int) -> float:
    """The mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def demographics(df: DataFrame, area: str) -> DataFrame | None:
    """area, population, density, urbanization, literacy from a table's columns by name; None without a population."""
    import re

    found = {k: next((c for c in df.columns if re.search(p, c.lower())), None) for k, p in DEMOGRAPHIC}
    if not found["population"]:
        return None
    cols = [(F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(k) for k, c in found.items()]
    keyed = df.select(F.col(area).cast("string").alias("area"), *cols)
    return keyed.groupBy("area").agg(*[F.max(k).alias(k) for k, _ in DEMOGRAPHIC])


def time_clusters(df: DataFrame, roles: RoleMap, min_share: float = 0.30, min_n: int = 20, top: int = 10) -> DataFrame:
    """category, area, band, n, share: the band of the day that a category has most of its cases of an area in."""
    schema = "category string, area string, band string, n long, share double"
    if not (roles.time and roles.area and roles.first("category")):
        return unavailable(df.sparkSession, schema, "needs a time, an area and a category")
    rows = df.select(F.col(roles.first("category")).alias("category"), F.col(roles.area).alias("area"), F.hour(try_ts(df, roles.time)).alias("h")).filter("h IS NOT NULL AND category IS NOT NULL AND area IS NOT NULL")
    n = rows.groupBy("category", "area", hour_band(F.col("h")).alias("band")).agg(F.count("*").alias("n"))
    pair = W.partitionBy("category", "area")
    best = n.withColumn("total", F.sum("n").over(pair)).withColumn("r", F.row_number().over(pair.orderBy(F.desc("n"), "band")))
    out = best.filter("r = 1").withColumn("share", ratio(F.col("n"), F.col("total"))).filter((F.col("total") >= min_n) & (F.col("share") >= min_share))
    return out.select("category", "area", "band", "n", F.round("share", 4).alias("share")).orderBy(F.desc("n"), "category", "area").limit(top)


def correlation(cases: DataFrame, area: str, demo: DataFrame, min_areas: int = 5) -> DataFrame:
    """factor, r, n_areas, direction: Pearson's r of cases for each 100,000 people with each demographic factor."""
    n = cases.groupBy(F.col(area).cast("string").alias("area")).agg(F.count("*").alias("n"))
    both = n.join(demo.filter("population > 0"), "area").withColumn("rate", per_lakh(F.col("n"), F.col("population")))
    long = both.select("area", "rate", F.expr("stack(3, 'density', density, 'urbanization', urbanization, 'literacy', literacy) AS (factor, x)")).filter("x IS NOT NULL")
    r = F.try_divide(F.covar_pop("rate", "x"), F.stddev_pop("rate") * F.stddev_pop("x"))
    out = long.groupBy("factor").agg(F.round(r, 4).alias("r"), F.count("*").alias("n_areas")).filter((F.col("n_areas") >= min_areas) & F.col("r").isNotNull())
    return out.withColumn("direction", F.when(F.col("r") >= 0, "positive").otherwise("negative")).orderBy(F.abs("r").desc(), "factor")


def scatter(cases: DataFrame, area: str, demo: DataFrame) -> DataFrame:
    """The points behind ``correlation``: area, rate and the factors."""
    n = cases.groupBy(F.col(area).cast("string").alias("area")).agg(F.count("*").alias("n"))
    return n.join(demo.filter("population > 0"), "area").select("area", F.round(per_lakh(F.col("n"), F.col("population")), 2).alias("rate"), "density", "urbanization", "literacy")


def emerging(daily: DataFrame, category: str = "category", weeks: int = 8, min_per_week: float = 1.0, top: int = 5) -> DataFrame:
    """category, slope, mean_per_week, growth_pct: categories whose weekly counts rise; weeks end on Sundays."""
    last = F.broadcast(daily.agg(F.max("day").alias("hi")).withColumn("lo", F.date_sub("hi", weeks * 7)))
    first = F.date_add("lo", F.lit(6) - F.weekday("lo"))
    ends = last.select(F.explode(F.sequence(first, F.col("hi"), F.expr("interval 7 days"))).alias("week"), "lo").withColumn("i", F.row_number().over(W.orderBy(F.desc("week"))))
    ends = ends.filter(F.col("i") <= weeks).select("week", "lo", (F.lit(-1) * F.col("i")).alias("x"))
    named = daily.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("category"), F.date_add("day", F.lit(6) - F.weekday("day")).alias("week"), "day").agg(F.sum("n").alias("n"))
    in_window = named.join(F.broadcast(ends.select("week", "lo")), "week").filter("day >= lo").groupBy("category", "week").agg(F.sum("n").alias("n"))
    grid = named.select("category").distinct().crossJoin(F.broadcast(ends.select("week", "x")))
    filled = grid.join(in_window, ["category", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s = filled.groupBy("category").agg(F.regr_slope("n", "x").alias("slope"), F.avg("n").alias("mean"), F.count("*").alias("k"))
    s = s.filter((F.col("slope") > 0) & (F.col("mean") >= min_per_week))
    out = s.select("category", F.round("slope", 3).alias("slope"), F.round("mean", 2).alias("mean_per_week"), F.round(F.col("slope") * F.col("k") / F.greatest("mean", F.lit(1.0)) * 100, 1).alias("growth_pct"))
    return out.orderBy(F.desc("slope"), "category").limit(top)


def mo_signatures(df: DataFrame, roles: RoleMap, key: str, min_cases: int = 8, min_areas: int = 2, top: int = 6) -> DataFrame:
    """subtype, band, n, n_areas, areas (4), ids (3): methods that recur in several areas."""
    kind = roles.first("subcategory") or roles.first("category")
    if not (roles.time and roles.area and kind):
        return unavailable(df.sparkSession, "subtype string, band string, n long, n_areas long, areas array<string>, ids array<string>", "needs a time, an area and a category")
    rows = df.select(F.col(kind).cast("string").alias("subtype"), F.col(roles.area).cast("string").alias("area"), F.hour(try_ts(df, roles.time)).alias("h"), F.col(key).alias("id"))
    rows = rows.filter("h IS NOT NULL AND subtype IS NOT NULL AND area IS NOT NULL").withColumn("band", hour_band(F.col("h")))
    groups = ["subtype", "band"]
    n = rows.groupBy(*groups, "area").agg(F.count("*").alias("n")).groupBy(*groups).agg(F.sum("n").alias("n"), F.count("*").alias("n_areas"), F.slice(F.sort_array(F.collect_list("area")), 1, 4).alias("areas"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(*groups).orderBy("id"))).filter("r <= 3")  # cut off before the shuffle
    out = n.join(first.groupBy(*groups).agg(F.sort_array(F.collect_list("id")).alias("ids")), groups)
    out = out.filter((F.col("n") >= min_cases) & (F.col("n_areas") >= min_areas)).orderBy(F.desc("n"), "subtype", "band").limit(top).select(*groups, "n", "n_areas", "areas", "ids")
    return out.withColumn("ids", F.transform("ids", lambda i: i.cast("string")))


def min_max(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with each column scaled to [0, 1] under a new name; a constant column and nulls give 0."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(ends))
    for c, out in columns.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        wide = wide.withColumn(out, F.coalesce(ratio(F.col(c) - lo, hi - lo), F.lit(0.0)))
    return wide.drop(*ends.columns)


def risk_score(df: DataFrame, exposed: bool) -> DataFrame:
    """score from vol, slope, z (negative: 0) and, if wanted, exposure: weighted sums of their min-max values."""
    df = df.withColumn("__z", F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(0.0)))
    parts = {"vol": "__a", "slope": "__b", "__z": "__c"} | ({"exposure": "__d"} if exposed else {})
    df = min_max(df, parts)
    total = F.lit(0.0)
    for w, c in zip(RISK_EXPOSED if exposed else RISK_PLAIN, parts.values(), strict=True):
        total = total + w * F.col(c)
    return df.withColumn("score", total).drop("__z", *parts.values())


def area_risk(daily: DataFrame, horizon_days: int = 7, demo: DataFrame | None = None) -> DataFrame:
    """Areas by a risk score of recent volume, trend and deviation; daily: area, day, n (absent days become zeros)."""
    daily = daily.filter("area IS NOT NULL").groupBy("area", "day").agg(F.sum("n").alias("n"))
    # days without a case count as zeros: they are in the numbers of days, and add nothing to the sums
    span = daily.groupBy("area").agg(F.max("day").alias("hi"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("double").alias("days"))
    back = F.datediff("hi", "day") + 1
    some = daily.join(small_or_not(cut(span), MOST_AREAS), "area").filter("days >= 14").withColumn("back", back)
    on = lambda c, v=F.col("n"): F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("double")
    recent, base = F.col("back") <= 28, F.col("back") > 28
    s = some.groupBy("area").agg(
        F.first("days").alias("days"), on(recent).alias("y"), on(recent, -F.col("back") * F.col("n")).alias("xy"), on(F.col("back") <= 7).alias("week"),
        on(base).alias("old"), on(base, F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("total"),
    )
    m, nb = F.least("days", F.lit(28.0)), F.greatest(F.col("days") - 28, F.lit(0.0))
    x, xx = -m * (m + 1) / 2, m * (m + 1) * (2 * m + 1) / 6  # sums of -1 to -m and of their squares
    s = s.withColumn("nb", nb).withColumn("vol", F.col("y") / m).withColumn("slope", ratio(m * F.col("xy") - x * F.col("y"), m * xx - x * x))
    s = s.withColumns({"w": F.col("week") / 7, "b": ratio(F.col("old"), nb), "sd": F.sqrt(F.greatest(ratio(nb * F.col("squares") - F.col("old") * F.col("old"), nb * (nb - 1)), F.lit(0.0)))})
    s = s.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    z = F.when(F.col("nb") > 30, (F.col("w") - F.col("b")) / F.greatest("sd", F.lit(0.5))).otherwise(0.0)
    s = s.select("area", F.round("vol", 2).alias("vol"), F.round("slope", 4).alias("slope"), F.round(z, 2).alias("z"), F.round(F.greatest(F.col("vol") + F.col("slope") * horizon_days / 2, F.lit(0.0)), 2).alias("forecast_daily"), "total")
    exposed = False
    if demo is not None:
        s = s.join(demo, "area", "left").withColumn("per_lakh", F.round(per_lakh(F.col("total"), F.col("population")), 2))
        s = min_max(cut(s), {"density": "__den", "urbanization": "__urb"})  # a row an area, read several times
        s = s.withColumn("exposure", 0.6 * F.col("__den") + 0.4 * F.col("__urb")).drop("__den", "__urb")
        covered = s.agg(F.count("population").alias("c"), F.count("*").alias("n")).first()
        exposed = covered.c >= max(covered.n // 2, 1)
    else:
        s = s.withColumn("per_lakh", F.lit(None).cast("double"))
    out = risk_score(cut(s), exposed).withColumn("risk_score", F.round(F.col("score") * 100, 1))
    return out.select("area", "risk_score", F.col("vol").alias("recent_daily"), F.col("slope").alias("trend_slope"), F.col("z").alias("z_score"), "forecast_daily", "per_lakh").orderBy(F.desc("risk_score"), "area")


def capture_at_k(daily: DataFrame, window_days: int = 7, max_folds: int = 3, min_history: int = 90) -> DataFrame:
    """capture_rate, k, folds, n_areas: the share of a window's cases in the areas that led the 28 days before it."""
    schema = "capture_rate double, k int, folds int, n_areas int"
    ends = daily.agg(F.max("day").alias("hi"), F.min("day").alias("lo"), F.countDistinct("area").alias("n")).first()
    if ends.hi is None or (ends.hi - ends.lo).days < min_history or ends.n < 5:
        return unavailable(daily.sparkSession, schema, "insufficient history")
    k = max(3, math.ceil(0.2 * ends.n))
    folds = F.explode(F.sequence(F.lit(1), F.lit(max_folds))).alias("fold")
    first = ends.hi - timedelta(days=window_days * max_folds + 28)  # no fold looks further back
    rows = daily.filter(F.col("area").isNotNull() & (F.col("day") > F.lit(first))).select("area", "day", "n", folds).withColumn("at", F.date_sub(F.lit(ends.hi), F.col("fold") * window_days))
    past = (F.col("day") <= F.col("at")) & (F.col("day") > F.date_sub("at", 28))
    future = (F.col("day") > F.col("at")) & (F.col("day") <= F.date_add("at", window_days))
    areas = rows.groupBy("fold", "area").agg(F.sum(F.when(past, F.col("n"))).alias("past"), F.coalesce(F.sum(F.when(future, F.col("n"))), F.lit(0)).alias("future"))
    areas = areas.withColumn("r", F.row_number().over(W.partitionBy("fold").orderBy(F.desc_nulls_last("past"), "area")))
    hit = areas.groupBy("fold").agg(F.sum(F.when((F.col("r") <= k) & F.col("past").isNotNull(), F.col("future")).otherwise(0)).alias("hit"), F.sum("future").alias("all")).filter("all > 0")
    return hit.agg(F.round(F.avg(ratio(F.col("hit"), F.col("all"))), 3).alias("capture_rate"), F.lit(k).alias("k"), F.count("*").cast("int").alias("folds"), F.lit(int(ends.n)).alias("n_areas"))
