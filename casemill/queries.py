"""Registered queries: the operators applied to the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import bindings as B
from casemill.bindings import CASE_ROLES, CASES_SQL, DEMO_SQL, EVENT_ROLES, EVENTS_SQL, cases, events
from casemill.operators import periods, query, signals
from casemill.operators.query import Kpi, Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@register(f"""WITH {CASES_SQL}
SELECT date_trunc('week', ts)::TIMESTAMP AS period, area, count(*) AS count, round(sum(money), 2) AS sum_money FROM cases GROUP BY ALL""")
def q1_weekly_by_area(spark, sf_dir):
    """Q1, Q2: weekly counts and sums by area."""
    out = query.run(cases(spark, sf_dir), Query(["area"], "ts", "week", [("count", None), ("sum", "money")], limit=query.MOST_ROWS))
    return out.withColumn("sum_money", F.round("sum_money", 2))


@register(f"""WITH {EVENTS_SQL}
SELECT hour(ts)::INT AS hour_ts, dayofweek(ts)::INT AS dayofweek_ts, category, count(*) AS count, round(avg(value), 6) AS avg_value FROM ev GROUP BY ALL""")
def q3_date_parts(spark, sf_dir):
    """Q3: hour and day of the week as dimensions."""
    out = query.run(events(spark, sf_dir), Query(["hour(ts)", "dayofweek(ts)", "category"], measures=[("count", None), ("avg", "value")]))
    return out.withColumn("avg_value", F.round("avg_value", 6))


GRAINS_SQL = " UNION ALL ".join(f"SELECT '{g}' AS grain, date_trunc('{g}', ts)::TIMESTAMP AS period, count(*) AS count, count(DISTINCT area) AS distinct_area FROM ev GROUP BY ALL" for g in query.GRAINS)


@register(f"WITH {EVENTS_SQL} {GRAINS_SQL}")
def q2_grains(spark, sf_dir):
    """Q2: events by hour, day, week, month and year."""
    out = None
    for g in query.GRAINS:
        own = query.run(events(spark, sf_dir), Query([], "ts", g, [("count", None), ("distinct", "area")])).select(F.lit(g).alias("grain"), "period", "count", "distinct_area")
        out = own if out is None else out.unionByName(own)
    return out


@register(f"WITH {CASES_SQL} SELECT date_trunc('week', ts)::TIMESTAMP AS period, count(*) AS count FROM cases GROUP BY ALL")
def q9_series(spark, sf_dir):
    """Q9: a weekly series."""
    return query.chart(cases(spark, sf_dir), "ts", "timeseries")


@register(f"""WITH {CASES_SQL}
SELECT category, count(money) AS count_money, round(sum(money), 2) AS sum_money, round(avg(money), 4) AS avg_money, min(money) AS min_money, max(money) AS max_money,
       count(DISTINCT area) AS distinct_area FROM cases GROUP BY ALL""")
def q4_measures(spark, sf_dir):
    """Q4: all measures."""
    q = Query(["category"], measures=[("count", "money"), ("sum", "money"), ("avg", "money"), ("min", "money"), ("max", "money"), ("distinct", "area")])
    return query.run(cases(spark, sf_dir), q).withColumns({"sum_money": F.round("sum_money", 2), "avg_money": F.round("avg_money", 4)})


@register(f"""WITH {CASES_SQL}
SELECT area, count(*) AS count FROM cases WHERE status = 'F' AND category IN ('1-URGENT', '2-HIGH') AND money BETWEEN 1000 AND 200000
GROUP BY ALL ORDER BY count DESC, area LIMIT 10""")
def q5_filters_and_top(spark, sf_dir):
    """Q5, Q6: scalar, list and range filters; descending order and limit."""
    q = Query(["area"], filters={"status": "F", "category": ["1-URGENT", "2-HIGH"], "money": {"from": 1000, "to": 200000}}, order_by="count", limit=10)
    return query.run(cases(spark, sf_dir), q)


@register(f"""WITH {CASES_SQL}
SELECT case_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, area, category, status, money, lat, lng FROM cases WHERE status = 'P' ORDER BY case_id LIMIT 500""")
def q7_records(spark, sf_dir):
    """Q7: raw records, timestamps as text."""
    return query.records(cases(spark, sf_dir), {"status": "P"}, order=["case_id"])


@register(f"""WITH {CASES_SQL}
SELECT 'total' AS id, count(*)::DOUBLE AS value FROM cases WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'
UNION ALL SELECT 'areas', count(DISTINCT area) FROM cases WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'
UNION ALL SELECT 'pending', count(*) FROM cases WHERE status IN ('O', 'P') AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'
UNION ALL SELECT 'value', round(sum(money), 2) FROM cases WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'""")
def q8_kpis(spark, sf_dir):
    """Q8: key figures in one pass."""
    span = {"ts": {"from": datetime(1996, 1, 1), "to": datetime(1997, 12, 31)}}
    specs = [Kpi("total"), Kpi("areas", "distinct", "area"), Kpi("pending", filters={"status": ["O", "P"]}), Kpi("value", "sum", "money")]
    return query.kpis(cases(spark, sf_dir), specs, span).withColumn("value", F.round("value", 2))


@register(f"WITH {CASES_SQL} SELECT area, count(*) AS count FROM cases GROUP BY ALL ORDER BY count DESC, area LIMIT 12")
def q9_chart(spark, sf_dir):
    """Q9: the largest bars."""
    return query.chart(cases(spark, sf_dir), "area")


@register(f"""WITH {EVENTS_SQL}, v AS (SELECT area, count(*) AS value FROM ev GROUP BY ALL)
SELECT v.area, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, any_value(v.value)::DOUBLE AS value, round(any_value(v.value) / greatest((SELECT max(value) FROM v), 0.001), 6) AS weight
FROM v JOIN ev ON v.area = ev.area GROUP BY v.area""")
def q10_centroids(spark, sf_dir):
    """Q10: weighted area centroids."""
    e = events(spark, sf_dir)
    out = query.centroids(e, EVENT_ROLES, e.groupBy("area").agg(F.count("*").alias("n")), "n")
    return out.withColumns({c: F.round(c, 6) for c in ("lat", "lng", "weight")})


DAILY_SQL = f"{CASES_SQL}, daily AS (SELECT area, category, ts::DATE AS day, count(*) AS n FROM cases WHERE ts IS NOT NULL GROUP BY ALL)"


def daily(spark, sf_dir, **groups):
    return signals.daily_counts(cases(spark, sf_dir), "ts", groups or {"area": "area", "category": "category"})


@register(f"""WITH {EVENTS_SQL}, g AS (SELECT 2 / 110.574 AS dlat, 2 / (111.320 * greatest(cos(radians(avg(lat))), 0.2)) AS dlng FROM ev),
cells AS (SELECT round(lat / dlat) AS i, round(lng / dlng) AS j, count(*) AS n FROM ev, g GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, i, j LIMIT 2000)
SELECT round(i * dlat, 5) AS lat, round(j * dlng, 5) AS lng, n, round(least(n / (SELECT quantile_cont(n, 0.95) FROM cells), 1), 4) AS intensity FROM cells, g""")
def a1_grid_hotspots(spark, sf_dir):
    """A1: grid cells by count."""
    return signals.grid_hotspots(events(spark, sf_dir), EVENT_ROLES)


@register(f"WITH {DAILY_SQL} SELECT area, category, day, n FROM daily")
def a2_daily_counts(spark, sf_dir):
    """A2: daily counts by area and category."""
    return daily(spark, sf_dir)


@register(f"""WITH {DAILY_SQL}, s AS (
  SELECT area, category, avg(n) FILTER (day < hi - 28) AS mu, stddev_samp(n) FILTER (day < hi - 28) AS sd, count(*) FILTER (day < hi - 28) AS days, avg(n) FILTER (day >= hi - 28) AS now
  FROM daily, (SELECT max(day) AS hi FROM daily) GROUP BY ALL)
SELECT area, category, round(mu, 2) AS baseline_daily, round(now, 2) AS recent_daily, round((now - mu) * 100 / mu, 1) AS pct_change, round((now - mu) / greatest(coalesce(sd, 0), 0.5), 2) AS z_score
FROM s WHERE days >= 30 AND now IS NOT NULL AND (now - mu) / greatest(coalesce(sd, 0), 0.5) >= -1 ORDER BY z_score DESC, area, category LIMIT 50""")
def a3_spikes(spark, sf_dir):
    """A3: recent means against baselines (a low threshold, as the data has no spikes)."""
    return signals.spike_alerts(daily(spark, sf_dir), ["area", "category"], z_threshold=-1.0)


SPIKED_SQL = f"""{EVENTS_SQL}, e AS (SELECT max(ts::DATE) AS last FROM ev), sp AS (SELECT ev.* FROM ev UNION ALL SELECT ev.* FROM ev, e, range(0, 6) t(i) WHERE area = 'A3' AND category = 'click' AND ts::DATE >= last - 7),
daily AS (SELECT area, category, ts::DATE AS day, count(*) AS n FROM sp GROUP BY ALL)"""


@register(f"""WITH {SPIKED_SQL}, s AS (
  SELECT area, category, avg(n) FILTER (day < hi - 7) AS mu, stddev_samp(n) FILTER (day < hi - 7) AS sd, count(*) FILTER (day < hi - 7) AS days, avg(n) FILTER (day >= hi - 7) AS now
  FROM daily, (SELECT max(day) AS hi FROM daily) GROUP BY ALL)
SELECT area, category, round(mu, 2) AS baseline_daily, round(now, 2) AS recent_daily, round((now - mu) * 100 / mu, 1) AS pct_change, round((now - mu) / greatest(coalesce(sd, 0), 0.5), 2) AS z_score
FROM s WHERE days >= 5 AND now IS NOT NULL AND (now - mu) / greatest(coalesce(sd, 0), 0.5) >= 2.5 ORDER BY z_score DESC, area, category LIMIT 50""")
def a3_planted_spike(spark, sf_dir):
    """A3: clicks of one area come seven times over in the last week; the default threshold finds what is a spike."""
    e = events(spark, sf_dir)
    last = F.broadcast(e.agg(F.max(F.col("ts").cast("date")).alias("last")))
    more = e.filter("area = 'A3' AND category = 'click'").crossJoin(last).filter(F.col("ts").cast("date") >= F.date_sub("last", 7)).drop("last")
    spiked = e.unionByName(more.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(6)))).drop("i"))
    return signals.spike_alerts(signals.daily_counts(spiked, "ts", {"area": "area", "category": "category"}), ["area", "category"], window_days=7, least_days=5)


@register()
def a4_anomalies(spark, sf_dir):
    """A4: isolation forest over all cases."""
    return signals.anomalies(cases(spark, sf_dir), CASE_ROLES, "case_id").withColumn("record", F.to_json("record"))


@register(f"""WITH {CASES_SQL}, p AS (SELECT min(case_id) AS k, area FROM cases GROUP BY area)
SELECT CAST(-1 - k AS VARCHAR) AS key, true AS flagged, 'far from ' || area AS area FROM p""")
def a4_planted(spark, sf_dir):
    """A4: a planted case for each area, of an amount, a place and a kind that no other has, comes before all others."""
    c = cases(spark, sf_dir)
    first = c.groupBy("area").agg(F.min_by(F.struct(*c.columns), "case_id").alias("r")).select("r.*")
    odd = first.withColumns({"case_id": -1 - F.col("case_id"), "area": F.concat(F.lit("far from "), "area"), "category": F.lit("odd"), "money": F.lit(1e9)})
    n = odd.count()
    found = signals.anomalies(c.unionByName(odd), CASE_ROLES, "case_id", limit=n)
    return found.select("key", "flagged", F.col("record")["area"].alias("area"))


@register(f"WITH {DEMO_SQL} SELECT area, population, density, urbanization, CAST(NULL AS DOUBLE) AS literacy FROM demo")
def a5_demographics(spark, sf_dir):
    """A5: demographic columns by name."""
    return signals.demographics(B.demographics(spark, sf_dir), "area")


BAND = "CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 'Night' WHEN hour(ts) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'Afternoon' ELSE 'Evening' END"


@register(f"""WITH {EVENTS_SQL}, n AS (SELECT category, area, {BAND} AS band, count(*) AS n FROM ev GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY category, area) AS total, row_number() OVER (PARTITION BY category, area ORDER BY n DESC, band) AS r FROM n)
SELECT category, area, band, n, round(n / total::DOUBLE, 4) AS share FROM t WHERE r = 1 AND total >= 20 AND n / total::DOUBLE >= 0.2 ORDER BY n DESC, category, area LIMIT 10""")
def a7_time_clusters(spark, sf_dir):
    """Dominant bands of the day."""
    return signals.time_clusters(events(spark, sf_dir), EVENT_ROLES, min_share=0.2)


@register(f"""WITH {CASES_SQL}, {DEMO_SQL}, b AS (
  SELECT n * 100000.0::DOUBLE / population AS rate, density, urbanization FROM (SELECT area, count(*) AS n FROM cases GROUP BY ALL) c JOIN demo USING (area) WHERE population > 0),
l AS (SELECT rate, 'density' AS factor, density AS x FROM b UNION ALL SELECT rate, 'urbanization', urbanization FROM b)
SELECT factor, round(covar_pop(rate, x) / (stddev_pop(rate) * stddev_pop(x)), 4) AS r, count(*) AS n_areas,
       CASE WHEN round(covar_pop(rate, x) / (stddev_pop(rate) * stddev_pop(x)), 4) >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM l WHERE x IS NOT NULL GROUP BY factor HAVING count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(rate) > 0""")
def a8_correlation(spark, sf_dir):
    """Correlation with demographic factors."""
    demo = signals.demographics(B.demographics(spark, sf_dir), "area")
    return signals.correlation(cases(spark, sf_dir), "area", demo)


@register(f"""WITH {CASES_SQL}, {DEMO_SQL}
SELECT area, round(n * 100000.0::DOUBLE / population, 2) AS rate, density, urbanization, CAST(NULL AS DOUBLE) AS literacy FROM (SELECT area, count(*) AS n FROM cases GROUP BY ALL) c JOIN demo USING (area) WHERE population > 0""")
def a8_scatter(spark, sf_dir):
    """The points behind the correlation."""
    return signals.scatter(cases(spark, sf_dir), "area", signals.demographics(B.demographics(spark, sf_dir), "area"))


@register(f"""WITH {DAILY_SQL}, w AS (SELECT category, day, day + (7 - isodow(day))::INT AS week, n FROM daily), e AS (SELECT max(day) AS hi, max(day) - 56 AS lo FROM daily),
s AS (SELECT week, lo, -row_number() OVER (ORDER BY week DESC) AS x FROM (SELECT unnest(generate_series(lo + (7 - isodow(lo))::INT, hi, INTERVAL 7 DAY))::DATE AS week, lo FROM e) QUALIFY x >= -8),
f AS (SELECT c.category, s.week, x, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT category FROM daily) c CROSS JOIN s LEFT JOIN w ON w.category = c.category AND w.week = s.week AND w.day >= s.lo GROUP BY ALL),
r AS (SELECT category, regr_slope(n, x) AS slope, avg(n) AS mean, count(*) AS k FROM f GROUP BY ALL)
SELECT category, round(slope, 3) AS slope, round(mean, 2) AS mean_per_week, round(slope * k / greatest(mean, 1) * 100, 1) AS growth_pct FROM r WHERE slope > 0 AND mean >= 1 ORDER BY slope DESC, category LIMIT 5""")
def a9_emerging(spark, sf_dir):
    """Categories that rise from week to week."""
    return signals.emerging(daily(spark, sf_dir))


@register(f"""WITH {EVENTS_SQL}
SELECT category AS subtype, {BAND} AS band, count(*) AS n, count(DISTINCT area) AS n_areas, list_sort(list(DISTINCT area))[1:4] AS areas,
       list_transform(list_sort(list(event_id))[1:3], lambda x: CAST(x AS VARCHAR)) AS ids
FROM ev GROUP BY ALL HAVING count(*) >= 8 AND count(DISTINCT area) >= 2 ORDER BY n DESC, subtype, band LIMIT 6""")
def a10_mo_signatures(spark, sf_dir):
    """A10: methods that recur in several areas."""
    return signals.mo_signatures(events(spark, sf_dir), EVENT_ROLES, "event_id")


@register(f"""WITH {CASES_SQL}, a AS (SELECT area, count(*)::DOUBLE AS n FROM cases GROUP BY ALL)
SELECT area, n, round((n - (SELECT min(n) FROM a)) / nullif((SELECT max(n) - min(n) FROM a), 0), 6) AS scaled FROM a""")
def a11_min_max(spark, sf_dir):
    """Min-max scaling."""
    n = cases(spark, sf_dir).groupBy("area").agg(F.count("*").cast("double").alias("n"))
    return signals.min_max(n, {"n": "scaled"}).withColumn("scaled", F.round("scaled", 6))


RISK_SQL = f"""{DAILY_SQL}, {DEMO_SQL}, d AS (SELECT area, day, sum(n) AS n FROM daily WHERE area IS NOT NULL GROUP BY ALL),
span AS (SELECT area, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY area),
f AS (SELECT area, day, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY area ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY area) AS days FROM span LEFT JOIN d USING (area, day)),
s0 AS (SELECT area, avg(n) FILTER (back <= 28) AS vol, coalesce(regr_slope(n, -back) FILTER (back <= 28), 0) AS slope, avg(n) FILTER (back <= 7) AS w, avg(n) FILTER (back > 28) AS b,
       stddev_samp(n) FILTER (back > 28) AS sd, count(*) FILTER (back > 28) AS nb, sum(n) AS total FROM f WHERE days >= 14 GROUP BY area),
s AS (SELECT area, round(vol, 2) AS vol, round(slope, 4) AS slope, round(CASE WHEN nb > 30 THEN (w - b) / greatest(sd, 0.5) ELSE 0 END, 2) AS z, round(greatest(vol + slope * 7 / 2.0, 0), 2) AS fc, total FROM s0)"""


@register(f"""WITH {RISK_SQL}, j AS (SELECT s.*, round(total * 100000.0::DOUBLE / population, 2) AS per_lakh, density, urbanization FROM s LEFT JOIN demo USING (area)),
e AS (SELECT *, 0.6 * coalesce((density - min(density) OVER ()) / nullif(max(density) OVER () - min(density) OVER (), 0), 0) + 0.4 * coalesce((urbanization - min(urbanization) OVER ()) / nullif(max(urbanization) OVER () - min(urbanization) OVER (), 0), 0) AS x, greatest(z, 0) AS zp FROM j),
r AS (SELECT *, 0.40 * coalesce((vol - min(vol) OVER ()) / nullif(max(vol) OVER () - min(vol) OVER (), 0), 0) + 0.25 * coalesce((slope - min(slope) OVER ()) / nullif(max(slope) OVER () - min(slope) OVER (), 0), 0)
  + 0.15 * coalesce((zp - min(zp) OVER ()) / nullif(max(zp) OVER () - min(zp) OVER (), 0), 0) + 0.20 * coalesce((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0) AS score FROM e)
SELECT area, round(score * 100, 1) AS risk_score, vol AS recent_daily, slope AS trend_slope, z AS z_score, fc AS forecast_daily, per_lakh FROM r""")
def a13_area_risk(spark, sf_dir):
    """Risk of areas, with demographic exposure."""
    demo = signals.demographics(B.demographics(spark, sf_dir), "area")
    return signals.area_risk(daily(spark, sf_dir, area="area"), demo=demo)


@register(f"SELECT * FROM ({ORACLE_SQL['a13_area_risk']}) ORDER BY coalesce(per_lakh, 0) DESC, area LIMIT 8")
def q11_per_capita(spark, sf_dir):
    """Q11: areas by rate for each 100,000 people."""
    return query.per_capita_ranking(a13_area_risk(spark, sf_dir))


@register(f"""WITH {DAILY_SQL}, e AS (SELECT max(day) AS hi FROM daily), k AS (SELECT greatest(3, ceil(0.2 * count(DISTINCT area)))::INT AS k, count(DISTINCT area)::INT AS n_areas FROM daily),
f AS (SELECT fold, area, sum(n) FILTER (day <= hi - 7 * fold AND day > hi - 7 * fold - 28) AS past, coalesce(sum(n) FILTER (day > hi - 7 * fold AND day <= hi - 7 * fold + 7), 0) AS future
  FROM daily, e, (SELECT unnest([1, 2, 3]) AS fold) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY past DESC NULLS LAST, area) AS r FROM f),
h AS (SELECT fold, coalesce(sum(future) FILTER (r <= k AND past IS NOT NULL), 0) AS hit, sum(future) AS total FROM r, k GROUP BY fold HAVING sum(future) > 0)
SELECT round(avg(hit / total::DOUBLE), 3) AS capture_rate, any_value(k) AS k, count(*)::INT AS folds, any_value(n_areas) AS n_areas FROM h, k""")
def f13_capture_at_k(spark, sf_dir):
    """back-test of the areas that lead."""
    return signals.capture_at_k(daily(spark, sf_dir, area="area"))


WINDOW = ("1997-03-01", "1997-06-09")
WIN_SQL = "ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1997-06-09'"
PREV_SQL = "ts >= TIMESTAMP '1996-11-21' AND ts < TIMESTAMP '1997-03-01'"


@register(f"""WITH {CASES_SQL}, c AS (SELECT count(*) FILTER ({WIN_SQL}) AS current, count(*) FILTER ({PREV_SQL}) AS previous FROM cases)
SELECT current, previous, current - previous AS change, round((current - previous) * 100.0::DOUBLE / nullif(previous, 0), 1) AS percent_change, previous > 0 AS available,
       sha256('1997-03-01T00:00:00|1997-06-09T00:00:00|||v1') AS evidence FROM c""")
def t1_compare(spark, sf_dir):
    """A window against the one before."""
    return periods.compare(cases(spark, sf_dir), CASE_ROLES, periods.Window(*WINDOW), "v1")


@register(f"""WITH {CASES_SQL}
SELECT coalesce(area, 'None') AS key, count(*) FILTER ({WIN_SQL}) AS current, count(*) FILTER ({PREV_SQL}) AS previous, count(*) FILTER ({WIN_SQL}) - count(*) FILTER ({PREV_SQL}) AS change
FROM cases WHERE {WIN_SQL} OR {PREV_SQL} GROUP BY ALL ORDER BY change DESC, key LIMIT 100""")
def t2_deltas(spark, sf_dir):
    """Changes by area."""
    return periods.deltas(cases(spark, sf_dir), CASE_ROLES, periods.Window(*WINDOW), "area")


FRAMES_SQL = "fr AS (SELECT i::INT AS frame, TIMESTAMP '1997-03-01' + i * INTERVAL 15 DAY AS start, least(TIMESTAMP '1997-03-01' + (i + 1) * INTERVAL 15 DAY, TIMESTAMP '1997-06-09') AS \"end\" FROM range(0, 7) t(i))"


@register(f"""WITH {CASES_SQL}, {FRAMES_SQL} SELECT frame, start, "end", count(case_id) AS n FROM fr LEFT JOIN cases ON ts >= start AND ts < "end" GROUP BY ALL""")
def t3_frames(spark, sf_dir):
    """Counts of frames."""
    return periods.frames(cases(spark, sf_dir), CASE_ROLES, periods.Window(*WINDOW), 15)


@register(f"""WITH {EVENTS_SQL}, x AS (SELECT min(ts)::DATE + INTERVAL 12 HOUR AS lo FROM ev), fr AS (SELECT i::INT AS frame, lo + i * INTERVAL 4 DAY AS start, least(lo + (i + 1) * INTERVAL 4 DAY, lo + INTERVAL 18 DAY) AS "end" FROM x, range(0, 5) t(i))
SELECT frame, start::TIMESTAMP AS start, "end"::TIMESTAMP AS "end", count(event_id) AS n FROM fr LEFT JOIN ev ON ts >= start AND ts < "end" GROUP BY ALL""")
def t3_frames_from_noon(spark, sf_dir):
    """Frames that begin at noon, over events of all hours."""
    e = events(spark, sf_dir)
    lo = e.agg(F.min("ts").cast("date").alias("d")).first().d
    start = datetime(lo.year, lo.month, lo.day, 12)
    w = periods.Window(start.isoformat(), (start + timedelta(days=18)).isoformat())
    return periods.frames(e, EVENT_ROLES, w, 4)


@register(f"""WITH {CASES_SQL}, {FRAMES_SQL}, p AS (
  SELECT frame, round(lat, 2) AS lat, round(lng, 2) AS lng, count(*) FILTER (ts >= start) AS n, count(*) FILTER (ts < start) AS p FROM fr JOIN cases ON ts >= start - ("end" - start) AND ts < "end" GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, lat, lng) AS r, row_number() OVER (PARTITION BY frame ORDER BY p DESC, lat, lng) AS rp FROM p),
o AS (SELECT frame, lat, lng, n, CASE WHEN rp <= 500 THEN p ELSE 0 END AS previous FROM r WHERE n > 0 AND r <= 500)
SELECT *, CASE WHEN previous = 0 THEN 'emerging' WHEN n < previous THEN 'declining' ELSE 'persistent' END AS kind FROM o""")
def t4_frame_cells(spark, sf_dir):
    """T4: emerging, declining and persistent cells of frames."""
    return periods.frame_cells(cases(spark, sf_dir), CASE_ROLES, periods.Window(*WINDOW), 15)
