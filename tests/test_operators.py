"""Planted patterns and literal cases for the operators."""

import json
import random
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casemill.functions.expressions import hour_band, status_label
from casemill.functions.roles import RoleMap
from casemill.operators import cleaning, findings, graph, merge, periods, profile, query, reports, signals, triage
from casemill.operators.query import Query
from casemill.plans import lineage
from casemill.sources import tables
from casemill.streaming import sentinel

ROLES = RoleMap({"id": "id", "ts": "timestamp", "area": "admin_area_1", "cat": "category"})


def test_time_concentration(spark):
    rows = [("2024-01-01 02:30:00", "AreaA", "Theft", f"a{i}") for i in range(30)] + [("2024-01-01 08:00:00", "AreaA", "Theft", f"b{i}") for i in range(3)]
    rows += [("2024-01-02 20:00:00", "AreaB", "Robbery", f"c{i}") for i in range(25)] + [(None, "AreaB", "Robbery", "x"), ("no time", "AreaB", "Robbery", "y")]
    df = spark.createDataFrame(rows, "ts string, area string, cat string, id string")
    out = {(r.category, r.area): r for r in signals.time_clusters(df, ROLES, 0.5, 5).collect()}
    assert out["Theft", "AreaA"].band == "Night" and out["Theft", "AreaA"].share >= 0.5 and out["Robbery", "AreaB"].n == 25
    assert signals.time_clusters(df, RoleMap({"ts": "timestamp"})).unavailable


def test_bands_and_status(spark):
    got = spark.createDataFrame([(h,) for h in (0, 5, 6, 11, 12, 17, 18, 23, None)], "h int").select(hour_band(F.col("h"))).collect()
    assert [r[0] for r in got] == ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Evening"]
    texts = ["Charge Sheeted", "Closed - undetected", "Under Investigation", "charge pending", "odd", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(status_label(F.col("s"))).collect()
    assert [r[0] for r in got] == ["detected", "undetected", "open", "detected", None, None]


def test_correlation_and_constant_factors(spark):
    urban = {f"A{i}": u for i, u in enumerate((20, 40, 60, 80, 90))}
    events = spark.createDataFrame([(a, f"{a}{i}") for a, u in urban.items() for i in range(u * 10)], "area string, id string")
    demo = signals.demographics(spark.createDataFrame([(a, 60_000, float(u), 1.0) for a, u in urban.items()], "area string, population long, urbanization_pct double, density double"), "area")
    out = signals.correlation(events, "area", demo, 3).collect()
    assert [(r.factor, r.direction) for r in out] == [("urbanization", "positive")] and out[0].r > 0.99
    points = signals.scatter(events, "area", demo).collect()
    assert len(points) == 5 and all(p.literacy is None for p in points)
    assert signals.demographics(events, "area") is None


def weekly(spark):
    start = datetime(2024, 1, 7).date()
    rows = []
    for w in range(8):
        for cat, n in (("Cybercrime", 1 + 3 * w), ("Robbery", 5), ("Theft", max(0, 10 - 2 * w))):
            if n:
                rows.append((cat, start + timedelta(days=7 * w), n))
    return spark.createDataFrame(rows, "category string, day date, n long")


def test_emerging_category(spark):
    out = signals.emerging(weekly(spark), min_per_week=0.5).collect()
    assert out[0].category == "Cybercrime" and out[0].slope > 0 and "Theft" not in {r.category for r in out}


def test_recurring_method(spark):
    rows = [("2024-01-01 01:00:00", "AreaA", "V", "VehicleTheft", f"a{i}") for i in range(12)] + [("2024-01-01 03:00:00", "AreaB", "V", "VehicleTheft", f"b{i}") for i in range(10)]
    rows += [("2024-01-01 20:00:00", "AreaC", "R", "StreetRobbery", f"c{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "ts string, area string, cat string, subtype string, id string")
    out = signals.mo_signatures(df, RoleMap(ROLES.columns | {"subtype": "subcategory"}), "id").collect()
    assert [(r.subtype, r.band, r.n, r.n_areas, r.areas, r.ids) for r in out] == [("VehicleTheft", "Night", 22, 2, ["AreaA", "AreaB"], ["a0", "a1", "a10"])]


def test_capture_rate(spark):
    rows = [(a, (datetime(2024, 1, 1) + timedelta(days=d)).date(), 20 if a == "A" else 1) for d in range(200) for a in "ABCDEF"]
    df = spark.createDataFrame(rows, "area string, day date, n long")
    r = signals.capture_at_k(df).first()
    assert r.capture_rate >= 0.7 and r.k >= 3 and r.folds == 3
    assert signals.capture_at_k(df.filter("day < '2024-01-20'")).unavailable


def test_spikes_need_history_and_skip_null_groups(spark):
    day = lambda d: (datetime(2024, 1, 1) + timedelta(days=d)).date()
    rows = [("A", day(d), 1 if d < 70 else 9) for d in range(100)] + [("short", day(d), 9) for d in range(80, 100)] + [(None, day(d), 1 if d < 70 else 50) for d in range(100)]
    out = signals.spike_alerts(spark.createDataFrame(rows, "area string, day date, n long"), ["area"]).collect()
    assert [(r.area, r.recent_daily) for r in out] == [("A", 9.0)] and out[0].z_score > 2.5


def test_risk_components(spark):
    df = spark.createDataFrame([("low", 0.0, 0.0, -3.0, 0.0), ("top", 10.0, 1.0, 2.0, 1.0)], "area string, vol double, slope double, z double, exposure double")
    for exposed in (False, True):
        out = {r.area: r.score for r in signals.risk_score(df, exposed).collect()}
        assert out["top"] == pytest.approx(1.0) and out["low"] == 0.0
    flat = signals.min_max(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), {"v": "s"})
    assert [r.s for r in flat.collect()] == [0.0, 0.0, 0.0]


def test_area_risk_fills_missing_days(spark):
    day = lambda d: (datetime(2024, 1, 1) + timedelta(days=d)).date()
    rows = [("rise", day(d), 1 + d // 4) for d in range(60)] + [("rare", day(d), 1) for d in (0, 59)] + [("new", day(d), 5) for d in range(50, 60)]
    out = {r.area: r for r in signals.area_risk(spark.createDataFrame(rows, "area string, day date, n long")).collect()}
    assert set(out) == {"rise", "rare"} and out["rise"].risk_score > out["rare"].risk_score and out["rare"].recent_daily == pytest.approx(1 / 28, abs=0.01)


def test_hotspots(spark):
    rows = [(12.0, 77.0)] * 10 + [(13.0, 78.0)] * 3 + [(14.0, 79.0)] * 2 + [(None, 77.0)]
    df = spark.createDataFrame(rows, "lat double, lng double")
    out = signals.grid_hotspots(df, RoleMap({"lat": "latitude", "lng": "longitude"})).collect()
    assert [r.n for r in out] == [10, 3] and out[0].intensity == 1.0 and abs(out[0].lat - 12) < 0.02


def test_anomalies_find_planted_outliers(spark):
    rows = [(f"r{i}", float(100 + i % 7), float(30 + i % 5), "Theft") for i in range(600)] + [("odd1", 90_000.0, 99.0, "Rare"), ("odd2", -5_000.0, 1.0, "Theft")]
    df = spark.createDataFrame(rows, "id string, loss double, age double, cat string")
    out = [r.key for r in signals.anomalies(df, RoleMap({"id": "id", "loss": "money", "age": "age", "cat": "category"}), "id", limit=5).collect()]
    assert {"odd1", "odd2"} <= set(out)
    assert signals.anomalies(df, RoleMap({"id": "id"}), "id").unavailable


def test_few_odd_rows_among_very_many_come_first(spark):
    """Hardly a sample of a tree holds one of them."""
    k = F.col("id")
    df = spark.range(120_000).select(k.cast("string").alias("id"), (100 + k % 997).cast("double").alias("loss"), (k % 61).cast("double").alias("age"), (k % 5).cast("string").alias("cat"))
    odd = spark.createDataFrame([(f"odd{i}", 1e9, float(i), "odd") for i in range(4)], df.schema)
    roles = RoleMap({"id": "id", "loss": "money", "age": "age", "cat": "category"})
    out = signals.anomalies(df.union(odd), roles, "id", limit=4).collect()
    assert {r.key for r in out} == {f"odd{i}" for i in range(4)} and all(r.flagged for r in out)


def period_rows(spark):
    rows = []
    for d in range(60):
        for i in range(2 if d < 30 else 4):
            rows.append((datetime(2026, 1, 1) + timedelta(days=d, hours=i), ("Mysuru", "Bengaluru")[i % 2], ("Robbery", "Fraud")[i % 2], (12.3, 12.97)[i % 2], (76.6, 77.59)[i % 2]))
    df = spark.createDataFrame(rows, "occurred_at timestamp_ntz, district string, crime_type string, latitude double, longitude double")
    return df, RoleMap({"occurred_at": "timestamp", "district": "admin_area_1", "crime_type": "category", "latitude": "latitude", "longitude": "longitude"})


def test_period_comparison(spark):
    df, roles = period_rows(spark)
    w = periods.Window("2026-01-31", "2026-03-02")
    r = periods.compare(df, roles, w).first()
    assert (r.current, r.previous, r.percent_change, r.available) == (120, 60, 100.0, True)
    r = periods.compare(df, roles, w, area="Mysuru").first()
    assert (r.current, r.previous) == (60, 30)
    f = periods.frames(df, roles, w, 10).collect()
    assert [x.n for x in f] == [40, 40, 40] and sum(x.n for x in f) == 120
    assert {x.kind for x in periods.frame_cells(df, roles, w, 10).collect()} == {"persistent"}
    r = periods.compare(df, roles, periods.Window("2026-01-01", "2026-01-08")).first()
    assert not r.available and r.percent_change is None
    with pytest.raises(ValueError):
        periods.Window("2026-02-01", "2026-01-01")
    with pytest.raises(ValueError):
        periods.frames(df, roles, periods.Window("2025-01-01", "2025-12-31"), 1)


def test_query_refuses_unknown_names_and_sorts_nulls_last(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, v int")
    for bad in (Query(["x"]), Query(measures=[("median", "v")]), Query(time_dimension="k", time_grain="decade"), Query(filters={"x": 1})):
        with pytest.raises(ValueError):
            query.run(df, bad)
    out = query.run(df, Query(["k"], measures=[("sum", "v")], order_by="sum_v", desc=True)).collect()
    assert [r.sum_v for r in out] == [3, 1, None]
    assert query.run(df, Query(filters={"k": []})).first()["count"] == 0


# cleaning


def col(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, c {kind}")


def values_of(cleaned):
    return [r.c for r in cleaned.clean.orderBy("id").collect()]


def test_dates_phones_money(spark):
    d = cleaning.normalize_dates(col(spark, ["15/03/2024", "2024-03-16", "not-a-date", "12/14/2025", "03/10/2026", None, ""]), "c", "id")
    assert values_of(d) == ["2024-03-15", "2024-03-16", None, "2025-12-14", "2026-10-03", None, None]
    assert [(r.row_key, r.value) for r in d.quarantine.collect()] == [("2", "not-a-date")]
    p = cleaning.normalize_phones(col(spark, ["9876543210", "+91 98765 43210", "098765 43210", "123", " ", None]), "c", "id")
    assert values_of(p) == ["+919876543210"] * 3 + ["123", None, None]
    assert [r.reason for r in p.quarantine.collect()] == ["bad phone length (3)"]
    m = cleaning.normalize_money(col(spark, ["₹1,200.50", "  2000 ", "", "abc", "Rs.250000"]), "c", "id")
    assert values_of(m) == [1200.5, 2000.0, None, None, 250000.0] and m.quarantine.count() == 1


def test_standardise(spark):
    df = col(spark, ["Theft", "Theft", "theft", "THEFT ", "Cyber", None])
    assert values_of(cleaning.standardize_values(df, "c", "id")) == ["Theft"] * 4 + ["Cyber", None]
    fuzzy = col(spark, ["theft", "THEFT - residential", "cyber crime", "zzz"])
    mapping = cleaning.build_value_map(fuzzy, "c", ["Theft", "Cybercrime", "Assault"])
    assert values_of(cleaning.standardize_values(fuzzy, "c", "id", mapping)) == ["Theft", "Theft", "Cybercrime", "zzz"]
    assert [r.value_key for r in cleaning.unmapped(fuzzy, "c", mapping).collect()] == ["zzz"]


def test_persons(spark):
    rows = [("p1", "Manjunath Gowda", "Udupi"), ("p2", "Manjunath GowdaB", "Udupi"), ("p3", "Manjunath  Gowda", "Udupi"), ("p4", "Asha Rao", "Mysuru"), ("p5", "ಮಂಜುನಾಥ", "Udupi"), ("p6", "Manjunath Gowda", "Mysuru")]
    out = cleaning.resolve_persons(spark.createDataFrame(rows, "pid string, name string, loc string"), "name", "pid", "loc")
    who = {r.pid: r.person_canonical for r in out.clean.collect()}
    assert who["p1"] == who["p2"] == who["p3"] and len({who[p] for p in ("p1", "p4", "p5", "p6")}) == 4 and who["p5"]
    assert {r.row_key for r in out.changes.collect()} == {"p1", "p2", "p3"}


def slow_ratio(a, b):
    """100 x (1 - insertions and deletions / lengths), a character at a time."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def slow_similarity(a, b):
    a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    words = slow_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    part = max(slow_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
    return max(slow_ratio(a, b), 0.95 * words, 0.9 * part if len(long) > 1.5 * len(short) or len(short) > 3 else 0.0)


def test_likeness_in_words_of_bits_equals_the_slow_one():
    from casemill.functions import likeness

    r = random.Random(2)
    text = lambda most: "".join(r.choice("ab cé😀") for _ in range(r.randrange(most)))
    pairs = [(text(12), text(12)) for _ in range(400)] + [(text(300), text(300)) for _ in range(30)] + [("", ""), ("", "a"), ("x" * 64, "x" * 65), ("ab" * 64, "ba" * 64), ("\x00a", "a")]
    a, b = zip(*pairs, strict=True)
    assert likeness.ratios(list(a), list(b)).tolist() == [slow_ratio(x, y) for x, y in pairs]
    values, names = [text(25) for _ in range(40)] + ["Theft (residential)", ""], ["theft", "b a", "", "a much longer name of two hundred characters " * 5]
    got = likeness.similarities(values, names)
    assert [[round(x, 9) for x in row] for row in got] == [[round(slow_similarity(v, n), 9) for n in names] for v in values]
    assert likeness.similarities([], names).shape == (0, 4) and likeness.similarities(values, []).shape == (42, 0)


@pytest.mark.parametrize("threshold", [60.0, 80.0, 88.0, 100.0])
def test_segments_find_all_similar_names(spark, threshold):
    r = random.Random(int(threshold))
    base = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(25)]
    names = {w for b in base for w in (b, b[1:], b + "a", b[:3] + b[4:], b[:2] + "cb" + b[2:], b[::-1]) if w}
    rows = [((i, w), p, w) for p in "xy" for i, w in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "o struct<i: int, w: string>, place string, own string").withColumn("o", F.struct("o.i", "place", "own"))
    got = {(x.lo.place, x.lo.own, x.hi.own) for x in cleaning.similar_names(df, threshold).collect()}
    order = sorted(names)
    want = {(p, a, b) for p in "xy" for i, a in enumerate(order) for b in order[i + 1 :] if slow_ratio(a, b) >= threshold}
    assert got == want


def test_rows_of_the_segment_index_do_not_grow_with_the_place(spark):
    for n in (500, 4_000):
        letters = F.base64(F.unhex(F.md5(F.col("id").cast("string"))))
        df = spark.range(n).select(F.col("id").alias("i"), F.lit("p").alias("place"), letters.substr(1, 21).alias("own"))
        lo, hi = cleaning.segment_index(df, 0.88)
        assert lo.count() == 36 * n and hi.count() <= 112 * n
        assert lo.join(hi, "key").filter("lo <> hi").count() <= 8 * n


@pytest.mark.parametrize("threshold", [60.0, 80.0, 88.0, 100.0])
def test_two_segments_find_all_similar_names(spark, threshold, monkeypatch):
    """Of three places two have more names than are few; names of 80 letters allow more changes than two segments are for."""
    monkeypatch.setattr(cleaning, "FEW_NAMES", 20)
    r = random.Random(int(threshold))
    base = ["".join(r.choice("ab é😀") for _ in range(r.randrange(1, 14) if threshold < 88 else r.randrange(1, 40))) for _ in range(20)]
    base += ["".join(r.choice("abc") for _ in range(80))] if threshold >= 88 else []
    changed = lambda b: "".join("" if r.random() < 0.06 else c + r.choice("abc") if r.random() < 0.06 else c for c in b)
    names = sorted({w for b in base for w in (b, changed(b), changed(b), b[1:], b + " a", b[3:] + b[:3]) if w})
    rows = [((i, p), p, w) for p, most in (("x", 999), ("y", 999), ("z", 20)) for i, w in enumerate(names[:most])]
    df = spark.createDataFrame(rows, "o struct<i: int, place: string>, place string, own string")
    got = sorted((x.lo.place, x.hi.place, x.lo.i, x.hi.i) for x in cleaning.similar_names(df, threshold).collect())
    alike = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if slow_ratio(names[a], names[b]) >= threshold]
    assert got == sorted((p, p, a, b) for p, most in (("x", 999), ("y", 999), ("z", 20)) for a, b in alike if b < most)
    assert alike or threshold == 100


def test_names_of_a_large_place_are_compared_with_few_others(spark, monkeypatch):
    """Of random names of 21 letters, sharing one segment, 105,760 pairs met at 6,000 names and 1,689,118 at 24,000."""
    met, counts = cleaning.met_names, []
    monkeypatch.setattr(cleaning, "met_names", lambda lo, hi, *p: counts.append((lo.count(), hi.count(), met(lo, hi, *p).count())) or met(lo, hi, *p))
    for n in (6_000, 24_000):
        counts.clear()
        df = spark.range(n).select(F.col("id").alias("o"), F.lit("p").alias("place"), F.md5(F.col("id").cast("string")).substr(1, 21).alias("own"))
        assert cleaning.similar_names(df, 88.0).count() == 0
        assert sum(c[0] for c in counts) == 9 * n and sum(c[1] for c in counts) <= 79 * n and sum(c[2] for c in counts) <= n / 100


def test_a_chain_of_names_in_turn(spark):
    """Each is like its neighbours only: every second one represents itself."""
    edges = spark.range(60).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    got = {(r.hi, r.lo) for r in cleaning.first_representatives(edges).collect()}
    assert got == {(i, i - 1) for i in range(1, 61, 2)}


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 999.0)], "id long, x double")
    out = cleaning.handle_missing(df, "x", "id", "drop", True, (0, 100))
    assert [r.id for r in out.clean.collect()] == [1] and sorted(r.reason for r in out.quarantine.collect()) == ["missing", "out of range"]
    filled = cleaning.handle_missing(df, "x", "id", "impute", True, (0, 100), fill=5.0)
    assert [r.x for r in filled.clean.orderBy("id").collect()] == [10.0, 5.0, 5.0]
    d = cleaning.dedupe_rows(spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), (None, 4), (None, 5)], "fir string, v long"), ["fir"], "v")
    assert sorted(r.v for r in d.clean.collect()) == [1, 2, 4] and d.quarantine.count() == 2


def test_messy_sample_end_to_end(spark):
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    text = [(d.strftime(f), d.strftime("%Y-%m-%d")) for d, f in zip(days, ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d %b %Y"] * 8, strict=True)]
    rows = [(f"F{i:02}", t, f"98765{i:05}", f"Rs. {i}00") for i, (t, _) in enumerate(text)] + [("F00", text[0][0], "9876500000", "Rs. 000")]
    df = spark.createDataFrame(rows, "fir string, occurrence_ts string, phone string, loss_amount string")
    digest = profile.digest(df)
    plan = cleaning.plan_from_digest(digest, "fir")
    out = cleaning.execute_plan(df, plan, "fir")
    truth = spark.createDataFrame([(f"F{i:02}", t) for i, (_, t) in enumerate(text)], "fir string, occurrence_ts string")
    assert not out.skipped and out.clean.count() == 40
    assert cleaning.recovery(out.clean, truth, "fir", "occurrence_ts").first().rate >= 0.95
    assert dict(out.clean.dtypes)["loss_amount"] == "double"


# profile, append, graph


def test_roles_by_name_and_by_shape(spark):
    rows = [(i, f"D{i % 3}", float(i % 80), 12.0 + i % 5, f"u{i}", f"k{i % 4}", datetime(2024, 1, 1), "9876543210", True) for i in range(100)]
    df = spark.createDataFrame(rows, "fir_no long, district string, loss_value double, latitude double, code_x string, colour string, seen_at timestamp_ntz, phone string, flag boolean")
    roles = {r.column: r.role for r in profile.profile({"t": df}).collect()}
    assert roles == {"fir_no": "id", "district": "admin_area_1", "loss_value": "money", "latitude": "latitude", "code_x": "id", "colour": "category", "seen_at": "timestamp", "phone": "phone", "flag": "boolean"}
    wide = df.withColumn("latitude", F.col("latitude") * 100)
    assert {r.column: r.role for r in profile.profile({"t": wide}).collect()}["latitude"] == "measure"


def test_label_resolution_suffixes_shared_names(spark):
    child = spark.createDataFrame([(1, 1, 2), (2, 2, None)], "case_id long, grade_id long, kind_id long")
    a = spark.createDataFrame([(1, "Open"), (2, "Closed")], "grade_id long, value string")
    b = spark.createDataFrame([(2, "Big")], "kind_id long, value string")
    out = profile.resolve_labels(child, [(a, "grade_id", "value"), (b, "kind_id", "value")])
    assert out.columns == ["case_id", "grade_id", "kind_id", "value", "value_kind_id"] and sorted((r.value, r.value_kind_id) for r in out.collect() if r.value_kind_id) == [("Open", "Big")]


def test_digest(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "a", "9876543210"), ("2", "05/01/2024", "b", "98765"), ("3", "x", "c", None)], "fir string, d string, cat string, phone string")
    out = {r.column: r for r in profile.digest(df).collect()}
    assert out["d"].date_parse_rate >= 0.6 and out["cat"].distinct == 3 and out["cat"]["values"] == ["a", "b", "c"] and out["phone"].phone_like_rate == 0.5 and out["phone"].null_pct == 0.333


def test_append(spark):
    stored = spark.createDataFrame([("A1", "x"), ("A2", "y"), ("A3", "z")], "fir_no string, crime_group string")
    new = spark.createDataFrame([("A3", "z", 1), ("A4", "q", 1), ("A5", "r", 1)], "FIR_No string, crime_group string, extra int")
    out = merge.append(new, stored, RoleMap({"fir_no": "id"}))
    assert (out.added, out.duplicates_skipped, out.extras_ignored, out.table.count(), out.new_table) == (2, 1, 1, 5, False)
    plain = merge.append(spark.createDataFrame([("a", None), ("zz", None)], "kind string, n int"), spark.createDataFrame([("a", None), ("b", None)], "kind string, n int"))
    assert (plain.added, plain.duplicates_skipped) == (1, 1)
    assert merge.append(new, None).new_table
    with pytest.raises(PermissionError):
        merge.append(new, stored, read_only=True)
    assert merge.match_table("other", ["fir_no", "crime_group"], {"cases": ["FIR_NO", "crime_group"], "b": ["x"]}) == "cases" and merge.match_table("o", ["q"], {"b": ["x"]}) is None


def test_graph(spark):
    acc = spark.createDataFrame([("P1", "Ravi Kumar", "C1", "1, Udupi", "x", 1), ("P1", "Ravi Kumar", "C2", "1, Udupi", "x", 2), ("P1", "Ravi Kumar", "C3", "1, Udupi", "x", 3), ("P2", "Kumar Ravi", "C4", "9, udupi", "x", 4), ("P3", "Else", "C4", "2, Mysuru", "y", 5)], "acc_id string, name string, case_ref string, address string, phone string, seq long")
    cases = spark.createDataFrame([("C1", "DistrictA", "VehicleTheft", "2024-01-01 01:00:00"), ("C2", "DistrictB", "VehicleTheft", "2024-01-02 02:00:00"), ("C3", "DistrictA", "Fraud", "2024-01-02 12:00:00"), ("C4", "DistrictC", "Fraud", "2024-01-03 20:00:00")], "fir_id string, district string, subtype string, ts string")
    inv = graph.fk_edges(acc, "person", "acc_id", "case_ref")
    all_profiles = graph.profiles(inv, cases, "fir_id", "district", "subtype", F.col("ts").try_cast("timestamp_ntz"))
    r = graph.profile_of(all_profiles, "person:P1").first()
    assert (r.n_cases, r.areas, r.top_kind, r.peak_band) == (3, ["DistrictA", "DistrictB"], "VehicleTheft", "Night")
    assert graph.profile_of(all_profiles, "person:none").first().n_cases == 0
    assert [(x.src, x.dst) for x in graph.fuzzy_edges(acc, "person", "acc_id", "name", "address", "seq").collect()] == [("person:P1", "person:P2")]
    shared = graph.shared_edges(acc, "person", "acc_id", "phone", "seq")
    assert [(x.src, x.dst) for x in shared.collect()] == [("person:P1", "person:P2")]
    assert [(x.id, x.cases) for x in graph.repeat_entities(inv).collect()] == [("person:P1", 3)]
    assert {tuple(x) for x in graph.projection(shared, inv).collect()} == {("person:P1", "person:P2"), ("person:P2", "person:P3")}
    parts = {x.id: x.component for x in graph.connected_components(inv.unionByName(shared)).collect()}
    assert len(set(parts.values())) == 1 and parts["person:P3"] == "case:C1"
    assert {x.id: x.degree for x in graph.search(graph.nodes(acc, "person", "acc_id", "name", "seq"), inv, "RAVI").collect()} == {"person:P1": 3, "person:P2": 1}
    near = graph.ego(inv.unionByName(shared), "case:C1", 1).collect()
    assert [(x.src, x.dst) for x in near] == [("case:C1", "person:P1")]


# triage, findings, reports


def test_triage(spark):
    rows = []
    for i in range(415):
        cat, state = ("Cybercrime" if i % 2 else "Theft"), "Under Investigation"
        if i < 400:
            state = "Undetected" if (i % 2 and i % 10) or (not i % 2 and i % 10 == 0) else "Charge Sheeted"
        start = datetime(2024, 1, 1) + timedelta(days=i % 300, hours=i % 24)
        rows.append((i, cat, f"A{i % 4}", start, start + timedelta(hours=5), float(i * 10), state, f"name{i}"))
    df = spark.createDataFrame(rows, "case_id long, cat string, area string, occurrence_ts timestamp_ntz, reported_ts timestamp_ntz, loss double, status string, person_name string")
    roles = RoleMap({"case_id": "id", "cat": "category", "area": "admin_area_1", "occurrence_ts": "timestamp", "reported_ts": "timestamp", "loss": "money", "status": "status", "person_name": "person_name"})
    train, todo = triage.features(df, roles), triage.features(df, roles, training=False)
    assert train.count() == 400 and todo.count() == 15 and not {"person_name", "status"} & set(train.columns) and {r.report_delay_h for r in train.collect()} == {5.0}
    bundle = triage.train_detection(train, repeats=1, trees=5)
    assert bundle.metrics["auc"] > 0.7 and bundle.importance.first().feature == "crime_type"
    timed = train.drop("label").withColumn("days", F.when(F.col("crime_type") == "Theft", 10.0).otherwise(100.0))
    slow = triage.train_duration(timed, trees=5)
    assert slow.metrics["mae"] < 5 and triage.train_duration(timed.limit(5)).model is None
    out = triage.score_open(todo, bundle, slow).collect()
    assert len(out) == 15 and [r.probability for r in out] == sorted(r.probability for r in out) and all(len(r.factors) == 3 for r in out)
    assert triage.train_detection(train.limit(50)).reason


def test_selection_keeps_the_headlines(spark):
    rows = [(f"s{i}", "spike", 90 - i) for i in range(5)] + [("r", "rising_risk", 30)] + [(f"d{i}", "data_gap", 95 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, type string, severity int").withColumns({"title": F.col("id"), "evidence": F.create_map().cast("map<string,string>"), "area": F.lit("x"), "category": F.lit("y"), "suggested_action": F.lit(""), "surface": F.lit("")})
    out = [r.id for r in findings.select(df).collect()]
    assert out == ["s0", "r", "d0", "d1", "d2", "s1", "s2"]
    text = findings.brief(findings.select(df)).first().brief
    assert text.startswith("7 priority findings. Most urgent: s0. Watch: r. Data caveat: d0.")
    assert findings.brief(df.limit(0)).first().brief.startswith("No significant")
    assert {r.type for r in findings.mission(df, "hotspot-patrol").collect()} == {"spike", "rising_risk"}


def test_severities_are_bounded_and_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 2.5, 0.05, -0.5), (9.0, 2.5, 5.0, 1.0)], "z double, t double, rate double, r double")
    sev = findings.severities({"z": F.col("z"), "threshold": F.col("t"), "rate": F.col("rate"), "r": F.col("r")})
    got = [tuple(x) for x in df.select(sev["spike"], sev["data_gap"], sev["socio_correlation"]).collect()]
    assert got == [(40, 33, 68), (100, 80, 95)]


def test_a_failing_signal_contributes_nothing(spark):
    good = findings.from_anomalies(spark.range(3))
    out, failed = findings.build(spark, {"good": lambda: good, "bad": lambda: spark.table("no_such_table")})
    assert [r.severity for r in out.collect()] == [46] and set(failed) == {"bad"}


def test_the_bundle_holds_anomalies_predictions_and_a_forecast(spark):
    from casemill import link_queries

    sf = "/root/testdata/sf0.001"
    every = {r.type: r for r in link_queries.all_findings(spark, sf).collect()}
    assert "anomaly" in every
    scored = link_queries.predictions(spark, sf).collect()
    assert scored and ("predicted_undetected" in every) == any(r.probability < 0.35 for r in scored) and ("predicted_stall" in every) == any(r.stall for r in scored)
    rows = link_queries.f16_forecast(spark, sf).collect()
    assert len(rows) == 5 and {r.confidence for r in rows} == {"high"}


def test_registered_models_take_five_repeats_and_all_trees(spark, monkeypatch):
    import inspect

    from casemill import link_queries

    given = {}
    for name in ("train_detection", "train_duration"):
        whole = inspect.signature(getattr(triage, name))

        def note(*args, name=name, whole=whole, **more):
            given[name] = whole.bind(*args, **more)
            given[name].apply_defaults()

        monkeypatch.setattr(triage, name, note)
    link_queries.bundles(spark, "/root/testdata/sf0.001")
    assert given["train_detection"].arguments["repeats"] == 5
    assert all(g.arguments["trees"] == 20 for g in given.values())


def test_watch_rules_count_once(spark):
    df, roles = period_rows(spark)
    rules = spark.createDataFrame([(1, datetime(2026, 1, 31), datetime(2026, 3, 2), 25.0, "gte", True), (2, datetime(2026, 1, 31), datetime(2026, 3, 2), 25.0, "lte", True), (3, datetime(2026, 1, 1), datetime(2026, 1, 8), 0.0, "gte", True), (4, datetime(2026, 1, 31), datetime(2026, 3, 2), 0.0, "gte", False)], "rule_id int, start timestamp_ntz, end timestamp_ntz, threshold double, comparison string, enabled boolean")
    first = reports.watch(rules, df, roles, version="v").collect()
    assert [(r.rule_id, r.percent_change) for r in first] == [(1, 100.0)]
    known = spark.createDataFrame([(r.event,) for r in first], "event string")
    assert reports.watch(rules, df, roles, known, "v").collect() == [] and reports.watch(rules, df, roles, known, "w").count() == 1


def test_scan_of_many_data_sets(spark):
    out, failed = reports.scan_all(spark, {"a": lambda: spark.range(2), "b": lambda: spark.table("no_such_table"), "c": lambda: spark.range(3).filter(F.raise_error(F.col("id").cast("string")).isNull())})
    assert [(r.dataset, r.alerts) for r in out.collect()] == [("a", 2)] and set(failed) == {"b", "c"}


# sources and the stream


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Case No,Crime-Head,Crime Head\n1,a,b\n2,c,d\n")
    df = tables.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["case_no", "crime_head", "crime_head_2"] and df.count() == 2
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "empty.csv"))
    tables.write_table(df, str(tmp_path), "My Table!")
    assert tables.read_tables(spark, str(tmp_path), ["my_table"])["my_table"].count() == 2 and spark.table("my_table").count() == 2
    tables.export_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    many = spark.range(1_000).selectExpr("id", "concat('a, \"', id % 7, '\"') AS text", "id / 4.0 AS x").repartition(5)
    tables.export_parts(many, str(tmp_path / "parts"), ["id"], part_rows=90)
    listed = sorted(spark.read.json(str(tmp_path / "parts/manifest")).collect(), key=lambda r: r.place)
    files = [next((tmp_path / "parts/header").glob("part-*.csv")), *(tmp_path / "parts/rows" / r.file for r in listed)]
    many.orderBy("id").coalesce(1).write.option("header", True).csv(str(tmp_path / "one"))
    assert b"".join(f.read_bytes() for f in files) == next((tmp_path / "one").glob("part-*.csv")).read_bytes()
    body = b"".join(f.read_bytes() for f in files).splitlines()
    assert len(listed) >= 10 and body[0] == b"id,text,x" and [int(x.split(b",")[0]) for x in body[1:]] == list(range(1_000)) and all((tmp_path / "parts/rows" / r.file).stat().st_size == r.bytes for r in listed)
    assert sorted(map(tuple, tables.read_parts(spark, str(tmp_path / "parts")).collect()))[5] == (5, 'a, "5"', 1.25)
    for at in ("2024-01-01", "2024-02-01"):
        tables.log_event(spark, str(tmp_path / "log"), at, "append", ["f"], ["t"])
    assert [r.at for r in tables.read_log(spark, str(tmp_path / "log")).collect()] == ["2024-02-01", "2024-01-01"]


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Case No</t></si><si><t>Area</t></si><si><t>Udupi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    out = tables.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert out.columns == ["case_no", "area"] and [tuple(r) for r in out.collect()] == [(7, "Udupi"), (None, "x")]


def test_sentinel_raises_each_alert_once(spark, tmp_path):
    roles = RoleMap({"id": "id", "ts": "timestamp", "area": "admin_area_1", "cat": "category"})
    schema = "id long, ts timestamp_ntz, area string, cat string"
    rows = [(d * 100 + i, datetime(2024, 1, 1) + timedelta(days=d), "A", "Theft") for d in range(100) for i in range(1 if d < 75 else 9)]
    inc, stored, alerts, check = (str(tmp_path / n) for n in ("in", "stored", "alerts", "check"))
    spark.createDataFrame(rows, schema).write.parquet(inc)
    for _ in range(2):
        sentinel.start(spark, inc, schema, stored, alerts, check, roles, every=None, z_threshold=2.0).awaitTermination()
        assert spark.read.parquet(stored).count() == len(rows)
        assert [(r.area, r.category) for r in spark.read.parquet(alerts).collect()] == [("A", "Theft")]
        spark.createDataFrame(rows[-20:], schema).write.mode("append").parquet(inc)  # known cases again


def test_kpis_and_evidence(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("x", None)], "k string, v double")
    out = {r.id: r.value for r in query.kpis(df, [query.Kpi("n"), query.Kpi("x", filters={"k": "x"}), query.Kpi("v", "sum", "v", {"k": ["x", "y"]})], {"k": "y"}).collect()}
    assert out == {"n": 1.0, "x": 2.0, "v": 3.0}
    spikes = spark.createDataFrame([("A", "Theft", 1.0, 3.0, 200.0, 4.0)], "area string, category string, baseline_daily double, recent_daily double, pct_change double, z_score double")
    f = findings.from_spikes(spikes).first()
    assert f.severity == 70 and f.evidence["z_score"] == "4.0" and json.dumps(f.evidence)


def test_entities_and_domain_pack(spark):
    accused = spark.createDataFrame([(f"P{i % 20}", f"N{i % 20}", f"C{i}", f"98{i % 20:08}") for i in range(60)], "person_id string, accused_name string, fir_no string, phone string")
    cases = spark.createDataFrame([(f"C{i}", ("Pending Trial", "Closed")[i % 2], "Heinous", datetime(2024, 1, 1)) for i in range(60)], "fir_no string, case_status string, gravity string, occurred timestamp_ntz")
    p = profile.profile({"accused": accused, "cases": cases})
    r = profile.entities(p).collect()
    assert [(x.table, x.entity, x.id_column, x.label_column, x.link_columns) for x in r] == [("accused", "accused", "person_id", "accused_name", ["phone"])]
    out = {x.id: x for x in profile.domain_pack(p, profile.top_values(cases), "cases").collect()}
    assert set(out) == {"hour_of_day", "network", "open_cases", "pending_cases", "heinous_cases"} and out["open_cases"]["values"] == ["Pending Trial"]
    plain = profile.profile({"t": spark.createDataFrame([(1, "x")], "n long, colour string")})
    assert profile.domain_pack(plain, profile.top_values(cases), "t").count() == 0


def test_resolution_table_and_suggestions(spark):
    cases = spark.createDataFrame([(i, "A", datetime(2024, 1, 1)) for i in range(50)], "case_id long, district string, occurred_ts timestamp_ntz")
    sheets = spark.createDataFrame([(i % 40, datetime(2024, 2, 1)) for i in range(80)], "case_id long, csdate timestamp_ntz")
    p = profile.profile({"cases": cases, "chargesheets": sheets})
    links = profile.relations(p)
    assert [(r.table, r.column) for r in triage.resolution_table(p, links, "cases").collect()] == [("chargesheets", "csdate")]
    assert {r.id for r in profile.suggestions(p, "cases").collect()} == {"total_records", "active_areas", "trend", "by_area"}


def slow_persons(rows, threshold=88.0):
    """Names in the order of their first keys, each to the first representative of its place that is similar enough."""
    def ratio(a, b):
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        return 200.0 * row[-1][-1] / (len(a) + len(b))

    first = {}
    for k, name, place in rows:
        n = " ".join("".join(c for c in name.lower() if c.isalpha() or c.isspace()).split())
        first[n, place] = min(k, first.get((n, place), k))
    found, out = [], {}
    for (n, place), k in sorted(first.items(), key=lambda e: (e[1], e[0])):
        own = " ".join(sorted(n.split()))
        out[n, place] = next((r for o, p, r in found if p == place and ratio(own, o) >= threshold), None) or f"PC{k}"
        if out[n, place] == f"PC{k}":
            found.append((own, place, f"PC{k}"))
    return {k: out[" ".join("".join(c for c in name.lower() if c.isalpha() or c.isspace()).split()), place] for k, name, place in rows}


def test_persons_equal_the_greedy_order(spark):
    r = random.Random(4)
    names = ["Manjunath Gowda", "Asha Rao", "Ravi Kumar Shetty", "Ab", "Li", "Anna Annanna", "Customer Anand", "Customer Anandi"]
    rows = []
    for k in range(300):
        n = list(r.choice(names) + r.choice(["", " B", " Rao", "a"]))
        for _ in range(r.randint(0, 2)):
            n.insert(r.randint(0, len(n)), r.choice("abn ")) if r.random() < 0.5 else n.pop(r.randrange(len(n)))
        rows.append((k, "".join(n) if any(c.isalpha() for c in n) else "Li", r.choice("xy")))
    out = cleaning.resolve_persons(spark.createDataFrame(rows, "k long, name string, place string"), "name", "k", "place")
    assert {x.k: x.person_canonical for x in out.clean.collect()} == slow_persons(rows)


def test_steps_that_fail_at_run_time_are_skipped(spark):
    df = spark.createDataFrame([(1, "15/03/2024", 5.0), (2, "x", None)], "id long, d string, v double")
    plan = [{"op": "handle_missing", "column": "v", "policy": "impute", "required": True, "fill": "no number"}, {"op": "normalize_dates", "column": "d"}]
    out = cleaning.execute_plan(df, plan, "id")
    assert len(out.skipped) == 1 and out.skipped[0].startswith("handle_missing")
    assert sorted((r.id, r.d, r.v) for r in out.clean.collect()) == [(1, "2024-03-15", 5.0), (2, None, None)]


def test_a_signal_that_fails_at_run_time_gives_no_findings(spark):
    good = lambda: findings.from_repeats(spark.createDataFrame([("a", 5)], "id string, cases long"))
    bad = lambda: findings.from_repeats(spark.createDataFrame([("a", 5)], "id string, cases long").withColumn("cases", F.raise_error(F.lit("broken")).cast("long")))
    out, failed = findings.build(spark, {"good": good, "bad": bad})
    assert [r.id for r in out.collect()] == ["network_hub:a"] and "broken" in failed["bad"]


def test_frames_count_from_the_window_start(spark):
    rows = [(datetime(2024, 1, 1, 12) + timedelta(hours=i),) for i in range(240)] + [(datetime(2024, 1, 11, 12),), (datetime(2024, 1, 6, 11, 59, 59, 999_999),)]
    df, roles = spark.createDataFrame(rows, "ts timestamp_ntz"), RoleMap({"ts": "timestamp"})
    w = periods.Window("2024-01-01T12:00:00", "2024-01-11T12:00:00")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.n for r in periods.frames(df, roles, w, 10).collect()] == [241]
            assert [r.n for r in periods.frames(df, roles, w, 5).collect()] == [121, 120]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert periods.compare(df, roles, w).first().current == 241


def test_counts_before_points(spark):
    r = random.Random(2)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 20_000))
    times, points = [at() for _ in range(400)], [at() for _ in range(30)] + [datetime(2023, 1, 1), datetime(2025, 1, 1)]
    got = reports.counts_before(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"), spark.createDataFrame([(t,) for t in points], "at timestamp_ntz"))
    assert {x["at"]: x.before for x in got.collect()} == {p: sum(t < p for t in times) for p in points}


def test_dates_by_shape_equal_trying_every_format(spark):
    values = ["2024-03-16", "15/03/2024", "15-03-2024", "5/3/2024", "5-3-2024", "15.03.2024", "12/14/2025", "12-14-2025", "5 Mar 2024", "05 Mar 2024", "Mar 5, 2024", "2024/03/16", "20240316", "2024-03-16 10:11:12", "2024-03-16T10:11:12", "15/03/2024 10:11", "15-03-2024 10:11", " 2024-03-16 ", "31/02/2024", "2024-13-01", "x", "", "1234567890", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    every = F.coalesce(*[F.try_to_timestamp(F.trim("c"), F.lit(f)) for f in profile.DATE_FORMATS]).cast("date")
    assert df.filter(~every.eqNullSafe(profile.parsed_date(F.col("c")))).collect() == []
    assert df.filter(every.isNotNull()).count() == 18


def test_digest_counts_nulls_and_whole_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, None, "a"), (2, None, None)], "n int, x string, y string")
    out = {r.column: r for r in profile.digest(df).collect()}
    assert {r.duplicate_rows for r in out.values()} == {1} and {r.rows for r in out.values()} == {4}
    assert (out["x"].null_pct, out["y"].null_pct, out["n"].distinct, out["n"]["values"], out["n"].date_parse_rate) == (0.75, 0.5, 2, ["1", "2"], None)
    assert [(r.rows, r.distinct, r.samples) for r in profile.digest(df.limit(0)).collect()] == [(0, 0, [])] * 3


def test_sentinel_keeps_null_and_repeated_ids_and_may_repeat_a_batch(spark, tmp_path):
    roles = RoleMap({"id": "id", "ts": "timestamp", "area": "admin_area_1", "cat": "category"})
    schema = "id long, ts timestamp_ntz, area string, cat string"
    stored, alerts = str(tmp_path / "stored"), str(tmp_path / "alerts")
    one = spark.createDataFrame([(None, datetime(2024, 1, 1), "A", "x")] * 3 + [(1, datetime(2024, 1, 1), "A", "x")] * 2 + [(2, datetime(2024, 1, 2), "A", "x")], schema)
    two = spark.createDataFrame([(1, datetime(2024, 1, 1), "A", "x"), (3, datetime(2024, 1, 3), "B", "x"), (None, datetime(2024, 1, 3), "B", "x")], schema)
    sentinel.process(one.limit(0), 0, stored, alerts, roles)
    for n, batch in ((1, one), (2, two), (2, two), (1, one)):
        sentinel.process(batch, n, stored, alerts, roles)
    assert Counter(r.id for r in spark.read.parquet(stored).collect()) == Counter({None: 4, 1: 2, 2: 1, 3: 1})
    daily = spark.read.parquet(f"{stored}_daily").groupBy("area").agg(F.sum("n").alias("n"))
    assert {r.area: r.n for r in daily.collect()} == {"A": 6, "B": 2}


def test_first_rows_of_hot_keys_and_equal_rows(spark):
    rows = [(None, i % 7, "a") for i in range(200)] + [("k", 3, "b"), ("k", 3, "b"), ("k", None, "c"), ("j", None, "d"), ("j", None, None)]
    df = spark.createDataFrame(rows, "k string, v long, t string")
    out = cleaning.dedupe_rows(df, ["k"], "v")
    assert sorted(map(repr, map(tuple, out.clean.collect()))) == sorted(map(repr, [(None, 0, "a"), ("k", 3, "b"), ("j", None, "d")]))
    assert out.quarantine.count() == len(rows) - 3


def test_types_of_workbook_columns(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "2024-01-05 10:00:00", "x", None), (" ", "2", "false", "2024-01-06 11:00:00", "2", None)], "a string, b string, c string, d string, e string, f string")
    out = tables.typed(df)
    assert [t for _, t in out.dtypes] == ["bigint", "double", "boolean", "timestamp_ntz", "string", "string"] and out.collect()[1].a is None


def test_a_wide_master_is_not_broadcast(spark):
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k long, t string")
    hinted = lambda most: "ResolvedHint" in lineage.small_or_not(wide, 100, most)._jdf.queryExecution().analyzed().toString()
    assert hinted(100_000) and not hinted(10_000)


# communities


def modularity_of(pairs, label, resolution=1.0):
    edges = {frozenset(p) for p in pairs if p[0] != p[1]}
    tot, within = {}, {}
    for a, b in map(tuple, edges):
        for x in (a, b):
            tot[label[x]] = tot.get(label[x], 0) + 1
        within[label[a]] = within.get(label[a], 0) + 2 * (label[a] == label[b])
    m2 = 2 * len(edges)
    return sum(within.get(c, 0) / m2 - resolution * (t / m2) ** 2 for c, t in tot.items())


def test_communities_of_planted_groups_beat_label_propagation(spark):
    import random

    from casemill.operators import communities

    r = random.Random(1)
    nodes = [f"n{i:03}" for i in range(150)]
    pairs = [(a, b) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if r.random() < (0.5 if i % 5 == j % 5 else 0.02)]
    df = spark.createDataFrame([*pairs, *pairs[:20], ("n000", "n000")], "src string, dst string")
    label = {x.id: x.community for x in communities.communities(df).collect()}
    assert {c: {n for n in nodes if label[n] == c} for c in set(label.values())} == {nodes[k]: set(nodes[k::5]) for k in range(5)}
    got = communities.modularity(df, spark.createDataFrame(list(label.items()), "id string, community string")).first()
    other = {x.id: x.community for x in graph.label_propagation(df).collect()}
    assert abs(got.modularity - modularity_of(pairs, label)) < 1e-12 and got.communities == 5 and got.modularity >= modularity_of(pairs, other)


def test_communities_of_weighted_and_odd_edges(spark):
    from casemill.operators import communities

    rows = [("a", "b", 5.0), ("b", "c", 0.1), ("c", "d", 5.0), ("d", "a", 0.1), ("x", "x", 9.0)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    assert {(r.id, r.community) for r in communities.communities(df, weight="weight").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    assert communities.communities(df.limit(0)).count() == 0
    hub = spark.createDataFrame([("hub", f"leaf{i}") for i in range(300)], "src string, dst string")
    assert {r.community for r in communities.communities(hub).collect()} == {"hub"}


def test_ego_of_an_unknown_node_is_an_error(spark):
    edges = spark.createDataFrame([("p:1", "case:1", "involved_in", None), ("p:1", "p:2", "shared_phone", "9")], graph.EDGES)
    with pytest.raises(LookupError):
        graph.ego(edges, "p:9")
    around = graph.ego(edges, "p:1")
    assert {tuple(r) for r in around.collect()} == {("case:1", "p:1", "involved_in", None), ("p:1", "p:2", "shared_phone", "9")}
    nodes = spark.createDataFrame([("p:1", "p", "Anna")], "id string, kind string, label string")
    assert {tuple(r) for r in graph.ego_nodes(around, nodes, "p:1").collect()} == {("p:1", "p", "Anna", True), ("p:2", "p", "2", False), ("case:1", "case", "1", False)}


# boosting


def test_feistel_numbers_are_permutations():
    import numpy as np

    from casemill.operators import boosting

    for n in (1, 2, 3, 7, 64, 1000, 1025):
        for key in (1, 5, 2**40):
            assert sorted(boosting.feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert (boosting.feistel(np.arange(5000), 5000, 1) != boosting.feistel(np.arange(5000), 5000, 2)).mean() > 0.99


def test_best_splits_by_all_ways():
    """Numbers: every cut, the missing ones on either side. Categories: no worse than the best of all subsets."""
    import itertools

    import numpy as np

    from casemill.operators import boosting

    r = np.random.default_rng(3)
    gain = lambda s, left: sum(boosting._gain(*(s[i, part].sum() for i in (0, 1))) for part in (left, ~left)) - boosting._gain(s[0].sum(), s[1].sum())
    for _ in range(20):
        s = np.zeros((3, boosting.BINS))
        at = np.r_[0, r.choice(np.arange(1, 256), 6, replace=False)] if r.random() < 0.5 else r.choice(np.arange(1, 256), 7, replace=False)
        s[0, at], s[1, at], s[2, at] = r.normal(size=7) * 30, 50, r.integers(20, 60, 7)
        ways = [np.isin(np.arange(256), x) for k in range(1, 7) for x in itertools.combinations(at.tolist(), k)]
        ordered = [w for w in ways if all(not (w[a] < w[b]) for a, b in itertools.pairwise(sorted(x for x in at if x)))]
        number, bins = boosting.best_split(s, False)
        assert abs(number - max(0.0, *(gain(s, w) for w in ordered))) < 1e-9 and (number == 0 or abs(gain(s, bins) - number) < 1e-9)
        category, bins = boosting.best_split(s, True)
        assert abs(category - max(gain(s, w) for w in ways)) < 1e-9 and abs(gain(s, bins) - category) < 1e-9
    assert boosting.best_split(np.zeros((3, 256)), True)[0] == 0


def test_boosting_of_many_categories_missing_values_and_a_saved_model(spark, tmp_path):
    from casemill.operators import boosting

    k = F.col("id")
    many = F.concat(F.lit("c"), (k % 2_999).cast("string"))
    df = spark.range(30_000).select(many.alias("many"), F.when(k % 5 != 0, F.lit("x")).alias("one"), F.when(k % 4 != 0, (k % 1_000).cast("double")).alias("number"), ((k % 2_999 % 7 < 3) & (k % 4 != 0)).cast("double").alias("label"))
    model = boosting.fit(df, "label", ["many", "one"], ["number"], trees=12)
    assert model.codes.filter("feature = 'many'").agg(F.max("bin")).first()[0] <= 255 and model.codes.filter("feature = 'many'").count() == 2_999
    right = lambda m: m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right(model) > 0.99  # an interaction of a category and a missing number
    model.save(str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    assert right(again) == right(model) and again.numbers == ["number"]
    unknown = spark.createDataFrame([("never seen", None, float("nan"), 1.0)], df.schema)
    assert 0 < model.transform(unknown).first().probability < 1
    falls = {r.feature: r.importance for r in boosting.importance(model, df, repeats=2).collect()}
    assert falls["many"] > 0.2 and falls["number"] > 0.1 and abs(falls["one"]) < 0.01
    timed = boosting.fit(df.withColumn("days", F.col("number") * 2), "days", [], ["number"], "squared", trees=30)
    assert timed.transform(df.filter("number IS NOT NULL")).agg(F.avg(F.abs(F.col("prediction") - F.col("number") * 2))).first()[0] < 40
    assert boosting.fit(df.limit(0), "label", ["many"], ["number"]).transform(df.limit(3)).count() == 3


def test_splits_keep_each_label_s_share(spark):
    df = spark.range(8_000).select(F.col("id").cast("string").alias("case_id"), (F.col("id") % 50 == 0).cast("double").alias("label"))
    train, test = triage.split(df, label="label")
    n = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert abs(n[1.0] - 120) <= 2 and abs(n[0.0] - 5_880) <= 5 and train.count() + test.count() == 8_000


def test_the_share_of_flagged_rows_is_the_contamination(spark):
    k = F.col("id")
    df = spark.range(20_000).select(k.cast("string").alias("id"), F.rand(3).alias("loss"), (F.rand(4) * F.rand(5)).alias("age"))
    roles = RoleMap({"id": "id", "loss": "money", "age": "age"})
    scored = signals.anomaly_scores(df, roles, "id", contamination=0.05)
    n = scored.agg(F.avg(F.col("flagged").cast("int")).alias("share"), F.count_if(F.col("flagged") != (F.col("score") > 0)).alias("bad")).first()
    assert abs(n.share - 0.05) <= 0.001 and n.bad == 0
    top = signals.anomalies(df, roles, "id", limit=3).collect()
    assert all(r.flagged and r.record["id"] == r.key and set(r.record) == {"id", "loss", "age"} for r in top) and top == sorted(top, key=lambda r: -r.score)


def test_the_filters_of_all_figures_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS kind", "id % 3 AS place").write.parquet(f"{tmp_path}/t")
    specs = [query.Kpi("a", "count", None, {"kind": 1}), query.Kpi("b", "sum", "id", {"kind": 2})]
    out = query.kpis(spark.read.parquet(f"{tmp_path}/t"), specs, {"place": 2})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(place,2)" in plan.split("PushedFilters")[1]
    assert {r.id: r.value for r in out.collect()} == {"a": sum(i % 7 == 1 and i % 3 == 2 for i in range(100)), "b": sum(i for i in range(100) if i % 7 == 2 and i % 3 == 2)}


# stored states


def test_merged_states_equal_the_whole_table_s(spark):
    from casemill.operators import states

    k = F.col("id")
    df = spark.range(30_000).select(k, F.when(k % 3 > 0, (k % 977).cast("double")).alias("x"), F.concat(F.lit("v"), (k % 5_000).cast("string")).alias("text"), (k % 2 == 0).alias("flag"), F.timestamp_seconds(k).alias("at"))
    parts = [states.profile_state(df.filter(k % 4 == i), "t") for i in range(4)] + [states.profile_state(df.limit(0), "t")]
    got = {r.column: r for r in states.stats_of(states.merge_states(*parts)).collect()}
    want = {r.column: r for r in profile.column_stats(df, "t").collect()}
    for c, w in want.items():
        g = got[c]
        assert (g.row_count, g.null_fraction, g.lo, g.hi, g.position, g.dtype) == (w.row_count, w.null_fraction, w.lo, w.hi, w.position, w.dtype)
        assert (g.mean is None) == (w.mean is None) and (g.mean is None or abs(g.mean - w.mean) < 1e-3) and abs(g.distinct - w.distinct) <= 0.02 * w.distinct
    assert abs(got["id"].q50 - 15_000) < 300 and abs(got["x"].q25 - 244) < 15 and got["text"].q50 is None
    empty = {r.column: r for r in states.stats_of(states.profile_state(df.limit(0), "t")).collect()}
    assert empty["x"].row_count == 0 and empty["x"].distinct == 0 and empty["x"].q50 is None


@pytest.mark.parametrize("few", [1_000, 3])
def test_the_index_of_ids_is_never_shuffled(spark, monkeypatch, few):
    from casemill.operators import states

    monkeypatch.setattr(states, "FEW_IDS", few)
    index = f"ids_test_{few}"
    states.store_ids(spark.range(0, 5_000, 2), "id", index, buckets=8)
    states.store_ids(spark.range(0, 5_000, 5).filter("id % 2 = 1"), "id", index, buckets=8)
    incoming = spark.createDataFrame([(i,) for i in (1, 2, 5, 5, 7, 7, 9_999)] + [(None,)], "id long")
    out = states.new_ids(incoming, "id", index)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") <= 1
    if few == 1_000:
        assert "SelectedBucketsCount" in plan
    assert sorted((r.id for r in out.collect()), key=repr) == [1, 7, 7, 9_999, None]
    spark.sql(f"DROP TABLE {index}")


def test_the_sentinel_takes_on_cases_from_before_its_index(spark, tmp_path):
    roles = RoleMap({"id": "id", "ts": "timestamp", "area": "admin_area_1", "cat": "category"})
    rows = lambda ids: spark.createDataFrame([(i, datetime(2024, 1, 1), "A", "Theft") for i in ids], "id long, ts timestamp_ntz, area string, cat string")
    stored, alerts = str(tmp_path / "cases"), str(tmp_path / "alerts")
    rows([1, 2]).withColumn("batch", F.lit(0).cast("long")).write.partitionBy("batch").parquet(stored)
    sentinel.process(rows([2, 3]), 7, stored, alerts, roles)
    sentinel.process(rows([3, 4]), 8, stored, alerts, roles)
    sentinel.process(rows([3, 4]), 8, stored, alerts, roles)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(stored).collect()) == [(1, 0), (2, 0), (3, 7), (4, 8)]
    assert sorted((r.id, r.batch) for r in spark.read.parquet(f"{stored}_ids").select("id", "batch").distinct().collect()) == [(1, 0), (2, 0), (3, 7), (4, 8)]


def test_values_are_compared_after_they_are_distinct(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("v"))
    plan = cleaning.build_value_map(df, "v", ["1", "2"], 70.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and plan.index("EvalPython") < plan.index("Aggregate")


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 2.0, 3.0, None], [5.0], [float(i * i) for i in range(40)], [1.0, 9.0]])
def test_a_value_between_exact_percentiles(spark, values):
    from casemill.operators import states

    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ends = df.agg(F.percentile("v", 0.48).alias("a"), F.percentile("v", 0.52).alias("b")).first()
    known = sorted(v for v in values if v is not None)
    for q in {*known, *(v + 0.5 for v in known), *ends, ends.a - 0.01, ends.b + 0.01, known[0] - 1}:
        got = states.between_percentiles(df, {"v": q}, 0.48, 0.52).first()
        assert got.between == (ends.a <= q <= ends.b), (q, ends)


def test_rows_of_equal_bins_are_one_row(spark, monkeypatch):
    from casemill.operators import boosting

    seen, own = [], boosting.sums_of
    monkeypatch.setattr(boosting, "sums_of", lambda rows, *a: seen.append(rows.count()) or own(rows, *a))
    k = F.col("id")
    df = spark.range(6_000).select((k % 4).cast("string").alias("kind"), (k % 7).cast("double").alias("x"), ((k % 4 == 1) | (k % 11 == 0)).cast("double").alias("label"))
    model = boosting.fit(df, "label", ["kind"], ["x"], trees=2)
    assert set(seen) == {28}
    right = model.transform(df).agg(F.avg(((F.col("probability") > 0.5) == (F.col("kind") == "1")).cast("int"))).first()[0]
    assert right > 0.99


def test_communities_broadcast_no_table_that_grows(spark, monkeypatch):
    from casemill.operators import communities

    monkeypatch.setattr(communities, "FEW_NODES", 3)
    left, right = spark.range(50).selectExpr("string(id) AS id", "1 AS a"), spark.range(50).selectExpr("string(id) AS id", "2 AS b")
    plan = communities._met(left, right, "id", False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    edges = spark.createDataFrame([(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")], "src string, dst string")
    assert {(r.id, r.community) for r in communities.communities(edges).collect()} == {(f"{g}{i}", f"{g}0") for g in "ab" for i in range(4)}


def test_rounds_of_communities_write_nodes_not_pairs(spark, monkeypatch):
    """Before, each round wrote its pairs' communities anew, and shuffled all pairs."""
    from casemill.operators import communities

    rows, kept = [], communities.stored
    monkeypatch.setattr(communities, "stored", lambda df, *name: (lambda t: rows.append(t.count()) or t)(kept(df, *name)))
    pairs = [(f"{i % 2}.{i:03}", f"{j % 2}.{j:03}") for i in range(200) for j in range(i) if (i * 31 + j * 17) % 10 < (8 if i % 2 == j % 2 else 1)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    label = {r.id: r.community for r in communities.communities(df).collect()}
    assert label == {f"{i % 2}.{i:03}": f"{i % 2}.{i % 2:03}" for i in range(200)}
    assert len(pairs) > 2000 and [n for n in rows if n > 600] == [len(pairs)]


def test_communities_do_not_depend_on_blocks_and_hubs(spark, monkeypatch):
    from casemill.operators import communities

    pairs = [(i, j, 1 + (i * j) % 4 / 4) for i in range(60) for j in range(i) if (i * 7 + j * 5) % 11 < (6 if i % 3 == j % 3 else 1)] + [(60, i, 0.5) for i in range(60)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in pairs], "src string, dst string, w double")
    found = []
    for most, hub in ((2_000_000, 500_000), (100, 25)):
        monkeypatch.setattr(communities, "PAIRS", most)
        monkeypatch.setattr(communities, "HUB", hub)
        found.append({(r.id, r.community) for r in communities.communities(df, weight="w").collect()})
    assert found[0] == found[1] and len(found[0]) == 61 and 1 < len({c for _, c in found[0]}) < 10
