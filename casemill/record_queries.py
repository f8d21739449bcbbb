"""Registered queries on sources, profiles, cleaning and appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings import CASES_SQL, cases, table
from casemill.functions.expressions import norm_name
from casemill.functions.roles import NAME_PATTERNS, RoleMap
from casemill.operators import cleaning, merge, profile
from casemill.queries import register
from casemill.sources import tables


@register("""SELECT * FROM (
SELECT 'customer' AS "table", count(*) AS n_rows, 5::BIGINT AS n_columns FROM customer UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'orders', count(*), 6 FROM orders)
UNION ALL SELECT NULL, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders), 14""")
def s7_composition(spark, sf_dir):
    """Rows and columns of tables and in total."""
    return tables.composition({n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")})


@register("""SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment, c_nationkey, n_name, n_regionkey, r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def s8_denormalized(spark, sf_dir):
    """A fact table with its masters."""
    fact = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return tables.denormalize(fact, [(customer, "o_custkey", "c_custkey"), (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"), (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")])


@register("""SELECT 'orders' AS "table", * FROM (
SELECT 'o_orderkey' AS "column", 0 AS position, 'integer' AS dtype, count(*) AS row_count, round(1 - count(o_orderkey) / count(*), 4) AS null_fraction, count(DISTINCT o_orderkey) AS "distinct", min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi, round(avg(o_orderkey), 4) AS mean FROM orders
UNION ALL SELECT 'o_custkey', 1, 'integer', count(*), round(1 - count(o_custkey) / count(*), 4), count(DISTINCT o_custkey), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4) FROM orders
UNION ALL SELECT 'o_orderstatus', 2, 'string', count(*), round(1 - count(o_orderstatus) / count(*), 4), count(DISTINCT o_orderstatus), NULL, NULL, NULL FROM orders
UNION ALL SELECT 'o_totalprice', 3, 'float', count(*), round(1 - count(o_totalprice) / count(*), 4), count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_orderdate', 4, 'timestamp', count(*), round(1 - count(o_orderdate) / count(*), 4), count(DISTINCT o_orderdate), epoch(min(o_orderdate)), epoch(max(o_orderdate)), NULL FROM orders
UNION ALL SELECT 'o_orderpriority', 5, 'string', count(*), round(1 - count(o_orderpriority) / count(*), 4), count(DISTINCT o_orderpriority), NULL, NULL, NULL FROM orders)""")
def p1_column_stats(spark, sf_dir):
    """Statistics of all columns in one pass."""
    return profile.column_stats(table(spark, sf_dir, "orders"), "orders")


@register("""WITH l AS (SELECT 'n_name' AS "column", n_name AS value FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
n AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS rank FROM n QUALIFY rank <= 10""")
def p2_top_values(spark, sf_dir):
    """The commonest values of string columns."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return profile.top_values(c.select("n_name", "c_mktsegment", "c_custkey"))


def keyed(spark, sf_dir):
    """Tables whose keys have equal names, as relations are found by names."""
    rename = lambda n, *pairs: table(spark, sf_dir, n).withColumnsRenamed(dict(pairs))
    return {
        "orders": rename("orders", ("o_custkey", "cust_id"), ("o_orderkey", "order_id")), "customer": rename("customer", ("c_custkey", "cust_id"), ("c_nationkey", "nation_id")),
        "nation": rename("nation", ("n_nationkey", "nation_id")), "events": table(spark, sf_dir, "events"),
    }


KEYED = {
    "orders": {"order_id": "o_orderkey", "cust_id": "o_custkey", "o_orderstatus": "", "o_totalprice": "", "o_orderdate": "", "o_orderpriority": ""},
    "customer": {"cust_id": "c_custkey", "c_name": "", "nation_id": "c_nationkey", "c_acctbal": "", "c_mktsegment": ""}, "nation": {"nation_id": "n_nationkey", "n_name": "", "n_regionkey": ""},
    "events": {"event_id": "", "ts": "", "user_id": "", "event_type": "", "value": "", "props": ""},
}
_STATS = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{own or c}' AS own, count(*) AS n, count(DISTINCT {own or c}) AS d FROM {t}" for t, cols in KEYED.items() for c, own in cols.items())
_NAMED = " ".join(f"WHEN regexp_matches(lower(c), '{pattern}')" + {"id": " AND dtype <> 'float'", "latitude": " AND false", "longitude": " AND false"}.get(role, "") + f" THEN '{role}'" for role, pattern in NAME_PATTERNS)


@register(f"""WITH s AS ({_STATS}), k AS (SELECT s.*, CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN data_type LIKE '%INT%' THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' ELSE 'string' END AS dtype
  FROM s JOIN duckdb_columns() x ON x.table_name = s.t AND x.column_name = s.own), r AS (SELECT *, CASE {_NAMED} END AS named FROM k)
SELECT t AS "table", c AS "column", dtype, coalesce(named, CASE WHEN dtype = 'timestamp' THEN 'timestamp' WHEN dtype = 'string' THEN CASE WHEN d > 0.95 * n THEN 'id' WHEN d <= 50 THEN 'category' ELSE 'free_text' END WHEN dtype = 'integer' AND d > 0.95 * n THEN 'id' ELSE 'measure' END) AS role,
  CASE WHEN named IS NOT NULL THEN 0.9 WHEN dtype = 'timestamp' THEN 0.8 WHEN dtype = 'string' THEN CASE WHEN d > 0.95 * n THEN 0.5 WHEN d <= 50 THEN 0.7 ELSE 0.4 END WHEN dtype = 'integer' AND d > 0.95 * n THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM r""")
def p4_roles(spark, sf_dir):
    """Semantic roles of all columns."""
    return profile.profile(keyed(spark, sf_dir)).select("table", "column", "dtype", "role", "confidence")


KEYS_SQL = """k AS (SELECT 'orders' AS t, 'cust_id' AS c, count(*) AS n, count(DISTINCT o_custkey) AS d FROM orders UNION ALL SELECT 'customer', 'cust_id', count(*), count(DISTINCT c_custkey) FROM customer
  UNION ALL SELECT 'customer', 'nation_id', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'nation', 'nation_id', count(*), count(DISTINCT n_nationkey) FROM nation),
o AS (SELECT c, t FROM k WHERE d >= 0.9 * n QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, t) = 1)
SELECT k.t AS from_table, k.c AS from_column, o.t AS to_table, o.c AS to_column FROM k JOIN o ON k.c = o.c AND k.t <> o.t"""


@register(f"WITH {KEYS_SQL}")
def p5_relations(spark, sf_dir):
    """P5: relations over equal id columns."""
    return profile.relations(profile.profile(keyed(spark, sf_dir)))


@register("SELECT c_custkey, c_nationkey AS nation_id, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def p6_labels(spark, sf_dir):
    """Labels of a small master."""
    t = keyed(spark, sf_dir)
    child = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_id"))
    return profile.resolve_labels(child, [(t["nation"], "nation_id", "n_name")])


@register("""SELECT t AS "table" FROM (SELECT 'orders' AS t, count(*) AS n, 1 AS timed FROM orders UNION ALL SELECT 'events', count(*), 1 FROM events
UNION ALL SELECT 'customer', count(*), 0 FROM customer UNION ALL SELECT 'nation', count(*), 0 FROM nation) ORDER BY timed DESC, n DESC, t LIMIT 1""")
def p8_primary_table(spark, sf_dir):
    """The main table."""
    return profile.primary_table(profile.profile(keyed(spark, sf_dir)))


@register(f"""WITH {CASES_SQL} SELECT * FROM (VALUES ('kpi', 'total_records', 'count', CAST(NULL AS VARCHAR)), ('kpi', 'active_areas', 'distinct', 'district'), ('timeseries', 'trend', 'count', 'ts'),
('bar', 'by_category', 'count', 'category'), ('bar', 'by_area', 'count', 'district')) v(kind, id, aggregate, "column")
UNION ALL SELECT 'map_heat', 'map', 'count', NULL FROM cases HAVING min(lat) >= -90 AND max(lat) <= 90 AND min(lng) >= -180 AND max(lng) <= 180""")
def p9_suggestions(spark, sf_dir):
    """Key figures and charts from roles."""
    renamed = cases(spark, sf_dir).withColumnRenamed("area", "district")
    return profile.suggestions(profile.profile({"cases": renamed}), "cases")


@register(f"""WITH {CASES_SQL}, d AS (SELECT area, category, status FROM cases)
SELECT c AS "column", (SELECT count(*) FROM d) AS rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, 0.0::DOUBLE AS null_pct, list_sort(v).len() AS "distinct",
       list_sort(v)[1:5] AS samples, 0.0::DOUBLE AS date_parse_rate, 0.0::DOUBLE AS phone_like_rate, list_sort(v) AS "values"
FROM (SELECT 'area' AS c, list(DISTINCT area) AS v FROM d UNION ALL SELECT 'category', list(DISTINCT category) FROM d UNION ALL SELECT 'status', list(DISTINCT status) FROM d)""")
def p11_digest(spark, sf_dir):
    """A digest over all rows."""
    return profile.digest(cases(spark, sf_dir).select("area", "category", "status"))


def messy(spark, sf_dir):
    """Orders as texts in changing formats."""
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 2, F.date_format(d, "dd-MM-yyyy")).when(k % 5 == 3, F.date_format(d, "dd.MM.yyyy")).otherwise(F.lit("unknown"))
    ten = F.lpad(((k * 7919) % 1_000_000).cast("string"), 10, "9")
    phone = F.when(k % 5 == 0, ten).when(k % 5 == 1, F.concat(F.lit("+91 "), ten)).when(k % 5 == 2, F.concat(F.lit("0"), ten)).when(k % 5 == 3, F.lit("")).otherwise(F.lit("123"))
    whole = F.floor("o_totalprice").cast("string")
    money = F.when(k % 5 == 0, F.concat(F.lit("₹"), whole)).when(k % 5 == 1, F.concat(F.lit("Rs."), whole)).when(k % 5 == 2, F.concat(F.lit("  "), whole, F.lit(".50 "))).when(k % 5 == 3, F.lit("abc")).otherwise(whole)
    kind = F.when(k % 3 == 0, F.upper("o_orderpriority")).when(k % 3 == 1, F.concat(F.lit("  "), F.lower("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    return o.select(k.alias("id"), date.alias("date"), phone.alias("phone"), money.alias("money"), kind.alias("kind"), "o_custkey")


MESSY_SQL = """m AS (SELECT o_orderkey AS id, o_orderdate, o_custkey,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'unknown' END AS date,
  lpad(CAST((o_orderkey * 7919) % 1000000 AS VARCHAR), 10, '9') AS ten, CAST(floor(o_totalprice)::BIGINT AS VARCHAR) AS whole,
  CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN '  ' || lower(o_orderpriority) ELSE o_orderpriority END AS kind FROM orders)"""


@register(f"WITH {MESSY_SQL} SELECT id, CASE WHEN id % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM m")
def c1_dates(spark, sf_dir):
    """Mixed date formats."""
    return cleaning.normalize_dates(messy(spark, sf_dir), "date", "id").clean.select("id", "date")


@register(f"WITH {MESSY_SQL} SELECT CAST(id AS VARCHAR) AS row_key, 'date' AS \"column\", 'unparseable date' AS reason, date AS value FROM m WHERE id % 5 = 4")
def c1_quarantine(spark, sf_dir):
    """What is no date."""
    return cleaning.normalize_dates(messy(spark, sf_dir), "date", "id").quarantine


@register(f"WITH {MESSY_SQL} SELECT id, CASE WHEN id % 5 < 3 THEN '+91' || ten WHEN id % 5 = 3 THEN NULL ELSE '123' END AS phone FROM m")
def c2_phones(spark, sf_dir):
    """Phone numbers."""
    return cleaning.normalize_phones(messy(spark, sf_dir), "phone", "id").clean.select("id", "phone")


@register(f"WITH {MESSY_SQL} SELECT id, CASE id % 5 WHEN 3 THEN NULL WHEN 2 THEN CAST(whole AS DOUBLE) + 0.5 ELSE CAST(whole AS DOUBLE) END AS money FROM m")
def c3_money(spark, sf_dir):
    """Amounts."""
    return cleaning.normalize_money(messy(spark, sf_dir), "money", "id").clean.select("id", "money")


AUTO_SQL = f"""{MESSY_SQL}, n AS (SELECT lower(trim(kind)) AS value_key, trim(kind) AS spelling, count(*) AS n FROM m GROUP BY ALL),
a AS (SELECT value_key, spelling AS canonical FROM n QUALIFY row_number() OVER (PARTITION BY value_key ORDER BY n DESC, spelling) = 1)"""


@register(f"WITH {AUTO_SQL} SELECT * FROM a")
def c4_auto_value_map(spark, sf_dir):
    """C4: the commonest spellings."""
    return cleaning.auto_value_map(messy(spark, sf_dir), "kind")


@register()
def c5_fuzzy_value_map(spark, sf_dir):
    """Values mapped to a given list by likeness."""
    return cleaning.build_value_map(messy(spark, sf_dir), "kind", ["Urgent", "High", "Medium", "Not specified", "Low"], 70.0)


@register("""WITH n AS (SELECT upper(translate(md5(n_name)[1:14], '0123456789', 'ghijklmnop')) AS n_name, lower(translate(md5(n_name)[1:14], '0123456789', 'ghijklmnop')) AS name, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT n_name, CASE WHEN k % 4 = 1 THEN name[1:1 + k // 4 % len(name)] || 'z' || name[2 + k // 4 % len(name):] WHEN k % 4 = 2 AND len(name) > 5 THEN name[1:k // 4 % len(name)] || name[2 + k // 4 % len(name):]
  WHEN k % 4 = 3 THEN 'country of ' || name ELSE name END AS value FROM n)
SELECT DISTINCT trim(regexp_replace(value, ' +', ' ', 'g')) AS value_key, n_name AS canonical FROM v""")
def c5_planted_values(spark, sf_dir):
    """Names (of nations, in other letters) with a letter more, a letter less or more words, mapped back."""
    letters = F.upper(F.translate(F.substring(F.md5("n_name"), 1, 14), "0123456789", "ghijklmnop"))
    nation = table(spark, sf_dir, "nation").withColumn("n_name", letters)
    names = [r.n_name for r in nation.select("n_name").orderBy("n_nationkey").collect()]
    name, k = F.lower("n_name"), F.col("c_custkey")
    at = (F.floor(k / 4) % F.length(name)).cast("int")
    rest = lambda i: name.substr(i, F.length(name))
    written = F.when(k % 4 == 1, F.concat(name.substr(F.lit(1), at + 1), F.lit("z"), rest(at + 2))).when((k % 4 == 2) & (F.length(name) > 5), F.concat(name.substr(F.lit(1), at), rest(at + 2)))
    written = written.when(k % 4 == 3, F.concat(F.lit("country of "), name)).otherwise(name)
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return cleaning.build_value_map(rows.select(written.alias("value")), "value", names, 70.0)


@register(f"WITH {AUTO_SQL} SELECT id, canonical AS kind FROM m JOIN a ON lower(trim(kind)) = value_key")
def c6_standardized(spark, sf_dir):
    """Values replaced by their common spelling."""
    return cleaning.standardize_values(messy(spark, sf_dir), "kind", "id").clean.select("id", "kind")


def written_names(spark, sf_dir):
    """Customers under names of letters, three at a time nearly alike."""
    k = F.col("c_custkey")
    letters = F.translate(F.md5(F.floor(k / 3).cast("string")), "0123456789", "ghijklmnop")
    name = F.concat(F.upper(F.substring(letters, 1, 10)), F.when(k % 3 == 0, F.lit("  -")).otherwise(F.lit(" ")), F.substring(letters, 11, 10), F.when(k % 3 == 1, F.lit(" A.")).otherwise(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.pmod(F.floor(k / 6), F.lit(7)).cast("string").alias("place"))


NAMES_SQL = """nm AS (SELECT c_custkey, translate(md5(CAST(c_custkey // 3 AS VARCHAR)), '0123456789', 'ghijklmnop') AS l, CAST(c_custkey // 6 % 7 AS VARCHAR) AS place FROM customer),
nn AS (SELECT c_custkey, place, upper(l[1:10]) || CASE WHEN c_custkey % 3 = 0 THEN '  -' ELSE ' ' END || l[11:20] || CASE WHEN c_custkey % 3 = 1 THEN ' A.' ELSE '' END AS name FROM nm)"""


@register(f"""WITH {NAMES_SQL} SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(name), '[^\\pL\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM nn""")
def c7_names(spark, sf_dir):
    """Names in letters and single spaces."""
    return written_names(spark, sf_dir).select("c_custkey", norm_name(F.col("name")).alias("name"))


@register(f"""WITH {NAMES_SQL} SELECT c_custkey, name, place, 'PC' || CAST(min(c_custkey) OVER (PARTITION BY c_custkey // 3) AS VARCHAR) AS person_canonical FROM nn""")
def c8_persons(spark, sf_dir):
    """customers' names as persons of a place."""
    return cleaning.resolve_persons(written_names(spark, sf_dir), "name", "c_custkey", "place").clean


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000")
def c9_valid_range(spark, sf_dir):
    """Rows out of range dropped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cleaning.handle_missing(o, "o_totalprice", "o_orderkey", "drop", True, (1000, 150000)).clean


@register("SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'out of range' AS reason FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 150000")
def c9_flagged(spark, sf_dir):
    """Rows out of range flagged, all of them kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cleaning.handle_missing(o, "o_totalprice", "o_orderkey", "flag", True, (1000, 150000)).quarantine.select("row_key", "reason")


@register("SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 150000 THEN o_totalprice ELSE 0.0 END::DOUBLE AS o_totalprice FROM orders")
def c9_imputed(spark, sf_dir):
    """Values out of range replaced."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cleaning.handle_missing(o, "o_totalprice", "o_orderkey", "impute", True, (1000, 150000), fill=0.0).clean


@register("SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'o_custkey' AS \"column\", 'duplicate' AS reason FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1")
def c10_quarantine(spark, sf_dir):
    """The later orders of each customer."""
    return cleaning.dedupe_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").quarantine.select("row_key", "column", "reason")


@register("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def c10_deduped(spark, sf_dir):
    """The first order of each customer."""
    return cleaning.dedupe_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").clean


@register(f"WITH {MESSY_SQL} SELECT \"column\", op, count(*) AS n FROM (SELECT 'date' AS \"column\", 'normalize_dates' AS op FROM m WHERE id % 5 > 0 UNION ALL SELECT 'phone', 'normalize_phones' FROM m WHERE id % 5 < 4) GROUP BY ALL")
def c11_plan_changes(spark, sf_dir):
    """C11: the audit of a plan, by step."""
    plan = [{"op": "normalize_dates", "column": "date"}, {"op": "no_such_step"}, {"op": "normalize_phones", "column": "phone"}, {"op": "normalize_money", "column": "no_such_column"}]
    return cleaning.execute_plan(messy(spark, sf_dir), plan, "id").changes.groupBy("column", "op").agg(F.count("*").alias("n"))


@register(f"""WITH {AUTO_SQL} SELECT m.id, CASE WHEN m.id % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE m.id % 5 WHEN 0 THEN ten WHEN 1 THEN '+91 ' || ten WHEN 2 THEN '0' || ten WHEN 3 THEN '' ELSE '123' END AS phone,
  CASE m.id % 5 WHEN 0 THEN '₹' || whole WHEN 1 THEN 'Rs.' || whole WHEN 2 THEN '  ' || whole || '.50 ' WHEN 3 THEN 'abc' ELSE whole END AS money, canonical AS kind, o_custkey
FROM m JOIN a ON lower(trim(kind)) = value_key""")
def c12_planned_cleaning(spark, sf_dir):
    """The plan that a digest suggests, carried out."""
    m = messy(spark, sf_dir)
    return cleaning.execute_plan(m, cleaning.plan_from_digest(profile.digest(m), "id"), "id").clean


@register("SELECT 4.0::DOUBLE * count(*) FILTER (o_orderkey % 5 < 4) / count(*) / 4 AS rate, count(*) AS rows FROM orders")
def c13_recovery(spark, sf_dir):
    """The share of dates that cleaning gets right."""
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return cleaning.recovery(cleaning.normalize_dates(messy(spark, sf_dir), "date", "id").clean, truth, "id", "date")


def halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1").withColumn("extra", F.lit(1))


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def m3_new_by_id(spark, sf_dir):
    """M2, M3: incoming rows with new ids."""
    stored, incoming = halves(spark, sf_dir)
    return merge.new_by_id(merge.align(incoming, stored)[0], stored, "o_orderkey")


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def m4_new_by_row(spark, sf_dir):
    """M4: incoming rows that are new as a whole."""
    stored, incoming = halves(spark, sf_dir)
    return merge.new_by_row(merge.align(incoming, stored)[0], stored)


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def m5_appended(spark, sf_dir):
    """M5: the table after an append."""
    stored, incoming = halves(spark, sf_dir)
    return merge.append(incoming, stored, RoleMap({"o_orderkey": "id"})).table


@register(f"SELECT * FROM (WITH {KEYS_SQL}) WHERE 'orders' IN (from_table, to_table)")
def m6_links(spark, sf_dir):
    """M6: relations of a new table."""
    return merge.link_new_table(profile.profile(keyed(spark, sf_dir)), "orders")


