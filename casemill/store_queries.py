"""Registered queries on reading, writing, appending and watching tables: what was written is read again."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import functions as F

from casemill import queries as own
from casemill.bindings import CASE_ROLES, CASES_SQL, cases, table
from casemill.functions.roles import RoleMap
from casemill.operators import merge, profile, reports, signals, states, triage
from casemill.plans.lineage import checkpoint_dir, cut
from casemill.queries import register
from casemill.sources import tables
from casemill.streaming import sentinel


def place(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"


@register("SELECT o_orderkey AS order_key, o_orderstatus AS order_status, o_totalprice AS total_price_2, o_custkey AS total_price, o_orderdate AS order_date FROM orders")
def s2_csv(spark, sf_dir):
    """Orders written as CSV under names to clean, and read again with types."""
    at = place(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderdate")
    o.toDF(" Order Key", "ORDER-Status!", "total price", "Total_Price", "order date").write.option("header", True).csv(at)
    out = tables.read_csv(spark, at)
    return out.withColumns({"order_key": F.col("order_key").cast("long"), "total_price": F.col("total_price").cast("long"), "order_date": F.col("order_date").cast("timestamp_ntz")})


def workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet: numbers as numbers, texts in the sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def write_file(folder: str, name: str, content: bytes) -> str:
    """Writes a file of a shared folder from within a task."""
    if re.match(r"\w+:/", folder):
        fs, path = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
    else:
        fs, path = LocalFileSystem(), folder
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    return f"{folder}/{name}"


@register("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def s3_workbooks(spark, sf_dir):
    """S3: customers as workbooks of 5,000 keys each, written by the tasks, and all of them read again."""
    at = place(spark)
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]

    def write(key, pdf):
        content = workbook([tuple(names), *pdf[names].astype(object).itertuples(index=False, name=None)])
        return pd.DataFrame({"path": [write_file(at, f"{key[0]:012}.xlsx", content)]})

    block = F.floor(F.col("c_custkey") / 5_000).alias("block")
    table(spark, sf_dir, "customer").select(*names).groupBy(block).applyInPandas(write, "path string").write.parquet(f"{at}-written")
    return tables.read_xlsx(spark, f"{at}/*.xlsx")


@register("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL")
def s5_stored(spark, sf_dir):
    """A table stored under a cleaned name and asked by that name."""
    at = place(spark)
    tables.write_table(table(spark, sf_dir, "customer"), at, "My Customers!")
    tables.read_tables(spark, at, ["my_customers"])
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM my_customers GROUP BY c_mktsegment")


@register("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def s6_export(spark, sf_dir):
    """A result exported as CSV and read again."""
    at = place(spark)
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    tables.export_parts(c.groupBy("n_name").agg(F.count("*").alias("n")), at, ["n_name"], part_rows=10)
    return tables.read_parts(spark, at).withColumn("n", F.col("n").cast("long"))


@register("""SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS at, 'append ' || count(*) AS action, ['orders.parquet'] AS files, ['orders'] AS tables FROM orders
UNION ALL SELECT '1900-01-01', 'create ' || count(*), ['nation.parquet', 'region.parquet'], ['nation', 'region'] FROM nation""")
def s9_log(spark, sf_dir):
    """An ingest log of what was read, newest first."""
    at = place(spark)
    last = table(spark, sf_dir, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("d"), F.count("*").alias("n")).first()
    tables.log_event(spark, at, "1900-01-01", f"create {table(spark, sf_dir, 'nation').count()}", ["nation.parquet", "region.parquet"], ["nation", "region"])
    tables.log_event(spark, at, last.d, f"append {last.n}", ["orders.parquet"], ["orders"])
    return tables.read_log(spark, at)


@register("""SELECT r_name, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def s10_view(spark, sf_dir):
    """The fact table's view stands in for it in a query by name."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    wired = tables.wire_view(t, "orders", [("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")])
    wired["orders"].createOrReplaceTempView("orders_view")
    return spark.sql("SELECT r_name, o_orderstatus, count(*) AS n FROM orders_view GROUP BY r_name, o_orderstatus")


@register("""WITH own AS (SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('orders', 'lineitem', 'customer', 'nation', 'region')),
inc AS (SELECT 'upload' AS incoming, column_name FROM own WHERE table_name = 'orders' UNION ALL SELECT 'upload', 'note'
  UNION ALL SELECT 'lineitem', 'x' UNION ALL SELECT 'misc', column_name FROM own WHERE table_name = 'region' UNION ALL SELECT 'misc', unnest(['a', 'b', 'c'])),
j AS (SELECT i.incoming, o.table_name, count(*) FILTER (i.column_name = o.column_name) AS shared FROM inc i CROSS JOIN own o GROUP BY ALL),
l AS (SELECT j.*, shared / ((SELECT count(*) FROM inc WHERE inc.incoming = j.incoming) + (SELECT count(*) FROM own WHERE own.table_name = j.table_name) - shared) AS likeness FROM j)
SELECT incoming, coalesce(max(table_name) FILTER (table_name = incoming), max(table_name) FILTER (likeness >= 0.8)) AS matched FROM l GROUP BY incoming""")
def m1_match(spark, sf_dir):
    """M1: which stored table an incoming one belongs to, by name or by its columns."""
    stored = {n: table(spark, sf_dir, n).columns for n in ("orders", "lineitem", "customer", "nation", "region")}
    incoming = {"upload": [*(c.upper() for c in stored["orders"]), "note"], "lineitem": ["x"], "misc": [*stored["region"], "a", "b", "c"]}
    return spark.createDataFrame([(n, merge.match_table(n, c, stored)) for n, c in incoming.items()], "incoming string, matched string")


@register("""SELECT 'o_orderkey' AS "column", count(*) AS row_count, count(DISTINCT o_orderkey) AS "distinct", 'id' AS role FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), 'foreign_key' FROM orders
UNION ALL SELECT 'o_totalprice', count(*), count(DISTINCT o_totalprice), 'money' FROM orders""")
def m5_profile(spark, sf_dir):
    """M5: the profile after an append: new figures, old roles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored, incoming = o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1")
    out = merge.append(incoming, stored, RoleMap({"o_orderkey": "id", "o_custkey": "foreign_key", "o_totalprice": "money"}), name="orders")
    return out.profile.select("column", "row_count", "distinct", "role")


#: A column's figures in SQL: counts, ends and mean exactly, and that the sketches are near the truth.
_FIGURES = lambda c, source, mean: f"""SELECT '{c}' AS "column", count(*) AS row_count, round(1 - count({c}) / count(*), 4) AS null_fraction, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
{f"round(avg({c})::DOUBLE, 2)" if mean else "CAST(NULL AS DOUBLE)"} AS mean, true AS near, true AS middle FROM {source}"""  # noqa: E731


@register(" UNION ALL ".join(_FIGURES(c, "(SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS o_totalprice) FROM orders)", True) for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def m5_state(spark, sf_dir):
    """An append that reads the incoming rows, the id index and the stored state only; how near its sketches are."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("o_totalprice"))
    first, incoming = o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1")
    index = f"ids_{uuid.uuid4().hex}"
    states.store_ids(first, "o_orderkey", index)
    out = merge.append_to_state(incoming, first, states.profile_state(first, "orders"), index, "o_orderkey", RoleMap({"o_orderkey": "id"}), "orders")
    stats = states.stats_of(out.state)
    halves = {r["column"]: r["q50"] for r in stats.select("column", "q50").collect()}  # three numbers
    middle = states.between_percentiles(o, halves, 0.48, 0.52)
    truth = o.agg(*[F.countDistinct(c).alias(c) for c in o.columns])
    long = truth.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("d")) for c in o.columns])))
    met = stats.join(F.broadcast(long), stats["column"] == F.col("c")).join(F.broadcast(middle), "column")  # three rows
    near = F.abs(F.col("distinct") - F.col("d")) <= 0.02 * F.col("d")
    spark.sql(f"DROP TABLE {index}")
    return met.select("column", "row_count", "null_fraction", "lo", "hi", F.round("mean", 2).alias("mean"), near.alias("near"), F.col("between").alias("middle"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def m3_indexed(spark, sf_dir):
    """M3: new rows by an index of ids in hash buckets."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    index = f"ids_{uuid.uuid4().hex}"
    states.store_ids(o.filter("o_orderkey % 3 <> 0"), "o_orderkey", index)
    out = cut(states.new_ids(o, "o_orderkey", index))
    spark.sql(f"DROP TABLE {index}")
    return out


@register("""SELECT 'customer' AS "table", 'customer' AS entity, CASE WHEN count(DISTINCT c_nationkey) < 0.95 * count(*) THEN 'nation_id' ELSE 'cust_id' END AS id_column, 'c_name' AS label_column, CAST([] AS VARCHAR[]) AS link_columns FROM customer
UNION ALL SELECT 'nation', 'nation', 'nation_id', 'n_name', [] FROM nation HAVING count(DISTINCT n_nationkey) > 0.95 * count(*)
UNION ALL SELECT 'supplier_contacts', 'supplier_contact', 'supplier_no', 's_name', ['contact_no'] FROM supplier HAVING count(*) > 0""")
def p7_entities(spark, sf_dir):
    """Tables of named things, after relations have set the roles of keys."""
    s = table(spark, sf_dir, "supplier")
    contacts = s.select(F.col("s_suppkey").alias("supplier_no"), "s_name", F.lpad((F.col("s_suppkey") * 7919 % 1_000_000).cast("string"), 10, "9").alias("contact_no"))
    rename = lambda n, **names: table(spark, sf_dir, n).withColumnsRenamed(names)
    t = {"customer": rename("customer", c_custkey="cust_id", c_nationkey="nation_id"), "nation": rename("nation", n_nationkey="nation_id"), "orders": rename("orders", o_custkey="cust_id"), "supplier_contacts": contacts}
    return profile.entities(profile.relabelled(profile.profile(t)))


@register("""SELECT 'customer' AS "table", 'cust_id' AS "column", 'id' AS role FROM customer HAVING count(DISTINCT c_custkey) >= 0.9 * count(*)
UNION ALL SELECT 'orders', 'cust_id', 'foreign_key' FROM orders HAVING count(*) > 0""")
def p5_relabelled(spark, sf_dir):
    """P5: the roles that relations give to keys."""
    t = {"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cust_id"), "orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "cust_id")}
    return profile.relabelled(profile.profile(t)).filter("column = 'cust_id'").select("table", "column", "role")


@register("""WITH v AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'Charge sheeted' WHEN 'P' THEN 'Pending Trial' ELSE 'Under Investigation' END AS s FROM orders)
SELECT 'hour_of_day' AS id, 'ts' AS "column", CAST(NULL AS VARCHAR[]) AS "values" UNION ALL SELECT 'network', NULL, NULL
UNION ALL SELECT 'open_cases', 'status', (SELECT list_sort(list(s)) FROM v WHERE s ILIKE '%pending%' OR s ILIKE '%investigation%')
UNION ALL SELECT 'pending_cases', 'status', (SELECT list_sort(list(s)) FROM v WHERE s ILIKE '%pending%')""")
def p10_domain_pack(spark, sf_dir):
    """P10: further key figures for cases with crime columns."""
    status = F.when(F.col("status") == "F", "Charge sheeted").when(F.col("status") == "P", "Pending Trial").otherwise("Under Investigation")
    c = cases(spark, sf_dir).withColumn("status", status).withColumnsRenamed({"case_id": "fir_no", "category": "crime_group"})
    return profile.domain_pack(profile.profile({"cases": c}), profile.top_values(c.select("status")), "cases")


@register("""SELECT 'shipments' AS "table", 'disposal_date' AS "column" FROM orders HAVING count(DISTINCT o_orderkey) >= 0.9 * count(*)""")
def l8_resolution_table(spark, sf_dir):
    """The table and date that say when a case was resolved."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("disposal_date"), F.col("l_linenumber").alias("line"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"))
    p = profile.profile({"orders": o, "shipments": li})
    # of the shipments' order_id few values are distinct, so it is named as a key by its name alone
    links = profile.relations(p.withColumn("role", F.when(F.col("column") == "order_id", F.lit("id")).otherwise(F.col("role"))))
    return triage.resolution_table(p, links, "orders")


@register(f"""WITH {CASES_SQL}, halves AS (SELECT *, case_id % 2 AS half FROM cases), daily AS (SELECT half, area, category, ts::DATE AS day, count(*) AS n FROM halves GROUP BY ALL),
s AS (SELECT half, area, category, avg(n) FILTER (day < hi - 28) AS mu, stddev_samp(n) FILTER (day < hi - 28) AS sd, count(*) FILTER (day < hi - 28) AS days, avg(n) FILTER (day >= hi - 28) AS now
  FROM daily JOIN (SELECT half, max(day) AS hi FROM daily GROUP BY half) USING (half) GROUP BY ALL)
SELECT CASE half WHEN 0 THEN 'even' ELSE 'odd' END AS dataset, least(50, count(*) FILTER (days >= 30 AND now IS NOT NULL AND (now - mu) / greatest(coalesce(sd, 0), 0.5) >= -0.5)) AS alerts FROM s GROUP BY half""")
def r3_scan(spark, sf_dir):
    """New alerts of several data sets; one of them fails while its job runs and stops nothing."""
    none = spark.createDataFrame([], "area string, category string")

    def alerts(half):
        c = cases(spark, sf_dir).filter(F.col("case_id") % 2 == half)
        daily = signals.daily_counts(c, "ts", {"area": "area", "category": "category"})
        return reports.new_alerts(daily, ["area", "category"], none, z_threshold=-0.5)

    def broken():
        return cases(spark, sf_dir).filter(F.when(F.col("case_id") > 0, F.raise_error(F.concat(F.lit("bad case "), "case_id"))).isNull())

    out, failed = reports.scan_all(spark, {"even": lambda: alerts(0), "broken": broken, "odd": lambda: alerts(1)})
    if set(failed) != {"broken"}:
        raise RuntimeError(f"other data sets failed: {failed}")
    return out


@register(f"""WITH {CASES_SQL} SELECT area, category, count(*) AS n, count(*) FILTER (case_id % 10 = 0) AS without_id FROM cases GROUP BY ALL""")
def st1_sentinel(spark, sf_dir):
    """ST1: cases arrive three times as a stream; each batch is appended. Cases without an id stay, known ids come once."""
    at = place(spark)
    c = cases(spark, sf_dir).withColumn("case_id", F.when(F.col("case_id") % 10 != 0, F.col("case_id")))
    for i in range(3):
        part = F.pmod(F.hash("ts", "area"), F.lit(3))  # the first file's known ids come again with the last one
        again = (part == i) | ((part == 0) & F.col("case_id").isNotNull()) if i == 2 else part == i
        c.filter(again).write.mode("append").parquet(f"{at}/in")
        # it works off what is there and stops, and goes on from there the next time
        sentinel.start(spark, f"{at}/in", c.schema, f"{at}/cases", f"{at}/alerts", f"{at}/offsets", CASE_ROLES, every=None).awaitTermination()
    return spark.read.parquet(f"{at}/cases").groupBy("area", "category").agg(F.count("*").alias("n"), F.count_if(F.col("case_id").isNull()).alias("without_id"))


@register(f"SELECT area, category, day, n FROM ({own.ORACLE_SQL['a2_daily_counts']})")
def st1_daily(spark, sf_dir):
    """ST1: the daily counts that the sentinel keeps, a partition a batch, add up to those of all cases."""
    at = place(spark)
    c = cases(spark, sf_dir)
    for i in range(2):
        c.filter(F.col("case_id") % 2 == i).write.mode("append").parquet(f"{at}/in")
        sentinel.start(spark, f"{at}/in", c.schema, f"{at}/cases", f"{at}/alerts", f"{at}/offsets", CASE_ROLES, every=None).awaitTermination()
    return spark.read.parquet(f"{at}/cases_daily").groupBy("area", "category", "day").agg(F.sum("n").alias("n"))
