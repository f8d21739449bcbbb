"""Profiles of tables: column statistics, semantic roles, relations, labels, entities and a digest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.functions.expressions import digits_only
from casemill.functions.roles import NAME_PATTERNS, RoleMap
from casemill.plans.lineage import cut

LABEL_ROWS = 2_000
# Name signals of a crime data set.
SIGNALS = ("fir", "crime", "offence", "accused", "victim", "police_station", "ipc", "bns", "modus", "complainant", "arrest")


def dtype_of(kind: T.DataType) -> str:
    """One of string, integer, float, timestamp, date, boolean."""
    for name, kinds in (("timestamp", (T.TimestampType, T.TimestampNTZType)), ("date", T.DateType), ("integer", T.IntegralType), ("float", (T.FractionalType,)), ("boolean", T.BooleanType)):
        if isinstance(kind, kinds):
            return name
    return "string"


def column_stats(df: DataFrame, table: str, approximate: bool = False) -> DataFrame:
    """table, column, position, dtype, row_count, null_fraction, distinct, lo, hi, mean: one row a column, from one pass.

    lo and hi are numbers; times count as seconds since 1970.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    out = []
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), dtype_of(f.dataType)
        number = c.cast("double") if kind in ("integer", "float") else F.unix_timestamp(c.cast("timestamp")).cast("double") if kind in ("timestamp", "date") else None
        aggs += [F.count(c).alias(f"n{i}"), distinct(c if not isinstance(f.dataType, T.MapType) else F.to_json(c)).alias(f"d{i}")]
        null = F.lit(None).cast("double")
        aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")] if number is not None else []
        aggs += [F.avg(number).alias(f"m{i}")] if kind in ("integer", "float") else []
        lo, hi = (F.col(f"lo{i}"), F.col(f"hi{i}")) if number is not None else (null, null)
        mean = F.round(f"m{i}", 4) if kind in ("integer", "float") else null
        nulls = F.when(F.col("rows") > 0, F.round(1 - F.col(f"n{i}") / F.col("rows"), 4)).otherwise(0.0)
        out.append(F.struct(F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(kind).alias("dtype"), F.col("rows").alias("row_count"), nulls.alias("null_fraction"), F.col(f"d{i}").alias("distinct"), lo.alias("lo"), hi.alias("hi"), mean.alias("mean")))
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def top_values(df: DataFrame, k: int = 10, most_distinct: int = 5_000) -> DataFrame:
    """column, value, n, rank: the commonest values of string columns that have few enough."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in texts]))).filter("value IS NOT NULL")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    few = n.groupBy("column").agg(F.count("*").alias("d")).filter(F.col("d") <= most_distinct).select("column")
    best = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return n.join(F.broadcast(few), "column").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)  # few: a row a column


def infer_roles(stats: DataFrame) -> DataFrame:
    """``stats`` with role and confidence: name patterns in order, then types and distinct shares."""
    name, kind = F.lower("column"), F.col("dtype")
    role: Column = F
    numeric = kind.isin("integer", "float")
    for own, pattern in NAME_PATTERNS:
        hit = name.rlike(pattern)
        if own in ("latitude", "longitude"):
            top = 90 if own == "latitude" else 180
            hit = hit & numeric & (F.col("lo") >= -top) & (F.col("hi") <= top)
        if own == "id":
            hit = hit & (kind != "float")
        role = role.when(hit, F.struct(F.lit(own).alias("role"), F.lit(0.9).alias("confidence")))
    share = F.try_divide(F.col("distinct"), F.col("row_count"))
    unique = F.coalesce(share > 0.95, F.lit(False))
    text = (kind == "string") & (F.col("row_count") > 0)
    for hit, own, sure in (
        (kind == "timestamp", "timestamp", 0.8), (kind == "date", "date", 0.8), (kind == "boolean", "boolean", 0.9),
        (text & unique, "id", 0.5), (text & (F.col("distinct") <= 50), "category", 0.7), (text, "free_text", 0.4),
        ((kind == "integer") & unique, "id", 0.5), (numeric, "measure", 0.6),
    ):
        role = role.when(hit, F.struct(F.lit(own).alias("role"), F.lit(sure).alias("confidence")))
    return stats.withColumn("__r", role.otherwise(F.struct(F.lit("other").alias("role"), F.lit(0.3).alias("confidence")))).select("*", "__r.role", "__r.confidence").drop("__r")


def role_map(profile: DataFrame, table: str) -> RoleMap:
    """The roles of one table, from its profile (a row a column)."""
    rows = profile.filter(F.col("table") == table).select("column", "role", "position").collect()
    return RoleMap({r.column: r.role for r in sorted(rows, key=lambda r: r.position)})


def profile(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Statistics and roles of all columns of all tables."""
    out = None
    for name, df in tables.items():
        own = column_stats(df, name, approximate)
        out = own if out is None else out.unionByName(own)
    return cut(infer_roles(out))


def relations(profile: DataFrame) -> DataFrame:
    """from_table, from_column, to_table, to_column: equal id columns, owned by the largest table that they tell apart."""
    ids = profile.filter(F.col("role").isin("id", "foreign_key"))
    shared = ids.withColumn("tables", F.count("*").over(W.partitionBy("column"))).filter("tables >= 2")
    near = F.col("distinct") >= 0.9 * F.col("row_count")
    own = shared.filter(near & (F.col("row_count") > 0)).withColumn("r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("row_count"), "table"))).filter("r = 1").select("column", F.col("table").alias("to_table"))
    return shared.join(own, "column").filter(F.col("table") != F.col("to_table")).select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table", F.col("column").alias("to_column"))


def relabelled(profile: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``profile`` with the roles that relations give: id for the column they point at, foreign_key for the others."""
    found = relations(profile) if found is None else found
    to = found.select(F.col("to_table").alias("table"), F.col("to_column").alias("column"), F.lit("id").alias("__new"))
    away = found.select(F.col("from_table").alias("table"), F.col("from_column").alias("column"), F.lit("foreign_key").alias("__new"))
    new = to.unionByName(away).groupBy("table", "column").agg(F.max("__new").alias("__new"))  # a row a key column
    return profile.join(F.broadcast(new), ["table", "column"], "left").withColumn("role", F.coalesce("__new", "role")).select(*profile.columns)


def resolve_labels(child: DataFrame, masters: list[tuple[DataFrame, str, str]], most_rows: int = LABEL_ROWS) -> DataFrame:
    """``child`` with the label of each small master: (master, key, label), joined on the key of the same name.

    A label that the child has already is skipped; one that two masters share gets the key's name added.
    """
    own = set(child.columns)
    taken: set[str] = set()
    for master, key, label in masters:
        if label in own or key not in child.columns or master.limit(most_rows + 1).count() > most_rows:
            continue
        name = f"{label}_{key}" if label in taken else label
        taken.add(label)
        labels = master.groupBy(F.col(key).alias("__key")).agg(F.min(label).alias(name))
        child = child.join(F.broadcast(labels), child[key] == F.col("__key"), "left").drop("__key")
    return child


def entities(profile: DataFrame) -> DataFrame:
    """table, entity, id_column, label_column, link_columns: tables of persons, by an id that recurs if there is one."""
    by = lambda *roles: F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), F.struct("position", "column"))))
    recurs = F.col("distinct") < 0.95 * F.col("row_count")
    ids = F.array_sort(F.collect_list(F.when(F.col("role").isin("id", "foreign_key"), F.struct((~recurs).alias("unique"), "position", "column"))))
    t = profile.groupBy("table").agg(ids.alias("ids"), by("person_name").alias("names"), by("phone", "address", "identifier").alias("links")).filter("size(ids) > 0 AND size(names) > 0")
    return t.select("table", F.regexp_replace("table", "s$", "").alias("entity"), F.col("ids")[0]["column"].alias("id_column"), F.col("names")[0]["column"].alias("label_column"), F.transform("links", lambda x: x["column"]).alias("link_columns"))


def primary_table(profile: DataFrame) -> DataFrame:
    """table: the largest one that has a time, or else the largest."""
    t = profile.groupBy("table").agg(F.max(F.col("role").isin("timestamp", "date").cast("int")).alias("timed"), F.max("row_count").alias("rows"))
    return t.orderBy(F.desc("timed"), F.desc("rows"), "table").limit(1).select("table")


def suggestions(profile: DataFrame, table: str) -> DataFrame:
    """kind, id, aggregate, column: key figures and charts that a table's roles allow."""
    roles = role_map(profile, table)
    rows = [("kpi", "total_records", "count", None)]
    if roles.area:
        rows.append(("kpi", "active_areas", "distinct", roles.area))
    if roles.first("money"):
        rows.append(("kpi", "total_value", "sum", roles.first("money")))
    if roles.time:
        rows.append(("timeseries", "trend", "count", roles.time))
    rows += [("bar", f"by_{c}", "count", c) for c in roles.all("category")[:3]]
    if roles.area:
        rows.append(("bar", "by_area", "count", roles.area))
    if roles.first("latitude") and roles.first("longitude"):
        rows.append(("map_heat", "map", "count", None))
    return profile.sparkSession.createDataFrame(rows, "kind string, id string, aggregate string, column string")


def domain_pack(profile: DataFrame, values: DataFrame, table: str) -> DataFrame:
    """More key figures for crime data (none if fewer than two signals occur in the names): id, column, values."""
    spark = profile.sparkSession
    schema = "id string, column string, values array<string>"
    names = " ".join(x for r in profile.select("table", "column").collect() for x in r).lower()  # a row a column
    if sum(s in names for s in SIGNALS) < 2:
        return spark.createDataFrame([], schema)
    roles = role_map(profile, table)
    status = roles.first("status")
    out = spark.createDataFrame([("hour_of_day", roles.time, None), ("network", None, None)], schema)
    if status:
        low = F.lower("value")
        own = values.filter(F.col("column") == status)
        for name, parts in (("open_cases", "open|pending|investigation"), ("pending_cases", "pending")):
            out = out.union(own.filter(low.rlike(parts)).agg(F.lit(name).alias("id"), F.lit(status).alias("column"), F.sort_array(F.collect_list("value")).alias("values")))
    for c in roles.columns:
        if "gravity" in c.lower():
            out = out.union(spark.createDataFrame([("heinous_cases", c, ["Heinous"])], schema))
    return out


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d/M/yyyy", "d-M-yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "d MMM yyyy", "dd MMM yyyy", "MMM d, yyyy", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm")


def _shape(pattern: str) -> str:
    """A regular expression of the texts that a date format can read."""
    parts = re.split(r"(y+|M+|d+|H+|m+|s+|'[^']*')", pattern)
    width = {"d": r"\d\d?", "M": r"\d\d?", "MMM": "[A-Za-z]{3}", "yyyy": r"\d{4}"}
    return "^" + "".join(p.strip("'") if p.startswith("'") else width.get(p, r"\d\d") if re.fullmatch(r"[yMdHms]+", p) else re.escape(p) for p in parts) + "$"


def parsed_date(c: Column) -> Column:
    """A text's date by the first format that fits; days come before months unless they cannot.

    A format is tried only on texts of its shape, as a failed try is costly.
    """
    text = F.trim(c)
    return F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]).cast("date")


def _whole_rows(df: DataFrame) -> DataFrame:
    """One row: the number of distinct rows, by two 64-bit hashes of their columns (maps as JSON)."""
    cols = [F.to_json(F.struct(c)) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])  # hashes pass over nulls
    both = df.select(F.xxhash64(nulls, *cols).alias("a"), F.xxhash64(F.lit(1), *cols, nulls).alias("b"))
    return both.distinct().agg(F.count("*").alias("whole"))


def digest(df: DataFrame) -> DataFrame:
    """column, rows, duplicate_rows, null_pct, distinct, samples, date_parse_rate, phone_like_rate, values.

    Values are counted first; dates and phone numbers are looked for in distinct values, weighted by their counts.
    """
    fields = df.schema.fields
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("value")) for i, f in enumerate(fields)])))
    counts = long.groupBy("i", "value").agg(F.count("*").alias("n"))
    text = F.col("i").isin([i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)])
    known = F.col("value").isNotNull()
    share = lambda hit: F.sum(F.when(text & known & hit, F.col("n")).otherwise(0)) / F.sum(F.when(known, F.col("n")))
    stats = counts.groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.count("value").alias("distinct"),
        share(parsed_date(F.col("value")).isNotNull()).alias("dates"), share(F.length(digits_only(F.col("value"))) == 10).alias("phones"),
    )
    first = counts.filter(known).withColumn("r", F.row_number().over(W.partitionBy("i").orderBy("value"))).filter("r <= 26")  # cut off before the shuffle
    values = first.groupBy("i").agg(F.sort_array(F.collect_list("value")).alias("v"))
    names = df.sparkSession.createDataFrame([(i, f.name, isinstance(f.dataType, T.StringType)) for i, f in enumerate(fields)], "i int, column string, is_text boolean")
    both = names.join(F.broadcast(stats), "i", "left").join(F.broadcast(values), "i", "left").crossJoin(F.broadcast(_whole_rows(df)))  # a row a column
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    nulls = F.when(rows > 0, F.round(1 - F.col("known") / rows, 3)).otherwise(0.0)
    rate = lambda c: F.when(F.col("is_text"), F.round(F.coalesce(c, F.lit(0.0)), 3))
    v, distinct = F.coalesce("v", F.array().cast("array<string>")), F.coalesce("distinct", F.lit(0))
    return both.select(
        "column", rows.alias("rows"), (rows - F.col("whole")).alias("duplicate_rows"), nulls.alias("null_pct"), distinct.alias("distinct"), F.slice(v, 1, 5).alias("samples"),
        rate("dates").alias("date_parse_rate"), rate("phones").alias("phone_like_rate"), F.when(distinct <= 25, v).alias("values"),
    )
