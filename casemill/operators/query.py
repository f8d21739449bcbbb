"""Aggregate queries over any table: filters, time buckets, groups, measures, order and limit."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.expressions import try_ts
from casemill.functions.roles import RoleMap

GRAINS = ("hour", "day", "week", "month", "year")
PARTS = ("hour", "dayofweek", "month")
AGGREGATES = ("count", "sum", "avg", "min", "max", "distinct")
MOST_ROWS, MOST_RECORDS = 10_000, 500


@dataclass
class Query:
    """dimensions: columns, or hour(c), dayofweek(c), month(c). measures: (aggregate, column or None)."""

    dimensions: list[str] = field(default_factory=list)
    time_dimension: str | None = None
    time_grain: str = "day"
    measures: list[tuple[str, str | None]] = field(default_factory=lambda: [("count", None)])
    filters: dict[str, Any] = field(default_factory=dict)
    order_by: str | None = None
    desc: bool = True
    limit: int = MOST_ROWS


def known(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    return column


def bucket(df: DataFrame, column: str, grain: str) -> Column:
    """The start of a timestamp's hour, day, week (from Monday), month or year."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return F.date_trunc(grain, try_ts(df, known(df, column))).cast("timestamp_ntz")


def dimension(df: DataFrame, text: str) -> Column:
    """A column, or a date part of one; days of the week count from Sunday = 0."""
    part, _, rest = text.partition("(")
    if rest.endswith(")") and part in PARTS:
        ts = try_ts(df, known(df, rest[:-1]))
        return {"hour": F.hour(ts), "dayofweek": F.dayofweek(ts) - 1, "month": F.month(ts)}[part].alias(f"{part}_{rest[:-1]}")
    return F.col(known(df, text))


def measure(df: DataFrame, kind: str, column: str | None) -> Column:
    if kind not in AGGREGATES:
        raise ValueError(f"unknown aggregate {kind!r}")
    if column is None:
        if kind != "count":
            raise ValueError(f"{kind} needs a column")
        return F.count("*").alias("count")
    c = F.col(known(df, column))
    made = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "distinct": F.countDistinct}[kind](c)
    return made.alias(f"{kind}_{column}")


def filtered(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Scalar: equal; list: one of; {"from", "to"}: between, both ends included. All must hold."""
    for column, want in filters.items():
        c = F.col(known(df, column))
        if isinstance(want, dict):
            if want.get("from") is not None:
                df = df.filter(c >= F.lit(want["from"]))
            if want.get("to") is not None:
                df = df.filter(c <= F.lit(want["to"]))
        elif isinstance(want, (list, tuple)):
            df = df.filter(c.isin(list(want)) if len(want) else F.lit(False))
        else:
            df = df.filter(c == F.lit(want))
    return df


def run(df: DataFrame, q: Query) -> DataFrame:
    """The result of a query; nulls sort last either way."""
    rows = filtered(df, q.filters)
    keys = [dimension(df, d) for d in q.dimensions]
    if q.time_dimension:
        keys = [bucket(df, q.time_dimension, q.time_grain).alias("period"), *keys]
    values = [measure(df, *m) for m in (q.measures or [("count", None)])]
    out = rows.groupBy(*keys).agg(*values) if keys else rows.agg(*values)
    order = q.order_by or ("period" if q.time_dimension else None)
    if order:
        if order not in out.columns:
            raise ValueError(f"unknown order {order!r}")
        down = q.desc if q.order_by else False
        ties = [F.col(c).asc_nulls_last() for c in out.columns if c != order]
        out = out.orderBy(F.col(order).desc_nulls_last() if down else F.col(order).asc_nulls_last(), *ties)
    return out.limit(min(q.limit, MOST_ROWS))


def records(df: DataFrame, filters: dict[str, Any], limit: int = MOST_RECORDS, order: list[str] | None = None) -> DataFrame:
    """Raw rows with timestamps as text; in the order of all columns unless one is given."""
    rows = filtered(df, filters).orderBy(*[F.col(c).asc_nulls_last() for c in (order or df.columns)]).limit(min(limit, MOST_RECORDS))
    return rows.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if k.startswith("timestamp") else F.col(c) for c, k in df.dtypes])


@dataclass
class Kpi:
    id: str
    aggregate: str = "count"
    column: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)


def kpis(df: DataFrame, specs: list[Kpi], filters: dict[str, Any] | None = None, own_filters_win: bool = True) -> DataFrame:
    """id, value: all key figures in one pass, each over the rows that its filters and the common ones keep."""
    values, kept = [], []
    for s in specs:
        merged = {**(filters or {}), **s.filters} if own_filters_win else {**s.filters, **(filters or {})}
        keep = F.lit(True)
        for column, want in merged.items():
            c = F.col(known(df, column))
            if isinstance(want, dict):
                keep &= (c >= F.lit(want["from"]) if want.get("from") is not None else F.lit(True)) & (c <= F.lit(want["to"]) if want.get("to") is not None else F.lit(True))
            else:
                keep &= c.isin(list(want)) if isinstance(want, (list, tuple)) else c == F.lit(want)
        kept.append(keep if merged else None)
        x = F.when(keep, F.col(s.column) if s.column else F.lit(1))
        made = {"count": F.count, "sum": F.sum, "avg": F.avg, "distinct": F.countDistinct}[s.aggregate](x)
        values.append(F.struct(F.lit(s.id).alias("id"), made.cast("double").alias("value")))
    if kept and all(k is not None for k in kept):  # rows that no figure counts needn't be read; what all have in common reaches the scan
        df = df.filter(reduce(operator.or_, kept))
    return df.agg(F.array(*values).alias("k")).select(F.inline("k"))


def chart(df: DataFrame, column: str, kind: str = "bar", limit: int = 12) -> DataFrame:
    """A weekly series, or the largest bars."""
    if kind == "timeseries":
        return run(df, Query(time_dimension=column, time_grain="week"))
    return run(df, Query(dimensions=[column], order_by="count", limit=limit))


def centroids(df: DataFrame, roles: RoleMap, values: DataFrame, value: str, limit: int = 200) -> DataFrame:
    """area, lat, lng, value, weight: mean places of the areas of ``values`` (area, value), weighted by the largest."""
    place = df.groupBy(F.col(roles.area).alias("area")).agg(F.avg(roles.first("latitude")).alias("lat"), F.avg(roles.first("longitude")).alias("lng"))
    place = place.orderBy("area").limit(limit)
    top = values.agg(F.greatest(F.max(value).cast("double"), F.lit(0.001)).alias("__top"))
    own = values.crossJoin(F.broadcast(top)).select("area", F.col(value).cast("double").alias("value"), (F.col(value) / F.col("__top")).alias("weight"))
    return own.join(place, "area").select("area", "lat", "lng", "value", "weight")


def per_capita_ranking(risk: DataFrame, limit: int = 8) -> DataFrame:
    """Areas of a risk table by their rate for each 100,000 people."""
    return risk.orderBy(F.coalesce("per_lakh", F.lit(0.0)).desc(), "area").limit(limit)
