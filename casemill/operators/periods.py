"""Period comparison: a window against the equally long one before it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.expressions import pct_delta, try_ts
from casemill.functions.roles import RoleMap
from casemill.plans.lineage import stored

MOST_DAYS, MOST_FRAMES, MOST_CELLS, MOST_GROUPS = 366, 60, 500, 100


class Window:
    """[start, end) and the window of the same length before it."""

    def __init__(self, start: str, end: str):
        self.start, self.end = datetime.fromisoformat(start), datetime.fromisoformat(end)
        if not self.start < self.end:
            raise ValueError("the window ends before it starts")
        if self.end - self.start > timedelta(days=MOST_DAYS):
            raise ValueError(f"a window has at most {MOST_DAYS} days")
        self.before = self.start - (self.end - self.start)


def _at(t: datetime) -> Column:
    """A time without zone; a datetime as such would be read in the session's zone."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def in_windows(df: DataFrame, roles: RoleMap, w: Window, area: str | None = None, category: str | None = None) -> DataFrame:
    """The rows of both windows with __ts and __now (whether in the current one); filters compare as text."""
    for role, want in (("admin_area_1", area), ("category", category)):
        if want is not None and roles.first(role):
            df = df.filter(F.col(roles.first(role)).cast("string") == want)
    rows = df.withColumn("__ts", try_ts(df, roles.time)).filter((F.col("__ts") >= _at(w.before)) & (F.col("__ts") < _at(w.end)))
    return rows.withColumn("__now", F.col("__ts") >= _at(w.start))


def compare(df: DataFrame, roles: RoleMap, w: Window, version: str = "", area: str | None = None, category: str | None = None) -> DataFrame:
    """current, previous, change, percent_change, available, evidence: one row."""
    rows = in_windows(df, roles, w, area, category)
    out = rows.agg(F.count_if("__now").alias("current"), F.count_if(~F.col("__now")).alias("previous"))
    request = "|".join(map(str, (w.start.isoformat(), w.end.isoformat(), area or "", category or "", version)))
    return out.select("current", "previous", (F.col("current") - F.col("previous")).alias("change"), pct_delta(F.col("current"), F.col("previous")).alias("percent_change"), (F.col("previous") > 0).alias("available"), F.sha2(F.lit(request), 256).alias("evidence"))


def deltas(df: DataFrame, roles: RoleMap, w: Window, by: str, limit: int = MOST_GROUPS) -> DataFrame:
    """key, current, previous, change for each value of a column, by change."""
    rows = in_windows(df, roles, w)
    out = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias("key")).agg(F.count_if("__now").alias("current"), F.count_if(~F.col("__now")).alias("previous"))
    return out.withColumn("change", F.col("current") - F.col("previous")).orderBy(F.desc("change"), "key").limit(limit)


def _frames(w: Window, frame_days: int) -> list[tuple[int, datetime, datetime]]:
    out, at = [], w.start
    while at < w.end:
        out.append((len(out), at, min(at + timedelta(days=frame_days), w.end)))
        at += timedelta(days=frame_days)
    if len(out) > MOST_FRAMES:
        raise ValueError(f"a comparison has at most {MOST_FRAMES} frames")
    return out


_DAY = 86_400_000_000


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone since 1970, by its parts: no session zone has a say in it."""
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * _DAY + seconds


def frames(df: DataFrame, roles: RoleMap, w: Window, frame_days: int) -> DataFrame:
    """frame, start, end, n: all frames of the window; the last one ends with it."""
    spark = df.sparkSession
    every = F.broadcast(spark.createDataFrame(_frames(w, frame_days), "frame int, start timestamp_ntz, end timestamp_ntz"))
    rows = in_windows(df, roles, w).filter("__now")
    since = _micros(F.col("__ts")) - _micros(_at(w.start))  # frames are [start, end), whatever the time of day
    n = rows.groupBy(F.floor(since / (frame_days * _DAY)).cast("int").alias("frame")).agg(F.count("*").alias("n"))
    return every.join(n, "frame", "left").select("frame", "start", "end", F.coalesce("n", F.lit(0)).alias("n")).orderBy("frame")


def frame_cells(df: DataFrame, roles: RoleMap, w: Window, frame_days: int) -> DataFrame:
    """frame, lat, lng, n, previous, kind: the frame's cells against the equally long time before the frame."""
    lat, lng = roles.first("latitude"), roles.first("longitude")
    every = _frames(w, frame_days)
    rows = in_windows(df, roles, w).filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    # of a frame [a, b) the time before is [2a - b, a): a row is in the frame that its distance from the start gives (-1:
    # before the first), and before the next one, unless that is the last, shortened, and begins too long after it
    since = _micros(F.col("__ts")) - _micros(_at(w.start))
    size = frame_days * _DAY
    sizes = [(b - a) // timedelta(microseconds=1) for _, a, b in every]
    rows = rows.select(F.round(lat, 2).alias("lat"), F.round(lng, 2).alias("lng"), since.alias("since"), F.floor(since / size).cast("int").alias("at"))
    next_size = F.when(F.col("at") + 1 == len(every) - 1, F.lit(sizes[-1])).otherwise(F.lit(sizes[0]))
    before = (F.col("at") + 1 < len(every)) & (F.col("since") >= (F.col("at") + 1) * F.lit(size) - next_size)
    own = F.array_compact(F.array(F.when(F.col("at") >= 0, F.struct(F.col("at").alias("frame"), F.lit(True).alias("now"))), F.when(before, F.struct((F.col("at") + 1).alias("frame"), F.lit(False).alias("now")))))
    n = rows.filter("at >= -1").select("lat", "lng", F.inline(own)).groupBy("frame", "lat", "lng").agg(F.count_if("now").alias("n"), F.count_if(~F.col("now")).alias("p"))
    n = stored(n, "cells")  # two rankings read it
    # each ranking by itself, so that it is cut off before the shuffle; no task gets all cells of a frame
    best = lambda c: n.withColumn("r", F.row_number().over(W.partitionBy("frame").orderBy(F.desc(c), "lat", "lng"))).filter(F.col("r") <= MOST_CELLS)
    old = best("p").select("frame", "lat", "lng", F.col("p").alias("previous"))
    out = best("n").filter("n > 0").select("frame", "lat", "lng", "n").join(old, ["frame", "lat", "lng"], "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    kind = F.when(F.col("previous") == 0, "emerging").when(F.col("n") < F.col("previous"), "declining").otherwise("persistent")
    return out.select("frame", "lat", "lng", "n", "previous", kind.alias("kind"))
