"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.plans.lineage import cut, small_or_not

# Parts of a status text, and the places of the day bands.
DETECTED, UNDETECTED, OPEN = ("charge", "convict", "acquit"), ("undetected", "closed"), ("investigation", "pending", "open")
BANDS = (("Night", 0, 5), ("Morning", 6, 11), ("Afternoon", 12, 17), ("Evening", 18, 23))


def try_ts(df: DataFrame, column: str) -> Column:
    """The column as a timestamp without time zone; null where it is none."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.col(column).cast("timestamp_ntz")
    return F.col(column).cast("string").try_cast("timestamp_ntz")


def day_of(df: DataFrame, column: str) -> Column:
    return try_ts(df, column).cast("date")


def hour_band(hour: Column) -> Column:
    """The band of an hour; a null hour is Evening, so callers filter nulls first."""
    out = F
    for name, low, high in BANDS[:-1]:
        out = out.when(hour.between(low, high), name)
    return out.otherwise(BANDS[-1][0])


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squeeze_lower(c: Column) -> Column:
    return F.lower(squeeze(c))


def norm_name(c: Column) -> Column:
    """Letters and single spaces, lower-cased; combining marks go too."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\s]", ""))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def severity(c: Column, high: float) -> Column:
    """Clipped to [0, high] and rounded half to even."""
    return F.bround(clip(c.cast("double"), 0.0, high), 0).cast("int")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_delta(now: Column, before: Column) -> Column:
    return F.round(ratio((now - before) * 100.0, before), 1)


def per_lakh(n: Column, population: Column) -> Column:
    return ratio(n * 100_000.0, population)


def status_label(status: Column) -> Column:
    """detected, undetected or open, by parts of the text; null if none occurs. detected wins."""
    low = F.lower(F.coalesce(status, F.lit("")))
    out = F
    for name, parts in (("detected", DETECTED), ("undetected", UNDETECTED), ("open", OPEN)):
        out = out.when(low.rlike("|".join(parts)), name)
    return out.otherwise(F.lit(None).cast("string"))


def token_key(name: Column, address: Column) -> Column:
    """Sorted tokens of a name (a-z, over one letter) and the last comma part of an address."""
    tokens = F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]+", " "), " "), lambda t: F.length(t) > 1))
    place = F.lower(F.trim(F.element_at(F.split(F.coalesce(address, F.lit("")), ","), -1)))
    return F.concat_ws("|", F.array_join(tokens, " "), place)


def frequencies(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each column, the share of rows that have the row's value of it (null: 0) under a new name.

    All columns are counted in one pass; a column's values are broadcast if they are few.
    """
    if not columns:
        return df
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = cut(df.select(F.inline(pairs)).groupBy("i", "v").agg(F.count("*").alias("n")))
    total = counts.filter("i = 0").agg(F.sum("n")).first()[0] or 1
    for i, (c, out) in enumerate(columns.items()):
        own = counts.filter((F.col("i") == i) & F.col("v").isNotNull()).select(F.col("v").alias("__v"), (F.col("n") / F.lit(float(total))).alias(out))
        df = df.join(small_or_not(own, 200_000), df[c].cast("string") == F.col("__v"), "left").drop("__v").fillna({out: 0.0})
    return df
