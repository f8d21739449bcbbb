"""Record cleaning. Each step gives the clean table, an audit of changes and what it put in quarantine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions import likeness
from casemill.functions.expressions import digits_only, norm_name, squeeze, squeeze_lower
from casemill.operators.profile import parsed_date
from casemill.plans.lineage import cut, small_or_not, stored

#: Rows of a value map that is broadcast.
MOST_VALUES = 200_000
#: Pairs of a value and a canonical text that are compared at once.
LIKENESSES = 100_000
#: Names of a place up to which they are compared where they share one segment; of more, two.
FEW_NAMES = 5_000
#: Keys of names that a task holds at once.
KEYS = 500_000
CHANGES = "column string, row_key string, op string, before string, after string"
QUARANTINE = "row_key string, column string, reason string, value string"


@dataclass
class Cleaned:
    clean: DataFrame
    changes: DataFrame
    quarantine: DataFrame
    skipped: list[str] = field(default_factory=list)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _result(df: DataFrame, key: str, column: str, op: str, after: Column, reason: Column, changed: Column | None = None) -> Cleaned:
    """A step that gives a column new values; rows with a reason go to quarantine too."""
    marked = df.withColumn("__after", after).withColumn("__reason", reason)
    before, text = F.col(column).cast("string"), F.col("__after").cast("string")
    differs = changed if changed is not None else ~before.eqNullSafe(text)
    k = F.col(key).cast("string").alias("row_key")
    changes = marked.filter(differs).select(F.lit(column).alias("column"), k, F.lit(op).alias("op"), before.alias("before"), text.alias("after"))
    quarantine = marked.filter("__reason IS NOT NULL").select(k, F.lit(column).alias("column"), F.col("__reason").alias("reason"), before.alias("value"))
    clean = marked.select(*[F.col("__after").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    return Cleaned(clean, changes, quarantine)


def normalize_dates(df: DataFrame, column: str, key: str) -> Cleaned:
    """Mixed formats to ISO dates as text, days first; what is no date becomes null."""
    text = F.col(column).cast("string")
    after = F.date_format(parsed_date(text), "yyyy-MM-dd")
    bad = F.when((F.trim(text) != "") & after.isNull(), "unparseable date")
    return _result(df, key, column, "normalize_dates", after, bad.otherwise(F.lit(None)), ~F.substring(text, 1, 10).eqNullSafe(F.col("__after")))


def normalize_phones(df: DataFrame, column: str, key: str) -> Cleaned:
    """+91 and ten digits; numbers of another length stay as they are and go to quarantine, blanks become null."""
    text = F.col(column).cast("string")
    d = digits_only(text)
    n = F.length(d)
    ten = F.when((n == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((n == 11) & d.startswith("0"), F.substring(d, 2, 10)).when(n == 10, d)
    blank = text.isNull() | (F.trim(text) == "")
    after = F.when(blank, F.lit(None)).when(ten.isNotNull(), F.concat(F.lit("+91"), ten)).otherwise(text)
    return _result(df, key, column, "normalize_phones", after, F.when(~blank & ten.isNull(), F.concat(F.lit("bad phone length ("), n.cast("string"), F.lit(")"))))


def normalize_money(df: DataFrame, column: str, key: str) -> Cleaned:
    """Amounts as doubles. A leading currency mark (Rs., INR, a sign) is taken off first."""
    text = F.col(column).cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^(rs|inr)\.?", ""), r"[^0-9.\-]", "")
    after = plain.try_cast("double")
    return _result(df, key, column, "normalize_money", after, F.when(text.isNotNull() & (F.trim(text) != "") & after.isNull(), "not an amount"))


def auto_value_map(df: DataFrame, column: str) -> DataFrame:
    """value_key, canonical: the commonest spelling of each text, case and spaces aside; ties to the smaller one."""
    c = F.col(column).cast("string")
    n = df.filter(c.isNotNull() & (F.trim(c) != "")).groupBy(squeeze_lower(c).alias("value_key"), squeeze(c).alias("spelling")).agg(F.count("*").alias("n"))
    best = W.partitionBy("value_key").orderBy(F.desc("n"), "spelling")
    return n.withColumn("r", F.row_number().over(best)).filter("r = 1").select("value_key", F.col("spelling").alias("canonical"))


def build_value_map(df: DataFrame, column: str, canonical: list[str], threshold: float = 85.0) -> DataFrame:
    """value_key, canonical: each distinct value's most similar one of a given list (ties to the first), if similar enough."""

    @F.pandas_udf("struct<canonical: string, ratio: double>")
    def best(values: pd.Series) -> pd.DataFrame:
        found: list[tuple[str | None, float]] = []
        step = max(1, LIKENESSES // max(1, len(canonical)))
        for i in range(0, len(values), step):
            s = likeness.similarities(values[i : i + step].tolist(), canonical)
            if canonical:
                found += [(canonical[j] if r else None, r) for j, r in zip(s.argmax(axis=1), s.max(axis=1), strict=True)]
            else:
                found += [(None, 0.0)] * len(s)
        return pd.DataFrame(found, columns=["canonical", "ratio"])

    c = F.col(column).cast("string")
    keys = df.filter(c.isNotNull() & (F.trim(c) != "")).select(squeeze_lower(c).alias("value_key")).distinct()
    # not deterministic to the optimizer, which would else push the filter, and the comparisons with it, below distinct
    return keys.withColumn("b", best.asNondeterministic()("value_key")).filter(F.col("b.ratio") >= threshold).select("value_key", "b.canonical")


def standardize_values(df: DataFrame, column: str, key: str, mapping: DataFrame | None = None) -> Cleaned:
    """Values replaced by a map (value_key, canonical); what the map lacks stays. Without a map: auto_value_map."""
    mapping = cut(mapping if mapping is not None else auto_value_map(df, column)).select(F.col("value_key").alias("__k"), F.col("canonical").alias("__c"))
    # a map of values is small as a rule; one that isn't meets the rows in a shuffled join
    joined = df.join(small_or_not(mapping, MOST_VALUES), squeeze_lower(F.col(column).cast("string")) == F.col("__k"), "left")
    out = _result(joined, key, column, "standardize_values", F.coalesce("__c", F.col(column)), F.lit(None).cast("string"))
    return Cleaned(out.clean.select(*df.columns), out.changes, out.quarantine)


def unmapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """value_key, n: values that a map lacks."""
    c = F.col(column).cast("string")
    keys = df.filter(c.isNotNull() & (F.trim(c) != "")).groupBy(squeeze_lower(c).alias("value_key")).agg(F.count("*").alias("n"))
    return keys.join(mapping, "value_key", "left_anti")


def segment_index(names: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(key, lo) and (key, hi): names of a pair whose ratio reaches t have a key in common, the shorter one's as lo.

    names: i (a number), place, own (text). Of lengths s <= r, a ratio of t allows D = (1 - t) (s + r) insertions and
    deletions, each of which breaks one segment at most, so of D + 1 segments of the shorter name one stands whole in the
    longer one, moved by no more than the insertions or deletions before it. A key is a place, both lengths, a segment's
    number and its text; one name has a number of keys that depends on its length only.
    """
    n, long = F.length("own"), "bigint"
    changes = lambda s, r: F.floor((s + r) * (1 - t) + 1e-9).cast(long)
    start = lambda i, s, parts: F.floor(i * s / parts).cast(long)
    key = lambda s, r, i, text: F.xxhash64("place", s, r, i, text)

    def own_keys(r):
        parts = changes(n, r) + 1
        return F.transform(F.sequence(F.lit(0).cast(long), parts - 1), lambda i: key(n.cast(long), r, i, F.expr("own").substr((start(i, n, parts) + 1).cast("int"), (start(i + 1, n, parts) - start(i, n, parts)).cast("int"))))

    def met_keys(s):
        d = changes(s, n)
        more = n - s  # the longer one's additional characters
        low, high = -F.floor((d - more) / 2).cast(long), F.floor((d + more) / 2).cast(long)

        def of_segment(i):
            first, size = start(i, s, d + 1), start(i + 1, s, d + 1) - start(i, s, d + 1)
            moved = F.filter(F.sequence(low, high), lambda m: (first + m >= 0) & (first + m + size <= n))
            return F.transform(moved, lambda m: key(s, n.cast(long), i, F.expr("own").substr((first + m + 1).cast("int"), size.cast("int"))))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast(long), d), of_segment))

    longest, shortest = F.floor(n * (2 - t) / t + 1e-9).cast(long), F.greatest(F.lit(1), F.ceil(n * t / (2 - t) - 1e-9)).cast(long)
    lo = names.select(F.col("i").alias("lo"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(n.cast(long), longest), own_keys)))).alias("key"))
    hi = names.select(F.col("i").alias("hi"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(shortest, n.cast(long)), met_keys)))).alias("key"))
    return lo, hi


def two_segment_index(names: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(key, lo, lo_marks) and (key, hi, hi_marks) as of segment_index, but a key holds two whole segments (`likeness.whole_segments`).

    Two segments of 21 random letters are 6 of them, so in a place of very many names few share a key by chance. Keys are
    made for lengths that occur only. Of names that share one, those whose letters differ by too many never leave the join
    (`within_marks`).
    """
    lengths = sorted(r.n for r in names.select(F.length("own").alias("n")).distinct().collect())  # a number a length

    def keys(longer: bool):
        side = "hi" if longer else "lo"

        def of(batches):
            for x in batches:
                held, size = [], 0
                for n, y in x.groupby(x["own"].str.len()):
                    others = [m for m in lengths if (m <= n if longer else m >= n)]
                    texts, own, salts = y["own"].tolist(), y["i"].to_numpy(), y["salt"].to_numpy().view("uint64")
                    marks = likeness.letter_marks(texts)
                    for key in likeness.segment_keys(texts, salts, others, t, longer):
                        held.append(pd.DataFrame({side: own, "key": key, f"{side}_marks": marks}))
                        size += len(own)
                        if size >= KEYS:
                            yield pd.concat(held)
                            held, size = [], 0
                if held:
                    yield pd.concat(held)

        return of

    salted = names.select("i", "own", F.xxhash64("place").alias("salt"))
    lo, hi = (salted.mapInPandas(keys(longer), f"{c} long, key long, {c}_marks long") for longer, c in ((False, "lo"), (True, "hi")))
    # merged: by the size of the names alone, keys of which there are a hundred times as many seem small enough to broadcast
    return lo.hint("merge"), hi.hint("merge")


def within_marks(t: float) -> Column:
    """Whether two names' letter counts (`likeness.letter_marks`) leave a ratio of t possible."""
    size = lambda c: F.col(c).bitwiseAND(255)
    differ = F.bit_count(F.shiftrightunsigned(F.col("lo_marks").bitwiseXOR(F.col("hi_marks")), 8))
    return (differ <= F.floor((size("lo_marks") + size("hi_marks")) * (1 - t) + 1e-9)) | (F.greatest(size("lo_marks"), size("hi_marks")) == 255)


def met_names(lo: DataFrame, hi: DataFrame, possible: Column | None = None) -> DataFrame:
    """a, b: pairs of numbers that share a key and are possible, once each, a < b."""
    both = lo.join(hi, "key").filter("lo <> hi")
    return (both if possible is None else both.filter(possible)).select(F.least("lo", "hi").alias("a"), F.greatest("lo", "hi").alias("b")).distinct()


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """lo, hi: pairs of names of one place whose indel ratio reaches the threshold, lo < hi.

    names: o (orderable, unique), place, own (text, not empty). Only names that share a key of the segment index are
    compared; in places of many names a key is of two segments, so that compared pairs don't grow with the square of them.
    Pairs are found by number, once each, before they meet their texts.
    """
    numbered = stored(names.withColumn("i", F.monotonically_increasing_id()), "names")
    large = cut(numbered.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > FEW_NAMES).select("place"))
    if large.isEmpty():
        met = met_names(*segment_index(numbered, threshold / 100))
    else:
        large = small_or_not(large, MOST_VALUES)
        few, many = numbered.join(large, "place", "left_anti"), numbered.join(large, "place", "left_semi")
        met = met_names(*segment_index(few, threshold / 100)).unionByName(met_names(*two_segment_index(many, threshold / 100), within_marks(threshold / 100)))
    end = lambda c: numbered.select(F.col("i").alias(c), F.struct("o", "own").alias(f"n_{c}"))
    pairs = met.join(end("a"), "a").join(end("b"), "b")

    @F.pandas_udf("double")
    def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(likeness.ratios(a.tolist(), b.tolist()), dtype=float)

    alike = pairs.filter(ratio_of("n_a.own", "n_b.own") >= threshold)
    return alike.select(F.least("n_a.o", "n_b.o").alias("lo"), F.greatest("n_a.o", "n_b.o").alias("hi"))


def first_representatives(edges: DataFrame) -> DataFrame:
    """hi, lo: for each node that has one, the first representative linked to it; the others represent themselves.

    In order, a node joins the first representative it is linked to, or else becomes one. Each round all nodes without an
    earlier open neighbour become representatives and take theirs along.
    """
    edges = stored(edges, "like")
    left, members, rounds = edges, edges.select("hi").limit(0), 0
    while not left.isEmpty():
        lead = left.select("lo").distinct().join(left.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        taken = stored(left.join(lead, "lo", "left_semi").select("hi").distinct(), "taken")
        members = members.unionByName(taken)
        rounds += 1
        members = stored(members, "members") if rounds % 16 == 0 else members  # so that the plan stays short
        gone = lead.select(F.col("lo").alias("x")).unionByName(taken.select(F.col("hi").alias("x")))
        left = stored(left.join(gone.withColumnRenamed("x", "lo"), "lo", "left_anti").join(gone.withColumnRenamed("x", "hi"), "hi", "left_anti").select("lo", "hi"), "left")
    members = stored(members, "members")
    return edges.join(members, "hi", "left_semi").join(members.select(F.col("hi").alias("lo")), "lo", "left_anti").groupBy("hi").agg(F.min("lo").alias("lo"))


def resolve_persons(df: DataFrame, name: str, key: str, locality: str | None = None, threshold: float = 88.0) -> Cleaned:
    """``person_canonical``: a class of like names of one locality, named after the key of its first name.

    Names are taken in the order of their first keys; each joins the first representative of its locality whose words, in
    alphabetical order, are similar enough, or becomes one.
    """
    place = F.coalesce(F.col(locality).cast("string"), F.lit("")) if locality else F.lit("")
    marked = df.withColumn("__n", F.coalesce(norm_name(F.col(name)), F.lit(""))).withColumn("__p", place)
    first = marked.filter("__n <> ''").groupBy("__n", "__p").agg(F.min(key).alias("first"))
    own = F.array_join(F.array_sort(F.split("__n", " ")), " ")
    names = cut(first.select(F.struct("first", "__n", "__p").alias("o"), F.col("__p").alias("place"), own.alias("own")))
    joins = first_representatives(similar_names(names, threshold))
    made = names.join(joins, names.o == joins.hi, "left").select("o.__n", "o.__p", F.concat(F.lit("PC"), F.coalesce("lo.first", "o.first").cast("string")).alias("person"))
    made = cut(made)
    joined = marked.join(made, ["__n", "__p"], "left").withColumn("person_canonical", F.col("person"))
    several = made.groupBy("person").agg(F.count("*").alias("m")).filter("m > 1")
    changes = joined.join(several, "person").select(F.lit(name).alias("column"), F.col(key).cast("string").alias("row_key"), F.lit("merge_person").alias("op"), F.col(name).alias("before"), F.col("person").alias("after"))
    return Cleaned(joined.select(*df.columns, "person_canonical"), changes, _empty(df, QUARANTINE))


def handle_missing(df: DataFrame, column: str, key: str, policy: str = "flag", required: bool = False, valid_range: tuple[float, float] | None = None, fill=None) -> Cleaned:
    """Missing (null or blank, if required) and out-of-range values: rows dropped, values imputed, or only flagged."""
    c = F.col(column)
    missing = (c.isNull() | (F.trim(c.cast("string")) == "")) & F.lit(required)
    outside = F.lit(False) if valid_range is None else F.coalesce(~c.try_cast("double").between(*valid_range), F.lit(False))
    reason = F.when(missing, "missing").when(outside, "out of range")
    k = F.col(key).cast("string").alias("row_key")
    bad = df.withColumn("__reason", reason).filter("__reason IS NOT NULL")
    value = F.to_json(F.struct(*[F.col(f"`{x}`") for x in df.columns])) if policy == "drop" else c.cast("string")
    quarantine = bad.select(k, F.lit(column).alias("column"), F.col("__reason").alias("reason"), value.alias("value"))
    if policy == "drop":
        return Cleaned(df.filter(reason.isNull()), _empty(df, CHANGES), quarantine)
    if policy == "impute":
        filled = df.withColumn(column, F.when(reason.isNotNull(), F.lit(fill).cast(df.schema[column].dataType)).otherwise(c))
        changes = bad.select(F.lit(column).alias("column"), k, F.lit("impute").alias("op"), c.cast("string").alias("before"), F.lit(fill).cast("string").alias("after"))
        return Cleaned(filled, changes, quarantine)
    return Cleaned(df, _empty(df, CHANGES), quarantine)


def dedupe_rows(df: DataFrame, keys: list[str], order: str) -> Cleaned:
    """The first row of each key (null keys are equal), by an order column; the others go to quarantine.

    The first rows are a minimum, so that a key of very many rows is aggregated before the shuffle; columns cannot be maps.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = F.struct(*[x for c in (order, *(c for c in df.columns if c != order)) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])  # nulls last
    clean = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, by).alias("__r")).select("__r.*")
    rest = df.exceptAll(clean).select(F.col(order).cast("string").alias("row_key"), F.lit(",".join(keys)).alias("column"), F.lit("duplicate").alias("reason"), F.to_json(whole).alias("value"))
    return Cleaned(clean, _empty(df, CHANGES), rest)


STEPS: dict[str, Callable[..., Cleaned]] = {
    "normalize_dates": normalize_dates, "normalize_phones": normalize_phones, "normalize_money": normalize_money, "standardize_values": standardize_values,
    "resolve_persons": lambda df, column, key, **p: resolve_persons(df, column, key, **p), "handle_missing": handle_missing,
}


def execute_plan(df: DataFrame, plan: list[dict], key: str) -> Cleaned:
    """Steps in order: {"op", "column", ...}, or {"op": "dedupe_rows", "keys"}. Unknown and failing steps are skipped and named.

    Each step's table is computed and kept, so that a step that fails shows, and later ones don't repeat earlier ones.
    """
    changes, quarantine, skipped = _empty(df, CHANGES), _empty(df, QUARANTINE), []
    for step in plan:
        p = {k: v for k, v in step.items() if k != "op"}
        try:
            if step["op"] == "dedupe_rows":
                out = dedupe_rows(df, p["keys"], p.get("order", key))
            elif step["op"] in STEPS:
                out = STEPS[step["op"]](df, key=key, **p)
            else:
                skipped.append(step["op"])
                continue
            clean = cut(out.clean)
        except Exception as e:  # a failing step is part of the result
            skipped.append(f"{step['op']}: {type(e).__name__}")
            continue
        df = clean
        changes, quarantine = changes.unionByName(out.changes), quarantine.unionByName(out.quarantine)
    return Cleaned(df, changes, quarantine, skipped)


def plan_from_digest(digest: DataFrame, key: str) -> list[dict]:
    """A cleaning plan by rules over a digest (a row a column)."""
    plan: list[dict] = []
    rows = {r.column: r for r in digest.collect()}
    for c, r in rows.items():
        low = c.lower()
        if c == key or r.date_parse_rate is None:
            continue
        if r.phone_like_rate > 0.3:
            plan.append({"op": "normalize_phones", "column": c})
        elif r.date_parse_rate > 0.5:
            plan.append({"op": "normalize_dates", "column": c})
        elif any(x in low for x in ("amount", "value", "price", "cost", "loss", "salary", "income")):
            plan.append({"op": "normalize_money", "column": c})
        elif "name" in low.split("_"):
            plan.append({"op": "resolve_persons", "column": c})
        elif r.distinct <= 25:
            plan.append({"op": "standardize_values", "column": c})
    plan += [{"op": "handle_missing", "column": c, "required": True} for c, r in rows.items() if r.null_pct > 0 and c != key]
    return [*plan, {"op": "dedupe_rows", "keys": [key]}]


def recovery(cleaned: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """rate, rows: the share of keys whose first ten characters of a column are the true ones."""
    a = cleaned.select(F.col(key).cast("string").alias("k"), F.substring(F.col(column).cast("string"), 1, 10).alias("got"))
    b = truth.select(F.col(key).cast("string").alias("k"), F.substring(F.col(column).cast("string"), 1, 10).alias("want"))
    return a.join(b, "k").agg(F.avg(F.coalesce((F.col("got") == F.col("want")).cast("int"), F.lit(0))).alias("rate"), F.count("*").alias("rows"))
