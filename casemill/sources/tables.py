"""Reading and writing tables: Parquet, CSV and workbooks in; Parquet, CSV and JSON lines out."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.plans.lineage import small_or_not


def clean_name(name: str, fallback: str = "table") -> str:
    """Lower-case letters, digits and single underscores."""
    return re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_").lower() or fallback


def clean_columns(df: DataFrame) -> DataFrame:
    """Columns under clean names; a name that occurs again gets a number."""
    names: list[str] = []
    for i, c in enumerate(df.columns):
        name = clean_name(c, f"column_{i}")
        n = 2
        while name in names:
            name, n = f"{clean_name(c, f'column_{i}')}_{n}", n + 1
        names.append(name)
    return df.toDF(*names)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder, each also as a temporary view."""
    out = {}
    for n in names:
        out[n] = spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header. An empty one is an error."""
    df = clean_columns(spark.read.csv(path, header=True, inferSchema=True))
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The first sheet of a workbook as rows of texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = len(cells)
                if letters:
                    at = -1
                    for x in letters[0]:
                        at = (at + 1) * 26 + ord(x) - 65
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def typed(df: DataFrame) -> DataFrame:
    """Text columns as long, double, boolean or timestamp, whichever all their values (blanks aside) can be read as."""
    kinds = ("bigint", "double", "boolean", "timestamp_ntz")
    texts = [c for c, t in df.dtypes if t == "string"]
    given = {c: F.when(F.trim(f"`{c}`") != "", F.trim(f"`{c}`")) for c in texts}
    if not texts:
        return df
    bad = df.agg(*[F.count_if(given[c].isNotNull() & given[c].try_cast(k).isNull()).alias(f"{i}_{k}") for i, c in enumerate(texts) for k in kinds], *[F.count(given[c]).alias(f"{i}_n") for i, c in enumerate(texts)]).first()
    own = {c: next((k for k in kinds if bad[f"{i}_n"] and not bad[f"{i}_{k}"]), None) for i, c in enumerate(texts)}
    return df.select(*[(given[c].try_cast(own[c]) if own.get(c) else F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of workbooks (a task a workbook) with the header of the first one; types as their texts allow."""
    files = spark.read.format("binaryFile").load(path).orderBy("path")
    header = [h or "" for h in sheet_rows(files.select("content").first()[0])[0]]

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                body = [(r + [None] * len(header))[: len(header)] for r in sheet_rows(bytes(content))[1:]]
                yield pd.DataFrame(body, columns=[f"c{i}" for i in range(len(header))], dtype=object)

    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    return typed(clean_columns(files.select("content").mapInPandas(rows, schema).toDF(*[h or f"column_{i}" for i, h in enumerate(header)])))


def write_table(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{clean_name(name)}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


#: Rows of a part of an export at most.
PART_ROWS = 1_000_000


def export_csv(df: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """A CSV file with a header for each ``part_rows`` rows, written side by side; few rows are one file."""
    df.repartition(max(1, -(-df.count() // part_rows))).write.mode("overwrite").option("header", True).csv(path)


def export_parts(df: DataFrame, path: str, order: list[str] | None = None, part_rows: int = PART_ROWS) -> None:
    """CSV in parts that many tasks write, in the order of the given columns (or as they come), and their manifest.

    ``path``/header holds the one header line, ``path``/rows the parts, without one, and ``path``/manifest a line of JSON
    for each: place, file, bytes. The header and the parts in the manifest's order are the bytes of one CSV file.
    """
    spark = df.sparkSession
    n = max(1, -(-df.count() // part_rows))
    if order:
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("header", False).option("maxRecordsPerFile", part_rows).csv(f"{path}/rows")
    names = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
    names.coalesce(1).write.mode("overwrite").option("header", False).csv(f"{path}/header")  # one row
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.csv").load(f"{path}/rows").filter("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    # part-<task>-...-c<number>: files in the order of tasks, then of numbers; a row a file
    listed = parts.select(F.struct(F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long")).alias("at"), name.alias("file"), F.col("length").alias("bytes"))
    listed = listed.withColumn("place", F.row_number().over(W.orderBy("at"))).select("place", "file", "bytes")
    listed.write.mode("overwrite").json(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """An export's rows, typed as read_csv types them."""
    header = spark.read.csv(f"{path}/header").first()
    return clean_columns(spark.read.csv(f"{path}/rows", inferSchema=True).toDF(*header))


def composition(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, n_columns for each table, and a row for the total (table is null)."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        out = own if out is None else out.unionByName(own)
    return out.rollup("table").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_columns").alias("n_columns"))


def denormalize(fact: DataFrame, masters: list[tuple[DataFrame, str, str]], most_rows: int = 100_000) -> DataFrame:
    """``fact`` left-joined with masters (table, the fact's key, the master's key), whose keys must be unique.

    Masters of at most ``most_rows`` rows are broadcast.
    """
    for m, key, own in masters:
        extra = [c for c in m.columns if c != own and c not in fact.columns]
        side = m.select(F.col(own).alias("__key"), *extra)
        fact = fact.join(small_or_not(side, most_rows), fact[key] == F.col("__key"), "left").drop("__key")
    return fact


def wire_view(tables: dict[str, DataFrame], fact: str, masters: list[tuple[str, str, str]], name: str | None = None) -> dict[str, DataFrame]:
    """``tables`` with the fact table replaced by its view with masters (table, the fact's key, the master's key).

    The view stands under ``name`` (the fact's own if None), also as a temporary view, so that queries by name read it.
    """
    view = denormalize(tables[fact], [(tables[m], key, own) for m, key, own in masters])
    view.createOrReplaceTempView(name or fact)
    return {k: v for k, v in tables.items() if k != fact} | {name or fact: view}


def log_event(spark: SparkSession, path: str, at: str, action: str, files: list[str], tables: list[str]) -> None:
    """Adds a line to an ingest log."""
    spark.createDataFrame([(at, action, files, tables)], "at string, action string, files array<string>, tables array<string>").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An ingest log, newest first."""
    return spark.read.schema("at string, action string, files array<string>, tables array<string>").json(path).orderBy(F.desc("at"))
