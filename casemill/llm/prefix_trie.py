"""A trie of conversation prefixes by van Emde Boas recursion.

A conversation is a sequence of turns, and a node of the trie is a distinct sequence of first turns. Sequences are cut at
half their height: the upper halves make one trie, the lower halves make a forest below each distinct cut prefix. Both
are of half the height and are cut again, all tries of one height together in one DataFrame, so that h turns take log2(h)
rounds whatever the number of tries. A block is a stretch of 2^k turns of one conversation that starts at a multiple of
2^k, which is the path that the conversation takes through one of the tries of height 2^k:

* upwards, blocks are named by what they hold: a block's name is the digest of the names of its two halves;
* downwards, cut prefixes are named: an upper trie has the root of the trie it was cut from, a lower one's root is the
  digest of that root and of the upper half's name. At height 1 each row has the name of its whole prefix;
* equal names are one node, its smallest member stands for it. Each node's own figures are put on that member's row;
  upwards, blocks add them up, and downwards, what a lower trie holds is grafted onto the upper half above it, so each
  row ends with the figures of all it has below. Summed over a node's members these are its subtree's totals.

A block has two halves, so no round gathers more than two rows a key, however long a conversation is; positions are
counted within ranges of the sorted table. Groups of many conversations (common prefixes) are only summed before they are
shuffled, or joined to one row. A node's ends_sha256 is one sequential digest: its ids are sorted by ranges, written to
pieces of text there, and the pieces streamed through the digest.

Odd input: rows with a null conv_id are of no conversation and take no part; a null turn comes first; turns of the same
number follow by the digest of their role and text, repeated rows are turns of their own; null and empty texts are
equal; very long texts leave the scan as a digest and a number of words. An empty table has no node. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.plans.lineage import cut

#: Conversations of a group share a start; a conversation takes up to MOST turns from its group's first one.
GROUP, MOST = 20, 3
#: Ids of a piece of text at most; levels that are joined before lineage is cut.
PIECE, LEVELS = 4_096, 4


def _digest(of: Column) -> Column:
    return F.unhex(F.substring(F.sha2(of, 256), 1, 32))


def numbered(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, name, words) for each turn, in order from 1, and (conv, n) for each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = cut(table.select(F.col("conv_id").cast("long").alias("conv"), "turn", name.alias("name"), words.alias("words")).filter("conv IS NOT NULL"))
    order = [F.asc_nulls_first("turn"), F.col("name"), F.col("tie")]
    ranged = cut(turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    counts = cut(ranged.groupBy("part", "conv").agg(F.count("*").alias("n")))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    first = counts.select("part", "conv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = F.row_number().over(W.partitionBy("part", "conv").orderBy(*order))
    own = ranged.withColumn("here", here).join(first, ["part", "conv"]).select("conv", (F.col("here") + F.col("before")).alias("pos"), "name", "words")
    return cut(own), cut(counts.groupBy("conv").agg(F.sum("n").alias("n")))


def rebuilt(own: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, pos, name, words, last) of the rebuilt conversations; pos 0 stands for the start, before any turn."""
    lead = own.filter((F.col("pos") <= MOST) & (F.col("conv") % GROUP == 0)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "words"))).alias("lead"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST + 1)
    plan = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base")).join(lead, "base", "left")
    taken = F.when(F.col("lead").isNull(), F.lit(0)).otherwise(F.least(F.size("lead"), "h")).cast("long")
    plan = plan.withColumn("taken", taken)
    plan = cut(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    start = plan.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("words"), "length")
    shared = plan.filter("taken > 0").select("conv", "length", F.explode(F.slice("lead", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    shared = shared.select("conv", F.col("t.pos").cast("long").alias("pos"), "t.name", "t.words", "length")
    rest = own.join(plan.select("conv", "h", "taken", "length"), "conv").filter("pos > h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words", "length")
    return cut(start.unionByName(shared).unionByName(rest).withColumn("last", F.col("pos") == F.col("length")))


def _starts(spots: DataFrame, level: int) -> DataFrame:
    """(conv, i) of the conversations whose rows 0 to their length fit one block of this level and none of a lower one."""
    low, high = (1 << (level - 1) if level else 0), 1 << level
    return spots.filter(F.col("last") & (F.col("pos") >= low) & (F.col("pos") < high)).select("conv", F.lit(0).cast("long").alias("i"))


def prefix_names(spots: DataFrame, levels: int) -> DataFrame:
    """(conv, i, name): the name of the sequence of each conversation's first i turns."""
    blocks = [spots.filter("pos > 0").select("conv", (F.col("pos") - 1).alias("i"), "name")]
    for _ in range(1, levels):
        halves = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("i"))
        pair = halves.agg(F.count("*").alias("n"), F.min_by("name", "i").alias("a"), F.max_by("name", "i").alias("b")).filter("n = 2")
        blocks.append(cut(pair.select("conv", "i", _digest(F.concat("a", "b")).alias("name"))))
    nothing = F.unhex(F.lit(""))
    at = _starts(spots, levels).withColumn("root", nothing)
    for k in range(levels, 0, -1):
        upper = blocks[k - 1].filter("i % 2 = 0").select("conv", F.shiftright("i", 1).alias("i"), F.col("name").alias("upper"))
        low = F.struct((F.col("i") * 2 + 1).alias("i"), _digest(F.concat("root", "upper")).alias("root"))
        both = F.array(F.struct((F.col("i") * 2).alias("i"), "root"), low)
        at = at.join(upper, ["conv", "i"], "left").select("conv", F.explode(F.when(F.col("upper").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("c")).select("conv", "c.i", "c.root")
        at = at.unionByName(_starts(spots, k - 1).withColumn("root", nothing))
        at = cut(at) if k % LEVELS == 1 else at
    return at.select("conv", "i", F.col("root").alias("name"))


def below(values: DataFrame, levels: int, spots: DataFrame, names: list[str]) -> DataFrame:
    """(conv, i, names): for each row the sums of the named columns over it and all later rows of its conversation."""
    sums = [values.select("conv", "i", *names)]
    for _ in range(1, levels):
        sums.append(cut(sums[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(*[F.sum(c).alias(c) for c in names])))
    none = [F.lit(0).cast("long").alias(c) for c in names]
    at = _starts(spots, levels).select("conv", "i", *none)
    for k in range(levels, 0, -1):
        lower = sums[k - 1].filter("i % 2 = 1").select("conv", F.shiftright("i", 1).alias("i"), *[F.col(c).alias(f"lower_{c}") for c in names])
        both = F.array(
            F.struct((F.col("i") * 2).alias("i"), *[(F.col(c) + F.coalesce(f"lower_{c}", F.lit(0))).alias(c) for c in names]),
            F.struct((F.col("i") * 2 + 1).alias("i"), *names),
        )
        at = at.join(lower, ["conv", "i"], "left").select("conv", F.explode(F.when(F.col(f"lower_{names[0]}").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("c")).select("conv", "c.*")
        at = at.unionByName(_starts(spots, k - 1).select("conv", "i", *none))
        at = cut(at) if k % LEVELS == 1 else at
    later = at.select("conv", "i", *[F.col(c).alias(f"later_{c}") for c in names])
    return values.join(later, ["conv", "i"]).select(*[c for c in values.columns if c not in names], *[(F.col(c) + F.col(f"later_{c}")).alias(c) for c in names])


def _pieces(batches):
    """Rows sorted by name and id: for each name the text of up to PIECE ids."""
    name, first, ids = None, None, []

    def piece():
        return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != name or len(ids) == PIECE:
                if ids:
                    yield piece()
                name, first, ids = own, conv, []
            ids.append(conv)
    if ids:
        yield piece()


def _joined(batches):
    """Pieces sorted by name and first id: the digest of each name's ids."""
    name, digest, names, digests = None, None, [], []
    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != name:
                if digest:
                    names.append(name)
                    digests.append(digest.hexdigest())
                name, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
        names, digests = [], []
    if digest:
        yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})


def prefix_trie(table: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations (conv_id, turn, role, text)."""
    spots = rebuilt(*numbered(table))
    levels = (spots.agg(F.max("pos")).first()[0] or 0).bit_length()
    rows = spots.select("conv", F.col("pos").alias("i"), "words", "last").join(prefix_names(spots, levels), ["conv", "i"])
    rows = cut(rows)
    nodes = rows.groupBy("name", "i").agg(F.min(F.struct("conv", "last")).alias("m"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = cut(nodes.select("name", "i", F.col("m.conv").alias("conv"), F.col("m.last").alias("last"), "n_convs", "words"))
    # a conversation stands for a stretch of nodes down to its end; where that begins, it branches off another one's
    tops = nodes.groupBy("conv").agg(F.min("i").alias("top")).filter("top > 0").select("conv", "top", (F.col("top") - 1).alias("i"))
    at = tops.join(rows.select("conv", "i", "name"), ["conv", "i"]).select("top", "name", F.col("conv").alias("branch"))
    branches = cut(at.join(nodes.select("name", F.col("conv").alias("parent")), "name").select("branch", "top", "parent"))
    kids = branches.groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("i")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(kids, ["conv", "i"], "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + (~F.col("last")).cast("long"))
    nodes = nodes.join(branches.select(F.col("branch").alias("conv"), F.col("top").alias("i"), "parent"), ["conv", "i"], "left")
    nodes = nodes.withColumn("parent", F.coalesce("parent", F.when(F.col("i") > 0, F.col("conv"))))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = cut(nodes.drop("kids", "last", "words"))
    values = rows.select("conv", "i", "name").join(nodes.select("conv", "i", "leaves", "saved"), ["conv", "i"], "left")
    values = cut(values.na.fill(0, ["leaves", "saved"]))
    totals = below(values, levels, spots, ["leaves", "saved"]).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = rows.filter("last").select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    pieces = ends.mapInArrow(_pieces, "name binary, first long, ids string")
    digests = pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_joined, "name binary, ends_sha256 string")
    out = nodes.join(totals, "name").join(digests, "name", "left")
    return out.select(F.col("conv").alias("conv_id"), F.col("i").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n,
         -- crc32 of the decimal digits, bit by bit: each byte (shown as 256 more) is mixed in, then shifted out in eight steps
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
             lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 4 AS h
  FROM own GROUP BY conv_id
), sized AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), turns AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM sized c JOIN own o ON o.conv_id = c.base AND o.pos <= c.taken
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + c.taken, o.role, o.text FROM sized c JOIN own o USING (conv_id) WHERE o.pos > c.h
), keyed AS (
  SELECT conv_id, pos, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS k,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
), whole AS (
  SELECT c.conv_id, coalesce(list(k ORDER BY pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(words ORDER BY pos) FILTER (k IS NOT NULL), []) AS ws
  FROM convs c LEFT JOIN keyed USING (conv_id) GROUP BY c.conv_id
), paths AS (
  SELECT conv_id, d, array_to_string(ks[:d], ',') AS name, array_to_string(ks[:d - 1], ',') AS up, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, d = len(ks) AS last
  FROM whole, unnest(range(len(ks) + 1)) AS u(d)
), nodes AS (
  SELECT d, name, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY d, name
), kids AS (
  SELECT d - 1 AS d, up AS name, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), valued AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.words AS saved FROM nodes n LEFT JOIN kids k USING (d, name)
), totals AS (  -- each node and all above it on the path of its smallest member
  SELECT a.d, a.name, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v JOIN paths a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.d, a.name
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals t USING (d, name) LEFT JOIN nodes p ON p.d = v.d - 1 AND v.d > 0 AND p.name = v.up
"""
