import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from casemill.llm import prefix_trie

SF = "/root/testdata/sf0.001"
CONVS = "conv_id long, turn long, role string, text string"


def slow_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved = (len(members[node]) - 1) * words + sum(totals[k][1] for k in kids[node])
        totals[node] = (sum(totals[k][0] for k in kids[node]) or 1, saved)
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(kids[n]), *totals[n], hashlib.sha256(",".join(str(c) for c in members[n] if len(whole[c]) == len(n)).encode()).hexdigest())
        for n in members
    )


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2])


def test_op11_equals_brute_force_and_sql(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    conversations = duckdb.connect()
    conversations.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = slow_trie(rows)
    assert got(spark.read.parquet(f"{SF}/conversations.parquet")) == want
    assert sorted(conversations.sql(prefix_trie.OP11_SQL).fetchall(), key=lambda r: r[:2]) == want


def test_trie_of_odd_input(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "a  b\tc"])) for c in [*range(60), 205, 400, 419] for t in range(r.randrange(1, 7))]
    rows += [(7, None, "user", "first"), (7, 1, "user", "tied"), (7, 1, "user", "tied"), (8, 1, "x", "tied otherwise"), (None, 0, "user", "of none"), (None, None, None, None)]
    rows += [(100 + i, t, "user", f"turn {t} " * 3) for i in range(5) for t in range(70 + i % 2)]  # long ones, nearly the same
    rows += [(300, 0, "user", "word " * 200_000), (301, 0, "user", "word " * 200_000)]
    rows += [(500 + i, 0, "user", "all say this") for i in range(600)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CONVS)
    extra = df.selectExpr("*", "1 AS name", "'x' AS words", "2 AS conv", "3 AS i", "4 AS last").repartition(5)
    assert got(extra) == slow_trie(rows)


def test_one_conversation_with_most_rows(spark):
    rows = [(40, t, "user", str(t % 7)) for t in range(1_500)] + [(41, t, "user", str(t % 7)) for t in range(400)] + [(3, 0, "user", "0")]
    assert got(spark.createDataFrame(rows, CONVS).repartition(4)) == slow_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(1, 0, "user", "x")]])
def test_tables_of_few_rows(spark, rows):
    assert got(spark.createDataFrame(rows, CONVS)) == slow_trie(rows)
