import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from casemill.llm import debruijn, norm_buckets

SF = "/root/testdata/sf0.001"


def from_sql(sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.sql(sql).fetchall()


# ranked search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_op12_equals_sql_and_brute_force(spark):
    docs, items = (duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    want = slow_search([d[:2] for d in docs], items, 10)
    assert found(norm_buckets.op12_norm_buckets(spark, SF)) == want == sorted(from_sql(norm_buckets.OP12_SQL))


@pytest.mark.parametrize("block,k", [(4_096, 3), (3, 10)])
def test_search_of_odd_input(spark, block, k):
    r = random.Random(4)
    words = ["alpha", "Beta", "beta", "Ä", "ä", "x1", "der", "und", "the", "日本", "_"]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 30)))) for i in range(300)]
    docs += [(None, "alpha Beta"), (None, None), (400, ""), (401, "\n--"), (402, "alpha " * 300_000), (403, "beta"), (404, "beta"), (403, "beta")] + [(500 + i, "common words of a copy") for i in range(200)]
    items = [(i, " ".join(r.choices(words, k=5))) for i in range(12)] + [(None, "alpha"), (20, None), (21, "nowhere"), (22, "alpha"), (22, "beta"), (23, "COMMON copy"), (24, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS norm", "2 AS score", "3 AS bucket", "'x' AS terms").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS rank")
    assert found(norm_buckets.search(d, q, k, block)) == slow_search(docs, items, k)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(norm_buckets.search(d.limit(0), q)) == found(norm_buckets.search(d, q.limit(0))) == found(norm_buckets.search(d.limit(0), q.limit(0))) == []


def test_terms_of_pieces(monkeypatch):
    text = "Ab,cÄ d_é" * 50 + "\x00z\x7fq"
    whole = [t for p in norm_buckets.pieces(text) for t in p]
    assert [t.decode() for t in whole] == terms(text)
    monkeypatch.setattr(norm_buckets, "PIECE", 7)
    assert [t for p in norm_buckets.pieces(text) for t in p] == whole


def test_buckets_are_searched_longest_first_and_all():
    sizes = {3: 5, 4: 100, 7: 1, 9: 2, 12: 1}
    steps = norm_buckets._steps(sizes)
    assert [b for low, high in steps for b in sorted(sizes, reverse=True) if low <= b <= high] == [12, 9, 7, 4, 3]


def test_bounds_leave_most_vectors_unscored(monkeypatch):
    """Coordinate and length bounds, with a reachable k-th score known, keep only vectors near it."""
    r = np.random.default_rng(2)
    n, v = 4_000, 30
    held = [np.sort(r.choice(v, 8, replace=False)).astype(np.int32) for _ in range(n)]
    impacts = [r.integers(1, 1_000, 8).astype(np.int32) for _ in range(n)]
    norm = np.array([math.sqrt((i.astype(float) ** 2).sum()) for i in impacts])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "norm": norm, "terms": pa.array(held, pa.list_(pa.int32())), "impacts": pa.array(impacts, pa.list_(pa.int32()))})

    class Sent:
        value = norm_buckets.Block(pa.table({"item_id": pa.array([5], pa.int64()), "terms": pa.array([[bytes([65 + i]) for i in range(v)]], pa.list_(pa.binary()))}))

    weights = r.integers(1, 5_000, v)
    exact = np.array([int((weights[t] * i.astype(np.int64)).sum()) for t, i in zip(held, impacts, strict=True)])
    kth = int(np.sort(exact)[-10])
    scored = []
    add = norm_buckets.Best.add
    monkeypatch.setattr(norm_buckets.Best, "add", lambda self, score, *a: (scored.append(len(score)), add(self, score, *a)))
    out = next(iter(norm_buckets._search(Sent, weights, np.array([kth]), 10)([batch])))
    assert sorted(out.column(2).to_pylist()) == sorted(exact[exact >= kth].tolist())[-10:] and sum(scored) == (exact >= kth).sum()
    assert not list(norm_buckets._search(Sent, weights, np.array([-1]), 10)([batch]))[0].num_rows


# substring dedup


def slow_dedup(docs):
    """docs: (id, text) in their order; rows of one id and text are one document."""
    order = sorted({(i is not None, i or 0, debruijn_tie(docs, i, t), t or "") for i, t in docs})
    seen, gone = set(), defaultdict(set)
    for key in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", key[3])
        for p in range(len(w) - 19):
            own = tuple(w[p : p + 20])
            if own in seen:
                gone[key] |= set(range(p, p + 20))
            seen.add(own)
    out = []
    for i, t in docs:
        key = (i is not None, i or 0, debruijn_tie(docs, i, t), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        kept = [x for p, x in enumerate(w) if p not in gone[key]]
        out.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def debruijn_tie(docs, i, t):
    """Rows of one id: the planted ones are the same but for words that repeat nowhere, so any order gives the same result."""
    return t or ""


def test_op13_equals_sql_and_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in slow_dedup(docs))
    got = sorted(tuple(r) for r in debruijn.op13_debruijn_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want == sorted(from_sql(debruijn.OP13_SQL)) and sum(r[2] for r in got) > 1_000


def test_dedup_of_odd_input(spark):
    r = random.Random(6)
    passages = [" ".join(str(r.randrange(10**6)) for _ in range(n)) for n in (20, 21, 40, 300, 19)]
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    docs = [(i, f"{fresh(r.randrange(0, 15))} {r.choice(passages)}\t\n{fresh(r.randrange(0, 40))}  {r.choice(passages)} {fresh(5)}") for i in range(60)]
    docs += [(100 + i, "all of them the same " * r.choice([6, 6, 9])) for i in range(120)]  # periodic, and a hot path
    docs += [(300, None), (301, ""), (302, " \n"), (303, "short"), (304, "a " * 19), (305, "a " * 20), (306, "a " * 21), (None, passages[3]), (None, fresh(30)), (None, passages[3]), (400, fresh(25)), (400, fresh(30))]
    docs += [(500 + i, " ".join(w if r.random() > 0.02 else fresh(1) for w in passages[3].split())) for i in range(40)]  # near copies
    docs += [(600, docs[0][1]), (600, docs[0][1]), (601, fresh(3) + " Ä\x0bö " + passages[2] + " x")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS th", "3 AS start", "'x' AS kept", "4 AS n").repartition(7)
    got = sorted((tuple(x) for x in debruijn.deduplicated(df).collect()), key=repr)
    assert got == slow_dedup(docs)


def test_one_passage_in_most_documents(spark):
    passage = " ".join(map(str, range(30)))
    docs = [(i, f"{i}a {passage} {i}b") for i in range(3_000)]
    got = debruijn.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {(x.doc_id == 0, x.n_removed) for x in got} == {(True, 0), (False, 30)}


def test_dedup_of_an_empty_table(spark):
    assert debruijn.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_streamed_anchors_of_any_batches():
    """What becomes of paths doesn't depend on where batches end."""
    r = random.Random(9)
    rows = sorted((r.randrange(12), r.randrange(3), d // 2, 0, d // 2 % 7) for d in range(200))  # half of them documents again
    schema = ("anchor", "p", "d", "th", "start")

    def met(sizes):
        out, at = [], 0
        for n in sizes:
            part = rows[at : at + n]
            at += n
            out.append(pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in part], pa.int64()) for i, c in enumerate(schema)} | {"n": pa.array([1] * len(part), pa.int64()), "hot": pa.array([x[0] == 5 for x in part], pa.bool_())}))
        return sorted(t for b in debruijn._met(out) for t in zip(*(b.column(c).to_pylist() for c in ("kind", "anchor", "p", "d")), strict=True))

    first, kinds = {}, defaultdict(set)
    for a, p, d, *_ in rows:
        first.setdefault((a, p), d)
        kinds[a].add(p)
    want = [(debruijn.REPEATED, a, p, d) for a, p, d, *_ in rows if first[a, p] != d]
    want += [(debruijn.SHARED if a == 5 else debruijn.OPEN, a, p, d) for (a, p), d in first.items() if a == 5 or len(kinds[a]) > 1]
    assert met([200]) == met([1] * 200) == met([3, 0, 50, 7, 140]) == sorted(want)


def test_pieces_change_no_result(monkeypatch):
    r = random.Random(8)
    text = " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(400)) + "\n" + "x" * 900 + " end"
    batch = lambda *c: [pa.RecordBatch.from_arrays([pa.array(x) for x in c], [str(i) for i in range(len(c))])]

    def windows():
        out = {}
        for b in debruijn._paths(batch([1], [0], [text])):
            for anchor, start, n in zip(*(b.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
                assert not set(range(start, start + n)) & set(out)
                out |= dict.fromkeys(range(start, start + n), anchor)
        return out

    packed = zstandard.compress(text.encode())
    opened = [{"start": 3, "n": 200}, {"start": 100, "n": 250}]
    single = lambda: [b.to_pydict() for b in debruijn._windows(batch([1], [0], [packed], [opened]))]
    kept = lambda: next(iter(debruijn._keep(batch([1], [packed], [opened[:1]])))).to_pydict()
    whole, single_whole, kept_whole = windows(), single(), kept()
    assert sorted(whole) == list(range(len(text.split()) - 19)) and kept_whole["kept"] == [" ".join(text.split()[:3] + text.split()[222:])]
    monkeypatch.setattr(debruijn, "PIECE", 150)
    assert (windows(), single(), kept()) == (whole, single_whole, kept_whole)
