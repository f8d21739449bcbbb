import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casemill.llm import mixing, trie, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def slow_simhash(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps, budget=4):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_of_odd_texts():
    for t in ["", None, " \t\n", "one", "Ä B c", "a b c d", "a b c d e A B", "x y z w q r", "tab\tand\x0bmore\x0cwhite\rspace here " * 40]:
        assert trie.simhash(t) == slow_simhash(t)


def test_op2_equals_brute_force_on_all_documents(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in trie.op2_simhash_trie(spark, "/root/testdata/sf0.001").collect()}
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    fps = [slow_simhash(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, slow_classes(fps), strict=True)}
    assert got == want


@pytest.mark.parametrize("levels,group", [((6,), 1000), ((6, 8, 10), 3), ((6, 8), 1)])
def test_links_span_all_classes_even_in_hot_groups(spark, levels, group):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)} | {0}
    for f in list(fps)[:20]:
        for _ in range(12):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {x.node: x.label for x in trie.components(trie.links(df, levels=levels, group=group)).collect()}
    got = [labels.get(f, f) for f in signed]
    want = slow_classes(fps)
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (5, 5)], "src long, dst long")
    labels = {x.node: x.label for x in trie.components(edges).collect()}
    assert {labels[i] for i in range(71)} == {0} and labels[101] == labels[100] == 100 and len(labels) == 73


def test_near_duplicates_and_one_of_each_on_odd_input(spark):
    long = "many words are in this one text and it goes on and on until it ends here at last "
    rows = [(3, long * 9, "a"), (1, long * 9, "b"), (None, long * 9, "a"), (7, None, None), (8, "", "a"), (7, None, None), (None, "alone", "a"), (9, "x" * 200_000, "a")]
    df = docs_of(spark, rows).withColumn("fingerprint", F.lit("mine")).withColumn("__fp2", F.lit(1))
    got = Counter((r.doc_id, r.component_id) for r in trie.near_duplicates(df).collect())
    assert got == Counter({(3, 1): 1, (1, 1): 1, (None, 1): 1, (7, 7): 2, (8, 7): 1, (None, None): 1, (9, 9): 1})
    kept = trie.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.fingerprint) for r in kept.collect()) == [(-1, "mine"), (1, "mine"), (7, "mine"), (9, "mine")]
    assert trie.near_duplicates(df.limit(0)).collect() == [] and trie.one_of_each(df.limit(0)).collect() == []


def test_mixing_is_poisson_and_repeatable(spark):
    rows = [(i, "t" * 9, "big" if i % 10 else "small") for i in range(4000)]
    df = docs_of(spark, rows)
    got = mixing.mix(df).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix(df).collect()]
    n = Counter(r.doc_id for r in got)
    big, small = ([n[i] for i in range(4000) if bool(i % 10) == b] for b in (True, False))
    for counts, share in ((big, 0.75), (small, 0.25)):
        rate = 4000 * share / len(counts)
        assert abs(np.mean(counts) - rate) < 5 * (rate / len(counts)) ** 0.5
        assert abs(np.var(counts) - rate) < 0.3 * rate
    assert max(Counter((r.doc_id, r.copy) for r in got).values()) == 1
    order = [r.doc_id for r in got[:300]]
    assert order != sorted(order)


def test_mixing_weights_large_rates_and_odd_input(spark):
    rows = [(1, "a" * 50, None), (1, "a" * 50, None), (None, None, "s"), (None, "", "s"), (5, "b", "t")]
    df = docs_of(spark, rows).withColumn("copy", F.lit("mine")).withColumn("rate", F.lit(1))
    w = spark.createDataFrame([(None, 1.0), ("s", 1.0), ("unknown", 3.0)], "source string, weight double")
    out = mixing.mix(df, w, epochs=100.0)
    assert sorted(out.columns) == sorted(df.columns)
    n = Counter(r.source for r in out.collect())
    assert n["t"] == 0 and n[None] > 10 and n["s"] > 1000  # the rate of s is over 16: several draws
    same = Counter(r.copy for r in out.filter("doc_id = 1").collect())
    assert set(same.values()) == {2}  # repeated rows are repeated equally
    assert mixing.mix(df.limit(0)).collect() == []
    long = docs_of(spark, [(i, "z" * 300_000, "long") for i in range(6)] + [(9, None, None)])
    assert {(r.source, len(r.text)) for r in mixing.mix(long, epochs=3.0).filter("text IS NOT NULL").collect()} == {("long", 300_000)}


def slow_top_k(rows, k):
    ok = [(i, [float(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in ok if i != q and len(c) == len(v))[:k]
        out += [(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k_on_odd_input_ties_and_small_blocks(spark, block):
    r = random.Random(2)
    rows = [(i, [r.uniform(-2, 2) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(80)] + [(50, [9.0, 1.0, 0.0, 0.0])]
    rows += [(2000, None), (None, [1.0] * 4), (2050, [1.0, None, 1.0, 1.0]), (2100, [float("nan")] * 4), (2150, [float("inf")] * 4), (2200, []), (2250, [1.0, 2.0]), (2251, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(5)
    got = vectors.top_k(df, df.filter("vec_id % 50 = 0"), block=block).collect()
    assert sorted(tuple(x) for x in got) == slow_top_k(rows, 5)
    assert vectors.top_k(df.limit(0), df.limit(0)).collect() == []


def exact_top_k(rows, k):
    """By Python's integers, without limits of size."""
    ok = [(i, [int((Fraction(x) * 256).__floor__()) for x in v]) for i, v in rows]
    out = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in ok if i != q and len(c) == len(v))[:k]
            out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1e6, 1e8, 1e30, 1.5e308])
def test_top_k_is_exact_for_all_finite_vectors(spark, scale):
    r = random.Random(9)
    rows = [(i, [scale, float(i % 7)]) for i in range(40)] + [(50, [-scale, 3.0]), (100, [1.0, 2.0]), (150, [0.0, 0.0])]
    rows += [(200 + i, [r.uniform(-1, 1), r.uniform(-scale / 2, scale / 2)]) for i in range(40)] + [(300, [0.25, 0.5, 1.0]), (301, [scale, 0.5, 1.0]), (302, [scale, 0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for block in (4096, *[2] * (scale == 1e8)):
        got = vectors.top_k(df, df.filter("vec_id % 50 = 0"), block=block).collect()
        assert sorted(tuple(x) for x in got) == exact_top_k(rows, 5)


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.finfo(float).max, -1e300, -2.0, -1.0, -1e-300, -0.0, 0.0, 1e-300, 1.0, 2.0, 1e300, np.finfo(float).max])
    k = vectors.ordered(x)
    assert (np.diff(k) >= 0).all() and k[5] == k[6] and len(set(k.tolist())) == len(x) - 1


def close_groups(groups, size, seed=4):
    """Fingerprints within a few bits of each group's first; all of a group are linked over it."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = int(r.integers(0, 1 << 63, dtype=np.uint64)) & ~0xFFFF
        out.append([base | int(x) for x in r.choice(1 << 14, size, replace=False)])
    return out


def test_classes_of_dense_groups_need_little_memory():
    import tracemalloc

    own = [sorted(g) for g in close_groups(100, 900)]
    fps = np.array([f for g in own for f in g], np.uint64)
    group = np.repeat(np.arange(100), 900)
    tracemalloc.start()
    label = trie._classes(fps, group, trie.BUDGET)
    assert tracemalloc.get_traced_memory()[1] < 400e6  # all their linked pairs would be gigabytes
    tracemalloc.stop()
    few = [slow_classes(g[:200]) for g in own[:2]]
    for n, want in enumerate(few):
        got = trie._classes(fps[n * 900 : n * 900 + 200], np.zeros(200, np.int64), trie.BUDGET)
        assert got.tolist() == want
    assert all(label[n * 900 : (n + 1) * 900].min() == n * 900 for n in range(100))


def test_groups_that_the_third_level_leaves_fall_apart(spark):
    own = close_groups(2, 400, 8)
    fps = sorted(f for g in own for f in g)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    labels = {x.node: x.label for x in trie.components(trie.links(df, levels=(6, 8, 10, 16), group=50)).collect()}
    got = [labels.get(f - (1 << 64) if f >> 63 else f, f) for f in fps]
    label = trie._classes(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), trie.BUDGET)
    pairs = set(zip(got, label.tolist(), strict=True))
    assert len(pairs) == len(set(got)) == len(set(label.tolist()))


def test_an_id_of_two_classes_stands_for_both(spark):
    rows = [(3, "one text of some words here", "a"), (3, "quite another text of other words", "b"), (5, "one text of some words here", "c"), (2, "third", "d")]
    assert sorted((r.doc_id, r.source) for r in trie.one_of_each(docs_of(spark, rows)).collect()) == [(2, "d"), (3, "a"), (3, "b")]


def test_the_row_that_stays_of_equal_ids_and_texts_repeats(spark):
    rows = [(1, "same words in here now", f"s{i}") for i in range(30)] + [(None, "other words over there again", f"s{i}") for i in range(30)]
    kept = [sorted((r.doc_id or 0, r.source) for r in trie.one_of_each(docs_of(spark, rows).repartition(n)).collect()) for n in (1, 3, 7)]
    assert len(kept[0]) == 2 and kept[0] == kept[1] == kept[2]


def test_hundreds_of_blocks_are_one_table(spark):
    r = random.Random(12)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    one = sorted(map(tuple, vectors.top_k(df, df, 3).collect()))
    out = vectors.top_k(df, df, 3, block=1)
    assert sorted(map(tuple, out.collect())) == one and "Union" not in out._jdf.queryExecution().executedPlan().toString()
