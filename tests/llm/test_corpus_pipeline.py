from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from casemill.llm import bytes_bpe, mixing, quality, secrets, trie

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == columns
    start, good, single, clean, mixed = ({tuple(r) for r in d.collect()} for d in inputs)

    judged = {r.doc_id: r.predicted for r in quality.classify(inputs[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good == {r for r in start if judged[r[0]] == 1} and 0 < len(good) < len(start)

    classes = {r.doc_id: r.component_id for r in trie.near_duplicates(inputs[1]).collect()}
    assert single == {r for r in good if classes[r[0]] == r[0]}

    assert {r[0] for r in clean} == {r[0] for r in single}
    for r in single:
        text = secrets.without_spans(r[1], secrets.scan(r[1])[0])
        assert (r[0], text, r[2], r[3], len(text)) in clean

    copies = Counter(r.doc_id for r in mixing.mix(inputs[3]).collect())
    assert Counter(r.doc_id for r in inputs[4].collect()) == copies and {r[0] for r in mixed} == set(copies)

    encoded = {r.doc_id: r.n_tokens for r in bytes_bpe.encode(inputs[4]).collect()}
    assert Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == Counter({(i, encoded[i]): n for i, n in copies.items()})
    assert all(len(r.ids) == r.n_tokens for r in docs.collect())

    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in whole.collect()) == Counter((r.doc_id, r.ids_sha256) for r in docs.collect())


def odd_folder(spark, path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "__fp", "fp", "copy", "word", "d0"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_the_pipeline_on_odd_input(spark, tmp_path):
    long = "some words of a very long document " * 4_000
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "a null id", None, "a", 9), (None, "a null id", None, "a", 9), (3, long, "en", "b", len(long)), (3, "the same id again", "en", "b", 17), (4, "pwd: kX8$mQ2!vN7z", "en", "c", 17), (5, long, "en", "b", len(long))]
    sf = odd_folder(spark, tmp_path / "odd", rows, [(None, 1, 0), (1, None, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns) and {r.d0 for r in out.collect()} <= {"mine"}
        out.write.parquet(f"{tmp_path}/odd-{n}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{n}")
        if n == 1:  # empty texts are one class, the long texts another; ids that occur twice are kept apart
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect()) == [(0, 9), (1, 0), (3, 17), (3, len(long)), (4, 17)]
        if n == 2:
            assert [(r.text, r.n_chars) for r in docs.collect() if r.doc_id == 4] == [("pwd: [redacted]", 15)]
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_the_pipeline_without_documents(spark, tmp_path):
    sf = odd_folder(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(stage(spark, docs, sf).collect() == [] for _, stage in corpus_pipeline.STAGES)
