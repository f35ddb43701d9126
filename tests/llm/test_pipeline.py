"""The pipeline: every stage on all that its predecessor kept, against the operators' own results and planted cases."""

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, importance, minhash, secrets, sentencepiece_scan
from millrace.llm.queries import UNIGRAM_VOCABULARY, vocabulary_path
from millrace.llm.unigram import unigram_proto

WORDS = "the of quick brown fox jumps over lazy dog and then runs far away from all noise in deep green woods until night falls".split()


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ITEM = "which of these seven words never stands beside any other word of this sentence"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(70, i) + (" vile" * 8 if i % 4 == 0 else "")) for i in range(1, 160)]
    rows += [(200, rows[0][1]), (201, rows[1][1].replace("fox", "cat", 1)), (202, prose(40, 777) + " " + ITEM.replace("beside", "behind") + " " + prose(30, 778))]
    rows += [(203, prose(60, 779) + " password: hunter2hunter2 end"), (204, None), (205, ""), (206, "x"), (None, prose(50, 780)), (None, None), (207, prose(60, 781)), (207, prose(60, 782)), (208, ("word " * 60_000).strip() + " " + prose(40_000, 783))]
    d = spark.createDataFrame([(i, t, "en", "web", len(t or ""), "k", "l", "b") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __kept string, __leaks string, bucket string")
    d.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, d


def test_every_stage_equals_its_operator(spark, tables):
    folder, d = tables
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{len(names)}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        names.append(name)
        ids = lambda x: sorted(-1 if r.doc_id is None else r.doc_id for r in x.select("doc_id").collect())
        if len(names) == 1:
            labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality = 1 AND toxic = 0 AS wanted")
            assert ids(docs) == ids(importance.classify(before, labels).where("kept")) and not set(range(4, 160, 4)) & set(ids(docs))
        if len(names) == 2:
            near = minhash.near_duplicates(before)
            assert set(ids(docs)) == {r.doc_id if r.doc_id is not None else -1 for r in near.where("kept").collect()} and not {200, 201} & set(ids(docs))
            assert ids(docs).count(-1) == ids(before).count(-1) and ids(docs).count(207) <= 1
        if len(names) == 3:
            leaking = {r.doc_id for r in decontaminate.leaking_documents(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert leaking == {202} and set(ids(docs)) == set(ids(before)) - leaking
        if len(names) == 4:
            assert ids(docs) == ids(before)
            text = next(r.text for r in docs.where("doc_id = 203").collect())
            assert "hunter2" not in text and all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect())
        if len(names) < 5:
            assert docs.columns == before.columns
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_proto(vocabulary_path(UNIGRAM_VOCABULARY)))
    texts = sorted((r.text or "") for r in before.collect())
    assert sorted(list(r.ids) for r in docs.collect()) == sorted(sp.encode(t) for t in texts) and all(r.round_trip for r in docs.collect())
    decoded = sorted(r.text for r in sentencepiece_scan.decode(docs, vocabulary_path(UNIGRAM_VOCABULARY)).collect())
    assert decoded == texts


def test_empty_tables_pass_through(spark, tables, tmp_path):
    folder, d = tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert secrets.redact_documents(d.limit(0), secrets.train(secrets.samples(spark))).columns == d.columns
