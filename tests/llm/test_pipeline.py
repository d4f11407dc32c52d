"""The pipeline and the queries, against plainer versions of what they say."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gaugework.llm import harmonic, mixing, secrets, toxicity
from gaugework.llm.bpe import encoder
from gaugework.llm.tables import read
from tests.llm.test_groups import planned_joins, plain_simhash, reach

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    docs, made = read(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*made, docs]


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mix", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go(spark, stages):
    labels = read(spark, FOLDER, "labels")
    model = toxicity.learned(stages[0], labels)
    scores = {r["doc"]["doc_id"]: r["score"] for r in toxicity.score(stages[0], model).collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == {i for i, score in scores.items() if score < 0.5}
    assert len(kept) > 0.8 * len(scores)


def test_one_near_copy_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    roots = reach([plain_simhash(text) for _, text in rows])
    assert {r["doc_id"] for r in stages[2].collect()} == {rows[i][0] for i in set(roots)}


def test_the_near_copy_stage_broadcasts_no_masks(spark, documents, monkeypatch):
    docs = documents([(i, f"word{i} " * 20, "en", "a") for i in range(8)])
    planned_joins(monkeypatch, plans := [])
    assert corpus_pipeline.drop_near_copies(spark, docs, FOLDER).count() == 8
    assert [found for name, found in plans if name == "buckets"] == [["SortMergeJoin"]]


def test_secrets_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert not any(secrets.base_spans(text) for text in after.values())
    assert all(after[i] == text for i, text in before.items() if not secrets.candidates(text, []) and not secrets.base_spans(text))


def test_the_mix_repeats_documents(stages):
    wanted = {r["doc_id"]: r["taken"] for r in mixing.mix_report(stages[3]).collect()}
    words = dict.fromkeys(wanted, 0)
    for r in stages[4].collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == wanted


def test_all_tokens_are_packed(stages):
    encode = encoder("word_bpe_49k.json")
    tokens = sum(len(encode.encode(r["text"])) // 4 + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == tokens
    size = np.bincount([r["sequence_id"] for r in rows], [r["length"] for r in rows])
    assert size.min() > 0 and size.max() <= harmonic.CAPACITY


def test_queries_are_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"pipeline", *names} <= entry.queries().keys()
    ids = {r["doc_id"] for r in read(spark, FOLDER, "documents").select("doc_id").collect()}
    made = entry.queries()["op2_sentence_spans"](spark, FOLDER)
    assert {r["doc_id"] for r in made.collect()} == ids
