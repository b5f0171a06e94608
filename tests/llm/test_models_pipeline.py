"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenemill.llm import nearcopies, quality, repeats, toxicity
from scenemill.llm.storage import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("rated, label, least", [(quality.rated, "quality", 0.97), (toxicity.rated, "toxic", 0.93)])
def test_held_out_accuracy(spark, rated, label, least):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = rated(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    assert len(got) > 1000 and sum(r[0] == r[1] for r in got) / len(got) > least


@pytest.mark.parametrize("rated, fallback", [(quality.rated, 1.0), (toxicity.rated, 0.0)])
def test_odd_rows(spark, frame, odd_rows, rated, fallback):
    labels = table(spark, SF, "labels")
    docs = frame(odd_rows)
    got = rated(docs.unionByName(table(spark, SF, "documents"), allowMissingColumns=True), labels).collect()
    assert len(got) == len(odd_rows) + 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    none = rated(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {fallback}
    assert rated(docs.limit(0), labels).count() == 0


def test_pairs_learn_interactions():
    import numpy as np

    texts = [f"{a} {b} filler" for a in ("insult", "plain") for b in ("group", "other")] * 40
    label = np.array([int("insult group" in t) for t in texts])
    doc, terms = toxicity.terms([t.encode() for t in texts])
    model = toxicity.learn(doc, terms, label, np.unique(terms))
    score = model.score([b"insult group filler", b"insult other filler", b"plain group filler"])
    assert score[0] > 0.7 and max(score[1:]) < 0.3


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "repeats", "leaks", "tokens"]
    labels, items = table(spark, SF, "labels"), [r.text for r in table(spark, SF, "benchmark").collect()]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in held.select("doc_id", "text").collect()}
        out = stage(spark, held, SF).cache()
        if name != "tokens":
            assert out.columns == docs.columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            known = {r.doc_id: r.quality for r in labels.collect()}
            kept = [known[i] for i in known if i in after]
            assert sum(kept) / len(kept) > 0.97 and sum(1 for i in known if known[i] == 1 and i not in after) <= 0.03 * len(known)
        elif name == "near_copies":
            label = {r.doc_id: r.class_id for r in nearcopies.classes(held).collect()}
            assert set(after) == {i for i in label if label[i] == i} and len(after) < len(before)
        elif name == "repeats":
            cut = {r.doc_id: r for r in repeats.removal(held).collect()}
            assert all(len(t.encode()) >= cut[i].n_bytes - cut[i].n_removed for i, t in after.items())
            assert sum(map(len, after.values())) < sum(map(len, before.values()))
        elif name == "leaks":
            gone = set(before) - set(after)
            assert gone >= {i for i, t in before.items() if any(x in t for x in items)} and len(gone) < 0.1 * len(before)
        else:
            assert out.count() == len(before) and out.agg(F.min(F.size("ids") == F.col("n_tokens"))).first()[0]
        held = out
