from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_mart.llm import toxicity
from ledger_mart.llm.common import held_out

INSULTS = ["dumbwit", "grobolt", "schnuf", "vermik"]


def corpus(n=700):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("the ing an er re on ti st ou at".split(), k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "", "s", ",", "er"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.learn(docs.where(~held_out("doc_id", 4)), labels)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    truth = {i: t for i, _, t in rows}
    got = toxicity.score(docs, model).withColumn("out", held_out("doc_id", 4)).where("out").collect()
    right = sum((r["score"] >= toxicity.CUT) == truth[r["doc_id"]] for r in got)
    assert len(got) > 100 and right >= 0.98 * len(got)
    assert all(any(w[:5] in r["window"] for w in INSULTS) for r in got if r["score"] >= toxicity.CUT and truth[r["doc_id"]])


@pytest.mark.parametrize("text", ["you dumbwit", "a d.u.m.b.w.i.t here", "so d u m b w i t then", "dum-bwit", "DUMBWIT!!", "grob_olt", "xgrobolt", "the schnnuf one"])
def test_gaps_and_inserted_characters(spark, trained, text):
    clean = "the anti reon stou erat"
    docs = spark.createDataFrame([(1, text), (2, clean)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, trained[3]).collect()}
    assert score[1] >= toxicity.CUT > score[2]


def test_the_kernel_counts_gapped_triples():
    codes, weights = toxicity.Triples()(["ab", "abc"])
    symbol = {"^": 0, "a": 2, "b": 3, "c": 4}
    code = lambda x: (symbol[x[0]] * 64 + symbol[x[1]]) * 64 + symbol[x[2]]
    found = {int(c): float(w) for c, w in zip(codes[0], weights[0]) if w > 0}
    d = toxicity.DECAY
    want = {code("^ab"): 1, code("ab^"): 1, code("^a^"): d, code("^b^"): d}
    norm = np.sqrt(sum(v * v for v in want.values()))
    assert found == pytest.approx({k: v / norm for k, v in want.items()}, abs=1e-6)


def test_folded_weights_are_the_kernel_machine(trained):
    """A window's margin is linear in its kernel with the landmarks."""
    words = ["dumbwit", "another", "thing"]
    used, dense = toxicity._kernel_to(words)
    kernel = toxicity._kernel(words, used, dense)
    assert kernel == pytest.approx(dense @ dense.T, abs=1e-5)
    assert np.all(kernel <= toxicity._kernel(words, used, dense).T + 1e-5)


def test_odd_texts_and_tables(spark, trained, documents):
    docs = documents([None, "", " \n", "x" * 100_000, "dumbwit " * 20_000, (None, "you grobolt", None, None)])
    got = toxicity.score(docs, trained[3]).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[4] >= toxicity.CUT and by_id[None] >= toxicity.CUT and max(by_id[i] for i in range(3)) < toxicity.CUT
    assert toxicity.score(documents([]), trained[3]).collect() == []


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0)], [(0, 1)], [(0, None), (None, 1), (9, 1)]])
def test_labels_of_one_kind_or_none(spark, documents, labels):
    docs = documents(["a b", "c d"])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {round(r["score"], 6) for r in toxicity.toxicity(docs, table, F.lit(True)).collect()}
    assert scores == {1.0 if labels == [(0, 1)] else 0.0}


def test_repeated_labels(spark, documents):
    table = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    toxicity.learn(documents(["you grobolt", "fine words"]), table)
