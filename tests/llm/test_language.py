from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_mart.llm import language
from ledger_mart.llm.common import held_out

SYLLABLES = {"en": "the ing tion and er th ou".split(), "de": "ein sch ung der ß ü keit".split(), "ru": "при ст ов ени на ло ть".split()}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(2)
    return [(i, text(lang := rng.choice(list(SYLLABLES)), rng, rng.randint(3, 60)), lang, "s") for i in range(n)]


def test_held_out_accuracy(documents):
    rows = corpus() + [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 !?", "de", "s"), (1003, "Schung der ein ung", None, "s"), (None, "ening the", "en", "s")]
    docs = documents(rows)
    out = held_out("doc_id", 4)
    got = {r["doc_id"]: r for r in language.identified(docs, ~out).withColumn("out", out).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, lang) for i, _, lang, _ in rows[:240] if got[i]["out"]]
    assert len(held) > 30 and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]


def test_one_language_none_and_no_rows(documents):
    docs = documents([(0, "ab", "xx", "s"), (1, "cd", "xx", "s"), (2, "", "xx", "s")])
    assert [r["lang_pred"] for r in language.identified(docs, F.lit(True)).orderBy("doc_id").collect()] == ["xx", "xx", "und"]
    assert {(r["lang_pred"], r["score"]) for r in language.identified(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert language.identified(documents([]), F.lit(True)).collect() == []


def test_scores_are_those_of_the_kernel():
    """Folding landmarks into n-gram weights changes nothing."""
    rng = random.Random(1)
    presence = language.Presence()
    found, langs = zip(*[(presence(text(x, rng)), x) for x in ("en", "de", "ru") * 15])
    model = language.fit(list(found), list(langs), {"en": 15, "de": 15, "ru": 15})
    texts = [presence(text("de", rng)) for _ in range(5)]
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in found] for a in found])
    own = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in found] for a in texts])
    truth = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    # kernel ridge regression with centred features, in the dual
    n = len(found)
    centre = np.eye(n) - 1 / n
    dual = np.linalg.solve(centre @ kernel @ centre + language.RIDGE * n * np.eye(n), truth - truth.mean(0))
    want = (own - kernel.mean(0)) @ centre @ dual + truth.mean(0)
    assert model.scores(texts) == pytest.approx(want, abs=2e-3)


def test_long_text_is_read_whole(documents):
    rng = random.Random(3)
    model_rows = corpus(90)
    docs = documents(model_rows + [(500, "1 " * 200_000 + text("ru", rng, 30), None, "s")])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(docs, F.col("doc_id") < 90).collect()}
    assert got[500] == "ru"
