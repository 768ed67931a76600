"""The gram index against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledger_mart.llm import queries, variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, times=2):
    found = {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if is_near(w, v)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= times * n else None
        found[w] = [form, w, n, len(near), counts[form] if form else None]
    for w, row in found.items():
        while found[row[1]][0]:
            row[1] = found[row[1]][0]
    return sorted((w, *row) for w, row in found.items())


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(rng, n):
    """Words of few syllables, so that many are near; some made of others by an edit."""
    syllables = ["th", "er", "on", "an", "tion", "é", "ÿa", "ing", "a", "b"]
    words = {"".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("xaé") + w[i:], w[:i] + rng.choice("xaé") + w[i + 1 :]]))
    return {w: rng.choice([3, 4, 7, 7, 20, 100, 5000]) for w in sorted(words) if len(w) >= 5}


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(variants, "FREQUENT", rng.choice([2, 10, 10**6]))
    monkeypatch.setattr(variants, "SHARES", rng.choice([10, 10**5]))
    monkeypatch.setattr(variants, "_BLOCK", rng.choice([3, 1024]))
    monkeypatch.setattr(variants, "_HELD", rng.choice([30, 300_000]))
    counts = vocabulary(rng, 400)
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert rows_of(got) == brute(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=3, max_size=12), st.text("abé", min_size=3, max_size=12), st.sets(st.text("abé\x02\x03", min_size=2, max_size=5)))
def test_near_words_share_a_list(a, b, frequent):
    a, b = (a, b) if is_near(a, b) else (a, a[: len(b) % len(a)] + "é" + a[len(b) % len(a) :])
    known = {g: len(g) for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}
    lists = [{x[:3]: x[3] for x in variants.entries(w, known)} for w in (a, b)]
    own = [{x[:3] for x in variants.entries(w, known) if x[3] == 0} for w in (a, b)]
    longer = [{x[:3] for x in variants.entries(w, known) if x[3] == 1} for w in (a, b)]
    assert lists[0] and (own[0] & own[1] or own[0] & longer[1] or longer[0] & own[1])


@settings(max_examples=300, deadline=None)
@given(st.text("abé日", min_size=1, max_size=7), st.text("abé日", min_size=1, max_size=7))
def test_near_equals_the_definition(a, b):
    codes, length = variants._codes([a, b])
    assert bool(variants.near(codes[:1], length[:1], codes[1:], length[1:])[0]) == is_near(a, b)


def test_odd_words_and_repeated_rows(spark):
    rows = [("word", 5), ("word", 6), (None, 9), ("", 9), ("words", 3), ("日本語字", 3), ("日本語学", 30), ("x" * 20000, 3), ("x" * 19999, 9)]
    got = variants.variants(spark.createDataFrame(rows, "word string, n long").selectExpr("*", "'x' as near", "1 as form", "2 as list"))
    assert rows_of(got) == brute({"word": 11, "words": 3, "日本語字": 3, "日本語学": 30, "x" * 20000: 3, "x" * 19999: 9})
    assert variants.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([("ab", 1)], "word string, n long"))


def test_equal_words_are_one_group_in_any_batch(spark, session_batches):
    counts = {f"{a}{b}nounced": 3 + a for a in range(40) for b in range(10)}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert rows_of(got) == brute(counts)


@pytest.fixture
def session_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, old)


def words_by_hand(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] = counts.get(low, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_equals_brute_force(spark, documents, folder):
    rng = random.Random(3)
    words = list(vocabulary(rng, 60))
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, k=200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "Ünder_Ünder3Ünder×Ü÷÷÷÷÷"), (3, texts[3]), (None, texts[4])]
    frame = documents([(i, t, "en", "a") for i, t in rows])
    got = queries.op12_variants(spark, folder(documents=frame))
    want = words_by_hand(rows)
    assert rows_of(got) == brute(want) and len(want) > 40
    assert np.isin(["ünder"], list(want)).sum() == 0
