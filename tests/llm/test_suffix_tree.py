from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from ledger_mart.llm import suffix_tree as st
from ledger_mart.llm.common import held_out


def score(docs, taught):
    return {r["doc_id"]: r for r in st.scored(docs, taught).collect()}


def words(text):
    return (text or "").encode().lower().split()


def corpus(n=150):
    rng = random.Random(9)
    vocabulary = [f"W{i}" for i in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = [None, "", "É é", " A\x0bb "]
    for i in range(n):
        own = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 50)) + [f"rare{i}"] * (i % 3 == 0)
        rows.append(" ".join(own) + (" " + passage if i % 4 == 0 else ""))
    return rows


@pytest.mark.parametrize("head", [7, 300_000])
def test_base_score_by_hand(documents, monkeypatch, head):
    monkeypatch.setattr(st, "HEAD", head)  # all other words' counts come by the join
    monkeypatch.setattr(st, "_HELD", 50)
    monkeypatch.setattr(st, "_HELD_WORDS", 20)
    monkeypatch.setattr(st, "_DOCS", 9)
    monkeypatch.setattr(st, "in_slices", lambda batches, most: (b.slice(i, 9) for b in batches for i in range(0, b.num_rows, 9)))
    texts = corpus()
    got = score(documents(texts), ~held_out("doc_id", 7))
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = [*words(t), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own))


def by_hand(texts, taught):
    """Probability of each token from plain dictionaries of runs."""
    sequences = {i: ["<s>", *words(t), "</s>"] for i, t in enumerate(texts)}
    counts = [Counter() for _ in range(st.DEPTH + 2)]
    for i in taught:
        s = sequences[i]
        for n in range(1, st.DEPTH + 2):
            for j in range(len(s) - n + 1):
                counts[n][tuple(s[j : j + n])] += 1
    total = sum(n for (w,), n in counts[1].items() if w != "<s>")
    kinds = sum(w != "<s>" for (w,) in counts[1])
    single = sum(n == 1 and w != "<s>" for (w,), n in counts[1].items())
    least = max(st.LEAST_COUNT, math.ceil(st.LEAST_SHARE * total))
    spared = min(0.95, max(0.05, single / kinds))
    fixed = {(w,) for w in ("<s>", "</s>")}
    frequent = [{}, {r: n for r, n in counts[1].items() if n >= least or r in fixed}]
    for n in range(2, st.DEPTH + 2):
        frequent.append({r: c for r, c in counts[n].items() if c >= least and r[:-1] in frequent[n - 1] and r[1:] in frequent[n - 1]})
    root = lambda w: max(counts[1][(w,)] - spared, 1e-9) / total if counts[1][(w,)] and w != "<s>" else spared * kinds / total
    left = {}

    def p(context, w):
        if not context:
            return root(w)
        q = p(context[1:], w)
        if context not in left:
            return q
        n = frequent[len(context) + 1].get((*context, w), 0)
        return (max(n - st.DISCOUNT, 0) / counts[len(context)][context] if n else 0) + left[context] * q

    for n in range(1, st.DEPTH + 1):
        states = {}
        for context in {r[:-1] for r in frequent[n + 1]}:
            after = {r[-1]: c for r, c in frequent[n + 1].items() if r[:-1] == context}
            whole, seen = counts[n][context], sum(after.values())
            ratio = 2 * sum(c * math.log(c / whole / p(context[1:], w)) for w, c in after.items())
            if rest := whole - seen:
                ratio += 2 * rest * math.log(rest / whole / max(1 - sum(p(context[1:], w) for w in after), 1e-9))
            if ratio > len(after) + st.LOOSE * math.sqrt(2 * len(after)) + st.LOOSE:
                states[context] = (rest + st.DISCOUNT * len(after)) / whole
        left |= states
    # a context beyond the frequent runs is none
    def longest(before):
        for n in range(min(st.DEPTH, len(before)), 0, -1):
            if tuple(before[-n:]) in frequent[n]:
                return tuple(before[-n:])
        return ()

    return {i: sum(math.log10(p(longest(s[:j]), s[j])) for j in range(1, len(s))) for i, s in sequences.items()}, left, p, [w for (w,) in counts[1] if w != "<s>"]


def test_score_by_hand(documents):
    texts = corpus()
    taught = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    want, states, p, symbols = by_hand(texts, taught)
    for context in states:  # over the known words and an unknown one
        assert sum(p(context, w) for w in [*symbols, None]) == pytest.approx(1)
    got = score(documents(texts), ~held_out("doc_id", 7))
    assert any(len(c) > 1 for c in states) and any(len(c) == 1 for c in states)
    assert {i: got[i]["score"] for i in want} == pytest.approx(want, rel=1e-9)


def test_repeated_passages_score_higher(documents):
    texts = corpus()
    got = score(documents(texts), ~held_out("doc_id", 7))
    out = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 7 == 2 and i >= 4 and i % 4 == 0]  # with the passage
    assert out and all(r["score"] > r["base_score"] + 10 for r in out)


def test_nothing_taught_no_rows_and_null_ids(documents):
    got = score(documents(["a b", None]), F.lit(False))
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.values()] == [(0, 0, 0.0, 0.0)] * 2
    assert score(documents([]), F.lit(True)) == {}
    rows = st.scored(documents([(None, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "en", "s")]), F.lit(True)).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1


@pytest.mark.parametrize(("head", "fast"), [(7, 300_000), (300_000, 5), (7, 0)])
def test_runs_of_all_words_score_by_hand(documents, monkeypatch, head, fast):
    """Words beyond the head are in contexts, and runs that are not sent to the tasks count as well."""
    monkeypatch.setattr(st, "HEAD", head)
    monkeypatch.setattr(st, "FAST", fast, raising=False)
    texts = corpus()
    taught = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = by_hand(texts, taught)[0]
    got = score(documents(texts), ~held_out("doc_id", 7))
    assert {i: got[i]["score"] for i in want} == pytest.approx(want, rel=1e-9)


def test_the_threshold_does_not_rise_with_the_corpus(documents):
    rows = ["x " * 10_000] * 300 + ["p q"] * 4 + ["p", "q", "p q", "q p"]
    got = score(documents(rows, clash=False), F.col("doc_id") < 304)
    assert got[306]["score"] > got[307]["score"] + 5


def test_what_was_sent_to_tasks_goes_when_its_jobs_end(documents, monkeypatch):
    """Only what the returned rows still need is left on the disks."""
    docs, left = documents(corpus()), []
    context = type(docs.sparkSession.sparkContext)
    make = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: left.append(make(self, value)) or left[-1])
    rows = st.scored(docs, ~held_out("doc_id", 7))
    assert len(left) > 6 and [b for b in left if os.path.exists(b._path)] == left[-1:]
    assert rows.count() == len(corpus())


def test_a_sieve_is_as_long_as_its_keys_need(spark):
    keys = spark.range(100).selectExpr("xxhash64(id) as key")
    sieve = st.sieve_of(keys)
    assert len(sieve) == 1 << 10
    assert st.passes(sieve, np.array([r["key"] for r in keys.collect()])).all()
    assert len(st.sieve_of(spark.range(20_000).selectExpr("xxhash64(id) as key"))) == 1 << 15


def test_lookups_are_shuffled_by_lots_of_documents(documents, monkeypatch):
    """Not a row for each occurrence of a run whose weight isn't sent."""
    asked, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: asked.append(self._df) or cogroup(self, other))
    monkeypatch.setattr(st, "FAST", 0)
    docs = documents(corpus())
    assert st.scored(docs, ~held_out("doc_id", 7)).count() == len(corpus())
    tokens = sum(len(words(t)) for t in corpus())
    assert len(asked) == 1 and 0 < asked[0].count() <= 9 * docs.rdd.getNumPartitions() < tokens / 10
