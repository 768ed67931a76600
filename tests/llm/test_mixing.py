from __future__ import annotations

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledger_mart.llm import mixing


def mix(docs):
    return [r.asDict() for r in mixing.systematic_mix(docs).collect()]


def by_resharing(sizes):
    """Targets by sharing out and resharing what is above the cap, in exact numbers."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, fixed = Fraction(3 * sum(sizes.values()), 2), {}, set()
    while True:
        going = [s for s in names if s not in fixed]
        rest = left - sum(target[s] for s in fixed)
        if not going:
            return target
        for s in going:
            target[s] = rest * weight[s] / sum(weight[x] for x in going)
        above = [s for s in going if target[s] > 2 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            fixed.add(s)


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "a", "b", "B", "é", "z", ""]), st.integers(0, 500), min_size=1))
def test_targets_equal_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx({s: float(t) for s, t in by_resharing(sizes).items()})


def test_words_taken_come_near_the_targets(documents):
    texts = [(i, "w " * (i * 7 % 40 + 1), "en", ("a", "b", None, "c")[i % 4 if i % 3 else 0]) for i in range(400)]
    rows = mix(documents(texts))
    assert len(rows) == 400 and all(r["copies"] in (0, 1, 2) for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mix(documents(texts).repartition(7))))


def test_sizes_of_odd_texts(documents):
    texts = [None, "", " \t\n", "a", " a ", "a b", "\n\na b\r\nc", "é\x0bö"]
    assert {r["doc_id"]: r["size"] for r in mix(documents(texts))} == dict(enumerate([0, 0, 0, 1, 1, 2, 2, 2]))


def test_no_rows_and_no_words(documents):
    assert mix(documents([])) == []
    assert [r["copies"] for r in mix(documents([None, ""]))] == [0, 0]


def test_repeated_rows_and_null_ids(documents):
    rows = mix(documents([(None, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "c", "en", None)]))
    assert len(rows) == 4


def test_emitted_documents_keep_their_columns(documents):
    docs = documents([(i, f"word {i}", "en", "ab"[i % 2]) for i in range(40)] + [(3, "word 3", "en", "b"), (None, "x", None, None)])
    plan = mixing.systematic_mix(docs)
    out = mixing.emit(docs, plan)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {
        r["doc_id"]: r["copies"] for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect() if r["copies"]
    }
