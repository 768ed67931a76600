from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from ledger_mart.llm.common import table
from ledger_mart.llm.packing import LENGTH

pytest.importorskip("public_tokenizers")
SYLLABLES = {"en": "the ing tion and er th ou".split(), "de": "ein sch ung der ge ü keit".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    folder, rows, labels, toxic, copies = str(tmp_path_factory.mktemp("tables")), [], [], set(), {}
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        if rng.random() < 0.2:
            words[rng.randrange(len(words))] = "grobolt" + rng.choice(["", "s", "."])
            toxic.add(i)
        labels.append((i, 1, int(i in toxic)))
        rows.append((i, " ".join(words), lang, rng.choice(["a", "b", "c", None])))
    for i in range(600, 640):  # near copies
        of = rng.randrange(600)
        words = rows[of][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, rows[of][1] if i % 2 or len(words) < 100 else " ".join(words), rows[of][2], "a"))
        copies[i] = of
    rows += [(700, None, "en", "a"), (701, "", "en", "b"), (702, "123 456", "en", None)]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}, toxic, copies


def test_stages_one_by_one(spark, tables):
    folder, rows, toxic, copies = tables
    toxic = toxic | {i for i, of in copies.items() if of in toxic}
    docs = kept = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
        path = f"{folder}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "toxicity":
            assert len(set(ids) & toxic) <= 0.02 * len(toxic) and len(set(rows) - toxic - set(ids)) <= 0.01 * len(rows)
        elif name == "language":
            assert not set(ids) & {700, 701, 702} and len(ids) >= len(rows) - len(toxic) - 12
        elif name == "near_duplicates":
            assert len(ids) == len(set(ids)) and not set(ids) & {i for i, of in copies.items() if of in ids}
            single = set(ids)
        else:
            assert set(ids) <= single and max(map(ids.count, set(ids))) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)


def test_run(spark, tables):
    folder, rows, *_ = tables
    pieces = corpus_pipeline.run(spark, folder).collect()
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= LENGTH
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in pieces[:50]:
        ids = np.array([*tokenizer.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids, 2], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for name in ("documents", "labels"):
        table(spark, folder, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("langs", [["en"], ["en", "de"]])
def test_language_stage_drops_letter_junk_and_languages_not_learned(documents, langs):
    rng = random.Random(11)
    text = lambda parts: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(8, 150)))
    rows = [(i, text(SYLLABLES[langs[i % len(langs)]]), langs[i % len(langs)], "a") for i in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(1000 + i, text(list(letters)), None, "a") for i in range(20)]
    rows += [(1100 + i, text("при ст ов ени на ло ть".split()), None, "a") for i in range(20)]
    rows += [(1200 + i, "".join(rng.choices(letters.upper() + letters + "0123456789+/", k=800)), None, "a") for i in range(20)]
    docs = documents(rows, clash=False)
    ids = {r["doc_id"] for r in corpus_pipeline.drop_unknown_language(docs.sparkSession, docs, "").collect()}
    assert max(ids) < 300 and len(ids) >= 294
