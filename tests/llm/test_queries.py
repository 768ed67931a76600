"""Registered queries: against SQL where SQL can say the same, else their shape."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from ledger_mart.llm import queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_partenum": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_syncmers": {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
        "near_edited": "double", "near_next": "double",
    },
    "op6_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7_suffix_tree": {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
        "base_score": "double", "score": "double",
    },
    "op8_packing": {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint",
    },
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11_runs": {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
        "runs_sha256": "string", "collapsed_sha256": "string",
    },
    "op12_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_positional": {
        "doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean",
    },
    "op10_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = Counter(tuple(r) for r in got.select(*columns).collect())
    assert rows == Counter(want.project(quoted).fetchall()) and rows


@pytest.mark.parametrize("name", queries.queries())
def test_columns_and_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR)
    kinds = dict(got.dtypes)
    assert COLUMNS.get(name, {}).items() <= kinds.items()
    rows = got.collect()
    if name in ("op6_topk", "op12_variants"):
        return
    if name == "op10_html":
        ids, of = [r["page_id"] for r in rows], "select page_id from pages"
    else:
        ids, of = [r["doc_id"] for r in rows], "select doc_id from documents"
    want = [r[0] for r in duck.sql(of).fetchall()]
    assert (sorted(set(ids)) if name == "op8_packing" else sorted(ids)) == sorted(want)


def test_all_are_registered():
    numbers = [n.split("_")[0] for n in registry.queries() if n.startswith("op")]
    assert numbers == [f"op{i}" for i in range(1, 14)] and "pipeline" in registry.queries()
