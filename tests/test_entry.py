from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import __spark_entry__ as entry  # noqa: E402
from loomtree.plans import catalog  # noqa: E402

FAST = ["tokenize_index", "bm25_topk", "hybrid_h", "hybrid_e", "budget_bytes", "build_tree", "ancestors", "get_context", "session_keywords", "kw_tfidf_e", "wal_replay", "sliding", "knn_many_queries"]


def plain(rows, names):
    def text(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else str(round(v, 5) + 0.0)
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.FLAGSHIP in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
