"""Queries on tables whose names repeat where ids do not."""

from __future__ import annotations

import duckdb

from siltstone.plans.catalog import CATALOG


def test_pages_with_one_url_are_told_apart(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1::BIGINT, 'u/a'), (2, 'u/a'), (3, 'u/b'), (4, 'u/b'), (5, 'u/c')) v(page_id, url)")
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1::BIGINT), (5), (4)) v(doc_id)")
    con.execute("CREATE TABLE labels AS SELECT * FROM (VALUES (1::BIGINT), (5), (3)) v(doc_id)")
    for t in ("pages", "documents", "labels"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    expected = sorted(r[-1] for r in con.execute(CATALOG.sql["anl28_unused_files"]).fetchall())
    assert expected == ["file u/a is not used", "file u/b is not used", "file u/b is not used"]
    assert sorted(r.message for r in CATALOG.queries["anl28_unused_files"](spark, str(tmp_path)).collect()) == expected
