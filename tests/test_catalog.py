"""Every registered query of the library against its SQL, at the smallest size."""

import math
import re

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple("" if x is None else str(x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.collect(), df.columns)
    result = duck.sql(ORACLES[name])
    columns = list(result.columns)
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["extract_title", "html_to_text", "section_between", "extract_links"])
def test_references_cut_short_match_sql(spark, tmp_path, name):
    """A text that ends inside a reference ('&amp') keeps it, as the SQL does."""
    pages = [(i, "http://x.org/a", f"<html><title>T{end}</title><article><h1>One &amp;&amp;{end}</h1><a href='/b?x=1'>L &lt;{end}</a>&nbsp;b{end}</article></html>") for i, end in enumerate(["", "&amp", "&am", "&lt", "&copy", "&"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df, result = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), list(result.columns))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) >= 112


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["html_to_text", "extract_links", "html_cells", "signed_sentence_value", "candidate_blocks", "history_rows"])
def test_extraction_stays_in_the_jvm(spark, name):
    # operators only: the table of character references holds names such as LeftArrow
    operators = re.findall(r"(?m)^[\s:+-]*(?:\*\(\d+\) )?([A-Z]\w+)", plan(QUERIES[name](spark, DATA)))
    assert "Project" in operators and not [x for x in operators for w in ("Python", "Pandas", "Arrow") if w in x]


def test_small_dimensions_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(QUERIES["leaderboard"](spark, DATA))


def test_filters_reach_the_scan(spark):
    assert "EqualTo(event_type,purchase)" in plan(QUERIES["scan_captures"](spark, DATA))


def test_all_confirmation_statuses_occur(spark):
    found = {r.status: r["count"] for r in QUERIES["classify_confirmation"](spark, DATA).groupBy("status").count().collect()}
    assert found == {"CONFIRMED": 21, "MISMATCH": 10, "NOT_UPDATED": 17, "ERROR": 12}
