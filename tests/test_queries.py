"""Registered queries against their SQL in DuckDB."""

import decimal
import os

import duckdb
import pytest

from attesta.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.select(*columns).collect()), key=repr) == expected


def test_filter_on_a_verdict_stays_above_the_rules(spark):
    """Pushed below, the filter would repeat the whole tree of rules."""
    found = queries.results(spark, SF).where("error_code = 'SOURCE_TIMEOUT'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("SOURCE_TIMEOUT") < plan.index("Generate inline")


def test_every_sql_has_a_query():
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()


def test_a_reference_that_is_cut_off_stays(spark, tmp_path):
    """As in the SQL; an abstract of a service has it resolved, as HTML does."""
    pages = [(1, "<b>a &amp;&amp</b> b"), (2, "a &am<i>b</i> &lt;&gt &quot;&amp;amp &copy; &middot"), (3, "& &; &#"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.html_abstract_clean(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(con.execute(queries.ORACLE_SQL["html_abstract_clean"]).fetchall())
    assert spark.range(1).select(queries.tx.clean_markup(queries.F.lit("a &amp b"))).first()[0] == "a & b"


@pytest.mark.parametrize("name", ["numeric_claim_verdict", "pct_claim_verdict", "claim_verdicts"])
def test_evidence_is_never_broadcast(spark, name):
    """It is many times wider than the papers that Spark takes its size from."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_salt" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
