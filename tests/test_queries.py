"""Every registered query against its SQL, or for rows and a stable schema where it has none."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from mailgauge.plans import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(frame, columns):
    # Whole numbers with nulls are floats in one engine's frames and Int64 in the other's.
    return Counter(map(tuple, frame[columns].convert_dtypes().astype(str).replace({"None": "", "nan": "", "<NA>": ""}).values))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_points_without_a_reason(spark, tmp_path):
    """Messages whose only cue is too weak for a reason: result_issues takes their points as its SQL does."""
    import duckdb

    docs = [(6973, "Please open it."), (36821, "A payment."), (71, "Nothing here."), (155, "Please open it.")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["result_issues"](spark, str(tmp_path)).toPandas(), c.sql(SQL["result_issues"]).df()
    assert rows(got, ["email_id", "issues"]) == rows(want, ["email_id", "issues"])
    # The operator's own record still gives no reason for such a cue.
    said = {r.email_id: (r.raw_score, list(r.indicators)) for r in catalog._triage(spark, str(tmp_path)).select("email_id", "raw_score", "indicators").collect()}
    assert all(said[i][0] > 0 and said[i][1] == [] for i in (6973, 36821))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "verdict", "messages", "mean_risk"]


def test_no_row_at_a_time_python(spark, small):
    plan = QUERIES["triage"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan
