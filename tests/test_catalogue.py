"""Every query of the engine against DuckDB on the same tables."""

import os

import duckdb
import pytest

from lodestrata.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name, tmp_path):
    catalogue.queries()[name](spark, SF).write.parquet(str(tmp_path / "got"))
    con.sql(f"create or replace table want as {catalogue.oracle_sql()[name]}")
    con.sql(f"create or replace table got as from '{tmp_path}/got/*.parquet'")
    kinds = [sorted((r[0], r[1]) for r in con.sql(f"describe {t}").fetchall()) for t in ("want", "got")]
    assert kinds[0] == kinds[1]
    cols = ", ".join(f'"{c}"' for c, _ in kinds[0])
    assert con.sql(f"select count(*) from got").fetchall() == con.sql("select count(*) from want").fetchall()
    assert con.sql(f"select {cols} from want except all select {cols} from got").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = catalogue.flagship(spark, SF).collect()
    assert sum(r["grain"] == 3 for r in rows) == 1 and all(r["complete"] for r in rows)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["select_slides"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:" in plan
    plan = catalogue.queries()["decision_cache"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in plan or "PushedFilters: [" in plan
    assert "WindowGroupLimit" in catalogue.queries()["budgeted_sample"](spark, SF)._jdf.queryExecution().toString()
