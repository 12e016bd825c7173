"""Every query of the catalogue against its oracle, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from tidemark.plans import catalog, lake

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in lake.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE if not n.startswith("ML1")))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    r = duck.sql(catalog.ORACLE[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in catalog.ORACLE and not n.startswith(("ML13", "ML3", "ML1_", "ML12"))))
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["J4_equi_and_before", "J5_asof_strict", "J6_event_to_engaged", "J7_asof_two_keys", "J8_exists_ahead", "J9_count_before", "J10_late_notice", "Q9_history_counts", "Q10_labels"])
def test_plans_form_no_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("NestedLoop|CartesianProduct", plan)


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["D1_sec_date"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    plan = catalog.QUERIES["A26_unmatched_by_year"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan
