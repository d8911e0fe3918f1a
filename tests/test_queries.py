"""Every registered query against its SQL twin, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
import compare
from postmill.plans.registry import OPERATORS, QUERIES

SF = "/root/testdata/sf0.001"
INVENTORY = {"S": 12, "P": 26, "F": 12, "J": 10, "A": 22, "W": 6, "O": 6, "U": 3, "T": 17}


@pytest.fixture(scope="module")
def db():
    return compare.database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, db, name):
    assert compare.compare(spark, db, SF, name) == ""


def test_every_operator_has_a_query():
    wanted = {f"{k}{i:02d}" for k, n in INVENTORY.items() for i in range(1, n + 1)} | {f"ST{i}" for i in range(1, 10)}
    have = {op for ops in OPERATORS.values() for op in ops}
    assert wanted - have == set()
    assert have - wanted == set()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["mailing_id", "total_rows", "processed_rows", "duplicates_skipped", "invalid_emails",
                          "invalid_duplicates", "status"]
    assert df.count() == 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan_has_no_product_and_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoop", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan, plan


def test_columns_are_pruned_and_filters_reach_the_scan(spark):
    plan = _plan(entry.queries()["skip_existing"](spark, SF))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("o_totalprice" not in s and "o_orderpriority" not in s for s in scans)
    assert "EqualTo(o_orderstatus,F)" in plan


def test_stored_tables_prune_folders_and_push_filters(spark, tmp_path):
    from postmill.operators import intake, lookups
    from postmill.plans import views as v
    from postmill.sources import tables

    cands = intake.storable(intake.candidates(v.mail_rows_from(v.table(spark, SF, "orders"))))
    tables.append(intake.as_entries(cands, v.AS_OF), str(tmp_path), "mailing_entries")
    stored = tables.read_table(spark, str(tmp_path), "mailing_entries")
    one = lookups.pending(tables.of_mailing(stored, "m3")).select("email")
    plan = _plan(one)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert "EqualTo(status,PENDING)" in plan and "EqualTo(mailing_id,m3)" in plan
    assert "validation_details" not in plan
    assert one.count() == stored.where("mailing_id = 'm3' AND status = 'PENDING'").count() > 0
