import pytest

from tests.compare import assert_same
from tests.conftest import SMALL
from tidemark.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SMALL), duck, SQL[name])


def test_only_the_breaker_has_no_sql():
    assert set(catalog.queries()) - set(SQL) == {"breaker_states"}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def test_summary_of_the_larger_tables(spark):
    row = catalog.queries()["reconcile_summary"](spark, "/root/testdata/sf0.01").first()
    assert (row.matched_count, row.mismatched_count, row.missing_count, row.unexpected_count) == (1456, 28, 16, 100)
    assert (row.source_count, row.target_count) == (1500, 1584)


def test_counts_of_the_larger_tables(spark):
    d = "/root/testdata/sf0.01"
    claims = {r.outcome: r["count"] for r in catalog.queries()["claim_records"](spark, d).groupBy("outcome").count().collect()}
    assert claims == {"CLAIMED": 7322, "ALREADY_MIGRATED": 15264, "CLAIMED_BY_OTHER_WORKER": 22414}
    got = {(r.outcome, r.reason): r["count"] for r in catalog.queries()["delta_outcomes"](spark, d).groupBy("outcome", "reason").count().collect()}
    assert got == {
        ("DLT", "INCOMPLETE_EVENT"): 40, ("DLT", "REUSED_EVENT_ID"): 30, ("DLT", "SOURCE_NOT_FOUND"): 1, ("DLT", "INVALID_RECORD"): 118,
        ("DUPLICATE", None): 497, ("PROCESSED", None): 9845,
    }


def test_one_sided_drilldown_is_an_anti_join(spark):
    plan = catalog.queries()["missing_in_target"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "FullOuter" not in plan


def test_fingerprints_are_made_before_the_shuffle(spark):
    plan = catalog.queries()["reconcile_items"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join FullOuter")
    assert "sha2" in plan[join:] and "sha2" not in plan[:join]
