import pytest
from conftest import DATA, same_rows

import __spark_entry__ as entry
from assetloom.operators import similarity
from assetloom.plans import registry
from assetloom.plans import similarity as plans


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_plans(spark):
    for name in ("exact_dup_canonical", "issue_fact", "profile_plan", "hamming_pairs"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_pushdown(spark):
    plan = registry.QUERIES["failed_by_type_threshold"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


def test_water_fill_stays_within_budget(spark):
    out = registry.QUERIES["water_fill"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_star_groups_hold_direct_links(spark):
    links = {frozenset((r["a"], r["b"])) for r in similarity.hamming_pairs(plans._hashes(spark, DATA), "vec_id", "dhash", plans.WIDE).collect()}
    found = registry.QUERIES["star_groups"](spark, DATA).collect()
    assert found
    for r in found:
        assert r["anchor"] == r["item"] or frozenset((r["anchor"], r["item"])) in links
