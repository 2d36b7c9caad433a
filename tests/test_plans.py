"""What the plans of some queries look like: pushed filters, pruned columns, no needless shuffles."""

from ctxspark.plans import catalog


def test_search_has_no_shuffle_of_documents(spark, sf):
    from ctxspark.operators import retrieval
    from ctxspark.plans import relations

    plan = catalog.plan_of(retrieval.search(relations.chunks(spark, sf), "inea than", k=5))
    assert "hashpartitioning" not in plan
    assert "TakeOrderedAndProject" in plan


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = catalog.plan_of(catalog.read(spark, sf, "lineitem").where("l_linenumber = 1").select("l_partkey"))
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in plan
    assert "l_extendedprice" not in plan


def test_rollup_is_partial_first(spark, sf):
    plan = catalog.plan_of(catalog.queries()["tool_rollup"](spark, sf))
    assert "partial_sum" in plan


def test_interval_join_is_an_equi_join(spark, sf):
    plan = catalog.plan_of(catalog.queries()["changed_spans"](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_is_an_equi_join(spark, sf):
    plan = catalog.plan_of(catalog.queries()["claim_overlap"](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
