"""Plan shape: no Python UDFs, no full-table single-partition exchange."""

from fraudframe.operators import ranks
from fraudframe.plans.catalog import QUERIES

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_plan_has_no_python_and_no_single_partition(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL_DISTINCT", 0)   # force the range-partitioned path
    plan = _plan(QUERIES["build_features_fx1"](spark, SF_SMALL))
    assert "Python" not in plan and "ArrowEvalPython" not in plan
    # A single-partition exchange may only feed the final merge of a global
    # aggregate, i.e. sit directly above its partial (one row per task) side.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1] and "partial_" in lines[i + 1], line


def test_scan_prunes_columns(spark):
    df = QUERIES["headline_metrics"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan     # the events column no query needs is never read


def test_profile_queries_build_no_rank_table(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL_DISTINCT", 0)
    written = []
    monkeypatch.setattr(ranks, "materialize", lambda df, name: written.append(name))
    for key in ["validate_model_input", "time_features", "amount_features", "headline_metrics", "headline_metrics_fx2",
                "fraud_counts", "total_fraud_amount", "fraud_by_hour", "top_fraud_location", "top_fraud_card_type",
                "top_fraud_merchant", "fraud_distribution", "daily_timeline", "daily_timeline_join", "amount_histogram",
                "class_weights", "merchant_risk"]:
        QUERIES[key](spark, SF_SMALL)
    assert not written


def test_ranged_path_gives_the_same_feature_table(spark, monkeypatch):
    small = QUERIES["build_features_fx2"](spark, SF_SMALL).cache()
    monkeypatch.setattr(ranks, "SMALL_DISTINCT", 0)
    ranged = QUERIES["build_features_fx2"](spark, SF_SMALL)
    assert small.count() == ranged.count()
    assert small.exceptAll(ranged).count() == 0 and ranged.exceptAll(small).count() == 0


def test_analyse_flow_runs(spark):
    from fraudframe.plans import flows
    from fraudframe.sources.tables import fixture
    res = flows.analyse(fixture(spark, SF_SMALL, "fx1"), persist=True)
    try:
        assert res["headline_metrics"].first()["total_transactions"] == res["processed"].count()
        assert {"fraud_by_hour", "daily_timeline", "top_fraud_location"} <= set(res)
        text = flows.report_text(flows.summary_report(res["processed"]))
        assert text.startswith("=== FRAUD DETECTION ANALYSIS REPORT ===")
    finally:
        res["processed"].unpersist()


def test_timeline_join_equals_single_aggregate_and_class_split_is_complete(spark):
    a = QUERIES["daily_timeline"](spark, SF_SMALL)
    b = QUERIES["daily_timeline_join"](spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    whole = QUERIES["build_features_fx1"](spark, SF_SMALL)
    from fraudframe.plans.catalog import canonical, processed
    from fraudframe.operators import profile
    df = processed(spark, SF_SMALL, "fx1")
    parts = canonical(profile.fraud_rows(df).unionByName(profile.legit_rows(df)))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
