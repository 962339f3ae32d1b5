"""Plan shapes that matter at scale."""

import re

import __spark_entry__ as entry

from hostloom.operators import features as X
from hostloom.plans import standin

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return text[: text.rindex("== Initial Plan ==")] if "== Initial Plan ==" in text else text


def test_feature_plan_scans_twice_and_shares_the_counts(spark):
    plan = final_plan(X.host_features(standin.sessions(spark, SF)))
    assert plan.count("FileScan") == 2
    assert plan.count("ReusedExchange") == 2
    # moments; counts by value, then by host; the reused ones add none.
    assert plan.count("Exchange hashpartitioning") <= 5
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "Python" not in plan


def formatted(df):
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    plan = formatted(entry.queries()["pro_edge_features"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "source_port" not in schema and "network_bytes" not in schema
    filters = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    for pushed in ("StringContains(event_provider,arkime)", "Not(StringContains(protocol,lldp))", "Not(StringContains(source_ip,:))"):
        assert pushed in filters


def test_time_range_of_the_slices_reaches_the_scan(spark):
    plan = formatted(entry.queries()["slice_sessions"](spark, SF))
    assert "GreaterThan(first_packet," in plan and "LessThanOrEqual(first_packet," in plan


def test_labels_of_present_hosts_need_no_lists_and_no_grid(spark):
    for name in ("slice_labels_present", "class_comparison", "slice_train_test"):
        plan = final_plan(entry.queries()[name](spark, SF))
        assert "ObjectHashAggregate" not in plan and "sequence(" not in plan and "Generate explode(sequence" not in plan, name


def test_slices_are_rebalanced_before_writing(spark, tmp_path):
    log = standin.sessions(spark, SF).selectExpr("source_ip AS ip", "CAST(ip_protocol AS STRING) AS slice").hint("rebalance", "slice")
    assert "REBALANCE_PARTITIONS_BY_COL" in formatted(log)


def test_addresses_are_tested_once_per_host(spark):
    for name in ("public_ips", "public_ips_by_ranges", "public_ips_by_changed_ranges", "ipv4_hosts", "labelled_hosts"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan[: plan.index("Aggregate [ip")], plan[plan.index("Aggregate [ip") :]
        assert "Filter" in above and "RLIKE" in above and "RLIKE" not in below, name


def test_slices_are_shuffled_by_number(spark):
    for name in ("slice_features", "feature_density"):
        plan = final_plan(entry.queries()[name](spark, SF))
        assert "Exchange hashpartitioning(slice_no" in plan and "Exchange hashpartitioning(slice#" not in plan, name
