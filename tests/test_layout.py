"""Bucketed fact layout: the line-to-order join runs without a shuffle."""

import uuid

from quayside.operators import loyalty
from quayside.plans.model import bucketed_star_model, sales_lines, star_model

SF = "/root/testdata/sf0.001"


def test_bucketed_facts_join_without_exchange(spark, scratch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # force a shuffle-style join
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        model = bucketed_star_model(spark, SF, 4, scratch, prefix=f"t{uuid.uuid4().hex[:8]}")
        joined = model.order_items.join(model.orders.withColumnRenamed("id", "order_id"), "order_id")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        # same answers as the plain layout
        a = {r["customer_id"]: r["category_diversity"]
             for r in loyalty.category_diversity(sales_lines(model)).collect()}
        b = {r["customer_id"]: r["category_diversity"]
             for r in loyalty.category_diversity(sales_lines(star_model(spark, SF))).collect()}
        assert a == b
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old_aqe)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from quayside.session import ensure_checkpoint_dir, is_local

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert is_local(session("local[4]")) and is_local(session("local")) and not is_local(session("local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(session("spark://host:7077"))
