"""Physical plans: no join compares every pair, no Python runs, filters and columns reach the scans."""

import os
import re

import pytest
from pyspark.sql import functions as F

from larkspur.plans import registry
from larkspur.sources import manifests
from larkspur.sources.scratch import shared_dir
from larkspur.streaming import upserts
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_pairwise_join_and_no_python(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, DATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(registry.QUERIES["directory_page"](spark, DATA))
    assert "IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "TakeOrderedAndProject" in plan
    orders = re.search(r"ReadSchema: (struct<o_[^>]*>)", plan)
    assert orders is None or "o_orderpriority" not in orders[1]


def test_folders_of_other_years_are_not_opened(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("year"))
    manifests.write(orders, str(tmp_path / "orders"))
    found = manifests.read(spark, str(tmp_path / "orders"), "o_orderkey long, year int").where("year >= 1998")
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan_of(found))


def test_query_leaves_only_its_result(spark):
    before = set(os.listdir(shared_dir(spark)))
    assert registry.QUERIES["stream_upsert"](spark, DATA).count() > 0
    assert [name.rpartition("-")[0] for name in set(os.listdir(shared_dir(spark))) - before] == ["stream_upsert"]


def test_parts_of_a_streamed_table_are_merged(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 3).alias("v"))
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = upserts.latest_table(stream, ["k"], ["t"], str(tmp_path / "table"), merge_every=3)
    assert sorted(map(tuple, found.collect())) == sorted((t % 7, t, 3 * t) for t in range(393, 400))
    assert len(os.listdir(tmp_path / "table" / "rows")) <= 3
