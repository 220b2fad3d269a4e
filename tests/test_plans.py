"""Plan properties that hold the cost down at scale."""

import re

from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.operators import clean as C
from flowlake.operators import flows as FL
from flowlake.plans import clean_job
from flowlake.queries import bindings as B
from flowlake.session import new_folder
from flowlake.sources import flow_csv, sinks
from tests.conftest import plan_of
from tests.packets import frame, random_rows


def test_one_data_set_is_read_alone(spark, sf_dir):
    rows = spark.range(10).select(
        *[F.col("id").cast("string").alias(c) for c in S.FEATURES], F.lit("Bot").alias("Label"),
        F.lit("f").alias("Source_File"), F.when(F.col("id") < 5, "2017").otherwise("2018")
        .alias("Dataset"), F.col("id").alias(S.ROW_ORD), F.lit("p").alias("source_path"))
    path = new_folder(spark, "merged")
    sinks.write_merged(rows, path)
    one = flow_csv.read_merged(spark, path).where("Dataset = '2018'").select("Label")
    plan = plan_of(one)
    assert re.search(r"PartitionFilters: \[isnotnull\(Dataset#\d+\), \(Dataset#\d+ = 2018\)\]", plan)
    assert "ReadSchema: struct<Label:string>" in plan and one.count() == 5


def test_label_lookup_is_a_broadcast(spark, sf_dir):
    plan = plan_of(C.group_labels(B.raw_flows(spark, sf_dir), S.label_map(spark)))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_cleaning_shuffles_once(spark, sf_dir):
    plan = plan_of(clean_job.clean_rows(B.raw_flows(spark, sf_dir)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_scan_reads_what_is_used(spark, sf_dir):
    plan = plan_of(B.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_tax"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_packets_are_shuffled_once_by_slice(spark):
    """Whole packets move once, by (pair, slice); no window spans a whole pair of packets."""
    rows = FL.assign_flows(FL.prepare_packets(frame(spark, random_rows(4, n=80))), 15, 40)
    plan = plan_of(rows)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "slice" in shuffles[0]
    assert "SinglePartition" not in plan
