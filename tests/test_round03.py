"""Work that grows with the input: sparse trees, joins of the stand-in log, files of a stream, partial sums of a fit."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens import catalog
from breachlens.oracle_sql import ORACLES
from breachlens.plans import training
from breachlens.plans.forest import BalancedForest
from breachlens.sources.stand_in import stand_in_event_log

SF = "/root/testdata/sf0.001"


def test_trees_of_two_million_inputs(spark):
    """Dense rows would take 8 MB each. Input 0 tells the classes, input 2 is -1, absent (0) or 1."""
    width = 2_000_000
    rows = [(f"I{i}", i % 2, SparseVector(width, {k: v for k, v in ((0, float(i % 2)), (2, float(i % 3 - 1)), (10 + i, 1.0)) if v}))
            for i in range(200)]
    schema = T.StructType([T.StructField("number", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", VectorUDT())])
    df = spark.createDataFrame(rows, schema)
    forest = BalancedForest.fit(df, "number", "y", "x", 4, 2, 2, 1)
    assert forest.getNumTrees == 4 and len(forest.featureImportances) == width
    scored = forest.transform(df).select("probability").collect()
    assert all(r["probability"].toArray().sum() == pytest.approx(1) for r in scored)


def test_a_tree_takes_the_best_cut(spark):
    """Two inputs, both drawn at each node: the cut with the greatest gain, absent entries counted as zero."""
    values = [(-2.0, 0), (-1.0, 0), (0.0, 0), (0.0, 0), (1.0, 1), (2.0, 1)] * 20
    rows = [(f"I{i}", y, SparseVector(2, {0: v, 1: 1.0} if v else {1: 1.0})) for i, (v, y) in enumerate(values)]
    schema = T.StructType([T.StructField("number", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("x", VectorUDT())])
    tree = BalancedForest.fit(spark.createDataFrame(rows, schema), "number", "y", "x", 1, 1, 1, 1).groups[0].trees[0]
    assert tree.cut_input[0] == 0 and tree.cut[0] == 0.0 and tree.p[1:] == pytest.approx([0.0, 1.0]) and tree.gain[0] == pytest.approx(0.5)


def test_orders_meet_customers_before_line_items(spark):
    plan = stand_in_event_log(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = next(x for x in plan.splitlines() if "Join Inner" in x)
    assert "l_orderkey" in top and "o_orderkey" in top


def test_files_of_a_stream_grow_in_number():
    assert catalog.log_files(0) == catalog.log_files(6_000_000) == 6
    assert catalog.log_files(6_000_001) == 12 and catalog.log_files(216_000_000) == 216


def test_few_partial_sums_reach_the_driver():
    assert training.aggregation_depth(1) == 2
    def left(n, depth):
        scale = max(2, int(np.ceil(n ** (1 / depth))))
        while n > scale + np.ceil(n / scale):
            n //= scale
        return n
    for n in (8, 24, 200, 2000):
        assert left(n, training.aggregation_depth(n)) <= min(4, left(n, 2))


def test_the_roundtrip_has_a_row_per_incident():
    assert "SELECT number, TRUE AS same FROM inc" in ORACLES["model_roundtrip"]
