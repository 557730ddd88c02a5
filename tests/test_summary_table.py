"""Partial states merge to the summary of the whole log, in any split and order; batches can be run again."""

import random

import pytest
from pyspark.sql import functions as F

from breachlens.catalog import event_log
from breachlens.operators import summary
from breachlens.streaming.summary_table import SummaryTable, follow, merged, partial_state, summary_of

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def log(spark):
    return event_log(spark, SF).withColumn("number", F.when(F.col("number") == "INC0000001", None).otherwise(F.col("number"))).cache()


@pytest.fixture(scope="module")
def whole(log):
    return rows(summary.incident_summary(log, order_by="event_seq"))


def batches(log, n, seed):
    part = F.pmod(F.xxhash64("event_seq", "number", F.lit(seed)), F.lit(n))
    return [log.where(part == k) for k in range(n)]


@pytest.mark.parametrize("n,seed", [(1, 1), (4, 2), (9, 3)])
def test_any_split_and_order(log, whole, n, seed):
    states = [partial_state(b, "event_seq") for b in batches(log, n, seed)]
    random.Random(seed).shuffle(states)
    tree = states[0]
    for s in states[1:]:
        tree = merged(tree.unionByName(s))
    assert rows(summary_of(merged(tree))) == whole


def test_same_schema_as_the_summary(log):
    a, b = summary.incident_summary(log, order_by="event_seq"), summary_of(partial_state(log, "event_seq"))
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    few = log.select("number", "reopen_count")
    assert rows(summary_of(merged(partial_state(few)))) == rows(summary.incident_summary(few))


def test_table_of_batches(spark, log, whole, tmp_path):
    table = SummaryTable(spark, str(tmp_path / "t"), order_by="event_seq")
    with pytest.raises(ValueError, match="no batch"):
        table.state()
    parts = batches(log, 5, 7)
    for i in (0, 1, 1, 2):                      # one runs twice
        table.apply(parts[i], i)
    assert table.version() == -1 and table.compact() == 2 == table.version()
    table.apply(parts[0], 0)                    # a late repeat of a merged batch
    assert table.compact() == 2
    table.apply(parts[4], 3)
    table.apply(parts[3], 4)
    assert rows(table.summary()) == whole
    assert table.compact(vacuum=True) == 4
    assert rows(table.summary()) == whole
    assert {p.name for p in (tmp_path / "t" / "base").iterdir()} == {"version=4"}
    # a base whose writing failed is never read
    spark.range(1).write.parquet(str(tmp_path / "t" / "base" / "version=9"))
    assert rows(table.summary()) == whole
    table.apply(log.limit(0), 5)
    assert rows(table.summary()) == whole and table.compact() in (4, 5)


def test_stream(spark, log, whole, tmp_path):
    folder, table = str(tmp_path / "log"), SummaryTable(spark, str(tmp_path / "t"), order_by="event_seq")
    first, second = batches(log, 2, 4)
    first.repartition(3).write.parquet(folder)
    for more in (None, second):
        if more is not None:
            more.repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        follow(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        table.compact()
    assert rows(table.summary()) == whole


def test_sketches_merge_within_their_rank_error(spark):
    from breachlens.operators import explain, features, ranks, reports
    rng = random.Random(4)
    values = [rng.choice([0.0, 0.5, rng.random(), rng.random() ** 9]) for _ in range(20_000)]
    df = spark.createDataFrame([(v, v * 100, None if i % 3 else v) for i, v in enumerate(values)],
                               "sla_breach_probability double, total_events double, resolution_hours double").repartition(9)
    probs = {f"q{i}": i / 20 for i in range(21)}
    found = reports.score_quantiles(df, probs=probs, exact=False, rank_error=0.001)
    for r in reports.quantile_ranks(df, "sla_breach_probability", found, probs).collect():
        assert r["below"] <= r["q"] * r["n"] + 21 and r["upto"] >= r["q"] * r["n"] - 21, r
    exact, near = features.numeric_medians(df, ["total_events"]).first()[0], features.numeric_medians(df, ["total_events"], exact=False).first()[0]
    assert abs(exact - near) < 0.5
    stats = explain.driver_stats(df, exact=False)
    assert set(stats.columns) == {"total_events_median", "total_events_q75", "resolution_hours_median", "resolution_hours_q75"}
    assert "Exchange hashpartitioning" not in ranks.approximate_quantiles(df, {"total_events": {"m": 0.5}})._jdf.queryExecution().toString()
