"""The registered queries over whole tables, against brute force, and the pipeline stage by stage."""

import collections
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import brute
from breachlens.llm import language
from breachlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    con = duckdb.connect()
    return con.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_one_row_per_document(spark, docs):
    ids = sorted(d[0] for d in docs)
    for name in QUERIES:
        if name not in ("op8_url_filter", "op11_conversations", "op12_warc", "op13_vector_codes"):
            assert sorted(r["doc_id"] for r in rows(spark, name)) == ids, name


def test_op3_op10_base(spark, docs):
    text = {d[0]: d[1] for d in docs}
    for name, kinds in (("op3_secrets", brute.SECRETS), ("op10_personal_data", brute.PERSONAL)):
        for r in rows(spark, name):
            assert r["base_sha256"] == brute.sha256(brute.base_spans(text[r["doc_id"]], kinds))


def test_op6_classes(spark, docs):
    groups = collections.defaultdict(set)
    for r in rows(spark, "op6_near_duplicates"):
        groups[r["class_id"]].add(r["doc_id"])
    brute.check_classes(groups.values(), [(d[0], d[1]) for d in docs])


def test_op6_recall_of_edited_copies(spark):
    """Over a larger set: all pairs whose words are 0.8 alike, and those that are 0.9 alike."""
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in duckdb.connect().sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    groups = collections.defaultdict(set)
    for r in QUERIES["op6_near_duplicates"](spark, sf).collect():
        groups[r["class_id"]].add(r["doc_id"])
    brute.check_classes(groups.values(), docs, 0.95)
    near = brute.alike(docs, 0.9)
    number = {d: k for k, g in groups.items() for d in g}
    assert sum(number[a] == number[b] for a, b in near) >= 0.98 * len(near)


def test_op7_held_out_accuracy(spark, docs):
    lang = {d[0]: d[2] for d in docs}
    held = [r for r in rows(spark, "op7_language_id") if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op9(spark, docs):
    items = duckdb.connect().sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute.contaminated([(d[0], d[1]) for d in docs], items)
    for r in rows(spark, "op9_decontaminate"):
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n, hit, len(found), brute.sha256(",".join(found)), hit > 0)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = table.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = table
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        assert table.columns[:len(columns)] == columns
        seen[name] = (before, table)
    before, after = seen["near_duplicates"]
    kept = {r[0] for r in after.select("doc_id").collect()}
    own = [(r[0], r[1]) for r in before.select("doc_id", "text").collect()]
    whole = brute.classes(own)
    assert all(group & kept for group in whole)
    assert len(kept) - len(whole) <= 0.1 * len(brute.alike(own))       # what the sketches miss
    before, after = seen["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contaminated([(r[0], r[1]) for r in before.select("doc_id", "text").collect()], items)
    assert {r[0] for r in after.select("doc_id").collect()} == {d for d, v in want.items() if not v[1]}
    before, after = seen["mix"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    before, after = seen["shard"]
    assert after.count() == before.count()
    for r in after.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n")).collect():
        assert (r["lo"], r["hi"]) == (0, r["n"] - 1)
    assert language.MIN_SCORE < 0.5 and "corpus_pipeline" in sys.modules


ODD = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, lang_pred string, spans string, row string"


@pytest.mark.parametrize("rows", [0, 40])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """An empty table; and one without labels, with nulls, repeated rows and columns named like those of the stages."""
    import corpus_pipeline

    texts = [f"Document number {i} has words of its own {i * i} and {i * 7} others, as {i} does." for i in range(rows)]
    made = [(i if i % 9 else None, t if i % 7 else None, None, None if i % 3 else "s", i, "a", None, "x", "1", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(made + made[:10], ODD)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", "nothing that any of these documents says in ten consecutive words at all")] if rows else [],
                          "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = out.collect()
    kept = {r["text"] for r in got}
    assert kept <= {t for _, t, *_ in made if t} and bool(kept) == bool(rows)
    assert sorted(r["slot"] for r in got if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in got)))
