"""Work that must not grow with the layout of the input: uneven scans, repeated runs of the rules, copied lists."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import mask as M
from inkveil.operators import rule_table
from inkveil.operators.sequence import number_rows
from inkveil.queries.registry import QUERIES
from inkveil.sources import files as SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_evens_out_rows_not_splits(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    uneven = spark.range(0, 16_000, 1, 2 * cores).where("id < 800")  # all rows in one of many splits
    sizes = [r["count"] for r in SF.spread(uneven).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and sum(sizes) == 800 and max(sizes) <= 2 * min(sizes)
    assert SF.spread(uneven, 10).rdd.getNumPartitions() == 80


def test_spread_keeps_later_filters_behind_the_exchange(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    out = SF.spread(spark.read.parquet(str(tmp_path / "t"))).where(F.col("text").rlike("7$"))
    assert plan(out).index("RLIKE") < plan(out).index("Repartition") and out.count() == 10


@pytest.mark.parametrize("per_row", [2, 1000])
def test_entities_of_items_are_found_once(spark, tmp_path, per_row):
    found = str(tmp_path / "found")
    spark.createDataFrame([(1, "ann bo"), (1, "cy"), (1, "di")], "doc_id long, text string").write.parquet(found)
    items = spark.createDataFrame([(1, 1, 0, "Ann"), (1, 1, 1, "n\nb"), (1, 1, 2, "y\nd"), (2, 1, 0, "cy")], "doc_id long, page_no long, item_no int, str string")
    manual = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got = M.highlight_items(items, spark.read.parquet(found), manual, per_row)
    assert not any(f.startswith(f"file://{found}") for f in got.inputFiles())
    assert {(r.doc_id, r.item_no): r.label for r in got.collect()} == {(1, 0): "detected", (1, 1): None, (1, 2): None, (2, 0): None}


def test_rows_to_number_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").mapInPandas(look, "k long, id long")
    got = number_rows(rows, ["k"], [F.col("id")]).collect()
    assert seen.value == 1000 and {(r.k, r.id): r.n for r in got} == {(i % 3, i): i // 3 + 1 for i in range(1000)}


def test_led_rules_do_not_shuffle_texts(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "abc abc"), (2, "ab"), (2, "xabcx"), (None, "abc")], "doc_id long, text string").write.parquet(docs)
    rules = spark.createDataFrame([("R", "abc", True, 0), ("S", "xabc", False, 0)], "rule string, pattern string, ignore_case boolean, group_no int")
    got = rule_table.scan_rule_table(spark.read.parquet(docs), rules, planned=1)
    assert not any(f.startswith(f"file://{docs}") for f in got.inputFiles())
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "R", 1, "abc"), (1, "R", 2, "abc"), (2, "R", 1, "abc"), (2, "S", 1, "xabc"), (None, "R", 1, "abc")]


def test_lists_of_targets_are_not_copied_to_every_page(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "ann"), (1, "bo"), (2, "cy")], "doc_id long, text string").write.parquet(path)
    pages = [(d, p, "ann bo cy") for d in (1, 2, 3) for p in (0, 10_000, 10_000, 90_000, None)]
    frame = spark.createDataFrame(pages, "doc_id long, page_no long, text string")
    want = sorted((d, p, {1: 2, 2: 1, 3: 0}[d]) for d, p, _ in pages if p is not None)
    for per_bucket in (4096, 2):
        monkeypatch.setattr(M, "PAGES_PER_BUCKET", per_bucket)
        got = M.redact_pages(frame, spark.read.parquet(path))
        rows = got.collect()
        assert sorted((r.doc_id, r.page_no, r.n_redactions) for r in rows if r.page_no is not None) == want
        assert [r.n_redactions for r in rows if r.page_no is None] == [0] * 3
    # A bucket comes from the number of a document's pages, not from their numbers.
    attached = M.attach_targets(frame, M.clean_targets(spark.read.parquet(path)))
    assert "FLOOR" not in plan(attached).upper()


@pytest.mark.parametrize("name", ["remove_entities", "verify_redaction"])
def test_rules_run_once(spark, tmp_path, name):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, "user", "Mail jo@x.org now")], "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame([(7, 3, 1200.5)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{sf}/orders.parquet")
    got = QUERIES[name](spark, sf)
    assert not any(f.endswith(".parquet") and "orders.parquet/" in f for f in got.inputFiles()) and got.count() > 0
