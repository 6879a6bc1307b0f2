"""What keeps receipt queries in proportion to their input: steps that are done once, and documents that leave whole."""

import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperslip.operators import dates as D
from paperslip.operators import fields as X
from paperslip.operators import items as I
from paperslip.operators import layout as Y
from paperslip.operators import lines as L
from paperslip.operators import records as R
from paperslip.plans import fixtures, io_queries, record_queries
from paperslip.streaming.state import DocumentLines

WORDS = "doc_id long, page int, word_id long, text string, x0 int, y0 int, x1 int, y1 int"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_gathered_once(spark, sf):
    assert optimized(fixtures.lines(spark, sf)).count("collect_list(") == 1


def test_tokens_meet_a_document_as_one_row(spark):
    fields = spark.createDataFrame([(1, "total", "5.00 gbp"), (2, "total", "x")], "doc_id long, field string, value string")
    lines = spark.createDataFrame([(1, 2, "TOTAL 5.00 GBP", "0.50"), (1, 1, "5.00", "0.90"), (1, None, "GBP", "0.10"), (3, 1, "x", "0.20")], "doc_id long, line_number long, text string, confidence string").withColumn("confidence", F.col("confidence").cast("decimal(6,2)"))
    found = R.token_confidence(fields, lines)
    assert optimized(found).count("Join ") == 1
    assert {(r.doc_id, r.token): float(r.confidence) for r in found.collect()} == {(1, "5.00"): 0.9, (1, "gbp"): 0.5, (2, "x"): 1.0}


def test_values_meet_a_document_as_one_row(spark):
    values = spark.createDataFrame([(1, "TOTAL"), (1, "2024-03-01"), (2, "none"), (1, None)], "doc_id long, value string")
    lines = spark.createDataFrame([(1, 3, "total"), (1, 2, "subtotal 01/03/2024"), (1, None, "total")], "doc_id long, line_number long, text string")
    found = D.locate_source_line(values, lines)
    assert optimized(found).count("Join ") == 1
    assert {(r.doc_id, r.value): r.line_number for r in found.collect()} == {(1, "TOTAL"): 2, (1, "2024-03-01"): 2, (2, "none"): None, (1, None): None}


def test_grouped_words_are_dealt_out_once(spark):
    words = spark.createDataFrame([(1, 1, 2, "b", 30, 1, 40, 9), (1, 1, 1, "a", 10, 0, 20, 8), (1, 1, 3, None, None, 3, 50, 9), (1, 1, 4, "c", 5, 20, 9, None), (2, 1, 1, "d", 1, 1, 2, 2)], WORDS)
    found = Y.group_words(words)
    assert optimized(found).count("Aggregate ") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a b", 10, 0, 50, 9), (1, 2, "c", 5, 20, 9, None), (2, 1, "d", 1, 1, 2, 2)]


def test_a_page_of_many_lines(spark):
    words = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("word_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit(0).alias("x0"), (F.col("id") * 20).cast("int").alias("y0"), F.lit(9).alias("x1"), (F.col("id") * 20 + 10).cast("int").alias("y1"))
    began = time.perf_counter()
    rows = Y.reconstruct_lines(words).orderBy("line_number").collect()
    assert time.perf_counter() - began < 10  # a minute and more by looking into all lines of the page for each word
    assert [r.text for r in rows] == [f"w{i}" for i in range(20_000)]


def test_each_amount_is_read_once(spark, sf):
    plan = optimized(X.mine_amounts(fixtures.lines(spark, sf)))
    assert plan.count(X.AMOUNT_RULES[0][1]) == 1 and plan.count(X.AMOUNT_RULES[11][1]) == 1


def test_each_item_is_read_once(spark):
    records = spark.createDataFrame([(1, '{"items": [{"name": "Tea", "qty": 2, "price": 3}, "Total", ["Cake", 4.5]]}')], "doc_id long, record string")
    found = I.normalize_items(records)
    assert optimized(found).count("$.description[0]") <= 2  # once and by nullif
    assert sorted((r.item_no, r.name, r.quantity, float(r.total_price)) for r in found.collect()) == [(1, "Tea", 2, 3.0), (3, "Cake", 1, 4.5)]


def test_recovered_items_are_not_gathered_again(spark):
    texts = spark.createDataFrame([(1, "ITEM QTY PRICE Tea 2 1.50 3.00 Cake 1 4.00 4.00 TOTAL 7.00"), (2, "ITEM none TOTAL")], "doc_id long, text string")
    found = I.recover_items_flat(texts)
    assert "Aggregate" not in optimized(found)
    assert sorted((r.doc_id, r.item_no, r.name, r.quantity, float(r.total_price)) for r in found.collect()) == [(1, 1, "Tea", 2, 3.0), (1, 2, "Cake", 1, 4.0)]


def test_recognition_json_is_made_from_lines(spark, sf):
    assert optimized(io_queries.s2_explode_ocr(spark, sf)).count("collect_list(") == 2  # of items and of lines


def test_candidate_lines_are_scored_once_and_only_where_they_may_count(spark):
    words = ["total", "sum", "net 5.00", "vat", "rate:", "£1.00", "2 x £3.50", "qty description", "ltd", "thank you", "5 %", "@ 3", "visa ****1234", "   ", "12/03/2024", None]
    lines = spark.createDataFrame([(i, k, t if s is None or t is None else f"{t} {s}") for i, s in enumerate(words) for k, t in enumerate(words)], "doc_id long, line_number int, text string")
    classes = L.classify_lines(L.line_features(lines))
    quick, every = L.candidate_lines(classes.where(L.has_summary_words())), L.candidate_lines(classes)
    assert set(map(tuple, quick.collect())) == set(map(tuple, every.collect())) and quick.count() > 50
    plan = optimized(quick)
    assert plan.count("pharmacy,supermarket") == 1  # once, and not in a filter for each rule that asks for it
    assert plan.index("zero\\ rated") > plan.index("pharmacy,supermarket")  # below the features


def test_findings_of_a_receipt_are_made_in_its_row(spark, sf):
    plan = optimized(record_queries.QUERIES["a19_score_findings"](spark, sf))
    assert plan.count("collect_list(") == 1  # each receipt is gathered once
    texts = ["TOTAL £5.00", "total 7.50 due 9.00", "Total 7.50", "VAT 1.00", "01/02/2024", "RECEIPT NO: R12", "cash", "VISA x", "Lorem ipsum", None, ""]
    lines = [(d, (d * k) % 4, texts[(d + k * k) % len(texts)]) for d in range(30) for k in range(d % 6)]
    lines = spark.createDataFrame(list(dict.fromkeys(lines)), "doc_id long, line_number long, text string").where("text IS NOT NULL").dropDuplicates(["doc_id", "line_number"]).localCheckpoint()
    best = X.best_candidate(X.candidates(lines)).select("doc_id", "field", "value")
    docs = X.with_best_fields(lines.groupBy("doc_id").agg(F.collect_list(F.struct("line_number", "text")).alias("lines")))
    assert sorted(map(tuple, docs.select("doc_id", F.inline("fields")).collect())) == sorted(map(tuple, best.collect())) and best.count() > 30
    claims = [(d, f, v) for d in range(8) for f, v in enumerate(["5.00", "7,50", "9", "Acme", "LOREM x", "cash", None, "", "0.00", "77.10", "acme 1234567"][d : d + 4])]
    things = [(d, k, n, p) for d in range(8) for k, (n, p) in enumerate([("Total thing", "5.00"), ("a b", "9.99"), ("Phantom", None), (None, "7.50")])]
    fields = spark.createDataFrame(claims, "doc_id long, field int, value string")
    items = spark.createDataFrame(things, "doc_id long, item_no int, name string, price string").withColumn("price", F.col("price").cast("decimal(14,2)"))
    whole = spark.createDataFrame([(d, t) for d, t in enumerate(["TOTAL 5.00", "lorem 7,50", "77.1 acme", None, "", "cash thing", "x", "9 total"])], "doc_id long, text string")
    joined = {"n_fields": R.ground_fields(fields, whole), "n_items": R.ground_items(items, whole), "n_placeholders": R.placeholder_hits(fields, whole)}
    of = lambda rows, *columns: rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("_a"))
    found = R.document_findings(whole.join(of(fields, "field", "value").withColumnRenamed("_a", "fields"), "doc_id").join(of(items, "name", "price").withColumnRenamed("_a", "items"), "doc_id")).collect()
    for kind, rows in joined.items():
        counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
        assert counts and {r.doc_id: r[kind] for r in found if r[kind]} == counts


@pytest.mark.parametrize("name", ["s1_read_words", "s3_read_classified_lines", "s6_write_results", "s7_export_training"])
def test_text_that_is_written_is_compressed(spark, sf, tmp_path, monkeypatch, name):
    monkeypatch.setattr(io_queries, "shared_path", lambda spark, tag: f"{tmp_path}/{tag}")
    assert io_queries.QUERIES[name](spark, sf).count() > 0
    parts = [f.name for f in tmp_path.rglob("part-*")]
    assert parts and all(f.endswith(".gz") for f in parts)


def test_a_document_asks_the_store_once():
    class Store:
        asked = 0

        def exists(self):
            self.asked += 1
            return True

        def get(self):
            self.asked += 1
            return [3], ["END"], 3, 12, False

        def update(self, value):
            self.value = value

        def getCurrentWatermarkInMs(self):
            return 0

    store, lines = Store(), DocumentLines("^END", 5)
    lines.handle = lines.state = store
    lines.is_last = re.compile("^END")
    assert list(lines.handleInputRows((1,), iter([Row(line_number=2, text="x", at=7)]), store)) == []
    assert store.asked == 1 and store.value == ([3, 2], ["END", "x"], 3, 12, False)
