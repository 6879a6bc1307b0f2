"""Hand-made edge rows: empty texts, damaged amounts and dates, ties, one-line documents."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperslip.operators import dates as D
from paperslip.operators import fields as X
from paperslip.operators import items as I
from paperslip.operators import knowledge as K
from paperslip.operators import layout as Y
from paperslip.operators import lines as L
from paperslip.operators import payment as P
from paperslip.operators import records as R
from paperslip.operators import vat as V


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, 1, ""),
        (2, 1, "ONE LINE LTD"),
        (3, 1, "ab"),
        (3, 2, None),
        (3, 3, "Total £1,234.56"),
        (3, 4, "TOTAL £1234.56"),
        (3, 5, "change due £9999.99"),
        (4, 1, "Date: 31/02/2024"),
        (4, 2, "2024-03-05"),
        (4, 3, "06/03/2024"),
        (5, 1, "VAT REG NO: GB123456789ABC"),
        (5, 2, "10% service, 250% no"),
        (6, 1, "xxxx1234 and ****************9876"),
        (6, 2, "ending in 5555"),
    ]
    return spark.createDataFrame(rows, "doc_id long, line_number long, text string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_classes_of_edge_lines(edge):
    got = {(r.doc_id, r.line_number): (r.line_type, r.rule) for r in L.classify_lines(L.line_features(edge)).collect()}
    assert got[1, 1] == got[3, 1] == got[3, 2] == ("IGNORE", "ignore_empty")
    assert got[2, 1][0] == "HEADER" and len(got) == 14


def test_amounts(edge):
    best = X.payable_amounts(edge)
    assert rows(best, "doc_id", "amount", "line_number", "n_candidates") == [(3, Decimal("1234.56"), 3, 2)]  # the first of equals, no change line
    assert rows(X.mine_rates(edge), "doc_id", "rate") == [(5, Decimal("10.00"))]


def test_dates_and_numbers(edge):
    got = D.mine_dates(edge.where("doc_id = 4")).collect()
    assert [(str(r.day), r.line_number) for r in got] == [("2024-03-05", 2)]  # 31 February is no date
    assert rows(X.mine_tax_numbers(edge), "doc_id", "number") == [(5, "GB123456789")]


def test_cards(edge):
    assert rows(P.mine_cards(edge), "doc_id", "last4", "tier") == [(6, "1234", 2)]


def test_ties_keep_the_first(spark):
    c = spark.createDataFrame([(1, "total", "a", 0.9, 2, 1), (1, "total", "b", 0.9, 1, 2), (1, "total", "c", 0.8, 0, 0)], "doc_id long, field string, value string, score double, line_number long, rule int")
    assert rows(X.best_candidate(c), "value") == [("b",)]


def test_grounding(spark):
    fields = spark.createDataFrame([(1, "total", "12.50"), (1, "tax", "0.00"), (1, "name", None), (1, "date", "nope"), (2, "total", "3.10")], "doc_id long, field string, value string")
    texts = spark.createDataFrame([(1, "Total 12,50"), (2, "total 3.1")], "doc_id long, text string")
    assert rows(R.ground_fields(fields, texts), "doc_id", "field") == [(1, "date")]


def test_reconciliation_of_known_runs(spark):
    docs = spark.createDataFrame([(1000, Decimal("75.01"), Decimal("15.00"), Decimal("90.01")), (7, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))], "doc_id long, subtotal decimal(16,2), tax decimal(16,2), total decimal(16,2)")
    items = spark.createDataFrame([(1000, Decimal("100.00")), (1000, Decimal("56.24"))], "doc_id long, price decimal(16,2)")
    assert rows(R.score_findings(X.reconcile_totals(docs, items).where("finding"), docs.select("doc_id", F.expr("0.5BD").alias("relevance"))), "doc_id", "n_findings") == [(1000, 1), (7, 0)]


def test_damaged_answers(spark):
    raw = [(1, '```json\n{"total": "1.00", "vendor": "A",}\n```'), (2, '{"total": "2.00" // note\n, "vendor": "B"}'), (3, '{"total": "3'), (4, None), (5, "{}")]
    got = R.ingest_responses(spark.createDataFrame(raw, "id long, raw string"))
    assert rows(got, "id", "parsed", "total") == [(1, True, "1.00"), (2, True, "2.00"), (3, False, None), (4, False, None), (5, False, None)]


def test_anchored_lines(spark):
    """The anchor is the line's first word: a drift of small steps breaks the line."""
    w = spark.createDataFrame([(1, 1, i, f"w{i}", 10 * i, 3 * i, 10 * i + 5, 3 * i + 12) for i in range(4)], "doc_id long, page int, word_id long, text string, x0 int, y0 int, x1 int, y1 int")
    assert rows(Y.group_words(w), "line_number", "text") == [(1, "w0 w1"), (2, "w2 w3")]


def test_reading_order_is_read_back(spark):
    rnd = [(1, 1, 100 * k + i, f"t{k}.{i}", 60 * i, 20 * k + (i * 7 % 3), 60 * i + 50, 20 * k + 12 + (i * 7 % 3)) for k in range(5) for i in range(4)]
    w = spark.createDataFrame(rnd[::-1], "doc_id long, page int, word_id long, text string, x0 int, y0 int, x1 int, y1 int")
    assert rows(Y.reconstruct_lines(w), "line_number", "text") == [(k + 1, " ".join(f"t{k}.{i}" for i in range(4))) for k in range(5)]


def test_upsert_is_idempotent(spark):
    kb = spark.createDataFrame([("a", "t", "old", 1), ("b", "t", "same", 1)], "id string, doc_type string, content string, version int")
    new = spark.createDataFrame([("a", "t", "new", 2), ("c", "t", "more", 1)], kb.schema)
    once = K.upsert_kb(kb, new)
    assert rows(once, "id", "content") == rows(K.upsert_kb(once, new), "id", "content") == [("a", "new"), ("b", "same"), ("c", "more")]


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 40, 999, 1000, 1001, 1960, 1961, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = [r.text for r in sorted(K.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.chunk)]
        assert got[0] + "".join(x[40:] for x in got[1:]) == text and all(len(x) <= 1000 for x in got)


def test_empty_tables(edge):
    none = edge.where("false")
    for f in (X.payable_amounts, X.mine_amounts, D.mine_dates, X.receipt_numbers, X.whole_texts, P.tag_payments, P.address_blocks, L.tag_sections, L.line_features):
        assert f(none).count() == 0


def test_names_anywhere_in_a_line(spark):
    suppliers = spark.createDataFrame([(1, "SUPPLIER#000000001"), (2, "TESCO"), (3, "Corner#Shop"), (4, ""), (5, None)], "s_suppkey int, s_name string")
    rows = [
        (1, 1, "WELCOME TO SUPPLIER 000000001"),
        (2, 1, "TESCO EXTRA STORE"),
        (3, 2, "the corner shop of York"),
        (4, 1, "WWW.TESCO.COM"),
        (5, 1, "Tesco"),
        (6, 1, "nobody"),
        (7, 1, None),
    ]
    lines = spark.createDataFrame(rows, "doc_id int, line_number int, text string")
    got = {r.doc_id: (r.suppkey, float(r.score)) for r in X.match_suppliers(lines, suppliers).collect()}
    assert got == {1: (1, 0.306), 2: (2, 0.333), 3: (3, 0.222), 4: (2, 0.25), 5: (2, 0.389)}
    vendors = {r.doc_id: (r.vendor, r.vendor_type, float(r.confidence)) for r in K.match_vendors(lines, suppliers.selectExpr("s_suppkey AS vendor", "replace(s_name, '#', ' ') AS name")).collect()}
    assert vendors == {1: (1, "other", 0.5), 2: (2, "other", 0.5), 3: (3, "other", 0.5), 4: (2, "other", 0.5), 5: (2, "other", 0.5), 6: (None, "other", 0.3), 7: (None, None, 0.0)}
    assert X.match_suppliers(lines, suppliers.where("false")).count() == 0


def test_vendor_terms_and_countries(spark):
    """Whole words two points, within words one, half a point for each address word, telephone and website; over 2 * patterns + 2."""
    vendors = spark.createDataFrame(
        [(1, "ACME", "UK", ["Mill Lane", "York"], r"\d{5} \d", None), (2, "ACME SHOP", "FR", None, None, "acme.example"), (2, "me sh", "FR", None, None, "acme.example"), (3, "ME SH", None, [""], "", None), (4, "C&A (UK)", None, None, None, None)],
        "vendor int, name string, country string, address array<string>, phone string, website string",
    )
    lines = spark.createDataFrame([(1, 1, "Acme, Shop"), (1, 9, "12 MILL LANE"), (1, 10, "tel 01234 56"), (2, 1, "Acme shop"), (2, 2, "www.ACME.example"), (3, 6, "Acme's pump"), (4, 1, None), (5, 1, "at c&a (uk) (c&a)"), (6, 1, "zACMEz pharmacy")], "doc_id int, line_number int, text string")
    countries = spark.createDataFrame([(1, "UK"), (2, "FR"), (3, None)], "doc_id int, country string")
    got = {r.doc_id: (r.vendor, float(r.confidence)) for r in K.match_vendors(lines, vendors, countries).collect()}
    assert got == {1: (1, 0.75), 2: (2, 0.5833), 3: (1, 0.5), 4: (None, 0.0), 5: (None, 0.3), 6: (None, 0.3)}
    kinds = {r.doc_id: r.vendor_type for r in K.match_vendors(lines, vendors, countries, first=5).collect()}
    assert kinds[3] == "petrol" and kinds[6] == "pharmacy" and kinds[4] is None


def brute_names(texts, names):
    return sorted((i, n) for i, t in enumerate(texts) for n in names if t is not None and n is not None and n.strip() and n in t)


@pytest.mark.parametrize("most", [1 << 25, 1 << 16])
def test_dictionary_equals_brute_force(spark, monkeypatch, most):
    """Names of all lengths, repeated and overlapping ones, other scripts, and a bit set that is too small for them."""
    from paperslip.operators import dictionary as D

    monkeypatch.setattr(D, "MOST_BITS", most)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé漢🙂 ") for _ in range(rnd.randint(1, 20)))
    names = [word() for _ in range(300)] + ["a", " ", "", None, "ab", "ab", "x" * 40, "x" * 41]
    texts = [word() + rnd.choice(names[:300]) + word() for _ in range(200)] + [None, "", "a", "x" * 100, "ab" * 50]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, number int")
    got = sorted((r.id, r.name) for r in D.names_in(lines, "text", known).collect())
    assert got == brute_names(texts, names)
    assert D.names_in(lines, "text", known.where("false")).count() == 0
    assert D.names_in(lines.where("false"), "text", known).count() == 0


def test_dictionary_sends_few_rows(spark):
    """A large dictionary of long names: what reaches the join is about what matches."""
    from paperslip.operators import dictionary as D

    known = spark.range(50_000).select(F.concat(F.lit("SUPPLIER "), F.lpad(F.xxhash64("id").cast("string"), 20, "0")).alias("name"))
    lines = known.limit(2000).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("AT "), F.col("name"), F.lit(" LTD")).alias("text")).unionByName(spark.range(20_000).select("id", F.concat(F.lit("line without any of them "), "id").alias("text")))
    found = D.names_in(lines, "text", known)
    assert found.count() == 2000
    sent = [p for p in str(found._jdf.queryExecution().executedPlan().toString()).split("\n") if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert not sent


def test_configured_suppliers_and_amounts(spark):
    names = spark.createDataFrame([("Tesco",), ("Tesco Extra",), ("Co",), (" ",)], "name string")
    lines = spark.createDataFrame(
        [(1, 1, " "), (1, 2, "at tesco extra."), (1, 3, "Tesco"), (2, 1, "Costco"), (2, 2, "12/05/2023"), (3, 9, "Tesco"), (4, 1, "a menu of Co"), (4, 2, "the co, of"), (4, 3, None), (5, 1, "welcome to joe's bar"), (5, 2, "Bar Ltd"), (6, 1, "Bar Ltd"), (7, 1, None)],
        "doc_id int, line_number int, text string",
    )
    got = {r.doc_id: (r.name, r.line_number, r.rule) for r in P.supplier_by_rules(lines, P.SUPPLIER_RULES, names, excludes=("MENU",)).collect()}
    assert got == {1: ("Tesco Extra", 2, 0), 2: ("Costco", 1, 3), 4: ("Co", 2, 0), 5: ("Joe's Bar", 1, 1), 6: ("Bar Ltd", 1, 2)}
    amounts = spark.createDataFrame([(1, 1, "Subtotal 1,234.50 of 3.00"), (1, 2, "9999.00"), (2, 1, "net amount: 16 05"), (3, 1, "net 0.00"), (4, 1, None)], "doc_id int, line_number int, text string")
    assert rows(P.amount_by_rules(amounts, P.NET_RULES), "doc_id", "amount") == [(1, Decimal("1234.50")), (2, Decimal("16.05"))]


def test_field_confidence_of_given_maps(spark):
    items = spark.createDataFrame([(4, {"price": Decimal("0.50"), "name": Decimal("0.90")}), (4, {"price": Decimal("0.70")}), (5, None)], "doc_id long, confidences map<string, decimal(3,2)>")
    own = spark.createDataFrame([(4, "name", Decimal("0.20")), (6, "date", Decimal("0.10"))], "doc_id long, field string, confidence decimal(3,2)")
    got = {(r.doc_id, r.field): float(r.confidence) for r in R.field_confidence(items, own).collect()}
    assert got == {(4, "price"): 0.6, (4, "name"): 0.2, (6, "date"): 0.1}


def test_every_benchmark_row_is_context(spark):
    from paperslip.plans.record_queries import _met

    docs = spark.range(130).select(F.col("id").alias("doc_id"))
    bench = spark.range(60).select(F.col("id").alias("item_id"), F.col("id").cast("string").alias("text"))
    context, said = _met(docs, bench)
    assert {r.context for r in context.collect()} == {str(i) for i in range(60)}
    assert {r.value for r in said.collect()} == {str(i) for i in range(0, 60, 2)}


# ---- retrieval


def _vectors(spark, n, seed, dim=16, kinds=3):
    import numpy as np

    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return [(i, [float(x) for x in centres[i % 12] + 0.3 * rnd.normal(size=dim)], i % kinds) for i in range(n)]


def brute_topk(queries, base, k, same):
    import numpy as np

    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    good = [(i, unit(v), f) for i, v, f in base if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all()]
    out = []
    for q, v, f in queries:
        if v is None:
            continue
        hits = sorted((-round(float(unit(v) @ u), 6), i) for i, u, g in good if not same or f == g)[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    """Several blocks and chunks, ties, vectors that take no part, and a filter value without rows."""
    from paperslip.operators import retrieval as RT

    monkeypatch.setattr(RT, "BLOCK", 40)
    monkeypatch.setattr(RT, "CHUNK", 5)
    base = _vectors(spark, 300, 1) + [(1000 + i, [1.0] * 16, 0) for i in range(60)] + [(2000, None, 0), (2001, [1.0] * 15, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0] * 15 + [None], 1), (2004, [0.0] * 16, 1)]
    asked = [(i, v, f) for i, v, f in _vectors(spark, 20, 2)] + [(50, [1.0] * 16, 0), (51, [2.0] * 16, 7), (52, None, 0)]
    schema = "embedding array<double>, label int"
    kb = spark.createDataFrame(base, "vec_id long, " + schema).repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, " + schema).repartition(2)
    got = sorted(tuple(r) for r in K.similarity_topk(queries, kb, 7, ["label"]).collect())
    assert got == brute_topk(asked, base, 7, True)
    retried = sorted((*tuple(r)[:4], r.filtered) for r in RT.with_retry(queries, kb, 4, ["label"]).collect())
    want = [(*r, True) for r in brute_topk([a for a in asked if a[2] != 7], base, 4, True)] + [(*r, False) for r in brute_topk([a for a in asked if a[2] == 7], base, 4, False)]
    assert retried == sorted(want)
    assert K.similarity_topk(queries, kb.where("false"), 3, ["label"]).count() == 0 == K.similarity_topk(queries.where("false"), kb, 3, ["label"]).count()


def test_index_finds_most_with_few_candidates(spark):
    """In clustered vectors 0.95 of the best rows lie in few cells; all cells give the exact result."""
    from paperslip.operators import retrieval as RT

    every = _vectors(spark, 3060, 5)
    base, asked = every[:3000], every[3000:]
    schema = "embedding array<double>, label int"
    kb, queries = spark.createDataFrame(base, "vec_id long, " + schema), spark.createDataFrame(asked, "query_id long, " + schema)
    index = RT.build_index(kb, ["label"])
    probes = RT.probes_for(index, kb, queries, 10, ["label"])
    assert probes < len(index.centroids) / 3
    exact = {tuple(r)[:2] for r in K.similarity_topk(queries, kb, 10, ["label"]).collect()}
    found = {tuple(r)[:2] for r in K.similarity_topk(queries, index, 10, ["label"], probes).collect()}
    assert len(found & exact) >= 0.9 * len(exact) == 540
    all_cells = sorted(tuple(r) for r in K.similarity_topk(queries, index, 10, ["label"], len(index.centroids)).collect())
    assert all_cells == sorted(tuple(r) for r in K.similarity_topk(queries, kb, 10, ["label"]).collect())


def test_index_on_the_test_vectors(spark):
    """Recall on `embeddings`, and how much of the table the cells leave out."""
    from paperslip.operators import retrieval as RT
    from paperslip.plans.more_queries import _search

    queries, kb = _search(spark, "/root/testdata/sf0.01")
    index = RT.build_index(kb, ["label"])
    probes = RT.probes_for(index, kb, queries, 10, ["label"])
    exact = {tuple(r)[:2] for r in K.similarity_topk(queries, kb, 10, ["label"]).collect()}
    found = {tuple(r)[:2] for r in K.similarity_topk(queries, index, 10, ["label"], probes).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_context_masks_and_drops(spark):
    hits = spark.createDataFrame([(1, 2, "paid with ****1234 on 01/02/2024: 5.00\nExample: drop me"), (1, 1, None), (1, 3, " "), (1, 4, "card 4111 1111 1111 1111"), (2, 1, "x" * 400)], "query_id int, rank int, text string")
    assert rows(K.build_context(hits, most=200), "query_id", "context") == [(1, "paid with [card] on [date]: [n]\ncard [card]"), (2, "x" * 150)]


# ---- dates, amounts, VAT lines, items


@pytest.mark.parametrize(
    ("texts", "day"),
    [
        (["31/02/2024", "no date"], None),
        (["1st of May", "May 3rd, 2021"], "2021-05-03"),
        (["Date: 03/04/05"], "2005-04-03"),
        (["01/02/1999", "02/03/2021"], "2021-03-02"),  # recent years first
        (["121314 then 5/6/21"], "2021-06-05"),  # medium before low priority
        (["3 Sept '24"], "2024-09-03"),
        (["1/2/2022", "invoice 3/4/2022"], "2022-04-03"),  # longer, with its label
        (["20230431", "20230430"], "2023-04-30"),
        (["12/11/1899", "1.1.2101"], None),
        ([None, ""], None),
    ],
)
def test_best_date(spark, texts, day):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id long, line_number long, text string")
    assert [str(r.day) for r in D.mine_dates(lines).collect()] == ([day] if day else [])


def test_located_renderings(spark):
    values = spark.createDataFrame([(1, "2024-03-05"), (2, "2024-03-05"), (3, "2024-13-05"), (4, "R77")], "doc_id int, value string")
    lines = spark.createDataFrame([(1, 1, "no"), (1, 2, "MARCH 05, 2024"), (2, 1, "5.3.24"), (3, 1, "at 2024-13-05"), (4, 3, "no r77"), (4, 2, None)], "doc_id int, line_number int, text string")
    assert rows(D.locate_source_line(values, lines), "doc_id", "line_number") == [(1, 2), (2, None), (3, 1), (4, 3)]


def test_vat_lines_that_are_none(spark):
    texts = ["", None, "VAT", "20%", "10% OFF £5.00", "TOTAL 1.00 2.00 3.00", "VAT REG NO 12.34", "3.00 4.00 5.00", "%%% ((", "VAT RATE", "VAT RATE NET", "1.00 2.00", "TOTAL £5.00"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, line_number int, text string")
    assert rows(V.parse_vat_lines(lines), "line_number", "layout") == [(11, "tokens")]
    far = spark.createDataFrame([(1, 0, "VAT RATE NET"), *((1, i, "x") for i in range(1, 10)), (1, 10, "1.00 2.00")], "doc_id int, line_number int, text string")
    assert V.parse_vat_lines(far).count() == 0


def test_triplets_of_scrambled_numbers(spark):
    texts = [
        (1, "ITEM QTY Masala Dosa 2 59.00 118.00 Vada 1 25.00 25.00 TOTAL 143"),
        (2, "QTY 2 59.00 118.00 1 69.00 69.00 MasalaDosa TOTAL"),
        (3, "25 50,5 7 only one SUBTOTAL"),
        (4, "no numbers at all"),
        (5, None),
        (6, ""),
        (7, "9.50 Tea Total"),
        (8, "a 1 2.00"),
    ]
    got = rows(I.recover_items_flat(spark.createDataFrame(texts, "doc_id int, text string")), "doc_id", "item_no", "name", "quantity", "unit_price", "total_price")
    d = lambda x: None if x is None else Decimal(x)
    assert got == [
        (1, 1, "Masala Dosa", 2, d("59.00"), d("118.00")),
        (1, 2, "Vada", 1, d("25.00"), d("25.00")),
        (2, 1, "Masala", 2, d("59.00"), d("118.00")),
        (2, 2, "Dosa", 1, d("69.00"), d("69.00")),
        (3, 1, "only", 1, d("25.00"), d("50.50")),
        (3, 2, "one", 1, None, d("7.00")),
        (7, 1, "Tea", 1, None, d("9.50")),
        (8, 1, "a", 1, d("1.00"), d("2.00")),
    ]


def test_items_of_odd_answers(spark):
    records = [(1, None), (2, ""), (3, "[1, 2]"), (4, '{"items": {"name": "no array"}}'), (5, '{"items": [null, {"name": "Tea", "quantity": "two", "price": "1,234.50 EUR"}, {"quantity": 2}, ["Cake", {"price": 2.5, "qty": 3}], ["Pie", "x", "y"]]}')]
    got = rows(I.normalize_items(spark.createDataFrame(records, "doc_id int, record string")), "doc_id", "item_no", "name", "quantity", "total_price")
    assert got == [(5, 2, "Tea", 1, Decimal("1234.50")), (5, 3, "N/A", 2, None), (5, 4, "Cake", 3, Decimal("2.50")), (5, 5, "Pie", 1, None)]
    dirty = [(1, '{"receipt_number": "[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]", "qty": 2}'), (2, '{"receipt_number": "A[1]", "note": null}'), (3, "no json")]
    assert rows(I.clean_records(spark.createDataFrame(dirty, "doc_id int, record string")), "doc_id", "field", "value") == [(1, "receipt_number", None), (2, "note", None), (2, "receipt_number", "A[1]")]


def test_stated_discounts_and_readings(spark):
    details = spark.createDataFrame([(1, Decimal("2.00")), (1, Decimal("3.00")), (2, Decimal("1.00")), (3, Decimal("0.00"))], "doc_id int, amount decimal(16,2)")
    lines = spark.createDataFrame([(1, 5, "Total discount: £1,007.50"), (1, 6, "you saved: 1"), (4, 1, "discount total : 3"), (5, 1, None)], "doc_id int, line_number int, text string")
    assert rows(P.discount_totals(details, lines), "doc_id", "total", "stated") == [(1, Decimal("1007.50"), True), (2, Decimal("1.00"), False), (3, None, False), (4, Decimal("3.00"), True)]
    heads = spark.createDataFrame([(1, 1, "ACME LTD", 0.5), (2, 1, "ACME LTD", None)], "doc_id int, line_number int, text string, confidence double")
    low, plain = (r.score for r in X.score_suppliers(heads).orderBy("doc_id").collect())
    assert plain - low == Decimal("0.060")


def test_a_date_is_read_once_and_only_by_formats_of_its_shape(spark):
    lines = spark.createDataFrame([(1, 1, "Date: 03/04/2021 or MAY 3RD, 2021")], "doc_id long, line_number long, text string")
    plan = D.dates_in(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * 7 * len(D.RULES)  # once per rule, and not again in each format and in a filter
    texts = ["1-2-2021", "01022021", "May 3 2021", "2021-05-03T10:11:12", "1.1.2101", "12/11/1899", "3.4.69", "3.4.68", "30 Feb 2021", "Jan 021999", "20231399"]
    days = spark.createDataFrame([(t,) for t in texts], "t string").select(D.parsed(F.col("t")).cast("string")).collect()
    assert [d[0] for d in days] == ["2021-02-01", "2021-02-01", "2021-05-03", "2021-05-03", None, None, "1969-04-03", "2068-04-03", None, "1999-01-02", None]


def test_features_are_small_methods_and_classes_are_computed_once(spark):
    texts = ["VAT @ 20% £1.00", "x" * 300, "me@a.co www.a.com +44 01234 567890", "TEL 12345678901", "****1234 xx1234 AB1 2CD", "1/2/21 10:30 3% @ 5 5 %", "  two  words ", None, ""]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id long, line_number long, text string")
    got = L.line_features(lines)
    for name, pattern in L.PATTERNS.items():  # a pattern's quicker test loses none
        assert got.where(F.col(f"n_{name}") != F.regexp_count("text", F.lit(pattern))).count() == 0
    classes = L.classify_lines(got)
    rows_ = L.vat_candidates(classes).select("line_number", "known", "header").collect()
    assert sorted(tuple(r) for r in rows_) == [(1, True, False), (6, True, False)]
    plan = L.vat_candidates(classes)._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString()
    debug = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = [debug.codegenStringSeq(f._jdf.queryExecution().executedPlan()) for f in (L.vat_candidates(classes), classes)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [s.apply(i)._3().maxMethodCodeSize() for s in stages for i in range(s.size())]
    assert sizes and all(0 < size < 8000 for size in sizes)  # what the JVM compiles


def test_a_name_given_often_meets_a_line_once(spark):
    from paperslip.operators import dictionary

    seen = []
    whole = dictionary.names_in
    names = spark.createDataFrame([("Supplier",)] * 50 + [("supplier",)], "name string")
    lines = spark.createDataFrame([(1, 1, "THE SUPPLIER 7")], "doc_id int, line_number int, text string")
    try:
        dictionary.names_in = lambda *a: seen.append(whole(*a)) or seen[-1]
        assert [tuple(r) for r in dictionary.first_known(lines, names).collect()] == [(1, 1, "Supplier")]
    finally:
        dictionary.names_in = whole
    assert seen[0].count() == 2  # both spellings, not 51 rows


def test_tokens_of_a_vat_line_are_typed_once(spark):
    lines = spark.createDataFrame([(1, 1, "VAT @ 20% £1.00"), (1, 2, None)], "doc_id int, line_number int, text string")
    found = V.parse_vat_lines(lines)
    assert rows(found, "line_number", "layout", "vat") == [(1, "word_at_rate", Decimal("1.00"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(V.TOKENS[1][1]) == 1


def test_keywords_are_counted_without_a_term_per_word(spark):
    """A sum of a term per keyword is a method that the JVM's compiler leaves interpreted."""
    texts = ["", None, "TOTAL  £1.20", "Tesco Express Ltd, co-op", "VAT @ 20% incl. tax", "sub total due amount"]
    out = L.line_features(spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "doc_id long, line_number long, text string"))
    for r in out.collect():
        for k, words in L.KEYWORDS.items():
            assert r[f"n_{k}"] == sum(w in (texts[r.doc_id] or "").lower() for w in words), (r.doc_id, k)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(") < 40
