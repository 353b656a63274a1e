"""Pair scores, clusters, transactions, diffs, prices and rules on hand-made papers."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.operators import lines as L
from tillsight.operators import pairs as P
from tillsight.operators import rules as U
from tillsight.operators import transactions as T

BASE = datetime(2042, 5, 6, 18)


def paper(i, kind, at=0, total=None, **more):
    t = BASE + timedelta(seconds=at)
    row = dict.fromkeys(schema.names(schema.DOCUMENTS))
    row |= {"document_id": i, "type": kind, "device_id": "d1", "session_id": "s", "job_id": f"j-{i}", "document_time": t, "captured_at": t + timedelta(seconds=1), "gross_total": None if total is None else Decimal(total), "complete": True, "economic_close": False, "payload_sha256": i}
    return row | more


def item(doc, seq, code, price=None, qty=1, total=None, description=None):
    row = dict.fromkeys(schema.names(schema.LINES))
    return row | {"document_id": doc, "sequence": seq, "item_code": code, "description": description, "quantity": Decimal(qty), "unit_price": None if price is None else Decimal(price), "line_total": None if total is None and price is None else Decimal(total if total is not None else price * qty), "removed": False}


def frames(spark, papers, items=(), pays=()):
    d = spark.createDataFrame([tuple(p[c] for c in schema.names(schema.DOCUMENTS)) for p in papers], schema.DOCUMENTS)
    ln = spark.createDataFrame([tuple(x[c] for c in schema.names(schema.LINES)) for x in items], schema.LINES)
    return d, ln, spark.createDataFrame([(a, "CASH", Decimal(b)) for a, b in pays], schema.PAYMENTS)


def scored(spark, papers, items=()):
    d, ln, _ = frames(spark, papers, items)
    x = P.described(d, ln)
    return x, P.score(P.all_pairs(x), x)


def grouped(spark, papers, items=()):
    x, s = scored(spark, papers, items)
    out = {}
    for r in P.clusters(x, s).collect():
        out.setdefault(r.cluster, set()).add(r.document_id)
    return sorted(map(sorted, out.values()))


def test_general_score_adds_up(spark):
    _, s = scored(spark, [paper("a", "ORDER", 0, 10, order_code="o 1", table_code="t"), paper("b", "PRE_BILL", 60, 10, order_code="O  1", table_code="T", device_id="d2")])
    r = s.first()
    assert (r.rule, r.score) == ("general", 35 + 12 + 12 + 3 + 8 + 8)


def test_general_score_is_zero_for_types_that_cannot_meet(spark):
    _, s = scored(spark, [paper("a", "COMMERCIAL_DOCUMENT", 0, 10, table_code="t"), paper("b", "COMMERCIAL_DOCUMENT", 60, 10, table_code="t")])
    assert s.first().score == 0
    _, s = scored(spark, [paper("a", "ORDER", 0, 10, order_code="1"), paper("b", "PRE_BILL", 7201, 10, order_code="1")])
    assert s.first().score == 0


def test_gates_and_references(spark):
    _, s = scored(spark, [paper("a", "COMMERCIAL_DOCUMENT", 0, 10, order_code="1"), paper("b", "PRE_BILL", 1, 10, order_code="1")])
    assert (s.first().rule, s.first().score) == ("boundary", 0)
    _, s = scored(spark, [paper("a", "PRE_BILL", 0, 10, order_code="1"), paper("b", "COMMERCIAL_DOCUMENT", 0, 10, order_code="2")])
    assert (s.first().rule, s.first().score) == ("conflict", 0)
    fiscal = paper("a", "COMMERCIAL_DOCUMENT", 0, 10, external_code="F-0042")
    _, s = scored(spark, [fiscal, paper("b", "CONFORMING_COPY", 60, 10, commercial_reference="f-0042")])
    assert (s.first().rule, s.first().score) == ("commercial_reference", 95)
    seen = fiscal | {"external_code": None, "external_suffix": "0042", "suffix_evidence": "RCH_STATUS_RESPONSE_SUFFIX_SEQUENCE_CONFIRMED", "table_code": "T"}
    copy = paper("b", "CONFORMING_COPY", 60, 10, commercial_reference="F-0042", table_code="t")
    _, s = scored(spark, [seen, copy], [item("a", 1, "X", 5), item("b", 1, "x", 5)])
    assert (s.first().rule, s.first().score) == ("suffix_reference", 100)
    _, s = scored(spark, [paper("a", "COMMERCIAL_DOCUMENT", job_id="J"), paper("b", "DEVICE_RESPONSE", 5, job_id="J")])
    assert (s.first().rule, s.first().score) == ("response", 90)


def test_table_sequences(spark):
    both = [item("a", 1, None, description="Caffè"), item("b", 1, None, description="CAFFE")]
    pre = lambda at: [paper("a", "PRE_BILL", 0, 10, table_code="T"), paper("b", "COMMERCIAL_DOCUMENT", at, 9, table_code="t")]
    assert scored(spark, pre(300), both)[1].first().rule == "table_sale"
    assert scored(spark, pre(301), both)[1].first().rule == "general"
    assert scored(spark, pre(100), [item("a", 1, "A"), item("b", 1, "B")])[1].first().rule == "general"
    change = [paper("a", "KITCHEN_ORDER", 0, table_code="T"), paper("b", "ORDER_CHANGE", 20, table_code="T")]
    assert scored(spark, change, both)[1].first().rule == "table_change"


def test_kitchen_tickets_do_not_chain(spark):
    k = lambda i, at, dev: paper(i, "KITCHEN_ORDER", at, table_code="lab-20", device_id=dev)
    assert grouped(spark, [k("a", 0, "p1"), k("b", 12, "p2"), k("c", 24, "p3"), k("d", 50, "p1")]) == [["a", "b", "c"], ["d"]]
    assert grouped(spark, [k("a", 0, "p1"), k("b", 600, "p2")]) == [["a"], ["b"]]


def test_episodes_on_one_table(spark):
    papers, items = [], []
    for n, at in enumerate((0, 600)):
        papers += [paper(f"p{n}", "PRE_BILL", at, 10, table_code="T"), paper(f"q{n}", "COMMERCIAL_DOCUMENT", at + 120, 9, table_code="T")]
        items += [item(f"p{n}", 1, "A", 10), item(f"q{n}", 1, "A", 9)]
    assert grouped(spark, papers, items) == [["p0", "q0"], ["p1", "q1"]]


def test_copy_joins_one_parent(spark):
    papers = [paper("a", "COMMERCIAL_DOCUMENT", 0, 10, external_code="F1"), paper("b", "COMMERCIAL_DOCUMENT", 100, 10, external_code="F1"), paper("c", "CONFORMING_COPY", 90, 10, commercial_reference="F1")]
    assert grouped(spark, papers) == [["a"], ["b", "c"]]


def test_candidates_equal_the_filtered_all_pairs(spark):
    d, ln, _ = frames(spark, [paper(f"d{i:02}", "ORDER", 1000 * i, table_code=f"T{i % 3}") for i in range(30)])
    x = P.described(d, ln)
    near = lambda a, b: a % 3 == b % 3 and 1000 * abs(a - b) <= 7200
    want = {(f"d{a:02}", f"d{b:02}") for a in range(30) for b in range(a + 1, 30) if near(a, b)}
    assert {(r.a, r.b) for r in P.candidates(x).collect()} == want


def sale(spark):
    papers = [paper("P", "PRE_BILL", 0, 100, order_code="80"), paper("C", "COMMERCIAL_DOCUMENT", 120, 50, order_code="80")]
    items = [item("P", 1, "A", 30), item("P", 2, "B", 40), item("P", 3, "C", 30), item("C", 1, "A", 1), item("C", 2, "B", 49)]
    d, ln, pay = frames(spark, papers, items, [("C", 50)])
    m = T.episodes(d)
    tx = T.transactions(m, pay)
    return m, tx, T.outcome_changes(m, tx, ln), ln, pay


def test_reduction_after_the_prebill(spark):
    m, tx, ch, ln, pay = sale(spark)
    r = tx.first()
    assert (r.difference, r.percent, r.split_payment, r.prebill_id) == (Decimal("50.0000"), Decimal("50.0000"), False, "P")
    assert {(c.item_key, c.change_type) for c in ch.collect()} == {("CODE:A", "PRICE_CHANGED"), ("CODE:B", "PRICE_CHANGED"), ("CODE:C", "REMOVED")}
    found = U.evaluate(U.Context(m, tx, ch, ln, T.events(m, pay, ch))).collect()
    assert [(f.rule_code, f.score, f.confidence) for f in found] == [("MODIFICA_POST_PRECONTO", 85, 95)]
    rest = tuple(r for r in U.RULES if r.code != U.PRIMARY)
    assert {f.rule_code for f in U.evaluate(U.Context(m, tx, ch, ln, T.events(m, pay, ch)), rest).collect()} >= {"PREBILL_FISCAL_AMOUNT_DROP", "ITEM_REMOVED_AFTER_PREBILL", "PRICE_REDUCED_AFTER_PREBILL", "EXTREME_PRICE_CHANGE"}


def test_split_bill_is_one_outcome(spark):
    papers = [paper("P", "PRE_BILL", 0, 100, order_code="80"), paper("C", "COMMERCIAL_DOCUMENT", 120, 50, order_code="80"), paper("D", "COMMERCIAL_DOCUMENT", 180, 50, order_code="80")]
    d, ln, pay = frames(spark, papers, [item("P", 1, "A", 50), item("P", 2, "B", 50), item("C", 1, "A", 50), item("D", 1, "B", 50)], [("C", 50), ("D", 50)])
    m = T.episodes(d)
    tx = T.transactions(m, pay)
    r = tx.first()
    assert r.split_payment and r.difference == 0 and r.payment_total == 100
    assert {c.change_type for c in T.outcome_changes(m, tx, ln).collect()} == {"UNCHANGED"}
    assert U.evaluate(U.Context(m, tx, T.outcome_changes(m, tx, ln), ln, T.events(m, pay, T.outcome_changes(m, tx, ln)))).count() == 0


def test_no_close_keeps_the_whole_difference(spark):
    d, ln, pay = frames(spark, [paper("P", "PRE_BILL", 0, 10, order_code="1")])
    tx = T.transactions(T.episodes(d), pay)
    assert (tx.first().difference, tx.first().final_total) == (10, 0)


def test_deltas_leave_residuals(spark):
    state = spark.createDataFrame([("t", "A", Decimal(2), Decimal(5)), ("t", "B", Decimal(1), None)], "t string, item_key string, quantity decimal(19,4), unit_price decimal(19,4)")
    deltas = spark.createDataFrame([("t", "A", 1, Decimal(-1), False), ("t", "B", 1, Decimal(-1), False), ("t", "C", 1, Decimal(-3), False), ("t", "D", 1, Decimal(2), False)], "t string, item_key string, ordinal int, quantity decimal(19,4), removed boolean")
    got = {r.item_key: (r.quantity, r.line_total) for r in L.apply_deltas(state, deltas, ["t"]).collect()}
    assert got == {"A": (1, 5), "D": (2, None)}


def test_price_attribution(spark):
    cols = "transaction_id string, line_id string, document_id string, sequence int, item_code string, description string, quantity decimal(19,4), unit_price decimal(19,4), line_total decimal(19,4)"
    rows = [("t", "s1", "P", 1, "X", "Pane", 1, 2, 2), ("t", "s2", "P", 2, None, "Vino  Rosso", 1, 5, 5), ("t", "s3", "P", 3, None, "vino rosso", 1, 6, 6), ("t", "s4", "P", 4, "Q", "Acqua", 2, None, 3), ("t", "s5", "P", 5, "Z", "Sale", 3, 1, 3)]
    s = spark.createDataFrame([(*r[:6], *(None if v is None else Decimal(v) for v in r[6:])) for r in rows], cols)
    t = spark.createDataFrame([("t", "k1", "X", "other", Decimal(1)), ("t", "k2", None, "VINO ROSSO", Decimal(1)), ("t", "k3", "Q", None, None), ("t", "k4", "Z", None, Decimal(1))], "transaction_id string, line_id string, item_code string, description string, quantity decimal(19,4)")
    got = {}
    for r in L.attribute_prices(t, s).collect():
        got.setdefault(r.target, []).append((r.status, r.basis[:4], r.unit_price, r.confidence_points))
    assert got["k1"] == [("RESOLVED", "ITEM", 2, 98)] and sorted(x[0] for x in got["k2"]) == ["AMBIGUOUS"] * 2 and got["k2"][0][3] == 49
    assert got["k3"] == [("RESOLVED", "ITEM", Decimal("1.5"), 85)] and "k4" not in got


def test_registry_rejects_a_rule_twice():
    with pytest.raises(ValueError, match="twice"):
        U.registry((U.RULES[0], U.RULES[0]))


def test_weight_rounds_half_to_even(spark):
    m, tx, ch, ln, _ = sale(spark)
    from dataclasses import replace

    half = replace(U.registry()[U.PRIMARY], weight=0.5)
    assert U.finding(U.Context(m, tx, ch, ln, None), half).first().score == 42  # 42.5


def test_chain_verifies_and_breaks(spark):
    log = spark.createDataFrame([("a", i, f"e{i}") for i in range(1, 6)], "k string, n int, p string")
    chain = log.join(T.hash_chain(log, "k", "n", F.col("p")), ["k", "n"])
    assert T.verify_chain(chain, "k", "n", F.col("p")).count() == 0
    assert [r.n for r in T.verify_chain(chain.withColumn("p", F.when(F.col("n") == 3, "x").otherwise(F.col("p"))), "k", "n", F.col("p")).collect()] == [3]
    import hashlib

    first = next(r for r in chain.collect() if r.n == 1)
    assert first.record_hash == hashlib.sha256(bytes(32) + b"e1").hexdigest()


def test_transaction_id_is_a_name_uuid(spark):
    import uuid

    r = spark.range(1).select(P.transaction_id(F.array(F.lit("b"), F.lit("a")), "v1").alias("u")).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "v1:a:b"))


def test_a_code_used_again_opens_a_new_episode(spark):
    papers = [
        paper("a1", "PRE_BILL", 0, 10, order_code="7"), paper("a2", "COMMERCIAL_DOCUMENT", 60, 9, order_code="7"), paper("a3", "ORDER_CHANGE", 90, order_code="7"),
        paper("b1", "PRE_BILL", 4000, 20, order_code="7"), paper("b2", "COMMERCIAL_DOCUMENT", 4060, 20, order_code="7"), paper("b3", "COMMERCIAL_DOCUMENT", 4070, 1, order_code="7"), paper("c1", "KITCHEN_ORDER", 9000, order_code="7"), paper("d1", "PRE_BILL", 4060, 5, order_code="8"),
    ]
    d, _, _ = frames(spark, papers)
    got = {r.document_id: r.transaction_key for r in T.episodes(d).collect()}
    assert got == {"a1": "7", "a2": "7", "a3": "7", "b1": "7#2", "b2": "7#2", "b3": "7#2", "c1": "7#3", "d1": "8"}
