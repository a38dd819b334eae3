"""Files, estate, reconciliation and streams on small fixtures; plans and SQL checks."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.catalog.adapters import view
from creditloom.plans import copybooks, estate, jcl, recon
from creditloom.session import scratch_path
from creditloom.sources import fixed, layouts, portfolio
from tests.oracle import ROOT, compare, connect


def lines_df(spark, files):
    return spark.createDataFrame([(f, i + 1, t) for f, text in files.items() for i, t in enumerate(text)], "file string, line_no long, text string")


def test_record_widths():
    assert [layouts.width(x) for x in (layouts.LOAN, layouts.CUSTOMER, layouts.COLLATERAL, layouts.GUARANTEE, layouts.SANCTION, layouts.SCORE_RESULT, layouts.RECOVERY_ACTION, layouts.LEDGER_CUSTOMER, layouts.LEDGER_TXN)] == [
        238, 434, 253, 130, 200, 229, 238, 103, 35]


def test_manifest_md5(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"x" * 20)
    row = fixed.file_manifest(spark, str(tmp_path), 10).first()
    assert (row.file_name, row.md5, row.size_bytes, row.record_count) == ("a.dat", hashlib.md5(b"x" * 20).hexdigest(), 20, 2)


def test_binary_ledger_records(spark, tmp_path):
    raw = b"".join(c.encode().ljust(10) + b"T1".ljust(10) + b"DB" + bytes.fromhex(p) + b"20260531" for c, p in (("1", "000012345d"), ("2", "000000099c")))
    (tmp_path / "t.dat").write_bytes(raw)
    got = fixed.read_fixed_binary(spark, str(tmp_path / "t.dat"), layouts.LEDGER_TXN).orderBy("txn_id").collect()
    assert [(r.txn_id, r.cust_id, r.txn_type, r.amount_cents, r.txn_date) for r in got] == [("1", "T1", "DB", -12345, 20260531), ("2", "T1", "DB", 99, 20260531)]


def test_copy_rings_and_replacing(spark):
    src = lines_df(spark, {"P": ["       01 A.", "           COPY B1 REPLACING ==INV== BY ==SALES==.", "      *    COPY NO."]})
    books = lines_df(spark, {"B1": ["          05 INV-X PIC X.", "          05 INVALID PIC X.", "           COPY B2."], "B2": ["           COPY B1.", "           COPY GONE."]})
    got = [r.text.strip() for r in copybooks.expand(src, books, marks=False).orderBy("place").collect()]
    assert got == ["01 A.", "05 SALES-X PIC X.", "05 INVALID PIC X.", "* >>>CIRCULAR COPY: B1<<<", "* >>>UNRESOLVED COPY: GONE<<<", "*    COPY NO."]
    status = {r.copybook: r.status for r in copybooks.closure(src, books).collect()}
    assert status == {"B1": "circular", "B2": "circular", "GONE": "unresolved"}


def test_condition_stack_and_rings(spark):
    code = ["       PROCEDURE DIVISION.", "       A.", "           END-IF", "           PERFORM B", "           IF X = 1", "           PERFORM B", "           END-IF", "           PERFORM D.", "       B.", "           PERFORM C.",
            "       C.", "           STOP RUN.", "       D.", "           PERFORM E.", "       E.", "           STOP RUN.", "       R1.", "           PERFORM R2.", "       R2.", "           PERFORM R1."]
    ctx = estate.with_context(estate.code_lines(lines_df(spark, {"P": code})))
    edges = estate.call_edges(ctx)
    assert [(r.dst, r.conditional) for r in edges.orderBy("line_no").limit(3).collect()] == [("B", False), ("B", True), ("D", False)]
    pars = estate.paragraphs(ctx)
    seg = {r.paragraph: r.segment for r in estate.segments(pars, estate.internal_calls(edges, pars)).collect()}
    assert seg == {"A": "A", "B": "B", "C": "B", "D": "A", "E": "A", "R1": "R1", "R2": "R1"}


def test_step_conditions(spark):
    deck = ["//J JOB (A),", "//         CLASS=B", "//S1 EXEC PGM=P1", "//S2 EXEC PGM=P2,COND=(0,NE)", "//S3 EXEC PGM=P3,COND=(8,LT,S1)", "//S4 EXEC PGM=P4,COND=(4,EQ)"]
    steps = jcl.jcl_steps(jcl.statements(lines_df(spark, {"D": deck})))
    for rc, want in (({"S1": 0, "S2": 0, "S3": 0}, {"S1": True, "S2": True, "S3": True, "S4": True}), ({"S1": 12, "S3": 4}, {"S1": True, "S2": False, "S3": False, "S4": False})):
        codes = spark.createDataFrame([("D", k, v) for k, v in rc.items()], "file string, step string, rc long")
        assert {r.step: r.runs for r in jcl.step_runs(steps, codes).collect()} == want


@pytest.mark.parametrize(
    "b,a,kind",
    [
        ("  hello  ", "hello", "exact"), ("JOB v6.0 - START 20260525-471200", "JOB v6.0 - START 20260601-093000", "date"), ("TOTAL PROV: 10875.330", "TOTAL PROV: 10875.331", "tolerant"),
        ("TOTAL PROV: 10000", "TOTAL PROV: 10500", "numeric mismatch"), ("CLASS 1: 000004", "CLASS_X: 000004", "number count differs"), ("abc", "abd", "text differs"),
        ("ENC=000000104481856", "ENC=000000104481800", "tolerant"), ("A 5", "B 5", "text skeleton differs"), ("CLASS 2 LOANS: 5 AMOUNT: 7", "CLASS 2 LOANS: 5", "exact"),
    ],
)
def test_tolerant_compare(spark, b, a, kind):
    pairs = recon.pair_lines(lines_df(spark, {"f": [b]}), lines_df(spark, {"f": [a]}))
    assert recon.compare_tolerant(pairs).first().kind == kind


def test_json_walk(spark):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": [1, {"c": 2}], "d": null}', '{"a": 1.5, "b": [1, {"c": 3}], "e": 1}'), (2, "[]", "{}"), (3, '{"x": []}', '{"x": [1]}')], "doc_id int, expected string, actual string")
    got = {(r.doc_id, r.path, r.kind) for r in recon.diff_json(docs).collect()}
    assert got == {(1, "a", "type"), (1, "b[1].c", "value"), (1, "d", "missing"), (1, "e", "extra"), (2, "$", "type"), (3, "x", "length")}


def test_portfolio_can_be_screened(spark):
    from creditloom.plans import credit

    p = portfolio.make_portfolio(spark, 2000)
    ev = credit.evaluate_loans(p["loans"], p["customers"], p["collateral"], p["guarantees"], p["sanctions"], 20260531)
    counts = {r.outcome: r["count"] for r in ev.groupBy("outcome").count().collect()}
    assert sum(counts.values()) == 2000 and counts["SCORED"] > 1000


CHECKED = ["i14_evaluate_loans", "i14_evaluate_loans_clean", "d1", "i15", "e5", "i18", "i21", "d10", "d7", "a12", "i24_auto_premium_clean", "c12", "e4", "j2_", "j3_diff", "g5", "e8", "k10", "k6", "k24", "e11", "k16", "k17", "l3", "l7", "l6", "e10", "a2_", "m1_post", "m2", "m3"]


@pytest.mark.parametrize("name", [n for n in entry.queries() if any(n.startswith(c) for c in CHECKED)])
def test_against_sql(spark, name):
    sf = f"{ROOT}/sf0.001"
    why, _ = compare(spark, connect(sf), name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert why is None


@pytest.mark.parametrize("name", ["i14_evaluate_loans", "d2_class_totals", "i21_recovery_actions", "j2_diff_lines_tolerant", "c15_fuzzy_match", "c16_longest_literal", "k10_call_edges", "d20_compliance_rate"])
def test_plans_stay_in_spark(spark, name):
    plan = entry.queries()[name](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["c2_loan_collateral"](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    some = view(spark, f"{ROOT}/sf0.001", "collateral").where("loan_id <= 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThanOrEqual(l_orderkey,2)" in some
    assert "l_comment" not in plan and "l_tax" not in plan


def test_scratch_is_shared(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_long_chains_are_followed_to_their_end(spark):
    from creditloom.plans import jcl

    chain = spark.createDataFrame([(f"{'PGM' if i % 2 else 'DSN'}:N{i}", f"{'DSN' if i % 2 else 'PGM'}:N{i + 1}") for i in range(60)], "src string, dst string")
    hops = {(r.source, r.target): r.hops for r in jcl.data_lineage(chain).collect()}
    assert hops["N0", "N60"] == 30 and len(hops) == 30 * 31 // 2
    copy = lambda b: f"           COPY {b}."
    books = [(f"B{i}", 1, copy(f"B{i + 1}")) for i in range(14)] + [("B14", 1, "           05 LEAF PIC X.")]
    ring = [(f"R{i}", 1, copy(f"R{(i + 1) % 12}")) for i in range(12)]
    lib = spark.createDataFrame(books + ring, "file string, line_no bigint, text string")
    src = spark.createDataFrame([("P", 1, copy("B0")), ("Q", 1, copy("R0"))], "file string, line_no bigint, text string")
    status = {r.copybook: (r.depth, r.status) for r in copybooks.closure(src, lib).collect()}
    assert status["B14"] == (15, "too_deep") and status["B3"] == (4, "resolved") and status["R5"][1] == "circular"
    lines = {r.file: r.text.strip() for r in copybooks.expand(src, lib, marks=False).collect()}
    assert lines == {"P": "05 LEAF PIC X.", "Q": "* >>>CIRCULAR COPY: R0<<<"}


def test_json_with_dotted_keys_nulls_bad_texts_and_large_numbers(spark):
    from creditloom.plans import recon

    same = '{"a": {"b.c": 1}, "a.b": {"c": 2}}'
    rows = [
        (1, same, same), (2, None, None), (3, "{}", None), (4, "{bad", "{}"), (5, '{"n": 123456789012345678901}', '{"n": 5}'),
        (6, '{"a": {"b.c": 1}, "a.b": {"c": 2}}', '{"a": {"b.c": 3}, "a.b": {"c": 2}}'), (7, '{"x": [1, {"y": [2]}]}', '{"x": [1, {"y": []}]}'),
    ]
    found = recon.diff_json(spark.createDataFrame(rows, "doc_id long, expected string, actual string")).collect()
    assert sorted(tuple(r) for r in found) == [
        (3, "$", "type", "dict", "NoneType"), (4, "$", "unparsed", "invalid", "valid"), (5, "n", "value", "123456789012345678901", "5"),
        (6, "a.b.c", "value", "1", "3"), (7, "x[1].y", "length", "1", "0"),
    ]
