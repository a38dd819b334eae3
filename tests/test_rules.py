"""Storage rules, bands and literal cases."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions import conditions as cond
from creditloom.functions import pic
from creditloom.functions import text as tx
from creditloom.plans import aml, credit, insurance, payroll, recovery, risk


def values(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_store(spark):
    x = F.col("x")
    rows = [(-5075,), (5055,), (123456,)]
    assert values(spark, pic.store(x, 2, 4, 0), rows, "x long") == [50, 50, 1234]
    assert values(spark, pic.store(x, 2, 2, 0, signed=True), rows, "x long") == [-50, 50, 34]
    assert values(spark, pic.store(x, 2, 4, 1, rounded=True), rows, "x long") == [508, 506, 12346]


@pytest.mark.parametrize("mode,want", [("literal", 0), ("clean", 1000000)])
def test_loss_provision_rate(spark, mode, want):
    assert values(spark, risk.provision_rate(F.col("d"), mode), [(30,), (31,), (90,), (91,), (180,), (181,)], "d int") == [0, 200000, 200000, 500000, 500000, want]


def test_ratio_beyond_long(spark):
    big = 10**13
    rows = [(big - 1, 3), (10, 4), (big, big * 2)]
    got = values(spark, pic.ratio(F.col("a"), F.col("b"), 6), rows, "a long, b long")
    assert got == [(2 * a * 10**6 + b) // (2 * b) for a, b in rows]


def test_negative_final_score(spark):
    f = lambda m: credit.final_score(F.col("r"), F.col("b"), F.col("s"), m)
    rows = [(5000, -100, 0), (5025, -100, 0), (99999, 90, 30), (None, 0, 0)]
    assert values(spark, f("literal"), rows, "r long, b long, s long") == [50, 49, 1000, None]
    assert values(spark, f("clean"), rows, "r long, b long, s long") == [0, 0, 1000, None]


FEE_CASES = [("CON", 10_000_000, (150_000, 29_000, 45_000, 224_000)), ("IMM", 50_000_000, (500_000, 95_500, 225_000, 820_500)), ("PRO", 100_000, (5_000, 1_450, 0, 6_450))]


def test_fees(spark):
    df = spark.createDataFrame([(t, a) for t, a, _ in FEE_CASES], "loan_type string, original_cents long")
    one = df.select(credit.fees(F.col("loan_type"), F.col("original_cents")).alias("f")).select("f.*").collect()
    staged = credit.with_fees(df).select("file_fee", "tax", "insurance", "total").collect()
    assert [tuple(r) for r in one] == [c for *_, c in FEE_CASES] == [tuple(r) for r in staged]


def test_aml_cases(spark):
    sanctions = spark.createDataFrame([("MOHAMED TRABELSI", "12345678", "PEP", 3), ("X Y", "77777777", "UNL", 5)], "name_key string, cin string, list_code string, severity int")
    cases = [
        ("Bensalah-Ahmed", "88776655", "TUN", 500_000, "Y", 0, "AML CLEAR"), ("mohamed.trabelsi", "00000000", "TUN", 500_000, "Y", 50, "AML CLEAR"),
        ("A", "77777777", "TUN", 1_000_000, "C", 150, "CIN MATCH ON SANCTIONS LIST"), ("A", "77777777", "TUN", 1_000_001, "N", 180, "CIN MATCH ON SANCTIONS LIST"),
        ("A", "0", "IRN", 100, "Y", 101, "AML CLEAR"), ("A", "0", "IRN", 5_000_001, "C", 181, "MANUAL REVIEW REQUIRED"),
        ("x y", "0", "TUN", 100, "N", 200, "HIT UN SANCTIONS         SEVERITY 5"), ("A", "0", "   ", 100, "Y", 4, "AML CLEAR"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, name string, cin string, nationality string, amount_cents long")
    got = aml.aml_screen(df, sanctions).orderBy("i").select("aml_clear", "aml_score", "aml_reason").collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]


def test_hotel_needs_three_blanks(spark):
    got = values(spark, cond.sector_of(F.col("e")), [("HOTEL AFRICA",), ("HOTEL   AFRICA",), ("HOTEL",), ("MINISTERE",), ("BANQUE X",)], "e string")
    assert got == ["AUTR", "TOUR", "TOUR", "ADMI", "BANK"]


def test_score_band_edges(spark):
    got = values(spark, credit.score_income(F.col("r"))[0], [(29999,), (30000,), (24999,), (12000,), (11999,), (None,)], "r long")
    assert got == [850, 1000, 700, 300, 0, 0]
    assert values(spark, credit.score_collateral(F.col("r")), [(600000,), (600001,), (1000000,), (1000001,), (None,)], "r long") == [1000, 800, 200, 0, 0]
    assert values(spark, credit.decide(F.col("s")), [(600,), (599,), (449,), (349,)], "s long") == ["AP", "CO", "RV", "DC"]


def test_escalation_matrix(spark):
    rows = [("2", 45, 0), ("2", 46, 0), ("2", 61, 0), ("3", 120, 0), ("3", 121, 0), ("3", 151, 0), ("4", 365, 0), ("4", 366, 5_000_000), ("4", 366, 5_000_100), ("4", 541, 9_000_000), ("1", 5, 0)]
    got = values(spark, recovery.recovery_action(F.col("k"), F.col("d"), F.col("c")), rows, "k string, d int, c long")
    assert got == ["SMS", "PHN", "DUL", "LEG", "GTR", "RST", "CRT", "WOF", "CSZ", "WOF", None]


QUOTES = [
    (1, 22, 2, "TR", 6, "RC", 100, "TUN", 0), (2, 45, 22, "TR", 8, "TC", 50, "SFX", 0), (3, 52, 30, "LX", 14, "TI", 55, "TUN", 0), (4, 25, 5, "MT", 4, "RC", 100, "SOU", 1),
    (5, 38, 15, "CM", 20, "TC", 85, "BIZ", 0), (6, 17, 0, "TR", 5, "RC", 100, "TUN", 0), (7, 28, 8, "TR", 7, "TC", 250, "NAB", 4), (8, 68, 45, "TR", 5, "TI", 50, "KEF", 0),
    (9, 35, 12, "UT", 10, "TC", 75, "SFX", 1), (10, 82, 50, "TR", 6, "TC", 50, "TUN", 0),
]


def test_ten_quotes(spark):
    df = spark.createDataFrame(QUOTES, "quote_id long, age int, licence_years int, category string, power int, coverage string, crm_e2 int, gov string, accidents int")
    rows = {r.quote_id: r for r in insurance.auto_premium(df).collect()}
    assert [k for k, r in rows.items() if r.decision == "REFUSE"] == [6, 10]
    assert [k for k, r in rows.items() if r.decision == "MANUEL"] == [7]
    assert rows[1].net_e3 == 921_600  # 480 * 1.60 * 1.00 * 1.00 * 1.20
    assert rows[4].load_e2 == 500 and rows[7].load_e2 == 0
    assert rows[4].net_e3 == 362_000  # 320 * 1.25 * 0.85 * 1.05 + 5.00


def test_payroll_edges(spark):
    df = spark.createDataFrame(
        [(1, "a", 1250, 400, 0, 0, 0, "Y", "N"), (2, "b", 1000, 405, 0, 0, 0, "Y", "N"), (3, "c", 1000, 0, 7, 7, 7, "Y", "N")],
        "emp_id long, emp_name string, rate_cents long, hours_tenths long, gross_cents long, tax_cents long, net_cents long, active string, computed string",
    )
    got = {r.emp_id: (r.gross_cents, r.tax_cents, r.net_cents) for r in payroll.payroll(df).collect()}
    assert got == {1: (50_000, 6_000, 44_000), 2: (40_750, 2_038, 38_712), 3: (7, 7, 7)}


def test_packed_decimal_bytes(spark):
    df = spark.createDataFrame([(-12345,), (0,), (999999999,)], "x long").select("x", pic.pack_comp3(F.col("x"), 9).alias("p"))
    got = [(r.x, bytes(r.p).hex(), r.y) for r in df.select("x", "p", pic.unpack_comp3(F.col("p")).alias("y")).collect()]
    assert got == [(-12345, "000012345d", -12345), (0, "000000000c", 0), (999999999, "999999999c", 999999999)]


@pytest.mark.parametrize(
    "line,want",
    [
        ("  CLASS 1: 000004", [1, 4]), ("ENC=      1,044,818", [1044818]), ("PROVISION: 10875.331", [10875.331]), ("TAUX PROV:   0,00%", [0, 0]), ("DELTA: -1500", [-1500]),
        ("JOB v6.0 - START 20260525-471200", []), ("CNT=000004 ENC=000000104481856 PROV=0000000000000", [4, 104481856, 0]),
    ],
)
def test_extract_numbers(spark, line, want):
    got = values(spark, tx.extract_numbers(F.col("t")), [(line,)], "t string")[0]
    assert [float(x) for x in got] == want


def test_numbers_are_exact_at_any_size(spark):
    line = "A 0012345678901234567890 B -0.000000100% C 1,234.50 D -0 E 0.0 F 20260531 G v2.3"
    assert values(spark, tx.extract_numbers(F.col("t")), [(line,)], "t string")[0] == ["12345678901234567890", "-0.0000001", "1234.5", "0", "0"]
    cases = [
        ("12345678901234567890", "12345678901234567891", 0.0, False), ("12345678901234567890", "12345678901234567891", 0.001, True), ("12345678901234567890.0", "12345678901234567890", 0.0, True),
        ("0.0000001", "0.0000002", 0.1, False), ("0.0000001", "0.0000001000", 0.0, True), ("1000", "999", 0.001, True), ("1000", "998.999999999", 0.001, False), ("3", "2.997", 0.001, True), ("5", "5 6", 0.5, False),
        ("1" * 40, "1" * 39 + "2", 0.0, False), ("1" * 40, "1" * 39 + "2", 1e-9, True),
    ]
    near = tx.within_tolerance(tx.extract_numbers(F.col("a")), tx.extract_numbers(F.col("b")), F.col("p"))
    assert values(spark, near, [c[:3] for c in cases], "a string, b string, p double") == [c[3] for c in cases]
