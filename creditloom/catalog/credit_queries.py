"""Registered queries: predicates, joins, scoring, screening, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.adapters import TODAY
from creditloom.catalog.registry import big, half_up, query
from creditloom.functions import conditions as cond
from creditloom.functions import pic
from creditloom.functions import text as tx
from creditloom.operators import ordered
from creditloom.plans import aml, credit, risk
from creditloom.sources import reference_tables

BASE = "loan cust collateral guarantee sanction"

SECTOR_SQL = """CASE WHEN employer LIKE 'BANQUE%' THEN 'BANK' WHEN employer LIKE 'MINISTERE %' THEN 'ADMI' WHEN employer LIKE 'TUNISIE %' THEN 'TELE'
 WHEN employer LIKE 'ORANGE%' OR employer LIKE 'OOREDOO%' THEN 'TELE' WHEN employer LIKE 'PHARMACI%' THEN 'PHAR'
 WHEN employer LIKE 'HOTEL   %' OR employer LIKE 'TUNISA%' THEN 'TOUR' WHEN employer LIKE 'GROUPE %' THEN 'INDS'
 WHEN employer LIKE 'COMMERCE%' OR employer LIKE 'ARTISAN%' THEN 'COMM' ELSE 'AUTR' END"""
SECTOR_ADJ_SQL = """CASE {s} WHEN 'BANK' THEN 25 WHEN 'ADMI' THEN 30 WHEN 'INDS' THEN 15 WHEN 'COMM' THEN 5 WHEN 'AGRI' THEN -10 WHEN 'TOUR' THEN -15
 WHEN 'CONS' THEN -5 WHEN 'TRSP' THEN 10 WHEN 'PROF' THEN 20 WHEN 'PHAR' THEN 25 WHEN 'TELE' THEN 20 ELSE 0 END"""


def aml_ctes(people: str) -> str:
    """CTE ``hits``: people(name, cin, nationality, amount_cents, ...) with hit columns and outcome."""
    return f"""
 sn AS (SELECT name_key, MIN(CONCAT(list_code, CAST(severity AS STRING))) AS ls FROM sanction GROUP BY name_key),
 sc AS (SELECT DISTINCT cin AS scin FROM sanction),
 h0 AS (SELECT p.*, n.ls, n.ls IS NOT NULL AS name_hit, (n.ls IS NULL AND sc.scin IS NOT NULL) AS cin_hit
  FROM ({people}) p LEFT JOIN sn n ON n.name_key = REPLACE(REPLACE(REPLACE(UPPER(p.name), '.', ' '), ',', ' '), '-', ' ')
  LEFT JOIN sc ON sc.scin = p.cin),
 h1 AS (SELECT *, (CASE WHEN name_hit THEN CASE WHEN ls LIKE 'PEP%' THEN 50 ELSE 200 END ELSE 0 END) + (CASE WHEN cin_hit THEN 150 ELSE 0 END)
   + (CASE WHEN amount_cents > 5000000 THEN 80 WHEN amount_cents > 1000000 THEN 30 ELSE 0 END)
   + (CASE WHEN nationality IN ('IRN','SYR') THEN 101 ELSE 0 END) AS aml_score FROM h0),
 hits AS (SELECT *, CASE WHEN (name_hit OR cin_hit) AND aml_score > 150 THEN 'N' WHEN aml_score >= 300 THEN 'N' WHEN aml_score >= 150 THEN 'C' ELSE 'Y' END AS aml_clear,
   CASE WHEN aml_score < 150 THEN 'AML CLEAR'
    WHEN name_hit THEN CONCAT('HIT ', RPAD(CASE SUBSTR(ls, 1, 3) WHEN 'PEP' THEN 'PEP LIST' WHEN 'UNL' THEN 'UN SANCTIONS' WHEN 'EUL' THEN 'EU SANCTIONS' WHEN 'OFC' THEN 'OFAC SANCTIONS' ELSE 'BCT WATCHLIST' END, 20, ' '), ' SEVERITY ', SUBSTR(ls, 4, 1))
    WHEN cin_hit THEN 'CIN MATCH ON SANCTIONS LIST' WHEN aml_score >= 300 THEN 'HIGH AML RISK SCORE' ELSE 'MANUAL REVIEW REQUIRED' END AS aml_reason FROM h1)"""


def eval_sql(mode: str) -> str:
    name = "CONCAT(first_name, ' ', last_name)" if mode == "clean" else "RTRIM(SUBSTR(CONCAT(RPAD(first_name, 25, ' '), ' ', RPAD(last_name, 30, ' ')), 1, 55))"
    people = f"""SELECT l.*, {name} AS name, c.cin, c.nationality, l.original_cents AS amount_cents, c.status AS cust_status, c.aml_flag, c.kyc,
   c.income_cents, c.open_date, {SECTOR_SQL} AS sector, c.cust_id IS NOT NULL AS known FROM loan l LEFT JOIN cust c ON c.cust_id = l.cust_id"""
    ltv = "% 10000000" if mode == "literal" else ""
    fin = "LEAST(ABS(t_e2) // 100 % 10000, 1000)" if mode == "literal" else "GREATEST(0, LEAST(CASE WHEN t_e2 < 0 THEN -(ABS(t_e2) // 100) ELSE t_e2 // 100 END, 1000))"
    return f"""WITH {aml_ctes(people)},
 sec AS (SELECT loan_id, {big('SUM(c)')} AS c, {big('SUM(g)')} AS g FROM (SELECT loan_id, value_cents AS c, 0 AS g FROM collateral WHERE status = 'A'
   UNION ALL SELECT loan_id, 0, amount_cents FROM guarantee WHERE status = 'A') GROUP BY loan_id),
 e0 AS (SELECT h.*, COALESCE(sec.c, 0) AS collateral_cents, COALESCE(sec.g, 0) AS guarantee_cents,
   CASE WHEN h.loan_id = 0 THEN 'LOAN-ID IS ZERO - INVALID RECORD' WHEN original_cents = 0 THEN 'LOAN AMOUNT IS ZERO'
    WHEN status NOT IN ('AC','RS') THEN 'LOAN STATUS NOT ELIGIBLE FOR EVALUATION' WHEN NOT known THEN CONCAT('CUSTOMER NOT FOUND: ', LPAD(CAST(cust_id AS STRING), 8, '0')) END AS err,
   CASE WHEN cust_status = 'B' THEN 'CLIENT BLACKLISTE - DEMANDE REFUSEE' WHEN aml_flag = 'Y' THEN 'ALERTE AML EN COURS' WHEN kyc <> 'V' THEN CONCAT('KYC NON VALIDE - STATUT: ', kyc)
    WHEN cust_status <> 'A' THEN 'CLIENT INACTIF' WHEN aml_clear <> 'Y' THEN aml_reason END AS rej
   FROM hits h LEFT JOIN sec ON sec.loan_id = h.loan_id),
 e1 AS (SELECT *, CASE WHEN err IS NOT NULL THEN 'ERROR' WHEN rej IS NOT NULL THEN 'REJECTED' ELSE 'SCORED' END AS outcome, COALESCE(err, rej) AS reject_reason,
   collateral_cents + guarantee_cents AS security, (income_cents = 0 OR payment_cents = 0) AS no_income FROM e0),
 e2 AS (SELECT *, CASE WHEN NOT no_income THEN {half_up('income_cents', 'payment_cents', 4)} % 10000000 END AS income_ratio_e4,
   CASE WHEN payment_cents > 0 THEN {half_up('income_cents', 'payment_cents', 4)} % 10000000 END AS dscr_e4,
   CASE WHEN security > 0 THEN {half_up('outstanding_cents', 'security', 6)} {ltv} END AS ltv_e4, ({TODAY} - open_date) // 10000 AS years FROM e1),
 e3 AS (SELECT *,
   CASE WHEN no_income THEN 0 WHEN income_ratio_e4 >= 30000 THEN 1000 WHEN income_ratio_e4 >= 25000 THEN 850 WHEN income_ratio_e4 >= 20000 THEN 700 WHEN income_ratio_e4 >= 15000 THEN 500 WHEN income_ratio_e4 >= 12000 THEN 300 ELSE 0 END AS income_score,
   CASE WHEN dpd = 0 AND missed = 0 THEN 1000 WHEN dpd <= 30 THEN 700 WHEN dpd <= 90 THEN 400 WHEN dpd <= 180 THEN 150 ELSE 0 END AS history_score,
   CASE WHEN payment_cents = 0 THEN 1000 WHEN dscr_e4 >= 15000 THEN 1000 WHEN dscr_e4 >= 12000 THEN 750 WHEN dscr_e4 >= 10000 THEN 500 WHEN dscr_e4 >= 8000 THEN 250 ELSE 0 END AS dscr_score,
   CASE WHEN security = 0 THEN 0 WHEN ltv_e4 <= 600000 THEN 1000 WHEN ltv_e4 <= 700000 THEN 800 WHEN ltv_e4 <= 800000 THEN 600 WHEN ltv_e4 <= 900000 THEN 400 WHEN ltv_e4 <= 1000000 THEN 200 ELSE 0 END AS collat_score,
   CASE WHEN years >= 10 THEN 1000 WHEN years >= 7 THEN 800 WHEN years >= 5 THEN 600 WHEN years >= 3 THEN 400 WHEN years >= 1 THEN 200 ELSE 0 END AS tenure_score,
   CASE WHEN dpd <= 30 THEN NULL WHEN dpd <= 90 THEN 'RETARDS DE PAIEMENT DETECTES' WHEN dpd <= 180 THEN 'CREANCE CLASSEE - SUIVI REQUIS' ELSE 'CREANCE EN SOUFFRANCE > 180 JOURS' END AS reason_1,
   CASE WHEN no_income THEN 'REVENU OU MENSUALITE NULS' WHEN income_ratio_e4 < 12000 THEN 'RATIO REVENU/MENSUALITE INSUFFISANT' END AS reason_2,
   CASE WHEN payment_cents = 0 OR dscr_e4 >= 10000 THEN NULL WHEN dscr_e4 >= 8000 THEN 'TAUX DE COUVERTURE FAIBLE' ELSE 'CAPACITE REMBOURSEMENT INSUFFISANTE' END AS reason_3,
   cust_id % 200 - 100 AS bureau_adj, {SECTOR_ADJ_SQL.format(s='sector')} AS sector_adj FROM e2),
 e4 AS (SELECT *, 25 * income_score + 30 * history_score + 20 * dscr_score + 15 * collat_score + 10 * tenure_score AS raw_score_e2 FROM e3),
 e5 AS (SELECT *, raw_score_e2 + 100 * (bureau_adj + sector_adj) AS t_e2 FROM e4),
 e6 AS (SELECT *, {fin} AS score FROM e5),
 e7 AS (SELECT *, CASE WHEN outcome <> 'SCORED' THEN NULL WHEN score >= 600 THEN 'AP' WHEN score >= 450 THEN 'CO' WHEN score >= 350 THEN 'RV' ELSE 'DC' END AS decision,
   LEAST(GREATEST((original_cents * (CASE loan_type WHEN 'CON' THEN 15000 WHEN 'IMM' THEN 10000 WHEN 'AUT' THEN 20000 WHEN 'PRO' THEN 7500 WHEN 'REV' THEN 25000 ELSE 15000 END) * 2 + 1000000) // 2000000 % 1000000000, 5000), 500000) AS file_fee,
   CASE WHEN loan_type IN ('IMM','AUT','CON') THEN (original_cents * 9000 + 1000000) // 2000000 % 1000000000 ELSE 0 END AS insurance FROM e6),
 e8 AS (SELECT *, (file_fee * 3800 + 10000) // 20000 + 500 AS tax FROM e7),
 ev AS (SELECT *, (file_fee + insurance + tax) % 100000000000 AS total,
   CASE WHEN outcome <> 'SCORED' THEN NULL WHEN decision IN ('AP','CO') THEN LEAST((income_cents * 48) // 10, original_cents, CASE WHEN security > 0 THEN security * 8 // 10 ELSE original_cents END) ELSE 0 END AS max_loan_cents,
   CASE WHEN outcome <> 'SCORED' THEN NULL WHEN decision NOT IN ('AP','CO') THEN 0 WHEN score >= 850 THEN 87500 WHEN score >= 700 THEN 97500 WHEN score >= 600 THEN 107500 ELSE 117500 END AS max_rate_e4 FROM e8)
"""


def scored_only(col: str, alias: str | None = None) -> str:
    return f"CASE WHEN outcome = 'SCORED' THEN CAST({col} AS BIGINT) END AS {alias or col}"


def evaluated(s, mode=pic.LITERAL, **kw):
    loans, cust, col, gtr, sanc = s("loan", "cust", "collateral", "guarantee", "sanction")
    return credit.evaluate_loans(loans, cust, col, gtr, sanc, TODAY, mode, **kw)


def scored(s, mode=pic.LITERAL):
    return evaluated(s, mode).where(F.col("outcome") == "SCORED")


NUMS = ["collateral_cents", "guarantee_cents", "income_score", "history_score", "dscr_score", "collat_score", "tenure_score", "raw_score_e2", "score",
        "max_loan_cents", "max_rate_e4"]
EVAL_OUT = (
    "SELECT loan_id, cust_id, outcome, reject_reason, decision, CAST(collateral_cents AS BIGINT) AS collateral_cents, CAST(guarantee_cents AS BIGINT) AS guarantee_cents, "
    + ", ".join(scored_only(c) for c in NUMS[2:] + ["file_fee", "insurance", "tax", "total"])
    + ", CASE WHEN outcome = 'SCORED' THEN reason_1 END AS reason_1, CASE WHEN outcome = 'SCORED' THEN reason_2 END AS reason_2, CASE WHEN outcome = 'SCORED' THEN reason_3 END AS reason_3 FROM ev"
)


def eval_columns(df):
    return df.select(
        "loan_id", "cust_id", "outcome", "reject_reason", "decision", *NUMS, "reason_1", "reason_2", "reason_3", "file_fee", "insurance",
        "tax", "total",
    )


@query("i14_evaluate_loans", BASE, eval_sql("literal") + EVAL_OUT)
def _(s):
    return eval_columns(evaluated(s))


@query("i14_evaluate_loans_clean", BASE, eval_sql("clean") + EVAL_OUT)
def _(s):
    return eval_columns(evaluated(s, pic.CLEAN))


@query("b4_route", BASE, eval_sql("literal") + "SELECT outcome, reject_reason, COUNT(*) AS loans FROM ev GROUP BY outcome, reject_reason")
def _(s):
    parts = credit.route(evaluated(s))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("outcome", "reject_reason").agg(F.count("*").alias("loans"))


@query("d1_loan_batch_stats", BASE, eval_sql("literal") + f"""SELECT COUNT(*) AS read_count, COUNT(*) FILTER (decision = 'AP') AS approved_count,
 COUNT(*) FILTER (decision IN ('CO','RV')) AS conditional_count, COUNT(*) FILTER (decision = 'DC' OR outcome = 'REJECTED') AS declined_count,
 COUNT(*) FILTER (outcome = 'ERROR') AS error_count, {big('SUM(original_cents)')} AS total_cents,
 {big("COALESCE(SUM(original_cents) FILTER (decision = 'AP'), 0)")} AS approved_cents, {big("COALESCE(SUM(original_cents) FILTER (decision = 'DC'), 0)")} AS declined_cents FROM ev""")
def _(s):
    return credit.loan_batch_stats(evaluated(s))


@query("i15_score_result", BASE, eval_sql("literal") + f"""SELECT ROW_NUMBER() OVER (ORDER BY loan_id) AS result_id, loan_id, cust_id, {big(TODAY)} AS score_date, {big('score')} AS score, decision,
 {big('max_loan_cents')} AS max_loan_cents, {big('max_rate_e4')} AS max_rate_e4, COALESCE(reason_1, '') AS reason_1, COALESCE(reason_2, '') AS reason_2, COALESCE(reason_3, '') AS reason_3, {big('0')} AS analyst_id
 FROM ev WHERE outcome = 'SCORED'""")
def _(s):
    return credit.score_result(scored(s), TODAY)


@query("e2_sequence_ids", BASE, eval_sql("literal") + "SELECT loan_id, ROW_NUMBER() OVER (ORDER BY score DESC, loan_id) AS place FROM ev WHERE outcome = 'SCORED'")
def _(s):
    df = scored(s).select("loan_id", "score")
    return ordered.dense_ids(df, [F.col("score").desc(), F.col("loan_id").asc()], "place").select("loan_id", "place")


@query("e5_carry_forward", BASE, eval_sql("literal") + f"""SELECT loan_id, decision,
 {big("COALESCE(LAST_VALUE(CASE WHEN decision IN ('AP','CO') THEN max_rate_e4 END IGNORE NULLS) OVER w, 0)")} AS carried_rate_e4,
 {big("COALESCE(LAST_VALUE(CASE WHEN decision IN ('AP','CO') THEN max_loan_cents WHEN decision = 'DC' THEN 0 END IGNORE NULLS) OVER w, 0)")} AS carried_max_cents
 FROM ev WHERE outcome = 'SCORED' WINDOW w AS (ORDER BY loan_id ROWS UNBOUNDED PRECEDING)""")
def _(s):
    return credit.carry_rate(scored(s)).select("loan_id", "decision", "carried_rate_e4", "carried_max_cents")


@query("e1_rank_components", BASE, eval_sql("literal") + f"""SELECT loan_id, ROW_NUMBER() OVER (PARTITION BY loan_id ORDER BY points DESC, place) AS component_rank, component, {big('weight')} AS weight, {big('points')} AS points FROM (
 SELECT loan_id, 0 AS place, 'INCOME' AS component, 25 AS weight, income_score AS points FROM ev WHERE outcome = 'SCORED' UNION ALL
 SELECT loan_id, 1, 'HISTORY', 30, history_score FROM ev WHERE outcome = 'SCORED' UNION ALL SELECT loan_id, 2, 'DSCR', 20, dscr_score FROM ev WHERE outcome = 'SCORED' UNION ALL
 SELECT loan_id, 3, 'COLLAT', 15, collat_score FROM ev WHERE outcome = 'SCORED' UNION ALL SELECT loan_id, 4, 'TENURE', 10, tenure_score FROM ev WHERE outcome = 'SCORED')""")
def _(s):
    return credit.rank_components(scored(s))


for _name, _cols in {
    "i1_score_income": ["income_ratio_e4", "income_score"], "i2_score_history": ["history_score"], "i3_score_dscr": ["dscr_e4", "dscr_score"],
    "i4_score_collateral": ["ltv_e4", "collat_score"], "i5_score_tenure": ["tenure_score"], "i6_final_score": ["raw_score_e2", "score"],
    "i7_bureau_adjustment": ["bureau_adj"], "i8_sector_adjustment": ["sector_adj"], "i10_max_loan": ["max_loan_cents"], "i11_price": ["max_rate_e4"],
}.items():
    query(_name, BASE, eval_sql("literal") + "SELECT loan_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _cols) + " FROM ev WHERE outcome = 'SCORED'")(
        lambda s, cols=tuple(_cols): scored(s).select("loan_id", *cols)
    )


@query("i9_decide", BASE, eval_sql("literal") + f"SELECT decision, COUNT(*) AS loans, {big('MIN(score)')} AS low, {big('MAX(score)')} AS high FROM ev WHERE outcome = 'SCORED' GROUP BY decision")
def _(s):
    return scored(s).groupBy("decision").agg(F.count("*").alias("loans"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("i4_score_collateral_clean", BASE, eval_sql("clean") + "SELECT loan_id, CAST(ltv_e4 AS BIGINT) AS ltv_e4, CAST(collat_score AS BIGINT) AS collat_score FROM ev WHERE outcome = 'SCORED'")
def _(s):
    return scored(s, pic.CLEAN).select("loan_id", "ltv_e4", "collat_score")


# --- predicates and scalar functions over whole tables -----------------------

@query("b1_check_preconditions", "loan", """SELECT loan_id, CASE WHEN loan_id = 0 THEN 'LOAN-ID IS ZERO - INVALID RECORD' WHEN original_cents = 0 THEN 'LOAN AMOUNT IS ZERO'
 WHEN status NOT IN ('AC','RS') THEN 'LOAN STATUS NOT ELIGIBLE FOR EVALUATION' END AS error FROM loan""")
def _(s):
    return s("loan").select("loan_id", cond.check_preconditions(F.col("loan_id"), F.col("original_cents"), F.col("status")).alias("error"))


@query("b2_check_customer", "cust", """SELECT cust_id, CASE WHEN status = 'B' THEN 'CLIENT BLACKLISTE - DEMANDE REFUSEE' WHEN aml_flag = 'Y' THEN 'ALERTE AML EN COURS'
 WHEN kyc <> 'V' THEN CONCAT('KYC NON VALIDE - STATUT: ', kyc) WHEN status <> 'A' THEN 'CLIENT INACTIF' END AS reason FROM cust""")
def _(s):
    return s("cust").select("cust_id", cond.check_customer(F.col("status"), F.col("aml_flag"), F.col("kyc")).alias("reason"))


@query("b3_conditions", "loan cust", """SELECT 'loan' AS source, COUNT(*) FILTER (status = 'AC') AS active, COUNT(*) FILTER (status = 'RS') AS second, COUNT(*) FILTER (loan_type = 'IMM') AS third FROM loan
 UNION ALL SELECT 'cust', COUNT(*) FILTER (status = 'A'), COUNT(*) FILTER (status = 'B'), COUNT(*) FILTER (kyc = 'V') FROM cust""")
def _(s):
    def counts(df, name, conds):
        n = [F.count_if(cond.condition(c)).alias(a) for c, a in zip(conds, ("active", "second", "third"))]
        return df.agg(*n).select(F.lit(name).alias("source"), "active", "second", "third")

    return counts(s("loan"), "loan", ["loan_active", "loan_restructured", "loan_mortgage"]).unionByName(
        counts(s("cust"), "cust", ["cust_active", "cust_blacklisted", "kyc_ok"])
    )


@query("b5_sector_of", "cust", f"SELECT cust_id, {SECTOR_SQL} AS sector FROM cust")
def _(s):
    return s("cust").select("cust_id", cond.sector_of(F.col("employer")).alias("sector"))


@query("b6_band", "loan", """SELECT loan_id, CAST(CASE WHEN dpd <= 30 THEN 700 WHEN dpd <= 90 THEN 400 WHEN dpd <= 180 THEN 150 ELSE 0 END AS BIGINT) AS low_band,
 CAST(CASE WHEN rate_e4 >= 120000 THEN 3 WHEN rate_e4 >= 100000 THEN 2 ELSE 1 END AS BIGINT) AS high_band FROM loan""")
def _(s):
    low = pic.band(F.col("dpd"), [(30, 700), (90, 400), (180, 150)], 0, "<=").cast("bigint")
    high = pic.band(F.col("rate_e4"), [(120000, 3), (100000, 2)], 1).cast("bigint")
    return s("loan").select("loan_id", low.alias("low_band"), high.alias("high_band"))


@query("b7_normalize_income", "cust", """SELECT cust_id, raw_income, CAST(SUBSTR(REPLACE(REPLACE(raw_income, ' ', '0'), '-', '0'), 1, 7) AS BIGINT) * 100
 + CAST(SUBSTR(REPLACE(REPLACE(raw_income, ' ', '0'), '-', '0'), 8, 2) AS BIGINT) AS income_cents FROM cust""")
def _(s):
    return s("cust").select("cust_id", "raw_income", cond.normalize_income(F.col("raw_income")).alias("income_cents"))


@query("b8_active_portfolio", "loan", "SELECT loan_id, status FROM loan WHERE status IN ('AC', 'RS')")
def _(s):
    return risk.active_portfolio(s("loan")).select("loan_id", "status")


@query("h1_store", "loan", """SELECT loan_id, outstanding_cents // 100 % 100000 AS cut, (outstanding_cents + 5) // 10 % 1000000 AS rounded,
 (rate_e4 - 100000) AS signed_in, ABS(rate_e4 - 100000) // 100 % 100 AS unsigned_store, CASE WHEN rate_e4 < 100000 THEN -(ABS(rate_e4 - 100000) // 100 % 100) ELSE (rate_e4 - 100000) // 100 % 100 END AS signed_store FROM loan""")
def _(s):
    x = F.col("outstanding_cents")
    d = F.col("rate_e4") - 100000
    return s("loan").select(
        "loan_id", pic.store(x, 2, 5, 0).alias("cut"), pic.store(x, 2, 5, 1, rounded=True).alias("rounded"), d.alias("signed_in"),
        pic.store(d, 2, 2, 0).alias("unsigned_store"), pic.store(d, 2, 2, 0, signed=True).alias("signed_store"),
    )


@query("h2_mod", "cust", "SELECT cust_id, cust_id % 200 - 100 AS adj FROM cust")
def _(s):
    return s("cust").select("cust_id", cond.bureau_fallback(F.col("cust_id")).alias("adj"))


@query("h3_inspect_replace", "cust", "SELECT cust_id, REPLACE(REPLACE(raw_income, ' ', '0'), '-', '0') AS digits, REPLACE(employer, 'TUNIS', 'TN') AS employer FROM cust")
def _(s):
    d = tx.inspect_replace(tx.inspect_replace(F.col("raw_income"), " ", "0"), "-", "0")
    return s("cust").select("cust_id", d.alias("digits"), tx.inspect_replace(F.col("employer"), "TUNIS", "TN").alias("employer"))


@query("h4_inspect_convert", sql="SELECT p_partkey, TRANSLATE(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS name FROM part")
def _(s):
    return s.table("part").select("p_partkey", tx.inspect_convert(F.col("p_name"), tx.LOWER, tx.LOWER.upper()).alias("name"))


@query("h5_inspect_tally", sql="SELECT doc_id, (LENGTH(text) - LENGTH(REPLACE(text, 'th', ''))) // 2 AS hits FROM documents")
def _(s):
    return s.table("documents").select("doc_id", tx.inspect_tally(F.col("text"), F.lit("th")).alias("hits"))


@query("h6_string_concat", "cust", "SELECT cust_id, SUBSTR(CONCAT(RPAD(last_name, 30, ' '), ' ', first_name), 1, 33) AS name FROM cust")
def _(s):
    return s("cust").select("cust_id", tx.string_concat(33, F.rpad("last_name", 30, " "), F.lit(" "), F.col("first_name")).alias("name"))


@query("h7_refmod", "cust", "SELECT cust_id, SUBSTR(RPAD(employer, 12, ' '), 3, 9) AS piece FROM cust")
def _(s):
    return s("cust").select("cust_id", tx.refmod(F.col("employer"), 3, 9).alias("piece"))


@query("h8_years_between", "cust", f"SELECT cust_id, ({TODAY} - open_date) // 10000 AS years FROM cust")
def _(s):
    return s("cust").select("cust_id", pic.years_between_yyyymmdd(F.lit(TODAY), F.col("open_date")).alias("years"))


@query("h9_add_days", "cust", """SELECT cust_id, open_date + 30 AS literal_date,
 CAST(STRFTIME(STRPTIME(CAST(open_date AS STRING), '%Y%m%d') + INTERVAL 30 DAY, '%Y%m%d') AS BIGINT) AS clean_date FROM cust""")
def _(s):
    d = F.col("open_date")
    return s("cust").select("cust_id", pic.add_days(d, 30).alias("literal_date"), pic.add_days(d, 30, pic.CLEAN).alias("clean_date"))


@query("h10_clamp", "loan", "SELECT loan_id, LEAST(GREATEST(outstanding_cents, 1000000), 20000000) AS bounded FROM loan")
def _(s):
    return s("loan").select("loan_id", pic.clamp(F.col("outstanding_cents"), 1000000, 20000000).alias("bounded"))


@query("h11_celsius_to_fahrenheit", sql="""SELECT event_id, CAST(ROUND(value * 100) AS BIGINT) AS centi,
 (CASE WHEN value < 0 THEN -((ABS(CAST(ROUND(value * 100) AS BIGINT)) * 9) // 5) ELSE (CAST(ROUND(value * 100) AS BIGINT) * 9) // 5 END) + 3200 AS fahrenheit_centi FROM events""")
def _(s):
    c = F.round(F.col("value") * 100).cast("bigint")
    return s.table("events").select("event_id", c.alias("centi"), pic.celsius_to_fahrenheit(c).alias("fahrenheit_centi"))


@query("h12_normalize_name", sql="SELECT c_custkey, REPLACE(REPLACE(REPLACE(UPPER(CONCAT('o.', c_name, ',x-y')), '.', ' '), ',', ' '), '-', ' ') AS name FROM customer")
def _(s):
    return s.table("customer").select("c_custkey", tx.normalize_name(F.concat(F.lit("o."), "c_name", F.lit(",x-y"))).alias("name"))


# --- joins -------------------------------------------------------------------

@query("c1_loan_customer", "loan cust", """SELECT l.loan_id, l.cust_id, c.first_name, CASE WHEN c.cust_id IS NULL THEN CONCAT('CUSTOMER NOT FOUND: ', LPAD(CAST(l.cust_id AS STRING), 8, '0')) END AS error
 FROM loan l LEFT JOIN cust c ON c.cust_id = l.cust_id""")
def _(s):
    who = s("cust").select("cust_id", "first_name", F.lit(True).alias("k"))
    msg = F.concat(F.lit(cond.ERR_CUSTOMER), F.lpad(F.col("cust_id").cast("string"), 8, "0"))
    return s("loan").join(who, "cust_id", "left").select("loan_id", "cust_id", "first_name", F.when(F.col("k").isNull(), msg).alias("error"))


SEC_SQL = "SELECT l.loan_id, COALESCE(x.v, 0) AS {a} FROM loan l LEFT JOIN (SELECT loan_id, CAST(SUM({c}) AS BIGINT) AS v FROM {t} WHERE status = 'A' GROUP BY loan_id) x ON x.loan_id = l.loan_id"


@query("c2_loan_collateral", "loan collateral", SEC_SQL.format(a="collateral_cents", c="value_cents", t="collateral"))
def _(s):
    agg = s("collateral").where(cond.condition("collateral_active")).groupBy("loan_id").agg(F.sum("value_cents").alias("v"))
    return s("loan").select("loan_id").join(agg, "loan_id", "left").select("loan_id", F.coalesce("v", F.lit(0)).alias("collateral_cents"))


@query("c3_loan_guarantees", "loan guarantee", SEC_SQL.format(a="guarantee_cents", c="amount_cents", t="guarantee"))
def _(s):
    agg = s("guarantee").where(cond.condition("guarantee_active")).groupBy("loan_id").agg(F.sum("amount_cents").alias("v"))
    return s("loan").select("loan_id").join(agg, "loan_id", "left").select("loan_id", F.coalesce("v", F.lit(0)).alias("guarantee_cents"))


PEOPLE_SQL = "SELECT cust_id, CONCAT(first_name, ' ', last_name) AS name, cin, nationality, income_cents * 20 AS amount_cents FROM cust"


def people(s):
    return s("cust").select(
        "cust_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "cin", "nationality", (F.col("income_cents") * 20).alias("amount_cents")
    )


@query("c4_aml_name_match", "cust sanction", f"WITH {aml_ctes(PEOPLE_SQL)} SELECT cust_id, SUBSTR(ls, 1, 3) AS hit_list, CAST(SUBSTR(ls, 4, 1) AS BIGINT) AS hit_severity FROM hits WHERE name_hit")
def _(s):
    return aml.sanction_hits(people(s), s("sanction")).where("name_hit").select("cust_id", "hit_list", "hit_severity")


@query("c5_aml_cin_match", "cust sanction", f"WITH {aml_ctes(PEOPLE_SQL.replace('CONCAT(first_name', 'CONCAT(first_name, CASE WHEN cust_id % 2 = 0 THEN chr(88) ELSE chr(89) END'))} SELECT cust_id, cin FROM hits WHERE cin_hit")
def _(s):
    p = people(s).withColumn("name", F.concat(F.split("name", " ")[0], F.when(F.col("cust_id") % 2 == 0, "X").otherwise("Y"), F.lit(" "), F.split("name", " ")[1]))
    return aml.sanction_hits(p, s("sanction")).where("cin_hit").select("cust_id", "cin")


@query("i13_aml_screen", "cust sanction", f"WITH {aml_ctes(PEOPLE_SQL)} SELECT cust_id, aml_clear, {big('aml_score')} AS aml_score, aml_reason FROM hits")
def _(s):
    return aml.aml_screen(people(s), s("sanction")).select("cust_id", "aml_clear", "aml_score", "aml_reason")


@query("n1_screen_transform", "cust sanction", f"WITH {aml_ctes(PEOPLE_SQL)} SELECT aml_clear, COUNT(*) AS people, {big('MAX(aml_score)')} AS top_score FROM hits GROUP BY aml_clear")
def _(s):
    sanctions = s("sanction")
    return people(s).transform(lambda d: aml.aml_screen(d, sanctions)).groupBy("aml_clear").agg(F.count("*").alias("people"), F.max("aml_score").alias("top_score"))


FEE_SQL = eval_sql("literal") + "SELECT loan_id, {cols} FROM ev"


@query("i12_fees", BASE, FEE_SQL.format(cols=", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("file_fee", "insurance", "tax", "total"))))
def _(s):
    return credit.with_fees(s("loan")).select("loan_id", "file_fee", "insurance", "tax", "total")


@query("n2_fee_struct", BASE, eval_sql("literal") + "SELECT loan_type, CAST(SUM(total) AS BIGINT) AS total_fees FROM ev GROUP BY loan_type")
def _(s):
    return s("loan").groupBy("loan_type").agg(F.sum(credit.fees(F.col("loan_type"), F.col("original_cents"))["total"]).alias("total_fees"))


@query("c6_recovery_flag", "loan prior_action", """SELECT l.loan_id, CASE WHEN p.loan_id IS NOT NULL THEN 'REC' ELSE 'NRC' END AS recovery_flag FROM loan l
 LEFT JOIN (SELECT DISTINCT loan_id FROM prior_action) p ON p.loan_id = l.loan_id WHERE l.status IN ('AC','RS')""")
def _(s):
    return risk.classify_portfolio(s("loan"), s("prior_action")).select("loan_id", "recovery_flag")


@query("c6_recovery_flag_first_rows", "loan prior_action", """SELECT l.loan_id, CASE WHEN p.loan_id IS NOT NULL THEN 'REC' ELSE 'NRC' END AS recovery_flag FROM loan l
 LEFT JOIN (SELECT DISTINCT loan_id FROM (SELECT loan_id FROM prior_action ORDER BY action_id LIMIT 200)) p ON p.loan_id = l.loan_id WHERE l.status IN ('AC','RS')""")
def _(s):
    return risk.classify_portfolio(s("loan"), s("prior_action"), first_rows=risk.RECOVERY_TABLE_ROWS).select("loan_id", "recovery_flag")


@query("a14_read_sector_risk", "sector_table", "SELECT code, ARG_MIN(label, adjustment) AS label, MIN(adjustment) AS adjustment FROM sector_table WHERE active_flag = 'Y' GROUP BY code")
def _(s):
    return reference_tables.active_sectors(s("sector_table")).orderBy("code")


@query("c7_sector_lookup", "cust sector_table", f"""WITH t AS (SELECT code, MIN(adjustment) AS adj FROM sector_table WHERE active_flag = 'Y' GROUP BY code)
 SELECT c.cust_id, c.sector, COALESCE(t.adj, 0) AS sector_adj FROM (SELECT cust_id, {SECTOR_SQL} AS sector FROM cust) c LEFT JOIN t ON t.code = c.sector""")
def _(s):
    t = reference_tables.active_sectors(s("sector_table")).select(F.col("code").alias("sector"), "adjustment")
    c = s("cust").select("cust_id", cond.sector_of(F.col("employer")).alias("sector"))
    return c.join(t, "sector", "left").select("cust_id", "sector", F.coalesce("adjustment", F.lit(0)).alias("sector_adj"))


BUREAU_SQL = "SELECT cust_id, ARG_MAX(score, CAST(EPOCH(score_date) AS BIGINT) * 1000 + score) AS bureau_score FROM bureau GROUP BY cust_id"


@query("a15_read_bureau_latest", "bureau", BUREAU_SQL)
def _(s):
    return credit.bureau_latest(s("bureau"))


@query("c8_bureau_as_of", "cust bureau", f"WITH b AS ({BUREAU_SQL}) SELECT c.cust_id, b.bureau_score FROM cust c LEFT JOIN b ON b.cust_id = c.cust_id")
def _(s):
    return s("cust").select("cust_id").join(credit.bureau_latest(s("bureau")), "cust_id", "left")


@query("i14_with_tables", BASE + " bureau sector_table", eval_sql("literal").replace("cust_id % 200 - 100 AS bureau_adj", "COALESCE((SELECT LEAST(GREATEST(b.bureau_score, -100), 100) FROM bl b WHERE b.cust_id = e2.cust_id), 0) AS bureau_adj")
       .replace(f"{SECTOR_ADJ_SQL.format(s='sector')} AS sector_adj", "COALESCE((SELECT t.adj FROM st t WHERE t.code = e2.sector), 0) AS sector_adj")
       .replace("WITH ", f"WITH bl AS ({BUREAU_SQL}), st AS (SELECT code, MIN(adjustment) AS adj FROM sector_table WHERE active_flag = 'Y' GROUP BY code), ", 1)
       + "SELECT loan_id, CAST(score AS BIGINT) AS score, decision FROM ev WHERE outcome = 'SCORED'")
def _(s):
    df = evaluated(s, sectors=reference_tables.active_sectors(s("sector_table")), bureau=s("bureau"))
    return df.where(F.col("outcome") == "SCORED").select("loan_id", "score", "decision")
