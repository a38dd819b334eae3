"""Registered queries: classification, recovery, report, insurance, payroll, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.adapters import TODAY
from creditloom.catalog.credit_queries import eval_sql
from creditloom.catalog.registry import big, half_up, query
from creditloom.functions import pic
from creditloom.operators import matching, ordered
from creditloom.plans import batch, insurance, ledger, payroll, recovery, report, risk

CLASS_SQL = "CASE WHEN dpd <= 30 THEN '1' WHEN dpd <= 90 THEN '2' WHEN dpd <= 180 THEN '3' ELSE '4' END"


def cl_sql(mode: str = "literal") -> str:
    top = 0 if mode == "literal" else 1000000
    return f"""WITH c0 AS (SELECT loan_id, cust_id, status, loan_type, rate_e4, outstanding_cents, dpd, loan_class AS prev_class, {CLASS_SQL} AS loan_class,
  CASE WHEN dpd <= 30 THEN 0 WHEN dpd <= 90 THEN 200000 WHEN dpd <= 180 THEN 500000 ELSE {top} END AS prov_rate_e4 FROM loan WHERE status IN ('AC','RS')),
 cl AS (SELECT *, (outstanding_cents * prov_rate_e4 * 2 + 1000000) // 2000000 AS provision_cents FROM c0)
"""


# The loan table after classification: what recovery and report read.
MASTER_SQL = f"""WITH m0 AS (SELECT loan_id, cust_id, loan_type, status, rate_e4, outstanding_cents, dpd, original_cents,
  CASE WHEN status IN ('AC','RS') THEN {CLASS_SQL} ELSE loan_class END AS loan_class,
  CASE WHEN status NOT IN ('AC','RS') OR dpd <= 30 OR dpd > 180 THEN 0 WHEN dpd <= 90 THEN 200000 ELSE 500000 END AS prov_rate_e4 FROM loan),
 ma AS (SELECT *, (outstanding_cents * prov_rate_e4 * 2 + 1000000) // 2000000 % 100000000000 AS provision_cents FROM m0),
 pf AS (SELECT *, CASE WHEN loan_class IN ('2','3','4') THEN loan_class ELSE '1' END AS rc FROM ma WHERE status IN ('AC','RS'))
"""


def master(s):
    return risk.rewrite_loans(s("loan"))


@query("i16_classify", "loan", cl_sql() + f"SELECT loan_id, prev_class, loan_class, {big('prov_rate_e4')} AS prov_rate_e4 FROM cl")
def _(s):
    return risk.classify(s("loan")).select("loan_id", "prev_class", "loan_class", "prov_rate_e4")


@query("i17_provision", "loan", cl_sql() + f"SELECT loan_id, {big('provision_cents')} AS provision_cents FROM cl")
def _(s):
    return risk.classify(s("loan")).select("loan_id", "provision_cents")


@query("i17_provision_clean", "loan", cl_sql("clean") + f"SELECT loan_id, {big('provision_cents')} AS provision_cents FROM cl")
def _(s):
    return risk.classify(s("loan"), pic.CLEAN).select("loan_id", "provision_cents")


TOT = f"SELECT d.k AS loan_class, COUNT(cl.loan_id) AS loans, {big('COALESCE(SUM(outstanding_cents), 0)')} AS outstanding_cents, {big('COALESCE(SUM(provision_cents), 0)')} AS provision_cents FROM (VALUES ('1'),('2'),('3'),('4')) d(k) LEFT JOIN cl ON cl.loan_class = d.k GROUP BY d.k"


@query("d2_class_totals", "loan", cl_sql() + TOT)
def _(s):
    return risk.class_totals(risk.classify(s("loan")))


@query("d2_class_totals_clean", "loan", cl_sql("clean") + TOT)
def _(s):
    return risk.class_totals(risk.classify(s("loan"), pic.CLEAN))


@query("i18_classify_portfolio", "loan prior_action", cl_sql() + f"""SELECT cl.loan_id, loan_class, {big('provision_cents')} AS provision_cents, CASE WHEN p.loan_id IS NOT NULL THEN 'REC' ELSE 'NRC' END AS recovery_flag
 FROM cl LEFT JOIN (SELECT DISTINCT loan_id FROM prior_action) p ON p.loan_id = cl.loan_id""")
def _(s):
    return risk.classify_portfolio(s("loan"), s("prior_action")).select("loan_id", "loan_class", "provision_cents", "recovery_flag")


@query("i18_rewrite_loans", "loan", MASTER_SQL + f"SELECT loan_id, loan_class, {big('prov_rate_e4')} AS prov_rate_e4, {big('provision_cents')} AS provision_cents FROM ma")
def _(s):
    return master(s).select("loan_id", "loan_class", "prov_rate_e4", "provision_cents")


@query("a16_risk_history", "loan", cl_sql() + f"SELECT loan_id, cust_id, loan_class AS new_class, prev_class, outstanding_cents, {big('provision_cents')} AS provision_cents, dpd, {big(TODAY)} AS report_date FROM cl")
def _(s):
    return risk.risk_history(risk.classify(s("loan")), TODAY)


@query("d15_counterparty_exposure", "loan", f"SELECT cust_id, COUNT(*) AS loans, {big('SUM(outstanding_cents)')} AS outstanding_cents FROM loan WHERE status IN ('AC','RS') GROUP BY cust_id")
def _(s):
    return risk.counterparty_exposure(s("loan"))


# --- recovery ----------------------------------------------------------------

def rec_sql(mode: str = "literal") -> str:
    claim = "outstanding_cents // 100 * 100" if mode == "literal" else "outstanding_cents"
    return MASTER_SQL + f""", q0 AS (SELECT *, CASE loan_class WHEN '2' THEN 100 WHEN '3' THEN 200 ELSE 300 END AS priority, {claim} AS claim_cents FROM pf WHERE loan_class IN ('2','3','4')),
 q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY priority DESC, claim_cents DESC, loan_id) AS queue_no,
  CASE WHEN loan_class = '2' THEN CASE WHEN dpd <= 45 THEN 'SMS' WHEN dpd <= 60 THEN 'PHN' ELSE 'DUL' END WHEN loan_class = '3' THEN CASE WHEN dpd <= 120 THEN 'LEG' WHEN dpd <= 150 THEN 'GTR' ELSE 'RST' END
   WHEN dpd <= 365 THEN 'CRT' WHEN dpd <= 540 AND claim_cents > 5000000 THEN 'CSZ' ELSE 'WOF' END AS action_type FROM q0)
"""


DAYS_SQL = "CASE action_type WHEN 'SMS' THEN 7 WHEN 'PHN' THEN 7 WHEN 'DUL' THEN 15 WHEN 'LEG' THEN 30 WHEN 'GTR' THEN 30 WHEN 'RST' THEN 30 WHEN 'CRT' THEN 60 WHEN 'CSZ' THEN 60 ELSE 0 END"


@query("b9_delinquent", "loan", rec_sql() + f"SELECT loan_id, {big('priority')} AS priority FROM q")
def _(s):
    return recovery.delinquent(master(s)).select("loan_id", "priority")


@query("f1_recovery_queue", "loan", rec_sql() + f"SELECT queue_no, loan_id, {big('claim_cents')} AS claim_cents FROM q")
def _(s):
    return recovery.recovery_queue(master(s)).select("queue_no", "loan_id", "claim_cents")


@query("i19_recovery_action", "loan", rec_sql() + "SELECT loan_id, action_type FROM q")
def _(s):
    d = recovery.delinquent(master(s))
    claim = recovery.sort_amount(F.col("outstanding_cents"))
    return d.select("loan_id", recovery.recovery_action(F.col("loan_class"), F.col("dpd"), claim).alias("action_type"))


@query("i20_next_action_date", "loan", rec_sql() + f"""SELECT loan_id, {big(f'{TODAY} + {DAYS_SQL}')} AS literal_date,
 CAST(STRFTIME(DATE '2026-05-31' + CAST({DAYS_SQL} AS INTEGER), '%Y%m%d') AS BIGINT) AS clean_date FROM q""")
def _(s):
    d = recovery.delinquent(master(s))
    a = recovery.recovery_action(F.col("loan_class"), F.col("dpd"), recovery.sort_amount(F.col("outstanding_cents")))
    d = d.select("loan_id", a.alias("a"))
    return d.select("loan_id", recovery.next_action_date(F.col("a"), TODAY).alias("literal_date"), recovery.next_action_date(F.col("a"), TODAY, pic.CLEAN).alias("clean_date"))


ACT_OUT = f"""SELECT queue_no AS action_id, loan_id, cust_id, action_type, {big('claim_cents')} AS claimed_cents, {big(f'{TODAY} + {DAYS_SQL}')} AS next_action_date,
 CONCAT('ACTION ', action_type, ' AMT ', LPAD(CAST(claim_cents // 100 AS STRING), 13, '0'), ' DPD ', LPAD(CAST(dpd AS STRING), 4, '0')) AS comments FROM q"""


@query("i21_recovery_actions", "loan", rec_sql() + ACT_OUT)
def _(s):
    return recovery.recovery_actions(master(s), TODAY).select("action_id", "loan_id", "cust_id", "action_type", "claimed_cents", "next_action_date", "comments")


@query("d3_recovery_totals", "loan", MASTER_SQL + f"SELECT d.k AS loan_class, COUNT(pf.loan_id) AS loans, {big('COALESCE(SUM(outstanding_cents), 0)')} AS amount_cents FROM (VALUES ('2'),('3'),('4')) d(k) LEFT JOIN pf ON pf.loan_class = d.k GROUP BY d.k")
def _(s):
    return recovery.recovery_totals(master(s))


@query("d4_action_totals", "loan", rec_sql() + "SELECT d.k AS action_type, COUNT(q.loan_id) AS actions FROM (VALUES ('SMS'),('EML'),('PHN'),('DUL'),('LEG'),('GTR'),('RST'),('CRT'),('CSZ'),('WOF')) d(k) LEFT JOIN q ON q.action_type = d.k GROUP BY d.k")
def _(s):
    return recovery.action_totals(master(s))


@query("c9_recovery_customer", "loan cust", rec_sql() + "SELECT q.loan_id, c.last_name, c.line1, c.city FROM q LEFT JOIN cust c ON c.cust_id = q.cust_id")
def _(s):
    d = recovery.delinquent(master(s))
    return d.join(s("cust").select("cust_id", "last_name", "line1", "city"), "cust_id", "left").select("loan_id", "last_name", "line1", "city")


LETTERHEAD = ["CREDIT BANK", "1 MAIN STREET", "Tel: 000"]


def letter_check() -> str:
    body = "CASE action_type WHEN 'DUL' THEN 'Nous constatons un retard de paiement sur votre dossier de credit.' WHEN 'LEG' THEN 'Suite a nos rappels precedents restes sans suite, nous vous mettons formellement en demeure.' ELSE 'Nous nous reservons le droit de faire appel au garant en cas de non regularisation.' END"
    lines = {
        1: "'CREDIT BANK'", 2: "'1 MAIN STREET'", 3: "'Tel: 000'", 5: f"'Tunis, le {TODAY}'",
        7: "CONCAT('Madame, Monsieur ', RPAD(COALESCE(first_name, ''), 25, ' '), ' ', RPAD(COALESCE(last_name, ''), 30, ' '))", 8: "COALESCE(line1, '')",
        9: "CONCAT(RPAD(COALESCE(zip, ''), 5, ' '), ' ', COALESCE(city, ''))", 12: "CONCAT('Objet: Mise en demeure - Dossier ', LPAD(CAST(loan_id AS STRING), 10, '0'))", 15: body,
        17: "CONCAT('Montant du sont: ', LPAD(CAST(claim_cents // 100 AS STRING), 13, '0'), ' TND')", 18: "CONCAT('Jours de retard: ', LPAD(CAST(dpd AS STRING), 4, '0'))",
        21: "'Veuillez regulariser votre situation dans un delai de 15 jours.'",
        24: "'Veuillez agreer, Madame, Monsieur, l expression de nos salutations distinguees.'", 28: "'Le Directeur du Recouvrement'", 32: "REPEAT('=', 137)",
    }
    case = "CASE n " + " ".join(f"WHEN {i} THEN {e}" for i, e in lines.items()) + " ELSE '' END"
    return rec_sql() + f"""SELECT queue_no AS action_id, n AS line_no, RPAD({case}, 137, ' ') AS value
 FROM (SELECT q.*, c.first_name, c.last_name, c.line1, c.zip, c.city, UNNEST(range(1, 34)) AS n FROM q LEFT JOIN cust c ON c.cust_id = q.cust_id WHERE action_type IN ('DUL','LEG','GTR'))"""


@query("i22_dunning_letters", "loan cust", letter_check())
def _(s):
    return recovery.dunning_letters(recovery.recovery_actions(master(s), TODAY), s("cust"), LETTERHEAD, "Tunis", TODAY)


# --- report ------------------------------------------------------------------

@query("d5_portfolio_by_class", "loan", MASTER_SQL + f"SELECT d.k AS loan_class, COUNT(pf.loan_id) AS loans, {big('COALESCE(SUM(outstanding_cents), 0)')} AS outstanding_cents, {big('COALESCE(SUM(provision_cents), 0)')} AS provision_cents FROM (VALUES ('1'),('2'),('3'),('4')) d(k) LEFT JOIN pf ON pf.rc = d.k GROUP BY d.k")
def _(s):
    return report.portfolio_by_class(master(s))


@query("d6_portfolio_by_type", "loan", MASTER_SQL + f"SELECT d.k AS loan_type, COUNT(pf.loan_id) AS loans, {big('COALESCE(SUM(outstanding_cents), 0)')} AS outstanding_cents FROM (VALUES ('CON'),('IMM'),('AUT'),('PRO'),('REV'),('DEC')) d(k) LEFT JOIN pf ON pf.loan_type = d.k GROUP BY d.k")
def _(s):
    return report.portfolio_by_type(master(s))


@query("d7_portfolio_by_segment", "loan cust", MASTER_SQL + f"""SELECT d.k AS segment, COUNT(x.loan_id) AS loans, {big('COALESCE(SUM(outstanding_cents), 0)')} AS outstanding_cents,
 COUNT(*) FILTER (x.status = 'AC') AS active_loans, COUNT(*) FILTER (x.status = 'RS') AS other_loans
 FROM (VALUES ('MM'),('MB'),('PR'),('PB')) d(k) LEFT JOIN (SELECT pf.*, c.segment FROM pf JOIN cust c ON c.cust_id = pf.cust_id) x ON x.segment = d.k GROUP BY d.k""")
def _(s):
    return report.portfolio_by_segment(master(s), s("cust"))


TOTALS_SQL = f"""SELECT COUNT(*) AS loans, {big('SUM(outstanding_cents)')} AS outstanding_cents, {big('SUM(provision_cents)')} AS provision_cents,
 {big('SUM(rate_e4 * outstanding_cents // 10000) * 10000 // SUM(outstanding_cents)')} AS avg_rate_e4, {big('SUM(provision_cents) * 10000 // SUM(outstanding_cents)')} AS provision_pct_e2 FROM pf"""


@query("d8_portfolio_totals", "loan", MASTER_SQL + TOTALS_SQL)
def _(s):
    return report.portfolio_totals(master(s))


@query("d9_risk_ratios", "loan", MASTER_SQL + ", t AS (SELECT SUM(outstanding_cents) AS t, SUM(CASE WHEN rc <> '1' THEN outstanding_cents ELSE 0 END) AS n, SUM(CASE WHEN rc = '4' THEN outstanding_cents ELSE 0 END) AS l, SUM(provision_cents) AS p FROM pf) "
       + f"SELECT {half_up('n', 't', 4)} AS npl_pct_e2, {half_up('l', 't', 4)} AS loss_pct_e2, {half_up('p', 't', 4)} AS coverage_pct_e2 FROM t")
def _(s):
    return report.risk_ratios(master(s))


SECTIONS_SQL = MASTER_SQL + ", x AS (SELECT pf.*, COALESCE(c.segment, '') AS segment FROM pf LEFT JOIN cust c ON c.cust_id = pf.cust_id) " + " UNION ALL ".join(
    f"SELECT '{n}' AS section, {c} AS code, COUNT(*) AS loans, {big('SUM(outstanding_cents)')} AS outstanding_cents, {big('SUM(provision_cents)')} AS provision_cents FROM x GROUP BY {c}"
    for n, c in (("class", "rc"), ("type", "loan_type"), ("segment", "segment"))
) + f" UNION ALL SELECT 'total', 'ALL', COUNT(*), {big('SUM(outstanding_cents)')}, {big('SUM(provision_cents)')} FROM x"


@query("d10_portfolio_sections", "loan cust", SECTIONS_SQL)
def _(s):
    return report.portfolio_sections(master(s), s("cust"))


TOP_SQL = MASTER_SQL + """SELECT p.loan_id, p.cust_id, RTRIM(SUBSTR(CONCAT(RPAD(COALESCE(c.last_name, ''), 30, ' '), ' ', COALESCE(c.first_name, '')), 1, 40)) AS cust_name, p.outstanding_cents, p.loan_class, p.loan_type
 FROM (SELECT * FROM pf WHERE outstanding_cents > 0 ORDER BY outstanding_cents DESC, loan_id LIMIT 10) p LEFT JOIN cust c ON c.cust_id = p.cust_id"""


@query("f2_top_exposures", "loan cust", TOP_SQL)
def _(s):
    return report.top_exposures(master(s), s("cust"))


@query("c10_report_customer", "loan cust", MASTER_SQL + "SELECT pf.loan_id, COALESCE(c.first_name, '') AS first_name, COALESCE(c.last_name, '') AS last_name, COALESCE(c.segment, '') AS segment FROM pf LEFT JOIN cust c ON c.cust_id = pf.cust_id")
def _(s):
    return report.with_customer(risk.active_portfolio(master(s)), s("cust")).select("loan_id", "first_name", "last_name", "segment")


@query("i23_monthly_report", "loan cust", SECTIONS_SQL.replace(" UNION ALL SELECT 'total'", " UNION ALL SELECT 'rate', CAST(SUM(rate_e4 * outstanding_cents // 10000) * 10000 // SUM(outstanding_cents) AS STRING), COUNT(*), 0, 0 FROM x UNION ALL SELECT 'total'"))
def _(s):
    m = master(s)
    t = report.portfolio_totals(m)
    zero = F.lit(0).cast("bigint")
    rate = t.select(F.lit("rate").alias("section"), F.col("avg_rate_e4").cast("string").alias("code"), "loans", zero.alias("outstanding_cents"), zero.alias("provision_cents"))
    return report.portfolio_sections(m, s("cust")).unionByName(rate)


# --- insurance ---------------------------------------------------------------

def premium_sql(mode: str = "literal") -> str:
    load = "accidents * 7500 % 1000" if mode == "literal" else "accidents * 7500"
    wrap = "% 10000000000" if mode == "literal" else ""
    return f"""WITH p0 AS (SELECT *, CASE WHEN age < 18 THEN 'AGE CONDUCTEUR INFERIEUR A 18 ANS' WHEN age > 80 THEN 'AGE CONDUCTEUR DEPASSE 80 ANS' WHEN licence_years = 0 THEN 'PERMIS DE CONDUIRE REQUIS' WHEN crm_e2 > 350 THEN 'COEFFICIENT CRM TROP ELEVE' END AS refusal,
  CASE category WHEN 'UT' THEN 620000 WHEN 'MT' THEN 320000 WHEN 'CM' THEN 950000 WHEN 'LX' THEN 1850000 ELSE 480000 END AS base_e3,
  CASE WHEN age < 25 THEN 160 WHEN age < 30 THEN 125 WHEN age < 65 THEN 100 ELSE 130 END AS a0,
  CASE WHEN power <= 4 THEN 85 WHEN power <= 7 THEN 100 WHEN power <= 10 THEN 120 WHEN power <= 14 THEN 150 ELSE 200 END AS power_e2,
  CASE coverage WHEN 'TC' THEN 180 WHEN 'TI' THEN 320 ELSE 100 END AS cover_e2,
  CASE gov WHEN 'TUN' THEN 120 WHEN 'ARI' THEN 115 WHEN 'BAR' THEN 110 WHEN 'SFX' THEN 105 WHEN 'SOU' THEN 105 WHEN 'NAB' THEN 100 WHEN 'BIZ' THEN 95 ELSE 90 END AS region_e2,
  {load} AS load_e2 FROM quote),
 p1 AS (SELECT *, CASE WHEN licence_years >= 10 AND age < 65 THEN a0 * 85 // 100 ELSE a0 END AS age_e2 FROM p0),
 p2 AS (SELECT *, CASE WHEN refusal IS NULL THEN LEAST(GREATEST((CAST(base_e3 AS HUGEINT) * age_e2 * power_e2 * cover_e2 * region_e2 * crm_e2 + load_e2 * 100000000000 + 5000000000) // 10000000000 {wrap}, 250000), 25000000) END AS net_e3 FROM p1),
 p3 AS (SELECT *, (net_e3 * 19 + 50) // 100 AS tax_e3, (net_e3 * 5 + 50) // 100 AS parafiscal_e3,
  CASE WHEN accidents >= 3 THEN 'SINISTRES > 3 - REVUE MANUELLE REQUISE' WHEN crm_e2 > 200 THEN 'CRM ELEVE - REVUE MANUELLE' END AS manual FROM p2),
 pr AS (SELECT *, net_e3 + tax_e3 + parafiscal_e3 AS total_e3, CASE WHEN refusal IS NOT NULL THEN 'REFUSE' WHEN manual IS NOT NULL THEN 'MANUEL' ELSE 'ACCEPTE' END AS decision, COALESCE(refusal, manual) AS reason FROM p3)
"""


PREM = ["age_e2", "power_e2", "cover_e2", "region_e2", "load_e2", "net_e3", "tax_e3", "parafiscal_e3", "total_e3"]
PREM_OUT = "SELECT quote_id, decision, reason, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in PREM) + " FROM pr"


@query("b10_check_quote", "quote", premium_sql() + "SELECT quote_id, refusal FROM pr")
def _(s):
    return s("quote").select("quote_id", insurance.check_quote().alias("refusal"))


@query("i24_auto_premium", "quote", premium_sql() + PREM_OUT)
def _(s):
    return insurance.auto_premium(s("quote")).select("quote_id", "decision", "reason", *PREM)


@query("i24_auto_premium_clean", "quote", premium_sql("clean") + PREM_OUT)
def _(s):
    return insurance.auto_premium(s("quote"), pic.CLEAN).select("quote_id", "decision", "reason", *PREM)


@query("d11_premium_totals", "quote", premium_sql() + f"""SELECT COUNT(*) FILTER (decision = 'ACCEPTE') AS accepted, COUNT(*) FILTER (decision = 'REFUSE') AS refused, COUNT(*) FILTER (decision = 'MANUEL') AS manual,
 {big("SUM(net_e3 // 10 * 10) FILTER (decision = 'ACCEPTE')")} AS net_e3, {big("SUM(total_e3 // 10 * 10) FILTER (decision = 'ACCEPTE')")} AS gross_e3 FROM pr""")
def _(s):
    return insurance.premium_totals(insurance.auto_premium(s("quote")))


# --- payroll -----------------------------------------------------------------

PAY_SQL = """WITH w0 AS (SELECT *, active = 'Y' AND computed = 'N' AND hours_tenths > 0 AS pays,
  (LEAST(hours_tenths, 400) * rate_cents + 5) // 10 + (GREATEST(hours_tenths - 400, 0) * rate_cents * 15 + 50) // 100 AS g FROM employee),
 w1 AS (SELECT *, (g * (CASE WHEN g < 50000 THEN 5 WHEN g < 150000 THEN 12 WHEN g < 300000 THEN 22 ELSE 30 END) + 50) // 100 AS t FROM w0),
 pay AS (SELECT emp_id, emp_name, active, hours_tenths, CASE WHEN pays THEN g ELSE gross_cents END AS gross_cents, CASE WHEN pays THEN t ELSE tax_cents END AS tax_cents,
  CASE WHEN pays THEN g - t ELSE net_cents END AS net_cents, CASE WHEN pays THEN 'Y' ELSE computed END AS computed FROM w1)
"""
PAY_COLS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("gross_cents", "tax_cents", "net_cents"))


@query("b11_payable", "employee", "SELECT emp_id FROM employee WHERE active = 'Y' AND computed = 'N' AND hours_tenths > 0")
def _(s):
    return s("employee").where(payroll.payable()).select("emp_id")


@query("i25_payroll", "employee", PAY_SQL + f"SELECT emp_id, computed, {PAY_COLS} FROM pay")
def _(s):
    return payroll.payroll(s("employee")).select("emp_id", "computed", "gross_cents", "tax_cents", "net_cents")


@query("d12_pay_summary", "employee", PAY_SQL + f"""SELECT COUNT(*) AS employees, {big('SUM(gross_cents)')} AS gross_cents, {big('SUM(tax_cents)')} AS tax_cents, {big('SUM(net_cents)')} AS net_cents,
 (SELECT emp_name FROM pay WHERE active = 'Y' AND computed = 'Y' ORDER BY gross_cents DESC, emp_id LIMIT 1) AS highest_paid FROM pay WHERE active = 'Y' AND computed = 'Y'""")
def _(s):
    return payroll.pay_summary(payroll.payroll(s("employee")))


@query("i26_reset_pay_period", "employee", PAY_SQL + """SELECT emp_id, CASE WHEN active = 'Y' THEN 0 ELSE hours_tenths END AS hours_tenths, CAST(CASE WHEN active = 'Y' THEN 0 ELSE gross_cents END AS BIGINT) AS gross_cents,
 CAST(CASE WHEN active = 'Y' THEN 0 ELSE tax_cents END AS BIGINT) AS tax_cents, CAST(CASE WHEN active = 'Y' THEN 0 ELSE net_cents END AS BIGINT) AS net_cents, CASE WHEN active = 'Y' THEN 'N' ELSE computed END AS computed FROM pay""")
def _(s):
    return payroll.reset_pay_period(payroll.payroll(s("employee"))).select("emp_id", "hours_tenths", "gross_cents", "tax_cents", "net_cents", "computed")


# --- ledger ------------------------------------------------------------------

@query("c11_split_transactions", "txn ledger", """SELECT t.txn_id, CASE WHEN l.cust_id IS NULL THEN 'FAILED' ELSE 'POSTED' END AS outcome FROM txn t LEFT JOIN ledger l ON l.cust_id = t.cust_id""")
def _(s):
    ok, bad = ledger.split_transactions(s("txn"), s("ledger"))
    return ok.select("txn_id", F.lit("POSTED").alias("outcome")).unionByName(bad.select("txn_id", F.lit("FAILED").alias("outcome")))


@query("i27_post_transactions", "txn ledger", f"""SELECT l.cust_id, l.balance_cents + COALESCE(d.v, 0) AS balance_cents, COALESCE(d.n, 0) AS posted FROM ledger l
 LEFT JOIN (SELECT cust_id, {big('SUM(amount_cents)')} AS v, COUNT(*) AS n FROM txn GROUP BY cust_id) d ON d.cust_id = l.cust_id""")
def _(s):
    return ledger.post_transactions(s("txn"), s("ledger")).select("cust_id", "balance_cents", "posted")


@query("i27_failed_lines", "txn ledger", "SELECT t.txn_id, CONCAT(RPAD(CAST(t.cust_id AS STRING), 10, ' '), 'FAILED') AS line FROM txn t ANTI JOIN ledger l ON l.cust_id = t.cust_id")
def _(s):
    return ledger.failed_lines(s("txn"), s("ledger"))


@query("d14_posting_totals", "txn ledger", "SELECT COUNT(*) FILTER (l.cust_id IS NOT NULL) AS posted, COUNT(*) FILTER (l.cust_id IS NULL) AS failed FROM txn t LEFT JOIN ledger l ON l.cust_id = t.cust_id")
def _(s):
    return ledger.posting_totals(s("txn"), s("ledger"))


@query("e4_running_balance", "txn ledger", f"""SELECT t.txn_id, t.cust_id, t.amount_cents, {big('l.balance_cents + SUM(t.amount_cents) OVER (PARTITION BY t.cust_id ORDER BY t.txn_id ROWS UNBOUNDED PRECEDING)')} AS balance_cents
 FROM txn t JOIN ledger l ON l.cust_id = t.cust_id""")
def _(s):
    return ledger.running_balance(s("txn"), s("ledger"))


@query("b12_statement_rows", "ledger", "SELECT cust_id, name FROM ledger WHERE status = 'A'")
def _(s):
    return ledger.statement_rows(s("ledger")).select("cust_id", "name")


@query("d13_statement_totals", "ledger", f"SELECT COUNT(*) AS records, {big('SUM(balance_cents)')} AS total_cents FROM ledger WHERE status = 'A'")
def _(s):
    return ledger.statement_totals(s("ledger"))


@query("i28_statements", "ledger", f"""WITH t AS (SELECT COUNT(*) AS n, {big('SUM(balance_cents)')} AS v FROM ledger WHERE status = 'A')
 SELECT 0 AS section, CAST(NULL AS BIGINT) AS cust_id, 'CUSTOMER STATEMENT REPORT' AS line
 UNION ALL SELECT 1, cust_id, CONCAT(RPAD(CAST(cust_id AS STRING), 10, ' '), RPAD(name, 30, ' ')) FROM ledger WHERE status = 'A'
 UNION ALL SELECT 2, NULL, CONCAT('GRAND TOTAL:  ', LPAD(CAST(v // 100 AS STRING), 12, ' '), '.', LPAD(CAST(v % 100 AS STRING), 2, '0')) FROM t
 UNION ALL SELECT 2, NULL, CONCAT('TOTAL RECORDS:  ', LPAD(CAST(n AS STRING), 5, '0')) FROM t UNION ALL SELECT 2, NULL, 'END OF REPORT'""")
def _(s):
    return ledger.statements(s("ledger"))


@query("c12_merge", "ledger txn", """WITH ch AS (SELECT cust_id, CASE cust_id % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'U' WHEN 2 THEN 'D' ELSE 'S' END AS op, CONCAT('NEW', CAST(cust_id AS STRING)) AS name FROM (SELECT DISTINCT ABS(cust_id) * 12 AS cust_id FROM txn UNION SELECT DISTINCT ABS(cust_id) * 12 + 1 FROM txn UNION SELECT DISTINCT ABS(cust_id) * 15 + 2 FROM txn UNION SELECT DISTINCT ABS(cust_id) * 16 + 3 FROM txn)),
 j AS (SELECT COALESCE(l.cust_id, ch.cust_id) AS cust_id, l.cust_id IS NOT NULL AS old, ch.op, l.name AS t_name, ch.name AS c_name FROM ledger l FULL JOIN ch ON ch.cust_id = l.cust_id),
 v AS (SELECT *, CASE WHEN op IS NULL THEN 'KEPT' WHEN op = 'I' AND old THEN 'REJECTED DUPLICATE' WHEN op = 'I' OR (op = 'S' AND NOT old) THEN 'INSERTED' WHEN NOT old THEN 'REJECTED NOT FOUND' WHEN op = 'D' THEN 'DELETED' ELSE 'UPDATED' END AS action FROM j)
 SELECT cust_id, CASE WHEN action IN ('INSERTED','UPDATED') THEN c_name ELSE t_name END AS name, action, action NOT IN ('DELETED','REJECTED NOT FOUND') AS live FROM v""")
def _(s):
    k = F.abs("cust_id")
    t = s("txn")
    ids = t.select(F.explode(F.array(k * 12, k * 12 + 1, k * 15 + 2, k * 16 + 3)).alias("cust_id")).distinct()
    m = F.col("cust_id") % 4
    op = F.when(m == 0, "I").when(m == 1, "U").when(m == 2, "D").otherwise("S")
    ch = ids.select("cust_id", op.alias("op"), F.concat(F.lit("NEW"), F.col("cust_id").cast("string")).alias("name"))
    return matching.merge(s("ledger"), ch, "cust_id", ["name"])


@query("e3_paginate", "loan", """SELECT n AS line_no, n > 55 AND (n - 56) % 53 = 0 AS starts_page, CASE WHEN n <= 55 THEN 0 ELSE (n - 56) // 53 + 1 END AS page FROM (SELECT ROW_NUMBER() OVER (ORDER BY loan_id) AS n FROM loan)""")
def _(s):
    n = ordered.number_by_id(s("loan").select("loan_id"), "loan_id", "line_no")
    starts, page = ordered.paginate(F.col("line_no"))
    return n.select("line_no", starts.alias("starts_page"), page.alias("page"))


def _batch_check() -> str:
    ev = eval_sql("literal")
    cl = cl_sql()[5:]
    ma = rec_sql()[5:]
    return ev + "," + cl + "," + ma + f""" SELECT (SELECT COUNT(*) FROM ev) AS read_count, (SELECT COUNT(*) FROM ev WHERE decision = 'AP') AS approved_count,
 (SELECT COUNT(*) FROM ev WHERE decision IN ('CO','RV')) AS conditional_count, (SELECT COUNT(*) FROM ev WHERE decision = 'DC' OR outcome = 'REJECTED') AS declined_count,
 (SELECT COUNT(*) FROM ev WHERE outcome = 'ERROR') AS error_count, (SELECT COUNT(*) FROM cl) AS classified, (SELECT {big('SUM(provision_cents)')} FROM cl) AS provision_cents,
 (SELECT COUNT(*) FROM q) AS actions, (SELECT COUNT(*) FROM pf) AS report_loans, (SELECT {big('SUM(outstanding_cents)')} FROM pf) AS outstanding_cents,
 (SELECT {big('SUM(rate_e4 * outstanding_cents // 10000) * 10000 // SUM(outstanding_cents)')} FROM pf) AS avg_rate_e4"""


@query("i29_monthly_batch", "loan cust collateral guarantee sanction prior_action", _batch_check())
def _(s):
    t = batch.monthly_batch(*s("loan", "cust", "collateral", "guarantee", "sanction", "prior_action"), TODAY)
    return batch.batch_summary(t)
