"""Registered queries: fixed-width files, reports, generated data, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.catalog.adapters import TODAY, VIEWS
from creditloom.catalog.credit_queries import BASE, eval_sql, evaluated
from creditloom.catalog.portfolio_queries import LETTERHEAD, MASTER_SQL, SECTIONS_SQL, TOP_SQL, TOTALS_SQL, cl_sql, letter_check, master, rec_sql
from creditloom.catalog.registry import big, half_up, query
from creditloom.catalog.credit_queries import PEOPLE_SQL, aml_ctes
from creditloom.functions import pic
from creditloom.plans import credit, ledger, recovery, report, risk
from creditloom.session import cut, scratch_path
from creditloom.sources import fixed, layouts, portfolio, reports
from creditloom.streaming import jobs

BANK, PROGRAM = "CREDIT BANK", "BATCH"
LOAN_COLS = [f.name for f in layouts.LOAN if f.name in VIEWS["loan"][2]]


@query("a1_read_fixed", "loan", "SELECT " + ", ".join(LOAN_COLS) + " FROM loan")
def _(s):
    path = scratch_path(s.spark, "loanfile")
    fixed.write_fixed(s("loan"), layouts.LOAN, path)
    return fixed.read_fixed(s.spark, path, layouts.LOAN).select(*LOAN_COLS)


@query("a1_read_fixed_nested", "cust", "SELECT cust_id, cin, first_name, last_name, income_cents, segment, line1, city FROM cust")
def _(s):
    path = scratch_path(s.spark, "custfile")
    none = F.lit("")
    c = s("cust").withColumn("address", F.struct("line1", none.alias("line2"), "city", "zip", none.alias("gov")))
    fixed.write_fixed(c, layouts.CUSTOMER, path, ["cust_id"])
    back = fixed.read_fixed(s.spark, path, layouts.CUSTOMER)
    return back.select("cust_id", "cin", "first_name", "last_name", "income_cents", "segment", "address.line1", "address.city")


@query("a2_read_fixed_binary", "loan", "SELECT loan_id, cust_id, loan_type, outstanding_cents, dpd FROM loan")
def _(s):
    path = scratch_path(s.spark, "loanrecords")
    fixed.join_records(fixed.encode_lines(s("loan"), layouts.LOAN), layouts.width(layouts.LOAN), path)
    return fixed.read_fixed_binary(s.spark, path, layouts.LOAN).select("loan_id", "cust_id", "loan_type", "outstanding_cents", "dpd")


@query("a3_redelimit", "source_line", "SELECT RPAD(SUBSTR(text, 1, 40), 40, ' ') AS value FROM source_line")
def _(s):
    return fixed.redelimit(s("source_line").select(F.col("text").alias("value")), 40)


PACK = "CONCAT(LPAD(CAST(ABS({c}) AS STRING), {n}, '0'), CASE WHEN {c} < 0 THEN 'D' ELSE 'C' END)"


@query("a4_packed_decimal", "txn", f"SELECT txn_id, {PACK.format(c='amount_cents', n=9)} AS packed, amount_cents FROM txn")
def _(s):
    t = s("txn").select("txn_id", pic.pack_comp3(F.col("amount_cents"), 9).alias("p"))
    return t.select("txn_id", F.hex("p").alias("packed"), pic.unpack_comp3(F.col("p")).alias("amount_cents"))


@query("a4_packed_records", "txn", "SELECT CAST(txn_id AS STRING) AS txn_id, CAST(cust_id AS STRING) AS cust_id, amount_cents FROM txn")
def _(s):
    t = s("txn").select("txn_id", "cust_id", F.substring("txn_type", 1, 2).alias("txn_type"), "amount_cents", F.lit(TODAY).alias("txn_date"))
    return fixed.decode_records(fixed.encode_records(t, layouts.LEDGER_TXN), layouts.LEDGER_TXN).select("txn_id", "cust_id", "amount_cents")


@query("a7_edited", "loan", """SELECT loan_id, CONCAT(LPAD(CAST(original_cents // 100 AS STRING), 10, ' '), ',', LPAD(CAST(original_cents % 100 AS STRING), 2, '0'), '0') AS amount,
 CONCAT(LPAD(CAST(rate_e4 // 10000 AS STRING), 2, ' '), ',', LPAD(CAST(rate_e4 % 10000 AS STRING), 4, '0')) AS rate, LPAD(FORMAT('{:,}', original_cents // 100), 12, ' ') AS grouped FROM loan""")
def _(s):
    o = F.col("original_cents")
    return s("loan").select(
        "loan_id", pic.edited(o, 2, 10, 3, point=",").alias("amount"), pic.edited(F.col("rate_e4"), 4, 2, 4, point=",").alias("rate"),
        pic.edited(o, 2, 12, 0, grouped=True).alias("grouped"),
    )


def z(c: str, n: int) -> str:
    return f"LPAD(CAST({c} AS STRING), {n}, '0')"


def header(page: str) -> str:
    return f"RPAD(CONCAT('          CREDIT BANK                   BATCH        PAGE: ', LPAD(CAST({page} AS STRING), 5, ' ')), 137, ' ')"


RULE = "REPEAT('=', 137)"
DEC_LABEL = "CASE decision WHEN 'AP' THEN 'APPROUVE' WHEN 'CO' THEN 'CONDITIONNE' WHEN 'RV' THEN 'A ETUDIER' ELSE 'REFUSE' END"
DEC_LINE = f"""RPAD(SUBSTR(CONCAT({z('loan_id', 10)}, '  ', {z('cust_id', 8)}, '  ', loan_type, '  ', LPAD(CAST(original_cents // 100 AS STRING), 10, ' '), ',', {z('original_cents % 100', 2)}, '0  ',
 LPAD(CAST(rate_e4 // 10000 AS STRING), 2, ' '), ',', {z('rate_e4 % 10000', 4)}, '  ', LPAD(CAST(score AS STRING), 4, ' '), '  ', RPAD({DEC_LABEL}, 11, ' '), '  ', RPAD(COALESCE(reason_1, ''), 50, ' ')), 1, 137), 137, ' ')"""
FOOT = "RPAD('                    DOCUMENT CONFIDENTIEL - USAGE INTERNE BCT', 137, ' ')"


def sub_header(title: str) -> str:
    return f"RPAD(CONCAT('               ', RPAD('{title}', 60, ' '), '     DATE: {TODAY}'), 137, ' ')"


def fixed_lines(section: int, exprs: list[str], src: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, CAST(0 AS BIGINT) AS seq, {i} AS part, RPAD({e}, 137, ' ') AS value {src}" for i, e in enumerate(exprs))


@query("a8_write_decisions", BASE, eval_sql("literal") + f""", nu AS (SELECT *, ROW_NUMBER() OVER (ORDER BY loan_id) AS n FROM ev WHERE outcome = 'SCORED'), br AS (SELECT *, n > 55 AND (n - 56) % 53 = 0 AS b FROM nu),
 t AS (SELECT COUNT(*) AS r, COUNT(*) FILTER (decision = 'AP') AS ap, COUNT(*) FILTER (decision IN ('CO','RV')) AS co, COUNT(*) FILTER (decision = 'DC' OR outcome = 'REJECTED') AS dc, SUM(original_cents) AS ta, COALESCE(SUM(original_cents) FILTER (decision = 'AP'), 0) AS aa FROM ev)
 {fixed_lines(0, [header('1'), sub_header('RAPPORT EVALUATION CREDITS - PRODUCTION'), RULE, "'  DOSSIER     CLIENT    TYPE   MONTANT         TAUX      SCORE   DECISION'", RULE])}
 UNION ALL SELECT 1, n, CASE WHEN b THEN 2 ELSE 0 END, {DEC_LINE} FROM br UNION ALL SELECT 1, n, 0, {header('(n - 56) // 53 + 1')} FROM br WHERE b UNION ALL SELECT 1, n, 1, {RULE} FROM br WHERE b
 UNION ALL {fixed_lines(2, [RULE, f"CONCAT('TOTAUX: TRAITES=', {z('r', 8)}, ' APPROUVES=', {z('ap', 8)}, ' CONDITIONNEL=', {z('co', 8)}, ' REFUSES=', {z('dc', 8)})", f"CONCAT('MONTANT TOTAL: ', {z('ta', 15)}, '  APPROUVE: ', {z('aa', 15)})", FOOT], 'FROM t')}""")
def _(s):
    ev = cut(evaluated(s))
    return reports.decision_report(ev.where(F.col("outcome") == "SCORED"), credit.loan_batch_stats(ev), BANK, PROGRAM, TODAY)


@query("a9_write_rejects", BASE, eval_sql("literal") + f"SELECT loan_id, RPAD(SUBSTR(CONCAT({z('loan_id', 10)}, '  ', {z('cust_id', 8)}, '  ', RPAD(reject_reason, 80, ' ')), 1, 120), 120, ' ') AS value FROM ev WHERE outcome <> 'SCORED'")
def _(s):
    return reports.reject_lines(evaluated(s))


@query("a10_write_bct_submission", "loan prior_action", cl_sql() + f"""SELECT cl.loan_id, RPAD(CONCAT('1234  {TODAY}  ', {z('cl.loan_id', 10)}, '  ', {z('cust_id', 8)}, '  ', loan_class, '  ', {z('outstanding_cents', 13)}, '  ', {z('provision_cents', 13)}, '  ', {z('dpd', 4)}, '  ',
 CASE WHEN p.loan_id IS NOT NULL THEN 'REC' ELSE 'NRC' END), 200, ' ') AS value FROM cl LEFT JOIN (SELECT DISTINCT loan_id FROM prior_action) p ON p.loan_id = cl.loan_id""")
def _(s):
    return reports.bct_lines(risk.classify_portfolio(s("loan"), s("prior_action")), 1234, TODAY)


@query("a10_ordered_text_sink", "loan prior_action", cl_sql() + f"SELECT COUNT(*) AS records, {big('SUM(200)')} AS chars, COUNT(*) AS in_order FROM cl")
def _(s):
    path = scratch_path(s.spark, "submission")
    lines = reports.bct_lines(risk.classify_portfolio(s("loan"), s("prior_action")), 1234, TODAY)
    reports.write_lines(lines, path, ("loan_id",))
    back = s.spark.read.text(path).select("value", F.expr("CAST(substring(value, 17, 10) AS BIGINT)").alias("id"), F.monotonically_increasing_id().alias("pos"), F.col("_metadata.file_name").alias("f"))
    # Per file: ids rise with position; files are ranges of ids in name order.
    per = back.groupBy("f").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    # One row per file: a small window tells where the files before end.
    top = F.max("hi").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    good = F.when(F.coalesce(F.col("top"), F.lit(-1)) < F.col("lo"), F.col("n")).otherwise(0)
    return per.withColumn("top", top).agg(F.sum("n").alias("records"), F.sum("c").alias("chars"), F.sum(good).alias("in_order"))


@query("a11_write_letters", "loan cust", letter_check().replace("SELECT queue_no AS action_id, n AS line_no, RPAD", "SELECT RPAD"))
def _(s):
    path = scratch_path(s.spark, "letters")
    letters = recovery.dunning_letters(recovery.recovery_actions(master(s), TODAY), s("cust"), LETTERHEAD, "Tunis", TODAY)
    reports.write_lines(letters, path, ("action_id", "line_no"))
    return s.spark.read.text(path)


CLASS_TEXT = {"1": "CLASSE 1 (COURANTS) ", "2": "CLASSE 2 (30-90J)   ", "3": "CLASSE 3 (90-180J)  ", "4": "CLASSE 4 (>180J)    "}


def _risk_summary() -> str:
    one = ", ".join(f"COUNT(*) FILTER (loan_class = '{k}') AS n{k}, COALESCE(SUM(outstanding_cents) FILTER (loan_class = '{k}'), 0) AS o{k}, COALESCE(SUM(provision_cents) FILTER (loan_class = '{k}'), 0) AS p{k}" for k in "1234")
    rows = [f"CONCAT('{CLASS_TEXT[k]}: CNT=', {z('n' + k, 6)}, ' ENC=', {z('o' + k, 15)}, ' PROV=', {z('p' + k, 13)})" for k in "1234"]
    lines = [header("1"), sub_header("RAPPORT CLASSIFICATION CREANCES BCT"), RULE, RULE, *rows, f"CONCAT('TOTAL PROVISIONS    : ', {z('pp', 15)})", FOOT]
    return cl_sql() + f", o AS (SELECT {one}, COALESCE(SUM(provision_cents), 0) AS pp FROM cl) " + fixed_lines(0, lines, "FROM o")


@query("a13_risk_summary_lines", "loan", _risk_summary())
def _(s):
    return reports.risk_summary_lines(risk.class_totals(risk.classify(s("loan"))), BANK, PROGRAM, TODAY)


def _escalation() -> str:
    n = lambda a: f"LPAD(CAST(COUNT(*) FILTER (action_type = '{a}') AS STRING), 6, '0')"
    line = f"RPAD(CONCAT({z('loan_id', 10)}, '  ', {z('cust_id', 8)}, '  CL:', loan_class, '  DPD:', {z('dpd', 4)}, '  AMT:', {z('claim_cents // 100', 13)}, '  ACT:', action_type), 137, ' ')"
    cls = [f"CONCAT('  {CLASS_TEXT[k]}: ', LPAD(CAST(COUNT(*) FILTER (loan_class = '{k}') AS STRING), 6, '0'), ' LOANS  ENC: ', LPAD(CAST(COALESCE(SUM(outstanding_cents) FILTER (loan_class = '{k}'), 0) AS STRING), 15, '0'))" for k in "234"]
    act = [f"CONCAT('  SMS    : ', {n('SMS')}, '  EMAIL: ', {n('EML')}, '  TEL  : ', {n('PHN')}, '  DUL  : ', {n('DUL')})",
           f"CONCAT('  LEG    : ', {n('LEG')}, '  GTR  : ', {n('GTR')}, '  RST  : ', {n('RST')}, '  CRT  : ', {n('CRT')})", f"CONCAT('  CSZ    : ', {n('CSZ')}, '  WOF  : ', {n('WOF')})"]
    return rec_sql() + fixed_lines(0, [header("1"), sub_header("RAPPORT ESCALADE RECOUVREMENT"), RULE]) + f" UNION ALL SELECT 1, queue_no, 0, {line} FROM q UNION ALL " + fixed_lines(
        2, [f"MIN({RULE})", "MIN('RESUME PAR CLASSE')", *cls], "FROM q") + " UNION ALL " + fixed_lines(3, [f"MIN({RULE})", "MIN('ACTIONS GENEREES')", *act, f"MIN({FOOT})"], "FROM q")


@query("a13_escalation_lines", "loan", _escalation())
def _(s):
    m = master(s)
    acts = recovery.recovery_actions(m, TODAY)
    return reports.escalation_lines(acts, recovery.recovery_totals(m), recovery.action_totals(m), BANK, PROGRAM, TODAY)


AMT = "LPAD(CONCAT(FORMAT('{{:,}}', CAST({c} // 100 // 1000 AS BIGINT)), ',', LPAD(CAST({c} // 100 % 1000 AS STRING), 3, '0')), 15, ' ')"
CNT = "LPAD(FORMAT('{:,}', loans), 7, ' ')"


def pct(c: str) -> str:
    return f"CONCAT(LPAD(CAST({c} // 100 AS STRING), 3, ' '), ',', LPAD(CAST({c} % 100 AS STRING), 2, '0'), '%')"


def _month() -> str:
    def title(k: int, text: str) -> str:
        return " UNION ALL ".join(f"SELECT {k}, CAST(-1 AS BIGINT), {i}, RPAD({e}, 137, ' ')" for i, e in enumerate(["''", f"'{text}'", RULE]))

    o = AMT.format(c="outstanding_cents")
    sec = SECTIONS_SQL[5:]
    pieces = [
        fixed_lines(0, [header("1"), sub_header("RAPPORT MENSUEL CREDIT - DIRECTION GENERALE"), RULE, "''", "'   CREDIT BANK - DIRECTION DU CREDIT'", f"'   PERIODE: {TODAY}'", "'   CONFIDENTIEL - USAGE INTERNE'", RULE]),
        title(1, "SECTION 1 - REPARTITION DU PORTEFEUILLE PAR CLASSE"),
        f"SELECT 1, CAST(code AS BIGINT), 0, RPAD(CONCAT('  CLASSE ', code, '   COUNT=', {CNT}, '   ENC=', {o}), 137, ' ') FROM se WHERE section = 'class'",
        f"SELECT 1, 100, 0, RPAD(CONCAT('  TOTAL ENCOURS         : ', {o}), 137, ' ') FROM tt",
        f"SELECT 1, 100, 1, RPAD(CONCAT('  TOTAL PROVISIONS     : ', {AMT.format(c='provision_cents')}, '   TAUX PROV: ', {pct('(provision_pct_e2 // 100)')}), 137, ' ') FROM tt",
        "SELECT 1, 100, 2, RPAD(CONCAT('  TAUX MOYEN PONDERE   : ', LPAD(CONCAT('0,', LPAD(CAST(avg_rate_e4 // 10000 AS STRING), 4, '0')), 7, ' '), '%'), 137, ' ') FROM tt",
        title(2, "SECTION 2 - TOP 10 EXPOSITIONS"),
        f"SELECT 2, n - 1, 0, RPAD(CONCAT('  #', CAST(n % 10 AS STRING), '  ', {z('loan_id', 10)}, '  ', RPAD(cust_name, 40, ' '), '  CL:', loan_class, '  ', loan_type, '  ENC:', {o}), 137, ' ') FROM tn",
        title(3, "SECTION 3 - REPARTITION PAR SEGMENT CLIENT"),
        f"SELECT 3, LIST_POSITION(['MM','MB','PR','PB'], code), 0, RPAD(CONCAT('  SEGMENT ', code, '   CNT=', {CNT}, '   ENC=', {o}), 137, ' ') FROM se WHERE section = 'segment' AND code <> ''",
        title(4, "SECTION 4 - VENTILATION PAR TYPE DE CREDIT"),
        f"SELECT 4, LIST_POSITION(['CON','IMM','AUT','PRO','REV','DEC'], code), 0, RPAD(CONCAT('  ', code, ' ', RPAD(CASE code WHEN 'CON' THEN 'CONSOMMATION' WHEN 'IMM' THEN 'IMMOBILIER' WHEN 'AUT' THEN 'AUTOMOBILE' WHEN 'PRO' THEN 'PROFESSIONNEL' WHEN 'REV' THEN 'REVOLVING' ELSE 'DECOUVERT' END, 20, ' '), '  CNT=', {CNT}, '  AMT=', {o}), 137, ' ') FROM se WHERE section = 'type'",
        title(5, "SECTION 5 - INDICATEURS DE RISQUE"),
        fixed_lines(5, [f"CONCAT('{t}', {pct(f'(({c} + 50) // 100)')})" for t, c in (("  RATIO NPL (CL 2-3-4) : ", "npl"), ("  RATIO PERTES (CL 4)  : ", "loss"), ("  TAUX COUVERTURE PROV : ", "cov"))], "FROM rr"),
        fixed_lines(6, ["''", RULE, "'  FIN DU RAPPORT - GENERE PAR BATCH v2.3'", FOOT]),
    ]
    rr = f"""rt AS (SELECT SUM(outstanding_cents) AS t, SUM(CASE WHEN rc <> '1' THEN outstanding_cents ELSE 0 END) AS n, SUM(CASE WHEN rc = '4' THEN outstanding_cents ELSE 0 END) AS l, SUM(provision_cents) AS p FROM pf),
 rr AS (SELECT {half_up('n', 't', 4)} AS npl, {half_up('l', 't', 4)} AS loss, {half_up('p', 't', 4)} AS cov FROM rt)"""
    first = sec.index("SELECT 'class' AS section")
    top = TOP_SQL[len(MASTER_SQL):]
    return (
        "WITH " + sec[:first].rstrip() + f", se AS ({sec[first:]}), tt AS ({TOTALS_SQL}), tp AS ({top}), tn AS (SELECT *, ROW_NUMBER() OVER (ORDER BY outstanding_cents DESC, loan_id) AS n FROM tp), {rr} "
        + " UNION ALL ".join(pieces)
    )


@query("a12_write_report", "loan cust", _month())
def _(s):
    m, c = master(s), s("cust")
    return reports.month_report(
        report.portfolio_by_class(m), report.portfolio_totals(m), report.top_exposures(m, c), report.portfolio_by_segment(m, c),
        report.portfolio_by_type(m), report.risk_ratios(m), BANK, PROGRAM, TODAY,
    )


@query("g1_report_sections", "loan cust", f"SELECT section, COUNT(*) AS lines FROM ({'{}'}) GROUP BY section".format(_month()))
def _(s):
    m, c = master(s), s("cust")
    lines = reports.month_report(
        report.portfolio_by_class(m), report.portfolio_totals(m), report.top_exposures(m, c), report.portfolio_by_segment(m, c),
        report.portfolio_by_type(m), report.risk_ratios(m), BANK, PROGRAM, TODAY,
    )
    return lines.groupBy("section").agg(F.count("*").alias("lines"))


@query("a16_append_risk_history", "loan", cl_sql() + f"SELECT COUNT(*) * 2 AS history_rows, COUNT(DISTINCT loan_id) AS loans, {big('SUM(provision_cents) * 2')} AS provision_cents FROM cl")
def _(s):
    path = scratch_path(s.spark, "riskhist")
    c = cut(risk.classify(s("loan")))
    for day in (TODAY - 100, TODAY):
        risk.append_risk_history(c, day, path)
    back = s.spark.read.parquet(path)
    return back.agg(F.count("*").alias("history_rows"), F.count_distinct("loan_id").alias("loans"), F.sum("provision_cents").alias("provision_cents"))


@query("a16_publish_risk_history", "loan", cl_sql() + f"SELECT COUNT(*) * 2 AS history_rows, COUNT(DISTINCT loan_id) AS loans, {big('SUM(provision_cents) * 2')} AS provision_cents FROM cl")
def _(s):
    path = scratch_path(s.spark, "riskruns")
    c = cut(risk.classify(s("loan")))
    for day in (TODAY - 100, TODAY, TODAY):  # the last one repeats a run
        risk.publish_risk_history(c, day, path, f"run-{day}")
    back = risk.read_risk_history(s.spark, path)
    return back.agg(F.count("*").alias("history_rows"), F.count_distinct("loan_id").alias("loans"), F.sum("provision_cents").alias("provision_cents"))


@query("a19_file_manifest", "loan", f"SELECT {big('COUNT(*) * 239')} AS size_bytes, {big('COUNT(*)')} AS record_count FROM loan")
def _(s):
    path = scratch_path(s.spark, "manifest")
    fixed.write_fixed(s("loan").repartition(3, "loan_id"), layouts.LOAN, path)
    m = fixed.file_manifest(s.spark, path, 239)
    return m.agg(F.sum("size_bytes").alias("size_bytes"), F.sum("record_count").alias("record_count"))


def _drawn(k: str, salt: int) -> str:
    return f"((({k} * 48271 + {salt * 7919 + 12345}) % 2147483647 * 69621 + {salt * 104729 + 1}) % 2147483647)"


def _weighted(k: str, salt: int, weights) -> str:
    out, edge = "CASE", 0
    for code, w in weights:
        edge += w
        out += f" WHEN {_drawn(k, salt)} % 100 < {edge} THEN '{code}'"
    return out + " END"


@query("a17_make_portfolio", sql=f"""WITH o AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, {_weighted('k', 21, portfolio.LOAN_TYPE_WEIGHTS)} AS loan_type, {_weighted('k', 22, portfolio.LOAN_STATUS)} AS status FROM o),
 b AS (SELECT *, CASE loan_type """ + " ".join(f"WHEN '{c}' THEN {lo} + {_drawn('k', 24)} % {hi - lo + 1}" for c, (lo, hi) in portfolio.AMOUNT_CENTS.items()) + f""" END AS original_cents,
  CASE WHEN status = 'AC' THEN CASE WHEN {_drawn('k', 28)} % 100 < 85 THEN 0 ELSE 1 + {_drawn('k', 29)} % 30 END WHEN status = 'RS' THEN {_drawn('k', 29)} % 31 WHEN status = 'LT' THEN 91 + {_drawn('k', 29)} % 275 ELSE 180 + {_drawn('k', 29)} % 541 END AS dpd,
  {_drawn('k', 25)} % 71 AS paid FROM a)
 SELECT 1000000001 + k AS loan_id, 10000001 + {_drawn('k', 23)} % 500 AS cust_id, loan_type, status, original_cents, CASE WHEN status = 'WO' THEN 0 ELSE original_cents * (100 - paid) // 100 END AS outstanding_cents, dpd FROM b""")
def _(s):
    ids = s.table("orders").select(F.col("o_orderkey").alias("id"))
    return portfolio.loans(ids, 500).select("loan_id", "cust_id", "loan_type", "status", "original_cents", "outstanding_cents", "dpd")


# --- streams -----------------------------------------------------------------

def event_stream(s):
    """The events file as a stream of transactions."""
    schema = s.table("events").schema
    raw = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    cols = VIEWS["txn"][2]
    return raw.selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


@query("m1_post_transactions_stream", "txn ledger", f"SELECT t.cust_id, {big('SUM(amount_cents)')} AS delta_cents, COUNT(*) AS txns FROM txn t SEMI JOIN ledger l ON l.cust_id = t.cust_id GROUP BY t.cust_id")
def _(s):
    return jobs.run_update(jobs.post_transactions_stream(event_stream(s), s("ledger")), ["cust_id"], scratch_path(s.spark, "post"))


@query("m1_failed_transactions_stream", "txn ledger", "SELECT t.txn_id, t.cust_id, t.amount_cents FROM txn t ANTI JOIN ledger l ON l.cust_id = t.cust_id")
def _(s):
    out = jobs.run_append(jobs.failed_transactions_stream(event_stream(s), s("ledger")), scratch_path(s.spark, "failed"))
    return out.select("txn_id", "cust_id", "amount_cents")


@query("m2_aml_screen_stream", "txn cust sanction", f"""WITH {aml_ctes("SELECT t.txn_id, CONCAT(c.first_name, ' ', c.last_name) AS name, c.cin, c.nationality, ABS(t.amount_cents) * 100 AS amount_cents FROM txn t LEFT JOIN cust c ON c.cust_id = t.cust_id")}
 SELECT txn_id, aml_clear, {big('aml_score')} AS aml_score, aml_reason FROM hits""")
def _(s):
    who = s("cust").select("cust_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "cin", "nationality")
    req = event_stream(s).select("txn_id", "cust_id", (F.abs("amount_cents") * 100).alias("amount_cents")).join(who, "cust_id", "left")
    out = jobs.run_append(jobs.aml_screen_stream(req, s("sanction")), scratch_path(s.spark, "screen"))
    return out.select("txn_id", "aml_clear", "aml_score", "aml_reason")


@query("m3_dedupe_submissions", sql="SELECT DISTINCT SUBSTR(SHA256(text), 1, 16) AS source_hash FROM documents")
def _(s):
    schema = s.table("documents").schema
    # The table may be one file or a folder of files; as a pattern, the path may be either.
    raw = s.spark.readStream.schema(schema).parquet(f"{s.sf_dir.rstrip('/')}/documents.parque[t]")
    subs = raw.select(F.col("text").alias("content"), F.timestamp_seconds(F.col("doc_id") % 60 + 1_700_000_000).alias("ts"))
    out = jobs.run_append(jobs.dedupe_submissions(subs).select("source_hash"), scratch_path(s.spark, "dedupe"))
    return out.select("source_hash")
