"""Registered queries: line, record, metric and document reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.registry import big, query
from creditloom.functions import text as tx
from creditloom.operators import alignment, matching, ordered
from creditloom.plans import recon
from creditloom.session import cut
from creditloom.sources import layouts

LINES = "base_line new_line"
# A number as the checking engine can say it (no look-around there; the test
# lines hold blanks around every number).
N_SQL = r"-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?%?"

D_SQL = r"\b20[0-9]{6}(?:-[0-9]{6})?\b"


def undated(c: str) -> str:
    return f"REGEXP_REPLACE({c}, '{D_SQL}', '__DATE__', 'g')"


def nums(c: str) -> str:
    return f"LIST_TRANSFORM(REGEXP_EXTRACT_ALL({undated(c)}, '{N_SQL}'), lambda x: CAST(REPLACE(REPLACE(x, ',', ''), '%', '') AS DOUBLE))"


PAIR_SQL = """WITH pa AS (SELECT COALESCE(b.file, a.file) AS file, COALESCE(b.line_no, a.line_no) AS line_no, COALESCE(b.text, '') AS baseline, COALESCE(a.text, '') AS actual,
  b.text IS NOT NULL AS in_baseline, a.text IS NOT NULL AS in_actual FROM base_line b FULL JOIN new_line a ON a.file = b.file AND a.line_no = b.line_no)
"""
EXACT_SQL = PAIR_SQL + ", ex AS (SELECT *, TRIM(baseline) = TRIM(actual) AS matched FROM pa)\n"
TOL_SQL = PAIR_SQL + f""", t0 AS (SELECT *, {nums('baseline')} AS bn, {nums('actual')} AS an FROM pa),
 t1 AS (SELECT *, CASE WHEN TRIM(baseline) = TRIM(actual) THEN 'exact' WHEN TRIM({undated('baseline')}) = TRIM({undated('actual')}) THEN 'date' WHEN LEN(bn) = 0 AND LEN(an) = 0 THEN 'text differs' WHEN LEN(bn) <> LEN(an) THEN 'number count differs'
  WHEN LIST_BOOL_AND(LIST_TRANSFORM(RANGE(1, LEN(bn) + 1), lambda i: bn[i] = an[i] OR ABS(bn[i] - an[i]) <= 0.001 * GREATEST(ABS(bn[i]), ABS(an[i]), 1e-9))) IS NOT TRUE THEN 'numeric mismatch'
  WHEN TRIM(REGEXP_REPLACE({undated('baseline')}, '{N_SQL}', '__NUM__', 'g')) <> TRIM(REGEXP_REPLACE({undated('actual')}, '{N_SQL}', '__NUM__', 'g')) THEN 'text skeleton differs' ELSE 'tolerant' END AS kind FROM t0),
 tol AS (SELECT *, kind IN ('exact', 'date', 'tolerant') AS matched FROM t1)
"""


def stats_sql(src: str) -> str:
    return f"""SELECT file, COUNT(*) AS lines_compared, COUNT(*) FILTER (matched) AS lines_matched, COUNT(*) FILTER (NOT matched) AS lines_diverged,
 MIN(line_no) FILTER (NOT matched) - 1 AS first_mismatch, (20000 * COUNT(*) FILTER (NOT matched) + COUNT(*)) // (2 * COUNT(*)) AS diff_pct_e2 FROM {src} GROUP BY file"""


def pairs(s):
    return recon.pair_lines(*s("base_line", "new_line"))


@query("c13_pair_lines", LINES, PAIR_SQL + "SELECT * FROM pa")
def _(s):
    return pairs(s)


@query("j1_diff_lines_exact", LINES, EXACT_SQL + stats_sql("ex"))
def _(s):
    return recon.diff_stats(recon.compare_exact(pairs(s)))


# Lines of both sides with blanks added: normalizing first brings the rest back in step.
BLANKS_SQL = """WITH nb AS (SELECT file, CASE WHEN line_no % 7 = 2 THEN line_no * 4 END AS extra, line_no * 4 + 1 AS line_no, CONCAT(text, '  ') AS text FROM new_line),
 ab AS (SELECT file, line_no, text FROM nb UNION ALL SELECT file, extra, '   ' FROM nb WHERE extra IS NOT NULL UNION ALL SELECT file, extra - 1, '' FROM nb WHERE extra IS NOT NULL),
 cl AS (SELECT file, line_no, RTRIM(text) AS text, 'a' AS side FROM ab UNION ALL SELECT file, line_no, RTRIM(text), 'b' FROM base_line),
 pv AS (SELECT *, LAG(text) OVER (PARTITION BY side, file ORDER BY line_no) AS before, MAX(CASE WHEN text <> '' THEN line_no END) OVER (PARTITION BY side, file) AS last FROM cl),
 nu AS (SELECT side, file, text, ROW_NUMBER() OVER (PARTITION BY side, file ORDER BY line_no) AS n FROM pv WHERE NOT (text = '' AND COALESCE(before, '') = '') AND line_no <= last),
 ex AS (SELECT COALESCE(b.file, a.file) AS file, COALESCE(b.n, a.n) AS line_no, TRIM(COALESCE(b.text, '')) = TRIM(COALESCE(a.text, '')) AS matched FROM (FROM nu WHERE side = 'b') b FULL JOIN (FROM nu WHERE side = 'a') a ON a.file = b.file AND a.n = b.n)
"""


@query("j1_compare_outputs", LINES, BLANKS_SQL + stats_sql("ex"))
def _(s):
    base, new = s("base_line", "new_line")
    grown = new.selectExpr("file", "explode(CASE WHEN line_no % 7 = 2 THEN array(struct(line_no * 4 - 1 AS n, '' AS t), struct(line_no * 4 AS n, '   ' AS t), struct(line_no * 4 + 1 AS n, concat(text, '  ') AS t)) ELSE array(struct(line_no * 4 + 1 AS n, concat(text, '  ') AS t)) END) AS x")
    return recon.compare_outputs(base, grown.selectExpr("file", "x.n AS line_no", "x.t AS text"))


@query("d16_diff_stats", LINES, TOL_SQL + stats_sql("tol"))
def _(s):
    return recon.diff_stats(recon.compare_tolerant(pairs(s)))


@query("j2_diff_lines_tolerant", LINES, TOL_SQL + "SELECT file, line_no, kind, matched FROM tol")
def _(s):
    return recon.compare_tolerant(pairs(s)).select("file", "line_no", "kind", "matched")


def near(pct: str) -> str:
    """Numbers within tolerance, or lines equal but for dates."""
    return f"""(TRIM(baseline) = TRIM(actual) OR TRIM({undated('baseline')}) = TRIM({undated('actual')}) OR (LEN(bn) > 0 AND LEN(bn) = LEN(an)
    AND LIST_BOOL_AND(LIST_TRANSFORM(RANGE(1, LEN(bn) + 1), lambda i: bn[i] = an[i] OR ABS(bn[i] - an[i]) <= {pct} * GREATEST(ABS(bn[i]), ABS(an[i]), 1e-9)))))"""


RULES_SQL = TOL_SQL + f""", ru AS (SELECT *, CASE WHEN CONTAINS(LOWER(baseline), 'row 1') OR CONTAINS(LOWER(actual), 'row 1') THEN 'ignored'
  WHEN CONTAINS(LOWER(baseline), 'row 2') OR CONTAINS(LOWER(actual), 'row 2') THEN CASE WHEN TRIM(baseline) = TRIM(actual) THEN 'exact' ELSE 'exact mismatch' END
  WHEN CONTAINS(LOWER(baseline), 'row 3') OR CONTAINS(LOWER(actual), 'row 3') THEN CASE WHEN {near('0.5')} THEN 'tolerant' ELSE 'outside tolerance' END
  WHEN {near('0.001')} THEN 'default' ELSE 'default tolerance failed' END AS rkind FROM tol)
"""


@query("j3_diff_lines_rules", LINES, RULES_SQL + "SELECT file, line_no, rkind AS kind, rkind IN ('ignored', 'exact', 'tolerant', 'default') AS matched FROM ru")
def _(s):
    return recon.compare_by_rules(pairs(s), exact=["ROW 2"], tolerant={"ROW 3": 0.5}, ignore=["Row 1"]).select("file", "line_no", "kind", "matched")


@query("j3_diff_lines_rule_table", LINES, RULES_SQL + "SELECT file, line_no, rkind AS kind, rkind IN ('ignored', 'exact', 'tolerant', 'default') AS matched FROM ru")
def _(s):
    both = pairs(s)
    rules = recon.field_rules(both.sparkSession, exact=["ROW 2"], tolerant={"ROW 3": 0.5}, ignore=["Row 1"])
    return recon.compare_by_table(both, rules).select("file", "line_no", "kind", "matched")


@query("j3_line_count_rule", LINES, PAIR_SQL + "SELECT file, COUNT(*) FILTER (in_baseline) AS baseline_lines, COUNT(*) FILTER (in_actual) AS actual_lines, COUNT(*) FILTER (in_baseline) = COUNT(*) FILTER (in_actual) AS same_count FROM pa GROUP BY file")
def _(s):
    return recon.line_count_rule(pairs(s))


# Output lines of the jobs, derived from orders.
JOB_LINES = {
    0: "CONCAT('  READ        : ', LPAD(CAST(line_no AS STRING), 8, '0'))",
    1: "CONCAT('  CLASS ', CAST(line_no % 4 + 1 AS STRING), ': ', LPAD(CAST(line_no AS STRING), 6, '0'))",
    2: "CONCAT('  TOTAL PROV: ', LPAD(CAST(line_no * 1000 AS STRING), 15, '0'))",
    3: "CONCAT('MONTHLY COMPLETED. LOANS=', LPAD(CAST(line_no AS STRING), 8, '0'), ' AMT=', LPAD(CAST(line_no * 7 AS STRING), 17, '0'))",
    4: "CONCAT('  CLASS ', CAST(line_no % 3 + 2 AS STRING), ' LOANS: ', LPAD(CAST(line_no AS STRING), 6, '0'), ' AMOUNT: ', CAST(line_no * 3 AS STRING))",
}
JOB_TEXT = "CASE line_no % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in JOB_LINES.items()) + " END"


def job_lines(s):
    return s("base_line").selectExpr("file", "line_no", f"{JOB_TEXT} AS text")


@query("j4_program_rules", "base_line", f"""SELECT line_no, CASE WHEN REGEXP_MATCHES(text, '(?i)CLASS\\s+[1-4]\\s*:') THEN 0.0 WHEN REGEXP_MATCHES(text, '(?i)TOTAL\\s+PROV') THEN 0.0001 ELSE 0.001 END::DOUBLE AS tolerance
 FROM (SELECT line_no, {JOB_TEXT} AS text FROM base_line)""")
def _(s):
    lines = job_lines(s).withColumn("job", F.lit("classification"))
    return recon.tolerances(lines, recon.program_rules(lines.sparkSession)).select("line_no", "tolerance")


@query("j5_summary_line_match", "base_line", f"""SELECT line_no, CASE line_no % 5 WHEN 3 THEN line_no % 2 = 0 WHEN 4 THEN line_no % 2 = 0 ELSE FALSE END AS matched FROM base_line""")
def _(s):
    other = job_lines(s).select("file", "line_no", F.when(F.col("line_no") % 2 == 0, F.regexp_replace("text", r"(AMT=|AMOUNT: )\d+", "$1" + "1")).otherwise(F.replace("text", F.lit(": "), F.lit(": 1"))).alias("t2"))
    other = other.withColumn("t2", F.when(F.col("line_no") % 2 == 1, F.replace("t2", F.lit("LOANS="), F.lit("LOANS=1"))).otherwise(F.col("t2")))
    j = job_lines(s).join(other, ["file", "line_no"])
    return j.select("line_no", recon.summary_line_match(F.col("text"), F.col("t2")).alias("matched"))


METRIC_SQL = f"""SELECT file, metric, CAST(ARG_MIN(v, line_no) AS BIGINT) AS value FROM (
 SELECT file, line_no, 'read_count' AS metric, NULLIF(REGEXP_EXTRACT(text, '(?i)READ\\s*:\\s*(\\d+)', 1), '') AS v FROM (SELECT file, line_no, {JOB_TEXT} AS text FROM base_line)) WHERE v IS NOT NULL GROUP BY file, metric"""


@query("d18_key_metrics", "base_line", f"""WITH t AS (SELECT file, line_no, {JOB_TEXT} AS text FROM base_line), m AS (
 """ + " UNION ALL ".join(f"SELECT file, line_no, 'CLASS_{k}_count' AS metric, NULLIF(REGEXP_EXTRACT(text, '(?i)CLASS\\s+{k}\\s*:\\s*(\\d+)', 1), '') AS v FROM t" for k in (1, 2, 3, 4))
       + """ UNION ALL SELECT file, line_no, 'TOTAL_PROVISION', NULLIF(REGEXP_EXTRACT(text, '(?i)TOTAL\\s+PROV\\s*:\\s*(\\d+)', 1), '') FROM t)
 SELECT file, metric, CAST(ARG_MIN(v, line_no) AS BIGINT) AS value FROM m WHERE v IS NOT NULL GROUP BY file, metric""")
def _(s):
    return recon.key_metrics(job_lines(s), "classification")


@query("j10_diff_metrics", "base_line", f"""WITH v AS ({METRIC_SQL}), e AS (SELECT file, 'read_count' AS metric, MIN(line_no) FILTER (line_no % 5 = 0) AS expected FROM base_line GROUP BY file UNION ALL SELECT DISTINCT file, 'absent', 1 FROM base_line)
 SELECT e.file, e.metric, e.expected, v.value AS actual, COALESCE(e.expected = v.value, FALSE) AS matched FROM e LEFT JOIN v ON v.file = e.file AND v.metric = e.metric""")
def _(s):
    b = s("base_line")
    e = b.groupBy("file").agg(F.min(F.when(F.col("line_no") % 5 == 0, F.col("line_no"))).alias("value")).select("file", F.lit("read_count").alias("metric"), "value")
    e = e.unionByName(b.select("file").distinct().select("file", F.lit("absent").alias("metric"), F.lit(1).cast("bigint").alias("value")))
    return recon.diff_metrics(e, recon.key_metrics(job_lines(s), "evaluation"))


@query("f5_mismatch_highlights", LINES, EXACT_SQL + "SELECT file, line_no, baseline, actual FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM ex WHERE NOT matched) WHERE rn <= 5")
def _(s):
    return recon.mismatch_highlights(recon.compare_exact(pairs(s)), 5).select("file", "line_no", "baseline", "actual")


@query("g4_line_multiset_diff", LINES, f"""WITH u AS (SELECT file, RTRIM(text) AS text, 1 AS s FROM base_line UNION ALL SELECT file, RTRIM(text), -1 FROM new_line)
 SELECT file, text, CASE WHEN SUM(s) > 0 THEN '-' ELSE '+' END AS side, {big('ABS(SUM(s))')} AS copies FROM u WHERE text <> '' GROUP BY file, text HAVING SUM(s) <> 0""")
def _(s):
    return recon.line_multiset_diff(*s("base_line", "new_line"))


# The second side repeats the lines of every third file in reverse order.
SHUFFLE_SQL = """WITH mx AS (SELECT file, MAX(line_no) AS m FROM base_line GROUP BY file), sh AS (SELECT b.file, CASE WHEN CAST(SUBSTR(b.file, 2) AS BIGINT) % 3 = 0 THEN mx.m - b.line_no + 1 ELSE b.line_no END AS line_no,
  CASE WHEN CAST(SUBSTR(b.file, 2) AS BIGINT) % 5 = 0 AND b.line_no = mx.m THEN 'CHANGED' ELSE b.text END AS text FROM base_line b JOIN mx ON mx.file = b.file)
"""


def shuffled(s):
    b = s("base_line")
    mx = b.groupBy("file").agg(F.max("line_no").alias("m"))
    n = F.expr("CAST(substring(file, 2) AS BIGINT)")
    j = b.join(mx, "file")
    return j.select(
        "file", F.when(n % 3 == 0, F.col("m") - F.col("line_no") + 1).otherwise(F.col("line_no")).alias("line_no"),
        F.when((n % 5 == 0) & (F.col("line_no") == F.col("m")), "CHANGED").otherwise(F.col("text")).alias("text"),
    )


@query("g5_same_lines_other_order", "base_line", SHUFFLE_SQL + """, x AS (SELECT b.file, LIST(b.text ORDER BY b.line_no) AS bl, LIST(b.text ORDER BY b.text) AS bs FROM base_line b GROUP BY b.file),
 y AS (SELECT file, LIST(text ORDER BY line_no) AS al, LIST(text ORDER BY text) AS ars FROM sh GROUP BY file)
 SELECT x.file, bs = ars AS same_bag, bl = al AS same_sequence, bs = ars AND bl <> al AS order_mismatch FROM x JOIN y ON y.file = x.file""")
def _(s):
    return recon.same_lines_other_order(s("base_line"), shuffled(s))


@query("j12_failure_kind", LINES, EXACT_SQL + """, f AS (SELECT file, MIN(line_no) FILTER (NOT matched) AS n, COUNT(*) FILTER (in_baseline) AS nb, COUNT(*) FILTER (in_actual) AS na FROM ex GROUP BY file),
 g AS (SELECT f.*, TRIM(ex.baseline) AS b, TRIM(ex.actual) AS a FROM f JOIN ex ON ex.file = f.file AND ex.line_no = f.n)
 SELECT file, CASE WHEN b <> '' AND a = '' THEN CASE WHEN na < nb THEN 'missing_new_line' ELSE 'content_mismatch' END WHEN a <> '' AND b = '' THEN CASE WHEN na > nb THEN 'extra_new_line' ELSE 'missing_old_line' END
  WHEN na > nb THEN 'extra_new_line' WHEN na < nb THEN 'extra_old_line' ELSE 'content_mismatch' END AS failure_kind FROM g""")
def _(s):
    b, n = s("base_line", "new_line")
    return recon.failure_kind(recon.compare_exact(recon.pair_lines(b, n)), recon.same_lines_other_order(b, n))


@query("j6_diff_records", LINES, PAIR_SQL + "SELECT file, line_no, RTRIM(baseline) = RTRIM(actual) AS matched FROM pa")
def _(s):
    return recon.diff_records(*s("base_line", "new_line")).select("file", "line_no", "matched")


MASKED = PAIR_SQL + ", mk AS (SELECT *, in_baseline AND in_actual AND SUBSTR(baseline, 5) = SUBSTR(actual, 5) AND LENGTH(baseline) = LENGTH(actual) AS matched FROM pa)\n"


@query("j7_diff_records_masked", LINES, PAIR_SQL + """, mk AS (SELECT *, in_baseline AND in_actual AND CONCAT(REPEAT('#', LEAST(4, LENGTH(baseline))), SUBSTR(baseline, 5)) = CONCAT(REPEAT('#', LEAST(4, LENGTH(actual))), SUBSTR(actual, 5)) AS matched FROM pa)
 SELECT file, line_no, matched FROM mk""")
def _(s):
    return recon.diff_records_masked(*s("base_line", "new_line"), ranges=[(0, 4)]).select("file", "line_no", "matched")


@query("j7_record_count_rule", LINES, PAIR_SQL + """, mk AS (SELECT *, in_baseline AND in_actual AND SUBSTR(baseline, 5) = SUBSTR(actual, 5) AS matched FROM pa)
 SELECT file, COUNT(*) FILTER (in_baseline) AS expected_records, COUNT(*) FILTER (in_actual) AS actual_records, COUNT(*) FILTER (NOT matched) AS different_records,
 COUNT(*) FILTER (in_baseline) = COUNT(*) FILTER (in_actual) AND COUNT(*) FILTER (NOT matched) = 0 AS matched FROM mk GROUP BY file""")
def _(s):
    return recon.record_count_rule(recon.diff_records_masked(*s("base_line", "new_line"), ranges=[(0, 4)]))


FIELDS = ["cust_id", "loan_type", "status", "original_cents", "outstanding_cents", "payment_cents", "rate_e4", "dpd", "missed"]


@query("j8_diff_fields", "loan", "WITH n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (loan_id % 17 <> 0) AS k, COUNT(*) FILTER (loan_id % 17 <> 0 AND loan_id % 5 <> 0) AS d FROM loan) "
       + " UNION ALL ".join(f"SELECT '{f}' AS field, n AS rows_compared, {'d' if f == 'dpd' else 'k'} AS equal_rows FROM n" for f in FIELDS))
def _(s):
    a = s("loan")
    b = a.where(F.col("loan_id") % 17 != 0).withColumn("dpd", F.when(F.col("loan_id") % 5 == 0, F.col("dpd") + 1).otherwise(F.col("dpd")))
    cols = [f for f in recon.layout_fields(layouts.LOAN) if f in FIELDS]
    return recon.diff_fields(a, b, "loan_id", cols)


@query("j9_diff_directory", "run", """SELECT program, COUNT(*) AS total, COUNT(*) FILTER (run_id % 13 <> 0 AND run_id % 7 <> 0) AS matches, COUNT(*) FILTER (run_id % 13 <> 0 AND run_id % 7 = 0) AS mismatches, COUNT(*) FILTER (run_id % 13 = 0) AS missing FROM run GROUP BY program""")
def _(s):
    e = s("run").select("program", F.col("run_id").cast("string").alias("item"), F.md5(F.col("run_id").cast("string")).alias("digest"), "run_id")
    a = e.where(F.col("run_id") % 13 != 0).withColumn("digest", F.when(F.col("run_id") % 7 == 0, F.lit("x")).otherwise(F.col("digest")))
    return recon.diff_directory(e.drop("run_id"), a.drop("run_id"))


@query("j14_run_status", "run", """SELECT run_id, CASE WHEN lines_compared <= 0 THEN 'not_run' WHEN lines_diverged = 0 THEN 'passed' WHEN lines_matched > 0 THEN 'partial' ELSE 'failed' END AS result FROM run""")
def _(s):
    return s("run").select("run_id", recon.run_status(F.col("lines_compared"), F.col("lines_matched"), F.col("lines_diverged")).alias("result"))


@query("d17_merge_status", "run", """WITH r AS (SELECT program, CASE WHEN run_id % 9 = 0 THEN 'skipped' ELSE status END AS st FROM run),
 a AS (SELECT program, COUNT(*) FILTER (st <> 'skipped') AS w, COUNT(*) FILTER (st = 'passed') AS p, COUNT(*) FILTER (st = 'partial') AS pa, COUNT(*) FILTER (st = 'failed') AS f, COUNT(*) FILTER (st = 'not_run') AS n FROM r GROUP BY program)
 SELECT program, w AS files, CASE WHEN w = 0 THEN 'failed' WHEN n = w THEN 'not_run' WHEN p = w THEN 'passed' WHEN f > 0 THEN 'failed' WHEN pa > 0 OR (p > 0 AND n > 0) THEN 'partial' ELSE 'failed' END AS status FROM a""")
def _(s):
    r = s("run").withColumn("status", F.when(F.col("run_id") % 9 == 0, "skipped").otherwise(F.col("status")))
    return recon.merge_status(r, "program")


@query("b13_ignore_lines", "base_line", "SELECT file, line_no FROM base_line WHERE NOT CONTAINS(LOWER(text), 'row 1') AND NOT REGEXP_MATCHES(text, '(?i)amount: [0-9]*7$')")
def _(s):
    return recon.ignore_lines(s("base_line"), ["Row 1"], [r"amount: \d*7$"]).select("file", "line_no")


@query("h13_extract_numbers", "base_line", f"SELECT line_no, LEN(n) AS numbers, n[2] AS second FROM (SELECT line_no, {nums('text')} AS n FROM base_line)")
def _(s):
    n = tx.extract_numbers(F.col("text"))
    return s("base_line").select("line_no", F.size(n).cast("bigint").alias("numbers"), F.get(n, 1).cast("double").alias("second"))


@query("h14_line_skeleton", "base_line", f"SELECT line_no, UPPER(REGEXP_REPLACE({undated('text')}, '{N_SQL}', '__NUM__', 'g')) || ' AT __DATE__ __VER__' AS skeleton FROM base_line")
def _(s):
    t = F.concat("text", F.lit(" at 20260525-471200 v2.3  "))
    return s("base_line").select("line_no", F.upper(tx.line_skeleton(t)).alias("skeleton"))


@query("h15_within_tolerance", LINES, TOL_SQL + ", w AS (SELECT file, line_no, LEN(bn) = LEN(an) AND COALESCE(LIST_BOOL_AND(LIST_TRANSFORM(RANGE(1, LEN(bn) + 1), lambda i: bn[i] = an[i] OR ABS(bn[i] - an[i]) <= 0.001 * GREATEST(ABS(bn[i]), ABS(an[i]), 1e-9))), TRUE) AS near FROM tol) SELECT * FROM w")
def _(s):
    p = recon.with_numbers(pairs(s))
    return p.select("file", "line_no", tx.within_tolerance(F.col("b_nums"), F.col("a_nums"), F.lit(0.001)).alias("near"))


@query("h16_source_hash", sql="SELECT doc_id, SUBSTR(SHA256(text), 1, 16) AS source_hash FROM documents")
def _(s):
    return s.table("documents").select("doc_id", tx.source_hash(F.col("text")).alias("source_hash"))


# Conversations as output lines: real texts with blank lines in them.
CONV_SQL = "SELECT CONCAT('C', CAST(conv_id AS STRING)) AS file, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, n) AS line_no, t AS text FROM (SELECT conv_id, turn, UNNEST(STRING_SPLIT(text || chr(10) || chr(10) || chr(10), chr(10))) AS t, UNNEST(RANGE(1, LEN(STRING_SPLIT(text || chr(10) || chr(10) || chr(10), chr(10))) + 1)) AS n FROM conversations)"


def conversation_lines(s):
    c = s.table("conversations").select("conv_id", "turn", F.posexplode(F.split(F.concat("text", F.lit("\n\n\n")), "\n")).alias("n", "text"))
    k = c.select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("file"), (F.col("turn") * 2**24 + F.col("n")).alias("pos"), "text")
    return ordered.row_numbers(k, ["file"], "pos", "line_no").select("file", "line_no", "text")


@query("e8_collapse_blanks", sql=f"""WITH l AS ({CONV_SQL}), r AS (SELECT file, line_no, REGEXP_REPLACE(text, '[ \\t\\r\\n]+$', '') AS text FROM l),
 p AS (SELECT *, LAG(text) OVER (PARTITION BY file ORDER BY line_no) AS prev, MAX(CASE WHEN text <> '' THEN line_no END) OVER (PARTITION BY file) AS last FROM r),
 k AS (SELECT * FROM p WHERE NOT (text = '' AND COALESCE(prev = '', TRUE)) AND line_no <= last)
 SELECT file, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_no) AS line_no, text FROM k""")
def _(s):
    return recon.collapse_blanks(conversation_lines(s))


DOC_E = """CONCAT('{"id": ', CAST(event_id AS STRING), ', "p": ', props, ', "tags": ["a", ', CAST(event_id % 3 AS STRING), '], "n": {"x": {"y": true}, "z": ', CAST(event_id % 7 AS STRING), '}}')"""
DOC_A = """CONCAT('{"id": ', CASE WHEN event_id % 4 = 0 THEN '"s"' ELSE CAST(event_id AS STRING) END, ', "p": ', CASE WHEN event_id % 5 = 0 THEN '{"q": 1}' ELSE props END, ', "tags": ["a"', CASE WHEN event_id % 3 = 0 THEN '' ELSE CONCAT(', ', CAST((event_id + event_id % 2) % 3 AS STRING)) END, '], "n": {"x": {"y": ', CASE WHEN event_id % 6 = 0 THEN 'false' ELSE 'true' END, '}, "z": ', CAST(event_id % 7 AS STRING), '}}')"""


@query("j11_diff_json", sql="""SELECT event_id AS doc_id, 'id' AS path, 'type' AS kind, 'int' AS expected, 'str' AS actual FROM events WHERE event_id % 4 = 0
 UNION ALL SELECT event_id, 'p.k', 'missing', NULL, NULL FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'p.q', 'extra', NULL, NULL FROM events WHERE event_id % 5 = 0
 UNION ALL SELECT event_id, 'tags', 'length', '2', '1' FROM events WHERE event_id % 3 = 0
 UNION ALL SELECT event_id, 'tags[1]', 'value', CAST(event_id % 3 AS STRING), CAST((event_id + event_id % 2) % 3 AS STRING) FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 1
 UNION ALL SELECT event_id, 'n.x.y', 'value', 'true', 'false' FROM events WHERE event_id % 6 = 0""")
def _(s):
    docs = s.table("events").selectExpr("event_id AS doc_id", f"{DOC_E} AS expected", f"{DOC_A} AS actual")
    return recon.diff_json(docs)


@query("h19_json_differences", sql="""SELECT kind, COUNT(*) AS findings FROM (SELECT 'type' AS kind FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'missing' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'extra' FROM events WHERE event_id % 5 = 0
 UNION ALL SELECT 'length' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'value' FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 1 UNION ALL SELECT 'value' FROM events WHERE event_id % 6 = 0) GROUP BY kind""")
def _(s):
    docs = s.table("events").selectExpr("event_id AS doc_id", f"{DOC_E} AS expected", f"{DOC_A} AS actual")
    return recon.diff_json(docs).groupBy("kind").agg(F.count("*").alias("findings"))


@query("c15_fuzzy_match", sql="""WITH n AS (SELECT DISTINCT CONCAT(CASE WHEN s_suppkey % 3 = 0 THEN 'Custmer#' ELSE 'Customer#' END, LPAD(CAST(s_suppkey * 11 AS STRING), 9, CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE 'x' END)) AS name FROM supplier),
 p AS (SELECT n.name, c.c_name, LEVENSHTEIN(n.name, c.c_name) AS d, c.c_custkey AS pos FROM n JOIN customer c ON LEVENSHTEIN(n.name, c.c_name) <= 2),
 b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY d, pos) AS rn FROM p)
 SELECT n.name, b.c_name AS candidate, CAST(b.d AS BIGINT) AS distance FROM n LEFT JOIN b ON b.name = n.name AND b.rn = 1""")
def _(s):
    k = F.col("s_suppkey")
    digits = (k * 11).cast("string")
    pad = F.when(k % 2 == 0, F.lpad(digits, 9, "0")).otherwise(F.lpad(digits, 9, "x"))
    names = s.table("supplier").select(F.concat(F.when(k % 3 == 0, "Custmer#").otherwise("Customer#"), pad).alias("name"))
    cands = s.table("customer").select(F.col("c_name").alias("candidate"), F.col("c_custkey").alias("position"))
    return matching.fuzzy_match(names, cands)


# Literals are words of other lines of the same file; owners are numbered.
LIT_SQL = "SELECT file, CONCAT('P', CAST(line_no % 10 AS STRING)) AS owner, SUBSTR(text, 1, CAST(5 + line_no % 6 AS INTEGER)) AS literal, line_no AS position FROM base_line"


def literals(s):
    return s("base_line").selectExpr("file", "concat('P', line_no % 10) AS owner", "substring(text, 1, cast(5 + line_no % 6 as int)) AS literal", "line_no AS position")


BEST_SQL = f"""li AS ({LIT_SQL}), tx AS (SELECT DISTINCT file, text FROM new_line),
 hit AS (SELECT tx.file, tx.text, li.owner, LENGTH(li.literal) AS len, ROW_NUMBER() OVER (PARTITION BY tx.file, tx.text ORDER BY LENGTH(li.literal) DESC, li.position) AS rn FROM tx JOIN li ON li.file = tx.file AND CONTAINS(LOWER(tx.text), LOWER(li.literal)))"""


@query("c16_longest_literal", LINES, f"WITH {BEST_SQL} SELECT tx.file, tx.text, h.owner, h.len AS literal_len FROM tx LEFT JOIN hit h ON h.file = tx.file AND h.text = tx.text AND h.rn = 1")
def _(s):
    return matching.longest_literal(s("new_line"), literals(s), "file")


@query("j13_attribute_mismatch", LINES, f"""WITH {BEST_SQL}, mm AS (SELECT file, line_no, text FROM new_line WHERE line_no % 13 = 0 OR line_no % 17 = 0 OR line_no % 19 = 0), tt AS (SELECT file, COUNT(*) AS lines FROM new_line GROUP BY file)
 SELECT mm.file, mm.line_no, COALESCE(h.owner, CONCAT('Q', CAST(CASE WHEN tt.lines = 1 THEN 0 ELSE LEAST((mm.line_no - 1) * 4 // GREATEST(tt.lines - 1, 1), 3) END AS STRING))) AS paragraph,
 CASE WHEN h.owner IS NOT NULL THEN 'display_literal' ELSE 'proportional' END AS method
 FROM mm JOIN tt ON tt.file = mm.file LEFT JOIN hit h ON h.file = mm.file AND h.text = mm.text AND h.rn = 1""")
def _(s):
    n = s("new_line")
    mm = n.where("line_no % 13 = 0 OR line_no % 17 = 0 OR line_no % 19 = 0")
    par = n.select("file").distinct().select("file", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])).alias("place"))
    par = par.select("file", "place", F.concat(F.lit("Q"), F.col("place").cast("string")).alias("paragraph"))
    return recon.attribute_mismatch(mm, literals(s), par, n.groupBy("file").agg(F.count("*").alias("lines")))


# The script replayed on both sides gives the two files; kept lines are found on both.
@query("g4_edit_script", LINES, """WITH b AS (SELECT file, COUNT(*) AS n, SHA256(STRING_AGG(text, chr(10) ORDER BY line_no)) AS h FROM base_line GROUP BY file), a AS (SELECT file, COUNT(*) AS n, SHA256(STRING_AGG(text, chr(10) ORDER BY line_no)) AS h FROM new_line GROUP BY file)
 SELECT COALESCE(b.file, a.file) AS file, COALESCE(b.n, 0) AS baseline_lines, COALESCE(a.n, 0) AS actual_lines, b.h AS baseline_hash, a.h AS actual_hash, TRUE AS ordered FROM b FULL JOIN a ON a.file = b.file""")
def _(s):
    script = cut(alignment.edit_script(*s("base_line", "new_line")))
    whole = lambda c: F.sha2(F.expr(f"listagg(text, '\\n') WITHIN GROUP (ORDER BY {c}) FILTER (WHERE {c} IS NOT NULL)"), 256)
    kept = script.where("op = 'keep'").groupBy("file").agg(F.expr("array_sort(collect_list(struct(baseline_line, actual_line)))").alias("k"))
    rises = F.aggregate("k", F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(True).alias("ok")), lambda acc, k: F.struct(k["actual_line"].alias("at"), (acc["ok"] & (k["actual_line"] > acc["at"])).alias("ok")))["ok"]
    count = lambda c: F.count(c)
    sums = script.groupBy("file").agg(count("baseline_line").alias("baseline_lines"), count("actual_line").alias("actual_lines"), whole("baseline_line").alias("baseline_hash"), whole("actual_line").alias("actual_hash"))
    return sums.join(kept.select("file", rises.alias("_ok")), "file", "left").select(*sums.columns, F.coalesce("_ok", F.lit(True)).alias("ordered"))
