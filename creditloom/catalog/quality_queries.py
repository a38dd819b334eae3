"""Registered queries: run scoring, history, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.registry import big, query
from creditloom.functions import text as tx
from creditloom.plans import quality
from creditloom.session import scratch_path
from creditloom.sources import history

R = "run"
CANON = """ca0 AS (SELECT *, CASE WHEN lines_compared > 0 AND lines_diverged = 0 AND lines_matched <= 0 THEN lines_compared WHEN lines_compared > 0 AND lines_matched > lines_compared THEN lines_compared ELSE lines_matched END AS lm FROM {src}),
 ca AS (SELECT *, CASE WHEN lines_compared > 0 AND lm >= lines_compared THEN 0 ELSE diff_pct_e2 END AS dp FROM ca0)"""


@query("l9_canonical_diff", R, f"WITH {CANON.format(src='run')} SELECT run_id, lm AS lines_matched, CAST(dp AS BIGINT) AS diff_pct_e2 FROM ca")
def _(s):
    return quality.canonical_diff(s(R)).select("run_id", "lines_matched", "diff_pct_e2")


CONV = """WITH p AS (SELECT run_id, CASE WHEN NOT has_parser OR parse_errors > 0 THEN 0 WHEN parse_warnings > 0 THEN 10 ELSE 20 END AS parse_points,
 CASE WHEN engine IS NULL THEN 0 WHEN engine = 'llm' THEN CASE WHEN rules >= 3 THEN 20 ELSE 15 END WHEN engine = 'deterministic' OR is_fallback THEN CASE WHEN rules >= 3 THEN 10 WHEN analysis_complexity IS NOT NULL THEN 5 ELSE 2 END WHEN rules >= 3 THEN 15 ELSE 5 END AS analyze_points,
 CASE WHEN NOT has_code THEN 0 WHEN compiles THEN CASE WHEN has_todo THEN 15 ELSE 20 END WHEN compiles IS NOT NULL THEN 5 WHEN conversion_status = 'partial' THEN 5 ELSE 10 END AS convert_points, semantic FROM run),
 t AS (SELECT *, parse_points + analyze_points + convert_points + semantic AS total FROM p)
 SELECT run_id, CAST(parse_points AS BIGINT) AS parse_points, CAST(analyze_points AS BIGINT) AS analyze_points, CAST(convert_points AS BIGINT) AS convert_points, CAST(total AS BIGINT) AS total,
 CASE WHEN total >= 90 THEN 'auto_approve' WHEN total >= 70 THEN 'manual_review' ELSE 'reconversion_required' END AS decision FROM t"""


@query("l1_conversion_score", R, CONV)
def _(s):
    return quality.conversion_score(s(R)).select("run_id", "parse_points", "analyze_points", "convert_points", "total", "decision")


@query("l2_structural_fidelity", R, """SELECT run_id, CAST(ROUND_EVEN(10.0::DOUBLE * ((m1 + m2) / 2.0::DOUBLE), 0) AS BIGINT) AS points FROM (SELECT run_id, CASE WHEN lines_compared = 0 THEN 1.0::DOUBLE ELSE LEAST(lines_matched::DOUBLE / lines_compared::DOUBLE, 1.0) END AS m1,
 CASE WHEN run_id % 5 = 0 THEN 1.0::DOUBLE ELSE LEAST((run_id % 3)::DOUBLE / (run_id % 5)::DOUBLE, 1.0) END AS m2 FROM run)""")
def _(s):
    k = F.col("run_id")
    pts = quality.structural_fidelity([(F.col("lines_matched"), F.col("lines_compared")), (k % 3, k % 5)])
    return s(R).select("run_id", pts.alias("points"))


REL = """WITH s0 AS (SELECT * REPLACE (CASE WHEN status = 'not_run' AND lines_compared > 0 THEN CASE WHEN failed_tests > 0 THEN 'failed' WHEN lines_diverged > 0 THEN 'partial' ELSE 'passed' END ELSE status END AS status) FROM run),
 """ + CANON.format(src="s0") + """,
 s1 AS (SELECT *, status = 'passed' AND failed_tests = 0 AS cl, status = 'passed' AND failed_tests = 0 AND lines_compared > 0 AND lm >= lines_compared AND lines_diverged = 0 AS perfect FROM ca),
 s2 AS (SELECT *, CASE WHEN status = 'not_run' OR lines_compared <= 0 THEN 0 WHEN cl THEN CASE WHEN (lm >= lines_compared AND lines_diverged = 0) OR lm * 100 >= lines_compared * 98 THEN 40 WHEN lm * 100 >= lines_compared * 90 THEN 36 ELSE 32 END
   WHEN status = 'partial' THEN lm * 35 // lines_compared WHEN failed_tests > 0 THEN lm * 25 // lines_compared ELSE lm * 30 // lines_compared END AS behavior_points,
  CASE WHEN perfect THEN 20 ELSE CASE rule_tests WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 14 WHEN 3 THEN 17 WHEN 4 THEN 19 ELSE 20 END END AS rules_points,
  CASE WHEN perfect THEN 15 ELSE CASE edge_tests WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 14 WHEN 3 THEN 17 WHEN 4 THEN 19 ELSE 15 END END AS edge_points,
  CASE WHEN perfect THEN 15 ELSE CASE unit_tests WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 14 WHEN 3 THEN 17 WHEN 4 THEN 19 ELSE 15 END END AS unit_points,
  CASE WHEN cl AND perfect THEN 10 WHEN cl AND retry_scope NOT IN ('', 'program') THEN 8 WHEN cl THEN 10 WHEN status = 'partial' THEN 5 ELSE 0 END AS retry_points,
  LEAST(conversion_score // 10, 10) AS conversion_points FROM s1),
 s3 AS (SELECT *, LEAST(behavior_points + rules_points + edge_points + unit_points + retry_points + conversion_points, 100) AS reliability,
  CONCAT_WS('; ', CASE WHEN status = 'not_run' THEN 'not_run' WHEN status <> 'passed' THEN CONCAT('status ', status) END, CASE WHEN lines_compared <= 0 AND status <> 'not_run' THEN 'compared 0 lines' END,
   CASE WHEN failed_tests > 0 THEN CONCAT(CAST(failed_tests AS STRING), ' failed tests') END, CASE WHEN dp > 500 THEN 'diff above 5%' END) AS blockers FROM s2),
 rel AS (SELECT *, CASE WHEN reliability >= 85 AND blockers = '' THEN 'ready_to_save' WHEN reliability >= 70 THEN 'needs_more_validation' ELSE 'retry_recommended' END AS decision_state FROM s3)
"""
REL_COLS = ["behavior_points", "rules_points", "edge_points", "unit_points", "retry_points", "conversion_points", "reliability"]


@query("l3_reliability_score", R, REL + "SELECT run_id, status, blockers, decision_state, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in REL_COLS) + " FROM rel")
def _(s):
    return quality.reliability_score(s(R)).select("run_id", "status", "blockers", "decision_state", *REL_COLS)


@query("l7_save_gate", R, REL + """, pv AS (SELECT *, run_id * 7 % 101 AS previous_score FROM rel),
 g AS (SELECT *, CAST(NOT (status = 'passed' AND failed_tests = 0) AS INT) + CAST(failed_tests > 0 AS INT) + CAST(dp > 500 OR (lines_diverged > 0 AND status <> 'passed') AS INT) + CAST(reliability < 85 AS INT) + CAST(reliability < previous_score AS INT) AS n FROM pv),
 h AS (SELECT *, n + CASE WHEN n > 0 AND retry_scope NOT IN ('', 'program') THEN 1 ELSE 0 END AS gb FROM g)
 SELECT run_id, CAST(gb AS BIGINT) AS gate_blockers, CASE WHEN gb = 0 AND reliability >= 85 THEN 'ready_to_save' WHEN reliability >= 70 AND status = 'passed' AND failed_tests = 0 THEN 'needs_more_validation' ELSE 'retry_recommended' END AS save_state FROM h""")
def _(s):
    r = quality.reliability_score(s(R)).withColumn("previous_score", F.col("run_id") * 7 % 101)
    return quality.save_gate(r).select("run_id", "gate_blockers", "save_state")


LAYER = """WITH f AS (SELECT *, old_status = 'compile_failure' OR new_status = 'compile_failure' AS cf, old_status IN ('runtime_failure','timeout') OR new_status IN ('runtime_failure','timeout') AS rf,
  old_status IN ('success','no_stdout','fallback') AS oo, new_status IN ('success','no_stdout','fallback') AS no, status IN ('passed','partial') AND lines_compared > 0 AS good FROM run),
 l0 AS (SELECT *, CASE WHEN status = 'not_run' AND old_status = '' AND new_status = '' THEN 0 WHEN infra_blocker THEN 5 WHEN cf THEN 0 WHEN old_status IN ('skipped','') AND new_status IN ('skipped','') THEN 50 ELSE 100 END AS compile_health,
  CASE WHEN status = 'not_run' OR cf OR rf THEN 0 WHEN good AND ((oo AND no) OR (status = 'passed' AND (oo OR no) AND (CASE WHEN oo THEN new_status ELSE old_status END) IN ('skipped','','no_stdout','fallback'))) THEN 100
   WHEN execution_mode = 'unavailable' THEN CASE WHEN good THEN 100 ELSE 10 END WHEN oo AND no THEN 100 ELSE 40 END AS runtime_health FROM f),
 l1 AS (SELECT *, CASE WHEN compile_health = 100 AND runtime_health = 100 AND NOT infra_blocker THEN CASE WHEN lines_compared <= 0 THEN CASE WHEN status IN ('failed','partial') THEN 0 ELSE 30 END
   WHEN lines_matched = lines_compared AND failed_tests = 0 THEN 100 ELSE GREATEST((10000 - diff_pct_e2 + 50) // 100, 0) END END AS behavioral_parity,
  CASE WHEN status = 'passed' AND failed_tests = 0 THEN 100 WHEN status = 'not_run' THEN 0 ELSE GREATEST((CASE status WHEN 'partial' THEN 55 WHEN 'failed' THEN 25 ELSE 40 END) - (CASE WHEN retry_scope = '' THEN 15 WHEN retry_scope = '3:section' THEN 5 ELSE 0 END), 0) END AS retry_stability,
  CASE WHEN status = 'passed' AND failure_reason = '' THEN 100 WHEN paragraphs = 0 AND retry_scope = '' AND attribution_method = '' THEN 10
   ELSE LEAST(100, 20 + (CASE WHEN paragraphs > 0 THEN 35 ELSE 0 END) + (CASE WHEN retry_scope <> '' THEN 20 ELSE 0 END) + (CASE WHEN attribution_method <> '' AND retry_scope <> '' THEN 15 ELSE 0 END)
    + (CASE WHEN attribution_method NOT IN ('','none','unknown') THEN 15 ELSE 0 END) + (CASE WHEN attribution_method <> '' THEN LEAST(10, attributed * 3) ELSE 0 END)) END AS attribution_confidence FROM l0),
 la AS (SELECT *, 30 * compile_health + 30 * runtime_health + COALESCE(25 * behavioral_parity, 0) + 10 * retry_stability + 5 * attribution_confidence AS num, 75 + CASE WHEN behavioral_parity IS NULL THEN 0 ELSE 25 END AS den FROM l1)
"""
LAYERS = ["compile_health", "runtime_health", "behavioral_parity", "retry_stability", "attribution_confidence"]


@query("l4_layer_scores", R, LAYER + "SELECT run_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LAYERS) + " FROM la")
def _(s):
    return quality.layer_scores(s(R)).select("run_id", *LAYERS)


@query("l5_qscore", R, LAYER + "SELECT run_id, CAST((2 * num + den) // (2 * den) AS BIGINT) AS qscore FROM la")
def _(s):
    return quality.qscore(quality.layer_scores(s(R))).select("run_id", "qscore")


@query("l6_primary_failure_layer", R, LAYER + """SELECT run_id, CASE WHEN infra_blocker OR cf THEN 'compile_health' WHEN rf THEN 'runtime_health'
 WHEN compile_health = lo THEN 'compile_health' WHEN runtime_health = lo THEN 'runtime_health' WHEN behavioral_parity = lo THEN 'behavioral_parity' WHEN retry_stability = lo THEN 'retry_stability' ELSE 'attribution_confidence' END AS primary_failure_layer
 FROM (SELECT *, LEAST(compile_health, runtime_health, COALESCE(behavioral_parity, 1000), retry_stability, attribution_confidence) AS lo FROM la)""")
def _(s):
    return quality.primary_failure_layer(quality.layer_scores(s(R))).select("run_id", "primary_failure_layer")


FP = f"WITH {CANON.format(src='run')}, fp AS (SELECT *, SUBSTR(SHA256(CONCAT_WS('|', UPPER(program), LOWER(status), lines_compared, lm, lines_diverged, dp, failed_tests, rule_tests, edge_tests, unit_tests, LEAST(conversion_score // 10, 10))), 1, 16) AS fingerprint FROM ca)"


@query("l8_run_fingerprint", R, FP + " SELECT run_id, fingerprint FROM fp")
def _(s):
    return quality.run_fingerprint(s(R)).select("run_id", "fingerprint")


DRIFT = "WITH f AS (SELECT *, CONCAT(CAST(lines_compared % 10 AS STRING), status) AS fp FROM run), g AS (SELECT *, FIRST_VALUE(score) OVER (PARTITION BY fp ORDER BY run_ts, run_id) AS first_score FROM f) SELECT run_id, fp AS fingerprint, first_score, score, score - first_score AS delta FROM g WHERE score <> first_score"


@query("e9_score_drift", R, DRIFT)
def _(s):
    r = s(R).withColumn("fingerprint", F.concat((F.col("lines_compared") % 10).cast("string"), F.col("status")))
    return quality.score_drift(r)


@query("e10_score_regression", R, "SELECT run_id, program, score, prev AS previous_score FROM (SELECT *, LAG(score) OVER (PARTITION BY program ORDER BY run_ts, run_id) AS prev FROM run) WHERE score < prev")
def _(s):
    return quality.score_regression(s(R)).drop("run_ts")


RULES_AS = """rl AS (SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN CONCAT('Limited to ', CAST(doc_id AS STRING), ' entries') WHEN 1 THEN 'Overtime pays 1.5 times' WHEN 2 THEN 'The the and there' ELSE 'must confirm with the onesen' END AS rule FROM documents)"""


@query("l10_rule_coverage", sql=f"""WITH {RULES_AS}, m AS (SELECT d.lang, CASE doc_id % 4
  WHEN 0 THEN CONTAINS(LOWER(text), CAST(doc_id AS STRING)) OR REGEXP_MATCHES(LOWER(text), 'max_\\w+\\s*=\\s*\\d+') OR REGEXP_MATCHES(LOWER(text), '\\[\\s*\\d+\\s*\\]') OR (CONTAINS(LOWER(text), 'limited')::INT + CONTAINS(LOWER(text), 'entries')::INT) * 10 >= 8
  WHEN 1 THEN CONTAINS(LOWER(text), '1.5') OR CONTAINS(LOWER(text), 'overtime_multiplier') OR (CONTAINS(LOWER(text), 'overtime')::INT + CONTAINS(LOWER(text), 'pays')::INT + CONTAINS(LOWER(text), 'times')::INT) * 10 >= 12
  WHEN 2 THEN CONTAINS(LOWER(text), 'there')
  ELSE (CONTAINS(LOWER(text), 'equalsignorecase') AND CONTAINS(LOWER(text), '"y"')) OR (CONTAINS(LOWER(text), 'confirm')::INT + CONTAINS(LOWER(text), 'onesen')::INT) * 10 >= 8 END AS hit FROM documents d)
 SELECT lang, COUNT(*) AS rules, COUNT(*) FILTER (hit) AS matched FROM m GROUP BY lang""")
def _(s):
    d = s.table("documents")
    m = F.col("doc_id") % 4
    rule = (
        F.when(m == 0, F.concat(F.lit("Limited to "), F.col("doc_id").cast("string"), F.lit(" entries"))).when(m == 1, "Overtime pays 1.5 times")
        .when(m == 2, "The the and there").otherwise("must confirm with the onesen")
    )
    per = quality.rule_coverage(d.select("doc_id", rule.alias("rule")), d.select("doc_id", F.col("text").alias("target")), "doc_id")
    return per.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("rules").alias("rules"), F.sum("matched").alias("matched"))


@query("l11_retry_scope", R, """WITH mm AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN NULL ELSE CONCAT('P', CAST((run_id + j * (run_id % 3)) % 7 AS STRING)) END AS p FROM run, (VALUES (0), (1)) v(j) WHERE run_id % 11 <> 0),
 se(p, sec) AS (VALUES ('P0', 'S0'), ('P1', 'S0'), ('P2', 'S1'), ('P3', 'S1'), ('P4', 'S1')),
 a AS (SELECT mm.run_id, COUNT(DISTINCT mm.p) AS n, COUNT(DISTINCT CASE WHEN mm.p IS NOT NULL THEN COALESCE(se.sec, mm.p) END) AS s, COUNT(se.sec) AS h, MIN(mm.p) AS op, MIN(COALESCE(se.sec, mm.p)) AS os FROM mm LEFT JOIN se ON se.p = mm.p GROUP BY mm.run_id),
 b AS (SELECT r.run_id, COALESCE(n, 0) AS n, COALESCE(s, 0) AS s, h, op, os FROM run r LEFT JOIN a ON a.run_id = r.run_id)
 SELECT run_id, CASE WHEN n = 1 THEN 'paragraph' WHEN n > 1 AND s = 1 AND h > 0 THEN 'section' WHEN n > 0 THEN 'file' ELSE 'program' END AS scope_type,
 CASE WHEN n = 1 THEN op WHEN n > 1 AND s = 1 AND h > 0 THEN os WHEN n > 0 THEN 'main' ELSE 'program' END AS scope_id, CASE WHEN n = 1 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS confidence, n AS paragraphs FROM b""")
def _(s):
    r = s(R)
    k = F.col("run_id")
    name = lambda j: F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("P"), ((k + j * (k % 3)) % 7).cast("string")))
    mm = r.where(k % 11 != 0).select("run_id", F.explode(F.array(name(0), name(1))).alias("paragraph"), F.lit("content_mismatch").alias("failure_kind"))
    sections = r.sparkSession.createDataFrame([("P0", "S0"), ("P1", "S0"), ("P2", "S1"), ("P3", "S1"), ("P4", "S1")], "paragraph string, section string")
    return quality.retry_scope(mm, sections, r)


# Words of documents against the words of good documents of the same language.
WORDS_SQL = "re AS (SELECT lang AS k, w AS name FROM (SELECT lang, UNNEST(REGEXP_EXTRACT_ALL(text, '[A-Za-z]{3,}')) AS w FROM documents)), va AS (SELECT DISTINCT lang AS k, w AS name FROM (SELECT lang, UNNEST(REGEXP_EXTRACT_ALL(text, '[A-Za-z]{3,}')) AS w FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1))"


def words(df, key):
    return df.select(key, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("name"))


def valid_words(s):
    good = s.table("labels").where("quality = 1").select("doc_id")
    return words(s.table("documents").join(good, "doc_id", "left_semi"), "lang")


@query("d20_compliance_rate", sql=f"WITH {WORDS_SQL} SELECT re.k AS lang, COUNT(*) AS identifiers, COUNT(va.name) AS valid, (COUNT(va.name) * 20000 + COUNT(*)) // (COUNT(*) * 2) AS rate_e2 FROM re LEFT JOIN va ON va.k = re.k AND va.name = re.name GROUP BY re.k")
def _(s):
    return quality.compliance_rate(words(s.table("documents"), "lang"), valid_words(s), "lang")


@query("g3_invented_names", sql=f"""WITH {WORDS_SQL}, n AS (SELECT DISTINCT k, name FROM re EXCEPT SELECT k, name FROM va) SELECT k AS lang, name,
 CASE WHEN REGEXP_MATCHES(name, '(Reader|Writer|Stream|Channel|Buffer)$') THEN 'file_handles' WHEN REGEXP_MATCHES(name, '(Service|Calculator|Validator|Handler|Manager)$') THEN 'service_objects' WHEN REGEXP_MATCHES(name, '^ws[A-Z].*(Request|Response|Req|Resp)$') THEN 'dto_variables'
  WHEN name IN ('process', 'handle', 'execute', 'validate', 'compute') THEN 'helper_methods' WHEN REGEXP_MATCHES(name, '(?i)(Flag|Found|EndOf|isValid)') THEN 'flag_fields' ELSE 'other' END AS category FROM n""")
def _(s):
    return quality.invented_names(words(s.table("documents"), "lang"), valid_words(s), "lang")


@query("d21_cost_estimate", sql=f"SELECT lang, {big('SUM(CAST(CEIL(LENGTH(text) / 4.0) AS BIGINT))')} AS tokens_in, {big('SUM(CAST(CEIL(LENGTH(text) / 4.0) AS BIGINT) * 100000 + CAST(CEIL(LENGTH(source) / 4.0) AS BIGINT) * 400000)')} AS cost FROM documents GROUP BY lang")
def _(s):
    t, o = tx.tokens_of(F.col("text")), tx.tokens_of(F.col("source"))
    return s.table("documents").groupBy("lang").agg(F.sum(t).alias("tokens_in"), F.sum(quality.cost_estimate(t, o)).alias("cost"))


@query("d22_repair_summary", R, """WITH n AS (SELECT program AS run_id, CASE run_id % 5 WHEN 0 THEN 'semicolon_expected' WHEN 1 THEN 'package_does_not_exist' WHEN 2 THEN 'package_does_not_exist' WHEN 3 THEN 'cannot_find_symbol' ELSE 'odd_thing' END AS e, CASE WHEN run_id % 5 = 1 THEN 'lombok' ELSE 'x.y' END AS d FROM run)
 SELECT run_id, CASE e WHEN 'semicolon_expected' THEN 'Added missing semicolon' WHEN 'cannot_find_symbol' THEN 'Fixed missing symbol' WHEN 'package_does_not_exist' THEN CASE WHEN d = 'lombok' THEN 'Removed framework import' ELSE 'Removed unavailable import' END ELSE 'Repaired odd thing' END AS repair, COUNT(*) AS notes FROM n GROUP BY 1, 2""")
def _(s):
    m = F.col("run_id") % 5
    e = F.when(m == 0, "semicolon_expected").when(m.isin(1, 2), "package_does_not_exist").when(m == 3, "cannot_find_symbol").otherwise("odd_thing")
    n = s(R).select(F.col("program").alias("run_id"), e.alias("error_type"), F.when(m == 1, "lombok").otherwise("x.y").alias("detail"))
    return quality.repair_summary(n)


@query("h21_reliability_badge", R, "SELECT run_id, CASE WHEN score <= 0 THEN 'Not Run' WHEN score >= 85 THEN 'Passed' WHEN score >= 55 THEN 'Needs Review' ELSE 'Failed' END AS badge FROM run")
def _(s):
    return s(R).select("run_id", tx.reliability_badge(F.col("score")).alias("badge"))


# --- history -----------------------------------------------------------------

def entries(s):
    d = s.table("documents")
    return d.select(
        F.col("doc_id").alias("id"), F.lit("single").alias("entry_type"), F.concat(F.lit("PGM"), F.col("doc_id").cast("string")).alias("program_name"), F.col("text").alias("source_code"),
        F.lit("deterministic").alias("analysis_engine"), F.col("lang").alias("complexity"), (F.col("doc_id") * 37 % 1009).alias("created_at"), F.col("n_chars").alias("chars"), "lang",
    )


@query("a18_history_round_trip", sql="SELECT doc_id AS id, SUBSTR(SHA256(text), 1, 16) AS source_hash, lang AS payload_lang, n_chars AS payload_chars FROM documents")
def _(s):
    path = scratch_path(s.spark, "history")
    history.write_history(history.history_rows(entries(s), ["lang", "chars"]), path)
    back = history.read_history(s.spark, path, "lang string, chars bigint")
    return back.select("id", "source_hash", F.col("payload.lang").alias("payload_lang"), F.col("payload.chars").alias("payload_chars"))


PRUNE = "SELECT doc_id AS id FROM documents ORDER BY doc_id * 37 % 1009 DESC, doc_id DESC LIMIT {n}"


@query("f3_prune_history", sql=PRUNE.format(n=50))
def _(s):
    return history.prune_history(entries(s), 50).select("id")


@query("f4_list_history", sql=PRUNE.format(n=7))
def _(s):
    return history.list_history(entries(s), 7).select("id")
