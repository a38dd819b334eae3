"""Run-quality scoring over a runs table: one row per run, columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.pic import clamp, idiv
from creditloom.functions.text import source_hash
from creditloom.operators.ordered import range_slices

# Layer weights, points, thresholds.
LAYER_WEIGHTS = {"compile_health": 30, "runtime_health": 30, "behavioral_parity": 25, "retry_stability": 10, "attribution_confidence": 5}
COMPILE_FAILED = ("compile_failure",)
RUNTIME_FAILED = ("runtime_failure", "timeout")
RUNTIME_OK = ("success", "no_stdout", "fallback")
TEST_TIERS = {1: 10, 2: 14, 3: 17, 4: 19}
MAX_RULES, MAX_EDGE, MAX_UNIT, MAX_RETRY, MAX_BEHAVIOR = 20, 15, 15, 10, 40
READY, BORDERLINE, SAVE_FROM, DIFF_LIMIT_E2 = 85, 70, 85, 500
STOP_WORDS = """the and for are but not you all can her was one our out day get has him his how its may new now old see two
way who use any per when that this with from into must each rule business""".split()


def _c(name: str) -> Column:
    return F.col(name)


# --- conversion --------------------------------------------------------------

def conversion_score(runs: DataFrame) -> DataFrame:
    """Parse 20 + analyze 20 + convert 20 + semantic 40, and the decision.

    Needs parse_errors, parse_warnings, has_parser, engine, is_fallback,
    rules, analysis_complexity, has_code, compiles (nullable), has_todo,
    conversion_status and semantic.
    """
    parse = F.when(~_c("has_parser") | (_c("parse_errors") > 0), 0).when(_c("parse_warnings") > 0, 10).otherwise(20)
    enough = _c("rules") >= 3
    analyze = (
        F.when(_c("engine").isNull(), 0).when((_c("engine") == "llm") & enough, 20).when(_c("engine") == "llm", 15)
        .when((_c("engine") == "deterministic") | _c("is_fallback"), F.when(enough, 10).when(_c("analysis_complexity").isNotNull(), 5).otherwise(2))
        .otherwise(F.when(enough, 15).otherwise(5))
    )
    ok = F.coalesce("compiles", F.lit(False))
    convert = (
        F.when(~_c("has_code"), 0).when(ok & ~_c("has_todo"), 20).when(ok, 15).when(_c("compiles").isNotNull(), 5)
        .when(_c("conversion_status") == "partial", 5).otherwise(10)
    )
    out = runs.withColumns({"parse_points": parse.cast("bigint"), "analyze_points": analyze.cast("bigint"), "convert_points": convert.cast("bigint")})
    total = (_c("parse_points") + _c("analyze_points") + _c("convert_points") + _c("semantic")).cast("bigint")
    return out.withColumn("total", total).withColumn("decision", conversion_decision(F.col("total")))


def conversion_decision(total: Column) -> Column:
    return F.when(total >= 90, "auto_approve").when(total >= 70, "manual_review").otherwise("reconversion_required")


def structural_fidelity(shares: list[tuple[Column, Column]]) -> Column:
    """Ten times the mean of matched/total shares; an empty part counts as full.

    Half rounds to even, as the scores it must equal do.
    """
    parts = [F.when(n == 0, 1.0).otherwise(F.least(m.cast("double") / n.cast("double"), F.lit(1.0))) for m, n in shares]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.bround(F.lit(10.0) * (total / F.lit(float(len(parts))))).cast("bigint")


def significant_words(rule: Column) -> Column:
    """Lower-case words of three letters or more that are not stop words."""
    words = F.transform(F.regexp_extract_all(rule, F.lit(r"[A-Za-z]\w{2,}"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def rule_matched(rule: Column, target: Column) -> Column:
    """Keyword rules first, then the share of significant words found."""
    rl, tl = F.lower(rule), F.lower(target)
    nums = F.regexp_extract_all(rule, F.lit(r"\b(\d+)\b"), F.lit(1))
    has_num = F.exists(nums, lambda n: tl.contains(n))
    capacity = (rl.contains("capacity") | rl.contains("limited to")) & (has_num | tl.rlike(r"max_\w+\s*=\s*\d+") | tl.rlike(r"\[\s*\d+\s*\]"))
    overtime = rl.contains("overtime") & (rl.contains("1.5") | rl.contains("1,5")) & (tl.contains("1.5") | tl.contains("overtime_multiplier"))
    tax = rule.contains("500") & (rl.contains("tax") | rl.contains("bracket") | rule.contains("%")) & tl.contains("500") & tl.contains("0.05")
    confirm = rl.contains("confirm") & tl.contains("equalsignorecase") & tl.contains('"y"')
    words = significant_words(rule)
    n = F.size(words)
    hit = F.size(F.filter(words, lambda w: tl.contains(w)))
    share = F.when(n >= 2, hit * 10 >= n * 4).when(n == 1, hit == 1).otherwise(False)
    return capacity | overtime | tax | confirm | share


def rule_coverage(rules: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rules per program, matched in its target text, and points out of ten.

    ``rules(key, rule)``, ``targets(key, target)``: one text per program.
    """
    j = rules.join(targets, key)
    agg = j.groupBy(key).agg(F.count("*").alias("rules"), F.count_if(rule_matched(F.col("rule"), F.col("target"))).alias("matched"))
    return agg.withColumn("points", F.bround(F.lit(10.0) * (F.col("matched") / F.col("rules"))).cast("bigint"))


# --- reliability -------------------------------------------------------------

def canonical_diff(runs: DataFrame) -> DataFrame:
    """Repaired counters: lines_compared, lines_matched, lines_diverged, diff_pct_e2."""
    n, m, d = _c("lines_compared"), _c("lines_matched"), _c("lines_diverged")
    fixed = F.when((n > 0) & (d == 0) & (m <= 0), n).when((n > 0) & (m > n), n).otherwise(m)
    out = runs.withColumn("lines_matched", fixed.cast("bigint"))
    pct = F.when((n > 0) & (_c("lines_matched") >= n), F.lit(0)).otherwise(_c("diff_pct_e2"))
    return out.withColumn("diff_pct_e2", pct.cast("bigint"))


def settled_status(status: Column, compared: Column, diverged: Column, failed: Column) -> Column:
    """A run that compared lines cannot be 'not_run'."""
    return F.when(
        (status == "not_run") & (compared > 0), F.when(failed > 0, "failed").when(diverged > 0, "partial").otherwise("passed")
    ).otherwise(status)


def perfect_pass() -> Column:
    return (_c("status") == "passed") & (_c("failed_tests") == 0) & (_c("lines_compared") > 0) & (
        _c("lines_matched") >= _c("lines_compared")
    ) & (_c("lines_diverged") == 0)


def _test_points(count: Column, top: int, ready: Column) -> Column:
    tier = None
    for n, p in TEST_TIERS.items():
        tier = F.when(count == n, p) if tier is None else tier.when(count == n, p)
    return F.when(ready, top).when(count <= 0, 0).when(count >= 5, top).otherwise(tier).cast("bigint")


def reliability_score(runs: DataFrame) -> DataFrame:
    """Five parts and the conversion bonus, clamped to 100, with state and blockers."""
    r = runs.withColumn("status", settled_status(_c("status"), _c("lines_compared"), _c("lines_diverged"), _c("failed_tests")))
    r = canonical_diff(r).withColumn("perfect", perfect_pass())
    n, m, failed, status = _c("lines_compared"), _c("lines_matched"), _c("failed_tests"), _c("status")
    clean = (status == "passed") & (failed == 0)
    scaled = lambda pct: idiv(m * F.lit(pct), n)
    behavior = (
        F.when((status == "not_run") | (n <= 0), 0)
        .when(clean & (((m >= n) & (_c("lines_diverged") == 0)) | (m * 100 >= n * 98)), MAX_BEHAVIOR)
        .when(clean & (m * 100 >= n * 90), 36).when(clean, 32).when(status == "partial", scaled(35)).when(failed > 0, scaled(25))
        .otherwise(scaled(30))
    )
    scoped = ~F.coalesce("retry_scope", F.lit("")).isin("", "program")
    retry = F.when(clean & _c("perfect"), MAX_RETRY).when(clean & scoped, MAX_RETRY - 2).when(clean, MAX_RETRY).when(status == "partial", 5).otherwise(0)
    bonus = F.coalesce(clamp(idiv(_c("conversion_score"), 10), 0, 10), F.lit(0))
    r = r.withColumns(
        {
            "behavior_points": clamp(behavior.cast("bigint"), 0, 100),
            "rules_points": _test_points(_c("rule_tests"), MAX_RULES, _c("perfect")),
            "edge_points": _test_points(_c("edge_tests"), MAX_EDGE, _c("perfect")),
            "unit_points": _test_points(_c("unit_tests"), MAX_UNIT, _c("perfect")),
            "retry_points": retry.cast("bigint"),
            "conversion_points": bonus.cast("bigint"),
        }
    )
    parts = ["behavior_points", "rules_points", "edge_points", "unit_points", "retry_points", "conversion_points"]
    total = F.lit(0).cast("bigint")
    for p in parts:
        total = total + F.col(p)
    blockers = F.array_compact(
        F.array(
            F.when(status == "not_run", "not_run").when(status != "passed", F.concat(F.lit("status "), status)),
            F.when((n <= 0) & (status != "not_run"), "compared 0 lines"),
            F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed tests"))),
            F.when(_c("diff_pct_e2") > DIFF_LIMIT_E2, "diff above 5%"),
        )
    )
    r = r.withColumn("reliability", clamp(total, 0, 100)).withColumn("blockers", F.array_join(blockers, "; "))
    state = F.when((_c("reliability") >= READY) & (_c("blockers") == ""), "ready_to_save").when(
        _c("reliability") >= BORDERLINE, "needs_more_validation"
    ).otherwise("retry_recommended")
    return r.withColumn("decision_state", state)


def save_gate(scored: DataFrame) -> DataFrame:
    """Save state from reliability, diff, failed tests and the previous score (nullable)."""
    total, status, failed, d = _c("reliability"), _c("status"), _c("failed_tests"), _c("lines_diverged")
    ok = (status == "passed") & (failed == 0)
    tests = [
        ~ok, failed > 0, (_c("diff_pct_e2") > DIFF_LIMIT_E2) | ((d > 0) & (status != "passed")), total < SAVE_FROM,
        F.coalesce(total < _c("previous_score"), F.lit(False)),
    ]
    n = F.lit(0)
    for t in tests:
        n = n + t.cast("int")
    scoped = ~F.coalesce("retry_scope", F.lit("")).isin("", "program")
    out = scored.withColumn("gate_blockers", (n + F.when((n > 0) & scoped, 1).otherwise(0)).cast("bigint"))
    state = F.when((_c("gate_blockers") == 0) & (total >= SAVE_FROM), "ready_to_save").when(
        (total >= BORDERLINE) & ok, "needs_more_validation"
    ).otherwise("retry_recommended")
    return out.withColumn("save_state", state)


def run_fingerprint(runs: DataFrame) -> DataFrame:
    """Hash of the stable facts of a run."""
    tests = lambda c: F.greatest(F.col(c), F.lit(0))
    facts = F.concat_ws(
        "|", F.upper("program"), F.lower("status"), "lines_compared", "lines_matched", "lines_diverged", "diff_pct_e2", "failed_tests",
        tests("rule_tests"), tests("edge_tests"), tests("unit_tests"), F.coalesce(clamp(idiv(_c("conversion_score"), 10), 0, 10).cast("string"), F.lit("")),
    )
    return canonical_diff(runs).withColumn("fingerprint", source_hash(facts))


def score_drift(runs: DataFrame) -> DataFrame:
    """Runs whose score differs from the first run with the same fingerprint.

    The first score is an aggregate joined back, so a fingerprint shared by
    very many runs stays spread out.
    """
    first = runs.groupBy("fingerprint").agg(F.min_by("score", F.struct("run_ts", "run_id")).alias("first_score"))
    j = runs.join(first, "fingerprint").where(F.col("score") != F.col("first_score"))
    return j.select("run_id", "fingerprint", "first_score", "score", (F.col("score") - F.col("first_score")).alias("delta"))


def previous_scores(runs: DataFrame) -> DataFrame:
    """Score of the program's run before each run; ordered slices, so no program fills one task."""
    order = [F.col("program"), F.col("run_ts"), F.col("run_id")]
    placed = range_slices(runs.select("run_id", "program", "run_ts", "score"), order)
    inside = Window.partitionBy("_slice", "program").orderBy("_at")
    local = placed.withColumn("_prev", F.lag("score").over(inside))
    ends = placed.groupBy("program", "_slice").agg(F.max_by("score", "_at").alias("_end"))
    carry = ends.select("program", "_slice", F.lag("_end").over(Window.partitionBy("program").orderBy("_slice")).alias("_car"))
    j = local.join(carry, ["program", "_slice"])
    return j.select("run_id", "program", "run_ts", "score", F.coalesce("_prev", "_car").alias("previous_score"))


def score_regression(runs: DataFrame) -> DataFrame:
    """Runs that scored below the run before."""
    p = previous_scores(runs)
    return p.where(F.col("score") < F.col("previous_score"))


# --- layers ------------------------------------------------------------------

def layer_scores(runs: DataFrame) -> DataFrame:
    """Compile, runtime, parity, retry and attribution scores.

    Needs old_status, new_status, status, infra_blocker, execution_mode,
    lines_compared, lines_matched, lines_diverged, diff_pct_e2 (nullable),
    failed_tests, retry_scope, paragraphs (count), attribution_method,
    attributed (count of attributed mismatches) and failure_reason.
    """
    o, n, st = _c("old_status"), _c("new_status"), _c("status")
    comp_fail = o.isin(*COMPILE_FAILED) | n.isin(*COMPILE_FAILED)
    run_fail = o.isin(*RUNTIME_FAILED) | n.isin(*RUNTIME_FAILED)
    idle = o.isin("skipped", "") & n.isin("skipped", "")
    compile_ = F.when((st == "not_run") & (o == "") & (n == ""), 0).when(_c("infra_blocker"), 5).when(comp_fail, 0).when(idle, 50).otherwise(100)
    both_ok = o.isin(*RUNTIME_OK) & n.isin(*RUNTIME_OK)
    other = F.when(o.isin(*RUNTIME_OK), n).otherwise(o)
    one_ok = (st == "passed") & (o.isin(*RUNTIME_OK) | n.isin(*RUNTIME_OK)) & other.isin("skipped", "", "no_stdout", "fallback")
    good = st.isin("passed", "partial") & (_c("lines_compared") > 0)
    runtime = (
        F.when((st == "not_run") | comp_fail | run_fail, 0).when(good & (both_ok | one_ok), 100)
        .when(_c("execution_mode") == "unavailable", F.when(good, 100).otherwise(10)).when(both_ok, 100).otherwise(40)
    )
    r = runs.withColumns({"compile_health": compile_.cast("bigint"), "runtime_health": runtime.cast("bigint")})
    applies = (_c("compile_health") == 100) & (_c("runtime_health") == 100) & ~_c("infra_blocker")
    cmp_, m, d = _c("lines_compared"), _c("lines_matched"), _c("lines_diverged")
    parity = (
        F.when(cmp_ <= 0, F.when(st.isin("failed", "partial"), 0).otherwise(30)).when((m == cmp_) & (_c("failed_tests") == 0), 100)
        .when(_c("diff_pct_e2").isNull(), F.when(d == 0, 95).otherwise(F.greatest(idiv((cmp_ - d) * 100 * 2 + cmp_, cmp_ * 2), F.lit(0))))
        .otherwise(F.greatest(idiv(F.lit(10_000) - _c("diff_pct_e2") + 50, 100), F.lit(0)))
    )
    scope = F.trim(F.coalesce("retry_scope", F.lit("")))
    base = F.when(st == "partial", 55).when(st == "failed", 25).otherwise(40)
    retry = (
        F.when((st == "passed") & (_c("failed_tests") == 0), 100).when(st == "not_run", 0)
        .otherwise(F.greatest(base - F.when(scope == "", 15).when(F.split_part(scope, F.lit(":"), F.lit(1)).rlike(r"\d") & scope.contains(":"), 5).otherwise(0), F.lit(0)))
    )
    method = F.coalesce("attribution_method", F.lit(""))
    mapped = method != ""
    attribution = (
        F.when((st == "passed") & (F.coalesce("failure_reason", F.lit("")) == ""), 100)
        .when((_c("paragraphs") == 0) & (scope == "") & ~mapped, 10)
        .otherwise(
            F.least(
                F.lit(100),
                F.lit(20) + F.when(_c("paragraphs") > 0, 35).otherwise(0) + F.when(scope != "", 20).otherwise(0)
                + F.when(mapped & (scope != ""), 15).otherwise(0) + F.when(~method.isin("", "none", "unknown"), 15).otherwise(0)
                + F.when(mapped, F.least(F.lit(10), _c("attributed") * 3)).otherwise(0),
            )
        )
    )
    return r.withColumns(
        {
            "behavioral_parity": F.when(applies, parity.cast("bigint")), "retry_stability": retry.cast("bigint"),
            "attribution_confidence": attribution.cast("bigint"),
        }
    )


def qscore(scored: DataFrame) -> DataFrame:
    """Weighted mean over the layers that have a score, rounded half up."""
    num, den = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for layer, w in LAYER_WEIGHTS.items():
        num = num + F.coalesce(F.col(layer) * w, F.lit(0))
        den = den + F.when(F.col(layer).isNotNull(), w).otherwise(0)
    return scored.withColumn("qscore", F.when(den > 0, idiv(num * 2 + den, den * 2)).otherwise(0).cast("bigint"))


def primary_failure_layer(scored: DataFrame) -> DataFrame:
    """Lowest layer; ties go to the earlier layer; hard failures decide first."""
    o, n = _c("old_status"), _c("new_status")
    comp = _c("infra_blocker") | o.isin(*COMPILE_FAILED) | n.isin(*COMPILE_FAILED)
    run = o.isin(*RUNTIME_FAILED) | n.isin(*RUNTIME_FAILED)
    cands = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("n"))) for i, x in enumerate(LAYER_WEIGHTS)]))
    low = F.array_min(cands)["n"]
    return scored.withColumn("primary_failure_layer", F.when(comp, "compile_health").when(run, "runtime_health").otherwise(low))


def retry_scope(mismatches: DataFrame, sections: DataFrame, runs: DataFrame) -> DataFrame:
    """Narrowest scope that covers a run's attributed mismatches, with confidence.

    ``mismatches(run_id, paragraph, failure_kind)`` (paragraph may be NULL),
    ``sections(paragraph, section)``, ``runs(run_id)``.
    """
    m = mismatches.join(sections, "paragraph", "left")
    agg = m.groupBy("run_id").agg(
        F.count_distinct("paragraph").alias("n_par"), F.count_distinct(F.when(F.col("paragraph").isNotNull(), F.coalesce("section", "paragraph"))).alias("n_sec"),
        F.count_if(F.col("section").isNotNull()).alias("has_sec"),
        F.min("paragraph").alias("one_par"), F.min(F.coalesce("section", "paragraph")).alias("one_sec"),
    )
    j = runs.select("run_id").join(agg, "run_id", "left")
    n, s = F.coalesce("n_par", F.lit(0)), F.coalesce("n_sec", F.lit(0))
    sec = (n > 1) & (s == 1) & (F.col("has_sec") > 0)
    kind = F.when(n == 1, "paragraph").when(sec, "section").when(n > 0, "file").otherwise("program")
    return j.select(
        "run_id", kind.alias("scope_type"),
        F.when(n == 1, F.col("one_par")).when(sec, F.col("one_sec")).when(n > 0, "main").otherwise("program").alias("scope_id"),
        F.when(n == 1, "high").when(n > 0, "medium").otherwise("low").alias("confidence"), n.alias("paragraphs"),
    )


# --- small summaries ---------------------------------------------------------

def compliance_rate(refs: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Share of identifiers in the valid set per program, percent at scale 2.

    ``refs(key, name)`` one row per reference, ``valid(key, name)``.
    """
    v = valid.select(key, "name").distinct().withColumn("_ok", F.lit(True))
    per = refs.groupBy(key, "name").agg(F.count("*").alias("n")).join(v, [key, "name"], "left")
    agg = per.groupBy(key).agg(F.sum("n").alias("identifiers"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("n"))), F.lit(0)).alias("valid"))
    return agg.withColumn("rate_e2", idiv(F.col("valid") * 20_000 + F.col("identifiers"), F.col("identifiers") * 2))


def invented_names(refs: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Referenced names outside the valid set, with a category."""
    names = refs.select(key, "name").distinct().join(valid.select(key, "name").distinct(), [key, "name"], "left_anti")
    n = F.col("name")
    cat = (
        F.when(n.rlike("(Reader|Writer|Stream|Channel|Buffer)$"), "file_handles")
        .when(n.rlike("(Service|Calculator|Validator|Handler|Manager)$"), "service_objects")
        .when(n.rlike("^ws[A-Z].*(Request|Response|Req|Resp)$"), "dto_variables")
        .when(n.isin("process", "handle", "execute", "validate", "compute"), "helper_methods")
        .when(n.rlike("(?i)(Flag|Found|EndOf|isValid)"), "flag_fields").otherwise("other")
    )
    return names.withColumn("category", cat)


def repair_summary(notes: DataFrame) -> DataFrame:
    """One counted line per run and kind of repair: (run_id, repair, notes).

    ``notes(run_id, error_type, detail)``.
    """
    t = F.lower("error_type")
    framework = F.lit(False)
    for mark in ("org.springframework", "jakarta.", "javax.annotation", "javax.inject", "lombok"):
        framework = framework | F.col("detail").contains(mark)
    label = (
        F.when(t == "semicolon_expected", "Added missing semicolon").when(t == "incompatible_types", "Fixed type mismatch")
        .when(t == "cannot_find_symbol", "Fixed missing symbol")
        .when((t == "package_does_not_exist") & framework, "Removed framework import").when(t == "package_does_not_exist", "Removed unavailable import")
        .when(t == "illegal_start", "Converted invalid syntax").when(t == "unclosed_comment", "Closed unterminated block comment")
        .when(t == "class_interface_enum_expected", "Inserted missing closing brace").when(t == "missing_return", "Added default return statement")
        .when(t == "unreachable_statement", "Commented out unreachable code").when(t == "duplicate_class", "Renamed duplicate class")
        .when(t == "public_class_wrong_file", "Adjusted class visibility")
        .otherwise(F.concat(F.lit("Repaired "), F.replace("error_type", F.lit("_"), F.lit(" "))))
    )
    return notes.groupBy("run_id", label.alias("repair")).agg(F.count("*").alias("notes"))


def cost_estimate(tokens_in: Column, tokens_out: Column, in_rate_micros: int = 100_000, out_rate_micros: int = 400_000) -> Column:
    """Cost in millionths of a micro-unit: tokens times the price per million in micros."""
    return (tokens_in * F.lit(in_rate_micros) + tokens_out * F.lit(out_rate_micros)).cast("bigint")
