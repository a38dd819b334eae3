"""Reconciliation of old and new outputs.

Line tables have (file, line_no, text); every comparison is keyed by
(file, line_no), so one huge file spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import text as tx
from creditloom.functions.pic import idiv
from creditloom.operators.matching import first_rules, longest_literal
from creditloom.operators.ordered import dense_ids, first_n, previous, row_numbers
from creditloom.session import cut
from creditloom.sources.layouts import Field

# Comparison defaults, summary lines, menu words.
DEFAULT_TOLERANCE = 0.001
LOANS_LINE = r"(?i)LOANS=(\d+)"
CLASS_LINE = r"(?i)CLASS\s+(\d+)\s+LOANS:\s*(\d+)"
MENU_WORDS = ("menu", "choice", "invalid", "option", "select", "enter", "prompt")

# Built-in rules per job: label patterns that must match exactly,
# and label patterns with their own tolerance.
JOB_RULES = {
    "classification": ([r"CLASS\s+[1-4]\s*:"], [(r"TOTAL\s+PROV", 0.0001)]),
    "evaluation": (
        [r"READ\s*:", r"APPROVED\s*:", r"CONDITIONAL\s*:", r"DECLINED\s*:"],
        [(r"ERRORS\s*:", 0.01)],
    ),
    "recovery": (
        [r"CLASS\s+\d\s+LOANS\s*:", r"SMS\s*:", r"EMAIL\s*:", r"PHONE\s*:", r"DUL\s*:", r"LEG\s*:", r"GTR\s*:",
         r"RST\s*:", r"CRT\s*:", r"CSZ\s*:", r"WOF\s*:"],
        [(r"AMOUNT\s*:", 0.0001)],
    ),
    "monthly": ([r"LOANS\s*="], [(r"AMT\s*=", 0.0001)]),
}

# Named counters of each job's output.
METRICS = {
    "classification": [
        ("CLASS_1_count", r"(?i)CLASS\s+1\s*:\s*(\d+)"), ("CLASS_2_count", r"(?i)CLASS\s+2\s*:\s*(\d+)"),
        ("CLASS_3_count", r"(?i)CLASS\s+3\s*:\s*(\d+)"), ("CLASS_4_count", r"(?i)CLASS\s+4\s*:\s*(\d+)"),
        ("TOTAL_PROVISION", r"(?i)TOTAL\s+PROV\s*:\s*(\d+)"),
    ],
    "evaluation": [
        ("read_count", r"(?i)READ\s*:\s*(\d+)"), ("approved_count", r"(?i)APPROVED\s*:\s*(\d+)"),
        ("conditional_count", r"(?i)CONDITIONAL\s*:\s*(\d+)"), ("declined_count", r"(?i)DECLINED\s*:\s*(\d+)"),
        ("errors_count", r"(?i)ERRORS\s*:\s*(\d+)"),
    ],
    "recovery": [
        ("class_2_count", r"(?i)CLASS\s+2\s+LOANS\s*:\s*(\d+)"), ("class_3_count", r"(?i)CLASS\s+3\s+LOANS\s*:\s*(\d+)"),
        ("class_4_count", r"(?i)CLASS\s+4\s+LOANS\s*:\s*(\d+)"),
        *[(f"action_{a}", rf"(?i){a}\s*:\s*(\d+)") for a in
          ("SMS", "EMAIL", "PHONE", "DUL", "LEG", "GTR", "RST", "CRT", "CSZ", "WOF")],
    ],
    "monthly": [("total_loans", r"(?i)LOANS\s*=\s*(\d+)"), ("total_outstanding", r"(?i)AMT\s*=\s*(\d+)")],
}


# --- lines -------------------------------------------------------------------

def collapse_blanks(lines: DataFrame) -> DataFrame:
    """Trailing blanks cut, runs of blank lines made one, blank edges dropped, re-numbered."""
    base = lines.select("file", "line_no", F.regexp_replace("text", r"\s+$", "").alias("text"))
    base = base.withColumn("_blank", F.col("text") == "")
    # Places without gaps make full blocks; what follows reads the written rows.
    base = dense_ids(base, [F.col("file"), F.col("line_no")], "_at")
    seen = previous(base, ["file"], "_at", "_prev", F.col("_blank"))
    kept = seen.where(~(F.col("_blank") & F.coalesce("_prev", F.lit(True))))
    last = base.where(~F.col("_blank")).groupBy("file").agg(F.max("_at").alias("_last"))
    kept = cut(kept.join(last, "file").where(F.col("_at") <= F.col("_last")))
    out = row_numbers(kept, ["file"], "_at", "new_no")
    return out.select("file", F.col("new_no").alias("line_no"), "text")


def ignore_lines(lines: DataFrame, fields: list[str], patterns: list[str]) -> DataFrame:
    """Drop lines holding an ignore field (any case) or matching a pattern (any case)."""
    drop = F.lit(False)
    for f in fields:
        if f.strip():
            drop = drop | F.lower("text").contains(f.strip().lower())
    for p in patterns:
        if p.strip():
            drop = drop | F.col("text").rlike("(?i)" + p)
    return lines.where(~drop)


def pair_lines(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Line n with line n; the missing side is empty and its flag is false."""
    b = baseline.select("file", "line_no", F.col("text").alias("b_text"))
    a = actual.select("file", "line_no", F.col("text").alias("a_text"))
    j = b.join(a, ["file", "line_no"], "full")
    return j.select(
        "file", "line_no", F.coalesce("b_text", F.lit("")).alias("baseline"), F.coalesce("a_text", F.lit("")).alias("actual"),
        F.col("b_text").isNotNull().alias("in_baseline"), F.col("a_text").isNotNull().alias("in_actual"),
    )


def summary_line_match(b: Column, a: Column) -> Column:
    """LOANS= and CLASS n LOANS lines agree on their counts alone."""
    get = lambda s, p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    klass = (get(b, CLASS_LINE, 1) == get(a, CLASS_LINE, 1)) & (get(b, CLASS_LINE, 2) == get(a, CLASS_LINE, 2))
    total = get(b, LOANS_LINE, 1) == get(a, LOANS_LINE, 1)
    return F.coalesce(klass, F.lit(False)) | F.coalesce(total, F.lit(False))


def cosmetic_match(b: Column, a: Column) -> Column:
    return summary_line_match(b, a) | (tx.cosmetic(b) == tx.cosmetic(a))


def date_only(b: Column, a: Column) -> Column:
    return tx.without_dates(b) == tx.without_dates(a)


def with_numbers(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {"b_nums": tx.extract_numbers(F.col("baseline")), "a_nums": tx.extract_numbers(F.col("actual"))}
    )


def compare_exact(pairs: DataFrame) -> DataFrame:
    """matched when equal after trimming."""
    return pairs.withColumn("matched", tx.strip(F.col("baseline")) == tx.strip(F.col("actual")))


def tolerance_for(line: Column, rules: tuple[list[str], list[tuple[str, float]]] | None) -> Column:
    """Tolerance of a line under one job's built-in rules."""
    out = None
    if rules:
        exact, tolerant = rules
        for p, t in [(p, 0.0) for p in exact] + tolerant:
            test = line.rlike("(?i)" + p)
            out = F.when(test, t) if out is None else out.when(test, t)
    return F.lit(DEFAULT_TOLERANCE) if out is None else out.otherwise(DEFAULT_TOLERANCE)


def compare_tolerant(pairs: DataFrame, job: str | None = None) -> DataFrame:
    """kind: exact, date or tolerant for matches, else the reason of the mismatch."""
    b, a = F.col("baseline"), F.col("actual")
    tol = F.when(b == "", DEFAULT_TOLERANCE).otherwise(tolerance_for(b, JOB_RULES.get(job) if job else None))
    p = with_numbers(pairs).withColumn("_tol", tol)
    nb, na = F.size("b_nums"), F.size("a_nums")
    kind = (
        F.when((tx.strip(b) == tx.strip(a)) | cosmetic_match(b, a), "exact")
        .when(date_only(b, a), "date")
        .when((nb == 0) & (na == 0), "text differs")
        .when(nb != na, "number count differs")
        .when(~tx.within_tolerance(F.col("b_nums"), F.col("a_nums"), F.col("_tol")), "numeric mismatch")
        .when(tx.line_skeleton(b) != tx.line_skeleton(a), "text skeleton differs")
        .otherwise("tolerant")
    )
    return p.select(*pairs.columns, kind.alias("kind")).withColumn(
        "matched", F.col("kind").isin("exact", "date", "tolerant")
    )


def program_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table (job, kind, pattern, tolerance, position)."""
    rows = []
    for job, (exact, tolerant) in JOB_RULES.items():
        rows += [(job, "exact", p, 0.0, i) for i, p in enumerate(exact)]
        rows += [(job, "tolerant", p, t, i) for i, (p, t) in enumerate(tolerant)]
    return spark.createDataFrame(rows, "job string, kind string, pattern string, tolerance double, position int")


def compare_by_rules(
    pairs: DataFrame, exact: list[str], tolerant: dict[str, float], ignore: list[str], ignore_patterns: list[str] | None = None,
    default: float = DEFAULT_TOLERANCE, normalize_space: bool = True,
) -> DataFrame:
    """Field rules per line: ignored, exact, tolerant, default; first group that applies decides.

    The tolerant and default paths compare numbers only.
    """
    b, a = F.col("baseline"), F.col("actual")
    has = lambda f: F.lower(b).contains(f.lower()) | F.lower(a).contains(f.lower())
    any_of = lambda tests: _or(tests)
    skip = any_of([has(f.strip()) for f in ignore if f.strip()] + [b.rlike("(?i)" + p) | a.rlike("(?i)" + p) for p in ignore_patterns or []])
    is_exact = any_of([has(f) for f in exact])
    tol = None
    for f, t in tolerant.items():
        tol = F.when(has(f), t) if tol is None else tol.when(has(f), t)
    tol = F.lit(None).cast("double") if tol is None else tol
    return _kinds_by_rules(pairs, skip, is_exact, tol, default, normalize_space)


def _kinds_by_rules(pairs: DataFrame, skip: Column, is_exact: Column, tol: Column, default: float, normalize_space: bool) -> DataFrame:
    """Kind of each pair, by the first group of rules that applies to it."""
    b, a = F.col("baseline"), F.col("actual")
    columns = [c for c in pairs.columns if not c.startswith("_rule_")]
    same = cosmetic_match(b, a) if normalize_space else summary_line_match(b, a) | (b == a)
    p = with_numbers(pairs).withColumn("_tol", tol)
    limit = F.coalesce("_tol", F.lit(default))
    numeric = (
        cosmetic_match(b, a) | date_only(b, a)
        | ((F.size("b_nums") > 0) & tx.within_tolerance(F.col("b_nums"), F.col("a_nums"), limit))
    )
    kind = (
        F.when(skip, "ignored").when(is_exact & same, "exact").when(is_exact, "exact mismatch")
        .when(F.col("_tol").isNotNull() & numeric, "tolerant").when(F.col("_tol").isNotNull(), "outside tolerance")
        .when(numeric, "default").otherwise("default tolerance failed")
    )
    return p.select(*columns, kind.alias("kind")).withColumn(
        "matched", F.col("kind").isin("ignored", "exact", "tolerant", "default")
    )


def field_rules(
    spark: SparkSession, exact: list[str], tolerant: dict[str, float], ignore: list[str], ignore_patterns: list[str] | None = None,
) -> DataFrame:
    """Rules of ``compare_by_rules`` as a table (job, kind, field, pattern, tolerance, position); the job is empty: any."""
    rows = [("", "ignore", f.strip(), None, None, i) for i, f in enumerate(ignore) if f.strip()]
    rows += [("", "ignore", None, p, None, len(ignore) + i) for i, p in enumerate(ignore_patterns or [])]
    rows += [("", "exact", f, None, 0.0, i) for i, f in enumerate(exact)]
    rows += [("", "tolerant", f, None, t, i) for i, (f, t) in enumerate(tolerant.items())]
    return spark.createDataFrame(rows, "job string, kind string, field string, pattern string, tolerance double, position int")


#: Kinds of rules in the order in which they apply.
RULE_KINDS = ("ignore", "exact", "tolerant")


def _placed(rules: DataFrame) -> DataFrame:
    """Rules with their place in the order: by kind, then by position."""
    rank = F.array_position(F.array(*[F.lit(k) for k in RULE_KINDS]), F.col("kind"))
    known = rules.where(F.col("kind").isin(*RULE_KINDS))
    field = F.col("field") if "field" in rules.columns else F.lit(None).cast("string")
    place = F.struct(rank.alias("rank"), "position")
    return known.select("job", field.alias("field"), "pattern", "tolerance", rank.cast("int").alias("rank"), place.alias("place"))


def compare_by_table(pairs: DataFrame, rules: DataFrame, default: float = DEFAULT_TOLERANCE, normalize_space: bool = True) -> DataFrame:
    """``compare_by_rules`` with any number of rules, given as a table.

    ``rules(job, kind, field, pattern, tolerance, position)`` as ``field_rules`` makes them; rules with other kinds are left out.
    Lines are judged under rules of the empty job, or of their own where ``pairs`` has a column ``job``.  A rule applies if it
    does to either side; positions are unique within a job and kind.
    """
    named = pairs.withColumn("_rule_job", F.coalesce("job", F.lit("")) if "job" in pairs.columns else F.lit(""))
    texts = named.select(F.col("_rule_job").alias("job"), F.explode(F.array("baseline", "actual")).alias("text"))
    found = first_rules(texts, _placed(rules), "job", ["rank", "tolerance", "place"])
    side = lambda s: found.select(F.col("job").alias("_rule_job"), F.col("text").alias(s), F.struct("place", "rank", "tolerance").alias(f"_rule_{s}"))
    j = named.join(side("baseline"), ["_rule_job", "baseline"], "left").join(side("actual"), ["_rule_job", "actual"], "left")
    has = lambda s: F.when(F.col(f"_rule_{s}.rank").isNotNull(), F.col(f"_rule_{s}"))
    j = j.withColumn("_rule_best", F.least(has("baseline"), has("actual")))  # structs compare by place
    rank = F.coalesce("_rule_best.rank", F.lit(0))
    tol = F.when(rank == 3, F.col("_rule_best.tolerance"))
    out = _kinds_by_rules(j, rank == 1, rank == 2, tol, default, normalize_space)
    return out.select(*pairs.columns, "kind", "matched")


def tolerances(lines: DataFrame, rules: DataFrame, default: float = DEFAULT_TOLERANCE) -> DataFrame:
    """``lines(job, text, ...)`` with the tolerance of the first rule of their job, exact rules before tolerant ones."""
    found = first_rules(lines, _placed(rules), "job", ["tolerance"])
    j = lines.join(found.hint("merge"), ["job", "text"], "left")
    return j.select(*lines.columns, F.coalesce("tolerance", F.lit(default)).alias("tolerance"))


def _or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def line_count_rule(pairs: DataFrame) -> DataFrame:
    """Per file: line counts of both sides and whether they agree."""
    return pairs.groupBy("file").agg(
        F.count_if(F.col("in_baseline")).alias("baseline_lines"), F.count_if(F.col("in_actual")).alias("actual_lines")
    ).withColumn("same_count", F.col("baseline_lines") == F.col("actual_lines"))


def diff_stats(compared: DataFrame) -> DataFrame:
    """Per file: compared, matched, diverged, percent (scale 2, half up), first mismatch (0-based)."""
    bad = F.count_if(~F.col("matched"))
    agg = compared.groupBy("file").agg(
        F.count("*").alias("lines_compared"), F.count_if(F.col("matched")).alias("lines_matched"), bad.alias("lines_diverged"),
        (F.min(F.when(~F.col("matched"), F.col("line_no"))) - 1).alias("first_mismatch"),
    )
    d, n = F.col("lines_diverged"), F.col("lines_compared")
    return agg.withColumn("diff_pct_e2", idiv(F.lit(20_000) * d + n, F.lit(2) * n))


def compare_outputs(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Normalized comparison per file: blanks collapsed on both sides, lines paired, matched after trimming, counted.

    A blank line more or less does not shift what follows.  Files on one side only diverge in every line; files of
    blank lines have no lines to compare and give no row.
    """
    return diff_stats(compare_exact(pair_lines(collapse_blanks(baseline), collapse_blanks(actual))))


def mismatch_highlights(compared: DataFrame, n: int = 50) -> DataFrame:
    """First n mismatches per file."""
    return first_n(compared.where(~F.col("matched")), ["file"], [F.col("line_no")], n)


def line_multiset_diff(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Lines found more often on one side, with the surplus; order is ignored."""
    clean = lambda df, s: df.select("file", F.regexp_replace("text", r"\s+$", "").alias("text"), F.lit(s).alias("s"))
    both = clean(baseline, 1).unionByName(clean(actual, -1)).where(F.col("text") != "")
    net = both.groupBy("file", "text").agg(F.sum("s").alias("n")).where(F.col("n") != 0)
    return net.select(
        "file", "text", F.when(F.col("n") > 0, "-").otherwise("+").alias("side"), F.abs("n").cast("bigint").alias("copies")
    )


def same_lines_other_order(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Per file: same non-blank lines as a multiset, and same sequence."""
    numbered = []
    for df, s in ((baseline, 1), (actual, -1)):
        rows = row_numbers(df.where(tx.strip(F.col("text")) != ""), ["file"], "line_no", "n")
        numbered.append(rows.select("file", "n", "text", F.lit(s).alias("s"), (F.lit(s) > 0).alias("is_b")))
    both = numbered[0].unionByName(numbered[1])
    per_text = both.groupBy("file", "text").agg(
        F.sum("s").alias("d"), F.count_if(F.col("is_b")).alias("nb"), F.count_if(~F.col("is_b")).alias("na")
    )
    bag = per_text.groupBy("file").agg(
        (F.count_if(F.col("d") != 0) == 0).alias("same_bag"), F.sum("nb").alias("nb"), F.sum("na").alias("na")
    )
    per_place = both.groupBy("file", "n", "text").agg(F.sum("s").alias("d"))
    seq = per_place.groupBy("file").agg((F.count_if(F.col("d") != 0) == 0).alias("same_sequence"))
    return bag.join(seq, "file").select(
        "file", "same_bag", "same_sequence",
        (F.col("same_bag") & ~F.col("same_sequence") & (F.col("nb") > 0) & (F.col("na") > 0)).alias("order_mismatch"),
    )


def failure_kind(compared: DataFrame, order: DataFrame) -> DataFrame:
    """Why a file fails, from its first mismatch."""
    first = F.min_by(F.struct("baseline", "actual"), F.when(~F.col("matched"), F.col("line_no")))
    agg = compared.groupBy("file").agg(
        first.alias("f"), F.count_if(~F.col("matched")).alias("bad"), F.count_if(F.col("in_baseline")).alias("nb"),
        F.count_if(F.col("in_actual")).alias("na"),
    )
    j = agg.where(F.col("bad") > 0).join(order.select("file", "order_mismatch"), "file", "left")
    b, a = tx.strip(F.col("f.baseline")), tx.strip(F.col("f.actual"))
    both = F.lower(F.concat_ws(" ", F.col("f.baseline"), F.col("f.actual")))
    fewer, more = F.col("na") < F.col("nb"), F.col("na") > F.col("nb")
    kind = (
        F.when(F.coalesce("order_mismatch", F.lit(False)), "order_mismatch")
        .when((b != "") & (a == ""), F.when(fewer, "missing_new_line").otherwise("content_mismatch"))
        .when((a != "") & (b == ""), F.when(more, "extra_new_line").otherwise("missing_old_line"))
        .when(more, "extra_new_line").when(fewer, "extra_old_line")
        .when(_or([both.contains(w) for w in MENU_WORDS]), "menu_branch_mismatch")
        .otherwise("content_mismatch")
    )
    return j.select("file", kind.alias("failure_kind"))


def attribute_mismatch(mismatches: DataFrame, literals: DataFrame, paragraphs: DataFrame, totals: DataFrame) -> DataFrame:
    """Owner paragraph of each mismatch: longest display literal, else the proportional place.

    ``mismatches(file, line_no, text)``, ``literals(file, owner, literal,
    position)``, ``paragraphs(file, place, paragraph)`` with place from 0, and
    ``totals(file, lines)``.
    """
    hit = longest_literal(mismatches, literals, "file").select("file", "text", "owner")
    n_par = paragraphs.groupBy("file").agg(F.count("*").alias("n_par"))
    j = mismatches.join(hit.hint("merge"), ["file", "text"], "left").join(totals, "file", "left").join(n_par, "file", "left")
    idx, span = F.col("line_no") - 1, F.greatest(F.col("lines") - 1, F.lit(1))
    place = F.when(F.col("lines") == 1, F.lit(0)).otherwise(
        F.least(idiv(idx * F.col("n_par"), span), F.col("n_par") - 1)
    )
    j = j.withColumn("place", F.when(F.col("owner").isNull(), place))
    out = j.join(paragraphs.withColumnRenamed("paragraph", "_by_place"), ["file", "place"], "left")
    return out.select(
        "file", "line_no", F.coalesce("owner", "_by_place").alias("paragraph"),
        F.when(F.col("owner").isNotNull(), "display_literal").when(F.col("_by_place").isNotNull(), "proportional").otherwise("none").alias("method"),
    )


# --- status ------------------------------------------------------------------

def run_status(compared: Column, matched: Column, diverged: Column) -> Column:
    return (
        F.when(compared <= 0, "not_run").when(diverged == 0, "passed").when(matched > 0, "partial").otherwise("failed")
    )


def merge_status(files: DataFrame, group: str, status: str = "status") -> DataFrame:
    """Project status from file statuses."""
    s = F.col(status)
    n = {k: F.count_if(s == k).alias(f"n_{k}") for k in ("passed", "partial", "failed", "not_run")}
    agg = files.groupBy(group).agg(F.count_if(s != "skipped").alias("work"), *n.values())
    c = F.col
    merged = (
        F.when(c("work") == 0, "failed").when(c("n_not_run") == c("work"), "not_run").when(c("n_passed") == c("work"), "passed")
        .when(c("n_failed") > 0, "failed").when((c("n_partial") > 0) | ((c("n_passed") > 0) & (c("n_not_run") > 0)), "partial")
        .otherwise("failed")
    )
    return agg.select(group, c("work").alias("files"), merged.alias("status"))


# --- metrics -----------------------------------------------------------------

def key_metrics(lines: DataFrame, job: str) -> DataFrame:
    """First value of each named counter per file: (file, metric, value)."""
    found = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("raw")) for m, p in METRICS[job]]
    )
    hits = lines.select("file", "line_no", F.explode(F.filter(found, lambda x: x["raw"].isNotNull())).alias("m"))
    return hits.groupBy("file", F.col("m.metric").alias("metric")).agg(
        F.min_by(F.col("m.raw"), "line_no").cast("decimal(38,0)").cast("bigint").alias("value")
    )


def diff_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (file, metric, value) against actual values; a missing one fails."""
    j = expected.select("file", "metric", F.col("value").alias("expected")).join(
        actual.select("file", "metric", F.col("value").alias("actual")), ["file", "metric"], "left"
    )
    return j.withColumn("matched", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


# --- records -----------------------------------------------------------------

def diff_records(baseline: DataFrame, actual: DataFrame) -> DataFrame:
    """Record by record, ignoring trailing blanks."""
    pairs = pair_lines(baseline, actual)
    cut_tail = lambda c: F.regexp_replace(c, r"\s+$", "")
    return pairs.withColumn("matched", cut_tail("baseline") == cut_tail("actual"))


def mask_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    """Blank out [start, end) character ranges, 0-based."""
    for start, end in ranges:
        filler = F.repeat(F.lit("#"), F.greatest(F.least(F.lit(end), F.length(c)) - start, F.lit(0)))
        c = F.when(F.length(c) > start, F.overlay(c, filler, F.lit(start + 1))).otherwise(c)
    return c


def diff_records_masked(baseline: DataFrame, actual: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Record by record with ignored ranges; missing records do not match."""
    pairs = pair_lines(baseline, actual)
    same = mask_ranges(F.col("baseline"), ranges) == mask_ranges(F.col("actual"), ranges)
    return pairs.withColumn("matched", F.col("in_baseline") & F.col("in_actual") & same)


def record_count_rule(compared: DataFrame) -> DataFrame:
    """Per file: same record count and every record equal."""
    return compared.groupBy("file").agg(
        F.count_if(F.col("in_baseline")).alias("expected_records"), F.count_if(F.col("in_actual")).alias("actual_records"),
        F.count_if(~F.col("matched")).alias("different_records"),
    ).withColumn(
        "matched", (F.col("expected_records") == F.col("actual_records")) & (F.col("different_records") == 0)
    )


def diff_fields(baseline: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: compared rows and equal rows over a key join; rows on one side only differ."""
    b = baseline.select(key, F.struct(*columns).alias("b"))
    a = actual.select(key, F.struct(*columns).alias("a"))
    j = b.join(a, key, "full")
    counts = j.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("b").isNotNull() & F.col("a").isNotNull() & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(f"eq_{c}") for c in columns],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"eq_{c}").alias("equal_rows")) for c in columns])
    return counts.select("n", F.explode(rows).alias("r")).select(
        F.col("r.field").alias("field"), F.col("n").alias("rows_compared"), F.col("r.equal_rows").alias("equal_rows")
    )


def layout_fields(fields: list[Field]) -> list[str]:
    return [f.name for f in fields if f.kind != "-" and "." not in f.name]


def diff_directory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Checks (program, item, digest) of two runs: total, matches, mismatches, missing."""
    e = expected.select("program", "item", F.col("digest").alias("e"))
    a = actual.select("program", "item", F.col("digest").alias("a"), F.lit(True).alias("_a"))
    j = e.join(a, ["program", "item"], "left")
    there = F.col("_a").isNotNull()
    return j.groupBy("program").agg(
        F.count("*").alias("total"), F.count_if(there & F.col("e").eqNullSafe(F.col("a"))).alias("matches"),
        F.count_if(there & ~F.col("e").eqNullSafe(F.col("a"))).alias("mismatches"), F.count_if(~there).alias("missing"),
    )


# --- JSON --------------------------------------------------------------------

def _kind(v: str) -> Column:
    """Type family of a variant value; no value at all counts as null, whole numbers beyond 64 bits as int."""
    s = F.schema_of_variant(F.col(v))
    return (
        F.when(F.col(v).isNull(), "NoneType").when(s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int").when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").when(s == "STRING", "str")
        .when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int").when(s == "VOID", "NoneType").otherwise("float")
    )


def diff_json(pairs: DataFrame) -> DataFrame:
    """Path-wise differences of ``pairs(doc_id, expected, actual)`` JSON texts.

    Both documents are walked together one nesting level per step, all
    documents at once; the walk ends when no containers are left.  Children
    meet by their steps, so keys may hold dots and brackets.  A NULL text counts
    as null; a pair with a text that is no JSON gives one row of kind
    ``unparsed`` that says which side is invalid (compare such pairs by line).
    """
    read = pairs.select("doc_id", "expected", "actual", F.try_parse_json("expected").alias("e"), F.try_parse_json("actual").alias("a"))
    bad = lambda text, v: F.col(text).isNotNull() & F.col(v).isNull()
    broken = bad("expected", "e") | bad("actual", "a")
    verdict = lambda text, v: F.when(bad(text, v), "invalid").otherwise("valid")
    out = read.where(broken).select(
        "doc_id", F.lit("$").alias("path"), F.lit("unparsed").alias("kind"), verdict("expected", "e").alias("expected"), verdict("actual", "a").alias("actual")
    )
    front = read.where(~broken).select("doc_id", F.lit("").alias("path"), F.array().cast("array<string>").alias("steps"), "e", "a")
    while True:
        typed = cut(front.withColumns({"ek": _kind("e"), "ak": _kind("a")}))
        at = F.when(F.col("path") == "", "$").otherwise(F.col("path"))
        same = F.col("ek") == F.col("ak")
        leaf = same & ~F.col("ek").isin("dict", "list")
        to_s = lambda c: F.to_json(F.col(c))
        here = typed.where(~same | (leaf & ~to_s("e").eqNullSafe(to_s("a")))).select(
            "doc_id", at.alias("path"), F.when(same, "value").otherwise("type").alias("kind"),
            F.when(same, to_s("e")).otherwise(F.col("ek")).alias("expected"), F.when(same, to_s("a")).otherwise(F.col("ak")).alias("actual"),
        )
        inner = typed.where(same & F.col("ek").isin("dict", "list"))
        if inner.isEmpty():
            return out.unionByName(here)

        def children(side: str) -> DataFrame:
            ex = inner.sparkSession.sql(
                f"SELECT doc_id, path, steps, ek, x.pos, x.key, x.value AS {side}v FROM {{front}}, LATERAL variant_explode({side}) x",
                front=inner,
            )
            p = F.col("path")
            child = F.when(F.col("ek") == "list", F.concat(p, F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
                F.when(p == "", F.col("key")).otherwise(F.concat(p, F.lit("."), F.col("key")))
            )
            step = F.when(F.col("ek") == "list", F.col("pos").cast("string")).otherwise(F.col("key"))
            return ex.select(
                "doc_id", F.array_append("steps", step).alias("steps"), child.alias(f"{side}_path"), F.col("path").alias(f"{side}_up"),
                F.col("ek").alias(f"{side}_ek"), f"{side}v",
            )

        both = cut(children("e").join(children("a"), ["doc_id", "steps"], "full").withColumn("cpath", F.coalesce("e_path", "a_path")))
        one_side = both.where(F.col("ev").isNull() | F.col("av").isNull())
        in_dict = F.coalesce("e_ek", "a_ek") == "dict"
        none = F.lit(None).cast("string")
        keys = one_side.where(in_dict).select(
            "doc_id", F.col("cpath").alias("path"), F.when(F.col("av").isNull(), "missing").otherwise("extra").alias("kind"),
            none.alias("expected"), none.alias("actual"),
        )
        up = F.coalesce("e_up", "a_up")
        owner = F.slice("steps", 1, F.size("steps") - 1)
        lens = both.where(~in_dict).groupBy("doc_id", owner.alias("owner"), up.alias("path")).agg(F.count("ev").alias("n"), F.count("av").alias("m"))
        # An empty list on one side has no children there, so counts still differ.
        sizes = lens.where(F.col("n") != F.col("m")).select(
            "doc_id", F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), F.lit("length").alias("kind"),
            F.col("n").cast("string").alias("expected"), F.col("m").cast("string").alias("actual"),
        )
        found = here.unionByName(keys).unionByName(sizes)
        out = out.unionByName(found)
        front = both.where(F.col("ev").isNotNull() & F.col("av").isNotNull()).select(
            "doc_id", F.col("cpath").alias("path"), "steps", F.col("ev").alias("e"), F.col("av").alias("a")
        )
