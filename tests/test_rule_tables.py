"""Rules as tables: the first rule of each text against brute force, and against rules written into the plan."""

import random
import re

from pyspark.sql import functions as F

from creditloom.operators.matching import first_rules, fixed_factor
from creditloom.plans import recon

RULES = "job string, place int, field string, pattern string, tolerance double"


def test_fixed_factors(spark):
    known = {
        r"CLASS\s+[1-4]\s*:": "class", r"TOTAL\s+PROV": "total", r"\d+": None, r"a|bc": None, r"ab?c": None, r"(x)": None,
        r"AMT\s*=\d+ END": " end", r"ab{2}": None, "": None, r"[^a]b": None, "é": None, r"x\.y": None,
    }
    rows = spark.createDataFrame([(p,) for p in known] + [(None,)], "p string").select("p", fixed_factor(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in rows if r.p is not None} == known


def test_first_rules_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abC1 :") for _ in range(n))
    rules = []
    for job in ("x", "y"):
        for i in range(120):
            if i % 3:
                rules.append((job, i, word(rng.choice((0, 1, 2, 3, 5, 9, 17)) if i > 40 else 6), None, float(i)))
            else:
                rules.append((job, i, None, rng.choice((r"ab\s*c", r"1\d*:", r"b|c c", r"a+b c", r"\sa[bc]+1")) if i > 60 else r"ZZ\d" + str(i), float(i)))
    rules.append(("x", 500, None, None, 1.0))
    texts = [(rng.choice("xyz"), word(rng.randrange(0, 30))) for _ in range(300)] + [("x", None), ("x", ""), ("x", "ab c"), ("x", "ab c"), ("y", "C" * 20_000)]

    def applies(text, field, pattern):
        if field is not None:
            return field.lower() in text.lower()
        return pattern is not None and re.search(pattern, text, re.IGNORECASE) is not None

    want = {}
    for job, text in texts:
        hits = [p for j, p, f, r, _ in rules if j == job and text is not None and applies(text, f, r)]
        want[job, text] = float(min(hits)) if hits else None
    got = first_rules(spark.createDataFrame(texts, "job string, text string"), spark.createDataFrame(rules, RULES), "job", ["tolerance"])
    assert {(r.job, r.text): r.tolerance for r in got.collect() if r.text is not None} == {k: v for k, v in want.items() if k[1] is not None}
    none = spark.createDataFrame([], RULES)
    assert {r.tolerance for r in first_rules(got.select("job", "text"), none, "job", ["tolerance"]).collect()} == {None}


def test_many_rules_equal_rules_in_the_plan(spark):
    lines = [("f", i, f"FIELD{i:05d} = {i * 10}", f"FIELD{i:05d} = {i * 10 + i % 3}", True, True) for i in range(40)]
    lines += [("f", 50, "noise ROW 7", "other", True, True), ("f", 51, "", "FIELD00003 = 30", False, True), ("f", 52, "TIME 12", "TIME 13", True, True)]
    pairs = spark.createDataFrame(lines, "file string, line_no bigint, baseline string, actual string, in_baseline boolean, in_actual boolean")
    few = dict(
        exact=[f"field{i:05d}" for i in range(0, 12)], tolerant={f"FIELD{i:05d}": 0.5 if i % 2 else 0.0 for i in range(10, 25)},
        ignore=["row 7", " ", "FIELD00005"], ignore_patterns=[r"TIME\s+\d+", r"FIELD00030|FIELD00031"],
    )
    rows = lambda df: sorted((r.line_no, r.kind, r.matched) for r in df.collect())
    table = recon.field_rules(spark, **few)
    assert rows(recon.compare_by_table(pairs, table)) == rows(recon.compare_by_rules(pairs, **few))
    more = recon.field_rules(spark, [f"unused{i}" for i in range(10_000)], {}, []).withColumn("position", F.col("position") + 100)
    assert rows(recon.compare_by_table(pairs, table.unionByName(more))) == rows(recon.compare_by_rules(pairs, **few))


def test_program_rules_equal_rules_in_the_plan(spark):
    lines = ["CLASS 2 : 5", "total  prov: 9", "READ : 4", "ERRORS: 1", "AMOUNT : 2", "CRT: 4", "LOANS = 1 AMT = 5", "", "CLASS 7: 1"]
    table = spark.createDataFrame([(j, t) for j in [*recon.JOB_RULES, "unknown"] for t in lines], "job string, text string")
    got = {(r.job, r.text): r.tolerance for r in recon.tolerances(table, recon.program_rules(spark)).collect()}
    for job in [*recon.JOB_RULES, "unknown"]:
        want = table.where(F.col("job") == job).select("text", recon.tolerance_for(F.col("text"), recon.JOB_RULES.get(job)).alias("t"))
        assert {r.text: r.t for r in want.collect()} == {t: got[job, t] for t in lines}
