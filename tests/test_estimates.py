"""Plans must not broadcast rows whose number the planner cannot know."""

import re

import pytest
from pyspark.sql import functions as F

from creditloom.catalog import adapters
from creditloom.operators import matching
from creditloom.plans import estate, jcl, recon

ROWS = "/root/testdata/sf0.001"


def broadcasts(df):
    """Broadcast joins of the plan as first made, before any stage has run."""
    return len(re.findall("BroadcastHashJoin", df._jdf.queryExecution().sparkPlan().toString()))


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.mark.parametrize("name", list(adapters.TEXTS))
def test_lines_are_not_taken_for_less_than_they_are(spark, name):
    lines = adapters.view(spark, ROWS, name)
    assert estimate(lines) >= lines.agg(F.sum(F.length("file") + 8 + F.length("text"))).first()[0]
    assert [r.line_no for r in lines.where(F.col("file") == lines.first().file).orderBy("line_no").collect()] == list(range(1, len(adapters.TEXTS[name][2]) + 1))


def test_exploded_pieces_are_merged(spark):
    n = spark.range(50).select(F.col("id").cast("string").alias("name"))
    assert broadcasts(matching.fuzzy_match(n, n.select(F.col("name").alias("candidate"), F.lit(1).alias("position")))) == 0


def test_longest_literal_of_few_and_many_lengths(spark):
    lines = spark.range(50).select(F.lit("f").alias("file"), F.concat(F.lit("say HELLO "), "id").alias("text"))
    rows = [("f", "a", "hello 1", 1), ("f", "b", "Hello 12", 2), ("f", "c", "o", 3), ("f", "d", "hello 1", 0), ("g", "e", "hello 13", 1)]
    rows += [("f", f"n{i}", "say hello 4" + "x" * i, 9) for i in range(20)]  # more lengths than a head may have
    found = matching.longest_literal(lines, spark.createDataFrame(rows, "file string, owner string, literal string, position int"), "file")
    got = {r.text: (r.owner, r.literal_len) for r in found.collect()}
    assert len(got) == 50 and got["say HELLO 12"] == ("b", 8) and got["say HELLO 13"] == ("d", 7) and got["say HELLO 2"] == ("c", 1) and got["say HELLO 45"] == ("n0", 11)


def test_rules_are_broadcast_and_texts_are_not(spark):
    lines = spark.range(50).select(F.lit("classification").alias("job"), F.concat(F.lit("CLASS 1 : "), "id").alias("text"))
    plan = recon.tolerances(lines, recon.program_rules(spark))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in text and {r.tolerance for r in plan.collect()} == {0.0}


def test_marks_of_lines_are_filled_once(spark):
    plan = estate.code_lines(adapters.view(spark, ROWS, "source_line"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!regexp_)replace\(", plan)) == len(adapters.PROGRAM_MARKS)


def test_calls_of_a_slice_are_computed_once(spark):
    calls = spark.createDataFrame([("f", "A", "B"), ("f", "B", "C")], "file string, src string, dst string").withColumn("dst", F.regexp_replace("dst", "x", "y"))
    pars = spark.createDataFrame([("f", "A", 1), ("f", "B", 2), ("f", "C", 3)], "file string, paragraph string, line_no bigint")
    found = estate.impact_slice(pars.select("file", F.col("paragraph").alias("target")), calls, pars)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.target, r.paragraph, r.role) for r in found.collect()} == {("A", "A", "target"), ("A", "B", "callee"), ("B", "B", "target"), ("B", "C", "callee"), ("B", "A", "caller"), ("C", "C", "target"), ("C", "B", "caller"), ("C", "A", "entry")}


def test_lines_are_squeezed_once(spark):
    plan = estate.code_lines(adapters.view(spark, ROWS, "source_line"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) <= 2  # the code and its upper case, which share it; none in the filter
    odd = spark.createDataFrame([("f", i, " " * 6 + t) for i, t in enumerate(["  \t\x0b\f\r ", "", " \u00a0 ", " X \t Y ", "*X"])], "file string, line_no int, text string")
    assert {r.line_no: r.code for r in estate.code_lines(odd).collect()} == {2: "\u00a0", 3: "X Y"}


def test_file_lines_alone_are_dealt(spark):
    """Lines that say nothing of files are gone before rows are dealt, and the code is computed once."""
    text = ["FILE-CONTROL.", "SELECT A", "ASSIGN TO 'X'", "MOVE 1 TO B.", "RECORD KEY IS K1", "ALTERNATE RECORD KEY K2", "SELECT B ASSIGN Y INDEXED", "DATA DIVISION.", "FD A.", "05 KEY-1 PIC X.", "SD C", "ASSIGN TO Z"]
    code = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string").select("file", "line_no", F.regexp_replace("text", "@", "").alias("upper"))
    found = estate.file_bindings(code)
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("f", "A", "X", "FD", "K1", "K2", False), ("f", "B", "Y", None, None, None, True), ("f", "C", None, "SD", None, None, False)}


def test_edges_of_lineage_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([("DSN:A", "PGM:P"), ("PGM:P", "DSN:B"), ("DSN:B", "PGM:Q"), ("PGM:Q", "DSN:C")], "src string, dst string")
    edges = edges.select(F.udf(told)("src").alias("src"), "dst")
    assert {tuple(r) for r in jcl.data_lineage(edges).collect()} == {("A", "B", 1), ("A", "C", 2), ("B", "C", 1)} and seen.value == 4


@pytest.mark.parametrize("name", list(adapters.TEXTS))
def test_marks_are_filled_before_the_loop_over_lines(spark, name):
    """Without a condition that reads the filled lines, generated code fills the text anew for each of its lines."""
    lines = adapters.view(spark, ROWS, name)
    for read in (lines, lines.groupBy("file").agg(F.max("text")), lines.where(F.col("file") != "PGM1").select("text")):
        assert re.search(r"Join Inner, .*_lines", read._jdf.queryExecution().optimizedPlan().toString())
    assert lines.select("file", "line_no").distinct().count() == lines.count() == lines.select("file").distinct().count() * len(adapters.TEXTS[name][2])
