"""Job control inventory: steps, datasets, step conditions and data lineage.

Input lines are (file, line_no, text) of job decks, one deck per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.graph import reach, strong_components
from creditloom.operators.ordered import fill_forward, previous, running
from creditloom.plans.estate import _hit, join_continuations
from creditloom.session import cut

# Statement patterns of a job deck.
# Names are read whole: the first eight characters of a longer one may be the name of another program.
ID = r"[A-Z0-9@#$]+"
CONTINUED = r"^//\s{9,}(?!\s*DD\s)"
JOB = rf"(?i)^//({ID})\s+JOB\b"
EXEC_PGM = rf"(?i)^//({ID})\s+EXEC\s+PGM=({ID})"
EXEC_PROC = rf"(?i)^//({ID})\s+EXEC\s+(?!PGM=)({ID})"
PARM = r"(?i)PARM='([^']*)'"
COND = rf"(?i)COND=\((\d+),([A-Z]+)(?:,({ID}))?\)"
DD = rf"(?i)^//({ID})\s+DD\s+(.*)"
DD_MORE = r"(?i)^//\s+DD\s+(.*)"
DSN = r"(?i)DSN=([^,\s]+)"
DISP = r"(?i)DISP=(\([^)]+\)|[^,\s]+)"


def statements(lines: DataFrame) -> DataFrame:
    """Logical statements: comments and inline data dropped, continuations joined."""
    t = F.rtrim("text")
    src = lines.select("file", "line_no", t.alias("text"))
    is_jcl = F.col("text").startswith("//") | F.col("text").startswith("/*")
    src = src.where(is_jcl & ~F.col("text").startswith("//*"))
    cont = F.col("text").rlike(CONTINUED)
    return join_continuations(src, cont, F.ltrim(F.expr("substring(text, 3)")), ["file"])


def with_step(stmts: DataFrame) -> DataFrame:
    """Each statement with its job and step, and the DD it belongs to."""
    t = F.col("text")
    step = F.coalesce(_hit(t, EXEC_PGM), _hit(t, EXEC_PROC))
    is_exec = step.isNotNull()
    dd = F.when(is_exec, F.lit("")).when(~t.rlike(EXEC_PGM), _hit(t, DD))
    return fill_forward(
        stmts, ["file"], "line_no",
        {"job": F.upper(_hit(t, JOB)), "step": F.upper(step), "step_line": F.when(is_exec, F.col("line_no")), "dd": F.upper(dd)},
    )


def jcl_steps(stmts: DataFrame) -> DataFrame:
    """Job, step, program or procedure, PARM and COND."""
    t = F.col("text")
    s = with_step(stmts).where(F.col("step_line") == F.col("line_no"))
    return s.select(
        "file", "line_no", "job", "step", F.upper(_hit(t, EXEC_PGM, 2)).alias("program"),
        F.when(~t.rlike(EXEC_PGM), F.upper(_hit(t, EXEC_PROC, 2))).alias("procedure"),
        F.when(t.rlike(EXEC_PGM), _hit(t, PARM)).alias("parm"), _hit(t, COND).cast("bigint").alias("cond_rc"),
        F.upper(_hit(t, COND, 2)).alias("cond_op"), F.upper(_hit(t, COND, 3)).alias("cond_step"),
    )


def jcl_dd(stmts: DataFrame) -> DataFrame:
    """Datasets per step and DD; concatenated ones carry the DD name above them."""
    t = F.col("text")
    s = with_step(stmts).where(F.col("step").isNotNull() & (t.rlike(DD) | t.rlike(DD_MORE)) & (F.col("dd") != ""))
    operands = F.coalesce(_hit(t, DD, 2), _hit(t, DD_MORE))
    disp = F.regexp_replace(_hit(operands, DISP), r"^\((.*)\)$", "$1")
    return s.select(
        "file", "line_no", "job", "step", "step_line", "dd", _hit(operands, DSN).alias("dataset"), disp.alias("disposition"),
        (~t.rlike(DD)).alias("concatenated"), (F.col("dd") == "SYSLIB").alias("copy_library"),
    )


def step_runs(steps: DataFrame, return_codes: DataFrame) -> DataFrame:
    """Which steps run: a COND that holds means the step is skipped.

    ``return_codes(file, step, rc)`` of the steps that ran.  Without a step
    name the condition is tested against every earlier step.
    """
    rc = return_codes.select("file", "step", F.col("rc").cast("bigint").alias("rc"))
    v, op = F.col("cond_rc"), F.col("cond_op")
    r = F.col("rc")
    named = steps.where(op.isNotNull() & F.col("cond_step").isNotNull()).join(
        rc.withColumnRenamed("step", "cond_step"), ["file", "cond_step"]
    )
    one = (
        F.when(op == "LT", v < r).when(op == "LE", v <= r).when(op == "EQ", v == r).when(op == "NE", v != r)
        .when(op == "GT", v > r).when(op == "GE", v >= r).otherwise(False)
    )
    named_skip = named.where(one).select("file", "line_no")
    # Any earlier step: the least and greatest code so far decide every
    # comparison but equality, which looks up the first step with that code.
    placed = steps.join(rc, ["file", "step"], "left")
    run = running(placed, ["file"], "line_no", {"_lo": ("min", r), "_hi": ("max", r)})
    run = previous(run, ["file"], "line_no", "_e", F.struct("_lo", "_hi"))
    first = placed.where(r.isNotNull()).groupBy("file", F.col("rc").alias("cond_rc")).agg(F.min("line_no").alias("_first"))
    free = run.where(op.isNotNull() & F.col("cond_step").isNull()).join(first, ["file", "cond_rc"], "left")
    lo, hi = F.col("_e._lo"), F.col("_e._hi")
    some = (
        F.when(op == "LT", v < hi).when(op == "LE", v <= hi).when(op == "GT", v > lo).when(op == "GE", v >= lo)
        .when(op == "NE", (v != lo) | (v != hi)).when(op == "EQ", F.col("_first") < F.col("line_no")).otherwise(False)
    )
    skip = named_skip.unionByName(free.where(some).select("file", "line_no")).distinct().withColumn("_skip", F.lit(True))
    return steps.join(skip, ["file", "line_no"], "left").select("file", "step", "program", F.col("_skip").isNull().alias("runs"))


def bind_files(bindings: DataFrame, dds: DataFrame, steps: DataFrame) -> DataFrame:
    """Program files to datasets: by DD name, else by dataset name, in the first step of the program.

    ``bindings(program, name, assign_to)``.
    """
    first = steps.where(F.col("program").isNotNull()).groupBy("program").agg(F.min(F.struct("file", "line_no")).alias("s"))
    first = first.select("program", F.col("s.file").alias("file"), F.col("s.line_no").alias("step_line"))
    mine = dds.where(~F.col("concatenated")).join(first, ["file", "step_line"]).select("program", "dd", "dataset", "disposition", "line_no")
    by_name = mine.groupBy("program", F.col("dd").alias("assign_key")).agg(F.max_by(F.struct("dd", "dataset", "disposition"), "line_no").alias("n"))
    by_set = mine.where(F.col("dataset").isNotNull()).groupBy("program", F.upper("dataset").alias("assign_key")).agg(
        F.min_by(F.struct("dd", "dataset", "disposition"), "line_no").alias("d")
    )
    b = bindings.withColumn("assign_key", F.upper("assign_to"))
    j = b.join(by_name, ["program", "assign_key"], "left").join(by_set, ["program", "assign_key"], "left")
    hit = F.coalesce("n", "d")
    unknown = F.lit("UNKNOWN")
    return j.select(
        "program", "name", F.coalesce(hit["dd"], "assign_to").alias("dd"), F.coalesce(hit["dataset"], unknown).alias("dataset"),
        F.coalesce(hit["disposition"], unknown).alias("disposition"),
    )


def lineage_edges(dds: DataFrame, steps: DataFrame) -> DataFrame:
    """Dataset to program (read) and program to dataset (written) edges.

    New datasets are written, shared and old ones read, MOD ones both.
    """
    s = steps.where(F.col("program").isNotNull()).select("file", F.col("line_no").alias("step_line"), "program")
    d = dds.where(F.col("dataset").isNotNull() & ~F.col("copy_library")).join(s, ["file", "step_line"])
    d = d.withColumns({"_disp": F.upper(F.coalesce("disposition", F.lit("SHR"))), "_p": F.concat(F.lit("PGM:"), "program"), "_d": F.concat(F.lit("DSN:"), "dataset")})
    new, mod = F.col("_disp").startswith("NEW"), F.col("_disp").startswith("MOD")
    read = d.where(~new).select(F.col("_d").alias("src"), F.col("_p").alias("dst"))
    wrote = d.where(new | mod).select(F.col("_p").alias("src"), F.col("_d").alias("dst"))
    return read.unionByName(wrote).distinct()


def data_lineage(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Datasets with the datasets derived from them: (source, target, hops).

    With ``sources(dataset)`` only these are followed, and stretches without branches count as one step, so a long
    chain takes few rounds; else every dataset is a source, and the result holds all pairs.
    """
    if sources is None:
        edges = cut(edges)  # read for the sources and for the steps
        asked = edges.select(F.col("src").alias("node")).where(F.col("src").startswith("DSN:")).distinct()
    else:
        asked = sources.select(F.concat(F.lit("DSN:"), "dataset").alias("node"))
    r = reach(edges, asked, shorten=sources is not None).where(F.col("node").startswith("DSN:"))
    return r.select(F.expr("substring(source, 5)").alias("source"), F.expr("substring(node, 5)").alias("target"), F.expr("distance div 2").cast("bigint").alias("hops"))


def lineage_groups(edges: DataFrame) -> DataFrame:
    """Datasets and programs that feed each other in a circle: (node, component), for components of more than one."""
    found = cut(strong_components(edges))
    many = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("component")
    return found.join(many, "component").select("node", "component")
