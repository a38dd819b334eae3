"""Names of more than eight characters in job decks."""

from creditloom.plans import jcl


def test_programs_with_long_names_stay_apart(spark):
    deck = ["//JOB500000 JOB (ACCT)", "//STEP000001 EXEC PGM=PGM100000", "//IN1 DD DSN=A.B,DISP=SHR", "//STEP2 EXEC PGM=PGM100001,COND=(4,LT,STEP000001)", "//STEP3 EXEC LONGPROCEDURE"]
    lines = spark.createDataFrame([("D", i + 1, t) for i, t in enumerate(deck)], "file string, line_no bigint, text string")
    st = jcl.statements(lines)
    steps = jcl.jcl_steps(st).orderBy("line_no").collect()
    assert [(r.job, r.step, r.program, r.procedure, r.cond_step) for r in steps] == [
        ("JOB500000", "STEP000001", "PGM100000", None, None), ("JOB500000", "STEP2", "PGM100001", None, "STEP000001"), ("JOB500000", "STEP3", None, "LONGPROCEDURE", None),
    ]
    bound = jcl.bind_files(spark.createDataFrame([("PGM100000", "F", "IN1"), ("PGM100001", "F", "IN1")], "program string, name string, assign_to string"), jcl.jcl_dd(st), jcl.jcl_steps(st))
    assert {(r.program, r.dataset) for r in bound.collect()} == {("PGM100000", "A.B"), ("PGM100001", "UNKNOWN")}
