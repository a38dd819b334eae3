"""Published tables and the monthly batch: retries, return codes, skipped steps, restart, written lines."""

import os

import pytest
from pyspark.sql import functions as F

from creditloom.catalog.adapters import TODAY, view
from creditloom.functions.pic import CLEAN
from creditloom.plans import batch, credit, risk
from creditloom.sources.published import fingerprint, publish, published

DATA = "/root/testdata/sf0.001"
NAMES = ("loan", "cust", "collateral", "guarantee", "sanction", "prior_action")


def test_a_table_is_published_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert published(spark, folder) == []
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(broken, folder, "a").count()
    assert published(spark, folder, "a") == []
    assert publish(spark.range(5), folder, "a").count() == 5
    assert publish(spark.range(9), folder, "a").count() == 5  # the first whole copy stays
    assert publish(spark.range(0), folder, "none").count() == 0
    assert len(published(spark, folder)) == 2 and len(published(spark, folder, "a")) == 1
    with pytest.raises(ValueError):
        publish(spark.range(1), folder, "a/b")


def test_fingerprints_follow_rows_and_not_their_order(spark):
    rows = [(1, "a"), (1, "a"), (2, None)]
    make = lambda r: spark.createDataFrame(r, "id bigint, text string")
    one = fingerprint([make(rows)], 5)
    assert fingerprint([make(rows[::-1]).repartition(3)], 5) == one
    others = [fingerprint([make(rows)], 6), fingerprint([make(rows[1:])], 5), fingerprint([make([(1, "b"), *rows[1:]])], 5), fingerprint([make([])], 5)]
    assert len({one, *others}) == 5


def test_history_of_a_repeated_run(spark, tmp_path):
    folder, classified = str(tmp_path / "h"), risk.classify(view(spark, DATA, "loan"))
    assert risk.read_risk_history(spark, folder).count() == 0
    for day, run in ((1, "r1"), (2, "r2"), (2, "r2")):
        risk.publish_risk_history(classified, day, folder, run)
    n = classified.count()
    assert {(r.report_date, r["count"]) for r in risk.read_risk_history(spark, folder).groupBy("report_date").count().collect()} == {(1, n), (2, n)}


def test_codes_and_skipped_steps(spark, tmp_path):
    tables = [view(spark, DATA, n) for n in NAMES]
    gone = str(tmp_path / "gone")
    codes, t = batch.run_batch(spark, *tables, TODAY, folder=str(tmp_path / "b"))
    errors = t["evaluation_stats"].first().error_count
    assert codes == {"evaluate": 4 if errors else 0, "classify": 0, "recover": 0, "report": 0}
    # Unreadable sanctions: 12, the classification is skipped, and what names it runs over the old loans.
    codes, t = batch.run_batch(spark, *tables[:4], gone, tables[5], TODAY, folder=str(tmp_path / "c"))
    assert codes == {"evaluate": 12, "recover": 0, "report": 0} and "classified" not in t and "loans" not in t
    # Unreadable actions of the run before: the classification fails and both later steps are skipped.
    codes, t = batch.run_batch(spark, *tables[:5], gone, TODAY, folder=str(tmp_path / "d"))
    assert codes == {"evaluate": 4 if errors else 0, "classify": 12} and "actions" not in t
    whole = tables[0].where("FALSE")
    assert batch.run_batch(spark, whole, *tables[1:], TODAY)[0]["evaluate"] == 0


def test_restart_and_lines(spark, tmp_path):
    tables, folder = [view(spark, DATA, n) for n in NAMES], str(tmp_path / "b")
    batch.run_batch(spark, *tables, TODAY, CLEAN, folder)
    first = set(published(spark, folder))
    _, t = batch.run_batch(spark, *tables, TODAY, CLEAN, folder)
    assert set(published(spark, folder)) == first and len(first) == 6
    batch.run_batch(spark, *tables, 20260601, CLEAN, folder)  # the classification does not depend on the date
    assert len(published(spark, folder)) == 6 + 4
    scored = t["evaluated"].where("outcome = 'SCORED'")
    want = {r.loan_id: r.max_rate_e4 for r in credit.score_result(scored, TODAY, CLEAN).collect()}
    assert {r.loan_id: r.max_rate_e4 for r in t["scores"].collect()} == want
    programs = dict.fromkeys(("evaluate", "classify", "recover", "report"), "PROG")
    lines = batch.batch_lines(t, tables[1], "BANK", 7, programs, ["BANK", "STREET"], "TOWN", TODAY)
    assert set(lines) == {"decisions", "rejects", "submission", "risk_summary", "escalations", "letters", "month"}
    out = str(tmp_path / "lines")
    batch.write_batch(lines, out)
    batch.write_batch({"rejects": lines["rejects"]}, out)
    assert sorted(os.listdir(out)) == sorted(lines)
    assert spark.read.text(f"{out}/submission").count() == t["classified"].count()
    assert spark.read.text(f"{out}/rejects").count() == t["evaluated"].where("outcome <> 'SCORED'").count()
