"""The monthly batch: evaluate, classify, recover, report, with step conditions, return codes and restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.pic import LITERAL
from creditloom.plans import credit, recovery, report, risk
from creditloom.session import scratch_path
from creditloom.sources import reports
from creditloom.sources.published import fingerprint, publish

# Return codes, and the step and greatest code on which a step depends.
RC_OK, RC_ERRORS, RC_FAILED = 0, 4, 12
CONDITIONS = {"classify": ("evaluate", 8), "recover": ("classify", 8), "report": ("classify", 8)}


class _Steps:
    """Steps of one run: which ran, their codes and tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.codes, self.tables = spark, folder, {}, {}

    def open(self, table: DataFrame | str) -> DataFrame:
        return self.spark.read.parquet(table) if isinstance(table, str) else table

    def run(self, name: str, step: Callable[[], int]) -> None:
        """A step is skipped if the one that it names ran and ended above the limit; one that cannot read its tables ends with 12."""
        before, limit = CONDITIONS.get(name, (None, 0))
        if self.codes.get(before, RC_OK) > limit:
            return
        try:
            self.codes[name] = step()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.codes[name] = RC_FAILED

    def keep(self, name: str, key: str, df: DataFrame) -> DataFrame:
        """A table written once for its inputs; a restart with the same inputs reads what is there."""
        self.tables[name] = publish(df, self.folder, f"{name}-{key}")
        return self.tables[name]


def run_batch(
    spark: SparkSession, loans: DataFrame | str, customers: DataFrame | str, collateral: DataFrame | str, guarantees: DataFrame | str,
    sanctions: DataFrame | str, prior_actions: DataFrame | str, today: int, mode: str = LITERAL, folder: str | None = None,
) -> tuple[dict[str, int], dict[str, DataFrame]]:
    """Return codes of the steps that ran, and their tables; inputs are tables or paths of tables.

    Codes: 4 from the evaluation when loans had errors, 12 when a step cannot read a table, else 0.  The classification is
    skipped if the evaluation ended above 8; recovery and report are if the classification did.  A step that was skipped
    has no code, and a condition on it does not hold, so that later steps run; without rewritten loans they read the old
    ones.  With a ``folder`` that holds tables of an earlier run, tables whose inputs, date and mode are the same
    are read instead of computed.  The recovery flag refers to ``prior_actions`` of the run before.
    """
    s = _Steps(spark, folder or scratch_path(spark, "batch"))
    t = s.tables

    def evaluate() -> int:
        read = [s.open(x) for x in (loans, customers, collateral, guarantees, sanctions)]
        key = fingerprint(read, today, mode)
        evaluated = s.keep("evaluated", key, credit.evaluate_loans(*read, today, mode))
        stats = s.keep("evaluation_stats", key, credit.loan_batch_stats(evaluated))
        s.keep("scores", key, credit.score_result(evaluated.where(F.col("outcome") == "SCORED"), today, mode))
        return RC_ERRORS if stats.where("error_count > 0").count() else RC_OK

    def classify() -> int:
        source, prior = s.open(loans), s.open(prior_actions)
        key = fingerprint([source, prior], mode)
        # The rewritten loan table feeds both later steps.
        s.keep("loans", key, risk.rewrite_loans(source, mode))
        t["class_totals"] = risk.class_totals(s.keep("classified", key, risk.classify_portfolio(source, prior, mode)))
        return RC_OK

    def master_loans() -> DataFrame:
        if "loans" in t:
            return t["loans"]
        old = s.open(loans)  # not classified before: no provisions yet
        return old.withColumns({c: F.lit(0).cast("bigint") for c in ("prov_rate_e4", "provision_cents") if c not in old.columns})

    def recover() -> int:
        master = master_loans()
        s.keep("actions", fingerprint([master], today, mode), recovery.recovery_actions(master, today, mode))
        t["action_totals"], t["recovery_totals"] = recovery.action_totals(master, mode), recovery.recovery_totals(master)
        return RC_OK

    def month() -> int:
        master, who = master_loans(), s.open(customers)
        t["totals"], t["sections"] = report.portfolio_totals(master), report.portfolio_sections(master, who)
        t["ratios"], t["top"] = report.risk_ratios(master), report.top_exposures(master, who)
        t["by_class"], t["by_type"] = report.portfolio_by_class(master), report.portfolio_by_type(master)
        t["by_segment"] = report.portfolio_by_segment(master, who)
        return RC_OK

    for name, step in (("evaluate", evaluate), ("classify", classify), ("recover", recover), ("report", month)):
        s.run(name, step)
    return s.codes, t


def batch_lines(
    tables: dict[str, DataFrame], customers: DataFrame, bank: str, bank_code: int, programs: dict[str, str], letterhead: list[str], city: str, today: int,
) -> dict[str, DataFrame]:
    """Line tables of the steps that ran: decisions, rejects, submission, risk summary, escalations, letters and month report.

    ``programs`` gives the program name that each step prints.
    """
    t, out = tables, {}
    if "evaluated" in t:
        scored = t["evaluated"].where(F.col("outcome") == "SCORED")
        out["decisions"] = reports.decision_report(scored, t["evaluation_stats"], bank, programs["evaluate"], today)
        out["rejects"] = reports.reject_lines(t["evaluated"])
    if "classified" in t:
        out["submission"] = reports.bct_lines(t["classified"], bank_code, today)
        out["risk_summary"] = reports.risk_summary_lines(t["class_totals"], bank, programs["classify"], today)
    if "actions" in t:
        out["escalations"] = reports.escalation_lines(t["actions"], t["recovery_totals"], t["action_totals"], bank, programs["recover"], today)
        out["letters"] = recovery.dunning_letters(t["actions"], customers, letterhead, city, today)
    if "totals" in t:
        out["month"] = reports.month_report(t["by_class"], t["totals"], t["top"], t["by_segment"], t["by_type"], t["ratios"], bank, programs["report"], today)
    return out


def write_batch(lines: dict[str, DataFrame], folder: str) -> None:
    """Each line table as text in its own folder, in print order; a repeated call replaces it."""
    for name, df in lines.items():
        reports.write_lines(df, f"{folder}/{name}", tuple(c for c in df.columns if c != "value"))


def monthly_batch(
    loans: DataFrame, customers: DataFrame, collateral: DataFrame, guarantees: DataFrame, sanctions: DataFrame,
    prior_actions: DataFrame, today: int, mode: str = LITERAL, folder: str | None = None,
) -> dict[str, DataFrame]:
    """The tables of ``run_batch`` over tables that are open already."""
    return run_batch(loans.sparkSession, loans, customers, collateral, guarantees, sanctions, prior_actions, today, mode, folder)[1]


def batch_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the headline numbers of all four steps."""
    s = tables["evaluation_stats"].select("read_count", "approved_count", "conditional_count", "declined_count", "error_count")
    c = tables["class_totals"].agg(F.sum("loans").alias("classified"), F.sum("provision_cents").alias("provision_cents"))
    a = tables["action_totals"].agg(F.sum("actions").alias("actions"))
    t = tables["totals"].select(F.col("loans").alias("report_loans"), "outstanding_cents", "avg_rate_e4")
    # Four single-row tables: stack them and keep the one value of each column.
    rows = s.unionByName(c, allowMissingColumns=True).unionByName(a, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in rows.columns])
