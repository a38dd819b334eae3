"""Recovery queue, escalation actions, dates and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.conditions import delinquent_priority, in_portfolio
from creditloom.functions.pic import LITERAL, add_days, check_mode, idiv, zoned
from creditloom.operators.ordered import dense_ids
from creditloom.plans.risk import with_all_codes

# Escalation steps, day offsets, action codes, seizure threshold.
ACTIONS = ("SMS", "EML", "PHN", "DUL", "LEG", "GTR", "RST", "CRT", "CSZ", "WOF")
DAYS = {"SMS": 7, "EML": 7, "PHN": 7, "DUL": 15, "LEG": 30, "GTR": 30, "RST": 30, "CRT": 60, "CSZ": 60, "WOF": 0}
SEIZE_ABOVE_UNITS = 50_000
LETTER_ACTIONS = ("DUL", "LEG", "GTR")
LETTER_LINES = 30
ACTION_TIME, OFFICER_ID = 120000, 100000


def delinquent(loans: DataFrame) -> DataFrame:
    """Class 2, 3 and 4 loans of the portfolio with their queue priority."""
    d = loans.where(in_portfolio(F.col("status"))).withColumn("priority", delinquent_priority(F.col("loan_class")))
    return d.where(F.col("priority").isNotNull())


def sort_amount(outstanding: Column, mode: str = LITERAL) -> Column:
    """Cents.  Literal mode drops the cents, as the sort record does."""
    if check_mode(mode) == LITERAL:
        return idiv(outstanding, 100) * F.lit(100)
    return outstanding


def queue_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("claim_cents").desc(), F.col("loan_id").asc()]


def recovery_queue(loans: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Delinquent loans in working order, numbered from 1."""
    d = delinquent(loans).select(
        "loan_id", "cust_id", "loan_class", "dpd", "priority", sort_amount(F.col("outstanding_cents"), mode).alias("claim_cents")
    )
    return dense_ids(d, queue_order(), "queue_no")


def recovery_action(klass: Column, dpd: Column, claim_cents: Column) -> Column:
    """Escalation matrix."""
    big = claim_cents > SEIZE_ABOVE_UNITS * 100
    return (
        F.when((klass == "2") & (dpd <= 45), "SMS").when((klass == "2") & (dpd <= 60), "PHN").when(klass == "2", "DUL")
        .when((klass == "3") & (dpd <= 120), "LEG").when((klass == "3") & (dpd <= 150), "GTR").when(klass == "3", "RST")
        .when((klass == "4") & (dpd <= 365), "CRT")
        .when((klass == "4") & (dpd <= 540), F.when(big, "CSZ").otherwise("WOF"))
        .when(klass == "4", "WOF")
    )


def next_action_date(action: Column, today: int, mode: str = LITERAL) -> Column:
    n = None
    for code, days in DAYS.items():
        n = F.when(action == code, days) if n is None else n.when(action == code, days)
    return add_days(F.lit(today).cast("bigint"), n, mode)


def recovery_actions(loans: DataFrame, today: int, mode: str = LITERAL) -> DataFrame:
    """One action per delinquent loan; ids follow the queue."""
    q = recovery_queue(loans, mode)
    q = q.withColumn("action_type", recovery_action(F.col("loan_class"), F.col("dpd"), F.col("claim_cents")))
    zero = F.lit(0).cast("bigint")
    note = F.concat(
        F.lit("ACTION "), F.col("action_type"), F.lit(" AMT "), zoned(idiv(F.col("claim_cents"), 100), 13),
        F.lit(" DPD "), zoned(F.col("dpd"), 4),
    )
    return q.select(
        F.col("queue_no").alias("action_id"), "loan_id", "cust_id", F.lit(today).cast("bigint").alias("action_date"),
        F.lit(ACTION_TIME).cast("bigint").alias("action_time"), "action_type", F.col("claim_cents").alias("claimed_cents"),
        zero.alias("recovered_cents"), F.lit("N").alias("response"),
        next_action_date(F.col("action_type"), today, mode).alias("next_action_date"),
        F.lit(OFFICER_ID).cast("bigint").alias("officer_id"), F.lit("").alias("legal_firm"), F.lit("").alias("court_case"),
        note.alias("comments"), "loan_class", "dpd",
    )


def recovery_totals(loans: DataFrame) -> DataFrame:
    """Count and amount per delinquent class."""
    agg = delinquent(loans).groupBy("loan_class").agg(
        F.count("*").alias("loans"), F.sum("outstanding_cents").alias("amount_cents")
    )
    return with_all_codes(agg, "loan_class", ("2", "3", "4"), ["loans", "amount_cents"])


def action_totals(loans: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Count per action code, without building the queue."""
    d = delinquent(loans)
    code = recovery_action(F.col("loan_class"), F.col("dpd"), sort_amount(F.col("outstanding_cents"), mode))
    agg = d.groupBy(code.alias("action_type")).agg(F.count("*").alias("actions"))
    return with_all_codes(agg, "action_type", ACTIONS, ["actions"])


def letter_lines(action: Column, letterhead: list[str], city: str, today: int) -> list[tuple[int, Column]]:
    """(line number, text) of a dunning letter; other lines of the thirty are blank."""
    # The letter texts.
    texts = {
        "DUL": "Nous constatons un retard de paiement sur votre dossier de credit.",
        "LEG": "Suite a nos rappels precedents restes sans suite, nous vous mettons formellement en demeure.",
        "GTR": "Nous nous reservons le droit de faire appel au garant en cas de non regularisation.",
    }
    body = None
    for code, text in texts.items():
        body = F.when(action == code, text) if body is None else body.when(action == code, text)
    field = lambda name, n: F.rpad(F.coalesce(F.col(name), F.lit("")), n, " ")
    if len(letterhead) > 3:
        raise ValueError("the letter has room for three lines of letterhead")
    lines = [(i + 1, F.lit(text)) for i, text in enumerate(letterhead)]
    lines += [
        (5, F.lit(f"{city}, le {today}")),
        (7, F.concat(F.lit("Madame, Monsieur "), field("first_name", 25), F.lit(" "), field("last_name", 30))),
        (8, field("line1", 40)),
        (9, F.concat(field("zip", 5), F.lit(" "), field("city", 20))),
        (12, F.concat(F.lit("Objet: Mise en demeure - Dossier "), zoned(F.col("loan_id"), 10))),
        (15, body),
        (17, F.concat(F.lit("Montant du sont: "), zoned(idiv(F.col("claimed_cents"), 100), 13), F.lit(" TND"))),
        (18, F.concat(F.lit("Jours de retard: "), zoned(F.col("dpd"), 4))),
        (21, F.lit("Veuillez regulariser votre situation dans un delai de 15 jours.")),
        (24, F.lit("Veuillez agreer, Madame, Monsieur, l expression de nos salutations distinguees.")),
        (28, F.lit("Le Directeur du Recouvrement")),
    ]
    return lines


def dunning_letters(
    actions: DataFrame, customers: DataFrame, letterhead: list[str], city: str, today: int, width: int = 137
) -> DataFrame:
    """Thirty lines and three trailer lines per letter: (action_id, line_no, value)."""
    who = customers.select("cust_id", "first_name", "last_name", "line1", "zip", "city")
    d = actions.where(F.col("action_type").isin(*LETTER_ACTIONS)).join(who, "cust_id", "left")
    by_no = dict(letter_lines(F.col("action_type"), letterhead, city, today))
    every = [by_no.get(i, F.lit("")) for i in range(1, LETTER_LINES + 1)]
    every += [F.lit(""), F.lit("=" * width), F.lit("")]
    return d.select("action_id", F.posexplode(F.array(*every)).alias("p", "t")).select(
        "action_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.rpad("t", width, " ").alias("value")
    )
