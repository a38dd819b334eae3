"""Loan evaluation: checks, screening, scoring, decision, pricing and fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import conditions as cond
from creditloom.functions.pic import CLEAN, LITERAL, band, check_mode, clamp, idiv, percent_of, ratio, store, years_between_yyyymmdd
from creditloom.operators.ordered import fill_forward, number_by_id
from creditloom.session import cut
from creditloom.plans.aml import aml_outcome, aml_score, loan_name_key, person_risk, sanction_hits

# Scoring thresholds (ratios at scale 4), weights in percent.
INCOME_BANDS = [(30000, 1000), (25000, 850), (20000, 700), (15000, 500), (12000, 300)]
DSCR_BANDS = [(15000, 1000), (12000, 750), (10000, 500), (8000, 250)]
LTV_BANDS = [(600000, 1000), (700000, 800), (800000, 600), (900000, 400), (1000000, 200)]
TENURE_BANDS = [(10, 1000), (7, 800), (5, 600), (3, 400), (1, 200)]
HISTORY_BANDS = [(30, 700), (90, 400), (180, 150)]
WEIGHTS = {"INCOME": 25, "HISTORY": 30, "DSCR": 20, "COLLAT": 15, "TENURE": 10}
MAX_SCORE = 1000
DECISION_BANDS = [(600, "AP"), (450, "CO"), (350, "RV")]
RATE_BANDS = [(850, 87500), (700, 97500), (600, 107500)]
RATE_OTHER = 117500
REASON_PAST_DUE = "RETARDS DE PAIEMENT DETECTES"
REASON_CLASSIFIED = "CREANCE CLASSEE - SUIVI REQUIS"
REASON_BAD = "CREANCE EN SOUFFRANCE > 180 JOURS"
REASON_NO_INCOME = "REVENU OU MENSUALITE NULS"
REASON_LOW_INCOME = "RATIO REVENU/MENSUALITE INSUFFISANT"
REASON_LOW_COVER = "TAUX DE COUVERTURE FAIBLE"
REASON_NO_COVER = "CAPACITE REMBOURSEMENT INSUFFISANTE"

# Fee table, rates in percent at scale 4, bounds in cents.
FEE_RATES = {"CON": 15000, "IMM": 10000, "AUT": 20000, "PRO": 7500, "REV": 25000}
FEE_RATE_OTHER = 15000
FEE_MIN, FEE_MAX = 5_000, 500_000
INSURED_TYPES = ("IMM", "AUT", "CON")
INSURANCE_RATE_E4 = 4500
TAX_RATE_E2 = 1900
STAMP_CENTS = 500


def income_ratio(income: Column, payment: Column) -> Column:
    """Income over payment at scale 4; NULL when either is zero."""
    return F.when((income != 0) & (payment != 0), store(ratio(income, payment, 4), 4, 3, 4))


def score_income(r: Column) -> tuple[Column, Column]:
    """(points, reason) of an income ratio."""
    reason = F.when(r.isNull(), REASON_NO_INCOME).when(r < INCOME_BANDS[-1][0], REASON_LOW_INCOME)
    return band(r, INCOME_BANDS, 0).cast("bigint"), reason


def score_history(dpd: Column, missed: Column) -> tuple[Column, Column]:
    points = F.when((dpd == 0) & (missed == 0), 1000).otherwise(band(dpd, HISTORY_BANDS, 0, "<="))
    reason = (
        F.when(dpd <= 30, F.lit(None)).when(dpd <= 90, REASON_PAST_DUE).when(dpd <= 180, REASON_CLASSIFIED)
        .otherwise(REASON_BAD)
    )
    return points.cast("bigint"), reason


def debt_cover(income: Column, payment: Column, existing_debt: Column | None = None) -> Column:
    """Income over debt service at scale 4; NULL without service."""
    service = store(payment if existing_debt is None else payment + existing_debt, 2, 9, 2)
    return F.when(service != 0, store(ratio(income, service, 4), 4, 3, 4))


def score_dscr(r: Column) -> tuple[Column, Column]:
    points = F.when(r.isNull(), 1000).otherwise(band(r, DSCR_BANDS, 0))
    reason = F.when(r.isNull() | (r >= 10000), F.lit(None)).when(r >= 8000, REASON_LOW_COVER).otherwise(REASON_NO_COVER)
    return points.cast("bigint"), reason


def loan_to_value(outstanding: Column, security: Column, mode: str = LITERAL) -> Column:
    """Percent at scale 4; NULL without security.  Literal mode wraps at 1000 %."""
    raw = ratio(outstanding, security, 6)
    return F.when(security != 0, store(raw, 4, 3, 4) if check_mode(mode) == LITERAL else raw)


def score_collateral(ltv: Column) -> Column:
    return band(ltv, LTV_BANDS, 0, "<=").cast("bigint")


def tenure_years(today: Column, open_date: Column) -> Column:
    return store(years_between_yyyymmdd(today, open_date), 0, 3, 0)


def score_tenure(years: Column) -> Column:
    return band(years, TENURE_BANDS, 0).cast("bigint")


def raw_score(income: Column, history: Column, dscr: Column, collateral: Column, tenure: Column) -> Column:
    """Weighted mean at scale 2."""
    parts = zip((income, history, dscr, collateral, tenure), WEIGHTS.values())
    total = None
    for points, weight in parts:
        total = points * F.lit(weight) if total is None else total + points * F.lit(weight)
    return total.cast("bigint")


def final_score(raw_e2: Column, bureau: Column, sector: Column, mode: str = LITERAL) -> Column:
    """Literal mode keeps the magnitude of a negative score; clean mode floors at zero."""
    total = raw_e2 + (bureau + sector) * F.lit(100)
    if check_mode(mode) == LITERAL:
        return clamp(store(total, 2, 4, 0), None, MAX_SCORE)
    return clamp(idiv(total, 100), 0, MAX_SCORE)


def decide(score: Column) -> Column:
    return band(score, DECISION_BANDS, "DC")


def max_loan(income: Column, security: Column, original: Column) -> Column:
    """Least of 40 % of yearly income, 80 % of security (when any) and the original amount."""
    by_income = store(idiv(income * F.lit(48), 10), 2, 11, 2)
    by_security = F.when(security > 0, idiv(security * F.lit(8), 10))
    return F.least(by_income, by_security, original).cast("bigint")


def price(score: Column) -> Column:
    """Rate in percent at scale 4."""
    return band(score, RATE_BANDS, RATE_OTHER).cast("bigint")


def fee_rate(loan_type: Column) -> Column:
    """File fee in percent at scale 4."""
    rate = None
    for code, value in FEE_RATES.items():
        rate = F.when(loan_type == code, value) if rate is None else rate.when(loan_type == code, value)
    return rate.otherwise(FEE_RATE_OTHER).cast("bigint")


def file_fee(amount: Column, rate: Column) -> Column:
    gross = store(percent_of(amount, rate, 4), 2, 7, 2)
    return F.least(F.greatest(gross, F.lit(FEE_MIN).cast("bigint")), F.lit(FEE_MAX).cast("bigint"))


def insurance_fee(loan_type: Column, amount: Column) -> Column:
    part = store(percent_of(amount, INSURANCE_RATE_E4, 4), 2, 7, 2)
    return F.when(loan_type.isin(*INSURED_TYPES), part).otherwise(F.lit(0).cast("bigint"))


def fee_tax(fee: Column) -> Column:
    return (percent_of(fee, TAX_RATE_E2, 2) + F.lit(STAMP_CENTS)).cast("bigint")


def fees(loan_type: Column, amount: Column) -> Column:
    """Struct of file_fee, tax, insurance and total in cents, for one-off use."""
    fee, insurance = file_fee(amount, fee_rate(loan_type)), insurance_fee(loan_type, amount)
    tax = fee_tax(fee)
    return F.struct(
        fee.alias("file_fee"), tax.alias("tax"), insurance.alias("insurance"), store(fee + insurance + tax, 2, 9, 2).alias("total")
    )


def with_fees(df: DataFrame, loan_type: str = "loan_type", amount: str = "original_cents") -> DataFrame:
    """Add file_fee, insurance, tax and total in stages, each computed once."""
    out = df.withColumn("_rate", fee_rate(F.col(loan_type)))
    out = out.withColumns({"file_fee": file_fee(F.col(amount), F.col("_rate")), "insurance": insurance_fee(F.col(loan_type), F.col(amount))})
    out = out.drop("_rate").withColumn("tax", fee_tax(F.col("file_fee")))
    return out.withColumn("total", store(F.col("file_fee") + F.col("insurance") + F.col("tax"), 2, 9, 2))


def security_by_loan(collateral: DataFrame, guarantees: DataFrame) -> DataFrame:
    """Active collateral and guarantee sums per loan, in one shuffle."""
    zero = F.lit(0).cast("bigint")
    c = collateral.where(cond.condition("collateral_active")).select(
        "loan_id", F.col("value_cents").alias("c"), zero.alias("g")
    )
    g = guarantees.where(cond.condition("guarantee_active")).select(
        "loan_id", zero.alias("c"), F.col("amount_cents").alias("g")
    )
    return c.unionByName(g).groupBy("loan_id").agg(
        F.sum("c").alias("collateral_cents"), F.sum("g").alias("guarantee_cents")
    )


def bureau_latest(scores: DataFrame) -> DataFrame:
    """Latest bureau score per customer."""
    return scores.groupBy("cust_id").agg(F.max_by("score", F.struct("score_date", "score")).alias("bureau_score"))


def rank_components(df: DataFrame, key: str = "loan_id") -> DataFrame:
    """The five components of each loan ranked by points, one row each.

    Sorted inside the row's own array, so no shuffle happens.
    """
    parts = [
        F.struct(
            (-F.col(f"{name.lower()}_score")).alias("neg"), F.lit(i).alias("place"), F.lit(name).alias("component"),
            F.lit(WEIGHTS[name]).cast("bigint").alias("weight"), F.col(f"{name.lower()}_score").alias("points"),
        )
        for i, name in enumerate(WEIGHTS)
    ]
    ranked = F.sort_array(F.array(*parts))
    return df.select(key, F.posexplode(ranked).alias("p", "c")).select(
        key, (F.col("p") + 1).cast("bigint").alias("component_rank"), F.col("c.component"), F.col("c.weight"),
        F.col("c.points"),
    )


def screened_customers(customers: DataFrame, sanctions: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Customers with their list hits: joined once per customer, not per loan."""
    named = customers.withColumn("_name", loan_name_key(F.col("first_name"), F.col("last_name"), mode))
    return person_risk(sanction_hits(named, sanctions, "_name", "cin")).drop("_name")


def evaluate_loans(
    loans: DataFrame,
    customers: DataFrame,
    collateral: DataFrame,
    guarantees: DataFrame,
    sanctions: DataFrame,
    today: int,
    mode: str = LITERAL,
    sectors: DataFrame | None = None,
    bureau: DataFrame | None = None,
) -> DataFrame:
    """Every loan with its outcome (SCORED, REJECTED, ERROR) and, if scored, its result.

    Rate and maximum are zero unless the decision is AP or CO; the storage
    effect that repeats an older value is ``carry_rate``.
    """
    check_mode(mode)
    who = screened_customers(customers, sanctions, mode).select(
        "cust_id", cond.check_customer(F.col("status"), F.col("aml_flag"), F.col("kyc")).alias("_refused"), "employer", "income_cents",
        tenure_years(F.lit(today).cast("bigint"), F.col("open_date")).alias("_years"), "person_points", "listed_country", "hit_reason",
        F.lit(True).alias("known"),
    )
    who = who.withColumn("sector", cond.sector_of(F.col("employer")))
    if sectors is None:
        who = who.withColumn("sector_adj", cond.default_sector_adjustment(F.col("sector")))
    else:
        table = sectors.select(F.col("code").alias("sector"), F.col("adjustment").cast("bigint").alias("_adj"))
        who = who.join(table, "sector", "left").withColumn("sector_adj", F.coalesce("_adj", F.lit(0))).drop("_adj")
    if bureau is None:
        who = who.withColumn("bureau_adj", cond.bureau_fallback(F.col("cust_id")))
    else:
        who = who.join(bureau_latest(bureau), "cust_id", "left").withColumn(
            "bureau_adj", F.coalesce(clamp(F.col("bureau_score").cast("bigint"), -100, 100), F.lit(0))
        )
    security = security_by_loan(collateral, guarantees)
    j = loans.join(security, "loan_id", "left").join(who, "cust_id", "left")

    # Each stage reads the columns of the stage before, so a ratio or score is
    # computed once instead of once per threshold that looks at it.
    j = j.select(
        "loan_id", "cust_id", "loan_type", "original_cents", "outstanding_cents", "payment_cents", "rate_e4", "dpd", "missed",
        "income_cents", "_years", "bureau_adj", "sector_adj", "hit_reason", "_refused",
        F.coalesce("collateral_cents", F.lit(0)).alias("collateral_cents"),
        F.coalesce("guarantee_cents", F.lit(0)).alias("guarantee_cents"),
        cond.check_preconditions(F.col("loan_id"), F.col("original_cents"), F.col("status")).alias("_bad"),
        F.when(
            F.col("known").isNull(), F.concat(F.lit(cond.ERR_CUSTOMER), F.lpad(F.col("cust_id").cast("string"), 8, "0"))
        ).alias("_missing"),
        aml_score(F.col("original_cents")).alias("_aml_score"),
    )
    clear, reason = aml_outcome(F.col("_aml_score"))
    no_clear = clear != "Y"
    hidden = ("_bad", "_missing", "_refused", "_aml_score", "hit_reason")
    j = j.select(
        *[c for c in j.columns if c not in hidden],
        F.when(F.col("_bad").isNotNull() | F.col("_missing").isNotNull(), "ERROR")
        .when(F.col("_refused").isNotNull() | no_clear, "REJECTED").otherwise("SCORED").alias("outcome"),
        F.coalesce(F.col("_bad"), F.col("_missing"), F.col("_refused"), F.when(no_clear, reason)).alias("reject_reason"),
    )
    scored = F.col("outcome") == "SCORED"
    income = F.col("income_cents")
    security_sum = F.col("collateral_cents") + F.col("guarantee_cents")
    j = j.select(
        "*",
        F.when(scored, income_ratio(income, F.col("payment_cents"))).alias("income_ratio_e4"),
        F.when(scored, debt_cover(income, F.col("payment_cents"))).alias("dscr_e4"),
        F.when(scored, loan_to_value(F.col("outstanding_cents"), security_sum, mode)).alias("ltv_e4"),
    )
    inc, why_inc = score_income(F.col("income_ratio_e4"))
    hist, why_hist = score_history(F.col("dpd"), F.col("missed"))
    dscr, why_dscr = score_dscr(F.col("dscr_e4"))
    j = j.select(
        "*",
        F.when(scored, inc).alias("income_score"), F.when(scored, hist).alias("history_score"), F.when(scored, dscr).alias("dscr_score"),
        F.when(scored, score_collateral(F.col("ltv_e4"))).alias("collat_score"),
        F.when(scored, score_tenure(F.col("_years"))).alias("tenure_score"),
        F.when(scored, why_hist).alias("reason_1"), F.when(scored, why_inc).alias("reason_2"), F.when(scored, why_dscr).alias("reason_3"),
    )
    j = j.withColumn("raw_score_e2", raw_score(*[F.col(f"{n.lower()}_score") for n in WEIGHTS]))
    j = j.withColumn("score", final_score(F.col("raw_score_e2"), F.col("bureau_adj"), F.col("sector_adj"), mode))
    j = j.withColumn("decision", F.when(scored, decide(F.col("score"))))
    granted = F.col("decision").isin("AP", "CO")
    zero = F.lit(0).cast("bigint")
    fee_names = ("file_fee", "insurance", "tax", "total")
    j = with_fees(j.drop("_years"))
    return j.select(
        *[c for c in j.columns if c not in fee_names], *[F.when(scored, F.col(c)).alias(c) for c in fee_names],
        F.when(granted, max_loan(income, security_sum, F.col("original_cents"))).when(scored, zero).alias("max_loan_cents"),
        F.when(granted, price(F.col("score"))).when(scored, zero).alias("max_rate_e4"),
    )


def route(evaluated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, rejected, errors)."""
    by = {k: evaluated.where(F.col("outcome") == k) for k in ("SCORED", "REJECTED", "ERROR")}
    return by["SCORED"], by["REJECTED"], by["ERROR"]


def loan_batch_stats(evaluated: DataFrame) -> DataFrame:
    """Counters and amounts of one batch, in one pass."""
    is_ = lambda *codes: F.col("decision").isin(*codes)
    amount = F.col("original_cents")

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, amount)), F.lit(0)).cast("bigint")

    return evaluated.agg(
        F.count("*").alias("read_count"),
        F.count_if(is_("AP")).alias("approved_count"),
        F.count_if(is_("CO", "RV")).alias("conditional_count"),
        F.count_if(is_("DC") | (F.col("outcome") == "REJECTED")).alias("declined_count"),
        F.count_if(F.col("outcome") == "ERROR").alias("error_count"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("total_cents"),
        total(is_("AP")).alias("approved_cents"),
        total(is_("DC")).alias("declined_cents"),
    )


def carry_rate(scored: DataFrame) -> DataFrame:
    """Literal storage effect: RV and DC rows repeat the rate of the last granted
    loan in loan order; RV rows repeat the last maximum, which DC resets to zero."""
    granted = F.col("decision").isin("AP", "CO")
    last_max = F.when(granted, F.col("max_loan_cents")).when(F.col("decision") == "DC", F.lit(0).cast("bigint"))
    filled = fill_forward(
        scored, [], "loan_id",
        {"carried_rate_e4": F.when(granted, F.col("max_rate_e4")), "carried_max_cents": last_max}, sparse=True,
    )
    zero = F.lit(0).cast("bigint")
    return filled.withColumns(
        {"carried_rate_e4": F.coalesce("carried_rate_e4", zero), "carried_max_cents": F.coalesce("carried_max_cents", zero)}
    )


def score_result(scored: DataFrame, today: int, mode: str = CLEAN) -> DataFrame:
    """Result rows with running ids in loan order; the evaluation is written once, as the numbering reads it twice."""
    scored = cut(scored)
    if check_mode(mode) == LITERAL:
        scored = carry_rate(scored).withColumns(
            {"max_rate_e4": F.col("carried_rate_e4"), "max_loan_cents": F.col("carried_max_cents")}
        )
    numbered = number_by_id(scored, "loan_id", "result_id")
    blank = F.lit("")
    return numbered.select(
        "result_id", "loan_id", "cust_id", F.lit(today).cast("bigint").alias("score_date"), "score", "decision",
        "max_loan_cents", "max_rate_e4", *[F.coalesce(f"reason_{i}", blank).alias(f"reason_{i}") for i in (1, 2, 3)],
        F.lit(0).cast("bigint").alias("analyst_id"),
    )
