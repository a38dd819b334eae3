"""Auto premium quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import LITERAL, check_mode, clamp, idiv, rescale, store

# Tariff.  Premiums at scale 3, coefficients at scale 2.
BASE_E3 = {"TR": 480_000, "UT": 620_000, "MT": 320_000, "CM": 950_000, "LX": 1_850_000}
BASE_OTHER_E3 = 480_000
AGE_E2 = [(25, 160), (30, 125), (65, 100)]
AGE_OTHER_E2 = 130
EXPERIENCE_YEARS, EXPERIENCE_PCT = 10, 85
POWER_E2 = [(4, 85), (7, 100), (10, 120), (14, 150)]
POWER_OTHER_E2 = 200
COVER_E2 = {"RC": 100, "TC": 180, "TI": 320}
REGION_E2 = {"TUN": 120, "ARI": 115, "BAR": 110, "SFX": 105, "SOU": 105, "NAB": 100, "BIZ": 95}
REGION_OTHER_E2 = 90
ACCIDENT_E2 = 7_500
MIN_E3, MAX_E3 = 250_000, 25_000_000
TAX_PCT, PARAFISCAL_PCT = 19, 5
MIN_AGE, MAX_AGE, MAX_CRM_E2, HIGH_CRM_E2, MANUAL_ACCIDENTS = 18, 80, 350, 200, 3
REASONS = {
    "young": "AGE CONDUCTEUR INFERIEUR A 18 ANS",
    "old": "AGE CONDUCTEUR DEPASSE 80 ANS",
    "licence": "PERMIS DE CONDUIRE REQUIS",
    "crm": "COEFFICIENT CRM TROP ELEVE",
    "accidents": "SINISTRES > 3 - REVUE MANUELLE REQUISE",
    "high_crm": "CRM ELEVE - REVUE MANUELLE",
}


def check_quote() -> Column:
    """Reason of refusal, or NULL."""
    return (
        F.when(F.col("age") < MIN_AGE, REASONS["young"]).when(F.col("age") > MAX_AGE, REASONS["old"])
        .when(F.col("licence_years") == 0, REASONS["licence"]).when(F.col("crm_e2") > MAX_CRM_E2, REASONS["crm"])
    )


def _pick(col: Column, table: dict, other: int) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(other).cast("bigint")


def age_coef(age: Column, licence_years: Column) -> Column:
    base = F.when(age < 25, 160).when(age < 30, 125).when(age < 65, 100).otherwise(AGE_OTHER_E2).cast("bigint")
    seasoned = (licence_years >= EXPERIENCE_YEARS) & (age < 65)
    return F.when(seasoned, idiv(base * F.lit(EXPERIENCE_PCT), 100)).otherwise(base)


def power_coef(power: Column) -> Column:
    out = None
    for edge, v in POWER_E2:
        out = F.when(power <= edge, v) if out is None else out.when(power <= edge, v)
    return out.otherwise(POWER_OTHER_E2).cast("bigint")


def accident_load(accidents: Column, mode: str = LITERAL) -> Column:
    """Scale 2.  Literal mode keeps one integer digit of the loading."""
    load = (accidents * F.lit(ACCIDENT_E2)).cast("bigint")
    return store(load, 2, 1, 2, rounded=True) if check_mode(mode) == LITERAL else load


def auto_premium(quotes: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Premium, taxes and decision per quote; amounts at scale 3."""
    q = quotes.select(
        "quote_id", "crm_e2", "accidents", check_quote().alias("refusal"),
        _pick(F.col("category"), BASE_E3, BASE_OTHER_E3).alias("base_e3"),
        age_coef(F.col("age"), F.col("licence_years")).alias("age_e2"), power_coef(F.col("power")).alias("power_e2"),
        _pick(F.col("coverage"), COVER_E2, 100).alias("cover_e2"),
        _pick(F.col("gov"), REGION_E2, REGION_OTHER_E2).alias("region_e2"),
        accident_load(F.col("accidents"), mode).alias("load_e2"),
    )
    # base(3) and five factors(2): scale 13; at most 1 850 000 * 160 * 200 * 320 * 120 * 350, within BIGINT.
    product = F.col("base_e3") * F.col("age_e2") * F.col("power_e2") * F.col("cover_e2") * F.col("region_e2") * F.col("crm_e2")
    net = rescale(product + F.col("load_e2") * F.lit(10**11), 13, 3, rounded=True)
    if mode == LITERAL:
        net = net % F.lit(10**10)
    ok = F.col("refusal").isNull()
    q = q.withColumn("net_e3", F.when(ok, clamp(net, MIN_E3, MAX_E3)))
    pct = lambda p: rescale(F.col("net_e3") * F.lit(p), 5, 3, rounded=True)
    q = q.select("*", pct(TAX_PCT).alias("tax_e3"), pct(PARAFISCAL_PCT).alias("parafiscal_e3"))
    manual = F.when(F.col("accidents") >= MANUAL_ACCIDENTS, REASONS["accidents"]).when(
        F.col("crm_e2") > HIGH_CRM_E2, REASONS["high_crm"]
    )
    return q.select(
        "quote_id", "base_e3", "age_e2", "power_e2", "cover_e2", "region_e2", "load_e2", "net_e3", "tax_e3",
        "parafiscal_e3", (F.col("net_e3") + F.col("tax_e3") + F.col("parafiscal_e3")).alias("total_e3"),
        F.when(~ok, "REFUSE").when(manual.isNotNull(), "MANUEL").otherwise("ACCEPTE").alias("decision"),
        F.coalesce(F.col("refusal"), manual).alias("reason"),
    )


def premium_totals(premiums: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Counts per decision; net and gross of accepted quotes.

    Literal mode cuts each added premium to two decimals, as the totals hold.
    """
    ok = F.col("decision") == "ACCEPTE"
    cut = (lambda c: idiv(F.col(c), 10) * F.lit(10)) if check_mode(mode) == LITERAL else F.col
    money = lambda c: F.coalesce(F.sum(F.when(ok, cut(c))), F.lit(0)).cast("bigint")
    return premiums.agg(
        F.count_if(ok).alias("accepted"), F.count_if(F.col("decision") == "REFUSE").alias("refused"),
        F.count_if(F.col("decision") == "MANUEL").alias("manual"), money("net_e3").alias("net_e3"),
        money("total_e3").alias("gross_e3"),
    )
