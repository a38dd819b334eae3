"""AML screening: list hits are found per person, points are added per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import LITERAL, check_mode, clamp
from creditloom.functions.text import inspect_tally, normalize_name

# Points, thresholds in cents, texts.
PEP_POINTS, LIST_POINTS, CIN_POINTS, COUNTRY_POINTS = 50, 200, 150, 100
LARGE_CENTS, LARGE_POINTS = 1_000_000, 30
VERY_LARGE_CENTS, VERY_LARGE_POINTS = 5_000_000, 80
SCORE_CAP, HIT_REJECT_ABOVE, REJECT_FROM, REVIEW_FROM = 999, 150, 300, 150
LIST_LABELS = {
    "PEP": "PEP LIST",
    "UNL": "UN SANCTIONS",
    "EUL": "EU SANCTIONS",
    "OFC": "OFAC SANCTIONS",
    "TUN": "BCT WATCHLIST",
}
RISK_COUNTRIES = "IRN PRK SYR YEM IRQ AFG SOM SDN LBY VEN MMR CUB"
REASON_CIN = "CIN MATCH ON SANCTIONS LIST"
REASON_HIGH = "HIGH AML RISK SCORE"
REASON_REVIEW = "MANUAL REVIEW REQUIRED"
REASON_CLEAR = "AML CLEAR"


def loan_name_key(first: Column, last: Column, mode: str = LITERAL) -> Column:
    """The screened name.  Literal mode keeps the inner padding of the fields."""
    if check_mode(mode) == LITERAL:
        return F.rtrim(F.substring(F.concat(F.rpad(first, 25, " "), F.lit(" "), F.rpad(last, 30, " ")), 1, 55))
    return F.concat_ws(" ", F.rtrim(first), F.rtrim(last))


def sanction_names(sanctions: DataFrame) -> DataFrame:
    """One row per name key."""
    return (
        sanctions.withColumn("name_key", F.rtrim("name_key"))
        .groupBy("name_key")
        .agg(F.min(F.struct("list_code", "severity")).alias("s"))
        .select("name_key", F.col("s.list_code").alias("hit_list"), F.col("s.severity").alias("hit_severity"))
    )


def sanction_hits(people: DataFrame, sanctions: DataFrame, name: str = "name", cin: str = "cin") -> DataFrame:
    """Add hit_list, hit_severity, name_hit and cin_hit to each person.

    The list is left to the optimizer's own size check: broadcast while it is
    small, shuffled by key when it is not.
    """
    names = sanction_names(sanctions)
    cins = sanctions.select(F.rtrim("cin").alias("_cin")).distinct().withColumn("_cin_hit", F.lit(True))
    keyed = people.withColumn("_key", F.rtrim(normalize_name(F.col(name))))
    out = keyed.join(names, keyed["_key"] == names["name_key"], "left").drop("_key")
    out = out.withColumn("name_hit", F.col("name_key").isNotNull()).drop("name_key")
    out = out.join(cins, F.rtrim(F.col(cin)) == F.col("_cin"), "left").drop("_cin")
    return out.withColumn("cin_hit", F.coalesce("_cin_hit", F.lit(False)) & ~F.col("name_hit")).drop("_cin_hit")


def _map(col: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(other)


def person_risk(hits: DataFrame, nationality: str = "nationality") -> DataFrame:
    """What the amount does not change: points of the person, listed country, text of the hit."""
    points = {k: PEP_POINTS if k == "PEP" else LIST_POINTS for k in LIST_LABELS}
    name_points = F.when(F.col("name_hit"), _map(F.col("hit_list"), points, 0)).otherwise(0)
    cin_points = F.when(F.col("cin_hit"), CIN_POINTS).otherwise(0)
    nat = F.rpad(nationality, 3, " ")
    # An unknown nationality counts nothing.
    tally = F.coalesce(inspect_tally(F.lit(RISK_COUNTRIES.ljust(60)), nat), F.lit(0))
    label = F.rpad(_map(F.col("hit_list"), LIST_LABELS, ""), 20, " ")
    found = F.when(
        F.col("name_hit"),
        F.concat(F.lit("HIT "), label, F.lit(" SEVERITY "), F.col("hit_severity").cast("string")),
    ).when(F.col("cin_hit"), REASON_CIN)
    return hits.withColumns(
        {
            "person_points": (name_points + cin_points + tally).cast("bigint"),
            "listed_country": F.coalesce(nat.isin(*RISK_COUNTRIES.split()), F.lit(False)),
            "hit_reason": found,
        }
    ).drop("name_hit", "cin_hit", "hit_list", "hit_severity")


def aml_score(amount: Column) -> Column:
    """Points of the person and the amount, capped."""
    amount_points = (
        F.when(amount > VERY_LARGE_CENTS, VERY_LARGE_POINTS).when(amount > LARGE_CENTS, LARGE_POINTS).otherwise(0)
    )
    base = F.col("person_points") + amount_points
    country = F.when(F.col("listed_country") & (base > 0), COUNTRY_POINTS).otherwise(0)
    return clamp((base + country).cast("bigint"), None, SCORE_CAP)


def aml_outcome(score: Column) -> tuple[Column, Column]:
    """(clear flag Y/C/N, reason) from the score and the hit text."""
    found = F.col("hit_reason")
    sure = found.isNotNull() & (score > HIT_REJECT_ABOVE)
    clear = F.when(sure | (score >= REJECT_FROM), "N").when(score >= REVIEW_FROM, "C").otherwise("Y")
    reason = (
        F.when(sure, found).when(score >= REJECT_FROM, F.coalesce(found, F.lit(REASON_HIGH)))
        .when(score >= REVIEW_FROM, F.coalesce(found, F.lit(REASON_REVIEW))).otherwise(REASON_CLEAR)
    )
    return clear, reason


def aml_screen(requests: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Screen requests(name, cin, nationality, amount_cents): adds aml_clear, aml_score, aml_reason."""
    hits = person_risk(sanction_hits(requests, sanctions))
    scored = hits.withColumn("aml_score", aml_score(F.col("amount_cents")))
    clear, reason = aml_outcome(F.col("aml_score"))
    return scored.select(*requests.columns, clear.alias("aml_clear"), "aml_score", reason.alias("aml_reason"))
