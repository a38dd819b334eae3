"""Named predicates over code columns, and the row checks built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.text import refmod

# Condition name -> (column, codes that make it true).
CONDITIONS = {
    "loan_consumer": ("loan_type", ["CON"]),
    "loan_mortgage": ("loan_type", ["IMM"]),
    "loan_auto": ("loan_type", ["AUT"]),
    "loan_business": ("loan_type", ["PRO"]),
    "loan_revolving": ("loan_type", ["REV"]),
    "loan_overdraft": ("loan_type", ["DEC"]),
    "loan_active": ("status", ["AC"]),
    "loan_restructured": ("status", ["RS"]),
    "loan_litigious": ("status", ["LT"]),
    "loan_settled": ("status", ["SD"]),
    "loan_written_off": ("status", ["WO"]),
    "loan_class_1": ("loan_class", ["1"]),
    "loan_class_2": ("loan_class", ["2"]),
    "loan_class_3": ("loan_class", ["3"]),
    "loan_class_4": ("loan_class", ["4"]),
    "loan_fixed_rate": ("rate_type", ["F"]),
    "loan_variable_rate": ("rate_type", ["V"]),
    "loan_secured_property": ("collateral_type", ["IMM"]),
    "loan_secured_vehicle": ("collateral_type", ["VEH"]),
    "loan_secured_deposit": ("collateral_type", ["DEP"]),
    "loan_unsecured": ("collateral_type", ["NON"]),
    "cust_individual": ("cust_type", ["PP"]),
    "cust_corporate": ("cust_type", ["PM"]),
    "cust_non_resident": ("cust_type", ["NR"]),
    "cust_male": ("gender", ["M"]),
    "cust_female": ("gender", ["F"]),
    "cust_single": ("marital", ["S"]),
    "cust_married": ("marital", ["M"]),
    "cust_divorced": ("marital", ["D"]),
    "cust_widowed": ("marital", ["W"]),
    "income_verified": ("verified", ["Y"]),
    "segment_mass": ("segment", ["MM"]),
    "segment_middle": ("segment", ["MB"]),
    "segment_premium": ("segment", ["PR"]),
    "segment_private": ("segment", ["PB"]),
    "kyc_ok": ("kyc", ["V"]),
    "kyc_pending": ("kyc", ["P"]),
    "kyc_expired": ("kyc", ["E"]),
    "aml_alert": ("aml_flag", ["Y"]),
    "is_pep": ("pep_flag", ["Y"]),
    "cust_active": ("status", ["A"]),
    "cust_inactive": ("status", ["I"]),
    "cust_blacklisted": ("status", ["B"]),
    "collateral_real_estate": ("collateral_type", ["IMM"]),
    "collateral_vehicle": ("collateral_type", ["VEH"]),
    "collateral_financial": ("collateral_type", ["FIN"]),
    "collateral_guarantee": ("collateral_type", ["GAR"]),
    "collateral_active": ("status", ["A"]),
    "collateral_released": ("status", ["R"]),
    "collateral_seized": ("status", ["S"]),
    "guarantee_active": ("status", ["A"]),
    "guarantee_called": ("status", ["C"]),
    "guarantee_expired": ("status", ["E"]),
}

# Reject and error texts.
ERR_ID = "LOAN-ID IS ZERO - INVALID RECORD"
ERR_AMOUNT = "LOAN AMOUNT IS ZERO"
ERR_STATUS = "LOAN STATUS NOT ELIGIBLE FOR EVALUATION"
ERR_CUSTOMER = "CUSTOMER NOT FOUND: "
REJ_BLACKLIST = "CLIENT BLACKLISTE - DEMANDE REFUSEE"
REJ_AML = "ALERTE AML EN COURS"
REJ_KYC = "KYC NON VALIDE - STATUT: "
REJ_INACTIVE = "CLIENT INACTIF"

# Employer prefix (compared over its full padded length) -> sector.
SECTOR_PREFIXES = [
    ("BANQUE", "BANK"),
    ("MINISTERE ", "ADMI"),
    ("TUNISIE ", "TELE"),
    ("ORANGE", "TELE"),
    ("OOREDOO", "TELE"),
    ("PHARMACI", "PHAR"),
    ("HOTEL   ", "TOUR"),
    ("TUNISA", "TOUR"),
    ("GROUPE ", "INDS"),
    ("COMMERCE", "COMM"),
    ("ARTISAN", "COMM"),
]
SECTOR_OTHER = "AUTR"

# Sector code -> label and score adjustment.
SECTOR_ADJUSTMENTS = [
    ("BANK", "SECTEUR BANCAIRE", 25),
    ("ADMI", "ADMINISTRATION PUBLIQUE", 30),
    ("INDS", "INDUSTRIE MANUFACTURIERE", 15),
    ("COMM", "COMMERCE GROS DETAIL", 5),
    ("AGRI", "AGRICULTURE PECHE", -10),
    ("TOUR", "TOURISME HOTELLERIE", -15),
    ("CONS", "CONSTRUCTION BTP", -5),
    ("TRSP", "TRANSPORT LOGISTIQUE", 10),
    ("PROF", "PROFESSIONS LIBERALES", 20),
    ("PHAR", "PHARMACIE SANTE", 25),
    ("TELE", "TELECOMMUNICATIONS", 20),
    ("AUTR", "AUTRES SECTEURS", 0),
]


def condition(name: str, prefix: str = "") -> Column:
    column, codes = CONDITIONS[name]
    return F.col(prefix + column).isin(*codes)


def in_portfolio(status: Column) -> Column:
    """Active or restructured."""
    return status.isin("AC", "RS")


def check_preconditions(loan_id: Column, original: Column, status: Column) -> Column:
    """First failing pre-condition, or NULL."""
    return (
        F.when(loan_id == 0, ERR_ID).when(original == 0, ERR_AMOUNT).when(~in_portfolio(status), ERR_STATUS)
    )


def check_customer(status: Column, aml_flag: Column, kyc: Column) -> Column:
    """First failing customer check, or NULL.  A PEP flag never rejects."""
    return (
        F.when(status == "B", REJ_BLACKLIST)
        .when(aml_flag == "Y", REJ_AML)
        .when(kyc != "V", F.concat(F.lit(REJ_KYC), kyc))
        .when(status != "A", REJ_INACTIVE)
    )


def sector_of(employer: Column) -> Column:
    """Sector code from the employer name; the first rule wins."""
    out = None
    for prefix, code in SECTOR_PREFIXES:
        hit = refmod(employer, 1, len(prefix)) == prefix
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(SECTOR_OTHER)


def default_sector_adjustment(sector: Column) -> Column:
    """The constant table as an expression: no join for twelve rows."""
    out = None
    for code, _label, points in SECTOR_ADJUSTMENTS:
        out = F.when(sector == code, points) if out is None else out.when(sector == code, points)
    return out.otherwise(0).cast("bigint")


def normalize_income(raw: Column) -> Column:
    """Blanks and hyphens become zeros; read as seven digits and two decimals."""
    digits = F.rpad(F.translate(F.rpad(F.substring(raw, 1, 9), 9, " "), " -", "00"), 9, "0")
    whole = F.substring(digits, 1, 7).cast("bigint")
    cents = F.substring(digits, 8, 2).cast("bigint")
    return whole * F.lit(100) + cents


def delinquent_priority(klass: Column) -> Column:
    """Queue priority of class 2, 3, 4; NULL otherwise."""
    return F.when(klass == "2", 100).when(klass == "3", 200).when(klass == "4", 300).cast("bigint")


def bureau_fallback(cust_id: Column) -> Column:
    """Stand-in bureau adjustment when no bureau table is given."""
    return (F.pmod(cust_id, F.lit(200)) - F.lit(100)).cast("bigint")
