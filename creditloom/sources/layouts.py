"""Record layouts of the fixed-width tables.

Fixed values: field name, kind, width.  Kinds: ``x`` text, ``9`` unsigned
digits, ``p`` packed signed decimal (width in bytes), ``-`` filler.
"""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    name: str
    kind: str
    width: int
    scale: int = 0


def layout(*fields: tuple) -> list[Field]:
    return [Field(*f) for f in fields]


LOAN = layout(
    ("loan_id", "9", 10), ("cust_id", "9", 8), ("acct_id", "9", 10), ("loan_type", "x", 3), ("status", "x", 2),
    ("loan_class", "x", 1), ("original_cents", "9", 13, 2), ("outstanding_cents", "9", 13, 2),
    ("payment_cents", "9", 9, 2), ("rate_e4", "9", 6, 4), ("rate_type", "x", 1), ("start_date", "9", 8),
    ("maturity_date", "9", 8), ("last_pmt_date", "9", 8), ("next_pmt_date", "9", 8), ("pmts_made", "9", 4),
    ("pmts_total", "9", 4), ("dpd", "9", 4), ("missed", "9", 3), ("prov_rate_e4", "9", 6, 4),
    ("provision_cents", "9", 11, 2), ("collateral_type", "x", 3), ("collateral_cents", "9", 13, 2),
    ("guarantor_id", "9", 8), ("branch", "9", 4), ("officer_id", "9", 6), ("purpose", "x", 40),
    ("restructure_date", "9", 8), ("write_off_date", "9", 8), ("filler", "-", 8),
)
CUSTOMER = layout(
    ("cust_id", "9", 8), ("cin", "x", 8), ("passport", "x", 12), ("cust_type", "x", 2), ("last_name", "x", 30),
    ("first_name", "x", 25), ("birth_date", "9", 8), ("nationality", "x", 3), ("gender", "x", 1),
    ("marital", "x", 1), ("address.line1", "x", 40), ("address.line2", "x", 40), ("address.city", "x", 20),
    ("address.zip", "x", 5), ("address.gov", "x", 3), ("mobile", "x", 12), ("home_phone", "x", 12),
    ("email", "x", 50), ("employer", "x", 40), ("job_title", "x", 30), ("income_cents", "9", 9, 2),
    ("verified", "x", 1), ("segment", "x", 2), ("risk_rating", "9", 2), ("kyc", "x", 1), ("kyc_expiry", "9", 8),
    ("aml_flag", "x", 1), ("pep_flag", "x", 1), ("open_date", "9", 8), ("status", "x", 1), ("manager_id", "9", 6),
    ("branch", "9", 4), ("assets_cents", "9", 15, 2), ("liabilities_cents", "9", 15, 2), ("filler", "-", 10),
)
COLLATERAL = layout(
    ("col_id", "9", 10), ("loan_id", "9", 10), ("cust_id", "9", 8), ("collateral_type", "x", 3),
    ("description", "x", 60), ("location", "x", 40), ("value_cents", "9", 13, 2), ("appraisal_date", "9", 8),
    ("appraisal_firm", "x", 30), ("coverage_e2", "9", 5, 2), ("insurance_num", "x", 20),
    ("insurance_expiry", "9", 8), ("registration", "x", 20), ("status", "x", 1), ("filler", "-", 17),
)
GUARANTEE = layout(
    ("gtr_id", "9", 10), ("loan_id", "9", 10), ("guarantor_id", "9", 8), ("guarantor_name", "x", 50),
    ("amount_cents", "9", 13, 2), ("income_cents", "9", 9, 2), ("sign_date", "9", 8), ("expiry_date", "9", 8),
    ("status", "x", 1), ("filler", "-", 13),
)
SANCTION = layout(
    ("name_key", "x", 55), ("cin", "x", 8), ("birth_date", "9", 8), ("nationality", "x", 3), ("list_code", "x", 3),
    ("severity", "9", 1), ("reason", "x", 60), ("list_date", "9", 8), ("filler", "-", 54),
)
SCORE_RESULT = layout(
    ("result_id", "9", 12), ("loan_id", "9", 10), ("cust_id", "9", 8), ("score_date", "9", 8), ("score", "9", 4),
    ("decision", "x", 2), ("max_loan_cents", "9", 13, 2), ("max_rate_e4", "9", 6, 4), ("reason_1", "x", 50),
    ("reason_2", "x", 50), ("reason_3", "x", 50), ("analyst_id", "9", 6), ("filler", "-", 10),
)
RECOVERY_ACTION = layout(
    ("action_id", "9", 12), ("loan_id", "9", 10), ("cust_id", "9", 8), ("action_date", "9", 8),
    ("action_time", "9", 6), ("action_type", "x", 3), ("claimed_cents", "9", 13, 2), ("recovered_cents", "9", 13, 2),
    ("response", "x", 1), ("next_action_date", "9", 8), ("officer_id", "9", 6), ("legal_firm", "x", 40),
    ("court_case", "x", 20), ("comments", "x", 80), ("filler", "-", 10),
)
LEDGER_CUSTOMER = layout(
    ("cust_id", "x", 10), ("name", "x", 30), ("address", "x", 50), ("balance_cents", "p", 6, 2),
    ("limit_cents", "p", 6, 2), ("status", "x", 1),
)
LEDGER_TXN = layout(
    ("txn_id", "x", 10), ("cust_id", "x", 10), ("txn_type", "x", 2), ("amount_cents", "p", 5, 2), ("txn_date", "9", 8),
)


def width(fields: list[Field]) -> int:
    return sum(f.width for f in fields)
