"""Domain views over the test tables, written once for both engines.

Each view is (source table, row filter, {column: expression}).  `` DIV `` is
integer division and becomes `` // `` on the checking side.  Money is BIGINT
cents; "today" is a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = 20260531
_PRICE = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"

VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "loan": (
        "orders", None,
        {
            "loan_id": "o_orderkey",
            "cust_id": "o_custkey",
            "loan_type": "CASE o_orderkey % 6 WHEN 0 THEN 'CON' WHEN 1 THEN 'IMM' WHEN 2 THEN 'AUT' WHEN 3 THEN 'PRO' WHEN 4 THEN 'REV' ELSE 'DEC' END",
            "status": "CASE WHEN o_orderkey % 20 < 16 THEN 'AC' WHEN o_orderkey % 20 < 18 THEN 'RS' WHEN o_orderkey % 20 = 18 THEN 'LT' ELSE 'SD' END",
            "loan_class": "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 < 6 THEN '1' WHEN o_orderkey % 9 = 6 THEN '2' WHEN o_orderkey % 9 = 7 THEN '3' ELSE '4' END",
            "original_cents": _PRICE,
            "outstanding_cents": f"{_PRICE} * (30 + o_orderkey % 71) DIV 100",
            "payment_cents": f"{_PRICE} DIV (12 + (o_orderkey * 7) % 60)",
            "rate_e4": "75000 + (o_orderkey * 131) % 65000",
            "dpd": "CASE WHEN (o_orderkey DIV 2) % 3 = 0 THEN 0 ELSE (o_orderkey * 37) % 720 END",
            "missed": "CASE WHEN (o_orderkey DIV 2) % 3 = 0 THEN (o_orderkey DIV 5) % 2 ELSE ((o_orderkey * 37) % 720) DIV 30 END",
        },
    ),
    "cust": (
        "customer", None,
        {
            "cust_id": "c_custkey",
            "cin": "LPAD(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')",
            "first_name": "CONCAT('FIRST', CAST(c_custkey % 50 AS STRING))",
            "last_name": "CONCAT('LAST', CAST(c_custkey % 200 AS STRING))",
            "nationality": "CASE WHEN c_custkey % 41 = 0 THEN 'IRN' WHEN c_custkey % 43 = 0 THEN 'SYR' ELSE 'TUN' END",
            "employer": "CASE c_custkey % 10 WHEN 0 THEN 'BANQUE DE TUNIS' WHEN 1 THEN 'MINISTERE SANTE' WHEN 2 THEN 'TUNISIE TELECOM' WHEN 3 THEN 'ORANGE' WHEN 4 THEN 'PHARMACIE CENTRALE' WHEN 5 THEN 'HOTEL   PALACE' WHEN 6 THEN 'GROUPE POULINA' WHEN 7 THEN 'COMMERCE DETAIL' WHEN 8 THEN 'ARTISAN' ELSE 'LIBERAL' END",
            "income_cents": "CAST(ROUND(ABS(c_acctbal) * 100) AS BIGINT)",
            "kyc": "CASE WHEN c_custkey % 12 = 5 THEN 'P' WHEN c_custkey % 33 = 7 THEN 'E' ELSE 'V' END",
            "aml_flag": "CASE WHEN c_custkey % 50 = 3 THEN 'Y' ELSE 'N' END",
            "pep_flag": "CASE WHEN c_custkey % 66 = 1 THEN 'Y' ELSE 'N' END",
            "status": "CASE WHEN c_custkey % 50 = 9 THEN 'B' WHEN c_custkey % 17 = 4 THEN 'I' ELSE 'A' END",
            "segment": "CASE c_custkey % 4 WHEN 0 THEN 'MM' WHEN 1 THEN 'MB' WHEN 2 THEN 'PR' ELSE 'PB' END",
            "open_date": "(2005 + c_custkey % 20) * 10000 + (1 + c_custkey % 12) * 100 + (1 + c_custkey % 28)",
            "line1": "CONCAT(CAST(c_custkey % 90 + 1 AS STRING), ' RUE ', c_mktsegment)",
            "zip": "LPAD(CAST(1000 + c_custkey % 9000 AS STRING), 5, '0')",
            "city": "CONCAT('VILLE', CAST(c_nationkey AS STRING))",
            "raw_income": "CASE WHEN c_acctbal < 0 THEN CONCAT('  -', LPAD(CAST(CAST(ROUND(ABS(c_acctbal) * 100) AS BIGINT) AS STRING), 6, '0')) WHEN c_custkey % 7 = 0 THEN '         ' ELSE LPAD(CAST(CAST(ROUND(c_acctbal * 100) AS BIGINT) AS STRING), 9, ' ') END",
        },
    ),
    "collateral": (
        "lineitem", None,
        {
            "col_id": "l_orderkey * 10 + l_linenumber", "loan_id": "l_orderkey",
            "value_cents": "CAST(ROUND(l_extendedprice * 100) AS BIGINT)",
            "status": "CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'A' END",
        },
    ),
    "guarantee": (
        "lineitem", None,
        {
            "gtr_id": "l_orderkey * 10 + l_linenumber", "loan_id": "l_orderkey",
            "amount_cents": "CAST(ROUND(l_extendedprice * 50) AS BIGINT)",
            "status": "CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'E' END",
        },
    ),
    "sanction": (
        "customer", None,
        {
            "name_key": "CASE WHEN c_custkey % 37 = 0 THEN CONCAT('FIRST', CAST(c_custkey % 50 AS STRING), ' LAST', CAST(c_custkey % 200 AS STRING)) ELSE CONCAT('LISTED ', CAST(c_custkey AS STRING)) END",
            "cin": "CASE WHEN c_custkey % 37 = 0 THEN LPAD(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0') ELSE CONCAT('L', CAST(c_custkey AS STRING)) END",
            "list_code": "CASE (c_custkey DIV 37) % 5 WHEN 0 THEN 'UNL' WHEN 1 THEN 'EUL' WHEN 2 THEN 'OFC' WHEN 3 THEN 'TUN' ELSE 'PEP' END",
            "severity": "1 + c_custkey % 5",
        },
    ),
    "prior_action": ("orders", None, {"action_id": "o_orderkey + 1", "loan_id": "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey ELSE -o_orderkey END", "action_type": "'SMS'"}),
    "bureau": (
        "events", None,
        {
            "cust_id": "user_id", "score_date": "CAST(DATE_TRUNC('day', ts) AS DATE)",
            "score": "CAST(ROUND(value) AS BIGINT) % 200 - 100",
        },
    ),
    "sector_table": (
        "supplier", None,
        {
            "code": "CASE s_suppkey % 12 WHEN 0 THEN 'BANK' WHEN 1 THEN 'ADMI' WHEN 2 THEN 'INDS' WHEN 3 THEN 'COMM' WHEN 4 THEN 'AGRI' WHEN 5 THEN 'TOUR' WHEN 6 THEN 'CONS' WHEN 7 THEN 'TRSP' WHEN 8 THEN 'PROF' WHEN 9 THEN 'PHAR' WHEN 10 THEN 'TELE' ELSE 'AUTR' END",
            "label": "s_name", "adjustment": "CAST(s_suppkey % 61 AS BIGINT) - 30",
            "active_flag": "CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'Y' END",
        },
    ),
    "txn": (
        "events", None,
        {
            "txn_id": "event_id", "cust_id": "CASE WHEN event_id % 50 = 0 THEN -user_id - 1 ELSE user_id END", "ts": "ts",
            "txn_type": "event_type",
            "amount_cents": "CASE WHEN event_id % 3 = 0 THEN -CAST(ROUND(value * 100) AS BIGINT) ELSE CAST(ROUND(value * 100) AS BIGINT) END",
        },
    ),
    "ledger": (
        "customer", None,
        {
            "cust_id": "c_custkey", "name": "c_name", "balance_cents": "CAST(ROUND(c_acctbal * 100) AS BIGINT)",
            "status": "CASE WHEN c_custkey % 9 = 0 THEN 'C' ELSE 'A' END",
        },
    ),
    "employee": (
        "customer", None,
        {
            "emp_id": "c_custkey", "emp_name": "c_name", "rate_cents": "1000 + (c_custkey * 37) % 9000",
            "hours_tenths": "(c_custkey * 53) % 700",
            "gross_cents": "CASE WHEN c_custkey % 13 = 0 THEN 100000 + c_custkey % 100 ELSE 0 END",
            "tax_cents": "CASE WHEN c_custkey % 13 = 0 THEN 12000 ELSE 0 END",
            "net_cents": "CASE WHEN c_custkey % 13 = 0 THEN 88000 + c_custkey % 100 ELSE 0 END",
            "active": "CASE WHEN c_custkey % 11 = 0 THEN 'N' ELSE 'Y' END",
            "computed": "CASE WHEN c_custkey % 13 = 0 THEN 'Y' ELSE 'N' END",
        },
    ),
    "quote": (
        "part", None,
        {
            "quote_id": "p_partkey", "age": "16 + (p_partkey * 13) % 70", "licence_years": "(p_partkey * 5) % 45",
            "category": "CASE p_partkey % 6 WHEN 0 THEN 'TR' WHEN 1 THEN 'UT' WHEN 2 THEN 'MT' WHEN 3 THEN 'CM' WHEN 4 THEN 'LX' ELSE 'ZZ' END",
            "power": "1 + (p_partkey * 3) % 22",
            "coverage": "CASE p_partkey % 3 WHEN 0 THEN 'RC' WHEN 1 THEN 'TC' ELSE 'TI' END",
            "crm_e2": "50 + (p_partkey * 29) % 320",
            "gov": "CASE p_partkey % 8 WHEN 0 THEN 'TUN' WHEN 1 THEN 'ARI' WHEN 2 THEN 'BAR' WHEN 3 THEN 'SFX' WHEN 4 THEN 'SOU' WHEN 5 THEN 'NAB' WHEN 6 THEN 'BIZ' ELSE 'KEF' END",
            "accidents": "p_partkey % 5",
        },
    ),
    "base_line": (
        "orders", None,
        {
            "file": "CONCAT('F', CAST(o_custkey % 200 AS STRING))", "line_no": "o_orderkey",
            "text": f"CONCAT('ROW ', CAST(o_orderkey AS STRING), ' AMOUNT: ', CAST({_PRICE} AS STRING))",
        },
    ),
    "new_line": (
        "orders", "o_orderkey % 23 <> 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0",
        {
            "file": "CONCAT('F', CAST(o_custkey % 200 AS STRING))", "line_no": "o_orderkey",
            "text": "CASE"
            f" WHEN o_orderkey % 13 = 0 THEN CONCAT('ROW ', CAST(o_orderkey AS STRING), ' AMOUNT: ', CAST({_PRICE} + 1 AS STRING))"
            f" WHEN o_orderkey % 17 = 0 THEN CONCAT('LINE ', CAST(o_orderkey AS STRING), ' AMOUNT: ', CAST({_PRICE} AS STRING))"
            f" WHEN o_orderkey % 19 = 0 THEN CONCAT('ROW ', CAST(o_orderkey AS STRING), ' AMOUNT: ', CAST({_PRICE} * 2 AS STRING))"
            f" ELSE CONCAT('ROW ', CAST(o_orderkey AS STRING), ' AMOUNT: ', CAST({_PRICE} AS STRING), '  ') END",
        },
    ),
    "run": (
        "orders", None,
        {
            "run_id": "o_orderkey", "program": "CONCAT('PGM', CAST(o_custkey AS STRING))", "run_ts": "o_orderdate",
            "status": "CASE o_orderkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'not_run' ELSE 'passed' END",
            "lines_compared": "o_orderkey % 120",
            "lines_diverged": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 120) DIV 10 END",
            "lines_matched": "CASE WHEN o_orderkey % 16 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN o_orderkey % 120 + o_orderkey % 3 ELSE o_orderkey % 120 - (o_orderkey % 120) DIV 10 END",
            "diff_pct_e2": "CASE WHEN o_orderkey % 120 = 0 OR o_orderkey % 4 = 0 THEN 0 ELSE ((o_orderkey % 120) DIV 10) * 10000 DIV (o_orderkey % 120) END",
            "failed_tests": "o_orderkey % 3", "rule_tests": "o_orderkey % 7", "edge_tests": "o_orderkey % 6", "unit_tests": "o_orderkey % 8",
            "conversion_score": "o_orderkey % 101", "score": "(o_orderkey * 37) % 101",
            "retry_scope": "CASE o_orderkey % 4 WHEN 0 THEN 'paragraph:1000-MAIN' WHEN 1 THEN '3:section' WHEN 2 THEN 'program' ELSE '' END",
            "old_status": "CASE o_orderkey % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'no_stdout' WHEN 3 THEN 'skipped' WHEN 4 THEN 'fallback' WHEN 5 THEN 'runtime_failure' ELSE '' END",
            "new_status": "CASE o_orderkey % 11 WHEN 0 THEN 'compile_failure' WHEN 1 THEN 'skipped' WHEN 2 THEN 'timeout' WHEN 3 THEN '' ELSE 'success' END",
            "infra_blocker": "o_orderkey % 29 = 0",
            "execution_mode": "CASE WHEN o_orderkey % 6 = 0 THEN 'unavailable' ELSE 'executed' END",
            "paragraphs": "o_orderkey % 3",
            "attribution_method": "CASE o_orderkey % 4 WHEN 0 THEN 'display_literal' WHEN 1 THEN 'none' ELSE '' END",
            "attributed": "o_orderkey % 5",
            "failure_reason": "CASE WHEN o_orderkey % 5 = 2 THEN 'diff' ELSE '' END",
            "parse_errors": "CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END", "parse_warnings": "o_orderkey % 3", "has_parser": "o_orderkey % 37 <> 0",
            "engine": "CASE o_orderkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'deterministic' WHEN 2 THEN 'other' ELSE NULL END",
            "is_fallback": "o_orderkey % 10 = 2", "rules": "o_orderkey % 6",
            "analysis_complexity": "CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE NULL END",
            "has_code": "o_orderkey % 41 <> 0", "compiles": "CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
            "has_todo": "o_orderkey % 2 = 0", "conversion_status": "CASE o_orderkey % 5 WHEN 0 THEN 'partial' ELSE 'complete' END",
            "semantic": "(o_orderkey * 3) % 41",
        },
    ),
}

# Programs derived from part: one row per (program, line), see program_lines.
PROGRAM_TEXT = [
    "       IDENTIFICATION DIVISION.",
    "       PROGRAM-ID. PGM@P.",
    "      * comment with COPY NOTREAL.",
    "       ENVIRONMENT DIVISION.",
    "       FILE-CONTROL.",
    "           SELECT FILE-@C ASSIGN TO 'DD@C'",
    "           ORGANIZATION IS INDEXED RECORD KEY IS KEY-@C.",
    "           SELECT OUT-@M",
    "           ASSIGN TO REPORT@M.",
    "       DATA DIVISION.",
    "       FILE SECTION.",
    "       FD FILE-@C.",
    "       01 REC-@P.",
    "           COPY CPY@C.",
    "          05 KEY-@C PIC X(10).",
    "          05 AMT-@P PIC S9(9)V99 COMP-3.",
    "          05 GRP-@P.",
    "             10 NAME-@P PIC X(@W).",
    "             10 TAB-@P OCCURS @N TIMES PIC 9(5)V9(2).",
    "             10 FLAG-@P PIC X VALUE 'N'.",
    "                88 IS-ON-@P VALUES 'Y' 'S'.",
    "          05 EDIT-@P PIC ZZ,ZZ9.99.                                      OVERFLOW",
    "       PROCEDURE DIVISION.",
    "       0000-MAIN.",
    "           PERFORM 1000-WORK",
    "           PERFORM 2000-LOOP UNTIL AMT-@P > @N",
    "           IF AMT-@P > 0",
    "               PERFORM 3000-CHECK",
    "               IF FLAG-@P = 'Y'",
    "                   GO TO 4000-EXIT",
    "               END-IF",
    "           END-IF",
    "           CALL 'PGM@S' USING REC-@P AMT-@P",
    "           STOP RUN.",
    "       1000-WORK.",
    "           ADD 1 TO AMT-@P.",
    "           MOVE 'N' TO FLAG-@P.",
    "           PERFORM 3000-CHECK.",
    "       2000-LOOP.",
    "           COMPUTE AMT-@P = AMT-@P + 1.",
    "           EVALUATE FLAG-@P",
    "           WHEN 'Y' PERFORM 1000-WORK",
    "           END-EVALUATE.",
    "       3000-CHECK.",
    "           DISPLAY 'CHECK @P' NAME-@P.",
    "       4000-EXIT.",
    "           EXIT PARAGRAPH.",
    "       9000-DEAD.",
    "           DISPLAY 'DEAD @P'.",
]
PROGRAM_MARKS = {
    "@P": "CAST(p_partkey AS STRING)", "@C": "CAST(p_partkey % 20 AS STRING)", "@S": "CAST(p_partkey DIV 2 AS STRING)",
    "@M": "CAST(p_partkey % 7 AS STRING)", "@W": "CAST(p_partkey % 40 + 1 AS STRING)", "@N": "CAST(p_partkey % 12 + 3 AS STRING)",
}
# Copybooks derived from supplier: chains, a ring of two and missing books.
BOOK_TEXT = ["       01 BOOK-@B.", "          05 FIELD-@B PIC X(@W).", "           @COPY"]
BOOK_MARKS = {
    "@B": "CAST(s_suppkey AS STRING)", "@W": "CAST(s_suppkey % 30 + 1 AS STRING)",
    "@COPY": "CASE WHEN s_suppkey % 10 = 0 THEN '05 LEAF PIC 9(4).' WHEN s_suppkey % 10 = 8 THEN CONCAT('COPY CPY', CAST(s_suppkey + 1 AS STRING), '.')"
    " WHEN s_suppkey % 10 = 7 THEN CONCAT('COPY GONE', CAST(s_suppkey AS STRING), '.') WHEN s_suppkey % 10 = 3"
    " THEN CONCAT('COPY CPY', CAST(s_suppkey - 1 AS STRING), ' REPLACING ==FIELD== BY ==ITEM==.') ELSE CONCAT('COPY CPY', CAST(s_suppkey - 1 AS STRING), '.') END",
}
# Programs whose COPY statements go over lines, share lines, and stand beside literals; copybooks in two libraries with rings of six.
SPLIT_TEXT = [
    "       IDENTIFICATION DIVISION.",
    "           COPY",
    "      * a comment with COPY NOTHING.",
    "               NET@C IN LIB@L",
    "               REPLACING ==FIELD== BY ==F.@P==@E",
    "               ==OTHER== BY ==REST==.",
    "           DISPLAY 'COPY HIDDEN@P. ' COPY NET@S. COPY NET@M OF LIB@K.",
    "           MOVE 'open COPY LOST@P.",
    "      -    'more COPY GONE@P. ' TO W.",
    "           MOVE @P TO X.",
]
SPLIT_MARKS = {
    "@P": "CAST(p_partkey AS STRING)", "@C": "CAST(p_partkey % 30 AS STRING)", "@S": "CAST(p_partkey % 11 AS STRING)", "@M": "CAST(p_partkey % 17 AS STRING)",
    "@L": "CAST(p_partkey % 2 AS STRING)", "@K": "CAST((p_partkey + 1) % 2 AS STRING)", "@E": "CASE WHEN p_partkey % 3 = 0 THEN '. EXIT' ELSE '' END",
}
NET_TEXT = ["       01 NET-@B.", "          05 FIELD-@B FIELD.", "           COPY NET@N IN LIB@L.@T"]
NET_MARKS = {
    "@B": "CAST(s_suppkey AS STRING)", "@N": "CAST(CASE WHEN s_suppkey % 6 = 5 THEN s_suppkey - 5 ELSE s_suppkey + 1 END AS STRING)",
    "@L": "CAST(s_suppkey DIV 6 % 2 AS STRING)", "@T": "CASE WHEN s_suppkey % 6 = 2 THEN CONCAT(' COPY FAR', CAST(s_suppkey AS STRING), '.') ELSE '' END",
}
# Job decks derived from supplier.
DECK_TEXT = [
    "//JOB@B   JOB (ACCT),'BATCH',",
    "//         CLASS=A",
    "//* a comment",
    "//STEP01   EXEC PGM=PGM@A,",
    "//         COND=(0,NE),PARM='MODE=@B'",
    "//SYSLIB   DD  DSN=LIB.COPY,DISP=SHR",
    "//IN1      DD  DSN=DATA.SET@B,DISP=SHR",
    "//         DD  DSN=DATA.EXTRA@B,DISP=SHR",
    "//OUT1     DD  DSN=DATA.SET@N,",
    "//             DISP=(NEW,CATLG,DELETE)",
    "//STEP02   EXEC PGM=PGM@D,COND=(4,LT,STEP01)",
    "//DD@C     DD  DSN=MASTER.M@C,DISP=(MOD,KEEP)",
    "//LOG      DD  SYSOUT=*",
    "//STEP03   EXEC MYPROC,COND=(8,EQ)",
    "//SYSIN    DD  DUMMY",
]
DECK_MARKS = {
    "@B": "CAST(s_suppkey AS STRING)", "@A": "CAST(s_suppkey * 2 AS STRING)", "@D": "CAST(s_suppkey * 2 + 1 AS STRING)",
    "@N": "CAST(CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey ELSE s_suppkey + 1 END AS STRING)",
    "@C": "CAST((s_suppkey * 2 + 1) % 20 AS STRING)",
}
TEXTS = {
    "source_line": ("part", "CONCAT('PGM', CAST(p_partkey AS STRING))", PROGRAM_TEXT, PROGRAM_MARKS),
    "book_line": ("supplier", "CONCAT('CPY', CAST(s_suppkey AS STRING))", BOOK_TEXT, BOOK_MARKS),
    "split_line": ("part", "CONCAT('PGM', CAST(p_partkey AS STRING))", SPLIT_TEXT, SPLIT_MARKS),
    "net_line": ("supplier", "CONCAT('NET', CAST(s_suppkey AS STRING))", NET_TEXT, NET_MARKS),
    "deck_line": ("supplier", "CONCAT('JOB', CAST(s_suppkey AS STRING))", DECK_TEXT, DECK_MARKS),
}


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its footer is read once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled(marks: dict[str, str]) -> str:
    out = "t"
    for mark, value in marks.items():
        out = f"REPLACE({out}, '{mark}', {value})"
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain view as a DataFrame; the lines of a text meet its table as a join.

    The planner takes an explode for as small as its input, and would broadcast tens of millions of lines that come from
    a few megabytes of keys.  The size of a join without equal keys is never taken for less than it is.
    """
    if name in TEXTS:
        source, file, text, marks = TEXTS[name]
        # A small table grows many-fold here: spread its rows over the cores first.
        rows = table(spark, sf_dir, source).repartition(spark.sparkContext.defaultParallelism)
        # Marks are filled once per row, in all lines together; a line then is an element, however often it is read.
        filled = rows.withColumn("t", F.lit("\n".join(text))).selectExpr(f"{file} AS file", f"split({_filled(marks)}, '\n') AS _lines")
        places = spark.range(len(text)).select(F.col("id").alias("p"))  # some dozens of fixed lines
        # A condition on the lines has them computed in front of the loop over places; a plain cross join leaves that to the first
        # use, which is inside the loop: each line then costs the filling of a whole text.
        return filled.join(F.broadcast(places), F.expr("p < size(_lines)")).selectExpr("file", "p + 1 AS line_no", "element_at(_lines, CAST(p + 1 AS INT)) AS text")
    source, keep, columns = VIEWS[name]
    df = table(spark, sf_dir, source)
    if keep:
        df = df.where(keep)
    out = df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    # INT literals meet BIGINT columns in the other engine: align whole numbers.
    return out.select(*[out[c].cast("bigint") if t == "int" else out[c] for c, t in out.dtypes])


def check_sql(name: str) -> str:
    """The same view for the checking engine."""
    if name in TEXTS:
        source, file, text, marks = TEXTS[name]
        lines = "[" + ", ".join(_quoted(t) for t in text) + "]"
        body = f"SELECT {file} AS file, n AS line_no, {_filled(marks)} AS text FROM (SELECT *, UNNEST({lines}) AS t, UNNEST(range(1, {len(text) + 1})) AS n FROM {source})"
    else:
        source, keep, columns = VIEWS[name]
        body = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}" + (f" WHERE {keep}" if keep else "")
    return body.replace(" DIV ", " // ")


def with_views(names: str, body: str) -> str:
    """A checking query over the named views; other named parts follow in ``body``."""
    ctes = ", ".join(f"{n} AS ({check_sql(n)})" for n in names.split())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
