"""Report and file sinks: lines as DataFrames with an order, then ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import edited, idiv, zoned
from creditloom.operators.ordered import number_by_id, paginate
from creditloom.plans.report import LOAN_TYPES, SEGMENTS, TYPE_LABELS
from creditloom.plans.risk import CLASSES

WIDTH = 137
# Report texts.
FOOTER = " " * 20 + "DOCUMENT CONFIDENTIEL - USAGE INTERNE BCT"
DECISION_TITLE = "RAPPORT EVALUATION CREDITS - PRODUCTION"
RISK_TITLE = "RAPPORT CLASSIFICATION CREANCES BCT"
RECOVERY_TITLE = "RAPPORT ESCALADE RECOUVREMENT"
MONTH_TITLE = "RAPPORT MENSUEL CREDIT - DIRECTION GENERALE"
DECISION_LABELS = {"AP": "APPROUVE", "CO": "CONDITIONNEL", "RV": "A ETUDIER", "DC": "REFUSE"}
LOAN_HEADINGS = [("DOSSIER", 10), ("CLIENT", 8), ("TYPE", 5), ("MONTANT", 14), ("TAUX", 8), ("SCORE", 6), ("DECISION", 10)]
CLASS_LABELS = {"1": "CLASSE 1 (COURANTS) ", "2": "CLASSE 2 (30-90J)   ", "3": "CLASSE 3 (90-180J)  ", "4": "CLASSE 4 (>180J)    "}


def fit(c: Column, width: int = WIDTH) -> Column:
    return F.rpad(F.substring(c, 1, width), width, " ")


def main_header(bank: str, program: str, page: Column | int) -> Column:
    page = F.lit(page) if isinstance(page, int) else page
    lead = " " * 10 + bank[:25].ljust(25) + " " * 5 + program[:8].ljust(8) + " " * 5 + "PAGE: "
    return fit(F.concat(F.lit(lead), edited(page, 0, 5)))


def sub_header(title: str, today: int) -> Column:
    return fit(F.lit(" " * 15 + title[:60].ljust(60) + " " * 5 + "DATE: " + str(today)))


def rule(ch: str = "=") -> Column:
    return F.lit(ch * WIDTH)


def loan_heading() -> Column:
    return fit(F.lit("".join("  " + text.ljust(n) for text, n in LOAN_HEADINGS)))


def _rows(spark, section: int, lines: list[Column], source: DataFrame | None = None) -> DataFrame:
    """Constant lines, or lines over a one-row summary, as (section, seq, part, value)."""
    src = spark.range(1) if source is None else source
    return src.select(
        F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("seq"),
        F.posexplode(F.array(*[fit(c) for c in lines])).alias("part", "value"),
    )


def decision_report(scored: DataFrame, stats: DataFrame, bank: str, program: str, today: int) -> DataFrame:
    """Decision lines with page breaks, header and totals: (section, seq, part, value)."""
    spark = scored.sparkSession
    head = _rows(spark, 0, [main_header(bank, program, 1), sub_header(DECISION_TITLE, today), rule(), loan_heading(), rule()])
    label = None
    for code, text in DECISION_LABELS.items():
        label = F.when(F.col("decision") == code, text) if label is None else label.when(F.col("decision") == code, text)
    gap = F.lit("  ")
    line = F.concat(
        zoned(F.col("loan_id"), 10), gap, zoned(F.col("cust_id"), 8), gap, F.rpad("loan_type", 3, " "), gap,
        edited(F.col("original_cents"), 2, 10, 3, point=","), gap, edited(F.col("rate_e4"), 4, 2, 4, point=","), gap,
        edited(F.col("score"), 0, 4), gap, F.rpad(label, 11, " "), gap, F.rpad(F.coalesce("reason_1", F.lit("")), 50, " "),
    )
    numbered = number_by_id(scored, "loan_id", "line_no")
    starts, page = paginate(F.col("line_no"))
    parts = F.when(starts, F.array(main_header(bank, program, page), rule(), fit(line))).otherwise(F.array(fit(line)))
    body = numbered.select(F.lit(1).alias("section"), F.col("line_no").alias("seq"), F.posexplode(parts).alias("part", "value"))
    n = lambda c: zoned(F.col(c), 8)
    money = lambda c: zoned(F.col(c), 15)
    tail = _rows(
        spark, 2,
        [
            rule(),
            F.concat(F.lit("TOTAUX: TRAITES="), n("read_count"), F.lit(" APPROUVES="), n("approved_count"),
                     F.lit(" CONDITIONNEL="), n("conditional_count"), F.lit(" REFUSES="), n("declined_count")),
            F.concat(F.lit("MONTANT TOTAL: "), money("total_cents"), F.lit("  APPROUVE: "), money("approved_cents")),
            F.lit(FOOTER),
        ],
        stats,
    )
    return head.unionByName(body).unionByName(tail)


def reject_lines(evaluated: DataFrame) -> DataFrame:
    """120-column reject log, one line per rejected or erroneous loan."""
    bad = evaluated.where(F.col("outcome") != "SCORED")
    line = F.concat(zoned(F.col("loan_id"), 10), F.lit("  "), zoned(F.col("cust_id"), 8), F.lit("  "), F.rpad("reject_reason", 80, " "))
    return bad.select("loan_id", fit(line, 120).alias("value"))


def bct_lines(classified: DataFrame, bank_code: int, today: int) -> DataFrame:
    """200-column regulatory rows."""
    gap = F.lit("  ")
    line = F.concat(
        F.lit(str(bank_code).zfill(4)), gap, F.lit(str(today)), gap, zoned(F.col("loan_id"), 10), gap, zoned(F.col("cust_id"), 8),
        gap, F.col("loan_class"), gap, zoned(F.col("outstanding_cents"), 13), gap, zoned(F.col("provision_cents"), 13), gap,
        zoned(F.col("dpd"), 4), gap, F.col("recovery_flag"),
    )
    return classified.select("loan_id", fit(line, 200).alias("value"))


def risk_summary_lines(totals: DataFrame, bank: str, program: str, today: int) -> DataFrame:
    """Header and class lines of the classification report."""
    spark = totals.sparkSession
    one = totals.agg(
        *[F.max(F.when(F.col("loan_class") == k, F.struct("loans", "outstanding_cents", "provision_cents"))).alias(f"c{k}") for k in CLASSES],
        F.sum("provision_cents").alias("p"),
    )
    lines = [main_header(bank, program, 1), sub_header(RISK_TITLE, today), rule(), rule()]
    for k in CLASSES:
        lines.append(
            F.concat(F.lit(CLASS_LABELS[k] + ": CNT="), zoned(F.col(f"c{k}.loans"), 6), F.lit(" ENC="),
                     zoned(F.col(f"c{k}.outstanding_cents"), 15), F.lit(" PROV="), zoned(F.col(f"c{k}.provision_cents"), 13))
        )
    lines += [F.concat(F.lit("TOTAL PROVISIONS    : "), zoned(F.col("p"), 15)), F.lit(FOOTER)]
    return _rows(spark, 0, lines, one)


def escalation_lines(actions: DataFrame, totals: DataFrame, by_action: DataFrame, bank: str, program: str, today: int) -> DataFrame:
    """Header, one line per action in queue order, class and action summary."""
    spark = actions.sparkSession
    head = _rows(spark, 0, [main_header(bank, program, 1), sub_header(RECOVERY_TITLE, today), rule()])
    line = F.concat(
        zoned(F.col("loan_id"), 10), F.lit("  "), zoned(F.col("cust_id"), 8), F.lit("  CL:"), F.col("loan_class"), F.lit("  DPD:"),
        zoned(F.col("dpd"), 4), F.lit("  AMT:"), zoned(idiv(F.col("claimed_cents"), 100), 13), F.lit("  ACT:"), F.col("action_type"),
    )
    body = actions.select(F.lit(1).alias("section"), F.col("action_id").alias("seq"), F.lit(0).alias("part"), fit(line).alias("value"))
    klass = totals.agg(*[F.max(F.when(F.col("loan_class") == k, F.struct("loans", "amount_cents"))).alias(f"c{k}") for k in "234"])
    codes = ("SMS", "EML", "PHN", "DUL", "LEG", "GTR", "RST", "CRT", "CSZ", "WOF")
    acts = by_action.agg(*[F.max(F.when(F.col("action_type") == a, F.col("actions"))).alias(a) for a in codes])
    cl = [
        F.concat(F.lit("  " + CLASS_LABELS[k] + ": "), zoned(F.col(f"c{k}.loans"), 6), F.lit(" LOANS  ENC: "), zoned(F.col(f"c{k}.amount_cents"), 15))
        for k in "234"
    ]
    n = lambda a: zoned(F.col(a), 6)
    lit = F.lit
    act = [
        F.concat(lit("  SMS    : "), n("SMS"), lit("  EMAIL: "), n("EML"), lit("  TEL  : "), n("PHN"), lit("  DUL  : "), n("DUL")),
        F.concat(lit("  LEG    : "), n("LEG"), lit("  GTR  : "), n("GTR"), lit("  RST  : "), n("RST"), lit("  CRT  : "), n("CRT")),
        F.concat(lit("  CSZ    : "), n("CSZ"), lit("  WOF  : "), n("WOF")),
    ]
    mid = _rows(spark, 2, [rule(), lit("RESUME PAR CLASSE"), *cl], klass)
    end = _rows(spark, 3, [rule(), lit("ACTIONS GENEREES"), *act, lit(FOOTER)], acts)
    return head.unionByName(body).unionByName(mid).unionByName(end)


def _amount(c: Column) -> Column:
    """Whole units in a 15-wide picture of comma groups; the last three digits always print."""
    v = idiv(c, 100)
    head = F.when(v >= 1000, _group(idiv(v, 1000))).otherwise("0")
    return F.lpad(F.concat(head, F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0")), 15, " ")


def _group(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")


def _percent(c_e2: Column) -> Column:
    """The printed picture has no decimal point: whole percent behind a comma."""
    v = idiv(c_e2, 100)
    return F.concat(F.lpad(idiv(v, 100).cast("string"), 3, " "), F.lit(","), F.lpad((v % 100).cast("string"), 2, "0"))


def month_report(
    by_class: DataFrame, totals: DataFrame, top: DataFrame, by_segment: DataFrame, by_type: DataFrame, ratios: DataFrame,
    bank: str, program: str, today: int, version: str = "v2.3",
) -> DataFrame:
    """Cover, five sections and footer as (section, seq, part, value).

    The report has a few dozen lines whatever the portfolio size.
    """
    spark = totals.sparkSession
    lit = F.lit

    def title(section: int, text: str) -> DataFrame:
        return _rows(spark, section, [lit(""), lit(text), rule()]).withColumn("seq", lit(-1).cast("bigint"))

    def table(section: int, df: DataFrame, seq: Column, line: Column) -> DataFrame:
        return df.select(lit(section).alias("section"), seq.cast("bigint").alias("seq"), lit(0).alias("part"), fit(line).alias("value"))

    def position(col: str, codes) -> Column:
        return F.array_position(F.array(*[lit(c) for c in codes]), F.col(col))

    count = lambda c: F.lpad(_group(F.col(c)), 7, " ")
    cover = _rows(
        spark, 0,
        [main_header(bank, program, 1), sub_header(MONTH_TITLE, today), rule(), lit(""), lit(f"   {bank} - DIRECTION DU CREDIT"),
         lit(f"   PERIODE: {today}"), lit("   CONFIDENTIEL - USAGE INTERNE"), rule()],
    )
    s1 = table(1, by_class, position("loan_class", CLASSES),
               F.concat(lit("  CLASSE "), F.col("loan_class"), lit("   COUNT="), count("loans"), lit("   ENC="), _amount(F.col("outstanding_cents"))))
    total_lines = _rows(
        spark, 1,
        [F.concat(lit("  TOTAL ENCOURS         : "), _amount(F.col("outstanding_cents"))),
         F.concat(lit("  TOTAL PROVISIONS     : "), _amount(F.col("provision_cents")), lit("   TAUX PROV: "), _percent(F.coalesce("provision_pct_e2", lit(0))), lit("%")),
         F.concat(lit("  TAUX MOYEN PONDERE   : "), F.lpad(F.concat(lit("0,"), F.lpad(idiv(F.coalesce("avg_rate_e4", lit(0)), 10_000).cast("string"), 4, "0")), 7, " "), lit("%"))],
        totals,
    ).withColumn("seq", lit(100).cast("bigint"))
    # n rows of the top list: a fixed size, so one small sort numbers them.
    placed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("outstanding_cents")).alias("neg"), "loan_id", "cust_name", "loan_class", "loan_type", "outstanding_cents"))).alias("t"))
    ranked = placed.select(F.posexplode("t").alias("p", "r")).select("p", "r.*")
    s2 = table(2, ranked, F.col("p"),
               F.concat(lit("  #"), ((F.col("p") + 1) % 10).cast("string"), lit("  "), zoned(F.col("loan_id"), 10), lit("  "),
                        F.rpad("cust_name", 40, " "), lit("  CL:"), F.rpad("loan_class", 1, " "), lit("  "), F.col("loan_type"), lit("  ENC:"), _amount(F.col("outstanding_cents"))))
    s3 = table(3, by_segment, position("segment", SEGMENTS),
               F.concat(lit("  SEGMENT "), F.col("segment"), lit("   CNT="), count("loans"), lit("   ENC="), _amount(F.col("outstanding_cents"))))
    label = None
    for code, text in TYPE_LABELS.items():
        label = F.when(F.col("loan_type") == code, text) if label is None else label.when(F.col("loan_type") == code, text)
    s4 = table(4, by_type, position("loan_type", LOAN_TYPES),
               F.concat(lit("  "), F.col("loan_type"), lit(" "), F.rpad(label, 20, " "), lit("  CNT="), count("loans"), lit("  AMT="), _amount(F.col("outstanding_cents"))))
    half_up = lambda c: idiv(F.coalesce(c, lit(0)) + lit(50), 100) * lit(100)
    s5 = _rows(
        spark, 5,
        [F.concat(lit("  RATIO NPL (CL 2-3-4) : "), _percent(half_up(F.col("npl_pct_e2"))), lit("%")),
         F.concat(lit("  RATIO PERTES (CL 4)  : "), _percent(half_up(F.col("loss_pct_e2"))), lit("%")),
         F.concat(lit("  TAUX COUVERTURE PROV : "), _percent(half_up(F.col("coverage_pct_e2"))), lit("%"))],
        ratios,
    )
    foot = _rows(spark, 6, [lit(""), rule(), lit(f"  FIN DU RAPPORT - GENERE PAR {program} {version}"), lit(FOOTER)])
    out = cover
    for part in (title(1, "SECTION 1 - REPARTITION DU PORTEFEUILLE PAR CLASSE"), s1, total_lines,
                 title(2, "SECTION 2 - TOP 10 EXPOSITIONS"), s2, title(3, "SECTION 3 - REPARTITION PAR SEGMENT CLIENT"), s3,
                 title(4, "SECTION 4 - VENTILATION PAR TYPE DE CREDIT"), s4, title(5, "SECTION 5 - INDICATEURS DE RISQUE"), s5, foot):
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "seq", "part")) -> None:
    """Range-partitioned sort, one file per range; file-name order is line order."""
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)
